"""Structured Streaming forms of the jobs whose input keeps arriving."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import annotate, economics, memory

MESSAGE_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


# Paces micro-batches; results do not depend on it.
BATCH_BYTES = 2_000_000_000


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxBytesPerTrigger", batch_bytes)
    return reader.parquet(folder)


def message_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Message files of a folder as a stream (IO14)."""
    return file_stream(spark, folder, pattern, MESSAGE_SCHEMA, batch_bytes)


def table_stream(spark: SparkSession, folder: str, name: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A given table as a stream, be it one file or a folder of part files."""
    # a plain path must be a folder, and a name filter on the folder above does not see part files; a glob takes both
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{folder}/{name}.parque[t]")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet files and stop; a restart continues from the checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id: a batch replayed after a failure replaces its own earlier output
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# S1 --------------------------------------------------------------------------
def annotate_stream(messages: DataFrame) -> DataFrame:
    """Annotations of arriving messages: the batch projection, unchanged, on a stream."""
    return annotate.annotate(messages)


# S2 --------------------------------------------------------------------------
def statement_stream(messages: DataFrame) -> DataFrame:
    """Statements of arriving messages, row by row: nothing is kept between batches, in whatever order they come."""
    return annotate.statements_of(annotate.annotate(messages))


def stored_items(statements: DataFrame) -> DataFrame:
    """Memory items of all statements that a stream has stored; a statement stored twice counts once."""
    events = memory.memory_events(statements.dropDuplicates(["conv_id", "turn", "idx"]))
    return memory.memory_items(events).drop("created_at")


# S4 --------------------------------------------------------------------------
def ledger_stream(runs: DataFrame) -> DataFrame:
    """Running token totals per count source over arriving runs."""
    percent = economics.reduction_percent(F.col("original_tokens"), F.col("compiled_tokens"))
    return runs.groupBy("count_source").agg(
        F.count("*").alias("runs"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("compiled_tokens").alias("compiled_tokens"),
        F.sum(F.col("original_tokens") - F.col("compiled_tokens")).alias("tokens_avoided"),
        F.avg(percent).alias("avg_reduction_percent"),
    )


def run_updates(runs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Arriving runs once each: a run that comes again within ``lateness`` of event time is left out, later state is dropped.

    Needs run_id and created_at; a run that is later than ``lateness`` behind the newest one is not counted.
    """
    return runs.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["run_id"])


def write_updates(runs: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available: each batch writes what it adds to the totals of its days, nothing rewrites them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch replayed after a failure replaces its own earlier share
        added = batch.groupBy(F.to_date("created_at").alias("day"), "count_source").agg(
            F.count("*").alias("runs"), F.sum("original_tokens").alias("original_tokens"), F.sum("compiled_tokens").alias("compiled_tokens")
        )
        added.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    runs.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_totals(added: DataFrame) -> DataFrame:
    """Totals by day and count source out of what the batches added."""
    sums = [F.sum(c).alias(c) for c in ("runs", "original_tokens", "compiled_tokens")]
    return added.groupBy("day", "count_source").agg(*sums)
