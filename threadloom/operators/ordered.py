"""Ordered per-key operations that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here every
key is cut into order-preserving buckets: the window runs inside (key, bucket),
and only one summary row per bucket is combined along the key. With buckets of
bounded size this needs no task larger than one bucket or one summary list.
"""

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def span_of(position: Column) -> Column:
    return F.floor(position / SPAN).cast("bigint")


def block_of(identifier: Column) -> Column:
    """Coarse bucket of an ever-growing id: at most a million rows where ids are unique."""
    return F.floor(identifier / 2**20).cast("bigint")


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by sort and merge, never broadcast.

    Spark plans broadcasts by the size of Parquet files. Keys and flags shrink there to a hundredth of
    their rows in memory, so a table of a few MB would fill the driver's memory.
    """
    return df.hint("merge")


def _earlier(keys, bucket):
    return Window.partitionBy(*keys).orderBy(*bucket)


def positions(df: DataFrame, keys: list[str], bucket: list[str], order: list, out: str = "pos", start: int = 0) -> DataFrame:
    """Dense 0-based position of each row within ``keys``; ``bucket`` is a prefix of ``order``."""
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order)
    before = (
        df.groupBy(*keys, *bucket)
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.sum("_size").over(_earlier(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, *bucket, F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn("_rank", F.row_number().over(inside))
        .join(merged(before), [*keys, *bucket])
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1 + start).cast("bigint"))
        .drop("_before", "_rank")
    )


def running_sums(df: DataFrame, keys: list[str], bucket: list[str], order: list, sums: dict[str, Column], include_row: bool = True) -> DataFrame:
    """Running totals in order; ``sums`` maps each new column to the summed expression."""
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_row else -1)
    along = _earlier(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, *bucket).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    totals = totals.select(*keys, *bucket, *[F.coalesce(F.sum(f"_t_{n}").over(along), F.lit(0)).alias(f"_t_{n}") for n in sums])
    out = df.withColumns({f"_i_{n}": F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()})
    out = out.join(merged(totals), [*keys, *bucket])
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_t_{n}") for n in sums}).drop(*[f"_{k}_{n}" for k in "it" for n in sums])


def carry(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], value: Column, out: str, include_row: bool) -> DataFrame:
    """Last non-null ``value`` before a row (or up to it) within ``keys``."""
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_row else -1)
    last = (
        df.select(*keys, *bucket, F.struct(*order).alias("_at"), value.alias("_value"))
        .groupBy(*keys, *bucket)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_value"))
    )
    last = last.select(
        *keys,
        *bucket,
        F.last("_value", ignorenulls=True).over(_earlier(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
    )
    return (
        df.withColumn(out, F.last(value, ignorenulls=True).over(inside))
        .join(merged(last), [*keys, *bucket])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop("_carried")
    )


def running_max(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Largest non-null ``value`` up to each row within ``keys``."""
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = df.groupBy(*keys, *bucket).agg(F.max(value).alias("_top"))
    tops = tops.select(*keys, *bucket, F.max("_top").over(_earlier(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    return df.withColumn(out, F.max(value).over(inside)).join(merged(tops), [*keys, *bucket]).withColumn(out, F.greatest(out, "_top")).drop("_top")


def following(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``value`` of the next row within ``keys``, NULL for the last."""
    first = df.groupBy(*keys, *bucket).agg(F.min_by(value, F.struct(*order)).alias("_next"))
    first = first.select(*keys, *bucket, F.lead("_next").over(_earlier(keys, bucket)).alias("_next"))
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order)
    return df.withColumn(out, F.lead(value).over(inside)).join(merged(first), [*keys, *bucket]).withColumn(out, F.coalesce(out, "_next")).drop("_next")


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], position: Column, upto: Column, how: str = "inner") -> DataFrame:
    """Join one-row-per-key facts to many rows per key, span by span.

    The facts are repeated once per span of 4096 positions, so the rows of one
    hot key spread over many join keys; ``upto`` is the last position needed.
    """
    spread = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), span_of(F.greatest(upto, F.lit(0))))))
    return rows.withColumn("_part", span_of(position)).join(merged(spread), [*keys, "_part"], how).drop("_part")


def attach_present(rows: DataFrame, facts: DataFrame, keys: list[str], position: Column, how: str = "left") -> DataFrame:
    """Join facts (one row per key) to many rows per key when the keys are too many to repeat per span.

    A fact is repeated only for the spans in which its key occurs, so the copies
    never exceed the rows they serve, and a hot key spreads over its spans.
    """
    spanned = rows.withColumn("_part", span_of(position))
    spread = spanned.select(*keys, "_part").distinct().join(merged(facts), keys)
    return spanned.join(merged(spread), [*keys, "_part"], how).drop("_part")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and continue from there.

    As columns: small on disk, and what reads it later reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoint_folder(spark) -> str:
    """Checkpoint folder named by the session; a temporary one only for a local master without a setting."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()
