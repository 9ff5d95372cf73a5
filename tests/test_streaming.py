from small_tables import SMALL
from pyspark.sql import functions as F

from threadloom.operators import annotate as A
from threadloom.operators import memory as M
from threadloom.plans import all_queries as Q
from threadloom.streaming import jobs as J
from threadloom.sources import tables as S


def test_annotation_stream_equals_batch(spark):
    got = Q.QUERIES["annotate_stream"](spark, SMALL)
    want = Q.QUERIES["annotate_conversations"](spark, SMALL).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tables_in_part_files_are_streamed_whole(spark, tmp_path):
    rows = [(c, t, "user", f"We use MySQL {c}.") for c in range(3) for t in range(4)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.QUERIES["annotate_stream"](spark, str(tmp_path))
    want = Q.QUERIES["annotate_conversations"](spark, str(tmp_path)).select(*got.columns)
    assert got.count() == 12
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.read.parquet(f"{SMALL}/orders.parquet").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    whole, parts = (Q.QUERIES["ledger_stream"](spark, folder).collect() for folder in (SMALL, str(tmp_path)))
    assert sorted(map(str, parts)) == sorted(map(str, whole))


def _write(df, folder):
    df.select("conv_id", "turn", "role", "text").write.mode("append").parquet(folder)


def test_memory_of_out_of_order_batches_of_any_size_equals_batch(spark, tmp_path):
    texts = [
        "We decided to use PostgreSQL 16 for the metadata.",
        "We use MySQL.",
        "We no longer use MySQL.",
        "We decided to use SQLite.",
        "We decided to use PostgreSQL 17 for the metadata.",
        "The deadline is June 3.",
        "The deadline is June 3.",
        "The deadline is July 1.",
    ]
    rows = [(c, t, t, "user", texts[(t + c) % len(texts)]) for c in range(4) for t in range(16)]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, pos bigint, role string, text string")
    order = [9, 3, 14, 0, 7, 12, 1, 15, 4, 10, 2, 6, 13, 5, 11, 8]
    for turn in order:
        _write(messages.where(F.col("turn") == turn).coalesce(1), f"{tmp_path}/in")
    for name, batch_bytes in (("one", 1), ("all", J.BATCH_BYTES)):
        J.run_to_end(J.statement_stream(J.message_stream(spark, f"{tmp_path}/in", batch_bytes=batch_bytes)), f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}")
    fields = ["conv_id", "key", "value", "type", F.round("confidence", 6).alias("confidence"), "active", "n_sources", "first_source", "last_source", "n_previous"]
    want = M.memory_items(M.memory_events(A.statements_of(A.annotate(messages)))).select(*fields).collect()
    for name in ("one", "all"):
        got = J.stored_items(spark.read.parquet(f"{tmp_path}/{name}").drop("batch")).select(*fields).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_replayed_batch_replaces_its_output(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "Hello there.")], "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = J.annotate_stream(J.message_stream(spark, f"{tmp_path}/in")).select("conv_id", "turn", "content_type")
    J.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/cp1")
    J.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
