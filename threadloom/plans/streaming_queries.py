"""Streams over the given tables, run to the end of the available input."""

import uuid

from pyspark.sql import functions as F

from threadloom.operators import ordered
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q
from threadloom.plans.message_queries import _ORDERS
from threadloom.plans.registry import query, rounded
from threadloom.sources import tables as S
from threadloom.streaming import jobs as J


def _work_folder(spark) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    return f"{ordered.use_checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _finish(spark, stream, mode="append"):
    folder = _work_folder(spark)
    J.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.parquet(f"{folder}/out")


@query(
    "annotate_stream",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')}
SELECT m.conv_id, m.turn, n.content_type, n.ambiguous, n.level AS protection_level, n.memory_complete FROM messages m JOIN notes n USING (role, text)""",
)
def annotate_stream(spark, sf):
    stream = J.annotate_stream(J.table_stream(spark, sf, "conversations", J.MESSAGE_SCHEMA))
    rows = stream.select("conv_id", "turn", "content_type", "ambiguous", F.col("protection.level").alias("protection_level"), "memory_complete")
    return _finish(spark, rows).drop("batch")


@query(
    "memory_stream",
    f"WITH {_ORDERS} SELECT conv_id, key, value, type, round(confidence, 6) AS confidence, active, n_sources, first_source, last_source, n_previous FROM memory_items",
)
def memory_stream(spark, sf):
    """Orders arrive in three installments, newest first; statements are stored as they come and merged at the end."""
    folder = _work_folder(spark)
    messages = ordered.cut_lineage(S.order_messages(spark, sf).drop("pos"))
    for part in (F.col("turn") > 8, (F.col("turn") > 4) & (F.col("turn") <= 8), F.col("turn") <= 4):
        messages.where(part).write.mode("append").parquet(f"{folder}/inbox")
        J.run_to_end(J.statement_stream(J.message_stream(spark, f"{folder}/inbox")), f"{folder}/out", f"{folder}/checkpoint")
    return rounded(J.stored_items(spark.read.parquet(f"{folder}/out").drop("batch")))


@query(
    "ledger_stream",
    f"""WITH {Q.RUN_ECONOMICS} SELECT count_source, count(*) AS runs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compiled_tokens) AS BIGINT) AS compiled_tokens,
  CAST(sum(tokens_avoided) AS BIGINT) AS tokens_avoided, round(avg(reduction_percent), 6) AS avg_reduction_percent FROM run_economics GROUP BY count_source""",
)
def ledger_stream(spark, sf):
    schema = S.table(spark, sf, "orders").schema
    orders = J.table_stream(spark, sf, "orders", schema)
    totals = _finish(spark, J.ledger_stream(S.run_rows(orders)), "complete")
    newest = totals.agg(F.max("batch").alias("b")).scalar()
    return rounded(totals.where(F.col("batch") == newest).drop("batch"))


@query(
    "ledger_updates",
    f"""WITH {Q.RUNS} SELECT CAST(created_at AS DATE) AS day, count_source, count(*) AS runs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compiled_tokens) AS BIGINT) AS compiled_tokens FROM runs GROUP BY ALL""",
)
def ledger_updates(spark, sf):
    """Runs arrive in three installments out of order, some of them again: every run counts once, on its day."""
    folder = _work_folder(spark)
    runs = ordered.cut_lineage(S.runs(spark, sf).select("run_id", F.col("created_at").cast("timestamp").alias("created_at"), "count_source", "original_tokens", "compiled_tokens"))
    k = F.col("run_id")
    for part in (k % 3 == 1, (k % 3 == 2) | (k % 6 == 1), (k % 3 == 0) | (k % 10 == 5)):
        runs.where(part).write.mode("append").parquet(f"{folder}/inbox")
        J.write_updates(J.run_updates(J.file_stream(spark, f"{folder}/inbox", "*.parquet", runs.schema), "3000 days"), f"{folder}/out", f"{folder}/checkpoint")
    return J.update_totals(spark.read.parquet(f"{folder}/out"))
