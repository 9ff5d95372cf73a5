"""Stored-table jobs on the given tables."""

import uuid

from pyspark.sql import functions as F

from threadloom.operators import annotate as A
from threadloom.operators import economics as E
from threadloom.operators import memory as M
from threadloom.operators import ordered
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q
from threadloom.plans.registry import query, rounded
from threadloom.sources import store as D
from threadloom.sources import tables as S


def _conversations(spark, sf):
    runs = S.runs(spark, sf).groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    names = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("conversation_id"), F.col("c_name").alias("title"))
    return runs.join(names, "conversation_id")


_CONVS = f"{Q.RUNS}, convs AS (SELECT conversation_id, c_name AS title, min(created_at) AS created_at, max(created_at) AS updated_at FROM runs JOIN customer ON c_custkey = conversation_id GROUP BY ALL)"


@query("list_conversations", f"WITH {_CONVS} SELECT conversation_id, title, CAST(epoch(updated_at) AS BIGINT) AS updated FROM convs")
def list_conversations(spark, sf):
    return D.list_conversations(_conversations(spark, sf)).select("conversation_id", "title", F.unix_timestamp("updated_at").alias("updated"))


@query("read_messages", f"WITH {Q.EVENT_MESSAGES} SELECT turn, role, text FROM event_messages WHERE conv_id = 7")
def read_messages(spark, sf):
    return D.read_messages(S.event_messages(spark, sf), 7).select("turn", "role", "text")


@query(
    "annotations_of",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')} SELECT m.conv_id, m.turn, n.content_type FROM messages m JOIN notes n USING (role, text) WHERE m.conv_id % 7 = 3""",
)
def annotations_of(spark, sf):
    messages = S.conversation_messages(spark, sf)
    stored = A.annotate(messages).select("conv_id", "turn", "content_type")
    return D.annotations_of(stored, messages.where(F.col("conv_id") % 7 == 3))


@query(
    "upsert_annotations",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')} SELECT m.conv_id, m.turn, CASE WHEN m.turn % 2 = 0 THEN 'fact' ELSE n.content_type END AS content_type, CASE WHEN m.turn % 2 = 0 THEN 2 ELSE 1 END AS updated_at
FROM messages m JOIN notes n USING (role, text)""",
)
def upsert_annotations(spark, sf):
    stored = A.annotate(S.conversation_messages(spark, sf)).select("conv_id", "turn", "content_type", F.lit(1).alias("updated_at"))
    stored = ordered.cut_lineage(stored)
    incoming = stored.where(F.col("turn") % 2 == 0).select("conv_id", "turn", F.lit("fact").alias("content_type"), F.lit(2).alias("updated_at"))
    return D.upsert_annotations(stored, incoming)


@query(
    "upsert_memory",
    """WITH s AS (SELECT o_custkey AS conv_id, o_orderpriority AS key, o_orderkey AS version, CAST(o_orderkey % 5 AS VARCHAR) AS value FROM orders)
SELECT conv_id, key, min(version) AS created_at, max(version) AS updated_at, max_by(value, version) AS value FROM s GROUP BY conv_id, key""",
)
def upsert_memory(spark, sf):
    k = F.col("o_orderkey")
    rows = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("key"), (k % 5).cast("string").alias("value"), k.alias("created_at"), k.alias("updated_at"))
    return D.upsert_memory(rows.where(F.col("updated_at") % 3 != 0), rows.where(F.col("updated_at") % 3 == 0))


@query(
    "stored_memory",
    """WITH s AS (SELECT o_custkey AS conv_id, o_orderpriority AS key, o_orderkey AS version, CAST(o_orderkey % 5 AS VARCHAR) AS value FROM orders)
SELECT conv_id, key, min(version) AS created_at, max(version) AS updated_at, max_by(value, version) AS value FROM s GROUP BY conv_id, key""",
)
def stored_memory(spark, sf):
    """The same merge into a stored table in three installments, each of which rewrites the buckets it touches."""
    k = F.col("o_orderkey")
    rows = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("key"), (k % 5).cast("string").alias("value"), k.alias("created_at"), k.alias("updated_at"))
    folder = f"{ordered.use_checkpoint_folder(spark)}/memory-{uuid.uuid4().hex}"
    for part in (F.col("updated_at") % 3 == 1, F.col("updated_at") % 3 == 0, F.col("updated_at") % 3 == 2):
        D.upsert_stored(rows.where(part), folder, ["conv_id", "key"], "updated_at", ["created_at"], buckets=8)
    return D.read_stored(spark, folder)


_ITEMS = f"{Q.ORDER_MESSAGES}, messages AS (SELECT * FROM order_messages), {X.annotated('messages')}, {X.STATEMENTS}, {X.MEMORY}"


@query("list_memory", f"WITH {_ITEMS} SELECT conv_id, key, value FROM memory_items WHERE active")
def list_memory(spark, sf):
    items = M.memory_items(M.memory_events(A.statements_of(A.annotate(S.order_messages(spark, sf)))))
    return D.list_memory(items).select("conv_id", "key", "value")


_CACHE = "SELECT doc_id % 100 AS conv_id, md5(text) AS cache_key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, 40) END AS summary FROM documents WHERE doc_id % 2 = 0"


def _documents(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 100).alias("conv_id"), F.md5("text").alias("cache_key"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 1, 40)).alias("summary"))


@query(
    "summary_cache_lookup",
    f"""WITH c AS (SELECT conv_id, cache_key, min(summary) AS summary FROM ({_CACHE}) GROUP BY ALL), w AS (SELECT DISTINCT doc_id % 100 AS conv_id, md5(text) AS cache_key FROM documents)
SELECT w.conv_id, w.cache_key, CASE WHEN summary IS NULL THEN 'miss' WHEN summary = '' THEN 'negative' ELSE 'hit' END AS state FROM w LEFT JOIN c USING (conv_id, cache_key)""",
)
def summary_cache_lookup(spark, sf):
    docs = _documents(spark, sf)
    cache = docs.where(F.col("doc_id") % 2 == 0).groupBy("conv_id", "cache_key").agg(F.min("summary").alias("summary"))
    return D.cached_summaries(docs.select("conv_id", "cache_key").distinct(), cache).select("conv_id", "cache_key", "state")


@query(
    "summary_cache_save",
    f"""WITH c AS ({_CACHE}), p AS (SELECT doc_id % 100 AS conv_id, md5(text) AS cache_key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, 40) END AS summary FROM documents)
SELECT conv_id, cache_key, min(summary) AS summary FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = p.conv_id AND c.cache_key = p.cache_key) GROUP BY conv_id, cache_key""",
)
def summary_cache_save(spark, sf):
    docs = _documents(spark, sf)
    return D.new_summaries(docs.where(F.col("doc_id") % 2 == 0), docs.select("conv_id", "cache_key", "summary"))


@query("group_counts", f"SELECT count(*) FILTER (summary <> '') AS compressed_groups, count(*) AS cached FROM ({_CACHE})")
def group_counts(spark, sf):
    cache = _documents(spark, sf).where(F.col("doc_id") % 2 == 0)
    return cache.agg(F.count_if(F.col("summary") != "").alias("compressed_groups"), F.count("*").alias("cached"))


@query(
    "run_ledger",
    f"""WITH {Q.RUNS}, {Q.ATTEMPTS}, {Q.RUN_CALLS}
SELECT 'compiler_run' AS ledger, count(*) AS n, CAST(sum(original_tokens) AS BIGINT) AS total FROM runs
UNION ALL SELECT 'run_attempt', count(*), CAST(sum(context_tokens) AS BIGINT) FROM attempts JOIN runs USING (run_id)
UNION ALL SELECT 'utility_call', count(*), CAST(sum(input_tokens) AS BIGINT) FROM run_calls JOIN runs USING (run_id)
UNION ALL SELECT 'context_decision', count(*), CAST(sum(context_tokens) AS BIGINT) FROM attempts JOIN runs USING (run_id)""",
)
def run_ledger(spark, sf):
    """Write the runs and their rows to the four ledger tables, in two batches, and read totals back."""
    runs = S.runs(spark, sf)
    ids = runs.select("run_id")
    attempts = S.attempts(spark, sf).join(ids, "run_id", "left_semi")
    tables = {
        "compiler_run": runs,
        "run_attempt": attempts.select("run_id", "at.*", "level", "passed", "context_tokens"),
        "utility_call": S.run_calls(spark, sf).join(ids, "run_id", "left_semi"),
        "context_decision": attempts.select("run_id", F.col("at.l_partkey").alias("message_id"), F.lit("KEEP").alias("action"), F.col("context_tokens").alias("tokens")),
    }
    folder = f"{ordered.use_checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for batch in (0, 1):
        D.write_run_ledger({name: rows.where(F.col("run_id") % 2 == batch) for name, rows in tables.items()}, folder, str(batch))
    measure = {"compiler_run": "original_tokens", "run_attempt": "context_tokens", "utility_call": "input_tokens", "context_decision": "tokens"}
    parts = [D.read_run_ledger(spark, folder, name).agg(F.lit(name).alias("ledger"), F.count("*").alias("n"), F.sum(c).alias("total")) for name, c in measure.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "runs_versioned",
    f"""WITH {Q.RUN_ECONOMICS} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'local_estimate' ELSE count_source END AS count_source, CASE WHEN run_id % 2 = 0 THEN compiled_tokens ELSE compiled_tokens + 5 END AS initial_compiled_tokens,
  CASE WHEN run_id % 2 = 0 THEN reduction_percent ELSE 1.5 END AS initial_reduction_percent FROM run_economics""",
)
def runs_versioned(spark, sf):
    runs = E.run_economics(S.runs(spark, sf), E.default_prices(spark)).select("run_id", "count_source", "compiled_tokens", "reduction_percent")
    old = runs.where(F.col("run_id") % 2 == 0).drop("count_source")
    new = runs.where(F.col("run_id") % 2 != 0).withColumns({"initial_compiled_tokens": F.col("compiled_tokens") + 5, "initial_reduction_percent": F.lit(1.5)})
    return D.read_runs_versioned([new, old]).select("run_id", "count_source", "initial_compiled_tokens", "initial_reduction_percent")


@query("runs_with_trace", f"WITH {Q.RUNS} SELECT run_id, c_name AS title, counting_ms FROM runs JOIN customer ON c_custkey = conversation_id")
def runs_with_trace(spark, sf):
    rows = D.runs_with_trace(S.runs(spark, sf), _conversations(spark, sf), "compilation struct<tokenCount:struct<latencyMs:bigint>>")
    return rows.select("run_id", "title", F.col("trace.compilation.tokenCount.latencyMs").alias("counting_ms"))


@query(
    "export_metrics",
    f"""WITH {Q.RUN_ECONOMICS} SELECT run_id, concat('He said "', model, '", twice') AS prompt, original_tokens, round(gross_input_savings_usd, 6) AS gross_input_savings_usd FROM run_economics""",
)
def export_metrics(spark, sf):
    """Write CSV and JSON and read the CSV back: quoting survives."""
    prompt = F.concat(F.lit('He said "'), F.col("model"), F.lit('", twice'))
    metrics = rounded(E.run_economics(S.runs(spark, sf), E.default_prices(spark)).select("run_id", prompt.alias("prompt"), "original_tokens", "gross_input_savings_usd"))
    folder = f"{ordered.use_checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    D.export_metrics(metrics, folder)
    return spark.read.schema(metrics.schema).option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/csv")


@query(
    "export_summary",
    f"""WITH {Q.RUN_ECONOMICS}, p AS (SELECT row_number() OVER (ORDER BY run_id) - 1 AS place, run_id, original_tokens, compiled_tokens, tokens_avoided FROM run_economics)
SELECT place, run_id, original_tokens, compiled_tokens, CAST(sum(original_tokens) OVER w AS BIGINT) AS full_so_far, CAST(sum(compiled_tokens) OVER w AS BIGINT) AS sent_so_far,
  CAST(sum(tokens_avoided) OVER () AS BIGINT) AS total_avoided, count(*) OVER () AS total_runs FROM p WINDOW w AS (ORDER BY place)""",
)
def export_summary(spark, sf):
    """Write totals and the cumulative series as one JSON document in parts and read it back."""
    runs = E.run_economics(S.runs(spark, sf), E.default_prices(spark)).select("run_id", "original_tokens", "compiled_tokens", "tokens_avoided")
    along, block = ["_all"], ["_block"]
    rows = runs.withColumns({"_all": F.lit(0), "_block": ordered.block_of(F.col("run_id"))})
    rows = ordered.positions(rows, along, block, ["run_id"], "place")
    rows = ordered.running_sums(rows, along, block, ["run_id"], {"full_so_far": F.col("original_tokens"), "sent_so_far": F.col("compiled_tokens")})
    series = rows.select("place", "run_id", "original_tokens", "compiled_tokens", "full_so_far", "sent_so_far")
    folder = f"{ordered.use_checkpoint_folder(spark)}/summary-{uuid.uuid4().hex}"
    D.export_summary(series, runs.agg(F.sum("tokens_avoided").alias("total_avoided"), F.count("*").alias("total_runs")), folder)
    point = "place bigint, run_id bigint, original_tokens bigint, compiled_tokens bigint, full_so_far bigint, sent_so_far bigint"
    totals, back = D.read_summary(spark, folder, "total_avoided bigint, total_runs bigint", point)
    return back.withColumns({c: totals.select(c).scalar() for c in totals.columns})


@query(
    "import_conversations",
    f"""WITH {_CONVS}, known AS (SELECT conversation_id, CASE WHEN conversation_id % 4 = 0 THEN concat('Customer#', lpad(CAST(conversation_id + 1 AS VARCHAR), 9, '0')) ELSE title END AS title FROM convs WHERE conversation_id % 2 = 0),
fresh AS (SELECT * FROM convs s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.conversation_id = s.conversation_id) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.title = s.title))
SELECT f.conversation_id, f.title, count(*) AS runs FROM fresh f JOIN runs r USING (conversation_id) GROUP BY ALL""",
)
def import_conversations(spark, sf):
    convs = ordered.cut_lineage(_conversations(spark, sf).select("conversation_id", "title"))
    renamed = F.format_string("Customer#%09d", F.col("conversation_id") + 1)
    target = {"conversation": convs.where(F.col("conversation_id") % 2 == 0).withColumn("title", F.when(F.col("conversation_id") % 4 == 0, renamed).otherwise(F.col("title")))}
    add = D.import_conversations(target, {"conversation": convs, "compiler_run": S.runs(spark, sf).select("conversation_id", "run_id")})
    return add["conversation"].join(add["compiler_run"], "conversation_id").groupBy("conversation_id", "title").agg(F.count("*").alias("runs"))


@query(
    "delete_conversations",
    f"""WITH {Q.RUNS}, {Q.ATTEMPTS} SELECT (SELECT count(*) FROM runs WHERE conversation_id % 10 <> 3) AS runs, count(*) AS attempts FROM attempts WHERE run_id NOT IN (SELECT run_id FROM runs WHERE conversation_id % 10 = 3)""",
)
def delete_conversations(spark, sf):
    tables = {"compiler_run": S.runs(spark, sf), "run_attempt": S.attempts(spark, sf)}
    ids = tables["compiler_run"].where(F.col("conversation_id") % 10 == 3).select("conversation_id")
    left = D.delete_conversations(tables, ids, ("run_attempt",))
    runs = left["compiler_run"].agg(F.count("*").alias("n")).scalar()
    return left["run_attempt"].agg(F.count("*").alias("attempts")).select(runs.alias("runs"), "attempts")


@query(
    "touch_conversations",
    f"""WITH {Q.CONVERSATIONS} SELECT conv_id, min_by(left(regexp_replace(text, '\\s+', ' ', 'g'), 60), turn) FILTER (role = 'user') AS title, min(turn) AS created_at, max(turn) AS updated_at FROM messages GROUP BY conv_id""",
)
def touch_conversations(spark, sf):
    return D.touched_conversations(S.conversation_messages(spark, sf), F.col("turn"))


@query(
    "runs_with_title",
    f"WITH {Q.RUNS} SELECT run_id, c_name AS title FROM runs JOIN customer ON c_custkey = conversation_id",
)
def runs_with_title(spark, sf):
    return S.runs(spark, sf).join(_conversations(spark, sf).select("conversation_id", "title"), "conversation_id").select("run_id", "title")


@query("quality_violations", f"WITH {Q.RUN_ECONOMICS} SELECT 'cost of an unpriced model' AS rule, count(*) FILTER (model = 'mystery-model' AND gross_input_savings_usd IS NOT NULL) AS violations FROM run_economics")
def quality_violations(spark, sf):
    runs = E.run_economics(S.runs(spark, sf), E.default_prices(spark))
    bad = (F.col("model") == "mystery-model") & F.col("gross_input_savings_usd").isNotNull()
    return runs.agg(F.lit("cost of an unpriced model").alias("rule"), F.count_if(bad).alias("violations"))


@query("read_fixture", f"WITH {Q.CONVERSATIONS} SELECT conv_id, CAST(pos AS BIGINT) AS pos, concat('m', turn) AS message_id, role, text FROM messages")
def read_fixture(spark, sf):
    """Conversations written as one JSON array a file and read back as messages."""
    messages = S.conversation_messages(spark, sf)
    item = F.struct("pos", F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), "role", F.col("text").alias("content")).alias("m"))
    files = messages.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(item)).getField("m")).alias("value"))
    folder = f"{ordered.use_checkpoint_folder(spark)}/fixture-{uuid.uuid4().hex}"
    files.repartition("conv_id").write.partitionBy("conv_id").option("maxRecordsPerFile", 1).text(folder)
    rows = D.read_fixture(spark, f"{folder}/*/*.txt", F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("bigint"))
    return rows.select("conv_id", "pos", "message_id", "role", "text")
