"""Replies to classification, summary and retrieval prompts, and what becomes of them."""

from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import annotate as A
from threadloom.operators import memory as M
from threadloom.operators import ordered
from threadloom.operators import relevance as R
from threadloom.operators import replies as P
from threadloom.operators import verdicts as W
from threadloom.plans import relevance_sql as B
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q
from threadloom.plans.registry import query, rounded
from threadloom.sources import store as D
from threadloom.sources import tables as S

# The replies' content as rows, without the text around it: what the readers must find.
_ANSWERS = f"""{Q.CONVERSATIONS}, {X.annotated('messages')},
pending AS (SELECT m.conv_id, m.turn, m.text, n.level FROM messages m JOIN notes n USING (role, text) WHERE m.role = 'user' AND n.ambiguous
  QUALIFY row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn DESC) <= 30),
answers AS (SELECT *, turn % 4 = 0 AS says_protected, regexp_replace(trim(concat('  ', text[1:20], '  "{{x}}')), '\\s+', ' ', 'g') AS note FROM pending WHERE turn % 2 = 0 AND turn % 8 <> 6 AND conv_id % 7 <> 3)"""


def _classified(spark, sf):
    annotated = ordered.cut_lineage(A.annotate(S.conversation_messages(spark, sf)))
    asked = ordered.cut_lineage(W.pending_messages(annotated))
    return annotated, P.classifications(S.classification_reply_rows(asked), asked)


@query(
    "classification_replies",
    f"""WITH {_ANSWERS} SELECT conv_id, turn, CASE WHEN says_protected THEN 'constraint' ELSE 'fact' END AS content_type, says_protected AS protected, 'states a rule' AS protection_reason,
  CASE WHEN says_protected THEN 0 ELSE 1 END AS n_statements, CASE WHEN NOT says_protected THEN 'open_topic' END AS key, CASE WHEN NOT says_protected THEN note END AS value, NOT says_protected AS complete FROM answers""",
)
def classification_replies(spark, sf):
    _, rows = _classified(spark, sf)
    first = F.get("statements", F.lit(0))
    return rows.select("conv_id", "turn", "content_type", "protected", "protection_reason", F.size("statements").alias("n_statements"), first["key"].alias("key"), first["value"].alias("value"), "complete")


@query(
    "classified_annotations",
    f"""WITH {_ANSWERS} SELECT m.conv_id, m.turn, CASE WHEN a.turn IS NULL THEN n.content_type WHEN says_protected THEN 'constraint' ELSE 'fact' END AS content_type,
  CASE WHEN a.turn IS NOT NULL THEN 'semantic' WHEN n.ambiguous THEN 'heuristic' ELSE 'deterministic' END AS class_method, coalesce(n.level, CASE WHEN says_protected THEN 'high' END) AS protection_level,
  CASE WHEN a.turn IS NOT NULL THEN n.level IS NULL AND NOT says_protected ELSE n.memory_complete END AS memory_complete, n.ambiguous AND a.turn IS NULL AS ambiguous
FROM messages m JOIN notes n USING (role, text) LEFT JOIN answers a ON a.conv_id = m.conv_id AND a.turn = m.turn""",
)
def classified_annotations(spark, sf):
    """Annotations once the replies were read."""
    merged = P.annotations_with(*_classified(spark, sf))
    return merged.select("conv_id", "turn", "content_type", "class_method", F.col("protection.level").alias("protection_level"), "memory_complete", "ambiguous")


@query(
    "classified_memory",
    f"""WITH {_ANSWERS}, {X.STATEMENTS.replace('statements AS', 'own AS')},
statements AS (SELECT * FROM own UNION ALL SELECT conv_id, turn, 1000, 'open_topic', note, 'fact', {V.REPLY_CONFIDENCE}, 'set' FROM answers WHERE NOT says_protected), {X.MEMORY}
SELECT conv_id, key, value, type, round(confidence, 6) AS confidence, active, n_sources, n_previous FROM memory_items""",
)
def classified_memory(spark, sf):
    """The memory that the messages and the replies about them make together."""
    merged = P.annotations_with(*_classified(spark, sf))
    items = M.memory_items(M.memory_events(A.statements_of(merged)))
    return rounded(items.select("conv_id", "key", "value", "type", "confidence", "active", "n_sources", "n_previous"))


_LONG = f"""d AS (SELECT doc_id % 50 AS conv_id, 1 AS req_turn, doc_id AS turn, text FROM documents WHERE length(text) > 880 QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) <= 6),
t AS (SELECT *, text[1:60] AS short, {X.tokens('text[1:60]')} <= {X.tokens('text')} * {V.SUMMARY_MAX_RATIO} AS small FROM d WHERE conv_id % 7 <> 3)"""


def _asked_summaries(spark, sf):
    """Long documents as messages to summarise, six for each of fifty requests, as a prompt holds."""
    docs = S.table(spark, sf, "documents").where(F.length("text") > 880)
    nth = F.row_number().over(ordered.Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id"))
    rows = docs.select((F.col("doc_id") % 50).alias("conv_id"), F.lit(1).cast("bigint").alias("req_turn"), F.col("doc_id").alias("turn"), "text", nth.alias("_n"))
    return ordered.cut_lineage(rows.where(F.col("_n") <= 6).drop("_n"))


@query(
    "summary_replies",
    f"""WITH {_LONG} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND small THEN {X.trim("short")} ELSE '' END AS summary,
  CASE WHEN turn % 4 = 0 THEN CASE WHEN NOT small THEN 'not_shorter' END WHEN turn % 4 = 1 THEN 'adds:987654321' WHEN turn % 4 = 2 THEN 'not_shorter' ELSE 'missing' END AS reason FROM t""",
)
def summary_replies(spark, sf):
    asked = _asked_summaries(spark, sf)
    return P.summary_results(S.summary_reply_rows(asked), asked).select("conv_id", "turn", "summary", "reason")


@query(
    "summary_cache_after_replies",
    f"""WITH {_LONG}, r AS (SELECT DISTINCT conv_id, substr(sha256(concat('summary', chr(10), conv_id, ':', turn, ':', sha256(text))), 1, 32) AS cache_key, CASE WHEN turn % 4 = 0 AND small THEN {X.trim("short")} ELSE '' END AS summary FROM t)
SELECT cache_key, CASE WHEN summary = '' THEN 'negative' ELSE 'hit' END AS state FROM r
UNION ALL SELECT substr(sha256(concat('summary', chr(10), conv_id, ':', turn, ':', sha256(text))), 1, 32), 'miss' FROM d WHERE conv_id % 7 = 3""",
)
def summary_cache_after_replies(spark, sf):
    """What the cache answers for the same messages once the replies are saved: rejected ones are not asked about again."""
    asked = _asked_summaries(spark, sf)
    results = ordered.cut_lineage(P.summary_results(S.summary_reply_rows(asked), asked))
    cache = results.where("false").select("conv_id", "cache_key", "summary")
    cache = cache.unionByName(D.new_summaries(cache, results.select("conv_id", "cache_key", "summary")))
    wanted = asked.select("conv_id", "req_turn", "turn", "text").distinct()
    message_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    wanted = wanted.select("conv_id", T.cache_key(F.lit("summary"), T.source_line(message_id, F.col("text"))).alias("cache_key"))
    return D.cached_summaries(wanted, cache).select("cache_key", "state")


_PICKED = f"""offer AS (SELECT m.conv_id, req_turn, m.turn, m.pos FROM messages m JOIN latest USING (conv_id) WHERE m.turn < req_turn QUALIFY row_number() OVER (PARTITION BY m.conv_id ORDER BY m.pos DESC) <= {V.SEARCH_DIGESTS}),
picked AS (SELECT conv_id, req_turn, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM offer WHERE turn % 3 = 0 AND conv_id % 7 <> 3),
q AS (SELECT conv_id, {X.words('lower(request)')} BETWEEN 1 AND {V.FOLLOW_UP_MAX_WORDS} AND ({' OR '.join(X.hit('lower(request)', p) for p in V.FOLLOW_UP_PATTERNS)}) AS follow_up FROM latest),
chosen AS (SELECT conv_id, req_turn, turn, {V.SEMANTIC_RETRIEVAL_SCORE}::DOUBLE AS score FROM picked JOIN q USING (conv_id) WHERE n <= CASE WHEN follow_up THEN {V.FOLLOW_UP_SELECTED} ELSE {V.SELECTED} END)"""


def _offered(spark, sf):
    messages = S.conversation_messages(spark, sf)
    requests = ordered.cut_lineage(R.request_features(R.latest_requests(messages)))
    pool = ordered.attach(messages.select("conv_id", "turn", "pos"), requests.select("conv_id", "req_turn"), ["conv_id"], F.col("turn"), F.col("req_turn")).where(F.col("turn") < F.col("req_turn"))
    nth = F.row_number().over(ordered.Window.partitionBy("conv_id").orderBy(F.desc("pos")))
    pool = ordered.cut_lineage(pool.withColumn("_n", nth).where(F.col("_n") <= V.SEARCH_DIGESTS).drop("_n"))
    return messages, requests, P.selected_messages(S.retrieval_reply_rows(pool), pool, requests)


@query("retrieval_replies", f"WITH {Q.CONVERSATIONS}, {Q.LATEST}, {_PICKED} SELECT * FROM chosen")
def retrieval_replies(spark, sf):
    _, _, chosen = _offered(spark, sf)
    return chosen


@query(
    "scores_after_replies",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')}, {B.BASE}, {B.NO_MEMORY}, {B.SCORES}, {_PICKED}
SELECT s.conv_id, s.req_turn, s.turn, greatest(s.score, coalesce(c.score, 0)) AS score, coalesce(c.score, 0) AS semantic FROM scores s LEFT JOIN chosen c ON c.conv_id = s.conv_id AND c.turn = s.turn""",
)
def scores_after_replies(spark, sf):
    """Scores of the histories with the messages that the replies selected."""
    messages, requests, chosen = _offered(spark, sf)
    features = ordered.cut_lineage(R.message_features(A.annotate(messages)))
    scored, _ = R.score(features, requests, external=ordered.cut_lineage(chosen))
    return scored.select(*R.KEYS, "turn", "score", F.col("signals.semantic").alias("semantic"))
