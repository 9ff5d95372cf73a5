"""History sizes and scoring."""

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import fixed_values as V
from threadloom.operators import annotate as A
from threadloom.operators import memory as M
from threadloom.operators import ordered
from threadloom.operators import relevance as R
from threadloom.plans import relevance_sql as P
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q
from threadloom.plans.registry import query, rounded
from threadloom.sources import tables as S

_CONV = f"{Q.CONVERSATIONS}, {X.annotated('messages')}, {P.BASE}"
_SERVICE_BASE = f"{Q.SERVICE_MESSAGES}, messages AS (SELECT * FROM service_messages), {X.annotated('messages')}, {P.BASE}"
SERVICE_SCORES = (
    f"{_SERVICE_BASE}, {X.STATEMENTS.replace('statements AS', 'every_statement AS')}, statements AS (SELECT s.* FROM every_statement s JOIN latest USING (conv_id) WHERE s.turn < req_turn), "
    f"{X.MEMORY}, {P.MEMORY_SCORES}, {P.SCORES}"
)


def _prepared(messages):
    """Annotated messages, their features and the analysed latest requests."""
    annotated = ordered.cut_lineage(A.annotate(messages))
    requests = ordered.cut_lineage(R.request_features(R.latest_requests(annotated)))
    return annotated, R.message_features(annotated), requests


def service_scores(spark, sf):
    annotated, features, requests = _prepared(S.service_messages(spark, sf))
    events = M.memory_events(M.memory_before_requests(A.statements_of(annotated), requests), R.KEYS)
    return R.score(features, requests, ordered.cut_lineage(M.memory_items(events, R.KEYS)), M.memory_sources(events, R.KEYS))


@query(
    "history_tokens",
    f"""WITH {Q.CONVERSATIONS}, t AS (SELECT *, {X.tokens('text')} AS own, sum({X.tokens('text')} + 4) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM messages)
SELECT conv_id, turn AS req_turn, pos AS history_messages, CAST(before + own AS BIGINT) AS original_tokens FROM t WHERE role = 'user' AND pos > 0""",
)
def history_tokens(spark, sf):
    return R.history_tokens(S.table(spark, sf, "conversations"))


@query(
    "event_history_tokens",
    f"""WITH {Q.EVENT_MESSAGES}, t AS (SELECT *, {X.tokens('text')} AS own, sum({X.tokens('text')} + 4) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM event_messages)
SELECT conv_id, turn AS req_turn, pos AS history_messages, CAST(before + own AS BIGINT) AS original_tokens FROM t WHERE role = 'user' AND pos > 0""",
)
def event_history_tokens(spark, sf):
    return R.history_tokens(S.event_messages(spark, sf))


@query(
    "request_history",
    f"""WITH {_CONV} SELECT conv_id, req_turn, turn, pos, tokens FROM history""",
)
def request_history(spark, sf):
    messages = S.conversation_messages(spark, sf)
    rows = R.history(messages.withColumn("tokens", T.message_tokens(F.col("text"))), R.latest_requests(messages))
    return rows.select(*R.KEYS, "turn", "pos", "tokens")


@query(
    "continuity_window",
    f"""WITH {_SERVICE_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS rn FROM history WHERE NOT protected),
w AS (SELECT *, max(tokens) OVER (PARTITION BY conv_id) AS largest FROM r WHERE rn <= {V.CONTINUITY_MESSAGES})
SELECT conv_id, req_turn, pos FROM w WHERE largest <= {V.CONTINUITY_MAX_TOKENS}""",
)
def continuity_window(spark, sf):
    _, features, requests = _prepared(S.service_messages(spark, sf))
    return R.continuity(R.history(features, requests))


@query(
    "term_document_frequency",
    f"WITH {_SERVICE_BASE} SELECT conv_id, term, expansion, df, round(weight, 6) AS weight FROM weights",
)
def term_document_frequency(spark, sf):
    _, features, requests = _prepared(S.service_messages(spark, sf))
    rows = ordered.cut_lineage(R.own_matches(features, requests))
    terms = R.query_terms(requests, rows)
    weights = R.term_weights(terms, R.term_matches(rows, terms))
    return rounded(weights.select("conv_id", "term", "expansion", "df", "weight"))


@query(
    "conversation_terms",
    f"WITH {_CONV} SELECT conv_id, term, expansion, df, round(weight, 6) AS weight FROM weights",
)
def conversation_terms(spark, sf):
    _, features, requests = _prepared(S.conversation_messages(spark, sf))
    rows = ordered.cut_lineage(R.own_matches(features, requests))
    terms = R.query_terms(requests, rows)
    weights = R.term_weights(terms, R.term_matches(rows, terms))
    return rounded(weights.select("conv_id", "term", "expansion", "df", "weight"))


@query("relevance_scores", f"WITH {_CONV}, {P.NO_MEMORY}, {P.SCORES} SELECT conv_id, req_turn, turn, score, paired_with FROM scores")
def relevance_scores(spark, sf):
    _, features, requests = _prepared(S.conversation_messages(spark, sf))
    scored, _ = R.score(features, requests)
    return scored.select(*R.KEYS, "turn", "score", "paired_with")


@query(
    "service_relevance_scores",
    f"""WITH {SERVICE_SCORES} SELECT conv_id, req_turn, turn, score, paired_with, floor(lexical * 100 + 0.5) / 100 AS lexical,
  floor(memory * 100 + 0.5) / 100 AS memory, floor(importance * 100 + 0.5) / 100 AS importance, floor(recency * 100 + 0.5) / 100 AS recency FROM scores""",
)
def service_relevance_scores(spark, sf):
    scored, _ = service_scores(spark, sf)
    return scored.select(*R.KEYS, "turn", "score", "paired_with", "signals.lexical", "signals.memory", "signals.importance", "signals.recency")


@query("qa_pairs", f"WITH {_SERVICE_BASE}, {P.NO_MEMORY}, {P.SCORES} SELECT conv_id, req_turn, turn, paired_with FROM scores WHERE paired_with IS NOT NULL")
def qa_pairs(spark, sf):
    _, features, requests = _prepared(S.service_messages(spark, sf))
    scored, _ = R.score(features, requests)
    return scored.where(F.col("paired_with").isNotNull()).select(*R.KEYS, "turn", "paired_with")


@query("memory_scores", f"WITH {SERVICE_SCORES} SELECT conv_id, req_turn, key, round(coverage, 6) AS coverage, round(memory_score, 6) AS memory_score FROM memory_scores JOIN latest USING (conv_id)")
def memory_scores(spark, sf):
    _, items = service_scores(spark, sf)
    return rounded(items.where("active").select(*R.KEYS, "key", "coverage", "memory_score"))


@query(
    "external_matches",
    f"WITH {_CONV}, {P.NO_MEMORY}, {P.SCORES} SELECT conv_id, req_turn, turn, CASE WHEN pos % 3 = 0 THEN greatest(score, {V.SEMANTIC_RETRIEVAL_SCORE}) ELSE score END AS score FROM scores",
)
def external_matches(spark, sf):
    """Scores with messages selected by meaning (every third message stands for a model's choice)."""
    _, features, requests = _prepared(S.conversation_messages(spark, sf))
    chosen = R.history(features, requests).where(F.col("pos") % 3 == 0).select(*R.KEYS, "turn", F.lit(V.SEMANTIC_RETRIEVAL_SCORE).alias("score"))
    scored, _ = R.score(features, requests, external=chosen)
    return scored.select(*R.KEYS, "turn", "score")
