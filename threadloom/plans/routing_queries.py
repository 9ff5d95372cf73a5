"""Routing of the service messages: decisions, groups, payload, accounting and checks."""

from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import annotate as A
from threadloom.operators import memory as M
from threadloom.operators import ordered, recovery
from threadloom.operators import relevance as R
from threadloom.operators import routing as G
from threadloom.operators import verdicts as W
from threadloom.plans import routing_sql as D
from threadloom.plans import text_sql as X
from threadloom.plans.registry import query
from threadloom.plans.relevance_queries import _prepared
from threadloom.sources import tables as S


def _service(spark, sf):
    """The service messages and what :func:`_prepared` makes of them; the messages are those of its written table, so they are numbered once."""
    messages = S.service_messages(spark, sf)
    annotated, features, requests = _prepared(messages)
    return annotated.select(*messages.columns), annotated, features, requests


def compiled(spark, sf, summaries=None):
    messages, annotated, features, requests = _service(spark, sf)
    return messages, G.compile_requests(messages, features, requests, A.statements_of(annotated), summaries=summaries)


@query(
    "route_messages",
    f"WITH {D.DECISIONS} SELECT conv_id, req_turn, turn, role, action, score, group_id, duplicate_of, continuity, antecedent FROM decisions",
)
def route_messages(spark, sf):
    _, c = compiled(spark, sf)
    d = c.decisions.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("continuity", "antecedent")})
    return d.select(*R.KEYS, "turn", "role", "action", "score", "group_id", "duplicate_of", "continuity", "antecedent")


@query("compressed_groups", f"WITH {D.DECISIONS} SELECT * FROM groups")
def compressed_groups(spark, sf):
    _, c = compiled(spark, sf)
    return c.groups.select("conv_id", "group_id", "kind", "n_sources", "first_pos", "original_tokens", "compressed_tokens", "summary")


@query("injected_memory", f"WITH {D.DECISIONS} SELECT * FROM injected")
def injected_memory(spark, sf):
    _, c = compiled(spark, sf)
    return c.memory.select("conv_id", "key", "value", "block_tokens")


@query(
    "antecedent_block",
    f"WITH {D.DECISIONS} SELECT a.conv_id, r.turn, 'those errors' AS phrase FROM antecedents a JOIN rows0 r USING (conv_id, pos)",
)
def antecedent_block(spark, sf):
    _, features, requests = _prepared(S.service_messages(spark, sf))
    rows = R.history(features, requests)
    picked = R.antecedents(rows, requests).select(*R.KEYS, "phrase", F.explode("selected").alias("pos"))
    return picked.join(ordered.merged(rows.select(*R.KEYS, "pos", "turn")), [*R.KEYS, "pos"]).select("conv_id", "turn", "phrase")


@query(
    "savings_partition",
    f"""WITH {D.DECISIONS},
d AS (SELECT conv_id, req_turn, sum(tokens) AS total, sum(tokens) FILTER (action IN ('KEEP', 'RETRIEVE')) AS exact, coalesce(sum(tokens) FILTER (action = 'OMIT' AND duplicate_of IS NULL), 0) AS omission,
    coalesce(sum(tokens) FILTER (action = 'OMIT' AND duplicate_of IS NOT NULL), 0) AS copies, coalesce(sum(tokens) FILTER (action = 'MEMORY'), 0) AS remembered,
    count(*) FILTER (action = 'KEEP') AS keep_count, count(*) FILTER (action = 'MEMORY') AS memory_count, count(*) FILTER (action = 'RETRIEVE') AS retrieve_count,
    count(*) FILTER (action = 'COMPRESS') AS compress_count, count(*) FILTER (action = 'OMIT') AS omit_count, count(*) AS total_items FROM decisions GROUP BY conv_id, req_turn),
g AS (SELECT conv_id, sum(compressed_tokens) AS compressed, coalesce(sum(original_tokens - compressed_tokens) FILTER (kind = 'duplicate'), 0) AS dup_gain, coalesce(sum(original_tokens - compressed_tokens) FILTER (kind <> 'duplicate'), 0) AS other_gain FROM groups GROUP BY conv_id),
b AS (SELECT conv_id, block_tokens FROM paying),
s AS (SELECT d.*, {X.tokens('l.request')} AS req, total + {X.tokens('l.request')} AS original_tokens, coalesce(exact, 0) + coalesce(compressed, 0) + coalesce(block_tokens, 0) + {X.tokens('l.request')} AS compiled_tokens,
    coalesce(dup_gain, 0) AS dup_gain, coalesce(other_gain, 0) AS other_gain, coalesce(block_tokens, 0) AS block FROM d JOIN latest l USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN b USING (conv_id))
SELECT conv_id, req_turn, CAST(original_tokens AS BIGINT) AS original_tokens, CAST(compiled_tokens AS BIGINT) AS compiled_tokens, CAST(original_tokens - compiled_tokens AS BIGINT) AS tokens_avoided,
  floor(CAST(original_tokens - compiled_tokens AS DOUBLE) / original_tokens * 1000 + 0.5) / 10 AS reduction_percent, CAST(omission AS BIGINT) AS omission, CAST(copies + dup_gain AS BIGINT) AS deduplication,
  CAST(other_gain AS BIGINT) AS compression, CAST(remembered - block AS BIGINT) AS memory, keep_count, memory_count, retrieve_count, compress_count, omit_count, total_items FROM s""",
)
def savings_partition(spark, sf):
    _, c = compiled(spark, sf)
    return G.savings(c)


@query("payload_entries", f"WITH {D.ENTRIES} SELECT conv_id, req_turn, place, sub, entry_id, role, section, content, tokens FROM entries")
def payload_entries(spark, sf):
    messages, c = compiled(spark, sf)
    e = G.payload_entries(c, messages)
    return e.select(*R.KEYS, F.col("place.pos").alias("place"), F.col("place.sub").alias("sub"), "entry_id", "role", "section", "content", "tokens")


_BODY = " || ".join(
    f"CASE WHEN {s} IS NULL THEN '' ELSE concat('<{s}>', chr(10), {s}, chr(10), '</{s}>', chr(10), chr(10)) END"
    for s in ("instructions", "structured_memory", "compressed_context", "conversation_history")
)


@query(
    "payload",
    f"""WITH {D.ENTRIES},
l AS (SELECT *, CASE WHEN section IS NULL AND role IN ('system', 'developer') THEN 'i' WHEN section = 'memory' THEN 'm' WHEN section = 'compressed' THEN 'c' ELSE 'h' END AS part,
  CASE WHEN section IS NULL THEN concat('[', role, '] ', content) ELSE content END AS line FROM entries),
p AS (SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(line, chr(10) ORDER BY place, sub) FILTER (part = 'i') AS instructions, string_agg(line, chr(10) ORDER BY place, sub) FILTER (part = 'm') AS structured_memory,
  string_agg(line, chr(10) ORDER BY place, sub) FILTER (part = 'c') AS compressed_context, string_agg(line, chr(10) ORDER BY place, sub) FILTER (part = 'h') AS conversation_history FROM l GROUP BY conv_id)
SELECT l.conv_id, l.req_turn, coalesce(p.tokens, 0) + {X.tokens('l.request')} AS context_tokens, FALSE AS too_large,
  concat(CASE WHEN p.conv_id IS NOT NULL THEN concat('<context>', chr(10), {_BODY}, '</context>', chr(10), chr(10)) ELSE '' END, '<current_request>', chr(10), l.request, chr(10), '</current_request>', chr(10)) AS prompt
FROM latest l LEFT JOIN p USING (conv_id)""",
)
def payload(spark, sf):
    messages, c = compiled(spark, sf)
    return G.render_prompts(ordered.cut_lineage(G.payload_entries(c, messages)), c.requests)


@query(
    "context_checks",
    """WITH l AS (SELECT user_id AS conv_id, count(*) AS n FROM events GROUP BY user_id)
SELECT conv_id, c AS "check", CAST(0 AS BIGINT) AS failures, TRUE AS passed FROM l, (VALUES ('protected_retained'), ('protected_not_compressed'), ('omitted_not_sent'), ('routed_once'), ('non_empty')) v(c)""",
)
def context_checks(spark, sf):
    messages, c = compiled(spark, sf)
    checks = G.check_context(c, ordered.cut_lineage(G.payload_entries(c, messages)), messages)
    return checks.select("conv_id", "check", "failures", "passed")


@query(
    "memory_checks",
    f"""WITH {D.ENTRIES}, r AS (SELECT conv_id, key, lower(value) AS v FROM memory_scores WHERE coverage > 0)
SELECT r.conv_id, r.key, EXISTS (SELECT 1 FROM entries e WHERE e.conv_id = r.conv_id AND contains(lower(e.content), r.v))
  OR EXISTS (SELECT 1 FROM memory_events s JOIN decisions d USING (conv_id, turn) WHERE s.conv_id = r.conv_id AND s.key = r.key AND s.change <> 'ignored' AND d.action IN ('KEEP', 'RETRIEVE', 'COMPRESS')) AS passed FROM r""",
)
def memory_checks(spark, sf):
    messages, annotated, features, requests = _service(spark, sf)
    said = A.statements_of(annotated)
    c = G.compile_requests(messages, features, requests, said)
    events = M.memory_events(M.memory_before_requests(said, requests), R.KEYS)
    sources = M.memory_sources(events, R.KEYS)
    _, items = R.score(features, requests, ordered.cut_lineage(M.memory_items(events, R.KEYS)), sources)
    entries = ordered.cut_lineage(G.payload_entries(c, messages))
    return G.check_memory(c, items, sources, entries).select("conv_id", "key", "passed")


@query(
    "identifier_checks",
    f"""WITH {D.ENTRIES}, i AS (SELECT DISTINCT conv_id, unnest(list_filter(list_transform(regexp_extract_all(request, {X.sql_quote(V.EXACT_TOKEN)}), lambda t: regexp_replace(t, '^`|`$', '', 'g')), lambda t: length(t) >= 3)) AS identifier FROM latest)
SELECT i.conv_id, i.identifier, EXISTS (SELECT 1 FROM entries e WHERE e.conv_id = i.conv_id AND contains(lower(e.content), lower(i.identifier))) AS passed
FROM i WHERE EXISTS (SELECT 1 FROM history h WHERE h.conv_id = i.conv_id AND contains(lower(h.text), lower(i.identifier)))""",
)
def identifier_checks(spark, sf):
    messages, c = compiled(spark, sf)
    entries = ordered.cut_lineage(G.payload_entries(c, messages))
    return G.check_identifiers(c.requests, entries, messages).select("conv_id", "identifier", "passed")


_NEEDS = f"""{D.DECISIONS},
f AS (SELECT conv_id, count(*) FILTER (NOT protected AND NOT continuity) AS outside, coalesce(bool_or(NOT protected AND NOT continuity AND score >= {V.RETRIEVE_THRESHOLD}), FALSE) AS any_relevant FROM decisions GROUP BY conv_id),
q AS (SELECT l.conv_id, l.req_turn, f.outside, f.any_relevant, l.request = '{D.REFERRING}' AS refers, l.request = '{D.REFERRING}' AND EXISTS (SELECT 1 FROM antecedents a WHERE a.conv_id = l.conv_id) AS resolved,
  {X.hit('l.request', V.REFERENTIAL_WORDS, 'i')} AS earlier, {X.hit('l.request', V.RECALL_WORDS, 'i')} AS recall, len(a.request_terms) AS terms,
  {X.words('lower(l.request)')} BETWEEN 1 AND {V.FOLLOW_UP_MAX_WORDS} AND ({' OR '.join(X.hit('lower(l.request)', p) for p in V.FOLLOW_UP_PATTERNS)}) AS follow_up FROM latest l JOIN f USING (conv_id) JOIN asked a USING (conv_id)),
needs AS (SELECT conv_id, req_turn, outside, any_relevant, follow_up, resolved AS reference_resolved, refers AND NOT resolved AND outside >= 1 AS reference_unresolved,
  NOT resolved AND ((follow_up AND outside >= 1 AND NOT any_relevant) OR (refers AND outside >= 1) OR (outside >= 6 AND ((earlier AND recall) OR (NOT any_relevant AND (earlier OR terms <= 2))))) AS needs_search FROM q)"""


@query("search_needs", f"WITH {_NEEDS} SELECT * FROM needs")
def search_needs(spark, sf):
    _, c = compiled(spark, sf)
    return G.search_needs(c)


def _recovered(spark, sf):
    """Recovery of the first three user messages of each history within 60 tokens, then of the next best matches."""
    messages, annotated, features, requests = _service(spark, sf)
    turns = F.array(*[F.lit(t).cast("bigint") for t in (1, 2, 3)])
    expansion = requests.select(*R.KEYS, turns.alias("include_ids"), F.lit(60).cast("bigint").alias("token_budget"), F.lit(0.05).alias("min_score"))
    sent = requests.select(*R.KEYS, F.lit(2).cast("bigint").alias("turn")).where(F.col("conv_id") % 2 == 0)
    return messages, G.compile_requests(messages, features, requests, A.statements_of(annotated), expansion=expansion, already_sent=sent)


@query("expansion_report")
def expansion_report(spark, sf):
    _, c = _recovered(spark, sf)
    return recovery.report_totals(c.recovered)


@query("expansion_items")
def expansion_items(spark, sf):
    _, c = _recovered(spark, sf)
    return c.recovered


@query("full_context", f"WITH {D.SERVICE_SCORES} SELECT conv_id, req_turn, pos, CAST(turn AS VARCHAR) AS entry_id, role, text AS content, tokens FROM history")
def full_context(spark, sf):
    messages = S.service_messages(spark, sf)
    return G.full_context(messages, R.latest_requests(messages))


@query(
    "search_pool",
    f"""WITH {_NEEDS}, p AS (SELECT d.conv_id, d.turn, d.pos, d.n, d.protected, w.reference_unresolved FROM decisions d JOIN needs w USING (conv_id) WHERE w.needs_search AND NOT d.continuity)
SELECT conv_id, turn FROM p WHERE reference_unresolved AND pos >= n - {V.ANTECEDENT_WINDOW}
UNION ALL SELECT conv_id, turn FROM (SELECT conv_id, turn FROM p WHERE NOT reference_unresolved AND NOT protected QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= {V.SEARCH_DIGESTS})""",
)
def search_pool(spark, sf):
    _, c = compiled(spark, sf)
    return G.search_pool(c, G.search_needs(c)).select("conv_id", "turn")


def _document_conversations(spark, sf):
    """Documents as assistant messages of fifty conversations, each ending in a user request."""
    cited = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" See notes/item.md."))).otherwise(F.col("text"))
    docs = S.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("conv_id"), F.col("doc_id").alias("turn"), cited.alias("text"))
    # the request quotes a document with exact wording where there is one: such a message can only be shortened by a supplied summary
    exact = F.when(T.needs_exact_wording(F.col("text")) & (F.length("text") > 1200), F.col("turn"))
    first = docs.groupBy("conv_id").agg(F.coalesce(F.min_by("text", exact), F.min_by("text", "turn")).alias("text"), (F.max("turn") + 1).alias("turn"))
    rows = docs.withColumn("role", F.lit("assistant")).unionByName(first.select("conv_id", "turn", F.substring("text", 1, 300).alias("text"), F.lit("user").alias("role")))
    rows = rows.withColumn("_span", ordered.span_of(F.col("turn")))
    return docs, ordered.cut_lineage(ordered.positions(rows, ["conv_id"], ["_span"], ["turn"]).drop("_span"))


@query("summary_prompts")
def summary_prompts(spark, sf):
    _, messages = _document_conversations(spark, sf)
    _, features, requests = _prepared(messages)
    c = G.compile_requests(messages, features, requests)
    wanted = c.decisions.where("summary_candidate").select(*R.KEYS, "turn")
    return W.summary_prompts(wanted.join(ordered.merged(messages.select("conv_id", "turn", "text")), ["conv_id", "turn"]))


@query("external_summaries")
def external_summaries(spark, sf):
    """Supplied summaries of the long documents of a conversation stand in where they shrink a relevant message."""
    docs, messages = _document_conversations(spark, sf)
    _, features, requests = _prepared(messages)
    summaries = docs.where(F.length("text") > 400).select("conv_id", "turn", F.substring("text", 1, 120).alias("summary"))
    c = G.compile_requests(messages, features, requests, summaries=summaries)
    return c.groups.select(*R.KEYS, "group_id", "kind", "original_tokens", "compressed_tokens")


@query(
    "omission_report",
    f"""WITH {D.DECISIONS} SELECT conv_id, turn, tokens, score, duplicate_of IS NOT NULL AS duplicate FROM decisions WHERE action = 'OMIT'""",
)
def omission_report(spark, sf):
    _, c = compiled(spark, sf)
    d = c.decisions.where(F.col("action") == "OMIT")
    return d.select("conv_id", "turn", "tokens", "score", F.col("duplicate_of").isNotNull().alias("duplicate")).orderBy(F.desc("tokens"))


@query(
    "top_omitted",
    f"""WITH {D.DECISIONS} SELECT conv_id, turn, score, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, tokens DESC, pos) AS place
FROM decisions WHERE action = 'OMIT' AND duplicate_of IS NULL QUALIFY place <= 40""",
)
def top_omitted(spark, sf):
    """The forty omitted messages shown to the evaluator, best score first."""
    _, c = compiled(spark, sf)
    order = ordered.Window.partitionBy(*R.KEYS).orderBy(F.desc("score"), F.desc("tokens"), "pos")
    d = c.decisions.where((F.col("action") == "OMIT") & F.col("duplicate_of").isNull()).withColumn("place", F.row_number().over(order))
    return d.where(F.col("place") <= 40).select("conv_id", "turn", "score", "tokens", F.col("place").cast("bigint").alias("place"))
