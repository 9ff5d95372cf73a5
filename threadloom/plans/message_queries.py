"""Text features, annotation, statements and memory."""

from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import annotate as A
from threadloom.operators import memory as M
from threadloom.operators import mentions
from threadloom.operators import ordered
from threadloom.operators import relevance as R
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q
from threadloom.plans.registry import query, rounded
from threadloom.sources import tables as S

_ALL = f"""{Q.RULE_MESSAGES},
{Q.SERVICE_MESSAGES},
all_messages AS (SELECT * FROM rule_messages UNION ALL SELECT conv_id + 2000000000 AS conv_id, turn, pos, role, text FROM service_messages),
messages AS (SELECT * FROM all_messages)"""


def _all(spark, sf):
    service = S.service_messages(spark, sf).withColumn("conv_id", F.col("conv_id") + 2_000_000_000)
    return S.rule_messages(spark, sf).unionByName(service)


@query(
    "message_features",
    f"""WITH {_ALL}, t AS (SELECT DISTINCT text FROM messages), f AS (
  SELECT text, {X.tokens('text')} + 4 AS tokens, CASE WHEN length({X.collapse('text')}) > 140 THEN concat({X.collapse('text')}[1:140], '…') ELSE {X.collapse('text')} END AS preview,
    CAST(len({X.sentences('text')}) AS BIGINT) AS sentences, CAST({X.words('text')} AS BIGINT) AS words, {X.asks('text')} AS asks,
    {X.signature('text')} AS signature, {X.template(X.signature('text'))} AS template, {X.event('text')} AS event,
    {X.hit('text', V.EXACT_WORDING)} AS exact_wording,
    {X.hit('text', V.LEVEL_PREFIX, 'im')} OR {X.hit('text', V.STACK_FRAME)} OR ({X.hit('text', V.ERROR_WORD, 'i')} AND len(regexp_extract_all(text, {X.sql_quote(V.KEY_VALUE)})) >= 2) AS evidence
  FROM t)
SELECT conv_id, turn, f.* EXCLUDE (text) FROM messages JOIN f USING (text)""",
)
def message_features(spark, sf):
    text = F.col("text")
    rows = _all(spark, sf).withColumn("signature", T.signature(text))
    return rows.select(
        "conv_id",
        "turn",
        T.message_tokens(text).alias("tokens"),
        T.preview(text).alias("preview"),
        F.size(T.sentences(text)).cast("bigint").alias("sentences"),
        T.word_count(text).cast("bigint").alias("words"),
        T.is_question_or_request(text).alias("asks"),
        "signature",
        T.template_signature(F.col("signature")).alias("template"),
        T.primary_event(text).alias("event"),
        T.needs_exact_wording(text).alias("exact_wording"),
        T.error_evidence(text).alias("evidence"),
    )


@query(
    "document_text_features",
    f"""SELECT doc_id, {X.tokens('text')} AS tokens, CAST(len({X.sentences('text')}) AS BIGINT) AS sentences, CAST({X.words('text')} AS BIGINT) AS words,
  md5({X.signature('text')}) AS signature, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {X.sql_quote(V.EXACT_TOKEN)}), lambda t: regexp_replace(t, '^`|`$', '', 'g')))), ' ') AS exact_tokens FROM documents""",
)
def document_text_features(spark, sf):
    text = F.col("text")
    return S.table(spark, sf, "documents").select(
        "doc_id",
        T.text_tokens(text).alias("tokens"),
        F.size(T.sentences(text)).cast("bigint").alias("sentences"),
        T.word_count(text).cast("bigint").alias("words"),
        F.md5(T.signature(text)).alias("signature"),
        F.array_join(F.array_sort(T.exact_tokens(text)), " ").alias("exact_tokens"),
    )


@query(
    "annotate_messages",
    f"""WITH {_ALL}, {X.annotated('messages')}
SELECT m.conv_id, m.turn, n.content_type, CASE WHEN n.ambiguous THEN 'heuristic' ELSE 'deterministic' END AS class_method, n.ambiguous,
  n.level AS protection_level, n.reason AS protection_reason, n.memory_complete FROM messages m JOIN notes n USING (role, text)""",
)
def annotate_messages(spark, sf):
    a = A.annotate(_all(spark, sf))
    return a.select(
        "conv_id", "turn", "content_type", "class_method", "ambiguous", F.col("protection.level").alias("protection_level"), F.col("protection.reason").alias("protection_reason"), "memory_complete"
    )


@query(
    "annotate_conversations",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')}
SELECT m.conv_id, m.turn, n.content_type, n.ambiguous, n.level AS protection_level, n.memory_complete FROM messages m JOIN notes n USING (role, text)""",
)
def annotate_conversations(spark, sf):
    a = A.annotate(S.conversation_messages(spark, sf))
    return a.select("conv_id", "turn", "content_type", "ambiguous", F.col("protection.level").alias("protection_level"), "memory_complete")


@query(
    "annotate_documents",
    f"""WITH messages AS (SELECT doc_id AS conv_id, 0 AS turn, 0 AS pos, CASE WHEN doc_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role, text FROM documents), {X.annotated('messages')}
SELECT m.conv_id, n.content_type, n.ambiguous, n.level AS protection_level, n.memory_complete FROM messages m JOIN notes n USING (role, text)""",
)
def annotate_documents(spark, sf):
    """The same rules on long real-shaped prose."""
    role = F.when(F.col("doc_id") % 3 == 0, "assistant").otherwise("user")
    zero = F.lit(0).cast("bigint")
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), zero.alias("turn"), zero.alias("pos"), role.alias("role"), "text")
    a = A.annotate(docs)
    return a.select("conv_id", "content_type", "ambiguous", F.col("protection.level").alias("protection_level"), "memory_complete")


@query(
    "annotate_incremental",
    f"""WITH {_ALL}, {X.annotated('messages')}
SELECT m.conv_id, m.turn, n.content_type FROM messages m JOIN notes n USING (role, text) WHERE m.turn % 10 = 0""",
)
def annotate_incremental(spark, sf):
    """Nine tenths were annotated before; only the others are classified."""
    messages = _all(spark, sf)
    known = messages.where(F.col("turn") % 10 != 0).select("conv_id", "turn")
    return A.annotate_new(messages, known).select("conv_id", "turn", "content_type")


@query(
    "merge_model_annotations",
    f"""WITH {Q.CONVERSATIONS}, {X.annotated('messages')}, a AS (SELECT m.*, n.content_type, n.ambiguous, n.level, n.memory_complete FROM messages m JOIN notes n USING (role, text)),
r AS (SELECT *, ambiguous AND turn % 2 = 0 AS answered, turn % 4 = 0 AS says_protected FROM a)
SELECT conv_id, turn, CASE WHEN answered THEN CASE WHEN says_protected THEN 'constraint' ELSE 'fact' END ELSE content_type END AS content_type,
  CASE WHEN answered THEN 'semantic' WHEN ambiguous THEN 'heuristic' ELSE 'deterministic' END AS class_method,
  CASE WHEN level IS NULL AND answered AND says_protected THEN 'high' ELSE level END AS protection_level,
  CASE WHEN answered THEN level IS NULL AND NOT says_protected ELSE memory_complete END AS memory_complete, ambiguous AND NOT answered AS ambiguous FROM r""",
)
def merge_model_annotations(spark, sf):
    a = A.annotate(S.conversation_messages(spark, sf))
    replies = a.where(F.col("turn") % 2 == 0).select(
        "conv_id", "turn", F.lit("fact").alias("content_type"), (F.col("turn") % 4 == 0).alias("protected"), F.lit("states a rule").alias("protection_reason"), F.lit(True).alias("complete")
    )
    merged = A.merge_model_annotations(a, replies)
    return merged.select("conv_id", "turn", "content_type", "class_method", F.col("protection.level").alias("protection_level"), "memory_complete", "ambiguous")


@query(
    "class_counts",
    f"""WITH {_ALL}, {X.annotated('messages')}
SELECT n.content_type, count(*) FILTER (NOT ambiguous) AS deterministic, count(*) FILTER (ambiguous) AS heuristic, CAST(0 AS BIGINT) AS semantic FROM messages m JOIN notes n USING (role, text) GROUP BY n.content_type""",
)
def class_counts(spark, sf):
    a = A.annotate(_all(spark, sf))
    return a.groupBy("content_type").pivot("class_method", ["deterministic", "heuristic", "semantic"]).count().na.fill(0)


@query(
    "extract_statements",
    f"""WITH {_ALL}, {X.annotated('messages')}
SELECT m.conv_id, m.turn, s.idx, s.key, s.value, s.type, s.confidence, s.op FROM messages m JOIN said s USING (role, text) WHERE m.role <> 'assistant'""",
)
def extract_statements(spark, sf):
    return A.statements_of(A.annotate(_all(spark, sf)))


_ORDERS = f"{Q.ORDER_MESSAGES}, messages AS (SELECT * FROM order_messages), {X.annotated('messages')}, {X.STATEMENTS}, {X.MEMORY}"
_SERVICE = f"{Q.SERVICE_MESSAGES}, messages AS (SELECT * FROM service_messages), {X.annotated('messages')}, {X.STATEMENTS}"


def _order_events(spark, sf):
    return M.memory_events(A.statements_of(A.annotate(S.order_messages(spark, sf))))


@query(
    "merge_memory",
    f"""WITH {_ORDERS} SELECT conv_id, key, value, type, round(confidence, 6) AS confidence, active, n_sources, first_source, last_source, n_previous FROM memory_items""",
)
def merge_memory(spark, sf):
    return rounded(M.memory_items(_order_events(spark, sf)).drop("created_at"))


@query(
    "merge_event_memory",
    f"""WITH {Q.EVENT_MESSAGES}, messages AS (SELECT * FROM event_messages), {X.annotated('messages')}, {X.STATEMENTS}, {X.MEMORY}
SELECT conv_id, key, value, type, round(confidence, 6) AS confidence, active, n_sources, first_source, last_source, n_previous FROM memory_items""",
)
def merge_event_memory(spark, sf):
    events = M.memory_events(A.statements_of(A.annotate(S.event_messages(spark, sf))))
    return rounded(M.memory_items(events).drop("created_at"))


@query(
    "memory_changes",
    f"""WITH {_ORDERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, key ORDER BY change = 'unchanged', idx DESC) AS rn FROM memory_events WHERE change <> 'ignored')
SELECT conv_id, turn, key, change, item_value AS value, previous_value FROM ranked WHERE rn = 1""",
)
def memory_changes(spark, sf):
    return M.memory_changes(_order_events(spark, sf))


@query("memory_sources", f"WITH {_ORDERS} SELECT DISTINCT conv_id, key, turn FROM memory_events WHERE change <> 'ignored'")
def memory_sources(spark, sf):
    return M.memory_sources(_order_events(spark, sf))


@query("memory_history", f"WITH {_ORDERS} SELECT conv_id, key, turn, idx, previous_value FROM memory_events WHERE change = 'updated'")
def memory_history(spark, sf):
    return M.memory_history(_order_events(spark, sf))


@query(
    "memory_block",
    f"""WITH {_ORDERS}, l AS (SELECT conv_id, created_at, concat(key, ': ', value) AS line FROM memory_items WHERE active),
b AS (SELECT conv_id, count(*) AS n_items, CAST(sum({X.tokens('line')} + 1) AS BIGINT) AS line_tokens, concat('{V.MEMORY_BLOCK_HEADER}', chr(10), string_agg(line, chr(10) ORDER BY created_at)) AS block FROM l GROUP BY conv_id)
SELECT conv_id, n_items, line_tokens, {X.tokens('block')} + 4 AS block_tokens, block FROM b""",
)
def memory_block(spark, sf):
    return M.memory_block(M.memory_items(_order_events(spark, sf)))


@query(
    "memory_totals",
    f"WITH {_ORDERS} SELECT count(*) FILTER (active) AS active_items, count(*) AS all_items, CAST(sum(n_previous) AS BIGINT) AS superseded_values FROM memory_items",
)
def memory_totals(spark, sf):
    return M.memory_totals(M.memory_items(_order_events(spark, sf)))


@query(
    "memory_as_of",
    f"""WITH {Q.ORDER_MESSAGES}, messages AS (SELECT * FROM order_messages), {X.annotated('messages')}, {X.STATEMENTS.replace('statements AS', 'every_statement AS')},
{Q.LATEST}, statements AS (SELECT s.* FROM every_statement s JOIN latest USING (conv_id) WHERE s.turn < req_turn), {X.MEMORY}
SELECT conv_id, req_turn, key, value, round(confidence, 6) AS confidence, active, n_sources FROM memory_items JOIN latest USING (conv_id)""",
)
def memory_as_of(spark, sf):
    messages = S.order_messages(spark, sf)
    before = M.memory_before_requests(A.statements_of(A.annotate(messages)), R.latest_requests(messages))
    items = M.memory_items(M.memory_events(before, R.KEYS), R.KEYS)
    return rounded(items.select(*R.KEYS, "key", "value", "confidence", "active", "n_sources"))


_EVERY = f"""{Q.ORDER_MESSAGES}, messages AS (SELECT * FROM order_messages), {X.annotated('messages')}, {X.STATEMENTS.replace('statements AS', 'every_statement AS')},
asked AS (SELECT conv_id, turn AS req_turn FROM messages WHERE role = 'user' AND pos > 0),
statements AS (SELECT concat(s.conv_id, ':', req_turn) AS conv_id, s.turn, s.idx, s.key, s.value, s.type, s.confidence, s.op FROM every_statement s JOIN asked USING (conv_id) WHERE s.turn < req_turn), {X.MEMORY},
seen AS (SELECT CAST(split_part(conv_id, ':', 1) AS BIGINT) AS conv, CAST(split_part(conv_id, ':', 2) AS BIGINT) AS req_turn, * EXCLUDE (conv_id) FROM memory_items)"""


@query(
    "memory_as_of_all",
    f"""WITH {_EVERY} SELECT conv AS conv_id, key, value, type, round(confidence, 6) AS confidence, active, n_sources, min(req_turn) AS first_request, max(req_turn) AS last_request, count(*) AS n_requests FROM seen GROUP BY ALL""",
)
def memory_as_of_all(spark, sf):
    """The memory before every request: each version once, with the stretch of requests that see it."""
    messages = S.order_messages(spark, sf)
    versions = ordered.cut_lineage(M.memory_versions(M.memory_events(A.statements_of(A.annotate(messages)))))
    return rounded(M.memory_for_requests(versions, R.all_requests(messages)).drop("turn", "until"))


@query(
    "memory_sizes",
    f"""WITH {_EVERY}, l AS (SELECT conv, req_turn, active, {X.tokens("concat(key, ': ', value)")} + 1 AS cost FROM seen),
t AS (SELECT conv, req_turn, count(*) FILTER (active) AS n, CAST(coalesce(sum(cost) FILTER (active), 0) AS BIGINT) AS tokens FROM l GROUP BY ALL)
SELECT a.conv_id, a.req_turn, coalesce(n, 0) AS active_items, coalesce(tokens, 0) AS line_tokens FROM asked a LEFT JOIN t ON t.conv = a.conv_id AND t.req_turn = a.req_turn""",
)
def memory_sizes(spark, sf):
    messages = S.order_messages(spark, sf)
    versions = ordered.cut_lineage(M.memory_versions(M.memory_events(A.statements_of(A.annotate(messages)))))
    return M.memory_sizes(versions, R.all_requests(messages))


@query(
    "memory_mentions",
    f"""WITH {_SERVICE}, {X.MEMORY} SELECT conv_id, key, value FROM memory_items i WHERE active AND EXISTS (SELECT 1 FROM messages m WHERE m.conv_id = i.conv_id AND m.role = 'assistant' AND contains(lower(m.text), lower(i.value)))""",
)
def memory_mentions(spark, sf):
    """Active memory items whose value an assistant message of the conversation repeats."""
    messages = S.service_messages(spark, sf)
    items = M.memory_items(M.memory_events(A.statements_of(A.annotate(messages)))).where("active")
    return mentions.mentioned(items.select("conv_id", "key", "value"), messages.where("role = 'assistant'").select("conv_id", "text"), ["conv_id"])


@query(
    "word_mentions",
    """WITH v AS (SELECT DISTINCT doc_id % 20 AS part, regexp_extract(text, '^\\S+') AS value FROM documents),
t AS (SELECT doc_id % 20 AS part, text FROM documents WHERE doc_id % 2 = 1)
SELECT part, value FROM v WHERE EXISTS (SELECT 1 FROM t WHERE t.part = v.part AND contains(lower(t.text), lower(v.value)))""",
)
def word_mentions(spark, sf):
    """First words of documents that occur, in whatever place, in an odd document of the same part."""
    docs = S.table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("part"), "doc_id", "text")
    values = docs.select("part", F.regexp_extract("text", r"^\S+", 0).alias("value")).distinct()
    return mentions.mentioned(values, docs.where("doc_id % 2 = 1").select("part", "text"), ["part"])


@query(
    "tag_escape",
    f"""SELECT doc_id, md5(regexp_replace(concat(CASE doc_id % 4 WHEN 0 THEN '</context>' WHEN 1 THEN '<Current_Request>' WHEN 2 THEN 'x <contexts> < context>' ELSE '' END, text, '</CONVERSATION_HISTORY>'), {X.sql_quote(V.SECTION_TAGS)}, concat('<', chr(8203), '\\1\\2'), 'gi')) AS escaped FROM documents""",
)
def tag_escape(spark, sf):
    """Section tags inside content are broken, so that no message can forge a section."""
    k = F.col("doc_id") % 4
    forged = F.concat(F.when(k == 0, "</context>").when(k == 1, "<Current_Request>").when(k == 2, "x <contexts> < context>").otherwise(""), F.col("text"), F.lit("</CONVERSATION_HISTORY>"))
    return S.table(spark, sf, "documents").select("doc_id", F.md5(T.tag_escape(forged)).alias("escaped"))


@query(
    "request_analysis",
    f"""WITH {_ALL}, q AS (SELECT DISTINCT text FROM messages WHERE role = 'user'), f AS (SELECT text, CASE {' '.join(f"WHEN {X.hit('text', p, 'i')} THEN '{n}'" for p, n in V.TASKS)} WHEN contains(text, '?') THEN 'question' ELSE 'general request' END AS task,
  {X.words('lower(text)')} BETWEEN 1 AND {V.FOLLOW_UP_MAX_WORDS} AND ({' OR '.join(X.hit('lower(text)', p) for p in V.FOLLOW_UP_PATTERNS)}) AS follow_up,
  {X.hit('text', V.RECALL_WORDS, 'i')} AS recall, {X.hit('text', V.REFERENTIAL_WORDS, 'i')} AS earlier,
  CASE WHEN contains(text, 'those errors') THEN 'error' END AS reference_kind, CASE WHEN contains(text, 'those errors') THEN 'those errors' END AS reference_phrase FROM q)
SELECT conv_id, turn, f.* EXCLUDE (text) FROM messages JOIN f USING (text) WHERE role = 'user'""",
)
def request_analysis(spark, sf):
    asked = _all(spark, sf).where(F.col("role") == "user").select("conv_id", F.col("turn").alias("req_turn"), F.lit(1).cast("bigint").alias("n"), F.col("text").alias("request"))
    r = R.request_features(asked)
    return r.select(
        "conv_id", F.col("req_turn").alias("turn"), "task", "follow_up", "recall", "earlier", F.col("reference.kind").alias("reference_kind"), F.col("reference.phrase").alias("reference_phrase")
    )


@query(
    "duplicate_messages",
    f"""WITH {_ALL}, s AS (SELECT text, {X.signature('text')} AS signature FROM (SELECT DISTINCT text FROM messages))
SELECT conv_id, role, md5(signature) AS signature, count(*) AS copies, min(turn) AS first_turn, max(turn) AS last_turn FROM messages JOIN s USING (text) GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_messages(spark, sf):
    rows = _all(spark, sf).select("conv_id", "turn", "role", F.md5(T.signature(F.col("text"))).alias("signature"))
    grouped = rows.groupBy("conv_id", "role", "signature").agg(F.count("*").alias("copies"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return grouped.where(F.col("copies") > 1)


@query(
    "cache_keys",
    f"""WITH {_ALL} SELECT conv_id, turn, substr(sha256(concat('summary', chr(10), conv_id, ':', turn, ':', sha256(text))), 1, 32) AS cache_key FROM messages""",
)
def cache_keys(spark, sf):
    msg_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _all(spark, sf).select("conv_id", "turn", T.cache_key(F.lit("summary"), T.source_line(msg_id, F.col("text"))).alias("cache_key"))
