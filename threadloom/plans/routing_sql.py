"""Routing as SQL over the service messages: ``decisions``, ``groups`` and ``injected`` come out."""

from threadloom.functions import fixed_values as V
from threadloom.plans import relevance_sql as P
from threadloom.plans import text_sql as X
from threadloom.plans.relevance_queries import SERVICE_SCORES

REFERRING = "Which of those errors came first?"
_EVIDENCE = f"({X.hit('text', V.LEVEL_PREFIX, 'im')} OR {X.hit('text', V.STACK_FRAME)} OR ({X.hit('text', V.ERROR_WORD, 'i')} AND len(regexp_extract_all(text, {X.sql_quote(V.KEY_VALUE)})) >= 2))"
_TOKENS = P.terms("sentence").removeprefix("list_distinct(").removesuffix(")")
_OWN = P.match("q", "t")

DECISIONS = f"""{SERVICE_SCORES},
flags AS (
  SELECT text, {X.signature('text')} AS sg, {X.template(X.signature('text'))} AS tm, {X.event('text')} AS ev, {X.hit('text', V.EXACT_WORDING)} AS exact_wording, {_EVIDENCE} AS evidence
  FROM (SELECT DISTINCT text FROM history)),
rows0 AS (
  SELECT s.*, n.memory_complete, n.reason AS protection_reason, f.exact_wording, f.evidence, s.content_type IN ('log', 'tool_output') AS logish, f.ev, concat(s.role, '|', f.sg) AS sigk,
    CASE WHEN s.content_type IN ('log', 'tool_output') THEN concat(s.role, '|', f.tm) END AS tmplk,
    CASE WHEN s.content_type IN ('log', 'tool_output') AND f.ev IS NOT NULL THEN concat(s.role, '|', f.ev) END AS evk
  FROM scores s JOIN notes n USING (role, text) JOIN flags f USING (text)),
recent AS (SELECT conv_id, pos FROM (SELECT conv_id, pos, max(tokens) OVER (PARTITION BY conv_id) AS largest FROM (
    SELECT conv_id, pos, tokens FROM rows0 WHERE NOT protected QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= {V.CONTINUITY_MESSAGES})) WHERE largest <= {V.CONTINUITY_MAX_TOKENS}),
shown AS (SELECT r.conv_id, r.pos, r.tokens, r.evidence OR r.logish AS ok FROM rows0 r JOIN latest l USING (conv_id) WHERE l.request = '{REFERRING}' AND r.role = 'user' AND r.pos >= r.n - {V.ANTECEDENT_WINDOW}),
newest AS (SELECT conv_id, max(pos) AS top FROM shown WHERE ok GROUP BY conv_id),
breaks AS (SELECT s.conv_id, max(pos) AS stop FROM shown s JOIN newest USING (conv_id) WHERE NOT ok AND pos < top GROUP BY s.conv_id),
antecedents AS (
  SELECT conv_id, pos FROM (SELECT s.conv_id, s.pos FROM shown s LEFT JOIN breaks b USING (conv_id) WHERE s.ok AND s.pos > coalesce(b.stop, -1))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= {V.ANTECEDENT_MAX_MESSAGES}),
rows1 AS (
  SELECT r.*, CASE WHEN protected THEN 'KEEP' WHEN c.pos IS NOT NULL OR a.pos IS NOT NULL THEN 'RETRIEVE' END AS a1,
    NOT protected AND c.pos IS NOT NULL AS continuity, NOT protected AND c.pos IS NULL AND a.pos IS NOT NULL AS antecedent
  FROM rows0 r LEFT JOIN recent c USING (conv_id, pos) LEFT JOIN antecedents a USING (conv_id, pos)),
kept AS (SELECT conv_id, sigk, max_by(turn, pos) AS kept_turn FROM rows1 WHERE a1 IS NOT NULL GROUP BY conv_id, sigk),
rows2 AS (SELECT r.*, CASE WHEN a1 IS NULL THEN kept_turn END AS dup2, coalesce(a1, CASE WHEN kept_turn IS NOT NULL THEN 'OMIT' END) AS a2 FROM rows1 r LEFT JOIN kept USING (conv_id, sigk)),
links AS (
  SELECT s.conv_id, s.key, s.turn, m.value, m.type IN ('constraint', 'preference') AS always, length(concat(key, ': ', value)) AS line_length, {X.tokens("concat(key, ': ', value)")} + 1 AS line_tokens, r.a2
  FROM (SELECT DISTINCT conv_id, key, turn FROM memory_events WHERE change <> 'ignored') s JOIN memory_scores m USING (conv_id, key) JOIN rows2 r USING (conv_id, turn)
  WHERE m.type IN ('constraint', 'preference') OR m.memory_score >= {V.MEMORY_THRESHOLD}),
eligible AS (SELECT conv_id, key FROM links GROUP BY conv_id, key HAVING bool_or(a2 IS DISTINCT FROM 'KEEP')),
carried AS (SELECT conv_id, turn, sum(line_tokens) AS line_cost, bool_or(always) AS always FROM links JOIN eligible USING (conv_id, key) GROUP BY conv_id, turn),
rows3 AS (
  SELECT *, coalesce(cand AND tokens > line_cost, FALSE) AS remembered, coalesce(a2, CASE WHEN cand AND tokens <= line_cost THEN 'RETRIEVE' END) AS a3
  FROM (SELECT r.*, c.line_cost, coalesce(a2 IS NULL AND c.always, FALSE) AS standing, a2 IS NULL AND c.line_cost IS NOT NULL AND (memory_complete OR score < {V.RETRIEVE_THRESHOLD}) AS cand
    FROM rows2 r LEFT JOIN carried c USING (conv_id, turn))),
block AS (SELECT DISTINCT l.conv_id, l.key, l.value, l.line_length FROM links l JOIN eligible USING (conv_id, key) JOIN rows3 r USING (conv_id, turn) WHERE r.remembered),
block_costs AS (SELECT conv_id, CAST(ceil(({len(V.MEMORY_BLOCK_HEADER)} + sum(line_length) + count(*)) / 4.0) AS BIGINT) + 4 AS block_tokens FROM block GROUP BY conv_id),
paying AS (SELECT conv_id, block_tokens FROM block_costs JOIN (SELECT conv_id, sum(tokens) AS replaced FROM rows3 WHERE remembered GROUP BY conv_id) USING (conv_id) WHERE block_tokens < replaced),
injected AS (SELECT conv_id, key, value, block_tokens FROM block JOIN paying USING (conv_id)),
rows4 AS (SELECT r.*, coalesce(a3, CASE WHEN remembered THEN CASE WHEN p.conv_id IS NOT NULL THEN 'MEMORY' ELSE 'RETRIEVE' END END) AS a4 FROM rows3 r LEFT JOIN paying p USING (conv_id)),
pool1 AS (SELECT conv_id, pos, turn, logish, sigk, tmplk, evk, ev, text, tokens, score, tmplk IS NOT NULL AND count(*) OVER (PARTITION BY conv_id, tmplk) >= 2 AS g1 FROM rows4 WHERE a4 IS NULL),
pool2 AS (SELECT *, NOT g1 AND evk IS NOT NULL AND count(*) FILTER (NOT g1) OVER (PARTITION BY conv_id, evk) >= 2 AS g2 FROM pool1),
pool3 AS (SELECT *, NOT g1 AND NOT g2 AND count(*) FILTER (NOT g1 AND NOT g2) OVER (PARTITION BY conv_id, sigk) >= 2 AS g3 FROM pool2),
members AS (SELECT *, CASE WHEN g1 THEN 'template' WHEN g2 THEN 'event' ELSE 'text' END AS pass, CASE WHEN g1 THEN tmplk WHEN g2 THEN evk ELSE sigk END AS gkey FROM pool3 WHERE g1 OR g2 OR g3),
parts AS (
  SELECT conv_id, pass, gkey, sigk, count(*) AS copies, min(pos) AS first_pos, min_by(turn, pos) AS first_turn, {X.trim('min_by(text, pos)')} AS line, max(score) AS score, sum(tokens) AS tokens, bool_and(logish) AS logs, min_by(ev, pos) AS ev
  FROM members GROUP BY conv_id, pass, gkey, sigk),
packed AS (
  SELECT conv_id, pass, gkey, sum(copies) AS size, count(*) AS n_parts, min(first_pos) AS first_pos, min_by(first_turn, first_pos) AS first_turn, max(score) AS score, sum(tokens) AS original_tokens, bool_and(logs) AS logs,
    CASE WHEN pass <> 'text' THEN min_by(ev, first_pos) END AS ev, list({{'line': line, 'copies': copies}} ORDER BY first_pos) AS ps FROM parts GROUP BY conv_id, pass, gkey),
worded AS (
  SELECT *, list_transform(ps, lambda p: CASE WHEN p.copies > 1 THEN concat(p.line, ' (×', p.copies, ')') ELSE p.line END) AS shown_lines,
    CASE WHEN ev IS NOT NULL THEN concat(size, 'x, ', ev) ELSE concat(size, 'x') END AS label FROM packed),
summed AS (
  SELECT *, CASE WHEN n_parts = 1 THEN concat('Repeated ', CASE WHEN logs THEN 'log' ELSE 'message' END, ' (', size, 'x): ', ps[1].line)
    WHEN n_parts <= 3 THEN concat('Related logs (', label, '): ', array_to_string(shown_lines, ' | '))
    ELSE concat('Related logs (', label, '; ', n_parts - 2, ' similar lines omitted between first and last): ', shown_lines[1], ' | ', shown_lines[-1]) END AS summary FROM worded),
ruled AS (
  SELECT *, {X.tokens('summary')} + 4 AS compressed_tokens, concat(pass, ':', first_turn) AS group_id, CASE WHEN score < {V.RETRIEVE_THRESHOLD} THEN 'omit'
    WHEN original_tokens - ({X.tokens('summary')} + 4) >= {V.MIN_SAVED_TOKENS} AND {X.tokens('summary')} + 4 <= original_tokens * {V.MAX_COMPRESSED_RATIO} THEN 'compress' WHEN n_parts = 1 THEN 'one_copy' END AS verdict FROM summed),
member_routes AS (
  SELECT m.conv_id, m.pos, g.verdict, g.group_id, p.first_turn, m.turn <> p.first_turn AS is_copy FROM members m JOIN parts p USING (conv_id, pass, gkey, sigk) JOIN ruled g USING (conv_id, pass, gkey)),
rows5 AS (
  SELECT r.*, CASE WHEN verdict = 'compress' THEN m.group_id END AS gid5, CASE WHEN verdict IN ('omit', 'one_copy') AND is_copy THEN m.first_turn END AS dup5,
    coalesce(a4, CASE WHEN verdict = 'compress' THEN 'COMPRESS' WHEN verdict = 'omit' OR (verdict = 'one_copy' AND is_copy) THEN 'OMIT' WHEN verdict = 'one_copy' THEN 'RETRIEVE' END) AS a5
  FROM rows4 r LEFT JOIN member_routes m USING (conv_id, pos)),
prose AS (
  SELECT conv_id, pos, turn, text, tokens, score, pos - row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS island FROM rows5
  WHERE a5 IS NULL AND score >= {V.RETRIEVE_THRESHOLD} AND content_type IN ('discussion', 'fact', 'decision') AND NOT exact_wording),
runs AS (SELECT conv_id, island, min(pos) AS run, sum(tokens) AS original_tokens, count(*) AS n_sources FROM prose GROUP BY conv_id, island HAVING sum(tokens) >= {V.MIN_DISCUSSION_TOKENS}),
cut_lines AS (
  SELECT conv_id, island, pos, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS line_no FROM (
    SELECT p.*, list_filter(regexp_split_to_array(regexp_replace({X.trim('text')}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: s <> '') AS ss FROM prose p JOIN runs USING (conv_id, island))),
rated AS (
  SELECT c.*, length(sentence) AS chars, {X.tokens('sentence')} + 1 AS cost, 3 * len(list_filter({_TOKENS}, lambda t: len(list_filter(a.request_terms, lambda q: {_OWN})) > 0))
    + len(regexp_extract_all(sentence, '[0-9]+')) + 0.5 * len(regexp_extract_all(sentence, '\\s[A-Z][a-zA-Z]+')) AS rating
  FROM cut_lines c JOIN asked a USING (conv_id)),
greedy AS (
  SELECT conv_id, island, count(*) AS sentences, list_reduce(list_prepend({{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[]), 'cost': CAST(0 AS BIGINT), 'id': CAST(0 AS BIGINT), 'budget': CAST(0 AS BIGINT)}},
    list({{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[]), 'cost': cost, 'id': pos * 2147483648 + line_no, 'budget': CAST(floor(original_tokens * {V.DISCUSSION_BUDGET}) AS BIGINT)}} ORDER BY rating DESC, pos, line_no)),
    lambda acc, x: {{'used': CASE WHEN acc.used + x.cost <= x.budget THEN acc.used + x.cost ELSE acc.used END, 'ids': CASE WHEN acc.used + x.cost <= x.budget THEN list_append(acc.ids, x.id) ELSE acc.ids END, 'cost': x.cost, 'id': x.id, 'budget': x.budget}}) AS r
  FROM rated JOIN runs USING (conv_id, island) GROUP BY conv_id, island),
extracts AS (
  SELECT r.conv_id, r.island, string_agg(r.sentence, ' ' ORDER BY r.pos, r.line_no) AS body FROM rated r JOIN greedy g USING (conv_id, island)
  WHERE list_contains(g.r.ids, r.pos * 2147483648 + r.line_no) AND len(g.r.ids) < g.sentences GROUP BY r.conv_id, r.island),
discussed AS (
  SELECT *, {X.tokens('summary')} + 4 AS compressed_tokens FROM (SELECT r.*, concat('discussion:', run) AS group_id, concat('Discussion summary (', n_sources, ' messages): ', body) AS summary FROM runs r JOIN extracts USING (conv_id, island))
  WHERE original_tokens - ({X.tokens('summary')} + 4) >= {V.MIN_SAVED_TOKENS} AND {X.tokens('summary')} + 4 <= original_tokens * {V.MAX_COMPRESSED_RATIO}),
rows6 AS (
  SELECT r.*, coalesce(gid5, d.group_id) AS gid6, coalesce(a5, CASE WHEN d.group_id IS NOT NULL THEN 'COMPRESS' END) AS a6
  FROM rows5 r LEFT JOIN prose p USING (conv_id, pos) LEFT JOIN discussed d ON d.conv_id = p.conv_id AND d.island = p.island),
decisions AS (
  SELECT conv_id, req_turn, n, pos, turn, role, text, tokens, score, content_type, protected, continuity, antecedent, coalesce(dup2, dup5) AS duplicate_of, gid6 AS group_id,
    coalesce(a6, CASE WHEN score >= {V.RETRIEVE_THRESHOLD} OR standing THEN 'RETRIEVE' ELSE 'OMIT' END) AS action FROM rows6),
groups AS (
  SELECT conv_id, group_id, CASE WHEN n_parts = 1 THEN 'duplicate' ELSE 'related_logs' END AS kind, CAST(size AS BIGINT) AS n_sources, first_pos, CAST(original_tokens AS BIGINT) AS original_tokens, compressed_tokens, summary FROM ruled WHERE verdict = 'compress'
  UNION ALL SELECT conv_id, group_id, 'discussion', n_sources, run, CAST(original_tokens AS BIGINT), compressed_tokens, summary FROM discussed)"""

ENTRIES = f"""{DECISIONS},
exact_entries AS (SELECT conv_id, req_turn, pos AS place, 1 AS sub, CAST(turn AS VARCHAR) AS entry_id, role, NULL AS section, text AS content, tokens, protected FROM decisions WHERE action IN ('KEEP', 'RETRIEVE')),
packed_entries AS (SELECT g.conv_id, d.req_turn, g.first_pos AS place, 1 AS sub, g.group_id AS entry_id, d.role, 'compressed' AS section, g.summary AS content, g.compressed_tokens AS tokens, FALSE AS protected FROM groups g JOIN decisions d ON d.conv_id = g.conv_id AND d.pos = g.first_pos),
sent AS (SELECT * FROM exact_entries UNION ALL SELECT * FROM packed_entries),
block_entries AS (
  SELECT b.conv_id, l.req_turn, coalesce(f.first_open, l.n) AS place, 0 AS sub, 'memory' AS entry_id, 'system' AS role, 'memory' AS section, b.content, b.tokens, FALSE AS protected
  FROM (SELECT conv_id, concat('{V.MEMORY_BLOCK_HEADER}', chr(10), string_agg(concat(key, ': ', value), chr(10) ORDER BY created_at)) AS content, any_value(block_tokens) AS tokens FROM injected JOIN (SELECT conv_id, key, created_at FROM memory_items) USING (conv_id, key) GROUP BY conv_id) b
  JOIN latest l USING (conv_id) LEFT JOIN (SELECT conv_id, min(place) AS first_open FROM sent WHERE NOT protected GROUP BY conv_id) f USING (conv_id)),
entries AS (SELECT * FROM sent UNION ALL SELECT * FROM block_entries)"""
