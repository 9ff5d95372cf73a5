"""Scoring as SQL: ``messages`` plus ``notes`` in, ``scores`` out (one latest request per conversation)."""

from threadloom.functions import fixed_values as V
from threadloom.plans import text_sql as X
from threadloom.plans import views_sql as Q


def _stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= {keep} THEN {t}[1:length({t}) - {len(s)}]" for s, keep in V.STEM_SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in V.STOPWORDS)
    raw = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({stop}))"
    return f"list_distinct(list_transform(list_transform({raw}, lambda t: {_stem('t')}), lambda t: {X.alias('t', V.TERM_ALIASES)}))"


def match(a: str, b: str) -> str:
    return f"({a} = {b} OR (length({a}) >= 5 AND starts_with({b}, {a})) OR (length({b}) >= 5 AND starts_with({a}, {b})))"


_IMPORTANT = (
    f"list_filter(list_transform(regexp_extract_all(request, '{V.WORD_TOKEN}'), lambda w, i: CASE WHEN {X.hit('w', V.SPECIAL_WORD)} OR ({X.hit('w', V.CAPITALIZED)} AND i > 1) "
    "THEN regexp_replace(w, '[_.-]+', ' ', 'g') END), lambda w: w IS NOT NULL)"
)
_GENERIC = " OR ".join(match(f"'{g}'", _t) for g in V.GENERIC_TERMS for _t in ("term", f"({X.alias('(' + _stem('term') + ')', V.TERM_ALIASES)})"))
_TYPE = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {f}" for k, f in V.TYPE_FACTOR.items()) + " END"

BASE = f"""{Q.LATEST},
history AS (
  SELECT m.conv_id, l.req_turn, l.n, m.pos, m.turn, m.role, m.text, n.content_type, n.level, n.level IS NOT NULL AS protected, {X.tokens('m.text')} + 4 AS tokens
  FROM messages m JOIN latest l USING (conv_id) JOIN notes n USING (role, text) WHERE m.pos < l.n),
asked AS (SELECT conv_id, req_turn, n, request, {terms('request')} AS request_terms, {terms("array_to_string(" + _IMPORTANT + ", ' ')")} AS important FROM latest),
own AS (SELECT conv_id, unnest(request_terms) AS term FROM asked),
text_terms AS (SELECT text, unnest({terms('text')}) AS d FROM (SELECT DISTINCT text FROM history)),
docs AS (SELECT h.conv_id, h.pos, h.level, t.d FROM history h JOIN text_terms t USING (text)),
own_pairs AS (SELECT DISTINCT d.conv_id, d.pos, o.term, d.level FROM docs d JOIN own o ON o.conv_id = d.conv_id AND {match('o.term', 'd.d')}),
lent AS (
  SELECT DISTINCT d.conv_id, d.d AS term FROM docs d
  WHERE d.level = 'critical' AND EXISTS (SELECT 1 FROM own_pairs p WHERE p.conv_id = d.conv_id AND p.pos = d.pos)
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.conv_id = d.conv_id AND {match('o.term', 'd.d')})),
query_terms AS (SELECT conv_id, term, FALSE AS expansion FROM own UNION ALL SELECT conv_id, term, TRUE FROM lent),
pairs AS (
  SELECT conv_id, pos, term FROM own_pairs
  UNION ALL SELECT DISTINCT d.conv_id, d.pos, l.term FROM docs d JOIN lent l ON l.conv_id = d.conv_id AND {match('l.term', 'd.d')}),
frequencies AS (SELECT conv_id, term, count(*) AS df FROM pairs GROUP BY conv_id, term),
weights AS (
  SELECT q.conv_id, q.term, q.expansion, coalesce(f.df, 0) AS df,
    ln(1 + (a.n + 1) / CAST(coalesce(f.df, 0) + 1 AS DOUBLE)) ** 2 * CASE WHEN q.expansion THEN {V.EXPANSION_WEIGHT} ELSE 1.0 END
      * CASE WHEN list_contains(a.important, q.term) THEN {V.IMPORTANT_TERM_WEIGHT} ELSE 1.0 END * CASE WHEN ({_GENERIC}) THEN {V.GENERIC_WEIGHT} ELSE 1.0 END AS weight
  FROM query_terms q JOIN asked a USING (conv_id) LEFT JOIN frequencies f USING (conv_id, term)),
totals AS (SELECT conv_id, coalesce(nullif(sum(weight) FILTER (NOT expansion), 0), 1) AS total FROM weights GROUP BY conv_id),
doc_overlap AS (SELECT conv_id, pos, least(1.0, sum(weight) / any_value(total)) AS overlap FROM pairs JOIN weights USING (conv_id, term) JOIN totals USING (conv_id) GROUP BY conv_id, pos)"""

MEMORY_SCORES = f"""item_terms AS (SELECT conv_id, key, unnest({terms("concat(replace(key, '_', ' '), ' ', value)")}) AS d FROM memory_items WHERE active),
item_pairs AS (SELECT DISTINCT i.conv_id, i.key, q.term FROM item_terms i JOIN query_terms q ON q.conv_id = i.conv_id AND {match('q.term', 'i.d')}),
item_overlaps AS (SELECT conv_id, key, least(1.0, sum(weight) / any_value(total)) AS overlap FROM item_pairs JOIN weights USING (conv_id, term) JOIN totals USING (conv_id) GROUP BY conv_id, key),
item_hits AS (
  SELECT conv_id, key, count(*) AS size, count(*) FILTER (EXISTS (SELECT 1 FROM own o WHERE o.conv_id = i.conv_id AND {match('o.term', 'i.d')})) AS hits FROM item_terms i GROUP BY conv_id, key),
memory_scores AS (
  SELECT conv_id, key, value, type, CASE WHEN hits / CAST(size AS DOUBLE) >= 0.5 AND (hits >= 2 OR size = 1) THEN hits / CAST(size AS DOUBLE) ELSE 0.0 END AS coverage,
    greatest(coalesce(overlap, 0.0), CASE WHEN hits / CAST(size AS DOUBLE) >= 0.5 AND (hits >= 2 OR size = 1) THEN hits / CAST(size AS DOUBLE) ELSE 0.0 END) AS memory_score
  FROM memory_items JOIN item_hits USING (conv_id, key) LEFT JOIN item_overlaps USING (conv_id, key) WHERE active),
memory_of_messages AS (
  SELECT s.conv_id, s.turn, max(memory_score) AS mem FROM (SELECT DISTINCT conv_id, key, turn FROM memory_events WHERE change <> 'ignored') s JOIN memory_scores USING (conv_id, key) GROUP BY s.conv_id, s.turn)"""

NO_MEMORY = "memory_of_messages AS (SELECT conv_id, turn, 0.0 AS mem FROM history WHERE FALSE)"

SCORES = f"""raw AS (SELECT h.*, coalesce(o.overlap, 0.0) AS overlap FROM history h LEFT JOIN doc_overlap o USING (conv_id, pos)),
paired AS (
  SELECT r.*, b.turn AS partner, CASE WHEN NOT r.protected AND NOT b.protected AND b.role <> r.role AND b.overlap >= {V.PAIR_MIN_SCORE} AND b.overlap * {V.PAIR_DECAY} > r.overlap THEN b.overlap * {V.PAIR_DECAY} END AS lent
  FROM raw r LEFT JOIN raw b ON b.conv_id = r.conv_id AND b.pos = CASE WHEN r.role = 'user' THEN r.pos + 1 ELSE r.pos - 1 END),
signalled AS (
  SELECT p.*, coalesce(lent, overlap) AS lexical, CASE WHEN lent IS NOT NULL THEN partner END AS paired_with, {_TYPE} AS type_factor,
    CASE WHEN m.mem >= {V.MEMORY_MATCH} THEN least(1.0, m.mem) ELSE 0.0 END AS memory,
    CASE WHEN protected THEN 1.0 WHEN m.mem IS NOT NULL THEN 0.6 WHEN content_type IN ('decision', 'constraint', 'preference') THEN 0.5 ELSE 0.2 END AS importance,
    0.5 ** ((n - 1 - pos) / CAST({V.RECENCY_HALF_LIFE} AS DOUBLE)) AS recency
  FROM paired p LEFT JOIN memory_of_messages m USING (conv_id, turn)),
scores AS (
  SELECT *, floor(least(1.0, least(1.0, lexical * type_factor) + 0.15 * memory
    + CASE WHEN lexical * type_factor > 0 OR memory > 0 THEN 0.06 * importance + 0.06 * recency ELSE 0.0 END) * 100 + 0.5) / 100 AS score
  FROM signalled)"""
