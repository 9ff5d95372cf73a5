"""SQL statements that check queries of this subpackage, for DuckDB."""

from threadloom.llm import licenses, templates

_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
_ALNUM = r"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(lower=_LOWER)
_SPACED = r"regexp_extract_all({lower}, '[^\x20\x09-\x0D]+')".format(lower=_LOWER)


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = " UNION ALL ".join(f"SELECT {t.number} AS number, '{t.label}' AS label, {_list(t.words)} AS phrase, {t.needed} AS needed, {t.base} AS base" for t in licenses.templates())

LICENSES = f"""
WITH t AS ({_TEMPLATES}),
d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
tw AS (SELECT number, label, len(phrase) AS size, len(list_distinct(phrase)) AS m, needed, unnest(list_distinct(phrase)) AS word FROM t),
near AS (SELECT doc_id, number, label, m, needed, word, unnest([i // size, i // size - 1]) AS block FROM w JOIN tw USING (word)),
met AS (SELECT doc_id, number, label, count(DISTINCT word) / m AS share FROM near WHERE block >= 0 GROUP BY doc_id, number, label, m, needed, block HAVING count(DISTINCT word) >= needed),
place AS (SELECT w.doc_id, t.label, i FROM w JOIN t ON t.base AND w.word = t.phrase[1] JOIN d ON d.doc_id = w.doc_id WHERE d.ws[i + 1 : i + len(phrase)] = phrase),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM met GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(found.labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""

NGRAMS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(a, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)"""

NGRAM_LINKS = f"""
WITH base AS ({NGRAMS}),
d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*)))
SELECT base.*, (SELECT count(*) FROM links WHERE a = base.doc_id) AS n_links FROM base"""

_PART = f"ceil((n - {templates.LEAD}) / {templates.PARTS}.0)::INT"

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, string_split(regexp_replace(trim(regexp_replace(line, '[\s\p{{Z}}]+', ' ', 'g')), '{templates.FIELD}', '<*>', 'g'), ' ') AS t FROM l),
n AS (SELECT doc_id, i, t, len(t) AS n FROM t WHERE len(t) >= {templates.MIN_TOKENS}),
k AS (SELECT doc_id, i, n, -1 AS part, array_to_string(t, chr(10)) AS key FROM n
  UNION ALL SELECT doc_id, i, n, p, concat(array_to_string(t[1 : {templates.LEAD} + p * {_PART}], chr(10)), chr(11), array_to_string(t[{templates.LEAD} + (p + 1) * {_PART} + 1 : n], chr(10))) FROM n, range({templates.PARTS}) r(p) WHERE n >= {templates.MIN_GENERAL}),
f AS (SELECT n, part, key, min(doc_id) AS first FROM k GROUP BY n, part, key),
dropped AS (SELECT DISTINCT doc_id, i FROM k JOIN f USING (n, part, key) WHERE first < doc_id),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '') AS text FROM l LEFT JOIN dropped x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, n_dropped FROM r WHERE n_dropped = 0 OR regexp_matches(text, '[^\s\p{{Z}}]')
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL"""

BENCHMARK = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
occ AS (SELECT doc_id, item, i, size FROM grams JOIN win USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_RULES = "('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')"

URLS = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{licenses.UPPER}', '{licenses.LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
r(rule, h, prefix, v) AS (VALUES {_RULES}),
m AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (n)"""

COLLOCATIONS = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, doc, unnest(list_transform(pieces, lambda x: regexp_extract_all(x, '[^\\x20\\x09]+'))) AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM p, range(1, 6) AS s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, size, a, unnest(range(1, size)) AS k, ws FROM c),
s AS (SELECT cuts.lang, cuts.phrase, size, a, cuts.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN n USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : cuts.k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[cuts.k + 1 : size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

CHECKS = {"op11_collocations": COLLOCATIONS, "op13_url_filter": URLS, "op2_license_scan": LICENSES, "op3_ngram_join": NGRAMS, "op3_ngram_links": NGRAM_LINKS, "op5_line_dedup": LINES, "op10_decontamination": BENCHMARK}
