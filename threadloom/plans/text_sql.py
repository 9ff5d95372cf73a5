"""SQL expressions for message rules, written for RE2 (no look-around)."""

from threadloom.functions import fixed_values as V
from threadloom.functions.regex import re2, sql_quote

WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def hit(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {sql_quote(re2(pattern, flags))})"


def group(x: str, pattern: str, n: int, flags: str = "") -> str:
    return f"regexp_extract({x}, {sql_quote(re2(pattern, flags))}, {n})"


def sub(x: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {sql_quote(re2(pattern, flags))}, {sql_quote(to)}, 'g')"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return trim(sub(x, r"\s+", " "))


def tokens(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS BIGINT)"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def sentences(x: str) -> str:
    bare = f"regexp_replace({x}, '(?s)```.*?```', ' ', 'g')"
    split = f"regexp_split_to_array(regexp_replace({bare}, '([.!?])\\s+', concat('\\1', chr(10)), 'g'), '\\n+')"
    return f"list_filter(list_transform({split}, lambda s: {trim('s')}), lambda s: s <> '')"


def asks(x: str) -> str:
    return f"(contains({x}, '?') OR {hit(x, V.REQUEST_START, 'i')})"


def signature(x: str) -> str:
    return collapse(sub(sub(f"lower({x})", V.ISO_TIMESTAMP, "#t"), V.CLOCK_TIME, "#t"))


def template(sig: str) -> str:
    # RE2 has no back-reference: one pattern per quote character
    quoted = sub(sub(sub(sub(sig, V.UUID, "#u"), V.HEX, "#h"), r"\"[^\"'\n]{1,60}\"", "#s"), r"'[^\"'\n]{1,60}'", "#s")
    return sub(quoted, V.NUMBER, "#n")


E_CODE = r"\bE(?:[A-QS-Z][A-Z]{3,}|R[A-QS-Z][A-Z]{2,}|RR[A-NP-Z][A-Z]+|RRO[A-QS-Z][A-Z]*|RROR[A-Z]+)\b"


def event(x: str) -> str:
    """Earliest event: the shortest text in front of a match, earlier patterns first on ties."""
    ps = [V.EVENT_PATTERNS[0], E_CODE, *V.EVENT_PATTERNS[2:]]
    rows = [f"CASE WHEN {hit(x, p)} THEN {{'at': length({group(x, '(?s)^(.*?)(?:' + p + ')', 1)}), 'rank': {i}, 'name': {group(x, p, 0)}}} END" for i, p in enumerate(ps)]
    return f"list_sort(list_filter([{', '.join(rows)}], lambda h: h IS NOT NULL))[1].name"


def slug(x: str) -> str:
    return sub(sub(f"replace(lower({x}), '`', '')", "[^a-z0-9]+", "_"), "^_+|_+$", "")


def alias(w: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"CASE {w} {cases} ELSE {w} END"


def canonical(x: str) -> str:
    return f"array_to_string(list_transform(string_split({slug(x)}, '_'), lambda w: {alias('w', V.KEY_ALIASES)}), '_')"


def clean(x: str) -> str:
    return sub(collapse(f"replace({x}, '`', '')"), r"[.;:!]+$", "")


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(x, p, 'i')} THEN '{c}'" for p, c in V.CATEGORIES) + " END"


def key_for(value: str, target: str, prefix: str) -> str:
    cat, t = category(value), canonical(target)
    lead = f"array_to_string(string_split({slug(value)}, '_')[1:3], '_')"
    return f"CASE WHEN {t} <> '' THEN CASE WHEN {cat} IS NOT NULL AND NOT ends_with({t}, {cat}) THEN concat({t}, '_', {cat}) ELSE {t} END ELSE coalesce({cat}, concat('{prefix}_', {lead})) END"


def rule_key(x: str) -> str:
    return f"concat('rule_', array_to_string(string_split({slug(x)}, '_')[1:4], '_'))"


def strong(s: str) -> str:
    habitual = (
        hit(s, r"\b(?:we|you)\s+(?:always|never)\s+", "i")
        + " AND NOT "
        + hit(s, r"\b(?:we|you)\s+(?:always|never)\s+(?:know|think|see|understand|remember|had|get|have)\b", "i")
    )
    return (
        f"(NOT contains({s}, '?') AND NOT {hit(s, V.REPORTING, 'i')} AND NOT {hit(s, V.INFERENCE, 'i')} AND "
        f"({hit(s, V.DIRECTIVE_START, 'i')} OR {hit(s, V.MODAL_HARD, 'i')} OR ({habitual})))"
    )


def subject_ok(s: str) -> str:
    return f"({words(s)} <= {V.SUBJECT_MAX_WORDS} AND NOT {hit(trim(s), V.NOT_SUBJECT, 'i')} AND NOT {hit(trim(s), V.EPHEMERAL_SUBJECT, 'i')})"


def value_ok(s: str, n: int) -> str:
    return f"({words(s)} <= {n} AND NOT {hit(trim(s), V.EPHEMERAL_VALUE, 'i')})"


def _branches(s: str):
    g = lambda p, n: group(s, p, n, "i")
    named = lambda p, prefix, kind, conf, op="set": (p, "TRUE", key_for(g(p, 1), g(p, 2), prefix), clean(g(p, 1)), f"'{kind}'", conf, op)
    skip = ", ".join(f"'{w}'" for w in V.P_PREFER_SKIP)
    prefer = clean(g(V.P_PREFER, 1))
    lead = f"array_to_string(list_filter(regexp_split_to_array({prefer}, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({skip}))[1:2], ' ')"
    return [
        (V.P_ASSIGN, "TRUE", canonical(g(V.P_ASSIGN, 1)), clean(g(V.P_ASSIGN, 2)), "'state'", 0.9, "set"),
        named(V.P_REMOVED, "uses", "fact", 0.85, "remove"),
        named(V.P_DECIDED, "decision", "decision", 0.9),
        named(V.P_GOING_WITH, "decision", "decision", 0.85),
        named(V.P_SWITCHED, "decision", "decision", 0.9),
        named(V.P_WE_USE, "uses", "fact", 0.85),
        (V.P_BUILDING, value_ok(g(V.P_BUILDING, 1), 12), "'project'", clean(g(V.P_BUILDING, 1)), "'fact'", 0.75, "set"),
        (V.P_ROLE, "NOT " + hit(g(V.P_ROLE, 1), V.P_ROLE_EXCLUDED, "i"), "'user_role'", clean(g(V.P_ROLE, 1)), "'fact'", 0.75, "set"),
        (V.P_LIVE_IN, "TRUE", "'user_location'", clean(g(V.P_LIVE_IN, 1)), "'fact'", 0.8, "set"),
        (V.P_WORK_AT, "TRUE", "'user_workplace'", clean(g(V.P_WORK_AT, 1)), "'fact'", 0.8, "set"),
        (V.P_WORK_ON, "TRUE", "'user_project'", clean(g(V.P_WORK_ON, 1)), "'fact'", 0.75, "set"),
        (V.P_PREFER, "TRUE", f"concat('preference_', {slug(lead)})", prefer, "'preference'", 0.8, "set"),
        (V.P_DIRECTIVE, "TRUE", rule_key(g(V.P_DIRECTIVE, 1)), clean(g(V.P_DIRECTIVE, 1)), "'constraint'", 0.85, "set"),
        (V.P_MUST, subject_ok(g(V.P_MUST, 1)), f"concat({canonical(g(V.P_MUST, 1))}, '_requirement')", clean(f"concat(lower({g(V.P_MUST, 2)}), ' ', {g(V.P_MUST, 3)})"), "'constraint'", 0.75, "set"),
        (V.P_USES, f"{subject_ok(g(V.P_USES, 1))} AND {value_ok(g(V.P_USES, 2), 10)}", canonical(g(V.P_USES, 1)), clean(g(V.P_USES, 2)), "'fact'", 0.75, "set"),
        (V.P_IS, f"{subject_ok(g(V.P_IS, 1))} AND {value_ok(g(V.P_IS, 2), 8)}", canonical(g(V.P_IS, 1)), clean(g(V.P_IS, 2)), f"CASE WHEN {hit(g(V.P_IS, 1), V.P_IS_OWN, 'i')} THEN 'fact' ELSE 'state' END", 0.75, "set"),
    ]


def annotated(source: str) -> str:
    """CTEs ``notes`` (annotation per distinct role and text) and ``said`` (its statements) over ``source``."""
    cases = []
    for p, guard, key, value, kind, conf, op in _branches("b"):
        if kind != "'constraint'":
            value = trim(f"regexp_split_to_array({value}, {sql_quote(re2(V.REASON_CLAUSE, 'i'))})[1]")
        cases.append(f"WHEN {hit('b', p, 'i')} AND ({guard}) AND {key} <> '' AND {value} <> '' THEN {{'key': {key}, 'value': {value}, 'type': {kind}, 'confidence': CAST({conf} AS DOUBLE), 'op': '{op}'}}")
    lines = "list_filter(string_split(t, chr(10)), lambda l: " + trim("l") + " <> '')"
    count = lambda p: f"len(list_filter(lines, lambda l: {hit('l', p)}))"
    some = lambda p: f"len(list_filter(declared, lambda s: {hit('s', p, 'i')})) > 0"
    return f"""texts AS (SELECT DISTINCT role, text FROM {source}),
cut AS (SELECT role, text, {trim('text')} AS t, {sentences(trim('text'))} AS ss FROM texts),
pieces AS (SELECT role, text, unnest(ss) AS raw, generate_subscripts(ss, 1) AS i FROM cut),
bare AS (SELECT role, text, i, {sub(f"{trim(sub('raw', V.LEAD_IN, '', 'i'))}", '[.!]+$', '')} AS b FROM pieces WHERE {trim(sub('raw', V.LEAD_IN, '', 'i'))} <> ''),
hits AS (SELECT role, text, i, CASE WHEN {asks('b')} AND NOT {hit('b', V.NEGATED_START, 'i')} THEN NULL ELSE CASE {' '.join(cases)} END END AS h FROM bare),
strongs AS (SELECT role, text, min_by(raw, i) AS strong FROM pieces WHERE {strong('raw')} GROUP BY role, text),
found AS (SELECT role, text, count(*) AS n, count(h) AS captured, count(*) FILTER (h.type = 'constraint') AS constraints FROM hits GROUP BY role, text),
said AS (
  SELECT role, text, CAST(row_number() OVER (PARTITION BY role, text ORDER BY i) - 1 AS INTEGER) AS idx, h.key AS key, h.value AS value, h.type AS type, h.confidence AS confidence, h.op AS op FROM hits WHERE h IS NOT NULL
  UNION ALL
  SELECT s.role, s.text, CAST(coalesce(f.captured, 0) AS INTEGER), {rule_key('strong')}, {clean('strong')}, 'constraint', CAST(0.7 AS DOUBLE), 'set'
  FROM strongs s LEFT JOIN found f USING (role, text) WHERE coalesce(f.constraints, 0) = 0),
said_types AS (SELECT role, text, list(DISTINCT type) AS types FROM said GROUP BY role, text),
guarded AS (
  SELECT c.*, {lines} AS lines, list_filter(ss, lambda s: NOT {asks('s')}) AS declared, s.strong, coalesce(st.types, []) AS types,
    coalesce(f.n, 0) AS n, coalesce(f.captured, 0) AS captured,
    CASE WHEN c.role = 'system' AND {hit('c.text', V.HARD_RULE, 'i')} THEN 'critical' WHEN c.role = 'system' THEN 'high'
      WHEN c.role = 'developer' AND {hit('c.text', V.HARD_RULE, 'i')} THEN 'critical'
      WHEN c.role = 'user' AND contains(c.text, '```') AND {hit('c.text', V.EXACT_DEMAND, 'i')} THEN 'high'
      WHEN c.role = 'user' AND s.strong IS NOT NULL THEN 'high' END AS level,
    CASE WHEN c.role = 'system' AND {hit('c.text', V.HARD_RULE, 'i')} THEN '{V.REASON_SYSTEM_HARD}' WHEN c.role = 'system' THEN '{V.REASON_SYSTEM}'
      WHEN c.role = 'developer' AND {hit('c.text', V.HARD_RULE, 'i')} THEN '{V.REASON_DEVELOPER}'
      WHEN c.role = 'user' AND contains(c.text, '```') AND {hit('c.text', V.EXACT_DEMAND, 'i')} THEN '{V.REASON_EXACT}'
      WHEN c.role = 'user' AND s.strong IS NOT NULL THEN concat('user_rule:', CASE WHEN length(s.strong) > {V.REASON_SNIPPET} THEN concat(s.strong[1:{V.REASON_SNIPPET}], '…') ELSE s.strong END) END AS reason
  FROM cut c LEFT JOIN strongs s USING (role, text) LEFT JOIN found f USING (role, text) LEFT JOIN said_types st USING (role, text)),
typed AS (
  SELECT *, CASE
    WHEN role IN ('system', 'developer') THEN CASE WHEN level = 'critical' OR {hit('t', V.SYSTEM_RULE_START, 'i')} THEN 'constraint' ELSE 'fact' END
    WHEN {count(V.LOG_LINE)} >= 2 OR {count(V.STACK_LINE)} >= 2 OR (len(lines) = 1 AND {hit('t', V.LOG_LINE)} AND {hit('t', V.SINGLE_LOG_LINE)}) THEN 'log'
    WHEN {hit('t', V.TOOL_OUTPUT, 'im')} THEN 'tool_output'
    WHEN contains(t, '```') OR (len(lines) >= 3 AND {count(V.CODE_LINE)} / CAST(len(lines) AS DOUBLE) > 0.6) THEN 'code'
    WHEN role = 'assistant' THEN CASE WHEN {words('t')} < 4 THEN 'other' ELSE 'discussion' END
    WHEN level IS NOT NULL THEN 'constraint'
    WHEN {some(V.DECISION_CUE)} THEN 'decision' WHEN {some(V.PREFERENCE_CUE)} THEN 'preference'
    WHEN len(types) > 0 THEN CASE WHEN list_contains(types, 'preference') THEN 'preference' WHEN list_contains(types, 'decision') THEN 'decision' ELSE 'fact' END
    WHEN {some(V.FACT_CUE)} THEN 'fact'
    WHEN {words('t')} < 4 THEN 'other' ELSE 'discussion' END AS content_type
  FROM guarded),
notes AS (
  SELECT role, text, content_type, level, reason, types,
    role = 'user' AND content_type = 'discussion' AND {words('t')} >= 4
      AND len(list_filter(declared, lambda s: {words('s')} >= 6 AND ({hit('s', V.DURABLE_CUE, 'i')} OR {hit('s', V.WEAK_CONSTRAINT, 'i')}))) > 0 AS ambiguous,
    role = 'user' AND level IS NULL AND len(types) > 0 AND NOT contains(text, '```') AND n = captured AS memory_complete
  FROM typed)"""


STATEMENTS = f"""statements AS (
  SELECT m.conv_id, m.turn, s.idx, {canonical('s.key')} AS key, s.value, s.type, s.confidence, s.op
  FROM messages m JOIN said s USING (role, text) WHERE m.role <> 'assistant')"""

# The merge without redirected keys: valid where no category holds two different keys.
MEMORY = """chained AS (
  SELECT *, lag(op) OVER w AS prev_op, lag(lower(value)) OVER w AS prev_low FROM statements WINDOW w AS (PARTITION BY conv_id, key ORDER BY turn, idx)),
changed AS (
  SELECT *, CASE WHEN op = 'remove' THEN CASE WHEN prev_op = 'set' THEN 'removed' ELSE 'ignored' END
    WHEN coalesce(prev_op, '') <> 'set' THEN 'created' WHEN prev_low = lower(value) THEN 'unchanged' ELSE 'updated' END AS change FROM chained),
starts AS (
  SELECT *, count(*) FILTER (change IN ('created', 'updated')) OVER (PARTITION BY conv_id, key ORDER BY turn, idx) AS run FROM changed),
run_values AS (SELECT conv_id, key, run, value AS run_value, type AS run_type, confidence AS run_confidence FROM starts WHERE change IN ('created', 'updated')),
memory_events AS (
  SELECT s.*, v.run_value AS item_value, CASE WHEN change = 'updated' THEN p.run_value END AS previous_value
  FROM starts s LEFT JOIN run_values v USING (conv_id, key, run) LEFT JOIN run_values p ON p.conv_id = s.conv_id AND p.key = s.key AND p.run = s.run - 1),
last_runs AS (SELECT conv_id, key, max(run) AS run FROM starts GROUP BY conv_id, key HAVING max(run) > 0),
repeats AS (SELECT conv_id, key, run, list(confidence ORDER BY turn, idx) AS cs FROM starts WHERE change = 'unchanged' GROUP BY conv_id, key, run),
memory_items AS (
  SELECT l.conv_id, l.key, v.run_value AS value, v.run_type AS type,
    list_reduce(list_prepend(v.run_confidence, coalesce(r.cs, [])), lambda a, b: least(0.99, greatest(a, b) + 0.05)) AS confidence,
    e.active, e.created_at, e.n_sources, e.first_source, e.last_source, e.n_previous
  FROM last_runs l JOIN run_values v USING (conv_id, key, run) LEFT JOIN repeats r USING (conv_id, key, run) JOIN (
    SELECT conv_id, key, max_by(op, turn * 1000 + idx) = 'set' AS active, min(turn * 1000 + idx) FILTER (change = 'created') AS created_at,
      count(DISTINCT turn) FILTER (change <> 'ignored') AS n_sources, min(turn) FILTER (change <> 'ignored') AS first_source,
      max(turn) FILTER (change <> 'ignored') AS last_source, count(*) FILTER (change = 'updated') AS n_previous
    FROM starts GROUP BY conv_id, key) e USING (conv_id, key))"""
