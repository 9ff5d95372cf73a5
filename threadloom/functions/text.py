"""Column expressions over message text. All of them are row-local and JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .regex import java

WHITESPACE = " \t\n\r\x0b\x0c"
FENCE = "```"


def match(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(c, F.lit(java(pattern, flags)))


def has(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part))


def extract(c: Column, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract(c, java(pattern, flags), group)


def extract_all(c: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, flags)), F.lit(group))


def match_count(c: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(c, F.lit(java(pattern, flags)))


def replace(c: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(c, java(pattern, flags), to)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    # a single space stays as it is, so most white space need not be replaced
    return F.trim(F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``, also from nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_round(x: Column, digits: int) -> Column:
    """Round half up at the given digit, also for negative numbers."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


# T1 ------------------------------------------------------------------------
def text_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(V.CHARS_PER_TOKEN)).cast("bigint")


def message_tokens(c: Column) -> Column:
    return text_tokens(c) + F.lit(V.MESSAGE_OVERHEAD)


# T2 ------------------------------------------------------------------------
def clip(c: Column, n: int, trim_end: bool = False) -> Column:
    head = F.substring(c, 1, n)
    if trim_end:
        head = F.regexp_replace(head, r"\s+\z", "")
    return F.when(F.length(c) > n, F.concat(head, F.lit("…"))).otherwise(c)


def preview(c: Column) -> Column:
    return clip(collapse(c), V.PREVIEW_LENGTH)


# T3, T4 --------------------------------------------------------------------
def sentences(c: Column) -> Column:
    bare = F.when(has_fence(c), F.regexp_replace(c, r"(?s)```.*?```", " ")).otherwise(c)
    # a pattern of split() is compiled for every row unless it is a single character; no line break is left inside a sentence
    parts = F.split(F.regexp_replace(bare, r"(?=\s)(?:(?<=[.!?])\s+|\s*\n\s*|\A\s+|\s+\z)", "\n"), "\n")
    return F.filter(parts, lambda s: s != "")


def has_fence(c: Column) -> Column:
    return F.contains(c, F.lit(FENCE))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def before_first(c: Column, pattern: str, flags: str = "") -> Column:
    """The text ahead of the first match, or all of it."""
    return F.regexp_replace(c, f"{java(f'(?:{pattern})', flags)}(?s:.*)", "")


# T5 ------------------------------------------------------------------------
def is_question_or_request(c: Column) -> Column:
    return F.contains(c, F.lit("?")) | match(c, V.REQUEST_START, "i")


# T6 ------------------------------------------------------------------------
def exact_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(extract_all(c, V.EXACT_TOKEN), lambda t: F.regexp_replace(t, r"^`|`\z", "")))


# T7, T8 --------------------------------------------------------------------
def signature(c: Column) -> Column:
    low = F.lower(c)
    timed = replace(replace(low, V.ISO_TIMESTAMP, "#t"), V.CLOCK_TIME, "#t")
    return collapse(F.when(has(low, ":"), timed).otherwise(low))


def template_signature(sig: Column) -> Column:
    """Template of an already computed :func:`signature`."""
    return replace(replace(replace(replace(sig, V.UUID, "#u"), V.HEX, "#h"), V.QUOTED, "#s"), V.NUMBER, "#n")


# T9 ------------------------------------------------------------------------
def primary_event(c: Column) -> Column:
    """Earliest event name in the text, or NULL; ties go to the earlier pattern."""
    hits = [
        F.when(
            match(c, p),
            F.struct(
                F.regexp_instr(c, F.lit(java(p))).alias("at"),
                F.lit(i).alias("rank"),
                extract(c, p, 0).alias("name"),
            ),
        )
        for i, p in enumerate(V.EVENT_PATTERNS)
    ]
    return F.array_min(F.array_compact(F.array(*hits)))["name"]


# T10 -----------------------------------------------------------------------
def needs_exact_wording(c: Column) -> Column:
    """Whether ``V.EXACT_WORDING`` matches: part by part, as each needs a character to begin with, and only up to where it is certain."""
    out = has(c, "`") | has(c, "http:") | has(c, "https:")
    for needed, pattern in V.EXACT_WORDING_PARTS:
        out = out | (has(c, needed) & match(c, pattern))
    return out


# T11, T12 ------------------------------------------------------------------
def _stem(t: Column) -> Column:
    out = None
    for suffix, keep in V.STEM_SUFFIXES:
        hit = F.endswith(t, F.lit(suffix)) & (F.length(t) - len(suffix) >= keep)
        cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


def _alias(t: Column, table: dict[str, str]) -> Column:
    out = None
    for short, full in table.items():
        out = F.when(t == short, full) if out is None else out.when(t == short, full)
    return out.otherwise(t)


def stem_alias(t: Column) -> Column:
    return _alias(_stem(t), V.TERM_ALIASES)


def tokenize(c: Column) -> Column:
    raw = F.filter(
        F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)),
        lambda t: (F.length(t) > 1) & ~t.isin(V.STOPWORDS),
    )
    return F.transform(F.transform(raw, _stem), lambda t: _alias(t, V.TERM_ALIASES))


def terms(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


# T13 -----------------------------------------------------------------------
def important_terms(c: Column) -> Column:
    tagged = F.transform(
        F.regexp_extract_all(c, F.lit(V.WORD_TOKEN), F.lit(0)),
        lambda w, i: F.when(match(w, V.SPECIAL_WORD) | (match(w, V.CAPITALIZED) & (i > 0)), F.regexp_replace(w, "[_.-]+", " ")),
    )
    return terms(F.array_join(F.array_compact(tagged), " "))


# T14 -----------------------------------------------------------------------
def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("`"), F.lit("")), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def canonical_key(c: Column) -> Column:
    return F.array_join(F.transform(F.split(slug(c), "_"), lambda w: _alias(w, V.KEY_ALIASES)), "_")


# T15 -----------------------------------------------------------------------
def request_task(c: Column) -> Column:
    out = None
    for pattern, name in V.TASKS:
        hit = match(c, pattern, "i")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.contains(c, F.lit("?")), "question").otherwise("general request")


def key_terms(c: Column) -> Column:
    """First distinct words whose first term is new, lower-cased."""
    tagged = F.filter(
        F.transform(
            F.regexp_extract_all(c, F.lit(V.WORD_TOKEN), F.lit(0)),
            lambda w: F.struct(F.get(tokenize(w), F.lit(0)).alias("term"), F.lower(w).alias("word")),
        ),
        lambda p: p["term"].isNotNull(),
    )

    def first_seen(pairs):
        return let(pairs.getField("term"), lambda seen: F.filter(pairs, lambda p, i: F.array_position(seen, p["term"]) == i + 1))

    return F.slice(let(tagged, first_seen).getField("word"), 1, V.MAX_KEY_TERMS)


# T16, T19 ------------------------------------------------------------------
def is_follow_up(c: Column) -> Column:
    def test(t):
        n = word_count(t)
        hit = F.lit(False)
        for p in V.FOLLOW_UP_PATTERNS:
            hit = hit | match(t, p)
        return (n > 0) & (n <= V.FOLLOW_UP_MAX_WORDS) & hit

    return let(F.regexp_replace(F.lower(strip(c)), "’", "'"), test)


def mentions_recall(c: Column) -> Column:
    return match(c, V.RECALL_WORDS, "i")


def mentions_earlier(c: Column) -> Column:
    return match(c, V.REFERENTIAL_WORDS, "i")


# T17 -----------------------------------------------------------------------
def _noun_kind(w: Column) -> Column:
    out = None
    for kind, p in V.NOUN_KINDS:
        out = F.when(match(w, p), kind) if out is None else out.when(match(w, p), kind)
    return out


def reference_words(c: Column) -> Column:
    """Word list with per-word flags; the input of :func:`detect_reference`."""
    raw = F.regexp_extract_all(F.regexp_replace(F.lower(c), "’", "'"), F.lit(V.REFERENCE_WORD), F.lit(0))
    return F.transform(
        raw,
        lambda w: F.struct(
            w.alias("w"),
            _noun_kind(w).alias("kind"),
            w.isin(V.DEICTIC).alias("deictic"),
            w.isin(V.PHRASE_BREAK).alias("stop"),
            w.isin(V.BACK_WORDS).alias("back"),
            w.isin(V.AFTER_WORDS).alias("after"),
        ),
    )


def _phrase(ws: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(ws.getField("w"), start + 1, length), " ")


def _reference(kind: Column, noun: Column, phrase: Column) -> Column:
    return F.struct(kind.alias("kind"), noun.alias("noun"), phrase.alias("phrase"))


def detect_reference(ws: Column) -> Column:
    """Referring expression of a request as STRUCT<kind, noun, phrase>, or NULL.

    ``ws`` is a column made by :func:`reference_words`. Each position is tested
    on its own; the first position that fires wins, demonstratives first.
    """

    def noun(i):
        return F.get(ws, i)["kind"].isNotNull()

    def stop(i):
        return F.coalesce(F.get(ws, i)["stop"], F.lit(True))

    def head(i):
        one, two, three = i + 1, i + 2, i + 3
        # the last noun of the unbroken run that starts at most two modifiers in
        from_three = F.when(noun(three), three)
        after_two = F.when(noun(two), F.coalesce(from_three, two)).when(~stop(two), from_three)
        after_one = F.when(noun(one) & noun(two), F.coalesce(from_three, two)).when(noun(one), one).when(~stop(one), after_two)
        return after_one

    def demonstrative(w, i):
        h = head(i)
        return F.when(w["deictic"] & h.isNotNull(), F.struct(i.alias("from"), h.alias("to")))

    def flagged(i, field):
        return F.coalesce(F.when(i >= 0, F.get(ws, i)[field]), F.lit(False))

    def back_or_after(w, i):
        begin = F.when(flagged(i - 1, "back"), i - 1).when(flagged(i - 2, "back") & ~flagged(i - 1, "stop"), i - 2)
        after = flagged(i + 1, "after")
        return F.when(
            w["kind"].isNotNull() & (begin.isNotNull() | after),
            F.struct(i.alias("at"), F.coalesce(begin, i).alias("from"), (i + F.when(after, 1).otherwise(0)).alias("to")),
        )

    def named(at, first, last):
        return _reference(F.get(ws, at)["kind"], F.get(ws, at)["w"], _phrase(ws, first, last - first + 1))

    def first_hit(fn):
        return F.get(F.array_compact(F.transform(ws, fn)), F.lit(0))

    pointing = let(first_hit(demonstrative), lambda h: F.when(h.isNotNull(), named(h["to"], h["from"], h["to"])))
    relative = let(first_hit(back_or_after), lambda h: F.when(h.isNotNull(), named(h["at"], h["from"], h["to"])))
    phrased = let(
        F.array_join(ws.getField("w"), " "),
        lambda t: F.when(match(t, V.WHY_FAILING), _reference(F.lit("error"), extract(t, V.WHY_FAILING, 1), extract(t, V.WHY_FAILING, 0))).when(
            match(t, V.WHAT_HAPPENED), _reference(F.lit("any"), F.lit("this"), extract(t, V.WHAT_HAPPENED, 0))
        ),
    )
    return F.coalesce(pointing, relative, phrased)


# T18 -----------------------------------------------------------------------
def error_evidence(c: Column) -> Column:
    return (
        match(c, V.LEVEL_PREFIX, "im")
        # no frame without one of these characters, no pair without a "="
        | ((has(c, "(") | has(c, '"') | has(c, ":")) & match(c, V.STACK_FRAME))
        | (has(c, "=") & match(c, V.ERROR_WORD, "i") & (match_count(c, V.KEY_VALUE) >= 2))
    )


def filled_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda line: F.ltrim(line, F.lit(WHITESPACE)) != "")


def pasted_output(c: Column) -> Column:
    return (has(c, "\n") & (F.size(filled_lines(c)) >= 3)) | (has(c, "=") & (match_count(c, V.KEY_VALUE) >= 3))


# T20 -----------------------------------------------------------------------
def cache_key(kind: Column, source_lines: Column) -> Column:
    """Content address of a representation; ``source_lines`` is ``id:sha256(text)`` joined by line breaks."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\n"), source_lines), 256), 1, 32)


def source_line(msg_id: Column, text: Column) -> Column:
    return F.concat(msg_id, F.lit(":"), F.sha2(text, 256))


# T21 -----------------------------------------------------------------------
def covered_terms(want: Column, have: Column) -> Column:
    """How many terms of ``want`` match some term of ``have`` (row-local term match)."""
    return F.size(matched_terms(want, have))


def matched_terms(want: Column, have: Column) -> Column:
    return F.filter(want, lambda t: F.exists(have, lambda h: term_match(t, h)))


def term_match(a: Column, b: Column) -> Column:
    n = V.PREFIX_MATCH_MIN
    return (a == b) | ((F.length(a) >= n) & F.startswith(b, a)) | ((F.length(b) >= n) & F.startswith(a, b))


def revises(instruction_terms: Column, statement: Column) -> Column:
    return match(statement, V.REVISION_MARKER, "i") & (covered_terms(instruction_terms, tokenize(statement)) >= V.MIN_SHARED_TERMS)


# T22 -----------------------------------------------------------------------
def tag_escape(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i){V.SECTION_TAGS}", "<​$1$2")
