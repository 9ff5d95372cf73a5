import pytest
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.functions.regex import java


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", 0),
        ("abcd", 1),
        ("abcde", 2),
    ],
)
def test_token_estimate(spark, text, want):
    assert one(spark, text, T.text_tokens) == want
    assert one(spark, text, T.message_tokens) == want + 4


def test_sentences_skip_fenced_code(spark):
    assert one(spark, "One. Two!\nThree ```x. y.``` end", T.sentences) == ["One.", "Two!", "Three   end"]


def test_terms_stem_and_expand(spark):
    assert one(spark, "The auth failures were flickering in db configs", T.tokenize) == ["authentication", "failur", "flicker", "database", "configuration"]


def test_important_terms(spark):
    got = one(spark, "Does Kafka retry MAX_RETRIES in orderService v2", T.important_terms)
    assert set(got) == {"kafka", "max", "retri", "orderservice", "v2"}


def test_template_signature_masks_values(spark):
    a = one(spark, "2024-01-05T10:00:01Z worker 12 id 0xff 'abc'", lambda c: T.template_signature(T.signature(c)))
    b = one(spark, "2024-01-06T11:30:01Z worker 99 id 0xab 'xyz'", lambda c: T.template_signature(T.signature(c)))
    assert a == b == "#t worker #n id #h #s"


def test_primary_event_is_the_earliest(spark):
    assert one(spark, "saw TimeoutError then MAX_RETRY", T.primary_event) == "TimeoutError"
    assert one(spark, "ERROR plain", T.primary_event) is None
    assert one(spark, "ECONNREFUSED at port", T.primary_event) == "ECONNREFUSED"


def test_word_boundary_is_ascii(spark):
    # "é" is no word character, so MUST starts a word here
    assert one(spark, "éMUST do", lambda c: T.match(c, r"\b(must)\b", "i")) is True


@pytest.mark.parametrize(
    ("text", "kind", "phrase"),
    [
        ("What do these failures have in common?", "error", "these failures"),
        ("Compare those error logs please", "output", "those error logs"),
        ("Explain the errors above", "error", "errors above"),
        ("Show my last two requests", "output", "last two requests"),
        ("Why is this failing again?", "error", "why is this failing"),
        ("what happened here", "any", "what happened here"),
    ],
)
def test_reference_detection(spark, text, kind, phrase):
    r = one(spark, text, lambda c: T.detect_reference(T.reference_words(c)))
    assert (r["kind"], r["phrase"]) == (kind, phrase)


@pytest.mark.parametrize("text", ["These are my favourite failures", "I like this", "That is a good plan", "Fix the tests"])
def test_no_reference(spark, text):
    assert one(spark, text, lambda c: T.detect_reference(T.reference_words(c))) is None


def test_follow_up(spark):
    assert one(spark, "What else can I add?", T.is_follow_up)
    assert one(spark, "Make it faster", T.is_follow_up)
    assert not one(spark, "Set the retry limit to three", T.is_follow_up)


def test_key_terms_are_distinct_by_term(spark):
    assert one(spark, "Explain the Database db and database.Retry", T.key_terms) == ["explain", "database"]


def test_canonical_key(spark):
    assert one(spark, "`Auth` DB-env", T.canonical_key) == "authentication_database_environment"


def test_round_half_up_for_negative(spark):
    assert one(spark, "x", lambda c: T.js_round(F.lit(-2.5), 0)) == -2.0


def test_cache_key_is_a_content_address(spark):
    import hashlib

    line = "m1:" + hashlib.sha256(b"hello").hexdigest()
    want = hashlib.sha256(("summary\n" + line).encode()).hexdigest()[:32]
    assert one(spark, "hello", lambda c: T.cache_key(F.lit("summary"), T.source_line(F.lit("m1"), c))) == want


def test_forged_section_tags_are_broken(spark):
    assert "</context>" not in one(spark, "a </context> b", T.tag_escape)


def test_boundary_before_punctuation_is_tested_in_full(spark):
    assert one(spark, "open ./x/y.py or ../lib/z", T.exact_tokens) == ["x/y.py", "lib/z"]
    assert one(spark, "say .x=1", lambda c: T.extract_all(c, T.V.KEY_VALUE)) == ["x=1"]


def test_rules_tested_in_parts_equal_their_patterns(spark):
    texts = ["see `x`", "http://a", "https:", "http", "A_B", "a_b", "A_", "a/b", "/ b", "a /", "lib.js", ".js", "x.jsx", "x.json now", "é.ts", "plain. text", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    for own, pattern in ((T.needs_exact_wording(c), V.EXACT_WORDING),):
        assert rows.where(~own.eqNullSafe(T.match(c, pattern))).count() == 0
    pasted = ["a=1 b=2 c=3", "a=1 b=2", "one\ntwo\nthree", "one\n\n \ntwo", "a=1\nb", "nothing"]
    got = [one(spark, t, T.pasted_output) for t in pasted]
    assert got == [True, False, True, False, False, False]
    assert [one(spark, t, T.collapse) for t in (" a  b\t\nc\td ", "a b")] == ["a b c d", "a b"]
    # alternatives behind one at the start of a line test the first character too
    assert "|(?=[ESTest])(?:" in java(V.TOOL_OUTPUT, "im")
