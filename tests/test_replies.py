import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions.reply_text import first_object
from threadloom.operators import replies as R

FENCE = "```"


def plain_object(text):
    """The scan one character at a time."""
    import re

    src = re.sub("(?i)```(?:json)?", "", text)
    for start in (i for i, c in enumerate(src) if c == "{"):
        depth, inside, i = 0, False, start
        while i < len(src):
            c = src[i]
            if inside:
                if c == "\\":
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"':
                inside = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(src[start : i + 1], parse_constant=lambda x: 1 / 0)
                        return src[start : i + 1]
                    except (ValueError, ZeroDivisionError):
                        break
            i += 1
    return None


TEXTS = [
    '{"a":1}', 'Sure: {"a":{"b":"}"}} and {"c":2}', FENCE + 'json\n{"a":"\\"}{"}\n' + FENCE, "no object", "", "{broken} {\"ok\":true}", '{"open": {"in": 1}', '{"a":1,}{"b":2}', "{'a':1}",
    'x } { "s": "line\\nbreak \\\\" } y', '{"a":"unterminated} {"b":1}', '{} rest', '{"é":"😀 \\😀"} {"z":"😀{"}', FENCE.upper() + "JSON {\"k\":[{\"v\":1},{\"v\":2}]}", '{"a":NaN}{"b":3}', '\\{"a":1}', '{"a":1 \\} {"b":2}}',
]


def test_the_first_valid_object_is_found(spark):
    rng = random.Random(2)
    pieces = ['{', '}', '"', '\\"', '{"a":1}', '"x":', ',', ' ', 'word', '{"b":"}"}', '\\', '[1]', '{"c":{"d":[]}}']
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").select("i", first_object(F.col("raw")).alias("doc")).collect()
    want = {i: plain_object(t) for i, t in enumerate(texts)}
    assert {r["i"]: r["doc"] for r in got} == want
    assert spark.sql("SELECT cast(NULL AS string) AS raw").select(first_object(F.col("raw"))).first()[0] is None


def test_a_long_reply(spark):
    doc = json.dumps({"results": [{"id": str(i), "type": 'quo"te {' * 20} for i in range(2000)]})
    row = spark.createDataFrame([("Here: " + doc + " }",)], "raw string").select(first_object(F.col("raw")).alias("d")).first()
    assert row["d"] == doc


def test_classifications(spark):
    raw = {"results": [
        {"id": "4", "type": "constraint", "protected": True, "protection_reason": " must hold ", "memory": [{"key": "Data Base", "value": " My  SQL ", "type": "odd", "op": "drop"}, 5, {"key": "", "value": "x"}, {"key": "old", "value": "v", "type": "state", "op": "remove"}, {"key": "long", "value": "x" * 241}], "complete": True},
        {"id": 6, "type": "nonsense", "protected": "yes", "memory": "none", "complete": True}, {"id": "99", "type": "fact"}, "junk", {"id": "8", "type": "fact"}, {"id": "8", "type": "decision"}]}
    replies = spark.createDataFrame([(1, 0, "ok " + json.dumps(raw)), (1, 1, "sorry"), (1, 2, None), (2, 0, '{"results": 7}')], "conv_id bigint, batch bigint, raw string")
    asked = spark.createDataFrame([(1, 0, 4), (1, 0, 6), (1, 0, 8), (1, 1, 20), (2, 0, 1)], "conv_id bigint, batch bigint, turn bigint")
    got = {r["turn"]: r for r in R.classifications(replies, asked).collect()}
    assert set(got) == {4, 6, 8}
    assert (got[4]["content_type"], got[4]["protected"], got[4]["protection_reason"], got[4]["complete"]) == ("constraint", True, "must hold", True)
    assert [tuple(s) for s in got[4]["statements"]] == [("data_base", "My SQL", "fact", 0.7, "set"), ("old", "v", "state", 0.7, "remove")]
    assert (got[6]["content_type"], got[6]["protected"], got[6]["statements"], got[6]["complete"]) == ("discussion", False, [], False)
    assert got[8]["content_type"] == "decision"
    assert sorted((r["conv_id"], r["batch"]) for r in R.unusable(replies).collect()) == [(1, 1), (1, 2)]


def test_summaries(spark):
    long = "The relay holds 300 jobs. " + "It was restarted after the incident and nobody lost a message. " * 4
    asked = spark.createDataFrame([(1, 9, t, long) for t in (1, 2, 3, 4, 5)] + [(2, 9, 1, long)], "conv_id bigint, req_turn bigint, turn bigint, text string")
    doc = {"summaries": [{"id": "1", "summary": "The relay holds 300 jobs."}, {"id": "2", "summary": "It holds 999 jobs."}, {"id": 3, "summary": long}, {"id": "4", "summary": "  "}, {"id": "2", "summary": "Restarted relay."}, {"id": "7", "summary": "x"}]}
    replies = spark.createDataFrame([(1, 9, json.dumps(doc)), (2, 9, "no")], "conv_id bigint, req_turn bigint, raw string")
    got = {(r["conv_id"], r["turn"]): (r["summary"], r["reason"]) for r in R.summary_results(replies, asked).collect()}
    assert got == {(1, 1): ("The relay holds 300 jobs.", None), (1, 2): ("Restarted relay.", None), (1, 3): ("", "not_shorter"), (1, 4): ("", "missing"), (1, 5): ("", "missing")}


@pytest.mark.parametrize("back, want", [(False, {7: 0.6, 3: 0.6, 5: 0.6, 1: 0.6}), (True, {7: 0.6, 3: 0.6})])
def test_selected_messages(spark, back, want):
    replies = spark.createDataFrame([(1, 9, '{"ids":["7",3,"7","88","5","1","2"]}'), (2, 9, '{"ids":"7"}')], "conv_id bigint, req_turn bigint, raw string")
    pool = spark.createDataFrame([(c, 9, t) for c in (1, 2) for t in (1, 2, 3, 5, 7)], "conv_id bigint, req_turn bigint, turn bigint")
    requests = spark.createDataFrame([(1, 9, back, None), (2, 9, False, None)], "conv_id bigint, req_turn bigint, follow_up boolean, reference string")
    assert {r["turn"]: r["score"] for r in R.selected_messages(replies, pool, requests).collect()} == want


def test_no_replies(spark):
    none = spark.createDataFrame([], "conv_id bigint, batch bigint, raw string")
    assert R.classifications(none, spark.createDataFrame([(1, 0, 4)], "conv_id bigint, batch bigint, turn bigint")).count() == 0
