import json
import random

from pyspark.sql import functions as F

from threadloom.operators import explain as P
from threadloom.operators import mentions as M
from threadloom.sources import store as D


def test_upsert_keeps_the_first_creation_and_the_last_value(spark):
    old = spark.createDataFrame([(1, "a", "x", 1, 1), (1, "b", "y", 1, 1)], "conv_id int, key string, value string, created_at int, updated_at int")
    new = spark.createDataFrame([(1, "a", "z", 5, 5), (2, "a", "n", 5, 5)], "conv_id int, key string, value string, created_at int, updated_at int")
    got = {(r["conv_id"], r["key"]): (r["value"], r["created_at"]) for r in D.upsert_memory(old, new).collect()}
    assert got == {(1, "a"): ("z", 1), (1, "b"): ("y", 1), (2, "a"): ("n", 5)}


def test_import_skips_known_ids_and_titles(spark):
    conv = "conversation_id int, title string"
    target = {"conversation": spark.createDataFrame([(1, "One"), (9, "Two")], conv)}
    source = {
        "conversation": spark.createDataFrame([(1, "Other"), (2, "Two"), (3, "Three")], conv),
        "message": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "conversation_id int, text string"),
    }
    add = D.import_conversations(target, source)
    assert [r["conversation_id"] for r in add["conversation"].collect()] == [3]
    assert sorted(r["text"] for r in add["message"].collect()) == ["c", "d"]


def test_fixture_file(spark, tmp_path):
    (tmp_path / "chat.json").write_text(json.dumps([{"id": "a", "role": "user", "content": "Hi"}, {"id": "b", "role": "assistant", "content": "Hello\nthere"}]))
    rows = D.read_fixture(spark, str(tmp_path / "chat.json")).orderBy("pos").collect()
    assert [(r["pos"], r["role"], r["text"]) for r in rows] == [(0, "user", "Hi"), (1, "assistant", "Hello\nthere")]


def test_ledger_batch_can_be_written_twice(spark, tmp_path):
    runs = spark.createDataFrame(
        [(1, [("optimized", 1)], [("evaluation",)], [(7, "KEEP")])],
        "run_id bigint, attempts array<struct<level:string,passed:int>>, calls array<struct<kind:string>>, decisions array<struct<message_id:bigint,action:string>>",
    )
    for _ in range(2):
        D.write_run_ledger(D.ledger_tables(runs), str(tmp_path), "7")
    assert {t: D.read_run_ledger(spark, str(tmp_path), t).count() for t in D.ledger_tables(runs)} == dict.fromkeys(D.ledger_tables(runs), 1)
    # a crash before the commit: a first batch stays unseen, a batch that is written again stays as it was
    for batch in ("7", "8"):
        for name, rows in D.ledger_tables(runs.union(runs)).items():
            rows.write.parquet(f"{tmp_path}/{name}/batch={batch}/version=broken")
    assert {t: D.read_run_ledger(spark, str(tmp_path), t).count() for t in D.ledger_tables(runs)} == dict.fromkeys(D.ledger_tables(runs), 1)
    D.write_run_ledger(D.ledger_tables(runs.union(runs)), str(tmp_path), "7")
    assert {t: D.read_run_ledger(spark, str(tmp_path), t).count() for t in D.ledger_tables(runs)} == dict.fromkeys(D.ledger_tables(runs), 2)


def _files(folder):
    return {p.parent.name: {q.name for q in p.parent.glob("part-*")} for p in folder.glob("data/*/*/part-*")}


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    schema, folder = "conv_id int, key string, value string, created_at int, updated_at int", str(tmp_path)
    assert D.read_stored(spark, folder) is None
    D.upsert_stored(spark.createDataFrame([(i, "a", "x", 1, 1) for i in range(100)], schema), folder, ["conv_id", "key"], "updated_at", ["created_at"], buckets=8)
    before = _files(tmp_path)
    assert len(before) == 8
    D.upsert_stored(spark.createDataFrame([(3, "a", "z", 5, 5), (200, "b", "n", 5, 5)], schema), folder, ["conv_id", "key"], "updated_at", ["created_at"])
    current = {p.rsplit("/", 2)[-2]: {p.rsplit("/", 1)[-1]} for p in D.read_stored(spark, folder).inputFiles()}
    changed = {b for b in current if current[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(current) == 8
    rows = {(r["conv_id"], r["key"]): (r["value"], r["created_at"]) for r in D.read_stored(spark, folder).collect()}
    assert len(rows) == 101 and rows[3, "a"] == ("z", 1) and rows[200, "b"] == ("n", 5) and rows[4, "a"] == ("x", 1)
    D.upsert_stored(spark.createDataFrame([], schema), folder, ["conv_id", "key"], "updated_at")
    # data without a manifest, as a broken write leaves it, is not part of the table
    spark.createDataFrame([(3, "a", "bad", 9, 9)], schema).write.parquet(f"{folder}/data/version=broken/_bucket=0")
    assert D.read_stored(spark, folder).count() == 101


def test_summary_is_read_back(spark, tmp_path):
    metrics = spark.createDataFrame([(i, i * 10, None if i % 3 else "x") for i in range(25)], "place bigint, tokens bigint, note string").repartition(4)
    totals = metrics.selectExpr("sum(tokens) AS tokens", "count(*) AS runs")
    D.export_summary(metrics, totals, str(tmp_path), part_rows=10)
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/summary").collect()]
    assert sorted((x["kind"], x["part"], len(x.get("points", []))) for x in lines) == [("series", 0, 10), ("series", 1, 10), ("series", 2, 5), ("totals", 0, 0)]
    got, series = D.read_summary(spark, str(tmp_path), "tokens bigint, runs bigint", "place bigint, tokens bigint, note string")
    assert tuple(got.first()) == (3000, 25)
    assert [tuple(r) for r in series.orderBy("place").collect()] == [(i, i * 10, None if i % 3 else "x") for i in range(25)]


def test_mentions_equal_a_plain_search(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "b", "Été", "mysql", "MySQL 8", "x y", "\U0001f600", ".*", ""]
    texts = [(rng.choice([1, 2, None]), " ".join(rng.choice(words) + rng.choice(["", "d", "!"]) for _ in range(rng.randrange(8)))) for _ in range(30)] + [(1, None), (3, "only")]
    values = [(k, n, v) for k in (1, 2, 4) for n, v in enumerate([*words, "nowhere", "abcd", "d a", None])] * 2
    df = spark.createDataFrame([(k, n, v, "t") for k, n, v in values], "conv_id int, key int, value string, text string")
    got = M.mentioned(df, spark.createDataFrame([(k, t, 1) for k, t in texts], "conv_id int, text string, key int"), ["conv_id"])
    assert got.columns == df.columns
    want = [(k, n, v, "t") for k, n, v in values if v is not None and any(t is not None and i == k and v.lower() in t.lower() for i, t in texts)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_values_that_are_words_are_not_compared_with_texts(spark, monkeypatch):
    compared, inside = [], M._inside
    monkeypatch.setattr(M, "_inside", lambda sought, texts, keys: compared.extend(r["_value"] for r in sought.collect()) or inside(sought, texts, keys))
    values = spark.createDataFrame([(1, f"stem{i}") for i in range(30)] + [(1, "m29 st"), (1, "tem3"), (1, "gone")], "part int, value string")
    texts = spark.createDataFrame([(1, f"Stem{i} stem{i + 1}") for i in range(29)], "part int, text string")
    got = sorted(r["value"] for r in M.mentioned(values, texts, ["part"]).collect())
    assert got == sorted([*(f"stem{i}" for i in range(30)), "tem3"])
    assert sorted(compared) == ["gone", "m29 st", "tem3"]


def test_upsert_breaks_ties_the_same_way_in_any_order(spark):
    schema = "conv_id int, turn int, value string, updated_at int"
    a, b = spark.createDataFrame([(1, 1, "a", 5)], schema), spark.createDataFrame([(1, 1, "b", 5)], schema)
    assert [D.upsert_annotations(x, y).first()["value"] for x, y in ((a, b), (b, a))] == ["b", "b"]


def test_unpriced_exports_stay_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now', None), (2, "plain", 0.5)], "run_id int, prompt string, net double")
    D.export_metrics(df, str(tmp_path))
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/csv").where(~F.col("value").startswith("run_id")).collect())
    assert lines == ['1,"say ""hi"", now",', "2,plain,0.5"]


def test_rebuilt_decisions_prefer_protection(spark):
    doc = {"classification": {"items": [{"id": "a", "contentType": "fact"}]}, "protection": {"items": [{"id": "a", "reason": "rule"}]}, "omission": {"items": [{"id": "a", "reason": "x", "tokens": 3}]}}
    r = P.rebuild_decisions(spark.createDataFrame([(1, json.dumps(doc))], "run_id int, trace_json string")).first()
    assert (r["action"], r["reason"]) == ("KEEP", "rule")
