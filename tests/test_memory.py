import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import memory as M

SCHEMA = "conv_id bigint, turn bigint, idx int, key string, value string, type string, confidence double, op string"
CATEGORY = {"framework", "database", "cache", "cloud", "language"}


def fold(statements):
    """The ordered fold, one statement at a time."""
    items, changes = {}, {}
    for _, turn, idx, key, value, kind, conf, op in sorted(statements, key=lambda s: (s[1], s[2])):
        if key not in items and key.split("_")[-1] in CATEGORY:
            alive = [k for k, i in items.items() if i["active"] and k.split("_")[-1] == key.split("_")[-1]]
            if len(alive) == 1:
                key = alive[0]
        item = items.get(key)
        if op == "remove":
            if item and item["active"]:
                item["active"] = False
                item["sources"].add(turn)
                changes[turn, key] = "removed"
            continue
        if not item:
            items[key] = {"value": value, "type": kind, "conf": conf, "active": True, "sources": {turn}, "previous": []}
            changes[turn, key] = "created"
            continue
        item["sources"].add(turn)
        if not item["active"]:
            item.update(value=value, type=kind, conf=conf, active=True)
            changes[turn, key] = "created"
        elif item["value"].lower() == value.lower():
            item["conf"] = min(0.99, max(item["conf"], conf) + 0.05)
            changes.setdefault((turn, key), "unchanged")
        else:
            item["previous"].append(item["value"])
            item.update(value=value, type=kind, conf=conf)
            changes[turn, key] = "updated"
    return items, changes


def _statements(seed, keys, n=60, convs=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(n if conv == 0 else 15):
            for idx in range(rng.choice([1, 1, 2])):
                op = "remove" if rng.random() < 0.2 else "set"
                rows.append((conv, turn, idx, rng.choice(keys), rng.choice(["A", "a", "B", "C"]), rng.choice(["fact", "decision"]), rng.choice([0.7, 0.75, 0.9]), op))
    rng.shuffle(rows)
    return rows


def _check(spark, rows):
    events = M.memory_events(spark.createDataFrame(rows, SCHEMA))
    got = {(r["conv_id"], r["key"]): r for r in M.memory_items(events).collect()}
    sources = M.memory_sources(events).groupBy("conv_id", "key").agg(F.sort_array(F.collect_list("turn")).alias("s")).collect()
    sources = {(r["conv_id"], r["key"]): r["s"] for r in sources}
    history = {}
    for r in sorted(M.memory_history(events).collect(), key=lambda r: (r["turn"], r["idx"])):
        history.setdefault((r["conv_id"], r["key"]), []).append(r["previous_value"])
    changed = {(r["conv_id"], r["turn"], r["key"]): r["change"] for r in M.memory_changes(events).collect()}
    want_keys, want_changes = set(), {}
    for conv in {r[0] for r in rows}:
        items, changes = fold([r for r in rows if r[0] == conv])
        want_changes.update({(conv, t, k): c for (t, k), c in changes.items()})
        for key, i in items.items():
            r = got[conv, key]
            want_keys.add((conv, key))
            assert (r["value"], r["type"], r["active"]) == (i["value"], i["type"], i["active"])
            assert abs(r["confidence"] - i["conf"]) < 1e-9
            assert sources[conv, key] == sorted(i["sources"]) and r["n_sources"] == len(i["sources"])
            assert history.get((conv, key), []) == i["previous"] and r["n_previous"] == len(i["previous"])
    assert set(got) == want_keys
    assert changed == want_changes


def test_merge_equals_the_fold(spark, short_spans):
    _check(spark, _statements(1, ["deadline", "owner"]))


def test_category_keys_join_the_single_active_item(spark, short_spans):
    _check(spark, _statements(2, ["database", "metadata_database", "audit_database", "cache", "owner"]))


def test_long_repeats_reach_the_maximum(spark, short_spans):
    rows = [(1, t, 0, "owner", "Ann", "fact", 0.7, "set") for t in range(50)]
    item = M.memory_items(M.memory_events(spark.createDataFrame(rows, SCHEMA))).first()
    assert item["confidence"] == 0.99 and item["n_sources"] == 50


def test_block_text_is_whole_above_the_request_limit(spark, monkeypatch):
    rows = [(1, 1, 0, "owner", "Ann", "fact", 0.7, "set"), (2, 1, 0, "owner", "B" * 400, "fact", 0.7, "set")]
    items = M.memory_items(M.memory_events(spark.createDataFrame(rows, SCHEMA)))
    monkeypatch.setattr(M.V, "MAX_REQUEST_TOKENS", 50)
    block = {r["conv_id"]: r for r in M.memory_block(items).collect()}
    assert block[1]["block"] == "STRUCTURED MEMORY\nowner: Ann" and block[1]["block_tokens"] == 11
    assert block[2]["block"] == "STRUCTURED MEMORY\nowner: " + "B" * 400 and block[2]["block_tokens"] == 111


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_a_hot_slot_are_resolved_by_spans(spark, short_spans, seed):
    """Removals of the only active item through a key that does not exist yet, across many spans."""
    rng = random.Random(seed)
    keys = [f"{x}database" for x in ("", "a_", "b_", "c_", "d_", "e_")][: 2 + seed * 2]
    rows = [(1, t, 0, rng.choice(keys[:2] if t < 20 else keys), rng.choice("AB"), "fact", 0.7, "remove" if rng.random() < 0.55 else "set") for t in range(60)]
    rows += [(2, t, 0, keys[0], "A", "fact", 0.7, "set") for t in range(12)] + [(2, 13, 0, keys[1], "B", "fact", 0.7, "remove"), (2, 14, 0, keys[1], "B", "fact", 0.7, "set")]
    _check(spark, rows)


def test_no_python_runs_in_the_merge(spark):
    rows = [(1, t, 0, ["database", "a_database"][t % 2], "A", "fact", 0.7, "set") for t in range(6)]
    plan = M.memory_events(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_versions_are_the_memory_before_every_request(spark, short_spans):
    rows = _statements(7, ["deadline", "owner", "database", "audit_database"], n=40, convs=3) + [(9, t, 0, "owner", "Ann", "fact", 0.7, "set") for t in range(30)]
    requests = [(conv, t) for conv in (0, 1, 2, 9, 11) for t in range(0, 45, 2 if conv else 3)] + [(0, 3), (2, 4)]
    versions = M.memory_versions(M.memory_events(spark.createDataFrame(rows, SCHEMA))).cache()
    asked = spark.createDataFrame(requests, "conv_id bigint, req_turn bigint")
    seen = [r.asDict() for r in M.memory_for_requests(versions, asked).collect()]
    sizes = {(r["conv_id"], r["req_turn"]): r for r in M.memory_sizes(versions, asked).collect()}
    assert len(sizes) == len(set(requests))
    assert len(seen) <= versions.count()
    for conv, turn in set(requests):
        items, _ = fold([r for r in rows if r[0] == conv and r[1] < turn])
        want = {k: (i["value"], i["type"], round(i["conf"], 9), i["active"], len(i["sources"])) for k, i in items.items()}
        got = {r["key"]: (r["value"], r["type"], round(r["confidence"], 9), r["active"], r["n_sources"]) for r in seen if r["conv_id"] == conv and r["first_request"] <= turn <= r["last_request"]}
        assert got == want
        lines = [f"{k}: {i['value']}" for k, i in items.items() if i["active"]]
        assert (sizes[conv, turn]["active_items"], sizes[conv, turn]["line_tokens"]) == (len(lines), sum(-(-len(x) // 4) + 1 for x in lines))
    for r in seen:
        mine = sorted({t for c, t in requests if c == r["conv_id"]})
        assert r["n_requests"] == sum(r["first_request"] <= t <= r["last_request"] for t in mine)


def test_memory_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    versions = M.memory_versions(M.memory_events(none))
    asked = spark.createDataFrame([(1, 5)], "conv_id bigint, req_turn bigint")
    assert versions.count() == 0 and M.memory_for_requests(versions, asked).count() == 0
    assert [tuple(r) for r in M.memory_sizes(versions, asked).collect()] == [(1, 5, 0, 0)]
