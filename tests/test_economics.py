import pytest
from pyspark.sql import functions as F

from threadloom.operators import economics as E
from threadloom.operators import ledger as L


@pytest.mark.parametrize(("full", "compiled", "want"), [(12481, 4106, 67.1), (0, 0, 0.0), (100, 120, -20.0), (1000, 1000, 0.0), (400, 401, -0.2)])
def test_reduction(spark, full, compiled, want):
    got = spark.range(1).select(E.reduction_percent(F.lit(full), F.lit(compiled)).alias("p")).first()["p"]
    assert got == want


def test_prices_by_exact_dated_and_unknown_model(spark):
    df = spark.createDataFrame([("claude-haiku-4-5",), ("claude-haiku-4-5-20251001",), ("nobody",), (None,)], "model string")
    got = {r["model"]: r["c"] for r in E.with_price(df, E.default_prices(spark)).select("model", E.input_cost(F.lit(2_000_000)).alias("c")).collect()}
    assert got == {"claude-haiku-4-5": 2.0, "claude-haiku-4-5-20251001": 2.0, "nobody": None, None: None}


def _calls(spark, n):
    rows = [(i, "evaluation", 1, 1000 + i, 100) for i in range(n)] + [(900, "evaluation", 0, None, None), (901, "compression", 1, 9, 9)]
    return spark.createDataFrame(rows, "id bigint, kind string, ok int, input_tokens bigint, output_tokens bigint")


@pytest.mark.parametrize(("n", "want"), [(2, (2, 1500, 200, "default")), (3, (3, 1001, 100, "history")), (30, (20, 1020, 100, "history"))])
def test_expected_evaluation(spark, n, want):
    r = E.expected_eval_usage(_calls(spark, n), F.col("id")).first()
    assert (r["samples"], r["input_tokens"], r["output_tokens"], r["source"]) == want


@pytest.mark.parametrize(
    ("gross", "avoided", "cost", "failed", "want"),
    [(1.0, 10, 0.1, "check", "safety_full_context"), (0.0, 0, 0.1, None, "equivalent_context"), (None, 10, 0.1, None, "optimized"), (0.25, 10, 0.25, None, "bypass_full_context"), (0.375, 10, 0.25, None, "optimized")],
)
def test_decisions(spark, gross, avoided, cost, failed, want):
    lit = lambda v, t: F.lit(v).cast(t)
    d = E.decide(lit(gross, "double"), lit(avoided, "bigint"), lit(cost, "double"), 1.5, lit(failed, "string"))
    assert spark.range(1).select(d.alias("d")).first()["d"] == want


def test_break_even(spark):
    assert spark.range(1).select(E.break_even_tokens(F.lit(0.0025), 1.5, F.lit(2.0)).alias("n")).first()["n"] == 1875


def test_context_added_compares_neighbouring_attempts(spark):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "c")]
    got = L.context_added(spark.createDataFrame(rows, "run_id bigint, idx bigint, entry_id string")).collect()
    assert sorted((r["idx"], r["entry_id"]) for r in got) == [(1, "b"), (2, "c")]


def test_oversize_prefers_the_count(spark):
    df = spark.createDataFrame([(1, 99_999, 200_000), (2, None, 100_001), (3, 100_000, None)], "id int, counted bigint, estimate bigint")
    assert [r["id"] for r in E.oversize_requests(df, "counted", "estimate").collect()] == [2]


def test_usage_as_of_equals_a_plain_window(spark, monkeypatch):
    import random

    from threadloom.operators import ordered

    monkeypatch.setattr(ordered, "block_of", lambda c: F.floor(c / 7).cast("bigint"))
    rng = random.Random(3)
    rows = [(i, rng.choice(["evaluation", "evaluation", "view"]), rng.choice([0, 1, 1, 1]), rng.choice([None, 100, 107, 250]), rng.randrange(50)) for i in sorted(rng.sample(range(400), 150))]
    got = {r["call_id"]: r for r in E.expected_eval_usage_as_of(spark.createDataFrame(rows, "call_id bigint, kind string, ok int, input_tokens bigint, output_tokens bigint"), "call_id").collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        seen = [(a, b) for j, kind, ok, a, b in rows if j < i and kind == "evaluation" and ok and a is not None][-20:]
        r = got[i]
        if len(seen) < 3:
            assert (r["samples"], r["input_tokens"], r["output_tokens"], r["source"]) == (len(seen), 1500, 200, "default")
        else:
            assert (r["samples"], r["input_tokens"], r["output_tokens"], r["source"]) == (len(seen), -(-sum(a for a, _ in seen) // len(seen)), -(-sum(b for _, b in seen) // len(seen)), "history")
