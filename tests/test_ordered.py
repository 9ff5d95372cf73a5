import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import greedy, ordered


def _skewed(spark, seed=1):
    rng = random.Random(seed)
    rows = [(0, t, rng.randint(1, 9)) for t in rng.sample(range(200), 90)]
    rows += [(k, t, rng.randint(1, 9)) for k in range(1, 6) for t in rng.sample(range(40), 4)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, t bigint, v bigint").withColumn("_span", ordered.span_of(F.col("t")))


def test_positions_and_running_sums_equal_plain_windows(spark, short_spans):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", (F.row_number().over(w) - 1).alias("pos"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()
    pos = ordered.positions(df, ["k"], ["_span"], ["t"])
    got = ordered.running_sums(pos, ["k"], ["_span"], ["t"], {"s": F.col("v")}).select("k", "t", "pos", "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_running_sum_without_own_row(spark, short_spans):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()
    got = ordered.running_sums(df, ["k"], ["_span"], ["t"], {"s": F.col("v")}, include_row=False).select("k", "t", "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_carry_finds_the_last_value_across_buckets(spark, short_spans):
    df = _skewed(spark)
    value = F.when(F.col("v") > 6, F.col("v"))
    for own in (True, False):
        w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        want = df.select("k", "t", F.last(value, ignorenulls=True).over(w).alias("c")).collect()
        got = ordered.carry(df, ["k"], ["_span"], ["t"], value, "c", include_row=own).select("k", "t", "c").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_attach_and_attach_present_equal_plain_joins(spark, short_spans):
    df = _skewed(spark).drop("_span")
    facts = spark.createDataFrame([(0, 7, 199), (2, 8, 39), (9, 9, 10)], "k bigint, f bigint, upto bigint")
    want = sorted(map(tuple, df.join(facts, "k").select("k", "t", "f").collect()))
    assert sorted(map(tuple, ordered.attach(df, facts, ["k"], F.col("t"), F.col("upto")).select("k", "t", "f").collect())) == want
    assert sorted(map(tuple, ordered.attach_present(df, facts, ["k"], F.col("t"), "inner").select("k", "t", "f").collect())) == want
    left = sorted(map(tuple, df.join(facts, "k", "left").select("k", "t", "f").collect()), key=str)
    assert sorted(map(tuple, ordered.attach_present(df, facts, ["k"], F.col("t")).select("k", "t", "f").collect()), key=str) == left


def test_greedy_budget_equals_a_loop(spark, short_spans):
    rng = random.Random(4)
    rows, want = [], set()
    for key in range(30):
        budget = rng.randint(0, 60)
        items = [(rng.choice([-3.0, -1.5, 0.0]), i, rng.randint(1, 25)) for i in range(rng.randint(1, 40))]
        left = budget
        for rank, i, cost in sorted(items):
            if cost <= left:
                left -= cost
                want.add((key, i))
        rows += [(key, rank, i, cost, budget) for rank, i, cost in items]
    df = spark.createDataFrame(rows, "k bigint, rank double, i bigint, cost bigint, budget bigint").withColumn("_span", ordered.span_of(F.col("i")))
    got = greedy.within_budget(df, ["k"], ["rank", "_span"], ["rank", "_span", "i"], "i", "cost", "budget", F.col("i"))
    assert {tuple(r) for r in got.select("k", "i").collect()} == want


def test_intermediate_tables_are_columns_in_the_shared_folder(spark):
    rows = [(i, [("a", float(i))] if i % 3 else None, "the same long text " * 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, v array<struct<n:string,x:double>>, text string")
    kept = ordered.cut_lineage(df)
    files = kept.inputFiles()
    assert files and all(f.endswith(".parquet") and ordered.use_checkpoint_folder(spark).removeprefix("file:") in f for f in files)
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 100_000
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert ordered.cut_lineage(df.where("k < 0")).count() == 0
