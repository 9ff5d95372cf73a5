"""Take rows in a given order while a budget holds, skipping those that do not fit (G1)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import ordered


def within_budget(rows: DataFrame, keys: list[str], bucket: list[str], order: list, row_id: str, cost: str, budget: str, position: Column) -> DataFrame:
    """Rows picked greedily per key; ``bucket`` is a prefix of ``order`` with bounded buckets;
    ``position`` spreads the rows of a hot key when they meet their remaining budget.

    Costs are positive. Everything before the first row that does not fit is taken:
    a running sum finds that prefix in parallel. Less is left than that one row
    costs, so of any cost c at most left/c further rows can follow, and they are
    the next ones of that cost. Only those candidates, a number bounded by the size
    of one row, are walked one after another.
    """
    summed = ordered.cut_lineage(ordered.running_sums(rows, keys, bucket, order, {"_used": F.col(cost)}))
    fits = F.col("_used") <= F.col(budget)
    taken = summed.where(fits).select(*keys, row_id)
    left = summed.groupBy(*keys).agg((F.first(budget) - F.coalesce(F.max(F.when(fits, F.col("_used"))), F.lit(0))).alias("_left"))
    rest = ordered.attach_present(summed.where(~fits), left, keys, position, "inner").where(F.col(cost) <= F.col("_left"))
    ranked = ordered.positions(rest, [*keys, cost], bucket, order, out="_nth").where(F.col("_nth") < F.floor(F.col("_left") / F.col(cost)))
    ascending = [_plain(o) for o in order]
    lists = ranked.groupBy(*keys, "_left").agg(
        F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ascending)], F.col(row_id).alias("id"), F.col(cost).cast("bigint").alias("cost")))).alias("c")
    )
    start = F.struct(F.col("_left").cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, r):
        take = r["cost"] <= acc["left"]
        return F.struct(
            F.when(take, acc["left"] - r["cost"]).otherwise(acc["left"]).alias("left"),
            F.when(take, F.array_append(acc["ids"], r["id"])).otherwise(acc["ids"]).alias("ids"),
        )

    more = lists.select(*keys, F.explode(F.aggregate("c", start, step, lambda acc: acc["ids"])).alias(row_id))
    return taken.unionByName(more)


def _plain(o) -> Column:
    """Order columns are given ascending (negate a column for descending order)."""
    return F.col(o) if isinstance(o, str) else o
