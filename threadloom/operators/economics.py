"""Prices, sizes, savings and the optimise-or-bypass decision as column rules."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.operators import ordered

MILLION = 1_000_000
PRICE_COLUMNS = "model, input, output, cache_write, cache_write_1h, cache_read"


def default_prices(spark: SparkSession) -> DataFrame:
    """The price rows as an inline table: Spark knows its size, so it joins without shuffling the other side."""
    rows = ", ".join(f"('{model}', {', '.join(f'{float(x)}D' for x in prices)})" for model, *prices in V.PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS prices({PRICE_COLUMNS})")


def with_price(df: DataFrame, prices: DataFrame, model: str = "model", out: str = "price") -> DataFrame:
    """Adds the price row of ``model`` as a struct: exact id, else the id without its -YYYYMMDD suffix, else NULL (J8)."""
    row = F.struct("input", "output", "cache_write", "cache_read")
    exact = prices.select(F.col("model").alias("_id"), row.alias("_exact"))
    dated = prices.select(F.col("model").alias("_alias"), row.alias("_dated"))
    return (
        df.withColumns({"_id": F.col(model), "_alias": F.regexp_replace(model, r"-\d{8}\z", "")})
        .join(exact, "_id", "left")
        .join(dated, "_alias", "left")
        .withColumn(out, F.coalesce("_exact", "_dated"))
        .drop("_id", "_alias", "_exact", "_dated")
    )


# E1 --------------------------------------------------------------------------
def reduction_percent(full: Column, compiled: Column) -> Column:
    return F.when(full > 0, F.floor((full - compiled) / full * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


# E2 --------------------------------------------------------------------------
def input_cost(tokens: Column, price: str = "price") -> Column:
    return tokens * F.col(f"{price}.input") / MILLION


def usage_cost(price: str = "price", inputs=None, outputs=None, cache_write=None, cache_read=None) -> Column:
    total = F.lit(0.0)
    for tokens, part in ((inputs, "input"), (outputs, "output"), (cache_write, "cache_write"), (cache_read, "cache_read")):
        if tokens is not None:
            total = total + F.coalesce(tokens, F.lit(0)) * F.col(f"{price}.{part}") / MILLION
    return total


# E3 --------------------------------------------------------------------------
def run_economics(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Size, reduction and input cost of each run; cost columns are NULL for unpriced models."""
    full, compiled = F.col("original_tokens"), F.col("compiled_tokens")
    return with_price(runs, prices).select(
        *runs.columns,
        (full - compiled).alias("tokens_avoided"),
        reduction_percent(full, compiled).alias("reduction_percent"),
        input_cost(full).alias("full_input_cost_usd"),
        input_cost(compiled).alias("compiled_input_cost_usd"),
        (input_cost(full) - input_cost(compiled)).alias("gross_input_savings_usd"),
    )


# A22 -------------------------------------------------------------------------
def expected_eval_usage(calls: DataFrame, order: Column) -> DataFrame:
    """One row: rounded-up mean usage of the newest 20 successful evaluations, or the default when fewer than 3."""
    recent = (
        calls.where((F.col("kind") == "evaluation") & (F.col("ok") == 1) & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull())
        .orderBy(order.desc())
        .limit(V.EVAL_WINDOW)
    )
    enough = F.col("samples") >= V.MIN_EVAL_SAMPLES
    mean = lambda c: F.ceil(F.sum(c) / F.count("*")).cast("bigint")
    return recent.agg(F.count("*").alias("samples"), mean("input_tokens").alias("i"), mean("output_tokens").alias("o")).select(
        "samples",
        F.when(enough, F.col("i")).otherwise(F.lit(V.DEFAULT_EVAL_INPUT).cast("bigint")).alias("input_tokens"),
        F.when(enough, F.col("o")).otherwise(F.lit(V.DEFAULT_EVAL_OUTPUT).cast("bigint")).alias("output_tokens"),
        F.when(enough, "history").otherwise("default").alias("source"),
    )


def expected_eval_usage_as_of(calls: DataFrame, order: str) -> DataFrame:
    """For every call what :func:`expected_eval_usage` said just before it; ``order`` is a whole-number column that calls are unique in.

    Successful evaluations are numbered along the order, block by block. The newest 20 up to one of them are
    the difference of two running sums, twenty numbers apart; every call takes the sums of the last one before it.
    """
    usable = (F.col("kind") == "evaluation") & (F.col("ok") == 1) & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    along, block = ["_all"], ["_block"]
    rows = calls.withColumns({"_all": F.lit(0), "_block": ordered.block_of(F.col(order))})
    done = ordered.positions(rows.where(usable).select(*along, *block, order, "input_tokens", "output_tokens"), along, block, [order], "_nth")
    done = ordered.cut_lineage(ordered.running_sums(done, along, block, [order], {"_i": F.col("input_tokens"), "_o": F.col("output_tokens")}))
    before = done.select((F.col("_nth") + V.EVAL_WINDOW).alias("_nth"), F.col("_i").alias("_i0"), F.col("_o").alias("_o0"))
    zero = F.lit(0)
    recent = F.struct(
        F.least(F.col("_nth") + 1, F.lit(V.EVAL_WINDOW)).cast("bigint").alias("n"), (F.col("_i") - F.coalesce("_i0", zero)).alias("i"), (F.col("_o") - F.coalesce("_o0", zero)).alias("o")
    )
    done = done.join(before, "_nth", "left").select(order, recent.alias("_recent"))
    rows = ordered.carry(rows.select(*along, *block, order).join(done, order, "left"), along, block, [order], F.col("_recent"), "_seen", include_row=False)
    n = F.coalesce("_seen.n", F.lit(0).cast("bigint"))
    enough = n >= V.MIN_EVAL_SAMPLES
    mean = lambda c: F.ceil(F.col(f"_seen.{c}") / n).cast("bigint")
    return rows.select(
        order,
        n.alias("samples"),
        F.when(enough, mean("i")).otherwise(F.lit(V.DEFAULT_EVAL_INPUT).cast("bigint")).alias("input_tokens"),
        F.when(enough, mean("o")).otherwise(F.lit(V.DEFAULT_EVAL_OUTPUT).cast("bigint")).alias("output_tokens"),
        F.when(enough, "history").otherwise("default").alias("source"),
    )


# E4 --------------------------------------------------------------------------
def expected_eval_cost(expected: DataFrame, utility_model: str, prices: DataFrame) -> DataFrame:
    """One row: expected cost of one validation call; NULL when the utility model is unpriced."""
    alias = re.sub(r"-\d{8}$", "", utility_model)
    known = prices.where(F.col("model").isin(utility_model, alias))
    price = known.agg(F.max_by(F.struct("input", "output"), F.col("model") == utility_model).alias("p")).scalar()
    return expected.withColumn("_p", price).select(
        "samples",
        "source",
        "input_tokens",
        "output_tokens",
        ((F.col("input_tokens") * F.col("_p.input") + F.col("output_tokens") * F.col("_p.output")) / MILLION).alias("eval_cost_usd"),
    )


# E5, E6 ----------------------------------------------------------------------
def decide(gross: Column, avoided: Column, eval_cost: Column, margin: float, failed_check: Column | None = None, forced: Column | None = None) -> Column:
    structural = F.lit(False) if failed_check is None else failed_check.isNotNull()
    keep = F.lit(False) if forced is None else forced.isNotNull()
    return (
        F.when(structural, "safety_full_context")
        .when(keep, "optimized")
        .when(avoided <= 0, "equivalent_context")
        .when(gross.isNull() | eval_cost.isNull(), "optimized")
        .when(gross < eval_cost * margin, "bypass_full_context")
        .otherwise("optimized")
    )


def break_even_tokens(eval_cost: Column, margin: float, input_price: Column) -> Column:
    return F.ceil(eval_cost * margin * MILLION / input_price).cast("bigint")


def economic_decisions(runs: DataFrame, calls: DataFrame, prices: DataFrame, utility_model: str, call_order: Column, margin: float = V.ECONOMICS_MARGIN) -> DataFrame:
    """Decision per run against the expected validation cost, which is one row read as a scalar."""
    cost = expected_eval_cost(expected_eval_usage(calls, call_order), utility_model, prices).select("eval_cost_usd").scalar()
    priced = with_price(run_economics(runs, prices), prices).withColumn("eval_cost_usd", cost)
    gross = F.col("gross_input_savings_usd")
    return priced.select(
        "run_id",
        "original_tokens",
        "compiled_tokens",
        "tokens_avoided",
        gross,
        "eval_cost_usd",
        (F.col("eval_cost_usd") * margin).alias("threshold_usd"),
        break_even_tokens(F.col("eval_cost_usd"), margin, F.col("price.input")).alias("break_even_tokens"),
        decide(gross, F.col("tokens_avoided"), F.col("eval_cost_usd"), margin).alias("decision"),
    )


# E7 --------------------------------------------------------------------------
def oversize_requests(sizes: DataFrame, counted: str, estimated: str, limit: int = V.MAX_REQUEST_TOKENS) -> DataFrame:
    """Requests a model call would be refused for: provider count, else the estimate, above the limit."""
    return sizes.withColumn("request_tokens", F.coalesce(counted, estimated)).where(F.col("request_tokens") > limit)


# E8 --------------------------------------------------------------------------
def price_retries(retries: DataFrame, prices: DataFrame, eval_cost: Column) -> DataFrame:
    """Cost, projected net and guard of each proposed retry.

    ``retries``: model, full_tokens, retry_tokens, output_tokens, optimizer_so_far, spent_so_far, optional.
    """
    priced = with_price(retries, prices).withColumn("eval_cost_usd", eval_cost)
    known = F.col("retry_tokens").isNotNull() & F.col("full_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    generation = F.when(known, usage_cost(inputs=F.col("retry_tokens"), outputs=F.col("output_tokens")))
    gross = input_cost(F.col("full_tokens")) - input_cost(F.col("retry_tokens"))
    net = gross - (F.col("optimizer_so_far") + F.col("eval_cost_usd")) - F.col("spent_so_far")
    known_cost = generation.isNotNull() & F.col("eval_cost_usd").isNotNull()
    out = priced.withColumns(
        {
            "expected_retry_cost_usd": F.when(known_cost, generation + F.col("eval_cost_usd")),
            "projected_net_usd": F.when(known_cost, net),
        }
    ).withColumn("blocked", F.coalesce(F.col("optional") & (F.col("projected_net_usd") < 0), F.lit(False)))
    guard = (
        F.when(~F.col("optional"), "not_applicable")
        .when(F.col("projected_net_usd").isNull(), "unknown")
        .when(F.col("blocked"), "blocked")
        .otherwise("allowed")
    )
    return out.withColumn("economic_guard", guard).drop("price")


# E9 --------------------------------------------------------------------------
def run_costs(runs: DataFrame, attempts: DataFrame, calls: DataFrame, prices: DataFrame, at: str = "at") -> DataFrame:
    """Net savings of each run: gross minus internal calls minus every attempt but the last.

    The three inputs are reduced to one row per run before they meet.
    """
    paid_calls = (
        with_price(calls, prices)
        .withColumn("_cost", usage_cost(inputs=F.col("input_tokens"), outputs=F.col("output_tokens")))
        .groupBy("run_id")
        .agg(
            F.sum(F.when(F.col("input_tokens").isNotNull(), F.col("_cost"))).alias("_optimizer"),
            F.count_if(F.col("input_tokens").isNotNull() & F.col("_cost").isNull()).alias("_calls_unpriced"),
        )
    )
    # a run has one model, so its attempts are summed as tokens and priced once per run
    billed = F.col("output_tokens").isNotNull()
    parts = F.struct(F.when(billed, F.col("context_tokens")).otherwise(0).alias("i"), F.coalesce("output_tokens", F.lit(0)).alias("o"), billed.cast("int").alias("b"))
    sums = attempts.withColumn("_a", parts).groupBy("run_id").agg(
        F.sum("_a.i").alias("_i"), F.sum("_a.o").alias("_o"), F.sum("_a.b").alias("_b"), F.max_by("_a", at).alias("_last"), F.count("*").alias("attempts")
    )
    priced = with_price(runs.select("run_id", "model").join(sums, "run_id"), prices)
    total = F.col("_i") * F.col("price.input") / MILLION + F.col("_o") * F.col("price.output") / MILLION
    last = F.col("_last.i") * F.col("price.input") / MILLION + F.col("_last.o") * F.col("price.output") / MILLION
    waste = priced.select(
        "run_id",
        F.coalesce(total - last, F.lit(0.0)).alias("_waste"),
        F.when(F.col("price").isNull(), F.col("_b") - F.col("_last.b")).otherwise(0).alias("_attempts_unpriced"),
        F.when(F.col("_b") > 0, total).alias("generation_cost_usd"),
        "attempts",
    )
    zero = F.lit(0)
    joined = run_economics(runs, prices).join(paid_calls, "run_id", "left").join(waste, "run_id", "left")
    accounted = (F.col("count_source") == "provider_count") & (F.coalesce("_calls_unpriced", zero) == 0) & (F.coalesce("_attempts_unpriced", zero) == 0)
    optimizer, wasted = F.coalesce("_optimizer", F.lit(0.0)), F.coalesce("_waste", F.lit(0.0))
    gross = F.col("gross_input_savings_usd")
    known = accounted & gross.isNotNull()
    return joined.select(
        *runs.columns,
        "tokens_avoided",
        "reduction_percent",
        F.when(known, gross).alias("gross_input_savings_usd"),
        F.when(known, optimizer).alias("optimizer_cost_usd"),
        F.when(known, wasted).alias("fallback_waste_cost_usd"),
        F.when(known, gross - optimizer - wasted).alias("net_savings_usd"),
        F.when(known, F.col("generation_cost_usd")).alias("generation_cost_usd"),
        F.coalesce("attempts", zero).alias("attempts"),
    )
