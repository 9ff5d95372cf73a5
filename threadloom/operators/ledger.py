"""Totals over the run, attempt and utility-call ledgers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import economics, ordered


def _sum0(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


# A9 --------------------------------------------------------------------------
def source_totals(runs: DataFrame) -> DataFrame:
    """Token totals per count source; counts and estimates are never added together."""
    return runs.groupBy("count_source").agg(
        F.count("*").alias("runs"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("compiled_tokens").alias("compiled_tokens"),
        F.sum("tokens_avoided").alias("tokens_avoided"),
        F.avg("reduction_percent").alias("avg_reduction_percent"),
        F.avg(F.coalesce("initial_reduction_percent", "reduction_percent")).alias("avg_initial_reduction_percent"),
    )


# A10 -------------------------------------------------------------------------
def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("requests"),
        F.avg("compiler_latency_ms").alias("avg_compiler_latency_ms"),
        F.avg("model_latency_ms").alias("avg_model_latency_ms"),
        F.count_if(F.col("evaluation_status") == "PASS").alias("passed"),
        _sum0("fallback_applied").alias("fallbacks"),
        *[_sum0(f"saved_{m}").alias(f"saved_{m}") for m in ("omission", "memory", "compression", "deduplication")],
    )


# A11 -------------------------------------------------------------------------
def estimator_accuracy(runs: DataFrame) -> DataFrame:
    both = runs.where((F.col("count_source") == "provider_count") & F.col("full_estimate_tokens").isNotNull())
    sums = both.agg(F.count("*").alias("runs"), _sum0("full_estimate_tokens").alias("estimated_full"), _sum0("original_tokens").alias("counted_full"))
    error = F.when(F.col("counted_full") != 0, (F.col("estimated_full") - F.col("counted_full")) / F.col("counted_full") * 100)
    return sums.withColumn("error_percent", error)


# A12 -------------------------------------------------------------------------
def actual_usage(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("provider_output_tokens").alias("runs"),
        _sum0("provider_input_tokens").alias("input_tokens"),
        _sum0("provider_output_tokens").alias("output_tokens"),
        _sum0("cache_creation_tokens").alias("cache_creation_tokens"),
        _sum0("cache_read_tokens").alias("cache_read_tokens"),
    )


# A13 -------------------------------------------------------------------------
COST_COLUMNS = ["gross_input_savings_usd", "optimizer_cost_usd", "fallback_waste_cost_usd", "net_savings_usd", "generation_cost_usd"]


def cost_totals(costed: DataFrame) -> DataFrame:
    return costed.agg(F.count("net_savings_usd").alias("priced_runs"), *[_sum0(c).alias(c) for c in COST_COLUMNS])


# A14 -------------------------------------------------------------------------
def utility_by_kind(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per kind; cache tokens, where the calls have them, cost what they are priced at."""
    cached = {name: F.col(c) for name, c in (("cache_write", "cache_creation_tokens"), ("cache_read", "cache_read_tokens")) if c in calls.columns}
    cost = F.when(F.col("input_tokens").isNotNull(), economics.usage_cost(inputs=F.col("input_tokens"), outputs=F.col("output_tokens"), **cached))
    return (
        economics.with_price(calls, prices)
        .withColumn("cost_usd", cost)
        .groupBy("kind")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("ok") == 0).alias("failed"),
            _sum0("input_tokens").alias("input_tokens"),
            _sum0("output_tokens").alias("output_tokens"),
            _sum0("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull() & F.col("input_tokens").isNotNull()).alias("unpriced_calls"),
        )
    )


# A15, A16, W6, W8 --------------------------------------------------------------
def attempt_summary(attempts: DataFrame, at: str = "at") -> DataFrame:
    """First and last attempt of each run, by aggregation instead of a window."""
    return attempts.groupBy("run_id").agg(
        F.count("*").alias("attempts"),
        F.min_by("context_tokens", at).alias("initial_tokens"),
        F.max_by("context_tokens", at).alias("final_tokens"),
        F.min_by("passed", at).alias("initial_passed"),
        F.max_by("passed", at).alias("final_passed"),
        F.max_by("level", at).alias("final_level"),
        F.max(F.when(F.col("level") == "regenerated", 1).otherwise(0)).alias("regenerated"),
    )


def final_pass_rate(attempts: DataFrame, warning_only: Column | None = None, at: str = "at") -> DataFrame:
    ok = F.col("passed") == 1
    ok = ok if warning_only is None else ok | F.coalesce(warning_only, F.lit(False))
    last = attempts.withColumn("_ok", ok.cast("int")).groupBy("run_id").agg(F.max_by("_ok", at).alias("ok"))
    return last.agg(F.count("*").alias("runs"), F.sum("ok").alias("passed"), F.avg("ok").alias("final_pass_rate"))


def regenerated_runs(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("level") == "regenerated").agg(F.count_distinct("run_id").alias("regenerated_runs"))


def initial_vs_final(runs: DataFrame, attempts: DataFrame, at: str = "at") -> DataFrame:
    """Reduction of the first and the returned attempt; fell back when they differ by more than .05 points (W8)."""
    full = F.col("original_tokens")
    sized = runs.select("run_id", "original_tokens").join(attempt_summary(attempts, at), "run_id")
    sized = sized.withColumns(
        {
            "initial_percent": economics.reduction_percent(full, F.col("initial_tokens")),
            "final_percent": economics.reduction_percent(full, F.col("final_tokens")),
        }
    )
    return sized.select(
        "run_id",
        "original_tokens",
        "initial_tokens",
        "final_tokens",
        "initial_percent",
        "final_percent",
        (F.abs(F.col("initial_percent") - F.col("final_percent")) > 0.05).alias("fell_back"),
    )


# W7 --------------------------------------------------------------------------
def context_added(entries: DataFrame) -> DataFrame:
    """Entries an attempt has that the attempt before it did not.

    ``entries``: run_id, idx, entry_id and any payload columns; first attempts add nothing.
    """
    before = entries.select("run_id", (F.col("idx") + 1).alias("idx"), "entry_id")
    return entries.where(F.col("idx") > 0).join(ordered.merged(before), ["run_id", "idx", "entry_id"], "left_anti")


# A17, A19 ----------------------------------------------------------------------
def benchmark_time(runs: DataFrame) -> DataFrame:
    """Baseline and optimised model time where both sides were generated (JSON document per run)."""
    full = F.get_json_object("benchmark_json", "$.full.modelLatencyMs").cast("bigint")
    own = F.get_json_object("benchmark_json", "$.optimized.modelLatencyMs").cast("bigint")
    both = F.get_json_object("benchmark_json", "$.full").isNotNull() & F.get_json_object("benchmark_json", "$.optimized").isNotNull()
    sums = runs.where(both).agg(F.count("*").alias("runs"), _sum0(full).alias("baseline_ms"), _sum0(own).alias("optimized_ms"))
    saved = F.col("baseline_ms") - F.col("optimized_ms")
    return sums.select("*", saved.alias("saved_ms"), F.when(F.col("runs") > 0, saved / F.col("runs")).alias("avg_saved_ms"))


def latency_breakdown(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean compiler, counting, optimizer and model time of a request, and their sum."""
    counting = F.get_json_object("trace_json", "$.compilation.tokenCount.latencyMs").cast("double")
    optimizer = calls.agg(_sum0("latency_ms").alias("ms")).scalar()
    means = runs.agg(
        F.count("*").alias("_n"),
        F.avg("compiler_latency_ms").alias("compiler_ms"),
        F.avg(counting).alias("counting_ms"),
        F.avg("model_latency_ms").alias("model_ms"),
    ).withColumn("optimizer_ms", F.when(F.col("_n") > 0, optimizer / F.col("_n")))
    zero = F.lit(0.0)
    total = F.coalesce("compiler_ms", zero) + F.coalesce("counting_ms", zero) + F.coalesce("optimizer_ms", zero) + F.coalesce("model_ms", zero)
    return means.select("compiler_ms", "counting_ms", "optimizer_ms", "model_ms", total.alias("total_ms"))


# A18 -------------------------------------------------------------------------
def economics_totals(decided: DataFrame) -> DataFrame:
    def n(kind):
        return F.count_if(F.col("economic_decision") == kind)

    bypassed = F.col("economic_decision") == "bypass_full_context"
    return decided.agg(
        F.count("economic_decision").alias("decided"),
        n("optimized").alias("optimized"),
        n("bypass_full_context").alias("bypasses"),
        n("equivalent_context").alias("equivalent"),
        n("safety_full_context").alias("safety"),
        _sum0(F.when(bypassed, F.col("expected_evaluation_cost_usd"))).alias("spend_avoided_usd"),
        _sum0(F.when(bypassed, F.col("expected_gross_savings_usd"))).alias("savings_forgone_usd"),
    )


# A20 -------------------------------------------------------------------------
def dashboard(costed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Headline numbers in one row: one scan of the runs, one of the attempts.

    Provider-counted totals lead; estimates only stand in when nothing was counted.
    """
    counted = F.col("count_source") == "provider_count"

    def side(column, cond):
        return _sum0(F.when(cond, F.col(column)))

    one = costed.agg(
        F.count("*").alias("requests"),
        F.count_if(counted).alias("counted_runs"),
        F.count_if(~counted).alias("estimated_runs"),
        *[side(c, counted).alias(f"counted_{c}") for c in ("original_tokens", "compiled_tokens", "tokens_avoided")],
        *[side(c, ~counted).alias(f"estimated_{c}") for c in ("original_tokens", "compiled_tokens", "tokens_avoided")],
        F.avg(F.when(counted, F.col("reduction_percent"))).alias("counted_mean_percent"),
        F.avg(F.when(~counted, F.col("reduction_percent"))).alias("estimated_mean_percent"),
        F.count("net_savings_usd").alias("priced_runs"),
        _sum0("net_savings_usd").alias("net_savings_usd"),
        F.count_if(F.col("evaluation_status") == "PASS").alias("passed"),
        _sum0("fallback_applied").alias("fallbacks"),
    )
    lead = lambda c: F.when(F.col("counted_runs") > 0, F.col(f"counted_{c}")).otherwise(F.col(f"estimated_{c}"))
    one = one.withColumns({c: lead(c) for c in ("runs", "original_tokens", "compiled_tokens", "tokens_avoided", "mean_percent")})
    rate = final_pass_rate(attempts).select("passed").scalar()
    n = F.col("runs")
    return one.select(
        "requests",
        "runs",
        "original_tokens",
        "compiled_tokens",
        "tokens_avoided",
        F.when(F.col("original_tokens") > 0, F.col("tokens_avoided") / F.col("original_tokens") * 100).otherwise(0.0).alias("overall_percent"),
        "mean_percent",
        (F.col("tokens_avoided") / F.greatest(n, F.lit(1))).alias("avoided_per_request"),
        "priced_runs",
        "net_savings_usd",
        F.when(F.col("priced_runs") > 0, F.col("net_savings_usd") / F.col("priced_runs")).alias("net_per_priced_run"),
        F.when(F.col("requests") > 0, F.col("passed") / F.col("requests")).alias("first_pass_rate"),
        F.when(F.col("requests") > 0, rate / F.col("requests")).alias("final_pass_rate"),
        "fallbacks",
        F.when(F.col("requests") > 0, F.col("fallbacks") / F.col("requests")).alias("fallback_rate"),
    )


def measures(parts: dict[str, DataFrame], by: dict[str, str] | None = None) -> DataFrame:
    """The whole dashboard as rows part, item, measure, value: every number of tables of few rows.

    ``by`` names a part's column that tells its rows apart; NULL numbers are left out.
    """
    out = None
    for part, rows in parts.items():
        item = (by or {}).get(part)
        numbers = [c for c in rows.columns if c != item]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("m")
        long = rows.select(F.lit(part).alias("part"), (F.col(item) if item else F.lit("")).alias("item"), pairs).select("part", "item", "m.*").where(F.col("value").isNotNull())
        out = long if out is None else out.unionByName(long)
    return out


# A21 -------------------------------------------------------------------------
def conversation_totals(costed: DataFrame) -> DataFrame:
    full, sent = F.sum("original_tokens"), F.sum("compiled_tokens")
    r = lambda c: T.js_round(_sum0(c), 6)
    return costed.groupBy("conversation_id").agg(
        F.count("*").alias("turns"),
        full.alias("full_tokens"),
        sent.alias("final_tokens"),
        (full - sent).alias("tokens_avoided"),
        F.when(full > 0, T.js_round((full - sent) / full * 100, 1)).otherwise(0.0).alias("weighted_reduction_percent"),
        r("gross_input_savings_usd").alias("gross_savings_usd"),
        r("optimizer_cost_usd").alias("optimizer_cost_usd"),
        r("fallback_waste_cost_usd").alias("fallback_waste_usd"),
        r("net_savings_usd").alias("net_savings_usd"),
        r("generation_cost_usd").alias("generation_cost_usd"),
        _sum0("attempts").alias("generations"),
        F.count_if(F.col("attempts") > 1).alias("retries"),
        F.count_if(F.col("quality_warning").isNotNull()).alias("quality_warnings"),
        F.count_if(F.col("economic_decision").isNotNull() & (F.col("economic_decision") != "optimized")).alias("full_context_routes"),
    )


# W5 --------------------------------------------------------------------------
def cumulative_series(costed: DataFrame) -> DataFrame:
    """Running full, sent and net per conversation, with T1, T2, ... labels."""
    net = F.coalesce("net_savings_usd", F.lit(0.0))
    rows = costed.select("conversation_id", "run_id", "created_at", "original_tokens", "compiled_tokens", net.alias("_net"))
    summed = ordered.running_sums(
        ordered.cut_lineage(rows.withColumn("_block", ordered.block_of(F.col("run_id")))),
        ["conversation_id"],
        ["created_at", "_block"],
        ["created_at", "run_id"],
        {"n": F.lit(1), "cumulative_full": F.col("original_tokens"), "cumulative_final": F.col("compiled_tokens"), "net": F.col("_net")},
    )
    return summed.select(
        "conversation_id",
        "run_id",
        F.concat(F.lit("T"), F.col("n").cast("string")).alias("label"),
        "cumulative_full",
        "cumulative_final",
        T.js_round(F.col("net"), 6).alias("cumulative_net_usd"),
    )


# K1, J7 ------------------------------------------------------------------------
def recent_runs(runs: DataFrame, conversations: DataFrame, limit: int = 25) -> DataFrame:
    """Newest runs with their conversation title."""
    titled = runs.join(conversations.select("conversation_id", "title"), "conversation_id")
    return titled.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


# J5 --------------------------------------------------------------------------
def messages_with_runs(messages: DataFrame, runs: DataFrame, attempts: DataFrame, at: str = "at") -> DataFrame:
    """Messages with the outcome of the run that produced them; attempts are reduced to one row per run first."""
    outcome = runs.join(attempt_summary(attempts, at).select("run_id", "regenerated", F.col("final_passed").alias("answer_passed")), "run_id", "left")
    flags = outcome.select(
        "assistant_message_id",
        "run_id",
        "evaluation_status",
        F.coalesce("regenerated", F.lit(0)).alias("regenerated"),
        "answer_passed",
        F.col("quality_warning").isNotNull().alias("has_warning"),
    )
    return messages.join(flags, messages["message_id"] == flags["assistant_message_id"], "left").drop("assistant_message_id")
