"""Run, cost and dashboard queries."""

from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.operators import economics as E
from threadloom.operators import ledger as L
from threadloom.plans import views_sql as Q
from threadloom.plans.registry import CHECKS, QUERIES, query, rounded
from threadloom.sources import tables as S

UTILITY_MODEL = "claude-haiku-4-5"


def _costed(spark, sf):
    return E.run_costs(S.runs(spark, sf), S.attempts(spark, sf), S.run_calls(spark, sf), E.default_prices(spark))


def _titles(spark, sf):
    customers = S.table(spark, sf, "customer")
    return customers.select(F.col("c_custkey").alias("conversation_id"), F.col("c_name").alias("title"))


@query(
    "run_economics",
    f"""WITH {Q.RUN_ECONOMICS}
SELECT run_id, tokens_avoided, reduction_percent, round(full_input_cost_usd, 9) AS full_input_cost_usd,
  round(compiled_input_cost_usd, 9) AS compiled_input_cost_usd, round(gross_input_savings_usd, 9) AS gross_input_savings_usd
FROM run_economics""",
)
def run_economics(spark, sf):
    cols = ["run_id", "tokens_avoided", "reduction_percent", "full_input_cost_usd", "compiled_input_cost_usd", "gross_input_savings_usd"]
    return rounded(E.run_economics(S.runs(spark, sf), E.default_prices(spark)).select(*cols), 9)


_EXPECTED = f"""recent AS (
  SELECT input_tokens, output_tokens FROM utility_calls
  WHERE kind = 'evaluation' AND ok = 1 AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL ORDER BY call_id DESC LIMIT {V.EVAL_WINDOW}),
expected AS (
  SELECT count(*) AS samples,
    CASE WHEN count(*) >= {V.MIN_EVAL_SAMPLES} THEN CAST(ceil(sum(input_tokens) / count(*)) AS BIGINT) ELSE {V.DEFAULT_EVAL_INPUT} END AS input_tokens,
    CASE WHEN count(*) >= {V.MIN_EVAL_SAMPLES} THEN CAST(ceil(sum(output_tokens) / count(*)) AS BIGINT) ELSE {V.DEFAULT_EVAL_OUTPUT} END AS output_tokens,
    CASE WHEN count(*) >= {V.MIN_EVAL_SAMPLES} THEN 'history' ELSE 'default' END AS source
  FROM recent)"""


@query("expected_eval_usage", f"WITH {Q.UTILITY_CALLS}, {_EXPECTED} SELECT * FROM expected")
def expected_eval_usage(spark, sf):
    return E.expected_eval_usage(S.utility_calls(spark, sf), F.col("call_id"))


@query(
    "eval_usage_as_of",
    f"""WITH {Q.UTILITY_CALLS}, s AS (
  SELECT call_id, count(*) OVER w AS n, sum(input_tokens) OVER w AS i, sum(output_tokens) OVER w AS o FROM utility_calls
  WHERE kind = 'evaluation' AND ok = 1 AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL WINDOW w AS (ORDER BY call_id ROWS BETWEEN {V.EVAL_WINDOW - 1} PRECEDING AND CURRENT ROW))
SELECT c.call_id, coalesce(n, 0) AS samples, CASE WHEN n >= {V.MIN_EVAL_SAMPLES} THEN CAST(ceil(i / n) AS BIGINT) ELSE {V.DEFAULT_EVAL_INPUT} END AS input_tokens,
  CASE WHEN n >= {V.MIN_EVAL_SAMPLES} THEN CAST(ceil(o / n) AS BIGINT) ELSE {V.DEFAULT_EVAL_OUTPUT} END AS output_tokens, CASE WHEN n >= {V.MIN_EVAL_SAMPLES} THEN 'history' ELSE 'default' END AS source
FROM utility_calls c ASOF LEFT JOIN s ON c.call_id > s.call_id""",
)
def eval_usage_as_of(spark, sf):
    """What the expected usage of an evaluation was before every internal call."""
    return E.expected_eval_usage_as_of(S.utility_calls(spark, sf), "call_id")


@query(
    "economic_decision",
    f"""WITH {Q.RUN_ECONOMICS}, {Q.UTILITY_CALLS}, {_EXPECTED},
cost AS (SELECT (e.input_tokens * p.input + e.output_tokens * p.output) / 1000000 AS eval_cost FROM expected e, prices p WHERE p.model = '{UTILITY_MODEL}')
SELECT run_id, original_tokens, compiled_tokens, tokens_avoided, round(gross_input_savings_usd, 9) AS gross_input_savings_usd,
  round(eval_cost, 9) AS eval_cost_usd, round(eval_cost * {V.ECONOMICS_MARGIN}, 9) AS threshold_usd,
  CAST(ceil(eval_cost * {V.ECONOMICS_MARGIN} * 1000000 / price_input) AS BIGINT) AS break_even_tokens,
  CASE WHEN tokens_avoided <= 0 THEN 'equivalent_context' WHEN gross_input_savings_usd IS NULL THEN 'optimized'
    WHEN gross_input_savings_usd < eval_cost * {V.ECONOMICS_MARGIN} THEN 'bypass_full_context' ELSE 'optimized' END AS decision
FROM run_economics, cost""",
)
def economic_decision(spark, sf):
    decided = E.economic_decisions(S.runs(spark, sf), S.utility_calls(spark, sf), E.default_prices(spark), UTILITY_MODEL, F.col("call_id"))
    return rounded(decided, 9)


@query(
    "oversize_requests",
    f"""WITH {Q.RUNS} SELECT run_id, coalesce(original_tokens, full_estimate_tokens) AS request_tokens FROM runs
WHERE coalesce(original_tokens, full_estimate_tokens) > 9500""",
)
def oversize_requests(spark, sf):
    return E.oversize_requests(S.runs(spark, sf), "original_tokens", "full_estimate_tokens", 9500).select("run_id", "request_tokens")


@query(
    "retry_prices",
    f"""WITH {Q.RUN_ECONOMICS}, {Q.UTILITY_CALLS}, {_EXPECTED},
cost AS (SELECT (e.input_tokens * p.input + e.output_tokens * p.output) / 1000000 AS eval_cost FROM expected e, prices p WHERE p.model = '{UTILITY_MODEL}'),
priced AS (
  SELECT run_id, fallback_applied = 1 AS optional,
    (compiled_tokens * price_input + provider_output_tokens * price_output) / 1000000 + eval_cost AS cost,
    (original_tokens - compiled_tokens) * price_input / 1000000 - (0.001 + eval_cost) - 0.002 AS net
  FROM run_economics, cost)
SELECT run_id, round(cost, 9) AS expected_retry_cost_usd, round(CASE WHEN cost IS NOT NULL THEN net END, 9) AS projected_net_usd,
  coalesce(optional AND cost IS NOT NULL AND net < 0, FALSE) AS blocked,
  CASE WHEN NOT optional THEN 'not_applicable' WHEN cost IS NULL OR net IS NULL THEN 'unknown' WHEN net < 0 THEN 'blocked' ELSE 'allowed' END AS economic_guard
FROM priced""",
)
def retry_prices(spark, sf):
    prices = E.default_prices(spark)
    expected = E.expected_eval_usage(S.utility_calls(spark, sf), F.col("call_id"))
    cost = E.expected_eval_cost(expected, UTILITY_MODEL, prices).select("eval_cost_usd").scalar()
    retries = S.runs(spark, sf).select(
        "run_id",
        "model",
        F.col("original_tokens").alias("full_tokens"),
        F.col("compiled_tokens").alias("retry_tokens"),
        F.col("provider_output_tokens").alias("output_tokens"),
        F.lit(0.001).alias("optimizer_so_far"),
        F.lit(0.002).alias("spent_so_far"),
        (F.col("fallback_applied") == 1).alias("optional"),
    )
    out = E.price_retries(retries, prices, cost)
    return rounded(out.select("run_id", "expected_retry_cost_usd", "projected_net_usd", "blocked", "economic_guard"), 9)


@query(
    "run_costs",
    f"""WITH {Q.RUN_COSTS}
SELECT run_id, CAST(attempts AS BIGINT) AS attempts, round(CASE WHEN known THEN gross_input_savings_usd END, 9) AS gross_input_savings_usd,
  round(CASE WHEN known THEN optimizer END, 9) AS optimizer_cost_usd, round(CASE WHEN known THEN waste END, 9) AS fallback_waste_cost_usd,
  round(net_savings_usd, 9) AS net_savings_usd, round(CASE WHEN known THEN generation END, 9) AS generation_cost_usd
FROM run_costs""",
)
def run_costs(spark, sf):
    cols = ["run_id", "attempts", *L.COST_COLUMNS]
    # adding 0.0 turns a negative zero left by a subtraction into zero
    costed = _costed(spark, sf).select(*cols).withColumns({c: F.round(c, 9) + 0.0 for c in L.COST_COLUMNS})
    return costed


@query(
    "source_totals",
    f"""WITH {Q.RUN_ECONOMICS}, {Q.ATTEMPTS},
firsts AS (SELECT run_id, min_by(context_tokens, idx) AS initial_tokens FROM attempts GROUP BY run_id),
sized AS (SELECT r.*, CASE WHEN initial_tokens IS NOT NULL THEN {Q.reduction('original_tokens', 'initial_tokens')} END AS initial_percent
  FROM run_economics r LEFT JOIN firsts USING (run_id))
SELECT count_source, count(*) AS runs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compiled_tokens) AS BIGINT) AS compiled_tokens,
  CAST(sum(tokens_avoided) AS BIGINT) AS tokens_avoided, round(avg(reduction_percent), 6) AS avg_reduction_percent,
  round(avg(coalesce(initial_percent, reduction_percent)), 6) AS avg_initial_reduction_percent
FROM sized GROUP BY count_source""",
)
def source_totals(spark, sf):
    runs = S.runs(spark, sf)
    first = L.initial_vs_final(runs, S.attempts(spark, sf)).select("run_id", F.col("initial_percent").alias("initial_reduction_percent"))
    sized = E.run_economics(runs, E.default_prices(spark)).join(first, "run_id", "left")
    return rounded(L.source_totals(sized))


@query(
    "run_totals",
    f"""WITH {Q.RUNS} SELECT count(*) AS requests, round(avg(compiler_latency_ms), 6) AS avg_compiler_latency_ms,
  round(avg(model_latency_ms), 6) AS avg_model_latency_ms, count(*) FILTER (evaluation_status = 'PASS') AS passed,
  CAST(sum(fallback_applied) AS BIGINT) AS fallbacks, CAST(sum(saved_omission) AS BIGINT) AS saved_omission, CAST(sum(saved_memory) AS BIGINT) AS saved_memory,
  CAST(sum(saved_compression) AS BIGINT) AS saved_compression, CAST(sum(saved_deduplication) AS BIGINT) AS saved_deduplication FROM runs""",
)
def run_totals(spark, sf):
    return rounded(L.run_totals(S.runs(spark, sf)))


@query(
    "estimator_accuracy",
    f"""WITH {Q.RUNS}, s AS (SELECT count(*) AS runs, CAST(sum(full_estimate_tokens) AS BIGINT) AS estimated_full, CAST(sum(original_tokens) AS BIGINT) AS counted_full
  FROM runs WHERE count_source = 'provider_count' AND full_estimate_tokens IS NOT NULL)
SELECT *, round((estimated_full - counted_full) / CAST(counted_full AS DOUBLE) * 100, 6) AS error_percent FROM s""",
)
def estimator_accuracy(spark, sf):
    return rounded(L.estimator_accuracy(S.runs(spark, sf)))


@query(
    "actual_usage",
    f"""WITH {Q.RUNS} SELECT count(provider_output_tokens) AS runs, CAST(sum(provider_input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(provider_output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens FROM runs""",
)
def actual_usage(spark, sf):
    return L.actual_usage(S.runs(spark, sf))


@query(
    "cost_totals",
    f"""WITH {Q.RUN_COSTS} SELECT count(net_savings_usd) AS priced_runs, round(sum(gross_input_savings_usd) FILTER (known), 6) AS gross_input_savings_usd,
  round(sum(optimizer) FILTER (known), 6) AS optimizer_cost_usd, round(sum(waste) FILTER (known), 6) AS fallback_waste_cost_usd,
  round(sum(net_savings_usd), 6) AS net_savings_usd, round(sum(generation) FILTER (known), 6) AS generation_cost_usd FROM run_costs""",
)
def cost_totals(spark, sf):
    return rounded(L.cost_totals(_costed(spark, sf)))


@query(
    "economics_totals",
    f"""WITH {Q.RUN_ECONOMICS} SELECT count(economic_decision) AS decided, count(*) FILTER (economic_decision = 'optimized') AS optimized,
  count(*) FILTER (economic_decision = 'bypass_full_context') AS bypasses, count(*) FILTER (economic_decision = 'equivalent_context') AS equivalent,
  count(*) FILTER (economic_decision = 'safety_full_context') AS safety,
  round(coalesce(sum(compiled_input_cost_usd) FILTER (economic_decision = 'bypass_full_context'), 0), 6) AS spend_avoided_usd,
  round(coalesce(sum(full_input_cost_usd) FILTER (economic_decision = 'bypass_full_context'), 0), 6) AS savings_forgone_usd FROM run_economics""",
)
def economics_totals(spark, sf):
    decided = E.run_economics(S.runs(spark, sf), E.default_prices(spark)).withColumns(
        {"expected_evaluation_cost_usd": F.col("compiled_input_cost_usd"), "expected_gross_savings_usd": F.col("full_input_cost_usd")}
    )
    return rounded(L.economics_totals(decided))


@query(
    "utility_by_kind",
    f"""WITH {Q.UTILITY_CALLS}, {Q.PRICES} SELECT c.kind, count(*) AS calls, count(*) FILTER (ok = 0) AS failed,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  round(coalesce(sum((input_tokens * p.input + output_tokens * p.output) / 1000000), 0), 6) AS cost_usd,
  count(*) FILTER (p.model IS NULL AND input_tokens IS NOT NULL) AS unpriced_calls
FROM utility_calls c LEFT JOIN prices p ON p.model = c.model GROUP BY c.kind""",
)
def utility_by_kind(spark, sf):
    return rounded(L.utility_by_kind(S.utility_calls(spark, sf), E.default_prices(spark)))


@query(
    "final_pass_rate",
    f"""WITH {Q.ATTEMPTS}, f AS (SELECT run_id, max_by(passed, idx) AS ok FROM attempts GROUP BY run_id)
SELECT count(*) AS runs, CAST(sum(ok) AS BIGINT) AS passed, round(avg(ok), 6) AS final_pass_rate FROM f""",
)
def final_pass_rate(spark, sf):
    return rounded(L.final_pass_rate(S.attempts(spark, sf)))


@query("regenerated_runs", f"WITH {Q.ATTEMPTS} SELECT count(DISTINCT run_id) AS regenerated_runs FROM attempts WHERE level = 'regenerated'")
def regenerated_runs(spark, sf):
    return L.regenerated_runs(S.attempts(spark, sf))


@query(
    "last_attempt",
    f"""WITH {Q.ATTEMPTS} SELECT run_id, count(*) AS attempts, max_by(level, idx) AS final_level, CAST(max_by(passed, idx) AS BIGINT) AS final_passed,
  CAST(max(CASE WHEN level = 'regenerated' THEN 1 ELSE 0 END) AS BIGINT) AS regenerated FROM attempts GROUP BY run_id""",
)
def last_attempt(spark, sf):
    s = L.attempt_summary(S.attempts(spark, sf))
    return s.select("run_id", "attempts", "final_level", F.col("final_passed").cast("bigint").alias("final_passed"), F.col("regenerated").cast("bigint").alias("regenerated"))


@query(
    "initial_vs_final",
    f"""WITH {Q.RUNS}, {Q.ATTEMPTS},
s AS (SELECT run_id, min_by(context_tokens, idx) AS initial_tokens, max_by(context_tokens, idx) AS final_tokens FROM attempts GROUP BY run_id),
p AS (SELECT run_id, original_tokens, initial_tokens, final_tokens, {Q.reduction('original_tokens', 'initial_tokens')} AS initial_percent,
  {Q.reduction('original_tokens', 'final_tokens')} AS final_percent FROM runs JOIN s USING (run_id))
SELECT *, abs(initial_percent - final_percent) > 0.05 AS fell_back FROM p""",
)
def initial_vs_final(spark, sf):
    return L.initial_vs_final(S.runs(spark, sf), S.attempts(spark, sf))


@query(
    "context_added",
    f"""WITH {Q.ATTEMPTS}, e AS (SELECT run_id, idx, l AS entry_id FROM attempts, (VALUES ('base'), ('extra')) v(l) WHERE l = 'base' OR level = 'expanded')
SELECT a.run_id, a.idx, a.entry_id FROM e a WHERE a.idx > 0
  AND NOT EXISTS (SELECT 1 FROM e b WHERE b.run_id = a.run_id AND b.idx = a.idx - 1 AND b.entry_id = a.entry_id)""",
)
def context_added(spark, sf):
    parts = F.when(F.col("level") == "expanded", F.array(F.lit("base"), F.lit("extra"))).otherwise(F.array(F.lit("base")))
    entries = S.numbered_attempts(spark, sf).select("run_id", "idx", F.explode(parts).alias("entry_id"))
    return L.context_added(entries)


@query(
    "benchmark_time",
    f"""WITH {Q.RUNS}, s AS (SELECT count(*) AS runs, CAST(sum(baseline_ms) AS BIGINT) AS baseline_ms, CAST(sum(optimized_ms) AS BIGINT) AS optimized_ms
  FROM runs WHERE baseline_ms IS NOT NULL AND optimized_ms IS NOT NULL)
SELECT *, baseline_ms - optimized_ms AS saved_ms, round((baseline_ms - optimized_ms) / CAST(runs AS DOUBLE), 6) AS avg_saved_ms FROM s""",
)
def benchmark_time(spark, sf):
    return rounded(L.benchmark_time(S.runs(spark, sf)))


@query(
    "latency_breakdown",
    f"""WITH {Q.RUNS}, {Q.UTILITY_CALLS}, m AS (SELECT avg(compiler_latency_ms) AS compiler_ms, avg(counting_ms) AS counting_ms,
  (SELECT sum(latency_ms) FROM utility_calls) / CAST(count(*) AS DOUBLE) AS optimizer_ms, avg(model_latency_ms) AS model_ms FROM runs)
SELECT round(compiler_ms, 6) AS compiler_ms, round(counting_ms, 6) AS counting_ms, round(optimizer_ms, 6) AS optimizer_ms, round(model_ms, 6) AS model_ms,
  round(compiler_ms + counting_ms + optimizer_ms + model_ms, 6) AS total_ms FROM m""",
)
def latency_breakdown(spark, sf):
    return rounded(L.latency_breakdown(S.runs(spark, sf), S.utility_calls(spark, sf)))


@query(
    "dashboard",
    f"""WITH {Q.RUN_COSTS}, t AS (
  SELECT count(*) AS requests, count(*) FILTER (count_source = 'provider_count') AS runs,
    CAST(sum(original_tokens) FILTER (count_source = 'provider_count') AS BIGINT) AS original_tokens,
    CAST(sum(compiled_tokens) FILTER (count_source = 'provider_count') AS BIGINT) AS compiled_tokens,
    CAST(sum(tokens_avoided) FILTER (count_source = 'provider_count') AS BIGINT) AS tokens_avoided,
    avg(reduction_percent) FILTER (count_source = 'provider_count') AS mean_percent,
    count(net_savings_usd) AS priced_runs, sum(net_savings_usd) AS net_savings_usd,
    count(*) FILTER (evaluation_status = 'PASS') AS passed, CAST(sum(fallback_applied) AS BIGINT) AS fallbacks
  FROM run_costs), f AS (SELECT sum(ok) AS final_ok FROM (SELECT max_by(passed, idx) AS ok FROM attempts GROUP BY run_id))
SELECT requests, runs, original_tokens, compiled_tokens, tokens_avoided, round(CAST(tokens_avoided AS DOUBLE) / original_tokens * 100, 6) AS overall_percent,
  round(mean_percent, 6) AS mean_percent, round(CAST(tokens_avoided AS DOUBLE) / runs, 6) AS avoided_per_request, priced_runs, round(net_savings_usd, 6) AS net_savings_usd,
  round(net_savings_usd / priced_runs, 6) AS net_per_priced_run, round(CAST(passed AS DOUBLE) / requests, 6) AS first_pass_rate,
  round(CAST(final_ok AS DOUBLE) / requests, 6) AS final_pass_rate, fallbacks, round(CAST(fallbacks AS DOUBLE) / requests, 6) AS fallback_rate FROM t, f""",
)
def dashboard(spark, sf):
    return rounded(L.dashboard(_costed(spark, sf), S.attempts(spark, sf)))


@query(
    "conversation_totals",
    f"""WITH {Q.RUN_COSTS} SELECT conversation_id, count(*) AS turns, CAST(sum(original_tokens) AS BIGINT) AS full_tokens, CAST(sum(compiled_tokens) AS BIGINT) AS final_tokens,
  CAST(sum(tokens_avoided) AS BIGINT) AS tokens_avoided, floor(CAST(sum(tokens_avoided) AS DOUBLE) / sum(original_tokens) * 100 * 10 + 0.5) / 10 AS weighted_reduction_percent,
  round(coalesce(sum(gross_input_savings_usd) FILTER (known), 0), 6) AS gross_savings_usd, round(coalesce(sum(optimizer) FILTER (known), 0), 6) AS optimizer_cost_usd,
  round(coalesce(sum(waste) FILTER (known), 0), 6) AS fallback_waste_usd, round(coalesce(sum(net_savings_usd), 0), 6) AS net_savings_usd,
  round(coalesce(sum(generation) FILTER (known), 0), 6) AS generation_cost_usd, CAST(sum(attempts) AS BIGINT) AS generations, count(*) FILTER (quality_warning IS NOT NULL) AS quality_warnings,
  count(*) FILTER (attempts > 1) AS retries, count(*) FILTER (economic_decision <> 'optimized') AS full_context_routes
FROM run_costs GROUP BY conversation_id""",
)
def conversation_totals(spark, sf):
    return rounded(L.conversation_totals(_costed(spark, sf)), 6)


@query(
    "cumulative_series",
    f"""WITH {Q.RUN_COSTS} SELECT conversation_id, run_id, concat('T', row_number() OVER w) AS label,
  CAST(sum(original_tokens) OVER w AS BIGINT) AS cumulative_full, CAST(sum(compiled_tokens) OVER w AS BIGINT) AS cumulative_final,
  round(sum(coalesce(net_savings_usd, 0)) OVER w, 6) AS cumulative_net_usd
FROM run_costs WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, run_id ROWS UNBOUNDED PRECEDING)""",
)
def cumulative_series(spark, sf):
    return rounded(L.cumulative_series(_costed(spark, sf)), 6)


@query(
    "recent_runs",
    f"""WITH {Q.RUNS} SELECT run_id, conversation_id, c_name AS title, original_tokens, compiled_tokens
FROM runs JOIN customer ON c_custkey = conversation_id ORDER BY created_at DESC, run_id DESC LIMIT 25""",
)
def recent_runs(spark, sf):
    cols = ["run_id", "conversation_id", "title", "original_tokens", "compiled_tokens"]
    return L.recent_runs(S.runs(spark, sf), _titles(spark, sf)).select(*cols)


@query(
    "messages_with_runs",
    f"""WITH {Q.RUNS}, {Q.ATTEMPTS}, m AS (SELECT o_orderkey AS message_id FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders),
a AS (SELECT run_id, max(CASE WHEN level = 'regenerated' THEN 1 ELSE 0 END) AS regenerated, max_by(passed, idx) AS answer_passed FROM attempts GROUP BY run_id)
SELECT m.message_id, r.run_id, r.evaluation_status, CASE WHEN r.run_id IS NOT NULL THEN coalesce(regenerated, 0) END AS regenerated, answer_passed,
  CASE WHEN r.run_id IS NOT NULL THEN quality_warning IS NOT NULL END AS has_warning
FROM m LEFT JOIN runs r ON r.run_id = m.message_id LEFT JOIN a ON a.run_id = r.run_id""",
)
def messages_with_runs(spark, sf):
    answers = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("message_id"))
    asked = answers.select((-1 - F.col("message_id")).alias("message_id"))
    runs = S.runs(spark, sf).withColumn("assistant_message_id", F.col("run_id"))
    return L.messages_with_runs(answers.union(asked), runs, S.attempts(spark, sf))


@query(
    "usage_costs",
    f"""WITH {Q.RUN_ECONOMICS} SELECT run_id, round((coalesce(provider_input_tokens, 0) * p.input + coalesce(provider_output_tokens, 0) * p.output + coalesce(cache_creation_tokens, 0) * p.cache_write
  + coalesce(cache_read_tokens, 0) * p.cache_read) / 1000000, 9) AS usage_cost_usd FROM run_economics r LEFT JOIN prices p ON p.model = regexp_replace(r.model, '-[0-9]{{8}}$', '')""",
)
def usage_costs(spark, sf):
    """What the counted usage of each run cost, cache tokens included."""
    rows = E.with_price(S.runs(spark, sf), E.default_prices(spark))
    cost = E.usage_cost(inputs=F.col("provider_input_tokens"), outputs=F.col("provider_output_tokens"), cache_write=F.col("cache_creation_tokens"), cache_read=F.col("cache_read_tokens"))
    return rows.select("run_id", F.round(cost, 9).alias("usage_cost_usd"))


_CACHED_CALLS = f"""{Q.UTILITY_CALLS}, cached AS (SELECT *, CASE WHEN call_id % 4 = 0 THEN 50 END AS cache_creation_tokens, CASE WHEN call_id % 6 = 0 THEN call_id % 40 END AS cache_read_tokens FROM utility_calls)"""


@query(
    "utility_with_cache",
    f"""WITH {_CACHED_CALLS}, {Q.PRICES} SELECT c.kind, round(coalesce(sum((input_tokens * p.input + output_tokens * p.output + coalesce(cache_creation_tokens, 0) * p.cache_write + coalesce(cache_read_tokens, 0) * p.cache_read) / 1000000), 0), 6) AS cost_usd
FROM cached c LEFT JOIN prices p ON p.model = c.model GROUP BY c.kind""",
)
def utility_with_cache(spark, sf):
    k = F.col("call_id")
    calls = S.utility_calls(spark, sf).withColumns({"cache_creation_tokens": F.when(k % 4 == 0, 50).cast("bigint"), "cache_read_tokens": F.when(k % 6 == 0, k % 40)})
    return rounded(L.utility_by_kind(calls, E.default_prices(spark)).select("kind", "cost_usd"))


_PARTS = ["run_totals", "estimator_accuracy", "actual_usage", "cost_totals", "economics_totals", "regenerated_runs", "benchmark_time", "latency_breakdown", "dashboard", "source_totals", "utility_by_kind"]
_BY = {"source_totals": "count_source", "utility_by_kind": "kind"}


def _long(part: str) -> str:
    item = _BY.get(part)
    rows = f"SELECT {item or chr(39) * 2} AS item, COLUMNS(lambda c: c <> '{item or ''}')::DOUBLE FROM ({CHECKS[part]})"
    return f"SELECT '{part}' AS part, item, measure, value FROM (UNPIVOT ({rows}) ON COLUMNS(* EXCLUDE item) INTO NAME measure VALUE value)"


@query("dashboard_measures", " UNION ALL ".join(_long(part) for part in _PARTS))
def dashboard_measures(spark, sf):
    """Every number of the dashboard in rows: runs, estimator, usage, costs, economics, calls by kind, latency, benchmark, headline."""
    parts = {part: QUERIES[part](spark, sf) for part in _PARTS}
    return L.measures(parts, _BY).withColumn("value", F.col("value") + 0.0)
