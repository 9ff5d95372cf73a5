"""Bounded recovery: bring back named messages in their cheapest form within one budget (R4, R12, R17).

An evaluator names omitted messages per request; the list arrives in one row,
so folding it in order works on an array that is no larger than that row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import greedy, memory, ordered, relevance, verdicts

KEYS = relevance.KEYS
ITEM = "struct<turn:bigint,kind:string,representation:string,tokens:bigint,skipped:boolean,why:string>"


def plan(rows: DataFrame, expansion: DataFrame, already_sent: DataFrame | None, messages: DataFrame, items: DataFrame | None, sources: DataFrame | None, summaries: DataFrame | None) -> DataFrame:
    """Per request: items restored or skipped in order, the budget left and whether it was overrun.

    ``expansion``: conv_id, req_turn, include_ids (turns), token_budget, min_score (NULL: named messages only).
    """
    named = expansion.select(*KEYS, "token_budget", F.posexplode("include_ids").alias("ord", "turn"))
    state = rows.select(*KEYS, "turn", "pos", "role", "tokens", "memory_complete", F.col("route").isNotNull().alias("_routed"))
    if already_sent is None:
        state = state.withColumn("_sent", F.lit(None).cast("boolean"))
    else:
        state = state.join(ordered.merged(already_sent.select(*KEYS, "turn", F.lit(True).alias("_sent"))), [*KEYS, "turn"], "left")
    state = state.withColumn("_there", F.col("_routed") | F.coalesce("_sent", F.lit(False))).drop("_routed", "_sent")
    named = named.join(ordered.merged(state), [*KEYS, "turn"])
    prev = state.select(*KEYS, (F.col("pos") + 1).alias("pos"), F.col("turn").alias("p_turn"), F.col("tokens").alias("p_tokens"), F.col("role").alias("p_role"), F.col("_there").alias("p_there"))
    named = named.join(ordered.merged(prev), [*KEYS, "pos"], "left").join(ordered.merged(messages.select("conv_id", "turn", "text")), ["conv_id", "turn"])
    named = named.withColumn("p_why", verdicts.partner_reason(F.col("role"), F.col("p_role"), F.col("text")))
    zero = F.lit(0).cast("bigint")
    if items is not None:
        lines = items.where("active").select(*KEYS, "key", memory.line_tokens().alias("_line"))
        cost = named.select(*KEYS, "turn").join(ordered.merged(sources), [*KEYS, "turn"]).join(ordered.merged(lines), [*KEYS, "key"]).groupBy(*KEYS, "turn").agg(F.sum("_line").alias("m_cost"))
        named = named.join(ordered.merged(cost), [*KEYS, "turn"], "left")
    else:
        named = named.withColumn("m_cost", F.lit(None).cast("bigint"))
    if summaries is not None:
        given = summaries.where(F.col("summary") != "").select("conv_id", "turn", T.message_tokens(F.col("summary")).alias("s_cost"))
        named = named.join(ordered.merged(given), ["conv_id", "turn"], "left")
    else:
        named = named.withColumn("s_cost", F.lit(None).cast("bigint"))
    tok = F.col("tokens")
    as_memory = F.col("memory_complete") & F.coalesce(F.col("m_cost") < tok, F.lit(False))
    as_summary = F.coalesce((F.col("s_cost") <= tok * V.SUMMARY_MAX_RATIO) & (tok - F.col("s_cost") >= V.MIN_SAVED_TOKENS), F.lit(False))
    named = named.withColumns(
        {
            "rep": F.when(as_memory, "memory").when(as_summary, "compressed").otherwise("original"),
            "cost": F.when(as_memory, F.col("m_cost")).when(as_summary, F.col("s_cost")).otherwise(tok),
            "p_there": F.coalesce("p_there", F.lit(True)),
            "p_tokens": F.coalesce("p_tokens", zero),
        }
    )
    fields = ["ord", "turn", "_there", "rep", "cost", "p_turn", "p_tokens", "p_there", "p_why"]
    lists = named.groupBy(*KEYS, "token_budget").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("xs"))
    ids = F.array().cast("array<bigint>")
    start = F.struct(
        F.col("token_budget").cast("bigint").alias("budget"), F.lit(False).alias("closed"), F.lit(0).alias("restored"), ids.alias("routed"), ids.alias("noted"), F.array().cast(f"array<{ITEM}>").alias("items")
    )
    folded = lists.withColumn("r", F.aggregate("xs", start, _step))
    return expansion.select(*KEYS, "token_budget", "min_score").join(ordered.merged(folded.select(*KEYS, "r")), KEYS, "left").select(
        *KEYS,
        "token_budget",
        "min_score",
        F.coalesce("r.budget", "token_budget").alias("budget_left"),
        F.coalesce("r.closed", F.lit(False)).alias("closed"),
        F.coalesce("r.items", F.array().cast(f"array<{ITEM}>")).alias("items"),
    )


def _item(turn, kind, rep, tokens, skipped, why):
    return F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), rep.alias("representation"), tokens.cast("bigint").alias("tokens"), F.lit(skipped).alias("skipped"), why.alias("why")).cast(ITEM)


def _step(acc, x):
    there = x["_there"] | F.array_contains(acc["routed"], x["turn"])
    blocked = acc["closed"] | ((acc["restored"] > 0) & (x["cost"] > acc["budget"]))
    take = ~there & ~blocked
    left = F.when(take, acc["budget"] - x["cost"]).otherwise(acc["budget"])
    over = take & (left < 0)
    known = F.array_contains(acc["routed"], x["p_turn"]) | F.array_contains(acc["noted"], x["p_turn"])
    partner = take & ~over & x["p_turn"].isNotNull() & x["p_why"].isNotNull() & ~x["p_there"] & ~F.coalesce(known, F.lit(False))
    with_partner = partner & (x["p_tokens"] <= left)
    zero = F.lit(0).cast("bigint")
    own = (
        F.when(there, _item(x["turn"], "named", F.lit("already_in_payload"), zero, False, F.lit("already in the payload, so nothing was added")))
        .when(blocked, _item(x["turn"], "named", x["rep"], zero, True, F.lit("named by the evaluator but not restored: the expansion budget was already used")))
        .otherwise(_item(x["turn"], "named", x["rep"], x["cost"], False, F.lit("the evaluator identified this omitted information as necessary")))
    )
    items = F.array_append(acc["items"], own)
    items = (
        F.when(with_partner, F.array_append(items, _item(x["p_turn"], "partner", F.lit("original"), x["p_tokens"], False, x["p_why"])))
        .when(partner, F.array_append(items, _item(x["p_turn"], "partner", F.lit("original"), zero, True, x["p_why"])))
        .otherwise(items)
    )
    routed = F.when(take & (x["rep"] != "memory"), F.array_append(acc["routed"], x["turn"])).otherwise(acc["routed"])
    return F.struct(
        F.when(with_partner, left - x["p_tokens"]).otherwise(left).alias("budget"),
        (acc["closed"] | over).alias("closed"),
        F.when(take, acc["restored"] + 1).otherwise(acc["restored"]).alias("restored"),
        F.when(with_partner, F.array_append(routed, x["p_turn"])).otherwise(routed).alias("routed"),
        F.when(take & (x["rep"] == "memory"), F.array_append(acc["noted"], x["turn"])).otherwise(acc["noted"]).alias("noted"),
        items.alias("items"),
    )


def restored(planned: DataFrame) -> DataFrame:
    """Messages brought back: KEYS, turn, kind, representation, tokens, why."""
    return planned.select(*KEYS, F.explode("items").alias("i")).select(*KEYS, "i.*").where(~F.col("skipped") & (F.col("representation") != "already_in_payload"))


def next_best(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Further omitted messages within the budget that is left, best score first, then newest (R12)."""
    open_ = planned.where(~F.col("closed") & F.col("min_score").isNotNull() & (F.col("budget_left") > 0)).select(*KEYS, "min_score", F.col("budget_left").alias("budget"))
    n = rows.groupBy(*KEYS).agg(F.max("pos").alias("_last"))
    wanted = open_.join(ordered.merged(n), KEYS)
    pool = rows.where((F.col("route.action") == "OMIT") & F.col("route.duplicate_of").isNull()).select(*KEYS, "pos", "turn", "score", "tokens")
    pool = ordered.attach(pool, wanted, KEYS, F.col("pos"), F.col("_last")).where(F.col("score") >= F.col("min_score"))
    ranked = ordered.cut_lineage(pool.select(*KEYS, "pos", "tokens", "budget", (-F.col("score")).alias("rank"), (-ordered.span_of(F.col("pos"))).alias("back_span"), (-F.col("pos")).alias("back")))
    return greedy.within_budget(ranked, KEYS, ["rank", "back_span"], ["rank", "back_span", "back"], "pos", "tokens", "budget", F.col("pos"))


def report(planned: DataFrame, decisions: DataFrame, groups: DataFrame, extra: DataFrame, injected: DataFrame | None, sources: DataFrame | None) -> DataFrame:
    """What recovery really sent, by the final route of each restored message (R17): one row per item."""
    named = planned.select(*KEYS, "token_budget", "closed", F.explode("items").alias("i")).select(*KEYS, "token_budget", "closed", "i.*")
    budgets = planned.select(*KEYS, "token_budget", "closed")
    scored = extra.join(ordered.merged(decisions.select(*KEYS, "pos", "turn", F.col("tokens").alias("_t"))), [*KEYS, "pos"]).join(ordered.merged(budgets), KEYS)
    scored = scored.select(
        *KEYS, "token_budget", "closed", "turn", F.lit("scored").alias("kind"), F.lit("original").alias("representation"), F.col("_t").alias("tokens"), F.lit(False).alias("skipped"), F.lit("next best match within the expansion budget").alias("why")
    )
    rows = named.unionByName(scored).join(ordered.merged(decisions.select(*KEYS, "turn", "action", "group_id", F.col("tokens").alias("_own"))), [*KEYS, "turn"])
    rows = rows.join(ordered.merged(groups.select(*KEYS, "group_id", "compressed_tokens")), [*KEYS, "group_id"], "left")
    if injected is not None:
        lines = sources.join(ordered.merged(injected.select(*KEYS, "key", "line_tokens")), [*KEYS, "key"]).groupBy(*KEYS, "turn").agg(F.sum("line_tokens").alias("_lines"))
        rows = rows.join(ordered.merged(lines), [*KEYS, "turn"], "left")
    else:
        rows = rows.withColumn("_lines", F.lit(None).cast("bigint"))
    live = ~F.col("skipped") & (F.col("representation") != "already_in_payload")
    rep = F.when(~live, F.col("representation")).when(F.col("action") == "MEMORY", "memory").when(F.col("action") == "COMPRESS", "compressed").otherwise("original")
    tokens = F.when(~live, F.col("tokens")).when(F.col("action") == "MEMORY", F.coalesce("_lines", F.lit(0))).when(F.col("action") == "COMPRESS", F.coalesce("compressed_tokens", "tokens")).otherwise(F.col("_own"))
    return rows.select(*KEYS, "token_budget", "closed", "turn", "kind", rep.alias("representation"), tokens.cast("bigint").alias("tokens"), "skipped", "why")


def report_totals(items: DataFrame) -> DataFrame:
    used = F.sum(F.when(~F.col("skipped"), F.col("tokens")).otherwise(0))
    totals = items.groupBy(*KEYS, "token_budget").agg(used.alias("used_tokens"), F.bool_or("closed").alias("_closed"), F.count("*").alias("items"))
    return totals.select(*KEYS, "token_budget", "used_tokens", "items", (F.col("_closed") | (F.col("used_tokens") > F.col("token_budget"))).alias("exceeded_by_required"))
