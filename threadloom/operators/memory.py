"""Structured memory: statements merged into one item per key.

The merge is defined as an ordered fold. It is computed here without folding a
conversation in one place: what each statement does to its item follows from
the previous statement of the same key, found with bucketed windows, and the
item is then an aggregate over those classified statements.

``keys`` names the columns that identify one memory: ``["conv_id"]`` for the
current state, ``["conv_id", "req_turn"]`` for the state before one request of
each. For all requests at once there are versions with the turns they are valid.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import ordered

CONV = ["conv_id"]
AT = ["turn", "idx"]
# From any confidence, this many repeats reach the maximum; later ones change nothing.
REPEATS_TO_MAX = 20
# States of a key while a slot's statements are followed, and the target that is not among a span's own keys.
ABSENT, INACTIVE, ACTIVE = 0, 1, 2
OTHER = -1
CATEGORY_NAMES = [name for _, name in V.CATEGORIES]


def _last_segment(key):
    return F.element_at(F.split(key, "_"), -1)


# --- M3: statements about a category join the single active item of it ---------
def resolve_keys(statements: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Replace ``key`` by the key of the item the statement applies to.

    Only categories for which a memory holds two or more different raw keys can
    redirect. Of those, repeats of the same key and operation follow their
    predecessor, so only the first statement of each repeat, a head, is followed.
    """
    canonical = T.canonical_key(F.col("key"))
    named = statements.withColumn("key", F.when(canonical != "", canonical).otherwise(F.col("key"))).withColumn("_cat", _last_segment(F.col("key")))
    named = ordered.cut_lineage(named)
    slot = [*keys, "_cat"]
    shared = (
        named.where(F.col("_cat").isin(CATEGORY_NAMES))
        .groupBy(*slot)
        .agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(*slot)
    )
    coupled = ordered.cut_lineage(named.join(ordered.merged(shared), slot, "left_semi").withColumn("_span", ordered.span_of(F.col("turn"))))
    if coupled.isEmpty():
        return named.drop("_cat")
    what = F.struct("key", "op")
    marked = ordered.cut_lineage(ordered.carry(coupled, slot, ["_span"], AT, what, "_prev", include_row=False))
    heads = marked.where(F.col("_prev").isNull() | (F.col("_prev") != what)).select(*slot, *AT, "key", "op")
    targeted = ordered.cut_lineage(marked.drop("_prev").join(ordered.merged(_walk_heads(heads, slot)), [*slot, *AT], "left"))
    followed = ordered.carry(targeted, slot, ["_span"], AT, F.col("_target"), "_to", include_row=True)
    redirected = followed.withColumn("key", F.col("_to")).drop("_cat", "_span", "_target", "_to")
    alone = named.join(ordered.merged(shared), slot, "left_anti").drop("_cat")
    return ordered.cut_lineage(alone.unionByName(redirected))


def _walk_heads(heads: DataFrame, slot: list[str]) -> DataFrame:
    """The key each head applies to (``_target``), for slots cut into spans that are followed at once.

    Each span starts from a state: which of its keys exist or are active, how many other items
    are active, and which one if it is the only one. The first pass starts all spans empty; what
    they end with gives the state the next span really starts from, and spans that started from
    another are followed again until none is left. The first n spans are right after n passes;
    once all keys exist, a span's end hardly depends on its start, so a few passes do.
    """
    spans = heads.withColumn("_span", ordered.span_of(F.col("turn"))).groupBy(*slot, "_span").agg(
        F.array_sort(F.collect_list(F.struct(*AT, "key", "op"))).alias("_heads"), F.array_sort(F.collect_set("key")).alias("_keys")
    )
    nothing = {"_before": F.transform("_keys", lambda k: F.lit(ABSENT)), "_others": F.lit(0), "_other": F.lit(None).cast("string")}
    walked = ordered.cut_lineage(_follow(spans.withColumns(nothing)))
    several = walked.groupBy(*slot).count().where("count > 1").select(*slot)
    if not several.isEmpty():
        single = walked.join(ordered.merged(several), slot, "left_anti")
        walked = ordered.cut_lineage(walked.join(ordered.merged(several), slot, "left_semi"))
        while True:
            real = ordered.cut_lineage(_states_before(walked, slot))
            same = F.col("_before") == F.col("_was")
            same &= (F.col("_others") == F.col("_others_was")) & F.col("_other").eqNullSafe(F.col("_other_was"))
            if real.where(~same).isEmpty():
                break
            walked = ordered.cut_lineage(_follow(real.drop("_was", "_others_was", "_other_was")))
        walked = single.unionByName(walked)
    target = F.when(F.col("_to") == OTHER, F.col("_other")).otherwise(F.get("_keys", F.col("_to")))
    rows = walked.select(*slot, "_keys", "_other", F.explode(F.arrays_zip("_heads", "_targets")).alias("_h"))
    rows = rows.select(*slot, "_keys", "_other", *[F.col(f"_h._heads.{c}").alias(c) for c in AT], F.col("_h._targets").alias("_to"))
    return rows.select(*slot, *AT, target.alias("_target"))


def _follow(spans: DataFrame) -> DataFrame:
    """Follow the heads of each span from its start (``_before``, ``_others``): ``_targets`` of the heads
    (place in ``_keys``, or OTHER), ``_after`` and whether the one other active item was removed."""
    places = F.transform("_heads", lambda h: F.struct((F.array_position("_keys", h["key"]) - 1).cast("int").alias("p"), (h["op"] == "remove").alias("off")))
    start = F.struct(F.col("_before").alias("s"), F.col("_others").alias("o"), F.array().cast("array<int>").alias("t"))

    def step(acc, h):
        alive = F.size(F.filter(acc["s"], lambda x: x == ACTIVE)) + acc["o"]
        only = F.when(acc["o"] == 1, F.lit(OTHER)).otherwise(F.array_position(acc["s"], ACTIVE).cast("int") - 1)
        to = F.when((F.get(acc["s"], h["p"]) != ABSENT) | (alive != 1), h["p"]).otherwise(only)

        def applied(to):
            changed = lambda x: F.when(~h["off"], ACTIVE).when(x == ABSENT, ABSENT).otherwise(INACTIVE)
            return F.struct(
                F.transform(acc["s"], lambda x, i: F.when(i == to, changed(x)).otherwise(x)).alias("s"),
                F.when((to == OTHER) & h["off"], 0).otherwise(acc["o"]).alias("o"),
                F.concat(acc["t"], F.array(to)).alias("t"),
            )

        return T.let(to, applied)

    followed = spans.withColumn("_r", F.aggregate(places, start, step))
    removed = (F.col("_others") == 1) & (F.col("_r.o") == 0)
    return followed.withColumns({"_after": F.col("_r.s"), "_targets": F.col("_r.t"), "_removed": removed}).drop("_r")


def _states_before(walked: DataFrame, slot: list[str]) -> DataFrame:
    """The same spans with the states that the spans before them end with; the states assumed so far in ``_was`` columns."""
    code = F.xxhash64("key").cast("decimal(38,0)")
    own = walked.select(*slot, "_span", F.explode(F.arrays_zip(F.col("_keys").alias("key"), F.col("_after").alias("after"))).alias("k")).select(*slot, "_span", "k.*", F.lit(True).alias("own"))
    gone = walked.where("_removed").select(*slot, "_span", F.col("_other").alias("key"), F.lit(INACTIVE).alias("after"), F.lit(False).alias("own"))
    # a row for each span a key occurs in
    rows = own.unionByName(gone).withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(*slot, "key").orderBy("_span")), F.lit(ABSENT)))
    rows = rows.withColumn("code", code)
    change = (F.col("after") == ACTIVE).cast("int") - (F.col("before") == ACTIVE).cast("int")
    mine = (F.col("own") & (F.col("before") == ACTIVE)).cast("int")
    spans = rows.groupBy(*slot, "_span").agg(
        F.sum(change).alias("_n"), F.sum(change * F.col("code")).alias("_codes"), F.sum(mine).alias("_mine"), F.sum(mine * F.col("code")).alias("_my_codes"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("key", "before")))).getField("before").alias("_before"),
    )
    # a row for each span of the slot; the sum of the codes of one item is its code
    along = Window.partitionBy(*slot).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    others = spans.select(*slot, "_span", "_before", (earlier("_n") - F.col("_mine")).cast("int").alias("_others"), (earlier("_codes") - F.col("_my_codes")).alias("_code"))
    names = rows.select(*slot, F.col("code").alias("_code"), F.col("key").alias("_other")).distinct()
    others = others.withColumn("_code", F.when(F.col("_others") == 1, F.col("_code").cast("decimal(38,0)"))).join(ordered.merged(names), [*slot, "_code"], "left").drop("_code")
    others = others.withColumn("_others", F.least("_others", F.lit(2)))
    kept = walked.select(*slot, "_span", "_heads", "_keys", F.col("_before").alias("_was"), F.col("_others").alias("_others_was"), F.col("_other").alias("_other_was"))
    return kept.join(ordered.merged(others), [*slot, "_span"])


# --- M4: what each statement does ------------------------------------------------
def memory_events(statements: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Every statement with its ``change`` (created, updated, unchanged, removed or ignored),

    the value it replaced and ``run_at``, the statement that set the current value.
    """
    item = [*keys, "key"]
    events = resolve_keys(statements, keys).withColumns({"_span": ordered.span_of(F.col("turn")), "_low": F.lower("value")})
    events = ordered.carry(events, item, ["_span"], AT, F.struct("op", "_low"), "_prev", include_row=False)
    was_active = F.coalesce(F.col("_prev.op") == "set", F.lit(False))
    events = events.withColumn(
        "change",
        F.when(F.col("op") == "remove", F.when(was_active, "removed").otherwise("ignored"))
        .when(~was_active, "created")
        .when(F.col("_prev._low") == F.col("_low"), "unchanged")
        .otherwise("updated"),
    )
    events = ordered.cut_lineage(events.drop("_prev", "_low"))
    starts = F.when(F.col("change").isin("created", "updated"), F.struct(F.struct(*AT).alias("at"), "value"))
    events = ordered.carry(events, item, ["_span"], AT, starts, "_before", include_row=False)
    classified = events.select(
        *item,
        *AT,
        "value",
        "type",
        "confidence",
        "op",
        "change",
        F.when(F.col("change") == "updated", F.col("_before.value")).alias("previous_value"),
        F.when(F.col("change").isin("created", "updated"), F.struct(*AT)).otherwise(F.col("_before.at")).alias("run_at"),
        F.when(F.col("change").isin("created", "updated"), F.col("value")).otherwise(F.col("_before.value")).alias("item_value"),
    )
    return ordered.cut_lineage(classified)


def memory_items(events: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Current item per key. Sources and earlier values are counted here and listed row by row
    in :func:`memory_sources` and :func:`memory_history`, so no item row grows with its history."""
    item = [*keys, "key"]
    at = F.struct(*AT)
    starts = F.col("change").isin("created", "updated")
    applied = F.col("change") != "ignored"
    items = events.groupBy(*item).agg(
        F.max_by(F.struct(at.alias("at"), "value", "type", "confidence"), F.when(starts, at)).alias("s"),
        (F.max_by("op", at) == "set").alias("active"),
        F.min(F.when(F.col("change") == "created", at)).alias("created_at"),
        F.count_distinct(F.when(applied, F.col("turn"))).alias("n_sources"),
        F.min(F.when(applied, F.col("turn"))).alias("first_source"),
        F.max(F.when(applied, F.col("turn"))).alias("last_source"),
        F.count_if(F.col("change") == "updated").alias("n_previous"),
    )
    items = items.where(F.col("created_at").isNotNull())
    first = Window.partitionBy(*item, "run_at").orderBy(*AT)
    repeats = (
        events.where(F.col("change") == "unchanged")
        .select(*item, "run_at", *AT, "confidence", F.row_number().over(first).alias("n"))
        .where(F.col("n") <= REPEATS_TO_MAX)
        .groupBy(*item, "run_at")
        .agg(F.array_sort(F.collect_list(F.struct("n", "confidence"))).alias("repeats"))
    )
    step = F.lit(V.CONFIDENCE_STEP)
    raised = F.aggregate(
        F.coalesce("repeats", F.array().cast("array<struct<n:int,confidence:double>>")),
        F.col("s.confidence"),
        lambda acc, r: F.least(F.lit(V.CONFIDENCE_MAX), F.greatest(acc, r["confidence"]) + step),
    )
    return (
        items.withColumn("run_at", F.col("s.at"))
        .join(ordered.merged(repeats), [*item, "run_at"], "left")
        .select(
            *item,
            F.col("s.value").alias("value"),
            F.col("s.type").alias("type"),
            raised.alias("confidence"),
            "active",
            "created_at",
            "n_sources",
            "first_source",
            "last_source",
            "n_previous",
        )
    )


def memory_sources(events: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Messages behind each item, one row per (item, source message)."""
    return events.where(F.col("change") != "ignored").select(*keys, "key", "turn").distinct()


def memory_history(events: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Superseded values, one row per replacement."""
    return events.where(F.col("change") == "updated").select(*keys, "key", *AT, "previous_value")


def memory_changes(events: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """The change each message made to each item (M5): its last real change, else "unchanged"."""
    real = F.when(F.col("change") != "unchanged", F.col("idx"))
    fields = F.struct("change", F.col("item_value").alias("value"), "previous_value")
    return (
        events.where(F.col("change") != "ignored")
        .groupBy(*keys, "turn", "key")
        .agg(F.coalesce(F.max_by(fields, real), F.max_by(fields, "idx")).alias("c"))
        .select(*keys, "turn", "key", "c.*")
    )


def memory_versions(events: DataFrame) -> DataFrame:
    """State of each item of a conversation after every turn that touched it, valid until the next such turn (NULL: still).

    One row per touched turn and item, however many requests look at it. Confidence in closed form: after
    n repeats it is n steps above the largest of its start and of each repeat's own less the steps before it.
    """
    item = [*CONV, "key"]
    starts = F.col("change").isin("created", "updated")
    repeat = F.col("change") == "unchanged"
    rows = events.where(F.col("change") != "ignored").withColumn("_span", ordered.span_of(F.col("turn")))
    rows = ordered.running_sums(rows, [*item, "run_at"], ["_span"], AT, {"_n": repeat.cast("int")})
    own = F.when(starts, F.col("confidence")).when(repeat, F.col("confidence") - F.lit(V.CONFIDENCE_STEP) * (F.col("_n") - 1))
    rows = ordered.running_max(rows, [*item, "run_at"], ["_span"], AT, own, "_base")
    rows = ordered.carry(rows, item, ["_span"], AT, F.when(starts, F.col("type")), "_type", include_row=True)
    raised = F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.least(F.lit(V.CONFIDENCE_MAX), F.col("_base") + F.lit(V.CONFIDENCE_STEP) * F.col("_n")))
    state = F.struct(F.col("item_value").alias("value"), F.col("_type").alias("type"), raised.alias("confidence"), (F.col("op") == "set").alias("active"))
    turns = ordered.cut_lineage(rows.groupBy(*item, "turn", "_span").agg(F.max_by(state, "idx").alias("s")).select(*item, "turn", "_span", "s.*"))
    turns = ordered.positions(turns, item, ["_span"], ["turn"], "n_sources", start=1)
    return ordered.following(turns, item, ["_span"], ["turn"], F.col("turn"), "until").drop("_span")


def memory_for_requests(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The versions of :func:`memory_versions` that a request sees, with the first and last such request and their number.

    A request sees the version that is valid before its turn, so each serves a stretch of neighbouring requests:
    the result grows with the changes, not with requests times items. ``requests``: conv_id, req_turn, many per conversation.
    """
    asked = requests.select("conv_id", F.col("req_turn").alias("turn")).distinct().withColumn("_span", ordered.span_of(F.col("turn")))
    asked = ordered.cut_lineage(ordered.positions(asked, CONV, ["_span"], ["turn"], "nth"))
    # number of requests up to each turn that touched an item, the request of the same turn included
    points = asked.select("conv_id", "turn", "_span", F.lit(0).alias("_kind")).unionByName(
        versions.select("conv_id", "turn", ordered.span_of(F.col("turn")).alias("_span"), F.lit(1).alias("_kind")).distinct()
    )
    counted = ordered.running_sums(points, CONV, ["_span"], ["turn", "_kind"], {"_seen": (F.col("_kind") == 0).cast("int")})
    counted = ordered.cut_lineage(counted.where("_kind = 1").select("conv_id", "turn", "_seen"))
    totals = asked.groupBy("conv_id").agg(F.count("*").alias("_all"))
    rows = versions.join(ordered.merged(counted.withColumnRenamed("_seen", "_from")), ["conv_id", "turn"])
    rows = rows.join(ordered.merged(counted.select("conv_id", F.col("turn").alias("until"), F.col("_seen").alias("_to"))), ["conv_id", "until"], "left")
    rows = ordered.attach_present(rows, totals, CONV, F.col("turn"), "inner").withColumn("_to", F.coalesce("_to", "_all"))
    rows = rows.where(F.col("_to") > F.col("_from"))
    place = lambda name: asked.select("conv_id", F.col("nth").alias(f"_{name}"), F.col("turn").alias(name))
    rows = rows.withColumns({"_first_request": F.col("_from"), "_last_request": F.col("_to") - 1})
    rows = rows.join(ordered.merged(place("first_request")), ["conv_id", "_first_request"]).join(ordered.merged(place("last_request")), ["conv_id", "_last_request"])
    return rows.select(
        "conv_id", "key", "value", "type", "confidence", "active", "n_sources", "turn", "until", "first_request", "last_request", (F.col("_to") - F.col("_from")).alias("n_requests")
    )


def memory_sizes(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Active items, and the tokens of their lines, before each request: running sums of what every version changes."""
    cost = F.when(F.col("active"), line_tokens()).otherwise(0)
    begin = versions.select("conv_id", "turn", F.lit(1).alias("_kind"), F.col("active").cast("int").alias("n"), cost.alias("tokens"))
    end = versions.where(F.col("until").isNotNull()).select("conv_id", F.col("until").alias("turn"), F.lit(1).alias("_kind"), (-F.col("active").cast("int")).alias("n"), (-cost).alias("tokens"))
    asked = requests.select("conv_id", F.col("req_turn").alias("turn"), F.lit(0).alias("_kind"), F.lit(0).alias("n"), F.lit(0).alias("tokens")).distinct()
    points = begin.unionByName(end).unionByName(asked).groupBy("conv_id", "turn", "_kind").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    points = points.withColumn("_span", ordered.span_of(F.col("turn")))
    summed = ordered.running_sums(points, CONV, ["_span"], ["turn", "_kind"], {"active_items": F.col("n"), "line_tokens": F.col("tokens")})
    return summed.where("_kind = 0").select("conv_id", F.col("turn").alias("req_turn"), "active_items", "line_tokens")


def memory_before_requests(statements: DataFrame, requests: DataFrame) -> DataFrame:
    """Statements made before each request, keyed for a memory per request (M9)."""
    wanted = requests.select("conv_id", "req_turn")
    return ordered.attach(statements, wanted, CONV, F.col("turn"), F.col("req_turn")).where(F.col("turn") < F.col("req_turn"))


# --- M6 ---------------------------------------------------------------------------
def line() -> "F.Column":
    return F.concat_ws(": ", "key", "value")


def line_tokens():
    return T.text_tokens(line()) + 1


def block_tokens(total_length, n_items):
    """Cost of a block as one message, from the summed line lengths."""
    chars = F.lit(len(V.MEMORY_BLOCK_HEADER)) + total_length + n_items
    return F.ceil(chars / V.CHARS_PER_TOKEN).cast("bigint") + V.MESSAGE_OVERHEAD


def memory_lines(items: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Lines of each memory block as rows."""
    return items.where("active").select(*keys, "created_at", line().alias("line"), line_tokens().alias("line_tokens"))


def memory_block(items: DataFrame, keys: list[str] = CONV) -> DataFrame:
    """Size and text of each memory block: one line per active item, in order of creation.

    The text is one value because it is sent as one entry; :func:`memory_lines` has the same lines as rows.
    """
    lines = memory_lines(items, keys)
    sizes = lines.groupBy(*keys).agg(
        F.count("*").alias("n_items"), F.sum("line_tokens").alias("line_tokens"), F.sum(F.length("line")).alias("_chars")
    )
    sizes = sizes.select(*keys, "n_items", "line_tokens", block_tokens(F.col("_chars"), F.col("n_items")).alias("block_tokens"))
    body = (
        lines.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("created_at", "line"))).alias("ls"))
        .select(*keys, F.concat(F.lit(V.MEMORY_BLOCK_HEADER + "\n"), F.array_join(F.col("ls").getField("line"), "\n")).alias("block"))
    )
    return sizes.join(ordered.merged(body), keys, "left")


def memory_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if("active").alias("active_items"), F.count("*").alias("all_items"), F.sum("n_previous").alias("superseded_values"))
