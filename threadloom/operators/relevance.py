"""How relevant is each earlier message, and each memory item, to a request?

A request is one row ``conv_id, req_turn, n, request``; ``n`` is the length of
its history. By default each conversation contributes its latest request, so
the history table has one row per message. Every row-to-request join goes
through ``ordered.attach``, which spreads a hot conversation over its spans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.operators import annotate, ordered

KEYS = ["conv_id", "req_turn"]
LOGISH = ["log", "tool_output"]
AFTER_OWN_TERMS = 1_000_000


# --- inputs ---------------------------------------------------------------------
def digest(c: Column) -> Column:
    """The first 16 bytes of a string's SHA-256: equal strings have equal ones, and rows that are moved often stay short."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def message_features(annotated: DataFrame) -> DataFrame:
    """Everything later steps need to know about a message, except its text.

    Signatures are kept as hashes so that joins and groups move short keys.
    """
    text, role = F.col("text"), F.col("role")
    staged = annotated.withColumn("_sig", T.signature(text))
    return staged.select(
        "conv_id",
        "turn",
        "pos",
        "role",
        "tokens",
        "content_type",
        "class_method",
        "memory_complete",
        F.col("protection").isNotNull().alias("protected"),
        F.col("protection.level").alias("level"),
        F.col("protection.reason").alias("protection_reason"),
        F.col("protection.method").alias("protection_method"),
        digest(F.concat_ws("|", role, "_sig")).alias("sig"),
        F.when(F.col("content_type").isin(LOGISH), digest(F.concat_ws("|", role, T.template_signature(F.col("_sig"))))).alias("template"),
        F.when(F.col("content_type").isin(LOGISH), T.primary_event(text)).alias("event"),
        T.needs_exact_wording(text).alias("exact_wording"),
        T.error_evidence(text).alias("evidence"),
        T.pasted_output(text).alias("pasted"),
        T.terms(text).alias("doc_terms"),
    )


def latest_requests(messages: DataFrame) -> DataFrame:
    """The newest user message of each conversation that has a history."""
    asked = messages.where((F.col("role") == "user") & (F.col("pos") > 0))
    last = asked.groupBy("conv_id").agg(F.max_by(F.struct("turn", "pos", "text"), "pos").alias("r"))
    return last.select("conv_id", F.col("r.turn").alias("req_turn"), F.col("r.pos").alias("n"), F.col("r.text").alias("request"))


def all_requests(messages: DataFrame) -> DataFrame:
    """Every user message that has a history, many per conversation."""
    asked = messages.where((F.col("role") == "user") & (F.col("pos") > 0))
    return asked.select("conv_id", F.col("turn").alias("req_turn"), F.col("pos").alias("n"), F.col("text").alias("request"))


def request_features(requests: DataFrame) -> DataFrame:
    text = F.col("request")
    staged = requests.withColumns({"request_terms": T.terms(text), "important": T.important_terms(text), "_words": T.reference_words(text)})
    return staged.select(
        *requests.columns,
        "request_terms",
        "important",
        T.text_tokens(text).alias("request_tokens"),
        T.request_task(text).alias("task"),
        T.key_terms(text).alias("key_terms"),
        T.is_follow_up(text).alias("follow_up"),
        T.mentions_recall(text).alias("recall"),
        T.mentions_earlier(text).alias("earlier"),
        T.detect_reference(F.col("_words")).alias("reference"),
    )


def history(features: DataFrame, requests: DataFrame, *request_columns: str) -> DataFrame:
    """Each request's earlier messages (J1), with the named request columns."""
    wanted = requests.select(*KEYS, "n", *request_columns)
    return ordered.attach(features, wanted, ["conv_id"], F.col("pos"), F.col("n") - 1).where(F.col("pos") < F.col("n"))


# --- term matching (J2) -----------------------------------------------------------
def _prefix(t: Column) -> Column:
    return F.substring(t, 1, V.PREFIX_MATCH_MIN)


def _matches(query: Column, doc: Column) -> Column:
    """Query terms that match the document. Two matching terms share their first five
    characters, so one set intersection leaves few terms to compare."""

    def near_terms(shared):
        near = F.filter(doc, lambda d: F.array_contains(shared, _prefix(d)))
        return F.when(F.size(shared) == 0, F.array().cast("array<string>")).otherwise(near)

    shared = F.array_intersect(F.transform(query, _prefix), F.transform(doc, _prefix))
    return T.let(T.let(shared, near_terms), lambda near: T.matched_terms(query, near))


def query_terms(requests: DataFrame, hist: DataFrame) -> DataFrame:
    """Terms that drive retrieval: the request's own, and the other terms of critical
    messages that touch the request, at reduced weight (A2). One row per term."""
    own = requests.select(*KEYS, "n", "important", F.posexplode("request_terms").alias("rank", "term"), F.lit(False).alias("expansion"))
    critical = hist.where((F.col("level") == "critical") & (F.size("matched_own") > 0))
    untouched = F.filter("doc_terms", lambda d: ~F.exists("request_terms", lambda q: T.term_match(q, d)))
    lent = critical.select(*KEYS, F.explode(untouched).alias("term")).distinct()
    lent = lent.join(ordered.merged(requests.select(*KEYS, "n", "important")), KEYS).select(
        *KEYS, "n", "important", F.lit(AFTER_OWN_TERMS).alias("rank"), "term", F.lit(True).alias("expansion")
    )
    return own.unionByName(lent)


def term_matches(hist: DataFrame, terms: DataFrame) -> DataFrame:
    """(request, message, query term) pairs that match; only matching pairs are produced."""
    own = hist.select(*KEYS, "pos", F.explode("matched_own").alias("term"))
    lent = terms.where("expansion").select(*KEYS, "n", "term", _prefix(F.col("term")).alias("_p"))
    reached = ordered.attach(
        hist.select(*KEYS, "pos", "doc_terms"), lent.select(*KEYS, "n").distinct(), KEYS, F.col("pos"), F.col("n") - 1
    )
    words = reached.select(*KEYS, "pos", F.explode("doc_terms").alias("d")).withColumn("_p", _prefix(F.col("d")))
    spread = lent.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("bigint"), ordered.span_of(F.col("n") - 1)))).drop("n")
    extra = (
        words.withColumn("_span", ordered.span_of(F.col("pos")))
        .join(ordered.merged(spread), [*KEYS, "_span", "_p"])
        .where(T.term_match(F.col("term"), F.col("d")))
        .select(*KEYS, "pos", "term")
        .distinct()
    )
    return own.unionByName(extra)


def _generic(term: Column) -> Column:
    words = F.array(*[F.lit(g) for g in V.GENERIC_TERMS])
    normal = T.stem_alias(term)
    return F.exists(words, lambda g: T.term_match(g, normal) | T.term_match(g, term))


def term_weights(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weight of each query term from its document frequency in the history (A1, A3)."""
    df = pairs.groupBy(*KEYS, "term").agg(F.count("*").alias("df"))
    weighted = terms.join(ordered.merged(df), [*KEYS, "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.pow(F.log1p((F.col("n") + 1) / (F.col("df") + 1)), F.lit(2.0))
    one = F.lit(1.0)
    weight = (
        idf
        * F.when(F.col("expansion"), V.EXPANSION_WEIGHT).otherwise(one)
        * F.when(F.array_contains("important", F.col("term")), V.IMPORTANT_TERM_WEIGHT).otherwise(one)
        * F.when(_generic(F.col("term")), V.GENERIC_WEIGHT).otherwise(one)
    )
    return weighted.select(*KEYS, "n", "rank", "term", "expansion", "df", weight.alias("weight"))


def total_weights(weights: DataFrame) -> DataFrame:
    own = F.coalesce(F.sum(F.when(~F.col("expansion"), F.col("weight"))), F.lit(0.0))
    return weights.groupBy(*KEYS).agg(own.alias("_w")).select(*KEYS, F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_w")).alias("total_weight"))


def overlap(pairs: DataFrame, weights: DataFrame, totals: DataFrame, row: str, position: Column) -> DataFrame:
    """Matched share of the request's weight per row (A4)."""
    facts = weights.join(ordered.merged(totals), KEYS).select(*KEYS, "n", "rank", "term", "weight", "total_weight")
    matched = ordered.attach(pairs, facts, [*KEYS, "term"], position, F.col("n"))
    return matched.groupBy(*KEYS, row).agg(
        F.least(F.lit(1.0), F.sum("weight") / F.first("total_weight")).alias("overlap"),
        F.array_sort(F.collect_list(F.struct("rank", "term"))).getField("term").alias("matched"),
    )


# --- memory scores (M7, M8) ---------------------------------------------------------
def memory_scores(items: DataFrame, requests: DataFrame, weights: DataFrame, totals: DataFrame) -> DataFrame:
    """Score of each memory item of each request: the better of request overlap and item coverage."""
    at = F.col("created_at.turn")
    terms = T.terms(F.concat_ws(" ", F.regexp_replace("key", "_", " "), "value"))
    rows = ordered.attach(items, requests.select(*KEYS, "n", "request_terms"), KEYS, at, F.col("req_turn"))
    rows = rows.withColumn("item_terms", terms).withColumns(
        {"matched_own": _matches(F.col("request_terms"), F.col("item_terms")), "hits": F.size(_matches(F.col("item_terms"), F.col("request_terms")))}
    )
    lent = weights.where("expansion").select(*KEYS, "n", "term", _prefix(F.col("term")).alias("_p"))
    own = rows.select(*KEYS, "key", at.alias("at"), F.explode("matched_own").alias("term"))
    words = rows.select(*KEYS, "key", at.alias("at"), F.explode("item_terms").alias("d")).withColumn("_p", _prefix(F.col("d")))
    spread = lent.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("bigint"), ordered.span_of(F.col("req_turn"))))).drop("n")
    near = words.withColumn("_span", ordered.span_of(F.col("at"))).join(ordered.merged(spread), [*KEYS, "_span", "_p"])
    extra = near.where(T.term_match(F.col("term"), F.col("d"))).select(*KEYS, "key", "at", "term").distinct()
    facts = weights.withColumn("n", F.col("req_turn"))
    shared = overlap(own.unionByName(extra), facts, totals, "key", F.col("at")).drop("matched")
    size = F.size("item_terms")
    share = F.col("hits") / size
    coverage = F.when((size > 0) & (share >= 0.5) & ((F.col("hits") >= 2) | (size == 1)), share).otherwise(0.0)
    return (
        rows.join(ordered.merged(shared), [*KEYS, "key"], "left")
        .withColumn("coverage", coverage)
        .select(*items.columns, "coverage", F.greatest(F.coalesce("overlap", F.lit(0.0)), "coverage").alias("memory_score"))
    )


# --- scores (A5, J3, J4, W1) ----------------------------------------------------------
def _type_factor(content_type: Column) -> Column:
    out = None
    for kind, factor in V.TYPE_FACTOR.items():
        out = F.when(content_type == kind, factor) if out is None else out.when(content_type == kind, factor)
    return out


def own_matches(features: DataFrame, requests: DataFrame) -> DataFrame:
    """History rows with the request terms each message matches."""
    rows = history(features, requests, "request_terms")
    return rows.withColumn("matched_own", _matches(F.col("request_terms"), F.col("doc_terms")))


def pair_scores(rows: DataFrame) -> DataFrame:
    """Neighbour whose score a question or answer inherits (J3); needs pos, role, protected and overlap."""
    strong = rows.where(~F.col("protected") & (F.col("overlap") >= V.PAIR_MIN_SCORE)).select(
        *KEYS, F.col("pos").alias("_npos"), F.col("role").alias("_nrole"), F.col("turn").alias("_nturn"), (F.col("overlap") * V.PAIR_DECAY).alias("_lent")
    )
    wanted = rows.withColumn("_npos", F.when(F.col("role") == "user", F.col("pos") + 1).otherwise(F.col("pos") - 1))
    joined = wanted.join(ordered.merged(strong), [*KEYS, "_npos"], "left")
    takes = ~F.col("protected") & (F.col("_nrole") != F.col("role")) & (F.col("_lent") > F.col("overlap"))
    return joined.withColumns(
        {
            "lexical": F.when(takes, F.col("_lent")).otherwise(F.col("overlap")),
            "paired_with": F.when(takes, F.col("_nturn")),
        }
    ).drop("_npos", "_nrole", "_nturn", "_lent")


def score(features: DataFrame, requests: DataFrame, items: DataFrame | None = None, sources: DataFrame | None = None, external: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Scores of all history rows, and of the memory items when given.

    ``items`` / ``sources``: memory before each request, keyed by conv_id and req_turn.
    ``external``: conv_id, req_turn, turn, score rows selected by meaning (V10).
    """
    requests = requests.where(F.col("n") > 0)
    rows = ordered.cut_lineage(own_matches(features, requests))
    terms = query_terms(requests, rows)
    pairs = term_matches(rows, terms)
    weights = ordered.cut_lineage(term_weights(terms, pairs))
    totals = total_weights(weights)
    lexical = overlap(pairs, weights, totals, "pos", F.col("pos"))
    rows = rows.drop("doc_terms", "request_terms", "matched_own").join(ordered.merged(lexical), [*KEYS, "pos"], "left")
    rows = rows.withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "matched": F.coalesce("matched", F.array().cast("array<string>"))})
    rows = pair_scores(rows)
    item_scores = None
    if items is not None:
        item_scores = ordered.cut_lineage(memory_scores(items, requests, weights, totals))
        active = item_scores.where("active").select(*KEYS, "key", "memory_score")
        of_message = (
            ordered.attach_present(sources, active, [*KEYS, "key"], F.col("turn"), "inner")
            .groupBy(*KEYS, "turn")
            .agg(F.max("memory_score").alias("memory_of_message"))
        )
        rows = rows.join(ordered.merged(of_message), [*KEYS, "turn"], "left")
    else:
        rows = rows.withColumn("memory_of_message", F.lit(None).cast("double"))
    if external is not None:
        rows = rows.join(ordered.merged(external.select(*KEYS, "turn", F.col("score").alias("_semantic"))), [*KEYS, "turn"], "left")
    else:
        rows = rows.withColumn("_semantic", F.lit(None).cast("double"))
    return _combine(rows), item_scores


def _combine(rows: DataFrame) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    mem = F.coalesce("memory_of_message", zero)
    staged = rows.withColumns(
        {
            "type_factor": _type_factor(F.col("content_type")),
            "_mem": F.when(mem >= V.MEMORY_MATCH, F.least(one, mem)).otherwise(zero),
            "_importance": F.when(F.col("protected"), 1.0)
            .when(F.col("memory_of_message").isNotNull(), 0.6)
            .when(F.col("content_type").isin("decision", "constraint", "preference"), 0.5)
            .otherwise(0.2),
            "_recency": F.pow(F.lit(0.5), (F.col("n") - 1 - F.col("pos")) / V.RECENCY_HALF_LIFE),
            "_sem": F.coalesce("_semantic", zero),
        }
    ).withColumn("_lex", F.least(one, F.col("lexical") * F.col("type_factor")))
    gate = F.when((F.col("_lex") > 0) | (F.col("_mem") > 0), one).otherwise(zero)
    combined = F.least(one, F.col("_lex") + 0.15 * F.col("_mem") + gate * (0.06 * F.col("_importance") + 0.06 * F.col("_recency")))
    r = lambda c: T.js_round(F.col(c), 2)
    return staged.select(
        *[c for c in rows.columns if c not in ("memory_of_message", "_semantic", "overlap", "lexical")],
        T.js_round(F.greatest("_sem", combined), 2).alias("score"),
        F.struct(
            r("lexical").alias("lexical"),
            "type_factor",
            r("_importance").alias("importance"),
            r("_recency").alias("recency"),
            r("_mem").alias("memory"),
            r("_sem").alias("semantic"),
        ).alias("signals"),
    )


# --- prefix totals for every request (T1, W2) ------------------------------------------
def history_tokens(messages: DataFrame) -> DataFrame:
    """Per user message: length and estimated size of everything before it, plus the request itself.

    Texts are measured in one scan; the two passes of the running sum read only the measured rows.
    """
    rows = messages.select("conv_id", "turn", "role", T.text_tokens(F.col("text")).alias("_own"), ordered.span_of(F.col("turn")).alias("_span"))
    sums = {"history_messages": F.lit(1), "_before": F.col("_own") + V.MESSAGE_OVERHEAD}
    summed = ordered.running_sums(ordered.cut_lineage(rows), ["conv_id"], ["_span"], ["turn"], sums, include_row=False)
    return summed.where((F.col("role") == "user") & (F.col("history_messages") > 0)).select(
        "conv_id", F.col("turn").alias("req_turn"), F.col("history_messages").cast("bigint").alias("history_messages"), (F.col("_before") + F.col("_own")).alias("original_tokens")
    )


def continuity(rows: DataFrame) -> DataFrame:
    """The last two unprotected messages of each request, unless either is too large (W2)."""
    newest = F.row_number().over(ordered.Window.partitionBy(*KEYS).orderBy(F.desc("pos")))
    last = rows.where(~F.col("protected")).select(*KEYS, "pos", "tokens", newest.alias("_rn")).where(F.col("_rn") <= V.CONTINUITY_MESSAGES)
    pair = last.groupBy(*KEYS).agg(F.max("tokens").alias("_largest"), F.collect_list("pos").alias("_at"))
    return pair.where(F.col("_largest") <= V.CONTINUITY_MAX_TOKENS).select(*KEYS, F.explode("_at").alias("pos"))


def antecedents(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest block of compatible user messages for requests that refer to one (W3).

    At most the last twelve messages of a request are gathered, so the fold is over a short array.
    """
    asks = requests.where(F.col("reference").isNotNull()).select(*KEYS, F.col("reference.kind").alias("kind"), F.col("reference.phrase").alias("phrase"))
    window = rows.where((F.col("pos") >= F.col("n") - V.ANTECEDENT_WINDOW) & (F.col("role") == "user")).join(ordered.merged(asks), KEYS)
    window = window.withColumn("ok", annotate.compatible_antecedent(F.col("kind"), F.col("role"), F.col("content_type"), F.col("evidence"), F.col("pasted")))
    # newest first
    lists = window.groupBy(*KEYS, "kind", "phrase").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("back"), "ok", "tokens"))).alias("ms")
    )
    none = F.array().cast("array<bigint>")
    start = F.struct(
        F.lit(False).alias("started"), F.lit(False).alias("ended"), none.alias("candidates"), none.alias("picked"), F.lit(V.ANTECEDENT_MAX_TOKENS).cast("bigint").alias("budget")
    )

    def step(acc, m):
        open_ = ~acc["ended"]
        hit = open_ & m["ok"]
        fits = (F.size(acc["picked"]) < V.ANTECEDENT_MAX_MESSAGES) & ((F.size(acc["picked"]) == 0) | (m["tokens"] <= acc["budget"]))
        take = hit & fits
        return F.struct(
            (acc["started"] | hit).alias("started"),
            (acc["ended"] | (acc["started"] & ~m["ok"])).alias("ended"),
            F.when(hit, F.array_append(acc["candidates"], -m["back"])).otherwise(acc["candidates"]).alias("candidates"),
            F.when(take, F.array_append(acc["picked"], -m["back"])).otherwise(acc["picked"]).alias("picked"),
            F.when(take, acc["budget"] - m["tokens"]).otherwise(acc["budget"]).alias("budget"),
        )

    folded = lists.withColumn("r", F.aggregate("ms", start, step))
    return folded.select(*KEYS, "kind", "phrase", F.col("r.candidates").alias("candidates"), F.array_sort("r.picked").alias("selected"))

