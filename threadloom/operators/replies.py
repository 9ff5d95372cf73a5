"""Replies to classification, summary and retrieval prompts, as tables the other jobs read.

A reply is free text around one JSON object (``functions.reply_text``). What it
says about messages it was not asked about is dropped.

What is accepted goes on: classifications into the annotations and statements,
summaries into the cache (rejected ones as empty entries, so that nobody asks
again), selected messages into the scores.

Defined cases: a reply that is NULL, or holds no object, gives one row of
:func:`unusable` and nothing else; members of another type than expected count
as absent; of several answers for one message the last counts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed_values as V
from threadloom.functions import text as T
from threadloom.functions.reply_text import STRICT, first_object
from threadloom.operators import annotate, ordered, verdicts

KEYS = ["conv_id", "req_turn"]
_MEMBER = "id string, type string, protected boolean, protection_reason string, memory array<string>, complete boolean"
_STATEMENT = "key string, value string, type string, op string"
STATEMENTS = "array<struct<key:string,value:string,type:string,confidence:double,op:string>>"


def with_object(replies: DataFrame) -> DataFrame:
    """The replies with ``doc``, their object."""
    return replies.withColumn("doc", first_object(F.col("raw")))


def unusable(replies: DataFrame) -> DataFrame:
    """Replies without an object, with an ``error``."""
    return with_object(replies).where(F.col("doc").isNull()).drop("doc", "raw").withColumn("error", F.lit("no_json_object"))


def _members(replies: DataFrame, name: str) -> DataFrame:
    """One row (``place``, ``member``) for each element of the list ``name``, as JSON text."""
    listed = F.from_json("doc", f"{name} array<string>", STRICT)[name]
    keep = [c for c in replies.columns if c not in ("raw", "doc")]
    rows = with_object(replies).where(F.col("doc").isNotNull())
    return rows.select(*keep, F.posexplode_outer(listed).alias("place", "member")).where(F.col("member").isNotNull())


def _last(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "place").alias("_r")).select(*keys, "_r.*")


# --- classification -----------------------------------------------------------
def classifications(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, content_type, protected, protection_reason, statements, complete of every classified message.

    ``replies``: conv_id, batch, raw; ``asked``: conv_id, batch, turn of the messages of each prompt.
    """
    rows = _members(replies, "results").where(F.col("member").startswith("{")).withColumn("r", F.from_json("member", _MEMBER, STRICT))
    rows = rows.select("conv_id", "batch", "place", "r.*").withColumnRenamed("id", "_id")
    named = asked.select("conv_id", "batch", "turn", F.col("turn").cast("string").alias("_id")).distinct()
    rows = rows.join(ordered.merged(named), ["conv_id", "batch", "_id"])
    parsed = F.transform(F.filter(F.coalesce("memory", F.array().cast("array<string>")), lambda m: m.startswith("{")), lambda m: F.from_json(m, _STATEMENT, STRICT))

    def statement(m):
        key = T.canonical_key(F.coalesce(m["key"], F.lit("")))
        value = T.strip(F.regexp_replace(F.coalesce(m["value"], F.lit("")), r"\s+", " "))
        kind = F.when(m["type"].isin(V.MEMORY_TYPES), m["type"]).otherwise("fact")
        return F.struct(key.alias("key"), value.alias("value"), kind.alias("type"), F.lit(V.REPLY_CONFIDENCE).alias("confidence"), F.when(m["op"] == "remove", "remove").otherwise("set").alias("op"))

    good = lambda s: (s["key"] != "") & (s["value"] != "") & (F.length(s["value"]) <= V.REPLY_VALUE_CHARS)
    why = T.strip(F.coalesce("protection_reason", F.lit("")))
    rows = rows.withColumn("statements", F.filter(F.transform(parsed, statement), good).cast(STATEMENTS))
    fields = {
        "content_type": F.when(F.col("type").isin(V.CONTENT_TYPES), F.col("type")).otherwise("discussion"),
        "protected": F.coalesce("protected", F.lit(False)),
        "protection_reason": F.when(why != "", T.clip(why, 100)),
        "complete": F.coalesce("complete", F.lit(False)) & (F.size("statements") > 0),
    }
    rows = rows.withColumns(fields)
    return _last(rows, ["conv_id", "turn"], ["content_type", "protected", "protection_reason", "statements", "complete"])


def annotations_with(annotated: DataFrame, classified: DataFrame) -> DataFrame:
    """Annotations with the classifications applied; the statements of a classified message end with those of its reply."""
    said = classified.select("conv_id", "turn", F.col("statements").alias("_said"))
    open_ = annotated.where(F.col("ambiguous") & (F.col("role") == "user")).select("conv_id", "turn")
    merged = annotate.merge_model_annotations(annotated, classified.drop("statements"))
    merged = merged.join(ordered.merged(said.join(ordered.merged(open_), ["conv_id", "turn"], "left_semi")), ["conv_id", "turn"], "left")
    kind = annotated.schema["statements"].dataType
    more = F.coalesce(F.col("_said"), F.array().cast(STATEMENTS)).cast(kind)
    return merged.withColumn("statements", F.concat(F.coalesce("statements", F.array().cast(kind)), more)).drop("_said")


# --- summaries ----------------------------------------------------------------
def summary_results(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, req_turn, turn, cache_key, summary, reason of every message a usable reply was asked to summarise.

    ``replies``: conv_id, req_turn, raw; ``asked``: conv_id, req_turn, turn, text. ``reason`` is NULL for
    accepted summaries; a rejected one is empty, which the cache keeps as "do not ask again".
    """
    rows = _members(replies, "summaries").where(F.col("member").startswith("{")).withColumn("r", F.from_json("member", "id string, summary string", STRICT))
    rows = rows.select(*KEYS, "place", F.col("r.id").alias("_id"), T.strip(F.coalesce("r.summary", F.lit(""))).alias("summary")).where(F.col("summary") != "")
    wanted = asked.select(*KEYS, "turn", "text").dropDuplicates([*KEYS, "turn"])
    named = wanted.select(*KEYS, "turn", F.col("turn").cast("string").alias("_id"))
    given = rows.join(ordered.merged(named), [*KEYS, "_id"]).drop("_id")
    checked = verdicts.check_summaries(given, wanted.select(*KEYS, "turn", "text"), [*KEYS, "turn"])
    # the last accepted one, else the first rejection
    order = F.struct("accepted", F.when(F.col("accepted"), F.col("place")).otherwise(-F.col("place")))
    best = checked.groupBy(*KEYS, "turn").agg(F.max_by(F.struct("accepted", "summary", "reason"), order).alias("_r"))
    answered = with_object(replies).where(F.col("doc").isNotNull()).select(*KEYS).distinct()
    out = wanted.join(ordered.merged(answered), KEYS, "left_semi").join(ordered.merged(best), [*KEYS, "turn"], "left")
    message_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    accepted = F.coalesce("_r.accepted", F.lit(False))
    return out.select(
        *KEYS,
        "turn",
        T.cache_key(F.lit("summary"), T.source_line(message_id, F.col("text"))).alias("cache_key"),
        F.when(accepted, F.col("_r.summary")).otherwise("").alias("summary"),
        F.when(~accepted, F.coalesce("_r.reason", F.lit("missing"))).alias("reason"),
    )


# --- retrieval ----------------------------------------------------------------
def selected_messages(replies: DataFrame, pool: DataFrame, requests: DataFrame) -> DataFrame:
    """conv_id, req_turn, turn, score of the messages chosen by meaning: the first ones named that were on offer.

    ``replies``: conv_id, req_turn, raw; ``pool``: conv_id, req_turn, turn; ``requests`` say whether the request
    points back at something, which allows three messages instead of five.
    """
    named = _members(replies, "ids").withColumnRenamed("member", "_id")
    offered = pool.select(*KEYS, "turn", F.col("turn").cast("string").alias("_id")).distinct()
    rows = named.join(ordered.merged(offered), [*KEYS, "_id"])
    # a reply is one row, and so are the places of its ids
    chosen = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("_t"))
    back = F.col("follow_up") | F.col("reference").isNotNull()
    limits = requests.select(*KEYS, F.when(back, V.FOLLOW_UP_SELECTED).otherwise(V.SELECTED).alias("_limit"))
    chosen = chosen.join(ordered.merged(limits), KEYS).select(*KEYS, F.explode(F.array_distinct(F.slice(F.col("_t.turn"), F.lit(1), F.col("_limit")))).alias("turn"))
    return chosen.withColumn("score", F.lit(V.SEMANTIC_RETRIEVAL_SCORE))
