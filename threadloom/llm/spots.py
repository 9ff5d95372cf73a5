"""Document fingerprints by SpotSigs.

Anchors are very common words of four languages. Every anchor starts a spot: the
anchor and the next two words that are not anchors. A fingerprint is the sorted
set of the spots' 32-bit hashes, eight hexadecimal digits each, so likeness (the
Jaccard similarity of the sets) is read from fingerprints alone.

Only built-in column functions are used.

Defined cases: a null text counts as empty; an empty text has an empty
fingerprint, like another empty one (1.0) and unlike all others (0.0); a text
without anchors has one spot, its whole wording; equal texts have equal
fingerprints; a null doc_id counts as the smallest; rows of equal doc_id follow
each other by the hash of their text; an empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import written

# Common words of English, French, German and Spanish
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it not of on or that the their they this to was were which with "
    "au aux avec ce dans des du elle en est et il la le les leur mais ne ou par pas pour qui se sont sur un une "
    "als auch auf aus das dem den der die ein eine einer er es ist mit nicht sich sie sind und von war wie zu "
    "al con del el ella esta como los las no para pero por que son su sus una y"
).split()
CHAIN = 2
BLOCK_ROWS = 1024
MAX_BLOCKS = 10_000


def with_spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """All columns of ``df`` and the sorted set of the hashes of the spots of ``text``."""
    anchors = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    norm, parts, bodies = f"_{out}_norm", f"_{out}_parts", f"_{out}_bodies"
    df = df.withColumn(norm, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    df = df.withColumn(parts, F.filter(F.split(F.regexp_replace(norm, f" ({anchors})(?= )", "\n$1:"), "\n"), lambda s, i: i > 0))
    df = df.withColumn(bodies, F.transform(parts, lambda s: F.substring_index(s, ":", -1)))

    def spot(s: Column, i: Column) -> Column:
        # content words after the anchor; those after the next anchors count where they are too few
        words = F.trim(F.concat(*[F.coalesce(F.get(F.col(bodies), i + k), F.lit("")) for k in range(3)]))
        return F.concat(F.substring_index(s, ":", 1), F.lit(":"), F.substring_index(words, " ", CHAIN))

    whole = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.array(F.when(F.col(norm) == "  ", F.col(text)).otherwise(F.col(norm))))
    found = F.when(F.size(parts) > 0, F.transform(parts, spot)).otherwise(whole)
    return df.withColumn(out, F.array_sort(F.array_distinct(F.transform(found, lambda s: F.hash(s))))).drop(norm, parts, bodies)


def fingerprint(spots: Column) -> Column:
    """Spot hashes as eight hexadecimal digits each."""
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two spot sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _block(doc_id: Column, share: Column, bounds: list, none_blocks: int) -> Column:
    """Number of the block of a row: how many bounds are below its id. An id that is several bounds has as many blocks.

    ``share`` (0 to 1, by the text's hash) chooses between those. Bounds are looked up in two steps, among every
    so many and then among those between two of them.
    """
    none = F.floor(share * none_blocks).cast("bigint") - none_blocks
    if not bounds:
        return F.when(doc_id.isNull(), none).otherwise(F.lit(0).cast("bigint"))
    step = max(1, math.isqrt(len(bounds)))
    parts = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    tops = F.array(*[F.lit(bounds[min(i + step, len(bounds)) - 1]) for i in range(0, len(bounds), step)])

    def below(holds) -> Column:
        whole = F.size(F.filter(tops, holds))
        return whole * step + F.coalesce(F.size(F.filter(F.get(parts, whole), holds)), F.lit(0))

    low, same = below(lambda b: b < doc_id), below(lambda b: b <= doc_id)
    found = F.when(same - low > 1, low + F.floor(share * (same - low))).otherwise(low)
    return F.when(doc_id.isNull(), none).otherwise(found.cast("bigint"))


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text and spots of every document, and next_text, next_spots of the row that follows by descending doc_id.

    The first row follows the last; rows of one id are in order of their text's hash. Rows are cut into
    blocks of neighbouring ids, about ``block_rows`` each or a ``MAX_BLOCKS``-th of all, by quantiles of
    doc_id; an id, or no id, that very many rows have is several blocks. Every block also gets the first
    row of the next one, so no step orders more than a block.
    """
    own_hash = F.xxhash64("text")
    rows = docs.withColumns({"_order": F.struct("doc_id", own_hash.alias("hash"))})
    counts = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    blocks = min(MAX_BLOCKS, max(1, -(-counts["n"] // block_rows)))
    share = (own_hash.cast("double") + 2.0**63) / 2.0**64
    bounds = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10_000).alias("b")).first()["b"] if blocks > 1 else []
    none_blocks = max(1, -(-counts["none"] * blocks // max(1, counts["n"])))
    rows = rows.withColumn("_block", _block(F.col("doc_id"), F.least(share, F.lit(1 - 2.0**-53)), sorted(bounds or []), none_blocks))
    # one narrow row per block: its first row, and the block that this row follows
    tops = rows.groupBy("_block").agg(F.max("_order").alias("_top"))
    tops = written(tops.withColumn("_goes", F.lag("_block").over(Window.orderBy(F.desc("_block")))), "spot-blocks")
    last = tops.agg(F.min("_block").alias("n")).first()["n"]
    tops = tops.withColumn("_goes", F.coalesce("_goes", F.lit(last).cast("bigint")))
    rows = rows.join(F.broadcast(tops), "_block")
    first_of_block = F.col("_order").eqNullSafe(F.col("_top"))
    own, lent = F.struct(F.col("_block").alias("block"), F.lit(0).alias("lent")), F.struct(F.col("_goes").alias("block"), F.lit(1).alias("lent"))
    rows = rows.withColumn("_to", F.explode(F.when(first_of_block, F.array(own, lent)).otherwise(F.array(own))))
    rows = with_spots(rows.select("doc_id", "text", "_order", "_to.block", "_to.lent"), "text", "spots")
    order = Window.partitionBy("block").orderBy("lent", F.desc("_order"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_spots": F.lead("spots").over(order)}).where(F.col("lent") == 0).drop("block", "lent", "_order")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the beginning of the
    next document, or by all of it where it is shorter.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "spots", "next_spots", edited.alias("edited"))
    rows = with_spots(rows, "edited", "edited_spots")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the fingerprint's smallest doc_id per document, and pairs of such ids with likeness >= threshold.

    Sets are partitioned by length so that only neighbouring partitions can be
    alike enough; within them sets meet in one of their first spots (by hash),
    and pairs whose sizes rule the threshold out are dropped before comparison.
    """
    sets = with_spots(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "spots")
    sets = sets.select("doc_id", "spots", fingerprint(F.col("spots")).alias("fingerprint"))
    members = sets.join(sets.groupBy("fingerprint").agg(F.min("doc_id").alias("representative")), "fingerprint").select("doc_id", "representative")
    one = sets.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("spots").alias("spots")).where(F.size("spots") > 0)
    size = F.size("spots")
    one = one.select("id", "spots", size.alias("n"), F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9).cast("int").alias("part") if threshold < 1 else size.alias("part"))
    reach = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1
    entries = one.select("id", "n", "part", F.explode(F.slice("spots", F.lit(1), reach)).alias("spot"))
    left, right = entries.alias("l"), entries.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1))).alias("r")
    met = left.join(right, ["part", "spot"]).where((F.col("l.id") != F.col("r.id")) & (F.least("l.n", "r.n") >= threshold * F.greatest("l.n", "r.n") - 1e-9))
    met = met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    spots = one.select("id", "spots")
    met = met.join(spots.select(F.col("id").alias("a"), F.col("spots").alias("_a")), "a").join(spots.select(F.col("id").alias("b"), F.col("spots").alias("_b")), "b")
    return members, met.select("a", "b", likeness(F.col("_a"), F.col("_b")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)
