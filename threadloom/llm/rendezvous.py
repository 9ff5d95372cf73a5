"""Sharding by rendezvous hashing.

Every shard draws a number from (record key, shard); the record goes to the
shard with the largest weighted draw. A new shard changes no other shard's
draws, so it only takes records into itself, and in proportion to its weight.

Defined cases: a null key is a key of its own; rows with equal keys share a
shard; a null text has size 16 and the checksum of no bytes; ties of draws go
to the lower shard; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import ordered

#: Rows that are ranked together, about.
SLOT_ROWS = 1 << 16


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard, 0 to len(weights) - 1, for a key; weights must be above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above 0")
    name = F.coalesce(key.cast("string"), F.lit("\x00null"))
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    base = F.xxhash64(name)

    def cost(s: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(base, s["shard"]), 11) + 0.5) / float(2**53)
        return F.struct((-F.log(unit) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def assign(docs: DataFrame, weights: list[float], grown_weights: list[float], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots number the rows of a shard without gaps. A shard may hold a large part of
    all rows, so it is ranked in buckets of its keys' hash, of about ``slot_rows`` rows
    if shards are even, and only the buckets' counts are added up along the shard.
    """
    buckets = max(1, -(-docs.count() // (slot_rows * len(weights))))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(data) + 16).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown_weights).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    rows = ordered.positions(rows, ["shard"], ["_bucket"], ["_bucket", "doc_id", "size", "text_crc32"], out="slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
