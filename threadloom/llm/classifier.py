"""Quality classifier with supervised subword embeddings.

Words, pairs of words and byte 3-grams of a text are hashed to buckets, each bucket
has a learned vector, a document is the mean of its vectors, and a softmax over two
classes gives the score. A pair of equal words has one bucket, whatever the word. Training is plain stochastic gradient descent in numpy on a
bounded sample of labelled documents. Scoring reads every whole text; since the
output is linear in the mean, each bucket is folded into one number first.

The sample takes at most ``MAX_ROWS`` labelled documents of at most ``MAX_BYTES``
of text together, in the order of a hash of doc_id. Texts of over ``MAX_TEXT``
bytes come after all others, so they only fill what is left; those of over
``MAX_BYTES`` cannot be learned from. It is chosen by ids and lengths, then only
the chosen texts are fetched.

Defined cases: a null or empty text gets the score of the bias alone; without
labelled rows every score is 0.5; several labels of one document count as their
majority (a tie counts as 1); null labels are left out; repeated documents give
repeated rows; labels of unknown documents are ignored.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import words as W

MAX_ROWS = 3000
MAX_BYTES = 24 << 20
MAX_TEXT = 1 << 20
BITS = 17
DIM = 10
EPOCHS = 10
RATE = 2.0
REPEAT = 3 << BITS  # bucket of a word that follows itself
SIZE = (3 << BITS) + 1


class Model(NamedTuple):
    """Difference of the two logits: ``bias`` plus the mean of ``weight`` over a text's buckets."""

    weight: np.ndarray
    bias: float


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte 3-gram at each place but the last two; case is kept."""
    x = data.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32) + (1 << BITS)


def buckets(text: W.Bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all words, of all pairs of words that follow each other, and of all 3-grams inside one text."""
    found = W.find_words(text, W.NOT_SPACE)
    out = [((found.hashes >> np.uint64(64 - BITS)).astype(np.int32), found.row)]
    pair = np.flatnonzero(found.row[1:] == found.row[:-1])
    one, two = found.hashes[pair], found.hashes[pair + 1]
    bucket = (W.mix(one * np.uint64(0x9E3779B97F4A7C15) + two) >> np.uint64(64 - BITS)).astype(np.int32) + (2 << BITS)
    out.append((np.where(one == two, REPEAT, bucket).astype(np.int32), found.row[pair]))
    if len(text.data) > 2:
        row = np.repeat(np.arange(len(text.offsets) - 1), np.diff(text.offsets))
        inside = row[2:] == row[:-2]
        out.append((_gram_buckets(text.data)[inside], row[:-2][inside]))
    return out


def train(texts: list[str], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (SIZE, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    bags = []
    for text in texts:
        found = np.concatenate([b for b, _ in buckets(W.text_bytes(pa.array([text], pa.string())))])
        bags.append(np.unique(found, return_counts=True))
    total, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now = rate * (1 - step / total)
            step += 1
            ids, counts = bags[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids] if len(ids) else np.zeros(dim, dtype=np.float32)
            logits = output @ mean + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[labels[i]] -= 1
            back = output.T @ slope
            output -= now * np.outer(slope, mean)
            bias -= now * slope
            if len(ids):
                vectors[ids] -= now * np.outer(share, back)
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = [np.zeros(0)]
    for _, part in W.slices(column):
        total, count = np.zeros(len(part)), np.zeros(len(part))
        for bucket, row in buckets(W.text_bytes(part)):
            total += np.bincount(row, weights=model.weight[bucket], minlength=len(part))
            count += np.bincount(row, minlength=len(part))
        out.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias))))
    return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows narrow rows
    text, order = F.coalesce("text", F.lit("")), ["_long", "_at", "doc_id", "_hash"]
    rows = docs.select("doc_id", F.xxhash64(text).alias("_hash"), F.octet_length(text).cast("bigint").alias("_bytes"), F.xxhash64("doc_id").alias("_at"))
    rows = rows.join(F.broadcast(known), "doc_id").where(F.col("_bytes") <= max_bytes).withColumn("_long", F.col("_bytes") > MAX_TEXT)
    rows = rows.orderBy(*order).limit(max_rows)
    so_far = F.sum("_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = rows.withColumn("_so_far", so_far).where(F.col("_so_far") <= max_bytes).select(*order, "_label").collect()
    if not chosen:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["_hash"]) for r in chosen], rows.select("doc_id", "_hash").schema).distinct()
    found = docs.select("doc_id", F.xxhash64(text).alias("_hash"), text.alias("_text")).join(F.broadcast(wanted), ["doc_id", "_hash"])
    # equal rows are fetched once and learned from as often as they were chosen
    texts = {(r["doc_id"], r["_hash"]): r["_text"] for r in found.groupBy("doc_id", "_hash").agg(F.first("_text").alias("_text")).collect()}
    return train([texts[r["doc_id"], r["_hash"]] for r in chosen], [r["_label"] for r in chosen])


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB at any input size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, shared.value), pa.float64())

    return docs.withColumn(out, score("text"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns."""
    # the row travels as one struct, so that no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return scored(rows, model).where(F.col("score") >= 0.5).select("row.*")
