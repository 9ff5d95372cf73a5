"""Collocations: phrases of two to five words that stand together more often than by chance.

Words are counted first. A phrase found ``least`` times consists of words found
as often, so only those get an id: their place among the frequent words, or, of
more than ``MAX_IDS`` frequent words, their 64-bit hash. Then phrases are
counted, one length after the other: every task packs the id n-grams of its
texts into counting quotient filters (``quotient``), one for each shard of the
permuted numbers, and each shard merges its sorted filters. A phrase can only be
frequent if its two parts without the first and without the last word are, so
from three words on n-grams are left out whose parts are not in a bitmap of the
frequent ones. The bitmap has a fixed number of bits at most, so it may let too
much pass, which costs counting only; it never drops a frequent phrase.

Counts, scores and ranks are exact: a phrase's places are all counted, overlaps
included, and scores are computed with decimals of 38 digits.

Skew: a frequent phrase is one entry in each filter, so no shard gets more than
one row for it from a chunk of a task; shards are cut by permuted numbers and
their number grows with the words, so they are of even size. A word that many
phrases begin or end with is joined in ``SALT`` copies.

Defined cases: null texts are empty; a null lang is ``und``, and so the same as
that name; rows with equal doc_id are counted each; phrases do not cross
punctuation or line ends; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import quotient as Q
from threadloom.llm import words as W
from threadloom.llm.shared import written

LONGEST = 5
MAX_IDS = 1 << 22
#: Words that a task gathers before it writes its filters.
CHUNK = 1 << 21
#: Words of the whole corpus for each shard, at most.
SHARD_WORDS = 1 << 23
MERGE_ENTRIES = 1 << 21
MIN_BITMAP, MAX_BITMAP = 1 << 20, 1 << 28
SALT = 16

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_MEMBER = ~_BREAKS
_MEMBER[[0x20, 0x09]] = False
IDS = "ids array<bigint>"


def _lang_hash(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name.encode()))


def _words(langs: list[str], part: pa.Array):
    """Words of a slice, with hashes that differ by lang, and the number of the piece each is in."""
    text = W.text_bytes(part)
    found = W.find_words(text, _MEMBER)
    # a new row, and each punctuation mark or line end, begins a new piece
    piece = np.cumsum(_BREAKS[text.data])[found.starts] + found.row if len(found.starts) else np.zeros(0, np.int64)
    names = {name: _lang_hash(name) for name in set(langs)}
    salt = np.array([names[x] for x in langs], np.uint64)
    return found, W.mix(found.hashes ^ salt[found.row]) if len(found.starts) else found.hashes, piece


def _slices(batch: pa.RecordBatch):
    langs = batch.column("lang").to_pylist()
    for at, part in W.slices(batch.column("text")):
        yield langs[at : at + len(part)], *_words(langs[at : at + len(part)], part)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h (64-bit name), f of every word."""

    def rows(held: dict):
        order = sorted(held)
        columns = [[held[k][0] for k in order], [held[k][1] for k in order], [held[k][2] for k in order]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(np.array(order, np.uint64).view(np.int64)), pa.array(columns[2], pa.int64())], ["lang", "word", "h", "f"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for langs, found, h, _ in _slices(batch):
                names, first, times = np.unique(h, return_index=True, return_counts=True)
                raw = found.data.tobytes()
                starts, ends, row = found.starts[first].tolist(), found.ends[first].tolist(), found.row[first].tolist()
                for name, a, b, r, n in zip(names.tolist(), starts, ends, row, times.tolist()):
                    if (entry := held.get(name)) is not None:
                        entry[2] += n
                    else:
                        held[name] = [langs[r], raw[a:b].decode(), n]
                if len(held) > CHUNK // 8:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return docs.mapInArrow(run, "lang string, word string, h bigint, f bigint").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def _id_table(frequent: DataFrame) -> tuple[np.ndarray | None, int]:
    """Sorted names of the frequent words, whose places are the ids, and bits of an id; no names if the names are the ids."""
    if frequent.limit(MAX_IDS + 1).count() > MAX_IDS:
        return None, 64
    names = np.sort(frequent.select("h").toArrow()["h"].to_numpy().view(np.uint64))
    return names, max(1, int(len(names)).bit_length())


def _numbered(frequent: DataFrame, names) -> DataFrame:
    """id, lang, word, f of the frequent words."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), names.value, None)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), batch.column("lang"), batch.column("word"), batch.column("f")], ["id", "lang", "word", "f"])

    return frequent.mapInArrow(run, "id bigint, lang string, word string, f bigint")


def _ids(h: np.ndarray, names: np.ndarray | None, known: np.ndarray | None) -> np.ndarray:
    """Ids of words, 0 for words that are not frequent. ``known``: bitmap of frequent words, if hashes are ids."""
    if names is None:
        return np.where(_in_bitmap(known, h), np.maximum(h, np.uint64(1)), np.uint64(0))
    if not len(names):
        return np.zeros(len(h), np.uint64)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, at.astype(np.uint64) + np.uint64(1), np.uint64(0))


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of a column ``h`` of 64-bit hashes; 16 bits for each if that is within the bounds."""
    bits = min(MAX_BITMAP, max(MIN_BITMAP, 1 << int(16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    rows = hashes.select(F.shiftright(place, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(ids[0]), 0x51ED270B93E4A1C7, np.uint64)
    for x in ids:
        h = W.mix(h ^ W.mix(x))
    return h


def count_phrases(docs: DataFrame, size: int, least: int, names, bits: int, known, parts, shards: int) -> DataFrame:
    """ids, f of the phrases of ``size`` words found ``least`` times or more, with ``h``, the phrase's hash.

    ``names`` and ``known`` are broadcasts for the ids, ``parts`` one of the bitmap of frequent phrases a word shorter.
    """
    packing = Q.Packing(size, bits)
    shard_bits = (shards - 1).bit_length()

    def filters(held: list[np.ndarray]):
        keys, counts = Q.tally(Q.permute(np.concatenate(held, axis=1), packing))
        shard = Q.shards_of(keys, packing, shard_bits)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        # a few shards at a time, so that a batch stays small
        for i in range(0, len(cuts) - 1, 64):
            spans = list(zip(cuts[i : i + 65][:-1], cuts[i : i + 65][1:]))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array([Q.dump(keys[:, a:b], counts[a:b], packing, shard_bits) for a, b in spans], pa.binary())], ["shard", "filter"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, h, piece in _slices(batch):
                ids = _ids(h, names.value, known.value)
                m = len(ids) - size + 1
                if m <= 0:
                    continue
                whole = piece[:m] == piece[size - 1 :]
                for k in range(size):
                    whole &= ids[k : m + k] > 0
                at = np.flatnonzero(whole)
                if parts is not None and len(at):
                    shorter = np.unique(np.r_[at, at + 1])
                    fits = np.zeros(len(ids) + 1, bool)
                    fits[shorter] = _in_bitmap(parts.value, _gram_hash([ids[shorter + k] for k in range(size - 1)]))
                    at = at[fits[at] & fits[at + 1]]
                if len(at):
                    held.append(Q.pack(np.stack([ids[at + k] for k in range(size)]), packing))
                    n += len(at)
                if n >= CHUNK:
                    yield from filters(held)
                    held, n = [], 0
        if held:
            yield from filters(held)

    def frequent(shard: int, held: list):
        keys, counts = Q.merge(held)
        keep = counts >= least
        ids = Q.unpack(Q.restore(keys[:, keep], packing), packing)
        columns = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, size), pa.int32()), pa.array(ids.T.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([columns, pa.array(counts[keep]), pa.array(_gram_hash(list(ids)).view(np.int64))], ["ids", "f", "h"])

    def merged(batches):
        here, held, n = None, [], 0
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                if shard != here:
                    if held:
                        yield frequent(here, held)
                    here, held, n = shard, [], 0
                held.append(Q.load(raw.as_py(), packing, shard, shard_bits))
                n += held[-1][0].shape[1]
                if n >= 2 * MERGE_ENTRIES and len(held) > 1:
                    held = [Q.merge(held)]
                    n = 0  # what is merged is bounded by the shard's distinct phrases
        if held:
            yield frequent(here, held)

    blobs = docs.mapInArrow(run, "shard int, filter binary")
    return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merged, f"{IDS}, f bigint, h bigint")


def phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n): all words of each lang; (id, lang, word, f): frequent words; (ids, f): frequent phrases of 2 to 5 words. Written tables."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = written(word_counts(docs), "words")
    totals = written(counted.groupBy("lang").agg(F.sum("f").alias("n")), "lang-words")
    frequent = counted.where(F.col("f") >= least)
    names, bits = _id_table(frequent)
    known = spark.sparkContext.broadcast(_bitmap(frequent.select("h")) if names is None else None)
    names_sent = spark.sparkContext.broadcast(names)
    if names is None:
        vocabulary = frequent.select(F.when(F.col("h") == 0, 1).otherwise(F.col("h")).alias("id"), "lang", "word", "f")
    else:
        vocabulary = _numbered(frequent, names_sent)
    vocabulary = written(vocabulary, "vocabulary")
    words = totals.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shards = 1 << (shards - 1).bit_length()
    parts, tables = None, []
    for size in range(2, LONGEST + 1):
        table = written(count_phrases(docs, size, least, names_sent, bits, known, parts, shards), f"phrases-{size}")
        tables.append(table.select("ids", "f"))
        if size < LONGEST:
            parts = spark.sparkContext.broadcast(_bitmap(table.select("h")))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return totals, vocabulary, out


def _with_counts(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """Adds the count of the phrase in column ``part`` (an array of ids); parts of one word, which many rows share, are joined in copies."""
    salt = F.pmod(F.xxhash64("ids", "k"), F.lit(SALT)).cast("int")
    rows = rows.withColumn("_salt", F.when(F.size(part) == 1, salt).otherwise(0))
    copies = F.when(F.size("_part") == 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    facts = counts.select(F.col("ids").alias("_part"), F.col("f").alias(out)).withColumn("_salt", F.explode(copies))
    return rows.join(facts.withColumnRenamed("_part", part), [part, "_salt"]).drop("_salt", part)


def scored(found: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """ids, lang, a, l, r, n, score of every phrase: those of its lowest-scoring cut, the first one on ties."""
    words = vocabulary.join(F.broadcast(totals) if totals.limit(10_000).count() < 10_000 else totals, "lang")
    counts = vocabulary.select(F.array("id").alias("ids"), "f").unionByName(found)
    cuts = found.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumns({"_left": F.slice("ids", F.lit(1), F.col("k")), "_right": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    cuts = _with_counts(_with_counts(cuts, counts, "_left", "l"), counts, "_right", "r")
    first = words.select(F.array("id").alias("_first"), "lang", "n").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    cuts = cuts.withColumns({"_first": F.slice("ids", 1, 1), "_salt": F.pmod(F.xxhash64("ids", "k"), F.lit(SALT)).cast("int")}).join(first, ["_first", "_salt"]).drop("_first", "_salt")
    cuts = cuts.withColumn("score", F.expr("cast(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000 as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least = F.min(F.struct("score", "k", "l", "r", "n", "lang")).alias("cut")
    return cuts.groupBy("ids", "a").agg(least).select("ids", "a", "cut.lang", "cut.l", "cut.r", "cut.n", "cut.score")


def not_covered(rows: DataFrame, found: DataFrame, num: int = 100, den: int = 100) -> DataFrame:
    """The rows whose words do not lie in a longer phrase with den * f >= num * a.

    A phrase between the two is found at least as often as the longer one, so phrases one word longer decide.
    """
    longer = found.where(F.size("ids") > 2).withColumn("_from", F.explode(F.array(F.lit(1), F.lit(2))))
    longer = longer.select(F.slice("ids", F.col("_from"), F.size("ids") - 1).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("_longer"))
    return rows.join(longer, "ids", "left").where(F.col("_longer").isNull() | (F.col("_longer") * den < F.col("a") * num)).drop("_longer")


def top(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``most`` best phrases of each lang."""
    totals, vocabulary, found = phrases(docs, least)
    rows = not_covered(scored(found, vocabulary, totals), found)
    # those that can be among the best, ties included, before their words are fetched
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = written(rows.withColumn("_rank", F.rank().over(by_score)).where(F.col("_rank") <= most).drop("_rank"), "best-phrases")
    parts = best.select("ids", F.posexplode("ids").alias("_at", "id")).join(vocabulary.select("id", "word"), "id")
    text = parts.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
    named = best.join(text.select("ids", F.array_join("_words.word", " ").alias("phrase")), "ids")
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(in_order).cast("bigint")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
