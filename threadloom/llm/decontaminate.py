"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or a whole
shorter item. Patterns of one length form a group with a shift table over
blocks of two words: a block that ends no pattern tells how many places can be
skipped. A block with shift 0 leads to the bucket of patterns with that ending
and the words of the window are compared one by one, at last as text.

Many stretches of text are scanned at once: every step moves one cursor per
stretch, each by its own shift.

Tasks get the items' texts, at most ``PASS_BYTES`` of them, and build the tables
from them as arrays: a pattern is the number of its first word. A larger
benchmark is searched for in several passes, one after the other; the hits so
far are written with the documents between two passes, so neither the driver nor
a task ever holds more than one pass.

Defined cases: a null or empty text has no words and is never contaminated; an
item without words has no window; items with equal id count once; a null item
id is listed as an empty string; an empty benchmark hits nothing; repeated
documents give repeated rows.
"""

import hashlib
import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.shared import written

WINDOW = 13
STRETCH = 256
TABLE_BITS = 18
#: Benchmark text searched for in one pass; a larger benchmark is searched for in several.
PASS_BYTES = 8 << 20
RESULT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean>"
STATE = "struct<hit:binary,items:array<string>>"


class Group(NamedTuple):
    """Patterns of one length in order of hash; ``owners[owner_at[p]:owner_at[p + 1]]`` are the items of pattern p."""

    length: int
    block: int
    shift: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # number of the pattern's first word among the items' words
    owner_at: np.ndarray
    owners: np.ndarray


class Tables(NamedTuple):
    names: list[str]
    words: W.Words  # of all items
    groups: list[Group]


def _fold(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash per run of ``length`` values along the last axis."""
    n = hashes.shape[-1] - length + 1
    out = np.zeros((*hashes.shape[:-1], max(n, 0)), dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[..., k : k + n]
    return W.mix(out)


def _slot(block_hashes: np.ndarray) -> np.ndarray:
    return (block_hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build(items: list[tuple[str, str]], window: int = WINDOW) -> Tables:
    """Search tables for (item id, text) pairs."""
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    owner = np.array([number[name] for name, _ in items], dtype=np.int64)
    found = W.find_words(W.text_bytes(pa.array([text for _, text in items], pa.string())), W.ALNUM)
    counts = np.diff(found.first)
    lengths = np.minimum(counts, window)
    groups = []
    for length in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == length)
        places = counts[own] - length + 1
        at = np.repeat(found.first[own], places) + np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
        groups.append(_group(found, length, at, np.repeat(owner[own], places)))
    return Tables(names, found, groups)


def _text(found: W.Words, at: int, length: int) -> bytes:
    return b" ".join(found.data[s:e].tobytes() for s, e in zip(found.starts[at : at + length], found.ends[at : at + length]))


def _group(found: W.Words, length: int, at: np.ndarray, owner: np.ndarray) -> Group:
    """Patterns that begin at the words ``at``; equal ones are one pattern with several owners."""
    block = min(2, length)
    whole = _fold(found.hashes, length)[at]
    order = np.lexsort((found.hashes[at + length - 1], found.hashes[at], whole))
    at, owner, whole = at[order], owner[order], whole[order]
    # three 64-bit hashes tell patterns apart
    first, last = found.hashes[at], found.hashes[at + length - 1]
    new = np.r_[True, (whole[1:] != whole[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])]
    pattern = np.cumsum(new) - 1
    both = np.unique(pattern * (int(owner.max()) + 1) + owner)
    owners = both % (int(owner.max()) + 1)
    owner_at = np.searchsorted(both // (int(owner.max()) + 1), np.arange(pattern[-1] + 2))
    at, whole = at[new], whole[new]
    shift = np.full(1 << TABLE_BITS, length - block + 1, dtype=np.int64)
    ends = _slot(_fold(found.hashes, block))
    for j in range(length - block + 1):
        np.minimum.at(shift, ends[at + j], length - block - j)
    return Group(length, block, shift, whole, at, owner_at, owners)


def scan(found: W.Words, group: Group, items: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence: (number of its first word, pattern)."""
    length, block, n = group.length, group.block, len(found.hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps = group.shift[_slot(_fold(found.hashes, block))]  # steps[i]: shift of the block that begins at word i
    counts = np.diff(found.first)
    long = np.flatnonzero(counts >= length)
    places = counts[long] - length + 1  # of windows in each text, cut into stretches
    pieces = -(-places // STRETCH)
    text = np.repeat(long, pieces)
    part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = found.first[text] + part * STRETCH
    limit = np.minimum(at + STRETCH, found.first[text] + np.repeat(places, pieces))
    ending = length - block
    hits = []
    while len(at):
        step = steps[at + ending]
        hits.append(at[step == 0])
        at = at + np.maximum(step, 1)
        going = at < limit
        at, limit = at[going], limit[going]
    starts = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts
    window = found.hashes[starts[:, None] + np.arange(length)]
    whole = _fold(window, length)[:, 0]
    pattern = np.searchsorted(group.hashes, whole)
    known = pattern < len(group.hashes)
    known[known] = group.hashes[pattern[known]] == whole[known]
    sure_starts, sure_patterns = [], []
    for s, p in zip(starts[known].tolist(), pattern[known].tolist()):
        text, h = _text(found, s, length), group.hashes[p]
        while p < len(group.hashes) and group.hashes[p] == h:  # more than one only if hashes collide
            if _text(items, group.first[p], length) == text:
                sure_starts.append(s)
                sure_patterns.append(p)
                break
            p += 1
    return np.array(sure_starts, np.int64), np.array(sure_patterns, np.int64)


def search(column: pa.Array, tables: Tables) -> list[tuple[np.ndarray, set[str]]]:
    """Per text: which words are hit, and the items with an occurring window."""
    names, known, groups = tables
    out = []
    for _, part in W.slices(column):
        found = W.find_words(W.text_bytes(part), W.ALNUM)
        change = np.zeros(len(found.hashes) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in range(len(part))]
        for group in groups:
            starts, pattern = scan(found, group, known)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + group.length, -1)
            for row, p in {*zip(found.row[starts].tolist(), pattern.tolist())}:
                items[row].update(names[o] for o in group.owners[group.owner_at[p] : group.owner_at[p + 1]])
        hit = np.cumsum(change[:-1]) > 0
        out += [(hit[found.first[i] : found.first[i + 1]], items[i]) for i in range(len(part))]
    return out


def passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES):
    """The items in lists of (name, text), of about ``pass_bytes`` of text each, one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, math.ceil(size / pass_bytes))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k).collect()
        yield k == count - 1, [(r["name"], r["text"]) for r in part]


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "_judged", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """All columns of ``docs`` and a struct of n_words, n_hit, n_items, items_sha256, contaminated."""
    spark, state = docs.sparkSession, f"{out}_state"
    rows = docs.withColumn(state, F.lit(None).cast(STATE))
    for final, items in passes(benchmark, pass_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, window, items))
        if final:
            return rows.withColumn(out, _pass(shared, True)("text", state)).drop(state)
        rows = written(rows.withColumn(state, _pass(shared, False)("text", state)), "decontaminate")
        shared.destroy()


_BUILT: dict[str, Tables] = {}


def _tables(key: str, window: int, items: list[tuple[str, str]]) -> Tables:
    """The search tables of a pass, built once in a worker process; those of another pass go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(items, window)
    return _BUILT[key]


def _pass(shared, final: bool):
    @F.arrow_udf(RESULT if final else STATE)
    def run(texts: pa.Array, states: pa.Array) -> pa.Array:
        found = search(texts, _tables(*shared.value))
        for i, before in enumerate(states):
            if before.is_valid and (held := before.as_py()):
                hit = np.unpackbits(np.frombuffer(held["hit"], np.uint8), count=len(found[i][0])).astype(bool)
                found[i] = (found[i][0] | hit, found[i][1] | set(held["items"]))
        if not final:
            return pa.StructArray.from_arrays([pa.array([np.packbits(h).tobytes() for h, _ in found], pa.binary()), pa.array([sorted(x) for _, x in found], pa.list_(pa.string()))], ["hit", "items"])
        n_words, n_hit = [len(h) for h, _ in found], [int(h.sum()) for h, _ in found]
        return pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for _, x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for _, x in found], pa.string()),
                pa.array([h > 0 and 20 * h >= w for w, h in zip(n_words, n_hit)], pa.bool_()),
            ],
            ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and what was found, one row per document."""
    return judged(docs.select("doc_id", "text"), benchmark).select("doc_id", "_judged.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    # the row travels as one struct, so that no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judged(rows, benchmark).where(~F.col("_judged.contaminated")).select("row.*")
