"""Exact n-gram Jaccard self-join of documents with a prefix tree.

A document is the set of its distinct word n-grams, as 64-bit hashes. All sets
are written in one global order, n-grams rare in the corpus first. Two sets that
are alike enough share one of the first few n-grams of both (their prefixes), so
documents only meet under an n-gram of their prefixes, in groups of fitting
sizes, and only when places leave enough to share. What meets is compared in prefix trees: the sets
met by one probing set are put in a trie in global order, their overlap with it
is counted once for each shared path, and a subtree is left as soon as what
remains of either set cannot make up the overlap still missing.

Links are wanted as classes, so pairs that are connected already need no
comparison. First every set is compared with the one set it meets under most of
its prefix n-grams among the first ``LEADERS`` of each, which settles groups of
copies of any size in linear work. Sets that are still apart are
compared with the ``NEAREST``, by signature, of ``DRAWN`` leaders drawn under each n-gram, as
most links of a large group of near copies tell nothing new; again, up to ``DRAWS`` times,
while that finds ``DRAW_LINKS``. Then all pairs that are not connected yet and
share as many prefix n-grams as their sizes demand are compared. They meet in
bands of sizes under each n-gram, and signatures of ``SIGNATURE_BITS`` parities
drop pairs that differ in too many members. This last step leaves no class out.

Links as such, and their number for each document, come from a further step: every
link lies inside a class, so all pairs of different sets of a class are compared,
by counting the n-grams that two blocks of at most about ``LINK_SETS`` sets, or
``LINK_BYTES`` of members, have in common. Copies count by their number.

The order only affects speed: n-grams found more than once within a task are
counted over all tasks and the ``FREQUENT`` most frequent are ordered last, by
count; all others by hash. This list, 3 MB, is broadcast, and doc_ids to fetch
sets of, if they are at most ``BROADCAST_ROWS``.

Skew: equal sets are one set from the start, and a task emits a set once; tries
of a set that many others meet are dealt over several tasks; buckets of an
n-gram that are still open in the last comparison are split into cells, and so are
the blocks of a large class after it. Steps are cut by tables in the shared folder.

Defined cases: null and empty texts, and texts without words, have no n-grams,
link with nothing and are their own class; a text of fewer words than n is one
n-gram as a whole; rows with equal doc_id are one document as a key but stay
separate rows; a null doc_id is never the name of a class with other ids; an
empty table gives no rows.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.components import connected
from threadloom.llm.shared import discard, written

FREQUENT = 1 << 18
COUNT_BLOCK = 1 << 20
LEADERS = 2
DRAWS, DRAWN, NEAREST = 3, 16, 4
DRAW_LINKS = 1000
TRIE_SETS = 512
BROADCAST_ROWS = 1_000_000
CELL_ROWS = 2048
SIGNATURE_BITS = 256
SIGNATURE = [f"s{i}" for i in range(SIGNATURE_BITS // 64)]
LINK_SETS = 1024
LINK_BYTES = 1 << 24
LINK_COLUMNS = 4096
_TOP = np.uint64(1 << 63)


def set_rows(column: pa.Array, size: int):
    """Yield (row, sorted distinct n-gram hashes) of each text that has some."""
    for start, part in W.slices(column):
        h, row = W.shingles(W.find_words(W.text_bytes(part), W.NOT_SPACE), size)
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
        bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield start + int(row[a]), np.unique(h[a:b])


def set_name(hashes: np.ndarray) -> bytes:
    """128-bit name of a set."""
    one, two = W.mix(hashes), W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return one.sum(dtype=np.uint64).tobytes() + two.sum(dtype=np.uint64).tobytes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's members in SIGNATURE_BITS slots: two sets differ in at least as many members as signatures in bits."""
    odd = np.bincount((hashes >> np.uint64(64 - SIGNATURE_BITS.bit_length() + 1)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def in_order(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Set members as numbers whose size is the global order, sorted."""
    known, rank = frequent
    code = hashes >> np.uint64(1)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        code = np.where(known[at] == hashes, _TOP | rank[at], code)
    return np.sort(code)


def least_partner(n, num: int, den: int):
    """Smallest size of a set, and so smallest overlap, that can be alike enough to one of n."""
    return -(-num * n // den)


def overlap_needed(n, m, num: int, den: int):
    return -(-num * (n + m) // (num + den))


def sets_and_counts(docs: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0: doc_id, hash (of the text), n, name, signature of every document; of kind 1: n-gram and how often a task saw it, if more than once."""

    def count(blocks: list[np.ndarray]):
        gram, times = np.unique(np.concatenate(blocks), return_counts=True)
        gram, times = gram[times > 1], times[times > 1]
        none = pa.nulls(len(gram))
        longs = none.cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(gram), np.int32)), none.cast(id_type[0]), longs, pa.array(times.astype(np.int32)), none.cast(pa.binary()), pa.array(gram.view(np.int64)), *[longs] * len(SIGNATURE)], names
        )

    names = ["kind", "doc_id", "hash", "n", "name", "gram", *SIGNATURE]
    id_type = [pa.int64()]

    def run(batches):
        blocks, held = [], 0
        for batch in batches:
            id_type[0] = batch.schema.field("doc_id").type
            n, name = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            signs = np.zeros((batch.num_rows, len(SIGNATURE)), np.int64)
            for row, grams in set_rows(batch.column("text"), size):
                n[row], name[row], signs[row] = len(grams), set_name(grams), signature(grams)
                blocks.append(grams)
                held += len(grams)
                if held >= COUNT_BLOCK:
                    yield count(blocks)
                    blocks, held = [], 0
            own = [batch.column("doc_id"), batch.column("hash"), pa.array(n), pa.array(name, pa.binary()), pa.nulls(batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), *own, *[pa.array(signs[:, k]) for k in range(len(SIGNATURE))]], names)
        if blocks:
            yield count(blocks)

    kind = docs.schema["doc_id"].dataType.simpleString()
    signs = ", ".join(f"{c} bigint" for c in SIGNATURE)
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, f"kind int, doc_id {kind}, hash bigint, n int, name binary, gram bigint, {signs}")


def frequent_grams(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rank by count) of the most frequent n-grams, sorted by hash; at most ``most`` rows."""
    rows = counts.groupBy("gram").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "gram").limit(most).toArrow()
    gram, times = rows["gram"].to_numpy().view(np.uint64), rows["times"].to_numpy()
    by_count = np.lexsort((gram, times))
    rank = np.empty(len(gram), dtype=np.uint64)
    rank[by_count] = np.arange(len(gram), dtype=np.uint64)
    order = np.argsort(gram)
    return gram[order], rank[order]


def prefix_entries(docs: DataFrame, size: int, num: int, den: int, frequent) -> DataFrame:
    """token, name, n, pos for the prefix of every set that can be like a different one; once per set and task."""

    def run(batches):
        seen: set[bytes] = set()
        least = -(-num // (den - num)) if num < den else 1 << 60
        for batch in batches:
            token, pos, name, n = [], [], [], []
            for _, grams in set_rows(batch.column("text"), size):
                if len(grams) < least or (key := set_name(grams)) in seen:
                    continue
                seen.add(key)
                prefix = in_order(grams, frequent.value)[: len(grams) - least_partner(len(grams), num, den) + 1]
                token.append(prefix)
                pos.append(np.arange(len(prefix), dtype=np.int32))
                name += [key] * len(prefix)
                n.append(np.full(len(prefix), len(grams), np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(name, pa.binary()), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], ["token", "name", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token bigint, name binary, n int, pos int")


def met_entries(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of n-grams that two or more different sets of fitting sizes have in their prefixes.

    The sets under an n-gram are in order of size, and where one is too small for the next the group ends: no
    pair spans that gap. ``token`` becomes a hash of the n-gram and the group's smallest size, ``at`` the number in the group.
    """

    def run(batches):
        held, held_at, held_n = None, 0, 0  # the last row seen, its number in its group, and the group's smallest size
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            token, n = table["token"].to_numpy(), table["n"].to_numpy().astype(np.int64)
            name = np.array(table["name"].to_pylist(), dtype="S16")
            again = np.r_[False, (token[1:] == token[:-1]) & (name[1:] == name[:-1])]
            if again.any():
                table = table.filter(pa.array(~again))
                token, n = token[~again], n[~again]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (n[:-1] * den < n[1:] * num)]
            start = np.flatnonzero(fresh)
            sizes = np.diff(np.r_[start, len(token)])
            at = np.arange(len(token)) - np.repeat(start, sizes)
            least = n[start]
            if held is not None:
                at[: sizes[0]] += held_at
                least[0] = held_n
            least = np.repeat(least, sizes)
            met = at > 0
            met[:-1] |= at[1:] > 0
            held, held_at, held_n = table.slice(len(token) - 1), int(at[-1]), int(least[-1])
            yield from grouped(table, token, least, at).slice(0, len(token) - 1).filter(pa.array(met[:-1])).to_batches()
        if held is not None and held_at > 0:
            yield from grouped(held, held["token"].to_numpy(), np.array([held_n]), np.array([held_at])).to_batches()

    def grouped(table, token, least, at):
        group = W.mix(token.view(np.uint64) ^ W.mix(least.astype(np.uint64)))
        return table.set_column(0, "token", pa.array(group.view(np.int64))).append_column("at", pa.array(at.astype(np.int32)))

    # names compare as zero-padded bytes here, which cannot make two different 16-byte names equal
    return entries.repartition("token").sortWithinPartitions("token", "n", "name").mapInArrow(run, "token bigint, name binary, n int, pos int, at int")


def _may_link(num: int, den: int):
    """Condition on two entries x and y of one n-gram: sizes and places leave enough to share.

    Before the n-gram both sets have at most ``before`` members in common, those
    that any other prefix has too; behind it at most what remains of either set.
    """
    n, m = F.col("x.n"), F.col("y.n")
    most = F.least("x.before", "y.before") + 1 + F.least(n - F.col("x.pos") - 1, m - F.col("y.pos") - 1)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most >= F.ceil((n + m) * num / F.lit(num + den) - 1e-9))


def _shared_needed(n, m, num: int, den: int):
    """How many n-grams the prefixes of two sets of these sizes share at least, if the sets are alike enough.

    The set whose prefix ends first in the global order has all common n-grams
    outside of it among its other members, so the rest of the overlap lies in both prefixes.
    """
    overlap = F.ceil((n + m) * num / F.lit(num + den) - 1e-9)
    return F.greatest(F.lit(1), overlap - F.ceil(F.greatest(n, m) * num / F.lit(den) - 1e-9) + 1)


def nearest_leaders(met: DataFrame, num: int, den: int) -> DataFrame:
    """For each set the leader (one of the first sets under an n-gram) it meets under most n-grams: pairs (a, b).

    At most one row per set. Those unlikely to link are left to the later steps.
    """
    x, y = met.where(F.col("at") < LEADERS).alias("x"), met.alias("y")
    shared = x.join(y, "token").where(_may_link(num, den) & (F.col("x.at") < F.col("y.at")))
    shared = shared.groupBy(F.col("y.name").alias("name"), F.col("x.name").alias("leader")).agg(F.count("*").alias("times"), F.max("x.n").alias("n"), F.max("y.n").alias("m"))
    shared = shared.where(F.col("times") * 2 >= _shared_needed(F.col("n"), F.col("m"), num, den))
    best = shared.groupBy("name").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    return best.select(F.least("name", "leader").alias("a"), F.greatest("name", "leader").alias("b")).distinct()


def _band(n, num: int, den: int):
    """Sets that can be alike enough are in the same or in neighbouring bands of sizes."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) * (1 + 1e-6))).cast("int") if num < den else n


def _slack(num: int, den: int):
    """How many more bits the signatures of x and y may differ in; below zero for sets that cannot be alike enough."""
    n, m = F.col("x.n"), F.col("y.n")
    bits = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SIGNATURE[1:]), F.bit_count(F.col(f"x.{SIGNATURE[0]}").bitwiseXOR(F.col(f"y.{SIGNATURE[0]}"))))
    return n + m - 2 * F.ceil((n + m) * num / F.lit(num + den) - 1e-9) - bits


def _in_components(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of sets with ``component``, a 64-bit name of the component that they are in so far."""
    named = near.select(F.col("node").alias("name"), F.col("component").alias("_component"))
    return rows.join(named, "name", "left").withColumn("component", F.xxhash64(F.coalesce("_component", "name"))).drop("_component")


def _open_tokens(rows: DataFrame) -> DataFrame:
    """The n-grams whose sets are not all in one component."""
    tokens = rows.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return tokens.where(F.col("_low") != F.col("_high")).select("token")


def open_entries(met: DataFrame, near: DataFrame, signatures: DataFrame) -> DataFrame:
    """The entries, with signatures, under n-grams whose sets are not all in one component."""
    tokens = _open_tokens(_in_components(met.select("token", "name"), near))
    return written(met.drop("at").join(tokens, "token", "left_semi").join(signatures, "name"), "ngram-open")


def closer_leaders(entries: DataFrame, near: DataFrame, draw: int, num: int, den: int) -> DataFrame:
    """For each set the ``NEAREST`` drawn leaders, in other components, whose signatures leave most room: pairs (a, b).

    Under each n-gram ``DRAWN`` sets lead, the first in orders of all sets that are drawn anew for every ``draw``.
    A set meets at most that many under each n-gram of its prefix.
    """
    rows = _in_components(entries, near)
    fields = ["name", "n", "pos", "before", "component", *SIGNATURE]
    first = [F.min(F.struct(F.xxhash64(F.lit(DRAWN * draw + k), "name").alias("_order"), *fields)).alias(f"_{k}") for k in range(DRAWN)]
    leaders = rows.groupBy("token").agg(*first).select("token", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"_{k}.{c}").alias(c) for c in fields]) for k in range(DRAWN)]))).alias("x")).select("token", "x.*")
    shared = leaders.alias("x").join(rows.alias("y"), "token").where(_may_link(num, den) & (F.col("x.component") != F.col("y.component")) & (_slack(num, den) >= 0))
    best = shared.groupBy(F.col("y.name").alias("name")).agg(F.sort_array(F.collect_set(F.struct(_slack(num, den).alias("slack"), F.col("x.name").alias("leader"))), asc=False).alias("_best"))
    best = best.select("name", F.explode(F.slice("_best", 1, NEAREST)).alias("x")).select("name", "x.leader")
    return best.select(F.least("name", "leader").alias("a"), F.greatest("name", "leader").alias("b")).distinct()


def open_pairs(entries: DataFrame, near: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) of sets in different components whose prefixes share enough n-grams to link, and the tables they are read from.

    Groups whose sets are all in one component are dropped. In any other group sets meet in bands of
    sizes, and only if their signatures differ little enough; the sets of a band are dealt into cells,
    so that many in one group spread over tasks. Components are compared by 64-bit names.
    """
    rows = _in_components(entries, near).withColumn("_band", _band(F.col("n"), num, den))
    tokens = written(_open_tokens(rows), "ngram-open-tokens")
    rows = rows.join(tokens, "token", "left_semi")
    counts = rows.groupBy("token", "_band").agg(F.count("*").alias("_count"))
    # a narrow row for each group and band; few bands need more than one cell
    parts = written(counts.select("token", "_band", F.ceil(F.col("_count") / CELL_ROWS).cast("int").alias("_parts")), "ngram-open-parts")
    large = parts.where("_parts > 1")
    fields = ["name", "n", "pos", "before", "component", "token", *SIGNATURE]
    dealt = lambda sets: F.pmod(F.xxhash64("name"), F.coalesce(F.col(sets), F.lit(1))).cast("int").alias("_i")
    # in each band its own sets, to the left, and those and the next smaller band's, to the right
    left = rows.join(large, ["token", "_band"], "left").select(*fields, "_band", dealt("_parts"))
    right = rows.withColumn("_to", F.explode(F.array(F.col("_band"), F.col("_band") + 1)))
    right = right.join(parts.select("token", F.col("_band").alias("_to"), "_parts"), ["token", "_to"])
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*fields, F.col("_band").alias("_own"), F.col("_to").alias("_band"), "_i")
    apart = F.col("x.component") != F.col("y.component")
    once = (F.col("y._own") < F.col("x._band")) | (F.col("x.name") < F.col("y.name"))
    shared = left.alias("x").join(right.alias("y"), ["token", "_band", "_i"]).where(_may_link(num, den) & apart & once & (_slack(num, den) >= 0))
    a, b = F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")
    shared = shared.groupBy(a, b).agg(F.count("*").alias("times"), F.max("x.n").alias("n"), F.max("y.n").alias("m"))
    return shared.where(F.col("times") >= _shared_needed(F.col("n"), F.col("m"), num, den)).select("a", "b"), [tokens, parts]


def trie_overlaps(probe: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[bool]:
    """Which sets are alike enough to the probing one; all in global order.

    The sets are walked as a trie in preorder: sorted, each keeps the path it
    shares with the one before, with the overlap counted along that path.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    out = [False] * len(sets)
    path = np.zeros(0, np.uint64)
    along = np.zeros(1, np.int64)  # along[d]: members of the probing set among the first d of the path
    for i in order:
        s = sets[i]
        depth = min(len(path), len(s))
        differs = np.flatnonzero(path[:depth] != s[:depth])
        depth = int(differs[0]) if len(differs) else depth
        depth = min(depth, len(along) - 1)
        need = overlap_needed(len(probe), len(s), num, den)
        counted = [along[: depth + 1]]
        have, at = int(along[depth]), depth
        while at < len(s):
            # what remains of the set, and of the probing set
            if have + min(len(s) - at, len(probe) - have) < need:
                break
            block = s[at : at + 64]
            place = np.minimum(np.searchsorted(probe, block), len(probe) - 1)
            more = have + np.cumsum(probe[place] == block)
            counted.append(more)
            have, at = int(more[-1]), at + len(block)
        path, along = s, np.concatenate(counted)
        out[i] = at >= len(s) and have >= need
    return out


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough; ``sets`` has name and members."""
    groups = pairs.groupBy("a").agg(F.count("*").alias("_count"))
    pairs = pairs.join(groups, "a").withColumn("_deal", F.pmod(F.xxhash64("b"), F.ceil(F.col("_count") / TRIE_SETS)).cast("int"))
    probes = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_count") / TRIE_SETS) - 1).cast("int"))))
    probes = probes.join(sets, F.col("a") == F.col("name")).select("a", "_deal", F.lit(None).cast("binary").alias("b"), "members")
    others = pairs.join(sets, F.col("b") == F.col("name")).select("a", "_deal", "b", "members")

    def run(batches):
        key, probe, names, held = None, None, [], []

        def settle():
            if probe is None or not held:
                return None
            yes = [n for n, ok in zip(names, trie_overlaps(probe, held, num, den)) if ok]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(yes), pa.binary()), pa.array(yes, pa.binary())], ["a", "b"]) if yes else None

        for batch in batches:
            columns = [batch.column(c) for c in ("a", "_deal", "b", "members")]
            for i in range(batch.num_rows):
                here = (columns[0][i].as_py(), columns[1][i].as_py())
                other, members = columns[2][i].as_py(), np.frombuffer(columns[3][i].as_buffer(), np.uint64).copy()
                if here != key:
                    if (found := settle()) is not None:
                        yield found
                    key, probe, names, held = here, None, [], []
                if other is None:
                    probe = members
                else:
                    names.append(other)
                    held.append(members)
                    if len(held) >= 2 * TRIE_SETS:  # the probing set came first
                        if (found := settle()) is not None:
                            yield found
                        names, held = [], []
        if (found := settle()) is not None:
            yield found

    dealt = probes.unionByName(others).repartition("a", "_deal").sortWithinPartitions("a", "_deal", F.col("b").isNotNull())
    return dealt.mapInArrow(run, "a binary, b binary")


def ordered_sets(docs: DataFrame, wanted: DataFrame, size: int, frequent) -> DataFrame:
    """name and members, in global order, of the sets of the wanted doc_ids (one document for each set)."""

    def run(batches):
        for batch in batches:
            out = [(set_name(grams), in_order(grams, frequent.value).tobytes()) for _, grams in set_rows(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["name", "members"])

    # a doc_id that repeats, or null, gives sets nobody asked for, or the same set again; neither changes what is linked
    wanted = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")
    return rows.mapInArrow(run, "name binary, members binary")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many members each set of one list shares with each of the other."""
    out = np.zeros((len(one), len(two)), np.int64)
    sizes = [len(s) for s in one] + [len(s) for s in two]
    member, row = np.concatenate(one + two), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(member, kind="stable")
    member, row = member[order], row[order]
    start = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
    times = np.diff(np.r_[start, len(member)])
    met = np.repeat(times > 1, times)
    row, column = row[met], np.repeat(np.arange(np.count_nonzero(times > 1)), times[times > 1])
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
        a, b = np.searchsorted(column, (first, first + LINK_COLUMNS))
        has = np.zeros((len(sizes), LINK_COLUMNS), np.float32)  # sums of up to LINK_COLUMNS ones are exact
        has[row[a:b], column[a:b] - first] = 1
        has = has[:, : int(column[b - 1]) - first + 1]
        out += (has[: len(one)] @ has[len(one) :].T).astype(np.int64)
    return out


def class_links(classes: DataFrame, sets: DataFrame, num: int, den: int, counted: bool) -> DataFrame:
    """All pairs (a, b) of different sets that link; ``counted``: name and n_links, the documents that it links with in other sets.

    ``classes`` has name, n, copies and component of every set that is not alone in its class.
    """
    groups = classes.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / LINK_SETS, F.sum(F.col("n").cast("bigint")) * 8 / LINK_BYTES)).cast("int").alias("_parts"))
    rows = classes.join(groups, "component").join(sets, "name").withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.select("component", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "name", "copies", "members")
    schema = "name binary, n_links bigint" if counted else "a binary, b binary"

    def settle(key, held: dict):
        sides = [[(name, *x[1:]) for name, x in held.items() if x[0] == side] for side in dict.fromkeys(key[1:])]
        one, two = sides[0], sides[-1]
        if not one or not two or len(held) < 2:
            return None
        n, m = (np.array([len(x[2]) for x in side]) for side in (one, two))
        yes = shared_counts([x[2] for x in one], [x[2] for x in two]) >= overlap_needed(n[:, None], m[None, :], num, den)
        if len(sides) == 1:
            yes &= ~np.eye(len(one), dtype=bool) if counted else np.triu(np.ones(yes.shape, bool), 1)
        if counted:
            found = [(x[0], int(c)) for x, c in zip(one, yes @ np.array([x[1] for x in two]))]
            found += [(x[0], int(c)) for x, c in zip(two, np.array([x[1] for x in one]) @ yes)] if len(sides) == 2 else []
            found = [x for x in found if x[1]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], ["name", "n_links"])
        pairs = [sorted((one[i][0], two[j][0])) for i, j in np.argwhere(yes)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.binary())], ["a", "b"])

    def run(batches):
        key, held = None, {}  # a set that was fetched more than once counts once
        for batch in batches:
            columns = [batch.column(c) for c in ("component", "_i", "_j", "_own", "name", "copies", "members")]
            for i in range(batch.num_rows):
                here = tuple(c[i].as_py() for c in columns[:3])
                if here != key:
                    if (found := settle(key, held) if held else None) is not None:
                        yield found
                    key, held = here, {}
                own, name, copies = (c[i].as_py() for c in columns[3:6])
                if name not in held:
                    held[name] = (own, copies, np.frombuffer(columns[6][i].as_buffer(), np.uint64).copy())
        if (found := settle(key, held) if held else None) is not None:
            yield found

    return rows.repartition("component", "_i", "_j").sortWithinPartitions("component", "_i", "_j").mapInArrow(run, schema)


def _classes_of_sets(docs: DataFrame, size: int, num: int, den: int, keep_sets: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, hash, n, name) of all documents; name, first_id, n, copies, component and whether it is alone of every set; with ``keep_sets`` members of those that are not.

    Tables in the shared folder go as soon as what is read from them is written.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    both = written(sets_and_counts(docs, size), "ngram-sets")
    rows = both.where("kind = 0").select("doc_id", "hash", "n", "name")
    signatures = both.where("kind = 0 and n > 0").groupBy("name").agg(*[F.first(c).alias(c) for c in SIGNATURE])
    frequent = spark.sparkContext.broadcast(frequent_grams(both.where("kind = 1")))

    met = met_entries(prefix_entries(docs, size, num, den, frequent), num, den)
    # a set has few rows here, those of its prefix
    before = F.row_number().over(Window.partitionBy("name").orderBy("pos")) - 1
    met = written(met.withColumn("before", before), "ngram-met")
    some = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.count("*").alias("copies"))

    pairs = written(nearest_leaders(met, num, den), "ngram-pairs")
    edges, sets = _verified(docs, pairs, some, size, num, den, frequent, keep_sets)
    near = written(connected(edges, "ngram-near"), "ngram-near")
    entries = open_entries(met, near, signatures)
    discard(met, edges)
    tried, kept = [pairs], [sets]
    for draw in range(DRAWS):
        closer = closer_leaders(entries, near, draw, num, den)
        for former in tried:
            closer = closer.join(former, ["a", "b"], "left_anti")
        tried.append(written(closer, "ngram-closer"))
        edges, sets = _verified(docs, tried[-1], some, size, num, den, frequent, keep_sets)
        kept.append(sets)
        found, former = edges.count(), near
        if found:
            near = written(connected(near.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(edges), "ngram-near"), "ngram-near")
            discard(former)
        discard(edges)
        if found < DRAW_LINKS:
            break
    candidates, used = open_pairs(entries, near, num, den)
    for former in tried:
        candidates = candidates.join(former, ["a", "b"], "left_anti")
    rest = written(candidates, "ngram-rest")
    discard(entries, *tried, *used)
    more, sets = _verified(docs, rest, some, size, num, den, frequent, keep_sets)
    kept.append(sets)

    classes = connected(near.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "ngram-classes")
    named = some.join(classes.withColumnRenamed("node", "name"), "name", "left").withColumn("alone", F.col("component").isNull())
    named = written(named.withColumn("component", F.coalesce("component", "name")), "ngram-named")
    discard(near, rest, more)
    return rows, named, reduce(DataFrame.unionByName, kept) if keep_sets else None


def join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, counted: bool = False) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, component_id, name (of the set), component for every row; two documents link when den * intersection >= num * union.

    With ``counted`` also n_links: the other rows, copies included, that the row links with.
    """
    rows, named, sets = _classes_of_sets(docs, size, num, den, counted)
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = named.join(first, "component").select("name", "component", "component_id", "copies")
    if counted:
        links = class_links(named.where("not alone").drop("first_id", "alone"), sets, num, den, True)
        links = written(links.groupBy("name").agg(F.sum("n_links").alias("n_links")), "ngram-n-links")
        facts = facts.join(links, "name", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    more = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if counted else []
    return (
        rows.join(facts.drop("copies"), "name", "left")
        .select("doc_id", "hash", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "name", "component", *more)
    )


def linked_sets(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) for different sets that link, and (doc_id, name) for the documents of each set; documents of one set link too."""
    rows, named, sets = _classes_of_sets(docs, size, num, den, True)
    links = class_links(named.where("not alone").drop("first_id", "alone"), sets, num, den, False)
    return written(links, "ngram-all-links"), rows.where("n > 0").select("doc_id", "name")


def _verified(docs: DataFrame, pairs: DataFrame, some: DataFrame, size: int, num: int, den: int, frequent, keep_sets: bool) -> tuple[DataFrame, DataFrame | None]:
    """The pairs that link, and, if they are kept, the sets of all pairs."""
    names = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    wanted = written(names.join(some, "name").select(F.col("first_id").alias("doc_id")), "ngram-wanted")
    sets = written(ordered_sets(docs, wanted, size, frequent), "ngram-members")
    found = written(linked(pairs, sets, num, den), "ngram-links")
    discard(wanted, *([] if keep_sets else [sets]))
    return found, sets if keep_sets else None


def classes(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return join(docs, size, num, den).select("doc_id", "n_shingles", "component_id")


def links(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links."""
    return join(docs, size, num, den, counted=True).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id, null as the largest, of several such texts that of the smallest hash.

    Documents without words are no class and stay; of equal rows, in id and text, one stays where they are of a class.
    """
    rows = written(join(docs, size, num, den).where("n_shingles > 0").select("doc_id", "hash", "component"), "ngram-kept")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = rows.groupBy("component").agg(F.min(place).alias("_best"), F.count("*").alias("_rows")).where("_rows > 1")
    best = written(best.select("_best.doc_id", "_best.hash", "component"), "ngram-best")
    # rows that are not their class's best; a (doc_id, hash) is one text and so of one class
    several = rows.join(best.select("component"), "component", "left_semi").select("doc_id", "hash").distinct()
    gone = several.join(best.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti")
    again = rows.groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    here = lambda t: F.col("_id").eqNullSafe(t["doc_id"]) & (F.col("_hash") == t["hash"])
    left = marked.join(gone, here(gone), "left_anti")
    once = left.join(again, here(again), "left_semi").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return left.join(again, here(again), "left_anti").select("_row.*").unionByName(once.select("_row.*"))
