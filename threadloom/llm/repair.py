"""Token-id files with Re-Pair grammar compression.

Documents are encoded with the tokenizers library, an end id is appended, and the
ids are written in ascending order of doc_id. A file row is one block of about a
million ids with a grammar of its own: frequent pairs of symbols are replaced by
nonterminals until no pair occurs ``MIN_COUNT`` times, and the row keeps the
rules, the length of every rule's expansion, the remaining sequence and where
each document begins in it. A document is decoded from its own stretch; its
length is known from the expansion lengths without decoding.

Many pairs are replaced at once. The first rounds take the most frequent ones, by
counts in hashed slots of which each stands for one pair. Later rounds take all
frequent pairs, counted exactly, and look only next to symbols that the round
before made; when that finds none, the whole sequence is looked at again, and
only if that finds none either is the grammar done. Of overlapping places
the more frequent pair's is taken, of a symbol's run every second one. No pair
spans two documents.

Texts are cut at spaces and line ends, where the tokenizer's own split cannot
join, and each distinct word is encoded once while a task remembers it. The
tokenizer's own special tokens are recognised in texts, as the library does.

Rows are dealt into ranges of (doc_id, hash of the text), so that a doc_id with
very many rows spreads too, and blocks are cut while a range streams through a
task. Blocks know where they start in their range, so only one number per range
is added up.

Defined cases: null and empty texts are the end id alone; a null doc_id comes
before all others; rows of equal doc_id follow each other by a hash of their
texts; a text longer than a block is a block of its own; an empty table gives no rows.
"""

import functools
import math
import os
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
#: Ranges are tasks; more text than this many times RANGE_BYTES makes longer ranges, which stream all the same.
MAX_RANGES = 100_000
BLOCK_IDS = 1 << 20
FIRST_ROUNDS = 2
RULES = 4096
MIN_COUNT = 8
SLOT_BITS = 20
#: Words whose ids a task keeps; beyond them it starts anew.
KEPT = 1_000_000
#: Words whose ids are put together at once.
GATHERED = 1 << 18
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # all of ASCII but the apostrophe, which begins contractions
BLOCK_TYPE = "range int, block int, start_in_range bigint, n_ids bigint, first_nonterminal int, doc_ids array<{id}>, doc_starts binary, rules binary, lengths binary, low binary, high binary"


class Grammar(NamedTuple):
    """``rules[k]`` are the two symbols of nonterminal first + k; ``ends`` the places after each document in ``sequence``."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    ends: np.ndarray


class _Numbers(dict):
    """Numbers strings as they first occur; ``fresh`` lists those without ids yet."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, text):
        number = self[text] = len(self)
        self.fresh.append(text)
        return number


class _Grown:
    """An array that grows in large steps."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(len(self.data), end - self.size), self.data.dtype)])
        self.data[self.size : end] = values
        self.size = end


def _stretches(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of all stretches, one after the other."""
    ahead = np.cumsum(size) - size
    return values[np.repeat(begin - ahead, size) + np.arange(int(size.sum()))]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordCoder:
    """Ids of texts, each distinct word encoded once.

    For a tokenizer that lower-cases, drops white space, keeps letters apart from
    punctuation and ends words with a mark. A word of letters and the punctuation
    after it are pieces of their own. Texts of Latin-1 characters, which hold
    nothing that joins with another character, are lower-cased first.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the model's spelling of the bytes of every character of Latin-1 that lowered text can hold
        self._spelling = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256)}
        self._as_bytes = lambda x: x.translate(self._spelling)
        probe = ["token", "Été", "größe", "x"]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        self.direct = whole == [[t.id for t in self.tokenizer.model.tokenize(self._as_bytes(x.lower()))] for x in probe]
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = _Numbers(), _Numbers()
        self.piece_begin, self.piece_size, self.piece_ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32)
        self.begin, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32)  # of each word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > KEPT:
            self.forget()
        number = self.words.__getitem__
        found = []
        for text in texts:
            words = self._plain(text).replace("\n", " ").split(" ")
            found.append(np.fromiter(map(number, words), np.int32, len(words)))
        self._learn()
        out, first, held = [], 0, 0
        for i, f in enumerate(found):
            held += len(f)
            if held >= GATHERED or i == len(found) - 1:
                out += self._ids_of(found[first : i + 1])
                first, held = i + 1, 0
        return out

    def _plain(self, text: str) -> str:
        try:
            low = text.encode("latin-1").lower().decode("latin-1")
        except UnicodeEncodeError:
            return text
        # special tokens are looked for before letters are lowered
        return text if any(t in low for t in self.special) else low

    def _learn(self) -> None:
        words, self.words.fresh = self.words.fresh, []
        if not words:
            return
        known = []  # pieces of each word, the second -1 where there is none
        number = self.pieces.__getitem__
        for word in words:
            stem = word.rstrip(PUNCTUATION)
            # a letter may become a letter and a mark, which goes with the punctuation
            if len(stem) < len(word) and stem.isalpha() and (stem.isascii() or stem.lower()[-1].isalpha()):
                known += number(stem), number(word[len(stem) :])
            else:
                known += number(word), -1
        self._learn_pieces()
        pieces = np.array(known, np.int64)
        begin, size = self.piece_begin.data[pieces], np.where(pieces < 0, 0, self.piece_size.data[pieces])
        both = size.reshape(-1, 2).sum(axis=1)
        self.begin.extend(self.ids.size + np.cumsum(both) - both)
        self.size.extend(both)
        self.ids.extend(_stretches(self.piece_ids.data, begin, size))

    def _learn_pieces(self) -> None:
        pieces, self.pieces.fresh = self.pieces.fresh, []
        # a piece of letters is one word to the library's model; all others go through its whole pipeline
        ids, sizes, places, rest = [], [], [], []
        tokenize, as_bytes = self.tokenizer.model.tokenize, self._as_bytes
        for i, x in enumerate(pieces):
            if self.direct and x.isalpha() and ((ascii := x.isascii()) or _is_latin(x)):
                found = [t.id for t in tokenize(x.lower() if ascii else as_bytes(x.lower()))]
                ids += found
                sizes.append(len(found))
                places.append(i)
            else:
                rest.append(i)
        for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False):
            found = e.ids
            ids += found
            sizes.append(len(found))
        size = np.array(sizes, np.int64)
        place = np.array(places + rest, np.int64)
        begin, in_order = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begin[place], in_order[place] = self.piece_ids.size + np.cumsum(size) - size, size
        self.piece_begin.extend(begin)
        self.piece_size.extend(in_order)
        self.piece_ids.extend(np.array(ids, np.int32))

    def _ids_of(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of texts, given the numbers of their words."""
        words = np.concatenate(found)
        size = self.size.data[words]
        ids = _stretches(self.ids.data, self.begin.data[words], size)
        ends = np.cumsum(size)[np.cumsum([len(f) for f in found]) - 1]  # a text has at least one word, if an empty one
        return np.split(ids, ends[:-1])


@functools.lru_cache(maxsize=2)
def coder(tokenizer_file: str) -> WordCoder:
    return WordCoder(tokenizer_file)


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    slot = left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(0x2C1B3C6D)
    slot >>= np.uint32(32 - SLOT_BITS)
    return slot


def _whole_slots(sequence: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all pairs and their counts; a pair that would span documents has the slot behind all others, of count 0."""
    slot = _slots(sequence[:-1], sequence[1:])
    slot[last[:-1]] = 1 << SLOT_BITS
    counts = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)
    counts[-1] = 0
    return slot, counts


def _top_pairs(sequence: np.ndarray, last: np.ndarray, rules: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of the most frequent slots, each slot for one of its pairs, and the pair's number there."""
    slot, counts = _whole_slots(sequence, last)
    top = np.flatnonzero(counts >= min_count)
    if len(top) > rules:
        top = np.sort(top[np.argpartition(counts[top], -rules)[-rules:]])
    rank = np.full(len(counts), -1, dtype=np.int16)
    rank[top] = np.arange(len(top))
    ranks = rank[slot]
    places = np.flatnonzero(ranks >= 0)
    ranks = ranks[places]
    stands = np.zeros(len(top), dtype=np.int64)
    stands[ranks] = places
    left, right = sequence[stands], sequence[stands + 1]
    same = (sequence[places] == left[ranks]) & (sequence[places + 1] == right[ranks])
    return places[same], ranks[same]


def _all_pairs(sequence: np.ndarray, last: np.ndarray, recent: int | None, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that occur often enough, and the pair's number there; with ``recent`` only of pairs with a symbol from there on."""
    if recent is None:
        slot, counts = _whole_slots(sequence, last)
        places = np.flatnonzero((counts >= min_count)[slot])
    else:
        new = np.flatnonzero(sequence >= recent)
        places = np.union1d(new, new - 1)
        places = places[(places >= 0) & (places < len(sequence) - 1)]
        places = places[~last[places]]
    pair = sequence[places].astype(np.uint64) << np.uint64(32) | sequence[places + 1]
    _, number, counts = np.unique(pair, return_inverse=True, return_counts=True)
    often = counts[number] >= min_count
    return places[often], number[often]


def _every_second(place: np.ndarray, rank: np.ndarray, alike: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring places (``alike``: of the same pair) every second one."""
    near = np.diff(place) == 1
    run = np.flatnonzero(np.r_[True, ~(near & (np.diff(rank) == 0)) if alike else ~near])
    every = (place - np.repeat(place[run], np.diff(np.r_[run, len(place)]))) % 2 == 0
    return place[every], rank[every]


def _often(place: np.ndarray, rank: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bincount(rank, minlength=1)[rank] >= min_count
    return place[keep], rank[keep]


def _most_frequent(place: np.ndarray, rank: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that do not overlap: a place stays if its pair is more frequent than those of its neighbours.

    The most frequent pair keeps all its places, so the result is empty only if no pair is frequent.
    """
    if not len(place):
        return place, rank
    place, rank = _often(*_every_second(place, rank, True), min_count)
    weight = np.bincount(rank, minlength=1)[rank] * (1 << 32) + rank
    beaten = np.zeros(len(place), bool)
    near = np.diff(place) == 1
    beaten[1:] |= near & (weight[:-1] > weight[1:])
    beaten[:-1] |= near & (weight[1:] > weight[:-1])
    return _often(place[~beaten], rank[~beaten], min_count)


def compress(ids: np.ndarray, ends: np.ndarray, first: int, rules: int = RULES, min_count: int = MIN_COUNT) -> Grammar:
    """Grammar of the ids of several documents; ``ends[i]`` is the place after document i, ``first`` above all ids."""
    sequence = ids.astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)  # last symbol of a document
    last[ends - 1] = True
    pairs = [np.zeros((0, 2), np.int64)]
    symbol, done, recent = first, 0, None  # recent: symbols from this one on are of the last round
    while True:
        if len(sequence) < 2:
            break
        if done < FIRST_ROUNDS:
            place, rank = _top_pairs(sequence, last, rules, min_count)
            place, rank = _often(*_every_second(place, rank, False), min_count) if len(place) else (place, rank)
        else:
            place, rank = _most_frequent(*_all_pairs(sequence, last, recent, min_count), min_count)
        done += 1
        if not len(place):
            if recent is None and done >= FIRST_ROUNDS:
                break
            recent, done = None, max(done, FIRST_ROUNDS)
            continue
        used = np.flatnonzero(np.bincount(rank))
        number = np.zeros(used[-1] + 1, dtype=np.int64)
        number[used] = np.arange(len(used))
        number = number[rank]
        stands = np.zeros(len(used), dtype=np.int64)
        stands[number] = place
        pairs.append(np.stack([sequence[stands], sequence[stands + 1]], axis=1).astype(np.int64))
        sequence[place] = symbol + number
        last[place] |= last[place + 1]
        stay = np.ones(len(sequence), dtype=bool)
        stay[place + 1] = False
        sequence, last = sequence[stay], last[stay]
        recent = symbol if done >= FIRST_ROUNDS + 1 else None
        symbol += len(used)
    table = np.concatenate(pairs).astype(np.int32)
    lengths = np.ones(len(table), dtype=np.int64)
    at = 0
    for step in pairs[1:]:  # a round's rules are made of what was there before it
        sides = np.where(step < first, 1, lengths[np.maximum(step - first, 0)])
        lengths[at : at + len(step)] = sides.sum(axis=1)
        at += len(step)
    return Grammar(first, table, lengths.astype(np.int32), sequence.astype(np.int32), np.flatnonzero(last) + 1)


def expand(grammar: Grammar, part: np.ndarray) -> np.ndarray:
    """Ids that a stretch of the sequence stands for."""
    part = part.astype(np.int32)
    while True:
        rule = part >= grammar.first
        if not rule.any():
            return part
        ahead = np.cumsum(rule) - rule + np.arange(len(part))
        out = np.empty(len(part) + int(rule.sum()), dtype=np.int32)
        out[ahead[~rule]] = part[~rule]
        both = grammar.rules[part[rule] - grammar.first]
        out[ahead[rule]], out[ahead[rule] + 1] = both[:, 0], both[:, 1]
        part = out


def expand_all(grammar: Grammar) -> np.ndarray:
    """Ids of the whole sequence: every rule is spelled out once, those made of others after them."""
    rules, first = grammar.rules.astype(np.int64), grammar.first
    sizes = grammar.lengths.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int32)
    depth = np.zeros(len(rules), np.int64)
    inner = np.maximum(rules - first, 0)
    while len(rules) and (deeper := np.where(rules < first, 0, depth[inner] + 1).max(axis=1)).any() and (deeper != depth).any():
        depth = deeper
    for d in range(int(depth.max(initial=-1)) + 1):
        at = np.flatnonzero(depth == d)
        left = np.where(rules[at, 0] < first, 1, sizes[inner[at, 0]])
        for symbol, to in ((rules[at, 0], begin[at]), (rules[at, 1], begin[at] + left)):
            _spell(flat, to, symbol, first, flat, begin, sizes)
    length = np.ones(len(grammar.sequence), np.int64)
    rule = grammar.sequence >= first
    length[rule] = sizes[grammar.sequence[rule] - first]
    out = np.empty(int(length.sum()), np.int32)
    _spell(out, np.cumsum(length) - length, grammar.sequence.astype(np.int64), first, flat, begin, sizes)
    return out


def _spell(out: np.ndarray, to: np.ndarray, symbols: np.ndarray, first: int, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
    """Write what each symbol stands for to its place."""
    rule = symbols >= first
    out[to[~rule]] = symbols[~rule]
    to, number = to[rule], symbols[rule] - first
    size = sizes[number]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = flat[np.repeat(begin[number], size) + step]


def document_lengths(grammar: Grammar) -> np.ndarray:
    """Number of ids of each document, from the expansion lengths."""
    sizes = np.ones(len(grammar.sequence), dtype=np.int64)
    rule = grammar.sequence >= grammar.first
    sizes[rule] = grammar.lengths[grammar.sequence[rule] - grammar.first]
    return np.diff(np.r_[0, np.cumsum(sizes)[grammar.ends - 1]]) if len(grammar.ends) else np.zeros(0, np.int64)


def document(grammar: Grammar, number: int) -> np.ndarray:
    """Ids of one document, without decoding the others."""
    return expand(grammar, grammar.sequence[grammar.ends[number - 1] if number else 0 : grammar.ends[number]])


def grammar_of(row: dict) -> Grammar:
    """Grammar of a file row."""
    low, high = np.frombuffer(row["low"], "<u2").astype(np.int32), np.frombuffer(row["high"], "<u2").astype(np.int32)
    return Grammar(row["first_nonterminal"], np.frombuffer(row["rules"], "<i4").reshape(-1, 2), np.frombuffer(row["lengths"], "<i4"), low | high << 16, np.frombuffer(row["doc_starts"], "<i8"))


def blocks(docs: DataFrame, tokenizer_file: str, end_id: int, range_bytes: int = RANGE_BYTES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """File rows of the documents' ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = min(MAX_RANGES, max(1, math.ceil(total / range_bytes)))
    text = F.coalesce("text", F.lit(""))
    order = [F.asc_nulls_first("doc_id"), F.col("_hash")]
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def pack(batches):
        own = coder(tokenizer_file)
        state = {"range": TaskContext.get().partitionId(), "block": 0, "start": 0}
        held: list[tuple] = []
        size, id_type = 0, pa.int64()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            id_type = batch.schema.field("doc_id").type
            for start in range(0, len(texts), 512):
                coded = own.encode([t.as_py() for t in texts[start : start + 512]])
                for doc_id, found in zip(ids[start : start + 512], coded):
                    if held and size + len(found) + 1 > block_ids:
                        yield _row(held, state, id_type)
                        held, size = [], 0
                    held.append((doc_id, np.append(found, end_id)))
                    size += len(found) + 1
        if held:
            yield _row(held, state, id_type)

    return rows.select("doc_id", "text").mapInArrow(pack, BLOCK_TYPE.format(id=kind))


def _row(held: list[tuple], state: dict, id_type: pa.DataType) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in held])
    grammar = compress(ids, np.cumsum([len(x) for _, x in held]), int(ids.max()) + 1)
    values = {
        "range": pa.array([state["range"]], pa.int32()),
        "block": pa.array([state["block"]], pa.int32()),
        "start_in_range": pa.array([state["start"]], pa.int64()),
        "n_ids": pa.array([len(ids)], pa.int64()),
        "first_nonterminal": pa.array([grammar.first], pa.int32()),
        "doc_ids": pa.array([[d for d, _ in held]], pa.list_(id_type)),
        "doc_starts": pa.array([grammar.ends.astype("<i8").tobytes()], pa.binary()),
        "rules": pa.array([grammar.rules.astype("<i4").tobytes()], pa.binary()),
        "lengths": pa.array([grammar.lengths.astype("<i4").tobytes()], pa.binary()),
        "low": pa.array([grammar.sequence.astype("<u2").tobytes()], pa.binary()),
        "high": pa.array([(grammar.sequence >> 16).astype("<u2").tobytes()], pa.binary()),
    }
    state["block"] += 1
    state["start"] += len(ids)
    return pa.RecordBatch.from_arrays(list(values.values()), list(values))


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Write the documents' ids as Parquet files of grammar blocks."""
    blocks(docs, tokenizer_file, end_id).write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document in the files."""
    return _decoded(files, "ids array<int>", lambda ids: ids.tolist())


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decoded ids."""
    rows = _decoded(files, "n_tokens bigint, ids_crc32 bigint", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def _decoded(files: DataFrame, columns: str, result) -> DataFrame:
    # one row per range, at most MAX_RANGES
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = files.join(F.broadcast(sums), "range").withColumn("start", F.col("before") + F.col("start_in_range"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar = grammar_of(row)
                ids = expand_all(grammar)
                sizes = document_lengths(grammar)
                stops = np.cumsum(sizes)
                out = [result(ids[b - n : b]) for n, b in zip(sizes, stops)]
                data = [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["start"] + stops - sizes, pa.int64())]
                data += [pa.array([x[k] for x in out], pa.int64()) for k in range(2)] if len(names) == 2 else [pa.array(out, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(data, ["doc_id", "start", *names])

    wanted = rows.select("doc_ids", "start", "first_nonterminal", "rules", "lengths", "low", "high", "doc_starts")
    return wanted.mapInArrow(run, f"doc_id {kind}, start bigint, {columns}")
