"""Periodic runs of words by a sparse dynamic program over diagonals.

A run with smallest period q is a stretch of at least max(12, 2q) words whose
words q apart are identical. On the diagonal of lag q, the words that equal the
one q before them, it is a match stretch of at least max(q, 12 - q) words, and
maximal there. So runs are the ends of match lengths on diagonals:

* Lags below ``NEAR`` are followed word by word, all words of a slice at once.
* For longer lags a word's earlier occurrences would make long texts with
  frequent words quadratic, so the program steps over blocks: for lags from 2b
  to 4b it looks at every b-th block of b words. A match stretch of 2b words
  contains a whole such block, its earlier occurrence at this lag starts an
  active diagonal, or lengthens it by b if the block before had one too. A
  diagonal ends where a block lacks the occurrence; its two ends are then moved
  by less than b words to where the match really begins and ends, and it is
  emitted if long enough. There are n / b blocks and 2b lags for each b, so
  even a text of one word alone takes O(n) steps for each doubling of b.

Only blocks whose words occur again in their text go to the next b. Stretches
are compared by 64-bit hashes of words. A multiple of a run's period gives the
same stretch again, the smallest is kept.

Texts of a slice of a few megabytes lie one behind the other; a match never
crosses from one text to the next. A longer text is a slice of its own.
"""

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm import words as W

NEAR = 16
LEAST = 12
#: Pairs of a block and a lag that are held at once.
PAIRS = 1 << 21
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(1389796271))


class Runs(NamedTuple):
    """Places are word numbers of the slice; in order of start, then period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class _Stretches:
    """Compares stretches of words by two polynomial hashes of their prefixes."""

    def __init__(self, h: np.ndarray):
        self.sums, self.powers = [], []
        for p, base in zip(_PRIMES, _BASES):
            power = np.ones(len(h) + 1, np.uint64)
            done = 1
            while done < len(power):  # the next stretch is the known one times base ** done
                factor = power[done - 1] * base % p
                power[done : 2 * done] = power[: len(power[done : 2 * done])] * factor % p
                done *= 2
            self.powers.append(power)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h % p * power[:-1] % p)]) % p)

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from x on equal those from y on; y <= x."""
        out = np.ones(len(x), bool)
        for p, s, power in zip(_PRIMES, self.sums, self.powers):
            one, two = (s[x + size] + p - s[x]) % p, (s[y + size] + p - s[y]) % p
            out &= two * power[x - y] % p == one
        return out

    def reach(self, x: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most ``most``, match those ``lag`` before them, from x on or, ``back``, before x."""
        known = np.zeros(len(x), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            grown = known + step
            fits = np.flatnonzero(grown <= most)
            at = x[fits] - grown[fits] if back else x[fits] + known[fits]
            size = grown[fits] if back else np.full(len(fits), step)
            known[fits] += np.where(self.equal(at, at - lag[fits], size), step, 0)
        return known


def _near(h: np.ndarray, text: np.ndarray):
    """Match stretches (begin, end) on the diagonals of the lags below NEAR."""
    for lag in range(1, min(NEAR, len(h))):
        same = (h[lag:] == h[:-lag]) & (text[lag:] == text[:-lag])
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        begin, end = edge[::2] + lag, edge[1::2] + lag
        yield begin, end, np.full(len(begin), lag)


def _far(h: np.ndarray, text: np.ndarray, first: np.ndarray):
    """Match stretches of at least the lag's length on the diagonals of the lags from NEAR on."""
    b = NEAR // 2
    n = len(h)
    if n < 2 * NEAR:
        return
    name = np.zeros(n - b + 1, np.uint64)
    for k in range(b):
        name = name * np.uint64(0xA0761D6478BD642F) + h[k : n - b + 1 + k]
    at = np.flatnonzero(text[: n - b + 1] == text[b - 1 :])
    name = W.mix(name[at] + text[at].astype(np.uint64) * _GOLD)
    stretches = None
    while True:
        order = np.argsort(name, kind="stable")  # at ascends, so equal names are in order of place
        name, at = name[order], at[order]
        again = np.zeros(len(name), bool)
        again[1:] = name[1:] == name[:-1]
        again[:-1] |= again[1:]
        name, at = name[again], at[again]
        if not len(at):
            return
        group = np.cumsum(np.r_[False, name[1:] != name[:-1]])
        # the blocks to look at, and where the earlier occurrences with lags from 2b to 4b are
        code = group * n + at
        blocks = np.flatnonzero(at % b == 0)
        low = np.searchsorted(code, group[blocks] * n + np.maximum(at[blocks] - 4 * b + 1, 0))
        high = np.searchsorted(code, group[blocks] * n + np.maximum(at[blocks] - 2 * b + 1, 0))
        if (high > low).any() and stretches is None:
            stretches = _Stretches(h)
        narrow = min(2 * b, max(1, PAIRS // max(1, len(blocks))))
        for lag_from in range(2 * b, 4 * b, narrow) if (high > low).any() else ():
            lag_to = min(lag_from + narrow, 4 * b)
            lo = np.searchsorted(code, group[blocks] * n + np.maximum(at[blocks] - lag_to + 1, 0)) if narrow < 2 * b else low
            hi = np.searchsorted(code, group[blocks] * n + np.maximum(at[blocks] - lag_from + 1, 0)) if narrow < 2 * b else high
            count = np.maximum(hi - lo, 0)
            block = np.repeat(at[blocks], count)
            place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            lag = block - at[place]
            if not len(lag):
                continue
            # blocks that follow each other on a diagonal are one active stretch
            order = np.lexsort((block, lag))
            block, lag = block[order], lag[order]
            new = np.r_[True, (lag[1:] != lag[:-1]) | (block[1:] != block[:-1] + b)]
            begin, end, lag = block[new], block[np.r_[new[1:], True]] + b, lag[new]
            own = text[begin]
            begin = begin - stretches.reach(begin, lag, np.minimum(begin - lag - first[own], b), True)
            end = end + stretches.reach(end, lag, np.minimum(first[own + 1] - end, b), False)
            yield begin, end, lag
        # names of twice the length, where both halves occur again
        order = np.argsort(at)
        at, name = at[order], name[order]
        half = np.searchsorted(at, at + b)
        whole = np.flatnonzero((half < len(at)) & (at[np.minimum(half, len(at) - 1)] == at + b))
        whole = whole[text[at[whole]] == text[at[half[whole]]]]
        name = W.mix(name[whole] * np.uint64(0xD6E8FEB86659FD93) + name[half[whole]])
        at = at[whole]
        b *= 2


def find_runs(h: np.ndarray, first: np.ndarray, least: int = LEAST) -> Runs:
    """All runs in texts of words; ``first[i]:first[i + 1]`` are the words of text i."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for source in (_near(h, text), _far(h, text, first)):
        for begin, end, lag in source:
            long = end - begin >= np.maximum(lag, least - lag)
            found.append(np.stack([begin[long] - lag[long], end[long], lag[long]]))
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return Runs(start[order], end[order], period[order])


def extra_words(runs: Runs, n: int) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs.start + runs.period, 1)
    np.add.at(depth, runs.end, -1)
    return np.cumsum(depth[:-1]) > 0


def planted(doc_id, n: int) -> np.ndarray | None:
    """For a tenth of the documents, the word that each place takes: from a place on, the words repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


_COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _slice_rows(ids: list, part: pa.Array, edit: bool):
    # words as they stand: the hash of find_words folds case, so words are hashed here
    text = W.text_bytes(part)
    found = W.find_words(text, W.NOT_SPACE, fold=False)
    source = np.arange(len(found.starts))
    if edit:
        for i, doc_id in enumerate(ids):
            a, b = found.first[i], found.first[i + 1]
            if (order := planted(doc_id, int(b - a))) is not None:
                source[a:b] = a + order
    runs = find_runs(found.hashes[source], found.first)
    kept = ~extra_words(runs, len(source))
    begin = np.searchsorted(runs.start, found.first)
    raw = text.data.tobytes()
    starts, ends = found.starts[source].tolist(), found.ends[source].tolist()
    for i in range(len(part)):
        a, b = int(found.first[i]), int(found.first[i + 1])
        mine = slice(begin[i], begin[i + 1])
        start, length, period = runs.start[mine] - a, runs.end[mine] - runs.start[mine], runs.period[mine]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
        left = b" ".join(raw[starts[k] : ends[k]] for k in (np.flatnonzero(kept[a:b]) + a).tolist())
        top = int(np.lexsort((period, start, -length))[0]) if len(start) else None
        best = [None] * 4 if top is None else [int(start[top]), int(length[top]), int(period[top]), 1000 * int(length[top]) // int(period[top])]
        yield (len(start), *best, lines, left)


def report(docs: DataFrame, edit: bool = True) -> DataFrame:
    """doc_id and digests of the runs of every row of (doc_id, text).

    ``edit`` first makes the last words of a tenth of the documents repeat, by doc_id.
    Defined cases: null and empty texts, and texts of white space, have no words
    and no runs; a null doc_id is never edited; repeated rows stay repeated; an
    empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, part in W.slices(batch.column("text")):
                rows = list(_slice_rows(ids[at : at + len(part)], part, edit))
                columns = list(zip(*rows))
                numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in c]) for c in ([lines.encode() for lines in columns[5]], columns[6])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *numbers, *digests], names)

    names = ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_COLUMNS}")


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: one row for each run, places in words from 0."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, part in W.slices(batch.column("text")):
                found = W.find_words(W.text_bytes(part), W.NOT_SPACE, fold=False)
                runs = find_runs(found.hashes, found.first)
                row = np.searchsorted(found.first, runs.start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)).take(pa.array(row)), pa.array(runs.start - found.first[row]), pa.array(runs.end - runs.start), pa.array(runs.period)], ["doc_id", "start", "length", "period"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, period bigint")
