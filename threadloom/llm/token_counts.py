"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A pre-token is a run without white space (as Unicode has it), with a mark for
the word's beginning. Its count is that of its best segmentation: the pieces with
the largest sum of scores, fewer pieces on a tie. The forward score of a place
depends only on the characters before it. So the distinct pre-tokens of a task
are put in one trie, every node keeps the forward score and the number of pieces
of the best way to it, and a new pre-token is scored from the first character on
that no earlier one shares with it. A document adds up the counts at the
terminals of its pre-tokens. At ``NODES`` nodes the trie starts anew; pre-tokens
above ``LONG`` characters are scored without it, a window of the longest piece at
a time.

The vocabulary is a list of pieces with scores. A local sentencepiece file gives
pieces but no probabilities, so its pieces are scored by Zipf's law on their
place in the file, log(1 / (place + 1)). A character that is no piece counts as
its UTF-8 bytes, each scored below all pieces.

Defined cases: null and empty texts have no pre-tokens and no tokens; repeated
rows give repeated rows; texts may be of any length; an empty table gives no rows.
"""

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BYTE_PENALTY = 10.0
#: Nodes of a task's trie, and pre-tokens whose counts it keeps; beyond them it starts anew.
NODES = 1_500_000
KEPT = 400_000
LONG = 4096


class Vocabulary(NamedTuple):
    scores: dict[str, float]
    lengths: dict[str, tuple[int, ...]]  # lengths of the pieces that end with a character
    byte_score: float
    longest: int


def vocabulary(pieces: list[tuple[str, float]]) -> Vocabulary:
    scores = dict(pieces)
    lengths: dict[str, set[int]] = {}
    for piece in scores:
        lengths.setdefault(piece[-1], set()).add(len(piece))
    return Vocabulary(scores, {c: tuple(sorted(n)) for c, n in lengths.items()}, min(scores.values(), default=0.0) - BYTE_PENALTY, max(map(len, scores), default=1))


@functools.lru_cache(maxsize=2)
def load(model_file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return vocabulary([(name, -math.log(place + 1)) for place, name in enumerate(names, 1)])


class Trie:
    """Forward scores of all prefixes of the pre-tokens that were put in; node 0 is the empty one."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and character to node
        self.best, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Number of tokens of a pre-token; only nodes that are new are scored."""
        scores, lengths, byte_score, _ = self.known
        child, best, count = self.child, self.best, self.count
        path = MARK + word
        if len(path) > LONG:
            return self._long(path)
        nodes = [0]
        node = 0
        for end, last in enumerate(path, 1):
            key = node * 0x110000 + ord(last)
            node = child.get(key, -1)
            if node < 0:
                top, least = None, 0
                if last not in scores:
                    size = len(last.encode())
                    top, least = best[nodes[-1]] + size * byte_score, count[nodes[-1]] + size
                for length in lengths.get(last, ()):
                    if length > end:
                        break
                    score = scores.get(path[end - length : end])
                    if score is not None:
                        before = nodes[end - length]
                        score += best[before]
                        tokens = count[before] + 1
                        if top is None or score > top or (score == top and tokens < least):
                            top, least = score, tokens
                node = child[key] = len(best)
                best.append(top)
                count.append(least)
            nodes.append(node)
        return count[node]

    def _long(self, path: str) -> int:
        scores, lengths, byte_score, longest = self.known
        kept = longest + 1
        best, count = [0.0] * kept, [0] * kept  # place modulo the window
        for end, last in enumerate(path, 1):
            top, least = None, 0
            if last not in scores:
                size = len(last.encode())
                top, least = best[(end - 1) % kept] + size * byte_score, count[(end - 1) % kept] + size
            for length in lengths.get(last, ()):
                if length > end:
                    break
                score = scores.get(path[end - length : end])
                if score is not None:
                    score += best[(end - length) % kept]
                    tokens = count[(end - length) % kept] + 1
                    if top is None or score > top or (score == top and tokens < least):
                        top, least = score, tokens
            best[end % kept], count[end % kept] = top, least
        return count[len(path) % kept]


class _Numbers(dict):
    """Numbers pre-tokens as they first occur; ``fresh`` lists those without a count yet."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document."""

    def run(batches):
        trie = Trie(load(model_file))
        numbers, stored = _Numbers(), np.zeros(0, np.int64)
        for batch in batches:
            pre, tokens = [], []
            texts = batch.column("text")
            for start in range(0, len(texts), 64):
                if len(numbers) > KEPT or len(trie.best) > NODES:
                    numbers, stored = _Numbers(), np.zeros(0, np.int64)
                    trie.clear()
                found = [np.fromiter(map(numbers.__getitem__, (x.as_py() or "").split()), np.int64) for x in texts[start : start + 64]]
                if len(numbers) > len(stored):
                    fresh, numbers.fresh = numbers.fresh, []
                    stored = np.concatenate([stored, np.fromiter(map(trie.tokens, fresh), np.int64, len(fresh))])
                pre += [len(f) for f in found]
                tokens += [int(stored[f].sum()) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
