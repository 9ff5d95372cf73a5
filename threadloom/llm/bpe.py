"""Byte-level BPE encoding and decoding.

The tiktoken library encodes with a local rank file. A long text is first cut at
safe boundaries, so memory and time per call stay bounded; decoding joins raw
token bytes, so any run of ids decodes to exact bytes.

Defined cases: a null text counts as empty; an empty text has no ids; repeated
rows give repeated results; special-token strings are ordinary text; other
columns, null or not, pass through; ids outside the vocabulary raise KeyError.
"""

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1 << 16
# The split pattern has no match that spans a letter or digit and the space after it, or an ASCII letter and a digit.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, limit: int = CHUNK_CHARS):
    """Cut a text after at least ``limit`` characters at the next safe boundary."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text) or not text:
        yield text[start:]


def encode_text(coder, text: str | None, limit: int = CHUNK_CHARS) -> np.ndarray:
    parts = [coder.encode_to_numpy(part, disallowed_special=()) for part in chunks(text or "", limit)]
    return (np.concatenate(parts) if len(parts) > 1 else parts[0]).astype("<u4")


def decode_ids(coder, ids: np.ndarray, block: int = 1 << 16) -> bytes:
    return b"".join(coder.decode_bytes(ids[at : at + block].tolist()) for at in range(0, len(ids), block))


def encode(text: Column | str, rank_file: str, pattern: str) -> Column:
    """Column of token ids, array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        coder = encoding(rank_file, pattern)
        return _lists([encode_text(coder, x.as_py()) for x in texts])

    return ids_of(text)


def decode(ids: Column | str, rank_file: str, pattern: str) -> Column:
    """Column of the raw bytes that the ids stand for; null ids give no bytes."""

    @F.arrow_udf(T.BinaryType())
    def bytes_of(lists: pa.Array) -> pa.Array:
        coder = encoding(rank_file, pattern)
        return pa.array([decode_ids(coder, np.array(x.as_py() or [], dtype=np.uint32)) for x in lists], pa.binary())

    return bytes_of(ids)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def with_ids(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text``."""
    return docs.withColumn(out, encode(docs[text], rank_file, pattern))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, its ids decoded, both digested in one pass."""
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

    @F.arrow_udf(kind)
    def digests(texts: pa.Array) -> pa.Array:
        coder = encoding(rank_file, pattern)
        count, ids_sha, bytes_sha = [], [], []
        for x in texts:
            ids = encode_text(coder, x.as_py())
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            bytes_sha.append(hashlib.sha256(decode_ids(coder, ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("r")).select("doc_id", "r.*")


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), exact: whether the decoded bytes are those of the text; one pass."""

    @F.arrow_udf("struct<n_tokens:bigint,ids:array<int>,exact:boolean>")
    def both(texts: pa.Array) -> pa.Array:
        coder = encoding(rank_file, pattern)
        ids = [encode_text(coder, x.as_py()) for x in texts]
        exact = [decode_ids(coder, i) == (x.as_py() or "").encode() for i, x in zip(ids, texts)]
        return pa.StructArray.from_arrays([pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(exact, pa.bool_())], ["n_tokens", "ids", "exact"])

    return docs.select("doc_id", both("text").alias("r")).select("doc_id", "r.*")
