"""URL filter over a sorted digest array of rules.

A rule is a host and a path prefix with a verdict, ``allow`` or ``block``. It
fits its host and all subdomains of it, if the url's path starts with the rule's
path. The rules are kept as files of 64-bit xxhash digests of ``host + path`` in
ascending order, with the full strings behind them. A task maps the files into
memory and probes them, a batch of urls at a time, by binary search; what a
digest finds is confirmed by comparing the string, so a collision changes
nothing. A url is probed with those of its host suffixes and path prefixes that
have a number of labels and a path length that some rule has.

The files are written by tasks, one for each ``FILE_BYTES`` of rules, and handed
to the executors by Spark. Only mapped pages are in memory, so the list may be
larger than it; nothing of it passes through the driver but file names and the
few pairs of label number and path length.

Defined cases: the rule with the longest string wins, of equally long ones that
with the longest host; of equal rules ``block`` wins; without a rule the verdict
is ``default``, as a url that no list names passes. A url that is null or has no
``://`` has an empty host and path. Rules with a null or empty host or a null
verdict, with a host that has ``/``, ``?`` or ``#``, or a path that is neither
empty nor starts with ``/`` fit nothing; a null path is empty. Repeated pages
stay repeated; an empty table gives no rows, an empty list no rule.
"""

import functools
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import shared_folder

FILE_BYTES = 1 << 26
SEED = 42  # that of Spark's xxhash64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_COLUMNS = "host string, path string, verdict string"


class Index(NamedTuple):
    """Names of the files, by ``digest mod number of files``, and the shapes (labels, path length) of the rules."""

    files: list[str]
    shapes: list[tuple[int, int]]


class Digests(NamedTuple):
    keys: np.ndarray
    ends: np.ndarray
    blocks: np.ndarray
    strings: np.ndarray


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed=SEED)


def _write(folder: str, number: int, texts: list[str], blocks: list[bool]) -> str:
    """One file: count, ascending digests, ends of the strings, verdicts, strings."""
    order = sorted(range(len(texts)), key=lambda i: digest(texts[i]))
    strings = [texts[i].encode() for i in order]
    name = f"rules-{number}-{uuid.uuid4().hex}"
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(np.array([len(order)], np.uint64).tobytes())
        out.write(np.array([digest(texts[i]) for i in order], np.uint64).tobytes())
        out.write(np.cumsum([len(s) for s in strings], dtype=np.uint64).tobytes())
        out.write(np.array([blocks[i] for i in order], np.uint8).tobytes())
        out.write(b"".join(strings))
    return name


@functools.lru_cache(maxsize=64)
def mapped(path: str) -> Digests:
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view(np.uint64)[0])
    keys, ends = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n : 8 + 16 * n].view(np.uint64)
    return Digests(keys, ends, raw[8 + 16 * n : 8 + 17 * n], raw[8 + 17 * n :])


def probe(index: Digests, texts: list[str], keys: np.ndarray) -> list[tuple[int, bool]]:
    """(number of the text, whether its rule blocks) of the texts that are rules."""
    found = []
    at = np.searchsorted(index.keys, keys)
    open_ = np.flatnonzero(at < len(index.keys))
    while len(open_):
        open_ = open_[index.keys[at[open_]] == keys[open_]]
        for i in open_:
            k = int(at[i])
            begin = int(index.ends[k - 1]) if k else 0
            if index.strings[begin : int(index.ends[k])].tobytes() == texts[i].encode():
                found.append((int(i), bool(index.blocks[k])))
        at[open_] += 1  # the next one has the same digest only if two rules collide
        open_ = open_[at[open_] < len(index.keys)]
    return found


def usable(rules: DataFrame) -> DataFrame:
    """host, path, blocks of the rules that can fit, each once."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    rows = rules.select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").alias("blocks"))
    rows = rows.where((F.col("host") != "") & ~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("blocks").isNotNull())
    return rows.groupBy("host", "path").agg(F.bool_or("blocks").alias("blocks"))


def build(rules: DataFrame) -> Index:
    """Write the sorted digest arrays of a rule table and hand them to the executors."""
    spark = rules.sparkSession
    folder = f"{shared_folder(spark)}/url-rules-{uuid.uuid4().hex}"
    rows = usable(rules)
    size = rows.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()[0] or 0
    count = -(-size // FILE_BYTES)
    if not count:
        return Index([], [])
    shapes = rows.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    text = F.concat("host", "path")
    dealt = rows.select(F.pmod(F.xxhash64(text), F.lit(count)).cast("int").alias("number"), text.alias("text"), "blocks")

    def run(batches):
        held: dict[int, tuple[list[str], list[bool]]] = {}
        for batch in batches:
            for number, text, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                texts, verdicts = held.setdefault(number, ([], []))
                texts.append(text)
                verdicts.append(blocks)
        if held:
            names = [_write(folder, n, *x) for n, x in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(names)], ["number", "name"])

    files = {r["number"]: r["name"] for r in dealt.repartition(count, "number").mapInArrow(run, "number int, name string").collect()}
    for name in files.values():
        spark.sparkContext.addFile(f"{folder}/{name}")
    return Index([files.get(n, "") for n in range(count)], sorted((r["labels"], r["length"]) for r in shapes))


def best_rules(hosts: list[str], paths: list[str], shapes: list[tuple[int, int]], files: list[Digests | None]) -> tuple[list[str | None], list[bool]]:
    """The winning rule of each url, and whether it blocks."""
    best: list[tuple] = [(0, 0, None, False)] * len(hosts)
    labels = [h.split(".") for h in hosts]
    for count, length in shapes:
        rows = [i for i, parts in enumerate(labels) if len(parts) >= count and len(paths[i]) >= length]
        if not rows:
            continue
        texts = [".".join(labels[i][-count:]) + paths[i][:length] for i in rows]
        keys = np.array([digest(t) for t in texts], np.uint64)
        file = keys.view(np.int64) % len(files)
        for number in np.unique(file):
            if files[number] is None:
                continue
            mine = np.flatnonzero(file == number)
            for i, blocks in probe(files[number], [texts[k] for k in mine], keys[mine]):
                rule = texts[mine[i]]
                row = rows[mine[i]]
                best[row] = max(best[row], (len(rule), len(rule) - length, rule, blocks))
    return [b[2] for b in best], [b[3] for b in best]


def with_parts(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with host and path of ``url``."""
    rest = F.coalesce(F.get(F.split(F.col("url"), "://", 2), 1), F.lit(""))
    cut = r"^([^/?#]*)([^?#]*)"
    return pages.select(*keep, F.translate(F.regexp_extract(rest, cut, 1), UPPER, LOWER).alias("host"), F.regexp_extract(rest, cut, 2).alias("path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of (page_id, url)."""
    index = build(rules)
    rows = with_parts(pages, "page_id")

    def run(batches):
        files = [mapped(SparkFiles.get(name)) if name else None for name in index.files]
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            rule, blocks = best_rules(hosts.to_pylist(), paths.to_pylist(), index.shapes, files)
            verdict = [default if r is None else "block" if b else "allow" for r, b in zip(rule, blocks)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
