"""Collocations, periodic runs and the url filter against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import collocations as C
from threadloom.llm import periodic_runs as P
from threadloom.llm import quotient as Q
from threadloom.llm import url_filter as U

# --- quotient filters ---------------------------------------------------------


@pytest.mark.parametrize("size,bits", [(2, 3), (5, 7), (5, 12), (4, 16), (3, 25), (5, 25), (2, 64), (5, 64)])
def test_filters_give_their_ngrams_back(size, bits):
    rng = np.random.default_rng(size * bits)
    packing = Q.Packing(size, bits)
    top = (1 << bits) - 1
    ids = rng.integers(0, top, (size, 3000), np.uint64, endpoint=True)
    ids[:, 1000:2000] = ids[:, :1]  # one very frequent n-gram
    want = Counter(map(tuple, ids.T.tolist()))
    assert (Q.unpack(Q.restore(Q.permute(Q.pack(ids, packing), packing), packing), packing) == ids).all()
    for shard_bits in (0, 2, 5):
        got, parts = {}, {}
        for chunk in np.array_split(ids, 3, axis=1):
            keys, counts = Q.tally(Q.permute(Q.pack(chunk, packing), packing))
            shard = Q.shards_of(keys, packing, shard_bits)
            for s in np.unique(shard):
                raw = Q.dump(keys[:, shard == s], counts[shard == s], packing, shard_bits)
                k, c = Q.load(raw, packing, int(s), shard_bits)
                assert (k == keys[:, shard == s]).all() and (c == counts[shard == s]).all()
                parts.setdefault(int(s), []).append((k, c))
        for found in parts.values():
            keys, counts = Q.merge(found)
            got |= dict(zip(map(tuple, Q.unpack(Q.restore(keys, packing), packing).T.tolist()), counts.tolist()))
        assert got == want


# --- collocations -------------------------------------------------------------


def plain_phrases(rows, least, most):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        longer = any(x == lang and len(w) > len(words) and b >= a and any(w[i : i + len(words)] == words for i in range(len(w))) for (x, w), b in cand.items())
        if not longer:
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, got = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= most:
            got.append((r[0], rank[r[0]], *r[1:]))
    return got


def random_rows(seed):
    rng = random.Random(seed)
    words = "the The of a new York york data é ÄB lake river-bank x 1990 ünï".split()
    sep = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ", "\u00a0"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "new york data lake of the river-bank . ") for _ in range(7)]
    return rows + [("en", None), ("fr", ""), ("fr", " \t "), (None, None), ("en", "a " * 3000)]


def phrase_rows(df):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert df.columns == cols
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("how", ["ids", "hashes", "many shards"])
def test_collocations_equal_the_plain_count(spark, monkeypatch, how):
    if how == "hashes":
        monkeypatch.setattr(C, "MAX_IDS", 5)
    if how == "many shards":
        monkeypatch.setattr(C, "SHARD_WORDS", 200)
        monkeypatch.setattr(C, "MIN_BITMAP", 64)
        monkeypatch.setattr(C, "MAX_BITMAP", 64)
    rows = random_rows(1)
    docs = spark.createDataFrame([(i, lang, text, "x", 1.0) for i, (lang, text) in enumerate(rows)], "doc_id int, lang string, text string, word string, f double")
    assert phrase_rows(C.top(docs, least=4, most=25)) == sorted(plain_phrases(rows, 4, 25))


def test_collocations_of_nothing(spark):
    schema = "doc_id bigint, lang string, text string"
    assert C.top(spark.createDataFrame([], schema)).count() == 0
    assert C.top(spark.createDataFrame([(1, None, None), (None, "en", "")], schema)).count() == 0


def test_large_counts_are_exact(spark):
    found = spark.createDataFrame([([1, 2], 9_000_000_000_007)], "ids array<bigint>, f bigint")
    vocabulary = spark.createDataFrame([(1, "en", "a", 9_100_000_000_001), (2, "en", "b", 9_200_000_000_003)], "id bigint, lang string, word string, f bigint")
    totals = spark.createDataFrame([("en", 16_000_000_000_000_007)], "lang string, n bigint")
    row = C.scored(found, vocabulary, totals).first()
    assert row["score"] == 1000 * 9_000_000_000_007 * 16_000_000_000_000_007 // (9_100_000_000_001 * 9_200_000_000_003)


# --- periodic runs ------------------------------------------------------------


def plain_runs(words, least=12):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                seen.setdefault((i - q, j), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def found_runs(texts):
    ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    salt = np.random.default_rng(5).integers(0, 1 << 63, len(ids) + 1, np.uint64)
    h = np.array([salt[ids[w]] for t in texts for w in t], np.uint64)
    first = np.cumsum([0] + [len(t) for t in texts])
    runs = P.find_runs(h, first)
    out = [[] for _ in texts]
    for s, e, q in zip(runs.start.tolist(), runs.end.tolist(), runs.period.tolist()):
        i = int(np.searchsorted(first, s, "right")) - 1
        assert e <= first[i + 1]
        out[i].append((s - int(first[i]), e - s, q))
    return out


def repeating_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = []
        while len(words) < rng.choice([0, 5, 30, 200, 700]):
            block = [rng.choice("abcdefghijk"[: rng.choice([1, 2, 3, 11])]) for _ in range(rng.choice([1, 2, 5, 17, 40, 90]))]
            words += (block * rng.choice([1, 2, 3, 7]))[: rng.randint(1, 300)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("pairs", [1 << 21, 40])
def test_runs_equal_all_diagonals(monkeypatch, seed, pairs):
    monkeypatch.setattr(P, "PAIRS", pairs)
    texts = repeating_texts(seed)
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_special_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 1000:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [list(fib[-1]), list(thue), ["a"] * 1000, (["a"] * 70 + ["b"]) * 9 + ["a"] * 50, list("ab" * 6), list("ab" * 5 + "a"), [str(i) for i in range(50)] * 2, [str(i) for i in range(50)] + ["x"] + [str(i) for i in range(50)]]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_text_of_one_word_takes_linear_steps():
    n = 400_000
    runs = P.find_runs(np.full(n, 7, np.uint64), np.array([0, n]))
    assert [x.tolist() for x in runs] == [[0], [n], [1]]


def plain_report(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(left))


def test_run_report_equals_the_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(repeating_texts(20) + repeating_texts(21))]
    rows += [(100 + i, " ".join(rng.choice(["été", "Été", "b", "c", "d\u00a0e"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(None, "a " * 20), (7, None), (7, "x " * 30), (7, "x " * 30), (8, " \n"), (9, "")]
    docs = spark.createDataFrame([(i, t, 5, "y") for i, t in rows], "doc_id bigint, text string, period int, start string")
    got = P.report(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_report(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    runs = sorted(tuple(r) for r in P.runs_of(docs.where("doc_id < 50 and doc_id not in (7, 8, 9)")).collect())
    assert runs == sorted((i, *r) for i, t in rows if i is not None and i < 50 and i not in (7, 8, 9) for r in plain_runs(re.findall("[^\x20\x09-\x0d]+", t)))
    assert P.report(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(600_000)]
    words[100_000:400_000] = words[100_000:175_000] * 4
    row = P.report(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), edit=False).first()
    assert row["period"] == 75_000 and 300_000 <= row["length"] < 300_040 and abs(row["start"] - 100_000) < 40


# --- urls ---------------------------------------------------------------------


def plain_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for h, p, v in rules:
        if not h or v is None or re.search("[/?#]", h) or (p and not p.startswith("/")):
            continue
        h, p = re.sub("[A-Z]", lambda m: m[0].lower(), h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.ORG", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "/", "block"),
         ("b.a.com", "", "allow"), ("com", "/xx", "allow"), ("x.com", "/y", "block"), ("x.com", "/y", "allow"), ("com", "/é", "block"), (None, "/", "block"), ("net", None, "block"),
         ("q.net", "z", "allow"), ("n/et", "/", "allow"), ("u.net", "/", None), ("", "/", "block")]


def urls():
    rng = random.Random(4)
    hosts = ["org", "example.org", "EXAMPLE.org", "www.example.org", "myexample.org", "a.com", "b.a.com", "c.b.a.com", "x.com", "net", "w.net", ".org", "org.", "a.com:80", "u@x.com", "", "localhost"]
    paths = ["", "/", "/es/", "/ES/", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/a", "/de/", "/xx/y", "/y", "/éa", "?/de/", "#/de/", "/de/?q#f", "//x", "/y\nz"]
    out = [rng.choice(["http", "HTTPS", ""]) + "://" + h + p for h in hosts for p in paths]
    return out + [None, "", "example.org/es/", "http:/x.org/", "a://b://c.org/", "://org/", "http://org/" + "x" * 200_000]


@pytest.mark.parametrize("file_bytes", [1 << 26, 40])
def test_url_verdicts_equal_the_plain_rule(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(U, "FILE_BYTES", file_bytes)
    rows = [(i // 2, u) for i, u in enumerate(urls())] + [(None, "http://org/"), (0, "http://org/"), (0, "http://org/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id bigint, url string, host string, rule string")
    got = U.judge(pages, spark.createDataFrame(RULES, U.RULE_COLUMNS))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain_judge(u, RULES)) for i, u in rows), key=repr)


def test_no_pages_or_no_rules(spark):
    none = spark.createDataFrame([], U.RULE_COLUMNS)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [tuple(r) for r in U.judge(pages, none, "block").collect()] == [(1, "a.org", "/", None, "block")]
    assert U.judge(pages.limit(0), none).count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "digest", lambda text: len(text) % 3)
    texts = [f"h{i}.org/{'x' * (i % 5)}" for i in range(40)]
    name = U._write(str(tmp_path), 0, texts, [i % 2 == 0 for i in range(40)])
    index = U.mapped(str(tmp_path / name))
    asked = texts + ["h1.orgx/", "nothing"]
    keys = np.array([U.digest(t) for t in asked], np.uint64)
    assert sorted(U.probe(index, asked, keys)) == [(i, i % 2 == 0) for i in range(40)]


def test_digests_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "example.org/es/", "é" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert {r["t"]: r["h"] % (1 << 64) for r in got} == {t: U.digest(t) for t in texts}
