"""Training-data operators against brute force on small fixtures, with their defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, classifier, components, decontaminate, licenses, ngram_join, queries, rendezvous, repair, spots, templates, token_counts
from threadloom.llm import words as W

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None, parts=3):
    rows = [(i, t, None, "s", None) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def some_texts(seed, count=60, words=30, longest=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "A.", "b,c", "ß9"]
    return ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, longest // 10))) for _ in range(count)]


ODD = [None, "", " \n\t ", "!!!", "one", "x" * 70_000, "a b " * 40_000, "  z", "Kelvin K mit", "\U0001f600 ok"]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# words


@pytest.mark.parametrize("member, pattern", [(W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_regex(member, pattern):
    import pyarrow as pa

    texts = [*ODD, *some_texts(1)]
    found = W.find_words(W.text_bytes(pa.array(texts, pa.string())), member)
    for i, text in enumerate(texts):
        got = [found.data[s:e].tobytes().decode() for s, e in zip(found.starts, found.ends)][found.first[i] : found.first[i + 1]]
        assert got == re.findall(pattern, lower(text))
    seen = {}
    for s, e, h in zip(found.starts, found.ends, found.hashes):
        assert seen.setdefault(found.data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_every_row():
    import pyarrow as pa

    column = pa.array(["a" * 50, None, "", "b" * 500, "c"], pa.string())
    assert [(s, len(p)) for s, p in W.slices(column, 60)] == [(0, 3), (3, 1), (4, 1)]


# token counts


def brute_count(word, known):
    path = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(path)
    for end in range(1, len(path) + 1):
        options = []
        for begin in range(end):
            score = known.scores.get(path[begin:end])
            if score is not None:
                options.append((score + best[begin][0], -(best[begin][1] + 1)))
        if path[end - 1] not in known.scores:
            size = len(path[end - 1].encode())
            options.append((best[end - 1][0] + size * known.byte_score, -(best[end - 1][1] + size)))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[-1][1]


def test_trie_counts_equal_plain_dynamic_programming(spark):
    known = token_counts.load(queries.PIECES)
    texts = [*ODD, *some_texts(2)]
    words = {w for t in texts for w in (t or "").split() if len(w) < 300}
    trie = token_counts.Trie(known)
    assert {w: trie.tokens(w) for w in words} == {w: brute_count(w, known) for w in words}
    got = rows_of(token_counts.count_tokens(frame(spark, texts), queries.PIECES))
    for i, t in enumerate(texts):
        parts = (t or "").split()
        assert got[i].n_pretokens == len(parts)
        if all(w in words for w in parts):
            assert got[i].n_tokens == sum(brute_count(w, known) for w in parts)


def test_trie_counts_when_words_are_forgotten(spark, monkeypatch):
    known = token_counts.load(queries.PIECES)
    monkeypatch.setattr(token_counts, "KEPT", 5)
    texts = some_texts(3, 200)
    got = rows_of(token_counts.count_tokens(frame(spark, texts, parts=1), queries.PIECES))
    assert all(got[i].n_tokens == sum(brute_count(w, known) for w in t.split()) for i, t in enumerate(texts))


def test_trie_scores_shared_prefixes_once(monkeypatch):
    known = token_counts.load(queries.PIECES)
    trie = token_counts.Trie(known)
    words = ["inter", "internet", "international", "intern", "x", "internet"]
    got = [trie.tokens(w) for w in words]
    assert len(trie.best) == 1 + len({(token_counts.MARK + w)[:k] for w in words for k in range(1, len(w) + 2)})
    assert got == [token_counts.Trie(known).tokens(w) for w in words] == [brute_count(w, known) for w in words]
    monkeypatch.setattr(token_counts, "LONG", 3)
    assert [token_counts.Trie(known).tokens(w) for w in [*words, "été" * 40, "\U0001f600"]] == [brute_count(w, known) for w in [*words, "été" * 40, "\U0001f600"]]


def test_trie_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 20)
    texts = some_texts(40) + ["a a b", "a a b"]
    known = token_counts.load(queries.PIECES)
    got = rows_of(token_counts.count_tokens(frame(spark, texts, parts=1), queries.PIECES))
    assert all(got[i].n_tokens == sum(brute_count(w, known) for w in t.split()) for i, t in enumerate(texts))


# license scans


def test_license_scan_keeps_repeated_rows(spark):
    rows = [(1, "This is under the MIT license ok"), (1, "This is under the MIT license ok"), (1, "cc by nc"), (None, None), (None, None), (2, "plain"), (2, "plain")]
    got = licenses.scan(spark.createDataFrame([(i, t, 3, "w") for i, t in rows], "doc_id bigint, text string, n_base int, word string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in got) == sorted([("1", 1, "mit"), ("1", 1, "mit"), ("1", 1, "cc-by-nc"), ("None", 0, ""), ("None", 0, ""), ("2", 0, ""), ("2", 0, "")])


def brute_places(text, phrase):
    words, wanted = alnum_words(text), phrase.split()
    return [i for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]


def test_license_scan(spark):
    rng = random.Random(4)
    fill = "the mit under license apache version 2 cc by nc gnu all rights reserved word".split()
    texts = [*ODD, *(" ".join(rng.choice(fill) for _ in range(rng.randrange(300))) for _ in range(60))]
    texts += ["Released under the MIT\nLicense.", "Apache License, Version 2.0 and again: apache-license version\n2", "x CC BY-NC 4.0", "license the under mit"]
    got = rows_of(licenses.scan(frame(spark, texts)))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        places = {label: brute_places(text, phrase) for label, phrase in licenses.BASE}
        every = sorted(p for x in places.values() for p in x)
        row = got[i]
        assert (row.n_words, row.n_base) == (len(alnum_words(text)), len(every)), text
        assert (row.first_word, row.last_word) == ((every[0], every[-1]) if every else (None, None))
        base = {label for label, x in places.items() if x}
        assert row.base_labels == ",".join(sorted(base)) and base <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
        expected = brute_blocks(text)
        assert row.labels == ",".join(sorted({label for label, _ in expected})) and row.score == pytest.approx(max([s for _, s in expected], default=0))


def brute_blocks(text):
    words, out = alnum_words(text), []
    for t in licenses.templates():
        length, wanted = len(t.words), set(t.words)
        for begin in range(0, len(words), length):
            held = len(wanted & set(words[begin : begin + 2 * length]))
            if held >= t.needed:
                out.append((t.label, held / len(wanted)))
    return out


# n-gram join


def brute_classes(texts, ids, size, num, den):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and den * common >= num * (len(a) + len(sets[j]) - common):
                parent[max(find(i), find(j), key=lambda x: ids[x])] = min(find(i), find(j), key=lambda x: ids[x])
    return {ids[i]: (len(s), ids[find(i)]) for i, s in enumerate(sets)}


def near_texts(seed, groups=6, copies=12, words=60):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [rng.choice(["of", "the", f"g{g}a{rng.randrange(50)}", f"x{rng.randrange(300)}"]) for _ in range(rng.randrange(12, words))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size, num, cell, seed", [(3, 90, 2048, 5), (5, 80, 2048, 6), (2, 60, 3, 7)])
def test_ngram_join(spark, monkeypatch, size, num, cell, seed):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 4)
    texts = [None, "", "  ", "one", "ONE", "two words", *near_texts(seed)]
    ids = [10 * len(texts) - 7 * i for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(frame(spark, texts, ids), size, num, 100).collect()}
    assert got == brute_classes(texts, ids, size, num, 100)


def test_ngram_join_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice([2, 3])):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    compared, verified = [], ngram_join._verified

    def counting(docs, pairs, *more):
        compared.append(pairs.count())
        return verified(docs, pairs, *more)

    monkeypatch.setattr(ngram_join, "_verified", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(frame(spark, texts), 3, 90, 100).collect()}
    assert got == brute_classes(texts, list(range(90)), 3, 90, 100)
    assert compared[-1] <= 90, compared  # what is left after the drawn leaders grows with the sets, not with their pairs


def brute_links(texts, size, num, den):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a & b and den * len(a & b) >= num * len(a | b)}


@pytest.mark.parametrize("size, num, block, seed", [(3, 90, 1024, 5), (2, 60, 3, 7)])
def test_ngram_links_are_whole(spark, monkeypatch, size, num, block, seed):
    monkeypatch.setattr(ngram_join, "LINK_SETS", block)
    monkeypatch.setattr(ngram_join, "LINK_COLUMNS", 16)
    texts = [None, "", "one", "ONE", "two words", *near_texts(seed)]
    want = brute_links(texts, size, num, 100)
    got = {r.doc_id: r.n_links for r in ngram_join.links(frame(spark, texts), size, num, 100).collect()}
    assert got == {i: sum(a == i for a, _ in want) for i in range(len(texts))}
    pairs, sets = (x.collect() for x in ngram_join.linked_sets(frame(spark, texts), size, num, 100))
    of = {}
    for r in sets:
        of.setdefault(bytes(r.name), []).append(r.doc_id)
    found = [(i, j) for r in pairs for i in of[bytes(r.a)] for j in of[bytes(r.b)]]
    same = {(i, j) for ids in of.values() for i in ids for j in ids if i != j}
    assert len(found) == len(set(found)) and {*found, *((j, i) for i, j in found)} | same == want


def test_ngram_links_reach_sets_of_null_ids(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i : i + 30]) for i in (0, 2, 4)]  # neighbours link, the middle one has no id
    got = ngram_join.links(frame(spark, texts, [7, None, 9]), 3, 80, 100).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {7: (7, 1), None: (7, 2), 9: (7, 1)}


def test_trie_overlaps_equal_set_intersection():
    rng = np.random.default_rng(8)
    for _ in range(20):
        pool = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        probe = np.unique(rng.choice(pool, 90))
        sets = [np.unique(rng.choice(pool, rng.integers(1, 150))) for _ in range(30)] + [probe, probe[:-1]]
        for num in (30, 50, 90):
            want = [100 * len(np.intersect1d(probe, s)) >= num * len(np.union1d(probe, s)) for s in sets]
            assert ngram_join.trie_overlaps(probe, sets, num, 100) == want


def test_keep_one_keeps_columns_and_single_documents(spark):
    texts = [None, "", "a b c d e f g h", "a b c d e f g h", "other words that stand here alone"]
    kept = ngram_join.keep_one(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4]


def test_keep_one_goes_by_text(spark):
    a, b, c = ("a b c d e f g h", "other words that stand here alone", "A b  c d e f g h")
    rows = [(None, a), (None, a), (2, a), (2, b), (2, b), (3, c), (None, b), (None, "x y z"), (None, "x y z"), (4, ""), (4, ""), (None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id bigint, text string, name string, component int").repartition(3))
    assert kept.columns == ["doc_id", "text", "name", "component"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, a), (2, b), (None, "x y z"), (4, ""), (4, ""), (None, None)], key=repr)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(30)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y, rng.choice(x, len(x) // 2)]))
        bits = sum(int(v).bit_count() for v in (ngram_join.signature(x) ^ ngram_join.signature(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))
    assert (ngram_join.signature(x) == ngram_join.signature(x[::-1])).all()


@pytest.mark.parametrize("shape", ["star", "random", "chain", "cliques"])
def test_components_equal_a_plain_search(spark, shape):
    rng = random.Random(31)
    edges = {
        "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 560)] + [(7, 7)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "chain": [(i, i + 1) for i in range(300)],
        "cliques": [(10 * k + i, 10 * k + j) for k in range(10) for i in range(10) for j in range(i)],
    }[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# sharding


def test_shards_are_the_winning_draws(spark):
    import math
    import struct

    import xxhash

    rng = random.Random(2)
    ids = [None, 0, -5, *rng.sample(range(10**12), 300), 7, 7]
    docs = spark.createDataFrame([(i, f"t{k}" if k % 5 else None) for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(3)

    def draw(i, weights):
        name = "\x00null" if i is None else str(i)
        base = xxhash.xxh64_intdigest(name.encode(), seed=42)
        first = xxhash.xxh64_intdigest(struct.pack("<Q", base), seed=42)
        costs = [(-math.log(((xxhash.xxh64_intdigest(struct.pack("<i", s), seed=first) >> 11) + 0.5) / 2**53) / w, s) for s, w in enumerate(weights)]
        return min(costs)[1]

    weights = [1.0, 2.0, 0.5] + [1.0] * 9
    rows = rendezvous.assign(docs, weights, [*weights, 1.5], slot_rows=5).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert (r.shard, r.grown_shard) == (draw(r.doc_id, weights), draw(r.doc_id, [*weights, 1.5]))
        assert r.grown_shard in (r.shard, len(weights))
    for s in range(len(weights)):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_classifier_scores_equal_a_plain_loop():
    import pyarrow as pa

    texts = [None, "", "a", "one two two three", "Ärger über alles über alles", "x" * 5000]
    model = classifier.train(["good clean text here", "bad bad bad junk", "more good text", "junk junk"], [1, 0, 1, 0], epochs=3)
    got = classifier.scores(pa.array(texts, pa.string()), model)
    for text, score in zip(texts, got):
        found = [int(b) for buckets, _ in classifier.buckets(W.text_bytes(pa.array([text], pa.string()))) for b in buckets]
        total = sum(float(model.weight[b]) for b in found) / max(1, len(found)) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


# BPE


def test_bpe_equals_library_and_round_trips(spark):
    coder = bpe.encoding(queries.RANK_FILE, queries.SPLIT_PATTERN)
    texts = [*ODD, *some_texts(9), "it's  <|endoftext|> we'll\n\n 12ab"]
    for t in texts:
        for limit in (1, 7, 1 << 16):
            if len(t or "") < 5000 or limit > 7:
                assert bpe.encode_text(coder, t, limit).tolist() == coder.encode_ordinary(t or "")
    got = rows_of(bpe.round_trip(frame(spark, texts), queries.RANK_FILE, queries.SPLIT_PATTERN))
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.with_ids(frame(spark, texts), queries.RANK_FILE, queries.SPLIT_PATTERN)
    again = again.select("doc_id", bpe.decode("ids", queries.RANK_FILE, queries.SPLIT_PATTERN).alias("raw"))
    assert all(bytes(r.raw) == (texts[r.doc_id] or "").encode() for r in again.collect())
    assert all(r.exact for r in bpe.encoded(frame(spark, texts), queries.RANK_FILE, queries.SPLIT_PATTERN).collect())


# line dedup


def test_lines_that_recur_in_later_documents_go(spark):
    log = "job 17 finished on host alpha after nine tries today"
    texts = [
        f"first text of its own here\n{log}",
        f"second text of its own there\n{log.replace('17', '99')}",  # a number is a variable field
        log.replace("after nine tries", "within four hours").replace("17", "5") + "\nthird text",  # differs in one quarter
        "ab cd\nab cd",  # too short to be a template
        "ab cd",
        "same line in one document\nsame line in one document",
        None,
        "",
        log,  # nothing of its own
    ]
    out = rows_of(templates.drop_recurring(frame(spark, texts), counts=True))
    assert {i: r.text for i, r in out.items()} == {
        0: texts[0], 1: "second text of its own there", 2: texts[2] if not shares(texts[0], texts[2]) else "third text", 3: texts[3], 4: texts[4], 5: texts[5], 6: None, 7: "",
    }
    assert out[1].n_lines == 2 and out[1].n_dropped == 1 and out[6].n_lines == 0


def keys(line):
    """Templates of a line, told apart by their fixed tokens."""
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
    n = len(tokens)
    if n < templates.MIN_TOKENS:
        return set()
    out = {(n, -1, tuple(tokens))}
    if n >= templates.MIN_GENERAL:
        step = -(-(n - templates.LEAD) // templates.PARTS)
        for p in range(templates.PARTS):
            a = templates.LEAD + p * step
            out.add((n, p, tuple(tokens[:a]) + ("|",) + tuple(tokens[a + step :])))
    return out


def shares(a, b):
    return bool({k for line in a.split("\n") for k in keys(line)} & {k for line in b.split("\n") for k in keys(line)})


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(10)
    lines = [" ".join(rng.choice(["a", "b", "7", "c4"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(6))) for _ in range(40)] + [None]
    first = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            for k in keys(line):
                first.setdefault(k, i)
    want = {}
    for i, t in enumerate(texts):
        kept = None if t is None else [x for x in t.split("\n") if all(first[k] == i for k in keys(x))]
        if t is None or len(kept) == len(t.split("\n")) or "".join(kept).strip():
            want[i] = None if t is None else "\n".join(kept)
    assert {r.doc_id: r.text for r in templates.drop_recurring(frame(spark, texts)).collect()} == want


# sharding


def test_shards(spark):
    texts = [*ODD, *some_texts(11, 400)]
    ids = [None, *range(1, len(texts))]
    out = rendezvous.assign(frame(spark, texts, ids), [1.0] * 40, [1.0] * 41, slot_rows=3).collect()
    assert len(out) == len(texts)
    by_id = {i: t for i, t in zip(ids, texts)}
    for r in out:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_follow_weights(spark):
    n = spark.range(20_000).select(rendezvous.shard_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), [1.0, 3.0]).alias("s")).where("s = 1").count()
    assert 14_600 < n < 15_400


# classifier


def test_classifier_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [r for r in classifier.report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in out)
    for label in (0, 1):
        own = [r for r in out if truth[r.doc_id] == label]
        assert sum(r.predicted == label for r in own) >= 0.9 * len(own)


def test_classifier_defined_cases(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in classifier.report(docs, none).collect()} == {0.5}
    few = spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 1), (999, 1)], "doc_id bigint, quality int")
    assert classifier.report(docs, few).count() == len(ODD)


# Re-Pair


def test_classifier_sample_goes_on_after_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, labels: seen.append(sorted(zip(texts, labels))))
    monkeypatch.setattr(classifier, "MAX_TEXT", 20)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = [f"long {i} " + "x" * (500 if i % 4 == 0 else 30) if i % 2 == 0 else f"text {i}" for i in ids]
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in ids], "doc_id bigint, quality int")
    short = [(t, i % 3 % 2) for i, t in zip(ids, texts) if i % 2]
    room = sum(len(t) for t, _ in short)
    for extra in (0, 90):
        classifier.fit(frame(spark, texts, ids), labels, max_bytes=room + extra)
        assert set(short) <= set(seen[-1]) and sum(len(t) for t, _ in seen[-1]) <= room + extra
    assert len(seen[0]) == len(short) < len(seen[1])
    classifier.fit(frame(spark, [texts[1], texts[1]], [ids[1], ids[1]]), labels)
    assert [t for t, _ in seen[-1]] == [texts[1]] * 2


def test_repair_grammar_round_trip():
    rng = np.random.default_rng(12)
    for n_docs in (1, 5, 40):
        parts = [np.append(rng.choice([3, 4, 5, 5, 5, 2], rng.integers(0, 200)), 2) for _ in range(n_docs)]
        ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        g = repair.compress(ids, ends, 6)
        assert repair.expand(g, g.sequence).tolist() == ids.tolist() == repair.expand_all(g).tolist()
        assert repair.document_lengths(g).tolist() == [len(p) for p in parts]
        assert all(repair.document(g, i).tolist() == p.tolist() for i, p in enumerate(parts))
        assert all(repair.expand(g, np.array([6 + k])).size == length for k, length in enumerate(g.lengths))


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(13)
    cases = [rng.choice([3, 4, 5, 5, 5, 2], 4000), np.tile(rng.integers(3, 900, 500), 1500), np.full(300, 7), np.arange(2000), np.tile([3, 3, 4], 400)]
    for ids in cases:
        g = repair.compress(ids, np.array([len(ids)]), int(ids.max()) + 1)
        assert repair.expand(g, g.sequence).tolist() == ids.tolist() == repair.expand_all(g).tolist()
        assert all(repair.expand(g, np.array([g.first + k])).size == length for k, length in enumerate(g.lengths))
        s = g.sequence.tolist()
        for pair in set(zip(s, s[1:])):
            at, n = 0, 0
            while at + 1 < len(s):
                hit = (s[at], s[at + 1]) == pair
                n, at = n + hit, at + 1 + hit
            assert n < repair.MIN_COUNT
    copies = repair.compress(np.tile(rng.integers(3, 900, 500), 1500), 500 * np.arange(1, 1501), 1000)
    assert len(copies.sequence) <= 2 * 1500


def library_ids(text):
    from tokenizers import Tokenizer

    global _FRESH
    if "_FRESH" not in globals():
        _FRESH = Tokenizer.from_file(queries.WORD_TOKENIZER)
    return _FRESH.encode(text or "", add_special_tokens=False).ids


SPECIAL = ["end <|endoftext|> here", "a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "İ! İ. x", "ÀB̈! é́?", "ǅ! ŉ's", "ΟΔΟΣ. ΟΔΟΣ", "<|endoftext|>.", "x<|end oftext|>"]


def test_word_coder_equals_the_library():
    rng = random.Random(21)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "İ", "ß", "Σ", "é", "'s", "'", "!", "..", "a", "B1", "日本", "\u0307", "\u0301", " ", " ", "\n", "\u00a0", "\t", "<|", "|>", "_", "½", "ﬁ"]
    texts = SPECIAL + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    got = repair.WordCoder(queries.WORD_TOKENIZER).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library_ids(text), text

def test_words_are_put_together_for_many_texts_at_once(monkeypatch):
    coder = repair.WordCoder(queries.WORD_TOKENIZER)
    texts = ["", " ", "the same words", "Été, größe! ÿ?", "\n", "ﬁn ﬁ? ŉ!", "a b\x85c\xad!", "x " * 40, "İ! don't <s> [UNK]", ""] * 3
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    calls = []
    gather = repair._stretches
    monkeypatch.setattr(repair, "_stretches", lambda *args: calls.append(1) or gather(*args))
    assert [x.tolist() for x in coder.encode(texts)] == want
    assert len(calls) == 2  # the new words, and all texts
    monkeypatch.setattr(repair, "GATHERED", 20)
    assert [x.tolist() for x in coder.encode(texts)] == want
    coder.forget()
    assert [x.tolist() for x in coder.encode(texts[::-1])] == want[::-1]



def test_repair_files(spark, tmp_path):
    texts = [*ODD, *some_texts(13), "J̌ ǰ Été, ΣΣ ok.. a. b it's <|endoftext|> #", "The the THE the, the.", *SPECIAL]
    ids = [None, *range(1000, 1000 - len(texts) + 1, -1)]
    path = str(tmp_path / "ids")
    repair.blocks(frame(spark, texts, ids), queries.WORD_TOKENIZER, 2, range_bytes=20_000, block_ids=500).write.parquet(path)
    files = spark.read.parquet(path)
    got = rows_of(repair.read_digests(files))
    lists = {r.doc_id: r.ids for r in repair.read(files).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        want = library_ids(t) + [2]
        assert lists[i] == want and got[i].start == start and got[i].n_tokens == len(want)
        assert got[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_rows_of_one_doc_id_are_several_ranges(spark, tmp_path):
    texts = [f"word{i} and text number {i}" for i in range(400)]
    path = str(tmp_path / "ids")
    repair.blocks(frame(spark, texts, [None] * 200 + [7] * 200, 4), queries.WORD_TOKENIZER, 2, range_bytes=1000).write.parquet(path)
    files = spark.read.parquet(path)
    assert files.select("range").distinct().count() > 4
    rows = repair.read(files).collect()
    assert len(rows) == 400 and sorted(tuple(r.ids) for r in rows) == sorted(tuple(library_ids(t) + [2]) for t in texts)
    places = sorted((r.start, len(r.ids), r.doc_id is not None) for r in rows)
    assert [p[0] for p in places] == [sum(n for _, n, _ in places[:k]) for k in range(400)] and [p[2] for p in places] == [False] * 200 + [True] * 200


# fingerprints


def plain_spots(text):
    words = re.findall(r"[^\W_]+", text.lower())
    anchors, out = set(spots.ANCHORS), set()
    parts = [[]]
    for w in words:
        parts.append([w]) if w in anchors else parts[-1].append(w)
    for i in range(1, len(parts)):
        chain = [w for p in parts[i : i + 3] for w in p[1:]]
        out.add(parts[i][0] + ":" + " ".join(chain[: spots.CHAIN]))
    return out or ({" ".join(words) or text} if text else set())


def test_fingerprints(spark):
    rng = random.Random(14)
    fill = ["the", "of", "und", "la", "cat", "dog", "Haus", "été", "x1", "y2", "z3"]
    texts = [None, "", "...", "plain", "the", *(" ".join(rng.choice(fill) for _ in range(rng.randrange(60))) for _ in range(40)), "the cat", "the cat"]
    ids = [None, *range(5, 5 + 3 * (len(texts) - 1), 3)]
    spots_by = {i: plain_spots(t or "") for i, t in zip(ids, texts)}
    order = sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)
    by_id = {i: t or "" for i, t in zip(ids, texts)}
    df = frame(spark, texts, ids)
    got = rows_of(spots.report(df))
    got_next = {r.doc_id: r.next_text for r in spots.with_next(df.na.fill("", ["text"]).select("doc_id", "text"), 4).collect()}

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(order):
        text, following = by_id[i], by_id[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[i]
        assert got_next[i] == following
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row.fingerprint) == 8 * len(spots_by[i]) and len(row.edited_fingerprint) == 8 * len(plain_spots(edited))
        assert row.near_edited == pytest.approx(jaccard(spots_by[i], plain_spots(edited)))
        assert row.near_next == pytest.approx(jaccard(spots_by[i], plain_spots(following)))


def test_next_document_with_sparse_and_repeated_ids(spark):
    rng = random.Random(3)
    ids = [10**12, -(10**15), *range(300), *[50] * 120, *[None] * 90]
    texts = [f"the text {rng.randrange(10**6)} of {i}" for i in ids]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(4)
    hashes = {(r.doc_id, r.text): r.h for r in df.selectExpr("*", "xxhash64(text) AS h").collect()}
    order = sorted(hashes, key=lambda k: (k[0] is not None, k[0] or 0, hashes[k]), reverse=True)
    got = {(r.doc_id, r.text): r.next_text for r in spots.with_next(df, 8).collect()}
    assert got == {k: order[(i + 1) % len(order)][1] for i, k in enumerate(order)}
    bounds = [50, 50, 50, 200]
    rows = df.selectExpr("doc_id", "xxhash64(text) / 18446744073709551616D + 0.5 AS u").select("doc_id", spots._block(F.col("doc_id"), F.col("u"), bounds, 2).alias("b")).collect()
    blocks = {i: {r.b for r in rows if r.doc_id == i} for i in (None, 50, 49, 51, 10**12)}
    assert blocks == {None: {-2, -1}, 50: {0, 1, 2}, 49: {0}, 51: {3}, 10**12: {4}}


def test_spot_pairs_equal_brute_force(spark):
    texts = near_texts(15, copies=6)
    members, pairs = spots.similar_pairs(frame(spark, texts), 0.6)
    sets = [plain_spots(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    assert {r.doc_id: r.representative for r in members.collect()} == {i: first[frozenset(s)] for i, s in enumerate(sets)}
    one = sorted(first.values())
    want = {(a, b) for a in one for b in one if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want


# decontamination


def brute_contamination(text, items, window=13):
    words = alnum_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = alnum_words(item)
        length = min(window, len(own))
        for k in range(len(own) - length + 1 if own else 0):
            for p in range(len(words) - length + 1):
                if words[p : p + length] == own[k : k + length]:
                    hit.update(range(p, p + length))
                    found.add("" if name is None else str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 600])
def test_decontamination(spark, pass_bytes):
    rng = random.Random(16)
    fill = ["a", "b", "c", "Ab", "é"]
    items = [(i % 25, " ".join(rng.choice(fill) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 40, 90] * 3)] + [(None, "lone item words"), (77, None)]
    texts = [None, "", "...", "b", *(" ".join(rng.choice([*fill, "q"]) for _ in range(rng.randrange(50))) for _ in range(40))]
    texts += ["x " * 500 + items[7][1] + " y" * 900, "LONE, item\nwords!" + " z" * 10, items[8][1] * 2]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.judged(frame(spark, texts), bench, pass_bytes=pass_bytes).select("doc_id", "_judged.*").collect()
    for r in rows:
        assert tuple(r)[1:] == brute_contamination(texts[r.doc_id], items), texts[r.doc_id]
    kept = decontaminate.drop_contaminated(frame(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.contaminated}


def test_empty_benchmark_and_empty_documents(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.report(frame(spark, ODD), bench).collect())
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    frames = [
        token_counts.count_tokens(none, queries.PIECES), licenses.scan(none), ngram_join.classes(none, 3, 90, 100), bpe.round_trip(none, queries.RANK_FILE, queries.SPLIT_PATTERN),
        templates.drop_recurring(none), rendezvous.assign(none, [1.0] * 2, [1.0] * 3), classifier.report(none, labels), spots.report(none), decontaminate.report(none, bench),
        repair.read_digests(repair.blocks(none, queries.WORD_TOKENIZER, 2)),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_stages_keep_columns_with_the_names_used_inside(spark):
    inside = ["_order", "_text", "_dropped", "_kept", "_row", "row", "score", "_score", "_judged", "_judged_state", "_block", "kind", "name", "component"]
    rows = [(i, t, *[f"{c}{i}" for c in inside]) for i, t in enumerate([None, "", "some words of its own", "other words that differ here"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in inside))
    bench = spark.createDataFrame([(1, "nothing of this occurs")], "item_id bigint, text string")
    model = classifier.Model(np.zeros(classifier.SIZE, dtype=np.float32), 1.0)
    for out in (templates.drop_recurring(docs), classifier.keep_good(docs, model), decontaminate.drop_contaminated(docs, bench), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(rows)
