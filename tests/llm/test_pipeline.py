"""The pipeline against brute-force versions of its stages on the smallest tables."""

import pytest
from test_operators import brute_classes, brute_contamination, keys

import corpus_pipeline
from threadloom.llm import bpe, classifier, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_lines(docs):
    first, out = {}, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        for line in r["text"].split("\n"):
            for k in keys(line):
                first.setdefault(k, r["doc_id"])
    for r in docs:
        lines = r["text"].split("\n")
        kept = [x for x in lines if all(first[k] == r["doc_id"] for k in keys(x))]
        if len(kept) == len(lines) or "".join(kept).strip():
            text = "\n".join(kept)
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SMALL).collect()
        out.append([r.asDict() for r in rows])
        if len(out) <= len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: r["doc_id"])


def test_stages_keep_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    for rows in stages[:-1]:
        assert all(list(r) == COLUMNS for r in rows)


def test_classifier_drops_what_it_rejects(spark, stages):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in classifier.report(docs, labels).collect()}
    assert ordered(stages[1]) == ordered([r for r in stages[0] if scores[r["doc_id"]] >= 0.5])


def test_later_stages_equal_brute_force(spark, stages):
    assert ordered(stages[2]) == ordered(plain_lines(stages[1]))
    rows = ordered(stages[2])
    classes = brute_classes([r["text"] for r in rows], [r["doc_id"] for r in rows], 5, 80, 100)
    assert ordered(stages[3]) == [r for r in rows if classes[r["doc_id"]][1] == r["doc_id"]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ordered(stages[4]) == [r for r in ordered(stages[3]) if not brute_contamination(r["text"], items)[-1]]
    coder = bpe.encoding(queries.RANK_FILE, queries.SPLIT_PATTERN)
    want = [(r["doc_id"], coder.encode_ordinary(r["text"]), True) for r in ordered(stages[4])]
    assert [(r["doc_id"], r["ids"], r["exact"]) for r in ordered(stages[5])] == want


def test_run_equals_its_stages(spark, stages):
    got = [r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert ordered(got) == ordered(stages[-1])
