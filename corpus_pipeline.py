"""Training-data pipeline: classify, drop recurring lines, drop near copies, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``. Stage results are written as Parquet in
the shared checkpoint folder and read again as the next stage's input, so a
lost executor costs no more than the stage it works on.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, classifier, decontaminate, ngram_join, templates
from threadloom.llm.queries import RANK_FILE, SPLIT_PATTERN
from threadloom.llm.shared import shared_folder
from threadloom.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 go."""
    return classifier.keep_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has go; n_chars follows the text."""
    return templates.with_lengths(templates.drop_recurring(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: five-word n-grams, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gave the text's bytes back."""
    return bpe.encoded(docs, RANK_FILE, SPLIT_PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
