"""Registered queries of the training-data operators, each over its whole table."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, classifier, collocations, decontaminate, licenses, ngram_join, periodic_runs, rendezvous, repair, spots, templates, token_counts, url_filter
from threadloom.llm.checks import CHECKS  # noqa: F401
from threadloom.llm.shared import shared_folder
from threadloom.sources.tables import table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPLIT_PATTERN = public_tokenizers.PATTERN
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), PIECES)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("n_met")


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"), size=3, num=90, den=100)


def op3_ngram_links(spark: SparkSession, folder: str) -> DataFrame:
    """op3_ngram_join with the number of links of each document."""
    return ngram_join.links(table(spark, folder, "documents"), size=3, num=90, den=100)


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), RANK_FILE, SPLIT_PATTERN)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped."""
    return templates.drop_recurring(table(spark, folder, "documents").select("doc_id", "text"), counts=True)


def op6_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return rendezvous.assign(table(spark, folder, "documents"), [1.0] * 40, [1.0] * 41)


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_repair_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    repair.write(table(spark, folder, "documents"), path, WORD_TOKENIZER, END_ID)
    return repair.read_digests(spark.read.parquet(path))


def op9_spot_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return spots.report(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.top(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.report(table(spark, folder, "documents"))


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), spark.createDataFrame(URL_RULES, url_filter.RULE_COLUMNS))


QUERIES = {f.__name__: f for f in (op1_trie_token_counts, op2_license_scan, op3_ngram_join, op3_ngram_links, op4_bpe_round_trip, op5_line_dedup, op6_rendezvous_shards, op7_quality_classifier, op8_repair_ids, op9_spot_fingerprints, op10_decontamination, op11_collocations, op12_periodic_runs, op13_url_filter)}
