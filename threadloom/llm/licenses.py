"""License scans as an exact set-similarity join of text blocks with license templates.

A template of L words and m distinct words is looked for in blocks of 2 L
consecutive words, one block for every L words of a text. A block meets the
template when it holds at least ceil(0.8 m) of its words. Words are ordered by
their frequency in all documents, rarest first. A block that lacks all of the
first m - ceil(0.8 m) + 1 words cannot meet the template, so only places of
these words are joined with the templates (prefix filter); a block with too few
distinct words (length filter), or with too few template words left after the
rank of the word that was met (positional filter), is dropped before its words
are counted. Phrases that stand word for word are then found among the blocks
met, by comparing the words around the rarest one.

Only built-in column functions are used. The templates are a short list given
by the caller, so their join side is small by construction.

Defined cases: a null or empty text has no words, places or labels and score 0;
rows with equal doc_id and text are one document; a null doc_id is an id; an
empty table gives no rows.
"""

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
MAX_TEMPLATES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that are counted word for word, with their labels
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Further templates, matched by containment only
MORE = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
]


class Template(NamedTuple):
    number: int
    label: str
    words: list[str]
    base: bool

    @property
    def needed(self) -> int:
        return math.ceil(CONTAINMENT * len(set(self.words)) - 1e-9)


def templates(base: list[tuple[str, str]] = BASE, more: list[tuple[str, str]] = MORE) -> list[Template]:
    if len(base) + len(more) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    out = []
    for number, (label, phrase) in enumerate([*base, *more]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase)
        out.append(Template(number, label, words, number < len(base)))
    return out


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences in all documents of the templates' words; as many rows as the templates have words."""
    found = docs.select(F.explode(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary))).alias("word"))
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def _index(spark, known: list[Template], frequency: dict[str, int]) -> DataFrame:
    """One row per prefix word of a template."""
    rows = []
    for t in known:
        ordered = sorted(set(t.words), key=lambda w: (frequency[w], w))
        for rank, word in enumerate(ordered[: len(ordered) - t.needed + 1]):
            place = t.words.index(word) if rank == 0 and t.base and t.words.count(word) == 1 else None
            rows.append((word, t.number, t.label, t.words, ordered, t.needed, rank, place))
    return spark.createDataFrame(rows, "word string, number int, label string, phrase array<string>, ordered array<string>, needed int, rank int, place int")


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks: how many blocks meet a template."""
    known = known or templates()
    spark = docs.sparkSession
    for t in known:
        if t.base and len(set(t.words)) < len(t.words):
            raise ValueError(f"a phrase that is counted must not repeat a word: {' '.join(t.words)}")
    index = _index(spark, known, word_frequencies(docs, sorted({w for t in known for w in t.words})))
    keys = [r["word"] for r in index.select("word").distinct().collect()]
    reach = 2 * max(len(t.words) for t in known)

    # the number of a row depends on its file split only, so a task that runs again gives the same
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("_words"))
    rare = F.array(*[F.lit(k) for k in keys])
    spots = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(keys), i)), lambda i: i.isNotNull())
    near = F.transform(
        spots,
        lambda p: F.struct(
            p.alias("at"),
            F.get(F.col("_words"), p).alias("word"),
            F.greatest(p - reach, F.lit(0)).alias("from"),
            F.slice(F.col("_words"), F.greatest(p - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("words"),
        ),
    )
    rows = rows.select("doc_id", "_row", F.size("_words").cast("bigint").alias("n_words"), F.explode_outer(F.when(F.arrays_overlap("_words", rare), near)).alias("_near"))
    rows = rows.select("doc_id", "_row", "n_words", "_near.*").join(F.broadcast(index), "word", "left")

    length = F.size("phrase")

    def overlap(back: int) -> Column:
        """Template words in the block that begins ``back`` steps before the one of this place."""
        begin = (F.floor(F.col("at") / length) - back).cast("int") * length
        held = F.array_distinct(F.slice("words", F.greatest(begin - F.col("from"), F.lit(0)) + 1, 2 * length))
        possible = (begin >= 0) & (F.size(held) >= F.col("needed")) & (F.size("ordered") - F.col("rank") >= F.col("needed"))
        return F.when(possible, F.size(F.array_intersect(held, F.col("ordered"))))

    rows = rows.withColumn("_met", F.greatest(overlap(0), overlap(1)))
    rows = rows.withColumn("_met", F.when(F.col("_met") >= F.col("needed"), F.col("_met")))
    start = F.col("at") - F.col("place")
    stands = F.col("_met").isNotNull() & (start >= 0) & (F.slice("words", F.greatest(start - F.col("from"), F.lit(0)) + 1, length) == F.col("phrase"))
    rows = rows.withColumn("_start", F.when(stands, start.cast("bigint")))
    grouped = rows.groupBy("doc_id", "_row").agg(
        F.max("n_words").alias("n_words"),
        F.count("_start").alias("n_base"),
        F.min("_start").alias("first_word"),
        F.max("_start").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_start").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_met").isNotNull(), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.col("_met") / F.size("ordered")), F.lit(0.0)).alias("score"),
        F.count("_met").alias("n_met"),
    )
    return grouped.drop("_row")
