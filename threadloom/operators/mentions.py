"""Which values occur in which texts, through the rarest three characters of each value.

A value can only occur in a text that has all its stretches of three characters.
Of those the one that the fewest texts have is looked up, and only texts that
have it are compared with the value; so a value costs as much as its rarest
stretch is common. Values of fewer than three characters are looked up whole.

A value without white space can only occur inside a word, so it is looked up
among the distinct words, first as a whole word; the others among the texts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import ordered

GRAM = 3
SPACE = r"[ \t\n\r]"


def _grams(text: Column) -> Column:
    """Distinct stretches of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), 1))


def _all_grams(text: Column) -> Column:
    """Distinct stretches of one to three characters."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), 1) for n in range(1, GRAM + 1)]))


def mentioned(values: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``values`` (keys, value, more) whose value occurs in a row of ``texts`` (keys, text) of the same keys, letter case aside.

    An empty value occurs in every text of its keys; a NULL one in none.
    """
    rest = [c for c in values.columns if c not in keys]
    low = F.lower("value")
    # the columns travel as one struct, so that none can clash
    sought = values.select(*keys, F.struct(*rest).alias("_row"), low.alias("_value")).where(F.col("_value").isNotNull())
    sought = ordered.cut_lineage(sought.withColumns({"_id": F.xxhash64("_value"), "_spaced": F.col("_value").rlike(SPACE)}))
    asked = sought.select(*keys).distinct()
    seen = texts.join(ordered.merged(asked), keys, "left_semi").select(*keys, F.lower("text").alias("_text"))
    words = seen.select(*keys, F.explode(F.array_distinct(F.split("_text", f"{SPACE}+"))).alias("_text")).distinct()
    words = ordered.cut_lineage(words)
    wanted = sought.where("_value <> ''").select(*keys, "_id", "_value", "_spaced").distinct()
    single = wanted.where(~F.col("_spaced"))
    whole = single.join(ordered.merged(words.withColumnRenamed("_text", "_value")), [*keys, "_value"], "left_semi").select(*keys, "_id")
    inside = _inside(ordered.cut_lineage(single.join(ordered.merged(whole), [*keys, "_id"], "left_anti")), words, keys)
    spaced = _inside(ordered.cut_lineage(wanted.where("_spaced")), seen, keys)
    found = whole.unionByName(inside).unionByName(spaced)
    empty = sought.where("_value = ''").join(ordered.merged(seen.select(*keys).distinct()), keys, "left_semi")
    out = sought.join(ordered.merged(found), [*keys, "_id"], "left_semi").unionByName(empty)
    return out.select(*keys, "_row.*").select(*values.columns)


def _inside(sought: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _id of the rows of ``sought`` (keys, _id, _value: distinct, not empty) whose value occurs in a row of ``texts`` (keys, _text)."""
    read = texts.join(ordered.merged(sought.select(*keys).distinct()), keys, "left_semi")
    read = ordered.cut_lineage(read.select(*keys, "_text", F.monotonically_increasing_id().alias("_place")))
    short = F.length("_value") < GRAM
    wanted = sought.select(*keys, "_id", F.explode(F.when(short, F.array("_value")).otherwise(_grams(F.col("_value")))).alias("_gram")).distinct()
    # only stretches that some value of the same keys has; one-row-per-stretch counts say how rare they are
    has_short = ordered.cut_lineage(sought.where(short).select(*keys).distinct())
    plain, small = read.join(ordered.merged(has_short), keys, "left_anti"), read.join(ordered.merged(has_short), keys, "left_semi")
    held = plain.select(*keys, "_place", F.explode(_grams(F.col("_text"))).alias("_gram")).unionByName(small.select(*keys, "_place", F.explode(_all_grams(F.col("_text"))).alias("_gram")))
    held = ordered.cut_lineage(held.join(ordered.merged(wanted.select(*keys, "_gram").distinct()), [*keys, "_gram"], "left_semi"))
    counts = held.groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    # a value with a stretch that no text has occurs nowhere
    ranked = wanted.join(ordered.merged(counts), [*keys, "_gram"], "left").groupBy(*keys, "_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram"))).alias("_g"))
    rare = ranked.where(F.col("_g.n") > 0).select(*keys, "_id", F.col("_g._gram").alias("_gram"))
    met = held.join(ordered.merged(rare), [*keys, "_gram"]).select(*keys, "_place", "_id").join(ordered.merged(read), [*keys, "_place"])
    return met.join(ordered.merged(sought.select(*keys, "_id", "_value")), [*keys, "_id"]).where(F.contains("_text", "_value")).select(*keys, "_id").distinct()
