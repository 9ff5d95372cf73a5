"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its first three tokens,
where tokens with a digit count as variable fields. At the leaf it belongs to
the template of all its tokens and, with eight tokens or more, to four templates
that leave out one quarter of the tokens after the first three; so two lines of
a leaf share a template when they differ only inside one quarter. A line whose
template was already used in a document with a smaller id is dropped; the first
document keeps it, so each text survives once. Lines of fewer than three tokens
are always kept. A document of which nothing but white space is left is dropped.

Only built-in column functions are used. Templates are 64-bit hashes.

Defined cases: null and empty texts have no lines and pass unchanged; a null
doc_id counts as the smallest id; repeated lines of one document, and rows with
the same doc_id, do not count as other documents; other columns pass through;
an empty table gives no rows. Ids are integers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import written

LEAD = 3
MIN_TOKENS = 3
MIN_GENERAL = 8
PARTS = 4
FIELD = r"[^ ]*[0-9][^ ]*"


def tokens_of(line: Column) -> Column:
    """Tokens between white space; those with a digit are one variable field."""
    plain = F.trim(F.regexp_replace(line, r"[\s\p{Z}]+", " "))
    return F.split(F.regexp_replace(plain, FIELD, "<*>"), " ")


def template_keys(n: Column, tokens: Column) -> Column:
    """Hashes of the templates that a line of ``n`` tokens belongs to; none for a short line."""
    step = F.ceil((n - LEAD) / PARTS).cast("int")

    def without(part: int) -> Column:
        end = F.lit(LEAD) + (part + 1) * step
        return F.xxhash64(n, F.lit(part), F.slice(tokens, 1, LEAD), F.slice(tokens, LEAD + 1, part * step), F.slice(tokens, end + 1, F.greatest(n - end, F.lit(0))))

    whole = F.xxhash64(n, F.lit(-1), tokens)
    return F.when(n < MIN_TOKENS, F.array().cast("array<bigint>")).when(n < MIN_GENERAL, F.array(whole)).otherwise(F.array(whole, *[without(p) for p in range(PARTS)]))


def order_of(doc_id: Column) -> Column:
    """Integer ids in order, null as the smallest."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)).cast("bigint"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """_order (the id, null as the smallest), _text (hash of the text), _dropped: numbers of the lines to drop, for documents that have some."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(F.split("text", "\n")).alias("_line", "_words"))
    rows = lines.select("doc_id", "_text", "_line", tokens_of(F.col("_words")).alias("_tokens")).withColumn("_n", F.size("_tokens"))
    rows = rows.select("doc_id", "_text", "_line", F.explode(template_keys(F.col("_n"), F.col("_tokens"))).alias("_key"))
    # read twice below; null counts as the smallest id
    rows = written(rows.withColumn("_order", order_of(F.col("doc_id"))).drop("doc_id"), "line-templates")
    first = rows.groupBy("_key").agg(F.min("_order").alias("_first"), F.max("_order").alias("_last")).where(F.col("_first") < F.col("_last")).drop("_last")
    later = rows.join(first, "_key").where(F.col("_first") < F.col("_order"))
    return later.groupBy("_order", "_text").agg(F.collect_set("_line").alias("_dropped"))


def drop_recurring(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents without recurring lines, all columns kept; with ``counts`` also n_lines and n_dropped."""
    # the row travels as one struct, so that no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), order_of(F.col("doc_id")).alias("_order"), F.xxhash64("text").alias("_text"))
    rows = rows.join(recurring_lines(docs), ["_order", "_text"], "left")
    lines = F.split("_row.text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("_dropped"), i))
    text = F.when(F.col("_dropped").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.select("_row", "_dropped", text.alias("_kept")).where(F.col("_dropped").isNull() | F.col("_kept").rlike(r"[^\s\p{Z}]"))
    more = [F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped")] if counts else []
    return rows.select(*[(F.col("_kept") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns], *more)


def with_lengths(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """Bring n_chars, where the documents have it, in line with the cleaned text."""
    if "n_chars" not in docs.columns:
        return cleaned
    length = F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
