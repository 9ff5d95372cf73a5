"""The JSON object in a model's free-text reply, as column expressions.

It is found the way a reader would: code fences are dropped, and from each
opening brace on the text is followed, strings and their escapes skipped, to the
brace that closes it; the first such stretch that is valid JSON counts.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as T

STRICT = {"columnNameOfCorruptRecord": "malformed", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def balanced(tail: Column) -> Column:
    """The text up to the brace that closes the first one; NULL if none does. ``tail`` begins with an opening brace."""
    # an escaped character is never a quote that ends a string; code points keep their number
    masked = F.regexp_replace(tail, r"(?s)\\.", "..")
    pieces = F.regexp_extract_all(masked, F.lit(r'"[^"]*"?|[{}]|[^"{}]+'), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(acc, piece):
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct(depth.alias("depth"), (acc["length"] + F.length(piece)).alias("length"), (depth == 0).alias("closed")))

    return T.let(F.aggregate(pieces, start, step), lambda r: F.when(r["closed"], F.substring(tail, F.lit(1), r["length"])))


def valid_object(doc: Column) -> Column:
    """``doc`` if it is valid JSON, else NULL."""
    return F.when(F.from_json(doc, "malformed string", STRICT)["malformed"].isNull(), doc)


def first_object(raw: Column) -> Column:
    """The first balanced object of a reply that is valid JSON, else NULL."""
    text = F.regexp_replace(raw, "(?i)```(?:json)?", "")
    parts = F.split(text, r"\{", -1)
    tail = lambda parts, i: F.concat(F.lit("{"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "{"))
    usable = lambda tail: T.let(balanced(tail), valid_object)

    def found(parts):
        # later braces are only tried while nothing was found; nearly always the first one is it
        first = F.when(F.size(parts) > 1, usable(tail(parts, F.lit(1))))
        others = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1))
        return F.coalesce(first, F.aggregate(others, F.lit(None).cast("string"), lambda acc, i: F.coalesce(acc, usable(tail(parts, i)))))

    return T.let(parts, found)
