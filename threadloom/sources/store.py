"""Stored tables: listing, latest-wins upserts, caches, the run ledger, import, delete and export.

Parquet has no row updates, so a change is a new version of the table (or of the
partitions it touches). Winners are picked by aggregation, never by a window
over a key.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TITLE_LENGTH = 60
MESSAGE_JSON = "id string, role string, content string"


# IO1 -------------------------------------------------------------------------
def read_messages(messages: DataFrame, conv_id) -> DataFrame:
    """Ordered history of one conversation; the filter reaches the scan."""
    return messages.where(F.col("conv_id") == conv_id).orderBy("turn")


# IO2 -------------------------------------------------------------------------
def list_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), F.desc("conversation_id"))


# J6 --------------------------------------------------------------------------
def annotations_of(annotations: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored annotations of the given messages."""
    return annotations.join(messages.select("conv_id", "turn"), ["conv_id", "turn"])


# IO3, IO4 --------------------------------------------------------------------
def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str, keep_first: list[str] | None = None) -> DataFrame:
    """Latest version of each key, the larger row on a tie; columns in ``keep_first`` keep their earliest value."""
    keep_first = keep_first or []
    both = stored.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c not in keep_first]
    winner = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_w"), *[F.min(c).alias(c) for c in keep_first])
    return winner.select(*keys, *keep_first, "_w.*")


def upsert_annotations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["conv_id", "turn"], "updated_at")


def upsert_memory(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["conv_id", "key"], "updated_at", ["created_at"])


# A stored table is a folder of buckets by the hash of its keys. Every change writes new versions of the buckets it
# touches and then one manifest, which names the version of each bucket; the newest manifest is the table.
BUCKETS = 64
BUCKET = "_bucket"


def _manifest(spark: SparkSession, folder: str) -> list:
    """Rows (number, buckets, bucket, version) of the newest manifest, at most one for each bucket; empty for a new table."""
    try:
        rows = spark.read.schema("number bigint, buckets int, bucket int, version string").parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = rows.agg(F.max("number")).first()[0]
    return rows.where(F.col("number") == newest).collect() if newest is not None else []


def _bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_stored(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a stored table, or of some of its buckets; None if it has none there."""
    paths = [f"{folder}/data/version={r['version']}/{BUCKET}={r['bucket']}" for r in _manifest(spark, folder) if only is None or r["bucket"] in only]
    return spark.read.parquet(*paths) if paths else None


def upsert_stored(incoming: DataFrame, folder: str, keys: list[str], version: str, keep_first: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Merge rows into a stored table by :func:`upsert`; only buckets that the rows fall into are read and written again.

    A table's number of buckets is fixed by its first write. Readers see the former table until the new manifest is there;
    what a broken write left is never named by one.
    """
    spark = incoming.sparkSession
    known = _manifest(spark, folder)
    buckets = known[0]["buckets"] if known else buckets
    rows = incoming.withColumn(BUCKET, _bucket_of(keys, buckets))
    touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())
    if not touched:
        return
    stored = read_stored(spark, folder, touched)
    stored = incoming.where("false") if stored is None else stored
    name = uuid.uuid4().hex
    merged = upsert(stored, incoming, keys, version, keep_first).withColumn(BUCKET, _bucket_of(keys, buckets))
    merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/data/version={name}")
    versions = {r["bucket"]: r["version"] for r in known} | dict.fromkeys(touched, name)
    number = known[0]["number"] + 1 if known else 0
    manifest = spark.createDataFrame([(number, buckets, b, v) for b, v in versions.items()], "number bigint, buckets int, bucket int, version string")
    manifest.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


# IO5 -------------------------------------------------------------------------
def list_memory(items: DataFrame, active_only: bool = True) -> DataFrame:
    rows = items.where("active") if active_only else items
    return rows.orderBy("conv_id", "created_at", "key")


# IO6 -------------------------------------------------------------------------
def cached_summaries(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Look up ``wanted`` (conv_id, cache_key, ...): hit, negative (an empty summary: do not ask again) or miss."""
    found = wanted.join(cache.select("conv_id", "cache_key", "summary"), ["conv_id", "cache_key"], "left")
    return found.withColumn("state", F.when(F.col("summary").isNull(), "miss").when(F.col("summary") == "", "negative").otherwise("hit"))


def new_summaries(cache: DataFrame, produced: DataFrame) -> DataFrame:
    """Rows to append: keys already cached are ignored, and one row per key is kept."""
    rest = [c for c in produced.columns if c not in ("conv_id", "cache_key")]
    once = produced.groupBy("conv_id", "cache_key").agg(F.min(F.struct(*rest)).alias("_r")).select("conv_id", "cache_key", "_r.*")
    return once.join(cache.select("conv_id", "cache_key"), ["conv_id", "cache_key"], "left_anti")


# IO7 -------------------------------------------------------------------------
def ledger_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """The four ledger tables of nested run rows (arrays ``attempts``, ``calls`` and ``decisions``)."""
    nested = {"attempts": ("run_attempt", True), "calls": ("utility_call", False), "decisions": ("context_decision", False)}
    tables = {"compiler_run": runs.drop(*nested)}
    for column, (name, numbered) in nested.items():
        if numbered:
            rows = runs.select("run_id", F.posexplode(column).alias("idx", "_x")).select("run_id", "idx", "_x.*")
        else:
            rows = runs.select("run_id", F.explode(column).alias("_x")).select("run_id", "_x.*")
        tables[name] = rows
    return tables


def write_run_ledger(tables: dict[str, DataFrame], folder: str, batch: str) -> None:
    """Write one batch of runs to the four tables; writing the same batch again replaces it.

    All rows go to folders of a new version. One row in ``commits`` then makes that version the batch's:
    before it readers see the batch as it was, after it all four tables as they are now, never a mixture.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}/batch={batch}/version={version}")
    commit = spark.createDataFrame([(batch, version, time.time_ns())], COMMITS)
    commit.coalesce(1).write.mode("append").parquet(f"{folder}/commits")


COMMITS = "batch string, version string, committed bigint"


def read_run_ledger(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of one ledger table: of each batch the version committed last."""
    commits = spark.read.schema(COMMITS).parquet(f"{folder}/commits")
    current = commits.groupBy("batch").agg(F.max_by("version", "committed").alias("version"))
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(current, ["batch", "version"], "left_semi").drop("version")


# IO8 -------------------------------------------------------------------------
def read_runs_versioned(versions: list[DataFrame]) -> DataFrame:
    """Runs of all schema versions; values that older rows lack are read from the columns they replaced."""
    rows = versions[0]
    for newer in versions[1:]:
        rows = rows.unionByName(newer, allowMissingColumns=True)
    fallback = {"initial_compiled_tokens": "compiled_tokens", "initial_reduction_percent": "reduction_percent"}
    rows = rows.withColumns({c: F.coalesce(c, old) for c, old in fallback.items()})
    return rows.withColumn("count_source", F.coalesce("count_source", F.lit("local_estimate")))


# IO9 -------------------------------------------------------------------------
def runs_with_trace(runs: DataFrame, conversations: DataFrame, trace_schema: str) -> DataFrame:
    titled = runs.join(conversations.select("conversation_id", "title"), "conversation_id")
    return titled.withColumn("trace", F.from_json("trace_json", trace_schema))


# IO10 ------------------------------------------------------------------------
def export_metrics(metrics: DataFrame, folder: str) -> None:
    """Per-turn metrics as CSV (quotes doubled, empty for NULL) and as JSON lines."""
    metrics.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").csv(f"{folder}/csv")
    metrics.write.mode("overwrite").json(f"{folder}/json")


def export_summary(metrics: DataFrame, totals: DataFrame, folder: str, part_rows: int = 10_000) -> None:
    """The export as JSON lines: a line of totals, and the ordered series in lines of at most ``part_rows`` points each.

    ``metrics`` has ``place`` (from 0, without gaps) and the measures of a point; ``totals`` is one row. A line has its
    kind and number, so the document is the lines in that order and no line grows with the series.
    """
    point = F.struct("place", *[c for c in metrics.columns if c != "place"])
    parts = metrics.groupBy(F.floor(F.col("place") / part_rows).cast("int").alias("part")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    none = F.lit(None)
    head = totals.select(F.lit("totals").alias("kind"), F.lit(0).alias("part"), F.struct(*totals.columns).alias("totals"), none.cast(parts.schema["points"].dataType).alias("points"))
    body = parts.select(F.lit("series").alias("kind"), "part", none.cast(head.schema["totals"].dataType).alias("totals"), "points")
    head.unionByName(body).write.mode("overwrite").json(f"{folder}/summary")


def read_summary(spark: SparkSession, folder: str, totals: str, point: str) -> tuple[DataFrame, DataFrame]:
    """(totals, series) of an export; ``totals`` and ``point`` are the schemas of the totals and of a point."""
    lines = spark.read.schema(f"kind string, part int, totals struct<{totals}>, points array<struct<{point}>>").json(f"{folder}/summary")
    return lines.where("kind = 'totals'").select("totals.*"), lines.where("kind = 'series'").select(F.explode("points").alias("p")).select("p.*")


# IO11 ------------------------------------------------------------------------
def import_conversations(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows to append so that conversations missing by id and by title come in with their children.

    ``conversation`` has conversation_id and title; every other table has conversation_id.
    """
    known = target["conversation"]
    fresh = source["conversation"].join(known.select("conversation_id"), "conversation_id", "left_anti").join(known.select("title").distinct(), "title", "left_anti")
    ids = fresh.select("conversation_id")
    return {name: fresh if name == "conversation" else rows.join(ids, "conversation_id", "left_semi") for name, rows in source.items()}


# IO12 ------------------------------------------------------------------------
def delete_conversations(tables: dict[str, DataFrame], ids: DataFrame, run_tables: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What remains of every table; tables named in ``run_tables`` hang on runs instead of conversations."""
    gone = ids.select("conversation_id").distinct()
    runs = tables["compiler_run"].join(gone, "conversation_id", "left_semi").select("run_id")
    return {name: rows.join(runs, "run_id", "left_anti") if name in run_tables else rows.join(gone, "conversation_id", "left_anti") for name, rows in tables.items()}


# IO13 ------------------------------------------------------------------------
def touched_conversations(messages: DataFrame, at: Column) -> DataFrame:
    """Title (first user request, whitespace collapsed, 60 characters) and last update per conversation."""
    title = F.substring(F.regexp_replace("text", r"\s+", " "), 1, TITLE_LENGTH)
    return messages.groupBy("conv_id").agg(
        F.min_by(title, F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.min(at).alias("created_at"), F.max(at).alias("updated_at")
    )


# IO15 ------------------------------------------------------------------------
def read_fixture(spark: SparkSession, path: str, conv_id: Column | None = None) -> DataFrame:
    """A JSON array of {id, role, content} as messages of one conversation per file, in array order.

    ``conv_id`` is an expression over ``file``, the file's path; a hash of it by default.
    """
    conv_id = F.xxhash64("file") if conv_id is None else conv_id
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.from_json("value", f"array<struct<{MESSAGE_JSON.replace(' string', ':string')}>>")).alias("pos", "m"))
    return rows.select(conv_id.alias("conv_id"), F.col("pos").cast("bigint").alias("turn"), F.col("pos").cast("bigint").alias("pos"), F.col("m.id").alias("message_id"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


