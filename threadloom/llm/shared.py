"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid

import pyarrow.fs

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; on a local master without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing still to be computed reads."""
    for frame in frames:
        system, path = pyarrow.fs.FileSystem.from_uri(frame.written_path)
        system.delete_dir(path)
