"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local folder, which only a local master's executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="newsloom-")
        shared_dir.own = at
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from a Parquet table: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder or file through the session's file systems; one that isn't there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the table behind a frame that written() returned, once nothing reads it any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Deletes every written table of this folder; call it when no frame built on one is in use any more."""
    delete(spark, f"{shared_dir(spark)}/newsloom")
