"""Tables that are replaced as a whole: version folders, and a pointer that is put in place last.

    <path>/v-<number>-<batch>/<table>/…parquet      what one commit wrote
    <path>/_current                                  the version that counts, its batch and notes, as JSON

A version is written beside the current one, so what it was computed from can be read all the while; only the move of the pointer makes it the
current one. A driver lost before that leaves a folder that nobody reads and the next commit replaces. A commit with a batch number counts
once: at that number or below, it's told apart by `seen`. One writer at a time; KEEP versions stay for readers that began before.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.objects import get, put, store_of

KEEP = 2
ONE = "table"


def pointer(path: str) -> dict:
    """{version, batch, notes} of the current version; {} if there is none."""
    return json.loads(get(f"{path}/_current") or b"{}")


def seen(path: str, batch: int | None) -> bool:
    """Whether this batch, or a later one, has been committed."""
    last = pointer(path).get("batch")
    return batch is not None and last is not None and batch <= last


def load(spark: SparkSession, path: str, schema: str, table: str = ONE) -> DataFrame:
    """The current version's table; an empty one where there is none. A plain Parquet folder, as earlier releases wrote, is read too."""
    at = pointer(path).get("version")
    if at is None:
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return spark.createDataFrame([], schema)
            raise
    return spark.read.schema(schema).parquet(f"{path}/{at}/{table}")


def read(spark: SparkSession, path: str, table: str = ONE) -> DataFrame:
    """The current version's table with the columns that it was written with; there must be one."""
    at = pointer(path).get("version")
    return spark.read.parquet(path if at is None else f"{path}/{at}/{table}")


def commit(path: str, tables: dict[str, DataFrame], batch: int | None = None, notes: dict | None = None) -> str:
    """Writes the tables as one version and makes it the current one; its name. A batch that was committed before is left alone."""
    now = pointer(path)
    if seen(path, batch):
        return now["version"]
    number = int(now["version"].split("-")[1]) + 1 if now else 1
    name = f"v-{number:08d}-{'none' if batch is None else batch}"
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/{table}")
    put(f"{path}/_current", json.dumps({"version": name, "batch": now.get("batch") if batch is None else batch, "notes": notes or {}}).encode())
    _forget(path, number)
    return name


def _forget(path: str, number: int) -> None:
    """Deletes what lies behind the versions that stay, an older layout's files with it."""
    store, at = store_of(path)
    for f in store.get_file_info(fs.FileSelector(at)):
        if f.type == fs.FileType.Directory and f.base_name.startswith("v-"):
            if int(f.base_name.split("-")[1]) <= number - KEEP:
                store.delete_dir(f.path)
        elif f.type == fs.FileType.File and f.base_name.endswith(".parquet"):
            store.delete_file(f.path)
