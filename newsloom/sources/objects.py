"""Single objects (files) in any file system that driver and executors reach: small ones by hand, many by tasks.

The data source `newsloom_objects` writes rows (target, file, body): each is one object, copied from `file` or holding `body`. A task
writes every object under a name of its own in `<folder>/_parts/<run>/`, which readers skip, and

* publish=task (the default): puts each in place once it is whole, so the driver handles no names at all;
* publish=commit: leaves that to the driver's commit, which puts them in place in the order of their targets after all tasks have ended,
  so nothing of a write that failed is seen. For a few objects that belong together.

A task that dies leaves parts alone, and these go with the run's folder when the write ends either way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from newsloom.functions.retry import retried

CHUNK = 4 << 20
#: What a store says that takes no access lists.
NO_ACL = "AccessControlListNotSupported"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """A location's file system, and its path there."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _opened(store: fs.FileSystem, path: str, public: bool):
    return store.open_output_stream(path, metadata={"ACL": "public-read"} if public else None)


def write_whole(store: fs.FileSystem, path: str, chunks: Iterator[bytes], public: bool = False) -> int:
    """Bytes written. public: readable by everybody where the store has access lists; one that takes none is tolerated, other errors aren't."""
    chunks = list(chunks) if public else chunks
    try:
        n = 0
        with _opened(store, path, public) as out:
            for c in chunks:
                n += out.write(c)
        return n
    except OSError as e:
        if not public or NO_ACL not in str(e):
            raise
        return write_whole(store, path, iter(chunks))


def put(uri: str, body: bytes, public: bool = False) -> None:
    """A small object, whole or not at all: written beside its place and moved there."""
    store, path = store_of(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    write_whole(store, part, iter([body]), public)
    store.move(part, path)


def get(uri: str) -> bytes | None:
    """An object's bytes; None if it isn't there."""
    store, path = store_of(uri)
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def exists(uri: str) -> bool:
    store, path = store_of(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Objects(WriterCommitMessage):
    parts: list[tuple[str, str]]
    n: int


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, publish: str, attempts: int, public: bool) -> None:
        if publish not in ("task", "commit"):
            raise ValueError(f"publish is task or commit, not {publish!r}")
        self.folder, self.run, self.publish, self.attempts, self.public = folder.rstrip("/"), run, publish, attempts, public

    def _one(self, target: str, file: str | None, body: bytes | None) -> tuple[str, str]:
        """Part and place of an object."""
        store, path = store_of(f"{self.folder}/{target}")
        part = f"{store_of(self.folder)[1]}/_parts/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(part.rpartition("/")[0])
        if file is None:
            write_whole(store, part, iter([body or b""]), self.public)
        else:
            there, at = store_of(file)
            with there.open_input_stream(at) as f:
                n = write_whole(store, part, iter(lambda: f.read(CHUNK), b""), self.public)
            if n != (size := there.get_file_info(at).size):
                raise OSError(f"{file} has {size} bytes, {n} were copied")
        if self.publish == "task":
            _place(store, part, path)
        return part, path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Objects:
        one, parts, n = retried(self._one, self.attempts), [], 0
        for batch in iterator:
            for r in batch.to_pylist():
                done = one(r["target"], r.get("file"), r.get("body"))
                n += 1
                if self.publish == "commit":
                    parts.append(done)
        return Objects(parts, n)

    def _clear(self) -> None:
        store, path = store_of(f"{self.folder}/_parts/{self.run}")
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)

    def commit(self, messages: list[Objects | None]) -> None:
        store, _ = store_of(self.folder)
        for part, path in sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p[1]):
            _place(store, part, path)
        self._clear()

    def abort(self, messages: list[Objects | None]) -> None:
        self._clear()


def _place(store: fs.FileSystem, part: str, path: str) -> None:
    store.create_dir(path.rpartition("/")[0])
    if store.get_file_info(path).type == fs.FileType.Directory:  # an older layout's folder of the same name
        store.delete_dir(path)
    store.move(part, path)


class ObjectSink(DataSource):
    """Format newsloom_objects: save(folder) of rows (target: a path below it, and file string or body binary)."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_objects"

    def writer(self, schema, overwrite: bool) -> Writer:
        o = self.options
        return Writer(o["path"], o["run"], o.get("publish", "task"), int(o.get("attempts", 1)), o.get("public", "false").lower() == "true")


def put_all(rows: DataFrame, folder: str, publish: str = "task", attempts: int = 1, public: bool = False) -> None:
    """rows (target, file) or (target, body) to objects of the folder."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ObjectSink)
    w = rows.write.format("newsloom_objects").mode("append").option("run", uuid.uuid4().hex).option("publish", publish)
    w.option("attempts", attempts).option("public", str(public).lower()).save(folder)


def put_rows(folder: str, *objects: DataFrame, public: bool = False) -> None:
    """Frames of (target, body string), all objects or none."""
    rows = objects[0]
    for o in objects[1:]:
        rows = rows.unionByName(o)
    put_all(rows.select("target", F.col("body").cast("binary").alias("body")), folder, "commit", public=public)
