import json
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom.operators import momentum
from newsloom.plans import engine
from newsloom.sources import archive, objects, versions
from newsloom.streaming import archive_stream


def _files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_put_and_get(tmp_path):
    at = f"file://{tmp_path}/a/x.json"
    assert objects.get(at) is None and not objects.exists(at)
    objects.put(at, b"one")
    objects.put(at, b"two", public=True)
    assert objects.get(at) == b"two" and objects.exists(at) and _files(tmp_path) == ["a/x.json"]


def test_public_where_no_lists_are_taken(tmp_path):
    class Store:
        def __init__(self, says):
            self.says, self.asked = says, []

        def open_output_stream(self, path, metadata=None):
            self.asked.append(metadata)
            if metadata:
                raise OSError(self.says)
            return open(path, "wb")

    s = Store("AccessControlListNotSupported: The bucket does not allow ACLs")
    assert objects.write_whole(s, str(tmp_path / "x"), iter([b"a", b"b"]), public=True) == 2 and s.asked == [{"ACL": "public-read"}, None]
    with pytest.raises(OSError, match="denied"):
        objects.write_whole(Store("Access denied"), str(tmp_path / "y"), iter([b"a"]), public=True)


def test_a_killed_task_leaves_no_half_file(spark, tmp_path, monkeypatch):
    """The first attempt to copy each file dies halfway; retries of the task's call end the copy. Without retries the write fails and only whole files are there."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    for k in range(6):
        (a / f"f{k}").write_bytes(bytes([k]) * 1000)
    rows = spark.createDataFrame([(f"x/f{k}", f"file://{a}/f{k}") for k in range(6)], "target string, file string").repartition(3)
    mark = str(tmp_path)

    class Dies(objects.Writer):
        def _one(self, target, file, body):
            store, _ = objects.store_of(self.folder)
            if TaskContext.get() is not None and not os.path.exists(f"{mark}/{target.replace('/', '-')}"):
                open(f"{mark}/{target.replace('/', '-')}", "w").close()
                part = f"{objects.store_of(self.folder)[1]}/_parts/{self.run}/dead"
                store.create_dir(part.rpartition("/")[0])
                objects.write_whole(store, part, iter([b"half"]))
                raise OSError("killed")
            return super()._one(target, file, body)

    class Sink(objects.ObjectSink):
        def writer(self, schema, overwrite):
            o = self.options
            return Dies(o["path"], o["run"], o.get("publish", "task"), int(o["attempts"]), False)

    monkeypatch.setattr(objects, "ObjectSink", Sink)
    with pytest.raises(Exception, match="killed"):
        objects.put_all(rows, f"file://{b}", attempts=1)
    assert all((b / f).read_bytes() == (a / f[-2:]).read_bytes() for f in _files(b)) and not (b / "_parts").exists() or not os.listdir(b / "_parts")
    objects.put_all(rows, f"file://{b}", attempts=2)
    assert _files(b) == [f"x/f{k}" for k in range(6)] and all((b / f).read_bytes() == (a / f[-2:]).read_bytes() for f in _files(b))
    assert not os.listdir(b / "_parts")


def test_objects_together_or_not(spark, tmp_path):
    good = spark.createDataFrame([("one", "1"), ("dir/two", "2")], "target string, body string")
    bad = spark.createDataFrame([("three", "3")], "target string, body string").withColumn("body", F.when(F.rand() < 2, F.raise_error(F.lit("broken"))).otherwise(F.col("body")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        objects.put_rows(f"file://{tmp_path}/t", good, bad)
    assert [f for f in _files(tmp_path) if "_parts" not in f] == []
    objects.put_rows(f"file://{tmp_path}/t", good)
    assert {f: (tmp_path / "t" / f).read_text() for f in _files(tmp_path / "t")} == {"one": "1", "dir/two": "2"}
    with pytest.raises(ValueError, match="publish"):
        objects.Writer("x", "r", "never", 1, False)


def test_counts_and_raw_files(spark, tmp_path):
    name = "latest_news_0.2.1_2026-03-01T10-20.json"
    assert archive.count(spark, str(tmp_path / "none")) == 0 and archive.raw_document(spark, str(tmp_path), "2026-03-01T10:20", name) is None
    at = archive.raw_path(str(tmp_path), "2026-03-01T10:20", name)
    objects.put(at, b'{"[A]": {"[a]": {"1": {"title": "t"}}}}')
    (tmp_path / "2026" / "03" / "state.json").write_text("{}")
    assert archive.raw_document(spark, str(tmp_path), "2026-03-01T10:20", name).where("doc is not null").count() == 1
    assert archive.count(spark, str(tmp_path)) == 1 and archive.count(spark, str(tmp_path), compat_all_json=True) == 2


def test_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    rows = lambda: sorted(x.a for x in versions.load(spark, at, "a long").collect())
    assert rows() == [] and versions.pointer(at) == {} and not versions.seen(at, 0)
    frame(9).write.parquet(at)  # an earlier release's layout
    assert rows() == [9]
    for n in range(4):
        versions.commit(at, {versions.ONE: versions.load(spark, at, "a long").unionByName(frame(n))}, batch=n)
    assert rows() == [0, 1, 2, 3, 9] and len([f for f in os.listdir(at) if f.startswith("v-")]) == versions.KEEP and not [f for f in os.listdir(at) if f.endswith(".parquet")]
    name = versions.commit(at, {versions.ONE: frame(77)}, batch=3)
    assert rows() == [0, 1, 2, 3, 9] and versions.pointer(at)["version"] == name and versions.seen(at, 2) and not versions.seen(at, 4)
    versions.commit(at, {versions.ONE: frame(5), "other": frame(6)}, notes={"x": 1})
    assert rows() == [5] and versions.pointer(at)["batch"] == 3 and [x.a for x in versions.read(spark, at, "other").collect()] == [6]


def test_death_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The driver dies when the table is written and the pointer isn't; the batch runs again."""
    at, schema = str(tmp_path / "t"), "date string, ts string, articles long"
    handle = archive_stream.metrics_upsert(at, schema)
    batch = lambda *r: spark.createDataFrame(list(r), schema)
    handle(batch(("d", "1", 5)), 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            handle(batch(("d", "1", 99), ("d", "2", 6)), 1)
    assert [(x.ts, x.articles) for x in versions.load(spark, at, schema).collect()] == [("1", 5)]
    for _ in range(2):
        handle(batch(("d", "1", 99), ("d", "2", 6)), 1)
    handle(batch(("d", "3", 7)), 1)  # a batch with that number has been committed
    assert sorted((x.ts, x.articles) for x in versions.load(spark, at, schema).collect()) == [("1", 5), ("2", 6)]


def _run_file(path, k):
    title = lambda s: {"title": f"{s} {k}", "link": f"https://{s}.com/{k}", "timestamp": f"2026-03-{k:02}T08:00:00Z", "source": f"https://{s}.com/f"}
    doc = {"[bridge] [storm]": {"[bridge]": {str(i): title(s) for i, s in enumerate(["a", "b", "c"][: 1 + k % 3])}}, "[music]": {"[music]": {"1": title("m")}}}
    (path / f"latest_news_0.2.1_2026-03-{k:02}T10-00-00.json").write_text(json.dumps(doc))


def test_identity_is_carried_by_the_stream(spark, tmp_path):
    """Ten runs by stream, restarted after the fifth, with a late one: the state is replay()'s."""
    a, out, cp = tmp_path / "archive", str(tmp_path / "out"), str(tmp_path / "cp")
    a.mkdir()
    none = spark.createDataFrame([], "url string, outlet string, domain string, section string")
    for k in range(1, 6):
        _run_file(a, k)
        os.utime(a / f"latest_news_0.2.1_2026-03-{k:02}T10-00-00.json", (1_700_000_000 + k, 1_700_000_000 + k))
    archive_stream.run_carry(spark, str(a), out, none, cp, max_files=3)
    assert versions.pointer(out)["notes"]["stamp"].startswith("2026-03-05")
    for k in range(6, 11):
        _run_file(a, k)
    late = "latest_news_0.2.1_2026-03-02T09-00-00.json"
    (a / late).write_text((a / "latest_news_0.2.1_2026-03-02T10-00-00.json").read_text())
    archive_stream.run_carry(spark, str(a), out, none, cp, max_files=10)
    got = {tuple(map(str, x)) for x in versions.load(spark, out, momentum.STATE, "state").collect()}
    assert [x.file.rsplit("/", 1)[1] for x in versions.read(spark, out, "refused").collect()] == [late]
    (a / late).unlink()
    docs = archive.documents(spark, str(a))
    days = [(f"2026-03-{k:02}", archive.story_fact(archive.fact_of(docs.where(F.col("file").endswith(f"-{k:02}T10-00-00.json"))))) for k in range(1, 11)]
    want = {tuple(map(str, x)) for x in engine.replay(spark, days, none).select(*momentum_columns()).collect()}
    assert got == want and len(got) > 0
    assert versions.read(spark, out, "stories").count() > 0 and versions.read(spark, out, "momentum").count() > 0


def momentum_columns():
    return [c.split()[0] for c in momentum.STATE.replace("array<struct<date:string,outlets:bigint,articles:bigint>>", "x").split(", ")]
