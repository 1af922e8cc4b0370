"""The archive of published documents: listing, reading, writing, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.dates import file_stamp, minute_of
from newsloom.operators.checks import gate
from newsloom.operators.stories import document_header
from newsloom.operators.tables import written
from newsloom.sources import objects, versions

DOC = "map<string,map<string,map<string,struct<title:string,link:string,timestamp:string,source:string>>>>"
#: Entries as older files write them too: published and title_detail_base for timestamp and source.
ENTRIES = DOC.replace("source:string", "source:string,published:string,title_detail_base:string")
NAME = r"^latest_news_\d[^/]*\.json$"
WRITERS = ("local", "remote", "both")
#: Files of a mirror up to which they are dealt to tasks by size, in one window over their listing; more are dealt by hash.
DEALT = 100_000


def listing(spark: SparkSession, path: str, since: str | None = None, compat_all_json: bool = False) -> DataFrame:
    """(file, name, size, stamp): files of the archive; compat_all_json keeps every .json, as the old monitor did."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    f = f.withColumn("name", F.substring_index("file", "/", -1)).withColumn("stamp", file_stamp(F.col("name")))
    f = f.where(F.col("name").endswith(".json") if compat_all_json else F.col("name").rlike(NAME))
    return f.where(F.col("stamp") >= since) if since else f


def _entry(e: Column) -> Column:
    either = lambda name, older: F.coalesce(F.nullif(e[name], F.lit("")), e[older]).alias(name)
    return F.struct(e["title"].alias("title"), e["link"].alias("link"), either("timestamp", "published"), either("source", "title_detail_base"))


def _doc(raw: Column) -> Column:
    return F.transform_values(raw, lambda _t, subs: F.transform_values(subs, lambda _s, es: F.transform_values(es, lambda _e, e: _entry(e))))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, doc) of every JSON file under path, with old or new names of an entry's fields; one that can't be read has doc null."""
    return parsed(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def parsed(raw: DataFrame) -> DataFrame:
    """raw (file, value): (file, ts, doc) of JSON documents."""
    return raw.select("file", file_stamp(F.substring_index("file", "/", -1)).alias("ts"), _doc(F.from_json("value", ENTRIES)).alias("doc"))


def fact_of(docs: DataFrame) -> DataFrame:
    """(file, ts, doc) to rows (file, ts, top_at, top_id, sub_at, sub_id, pos, title, link, timestamp, source), in the documents' order."""
    a = docs.select("file", "ts", F.posexplode(F.map_entries("doc")).alias("top_at", "t"))
    b = a.select("file", "ts", "top_at", F.col("t.key").alias("top_id"), F.posexplode(F.map_entries("t.value")).alias("sub_at", "s"))
    c = b.select("file", "ts", "top_at", "top_id", "sub_at", F.col("s.key").alias("sub_id"), F.posexplode(F.map_values("s.value")).alias("pos", "e"))
    return c.select("file", "ts", "top_at", "top_id", "sub_at", "sub_id", "pos", "e.*")


def story_fact(fact: DataFrame) -> DataFrame:
    """fact_of() rows to stories()' input: groups numbered by their place in the document."""
    return fact.withColumn("group", F.col("top_at").cast("long")).withColumn("label", F.col("top_id")).withColumn("pos", F.col("sub_at") * 1_000_000 + F.col("pos"))


def _object(at: str, key: str, value: Column) -> Column:
    """Aggregate: a JSON object of key (a column's name) to value (JSON), in the order of `at`."""
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'^\{"k":(.*)\}$', 1)
    each = F.transform(F.sort_array(F.collect_list(F.struct(at, F.concat(name, F.lit(":"), value).alias("j")))), lambda x: x["j"])
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def document_of(fact: DataFrame) -> DataFrame:
    """fact (cluster, top_id, leader, sub_id, pos, title, …) to one row with the JSON of the three-level map; of equal labels the last stays."""
    sub = fact.groupBy("cluster", "top_id", "leader", "sub_id").agg(_object("pos", "title", F.to_json(F.struct("title", "link", "timestamp", "source"))).alias("j"))
    sub = sub.groupBy("cluster", "top_id", "sub_id").agg(F.max_by("j", "leader").alias("j"), F.min("leader").alias("leader"))
    top = sub.groupBy("cluster", "top_id").agg(_object("leader", "sub_id", F.col("j")).alias("j"))
    top = top.groupBy("top_id").agg(F.max_by("j", "cluster").alias("j"), F.min("cluster").alias("cluster"))
    return top.agg(_object("cluster", "top_id", F.col("j")).alias("json"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table's current version, or an empty one where there is none yet."""
    return versions.load(spark, path, schema)


def save_state(df: DataFrame, path: str, batch: int | None = None, notes: dict | None = None) -> None:
    """A state table's next version; df may have been read from the current one."""
    versions.commit(path, {versions.ONE: df}, batch, notes)


def count(spark: SparkSession, path: str, since: str | None = None, compat_all_json: bool = False) -> int:
    """How many files of runs the archive has; 0 where there is no archive."""
    try:
        return listing(spark, path, since, compat_all_json).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def metadata(spark: SparkSession, stamp: str, version: str, local: str | None, remote: str | None) -> DataFrame:
    """One row; the local path wins as the reference to the latest document."""
    return spark.createDataFrame([(stamp, version, local or remote)], "datetime string, version string, latest_log_reference string")


def emit(fact: DataFrame, stamp: str, version: str, writer: str, local: str | None = None, remote: str | None = None, public: bool = False) -> None:
    """Archive copy, latest document and metadata, to the places that the writer names: at each place all three or none.

    public: the remote place's objects are readable by everybody, where it has access lists.
    """
    if writer not in WRITERS:
        raise ValueError(f"writer is one of {', '.join(WRITERS)}, not {writer!r}")
    doc = written(document_of(fact), "document")
    name = f"latest_news_{version}_{stamp.replace(':', '-')}.json"  # a colon can't be in every file system's names
    ref = {"local": f"{local}/latest_news.json" if writer in ("local", "both") else None, "remote": f"{remote}/archive/{name}"}
    meta = metadata(fact.sparkSession, stamp, version, ref["local"], ref["remote"]).select(F.lit("latest_news_metadata.json").alias("target"), F.to_json(F.struct("*")).alias("body"))
    for kind, place in (("local", local), ("remote", remote)):
        if writer in (kind, "both") and place:
            body = lambda target: doc.select(F.lit(target).alias("target"), F.col("json").alias("body"))
            objects.put_rows(place, body(f"archive/{name}"), body("latest_news.json"), meta, public=public and kind == "remote")


def log_visualization(fact: DataFrame, stamp: str, version: str, local: str, remote: str | None = None, s3: bool = False) -> None:
    """emit() under its earlier name: local, or with s3 both."""
    emit(fact, stamp, version, "both" if s3 else "local", local, remote)


def log_s3(fact: DataFrame, stamp: str, version: str, remote: str) -> None:
    """emit() to the remote place alone, under its earlier name."""
    emit(fact, stamp, version, "remote", remote=remote)


def emit_stories(stories: DataFrame, momentum: DataFrame, new_state: DataFrame, path: str, state_path: str, gated: bool = True, **limits) -> tuple[bool, str]:
    """Stories, momentum and, last, the state, if the gate lets them through: by distinct articles and by the number of stories."""
    spark = stories.sparkSession
    counts = lambda s: tuple(document_header(s).select("article_count", "story_count").first())
    old = versions.pointer(path).get("notes", {}).get("counts", (None, None))
    own = counts(stories)
    row = spark.createDataFrame([(*own, *old)], "a long, s long, pa long, ps long")
    ok, reason = row.select(gate(*(F.col(c) for c in row.columns), **limits).alias("g")).first().g
    if gated and not ok:
        return False, reason
    versions.commit(path, {"stories": stories, "momentum": momentum}, notes={"counts": own})
    save_state(new_state, state_path)
    return True, ""


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stories and momentum as emit_stories() published them last."""
    at = f"{path}/{versions.pointer(path)['version']}"
    return spark.read.parquet(f"{at}/stories"), spark.read.parquet(f"{at}/momentum")


def raw_path(path: str, stamp: str, name: str) -> str:
    """Where a run's raw file is kept: by year and month of its stamp."""
    return f"{path}/{stamp[:4]}/{stamp[5:7]}/{name}"


def raw_document(spark: SparkSession, path: str, stamp: str, name: str) -> DataFrame | None:
    """(file, ts, doc) of a raw file that is kept; None if it isn't."""
    at = raw_path(path, stamp, name)
    return documents(spark, at) if objects.exists(at) else None


def save_raw(df: DataFrame, path: str, stamp: str = "ts") -> None:
    """Raw documents by year and month."""
    t = F.to_timestamp(F.substring(stamp, 1, 10))
    df.withColumn("year", F.year(t)).withColumn("month", F.month(t)).write.mode("append").partitionBy("year", "month").parquet(path)


def latest_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The newest metadata row under path, or no row."""
    try:
        m = spark.read.schema("datetime string, version string, latest_log_reference string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "datetime string, version string, latest_log_reference string")
        raise
    return m.orderBy(F.col("datetime").desc()).limit(1)


def to_mirror(there: DataFrame, here: DataFrame) -> DataFrame:
    """Listings (name, size): what a mirror lacks or has in another size."""
    return there.join(here.select("name", "size"), ["name", "size"], "left_anti")


def mirrored(spark: SparkSession, path: str, target: str, since: str = "2021", attempts: int = 3) -> int:
    """Copies the runs of an archive from `since` on to target/<year>/, but those that are there in the same size; their number.

    Tasks copy, each file under another name first and moved when it is whole, so a lost task leaves no half file; the driver has the listings alone.
    A copy that fails `attempts` times fails its task.
    """
    try:
        here = listing(spark, target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        here = spark.createDataFrame([], "name string, size bigint")
    todo = to_mirror(listing(spark, path, since), here).select(F.concat_ws("/", F.substring("stamp", 1, 4), "name").alias("target"), "file", "size")
    todo = written(todo, "mirror")
    n = todo.count()
    if n:  # largest first, dealt in turn
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        dealt = todo.withColumn("k", F.row_number().over(Window.orderBy(F.col("size").desc(), "target")) % tasks) if n <= DEALT else todo.withColumn("k", F.pmod(F.xxhash64("target"), F.lit(tasks)))
        objects.put_all(dealt.repartitionById(tasks, F.col("k").cast("int")).select("target", "file"), target, attempts=attempts)
    return n


def with_minutes(files: DataFrame) -> DataFrame:
    """A listing with each file's minute and date, for metrics.archive_window()."""
    m = minute_of(F.col("name"))
    return files.withColumn("minute", m).withColumn("date", F.substring(m, 1, 10)).where("minute is not null")
