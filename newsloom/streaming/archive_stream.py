"""The archive and the events as streams: each file once, late data dropped, daily figures upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.metrics import upserted
from newsloom.operators.momentum import STATE, advanced, momentum
from newsloom.operators.stories import stories
from newsloom.operators.tables import drop_written, written
from newsloom.sources import archive, versions


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_counts(events: DataFrame, late: str = "14 days") -> DataFrame:
    """events (event_id, ts, event_type): counts per day and type; an event counts once, one later than `late` not at all."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    day = once.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return day.select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that has arrived, then stop: what a scheduler calls every few hours. Finished windows are appended to `out`."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def run_polling(df: DataFrame, handle, checkpoint: str, minutes: int = 60):
    """A daemon: handle(batch, id) for what arrived, every `minutes`."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()


def metrics_upsert(path: str, schema: str):
    """A foreachBatch handler: new runs' metrics into the table at path. A batch that was committed is skipped, and a stamp that is there already is left alone."""

    def handle(batch: DataFrame, number: int) -> None:
        if versions.seen(path, number):
            return
        new = upserted(versions.load(batch.sparkSession, path, schema), batch)
        versions.commit(path, {versions.ONE: new}, number)
        drop_written(new)

    return handle


def document_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Archived runs as they arrive: (file, ts, doc), as archive.documents() gives them."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    return archive.parsed(raw.select(F.col("_metadata.file_path").alias("file"), "value"))


def carry(path: str, sources: DataFrame):
    """A foreachBatch handler of document_stream(): a batch's runs, in order of their stamps, through stories and momentum.advanced() to the versioned state at path.

    Stories, momentum and state of a batch are one version, whose notes have the last run's stamp. A run at or before that stamp comes late and
    is refused: the state has gone past it; its file and stamp go to the version's table `refused`. A batch that was committed is skipped, so a
    restart neither loses a run nor counts one twice. The driver has the batch's stamps, at most as many as files in a batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if versions.seen(path, number):
            return
        spark = batch.sparkSession
        batch = written(batch.where("ts is not null and doc is not null"), "runs")
        last = before = versions.pointer(path).get("notes", {}).get("stamp", "")
        state = versions.load(spark, path, STATE, "state")
        runs = [(r.ts, r.file) for r in batch.groupBy("ts").agg(F.min("file").alias("file")).orderBy("ts").collect()]
        told = None
        for stamp, file in [r for r in runs if r[0] > before]:
            s, state = advanced(written(stories(archive.story_fact(archive.fact_of(batch.where(F.col("file") == file))), sources), "stories"), state, stamp[:10])
            told, last = s, stamp
        refused = spark.createDataFrame([r for r in runs if r[0] <= before], "stamp string, file string")
        tables = {"state": state, "refused": refused}
        if told is not None:
            tables |= {"stories": told, "momentum": momentum(state, told)}
        versions.commit(path, tables, number, {"stamp": last})

    return handle


def run_carry(spark: SparkSession, archive_path: str, path: str, sources: DataFrame, checkpoint: str, max_files: int = 1) -> None:
    """carry() over everything that has arrived, then stop."""
    q = document_stream(spark, archive_path, max_files).writeStream.foreachBatch(carry(path, sources)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
