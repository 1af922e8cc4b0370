"""python -m newsloom.cli run | update | dashboard | stats | analyze | clear-cache | replay | validate | mirror"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsloom.config import debug, settings


def session() -> SparkSession:
    return SparkSession.builder.appName("newsloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="newsloom")
    p.add_argument("--config", help="INI file; NEWSLOOM_<SECTION>_<KEY> overrides it")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="feeds to stories")
    r.add_argument("--feeds", help="file with one feed URL a line; default: [feeds] list")
    r.add_argument("--out", help="default: [storage] local")
    r.add_argument("--sources")
    r.add_argument("--as-of", required=True)
    for name in ("stats", "analyze"):
        s = sub.add_parser(name, help="figures of the run metrics table")
        s.add_argument("--metrics", required=True)
        s.add_argument("--days", type=int, default=7)
    u = sub.add_parser("update", help="new archive files to run metrics")
    u.add_argument("--archive", required=True)
    u.add_argument("--metrics", required=True)
    u.add_argument("--all-json", action="store_true", help="count every .json, state files too")
    d = sub.add_parser("dashboard", help="update's table: status, statistics, latest days")
    d.add_argument("--metrics", required=True)
    d.add_argument("--days", type=int, default=7)
    d.add_argument("--now", required=True)
    c = sub.add_parser("clear-cache")
    c.add_argument("--metrics", required=True)
    b = sub.add_parser("replay", help="archived runs, one a minute, latest 14 days, to a momentum state")
    b.add_argument("--archive", required=True)
    b.add_argument("--sources")
    b.add_argument("--state", required=True)
    v = sub.add_parser("validate", help="violations of a published stories table")
    v.add_argument("--out", required=True)
    g = sub.add_parser("mirror", help="copies an archive's runs that are missing or of another size")
    g.add_argument("--archive", required=True)
    g.add_argument("--target", required=True)
    g.add_argument("--since", default="2021")
    a = p.parse_args(args)
    conf = settings(a.config)
    if a.cmd == "run":
        a.feeds, a.out, a.sources = a.feeds or conf["feeds"]["list"], a.out or conf["storage"]["local"], a.sources or conf["feeds"]["sources"] or None
        if not a.feeds or not a.out:
            p.error("run needs --feeds and --out, or their settings")
    spark = session()
    if not debug(conf):
        spark.sparkContext.setLogLevel("ERROR")
    if a.cmd == "run":
        from newsloom.functions.dates import parsed
        from newsloom.operators import checks
        from newsloom.operators.momentum import STATE
        from newsloom.operators.naming import CACHE
        from newsloom.operators.tables import written
        from newsloom.plans.engine import run
        from newsloom.sources import archive, feeds

        got = written(feeds.fetched(feeds.feed_list(spark, a.feeds), feeds.http_fetch, attempts=3), "fetched")
        read = written(feeds.entries_of(got), "entries")
        day = F.to_date(parsed(F.col("published")))
        health = checks.feed_health(got.drop("body"), read.where("not bozo").select(F.col("feed_url").alias("url"), day.alias("day")), F.lit(a.as_of).cast("date"))
        late = read.where("bozo").join(got.where("error is null").select(F.col("url").alias("feed_url")), "feed_url", "left_semi")
        checks.emit_health(checks.with_late_errors(health, late.select(F.col("feed_url").alias("url"), "error")), a.as_of, a.out)
        e = read.withColumn("day", day).withColumn("pos", F.monotonically_increasing_id())
        out = run(e, feeds.sources_dimension(spark, a.sources), archive.state(spark, f"{a.out}/state", STATE), archive.state(spark, f"{a.out}/names", CACHE), a.as_of)
        archive.emit(out["groups"], a.as_of, conf["params"]["version"], "local", local=a.out)
        ok, why = archive.emit_stories(out["stories"], out["momentum"], out["state"], a.out, f"{a.out}/state")
        archive.save_state(out["names"], f"{a.out}/names")
        print("published" if ok else f"held back: {why}")
        return 0 if ok else 1
    from newsloom.operators import checks, metrics
    from newsloom.sources import archive, versions

    if a.cmd == "mirror":
        print(f"{archive.mirrored(spark, a.archive, a.target, a.since)} files copied")
        return 0
    if a.cmd == "update":
        docs = archive.documents(spark, a.archive)
        if not a.all_json:
            docs = docs.where(F.substring_index("file", "/", -1).rlike(archive.NAME))
        m = metrics.file_metrics(docs.withColumn("doc", F.coalesce("doc", F.create_map().cast(archive.DOC))))
        m = metrics.run_row(m)
        old = archive.state(spark, a.metrics, ", ".join(f"{n} {t}" for n, t in m.dtypes))
        archive.save_state(metrics.upserted(old, m), a.metrics)
        return 0
    if a.cmd == "clear-cache":
        archive.save_state(archive.state(spark, a.metrics, "date string").limit(0), a.metrics)
        return 0
    if a.cmd == "replay":
        from newsloom.plans.engine import replay
        from newsloom.sources import feeds

        files = metrics.archive_window(archive.with_minutes(archive.listing(spark, a.archive)))
        fact = archive.story_fact(archive.fact_of(archive.documents(spark, a.archive)))
        days = [(r.date, fact.where(F.col("file") == r.file)) for r in files.orderBy("minute").collect()]  # a row per run of two weeks
        archive.save_state(replay(spark, days, feeds.sources_dimension(spark, a.sources)), a.state)
        return 0
    if a.cmd == "validate":
        stories, moving = archive.published(spark, a.out)
        bad = checks.violations(stories).unionByName(checks.momentum_violations(moving))
        bad.show(100, truncate=False)
        return int(not bad.isEmpty())
    runs = versions.read(spark, a.metrics)
    if a.cmd == "dashboard":
        last = F.max(F.to_timestamp("ts"))
        now = F.lit(a.now).cast("timestamp")
        runs.agg(last.alias("last_update"), checks.status(last, now).alias("status")).show(truncate=False)
        metrics.overall(metrics.daily(runs)).show(vertical=True)
        metrics.plot_series(runs, a.days).show()
        return 0
    day = metrics.daily(runs)
    (metrics.overall(day) if a.cmd == "stats" else metrics.trends(day, a.days)).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
