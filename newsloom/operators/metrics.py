"""Archive monitoring: file metrics, daily and overall statistics, trends, plot series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.terms import terms
from newsloom.functions.text import clean_term
from newsloom.operators.tables import written

#: Of a run: its articles, groups (those of the top level), sub-groups, distinct sources, sub-groups a group, groups once more under their other name, and mean group size.
METRICS = ("articles", "groups", "sub_groups", "sources", "ratio", "top_groups", "group_size")


def places(c: Column) -> Column:
    """Two places, halves to the even one; a sum's last bits, which depend on its order, don't count."""
    return F.rint(F.round(c, 9) * 100) / 100


def stats(c: Column, name: str) -> list[Column]:
    """mean, median, min, max and sample deviation, to two places; of nothing 0, of one value deviation 0."""
    each = {"mean": F.avg(c), "median": F.median(c), "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "stdev": F.stddev_samp(c)}
    return [places(F.coalesce(v, F.lit(0.0))).alias(f"{name}_{k}") for k, v in each.items()]


def file_metrics(docs: DataFrame, source_field: str = "source") -> DataFrame:
    """docs (file, ts, doc map of maps of maps of structs): a row of metrics per file, as entry_metrics() gives them."""
    top = docs.select("file", "ts", F.posexplode_outer(F.map_entries("doc")).alias("top_at", "t"))
    sub = top.select("file", "ts", "top_at", F.posexplode_outer(F.map_entries("t.value")).alias("sub_at", "s"))
    return entry_metrics(sub.select("file", "ts", "top_at", "sub_at", F.explode_outer(F.map_values("s.value")).alias("e")).select("file", "ts", "top_at", "sub_at", F.col(f"e.{source_field}").alias("source"), F.col("e").isNotNull().alias("is_entry")))


def entry_metrics(rows: DataFrame) -> DataFrame:
    """rows (file, ts, top_at, sub_at, source, is_entry), an article each: a row of metrics per file.

    What has nothing inside (a file, group or sub-group) is a row with nulls behind it and is_entry false. articles_per_group statistics mix top-level and
    sub-group sizes, as the monitor always did; groups without articles have no size, and sources that are empty aren't counted.
    """
    sub = rows.groupBy("file", "ts", "top_at", "sub_at").agg(F.count_if("is_entry").alias("n"))
    tops = sub.groupBy("file", "ts", "top_at").agg(F.sum("n").alias("n"), F.count("sub_at").alias("subs"))
    sizes = tops.select("file", "n").unionByName(sub.where("sub_at is not null").select("file", "n")).where("n > 0")
    per = sizes.groupBy("file").agg(*stats(F.col("n"), "articles_per_group"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["n"])
    top_sizes = tops.where("n > 0").groupBy("file").agg(in_order(F.struct("top_at", "n")).alias("top_level_group_sizes"))
    sub_sizes = sub.where("n > 0").groupBy("file").agg(in_order(F.struct("top_at", "sub_at", "n")).alias("sub_group_sizes"))
    src = rows.groupBy("file").agg(F.countDistinct(F.nullif("source", F.lit(""))).alias("unique_sources"))
    whole = tops.groupBy("file", "ts").agg(F.sum("n").alias("total_articles"), F.count("top_at").alias("top_level_groups"), F.sum("subs").alias("sub_groups"))
    ratio = F.when(F.col("top_level_groups") > 0, places(F.col("sub_groups") / F.col("top_level_groups"))).otherwise(0.0)
    out = whole.withColumn("total_groups", F.col("top_level_groups")).withColumn("subgroups_per_top_group", ratio)
    for x in (src, per, top_sizes, sub_sizes):
        out = out.join(x, "file", "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("top_level_group_sizes", "sub_group_sizes")})
    return out.fillna(0, [c for c in per.columns if c != "file"])


def run_row(files: DataFrame) -> DataFrame:
    """file_metrics() rows as a run log's: date, ts and METRICS."""
    named = {
        "articles": "total_articles", "groups": "total_groups", "sub_groups": "sub_groups", "sources": "unique_sources", "ratio": "subgroups_per_top_group",
        "top_groups": "top_level_groups", "group_size": "articles_per_group_mean",
    }
    return files.select(F.substring("ts", 1, 10).alias("date"), "ts", *[F.col(named[m]).alias(m) for m in METRICS])


def _those_of(columns: list[str], suffix: str = "") -> list[str]:
    """The metrics that a table has: tables of earlier releases have five."""
    return [m for m in METRICS if m + suffix in columns]


def daily(runs: DataFrame) -> DataFrame:
    """runs (date, ts, metrics…): one row per date with its stamps; runs with the same stamp count once. Totals are sums over runs."""
    once, have = runs.dropDuplicates(["date", "ts"]), _those_of(runs.columns)
    aggs = [x for m in have for x in stats(F.col(m), m)]
    return once.groupBy("date").agg(F.count("*").alias("update_count"), F.sort_array(F.collect_list("ts")).alias("stamps"), *[F.sum(m).alias(f"{m}_total") for m in have], *aggs)


def overall(day: DataFrame, skip_zero: tuple[str, ...] = ("sources", "ratio")) -> DataFrame:
    """Statistics of the daily means; days whose mean is 0 are skipped for `skip_zero`."""
    have = _those_of(day.columns, "_mean")
    cols = [F.when(F.col(f"{m}_mean") != 0, F.col(f"{m}_mean")) if m in skip_zero else F.col(f"{m}_mean") for m in have]
    return day.agg(F.count("*").alias("days"), F.sum("update_count").alias("updates"), *[x for m, c in zip(have, cols, strict=True) for x in stats(c, m)])


def trends(day: DataFrame, days: int = 7) -> DataFrame:
    """(metric, first, last, change_percent, direction) between the first and last of the latest `days` days."""
    last = day.orderBy(F.col("date").desc()).limit(days)
    long_ = last.select("date", F.explode(F.create_map(*[x for m in _those_of(day.columns, "_mean") for x in (F.lit(m), F.col(f"{m}_mean"))])).alias("metric", "value"))
    t = long_.groupBy("metric").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"))
    change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.col("first") * 100)
    direction = F.when(F.abs(change) < 1.0, "stable").when(change > 0, "up").otherwise("down")
    return t.select("metric", "first", "last", places(change).alias("change_percent"), direction.alias("direction"))


def plot_series(runs: DataFrame, days: int) -> DataFrame:
    """Sums per day of the latest days: articles, groups, and articles in no group of their own."""
    alone = F.greatest(F.col("articles") - F.col("groups") - F.col("sub_groups"), F.lit(0))
    d = runs.groupBy("date").agg(F.sum("articles").alias("articles"), F.sum("groups").alias("groups"), F.sum(alone).alias("independent"))
    return d.orderBy(F.col("date").desc()).limit(days)


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Runs of the cache and the new ones; a stamp that is there already stays as it is."""
    fresh = new.dropDuplicates(["date", "ts"]).join(cache.select("date", "ts"), ["date", "ts"], "left_anti")
    return written(cache.unionByName(fresh.select(*cache.columns)), "runs")


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def group_sizes(groups: DataFrame, key: str) -> DataFrame:
    return groups.groupBy(key).agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_size"), F.max("n").alias("max_size"))


def top_words(tokens: DataFrame, n: int) -> DataFrame:
    """tokens (pos, words): the most frequent words, ties to the first met."""
    w = tokens.select("pos", F.posexplode("words").alias("at", "word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first")).orderBy(F.col("n").desc(), "first").limit(n).select("word", "n")


def absorbed_terms(terms: DataFrame) -> DataFrame:
    """terms (term, freq): one-word terms that are a word of a longer one go; the longer gets 1 for each."""
    long_ = terms.where(F.size(F.split("term", " ")) > 1)
    parts = long_.select(F.col("term").alias("holder"), F.explode(F.array_distinct(F.split("term", " "))).alias("term"))
    gone = terms.where(F.size(F.split("term", " ")) == 1).join(parts, "term").select("term", "holder")
    more = gone.groupBy("holder").agg(F.count("*").alias("more")).select(F.col("holder").alias("term"), "more")
    left = terms.join(gone.select("term").distinct(), "term", "left_anti").join(more, "term", "left")
    return left.select("term", (F.col("freq") + F.coalesce("more", F.lit(0))).alias("freq"))


def archive_window(runs: DataFrame, days: int = 14) -> DataFrame:
    """runs (file, minute, date): one file per minute stamp (the first), of the latest `days` distinct dates."""
    once = runs.groupBy("minute").agg(F.min("file").alias("file"), F.min("date").alias("date"))
    last = once.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
    return once.join(last, "date", "left_semi")


def top_terms(terms: DataFrame, n: int = 5) -> DataFrame:
    """terms (term, freq) after absorption, in brackets: most frequent, then most words, then by text."""
    t = absorbed_terms(terms).withColumn("words", F.size(F.split("term", " ")))
    t = t.orderBy(F.col("freq").desc(), F.col("words").desc(), "term").limit(n)
    return t.select(F.concat(F.lit("["), F.col("term"), F.lit("]")).alias("term"), "freq")


def sentence_terms(sentences: DataFrame, extract=terms) -> DataFrame:
    """sentences (text): (term, freq), cleaned terms with the number of sentences that have them."""
    t = sentences.select(F.explode(extract(F.col("text"))).alias("raw")).select(clean_term(F.col("raw")).alias("term")).where("term <> ''")
    return t.groupBy("term").agg(F.count("*").alias("freq"))


def group_keywords(tokens: DataFrame, n: int = 5) -> DataFrame:
    """tokens (group, pos, words): each group's n most frequent words, ties to the first met, and a suggested name of them."""
    # dealt by group before words are laid out, in full number: rows of (group, word) and the ranks behind need no further shuffle
    dealt = tokens.select("group", "pos", "words").repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    w = dealt.select("group", "pos", F.posexplode("words").alias("at", "word")).where("word <> ''")
    c = w.groupBy("group", "word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.col("n").desc(), "first"))).where(F.col("place") <= n)
    words = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return c.groupBy("group").agg(words.alias("keywords")).withColumn("name", F.initcap(F.array_join(F.slice("keywords", 1, 3), " ")))
