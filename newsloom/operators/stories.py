"""Overlapping groups to classified and ranked stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, links
from newsloom.functions.titles import bare, capital_runs, is_deal, keywords, proper_nouns, words
from newsloom.operators.connect import containment_components
from newsloom.operators.ingest import resolved
from newsloom.operators.tables import written

MERGE, MAX_KEYWORDS, MAX_ENTITIES, MIN_RUN = 0.5, 8, 10, 3
#: Tasks over which a story's runs of words are dealt.
PARTS = 64


def flattened(fact: DataFrame) -> DataFrame:
    """fact (group, label, pos, title, link, timestamp, source): one row per group and link identity, the first by pos."""
    key = links.normalize_link(F.col("link"))
    rows = fact.withColumn("key", key).where("key <> ''")
    first = F.min_by(F.struct("title", "link", F.col("timestamp").alias("published_raw"), F.col("source").alias("feed"), "pos"), F.col("pos"))
    return rows.groupBy("group", "label", "key").agg(first.alias("a")).select("group", "label", "key", "a.*")


def merged(members: DataFrame, threshold: float = MERGE) -> DataFrame:
    """members (group, key): (group, story), story the smallest group reachable through containment >= threshold."""
    root = containment_components(members.select(F.col("group").alias("id"), F.col("key").alias("item")), threshold)
    g = members.select("group").distinct()
    return g.join(root, F.col("group") == F.col("id"), "left").select("group", F.coalesce("root", "group").alias("story"))


def modal(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Counts of value within keys, and its place: most frequent first, ties to the first met (smallest pos)."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    return n.withColumn("place", F.row_number().over(w))


def story_id(keys: Column) -> Column:
    """keys: array of link identities."""
    return F.concat(F.lit("st_"), F.substring(F.sha2(F.array_join(F.slice(F.array_sort(F.array_distinct(keys)), 1, 20), ","), 256), 1, 6))


def template_runs(titles: DataFrame) -> DataFrame:
    """titles (story, ord, title): (story, run), the longest word run of MIN_RUN or more that 60 % of the titles share,
    that no longer shared run contains and that has no proper noun; 0 if none."""
    t = written(titles.select("story", "ord", words(F.col("title")).alias("w")), "titles")
    n = t.groupBy("story").agg(F.count("*").alias("n"))
    low = F.transform("w", lambda x: F.lower(x))
    starts = F.sequence(F.lit(1), F.size("w") - MIN_RUN + 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(MIN_RUN), F.size("w") - i + 1), lambda k: F.slice("w", i, k))))
    r = t.select("story", "ord", low.alias("w")).where(F.size("w") >= MIN_RUN).select("story", "ord", F.explode(F.array_distinct(runs)).alias("r"))
    # a story's runs meet its number of titles in PARTS tasks, whatever its size
    per = r.groupBy("story", "r").agg(F.count("*").alias("c")).where("c > 1").withColumn("part", F.pmod(F.xxhash64("r"), F.lit(PARTS)).cast("int"))
    sized = n.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    shared = written(per.join(sized, ["story", "part"]).where(F.col("c") >= F.ceil(F.col("n") * 6 / 10)).select("story", "r"), "runs")
    longer = shared.where(F.size("r") > MIN_RUN)
    inner = longer.select("story", F.slice("r", F.lit(1), F.size("r") - 1).alias("r")).unionByName(longer.select("story", F.slice("r", F.lit(2), F.size("r") - 1).alias("r"))).distinct()
    maximal = shared.join(inner, ["story", "r"], "left_anti")
    # proper nouns meet the words of these runs one by one, never gathered for a story
    proper = t.select("story", F.explode(proper_nouns(F.col("w"))).alias("noun")).distinct()
    named = maximal.select("story", "r", F.explode("r").alias("x")).withColumn("noun", bare(F.col("x"))).join(proper, ["story", "noun"]).select("story", "r").distinct()
    best = maximal.join(named, ["story", "r"], "left_anti").groupBy("story").agg(F.max(F.size("r")).alias("run"))
    return n.join(best, "story", "left").select("story", F.coalesce("run", F.lit(0)).alias("run"))


def kind_of(deal_share: Column, outlets: Column, run: Column) -> Column:
    return F.when(deal_share > 0.5, "deal").when((outlets == 1) & (run >= MIN_RUN), "roundup").otherwise("story")


def fallback_headlines(art: DataFrame, top: DataFrame) -> DataFrame:
    """art (story, outlet, ord, title), top (story, outlet: its modal one): each story's longest title of that outlet, of equals the first by ord."""
    return art.join(top, ["story", "outlet"]).groupBy("story").agg(F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("headline"))


def stories(fact: DataFrame, sources: DataFrame, threshold: float = MERGE, entities=capital_runs) -> DataFrame:
    """fact (group long in rank order, label, pos, title, link, timestamp, source) and sources (url, outlet, domain, section) to ranked stories."""
    members = written(flattened(fact), "members")
    story = written(merged(members, threshold), "story")
    m = members.join(story, "group")
    order = F.struct("group", "pos")
    art = m.groupBy("story", "key").agg(F.min_by(F.struct("title", "link", "published_raw", "feed"), order).alias("a"), F.min(order).alias("met"))
    art = art.select("story", "key", "met", "a.*")
    art = resolved(art, sources, links.feed_domain(F.col("feed")), links.outlet_of_domain(links.feed_domain(F.col("feed"))))
    art = art.withColumn("published", dates.to_iso8601(F.coalesce("published_raw", F.lit(""))))
    ord_ = F.row_number().over(Window.partitionBy("story").orderBy(F.col("published").desc(), "met"))
    art = written(art.withColumn("ord", ord_).withColumn("day", dates.iso_date(F.col("published"))), "articles")

    outlet = modal(art, ["story"], "outlet", "ord")
    domain = art.groupBy("story", "outlet").agg(F.max_by("domain", "ord").alias("domain"))
    outlets = outlet.join(domain, ["story", "outlet"]).groupBy("story").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "outlet", "domain", F.col("n").alias("articles")))), lambda x: F.struct(x["outlet"].alias("outlet"), x["domain"].alias("domain"), x["articles"].alias("articles"))).alias("outlets")
    )
    section = modal(art, ["story"], "section", "ord").where("place = 1").select("story", "section")
    top = outlet.where("place = 1").select("story", "outlet")
    headline = fallback_headlines(art, top)
    words_ = m.select("story", "group", keywords(F.col("label")).alias("k")).distinct().groupBy("story").agg(
        F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("group", "k"))), lambda x: x["k"]))), 1, MAX_KEYWORDS).alias("keywords")
    )
    ents = art.select("story", "ord", F.posexplode(entities(F.col("title"))).alias("p", "entity")).withColumn("at", F.struct("ord", "p"))
    ents = modal(ents, ["story"], "entity", "at").where(F.col("place") <= MAX_ENTITIES).groupBy("story").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"]).alias("entities")
    )
    runs = template_runs(art.select("story", "ord", "title"))
    merged_from = story.groupBy("story").agg(F.count("*").alias("merged_from_groups"))
    z = F.when(F.col("published").endswith("Z"), F.col("published"))
    base = art.groupBy("story").agg(
        story_id(F.collect_set("key")).alias("id"),
        F.count("*").alias("article_count"),
        F.countDistinct("outlet").alias("outlet_count"),
        F.coalesce(F.max(z), F.lit("")).alias("latest_published"),
        F.coalesce(F.min(F.nullif("day", F.lit(""))), F.lit("")).alias("first_seen"),
        F.greatest(F.countDistinct(F.nullif("day", F.lit(""))), F.lit(1)).alias("days_running"),
        F.avg(is_deal(F.col("title")).cast("int")).alias("deal_share"),
        F.sort_array(F.collect_list(F.struct("ord", "title", "link", "published", "outlet", "domain", "section", "feed"))).alias("articles"),
    )
    none = F.array().cast("array<string>")
    out = base
    for x in (headline, section, outlets, merged_from, runs):
        out = out.join(x, "story")
    out = out.join(words_, "story", "left").join(ents, "story", "left")
    out = out.withColumn("kind", kind_of(F.col("deal_share"), F.col("outlet_count"), F.col("run")))
    return out.select(
        "story", "id", "headline", F.lit("fallback").alias("headline_source"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("entities", none).alias("entities"),
        "section", "kind", "outlet_count", "article_count", "latest_published", "first_seen", "days_running", "merged_from_groups", "outlets", "articles",
    )


def story_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("outlet_count").desc(), F.col("article_count").desc(), F.col("latest_published").desc(), "story")


def document_header(s: DataFrame) -> DataFrame:
    """One row: feeds, distinct articles, stories, counts of kinds."""
    rows = s.select("story", "kind", F.explode("articles").alias("a"))
    kinds = [F.countDistinct(F.when(F.col("kind") == x, F.col("story"))).alias(x) for x in ("story", "roundup", "deal")]
    return rows.agg(
        F.countDistinct("a.feed").alias("feeds"), F.countDistinct(links.normalize_link(F.col("a.link"))).alias("article_count"), F.countDistinct("story").alias("story_count"), *kinds
    )
