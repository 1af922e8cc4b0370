"""Titles to groups, clusters of groups and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import STOP_WORDS, content_tokens
from newsloom.functions.titles import entity_tokens, label_order
from newsloom.operators.labels import labels
from newsloom.operators.leader import leaders
from newsloom.operators.similarity import cosine_pairs, tfidf
from newsloom.operators.tables import written

SIMILAR, CONTEXT = 0.25, 0.2


def title_groups(titles: DataFrame, threshold: float = SIMILAR, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """titles (pos, title): (pos, leader), groups of two titles or more."""
    docs = titles.select(F.col("pos").alias("id"), F.array_join(content_tokens(F.col("title"), stop=stop), " ").alias("text"))
    pairs = cosine_pairs(written(tfidf(docs), "weights"), threshold)
    return leaders(docs.select("id"), pairs, keep_single=False).select(F.col("id").alias("pos"), "leader")


def group_clusters(titles: DataFrame, groups: DataFrame, threshold: float = CONTEXT, stop: tuple[str, ...] = STOP_WORDS, entities=entity_tokens) -> DataFrame:
    """Groups (pos, leader) to (leader, cluster): similar texts whose entity sets share one or of which one is empty."""
    g = groups.join(titles, "pos")
    # a group's text in rows, a title each: it is never gathered
    docs = g.select(F.col("leader").alias("id"), F.array_join(content_tokens(F.col("title"), stop=stop), " ").alias("text"))
    ents = g.groupBy("leader").agg(F.array_distinct(F.flatten(F.collect_set(entities(F.col("title"))))).alias("e"))
    pairs = cosine_pairs(written(tfidf(docs), "weights"), threshold)
    a, b = ents.select(F.col("leader").alias("i"), F.col("e").alias("ei")), ents.select(F.col("leader").alias("j"), F.col("e").alias("ej"))
    ok = (F.size("ei") == 0) | (F.size("ej") == 0) | F.arrays_overlap("ei", "ej")
    pairs = pairs.join(a, "i").join(b, "j").where(ok).select("i", "j")
    return leaders(docs.select("id").distinct(), pairs, keep_single=True).select(F.col("id").alias("leader"), F.col("leader").alias("cluster"))


def groups_fact(entries: DataFrame, compat_overwrite: bool = False) -> DataFrame:
    """entries (pos, title, link, published, source): rows (cluster, top_id, leader, sub_id, pos, title, link, timestamp, source).

    compat_overwrite: of clusters (or groups of a cluster) with the same label only the last stays.
    """
    titles = entries.where("title is not null and title <> ''").select("pos", "title")
    groups = written(title_groups(titles), "groups")
    clusters = written(group_clusters(titles, groups), "clusters")
    member = groups.join(clusters, "leader").join(entries, "pos")
    sub = labels(member.select(F.col("leader").alias("group"), "pos", "title")).select(F.col("group").alias("leader"), F.col("label").alias("sub_id"))
    top = labels(member.select(F.col("cluster").alias("group"), "pos", "title")).select(F.col("group").alias("cluster"), F.col("label").alias("top_id"))
    fact = member.join(sub, "leader").join(top, "cluster")
    fact = fact.select("cluster", "top_id", "leader", "sub_id", "pos", "title", "link", F.col("published").alias("timestamp"), "source")
    if compat_overwrite:
        fact = written(fact, "fact")
        last = fact.groupBy("top_id").agg(F.max("cluster").alias("cluster"))
        fact = fact.join(last, ["top_id", "cluster"], "left_semi")
        last = fact.groupBy("cluster", "sub_id").agg(F.max("leader").alias("leader"))
        fact = fact.join(last, ["cluster", "sub_id", "leader"], "left_semi")
    return fact


def ranked_groups(fact: DataFrame) -> DataFrame:
    """(cluster, top_id, n_sub, n_articles) in the order of the front page."""
    g = fact.groupBy("cluster", "top_id").agg(F.countDistinct("sub_id", "leader").alias("n_sub"), F.count("*").alias("n_articles"))
    return g.orderBy(*label_order(F.col("top_id"), F.col("n_sub"), F.col("n_articles")), "cluster")
