"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

Roles of the tables (documented stand-ins): a page is a feed entry (title element, url, host as its feed); a document
is a group whose links are its lines, with its source as outlet and its lang as section; events are a run log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, links, text, titles
from newsloom.operators import checks, ingest, labels, leader, metrics, momentum, similarity, stories
from newsloom.operators import grouping as G
from newsloom.operators.graph import components
from newsloom.operators.tables import shared_dir, written
from newsloom.plans import board

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-20"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages as feed entries."""
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return p.select(
        F.col("page_id").alias("pos"), title.alias("title"), F.col("url").alias("link"), F.lit("").alias("published"), F.lit(None).cast("date").alias("day"),
        F.concat(F.lit("https://"), links.authority(F.col("url"))).alias("title_detail_base"),
    )


PAGES = "p AS (SELECT page_id AS pos, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, url AS link FROM pages)"


def lines(spark: SparkSession, d: str, whole: bool = True) -> DataFrame:
    """(group, key, pos, source, lang): the documents' distinct lines that aren't empty; not whole: their SHA-256 stand for them, as every shuffle behind would carry the texts."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "key"))
    t = t.where(F.trim("key") != "")
    t = t if whole else t.withColumn("key", F.unhex(F.sha2("key", 256)))
    return t.groupBy(F.col("doc_id").alias("group"), "key", "source", "lang").agg(F.min("pos").alias("pos"))


LINES = "l AS (SELECT DISTINCT doc_id AS g, source, lang, key FROM (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS key FROM documents) WHERE trim(key) <> '')"
SETS = LINES + """,
m AS (SELECT DISTINCT g, key FROM l), size AS (SELECT g, count(*) AS n FROM m GROUP BY g),
pairs AS (SELECT a.g AS i, b.g AS j, count(*) AS common, count(*) / least(any_value(x.n), any_value(y.n)) AS containment
  FROM m a JOIN m b ON a.key = b.key AND a.g < b.g JOIN size x ON x.g = a.g JOIN size y ON y.g = b.g
  GROUP BY a.g, b.g HAVING count(*) >= 0.5 * least(any_value(x.n), any_value(y.n)))"""
COMPONENTS = SETS + """,
edge AS (SELECT i AS a, j AS b FROM pairs UNION SELECT j, i FROM pairs),
reach(a, b) AS (SELECT g, g FROM size UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
story AS (SELECT a AS g, min(b) AS story FROM reach GROUP BY a)"""

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(coalesce({c}, '')), '<i>', ''), '<\i>', ''),
  '[^\p{{L}}\p{{N}}_\-''\s\p{{Z}}.]', '', 'g'), '[\p{{Nd}}_*]', '', 'g'), '(^|[\s\p{{Z}}]+)-([\s\p{{Z}}]+|$)', '', 'g'), '\.+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"""
STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


def cleaned_sql(c: str) -> str:
    x = CLEAN.format(c=c)
    return f"(CASE WHEN length({x}) - length(replace({x}, '''', '')) > 1 THEN replace({x}, '''', '') ELSE {x} END)"


# ---- text


@query(f"""
WITH c AS (SELECT doc_id, {cleaned_sql('text')} AS x FROM documents)
SELECT doc_id, md5(x) AS cleaned, len(list_filter(string_split(x, ' '), lambda w: w NOT IN {STOP})) AS n_tokens FROM c""")
def clean_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("x"))
    n = F.size(text.without_stop_words(text.tokens(F.col("x"))))
    return docs.select("doc_id", F.md5("x").alias("cleaned"), n.cast("long").alias("n_tokens"))


@query(f"""
WITH c AS (SELECT doc_id, list_filter(string_split({cleaned_sql('text')}, ' '), lambda w: w NOT IN {STOP}) AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM c))
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY count(*) DESC, min((doc_id, i)) LIMIT 25""")
def top_words(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), text.content_tokens(F.col("text")).alias("words"))
    return metrics.top_words(docs, 25)


_INFO = {}
for _letter, _v in text.RARITY.items():
    _INFO.setdefault(_v, []).append(_letter)
_RARE = " + ".join(f"(length(w) - length(translate(w, '{''.join(x)}', ''))) * {v - 1}" for v, x in _INFO.items() if v > 1)


@query(f"""
WITH w AS (SELECT DISTINCT regexp_replace(lower(x), '^[.,!?;:()"'']+|[.,!?;:()"'']+$', '', 'g') AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part)),
f AS (SELECT w, length(w) AS n, length(w) - length(translate(w, 'aeiou', '')) AS v, length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) AS letters, {_RARE} AS rare FROM w WHERE length(w) > 1)
SELECT w AS word, round(least((n + rare) / n / 6, 1.0) * 0.4 + 0.4 / (1 + v / CASE WHEN letters - v > 0 THEN letters - v ELSE 0.5 END) + 0.2 * least(ln(n) / ln(12.0), 1.0), 6) AS score FROM f""")
def info_score(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.where(F.length("w") > 1).select(F.lower("w").alias("word"), F.round(text.info_value(F.col("w")), 6).alias("score")).distinct()


@query()
def sentence_scores(spark, d):
    return entries(spark, d).select("pos", F.round(text.sentence_score(F.col("title")), 4).alias("score"))


@query(r"""
SELECT url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS link,
       array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '.'), -2, -1), '.') AS domain
FROM pages""")
def normalized_links(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("url", links.normalize_link(u).alias("link"), links.feed_domain(u).alias("domain"))


@query(r"""
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS published, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d') AS day FROM orders""")
def mail_dates(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" EST"))
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.to_iso8601(F.col("raw")).alias("published"), dates.iso_date(F.col("raw")).alias("day"))


# ---- ingest


@query(f"WITH {PAGES} SELECT title, min(pos) AS pos, arg_max(link, pos) AS link FROM p WHERE title <> '' GROUP BY title")
def feed_dedup(spark, d):
    return ingest.one_per_title(entries(spark, d).where(ingest.has_required("title", "link")).select("title", "pos", "link"))


@query(f"""
SELECT event_type, count(*) AS n FROM events
WHERE coalesce(date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') < 14, true) GROUP BY event_type""")
def recency_filter(spark, d):
    e = table(spark, d, "events").where(ingest.is_recent(F.to_date("ts"), F.lit(AS_OF).cast("date")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query(r"""
SELECT s_suppkey, coalesce(n_name, 'General') AS outlet, coalesce(r_name, 'General') AS section
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def source_lookup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = n.select(F.col("n_nationkey").cast("string").alias("url"), F.col("n_name").alias("outlet"), F.col("r_name").alias("domain"), F.col("r_name").alias("section"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("feed"))
    return ingest.resolved(s, dim, F.lit("General"), F.lit("General")).select("s_suppkey", "outlet", "section")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unknown_orders(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.unknown_only(table(spark, d, "orders").select("o_orderkey"), known, "o_orderkey")


# ---- similarity and groups

TITLES = PAGES + f""",
u AS (SELECT min(pos) AS pos, title FROM p WHERE title <> '' GROUP BY title),
tok AS (SELECT pos, unnest(regexp_extract_all(lower(array_to_string(list_filter(string_split({cleaned_sql('title')}, ' '), lambda w: w NOT IN {STOP}), ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM u),
tf AS (SELECT pos, term, count(*) AS tf FROM tok GROUP BY pos, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT pos, tf.term, df, tf * (ln((1.0 + (SELECT count(*) FROM u)) / (1 + df)) + 1) AS r FROM tf JOIN df ON tf.term = df.term),
w AS (SELECT pos, term, df, r / sqrt(sum(r * r) OVER (PARTITION BY pos)) AS w FROM raw)"""


def headlines(spark, d) -> DataFrame:
    return ingest.one_per_title(entries(spark, d).where("title <> ''").select("title", "pos", "link")).select("pos", "title")


def headline_weights(spark, d) -> DataFrame:
    t = headlines(spark, d).select(F.col("pos").alias("id"), F.array_join(text.content_tokens(F.col("title")), " ").alias("text"))
    return written(similarity.tfidf(t), "weights")


@query(f"WITH {TITLES} SELECT pos AS id, term, round(w, 9) AS weight FROM w")
def tfidf_weights(spark, d):
    return headline_weights(spark, d).select("id", "term", F.round("w", 9).alias("weight"))


@query(f"WITH {TITLES} SELECT a.pos AS i, b.pos AS j, round(sum(a.w * b.w), 9) AS sim FROM w a JOIN w b ON a.term = b.term AND a.pos < b.pos GROUP BY a.pos, b.pos HAVING round(sum(a.w * b.w), 12) >= 0.25")
def similar_pairs(spark, d):
    return similarity.cosine_pairs(headline_weights(spark, d), G.SIMILAR).select("i", "j", F.round("sim", 9).alias("sim"))


@query()
def title_groups(spark, d):
    return G.title_groups(headlines(spark, d))


@query()
def news_groups(spark, d):
    e = entries(spark, d).where("title <> ''")
    e = ingest.one_per_title(e.withColumn("source", ingest.source_of(F.col("title_detail_base"), F.col("link"))).drop("day"))
    return G.groups_fact(e.select("pos", "title", "link", "published", "source"))


@query()
def ranked_groups(spark, d):
    r = G.ranked_groups(written(news_groups(spark, d), "fact"))
    return r.select("cluster", "top_id", "n_sub", "n_articles")


@query(f"WITH {SETS} SELECT i, j, common, round(containment, 9) AS containment FROM pairs")
def containment_pairs(spark, d):
    m = lines(spark, d, False).select(F.col("group").alias("id"), F.col("key").alias("item"))
    return similarity.containment_pairs(m, 0.5).select("i", "j", "common", F.round("containment", 9).alias("containment"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT g, story FROM story")
def story_components(spark, d):
    m = written(lines(spark, d, False).select("group", "key").distinct(), "lines")
    return stories.merged(m).select(F.col("group").alias("g"), "story")


@query(f"""
WITH RECURSIVE {COMPONENTS},
a AS (SELECT story, key, min((l.g, source, lang)) AS a FROM l JOIN story USING (g) GROUP BY story, key),
art AS (SELECT story, key, a[1] AS met, a[2] AS source, a[3] AS lang FROM (SELECT story, key, [CAST(a[1] AS VARCHAR), a[2], a[3]] AS a, a[1] AS g FROM a)),
o AS (SELECT story, source, count(*) AS n, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, source) AS k FROM art GROUP BY story, source),
s AS (SELECT story, lang, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, lang) AS k FROM art GROUP BY story, lang),
c AS (SELECT story, count(*) AS article_count, count(DISTINCT source) AS outlet_count FROM art GROUP BY story),
f AS (SELECT story, count(*) AS merged_from_groups FROM story GROUP BY story)
SELECT c.story, article_count, outlet_count, merged_from_groups, o.source AS outlet, o.n AS outlet_articles, s.lang AS section,
       row_number() OVER (ORDER BY outlet_count DESC, article_count DESC, c.story) AS rank
FROM c JOIN o ON o.story = c.story AND o.k = 1 JOIN s ON s.story = c.story AND s.k = 1 JOIN f ON f.story = c.story WHERE outlet_count > 1""")
def story_board(spark, d):
    """Which outlets and sections carry which multi-outlet stories, ranked."""
    m = written(lines(spark, d, False), "lines")
    story = written(stories.merged(m.select("group", "key").distinct()), "story")
    art = m.join(story, "group").groupBy("story", "key").agg(F.min(F.struct("group", "source", "lang")).alias("a")).select("story", "key", "a.source", "a.lang")
    top = stories.modal(art, ["story"], "source", "source").where("place = 1").select("story", F.col("source").alias("outlet"), F.col("n").alias("outlet_articles"))
    sec = stories.modal(art, ["story"], "lang", "lang").where("place = 1").select("story", F.col("lang").alias("section"))
    c = art.groupBy("story").agg(F.count("*").alias("article_count"), F.countDistinct("source").alias("outlet_count")).where("outlet_count > 1")
    f = story.groupBy("story").agg(F.count("*").alias("merged_from_groups"))
    out = c.join(top, "story").join(sec, "story").join(f, "story")
    rank = F.row_number().over(Window.orderBy(F.col("outlet_count").desc(), F.col("article_count").desc(), "story"))
    return out.select("story", "article_count", "outlet_count", "merged_from_groups", "outlet", "outlet_articles", "section", rank.cast("long").alias("rank"))


@query(r"""
WITH c AS (SELECT n_name AS story, c_mktsegment AS outlet, count(*) AS n, min(c_custkey) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT story, outlet, n FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def modal_outlet(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return stories.modal(c.select(F.col("n_name").alias("story"), F.col("c_mktsegment").alias("outlet"), "c_custkey"), ["story"], "outlet", "c_custkey").where("place = 1").select("story", "outlet", "n")


@query("""WITH o AS (SELECT p_brand AS story, p_type AS outlet, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS k FROM part GROUP BY 1, 2)
SELECT story, arg_max(p_name, (length(p_name), -p_partkey)) AS headline FROM part JOIN o ON story = p_brand AND outlet = p_type AND k = 1 GROUP BY story""")
def fallback_headline(spark, d):
    """A brand is a story, its types are outlets."""
    art = table(spark, d, "part").select(F.col("p_brand").alias("story"), F.col("p_type").alias("outlet"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    return stories.fallback_headlines(art, stories.modal(art, ["story"], "outlet", "ord").where("place = 1").select("story", "outlet"))


@query(r"""
SELECT l_orderkey AS o, 'st_' || substr(sha256(array_to_string(list_slice(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), 1, 20), ',')), 1, 6) AS id
FROM lineitem GROUP BY l_orderkey""")
def story_ids(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(stories.story_id(F.collect_set(F.col("l_partkey").cast("string"))).alias("id"))


@query(rf"""
WITH {LINES}, t AS (SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(key, '(?i)(\$\s?\d[\d,]*(\.\d+)?\s*off|\d+\s?%\s*off|\bpre-?order\b|\bdeals?\b|\bdiscount\b|\bcoupon\b)')) AS deals FROM l GROUP BY source)
SELECT source, n, deals, CASE WHEN deals / n > 0.5 THEN 'deal' ELSE 'story' END AS kind FROM t""")
def classify_kind(spark, d):
    t = lines(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(titles.is_deal(F.col("key"))).alias("deals"))
    return t.select("source", "n", "deals", stories.kind_of(F.col("deals") / F.col("n"), F.lit(2), F.lit(0)).alias("kind"))


@query()
def template_run(spark, d):
    e = entries(spark, d).where("title <> ''")
    host = links.feed_domain(F.col("link"))
    return stories.template_runs(e.select(host.alias("story"), F.col("pos").alias("ord"), "title"))


@query()
def group_labels(spark, d):
    h = written(headlines(spark, d), "headlines")
    g = written(G.title_groups(h), "groups")
    return labels.labels(g.join(h, "pos").select(F.col("leader").alias("group"), "pos", "title"))


# ---- identity and momentum

YESTERDAY = "source < 'src2'"


def _identity(spark, d) -> tuple[DataFrame, DataFrame]:
    """Today's and yesterday's (id, item)."""
    m = written(lines(spark, d, False).select(F.col("group").alias("id"), F.col("key").alias("item"), "source"), "lines")
    return m.where(f"not ({YESTERDAY})"), m.where(YESTERDAY)


@query(f"""
WITH {LINES}, a AS (SELECT DISTINCT g, key FROM l WHERE NOT ({YESTERDAY})), b AS (SELECT DISTINCT g, key FROM l WHERE {YESTERDAY}),
na AS (SELECT g, count(*) AS n FROM a GROUP BY g), nb AS (SELECT g, count(*) AS n FROM b GROUP BY g),
x AS (SELECT a.g AS i, b.g AS j, count(*) AS common FROM a JOIN b USING (key) GROUP BY 1, 2)
SELECT i, j, common, round(common / (na.n + nb.n - common), 9) AS score FROM x JOIN na ON na.g = i JOIN nb ON nb.g = j WHERE common >= 0.4 * (na.n + nb.n - common)""")
def identity_pairs(spark, d):
    """Documents of the sources that sort first are yesterday's stories, the others today's."""
    return similarity.jaccard_pairs(*_identity(spark, d), momentum.MATCH).select("i", "j", "common", F.round("score", 9).alias("score"))


@query()
def identity_match(spark, d):
    return leader.matching_profiles(*similarity.jaccard_profiles(*_identity(spark, d), momentum.MATCH)).select("i", "j", F.round("score", 9).alias("score"))


DAYS = "d AS (SELECT event_type AS id, CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS outlets, count(*) AS articles FROM events GROUP BY 1, 2)"


def daily_points(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("id"), F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("outlets"), F.count("*").alias("articles"))


@query(f"""
WITH {DAYS}, w AS (SELECT *, lag(outlets) OVER o AS prev, lag(date) OVER o AS prev_date, count(*) OVER f AS n, avg(outlets) OVER f AS window_mean, max((outlets, -epoch(date))) OVER f AS peak
  FROM d WINDOW o AS (PARTITION BY id ORDER BY date), f AS (PARTITION BY id ORDER BY date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CAST(to_timestamp(-peak[2]) AS DATE) AS peak_date FROM w)
SELECT id, date, outlets, articles, round(window_mean, 9) AS window_mean, peak_date, CASE WHEN n = 1 THEN 'new' WHEN outlets > prev AND outlets >= window_mean THEN 'climbing'
  WHEN peak_date = prev_date AND outlets < prev THEN 'peaked' WHEN outlets < prev AND outlets < window_mean THEN 'cooling' ELSE 'steady' END AS trend FROM p""")
def daily_trend(spark, d):
    return momentum.daily_trend(daily_points(spark, d)).withColumn("window_mean", F.round("window_mean", 9))


@query(f"""
WITH {DAYS}, s AS (SELECT id, max(date) AS last FROM d GROUP BY id)
SELECT d.id, count(*) AS days_running, arg_min(date, (-outlets, date)) AS peak_date FROM d JOIN s ON d.id = s.id WHERE date > last - INTERVAL 14 DAY GROUP BY d.id""")
def peak_days(spark, d):
    p = written(daily_points(spark, d), "points")
    last = p.groupBy("id").agg(F.max("date").alias("last"))
    s = p.join(last, "id").where(F.datediff("last", "date") < momentum.WINDOW_DAYS)
    s = s.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("date", "outlets", "articles"))).alias("series"))  # WINDOW_DAYS points at most
    return s.select("id", F.size("series").cast("long").alias("days_running"), momentum.peak_date(F.col("series")).alias("peak_date"))


# ---- monitoring


def run_log(spark, d) -> DataFrame:
    """Events as a log of hourly runs."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    r = e.groupBy("hour").agg(F.count("*").alias("articles"), F.countDistinct("event_type").alias("groups"), F.countDistinct("user_id").alias("sub_groups"), F.countDistinct("props").alias("sources"))
    return r.select(F.to_date("hour").alias("date"), F.col("hour").alias("ts"), "articles", "groups", "sub_groups", "sources", (F.col("sub_groups") / F.col("groups")).alias("ratio"), F.col("groups").alias("top_groups"), (F.col("articles") / F.col("groups")).alias("group_size"))


RUNS = "r AS (SELECT CAST(date_trunc('hour', ts) AS DATE) AS date, date_trunc('hour', ts) AS ts, count(*) AS articles, count(DISTINCT event_type) AS groups, count(DISTINCT user_id) AS sub_groups, count(DISTINCT props) AS sources, count(DISTINCT user_id) / count(DISTINCT event_type) AS ratio, count(DISTINCT event_type) AS top_groups, count(*) / count(DISTINCT event_type) AS group_size FROM events GROUP BY date_trunc('hour', ts))"


def _stats_sql(m: str, c: str) -> str:
    each = {"mean": f"avg({c})", "median": f"median({c})", "min": f"CAST(min({c}) AS DOUBLE)", "max": f"CAST(max({c}) AS DOUBLE)", "stdev": f"stddev_samp({c})"}
    return ", ".join(f"round_even(round(coalesce({v}, 0), 9), 2) AS {m}_{k}" for k, v in each.items())


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"WITH {RUNS} SELECT date, count(*) AS update_count, string_agg(strftime(ts, '%H:%M'), ',' ORDER BY ts) AS stamps, " + ", ".join(f"round(sum({m}), 6) AS {m}_total" if m in ("ratio", "group_size") else f"sum({m})::BIGINT AS {m}_total" for m in metrics.METRICS) + ", " + ", ".join(_stats_sql(m, m) for m in metrics.METRICS) + " FROM r GROUP BY date")
def daily_stats(spark, d):
    day = metrics.daily(run_log(spark, d))
    return _rounded(day.withColumn("stamps", F.array_join(F.transform("stamps", lambda t: F.date_format(t, "HH:mm")), ",")))


MEANS = "m AS (SELECT date, count(*) AS u, " + ", ".join(f"round_even(round(avg({m}), 9), 2) AS {m}" for m in metrics.METRICS) + " FROM r GROUP BY date)"


@query(f"WITH {RUNS}, {MEANS} SELECT count(*) AS days, sum(u)::BIGINT AS updates, " + ", ".join(_stats_sql(m, f"nullif({m}, 0)" if m in ("sources", "ratio") else m) for m in metrics.METRICS) + " FROM m")
def overall_stats(spark, d):
    return metrics.overall(metrics.daily(run_log(spark, d)))


@query(f"""
WITH {RUNS}, {MEANS}, t AS (SELECT * FROM m ORDER BY date DESC LIMIT 7), u AS (UNPIVOT t ON {", ".join(metrics.METRICS)} INTO NAME metric VALUE value),
x AS (SELECT metric, arg_min(value, date) AS first, arg_max(value, date) AS last FROM u GROUP BY metric), y AS (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (last - first) / first * 100 END AS c FROM x)
SELECT metric, first, last, round_even(round(c, 9), 2) AS change_percent, CASE WHEN abs(c) < 1 THEN 'stable' WHEN c > 0 THEN 'up' ELSE 'down' END AS direction FROM y""")
def window_trends(spark, d):
    return metrics.trends(metrics.daily(run_log(spark, d)), 7)


@query(f"WITH {RUNS} SELECT date, sum(articles)::BIGINT AS articles, sum(groups)::BIGINT AS groups, sum(greatest(articles - groups - sub_groups, 0))::BIGINT AS independent FROM r GROUP BY date ORDER BY date DESC LIMIT 30")
def plot_series(spark, d):
    return metrics.plot_series(run_log(spark, d), 30)


@query(r"""
WITH s AS (SELECT r_name AS file, n_nationkey AS top, c_mktsegment AS sub, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
t AS (SELECT file, top, sum(n)::BIGINT AS n, count(*) AS subs FROM s GROUP BY 1, 2), z AS (SELECT file, n FROM s UNION ALL SELECT file, n FROM t),
q AS (SELECT file, round_even(round(avg(n), 9), 2) AS size_mean, round_even(median(n), 2) AS size_median, round_even(round(stddev_samp(n), 9), 2) AS size_stdev FROM z GROUP BY file),
l AS (SELECT file, string_agg(n, ',' ORDER BY top) AS top_sizes FROM t GROUP BY file), k AS (SELECT file, string_agg(n, ',' ORDER BY top, sub) AS sub_sizes FROM s GROUP BY file),
w AS (SELECT file, sum(n)::BIGINT AS total_articles, count(*) AS total_groups, sum(subs)::BIGINT AS sub_groups, count(*) AS unique_sources, round_even(round(sum(subs) / count(*), 9), 2) AS ratio FROM t GROUP BY file)
SELECT * FROM w JOIN q USING (file) JOIN l USING (file) JOIN k USING (file)""")
def file_metrics(spark, d):
    """A region is a file of nations (its groups and sources), segments (sub-groups) and customers (articles)."""
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("r_name").alias("file"), F.lit("2024-01-01").alias("ts"), F.col("n_nationkey").alias("top_at"), F.col("c_mktsegment").alias("sub_at"), F.col("n_name").alias("source"), F.lit(True).alias("is_entry"))
    m = metrics.entry_metrics(rows)
    size = lambda k: F.col(f"articles_per_group_{k}").alias(f"size_{k}")
    return m.select(
        "file", "total_articles", "total_groups", "sub_groups", "unique_sources", F.col("subgroups_per_top_group").alias("ratio"), size("mean"), size("median"), size("stdev"),
        F.array_join("top_level_group_sizes", ",").alias("top_sizes"), F.array_join("sub_group_sizes", ",").alias("sub_sizes"),
    )


@query(f"""
WITH f AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e, count(*) FILTER (event_type <> 'error') AS n, min(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')) FILTER (event_type <> 'error') AS age FROM events GROUP BY user_id)
SELECT user_id AS url, n AS entry_count, age AS newest_entry_age_days, n > 0 AS ok FROM f""")
def feed_health(spark, d):
    """Users are feeds, their events that aren't errors the entries."""
    e = table(spark, d, "events")
    feeds = e.select(F.col("user_id").alias("url")).distinct().withColumn("http_status", F.lit(200))
    good = e.where("event_type <> 'error'").select(F.col("user_id").alias("url"), F.to_date("ts").alias("day"))
    return checks.feed_health(feeds, good, F.lit("2024-01-31").cast("date")).select("url", "entry_count", F.col("newest_entry_age_days").cast("long").alias("newest_entry_age_days"), "ok")


@query(r"""
WITH n AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS stories FROM events GROUP BY 1),
p AS (SELECT *, lag(stories) OVER (ORDER BY day) AS before FROM n)
SELECT day, n, stories, n >= 50 AND (coalesce(before, 0) = 0 OR abs(stories - before) / before <= 0.6) AS ok FROM p""")
def publish_gate(spark, d):
    """A day is a run, its events the articles, its users the stories; the window is over one row a day."""
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("event_id").alias("n"), F.countDistinct("user_id").alias("stories"))
    order = Window.orderBy("day")
    e = e.withColumn("n0", F.lag("n").over(order)).withColumn("s0", F.lag("stories").over(order))
    return e.select("day", "n", "stories", checks.gate(F.col("n"), F.col("stories"), F.col("n0"), F.col("s0"), checks.FLOOR, checks.DEVIATION)["ok"].alias("ok"))


# ---- readers' queries


def _cards(spark, d) -> DataFrame:
    """Nations as stories: segments are outlets, customers articles, the region the section."""
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    seg = c.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count("*").alias("n"))
    s = seg.groupBy(F.col("n_name").alias("id"), F.col("r_name").alias("section")).agg(
        F.count("*").alias("outlet_count"), F.sum("n").alias("article_count"), F.collect_list(F.struct(F.col("c_mktsegment").alias("outlet"), F.col("n").alias("articles"))).alias("outlets")
    )
    none = F.array().cast("array<struct<title:string>>")
    return s.select("*", F.col("id").alias("headline"), F.array(F.lower("section")).alias("keywords"), F.lit("story").alias("kind"), F.lit("").alias("latest_published"), none.alias("articles"))


CARDS = "s AS (SELECT n_name AS id, r_name AS section, count(DISTINCT c_mktsegment) AS outlet_count, count(*) AS article_count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"


@query(f"WITH {CARDS} SELECT id, section, article_count FROM s WHERE contains(lower(id), '_1') OR contains(lower(section), '_1')")
def board_search(spark, d):
    return board.search(board.board(_cards(spark, d)), "_1").select("id", "section", "article_count")


@query(f"WITH {CARDS} SELECT section, count(*) AS n FROM s GROUP BY ROLLUP (section)")
def facet_counts(spark, d):
    return board.facet_counts(_cards(spark, d))


@query(f"""
WITH {CARDS} SELECT * FROM (SELECT 'rank' AS how, id FROM s ORDER BY outlet_count DESC, article_count DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'covered' AS how, id FROM s ORDER BY outlet_count DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'newest' AS how, id FROM s ORDER BY id LIMIT 10)""")
def sort_modes(spark, d):
    """The first page (ten) of each order."""
    c = written(_cards(spark, d), "cards")
    pages = [board.ordered(c, how).select(F.lit(how).alias("how"), "id").limit(10) for how in ("rank", "covered", "newest")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("WITH o AS (SELECT n_name AS id, c_mktsegment AS outlet, count(*) AS articles FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT id, outlet, articles, round(articles / sum(articles) OVER (PARTITION BY id), 9) AS share FROM o")
def outlet_share(spark, d):
    return board.outlet_share(_cards(spark, d)).withColumn("share", F.round("share", 9))


@query(f"WITH {CARDS} SELECT id, section, article_count FROM s WHERE section = (SELECT min(r_name) FROM region)")
def by_section(spark, d):
    """The cards of the section that comes first by name."""
    first = table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return board.by_section(_cards(spark, d), first).select("id", "section", "article_count")


# ---- the batch run on pages, in two runs of which the second carries the first's identities


def _stories(spark, d) -> DataFrame:
    """The stories of the pages' groups; hosts are feeds without an entry in the dimension."""
    from newsloom.plans.engine import story_fact

    none = spark.createDataFrame([], "url string, outlet string, domain string, section string")
    return written(stories.stories(story_fact(written(news_groups(spark, d), "fact")), none), "stories")


@query()
def stories_run(spark, d):
    return _stories(spark, d).select("id", "headline", "section", "kind", "outlet_count", "article_count", "first_seen", "days_running", "merged_from_groups")


@query()
def stories_header(spark, d):
    return stories.document_header(_stories(spark, d))


@query()
def momentum_run(spark, d):
    s = _stories(spark, d)
    _, state = momentum.advanced(s, spark.createDataFrame([], momentum.STATE), "2024-01-19")
    s, state = momentum.advanced(s, state, AS_OF)
    m = momentum.momentum(state, s)
    return m.select("id", "first_seen", "days_running", "peak_date", "trend")


@query()
def named_run(spark, d):
    from newsloom.operators import naming

    s, _ = naming.named(_stories(spark, d), spark.createDataFrame([], naming.CACHE), AS_OF)
    return naming.outcomes(s)


# ---- streams


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) - INTERVAL 14 DAY FROM events) GROUP BY 1, 2")
def stream_daily(spark, d):
    """Events as a stream, run to the end of what is there: the days that the watermark has closed."""
    import uuid

    from newsloom.streaming.archive_stream import daily_counts, event_stream, run_available

    at = f"{shared_dir(spark)}/newsloom/stream-{uuid.uuid4().hex}"
    e = event_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
    run_available(daily_counts(e.withColumn("ts", F.col("ts").cast("timestamp"))), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("day date, event_type string, n long, value double").parquet(f"{at}/out").select("day", "event_type", "n")


__all__ = ["ORACLE", "QUERIES", "components"]
