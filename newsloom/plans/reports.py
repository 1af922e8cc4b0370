"""Further registered queries: the operators of monitoring, naming, labels and file names over the driver's tables.

Stand-ins as in the catalog; parts are phrases, users feeds and their events entries, a document's lines the titles of a story.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, links, terms, text, titles
from newsloom.functions import entities as entities_
from newsloom.operators import checks, ingest, metrics, naming, schema_rules
from newsloom.operators.tables import shared_dir
from newsloom.plans.catalog import _RARE, ORACLE, PAGES, QUERIES, STOP, cleaned_sql, entries, query, table
from newsloom.sources import archive, objects, versions
from newsloom.streaming.archive_stream import metrics_upsert

NOW = "2024-01-20 12:00:00"
FEEDS = """f AS (SELECT user_id AS url, count(*) FILTER (event_type <> 'error') AS n, CASE WHEN max(value) FILTER (event_type = 'error') > 300 THEN 500 ELSE 200 END AS status FROM events GROUP BY user_id)"""


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# ---- feeds


def _health(spark, d) -> DataFrame:
    """Users are feeds; the largest error value tells an HTTP error; events that aren't errors are entries."""
    e = events(spark, d)
    worst = F.max(F.when(F.col("event_type") == "error", F.col("value")))
    feeds = e.groupBy(F.col("user_id").cast("string").alias("url")).agg(F.when(worst > 300, 500).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("error"))
    good = e.where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("url"), F.to_date("ts").alias("day"))
    return checks.feed_health(feeds, good, F.lit(NOW).cast("date"))


@query(f"WITH {FEEDS} SELECT count(*) AS feeds, count(*) FILTER (status < 400 AND n > 0) AS ok, count(*) FILTER (NOT (status < 400 AND n > 0)) AS failing, sum(n)::BIGINT AS entries FROM f")
def health_summary(spark, d):
    return checks.health_counts(_health(spark, d))


@query(f"WITH {FEEDS} SELECT CAST(url AS VARCHAR) AS url, CASE WHEN status >= 400 THEN 'HTTP 500' ELSE 'no entries' END AS reason FROM f WHERE NOT (status < 400 AND n > 0)")
def failing_feeds(spark, d):
    return checks.failing(_health(spark, d))


@query(f"WITH {FEEDS} SELECT 'ok' AS violation, count(*) AS n FROM f WHERE (n > 0) <> (status < 400 AND n > 0)")
def health_violations(spark, d):
    """Records of a monitor that calls a feed well if it has entries, whatever its status."""
    told = _health(spark, d).withColumn("ok", F.col("entry_count") > 0)
    return checks.health_violations(told).groupBy("violation").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)
SELECT 'title' AS violation, count(*) AS n FROM p WHERE h NOT LIKE '%.com' UNION ALL SELECT 'link', count(*) FROM p WHERE h LIKE '%.net'
UNION ALL SELECT 'source', count(*) FROM p WHERE h LIKE '%.net' UNION ALL SELECT 'timestamp', count(*) FROM p WHERE h NOT LIKE '%.org'""")
def news_violations(spark, d):
    """Pages as articles of a broken document: titles of .com alone, no links or sources of .net, stamps of .org alone."""
    e, host = entries(spark, d), links.authority(F.col("link"))
    fact = e.select(
        F.col("pos").alias("top_id"), F.when(host.endswith(".com"), F.col("title")).otherwise("").alias("title"), F.when(~host.endswith(".net"), F.col("link")).alias("link"),
        F.when(host.endswith(".org"), F.lit("2024")).alias("timestamp"), F.when(~host.endswith(".net"), host).otherwise("").alias("source"),
    )
    return checks.news_violations(fact).groupBy("violation").agg(F.count("*").alias("n"))


TURN_SCHEMA = {
    "type": "object", "required": ["conv_id", "role", "text"], "additionalProperties": False,
    "properties": {
        "conv_id": {"type": "integer", "minimum": 0}, "turn": {"type": "integer", "maximum": 3}, "role": {"enum": ["user", "assistant"]},
        "text": {"type": "string", "minLength": 20, "maxLength": 400, "pattern": "^[A-Z]"}, "words": {"type": "array", "maxItems": 60, "items": {"type": "string", "maxLength": 14}},
    },
}


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS w FROM conversations),
i AS (SELECT conv_id, turn, w, unnest(generate_series(1, len(w))) AS k FROM c)
SELECT conv_id, turn, '$.turn' AS path, 'maximum' AS rule FROM c WHERE turn > 3
UNION ALL SELECT conv_id, turn, '$.role', 'enum' FROM c WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, turn, '$', 'required:role' FROM c WHERE role IS NULL
UNION ALL SELECT conv_id, turn, '$', 'required:text' FROM c WHERE text IS NULL UNION ALL SELECT conv_id, turn, '$.text', 'minLength' FROM c WHERE length(text) < 20
UNION ALL SELECT conv_id, turn, '$.text', 'maxLength' FROM c WHERE length(text) > 400 UNION ALL SELECT conv_id, turn, '$.text', 'pattern' FROM c WHERE NOT regexp_matches(text, '^[A-Z]')
UNION ALL SELECT conv_id, turn, '$.words', 'maxItems' FROM c WHERE len(w) > 60
UNION ALL SELECT conv_id, turn, '$.words[' || (k - 1) || ']', 'maxLength' FROM i WHERE length(w[k]) > 14""")
def schema_violations(spark, d):
    """A turn is a JSON document with its words as a list, judged by a schema document."""
    c = table(spark, d, "conversations")
    doc = F.to_json(F.struct("conv_id", "turn", "role", "text", F.split("text", " ").alias("words")))
    return schema_rules.schema_violations(c.select("conv_id", "turn", doc.alias("value")), TURN_SCHEMA)


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) NOT LIKE '%.com'")
def unmapped_feeds(spark, d):
    """A page's host is a feed; those of .com are in the outlets' table."""
    f = table(spark, d, "pages").select(links.authority(F.col("url")).alias("url"))
    return ingest.unmapped(f, f.where(F.col("url").endswith(".com")).distinct())


@query("SELECT item_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM benchmark")
def stored_objects(spark, d):
    """An item's text is an object, put by tasks and read back."""
    at = f"{shared_dir(spark)}/newsloom/objects-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark")
    objects.put_all(b.select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("target"), F.col("text").cast("binary").alias("body")), at)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    name = F.regexp_extract("path", r"/([^/]+)\.txt$", 1)
    return back.select(name.cast(b.schema["item_id"].dataType).alias("item_id"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))


@query(r"""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%dT%H') AS ts, count(*) AS articles, count(*) FILTER (event_type = 'error') AS old FROM events GROUP BY 1, 2)
SELECT date, ts, CASE WHEN old > 0 THEN old ELSE articles END AS articles FROM r""")
def versioned_runs(spark, d):
    """Hours are runs; a first batch has the number of errors of those with any, a second all events of all, and it comes twice: the state has each run once, as it came first."""
    at = f"{shared_dir(spark)}/newsloom/state-{uuid.uuid4().hex}"
    stamp = F.substring(dates.run_stamp(F.col("ts")), 1, 13)
    e = events(spark, d).select(F.substring(stamp, 1, 10).alias("date"), stamp.alias("ts"), "event_type")
    count = lambda x: x.groupBy("date", "ts").agg(F.count("*").alias("articles"))
    handle = metrics_upsert(at, "date string, ts string, articles bigint")
    for number, batch in ((0, count(e.where("event_type = 'error'"))), (1, count(e)), (1, count(e))):
        handle(batch, number)
    return versions.load(spark, at, "date string, ts string, articles bigint")


@query(f"WITH {PAGES} SELECT pos, CASE WHEN link = '' THEN 'unknown' ELSE link END AS source FROM p WHERE title <> '' AND link <> ''")
def required_entries(spark, d):
    e = entries(spark, d).where(ingest.has_required("title", "link"))
    return e.select("pos", ingest.source_of(F.lit(""), F.col("link")).alias("source"))


@query(r"""SELECT page_id, CASE WHEN h LIKE '%.com' THEN t WHEN h LIKE '%.net' THEN 'Feed (subtitle: ' || t || ')' WHEN h LIKE '%.org' THEN 'Feed (link: ' || url || ')' ELSE 'Feed (' || h || ')' END AS feed_title
FROM (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)""")
def feed_titles(spark, d):
    """A page is a feed: those of .com have a title, of .net a subtitle, of .org a link, all others a URL alone."""
    t, host = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), links.authority(F.col("url"))
    only = lambda end, c: F.when(host.endswith(end), c)
    p = table(spark, d, "pages")
    return p.select("page_id", ingest.feed_title(only(".com", t), only(".net", t), F.lit(None).cast("string"), only(".org", F.col("url")), F.col("url")).alias("feed_title"))


@query(r"""WITH x AS (SELECT DISTINCT split_part(array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '.'), -2, -1), '.'), '.', 1) AS l FROM pages)
SELECT upper(substr(l, 1, 1)) || lower(substr(l, 2)) AS outlet, count(*) AS n FROM x GROUP BY 1""")
def derived_outlets(spark, d):
    domain = links.feed_domain(F.col("url"))
    return table(spark, d, "pages").select(F.substring_index(domain, ".", 1).alias("l"), links.outlet_of_domain(domain).alias("outlet")).distinct().groupBy("outlet").agg(F.count("*").alias("n"))


# ---- archive files


@query(r"""SELECT event_id, event_type <> 'error' AS is_run, CASE WHEN event_type <> 'error' THEN '0.2.1' END AS version, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS stamp,
strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events""")
def file_names(spark, d):
    """An event is a file: an archived run, or for an error a state file."""
    stamp = dates.run_stamp(F.col("ts"))
    name = F.concat(F.when(F.col("event_type") == "error", "momentum_state_").otherwise("latest_news_0.2.1_"), stamp, F.lit(".json"))
    f = events(spark, d).select("event_id", name.alias("name"))
    a = dates.archive_name(F.col("name"))
    return f.select("event_id", a.isNotNull().alias("is_run"), a["version"].alias("version"), a["stamp"].alias("stamp"), dates.minute_of(F.col("name")).alias("minute"))


@query(r"""WITH m AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS minute, min('f' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS file FROM events GROUP BY 1),
l AS (SELECT DISTINCT substr(minute, 1, 10) AS date FROM m ORDER BY 1 DESC LIMIT 14)
SELECT minute, file, substr(minute, 1, 10) AS date FROM m WHERE substr(minute, 1, 10) IN (SELECT date FROM l)""")
def archive_window(spark, d):
    """An event is a run's file."""
    minute = F.substring(dates.run_stamp(F.col("ts")), 1, 16)
    f = events(spark, d).select(F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("file"), minute.alias("minute"), F.substring(minute, 1, 10).alias("date"))
    return metrics.archive_window(f).select("minute", "file", "date")


@query("SELECT DISTINCT p_brand || p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE (p_brand || p_name, p_size) NOT IN (SELECT p_brand || p_name, p_size FROM part WHERE p_type = 'ECONOMY')")
def mirror_list(spark, d):
    """Parts are files, those of one type already copied."""
    p = table(spark, d, "part").select(F.concat("p_brand", "p_name").alias("name"), F.col("p_size").cast("long").alias("size"), "p_type")
    return archive.to_mirror(p.drop("p_type").distinct(), p.where("p_type = 'ECONOMY'"))


@query(r"""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%dT%H') AS ts, count(*) AS articles, count(*) FILTER (event_type = 'error') AS old FROM events GROUP BY 1, 2)
SELECT date, ts, CASE WHEN old > 0 THEN old ELSE articles END AS articles FROM r""")
def upserted_runs(spark, d):
    """Hours are runs; those with errors are known already, by the number of their errors, and stay as they are."""
    stamp = F.substring(dates.run_stamp(F.col("ts")), 1, 13)
    e = events(spark, d).select(F.substring(stamp, 1, 10).alias("date"), stamp.alias("ts"), "event_type")
    count = lambda x: x.groupBy("date", "ts").agg(F.count("*").alias("articles"))
    return metrics.upserted(count(e.where("event_type = 'error'")), count(e))


@query(f"""SELECT event_id, CASE WHEN s > 7 * 3600 THEN 'stale' ELSE 'fresh' END AS status,
CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def run_ages(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return events(spark, d).select("event_id", checks.status(F.col("ts"), now).alias("status"), dates.relative_time(F.col("ts"), now).alias("age"))


# ---- figures


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_feeds(spark, d):
    return metrics.top_counts(table(spark, d, "customer"), "c_mktsegment", 3)


@query("SELECT round(avg(n), 6) AS avg_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def group_size_summary(spark, d):
    return metrics.group_sizes(table(spark, d, "customer"), "c_nationkey").select(F.round("avg_size", 6).alias("avg_size"), "max_size")


@query("SELECT 0.0::DOUBLE AS x_mean, 0.0::DOUBLE AS x_median, 0.0::DOUBLE AS x_min, 0.0::DOUBLE AS x_max, 0.0::DOUBLE AS x_stdev")
def statistics_of_nothing(spark, d):
    """No customer's balance is null."""
    return table(spark, d, "customer").where("c_acctbal is null").agg(*metrics.stats(F.col("c_acctbal"), "x"))


# ---- words, terms and labels


@query(r"""WITH t AS (SELECT term, count(*) AS freq FROM (SELECT trim(regexp_replace(lower(p_name), '[^A-Za-z0-9 ]+', '', 'g')) AS term FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT lower(string_split(p_name, ' ')[1]) FROM part) GROUP BY term),
h AS (SELECT DISTINCT term AS holder, unnest(string_split(term, ' ')) AS term FROM t WHERE contains(term, ' ')),
g AS (SELECT h.term, holder FROM h JOIN t ON t.term = h.term AND NOT contains(t.term, ' ')),
k AS (SELECT t.term, freq + (SELECT count(*) FROM g WHERE holder = t.term) AS freq FROM t WHERE term NOT IN (SELECT term FROM g))
SELECT '[' || term || ']' AS term, freq FROM k ORDER BY freq DESC, len(string_split(term, ' ')) DESC, term LIMIT 20""")
def term_report(spark, d):
    """A part's name, its first word and its type are terms."""
    p = table(spark, d, "part")
    each = F.array(text.clean_term(F.col("p_name")), text.clean_term(F.col("p_type")), text.clean_term(F.get(F.split("p_name", " "), 0)))
    return metrics.top_terms(p.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("freq")), 20)


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type || ' ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2), ' ')) AS word FROM part),
f AS (SELECT word, lower(word) AS w, length(word) AS n, length(word) - length(translate(lower(word), 'aeiou', '')) AS v FROM w WHERE length(word) > 1),
s AS (SELECT word, round(least((n + {_RARE}) / n / 6, 1.0) * 0.4 + 0.4 / (1 + v / CASE WHEN n - v > 0 THEN n - v ELSE 0.5 END) + 0.2 * least(ln(n) / ln(12.0), 1.0), 4) AS score FROM f)
SELECT word, round(score * CASE WHEN upper(word) = word THEN 2.5 WHEN regexp_matches(word, '^[A-Z]') THEN 2.0 ELSE 1.0 END, 4) AS score FROM s""")
def weighted_words(spark, d):
    """Words of the parts' names, as they are and with a first capital, and of their types, all in capitals."""
    name = F.col("p_name")
    every = F.concat_ws(" ", name, "p_type", F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000)))
    w = table(spark, d, "part").select(F.explode(F.split(every, " ")).alias("word")).distinct().where(F.length("word") > 1)
    return w.select("word", F.round(text.weighted_score(F.col("word")), 4).alias("score"))


@query(r"""SELECT DISTINCT label, CASE WHEN one THEN lower(p_name) ELSE replace(lower(p_name), ' ', ',') END AS keywords, CASE WHEN one THEN 1 ELSE len(string_split(p_name, ' ')) END AS phrases,
CASE WHEN one THEN len(string_split(p_name, ' ')) WHEN len(string_split(p_name, ' ')) = 1 THEN 1 ELSE 999 END AS words
FROM (SELECT p_name, p_type = 'ECONOMY' AS one, CASE WHEN p_type = 'ECONOMY' THEN '[' || p_name || ']' ELSE '[' || replace(p_name, ' ', '] [') || ']' END AS label FROM part)""")
def label_shapes(spark, d):
    """A part's name is a phrase, or of most types its words are."""
    phrases = F.when(F.col("p_type") == "ECONOMY", F.array("p_name")).otherwise(F.split("p_name", " "))
    p = table(spark, d, "part").select(titles.bracket_label(phrases).alias("label")).distinct()
    c = F.col("label")
    return p.select("label", F.array_join(titles.keywords(c), ",").alias("keywords"), titles.phrase_count(c).cast("long").alias("phrases"), titles.word_count(c).cast("long").alias("words"))


@query(r"""WITH w AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[A-Za-z0-9$%''’.\-]+') AS ws FROM pages),
s AS (SELECT page_id, ws, list_filter(ws, lambda x: length(x) > 3 AND regexp_matches(x, '^[A-Za-z]')) AS l FROM w)
SELECT page_id, len(ws) AS n_words, len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(len(l), 1) >= 0.7 AS title_case FROM s""")
def title_shapes(spark, d):
    ws = titles.words(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.size(ws).cast("long").alias("n_words"), titles.is_title_case(ws).alias("title_case"))


@query()
def headline_terms(spark, d):
    """Rules over words, without SQL; the tests hold them on sentences."""
    return metrics.top_terms(metrics.sentence_terms(entries(spark, d).select(F.col("title").alias("text")), terms.terms), 20)


@query(f"""WITH c AS (SELECT doc_id, string_split({cleaned_sql("text")}, ' ') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM c)),
n AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM w WHERE word <> '' AND word NOT IN {STOP} GROUP BY doc_id, word),
r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM n)
SELECT doc_id, string_agg(word, ',' ORDER BY k) AS keywords FROM r WHERE k <= 5 GROUP BY doc_id""")
def document_keywords(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("group"), F.lit(0).alias("pos"), text.content_tokens(F.col("text")).alias("words"))
    return metrics.group_keywords(t, 5).select(F.col("group").alias("doc_id"), F.array_join("keywords", ",").alias("keywords"))


@query()
def dictionary_entities(spark, d):
    """Entities of the pages' titles by a dictionary: the 300 most frequent pairs of words of the headlines, and the 100 most frequent words. Tested against brute force."""
    t = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    words = F.regexp_extract_all("title", F.lit(entities_.WORD), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))
    w = t.select(words.alias("w"))
    top = lambda c, n: w.where("size(w) > 1").select(F.explode(c).alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p").limit(n)
    phrases = [r.p for r in top(pairs, 300).unionByName(top(F.col("w"), 100)).collect()]
    found = entities_.dictionary_entities(spark, phrases)
    return t.select("page_id", F.array_join(found(F.col("title")), "|").alias("entities"))


# ---- names


def _articles(c: Column, outlet: Column) -> Column:
    return F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda t: F.struct(t.alias("title"), outlet.alias("outlet")))


@query(r"""WITH l AS (SELECT doc_id, source, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
r AS (SELECT doc_id, source, ls[i] AS t, row_number() OVER (PARTITION BY doc_id ORDER BY length(ls[i]) DESC, i) AS k FROM l)
SELECT doc_id, md5(string_agg(k || '. ' || t || ' (' || source || ')', chr(10) ORDER BY k)) AS prompt FROM r WHERE k <= 12 GROUP BY doc_id""")
def naming_prompts(spark, d):
    """A document is a story, its lines the titles, its source their outlet."""
    p = naming.prompt(naming.longest_titles(_articles(F.col("text"), F.col("source")), with_outlets=True))
    return table(spark, d, "documents").select("doc_id", F.md5(p).alias("prompt"))


_REFUSED = " OR ".join("contains(lower(l), '" + m.replace("'", "''") + "')" for m in naming.REFUSALS)


@query(rf"""WITH a AS (SELECT doc_id, regexp_extract(regexp_replace(text, '\A{naming.BLANK}+', ''), '\A[^\n\r\x0b\x0c\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]*') AS l FROM documents),
b AS (SELECT doc_id, regexp_replace(l, '{naming.BLANK}+\z', '') AS l FROM a), c AS (SELECT doc_id, regexp_replace(l, '\A["''“”‘’ ]+|["''“”‘’ ]+\z', '', 'g') AS l FROM b),
x AS (SELECT doc_id, regexp_replace(regexp_replace(l, '\.+\z', ''), '\A{naming.BLANK}+|{naming.BLANK}+\z', '', 'g') AS l FROM c)
SELECT doc_id, CASE WHEN l <> '' AND length(l) <= 140 AND NOT ({_REFUSED}) THEN l END AS headline FROM x""")
def clean_replies(spark, d):
    """A document's text is a namer's reply."""
    return table(spark, d, "documents").select("doc_id", naming.cleaned(F.col("text")).alias("headline"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) * 14 AS n FROM supplier GROUP BY 1)
SELECT c.k, s.n IS NULL OR c.n > s.n * 1.5 AS due FROM c LEFT JOIN s ON c.k = s.k""")
def names_due(spark, d):
    """A nation is a story of its customers, named when it had fourteen articles a supplier."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") * 14).alias("cached"))
    return c.join(s, "k", "left").select("k", naming.needs_name(F.col("cached"), F.col("cached"), F.col("n")).alias("due"))


__all__ = ["ORACLE", "QUERIES"]
