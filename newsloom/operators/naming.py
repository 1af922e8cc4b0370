"""Headlines for stories: cached names, a budget, pluggable namers, clean-up."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.retry import or_none, retried
from newsloom.functions.terms import noun_chunks
from newsloom.functions.titles import capital_runs
from newsloom.operators.tables import written

BUDGET, MAX_TITLES, MAX_CHARS, GROWTH, RETENTION_DAYS, MAX_TOKENS = 60, 12, 140, 1.5, 30, 60
TASK = f"These titles are of one news story. Answer with a neutral headline of it in one line of at most {MAX_CHARS} characters, and nothing else."
#: (fixed values) what a reply that talks about its task holds, in lower case.
REFUSALS = (
    "these headlines", "the headlines", "headlines provided", "i cannot", "cannot be combined", "unable to determine", "unrelated to a single", "single news story name", "as an ai",
    "articles cover", "articles covered", "without a common", "no single event", "no common event", "different topics", "various topics", "multiple topics",
    "unrelated items", "unrelated stories", "unrelated events",
)
#: White space, and what ends a line, as the replies' language has them.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ON_A_LINE = r"[^\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*"
CACHE = "id string, headline string, headline_source string, article_count bigint, named_at string"
NAMERS: dict[str, Callable[[Column], Column]] = {}


def namer(name: str):
    """Registers a namer: array of titles (longest first) to a headline, null if it has none."""

    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        NAMERS[name] = f
        return f

    return add


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


@namer("local")
def local_name(titles: Column) -> Column:
    """Two most frequent entities (ties to the first met) and up to two longest noun phrases that share no word with them or each other; null without entities."""
    ents = F.flatten(F.transform(titles, capital_runs))
    each = F.transform(F.array_distinct(ents), lambda e: F.struct((-F.size(F.filter(ents, lambda x: x == e))).alias("n"), F.array_position(ents, e).alias("at"), e.alias("e")))
    top = F.transform(F.slice(F.array_sort(each), 1, 2), lambda x: x["e"])
    words = lambda phrases: F.flatten(F.transform(phrases, lambda p: F.split(F.lower(p), r"[^\p{L}\p{N}]+")))
    apart = lambda phrases, c: ~F.arrays_overlap(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), words(phrases))
    chunks = F.array_distinct(F.flatten(F.transform(titles, lambda t: noun_chunks(t))))
    by_length = F.transform(F.array_sort(F.transform(chunks, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c")))), lambda x: x["c"])

    def two(free: Column) -> Column:
        first = F.slice(free, 1, 1)
        return F.concat(first, F.slice(F.filter(free, lambda c: apart(first, c)), 1, 1))

    named_by = lambda ents: F.when(F.size(ents) > 0, F.array_join(F.concat(ents, _let(F.filter(by_length, lambda c: apart(ents, c)), two)), ", "))
    return _let(top, named_by)


def prompt(titles: Column) -> Column:
    """Numbered titles (with their outlets, as longest_titles() tells them), one a line."""
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def remote_namer(ask: Callable[[str], str], attempts: int = 2, parallel: int = 4) -> Callable[[Column], Column]:
    """A namer that asks `ask` (a prompt to a reply), `parallel` at a time in a batch; what fails in all attempts has no name, and its story the fallback's."""
    one = or_none(retried(ask, attempts))

    def replies(prompts: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(parallel) as pool:
            return pd.Series(list(pool.map(lambda p: one(f"{TASK}\n{p}") if p else None, prompts)), dtype=object)

    def name(titles: Column) -> Column:
        return F.pandas_udf(replies, "string")(prompt(titles))

    name.with_outlets = True
    return name


def register(name: str, ask: Callable[[str], str], **options) -> None:
    NAMERS[name] = remote_namer(ask, **options)


def _post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
        return r.read()


def http_ask(kind: str, url: str, model: str, key: str, timeout: float = 20.0, post: Callable[[str, dict[str, str], bytes, float], bytes] = _post) -> Callable[[str], str]:
    """ask for a service that takes 'messages' (key in x-api-key, reply in content) or 'chat' (bearer key, reply in choices); post is the transport."""
    if kind not in ("messages", "chat"):
        raise ValueError(f"kind is messages or chat, not {kind!r}")

    def ask(text: str) -> str:
        body = json.dumps({"model": model, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": text}]}).encode()
        headers = {"content-type": "application/json"} | ({"x-api-key": key} if kind == "messages" else {"authorization": f"Bearer {key}"})
        got = json.loads(post(url, headers, body, timeout))
        return got["content"][0]["text"] if kind == "messages" else got["choices"][0]["message"]["content"]

    return ask


def sdk_ask(invoke: Callable[[str], str]) -> Callable[[str], str]:
    """ask for a service behind a client library that signs its requests: invoke takes and gives the JSON of the 'messages' form."""

    def ask(text: str) -> str:
        return json.loads(invoke(json.dumps({"max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": text}]})))["content"][0]["text"]

    return ask


def longest_titles(articles: Column, with_outlets: bool = False) -> Column:
    """Titles of the articles, longest first, MAX_TITLES at most; with_outlets: each with its outlet in brackets behind it."""
    told = (lambda a: F.concat(a["title"], F.lit(" ("), a["outlet"], F.lit(")"))) if with_outlets else lambda a: a["title"]
    each = F.transform(articles, lambda a, i: F.struct((-F.length(a["title"])).alias("n"), i.alias("i"), told(a).alias("t")))
    return F.transform(F.slice(F.array_sort(each), 1, MAX_TITLES), lambda x: x["t"])


def cleaned(reply: Column) -> Column:
    """First line without blanks and quotes around it and full stops at its end; null if empty, too long or no headline."""
    line = F.regexp_extract(F.regexp_replace(reply, rf"\A{BLANK}+", ""), rf"\A{ON_A_LINE}", 0)
    for pattern in (rf"{BLANK}+\z", "\\A[\"'“”‘’ ]+|[\"'“”‘’ ]+\\z", r"\.+\z", rf"\A{BLANK}+|{BLANK}+\z"):
        line = F.regexp_replace(line, pattern, "")
    bad = F.lit(False)
    for mark in REFUSALS:
        bad = bad | F.lower(line).contains(mark)
    return F.when((line != "") & (F.length(line) <= MAX_CHARS) & ~bad, line)


def needs_name(cached: Column, cached_count: Column, count: Column) -> Column:
    return cached.isNull() | (count > cached_count * GROWTH)


def named(stories: DataFrame, cache: DataFrame, as_of: str, provider: str = "local", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(stories with headline and headline_source, the new cache). The budget goes to kind 'story' in rank order first."""
    name = NAMERS[provider]
    c = cache.select(F.col("id"), F.col("headline").alias("_h"), F.col("headline_source").alias("_s"), F.col("article_count").alias("_n"), F.col("named_at").alias("_at"))
    s = stories.join(c, "id", "left").withColumn("due", needs_name(F.col("_h"), F.col("_n"), F.col("article_count")))
    due = s.where("due").select("story", "kind", "outlet_count", "article_count", "latest_published")
    first = due.orderBy((F.col("kind") == "story").desc(), F.col("outlet_count").desc(), F.col("article_count").desc(), F.col("latest_published").desc(), "story").limit(budget)
    s = s.join(first.select("story", F.lit(True).alias("try")), "story", "left")
    known = "outlet" in stories.schema["articles"].dataType.elementType.names
    titles = longest_titles(F.col("articles"), known and getattr(name, "with_outlets", False))
    s = s.withColumn("_reply", name(F.when(F.col("try"), titles)))  # null titles aren't asked for
    s = s.withColumn("_new", F.when(F.col("try"), cleaned(F.col("_reply"))))
    s = s.withColumn("outcome", F.when(~F.col("due"), "cached").when(F.col("_new").isNotNull(), "named").when(F.col("try"), "failed").otherwise("over_budget"))
    s = s.withColumn("headline_source", F.when(~F.col("due"), F.col("_s")).when(F.col("_new").isNotNull(), F.lit(provider)).otherwise("fallback"))
    s = s.withColumn("headline", F.when(~F.col("due"), F.col("_h")).otherwise(F.coalesce("_new", "headline")))
    s = written(s, "named")
    new = s.where("outcome = 'named'").select("id", "headline", "headline_source", F.col("article_count").cast("long").alias("article_count"), F.lit(as_of).alias("named_at"))
    new = new.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("headline"))).where("k = 1").drop("k")
    oldest = F.date_format(F.date_sub(F.lit(as_of).cast("date"), RETENTION_DAYS), "yyyy-MM-dd")
    old = cache.join(new.select("id"), "id", "left_anti").where(F.col("named_at").isNull() | (F.col("named_at") >= oldest))
    return s.drop("_h", "_s", "_n", "_at", "due", "try", "_reply", "_new"), written(new.unionByName(old.select(*new.columns)), "names")


def outcomes(named_stories: DataFrame) -> DataFrame:
    return named_stories.groupBy("outcome").agg(F.count("*").alias("n"))
