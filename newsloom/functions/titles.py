"""Headlines' shapes and bracket labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (fixed values) what marks a deal.
DEAL = r"(?i)(\$\s?\d[\d,]*(\.\d+)?\s*off|\d+\s?%\s*off|\bpre-?order\b|\bdeals?\b|\bdiscount\b|\bcoupon\b)"
#: (fixed values) capitalised words that name nobody.
GENERIC = tuple(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
)
#: (fixed value) a word of a title.
WORD = r"[A-Za-z0-9$%'’.\-]+"


def is_deal(title: Column) -> Column:
    return F.coalesce(title.rlike(DEAL), F.lit(False))


def words(title: Column) -> Column:
    """ASCII words: accented letters split."""
    return F.regexp_extract_all(title, F.lit(WORD), F.lit(0))


def is_title_case(ws: Column) -> Column:
    """At least 0.7 of the words longer than three that begin with a letter begin with a capital."""
    long_ = F.filter(ws, lambda w: (F.length(w) > 3) & w.rlike("^[A-Za-z]"))
    return (F.size(long_) > 0) & (F.size(F.filter(long_, lambda w: w.rlike("^[A-Z]"))) / F.greatest(F.size(long_), F.lit(1)) >= 0.7)


def bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[.'’]+|[.'’]+$", "")


def proper_nouns(ws: Column) -> Column:
    """Lower-cased capitalised words behind the first, of titles that aren't in title case."""
    rest = F.filter(F.slice(ws, 2, 1_000_000), lambda w: w.rlike("^[A-Z]"))
    nouns = F.filter(F.transform(rest, bare), lambda w: ~w.isin(*GENERIC))
    return F.when(~is_title_case(ws), F.array_distinct(nouns)).otherwise(F.array().cast("array<string>"))


def capital_runs(title: Column) -> Column:
    """Default entities: runs of capitalised words, unless the title is in title case."""
    runs = F.regexp_extract_all(title, F.lit(r"\b(\p{Lu}[\p{L}\p{N}&'’\-]*(?:\s+\p{Lu}[\p{L}\p{N}&'’\-]*)*)"), F.lit(1))
    return F.when(~is_title_case(words(title)), F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def entity_tokens(title: Column, entities=capital_runs) -> Column:
    """Words of three letters or more of a title's entities, lower-cased."""
    every = F.flatten(F.transform(entities(title), lambda e: F.split(F.lower(e), r"[^\p{L}]+")))
    return F.array_distinct(F.filter(every, lambda w: F.length(w) >= 3))


def compatible(a: Column, b: Column) -> Column:
    """Entity sets that share one, or of which one is empty."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def bracket_label(phrases: Column) -> Column:
    return F.array_join(F.transform(phrases, lambda p: F.concat(F.lit("["), p, F.lit("]"))), " ")


def keywords(label: Column) -> Column:
    """Distinct lower-cased phrases in brackets, in order."""
    found = F.transform(F.regexp_extract_all(label, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda p: F.trim(F.lower(p)))
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def phrase_count(label: Column) -> Column:
    parts = F.split(F.replace(F.replace(label, F.lit("["), F.lit("|")), F.lit("]"), F.lit("")), r"\|")
    return F.size(F.filter(parts, lambda p: F.trim(p) != ""))


def word_count(label: Column) -> Column:
    """Words of a single phrase; 999 for none or several."""
    parts = F.split(F.trim(F.replace(F.replace(label, F.lit("["), F.lit("")), F.lit("]"), F.lit(""))), r"\s+")
    return F.when(phrase_count(label) == 1, F.size(F.filter(parts, lambda p: p != ""))).otherwise(999)


def label_order(label: Column, sub_groups: Column, articles: Column) -> list[Column]:
    """Sort key of groups: several phrases first, then more words, more sub-groups, more articles."""
    return [(phrase_count(label) > 1).desc(), word_count(label).desc(), sub_groups.desc(), articles.desc()]
