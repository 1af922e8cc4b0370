"""Headline text as Column expressions: cleaning, tokens, information scores, terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words (lower case); every function takes another list instead.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can "
    "could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in "
    "into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your yours yourself".split()
)
#: (fixed values) how rare each letter counts; every other character counts 1.
RARITY = {
    "a": 1, "b": 5, "c": 3, "d": 2, "e": 1, "f": 3, "g": 5, "h": 2, "i": 1, "j": 9, "k": 5, "l": 2, "m": 3,
    "n": 1, "o": 1, "p": 3, "q": 10, "r": 2, "s": 2, "t": 1, "u": 2, "v": 5, "w": 3, "x": 9, "y": 3, "z": 10,
}
#: (fixed values) sentence starters whose capital says little.
STARTERS = ("The", "A", "An", "In", "On", "It", "They", "This")
STRIPPED = ".,!?;:()\"'"


def clean_text(c: Column) -> Column:
    """Lower case, letters, inner hyphens and single apostrophes; null gives ''.

    A free-standing hyphen goes with the space around it; digits go; dots become spaces; two or more apostrophes all go.
    """
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.replace(F.replace(x, F.lit("<i>"), F.lit("")), F.lit("<\\i>"), F.lit(""))
    for pattern, to in (
        (r"[^\p{L}\p{N}_\-'\s\p{Z}.]", ""),
        (r"[\p{Nd}_*]", ""),
        (r"(^|[\s\p{Z}]+)-([\s\p{Z}]+|$)", ""),
        (r"\.+", " "),
        (r"[\s\p{Z}]+", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    x = F.trim(x)
    return F.when(F.length(x) - F.length(F.replace(x, F.lit("'"), F.lit(""))) > 1, F.replace(x, F.lit("'"), F.lit(""))).otherwise(x)


def tokens(c: Column) -> Column:
    """Split at single spaces; '' gives one empty token."""
    return F.split(c, " ")


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*stop))


def mapped_terms(c: Column, mapping: dict[str, str]) -> Column:
    """Whole-word, case-insensitive replacements in the mapping's order; keys are regular expressions, values replacement templates."""
    return reduce(lambda x, kv: F.regexp_replace(x, rf"(?i)\b{kv[0]}\b", kv[1]), mapping.items(), c)


def content_tokens(c: Column, mapping: dict[str, str] | None = None, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return without_stop_words(tokens(clean_text(mapped_terms(c, mapping) if mapping else c)), stop)


def _strip(word: Column) -> Column:
    cls = r"[.,!?;:()\"']"
    return F.regexp_replace(word, f"^{cls}+|{cls}+$", "")


def info_value(word: Column) -> Column:
    """40 % letter rarity, 40 % consonants, 20 % length (log base 12); under two characters 0. Not rounded."""
    w = _strip(F.lower(word))
    n = F.length(w)
    rare = F.lit(0)
    by_value: dict[int, str] = {}
    for letter, value in RARITY.items():
        if value > 1:
            by_value[value] = by_value.get(value, "") + letter
    for value, letters in by_value.items():
        rare = rare + (n - F.length(F.translate(w, letters, ""))) * (value - 1)
    rarity = F.least((n + rare) / n / 6, F.lit(1.0))
    vowels = n - F.length(F.translate(w, "aeiou", ""))
    consonants = F.length(F.regexp_replace(w, r"[^\p{L}]", "")) - vowels
    structure = 1 / (1 + vowels / F.when(consonants > 0, consonants).otherwise(0.5))
    length = F.least(F.ln(n) / F.ln(F.lit(12.0)), F.lit(1.0))
    return F.when(n < 2, 0.0).otherwise(rarity * 0.4 + structure * 0.4 + length * 0.2)


def weighted_score(word: Column, starts_sentence: bool = False) -> Column:
    """info_value with its weight for capitals: all capitals 2.5, capital 2.0, at a sentence's start 1.5 (starters 1.1)."""
    w = _strip(word)
    has_case = F.upper(w) != F.lower(w)
    capital = F.substring(w, 1, 1).rlike(r"^\p{Lu}")
    first = F.when(w.isin(*STARTERS), 1.1).otherwise(1.5) if starts_sentence else F.lit(2.0)
    weight = F.when(has_case & (F.upper(w) == w), 2.5).when(capital, first).otherwise(1.0)
    return F.when(F.length(w) < 2, 0.0).otherwise(F.round(info_value(w), 4) * weight)


def sentence_score(sentence: Column) -> Column:
    """Sum of the three best word scores of the lower-cased sentence, less up to 20 % for words under 0.45."""
    words = F.filter(F.split(F.lower(sentence), r"[\s\p{Z}]+"), lambda w: w != "")
    scores = F.transform(words, lambda w: F.round(weighted_score(w), 4))
    top = F.aggregate(F.slice(F.sort_array(scores, asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    noise = F.size(F.filter(scores, lambda s: s < 0.45)) / F.size(words)
    return F.when(F.size(words) == 0, 0.0).otherwise(top * (1 - noise * 0.2))


def clean_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(term), r"[^A-Za-z0-9 ]+", ""))
