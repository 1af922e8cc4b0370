"""Terms of a headline: noun phrases and the verbs that govern them, by rules over words instead of a trained parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import STOP_WORDS

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*|[.,;:!?()]"
#: Verbs of headlines that no ending tells.
VERBS = tuple("says said wins won gets got makes made takes took hits cuts sets set falls fell rises rose loses lost finds found leaves left goes went sees saw keeps kept".split())


def looks_verbal(word: Column) -> Column:
    """A verb by its ending, or one of VERBS; capitals are names."""
    return word.rlike(r"^(?!\p{Ll}*thing$)\p{Ll}{2,}(ed|ing|ises|izes|ates|ifies)$") | F.lower(word).isin(*VERBS)


def lemma(word: Column) -> Column:
    """Singular by rule: -ies to -y, -sses to -ss, no last s but behind s, u and i."""
    w = F.regexp_replace(word, r"(?i)(?<=\p{L}{2})ies$", "y")
    return F.regexp_replace(F.regexp_replace(w, r"(?i)(?<=ss)es$", ""), r"(?i)(?<=\p{L}{2}[^sui])s$", "")


def _breaks(w: Column, stop: tuple[str, ...]) -> Column:
    return ~w.rlike(r"^[\p{L}\p{N}]") | F.lower(w).isin(*stop) | looks_verbal(w)


def noun_chunks(sentence: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Longest runs of words without stop words, verbs and punctuation between them, in order."""
    ws = F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0))
    marked = F.array_join(F.transform(ws, lambda w: F.when(_breaks(w, stop), "\n").otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, "\n"), lambda c: F.trim(c)), lambda c: c != "")


def head_verbs(sentence: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Verbs that stand next to a noun phrase, in order."""
    ws = F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0))
    noun = lambda i: F.coalesce(~_breaks(F.get(ws, i), stop), F.lit(False))
    return F.filter(ws, lambda w, i: looks_verbal(w) & ~F.lower(w).isin(*stop) & (noun(i - 1) | noun(i + 1)))


def terms(sentence: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct noun phrases and head verbs; a single word is its lemma. Null has none."""
    each = F.array_distinct(F.concat(head_verbs(sentence, stop), noun_chunks(sentence, stop)))
    return F.coalesce(F.transform(each, lambda t: F.when(t.contains(" "), t).otherwise(lemma(t))), F.array().cast("array<string>"))
