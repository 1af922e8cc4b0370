"""Entities by a dictionary of phrases: the longest matches, word by word, of an automaton in flat arrays.

A phrase is a path of words; states and their words are one sorted array of keys, so a step of all words of a batch at once is one binary search:
the k-th step looks the k-th word behind every start up from the state that the start has reached, for the starts that are still on a path. There
are as many steps as the longest phrase has words. Of overlapping matches the leftmost is taken, of those at a word the longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a word of a title or phrase is, here.
WORD = r"[\p{L}\p{N}&'’\-]+"
#: Words of all phrases together: a broadcast of some 100 MB at most.
MOST_WORDS = 2_000_000


class Dictionary:
    """Phrases as an automaton. fold: case doesn't count."""

    def __init__(self, phrases: Iterable[str], fold: bool = False) -> None:
        import regex

        each = [regex.findall(WORD, p.lower() if fold else p) for p in phrases]
        each = [w for w in each if w]
        if sum(map(len, each)) > MOST_WORDS:
            raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
        self.fold, self.longest = fold, max(map(len, each), default=0)
        names = sorted({w for p in each for w in p})
        self.words, self.size = pa.array(names, pa.string()), len(names)
        place = {w: i for i, w in enumerate(names)}
        # level by level: a state is a distinct beginning of phrases
        at, states, ends, keys = np.zeros(len(each), np.int64), 1, set(), []
        ids = [np.array([place[w] for w in p], np.int64) for p in each]
        for k in range(self.longest):
            on = np.array([i for i, p in enumerate(ids) if len(p) > k])
            key = at[on] * self.size + np.array([ids[i][k] for i in on])
            new, inverse = np.unique(key, return_inverse=True)
            keys.append(new)
            at[on] = states + inverse
            states += len(new)
            ends.update(at[i] for i in on.tolist() if len(ids[i]) == k + 1)
        # states are numbered level by level and within a level by key, so their order is that of the keys
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.ends = np.zeros(states, bool)
        self.ends[sorted(ends)] = True

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = state * self.size + word
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (word >= 0), i + 1, -1)

    def found(self, titles: pa.ListArray) -> pa.ListArray:
        """Lists of words to lists of the distinct phrases in them, as they stand there."""
        flat = titles.flatten()
        counts = np.asarray(pc.fill_null(pc.list_value_length(titles), 0)).astype(np.int64)
        end = np.repeat(counts.cumsum(), counts)
        word = np.asarray(pc.fill_null(pc.index_in(pc.utf8_lower(flat) if self.fold else flat, self.words), -1)).astype(np.int64)
        best = np.zeros(len(word), np.int64)
        start, state = np.arange(len(word)), np.zeros(len(word), np.int64)
        for k in range(self.longest):
            go = start + k < end[start]
            start, state = start[go], state[go]
            state = self._step(state, word[start + k])
            start, state = start[state > 0], state[state > 0]
            best[start[self.ends[state]]] = k + 1
        hits, out, until = np.flatnonzero(best), [[] for _ in range(len(titles))], 0
        of = np.searchsorted(counts.cumsum(), hits, "right")
        for at, title, n in zip(hits.tolist(), of.tolist(), best[hits].tolist(), strict=True):
            if at >= until:
                until = at + n
                phrase = " ".join(flat.slice(at, n).to_pylist())
                if phrase not in out[title]:
                    out[title].append(phrase)
        return pa.array(out, pa.list_(pa.string()))


def dictionary_entities(spark: SparkSession, phrases: Iterable[str], fold: bool = False) -> Callable[[Column], Column]:
    """A function of a title's Column to its entities, as stories() and group_clusters() take them; the automaton is broadcast once."""
    shared = spark.sparkContext.broadcast(Dictionary(phrases, fold))

    def found(titles: pa.Array) -> pa.Array:
        return shared.value.found(titles)

    udf = F.arrow_udf(found, "array<string>")
    return lambda title: udf(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(WORD), F.lit(0)))
