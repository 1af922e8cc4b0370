"""Near-duplicate passages: exact ones by whole-table joins, the others by winnowed seeds, pair by pair on five-word shingles.

A passage of a document is repeated if it has PASSAGE words or more, begins and ends with a shingle (SHINGLE words) that the other document
has there too, and the shingle sets of the two stretches have a Jaccard similarity of SIMILARITY at least. Words keep their order; what
differs between two matching shingles is at most REACH shingles long on either side.

1. Documents of equal words are one node from here on: with PASSAGE words they are a passage as a whole.
2. Two such stretches share a run of 20 shingles (24 words) at least, if no shingle repeats in them: a change between two runs takes four shingles of one
   stretch and five of the other or more. With one change the union has 46 + 4, so 40 are common, in two runs; k changes take 9 k, so 36 k are
   common, in k + 1 runs. Of every STEP consecutive SEED-word windows the one of the smallest hash is kept (Schleimer, Wilkerson and Aiken
   2003), so each run of SEED + STEP - 1 = 24 words leaves both documents a seed. Only nodes with a seed that another node has go on.
3. Exact passages: every PASSAGE-word window whose inner seeds are all shared is joined by its hash, so a word inside any window that another node has is
   found without a pair being looked at, however many documents share the window. Each maximal stretch of such windows is then walked
   over changes to both sides against one node that has it (the smallest, or for that one the largest).
4. Near passages: what is left are shared seeds outside all of these stretches. Nodes that share such a seed go to one cluster (connected
   components), clusters are verified in blocks of bounded size as in near_dedup: each task holds two blocks. A seed's occurrence is compared with
   those of other documents, those with most shingles in common within SIGHT first (a passage has 41 in common at least), until it lies in a
   passage. No pair is dropped, capped or sampled: an occurrence that lies in no passage has been compared with all that could be one.
5. A document's passages are the union of those.

So every word of an exact passage is told, and every passage is told with one partner; where several partners differ in how far a passage goes on behind a change, it
is told as far as it goes with the partner it was walked with.

compact_windows (windows of min-hashes over Cartesian trees) found candidates earlier, at similarity s with probability 3s^2(1-s) + s^3; nothing but its tests uses it now.
Of a run of equal words that several documents share only the first seed is compared; a seed counts as inside such a run only if all words since the seed before it are equal too.

Defined results: text null has no words and no passages; rows that repeat doc_id and text are one document, and each gets that
document's result; rows that share doc_id alone are apart; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import textops
from newsloom.llm._shared import components, drop_written, ship, written

SHINGLE = 5
PASSAGE = 50
SEED, STEP = 13, 12
#: Similarity 4/5.
NUM, DEN = 4, 5
REACH = 64
#: Words to both sides of a seed within which its passage (or a part of it that is one) lies: a passage can be cut into parts of 46 to 91 shingles, of which one is similar enough.
SIGHT = 128
#: Distinct shingles that two passages have in common at least: 0.8 of the union of 46 and more.
COMMON = 37
#: Words by which an end may be known short.
SLACK = 0
#: Blocks of a cluster, as in near_dedup.
SMALL_BLOCK, SPREAD, BLOCK_WORDS = 25_000, 8, 1_000_000
#: Shingles of a change that are looked at before REACH, and occurrences that are compared before the others.
NEAR, AHEAD = 12, 4
#: Runs of an alignment that are looked at in all pairs.
RUNS = 256
U = np.uint64
#: Levels of the tree from which on equal minimums are looked for (a text without repeats has about twice the logarithm of its length).
DEEP = 30


def compact_windows(values: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), as positions in values, of every compact window of at least `least` elements, of sequences laid end to end.

    Of equal minimums of a range only the widest window is made: the others have its key and lie inside it. Sequences together hold fewer than 2**24 elements, or are one sequence, which
    is then compared by fewer bits.
    """
    place = np.arange(len(values), dtype=U)
    bits = U(max(24, int(len(values)).bit_length()))
    packed = (values >> bits << bits) | place
    mask = (U(1) << bits) - U(1)
    e = np.cumsum(counts)
    s = e - counts
    at = s.copy()  # where segments begin in values; s and e are places in packed, which is cut down to live segments
    ls, cs, rs = [], [], []
    for level in count():
        big = e - s >= least
        s, e, at = s[big], e[big], at[big]
        if not len(s):
            break
        order = np.argsort(s, kind="stable")
        s, e, at = s[order], e[order], at[order]
        lens = e - s
        live = int(lens.sum())
        if live < 0.7 * len(packed) or level >= DEEP:
            begin = np.cumsum(lens) - lens
            packed = packed[np.arange(live) + np.repeat(s - begin, lens)]
            s, e = begin, begin + lens
        cuts = np.empty(2 * len(s), np.int64)
        cuts[::2], cuts[1::2] = s, np.minimum(e, len(packed) - 1)
        low = np.minimum.reduceat(packed, cuts)[::2]
        if e[-1] == len(packed):  # the last cut can't lie behind the end
            low[-1] = packed[s[-1] :].min()
        c = (low & mask).astype(np.int64)
        ls.append(at)
        cs.append(c)
        rs.append(at + lens - 1)
        if level >= DEEP:  # texts that repeat themselves: split at every place of the minimum at once
            own = np.repeat(np.arange(len(s)), lens)
            hit = np.flatnonzero(packed >> bits == (low >> bits)[own])
            start, e = np.sort(np.concatenate([s, hit + 1])), np.sort(np.concatenate([hit, e]))
            own = own[np.minimum(start, len(own) - 1)]
            s, at = start, at[own] + start - s[own]
            continue
        mid = c - at + s
        s, e, at = np.concatenate([s, mid + 1]), np.concatenate([mid, e]), np.concatenate([at, c + 1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(ls), np.concatenate(cs), np.concatenate(rs)) if ls else (none, none, none)


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """first row, word hashes, words of each text."""
    sep = textops.separators("space")
    for at, data, off in textops.passes(texts):
        starts, ends, counts = textops.words(data, off, sep)
        yield at, textops.span_hashes(data, starts, ends), counts


def seeds(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word within the text) of the winnowed SEED-word windows."""
    g, per = textops.grams(h, counts, SEED)
    of = np.repeat(np.arange(len(counts)), per)
    m = len(g) - STEP + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(g, STEP).argmin(1)
    chosen = np.unique((np.arange(m) + low)[of[STEP - 1 :] == of[:m]])
    begin = np.cumsum(per) - per
    return g[chosen], of[chosen], chosen - begin[of[chosen]]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (doc, n_words, digest of the words, distinct seeds)."""
    for batch in batches:
        for at, h, counts in _hashed(batch.column(1)):
            n = len(counts)
            first, has = np.cumsum(counts) - counts, counts > 0
            place = (np.arange(len(h)) - np.repeat(first, counts)).astype(U)
            digests = []
            for salt in (0x8CB92BA72F3D8DD7, 0x2D358DCCAA6C78A5):
                d = np.zeros(n, U)
                if has.any():
                    d[has] = np.add.reduceat(textops.mix(h ^ textops.mix(place + U(salt))), first[has])
                digests.append(textops.longs(textops.mix(d + counts.astype(U))))
            k, o, _ = seeds(h, counts)
            order = np.lexsort((k, o))
            k, o = k[order], o[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), textops.longs(counts), *digests, textops.long_lists(k[new], np.bincount(o[new], minlength=n))], names=["doc", "n_words", "d1", "d2", "keys"]
            )


def _narrow(h: np.ndarray) -> np.ndarray:
    """A word's hash in 32 bits: a shingle is five of them."""
    return (h >> U(32)).astype(np.uint32).view(np.int32)


def _ints(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32), pa.int32()))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, shared keys) to (node, words, keys and places of the shared seeds, places and hashes of the windows of PASSAGE words)."""
    half = PASSAGE // 2
    for batch in batches:
        wanted = batch.column(2)
        for at, h, counts in _hashed(batch.column(1)):
            n, total = len(counts), len(h)
            mine = wanted.slice(at, n)
            rows = np.repeat(np.arange(n), np.diff(mine.offsets.to_numpy()))
            own = lambda key, row: textops.mix(key + textops.mix(row.astype(U)))
            known = own(mine.flatten().to_numpy(zero_copy_only=False).view(U), rows)
            first = np.cumsum(counts) - counts
            k, o, place = seeds(h, counts)
            shared = np.isin(own(k, o), known)
            some, other = np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32)
            some[first[o] + place + 1] = 1
            other[(first[o] + place + 1)[~shared]] = 1
            some, other = np.cumsum(some), np.cumsum(other)
            p = np.zeros(0, np.int64)
            if total >= PASSAGE:
                # seeds that lie so far inside a window that they depend on its words alone
                lo, hi = STEP - 1, PASSAGE - SEED - STEP + 2
                m = total - PASSAGE + 1
                good = (some[hi : hi + m] > some[lo : lo + m]) & (other[hi : hi + m] == other[lo : lo + m])
                p = np.flatnonzero(good)
                row = np.searchsorted(first + counts, p, "right")
                fits = p + PASSAGE <= (first + counts)[row]
                p, row = p[fits], row[fits]
            if len(p):
                x = np.zeros(total - half + 1, U)
                for i in range(half):
                    x = x * U(0xD6E8FEB86659FD93) + h[i : total - half + 1 + i]
                x = textops.mix(x)
                win, places, per = textops.mix(x[p] * U(0xA0761D6478BD642F) + x[p + PASSAGE - half]), p - first[row], np.bincount(row, minlength=n)
            else:
                win, places, per = np.zeros(0, U), p, np.zeros(n, np.int64)
            of = np.bincount(o[shared], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), _ints(_narrow(h), counts), textops.long_lists(k[shared], of), _ints(place[shared], of), _ints(places, per), textops.long_lists(win, per)],
                names=["node", "words", "keys", "places", "p", "h"],
            )


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, windows (p, other) that other nodes have) to (node, stretches, pairs (other, places of windows) to walk)."""
    span, pair = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("other", pa.int64()), ("at", pa.list_(pa.int64()))]))
    for batch in batches:
        spans, pairs = [], []
        for w in batch.column(1):
            p, other = w.values.field(0).to_numpy(), w.values.field(1).to_numpy()
            order = np.argsort(p, kind="stable")
            p, other = p[order].astype(np.int64), other[order]
            cut = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + 1, [True]]))
            spans.append([{"first": a, "end": b} for a, b in merged([(int(p[i]), int(p[j - 1]) + PASSAGE) for i, j in zip(cut[:-1], cut[1:], strict=True)])])
            # both ends of each run of windows, with a node that has them
            walk: dict[int, list[int]] = {}
            for k in sorted({int(k) for i, j in zip(cut[:-1], cut[1:], strict=True) for k in (i, j - 1)}):
                walk.setdefault(int(other[k]), []).append(int(p[k]))
            pairs.append([{"other": o, "at": at} for o, at in walk.items()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(pairs, pair)], names=["node", "spans", "pairs"])


def _shingles(words: np.ndarray) -> np.ndarray:
    g, _ = textops.grams(textops.mix(words.view(np.uint32).astype(U) + U(1)), np.array([len(words)]), SHINGLE)
    return g


def _shingles_of(docs: list[np.ndarray]) -> list[np.ndarray]:
    """_shingles() of each of many documents, made together."""
    words = np.concatenate([d.view(np.uint32) for d in docs])
    g, per = textops.grams(textops.mix(words.astype(U) + U(1)), np.array([len(d) for d in docs]), SHINGLE)
    return np.split(g, np.cumsum(per)[:-1])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, places of windows, words, other, words of the other) to the passages (node, first, end, partner) through the windows."""
    for batch in batches:
        out = []
        kept: dict[int, np.ndarray] = {}

        def of(node: int, words: pa.ListScalar, kept: dict[int, np.ndarray] = kept) -> tuple[np.ndarray, np.ndarray]:
            w = words.values.to_numpy(zero_copy_only=False)
            if node not in kept:
                kept.clear() if len(kept) > 64 else None
                kept[node] = _shingles(w)
            return w, kept[node]

        for node, places, words, other, others in zip(*(batch.column(i) for i in range(5)), strict=True):
            u, v = node.as_py(), other.as_py()
            x, gx = of(u, words)
            y, gy = of(v, others)
            walked: list[tuple[int, int, int]] = []
            for i in places.as_py():
                if any(p <= i < p + n for p, _, n in walked):
                    continue
                near = np.flatnonzero(gy == gx[i])
                near = near[near + PASSAGE <= len(y)]
                j = next((int(j) for j in near if (y[j : j + PASSAGE] == x[i : i + PASSAGE]).all()), None)
                if j is None:
                    continue
                runs = runs_around(gx, gy, i, j)
                walked += runs
                for a, b, c, d in similar(gx, gy, runs):
                    out += _long_enough((u, a, b, v), (v, c, d, u))
        yield _found(out)


def _long_enough(*sides: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Of (node, first shingle, end, partner) those of PASSAGE words or more, in words."""
    return [(n, a, b + SHINGLE - 1, p) for n, a, b, p in sides if b - a > PASSAGE - SHINGLE]


def _found(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = np.array(sorted(set(rows)), np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "first", "end", "partner"])


def _free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, keys, places, words, stretches or null) to a row (node, key, place, free, behind) for each shared seed.

    free: it lies in no stretch. behind: stands for the free seed before it and all words from there on; two seeds of equal key and behind are in a run of equal words that is
    walked from the earlier seed. What has none before it gets a value of its own.
    """
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        out: list[list[np.ndarray]] = []
        for row, keys, places, words, spans in zip(nodes, *(batch.column(i) for i in range(1, 5)), strict=True):
            between = _stretch_hash(words.values.to_numpy(zero_copy_only=False))
            k, at = keys.values.to_numpy(zero_copy_only=False), places.values.to_numpy(zero_copy_only=False).astype(np.int64)
            free = np.ones(len(k), bool)
            if spans.is_valid and len(spans.values):
                a = spans.values.field(0).to_numpy()
                order = np.argsort(a)
                a, b = a[order], spans.values.field(1).to_numpy()[order]
                b = np.maximum.accumulate(b)
                i = np.searchsorted(a, at, "right") - 1
                free = ~((i >= 0) & (at + SEED <= b[np.maximum(i, 0)]))
            behind = textops.mix(at.astype(U) + textops.mix(np.array([row], np.int64).view(U)))
            i = np.flatnonzero(free[1:] & free[:-1])
            behind[i + 1] = textops.mix(k[i].view(U) + textops.mix((at[i + 1] - at[i]).astype(U) + between(at[i], at[i + 1])))
            # where a text repeats itself within a seed's length, its first and last seeds of a kind stand for all between
            kind = np.stack([k.view(U), np.append(U(0), k[:-1].view(U)), np.append(k[1:].view(U), U(0))])
            order = np.lexsort((at, *kind))
            again = np.zeros(len(k), bool)  # the next of its kind is near
            again[:-1] = (kind[:, order[1:]] == kind[:, order[:-1]]).all(0) & (at[order[1:]] - at[order[:-1]] <= SEED)
            inner = np.zeros(len(k), bool)
            inner[order[1:]] = again[1:] & again[:-1]
            keep = ~inner
            out.append([np.full(int(keep.sum()), row), k[keep], at[keep], free[keep], behind.view(np.int64)[keep]])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "key", "place", "free", "behind"])


def _stretch_hash(words: np.ndarray):
    """A function of first words and ends: hashes of the stretches, wherever they stand, from sums over all words before them."""
    n = len(words) + 1
    up = np.full(n, textops.MULTIPLIER, U)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, U(pow(int(textops.MULTIPLIER), -1, 1 << 64)), U)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(n, U)
    np.cumsum(textops.mix(words.astype(np.int64).view(U)) * down[:-1], out=sums[1:])
    return lambda a, b: (sums[b] - sums[a]) * up[a]


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements are equal."""
    m = min(len(x), len(y))
    for lo in (0, 64):  # most runs are short
        hi = min(m, 64) if not lo else m
        differ = x[lo:hi] != y[lo:hi]
        if differ.any():
            return lo + int(differ.argmax())
    return m


def _meet(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """The places of the equal elements with the smallest sum of places, of equal sums that of the smallest place in x."""
    for n in (NEAR, REACH + 1):  # most changes are short, and pairs of sums below n are all among the first n of both
        b = y[:n]
        at = (x[:n, None] == b).ravel().nonzero()[0]
        if len(at):
            p, q = np.divmod(at, len(b))
            total = p + q
            k = int(total.argmin())
            if total[k] < n or n > NEAR:
                return int(p[k]), int(q[k])
    return None


def _walk(x: np.ndarray, y: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs (first of x, first of y, length) that follow the differing shingles i and j, over changes of at most REACH."""
    out = []
    while True:
        met = _meet(x[i : i + REACH + 1], y[j : j + REACH + 1])
        if met is None:
            return out
        i, j = i + met[0], j + met[1]
        n = _equal(x[i:], y[j:])
        out.append((i, j, n))
        i, j = i + n, j + n


def runs_around(x: np.ndarray, y: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs of equal shingles of the alignment of x and y through the equal shingles i and j, in order."""
    left, right = _equal(x[:i][::-1], y[:j][::-1]), _equal(x[i:], y[j:])
    back = _walk(x[::-1], y[::-1], len(x) - i + left, len(y) - j + left)
    before = [(len(x) - a - n, len(y) - b - n, n) for a, b, n in reversed(back)]
    return [*before, (i - left, j - left, left + right), *_walk(x, y, i + right, j + right)]


def _repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements that are equal to one before them: their places in order, and the place of the last such one."""
    order = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    at, was = order[same + 1], order[same]
    by = np.argsort(at)
    return at[by], was[by]


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y, not empty."""
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def similar(x: np.ndarray, y: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The longest stretches (of x, of y: first shingle and end) from run to run that are similar enough on their shingle sets."""
    least = PASSAGE - SHINGLE + 1
    first, other, lens = np.array(runs, np.int64).T
    b, d = first + lens, other + lens
    if len(runs) == 1:
        return [(int(first[0]), int(b[0]), int(other[0]), int(d[0]))] if lens[0] >= least else []
    x0, y0 = int(first[0]), int(other[0])
    x, y, first, b, other, d = x[x0 : b[-1]], y[y0 : d[-1]], first - x0, b - x0, other - y0, d - y0
    # the few elements that occur before: where, and where before
    at_x, was_x = _repeats(x)
    at_y, was_y = _repeats(y)
    aligned = np.repeat(first - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
    at_m, was_m = _repeats(x[aligned]) if len(at_x) else (at_x, was_x)
    was_m = aligned[was_m]
    elsewhere = _among(x, y)
    known = np.concatenate([[0], np.cumsum(elsewhere)])
    out: list[tuple[int, int, int, int]] = []
    far, done = -1, np.cumsum(lens) - lens
    starts = range(len(runs))
    if not len(at_x) and not len(at_y) and len(runs) <= RUNS:
        # nothing repeats: from which runs a stretch may begin is seen at once
        mine, theirs = b - first[:, None], d - other[:, None]
        most = known[b] - known[first][:, None]
        may = (np.maximum(mine, theirs) >= least) & (most * DEN >= NUM * (mine + theirs - most))
        starts = np.flatnonzero(np.triu(may).any(1)).tolist()
    for s in starts:
        a, c = int(first[s]), int(other[s])
        t = np.arange(max(s, far + 1), len(runs))
        t = t[np.maximum(b[t] - a, d[t] - c) >= least]
        if not len(t):
            if far == len(runs) - 1:
                break
            continue
        mine, theirs = at_x[was_x >= a], at_y[was_y >= c]
        both = b[t] - a - np.searchsorted(mine, b[t]) + d[t] - c - np.searchsorted(theirs, d[t])
        # what they have in common: at least what is aligned, at most what occurs anywhere between the ends
        upto = done[t] + lens[t]
        low = upto - done[s] - np.searchsorted(at_m[was_m >= a], upto)
        high = known[b[t]] - known[a] - np.searchsorted(mine[elsewhere[mine]], b[t])
        for k in np.flatnonzero(high * DEN >= NUM * (both - high))[::-1].tolist():
            common, e, f = int(low[k]), int(b[t[k]]), int(d[t[k]])
            if common * DEN < NUM * (int(both[k]) - common):
                common = len(np.intersect1d(x[a:e], y[c:f]))
            if common * DEN >= NUM * (int(both[k]) - common):
                out.append((a + x0, e + x0, c + y0, f + y0))
                far = int(t[k])
                break
    return out


WIDTH = 2 * SIGHT + SEED - SHINGLE + 1
#: Occurrences of which what they have in common is one product of matrices, and rows of it at once.
FEW, ROWS = 128, 256


class _Contexts:
    """The shingles of documents as numbers, end to end, and what lies within SIGHT of places in them."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        flat = np.concatenate(grams)
        self.sizes = np.array([len(g) for g in grams])
        self.base = np.cumsum(self.sizes) - self.sizes
        doc = np.repeat(np.arange(len(grams)), self.sizes)
        order = np.argsort(flat, kind="stable")
        by, doc = flat[order], doc[order]
        new = np.ones(len(flat), bool)
        new[1:] = by[1:] != by[:-1]
        number = np.cumsum(new) - 1
        #: What stands for places outside of a document.
        self.none = int(number[-1]) + 1 if len(flat) else 0
        self.ids = np.full(len(flat) + 1, self.none)
        self.ids[order] = number
        #: The place of the last equal shingle before in the document, or -1.
        self.last = np.full(len(flat) + 1, -1)
        again = np.flatnonzero(~new[1:] & (doc[1:] == doc[:-1])) + 1
        self.last[order[again]] = order[again - 1]
        once = np.ones(len(flat), bool)
        once[again] = False
        #: Whether several documents have the shingle.
        self.shared = np.append(np.bincount(number[once], minlength=self.none) > 1, False)

    def of(self, doc: int) -> np.ndarray:
        return self.ids[self.base[doc] : self.base[doc] + self.sizes[doc]]

    def around(self, who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each place: the numbers within SIGHT, which of them are the first of their kind there, and which places are inside the document."""
        place = (at - SIGHT)[:, None] + np.arange(WIDTH)
        inside = (place >= 0) & (place < self.sizes[who][:, None])
        place = np.where(inside, place + self.base[who][:, None], len(self.ids) - 1)
        first = self.last[place] < (self.base[who] + np.maximum(at - SIGHT, 0))[:, None]
        return self.ids[place], first, inside


def common_shingles(value: np.ndarray, line: np.ndarray, m: int, rows: np.ndarray) -> np.ndarray:
    """(value, line), each once and sorted by value, every value in several of m lines: how many values each of rows has in common with every line, a row for each."""
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    value = np.cumsum(new) - 1
    held = np.bincount(value)
    # frequent ones are laid out as columns of a matrix, the others as lists
    hot = held > (max(8, m // 8) if m > FEW else 0)
    col = np.cumsum(hot) - 1
    dense = np.zeros((m, int(hot.sum())), np.float32)
    h = hot[value]
    dense[line[h], col[value[h]]] = 1
    out = (dense[rows] @ dense.T).astype(np.int64)
    if h.all():
        return out
    value, line = value[~h], line[~h]
    at = np.searchsorted(value, np.arange(len(held) + 1))
    order = np.argsort(line, kind="stable")
    mine, cut = value[order], np.searchsorted(line[order], np.arange(m + 1))
    for i, r in enumerate(rows.tolist()):
        lists = [line[at[v] : at[v + 1]] for v in mine[cut[r] : cut[r + 1]].tolist()]
        if lists:
            out[i] += np.bincount(np.concatenate(lists), minlength=m)
    return out


def can_be_similar(match: np.ndarray, first: np.ndarray, inside: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """For each context (row) 2 if a stretch of 46 shingles or more over its middle could be a passage's part, if it has in common what match says; 1 if a shorter one could.

    Each common shingle adds a fifth, each other one takes four (once, if it repeats), and each change between common ones takes four of the other
    side's shingles, where shingles don't repeat (apart). Of two stretches one has 46 shingles, the other 37 at least. Never less than what is so.
    """
    # in fifths
    one = np.int16(1)
    w = match * (5 * one) - (match | first) * (4 * one)
    w[:, 1:] -= (match[:, :-1] & ~match[:, 1:] & apart[:, None]) * (16 * one)
    w -= ~inside * (5 * WIDTH * one)
    total = np.zeros((len(w), WIDTH + 1), np.int32)
    np.cumsum(w, axis=1, dtype=np.int32, out=total[:, 1:])
    over = SIGHT + SEED - SHINGLE + 1  # the first end behind the middle
    best = np.maximum.accumulate(total[:, :over - 1 : -1], axis=1)[:, ::-1]
    grade = np.zeros(len(w), np.int64)
    for least in (COMMON, PASSAGE - SHINGLE + 1):
        near = over - least  # from the beginnings up to here any end behind the middle is far enough
        grade += (best[:, 0] >= total[:, : near + 1].min(1)) | (best[:, 1 : SIGHT - near + 1] >= total[:, near + 1 : SIGHT + 1]).any(1)
    return grade


class _Covered:
    """Stretches found so far, by document."""

    def __init__(self) -> None:
        self.rows: dict[int, list[tuple[int, int]]] = {}

    def has(self, doc: int, place: int) -> bool:
        return any(a <= place and place + SEED <= b for a, b in self.rows.get(doc, ()))

    def add(self, doc: int, first: int, end: int) -> None:
        mine = [r for r in self.rows.get(doc, []) if not (first <= r[0] and r[1] <= end)]
        self.rows[doc] = mine if any(a <= first and end <= b for a, b in mine) else [*mine, (first, end)]


def passages(docs: list[np.ndarray], occurrences: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], blocks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, first word, end, partner) of the passages of documents (narrow word hashes) through free seeds.

    occurrences: (key, document, place, free). Of two different blocks only pairs across them are looked at.
    """
    key, of, place, free = occurrences
    order = np.lexsort((place, of, key))
    key, of, place, free = key[order], of[order], place[order], free[order]
    both = len(np.unique(blocks)) > 1
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    covered, out = _Covered(), []
    failed: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # of two documents and a distance: runs that are in no passage of both
    text = _Contexts(_shingles_of(docs))
    often, column = np.zeros(text.none + 1, bool), np.full(text.none + 1, -1, np.int64)
    for start, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        who, at = of[start:end], place[start:end]
        side = blocks[who]
        if who[0] == who[-1] or both and (side == side[0]).all():
            continue
        todo = np.array([k for k in np.flatnonzero(free[start:end]).tolist() if not covered.has(int(who[k]), int(at[k]))], np.int64)
        if not len(todo):
            continue
        ids, first, inside = text.around(who, at)
        apart = (first | ~inside).all(1)
        at_shared = (first & text.shared[ids]).ravel().nonzero()[0]
        held = ids.ravel()[at_shared] << 32 | at_shared // WIDTH
        held.sort()
        value, line = held >> 32, held & 0xFFFFFFFF
        same = value[1:] == value[:-1]
        several = np.append(same, False) | np.append(False, same)
        value, line = value[several], line[several]
        # who has fewer than COMMON has not so many in common with anybody
        enough = np.bincount(line, minlength=len(who)) >= COMMON
        todo = todo[enough[todo]]
        if not len(todo) or enough.sum() < 2:
            continue
        told, left = value, enough[line]
        value, line = value[left], line[left]
        for lo in range(0, len(todo), ROWS):
            rows = todo[lo : lo + ROWS]
            common = common_shingles(value, line, len(who), rows)
            ok = (common >= COMMON) & (who != who[rows][:, None])
            if both:
                ok &= side != side[rows][:, None]
            maybe = np.flatnonzero(ok.any(1))
            if not len(maybe):
                continue
            mid = rows[maybe]
            often[told] = True
            some = often[ids[mid]]
            often[told] = False
            maybe = maybe[can_be_similar(some, first[mid], inside[mid], apart[mid]) > 0]
            for r in maybe.tolist():
                k = int(rows[r])
                if covered.has(int(who[k]), int(at[k])):
                    continue
                near = np.flatnonzero(ok[r])
                near = near[np.argsort(-common[r, near], kind="stable")]
                mine = ids[k][first[k] & inside[k]]
                column[mine] = np.arange(len(mine))
                _partners(text, k, near, who, at, (ids, first, inside, apart), column, len(mine), covered, failed, out)
                column[mine] = -1
    return out


def _partners(text: _Contexts, k: int, near: np.ndarray, who: np.ndarray, at: np.ndarray, contexts: tuple, column: np.ndarray, n: int, covered: _Covered, failed: dict, out: list) -> None:
    """Occurrence k is compared with those near it, in order, until it lies in a passage. column: which of its n distinct shingles a number is, or -1."""
    ids, first, inside, apart = contexts
    u, i = int(who[k]), int(at[k])
    back = column[ids[k]]
    # the first ones mostly are enough
    for part in np.split(near, np.arange(AHEAD, len(near), 64)) if len(near) > AHEAD else [near]:
        met = column[ids[part]]
        rows, places = np.nonzero(met >= 0)
        has = np.zeros((len(part), n + 1), bool)  # the last column: outside of the document
        has[rows, met[rows, places]] = True
        wide = np.repeat(k, len(part))
        grade = can_be_similar(has[:, back], first[wide], inside[wide], apart[wide])
        part, met, grade = part[grade > 0], met[grade > 0], grade[grade > 0]
        theirs = can_be_similar(met >= 0, first[part], inside[part], apart[part])
        for m in part[(theirs > 0) & (grade + theirs > 2)].tolist():
            v, j = int(who[m]), int(at[m])
            pair, at_low = ((u, v, j - i), i) if u < v else ((v, u, i - j), j)
            if any(p <= at_low < q for p, q in failed.get(pair, ())):
                continue
            # a passage through the seed has a part within sight, over the seed, that is one
            mid, gu, gv = min(i, SIGHT), text.of(u), text.of(v)
            x, y = gu[max(0, i - SIGHT) : i + SIGHT], gv[max(0, j - SIGHT) : j + SIGHT]
            runs = runs_around(x, y, mid, min(j, SIGHT))
            found = similar(x, y, runs)
            if not any(a <= mid < b for a, b, _, _ in found):
                p, q = next((p, q) for p, _, q in runs if p <= mid < p + q)
                failed.setdefault(pair, []).append((at_low - mid + p, at_low - mid + p + q))
                continue
            if len(x) < len(gu) or len(y) < len(gv):
                found = similar(gu, gv, runs_around(gu, gv, i, j))
            for a, b, c, d in found:
                for row in _long_enough((u, a, b, v), (v, c, d, u)):
                    covered.add(*row[:3])
                    out.append(row)
            if covered.has(u, i):
                return


def _verify(group: pa.Table) -> pa.Table:
    group = group.sort_by("node").combine_chunks()
    lists = group.column("words").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    seen = group.column("seen").combine_chunks()
    n = np.diff(seen.offsets.to_numpy())
    rows = seen.flatten()
    key, place, free = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    doc = np.repeat(np.arange(len(n)), n)
    found = passages([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], (key, doc, place, free), group.column("block").to_numpy())
    node = group.column("node").to_pylist()
    return pa.Table.from_batches([_found([(node[d], a, b, node[p]) for d, a, b, p in found])])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, those that overlap put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [merged([(r["first"], r["end"]) for r in p]) for p in batch.column(1).to_pylist()]
        rows = [[{"first": a, "end": b} for a, b in s] for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), batch.column(2)], names=["node", "spans", "partner"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, spans (array of first word and end), partner_id (a document with one of them)."""
    spark = docs.sparkSession
    ship(spark)
    one = docs.agg(F.count("*") == F.countDistinct("doc_id")).first()[0]
    # where doc_id names a row it is the documents' key; else doc_id and text are
    key = F.col("doc_id") if one else F.struct("doc_id", F.xxhash64("doc_id", "text").alias("x"))
    named = docs.select("doc_id", "text", key.alias("doc"))
    of = (lambda c: F.col(c)) if one else (lambda c: F.col(f"{c}.doc_id"))
    doc_type = named.schema["doc"].dataType.simpleString()
    seen = written(named.select("doc", "text").mapInArrow(_signed, f"doc {doc_type}, n_words long, d1 long, d2 long, keys array<long>"), "windows")
    nodes = seen.groupBy("d1", "d2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("n_words").alias("n"), F.first("keys").alias("keys"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    member = nodes.select("node", F.explode("keys").alias("key"))
    # written, so that the join below deals plain tables and Spark can split a key of very many nodes
    shared = written(member.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("top > b").select("key"), "shared")
    want = member.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))  # a document's own seeds
    want = written(want.join(nodes.select("node", "low"), "node").select("node", "keys", F.col("low").alias("_low")), "wanted")
    texts = named.join(want, F.col("doc") == F.col("_low")).select("node", "text", "keys")
    places = texts.mapInArrow(_places, "node long, words array<int>, keys array<long>, places array<int>, p array<int>, h array<long>")
    places = written(places if one else places.dropDuplicates(["node"]), "places")

    # exact passages
    window = places.select("node", F.explode(F.arrays_zip("p", "h")).alias("w")).select("node", "w.p", "w.h")
    twice = written(window.groupBy("h").agg(F.min("node").alias("b"), F.max("node").alias("t")).where("b < t"), "windows")
    met = window.join(twice, "h").select("node", F.struct("p", F.when(F.col("node") == F.col("b"), F.col("t")).otherwise(F.col("b")).alias("other")).alias("w"))
    exact = met.groupBy("node").agg(F.collect_list("w").alias("w"))  # a document's own windows
    exact = exact.mapInArrow(_exact, "node long, spans array<struct<first:long,end:long>>, pairs array<struct<other:long,at:array<long>>>")
    exact = written(exact, "exact")
    pairs = exact.select("node", F.explode("pairs").alias("x")).select("node", "x.at", "x.other")
    words = places.select("node", "words")
    pairs = pairs.join(words, "node").join(words.select(F.col("node").alias("other"), F.col("words").alias("others")), "other")
    row = "node long, first long, end long, partner long"
    spread = written(pairs.select("node", "at", "words", "other", "others").mapInArrow(_spread, row).distinct(), "spread")
    plain = exact.select("node", F.explode("spans").alias("s"), F.col("pairs")[0]["other"].alias("partner")).select("node", "s.first", "s.end", "partner")
    sure = plain.unionByName(spread)

    # near passages through the shared seeds that are left
    stretch = F.collect_set(F.struct("first", "end"))
    left = places.select("node", "keys", "places", "words").join(sure.groupBy("node").agg(stretch.alias("spans")), "node", "left")
    left = written(left.mapInArrow(_free, "node long, key long, place long, free boolean, behind long"), "seeds")
    open_ = left.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("t"), F.max("free").alias("free"), F.min("behind").alias("x"), F.max("behind").alias("y"))
    open_ = written(open_.where("free and b < t and x < y").select("key", "b"), "open")
    seen_at = left.join(open_, "key")
    edges = seen_at.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    cluster = written(components(edges, "clusters"), "cluster")
    sized = seen_at.groupBy("node").agg(F.collect_list(F.struct("key", "place", "free")).alias("seen")).join(cluster, "node").join(words, "node")
    sized = written(sized, "clustered")
    size = F.sum(F.size("words"))
    g = sized.groupBy("root").agg(F.ceil(F.least(size / SMALL_BLOCK, SPREAD + size / BLOCK_WORDS)).cast("int").alias("g"))
    sets = sized.join(g, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    sets = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    sets = sets.select("root", F.least("block", "o").alias("bp"), F.greatest("block", "o").alias("bq"), "node", "block", "words", "seen")
    # dealt by block and in full number: after a join on root Spark would leave all blocks of a cluster in one task, and it would put tasks of few bytes and much work together
    sets = sets.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "bp", "bq")
    near = sets.groupBy("root", "bp", "bq").applyInArrow(_verify, row)

    rows = sure.unionByName(near).join(nodes.select(F.col("node").alias("partner"), F.col("low").alias("partner_low")), "partner")
    spans = rows.groupBy("node").agg(stretch.alias("spans"), F.min("partner_low").alias("partner"))
    spans = spans.mapInArrow(_merge, f"node long, spans array<struct<first:long,end:long>>, partner {doc_type}")

    # documents of equal words are repeated as a whole
    found = nodes.drop("keys").join(spans, "node", "left")
    whole = (F.col("low") != F.col("high")) & (F.col("n") >= PASSAGE)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    found = found.select("d1", "d2", "low", "high", whole.alias("whole"), F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"), "partner")
    out = seen.drop("keys").join(written(found, "found"), ["d1", "d2"])
    partner = F.when(F.col("whole"), F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low"))).otherwise(F.col("partner"))
    for x in (shared, want, places, twice, exact, spread, left, open_, cluster, sized):
        drop_written(x)
    return out.withColumn("partner", partner).select(of("doc").alias("doc_id"), "n_words", "spans", of("partner").alias("partner_id"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_passages, n_repeated (words in them), partner_id, repeated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return repeated_passages(docs).select(
        "doc_id", "n_words", F.size("spans").cast("long").alias("n_passages"), words.alias("n_repeated"), "partner_id", (F.size("spans") > 0).alias("repeated")
    )
