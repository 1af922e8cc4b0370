"""Texts as numpy arrays: words of many texts found and hashed without a Python loop over words or characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one pass takes at most (a longer text is a pass of its own).
PASS_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (public domain, Steele et al. 2014)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Values of a span that are taken in step with other spans'.
LONG = 64
MULTIPLIER = U(0x9E3779B97F4A7C55)
#: What each byte stands for in a hash: 64 pseudo-random bits.
BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def separators(kind: str) -> np.ndarray:
    """Table of the bytes between words. space: \\x20 and \\x09-\\x0D; alnum: ASCII other than digits and letters."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        for a, b in ("09", "az", "AZ"):
            table[ord(a) : ord(b) + 1] = False
    return table


def passes(texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and how many words each text has."""
    n = len(data)
    # one separator is put between texts, so that no word spans two
    is_word = np.zeros(n + 2, bool)
    is_word[1:-1] = ~sep[data]
    edge = is_word[1:] != is_word[:-1]
    starts = np.flatnonzero(edge & is_word[1:])
    ends = np.flatnonzero(edge & ~is_word[1:])
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < n)]
    inner = inner[is_word[inner] & is_word[inner + 1]]  # a word runs over the end of a text
    if len(inner):
        starts = np.sort(np.concatenate([starts, inner]))
        ends = np.sort(np.concatenate([ends, inner]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span; the spans are in order, not empty and don't overlap. fold: A-Z count as a-z.

    table: what each value of data stands for, if data are not bytes.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, U)
    if table is None:
        table = BYTE_CODE[FOLD] if fold else BYTE_CODE
    lens = ends - starts
    # spans by length, longest first: the k-th step takes the k-th value of the first spans[k] of them
    order = np.argsort((np.iinfo(np.uint16).max - np.minimum(lens, np.iinfo(np.uint16).max)).astype(np.uint16), kind="stable")
    at, size = starts[order], np.minimum(lens[order], LONG)
    h = np.zeros(n, U)
    for k, m in enumerate(np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist()):
        x = h[:m]
        x *= MULTIPLIER
        x += table[data[at[:m] + k]]
    for i in range(int(np.searchsorted(-lens[order], -LONG, "left"))):  # the few that are longer
        a, b = int(at[i]) + LONG, int(at[i] + lens[order[i]])
        while a < b:
            part = table[data[a : min(b, a + PASS_BYTES)]]
            power = np.full(len(part), MULTIPLIER, U)
            power[0] = 1
            power = np.multiply.accumulate(power)
            h[i] = mix(h[i : i + 1] * MULTIPLIER + (part * power).sum())[0]
            a += len(part)
    out = np.empty(n, U)
    out[order] = h
    return mix(out + lens.astype(U))


def grams(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words, and how many each text has (of a shorter text, none)."""
    n = len(hashes)
    per = np.maximum(counts - k + 1, 0)
    if n < k:
        return np.zeros(0, U), per
    out = np.zeros(n - k + 1, U)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + hashes[i : n - k + 1 + i]
    first = np.cumsum(counts) - counts
    keep = np.repeat(first, per) + (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
    return mix(out[keep]), per


def gram_sets(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct k-gram hashes of each text, how many each has, and its words. Fewer words than k are one gram."""
    starts, ends, counts = words(data, offsets, sep)
    hashes = span_hashes(data, starts, ends)
    g, per = grams(hashes, counts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = per.copy()
    whole[short] = 1
    begin = np.cumsum(whole) - whole
    out = np.empty(int(whole.sum()), U)
    out[np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(len(g))] = g
    if len(short):
        first = np.cumsum(counts) - counts
        value = np.zeros(len(short), U)
        for i in range(k - 1):
            has = counts[short] > i
            value[has] = value[has] * U(0xD6E8FEB86659FD93) + hashes[first[short[has]] + i]
        out[begin[short]] = mix(value + counts[short].astype(U) * U(0xA0761D6478BD642F))
    for a, b in zip(begin.tolist(), (begin + whole).tolist(), strict=True):
        out[a:b].sort()
    row = np.repeat(np.arange(len(counts)), whole)
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        out, row = out[new], row[new]
    return out, np.bincount(row, minlength=len(counts)), counts


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def long_lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), longs(flat))
