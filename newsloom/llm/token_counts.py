"""Token counts of a byte-level BPE by a compiled finite-state tokenizer.

The splitting pattern of the tokenizer is compiled into a deterministic transducer: its input symbols are character
classes with one character of look-ahead, its transitions say whether a piece begins. Texts are cut into chunks of
CHUNK characters; the state map of every chunk (where each state leads) is found for all chunks in lockstep, the maps
are composed by a parallel prefix scan, and a second lockstep pass from the now known states marks the pieces. A piece's emitted
tokens come from the merge table, run for all new distinct pieces at once; counts of pieces seen before are kept in the worker
(at most KEPT pieces, then it starts afresh: nothing depends on it but time).

Defined results: text null or empty has 0 bytes and 0 tokens; the tokenizer's special string inside a text is one token, as
its library reads it by default; bytes that are not UTF-8 count as U+FFFD; rows with equal doc_id are apart.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import textops
from newsloom.llm._shared import ship

CHUNK = 64
KEPT = 2_000_000
U = np.uint64

# classes of characters
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
#: What \\s is to the tokenizer's pattern, besides the space. (fixed values: Unicode White_Space)
WHITE_POINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# input symbols of the transducer
(S_PAD, S_OTHER, S_LETTER, S_NUMBER, S_WHITE_ON, S_WHITE_LAST, S_SPACE_ON, S_SPACE_LAST, S_APO1, S_APO2, S_APO, S_SHORT) = range(12)
# states: what the last character was
(Q_START, Q_LETTER, Q_NUMBER, Q_OTHER, Q_WHITE, Q_SPACE, Q_APO1, Q_APO2, Q_INSIDE) = range(9)


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol].

    Symbols tell apart: white space followed by more (ON: or by the end) and the last before other text (LAST); an apostrophe with a
    contraction of one letter (APO1) or two (APO2) behind it. A contraction counts only where its apostrophe begins a piece.
    """
    q, s = 9, 12
    nxt, begins = np.zeros((q, s), np.int8), np.zeros((q, s), bool)
    plain = {S_OTHER: Q_OTHER, S_LETTER: Q_LETTER, S_SHORT: Q_LETTER, S_NUMBER: Q_NUMBER, S_APO: Q_OTHER}
    for state in range(q):
        nxt[state, S_PAD] = state
        for sym in range(1, s):
            if state in (Q_APO1, Q_APO2):  # the contraction's letters belong to its piece
                nxt[state, sym] = Q_START if state == Q_APO1 else Q_APO1
                continue
            if sym in (S_WHITE_ON, S_WHITE_LAST, S_SPACE_ON, S_SPACE_LAST):
                last = sym in (S_WHITE_LAST, S_SPACE_LAST)
                begins[state, sym] = last or state != Q_WHITE
                nxt[state, sym] = Q_SPACE if sym == S_SPACE_LAST else Q_START if sym == S_WHITE_LAST else Q_WHITE
                continue
            if sym in (S_APO1, S_APO2):
                if state in (Q_OTHER, Q_SPACE):  # in the middle of, or behind a space: an ordinary sign
                    begins[state, sym], nxt[state, sym] = False, Q_OTHER
                else:
                    begins[state, sym], nxt[state, sym] = True, Q_APO1 if sym == S_APO1 else Q_APO2
                continue
            to = plain[sym]
            nxt[state, sym] = to
            begins[state, sym] = state != Q_SPACE and state != to
    return nxt, begins


NEXT, BEGINS = transducer()


def classes() -> np.ndarray:
    """The class of every code point."""
    kept = _memory()
    if not hasattr(kept, "classes"):
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        table[list(WHITE_POINTS)] = WHITE
        table[0x20] = SPACE
        kept.classes = table
        kept.codes = textops.mix(np.arange(1, 0x110001, dtype=U) * U(0x9E3779B97F4A7C15))
    return kept.classes


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Input symbols of code points; last: which are the last of their text."""
    c = classes()[points]
    white = c >= WHITE
    after = np.zeros(len(c), bool)  # text that is not white space follows
    after[:-1] = ~white[1:]
    after[last] = False
    sym = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE_ON, S_SPACE_ON], np.uint8)[c]
    sym[white & after] += 1
    apo = np.flatnonzero(points == 0x27)
    if len(apo):
        n = len(points)
        p = np.concatenate([points, [0, 0]])
        end = np.concatenate([last, [True, True]])
        one = np.where(end[apo], 0, p[apo + 1])
        two = np.where(end[apo] | end[np.minimum(apo + 1, n)], 0, p[apo + 2])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        sym[apo] = np.where(short, S_APO1, np.where(long_, S_APO2, S_APO))
    return sym


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the concatenated texts; offsets: of the texts, in characters."""
    n, lens = len(points), np.diff(offsets)
    if not n:
        return np.zeros(0, np.int64)
    last = np.zeros(n, bool)
    last[offsets[1:][lens > 0] - 1] = True
    sym = symbols(points, last)
    chunks = -(-lens // CHUNK)
    total = int(chunks.sum())
    text = np.repeat(np.arange(len(lens)), chunks)
    nth = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = offsets[:-1][text] + nth * CHUNK
    size = np.minimum(offsets[1:][text] - begin, CHUNK)
    at = begin[:, None] + np.arange(CHUNK)
    grid = np.where(np.arange(CHUNK) < size[:, None], sym[np.minimum(at, n - 1)], S_PAD).T.copy()
    maps = np.tile(np.arange(9, dtype=np.int8), (total, 1))
    for t in range(CHUNK):
        maps = NEXT[maps, grid[t][:, None]]
    # a text's first chunk is entered in the start state whatever came before: its map is constant, which ends the scan there
    maps[nth == 0] = maps[nth == 0][:, [Q_START] * 9]
    step = 1
    while step < int(chunks.max()):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    state = np.empty(total, np.int8)
    state[1:] = maps[:-1, 0]
    state[nth == 0] = Q_START
    out = np.zeros((CHUNK, total), bool)
    for t in range(CHUNK):
        out[t] = BEGINS[state, grid[t]]
        state = NEXT[state, grid[t]]
    flags = out.T
    return np.sort(at[flags])


class Merges:
    """The tokenizer's merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        vocab, merges = t["model"]["vocab"], t["model"]["merges"]
        self.special = [x["content"] for x in t["added_tokens"]]
        # a byte's printable stand-in: itself where printable, else the next free code point from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        stand = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte = np.array([vocab[stand[b]] for b in range(256)], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.to = key[order], order, to[order]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each piece (bytes, offsets). In each round every piece applies its lowest-ranked merge wherever it has it."""
        result = np.diff(offsets)
        row = np.repeat(np.arange(len(result)), result)
        s = self.byte[data]
        none = np.iinfo(np.int64).max
        while len(s):
            key = s[:-1] << 20 | s[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[at] == key) & (row[:-1] == row[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(rank, begin)
            lens = np.diff(np.append(begin, len(row)))
            over = least == none
            result[row[begin[over]]] = lens[over]
            go = np.repeat(~over, lens)
            hit = (rank == np.repeat(least, lens)) & go
            # a run of overlapping pairs (one symbol repeated) merges its first, third, ...
            idx = np.arange(len(s))
            before = np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(hit & ~before, idx, 0))
            hit &= (idx - run) % 2 == 0
            i = np.flatnonzero(hit)
            s[i] = self.to[at[i]]
            go[i + 1] = False
            s, row = s[go], row[go]
        return result


def _memory() -> types.ModuleType:
    """What a worker keeps between tasks."""
    return sys.modules.setdefault("_newsloom_token_memory", types.ModuleType("_newsloom_token_memory"))


def counted(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text (UTF-8 bytes, offsets)."""
    kept = _memory()
    if getattr(kept, "path", None) != path:
        kept.merges, kept.path = Merges(path), path
        kept.hashes, kept.counts = np.zeros(0, U), np.zeros(0, np.int32)
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        text = raw.decode("utf-8")
    result = np.zeros(len(offsets) - 1, np.int64)
    owner = np.arange(len(offsets) - 1)
    bounds = offsets
    special = np.zeros(len(owner), bool)
    found = [m.span() for x in kept.merges.special for m in re.finditer(re.escape(x.encode()), raw)]
    found = [(a, b) for a, b in found if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")]
    if found:  # the string is a text of its own between two others
        bounds = np.unique(np.concatenate([offsets, np.array(found).ravel()]))
        owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
        special = np.isin(bounds[:-1], [a for a, _ in found])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    char_offsets = np.searchsorted(byte_at, bounds)
    starts = piece_starts(points, char_offsets)
    if len(starts):
        ends = np.append(starts[1:], len(points))
        h = textops.span_hashes(points, starts, ends, table=kept.codes)
        seen, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(kept.hashes, seen)
        old = np.zeros(len(seen), bool)
        if len(kept.hashes):
            old = kept.hashes[np.minimum(at, len(kept.hashes) - 1)] == seen
        n = np.zeros(len(seen), np.int64)
        n[old] = kept.counts[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            a, b = byte_at[starts[first[new]]], byte_at[ends[first[new]]]
            lens = b - a
            off = np.concatenate([[0], np.cumsum(lens)])
            flat = data[np.arange(off[-1]) - np.repeat(off[:-1], lens) + np.repeat(a, lens)]
            n[new] = kept.merges.counts(flat, off)
            if len(kept.hashes) + len(new) > KEPT:
                kept.hashes, kept.counts = seen, n.astype(np.int32)
            else:
                kept.hashes = np.insert(kept.hashes, at[new], seen[new])
                kept.counts = np.insert(kept.counts, at[new], n[new].astype(np.int32))
        seg = np.searchsorted(char_offsets, starts, "right") - 1
        per = np.bincount(seg, n[inverse], len(owner)).astype(np.int64)
        per[special] = 1
        result += np.bincount(owner, per, len(result)).astype(np.int64)
    return result


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, off in textops.passes(batch.column(1)):
                n = counted(data, off, path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), textops.longs(np.diff(off)), textops.longs(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_tokens. path: a byte-level BPE file that every executor has at that place."""
    ship(docs.sparkSession)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_count(path or vocabulary()), f"doc_id {kind}, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > 512)
