"""Token ids in files: frequency-ranked, byte-aligned variable-length numbers with separate control bytes, decoded by table lookup.

Ids are counted over the whole corpus and ranked, most frequent first; a rank is written in as many bytes (1 to 4) as it needs, and the
lengths stand apart, two bits each, four to a control byte (Stream VByte; Lemire, Kurz and Rupp 2018). A reader takes all control bytes
of a group of documents at once: one table has the bytes that each of the 256 control bytes stands for, another where each of its 16
output bytes lies among them, so numpy gathers every rank without a loop over ids.

Layout of a folder: `ranks` (ids by rank, 32 bits each), one file for each shard of ascending doc_ids, and `manifest.json`, which is put in
place last and names the files that belong to it. A file is groups of at most GROUP ids (a longer document is a group of its own): control
bytes, data bytes; behind them an index of its documents and where its groups lie. Files are written by tasks through a
Python data source: an attempt writes a file under a name of its own, and only those that the driver's commit gets are in the manifest, so a lost
executor or a second attempt leaves nothing that a reader sees.

Scale: texts are tokenized once, in tasks; only their ids are shuffled, to shards whose bounds come from a range partitioning of
(doc_id, hash) alone; ids pass through unranked files of the same layout (two bytes an id, compressed) while they are counted. The driver holds a
count an id of the vocabulary and a line a shard. A task holds one group. Texts are cut where the tokenizer cuts them anyway (`pieces`); the pieces are
encoded by the tokenizer's library, each distinct one once in a pass of some MB, and kept in the worker, byte for byte (at most KEPT, then afresh:
nothing depends on it but time). `cuts_words` checks that the tokenizer's steps allow that; others take whole texts.

Defined results: text null counts as empty and has the end id alone; doc_id null sorts first; rows of equal doc_id go by a hash of the text, then by
their ids, and rows that repeat both are told apart by their place; bytes that aren't UTF-8 count as U+FFFD; an empty table gives a folder without shards and no rows; further columns are ignored.
Rows that repeat both doc_id and text are in one shard, whatever their number.
"""

from __future__ import annotations

import bisect
import io
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from newsloom.llm import textops
from newsloom.llm._shared import drop_written, ship, written
from newsloom.operators.tables import delete, shared_dir

END = 2
#: Ids in a group of a file.
GROUP = 1 << 20
#: Bytes of text for a shard.
SHARD = 256 << 20
#: Bytes of text that a worker tokenizes at a time, distinct pieces that it keeps (some 200 bytes each), and pieces that the library gets at a time.
PASS, KEPT, ASKED = 4 << 20, 600_000, 4096
MAGIC = b"NLTOKEN1"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"

# for each control byte: the bytes of each of its four numbers, of all, and which data byte each output byte is (NONE: it is zero)
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
TOTAL = LENGTHS.sum(1)
HAS = (np.arange(4)[None, None, :] < LENGTHS[:, :, None]).reshape(256, 16).astype(np.uint8)
PLACE = np.where(HAS == 1, ((LENGTHS.cumsum(1) - LENGTHS)[:, :, None] + np.arange(4)).reshape(256, 16), 0)


def packed(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes; the last control byte's numbers that aren't there are zeros of a byte each."""
    r = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    r[: len(ranks)] = ranks
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    control = (code.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    return control, r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]


def unpacked(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers, by table lookup."""
    at = TOTAL[control].cumsum() - TOTAL[control]
    out = data.take(at[:, None] + PLACE[control]) if len(control) else np.zeros((0, 16), np.uint8)
    out *= HAS[control]
    return out.view("<u4").ravel()[:n]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, as executors reach it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def _put(uri: str, name: str, body: bytes) -> None:
    """A small file, whole or not at all."""
    store, path = _store(uri)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}.tmp") as f:
        f.write(body)
    store.move(f"{path}/{name}.tmp", f"{path}/{name}")


def _get(uri: str, name: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


@dataclass
class Written(WriterCommitMessage):
    shard: int
    file: str
    n_docs: int
    n_ids: int


class Writer(DataSourceArrowWriter):
    """Rows (doc_id, ids), in their order, to one file a task. width: bytes of an id in the rows; ranked: the folder's ranks are used."""

    def __init__(self, uri: str, width: int, ranked: bool) -> None:
        self.uri, self.width, self.ranked = uri, width, ranked

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get().partitionId()
        store, path = _store(self.uri)
        rank = None
        if self.ranked:
            by_rank = np.frombuffer(_get(self.uri, "ranks"), "<u4")
            rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
            rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        name, out, groups, index = f"shard-{task:06d}-{uuid.uuid4().hex}", None, [], []
        held, size = [], 0

        def close_group() -> None:
            nonlocal held, size
            if held:
                groups.append(_write_group(out, held, rank, self.width))
                index.append((np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])))
            held, size = [], 0

        for batch in iterator:
            for at, data, off in textops.passes(batch.column("ids"), 4 * GROUP):
                n = np.diff(off) // self.width
                if out is None:
                    store.create_dir(path)
                    out = store.open_output_stream(f"{path}/{name}")
                    out.write(MAGIC)
                ids = batch.column("doc_id").slice(at, len(n))
                if size and size + n.sum() > GROUP:
                    close_group()
                held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), n, bytes(data)))
                size += int(n.sum())
        if out is None:  # no rows, no file
            return Written(task, "", 0, 0)
        close_group()
        n = np.concatenate([i[2] for i in index])
        where = out.tell()
        body = io.BytesIO()
        np.savez_compressed(body, groups=np.array(groups, np.int64), doc_id=np.concatenate([i[0] for i in index]), valid=np.concatenate([i[1] for i in index]), n=n)
        out.write(body.getvalue())
        out.write(np.array([where, out.tell() - where], "<i8").tobytes() + MAGIC)
        out.close()
        return Written(task, name, len(n), int(n.sum()))

    def commit(self, messages: list[Written | None]) -> None:
        files = [[m.file, m.n_docs, m.n_ids] for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.shard)]
        _put(self.uri, "manifest.json", json.dumps({"ranked": self.ranked, "width": self.width, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.uri)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{path}/{m.file}")


def _write_group(out, held: list, rank: np.ndarray | None, width: int) -> tuple[int, int, int, int, int]:
    """Returns place, documents, ids and the bytes of both parts."""
    at, flat = out.tell(), np.frombuffer(b"".join(h[3] for h in held), f"<u{width}")
    if rank is None:
        parts = b"", pa.compress(flat.tobytes(), "zstd", asbytes=True)
    else:
        parts = tuple(x.tobytes() for x in packed(rank[flat]))
    for p in parts:
        out.write(p)
    return at, sum(len(h[0]) for h in held), len(flat), len(parts[0]), len(parts[1])


@dataclass
class Shard(InputPartition):
    file: str
    start: int


class Reader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri
        self.manifest = json.loads(_get(uri, "manifest.json"))

    def partitions(self) -> list[Shard]:
        start, out = 0, []
        for file, _, n_ids in self.manifest["files"]:
            out.append(Shard(file, start))
            start += n_ids
        return out or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, path = _store(self.uri)
        by_rank = np.frombuffer(_get(self.uri, "ranks"), "<u4") if self.manifest["ranked"] else None
        with store.open_input_file(f"{path}/{partition.file}") as f:
            end = f.size()
            where, size = np.frombuffer(f.read_at(16, end - 16 - len(MAGIC)), "<i8")
            index = np.load(io.BytesIO(f.read_at(int(size), int(where))))
            groups, doc_id, valid, n = (index[k] for k in ("groups", "doc_id", "valid", "n"))
            row, start = 0, partition.start
            for at, docs, ids, a, b in groups.tolist():
                body = f.read_at(a + b, at)
                if by_rank is None:
                    flat = np.frombuffer(pa.decompress(body, ids * self.manifest["width"], "zstd"), f"<u{self.manifest['width']}")
                else:
                    raw = np.frombuffer(body, np.uint8)
                    flat = by_rank[unpacked(raw[:a], raw[a:], ids)]
                many = n[row : row + docs]
                flat = np.ascontiguousarray(flat, "<u4")
                offsets = np.concatenate([[0], many.cumsum()])
                lists = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id[row : row + docs], mask=~valid[row : row + docs]), pa.array(start + offsets[:-1]), pa.array(many), lists], names=["doc_id", "start", "n_tokens", "ids"]
                )
                row, start = row + docs, start + ids


class TokenFiles(DataSource):
    """Format newsloom_tokens: save(folder) with the options width and ranked; load(folder) gives SCHEMA, a partition a shard, in order."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("width", 4)), self.options.get("ranked") == "true")


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def cuts_words(path: str) -> bool:
    """Whether the tokenizer drops white space, lower-cases, and takes runs of letters, single digits, runs of other characters and contractions apart.

    Then a text's ids are those of its pieces, one after the other.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern", {}).get("Regex") == PATTERN
    norm = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", [])]
    plain = all(not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in d.get("added_tokens", []))
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
    return apart and level and plain and "Lowercase" in norm and set(norm) <= {"NFC", "Replace", "Lowercase"}


#: (fixed value) the splitting pattern for which pieces() cuts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = np.arange(256)
ASCII_LETTER = (BYTES >= 65) & (BYTES <= 90) | (BYTES >= 97) & (BYTES <= 122)
ASCII_OTHER = (BYTES > 32) & (BYTES < 127) & ~ASCII_LETTER
SPACE = textops.separators("space")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (bytes, offsets) cut at ASCII white space, between a letter (ASCII, or U+00C0 to U+017F but for U+0130, whose lower case ends in a mark) and another ASCII character behind it,
    and between such a character other than the apostrophe and an ASCII letter behind it: bytes of all pieces with A-Z in lower case, lengths, pieces of each text.

    What holds a special token's beginning is cut at white space alone and keeps its case.
    """
    n = len(data)
    word = np.concatenate([~SPACE[data], [False]])
    letter, other = ASCII_LETTER[data], ASCII_OTHER[data]
    last = letter.copy()
    if n > 1:
        lead, tail = data[:-1], data[1:]
        last[1:] |= (lead >= 0xC3) & (lead <= 0xC5) & (tail >= 0x80) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (lead == 0xC4) & (tail == 0xB0))
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin[1:n] |= last[:-1] & other[1:] | other[:-1] & (data[:-1] != 0x27) & letter[1:]
    begin[offsets[:-1]] = word[offsets[:-1]]
    text = FOLDED[data]
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    for at in special.tolist():  # few texts have any
        i = int(np.searchsorted(offsets, at, "right")) - 1
        a, b = int(offsets[i]), int(offsets[i + 1])
        gap = np.flatnonzero(~word[a:at])
        a = a + int(gap[-1]) + 1 if len(gap) else a
        gap = np.flatnonzero(~word[at:b])
        b = at + int(gap[0]) if len(gap) else b
        begin[a + 1 : b] = False
        text[a:b] = data[a:b]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(word[:-1] & (begin | ~word)[1:]) + 1
    return text[word[:-1]], ends - starts, np.diff(np.searchsorted(starts, offsets))


FOLDED = BYTES.astype(np.uint8)
FOLDED[65:91] += 32


class Pieces:
    """Ids of pieces, as the library gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = _library(path)
        self.model = Tokenizer(self.library.model)  # without the steps before it, which leave a run of a-z as it is
        self.start_afresh()

    def start_afresh(self) -> None:
        self.place, self.flat, self.ends = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, found: pa.BinaryArray) -> np.ndarray:
        """Where each piece's ids are; self.ends has where they end, at the place plus one. found: distinct pieces, as bytes."""
        if len(self.place) + len(found) > KEPT:
            self.start_afresh()
        _, offsets, data = found.buffers()
        cut, raw = np.frombuffer(offsets, np.int32)[: len(found) + 1].tolist(), bytes(data)
        listed = [raw[a:b] for a, b in pairwise(cut)]
        at = np.array(list(map(self.place.get, listed, repeat(-1))), np.int64)
        new = [listed[i] for i in np.flatnonzero(at < 0).tolist()]
        plain = [x for x in new if x.isalpha() and x.islower()]  # of bytes: a-z alone
        rest = [x for x in new if not (x.isalpha() and x.islower())]
        flat, many = [self.flat], []
        for library, some in ((self.model, plain), (self.library, rest)):
            for k in range(0, len(some), ASKED):
                ids = [e.ids for e in library.encode_batch_fast([x.decode("utf-8", "replace") for x in some[k : k + ASKED]], add_special_tokens=False)]
                many += map(len, ids)
                flat.append(np.array(list(chain.from_iterable(ids)), np.uint32))
        if new:
            self.flat, self.ends = np.concatenate(flat), np.concatenate([self.ends, self.ends[-1] + np.cumsum(many)])
            self.place.update(zip(plain + rest, count(len(self.place))))
            at = np.array([self.place[x] for x in listed], np.int64)
        return at


def encoded(known: Pieces, data: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts (bytes, offsets), each text's followed by the end id, and how many each has."""
    text, lens, counts = pieces(data, offsets)
    ranges = np.concatenate([[0], lens.cumsum()]).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ranges), pa.py_buffer(text)]).dictionary_encode()
    at = known.places(each.dictionary)
    first, many = known.ends[at], known.ends[at + 1] - known.ends[at]
    which = np.asarray(each.indices) if len(lens) else np.zeros(0, np.int64)
    return _joined(known.flat, first[which], many[which], counts, end)


def _joined(flat: np.ndarray, first: np.ndarray, many: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """flat[first : first + many] of each piece, one after the other; counts: pieces of each text, behind which its end id is put."""
    before = np.concatenate([[0], many.cumsum()])
    per = np.diff(before[np.concatenate([[0], counts.cumsum()])]) + 1
    out = np.full(int(per.sum()), end, np.uint32)
    text = np.repeat(np.arange(len(counts)), counts)  # each piece's text: so many end ids stand before it
    out[np.arange(before[-1]) + np.repeat(text, many)] = flat[np.arange(before[-1]) + np.repeat(first - before[:-1], many)]
    return out, per


def _whole(library, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    ids = [e.ids for e in library.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
    many = np.array([len(i) for i in ids], np.int64)
    return _joined(np.array(list(chain.from_iterable(ids)), np.uint32), many.cumsum() - many, many, np.ones(len(ids), np.int64), end)


_kept: dict[str, Pieces] = {}


def _tokenize(path: str, cut: bool, bounds: list[tuple], width: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _kept:
            _kept[path] = Pieces(path)
        known = _kept[path]
        for batch in batches:
            for at, data, off in textops.passes(batch.column(2), PASS):
                ids, per = encoded(known, data, off, end) if cut else _whole(known.library, data, off, end)
                keys = batch.slice(at, len(per))
                shard = [bisect.bisect_left(bounds, (d is not None, d or 0, h)) for d, h in zip(keys.column(0).to_pylist(), keys.column(1).to_pylist(), strict=True)]
                ends = (np.concatenate([[0], per.cumsum()]) * width).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), keys.column(0), keys.column(1), lists], names=["shard", "doc_id", "h", "ids"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs among a task's rows."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for _, data, _ in textops.passes(b.column(0), 4 * GROUP):
            n = np.bincount(np.frombuffer(data.tobytes(), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["id", "n"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder in order: doc_id, start (ids before it), n_tokens and ids (little-endian, 32 bits each)."""
    ship(spark)
    spark.dataSource.register(TokenFiles)
    return spark.read.format("newsloom_tokens").load(folder)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shards: int | None = None) -> None:
    """docs (doc_id, text) to a folder of the shared file system, in ascending doc_id. path: the tokenizer's file, at the same place on every executor."""
    spark = docs.sparkSession
    ship(spark)
    spark.dataSource.register(TokenFiles)
    path = path or vocabulary()
    width = 2 if max(_library(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    keys = written(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("size")), "keys")
    size = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD))
    tops = keys.repartitionByRange(shards, "doc_id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()  # a row a shard
    bounds = sorted((r.top.doc_id is not None, r.top.doc_id or 0, r.top.h) for r in tops)[:-1]
    drop_written(keys)

    rows = docs.mapInArrow(_tokenize(path, cuts_words(path), bounds, width, end), "shard int, doc_id long, h long, ids binary")
    rows = rows.repartitionById(max(1, len(bounds) + 1), "shard").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")
    plain = f"{shared_dir(spark)}/newsloom/tokens-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")  # the shuffled ids aren't read again once the files are there
    try:
        rows.write.format("newsloom_tokens").option("width", width).mode("append").save(plain)
    finally:
        spark.conf.set(cleanup, before)
    raw = read_tokens(spark, plain)
    per = raw.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r.n, r.id) for r in per.collect()))  # a row an id of the vocabulary at most
    _put(folder, "ranks", np.array([i for _, i in ranked], "<u4").tobytes())
    raw.select("doc_id", "ids").write.format("newsloom_tokens").option("width", 4).option("ranked", "true").mode("append").save(folder)
    delete(spark, plain)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/newsloom/files-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
