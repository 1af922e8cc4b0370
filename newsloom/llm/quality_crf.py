"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes and shapes of its words, cut into ranges,
with the same of the line before and after it; adjacent labels have transition weights. Forward-backward gives each
line's probability of being good; their means, weighted by the lines' lengths, and the worst stretch aggregate into
the document's score through a two-parameter-per-summary logistic layer.

Training: documents' labels stand for their lines at first; then lines that the fitted field itself finds typical of good
documents inside bad ones are relabelled (hard EM, EM_ROUNDS rounds) and the field is fitted again. Only
SAMPLE labelled documents at most, those of the smallest hash of doc_id, are used, and of these in the same order as many whole texts as have
SAMPLE_LINES lines together: these bounds on labelled rows hold for fitting alone, and no text is cut; scoring reads every line of every text.

Never inputs of a score: labels, lang, source, doc_id. Defined results: text null or empty is one empty line; labels
null are ignored; of contradicting labels the smaller counts; of rows that share a labelled doc_id one trains (the smallest hash of its lines' features);
without labels of both kinds every score is 1; rows with equal doc_id are scored apart; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import textops
from newsloom.llm._shared import fresh, ship, written
from newsloom.llm.crf import fit_field, marginals

SAMPLE = 6_000
#: 72 bytes each in the driver.
SAMPLE_LINES = 1_000_000
EM_ROUNDS = 2

#: Character classes of a byte; bytes of other scripts' characters count as letters.
CLASSES = ("upper", "lower", "digit", "space", "stop", "mark", "other")
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 6]] = 5

RANGES = {
    "log_len": (2, 3, 4, 5, 6, 7),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digit": (0.001, 0.02, 0.06, 0.15, 0.4),
    "stop": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2),
    "mark": (0.001, 0.01, 0.03, 0.08, 0.2),
    "other": (0.001, 0.05, 0.15),
    "word_len": (2, 3, 4, 5, 6, 8, 12),
    "repeat": (0.01, 0.05, 0.1, 0.2, 0.4),
    "bigram_repeat": (0.01, 0.05, 0.1, 0.2, 0.4),
    "title": (0.05, 0.1, 0.2, 0.4, 0.7),
    "short": (0.05, 0.2, 0.35, 0.5, 0.7),
    "same_as_other": (0.5,),
}
WIDTH = sum(len(v) + 1 for v in RANGES.values())


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts as bytes: features of each line (columns as RANGES), its length in bytes, and how many lines a text has."""
    n = len(data)
    breaks = np.flatnonzero(data == 10) + 1
    # an empty text still has one line; a line break at the very end begins no line
    first_break = np.searchsorted(breaks, offsets[:-1], "right")
    last_break = np.searchsorted(breaks, offsets[1:], "left")
    per = 1 + np.maximum(last_break - first_break, 0)
    total = int(per.sum())
    starts = np.empty(total, np.int64)
    at = np.cumsum(per) - per
    place = np.arange(total) - np.repeat(at, per)
    starts[place == 0] = offsets[:-1]
    rest = place > 0
    starts[rest] = breaks[np.repeat(first_break, per)[rest] + place[rest] - 1]
    ends = np.empty(total, np.int64)
    ends[:-1] = starts[1:]
    ends[at + per - 1] = offsets[1:]
    lens = ends - starts

    cls = _CLASS[data]
    f = np.zeros((total, len(RANGES)))

    def sums(x: np.ndarray) -> np.ndarray:
        c = np.zeros(n + 1, np.int32)
        np.cumsum(x, out=c[1:])
        return (c[ends] - c[starts]).astype(float)

    size = np.maximum(lens, 1)
    names = list(RANGES)
    upper = sums(cls == 0)
    lower = sums(cls == 1)
    f[:, names.index("log_len")] = np.log1p(lens)
    f[:, names.index("upper")] = upper / np.maximum(upper + lower, 1)
    for c in ("digit", "stop", "mark", "other"):
        f[:, names.index(c)] = sums(cls == CLASSES.index(c)) / size
    w_start, w_end, _ = textops.words(data, offsets, textops.separators("space"))
    if len(w_start):
        h = textops.span_hashes(data, w_start, w_end, fold=False)
        line = np.searchsorted(starts, w_start, "right") - 1
        words = np.bincount(line, minlength=total).astype(float)
        some = np.maximum(words, 1)
        f[:, names.index("word_len")] = np.bincount(line, w_end - w_start, total) / some
        title = (cls[w_start] == 0) & (cls[np.minimum(w_start + 1, n - 1)] != 0)
        f[:, names.index("title")] = np.bincount(line, title, total) / some
        f[:, names.index("short")] = np.bincount(line, (w_end - w_start) <= 3, total) / some
        twice = np.zeros(len(h), bool)
        twice[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        f[:, names.index("repeat")] = np.bincount(line, twice, total) / some
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
        pair[1:][line[1:] != line[:-1]] = 0
        key = textops.mix(pair + line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        again[pair == 0] = False
        f[:, names.index("bigram_repeat")] = np.bincount(line, again, total) / some
        # lines that another line of the text repeats
        c = np.zeros(len(h) + 1, np.uint64)
        place_in = np.arange(len(h)) - np.searchsorted(line, line)
        np.cumsum(textops.mix(h + place_in.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), out=c[1:])
        lo = np.searchsorted(line, np.arange(total), "left")
        hi = np.searchsorted(line, np.arange(total), "right")
        whole = c[hi] - c[lo]
        doc = np.repeat(np.arange(len(per)), per)
        key = textops.mix(whole + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = np.zeros(total, bool)
        eq = key[order[1:]] == key[order[:-1]]
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
        same[hi == lo] = False
        f[:, names.index("same_as_other")] = same
    return f, lens, per


def encoded(f: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Indices of the features that are on: own ranges, then those of the line before and after (a last index for none)."""
    own = np.empty(f.shape, np.int32)
    at = 0
    for j, cuts in enumerate(RANGES.values()):
        own[:, j] = at + np.searchsorted(cuts, f[:, j], "right")
        at += len(cuts) + 1
    n = len(f)
    begin = np.cumsum(per) - per
    before = np.full_like(own, 3 * WIDTH)
    after = np.full_like(own, 3 * WIDTH)
    if n > 1:
        before[1:] = own[:-1] + WIDTH
        after[:-1] = own[1:] + 2 * WIDTH
        before[begin] = 3 * WIDTH
        after[begin + per - 1] = 3 * WIDTH
    return np.hstack([own, before, after])


def summaries(p: np.ndarray, lens: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Of each text: logit of the length-weighted mean of its lines' P(good), the share of text in bad lines, and 1."""
    begin = np.cumsum(per) - per
    weight = lens + 1.0
    whole = np.add.reduceat(weight, begin)
    mean = np.add.reduceat(p * weight, begin) / whole
    bad = np.add.reduceat((p < 0.5) * weight, begin) / whole
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.stack([np.log(mean / (1 - mean)), bad, np.minimum.reduceat(p, begin), np.ones(len(per))], 1)


def fit(x: np.ndarray, lens: np.ndarray, per: np.ndarray, label: np.ndarray) -> dict:
    """label: 0 or 1 for each text."""
    share = max(float(label.mean()), 1e-3)
    weight = np.where(label == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))
    doc = np.repeat(np.arange(len(per)), per)
    y = label[doc]
    w, trans = fit_field(x, per, y, weight, 3 * WIDTH + 1)
    for _ in range(EM_ROUNDS):
        # lines of bad documents that look like lines of good ones are good; each bad document keeps its worst line
        own = w[x].sum(1)
        worst = np.minimum.reduceat(own, np.cumsum(per) - per)[doc]
        y = np.where(label[doc] == 1, 1, ((own > 0.5) & (own > worst)).astype(int))
        w, trans = fit_field(x, per, y, weight, 3 * WIDTH + 1)
    p, _, _ = marginals(w[x].sum(1), per, trans)
    s = summaries(p, lens, per)
    c = np.zeros(s.shape[1])
    for _ in range(40):  # Newton steps of a logistic regression
        q = 1 / (1 + np.exp(-np.clip(s @ c, -30, 30)))
        h = (s * (q * (1 - q))[:, None]).T @ s + 1e-2 * np.eye(len(c))
        c = c + np.linalg.solve(h, s.T @ (label - q) - 1e-2 * c)
    return {"w": w, "trans": trans, "c": c}


def scores(model: dict, x: np.ndarray, lens: np.ndarray, per: np.ndarray) -> np.ndarray:
    p, _, _ = marginals(model["w"][x].sum(1), per, model["trans"])
    return 1 / (1 + np.exp(-np.clip(summaries(p, lens, per) @ model["c"], -30, 30)))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, n_lines, lens, codes), all lines of each text."""
    for batch in batches:
        for at, data, off in textops.passes(batch.column(2)):
            f, lens, per = line_features(data, off)
            codes = encoded(f, per).astype(np.int16)
            offs = np.concatenate([[0], np.cumsum(per)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(per)), batch.column(1).slice(at, len(per)), textops.longs(per),
                    textops.long_lists(lens, per), pa.array([codes[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary()),
                ],
                names=["id", "label", "n_lines", "lens", "codes"],
            )


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, label 0/1): (id, label, lens, codes), a row for each labelled document of the sample."""
    ship(docs.sparkSession)
    place = F.md5(F.col("doc_id").cast("string"))
    few = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    few = few.orderBy(place, "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "label")
    got = docs.join(F.broadcast(few), F.col("doc_id") == F.col("id")).select("id", "label", "text")
    kind = few.schema["id"].dataType.simpleString()
    got = got.mapInArrow(_encode, f"id {kind}, label int, n_lines long, lens array<long>, codes binary")
    # rows that share a doc_id are combined in their tasks, so what is shuffled is at most a row for each document and task
    one = got.groupBy("id", "label").agg(F.min_by(F.struct("n_lines", "lens", "codes"), F.struct(F.md5("codes"), "n_lines")).alias("r")).select("id", "label", "r.*")
    one = written(one, "sample")
    ran = Window.orderBy(F.md5(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = one.where(F.col("n_lines") <= lines).select("id", "n_lines").withColumn("upto", F.sum("n_lines").over(ran))  # `sample` rows at most
    return one.join(F.broadcast(sized.where(F.col("upto") <= lines).select(F.col("id").alias("_id"))), F.col("id") == F.col("_id")).select("id", "label", "lens", "codes")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> dict | None:
    """docs (doc_id, text), labels (doc_id, label 0/1): the model fitted on sampled() rows; None without labels of both kinds."""
    rows = sampled(docs, labels, sample, lines).orderBy("label", F.md5("codes"), "id").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    per = rows.column("lens").combine_chunks()
    per = pa.compute.list_value_length(per).to_numpy(zero_copy_only=False).astype(np.int64)
    lens = pa.compute.list_flatten(rows.column("lens")).to_numpy()
    x = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int16).reshape(-1, 3 * len(RANGES)).astype(np.int64)
    return fit(x, lens, per, label)


def _score(model: dict | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            parts = []
            for _, data, off in textops.passes(texts):
                if model is None:
                    parts.append(np.ones(len(off) - 1))
                    continue
                f, lens, per = line_features(data, off)
                parts.append(scores(model, encoded(f, per), lens, per))
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*names, name])

    return run


def scored(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs (any columns, text among them) with the score in a column of that name."""
    ship(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(docs.schema.fields)).add(name, DoubleType())
    return docs.mapInArrow(_score(model, name), schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _model(spark: SparkSession, sf_dir: str) -> dict | None:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = scored(docs, _model(spark, sf_dir))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents whose score is under 0.5 go."""
    (name,) = fresh(docs.columns, "score")
    return scored(docs, _model(spark, sf_dir), name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
