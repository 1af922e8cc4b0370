"""Centroid clustering with block-norm screening (Bottesch, Buehler and Kaechele 2016), exact in integers.

Vectors become integers. Each is compressed, once, to two single-precision numbers a segment of SEGMENT components: its sum and the norm
of what is left after its mean is taken off. For a vector x and a centroid c, Cauchy-Schwarz gives in each segment
|x - c|^2 >= (sum_x - sum_c)^2 / SEGMENT + (rest_x - rest_c)^2, so the compressed forms alone give a lower bound of the distance. The
centroid with the smallest bound is measured first, in exact integers; every centroid whose bound lies above that distance can't be nearest and
is screened out; only the others receive exact distances. Bounds are floating point and are lowered by SLACK, far above their rounding,
before they screen anything: the result is that of measuring all pairs.

Scale: vectors are written once with their compressed form; a round is one pass over that table in which each task gives one
partial sum per centroid, so the driver gets k sums a task's share of, never vectors, and what is sent to tasks are k centroids.

Defined results: vectors of another length, or with a null or non-finite component, are left out, null vectors too; rows that repeat a vec_id are
apart; a vec_id of null is hashed as an empty string; ties of the first hash go by the vector; with fewer vectors than centroids there are as many centroids as vectors;
an empty table gives no rows; further columns are ignored. An integer above LIMIT in absolute value ends the run with an error: its
distance might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm._shared import ship, written

K, ROUNDS, SIZE, SEED = 40, 5, 64, "2:"
#: Components in a segment. Wider ones are cheaper to compare and screen out less.
SEGMENT = 2
#: Squared differences of 64 components up to this, summed, stay below 2^63.
LIMIT = 1 << 27
#: By this part of both squared norms, and by as much of one unit, a bound is lowered before it screens; rounding to single precision moves it by a quarter of that at most.
SLACK = 1e-6
#: Vectors measured at a time in a task.
ROWS = 8192


def integers(vec: Column, size: int = SIZE) -> Column:
    """floor(256 x) of each component, x as double; null if the vector isn't kept."""
    d = vec.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vec) == size) & ~bad, F.transform(d, lambda x: F.floor(x * 256)))


def compressed(x: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """For each row and segment: the sum over sqrt(segment), and the norm of what is left beside the mean."""
    parts = x.reshape(len(x), -1, segment).astype(np.float64)
    sums = parts.sum(2)
    rest = np.sqrt(((parts - sums[:, :, None] / segment) ** 2).sum(2))
    return (sums / np.sqrt(segment)).astype(np.float32), rest.astype(np.float32)


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Lower bounds of the squared distances between the rows of two compressed sets, lowered by SLACK."""
    x, c = np.hstack(a).astype(np.float64), np.hstack(b).astype(np.float64)
    square = (x * x).sum(1)[:, None] + (c * c).sum(1)
    return square - 2 * (x @ c.T) - SLACK * (square + 1)


def nearest(x: np.ndarray, form: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (of equals the smaller), its exact squared distance, and how many exact distances that took."""
    low = bounds(form, compressed(centroids))
    row = np.arange(len(x))
    best = low.argmin(1)
    dist = ((x - centroids[best]) ** 2).sum(1)
    open_ = low <= dist[:, None]
    open_[row, best] = False
    measured = len(x)
    for c in np.flatnonzero(open_.any(0)):  # k at most
        r = np.flatnonzero(open_[:, c])
        r = r[low[r, c] <= dist[r]]  # the distance to beat may have fallen meanwhile
        d = ((x[r] - centroids[c]) ** 2).sum(1)
        better = (d < dist[r]) | ((d == dist[r]) & (c < best[r]))
        dist[r[better]], best[r[better]] = d[better], c
        measured += len(r)
    return best, dist, measured


def _matrix(column: pa.ListArray, kind: type, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, width)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(1), np.int64, len(b.column(1)[0]))
            sums, rest = compressed(x)
            form = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (2 * sums.shape[1]), pa.array(np.hstack([sums, rest]).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), form], names=["vec_id", "x", "form"])


def _measured(b: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    x = _matrix(b.column(1), np.int64, centroids.shape[1])
    form = _matrix(b.column(2), np.float32, 2 * centroids.shape[1] // SEGMENT)
    half = form.shape[1] // 2
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        best, dist, _ = nearest(part, (form[at : at + ROWS, :half], form[at : at + ROWS, half:]), centroids)
        yield at, part, best, dist


def _sums(centroids: np.ndarray):
    """A task's rows: for each centroid with vectors, a list of how many they are and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for b in batches:
            for _, x, best, _ in _measured(b, centroids):
                order = np.argsort(best, kind="stable")
                found, first, many = np.unique(best[order], return_index=True, return_counts=True)
                total[found] += np.add.reduceat(x[order], first, axis=0)
                n[found] += many
        has = np.flatnonzero(n)
        lists = np.hstack([n[has, None], total[has]])
        lists = pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * lists.shape[1], pa.array(lists.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), lists], names=["cluster", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, best, dist in _measured(b, centroids):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array(best.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


def vectors(table: DataFrame, size: int = SIZE) -> DataFrame:
    """table (vec_id, embedding): the kept vectors as integers x with their compressed form, written."""
    ship(table.sparkSession)
    if size % SEGMENT:
        raise ValueError(f"vectors must have a multiple of {SEGMENT} components")
    kept = table.select("vec_id", integers(F.col("embedding"), size).alias("x")).where("x is not null")
    # floor() of a value beyond a long's range ends at the range's end, so it is above the limit as well
    checked = F.when(F.exists("x", lambda v: (v > LIMIT) | (v < -LIMIT)), F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling"))).otherwise(F.col("x"))
    checked = checked.cast("array<int>")
    kind = table.schema["vec_id"].dataType.simpleString()
    return written(kept.withColumn("x", checked).mapInArrow(_compress, f"vec_id {kind}, x array<int>, form array<float>"), "vectors")


def first_centroids(vecs: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and vec_id, in that order: k rows to the driver."""
    rows = vecs.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(vecs: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids after every vector went to its nearest one."""
    parts = vecs.mapInArrow(_sums(centroids), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    sums = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
    for r in parts.groupBy("cluster", "at").agg(F.sum("part").alias("total")).collect():  # k times 65 rows at most
        sums[r.cluster, r["at"]] = r.total
    has = sums[:, 0] > 0
    out = centroids.copy()
    out[has] = sums[has, 1:] // sums[has, :1]
    return out


def clustered(table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED) -> DataFrame:
    """table (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark = table.sparkSession
    vecs = vectors(table, size)
    centroids = first_centroids(vecs, k, seed)
    kind = vecs.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vecs, centroids)
    out = written(vecs.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"), "assigned")
    per = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(c, s, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    told = spark.createDataFrame(rows, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), F.col("cluster") == F.col("of")).drop("of")  # a row for each of k centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql() -> str:
    """Rounds without a recursive query: a table of distances to all centroids, then new centroids, ROUNDS times."""
    parts = [f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, row_number() OVER () AS rid FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v AS c
  FROM (SELECT sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM whole ORDER BY h, v LIMIT {K}))"""]
    near = """a{i} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS distance
  FROM (SELECT rid, vec_id, v, cluster, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)]) AS BIGINT) AS d FROM whole, c{i})
  GROUP BY rid)"""
    for i in range(ROUNDS):
        parts.append(near.format(i=i))
        parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list(CAST((t - ((t % n + n) % n)) // n AS BIGINT) ORDER BY pos) AS c
    FROM (SELECT cluster, pos, sum(x) AS t, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY cluster, pos)
    GROUP BY cluster) s ON o.cluster = s.cluster)""")
    parts.append(near.format(i=ROUNDS))
    return ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.cluster = c.cluster"""


OP13_SQL = _sql()
