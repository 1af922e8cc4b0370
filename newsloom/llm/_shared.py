"""What the operators share: written tables in the shared folder, rows' identities, components, module shipping."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.graph import components
from newsloom.operators.tables import drop_written, written

__all__ = ["ascii_lower", "components", "drop_written", "fresh", "keep_rows", "sha_of", "ship", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if getattr(ship, "app", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="newsloom-ship-")) / "newsloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    ship.app = sc.applicationId


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the byte-wise path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column in taken has it (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def sha_of(text: Column) -> Column:
    """With doc_id it names a row's content in decision tables."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keep_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi", single: bool = False) -> DataFrame:
    """Rows of docs whose (doc_id, sha of the text) is in keys (doc_id, sha), or with left_anti isn't; all columns, whatever their names.

    single: of rows that repeat doc_id and text, one stays.
    """
    i, k, s = fresh(docs.columns, "key_id", "key_sha", "own_sha")
    keys = keys.select(F.col("doc_id").alias(i), F.col("sha").alias(k)).distinct()
    out = docs.withColumn(s, sha_of(F.col("text"))).join(keys, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(s) == F.col(k)), how)
    if single:
        out = out.dropDuplicates(["doc_id", s])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
