"""Keyed upserts, conditional updates and writers.

A conditional update never recreates a row that is gone and never changes its key. Tables are
rewritten to a new path; the caller swaps it in, so a lost job leaves the old one whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The last writer wins: table without the keys of rows, and rows."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def update_if(table: DataFrame, changes: DataFrame, key: str, expected: Mapping[str, str], values: list[str]) -> DataFrame:
    """table with `values` taken from changes where the key matches and every expected column is unchanged.

    expected: column of table to column of changes with the value it must still have, null-safe.
    """
    new = changes.select(F.col(key).alias("k_"), *(F.col(e).alias(f"e_{c}") for c, e in expected.items()), *(F.col(v).alias(f"v_{v}") for v in values), F.lit(True).alias("hit_"))
    met = table.join(new, F.col(key) == F.col("k_"), "left")
    ok = F.coalesce(F.col("hit_"), F.lit(False))
    for c in expected:
        ok = ok & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return met.select(*(F.when(ok, F.col(f"v_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def update_with(table: DataFrame, requests: DataFrame, key: str, expected: Mapping[str, str], values: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """table with `values`, expressions over its columns, where a request still holds and `where` is true.

    A row whose key an expression would change, or that where declines, stays as it is. Repeated
    requests for a key count once.
    """
    asked = requests.select(F.col(key).alias("k_"), *(F.col(e).alias(f"e_{c}") for c, e in expected.items())).distinct().withColumn("hit_", F.lit(True))
    held = F.col(key) == F.col("k_")
    for c in expected:
        held = held & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    ok = F.coalesce(F.col("hit_"), F.lit(False))
    ok = ok & where if where is not None else ok
    ok = ok & (values[key] == F.col(key)) if key in values else ok
    return table.join(asked, held, "left").select(*(F.when(ok, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def fill_if(table: DataFrame, changes: DataFrame, key: str, expected: Mapping[str, str], column: str, replace: bool = False) -> DataFrame:
    """One column filled under the same conditions, kept where it has a value unless replace is set."""
    kept = table.withColumn("old_", F.col(column))
    out = update_if(kept, changes, key, expected, [column])
    value = F.col(column) if replace else F.coalesce("old_", column)
    return out.withColumn(column, value).drop("old_")


def reconcile(catalog: DataFrame, library: DataFrame, known: DataFrame) -> DataFrame:
    """id, action of each catalog row: keep, update (stale), skip (known but deleted) or insert."""
    lib = library.select("id", F.col("version").alias("have"))
    met = catalog.join(lib, "id", "left").join(known.select("id", F.lit(True).alias("known")), "id", "left")
    action = F.when(F.col("have") >= F.col("version"), "keep").when(F.col("have").isNotNull(), "update").when(F.col("known"), "skip").otherwise("insert")
    return met.select("id", action.alias("action"))


def export_document(table: DataFrame, version: int, columns: list[str]) -> DataFrame:
    """One JSON text for each row: the format version and the columns; binary columns are left out."""
    plain = [c for c in columns if dict(table.dtypes)[c] != "binary"]
    return table.select(F.to_json(F.struct(F.lit(version).alias("version"), *plain)).alias("value"))


def serialised_notes(rows: DataFrame) -> DataFrame:
    """Start, duration, confidence and strength to three decimals, half to even; end becomes duration."""
    r = lambda c: F.bround(c, 3)
    return rows.select(r(F.col("start")).alias("start"), r(F.col("end") - F.col("start")).alias("duration"), "midi", r(F.col("confidence")).alias("confidence"), r(F.col("strength")).alias("strength"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by Spark's committer: readers see all of it or nothing. NaN and infinities are refused."""
    _finite_only(df).write.mode("overwrite").json(path)


def _finite_only(df: DataFrame) -> DataFrame:
    """df, with an error for a number that JSON cannot say."""
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            bad = F.isnan(f.name) | (F.abs(f.name) == float("inf"))
            df = df.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(F.col(f.name)))
    return df


def write_document(df: DataFrame, path: str, *order: str) -> None:
    """df as one indented JSON array in one file of the folder path, rows by order; NaN and infinities are refused.

    One task writes it row by row, for reports and exports that people read.
    """
    if not df.limit(1).count():
        df.sparkSession.createDataFrame([("[]",)], "value string").write.mode("overwrite").text(path)
        return
    rows = _finite_only(df).repartition(1).sortWithinPartitions(*order) if order else _finite_only(df).repartition(1)
    texts = rows.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))

    def join(batches):
        import pandas as pd

        before = "["
        for b in batches:
            for text in b.value:
                yield pd.DataFrame({"value": [before + "\n" + "\n".join("  " + line for line in text.splitlines())]})
                before = ","
        yield pd.DataFrame({"value": ["]"]})

    texts.mapInPandas(join, "value string").write.mode("overwrite").text(path)


def no_alias(*paths: str) -> None:
    """Refuse outputs that are the same place as an input."""
    import posixpath

    seen = [posixpath.normpath(p.removeprefix("file://")) for p in paths]
    if len(set(seen)) < len(seen):
        raise ValueError("two of the paths are the same")


def pcm16(samples: Column, rate: int = 44_100) -> Column:
    """A mono WAV file of samples in -1 to 1: 44 bytes of header, then 16-bit numbers."""
    return _wave(samples, F.lit(rate))


@F.pandas_udf(T.BinaryType())
def _wave(samples, rate):
    import struct

    import numpy as np
    import pandas as pd

    def one(x, r):
        if x is None:
            return None
        data = (np.clip(np.asarray(x, float), -1, 1) * 32767).round().astype("<i2").tobytes()
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, r, 2 * r, 2, 16, b"data", len(data)) + data

    return pd.Series([one(x, int(r)) for x, r in zip(samples, rate)])
