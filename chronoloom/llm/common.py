"""Helpers shared by the training-data operators: shared-folder tables, bounded broadcasts, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only while its counted rows stay below this; each such row holds a few longs.
BROADCAST_ROWS = 1_000_000

#: A key that this many rows share is hot: it is not shuffled into one task.
HOT_ROWS = 20_000

#: The white space of every word definition here.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local master gets a folder of its own; a cluster gets an error,
    since no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(*tables: DataFrame) -> None:
    """Delete the files of tables made by stash() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit, else df: the join then shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], size: str, how: str = "left") -> DataFrame:
    """left joined with right, whose column size counts the rows of left that meet each of its rows.

    Rows of right that HOT_ROWS or more rows meet are broadcast (there are few of them), so that no
    task gets a hot key; the rest is shuffled. The keys of right are unique; size does not return
    where left has it already. how: left or inner.
    """
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in on])
    hot = right.where(F.col(size) >= HOT_ROWS) if size in right.columns else right.limit(0)
    if not hot.limit(1).count():
        return left.join(right, on, how)
    mark = fresh(left, "is_hot")
    flag = small(hot.select(*on).withColumn(mark, F.lit(True)))
    cold = left.join(flag, on, "left_anti").join(right.where(F.col(size) < HOT_ROWS), on, how)
    return cold.unionByName(left.join(small(hot), on))


def numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with out: 1, 2, ... within equal keys, nulls being values.

    The rows are written, numbered in the parts they lie in, and the parts of a group follow one
    another, so that no task holds a whole group.
    """
    at, part, before = (fresh(rows, f"nu_{x}") for x in ("at", "part", "before"))
    held = stash(rows.withColumn(at, F.monotonically_increasing_id()), "numbered")
    held = held.withColumn(part, F.shiftright(at, 33))
    other = {k: fresh(held, f"{k}_of_part") for k in [*keys, part]}
    size = fresh(held, "nu_size")
    parts = held.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(size))
    parts = parts.withColumn(before, F.sum(size).over(W.partitionBy(*keys).orderBy(part)) - F.col(size))
    parts = small(stash(parts.drop(size).withColumnsRenamed(other), "parts"))
    same = F.lit(True)
    for k, o in other.items():
        same = same & held[k].eqNullSafe(parts[o])
    nth = F.row_number().over(W.partitionBy(*keys, part).orderBy(at)) + F.col(before)
    return held.join(parts, same).withColumn(out, nth).select(*rows.columns, out)


def held_out(doc_id: str = "doc_id") -> Column:
    """The held-out fold: crc32 of the id's text leaves 2 on division by 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """The Arrow batches in parts of few rows, so that a worker holds the Python values of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
