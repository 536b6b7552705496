"""A uniform shuffle with exact shard sizes through a hypergeometric communication matrix.

Rows fall into blocks by hash. The counts that block p sends to shard s are drawn exactly: a
multivariate hypergeometric matrix with the block sizes as row sums and the shard sizes as column
sums. It is drawn as a tree: the driver draws it for groups of blocks, about as many as the root of
the blocks' number, and tasks draw each group's rows. Each block orders its rows by a keyed hash and
deals them out by its row of the matrix; after the exchange each shard orders what it has by a second
keyed hash. Every arrangement is then equally likely, and no count is left to chance. The same rows
and seed give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, fresh, numbered, small, stash

SHARDS = 8
#: Blocks, and runs that are ordered within the shards: of LEAST_ROWS rows or more on average and up to
#: BLOCKS of them, then of MOST_ROWS rows, so that each fits in memory and their number suits many tasks.
LEAST_ROWS, BLOCKS, MOST_ROWS = 128, 1024, 65_536
SEED = 5
#: Rows equal in the key beyond which they are numbered and spread over blocks like different rows.
COPIES = 4096
#: Populations from here on are beyond the library's draws.
LARGE = 10**9


def communication(block_sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """The matrix of counts; its column sums are as equal as can be, larger ones first."""
    total = sum(block_sizes)
    return matrix([seed], block_sizes, [total // shards + (s < total % shards) for s in range(shards)])


def matrix(seed: list[int], row_sums: list[int], column_sums: list[int]) -> np.ndarray:
    """A hypergeometric matrix with these sums."""
    rng, free = np.random.Generator(np.random.PCG64(seed)), np.array(column_sums, np.int64)
    out = np.zeros((len(row_sums), len(free)), np.int64)
    for p, n in enumerate(row_sums):
        out[p] = _draw(rng, free, int(n))
        free -= out[p]
    return out


def _draw(rng, free: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, of any population size."""
    if free.sum() < LARGE:
        return rng.multivariate_hypergeometric(free, n, method="marginals")
    half = len(free) // 2
    if not half:
        return np.array([n])
    left = _large(rng, int(free[:half].sum()), int(free[half:].sum()), n)
    return np.concatenate([_draw(rng, free[:half], left), _draw(rng, free[half:], n - left)])


def _large(rng, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by inversion over 12 standard deviations around the mode: what lies
    outside is below the resolution of a uniform number. Work grows with the root of n."""
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = 12 * math.isqrt(int(n * (good / total) * (bad / total) * max(1, total - n) / max(1, total - 1)) + 1) + 12
    low, high = max(0, n - bad, mode - wide), min(n, good, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def _rows_of_groups(seed: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group, blocks, counts, free in zip(part["group"], part["blocks"], part["counts"], part["free"]):
                ends = matrix([seed, 1, int(group)], list(counts), list(free)).cumsum(axis=1)
                yield pd.DataFrame({"block": np.array(blocks, np.int64), "ends": ends.tolist()})

    return run


def draw_matrix(sizes: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """(block, ends) from (block, size): the running sums of each block's row of the matrix.

    blocks: their number; those without a row are empty. The driver sees a number for each group of
    blocks, about the root of blocks.
    """
    per = math.isqrt(blocks - 1) + 1
    grouped = sizes.withColumn("group", F.floor(F.col("block") / per)).groupBy("group")
    grouped = stash(grouped.agg(F.sort_array(F.collect_list(F.struct("block", "size"))).alias("rows"), F.sum("size").alias("n")), "groups")
    sums = grouped.select("group", "n").orderBy("group").collect()
    counts = communication([r.n for r in sums], shards, seed)
    drawn = sizes.sparkSession.createDataFrame([(r["group"], row) for r, row in zip(sums, counts.tolist())], "group long, free array<long>")
    met = grouped.join(F.broadcast(drawn), "group")
    return met.select("group", F.col("rows.block").alias("blocks"), F.col("rows.size").alias("counts"), "free").mapInPandas(_rows_of_groups(seed), "block long, ends array<long>")


def _number_copies(keyed: DataFrame, row: str) -> DataFrame:
    """keyed where rows of one hash in row, if there are over COPIES of them, get hashes of their own.

    The copies are numbered without gaps, and the numbers' hashes are the same whichever copy has which.
    """
    hot = stash(keyed.groupBy(row).agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select(row), "hot")
    if not hot.limit(1).count():
        return keyed
    nth = fresh(keyed, "sh_nth")
    copies = numbered(keyed.join(small(hot), row, "left_semi"), [row], nth)
    copies = copies.withColumn(row, F.xxhash64(row, nth)).select(keyed.columns)
    return keyed.join(small(hot), row, "left_anti").select(keyed.columns).unionByName(copies)


def pieces(rows: int) -> int:
    return max(1, min(BLOCKS, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, key: tuple[str, ...] = ("doc_id",), shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one at most. key: the columns whose values order the rows; rows equal in
    them are told apart by a running number, and where there are over COPIES of them spread over the
    blocks like different rows. Nulls are values, in key and elsewhere; texts of any length are only
    hashed. Columns named shard or slot before are replaced; an empty table stays empty.
    """
    df = df.drop(shard, slot)
    row, block, copy, rank, run, ends, start = (fresh(df, f"sh_{x}") for x in ("row", "block", "copy", "rank", "run", "ends", "start"))
    cols = df.columns
    hashed = F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key))
    total = df.count()
    blocks = pieces(total)
    keyed = _number_copies(df.withColumn(row, hashed), row).withColumn(block, F.pmod(F.col(row), F.lit(blocks)).cast("long"))
    sizes = stash(keyed.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("size")), "sizes")
    drawn = stash(draw_matrix(sizes, blocks, shards, seed), "matrix")
    matrix = small(drawn.select(F.col("block").alias(block), F.col("ends").alias(ends)))

    copies = W.partitionBy(block, row).orderBy(*(F.xxhash64(c) for c in cols[:1]))
    local = W.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), row, copy), row, copy)
    dealt = keyed.repartition(block).withColumn(copy, F.row_number().over(copies)).withColumn(rank, F.row_number().over(local)).join(matrix, block)
    dealt = dealt.withColumn(shard, F.size(F.filter(ends, lambda e: e < F.col(rank))).cast("int"))
    # the second order, by ranges of its hash: a run's rows follow all of the runs before it
    runs = -(-blocks // shards)
    second = F.xxhash64(F.lit(seed + 2), row, copy)
    dealt = dealt.withColumn(rank, second).withColumn(run, F.least(F.floor((F.col(rank) / F.lit(2.0**64) + 0.5) * runs), F.lit(runs - 1)).cast("int"))
    dealt = dealt.select(*cols, row, copy, rank, run, shard)
    first = stash(dealt.groupBy(shard, run).count(), "runs") if runs > 1 else None
    if first is None:
        within = W.partitionBy(shard).orderBy(rank, row, copy)
        return dealt.withColumn(slot, (F.row_number().over(within) - 1).cast("long")).select(*cols, shard, slot)
    before = W.partitionBy(shard).orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    starts = first.select(shard, run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    within = W.partitionBy(shard, run).orderBy(rank, row, copy)
    numbered = dealt.withColumn(slot, F.row_number().over(within)).join(small(starts), [shard, run])
    return numbered.withColumn(slot, (F.col(slot) - 1 + F.col(start)).cast("long")).select(*cols, shard, slot)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `rows` law: texts are not grouped, since a uniform shuffle places each row by itself."""
    docs = documents(spark, sf_dir)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    keyed = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    out = shuffle_to_shards(keyed, key=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
