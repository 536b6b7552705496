"""Joins on time: nearest, as-of, interval, band and interpolating joins without Cartesian products.

Nearest and as-of lookups union both sides and look along the order with window functions. Interval
and band joins cut time into cells, put the interval side into each cell it touches and join on the
cell, with the exact predicate on top; each pair meets in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, keep: list[str], key: str, tie_later: bool = True) -> DataFrame:
    """Each left row with the nearest right row of its group: its `keep` columns and diff = at - time.

    right must not have two rows of one group and time that differ only in `keep` order; `key` orders
    such ties, lowest first. Of two equally near rows the later or the earlier wins. A group without
    right rows gives nulls.
    """
    packed = F.struct(F.col(time).alias("t"), *keep)
    right = right.groupBy(*by, time).agg(F.min_by(packed, key).alias("r"))
    both = left.select(*by, F.col(at).alias("t_"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema["r"].dataType).alias("r")).unionByName(
        right.select(*by, F.col(time).alias("t_"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), "r")
    )
    # both look back along an order, once up and once down: a frame that ends at the last row is summed anew for each row
    back = F.last("r", True).over(W.partitionBy(*by).orderBy("t_").rangeBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.last("r", True).over(W.partitionBy(*by).orderBy(F.desc("t_")).rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("b_", back).withColumn("a_", ahead).where("l is not null")
    to_back, to_ahead = F.col("t_") - F.col("b_.t"), F.col("a_.t") - F.col("t_")
    use_back = F.col("a_").isNull() | (to_back < to_ahead) | ((to_back == to_ahead) & F.lit(not tie_later))
    best = F.when(F.col("b_").isNotNull() & use_back, F.col("b_")).otherwise(F.col("a_"))
    out = both.withColumn("m_", best)
    return out.select("l.*", *(F.col(f"m_.{c}").alias(c) for c in keep), (F.col("t_") - F.col("m_.t")).alias("diff"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, keep: list[str], key: str) -> DataFrame:
    """Each left row with the last right row at or before it; of equal times the highest key."""
    right = right.groupBy(*by, time).agg(F.max_by(F.struct(*keep), key).alias("r"))
    left_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    both = left.select(*by, F.col(at).alias("t_"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema["r"].dataType).alias("r")).unionByName(right.select(*by, F.col(time).alias("t_"), F.lit(None).cast(left_type).alias("l"), "r"))
    w = W.partitionBy(*by).orderBy("t_").rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("m_", F.last("r", True).over(w)).where("l is not null")
    return both.select("l.*", *(F.col(f"m_.{c}").alias(c) for c in keep))


def cell(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("long")


def cells(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(cell(low, width), cell(high, width)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, low: Column, high: Column, width: int, how: str = "inner") -> DataFrame:
    """Pairs with low <= at <= high; low and high are over intervals' columns, which must not clash."""
    right = intervals.withColumn("lo_", low).withColumn("hi_", high).where("lo_ <= hi_").withColumn("cell_", cells(F.col("lo_"), F.col("hi_"), width))
    left = points.withColumn("cell_", cell(F.col(at), width))
    right = right.select(*(F.col(c).alias(f"r_{c}") if c in (*by, "cell_") else F.col(c) for c in right.columns))
    cond = (left["cell_"] == right["r_cell_"]) & left[at].between(right["lo_"], right["hi_"])
    for c in by:
        cond = cond & (left[c] == right[f"r_{c}"])
    return left.join(right, cond, how).drop("cell_", "r_cell_", "lo_", "hi_", *(f"r_{c}" for c in by))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_low: str, a_high: str, b_low: str, b_high: str, width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap: a_low < b_high and b_low < a_high.

    Both sides are put into cells; a pair is taken in the cell where the later of the two starts.
    """
    left = a.where(F.col(a_low) < F.col(a_high)).withColumn("cell_", cells(F.col(a_low), F.col(a_high), width))
    right = b.where(F.col(b_low) < F.col(b_high)).withColumn("r_cell_", cells(F.col(b_low), F.col(b_high), width))
    right = right.select(*(F.col(c).alias(f"r_{c}") if c in by else F.col(c) for c in right.columns))
    cond = (left["cell_"] == right["r_cell_"]) & (left[a_low] < right[b_high]) & (right[b_low] < left[a_high]) & (F.greatest(left[a_low], right[b_low]).between(left["cell_"] * width, left["cell_"] * width + width - 1))
    for c in by:
        cond = cond & (left[c] == right[f"r_{c}"])
    return left.join(right, cond).drop("cell_", "r_cell_", *(f"r_{c}" for c in by))


def interpolate(points: DataFrame, knots: DataFrame, by: list[str], at: str, x: str, y: str) -> DataFrame:
    """points with mapped: linear between the knots (x, y), a constant offset outside them.

    Knots of a group must have distinct x.
    """
    w = W.partitionBy(*by).orderBy(x)
    spans = knots.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    first = knots.groupBy(*by).agg(F.min(x).alias("fx"), F.min_by(y, x).alias("fy"))
    placed = as_of(points, spans, by, at, "x0", ["x0", "y0", "x1", "y1"], "x0").join(first, by, "left")
    t = F.col(at)
    inside = F.col("y0") + (t - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    mapped = F.when(F.col("x0").isNull(), F.col("fy") + (t - F.col("fx"))).when(F.col("x1").isNull(), F.col("y0") + (t - F.col("x0"))).otherwise(inside)
    return placed.withColumn("mapped", mapped.cast("double")).drop("x0", "y0", "x1", "y1", "fx", "fy")


def catalog_lookup(songs: DataFrame, catalog: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """key, value of each song: what the catalog has for its title and artist, null where it has nothing or is ambiguous.

    songs: key, title_key, artist_key (null: unknown); catalog: id, title_key, artist_key, rank, value (null: none). Of
    the rows that agree the first by rank with a value counts. A song without an artist takes a title that one artist
    alone has. known: title_key, artist_key, id of recordings that go by other titles; for these the id decides.
    The catalog is reduced to a row for each title and artist first, so no song meets more than one row.
    """
    best = lambda df, by: df.groupBy(*by).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("rank"))).alias("value"))
    titled = best(catalog, ["title_key", "artist_key"])
    alone = titled.groupBy("title_key").agg(F.count(F.lit(1)).alias("artists"), F.first("value").alias("value")).where("artists = 1").drop("artists")
    given, nameless = songs.where("artist_key is not null"), songs.where("artist_key is null")
    out = nameless.join(alone, "title_key", "left").select(key, "value")
    if known is not None:
        ids = known.groupBy("title_key", "artist_key").agg(F.min("id").alias("id"))
        met = given.join(ids, ["title_key", "artist_key"], "left")
        by_id = best(catalog, ["id", "artist_key"])
        out = out.unionByName(met.where("id is not null").join(by_id, ["id", "artist_key"], "left").select(key, "value"))
        given = met.where("id is null").drop("id")
    return out.unionByName(given.join(titled, ["title_key", "artist_key"], "left").select(key, "value"))
