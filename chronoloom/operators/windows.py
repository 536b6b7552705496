"""Window operators over ordered events: gaps, islands, runs, trims, smoothing, framing.

Every operator partitions by the columns `by` and breaks ties with `tie`, so results do not depend
on how rows arrive. Times are integer microseconds unless a column says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(by: list[str], *order: str | Column):
    return W.partitionBy(*by).orderBy(*order)


def gaps(events: DataFrame, end_of_track: int, minimum: int, by: list[str], start: str = "start_us", stop: str = "end_us", tie: str = "note_id") -> DataFrame:
    """Stretches of at least `minimum` without any event, with the leading and the trailing one.

    An event that began earlier may end later, so the end so far is a running maximum.
    """
    w = ordered(by, start, tie)
    so_far = F.coalesce(F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = events.select(*by, so_far.alias("gap_start"), F.col(start).alias("gap_end"))
    tail = events.groupBy(*by).agg(F.max(stop).alias("gap_start")).withColumn("gap_end", F.lit(end_of_track).cast("long"))
    return inner.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") >= minimum)


def islands(events: DataFrame, reach: int, by: list[str], start: str = "start_us", stop: str = "end_us", tie: str = "note_id") -> DataFrame:
    """events with island: a new one begins where the start lies more than `reach` behind the running end."""
    w = ordered(by, start, tie)
    so_far = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("opens", F.when(so_far.isNull() | (F.col(start) - so_far > reach), 1).otherwise(0)).withColumn("island", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def run_ids(rows: DataFrame, label: str, by: list[str], *order: str) -> DataFrame:
    """rows with run: consecutive equal labels share a number, counted from 1."""
    w = ordered(by, *order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("changed")


def trim_to_next(events: DataFrame, by: list[str], margin: int, floor: int, start: str = "start_us", stop: str = "end_us", tie: str = "note_id") -> DataFrame:
    """Ends moved to at least `margin` before the next start, but no event under `floor` long."""
    w = ordered(by, start, tie)
    nxt = F.lead(start).over(w)
    return events.withColumn(stop, F.greatest(F.col(start) + floor, F.coalesce(F.least(F.col(stop), nxt - margin), F.col(stop))))


def extend_legato(events: DataFrame, by: list[str], reach: int, pitch: str = "midi", start: str = "start_us", stop: str = "end_us", tie: str = "note_id") -> DataFrame:
    """An end up to `reach` before a next start of another pitch is moved onto it."""
    w = ordered(by, start, tie)
    nxt, other = F.lead(start).over(w), F.lead(pitch).over(w)
    close = (nxt - F.col(stop) > 0) & (nxt - F.col(stop) <= reach) & (other != F.col(pitch))
    return events.withColumn(stop, F.when(close, nxt).otherwise(F.col(stop)))


def onset_intervals(events: DataFrame, by: list[str], start: str = "start_us", stop: str = "end_us", tie: str = "note_id") -> DataFrame:
    """events with ioi (to the next start) and rest (from the own end to it); null at the last."""
    w = ordered(by, start, tie)
    nxt = F.lead(start).over(w)
    return events.withColumn("ioi", nxt - F.col(start)).withColumn("rest", nxt - F.col(stop))


def rectified_difference(rows: DataFrame, value: str, by: list[str], *order: str, first_is_self: bool = False) -> DataFrame:
    """rows with rise: the increase over the row before, 0 if none; the first row counts from 0 or itself."""
    before = F.lag(value).over(ordered(by, *order))
    before = F.coalesce(before, F.col(value) if first_is_self else F.lit(0))
    return rows.withColumn("rise", F.greatest(F.lit(0).cast("long"), F.col(value) - before))


def centred_mean(rows: DataFrame, value: str, reach: int, by: list[str], *order: str) -> DataFrame:
    """rows with total and width of the 2 * reach + 1 rows around each, shrinking at the edges."""
    w = ordered(by, *order).rowsBetween(-reach, reach)
    return rows.withColumn("total", F.sum(value).over(w)).withColumn("width", F.count(F.lit(1)).over(w))


def local_peaks(rows: DataFrame, value: str, by: list[str], *order: str, outside: int = 0) -> DataFrame:
    """Rows no lower than the one before and higher than the one after."""
    w = ordered(by, *order)
    return rows.withColumn("prev", F.coalesce(F.lag(value).over(w), F.lit(outside))).withColumn("next", F.coalesce(F.lead(value).over(w), F.lit(outside))).where(f"{value} >= prev and {value} > next").drop("prev", "next")


def weighted_neighbours(rows: DataFrame, value: str, weights: tuple[int, ...], by: list[str], *order: str) -> DataFrame:
    """rows with smooth: the weighted sum over the rows around, and weight: what of the weights exists."""
    w, reach = ordered(by, *order), len(weights) // 2
    total, present = F.lit(0), F.lit(0)
    for k, c in enumerate(weights):
        d = k - reach
        v = F.col(value) if d == 0 else F.lag(value, -d).over(w) if d < 0 else F.lead(value, d).over(w)
        total = total + F.coalesce(v * c, F.lit(0))
        present = present + F.when(v.isNotNull(), c).otherwise(0)
    return rows.withColumn("smooth", total.cast("long")).withColumn("weight", present.cast("long"))


def drop_repeats(events: DataFrame, near: int, by: list[str], order: list, pitch: str = "midi", start: str = "start_us") -> DataFrame:
    """Drop an event if one of the two before it, in order, has its pitch and starts within `near`."""
    w = ordered(by, *order)
    hit = F.lit(False)
    for k in (1, 2):
        hit = hit | F.coalesce((F.lag(pitch, k).over(w) == F.col(pitch)) & (F.abs(F.col(start) - F.lag(start, k).over(w)) < near), F.lit(False))
    return events.withColumn("repeat", hit).where("not repeat").drop("repeat")


def streaks(rows: DataFrame, hit: str, by: list[str], *order: str) -> DataFrame:
    """rows with combo (hits in a row up to here) and best (the longest so far)."""
    w = ordered(by, *order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    broken = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(upto)
    rows = rows.withColumn("broken", broken)
    inner = W.partitionBy(*by, "broken").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("combo", F.sum(F.when(F.col(hit), 1).otherwise(0)).over(inner)).drop("broken")
    return rows.withColumn("best", F.max("combo").over(upto))


def recent_valley(rows: DataFrame, value: str, rows_back: int, below: int, by: list[str], *order: str) -> DataFrame:
    """rows with valley: whether any of the rows just before lies below the bound."""
    w = ordered(by, *order).rowsBetween(-rows_back, -1)
    return rows.withColumn("valley", F.coalesce(F.min(value).over(w) < below, F.lit(False)))


def own_chunks(events: DataFrame, size: int, overlap: int, end_of_track: int, start: str = "start_us") -> DataFrame:
    """events with chunk: the overlapping chunk that owns the start, half an overlap away from its edges."""
    hop = size - overlap
    last = max(0, -(-(end_of_track - size) // hop))
    owner = F.floor((F.col(start) - overlap // 2) / hop)
    return events.withColumn("chunk", F.greatest(F.lit(0), F.least(owner, F.lit(last))).cast("long"))


def frames(length: Column, frame: int, hop: int) -> Column:
    """Starts of the overlapping frames of a sequence; at least one, the last may reach past the end."""
    last = F.greatest(F.lit(0), F.ceil((length - frame) / hop).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: k * hop)


def prefix_onsets(rows: DataFrame, length: str, by: list[str], *order: str) -> DataFrame:
    """rows with onset: the sum of the lengths before, counted over rows that are dropped later too."""
    w = ordered(by, *order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("onset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def running_max(rows: DataFrame, value: str, by: list[str], *order: str) -> DataFrame:
    return rows.withColumn("top", F.max(value).over(ordered(by, *order).rowsBetween(W.unboundedPreceding, 0)))


def gaussian(df: DataFrame, by: list[str], order: list[str], value: str, sigma: float, out: str, reach: int = 4) -> DataFrame:
    """df with out: value smoothed along each group by a Gaussian of `reach` rows on either side; groups are reflected at their ends, short ones held.

    Each row gathers its neighbours once, and the weights of the kernel go over that list.
    """
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    w = W.partitionBy(*by)
    rows = df.withColumn("g_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("g_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("g_near", F.collect_list(F.col(value).cast("double")).over(w.orderBy(*order).rowsBetween(-reach, reach)))
    low, total = F.greatest(F.lit(0), F.col("g_at") - reach), F.lit(0.0)
    for k, weight in zip(range(-reach, reach + 1), weights):
        j = F.col("g_at") + k
        turned = F.when(F.col("g_n") < reach, F.greatest(F.lit(0), F.least(F.col("g_n") - 1, j))).when(j < 0, -j - 1).when(j >= F.col("g_n"), 2 * F.col("g_n") - 1 - j).otherwise(j)
        total = total + F.element_at("g_near", (turned - low + 1).cast("int")) * (weight / sum(weights))
    return rows.withColumn(out, total).drop("g_at", "g_n", "g_near")
