"""Grouped summaries of timelines: streams, bins, key profiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Key profiles of a major and a minor key, from the tonic on.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def summarise_streams(notes: DataFrame, by: list[str], start: str = "start", dur: str = "dur", midi: str = "midi") -> DataFrame:
    """Count, first start, last end, true median, lowest and highest pitch, share of lone onsets, per stream."""
    onsets = notes.groupBy(*by, start).agg(F.count("*").alias("n"), F.max(F.col(start) + F.col(dur)).alias("stop"), F.min(midi).alias("lo"), F.max(midi).alias("hi"), F.collect_list(midi).alias("p"))
    pitches = notes.groupBy(*by).agg(F.median(midi).alias("median_midi"))
    summary = onsets.groupBy(*by).agg(F.sum("n").alias("notes"), F.min(start).alias("first"), F.max("stop").alias("last"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.count_if(F.col("n") == 1).alias("lone"), F.count("*").alias("onsets"))
    return summary.join(pitches, by)


def equal_bins(rows: DataFrame, by: list[str], place: str, count: str, bins: int) -> DataFrame:
    """rows with bin: floor(place * bins / count), at most `bins` of them."""
    return rows.withColumn("bin", F.floor(F.col(place) * F.least(F.lit(bins), F.col(count)) / F.col(count)))


def weighted_profile(rows: DataFrame, vector: str, weight: str, by: list[str]) -> DataFrame:
    """by, pc, value: the weighted sum of each element, map-side combined."""
    return rows.select(*by, F.posexplode(vector).alias("pc", "v"), F.col(weight).alias("w")).groupBy(*by, "pc").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def key_scores(profile: Column, scale: int = 100) -> Column:
    """array<struct(score, key)> of the 24 keys: the centred profile against each rotated key profile, in integers."""
    out = []
    for offset, base in ((0, MAJOR), (12, MINOR)):
        mean = sum(base) / 12
        for tonic in range(12):
            weights = [round((base[(k - tonic) % 12] - mean) * scale) for k in range(12)]
            score = sum((F.element_at(profile, k + 1) * w for k, w in enumerate(weights)), F.lit(0))
            out.append(F.struct(score.cast("long").alias("score"), F.lit(-(offset + tonic)).alias("neg_key")))
    return F.array(*out)


def best_rotation(a: Column, b: Column) -> Column:
    """struct(dot, shift): the rotation of a in -6 to 5 that agrees best with b; ties to the smallest shift, then the lower."""
    from chronoloom.functions.arrays import dot, rotate

    zero = F.lit(0).cast("long")
    tried = [F.struct(F.aggregate(F.zip_with(rotate(a, k), b, lambda x, y: x * y), zero, lambda s, x: s + x).alias("dot"), F.lit(-abs(k)).alias("near"), F.lit(-k).alias("low"), F.lit(k).alias("shift")) for k in range(-6, 6)]
    return F.array_max(F.array(*tried))


def report(pairs: DataFrame, ref: DataFrame, cand: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, precision and errors of matched pairs (diff, pitch_diff) against all of ref and cand."""
    n_ref, n_cand = ref.groupBy(*by).agg(F.count("*").alias("n_ref")), cand.groupBy(*by).agg(F.count("*").alias("n_cand"))
    got = pairs.groupBy(*by).agg(
        F.count("*").alias("matched"),
        F.count_if(F.col("pitch_diff") == 0).alias("exact"),
        F.count_if((F.col("pitch_diff") != 0) & (F.col("pitch_diff") % 12 == 0)).alias("octave"),
        F.count_if(F.col("pitch_diff") % 12 != 0).alias("wrong"),
        F.avg(F.abs("diff")).alias("mae"),
        F.percentile(F.abs("diff"), 0.95).alias("p95"),
    )
    out = n_ref.join(n_cand, by, "left").join(got, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*by, "n_ref", zero("n_cand"), zero("matched"), zero("exact"), zero("octave"), zero("wrong"), "mae", "p95")


def deviation(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation."""
    mid = rows.groupBy(*by).agg(F.median(value).alias("median"))
    return rows.join(mid, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def peak_normalised(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with level: value over the group's largest magnitude, 0 if that is 0."""
    top = F.max(F.abs(value)).over(W.partitionBy(*by))
    return rows.withColumn("level", F.when(top > 0, F.col(value) / top).otherwise(0.0))
