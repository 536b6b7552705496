"""Validation and projection of timeline rows: lenient, strict and versioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.music import round_half_up


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def normalise_notes(rows: DataFrame, duration: float, by: list[str], tie: str) -> DataFrame:
    """Lenient: bad rows go, values are clamped, a repeat within 18 ms of one of the two rows before goes.

    rows: start, duration, midi, confidence, strength as doubles; seconds.
    """
    good = finite("start") & finite("duration") & finite("midi") & (F.col("start") >= 0) & (F.col("start") < duration) & (F.col("duration") > 0) & F.col("midi").between(24, 108)
    share = lambda c: F.when(finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))).otherwise(0.5)
    kept = rows.where(good).select(*by, tie, "start", F.greatest(F.lit(0.045), F.least(F.col("duration"), F.least(F.lit(6.0), duration - F.col("start")))).alias("duration"), round_half_up(F.col("midi")).alias("midi"), share("confidence").alias("confidence"), share("strength").alias("strength"))
    w = W.partitionBy(*by).orderBy("start", F.col("confidence").desc(), "midi", tie)
    twin = F.lit(False)
    for k in (1, 2):
        twin = twin | F.coalesce((F.lag("midi", k).over(w) == F.col("midi")) & (F.abs(F.col("start") - F.lag("start", k).over(w)) < 0.018), F.lit(False))
    return kept.withColumn("twin", twin).where("not twin").drop("twin")


def strict_notes(rows: DataFrame, duration: float, by: list[str], tie: str, most: int = 20_000, least: int = 8) -> DataFrame:
    """The normalised rows, or an error if one would be lost, or there are too many or too few of a group."""
    before = rows.groupBy(*by).agg(F.count("*").alias("n_before"))
    kept = normalise_notes(rows, duration, by, tie)
    after = kept.groupBy(*by).agg(F.count("*").alias("n_after"))
    ok = (F.col("n_before") == F.coalesce("n_after", F.lit(0))) & F.col("n_before").between(least, most)
    checked = before.join(after, by, "left").withColumn("ok", F.when(ok, True).otherwise(F.raise_error(F.lit("rows would be lost, or their number is out of bounds")).cast("boolean")))
    return kept.join(checked.select(*by, "ok"), by).where("ok").drop("ok")


def move_boundary(segments: DataFrame, by: list[str], index: int, start: int, stop: int, idx: str = "seg_idx", low: str = "start_us", high: str = "end_us") -> DataFrame:
    """Segment `index` gets new bounds and its neighbours follow; the three are marked edited."""
    i = F.col(idx)
    return segments.withColumn("edited", F.abs(i - index) <= 1).withColumn(low, F.when(i == index, F.lit(start)).when(i == index + 1, F.lit(stop)).otherwise(F.col(low)).cast("long")).withColumn(high, F.when(i == index, F.lit(stop)).when(i == index - 1, F.lit(start)).otherwise(F.col(high)).cast("long"))


def valid_boundaries(segments: DataFrame, by: list[str], own: int, neighbour: int, idx: str = "seg_idx", low: str = "start_us", high: str = "end_us") -> DataFrame:
    """segments with valid: at least `own` long, and at least `neighbour` left to each neighbour."""
    w = W.partitionBy(*by).orderBy(idx)
    length = F.col(high) - F.col(low)
    return segments.withColumn("valid", (length >= own) & F.coalesce(F.lag(length).over(w) >= neighbour, F.lit(True)) & F.coalesce(F.lead(length).over(w) >= neighbour, F.lit(True)))


def merge_versions(base: DataFrame, current: DataFrame, automatic: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Three-way merge: a column that was edited since the base keeps its current value, else the automatic one."""
    named = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in columns))
    met = named(current, "c").join(named(base, "b"), key, "left").join(named(automatic, "a"), key, "left")
    pick = lambda c: F.when(~F.col(f"c_{c}").eqNullSafe(F.col(f"b_{c}")) | F.col(f"a_{c}").isNull(), F.col(f"c_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return met.select(key, *map(pick, columns))


def stale(source: Column, version: Column, usable: Column, current: float, least: int = 8) -> Column:
    """Whether a local row has to be made anew: never one with a source or of a newer version; else one of another version, or of too few notes."""
    newer = F.coalesce(finite(version) & (version > current), F.lit(False))
    return source.isNull() & ~newer & (~version.eqNullSafe(F.lit(current)) | (usable < least))


def merge_catalog(songs: DataFrame, catalog: DataFrame, key: str, marker: str) -> DataFrame:
    """songs with the catalog's melody, and its tempo unless the saved rhythm was edited; rows that the catalog lacks stay.

    songs: key, bpm, beats, original_bpm, original_beats, melody, algorithm; catalog: key, melody, bpm (null: none). The
    original's tempo always follows; marker is added to algorithm once.
    """
    entry = catalog.select(key, F.col("melody").alias("c_melody"), F.col("bpm").alias("c_bpm"), F.lit(True).alias("c_found"))
    met = songs.join(entry, key, "left")
    edited = ~F.col("bpm").eqNullSafe(F.col("original_bpm")) | ~F.col("beats").eqNullSafe(F.col("original_beats"))
    told = F.col("c_bpm").isNotNull()
    marked = F.when(F.contains("algorithm", F.lit(marker)), F.col("algorithm")).otherwise(F.concat("algorithm", F.lit(f" / {marker}")))
    new = {"bpm": F.when(told & ~edited, F.col("c_bpm")).otherwise(F.col("bpm")), "original_bpm": F.coalesce("c_bpm", "original_bpm"), "melody": F.when(F.col("c_found"), F.col("c_melody")).otherwise(F.col("melody")), "algorithm": F.when(F.col("c_found"), marked).otherwise(F.col("algorithm"))}
    return met.select(*(new.get(c, F.col(c)).alias(c) for c in songs.columns))


def trusted(source: Column, claimed: Column, content: Column) -> Column:
    """Whether a row may be shown: it has no source, or the digest claimed for it, trimmed and in any case, is its content's."""
    digest = F.lower(F.trim(claimed))
    proven = digest.rlike("^[a-f0-9]{64}$") & (digest == F.sha2(content.cast("binary"), 256))
    return source.isNull() | F.coalesce(proven, F.lit(False))
