"""From samples to chords, key, tempo, beats and waveform of each recording, in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.held import held
from chronoloom.operators import decode as D
from chronoloom.operators import signal as G
from chronoloom.sources.readers import wave_files

#: The rates that analysis and refinement work at, the bounds of a rate and of a recording in seconds, bins of a
#: waveform and the shares of level and peak in one.
ANALYSIS_RATE, REFINE_RATE, LOWEST_RATE, HIGHEST_RATE, SHORTEST_S, LONGEST_S = 11_025, 22_050, 8_000, 96_000, 0.25, 600
BINS, LEVEL_SHARE, PEAK_SHARE = 640, 0.7, 0.3
#: Samples of a rendered recording whose levels and peaks a task takes together.
WAVE_BLOCK = 1 << 19


def checked(pieces: DataFrame | G.Tones, by: list[str], rate: int) -> DataFrame | G.Tones:
    """pieces, refusing recordings out of bounds and samples that are no numbers."""
    if not LOWEST_RATE <= rate <= HIGHEST_RATE:
        raise ValueError("the sample rate is out of bounds")
    seconds = G.lengths(pieces, by).select(*by, (F.col("total") / rate).alias("seconds"))
    refuse = lambda test, text: F.when(test, F.raise_error(F.lit(text)))
    short, long = refuse(F.col("seconds") < SHORTEST_S, "a recording is too short"), refuse(F.col("seconds") > LONGEST_S, "a recording is too long")
    if isinstance(pieces, G.Tones):
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
        ok = F.coalesce(short, long, refuse(~(finite("midi") & finite("level")), "a sample is no number"))
        return pieces._replace(notes=pieces.notes.join(seconds, by).select(*by, F.when(ok.isNull(), F.col("start_us")).alias("start_us"), "midi", "level"))
    odd = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(short, long, refuse(odd, "a sample is no number"))
    return pieces.join(seconds, by).select(*by, "at", F.when(ok.isNull(), F.col("samples")).alias("samples"))


def _waves(tones: G.Tones, by: list[str]) -> DataFrame:
    """by, bins, total, bin, squares, peak of rendered recordings: a row for each part and block."""

    def run(x: np.ndarray, block: int, total: int) -> pd.DataFrame:
        bins, place = min(BINS, total), block * WAVE_BLOCK + np.arange(min(WAVE_BLOCK, total - block * WAVE_BLOCK))
        bin = ((place + 1) * bins - 1) // total
        edge = np.flatnonzero(np.diff(bin, prepend=-1))
        x = x[: len(place)].astype(np.float32)  # what rendered samples are
        return pd.DataFrame({"bins": bins, "total": total, "bin": bin[edge], "squares": np.add.reduceat((x * x).astype(float), edge), "peak": np.maximum.reduceat(np.abs(x), edge).astype(float)})

    return G.on_blocks(G.cut_blocks(tones, by, WAVE_BLOCK, 0, 0), by, WAVE_BLOCK, run, "bins long, total long, bin long, squares double, peak double")


def waveform(pieces: DataFrame | G.Tones, by: list[str]) -> DataFrame:
    """by, waveform: level and peak of up to BINS equal parts of each recording, the highest being 1."""
    if isinstance(pieces, G.Tones):
        level = _waves(pieces, by).groupBy(*by, "bins", "total", "bin").agg(F.sum("squares").alias("squares"), F.max("peak").alias("peak"))
        return _scaled(level, by)
    sized = pieces.join(G.lengths(pieces, by), by)
    bins = F.least(F.lit(BINS), F.col("total"))
    each = sized.select(*by, "total", bins.cast("long").alias("bins"), F.col("at"), F.posexplode("samples").alias("k", "x")).withColumn("place", F.col("at") + F.col("k"))
    # sample j is in bin b where floor(b * total / bins) <= j < floor((b + 1) * total / bins)
    each = each.withColumn("bin", F.floor(((F.col("place") + 1) * F.col("bins") - 1) / F.col("total")))
    level = each.groupBy(*by, "bins", "total", "bin").agg(F.sum(F.col("x") * F.col("x")).alias("squares"), F.max(F.abs("x")).alias("peak"))
    return _scaled(level, by)


def _scaled(level: DataFrame, by: list[str]) -> DataFrame:
    edge = lambda b: F.floor(b * F.col("total") / F.col("bins"))
    value = F.sqrt(F.col("squares") / (edge(F.col("bin") + 1) - edge(F.col("bin")))) * LEVEL_SHARE + F.col("peak") * PEAK_SHARE
    named = level.select(*by, "bin", value.alias("v"))
    top = F.max("v").over(W.partitionBy(*by))
    scaled = named.select(*by, "bin", F.when(top > 0, F.col("v") / top).otherwise(0.0).alias("v"))
    return scaled.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda x: x.v).alias("waveform"))


def analyse(pieces: DataFrame | G.Tones, by: list[str], rate: int) -> DataFrame:
    """by, duration, bpm, beats, waveform, chords (start, end, chord, confidence), key, confidence of each recording.

    pieces: by, at, samples, as operators.signal takes them. Frames and chord paths are worked on in
    blocks of a recording (of Tones the samples too, which are not stored); what one task holds of a whole recording is its envelope, 800 bytes a second.
    """
    good = checked(pieces, by, rate)
    good = good if isinstance(good, G.Tones) else held(good, "samples")
    sized = G.lengths(good, by)
    durations = sized.select(*by, (F.col("total") / rate).alias("duration"))
    scored = held(D.chord_scores(held(G.spectrum(good, by, rate), "frames"), by), "scores")
    found = held(D.chords(scored, durations, by, G.frame_size(rate) // 4 / rate), "chords")
    keys = D.keys_of(scored, found, durations, by)
    beats = G.rhythms_of(good, by, rate).withColumnRenamed("confidence", "beat_confidence")
    lists = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "start", "end", "chord", "confidence"))), lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.chord.alias("chord"), c.confidence.alias("confidence"))).alias("chords"))
    return durations.join(beats, by).join(waveform(good, by), by).join(lists, by).join(keys, by)


def pieces_of(spark: SparkSession, path: str, to: int) -> DataFrame:
    """path, at, samples of the WAV files under path at the rate `to`, whatever theirs is."""
    files = wave_files(spark, path, None, 0.0, LONGEST_S)
    out = spark.createDataFrame([], "path string, at long, samples array<double>")
    for (rate,) in sorted(map(tuple, files.select("sample_rate").distinct().collect())):  # a few rates
        mine = files.where(F.col("sample_rate") == rate).select("path", F.lit(0).cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples"))
        out = out.unionByName(G.resample(mine, ["path"], rate, to))
    return out


def analyse_files(spark: SparkSession, path: str) -> DataFrame:
    """analyse() of the WAV files under path, at the analysis rate."""
    return analyse(pieces_of(spark, path, ANALYSIS_RATE), ["path"], ANALYSIS_RATE)
