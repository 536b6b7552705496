"""Whole pipelines: inspect, convert, compare, refine; each a chain of lazy DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.music import fold_octave
from chronoloom.functions.text import name_score
from chronoloom.operators import aggregates as G
from chronoloom.operators import align as A
from chronoloom.operators import sequences as S


def selects(selectors: list[str], index: Column, ident: Column, name: Column) -> Column:
    """Whether any selector names the part: its number, its id, or a part of its name, all case-folded; an empty one names none."""
    out = F.lit(False)
    for low in filter(None, (s.strip().lower() for s in selectors)):
        out = out | (index == int(low) if low.isdigit() else F.lit(False)) | (F.lower(ident) == low) | F.lower(name).contains(low)
    return out


PVS = ["part_index", "voice", "staff"]


def ranked_streams(notes: DataFrame, by: list[str]) -> DataFrame:
    """Streams of each score (by) with their score as the melody: name, lone onsets, register, density, coverage of
    the whole score, number of notes and upper staff speak for a stream, drums against it."""
    s = G.summarise_streams(notes, [*by, *PVS], "start", "duration", "midi")
    names = notes.groupBy(*by, *PVS).agg(F.min("part_name").alias("part_name"), F.max("is_drum").alias("is_drum"))
    s = s.join(names, [*by, *PVS])
    whole = F.greatest(F.lit(0.001), F.max("last").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))))
    span = F.greatest(F.lit(0.001), F.col("last") - F.col("first"))
    register = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("median_midi") - 45) / 35))
    staff = F.when(F.col("staff") == 1, 0.7).when(F.col("staff") > 1, -0.7).otherwise(0.0)
    size = F.least(F.lit(2.0), F.log2(F.col("notes") + F.lit(1.0)) / 2)
    score = name_score(F.col("part_name")) + 1.5 * F.col("lone") / F.col("onsets") + 1.4 * register + 0.8 * F.least(F.lit(1.0), F.col("notes") / span) + 0.8 * F.least(F.lit(1.0), span / whole) + size + staff - F.when(F.col("is_drum"), 12.0).otherwise(0.0)
    return s.withColumn("score", score)


def inspect(notes: DataFrame) -> DataFrame:
    """Streams of a score, the likeliest melody first."""
    return ranked_streams(notes, []).orderBy(F.col("score").desc(), *PVS)


def melody_of(notes: DataFrame, selectors: list[str] | None = None, voice: int | None = None, staff: int | None = None) -> DataFrame:
    """The chosen streams' upper voice; without a choice the best-ranked stream of each score (path). Drums never count.

    A choice that no note of any score meets is an error.
    """
    picked = notes.where(~F.coalesce("is_drum", F.lit(False)))
    chosen = [(bool(selectors), selects(selectors or [], F.col("part_index"), F.col("part_id"), F.col("part_name")), f"part {selectors}"), (voice is not None, F.col("voice") == voice, f"voice {voice}"), (staff is not None, F.col("staff") == staff, f"staff {staff}")]
    for wanted, test, name in chosen:
        if wanted:
            picked = picked.where(test)
            if not picked.limit(1).count():
                raise ValueError(f"no notes in {name}")
    if not any(wanted for wanted, *_ in chosen):
        best = F.max_by(F.struct(*PVS), F.struct("score", *((-F.col(c)).alias(c) for c in PVS))).alias("b")
        picked = picked.join(ranked_streams(picked, ["path"]).groupBy("path").agg(best).select("path", "b.*"), ["path", *PVS], "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        return pdf.loc[S.skyline(list(zip(pdf.start, pdf.duration, pdf.midi, pdf.velocity))), ["path", "start", "duration", "midi", "velocity"]]

    return picked.groupBy("path").applyInPandas(run, "path string, start double, duration double, midi int, velocity int")


#: Fixed values of converted notes: the application's pitches, the shortest note, the confidence of notes taken as they
#: are, and of aligned ones without and with their pitch in the recording; bounds of the strength.
LOWEST, HIGHEST, SHORTEST, PLAIN, ALIGNED, HEARD, LEAST_STRENGTH = 24, 108, 0.04, 0.98, 0.72, 0.27, 0.25


def convert(notes: DataFrame, offset: float = 0.0, scale: float = 1.0, transpose: int = 0, selectors: list[str] | None = None, voice: int | None = None, staff: int | None = None, alignment: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Application notes of a score's melody, with folded for pitches that were moved into range by octaves.

    alignment: operators.align's rows by path; times are then the recording's and pitches shifted as it
    says, and a note is as sure as its pitch is strong in the recording's frames (path, frame, chroma).
    """
    if scale <= 0:
        raise ValueError("the time scale must be positive")
    m = melody_of(notes, selectors, voice, staff).withColumn("stop", F.col("start") + F.col("duration"))
    if alignment is None:
        m = m.withColumn("shift", F.lit(transpose)).withColumn("confidence", F.lit(PLAIN))
        timed = lambda c: F.col(c) * scale + offset
    else:
        m = m.join(alignment.withColumnRenamed("pitch_shift", "shift"), "path")
        timed = lambda c: A.mapped(F.col(c), F.col("score_times"), F.col("audio_times")) * scale + offset
    raw = F.col("midi") + F.col("shift")
    m = m.withColumn("begin", timed("start")).withColumn("end", timed("stop")).where("end > 0").withColumn("pitch", fold_octave(raw, LOWEST, HIGHEST)).withColumn("folded", ~raw.between(LOWEST, HIGHEST))
    if alignment is not None:
        last = frames.groupBy("path").agg(F.max("frame").alias("last"))
        m = m.join(last, "path").withColumn("frame", F.greatest(F.lit(0), F.least(F.col("last"), F.bround(F.col("begin") * F.col("rate")).cast("long"))))
        m = m.join(frames.select("path", "frame", "chroma"), ["path", "frame"])
        heard = F.element_at("chroma", (F.col("pitch") % 12 + 1).cast("int")) / F.greatest(F.lit(1e-8), F.array_max("chroma"))
        m = m.withColumn("confidence", ALIGNED + HEARD * F.greatest(F.lit(0.0), F.least(F.lit(1.0), heard)))
    start = F.greatest(F.lit(0.0), F.col("begin"))
    length, strength = F.greatest(F.lit(SHORTEST), F.col("end") - start), F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(1.0), F.col("velocity") / 127))
    return m.select("path", F.round(start, 3).alias("start"), F.round(length, 3).alias("duration"), F.col("pitch").alias("midi"), F.round("confidence", 3).alias("confidence"), F.round(strength, 3).alias("strength"), "folded")


def compare(ref: DataFrame, cand: DataFrame, by: list[str], tolerance: float = 0.25) -> DataFrame:
    """The report of a one-to-one monotone match of two melodies per group (start, midi)."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["start", "midi"]), b.sort_values(["start", "midi"])
        am, bm = a.midi.to_list(), b.midi.to_list()
        pairs = S.align_monotone(a.start.to_list(), b.start.to_list(), tolerance)
        out = pd.DataFrame({"diff": [b.start.iloc[j] - a.start.iloc[i] for i, j in pairs], "pitch_diff": [int(bm[j] - am[i]) for i, j in pairs]})
        for c in reversed(by):
            out.insert(0, c, (a if len(a) else b)[c].iloc[0] if len(pairs) else None)
        return out.astype({"diff": float, "pitch_diff": "int64"})

    kinds = ", ".join(f"{c} {ref.schema[c].dataType.simpleString()}" for c in by)
    pairs = ref.groupBy(*by).cogroup(cand.groupBy(*by)).applyInPandas(run, f"{kinds}, diff double, pitch_diff long")
    return G.report(pairs, ref, cand, by)
