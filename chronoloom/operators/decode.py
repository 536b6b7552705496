"""Best paths over frames by max-plus products of frame blocks, so that many tasks decode one recording.

A block's product tells the best score from every state before it to every state at its end. One
short pass over a recording's blocks carries the scores forward, each block then tells which state
before it every state at its end comes from, a second pass picks the ends, and each block traces its
own frames. Scores are whole numbers of 2**-40, so that sums do not depend on where the blocks lie,
and ties go to the lowest state before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.held import held
from chronoloom.operators import sequences as S
from chronoloom.operators.aggregates import MAJOR, MINOR

UNIT, NEVER = 1 << 40, -(1 << 60)
#: Frames of a block.
BLOCK = 512
#: A model gives of a block's frames, in order: their scores [frame, state] and the scores of the steps into a frame [before, after].
Model = Callable[[pd.DataFrame], tuple[np.ndarray, Callable[[int], np.ndarray]]]


def units(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x, float) * UNIT).astype(np.int64)


def product(scores: np.ndarray, step: Callable[[int], np.ndarray]) -> np.ndarray:
    """The best score from each state before the frames to each state at their end."""
    k = scores.shape[1]
    total = np.where(np.eye(k, dtype=bool), 0, NEVER)
    for t in range(len(scores)):
        total = np.maximum((total[:, :, None] + step(t)[None]).max(axis=1) + scores[t], NEVER)
    return total


def pointers(enter: np.ndarray, scores: np.ndarray, step: Callable[[int], np.ndarray]) -> np.ndarray:
    """The best state before each frame's states, if the states before the frames have the scores of enter."""
    now, back = enter, np.empty(scores.shape, np.int16)
    for t in range(len(scores)):
        every = now[:, None] + step(t)
        back[t] = every.argmax(axis=0)
        now = every.max(axis=0) + scores[t]
    return back


def follow(back: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paths [end, frame], the state before the frames) that lead to each of the states of end."""
    now, out = np.asarray(end), np.empty((len(end), len(back)), np.int16)
    for t in range(len(back) - 1, -1, -1):
        out[:, t] = now
        now = back[t, now]
    return out, now


def path_of(enter: np.ndarray, scores: np.ndarray, step: Callable[[int], np.ndarray]) -> np.ndarray:
    """The best path over all frames in one task."""
    now = enter
    for t in range(len(scores)):
        now = (now[:, None] + step(t)).max(axis=0) + scores[t]
    return follow(pointers(enter, scores, step), [int(now.argmax())])[0][0]


def best_path(frames: DataFrame, by: list[str], model: Model, start: np.ndarray, block: int = BLOCK) -> DataFrame:
    """by, frame, state: the best path over the frames (by, frame, what the model reads) of each recording.

    Frames are numbered without gaps. start: the scores of the states before the first frame.
    """
    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in by)
    blocked = frames.withColumn("block", F.floor(F.col("frame") / block))
    name = lambda pdf, **cols: pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, **cols})

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        return name(pdf, block=[pdf.block.iloc[0]], product=[product(*model(pdf.sort_values("frame"))).ravel()])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        now, rows = np.asarray(start, np.int64), []
        pdf = pdf.sort_values("block")
        for k, flat in zip(pdf.block, pdf["product"]):
            rows.append((*(pdf[c].iloc[0] for c in by), k, now, -1))
            now = np.maximum((now[:, None] + np.asarray(flat).reshape(len(now), -1)).max(axis=0), NEVER)
        rows[-1] = (*rows[-1][:-1], int(now.argmax()))
        return pd.DataFrame(rows, columns=[*by, "block", "enter", "last"])

    def ends(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        back = pointers(np.asarray(entry.enter.iloc[0]), *model(pdf.sort_values("frame")))
        return name(pdf, block=[pdf.block.iloc[0]], enter=[entry.enter.iloc[0]], last=[entry["last"].iloc[0]], before=[follow(back, np.arange(back.shape[1]))[1].astype(int)])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False)
        state, out = int(pdf["last"].iloc[0]), []
        for before in pdf.before:
            out.append(state)
            state = int(before[state])
        return pdf.assign(state=out)[[*by, "block", "enter", "state"]]

    def trace(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        back = pointers(np.asarray(entry.enter.iloc[0]), *model(pdf))
        return pdf[[*by, "frame"]].assign(state=follow(back, [int(entry.state.iloc[0])])[0][0])

    key = [*by, "block"]
    products = blocked.groupBy(*key).applyInPandas(multiply, f"{keys}, block long, product array<long>")
    entries = products.groupBy(*by).applyInPandas(carry, f"{keys}, block long, enter array<long>, last int")
    entries = held(entries, "entries")
    links = blocked.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(ends, f"{keys}, block long, enter array<long>, last int, before array<int>")
    picked = links.groupBy(*by).applyInPandas(pick, f"{keys}, block long, enter array<long>, state int")
    return blocked.groupBy(*key).cogroup(picked.groupBy(*key)).applyInPandas(trace, f"{keys}, frame long, state int")


# ---- chords --------------------------------------------------------------------------------------

_SWITCH = np.full((25, 25), S.CHANGE)
_SWITCH[24, :] = _SWITCH[:, 24] = S.CHANGE_NONE
np.fill_diagonal(_SWITCH, 0)
_SWITCH = -units(_SWITCH)
#: The level beside the loud frames' below which a frame is silent, which of the sorted levels counts as
#: loud, and the least confidence of a key.
SILENT_SHARE, LOUD_RANK, LEAST_SILENCE, LEAST_KEY = 0.022, 0.9, 1e-5, 0.18
REACH = len(S.SMOOTH) // 2


def chord_model(pdf: pd.DataFrame) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    return units(np.stack(pdf.emission.to_list())), lambda t: _SWITCH


def chord_scores(frames: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """by, frame, time, emission, sure, wide: scores of 24 triads and no chord, confidence and smoothed chroma of each frame.

    frames: by, frame, time, rms, flatness, chroma. A block's frames come with REACH more on either side.
    """
    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in by)
    loud = F.element_at(F.sort_array(F.collect_list("rms")), (F.floor(F.count(F.lit(1)) * LOUD_RANK) + 1).cast("int"))
    quiet = frames.groupBy(*by).agg(F.greatest(F.lit(LEAST_SILENCE), loud * SILENT_SHARE).alias("silence"))
    met = frames.join(quiet, by).withColumn("block", F.explode(F.sequence(F.floor((F.col("frame") - REACH) / block), F.floor((F.col("frame") + REACH) / block))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        chroma = np.stack(pdf.chroma.map(np.asarray).to_list()).astype(float)
        scores, sure = S.chord_emissions(chroma, pdf.rms.to_numpy(float), pdf.flatness.to_numpy(float), float(pdf.silence.iloc[0]))
        out = pdf[[*by, "frame", "time"]].assign(emission=list(scores), sure=sure, wide=list(S.smoothed(chroma)[0]))
        return out[pdf.frame.to_numpy() // block == int(pdf.block.iloc[0])]

    return met.groupBy(*by, "block").applyInPandas(run, f"{keys}, frame long, time double, emission array<double>, sure double, wide array<double>")


def chords(scored: DataFrame, durations: DataFrame, by: list[str], hop_s: float, block: int = BLOCK) -> DataFrame:
    """by, nth, start, end, chord, confidence: runs of the best chord path; borders lie half a step before a run's first frame.

    scored: chord_scores(); durations: by, duration in seconds.
    """
    path = best_path(scored.select(*by, "frame", "emission"), by, chord_model, np.zeros(25, np.int64), block)
    w = W.partitionBy(*by).orderBy("frame")
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    runs = path.join(scored.select(*by, "frame", "time", "sure"), [*by, "frame"]).withColumn("nth", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    grouped = runs.withColumn("new", F.col("time") - hop_s / 2).groupBy(*by, "nth").agg(F.min("new").alias("start"), F.first("state").alias("state"), F.avg("sure").alias("sure"))
    order = W.partitionBy(*by).orderBy("nth")
    named = F.element_at(F.array(*map(F.lit, [*S.PITCHES, S.NO_CHORD])), F.col("state") + 1)
    met = grouped.join(durations, by)
    start = F.when(F.col("nth") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("start")))
    end = F.coalesce(F.least(F.col("duration"), F.lead("start").over(order)), F.col("duration"))
    return met.select(*by, F.col("nth").cast("long").alias("nth"), start.alias("start"), end.alias("end"), named.alias("chord"), F.when(F.col("state") < 24, F.col("sure")).otherwise(0.0).alias("confidence"))


def keys_of(scored: DataFrame, found: DataFrame, durations: DataFrame, by: list[str]) -> DataFrame:
    """by, key, confidence: the key whose profile agrees best with the sure frames' chroma, null where the chords are unsure."""
    total = scored.groupBy(*by).agg(F.array(*(F.sum(F.element_at("wide", k + 1) * F.col("sure")) for k in range(12))).alias("g"))
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / 12
    profiles = []
    for mode, profile in enumerate((MAJOR, MINOR)):
        off = np.array(profile) - np.mean(profile)
        for root in range(12):
            weights = np.roll(off / np.sqrt((off**2).sum()), root)
            profiles.append(F.struct(F.array(*map(F.lit, weights.tolist())).alias("w"), F.lit(-12 * mode - root).alias("order"), F.lit(f"{S.PITCHES[root]} {('major', 'minor')[mode]}").alias("key")))
    score = lambda p: F.aggregate(F.zip_with(F.col("g"), p["w"], lambda x, w: (x - F.col("mean")) * w), F.lit(0.0), lambda a, x: a + x)
    tried = F.transform(F.array(*profiles), lambda p: F.struct(score(p).alias("score"), p["order"].alias("order"), p["key"].alias("key")))
    best = total.withColumn("mean", mean).select(*by, F.when(F.col("mean") > 0, F.array_max(tried).getField("key")).alias("key"))
    length = F.col("end") - F.col("start")
    sure = found.groupBy(*by).agg(F.sum(F.col("confidence") * length).alias("sum")).join(durations, by).select(*by, (F.col("sum") / F.col("duration")).alias("confidence"))
    return best.join(sure, by).select(*by, F.when(F.col("confidence") >= LEAST_KEY, F.col("key")).alias("key"), "confidence")


# ---- melodies ------------------------------------------------------------------------------------

_BASE, _GAIN = (S._melody_steps()[k] for k in (0, 1))
_STEPS = units(_BASE)
MELODY_START = np.where(np.arange(S.SILENT + 1) == S.SILENT, 0, units(-6.0))


def melody_model(pdf: pd.DataFrame) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """act and onset: arrays of the pitches from LOWEST to HIGHEST."""
    act, onset = (np.stack(pdf[c].map(np.asarray).to_list()).astype(float) for c in ("act", "onset"))
    attacks = np.c_[onset, np.zeros(len(onset))]
    return units(S.melody_scores(act, onset)), lambda t: _STEPS + units(_GAIN * attacks[t][None]) if attacks[t].any() else _STEPS


def sparse_melody_model(pdf: pd.DataFrame) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """sounds: of each frame the pitches that sound as (pitch from LOWEST on, act, onset); each pitch once."""
    act, onset = np.zeros((len(pdf), S.HIGHEST - S.LOWEST + 1)), np.zeros((len(pdf), S.HIGHEST - S.LOWEST + 1))
    for t, sounds in enumerate(pdf.sounds):
        for x in sounds:
            act[t, x["pitch"]], onset[t, x["pitch"]] = x["act"], x["onset"]
    attacks = np.c_[onset, np.zeros(len(onset))]
    return units(S.melody_scores(act, onset)), lambda t: _STEPS + units(_GAIN * attacks[t][None]) if attacks[t].any() else _STEPS


def melody_frames(notes: DataFrame, by: list[str]) -> DataFrame:
    """by, frame, sounds: a row for each of the melody model's frames up to the last note's end, for sparse_melody_model().

    notes: by, start_us, end_us, midi, conf (0 to 1), strength; of notes of one pitch in one frame the surest counts, and at its first frame its strength.
    """
    at = lambda c: F.floor(F.col(c) * S.FRAME_RATE / (1_000_000 * S.FRAME_HOP))
    rows = notes.select(*by, at("start_us").alias("first"), at("end_us").alias("until"), (F.col("midi") - S.LOWEST).cast("int").alias("pitch"), "conf", "strength")
    inside = rows.where(F.col("pitch").between(0, S.HIGHEST - S.LOWEST)).withColumn("frame", F.explode(F.sequence("first", "until")))
    heard = inside.groupBy(*by, "frame", "pitch").agg(F.max("conf").alias("act"), F.max(F.when(F.col("frame") == F.col("first"), F.col("strength")).otherwise(0.0)).alias("onset"))
    sounds = heard.groupBy(*by, "frame").agg(F.collect_list(F.struct("pitch", "act", "onset")).alias("sounds"))
    every = rows.groupBy(*by).agg(F.max("until").alias("last")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    none = F.array().cast(sounds.schema["sounds"].dataType)
    return every.join(sounds, [*by, "frame"], "left").select(*by, "frame", F.coalesce("sounds", none).alias("sounds"))


def melody_runs(notes: DataFrame, by: list[str]) -> DataFrame:
    """by, first, until, state: stretches of equal pitch of the best path over melody_frames() of notes, in whole numbers.

    A best path passes through silence wherever nothing sounds (sequences.phrase_paths), so tasks decode phrases, and no frame is a row.
    """
    at = lambda c: F.floor(F.col(c) * S.FRAME_RATE / (1_000_000 * S.FRAME_HOP))
    rows = notes.select(*by, at("start_us").alias("a"), at("end_us").alias("b"), (F.col("midi") - S.LOWEST).cast("int").alias("pitch"), F.col("conf").cast("double").alias("conf"), F.col("strength").cast("double").alias("strength"))
    last = F.max("b").over(W.partitionBy(*by))
    inside = rows.withColumn("end", last).where(F.col("pitch").between(0, S.HIGHEST - S.LOWEST) & (F.col("a") <= F.col("b")))
    w = W.partitionBy(*by).orderBy("a")
    new = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)) + 1).cast("int"), F.lit(0))
    told = inside.withColumn("new", new).withColumn("phrase", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    tasks = 4 * notes.sparkSession.sparkContext.defaultParallelism
    lists = told.repartition(tasks, *by, "phrase").groupBy(*by, "phrase").agg(F.min("a").alias("begin"), (F.max("b") == F.max("end")).alias("final"), F.collect_list(F.struct("a", "b", "pitch", "conf", "strength")).alias("n"))
    names = ["a", "b", "pitch", "conf", "strength"]
    phrases = lists.select(*by, "begin", "final", *(F.col(f"n.{c}").alias(c) for c in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            size = pdf.a.map(len).to_numpy()
            a, b, pitch, conf, strength = (np.concatenate(pdf[c].to_list()) for c in names)
            begin = np.repeat(pdf.begin.to_numpy(), size)
            paths = S.phrase_paths(np.repeat(np.arange(len(pdf)), size), a - begin, b - begin, pitch, conf, strength, pdf.final.to_numpy(bool), units)
            found = [(i, f, u, s) for i, path in enumerate(paths) for s, f, u in S._runs_of(path) if s < S.SILENT]
            row, first, until, state = (np.array(c, int) for c in zip(*found)) if found else [np.zeros(0, int)] * 4
            shift = pdf.begin.to_numpy()[row]
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[row] for c in by}, "first": first + shift, "until": until + shift, "state": state})

    keys = ", ".join(f"{c} {notes.schema[c].dataType.simpleString()}" for c in by)
    return phrases.mapInPandas(run, f"{keys}, first long, until long, state int")


def runs(path: DataFrame, by: list[str]) -> DataFrame:
    """by, first, until, state: stretches of equal states of a path."""
    w = W.partitionBy(*by).orderBy("frame")
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    numbered = path.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("until"), F.first("state").alias("state")).drop("run")
