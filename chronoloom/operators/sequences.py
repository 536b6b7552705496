"""Ordered folds: operators whose every step reads the result of the step before.

Carries are one Arrow pass over partitions sorted by group and time: a step keeps what it carries and
nothing else, so time is linear and memory does not grow with a group. Decoding, alignment and signal
work run one group at a time; a group is one track.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# ---- folds over sorted partitions ---------------------------------------------------------------

#: Rows of a batch that a fold gives back.
BATCH = 8192


def fold(df: DataFrame, by: list[str], order: list[str], fields: list[str], step: Callable[[Iterator[tuple]], Iterable[tuple]], out: str) -> DataFrame:
    """by and the columns of out: what step yields for each group's rows of fields, sorted by order."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    names, n = [*by, *fields], len(by)
    schema = f"{kinds}, {out}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(len(names)))))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:n]):
            for got in step(r[n:] for r in group):
                held.append(key + got)
                if len(held) == BATCH:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    return df.repartition(*by).sortWithinPartitions(*by, *order).select(*names).mapInArrow(run, schema)


def anchored_groups(df: DataFrame, by: list[str], window: int, start: str = "start_us", tie: str = "note_id") -> DataFrame:
    """by, start, tie, anchor: events grouped around the first of each group, not chained."""

    def step(rows):
        anchor = None
        for at, name in rows:
            if anchor is None or at - anchor > window:
                anchor = at
            yield at, name, anchor

    return fold(df, by, [start, tie], [start, tie], step, f"{start} long, {tie} long, anchor long")


def suppress_onsets(df: DataFrame, by: list[str], gap: int, start: str = "start_us", strength: str = "strength_pct", tie: str = "note_id") -> DataFrame:
    """Of onsets closer than `gap` to the last kept one the stronger stays, and the anchor moves to it."""

    def step(rows):
        last = None
        for row in rows:
            if last is None or row[0] - last[0] >= gap:
                if last:
                    yield last
                last = row
            elif row[2] > last[2]:
                last = row
        if last:
            yield last

    return fold(df, by, [start, tie], [start, tie, strength], step, f"{start} long, {tie} long, {strength} long")


def monophonic(df: DataFrame, by: list[str], near: int, shortest: int, start: str = "start_us", dur: str = "dur_us", conf: str = "conf_pct", tie: str = "note_id") -> DataFrame:
    """One voice: onsets within `near` of the last kept collapse to the surer, then longer one; a note ends
    where the next starts; one left shorter than `shortest` goes, possibly one kept before."""

    def collapsed(rows):
        last = None
        for row in rows:  # at, conf, tie, dur
            if last is None or row[0] - last[0] >= near:
                if last:
                    yield last
                last = row
            elif (row[1], row[3]) > (last[1], last[3]):
                last = row
        if last:
            yield last

    def step(rows):
        held = None
        for at, _, name, length in collapsed(rows):
            if length < shortest:
                continue
            if held:
                cut = min(held[2], at - held[0])
                if cut >= shortest:
                    yield held[0], held[1], cut
            held = (at, name, length)
        if held:
            yield held

    rows = df.withColumn("sure", -F.col(conf))
    return fold(rows, by, [start, "sure", tie], [start, conf, tie, dur], step, f"{start} long, {tie} long, {dur} long")


#: The open strings and the highest fret of the instrument, and its costs in thousandths: a fret, a fret
#: past the 12th, and moves by strings and by frets.
OPEN_STRINGS, HIGHEST_FRET = (40, 45, 50, 55, 59, 64), 22
FRET, FAR_FRET, STRING_MOVE, FRET_MOVE = 130, 200, 160, 25


def lane_of(midi: int, last: tuple[int, int] | None) -> tuple[int, int]:
    """String and fret of a pitch, folded into the instrument's range by octaves, after the place before it."""
    low, high = OPEN_STRINGS[0], OPEN_STRINGS[-1] + HIGHEST_FRET
    if midi < low:
        midi += 12 * (-(-(low - midi) // 12))
    if midi > high:
        midi -= 12 * (-(-(midi - high) // 12))
    spots = [(midi - o, -s) for s, o in enumerate(OPEN_STRINGS) if 0 <= midi - o <= HIGHEST_FRET]

    def cost(spot):
        fret, string = spot[0], -spot[1]
        move = STRING_MOVE * abs(string - last[0]) + FRET_MOVE * abs(fret - last[1]) if last else 0
        return FRET * fret + FAR_FRET * max(0, fret - 12) + move, -string

    fret, string = min(spots, key=cost)
    return -string, fret


def lanes(df: DataFrame, by: list[str], start: str = "start_us", tie: str = "note_id", midi: str = "midi") -> DataFrame:
    """String and fret of each note: cheap frets, short moves from the place before; ties to the higher string."""

    def step(rows):
        last = None
        for name, pitch in rows:
            last = lane_of(pitch, last)
            yield name, *last

    return fold(df, by, [start, tie], [tie, midi], step, f"{tie} long, string int, fret int")


def bounded_cache(df: DataFrame, by: list[str], order: list[str], key: str, most: int) -> DataFrame:
    """by, order, key, hit, evicted: requests of a key against a first-in-first-out cache of `most` keys for each group.

    A key that is not held is put in, and where the cache is full the one put in first goes; a hit renews nothing.
    """
    names = {c: df.schema[c].dataType.simpleString() for c in (*order, key)}

    def step(rows):
        held: dict = {}
        for row in rows:
            asked, evicted = row[-1], None
            hit = asked in held
            if not hit:
                if len(held) >= most:
                    evicted = next(iter(held))
                    del held[evicted]
                held[asked] = None
            yield *row, hit, evicted

    return fold(df, by, order, [*order, key], step, ", ".join(f"{c} {t}" for c, t in names.items()) + f", hit boolean, evicted {names[key]}")


def merge_same_pitch(df: DataFrame, by: list[str], gap: int, start: str = "start_us", stop: str = "end_us", tie: str = "note_id", value: str = "conf_pct", attack: str = "attack") -> DataFrame:
    """Events of a group (a pitch) join the merged one before if the rest is at most `gap` and they have no attack of their own."""

    def step(rows):
        last = None
        for at, name, end, worth, attacked in rows:
            if last and at - last[2] <= gap and not attacked:
                last = (last[0], last[1], max(last[2], end), max(last[3], worth))
            else:
                if last:
                    yield last
                last = (at, name, end, worth)
        if last:
            yield last

    return fold(df, by, [start, tie], [start, tie, stop, value, attack], step, f"{start} long, {tie} long, {stop} long, {value} long")


def separate_onsets(df: DataFrame, by: list[str], near: int, start: str = "start_us", rank: str = "rank", tie: str = "note_id") -> DataFrame:
    """Of onsets closer than `near` to the last kept one the higher rank stays; equal: the earlier."""
    return suppress_onsets(df, by, near, start, rank, tie)


def upper_voice(df: DataFrame, by: list[str], window: int, gap: int, start: str = "start_us", stop: str = "end_us", tie: str = "note_id", midi: str = "midi") -> DataFrame:
    """The highest note of each anchored group; then neighbours of one pitch with a rest of at most `gap` are one."""
    grouped = anchored_groups(df, by, window, start, tie).join(df.drop(start), [*by, tie])
    top = grouped.groupBy(*by, "anchor").agg(F.max_by(F.struct(start, stop, midi, tie), F.struct(midi, F.col(stop), -F.col(tie))).alias("e")).select(*by, "e.*")
    w = W.partitionBy(*by).orderBy(start, tie)
    joins = (F.lag(midi).over(w) == F.col(midi)) & (F.col(start) - F.lag(stop).over(w) <= gap)
    top = top.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return top.groupBy(*by, "run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.first(midi).alias(midi)).drop("run")


def tempo_times(points: DataFrame, changes: DataFrame, default_bpm: int) -> DataFrame:
    """Quarter positions (score_id, query_id, pos) to microseconds by tempo changes (score_id, pos, bpm, ord).

    The last change of a position counts; before the first the default tempo holds.
    """
    from chronoloom.operators.joins import as_of

    c = changes.groupBy("score_id", "pos").agg(F.max_by("bpm", "ord").alias("bpm"))
    first = c.groupBy("score_id").agg(F.min("pos").alias("m")).where("m > 0").select("score_id", F.lit(0).cast("long").alias("pos"), F.lit(default_bpm).cast("long").alias("bpm"))
    w = W.partitionBy("score_id").orderBy("pos")
    span = F.floor((F.col("pos") - F.lag("pos").over(w)) * 60_000_000 / F.lag("bpm").over(w))
    c = c.unionByName(first).withColumn("span", span).withColumn("at", F.coalesce(F.sum("span").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    met = as_of(points, c.withColumnRenamed("pos", "p0"), ["score_id"], "pos", "p0", ["p0", "bpm", "at"], "p0")
    return met.withColumn("us", (F.col("at") + F.floor((F.col("pos") - F.col("p0")) * 60_000_000 / F.col("bpm"))).cast("long")).drop("p0", "bpm", "at")


# ---- decoding in Python -----------------------------------------------------------------------

PITCHES = [f"{n}{m}" for m in ("", "m") for n in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")]
NO_CHORD = "N"


def viterbi(emission: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """The state of each row with the highest total of emissions less switch costs; ties to the lowest state."""
    score, back = emission[0].copy(), np.zeros(emission.shape, np.int32)
    for t in range(1, len(emission)):
        total = score[:, None] - switch
        back[t] = total.argmax(axis=0)
        score = total.max(axis=0) + emission[t]
    path = np.empty(len(emission), np.int32)
    path[-1] = score.argmax()
    for t in range(len(emission) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


#: Fixed values of the chord model: weights of root, third and fifth; share of the cosine, of the coverage and the penalty
#: of a triad that lacks a note; scores of no chord in a quiet, an ambiguous and a clear frame.
TRIAD_WEIGHTS = np.array([1, 0.9, 0.75])
COSINE, COVERAGE, LACKING, LEAST_NOTE = 0.8, 0.2, 0.15, 0.025
NO_CHORD_QUIET, NO_CHORD_AMBIGUOUS, NO_CHORD_CLEAR, QUIETENED = 1.3, 0.78, 0.42, 0.25
CHANGE, CHANGE_NONE = 0.95, 0.80
_TRIADS = np.array([[k % 12, (k + (4 if k < 12 else 3)) % 12, (k + 7) % 12] for k in range(24)])


#: Frames on either side that a frame's chroma is smoothed over, with falling weights.
SMOOTH = (1, 2, 3, 2, 1)


def smoothed(chroma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each frame's pitch class shares with those of its neighbours, and the weight of all."""
    n = len(chroma)
    padded = np.pad(chroma, ((2, 2), (0, 0)))
    wide = sum(w * padded[k : k + n] for k, w in enumerate(SMOOTH))
    total = wide.sum(axis=1)
    return wide / np.where(total, total, 1)[:, None], total


def chord_emissions(chroma: np.ndarray, rms: np.ndarray, flatness: np.ndarray, silence: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of 24 triads and no chord for each frame, and each frame's confidence. silence: the level below which the recording is quiet, by default from its own frames."""
    n = len(chroma)
    wide, total = smoothed(chroma)
    parts = wide[:, _TRIADS]  # frames, triads, notes of a triad
    coverage, support = parts.sum(axis=2), parts.min(axis=2)
    norm = np.sqrt((wide**2).sum(axis=1))
    cosine = parts @ TRIAD_WEIGHTS / (norm * np.sqrt((TRIAD_WEIGHTS**2).sum()) + 1e-12)[:, None]
    triads = COSINE * cosine + COVERAGE * coverage - np.where(support < LEAST_NOTE, LACKING, 0)
    rows, best = np.arange(n), triads.argmax(axis=1)
    high = np.maximum(triads[rows, best], 0)
    second = np.maximum(np.partition(triads, -2, axis=1)[:, -2], 0)
    found = triads[rows, best] > 0
    of_best, least = np.where(found, coverage[rows, best], 0), np.where(found, support[rows, best], 0)
    if silence is None:
        silence = max(1e-5, np.sort(rms)[int(n * 0.9)] * 0.022)
    mute = (rms < silence) | (total < 1e-12) | (flatness > 0.42)
    ambiguous = (least < LEAST_NOTE) | ((high - second < 0.02) & (of_best < 0.65))
    none = np.where(mute, NO_CHORD_QUIET, np.where(ambiguous, NO_CHORD_AMBIGUOUS, NO_CHORD_CLEAR))
    sure = np.clip(of_best * (1 - flatness) * (0.42 + 0.48 * np.clip((high - second) / 0.2, 0, 1)), 0, 0.9)
    return np.c_[np.where(mute[:, None], QUIETENED * triads, triads), none], np.where(mute, 0, sure)


def chord_runs(time: np.ndarray, rms: np.ndarray, flatness: np.ndarray, chroma: np.ndarray, duration: float) -> list[tuple[float, float, str, float]]:
    """(start, end, chord, confidence) of the best chord path; borders lie half a step before a run's first frame."""
    switch = np.full((25, 25), CHANGE)
    switch[24, :] = switch[:, 24] = CHANGE_NONE
    np.fill_diagonal(switch, 0)
    scores, sure = chord_emissions(chroma, rms, flatness)
    path = viterbi(scores, switch)
    first = np.r_[0, np.flatnonzero(np.diff(path)) + 1]
    half = (time[1] - time[0] if len(time) > 1 else duration) / 2
    border = np.r_[0.0, np.clip(time[first[1:]] - half, 0, duration), duration]
    means = np.add.reduceat(sure, first) / np.diff(np.r_[first, len(path)])
    names = [*PITCHES, NO_CHORD]
    return [(float(border[k]), float(border[k + 1]), names[path[f]], float(means[k]) if path[f] < 24 else 0.0) for k, f in enumerate(first)]


def decode_chords(frames: DataFrame, by: list[str], hop_s: float) -> DataFrame:
    """by, start, end, chord, confidence: runs of the best chord path over frames (time, rms, flatness, chroma) of a hop each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        time, chroma = pdf.time.to_numpy(float), np.stack(pdf.chroma.map(np.asarray).to_list()).astype(float)
        got = chord_runs(time, pdf.rms.to_numpy(float), pdf.flatness.to_numpy(float), chroma, float(time[-1]) + hop_s)
        out = pd.DataFrame(got, columns=["start", "end", "chord", "confidence"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    schema = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in by)
    return frames.groupBy(*by).applyInPandas(run, f"{schema}, start double, end double, chord string, confidence double")


#: Fixed values of the melody model: pitches, frames of a note, of a flicker and between attacks; thresholds of
#: attacks and of activity; the model's frame grid in samples.
LOWEST, HIGHEST = 40, 96
NOTE_FRAMES, FLICKER_FRAMES, ATTACK_FRAMES = 4, 10, 6
STRONG_ATTACK, WEAK_ATTACK, ACTIVE = 0.6, 0.5, 0.31
FRAME_HOP, FRAME_RATE, WINDOW_FRAMES, WINDOW_SAMPLES = 256, 22_050, 172, 43_844
_WINDOW_SHIFT = FRAME_HOP / FRAME_RATE * (WINDOW_FRAMES - WINDOW_SAMPLES / FRAME_HOP) + 0.0018
SILENT = HIGHEST - LOWEST + 1


def frame_time(frame: int) -> float:
    """The time of a frame of the activation matrix; the model's windows overlap by a little."""
    return max(0.0, frame * FRAME_HOP / FRAME_RATE - _WINDOW_SHIFT * (frame // WINDOW_FRAMES))


def _melody_steps() -> tuple[np.ndarray, np.ndarray]:
    """Scores of a step between states, and the weight of the next pitch's onset in it."""
    gap = np.abs(np.subtract.outer(np.arange(SILENT + 1), np.arange(SILENT + 1))).astype(float)
    pick = [gap <= 2, gap <= 7, gap <= 12]
    base = np.select(pick, [-0.025 * gap, -0.09 - 0.045 * gap, -0.48 - 0.07 * (gap - 7)], -1.15 - 0.055 * (gap - 12))
    gain = np.select(pick, [0.36, 0.42, 0.48], 0.5)
    base[SILENT, :], gain[SILENT, :] = -0.12, 0.54
    base[:, SILENT], gain[:, SILENT] = -0.16, 0
    np.fill_diagonal(base, 0.11)
    np.fill_diagonal(gain, 0)
    return base, gain


def melody_scores(act: np.ndarray, onset: np.ndarray) -> np.ndarray:
    """Scores of each frame's pitches and of silence."""
    pitch = np.arange(LOWEST, HIGHEST + 1)
    top = np.where(act >= 0.27, pitch, LOWEST).max(axis=1)
    voiced = (act - 0.27) * 3.8 + onset * 0.72 - 0.06 * np.maximum(0, top[:, None] - pitch) - 0.045 * np.maximum(0, 52 - pitch)
    loud = act.max(axis=1)
    return np.c_[voiced, np.where(loud < 0.22, 0.34, np.where(loud < 0.31, 0.08, -0.52))]


def melody_path(act: np.ndarray, onset: np.ndarray) -> np.ndarray:
    """The best state of each frame: a pitch from LOWEST on, or SILENT."""
    base, gain = (np.ascontiguousarray(x.T) for x in _melody_steps())  # by next state, then by the one before
    scores = melody_scores(act, onset)
    attacks = np.c_[onset, np.zeros(len(onset))]
    state = np.full(SILENT + 1, -6.0)
    state[SILENT] = 0
    back = np.empty(scores.shape, np.int16)
    rows, attacked = np.arange(SILENT + 1), attacks.any(axis=1)
    for t in range(len(scores)):
        every = base + state
        if attacked[t]:
            every += gain * attacks[t][:, None]
        back[t] = best = every.argmax(axis=1)
        state = every[rows, best] + scores[t]
        state -= state.max()
    path = np.empty(len(scores), np.int16)
    now = int(state.argmax())
    for t in range(len(scores) - 1, -1, -1):
        path[t] = now
        now = back[t, now]
    return path


#: Cells of the phrases that are decoded side by side.
PHRASE_CELLS = 1 << 20


def phrase_paths(phrase: np.ndarray, first: np.ndarray, until: np.ndarray, pitch: np.ndarray, sure: np.ndarray, strong: np.ndarray, final: np.ndarray, whole: Callable[[np.ndarray], np.ndarray] | None = None) -> list[np.ndarray]:
    """melody_path() of many phrases side by side: notes of phrase 0, 1, ... with their first and last frame in it, pitch from LOWEST on, activity, and onset at the first frame.

    A pitch that does not sound in a frame scores at least half below silence and has no onset there, which is more
    than silence costs in steps: so a best path only meets silence and what sounds, and passes through
    silence wherever nothing does. A phrase lies between two such rests; final tells that a track ends with it.
    whole: what makes whole numbers of scores, or None for scores that are kept near 0.
    """
    n, count = len(final), np.zeros(len(final), int)
    length = np.zeros(n, int)
    np.maximum.at(length, phrase, until + 1)
    known, column = np.unique(phrase * (SILENT + 1) + pitch, return_inverse=True)
    owner = known // (SILENT + 1)
    np.add.at(count, owner, 1)
    offset = np.cumsum(count) - count
    place = np.arange(len(known)) - offset[owner]  # a pitch's state in its phrase
    k, out = place[column], [None] * n
    notes = np.argsort(phrase, kind="stable")
    edge = np.searchsorted(phrase[notes], np.arange(n + 1))
    kind = np.where(count <= 6, count, -(-count // 6) * 6)
    order, a = np.lexsort((length, kind)), 0
    base, gain = _melody_steps()
    never = -np.inf if whole is None else -(1 << 60)
    while a < n:
        states = int(kind[order[a]]) + 1
        b, most = a, 0
        while b < n and kind[order[b]] == states - 1 and (b == a or (b - a + 1) * int(length[order[b]]) * states <= PHRASE_CELLS):
            b += 1
        mine = order[a:b]
        size, frames, a = len(mine), int(length[mine[-1]]), b
        row = np.empty(n, int)
        row[mine] = np.arange(size)
        own = np.concatenate([notes[edge[p] : edge[p + 1]] for p in mine])
        names = np.full((size, states), SILENT)
        cols = np.concatenate([np.arange(offset[p], offset[p] + count[p]) for p in mine])
        names[row[owner[cols]], place[cols]] = known[cols] % (SILENT + 1)
        act, onset = np.zeros((frames, size, states - 1)), np.zeros((frames, size, states))
        spans = until[own] - first[own] + 1
        at = np.repeat(first[own] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
        np.maximum.at(act, (at, np.repeat(row[phrase[own]], spans), np.repeat(k[own], spans)), np.repeat(sure[own], spans))
        np.maximum.at(onset, (first[own], row[phrase[own]], k[own]), strong[own])
        height = names[:, :-1] + LOWEST
        top = np.where(act >= 0.27, height, LOWEST).max(axis=2, initial=LOWEST)
        voiced = (act - 0.27) * 3.8 + onset[:, :, :-1] * 0.72 - 0.06 * np.maximum(0, top[:, :, None] - height) - 0.045 * np.maximum(0, 52 - height)
        loud = act.max(axis=2, initial=0)
        scores = np.concatenate([voiced, np.where(loud < 0.22, 0.34, np.where(loud < 0.31, 0.08, -0.52))[:, :, None]], axis=2)
        step, more = (x[names[:, :, None], names[:, None, :]] for x in (base, gain))
        if whole is not None:
            scores, step = whole(scores), whole(step)
        scores[:, np.pad(names[:, :-1] == SILENT, ((0, 0), (0, 1)))] = never  # states beyond a phrase's own
        state = np.full((size, states), never)
        state[:, -1] = 0
        back, attacked = np.empty((frames, size, states), np.int16), onset.any(axis=2)
        begin = np.searchsorted(length[mine], np.arange(frames), "right")  # shorter phrases are over
        for t in range(frames):
            lo = int(begin[t])
            every = step[lo:] + state[lo:, :, None]
            hit = np.flatnonzero(attacked[t, lo:])
            if len(hit):
                risen = more[lo:][hit] * onset[t, lo:][hit][:, None, :]
                every[hit] += risen if whole is None else whole(risen)
            back[t, lo:] = every.argmax(axis=1)
            now = every.max(axis=1) + scores[t, lo:]
            state[lo:] = now - now.max(axis=1, keepdims=True) if whole is None else np.maximum(now, never)
        end = np.where(final[mine], state.argmax(axis=1), (state + step[:, :, -1]).argmax(axis=1))
        path = np.empty((frames, size), np.int16)
        for t in range(frames - 1, -1, -1):
            lo = int(begin[t])
            path[t, lo:] = names[np.arange(lo, size), end[lo:]]
            end[lo:] = back[t, np.arange(lo, size), end[lo:]]
        for i, p in enumerate(mine):
            out[p] = path[: length[p], i]
    return out


def phrases_of(first: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The phrase of each note, by first frame: a new one after a frame in which no note sounds."""
    over = np.maximum.accumulate(until)
    return np.cumsum(np.r_[0, first[1:] > over[:-1] + 1])


def _runs_of(path: np.ndarray) -> list[list[int]]:
    """[state, first frame, end] of each run of equal states."""
    cut = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)]
    return [[int(path[a]), int(a), int(b)] for a, b in zip(cut[:-1], cut[1:])]


class _Roll:
    """An activation matrix with the questions that clean-up asks of it."""

    def __init__(self, act: np.ndarray, onset: np.ndarray):
        self.act, self.onset = act, onset

    def peak(self, t: int, state: int) -> bool:
        x = self.onset[t, state]
        return x >= (self.onset[t - 1, state] if t else 0) and x > (self.onset[t + 1, state] if t + 1 < len(self.onset) else 0)

    def short_attack(self, state: int, a: int, b: int, neighbours: set[int]) -> bool:
        """Whether a run too short for a note is one: strongly attacked, active, and no neighbour sounds on under it."""
        if b - a >= NOTE_FRAMES or self.onset[a:b, state].max() < STRONG_ATTACK or self.act[a:b, state].mean() < ACTIVE:
            return False
        return all(s == SILENT or self.act[a:b, s].max() < ACTIVE for s in neighbours - {state})

    def smooth(self, path: np.ndarray) -> np.ndarray:
        """Short rests inside a pitch are bridged and weak, short changes of pitch go, in up to four passes."""
        for _ in range(4):
            runs, changed = _runs_of(path), False
            for k, (state, a, b) in enumerate(runs):
                left = runs[k - 1][0] if k else SILENT
                right = runs[k + 1][0] if k + 1 < len(runs) else SILENT
                new = state
                if state == SILENT:
                    if b - a <= 2 and left == right != SILENT:
                        again = b < len(path) and self.peak(b, left) and self.onset[b, left] >= WEAK_ATTACK and self.act[b, left] >= ACTIVE
                        new = state if again else left
                elif b - a < FLICKER_FRAMES:
                    around = {s for s, there in ((left, k > 0), (right, k + 1 < len(runs))) if there}
                    weak = self.onset[a:b, state].max() < STRONG_ATTACK
                    if weak or (b - a < NOTE_FRAMES and not self.short_attack(state, a, b, around)):
                        heard = {left, right} - {SILENT}
                        new = left if left == right else heard.pop() if len(heard) == 1 else SILENT
                if new != state:
                    runs[k][0], changed = new, True
            path = np.concatenate([np.full(b - a, s, np.int16) for s, a, b in runs])
            if not changed:
                break
        return path

    def attacks(self, state: int, a: int, b: int) -> list[int]:
        """The frames at which a run is attacked: its first, and later ones that are strong or follow a valley."""
        marks = [a]
        for t in (a + ATTACK_FRAMES + np.flatnonzero(self.onset[a + ATTACK_FRAMES : b - 1, state] >= WEAK_ATTACK)).tolist():
            x = self.onset[t, state]
            valley = (self.act[max(0, t - 3) : t, state] < ACTIVE).any()
            if self.peak(t, state) and (x >= STRONG_ATTACK or (x >= WEAK_ATTACK and valley)) and t - marks[-1] >= ATTACK_FRAMES:
                marks.append(t)
        return marks


def decode_melody(activity: np.ndarray, onset: np.ndarray, first_midi: int = 21) -> list[tuple[float, float, int, float, float]]:
    """(start, duration, midi, confidence, strength): one voice through a pitch activation matrix (frames x pitches)."""
    if not len(activity):
        return []
    keep = slice(LOWEST - first_midi, HIGHEST - first_midi + 1)
    clean = lambda x: np.clip(np.nan_to_num(x[:, keep], nan=0, posinf=0, neginf=0), 0, 1)
    roll = _Roll(clean(activity), clean(onset))
    return _cleaned(roll, melody_path(roll.act, roll.onset))


def decode_notes(tracks: list[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[float, float, int, float, float]]]:
    """decode_melody() of the piano roll of each track's notes: first and last frame, pitch from LOWEST on, activity, onset at the first frame, and the track's frames; a value for an array.

    Pitches out of range are left out before; activity and onset lie between 0 and 1.
    """
    tracks = [tuple(x[np.argsort(t[0], kind="stable")] for x in t[:5]) + (t[5],) for t in tracks]
    split = [phrases_of(t[0], t[1]) if len(t[0]) else np.zeros(0, int) for t in tracks]
    before = np.cumsum([0, *(s[-1] + 1 if len(s) else 0 for s in split)])
    begin = [np.r_[t[0][:1], t[0][1:][np.diff(s) > 0]] for t, s in zip(tracks, split)]
    final = [np.maximum.reduceat(t[1], np.r_[0, np.flatnonzero(np.diff(s)) + 1]) == t[5] - 1 if len(s) else np.zeros(0, bool) for t, s in zip(tracks, split)]
    all_of = lambda parts: np.concatenate([*parts, np.zeros(0, int)])
    shift = [t[b] - g[s] for b in (0, 1) for t, s, g in zip(tracks, split, begin)]
    phrase = all_of(s + k for s, k in zip(split, before)).astype(int)
    paths = phrase_paths(phrase, all_of(shift[: len(tracks)]).astype(int), all_of(shift[len(tracks) :]).astype(int), *(all_of(t[c] for t in tracks) for c in (2, 3, 4)), np.concatenate([*final, np.zeros(0, bool)])) if len(phrase) else []
    for i, (first, until, pitch, sure, strong, frames) in enumerate(tracks):
        path = np.full(frames, SILENT, np.int16)
        for at, p in zip(begin[i].tolist(), paths[before[i] : before[i + 1]]):
            path[at : at + len(p)] = p
        # a pitch's frames lie side by side
        act, onset = np.zeros((SILENT, frames)), np.zeros((SILENT, frames))
        for a, b, s, x in zip(first.tolist(), until.tolist(), pitch.tolist(), sure.tolist()):
            np.maximum(act[s, a : b + 1], x, out=act[s, a : b + 1])
        np.maximum.at(onset, (pitch, first), strong)
        yield _cleaned(_Roll(act.T, onset.T), path)


def _cleaned(roll: _Roll, path: np.ndarray) -> list[tuple[float, float, int, float, float]]:
    """The notes of a decoded path after clean-up."""
    runs, out = _runs_of(roll.smooth(path)), []
    for k, (state, a, b) in enumerate(runs):
        if state == SILENT:
            continue
        marks = [*roll.attacks(state, a, b), b]
        around = {runs[j][0] for j in (k - 1, k + 1) if 0 <= j < len(runs)}
        for s, e in zip(marks, marks[1:]):
            if e - s < NOTE_FRAMES and not ((s, e) == (a, b) and roll.short_attack(state, a, b, around)):
                continue
            begin = frame_time(s)
            out.append((round(begin, 3), round(max(0.045, frame_time(e) - begin), 3), state + LOWEST, round(float(roll.act[s:e, state].mean()), 3), round(float(roll.onset[s:e, state].max()), 3)))
    return out


def skyline(notes: list[tuple], window: float = 0.025, low: int = 36, high: int = 96, shortest: float = 0.035) -> list[int]:
    """Indices of the upper voice of (start, duration, midi, velocity): of each onset group the note that is high in
    the group, near the last chosen pitch and loud; a lower group under a note that still sounds is left out."""
    usable = [i for i, (_, d, m, _) in enumerate(notes) if low <= m <= high and d >= shortest]
    chosen: list[int] = []
    group: list[int] = []

    def close():
        last = notes[chosen[-1]] if chosen else None
        top = max(group, key=lambda i: (notes[i][2], notes[i][3], notes[i][1]))
        if last is None:
            return top
        over = last[0] + last[1] - notes[group[0]][0]
        if notes[top][2] < last[2] and over > max(window, min(0.1, 0.2 * last[1])):
            return None
        bottom, span = min(notes[i][2] for i in group), max(1, notes[top][2] - min(notes[i][2] for i in group))

        def worth(i):
            _, d, m, v = notes[i]
            leap = abs(m - last[2])
            return 1.2 * (m - bottom) / span + -0.045 * leap - (0.5 if leap > 12 else 0.0) + v / 254, m, d

        return max(group, key=worth)

    for i in [*sorted(usable, key=lambda i: (notes[i][0], notes[i][2])), None]:
        if group and (i is None or notes[i][0] - notes[group[0]][0] > window):
            best = close()
            chosen += [best] if best is not None else []
            group = []
        if i is not None:
            group.append(i)
    out: list[int] = []
    for i in chosen:  # one of two equal pitches at one time, the longer
        if out and abs(notes[out[-1]][0] - notes[i][0]) < 0.005 and notes[out[-1]][2] == notes[i][2]:
            out[-1] = i if notes[i][1] > notes[out[-1]][1] else out[-1]
        else:
            out.append(i)
    return out


def align_monotone(ref: list[float], cand: list[float], tolerance: float) -> list[tuple[int, int]]:
    """One-to-one pairs in order within tolerance: most pairs, then least total distance; of equal ways
    one that pairs here, else one that leaves out the earlier onset, the reference's at a tie.

    Only the band within tolerance is kept: where a reference onset is too early for a candidate it
    pairs with no later one either, so that cell equals the next row's, and likewise the other way.
    """
    slack = tolerance + 1e-9
    low = [bisect.bisect_left(cand, r - slack) for r in ref]
    high = [bisect.bisect_right(cand, r + slack) for r in ref]
    n, m = len(ref), len(cand)
    low.append(m), high.append(m)
    below: list[tuple[int, float]] = [(0, 0.0)]  # a row: cells low to high, the last one equal to the next row's
    actions: list[bytearray] = [bytearray()] * n
    for i in range(n - 1, -1, -1):
        a, b, first = low[i], high[i], low[i + 1]
        row: list[tuple[int, float]] = [(0, 0.0)] * (b - a + 1)
        row[b - a] = below[max(b, first) - first]
        how = actions[i] = bytearray(b - a)
        for j in range(b - 1, a - 1, -1):
            skip_ref, skip_cand = below[max(j, first) - first], row[j + 1 - a]
            early = ref[i] <= cand[j]
            best, act = (skip_ref, 1) if skip_ref > skip_cand or (skip_ref == skip_cand and early) else (skip_cand, 2)
            d = abs(ref[i] - cand[j])
            if d <= tolerance:
                c, s = below[max(j + 1, first) - first]
                if (c + 1, s - d) >= best:
                    best, act = (c + 1, s - d), 3
            row[j - a], how[j - a] = best, act
        below = row
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        j = max(j, low[i])
        act = actions[i][j - low[i]] if j < high[i] else 1
        if act == 3:
            pairs.append((i, j))
        i, j = i + (act != 2), j + (act != 1)
    return pairs


def collapse_path(path: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: the median b of each a of a warping path, made monotone by its running maximum."""
    mid = path.groupBy(*by, "a").agg(F.median("b").alias("m"))
    return mid.select(*by, "a", F.max("m").over(W.partitionBy(*by).orderBy("a").rowsBetween(W.unboundedPreceding, 0)).alias("b"))
