"""Alignment of scores to recordings: stacked features, warping by anti-diagonals, time maps.

A warping's cells depend on the two anti-diagonals before theirs, so a diagonal is one array step.
Only every so many diagonals are kept; the way back computes those between two kept ones again, so
memory grows with the sides of the matrix and not with its area. Matrices of few cells are kept whole, which
saves computing anything twice. A corridor limits each row to a range
of columns; coarse to fine, it lies around the path of the averaged features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the features: widths of smoothing in frames, weights of onsets by pitch class and of onsets, least
#: weight of a note and what its velocity adds.
CHROMA_SIGMA, ONSET_SIGMA, ONSET_CHROMA, ONSET, LEAST_NOTE, LOUD_NOTE = 0.65, 0.8, 0.55, 0.3, 0.35, 0.65
#: Moves back, in order of preference: both sides, the second side, the first; weights of the coarse-to-fine steps.
BOTH, SECOND, FIRST = range(3)
EQUAL_WEIGHTS, FINE_WEIGHTS = (1.0, 1.0, 1.0), (2.0, 1.5, 1.5)
#: Frames averaged at each scale of coarse to fine, and how far a corridor reaches around a path, in frames of its scale.
SCALES, REACH = (25, 5, 1), 10
SHIFTS = range(-6, 6)
#: Cells of a matrix that is kept whole.
WHOLE = 1 << 20
TIMES = "score_times array<double>, audio_times array<double>, pitch_shift int, cost double, rate double"


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """x along its last axis with a Gaussian of four sigmas, reflected at the ends."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = x.shape[-1]
    # reflection about the border, as often as the reach asks for
    at = np.arange(-reach, n + reach) % (2 * n)
    padded = x[..., np.minimum(at, 2 * n - 1 - at)]
    return sum(k * padded[..., i : i + n] for i, k in enumerate(kernel / kernel.sum()))


def unit_columns(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("a feature is no number")
    return x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), 1e-8)


def stacked(chroma: np.ndarray, onset_chroma: np.ndarray, onset: np.ndarray) -> np.ndarray:
    """25 rows of features, each column of length 1: pitch classes, their onsets, onsets."""
    onset = onset / max(float(onset.max(initial=0)), 1e-8)
    return unit_columns(np.vstack([chroma, ONSET_CHROMA * onset_chroma, ONSET * onset[None]]))


def score_features(start: np.ndarray, end: np.ndarray, midi: np.ndarray, velocity: np.ndarray, rate: float, duration: float | None = None) -> np.ndarray:
    """Features of notes at `rate` frames a second."""
    if not len(start):
        raise ValueError("a score without notes has no features")
    duration = float(end.max()) if duration is None else duration
    frames = max(2, int(np.ceil(duration * rate)) + 1)
    chroma, onset_chroma, onset = np.zeros((12, frames)), np.zeros((12, frames)), np.zeros(frames)
    first = np.clip(np.rint(start * rate).astype(int), 0, frames - 1)
    stop = np.maximum(first + 1, np.minimum(frames, np.ceil(end * rate).astype(int)))
    weight = LEAST_NOTE + LOUD_NOTE * np.clip(velocity / 127, 0, 1)
    pitch = midi.astype(int) % 12
    # each note's weight from its first frame to its last: sums of what begins less what ends
    change = np.zeros((12, frames + 1))
    np.add.at(change, (pitch, first), weight)
    np.add.at(change, (pitch, stop), -weight)
    chroma = np.maximum(np.cumsum(change, axis=1)[:, :-1], 0)
    np.add.at(onset_chroma, (pitch, first), weight)
    np.add.at(onset, first, weight)
    return stacked(smooth(chroma, CHROMA_SIGMA), smooth(onset_chroma, ONSET_SIGMA), smooth(onset, ONSET_SIGMA))


def audio_features(chroma: np.ndarray, onset: np.ndarray) -> np.ndarray:
    """Features of a recording's frames: their pitch classes (12 rows), the rises of these, and an onset strength a frame."""
    rise = np.maximum(0, np.diff(chroma, axis=1, prepend=chroma[:, :1]))
    return stacked(chroma, smooth(rise, ONSET_SIGMA), onset)


def pitch_shift(score: np.ndarray, audio: np.ndarray) -> int:
    """The shift of the score in semitones whose mean pitch classes agree best with the recording's; ties to the smallest, then the lowest."""
    a, b = score[:12].mean(axis=1), audio[:12].mean(axis=1)
    norm = max(float(np.linalg.norm(a)), 1e-8) * max(float(np.linalg.norm(b)), 1e-8)
    return max(SHIFTS, key=lambda k: (float(np.roll(a, k) @ b / norm), -abs(k)))


def shifted(features: np.ndarray, semitones: int) -> np.ndarray:
    out = features.copy()
    for k in (0, 12):
        out[k : k + 12] = np.roll(features[k : k + 12], semitones, axis=0)
    return out


# ---- warping -------------------------------------------------------------------------------------


class _Diagonals:
    """The accumulated costs of warping the columns of a onto those of b, diagonal by diagonal."""

    def __init__(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, subsequence: bool, weights: tuple):
        self.a, self.b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        self.low, self.high, self.subsequence, self.weights = low, high, subsequence, weights
        rows = np.arange(len(low))
        #: Rows of diagonal d are those with row + low <= d <= row + high: both sums grow with the row.
        self.enter, self.leave = rows + low, rows + high
        self.last = int(self.leave[-1])

    def rows(self, d: int) -> tuple[int, int]:
        return int(np.searchsorted(self.leave, d, "left")), int(np.searchsorted(self.enter, d, "right"))

    def distances(self, d: int, first: int, stop: int) -> np.ndarray:
        gap = self.a[first:stop] - self.b[d - stop + 1 : d - first + 1][::-1]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def step(self, d: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs by row, moves by row) of diagonal d from the one and the two before; both padded by one row in front."""
        n = len(self.low)
        first, stop = self.rows(d)
        cost, move = np.full(n + 1, np.inf), np.full(n, -1, np.int8)
        if stop <= first:
            return cost, move
        c = self.distances(d, first, stop)
        ways = np.stack([two[first:stop] + self.weights[BOTH] * c, one[first + 1 : stop + 1] + self.weights[SECOND] * c, one[first:stop] + self.weights[FIRST] * c])
        best = ways.argmin(axis=0)
        value = ways[best, np.arange(len(c))]
        if first == 0 and (self.subsequence or d == 0):  # the path may begin here
            value[0], best[0] = c[0], -1
        cost[first + 1 : stop + 1], move[first:stop] = value, best
        return cost, move


def warp(a: np.ndarray, b: np.ndarray, subsequence: bool = False, low: np.ndarray | None = None, high: np.ndarray | None = None, weights: tuple = EQUAL_WEIGHTS) -> tuple[np.ndarray, float]:
    """(path of pairs, cost) of the cheapest warping between the columns of two feature matrices, by Euclidean distance.

    subsequence: a may begin and end anywhere in b. low, high: the first and last column of b that each
    column of a may meet, neither falling. Ties prefer a step of both, then of b, then of a.
    """
    n, m = a.shape[1], b.shape[1]
    low = np.zeros(n, int) if low is None else low
    high = np.full(n, m - 1) if high is None else high
    work = _Diagonals(a, b, low, high, subsequence, weights)
    if n * m <= WHOLE:
        return _warp_whole(work, m)
    every = max(1, int(np.sqrt(n + m)))
    none = np.full(n + 1, np.inf)
    one, two, kept = none, none, []
    ends = np.full(m, np.inf)
    for d in range(work.last + 1):
        if d % every == 0:
            kept.append((one, two))
        now, _ = work.step(d, one, two)
        if 0 <= d - (n - 1) < m:
            ends[d - (n - 1)] = now[n]
        one, two = now, one
    j = int(ends.argmin()) if subsequence else m - 1
    cost, i, path, moves, begin = float(ends[j]), n - 1, [], [], 0
    if not np.isfinite(cost):
        raise ValueError("the corridor has no path")
    while True:
        path.append((i, j))
        d = i + j
        if not moves or d < begin:
            begin = d // every * every
            one, two = kept[d // every]
            moves = []
            for k in range(begin, d + 1):
                now, move = work.step(k, one, two)
                moves.append(move)
                one, two = now, one
        move = moves[d - begin][i]
        if move < 0:
            return np.array(path[::-1]), cost
        i, j = i - (move != SECOND), j - (move != FIRST)


def _warp_whole(work: _Diagonals, m: int) -> tuple[np.ndarray, float]:
    """warp() with all costs and distances kept: the same sums and ties, moves only where the path goes."""
    n, weights, open_start = len(work.low), work.weights, work.subsequence
    far = np.empty((n, m))
    rows = max(1, (1 << 16) // m)
    for i in range(0, n, rows):
        gap = (work.a[i : i + rows, None] - work.b[None]).reshape(-1, work.a.shape[1])
        far[i : i + rows] = np.sqrt(np.einsum("ij,ij->i", gap, gap)).reshape(-1, m)
    flat = far.ravel()
    # row d + 2 is diagonal d, padded by one in front
    costs = np.full((work.last + 3, n + 1), np.inf)
    every = np.arange(work.last + 1)
    firsts, stops = np.searchsorted(work.leave, every, "left").tolist(), np.searchsorted(work.enter, every, "right").tolist()
    for d, (first, stop) in enumerate(zip(firsts, stops)):
        if stop <= first:
            continue
        # cell i of the diagonal is at i * m + d - i
        at = d + first * (m - 1)
        c = flat[at : at + (stop - first - 1) * (m - 1) + 1 : max(1, m - 1)]
        two, one, now = costs[d], costs[d + 1], costs[d + 2, first + 1 : stop + 1]
        np.minimum(two[first:stop] + weights[BOTH] * c, one[first + 1 : stop + 1] + weights[SECOND] * c, out=now)
        np.minimum(now, one[first:stop] + weights[FIRST] * c, out=now)
        if first == 0 and (open_start or d == 0):
            now[0] = c[0]
    ends = np.full(m, np.inf)
    last = costs[n + 1 :, n][:m]
    ends[: len(last)] = last
    j = int(ends.argmin()) if open_start else m - 1
    cost, i, path = float(ends[j]), n - 1, []
    if not np.isfinite(cost):
        raise ValueError("the corridor has no path")
    while True:
        path.append((i, j))
        if i == 0 and (open_start or j == 0):
            return np.array(path[::-1]), cost
        c, d = far[i, j], i + j
        ways = costs[d, i] + weights[BOTH] * c, costs[d + 1, i + 1] + weights[SECOND] * c, costs[d + 1, i] + weights[FIRST] * c
        move = ways.index(min(ways))
        i, j = i - (move != SECOND), j - (move != FIRST)


def corridor(path: np.ndarray, n: int, m: int, factor: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns around a coarser path that each of n rows may meet: its cells, `factor` times as fine, and `reach` more on every side."""
    low, high = np.full(n, m), np.full(n, -1)
    for i, j in path.tolist():
        rows = slice(max(0, int(i * factor) - reach), min(n, int((i + 1) * factor) + reach + 1))
        low[rows] = np.minimum(low[rows], max(0, int(j * factor) - reach))
        high[rows] = np.maximum(high[rows], min(m - 1, int((j + 1) * factor) + reach))
    # rows that averaging cut off meet what their neighbours do
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    low[0], high[-1] = 0, m - 1
    return np.minimum(low, m - 1), high


def averaged(x: np.ndarray, by: int) -> np.ndarray:
    """Means of every `by` columns, of length 1."""
    if by == 1:
        return x
    edges = np.arange(0, x.shape[1], by)
    return unit_columns(np.add.reduceat(x, edges, axis=1) / np.diff(np.append(edges, x.shape[1])))


def warp_fine(a: np.ndarray, b: np.ndarray, scales: tuple[int, ...] = SCALES, reach: int = REACH) -> tuple[np.ndarray, float]:
    """warp() from end to end, coarse to fine: each scale looks only around the path of the one before."""
    path, before = None, None
    for by in scales:
        x, y = averaged(a, by), averaged(b, by)
        around = corridor(path, x.shape[1], y.shape[1], before / by, reach) if path is not None else (None, None)
        path, cost = warp(x, y, False, *around, weights=FINE_WEIGHTS)
        before = by
    return path, cost


def strictly_rising(path: np.ndarray) -> np.ndarray:
    """The pairs of a path that lie above the last kept one on both sides; the last pair stays, whatever it displaces."""
    kept = [path[0]]
    for pair in path[1:]:
        if (pair > kept[-1]).all():
            kept.append(pair)
    while len(kept) > 1 and not (path[-1] > kept[-1]).all() and (path[-1] != kept[-1]).any():
        kept.pop()
    if (path[-1] > kept[-1]).all():
        kept.append(path[-1])
    return np.array(kept)


def time_map(path: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(score times, audio times): the median audio frame of each score frame, made rising."""
    if path.ndim != 2 or path.shape[1:] != (2,) or not len(path) or not np.isfinite(path).all():
        raise ValueError("no warping path")
    rows, at = np.unique(path[:, 0], return_inverse=True)
    order = np.lexsort((path[:, 1], at))
    value, edge = path[order, 1].astype(float), np.searchsorted(at[order], np.arange(len(rows)))
    count = np.diff(np.append(edge, len(path)))
    median = (value[edge + (count - 1) // 2] + value[edge + count // 2]) / 2
    return rows / rate, np.maximum.accumulate(median) / rate


def mapped(at: Column, score_times: Column, audio_times: Column) -> Column:
    """The time in the recording of a time in the score: between two points on their line, beyond them at the score's own speed."""
    n = F.size(score_times)
    k = F.size(F.filter(score_times, lambda x: x <= at))
    x0, x1, y0, y1 = (F.element_at(a, F.least(F.greatest(j, F.lit(1)), n)) for a in (score_times, audio_times) for j in (k, k + 1))
    inner = y0 + F.when(x1 > x0, (y1 - y0) * (at - x0) / (x1 - x0)).otherwise(0.0)
    first, last = (F.element_at(audio_times, j) + at - F.element_at(score_times, j) for j in (F.lit(1), n))
    return F.when(k == 0, first).when(k >= n, last).otherwise(inner)


def full(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The score anywhere in the recording; the cost is that of a path's mean step."""
    path, cost = warp(a, b, subsequence=True)
    return path, cost / len(path)


def fine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """From end to end, coarse to fine, both sides rising; the cost is the mean distance of the pitch classes along the path."""
    path, _ = warp_fine(a, b)
    path = strictly_rising(path)
    return path, float(np.linalg.norm(a[:12, path[:, 0]] - b[:12, path[:, 1]], axis=0).mean())


ALIGNERS = {"full": full, "fine": fine}


def align(notes: DataFrame, frames: DataFrame, by: list[str], rate: float, aligner: str = "full", transpose: int | None = None) -> DataFrame:
    """by, score_times, audio_times, pitch_shift, cost, rate: where each score's times lie in its recording.

    notes: by, start, end (seconds), midi, velocity, without drums; frames: by, frame, rms, chroma, `rate`
    frames a second. aligner: a name of ALIGNERS or a function of two feature matrices. transpose: the
    shift of the score, or None to estimate it. A score or a recording alone gives no row.
    """
    return align_each(notes, frames, by, rate, [aligner], transpose).drop("aligner")


def align_each(notes: DataFrame, frames: DataFrame, by: list[str], rate: float, aligners: list, transpose: int | None = None) -> DataFrame:
    """align() by several aligners, which read a score and a recording once: by, aligner, score_times, audio_times, pitch_shift, cost, rate."""
    if not np.isfinite(rate) or rate <= 0:
        raise ValueError("the feature rate must be positive")
    for aligner in aligners:
        if isinstance(aligner, str) and aligner not in ALIGNERS:
            raise ValueError(f"no aligner {aligner}")
    find = [(a, ALIGNERS[a]) if isinstance(a, str) else (getattr(a, "__name__", str(k)), a) for k, a in enumerate(aligners)]
    kinds = ", ".join(f"{c} {notes.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, "aligner", *(c.split()[0] for c in TIMES.split(", "))]

    def run(score: pd.DataFrame, audio: pd.DataFrame) -> pd.DataFrame:
        if score.empty or audio.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        audio = audio.sort_values("frame")
        chroma = np.stack(audio.chroma.map(np.asarray).to_list()).T.astype(float)
        rise = np.maximum(0, np.diff(audio.rms.to_numpy(float), prepend=0))
        b = audio_features(chroma, rise)
        a = score_features(*(score[c].to_numpy(float) for c in ("start", "end", "midi", "velocity")), rate)
        shift = pitch_shift(a, b) if transpose is None else transpose
        rows = []
        for name, f in find:
            path, cost = f(shifted(a, shift), b)
            score_times, audio_times = time_map(path, rate)
            rows.append((*(score[c].iloc[0] for c in by), name, score_times, audio_times, shift, cost, rate))
        return pd.DataFrame(rows, columns=names)

    heard = frames.select(*by, "frame", "rms", "chroma")
    return notes.select(*by, "start", "end", "midi", "velocity").groupBy(*by).cogroup(heard.groupBy(*by)).applyInPandas(run, f"{kinds}, aligner string, {TIMES}")
