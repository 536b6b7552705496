"""Warping against the full matrix, time maps, alignment of scores to rendered recordings."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import align as A
from chronoloom.operators import signal as G
from chronoloom.plans import cli


def full_matrix(a, b, subsequence, low=None, high=None, weights=(1, 1, 1)):
    """(cost, path) by the whole matrix, a cell at a time."""
    n, m = a.shape[1], b.shape[1]
    acc, how = np.full((n, m), np.inf), np.full((n, m), -1)
    for i in range(n):
        for j in range(m):
            if low is not None and not low[i] <= j <= high[i]:
                continue
            c = np.sqrt(((a[:, i] - b[:, j]) ** 2).sum())
            if i == 0 and (subsequence or j == 0):
                acc[i, j] = c
                continue
            for k, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
                if i >= di and j >= dj and acc[i - di, j - dj] + weights[k] * c < acc[i, j]:
                    acc[i, j], how[i, j] = acc[i - di, j - dj] + weights[k] * c, k
    i, j = n - 1, int(acc[-1].argmin()) if subsequence else m - 1
    path = [(i, j)]
    while how[i, j] >= 0:
        di, dj = ((1, 1), (0, 1), (1, 0))[how[i, j]]
        i, j = i - di, j - dj
        path.append((i, j))
    return acc[n - 1, path[0][1]], path[::-1]


@pytest.mark.parametrize("subsequence", [False, True])
def test_warp_equals_the_full_matrix(subsequence):
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (1, 9), (9, 1), (7, 7), (13, 29), (40, 23), (60, 61)]:
        a, b = rng.random((4, n)), rng.random((4, m))
        for x, y in ((a, b), (np.round(a), np.round(b))):  # the second with many ties
            path, cost = A.warp(x, y, subsequence)
            want, steps = full_matrix(x, y, subsequence)
            assert abs(cost - want) < 1e-9 and (np.round(x) is x or path.tolist() == [list(p) for p in steps])


def test_corridor_equals_the_full_matrix():
    rng = np.random.default_rng(2)
    a, b = rng.random((3, 30)), rng.random((3, 40))
    middle = np.linspace(0, 39, 30)
    low, high = np.maximum(0, middle - 4).astype(int), np.minimum(39, middle + 5).astype(int)
    path, cost = A.warp(a, b, False, low, high, A.FINE_WEIGHTS)
    want, steps = full_matrix(a, b, False, low, high, A.FINE_WEIGHTS)
    assert abs(cost - want) < 1e-9 and path.tolist() == [list(p) for p in steps]
    with pytest.raises(ValueError, match="no path"):
        A.warp(a, b, False, np.r_[np.zeros(15, int), np.full(15, 30)], np.r_[np.full(15, 5), np.full(15, 39)])


def test_warp_needs_little_memory():
    rng = np.random.default_rng(3)
    a, b = rng.random((3, 3000)), rng.random((3, 3000))
    tracemalloc.start()
    path, _ = A.warp(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and path[0].tolist() == [0, 0] and path[-1].tolist() == [2999, 2999]  # the matrix has 72 MB


def test_coarse_to_fine_finds_the_path():
    rng = np.random.default_rng(4)
    base = A.unit_columns(A.smooth(rng.random((12, 900)), 3.0))
    place = np.cumsum(rng.choice([0.6, 1.0, 1.5], 700))
    place = np.minimum(899, place / place[-1] * 899).astype(int)
    found, _ = A.warp_fine(base[:, place], base)
    exact, _ = A.warp(base[:, place], base, weights=A.FINE_WEIGHTS)
    off = [abs(j - place[i]) for i, j in found.tolist()]
    assert np.mean(off) < 2 and found[0].tolist() == [0, 0] and found[-1].tolist() == [699, 899]
    assert np.mean([abs(j - place[i]) for i, j in exact.tolist()]) >= np.mean(off) - 1


def test_strictly_rising():
    path = np.array([[0, 0], [0, 1], [1, 1], [1, 2], [2, 3], [3, 3], [3, 4]])
    got = A.strictly_rising(path)
    assert got.tolist() == [[0, 0], [1, 1], [2, 3], [3, 4]] and (np.diff(got, axis=0) > 0).all()
    assert A.strictly_rising(np.array([[0, 0], [1, 5], [2, 5]])).tolist() == [[0, 0], [2, 5]]
    assert A.strictly_rising(np.array([[3, 3]])).tolist() == [[3, 3]]


def test_time_map():
    score, audio = A.time_map(np.array([[2, 5], [2, 4], [1, 3], [0, 1]]), 2.0)
    assert score.tolist() == [0.0, 0.5, 1.0] and audio.tolist() == [0.5, 1.5, 2.25]
    for bad in (np.zeros((0, 2)), np.zeros((3, 3)), np.array([[0, np.nan]])):
        with pytest.raises(ValueError):
            A.time_map(bad, 2.0)


def test_mapped_times(spark):
    got = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 0.25, 1.0, 2.0, 3.0)], "t double").select(A.mapped(F.col("t"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(1.5), F.lit(3.5))).alias("x"))
    assert [r.x for r in got.collect()] == [-0.5, 0.5, 0.75, 1.5, 3.5, 4.5]


def test_smoothing_reflects():
    x = np.array([1.0, 0, 0, 0, 2])
    kernel = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    kernel /= kernel.sum()
    want = np.convolve(np.r_[x[2::-1], x, x[:1:-1]], kernel, "valid")
    assert np.allclose(A.smooth(x, 0.8), want) and abs(A.smooth(x, 0.8).sum() - x.sum()) < 1e-9
    assert np.allclose(A.smooth(np.array([3.0]), 0.8), [3.0])


def test_score_features_by_hand():
    f = A.score_features(np.array([0.0, 1.0]), np.array([1.0, 2.0]), np.array([60, 67]), np.array([127, 0]), 4.0)
    assert f.shape == (25, 9) and np.allclose(np.linalg.norm(f, axis=0), 1)
    assert f[0, 1] > 0.9 and f[7, 6] > 0.9 and f[12, 0] > f[12, 2] and f[24, 0] > f[24, 2]
    for k in (-5, 0, 3):
        assert A.pitch_shift(A.shifted(f, -k), f) == k
    with pytest.raises(ValueError):
        A.score_features(*(np.zeros(0),) * 4, 4.0)


def melody(rng, n):
    length = rng.choice([0.3, 0.45, 0.6], n)
    start = np.cumsum(length) - length
    return start, start + length * 0.9, 55 + np.cumsum(rng.integers(-4, 5, n)) % 24


@pytest.mark.parametrize("aligner", ["full", "fine"])
def test_scores_meet_their_recordings(spark, aligner):
    rng = np.random.default_rng(5)
    rate, notes, played, truth = 8000, [], [], {}
    for k in (1, 2):
        start, end, midi = melody(rng, 40)
        notes += [(k, float(s), float(e), int(m), 90) for s, e, m in zip(start, end, midi)]
        speed = 1.25 if k == 1 else 0.9
        truth[k] = start * speed
        played += [(k, int(s * speed * 1e6), int(m) + 2, 0.8) for s, m in zip(start, midi)]
    notes = spark.createDataFrame(notes, "rec long, start double, end double, midi int, velocity int")
    samples = G.render(spark.createDataFrame(played, "rec long, start_us long, midi int, level double"), ["rec"], rate)
    frames = G.spectrum(samples, ["rec"], rate)
    hop = G.frame_size(rate) // 4
    for r in A.align(notes, frames, ["rec"], rate / hop, aligner).collect():
        got = np.interp(truth[r.rec] / (1.25 if r.rec == 1 else 0.9), r.score_times, r.audio_times)
        assert r.pitch_shift == 2 and np.median(np.abs(got - truth[r.rec])) < 0.15, (r.rec, aligner)
        assert (np.diff(r.audio_times) >= 0).all() and r.cost >= 0
    with pytest.raises(ValueError, match="no aligner"):
        A.align(notes, frames, ["rec"], 8.0, "other")
    with pytest.raises(ValueError, match="rate"):
        A.align(notes, frames, ["rec"], 0.0)
    assert A.align(notes.limit(0), frames, ["rec"], rate / hop).count() == 0


SCORE = "path string, part_index int, voice int, staff int, start double, duration double, midi int, velocity int, part_id string, part_name string, is_drum boolean"


def test_convert_with_selectors_and_alignment(spark):
    rows = [("s", 0, 1, 1, 0.5 * k, 0.4, 72 + k, 90, "P1", "Vocal Melody", False) for k in range(6)] + [("s", 1, 2, 2, 0.5 * k, 0.4, 48, 60, "P2", "Piano", False) for k in range(6)] + [("s", 2, 1, 1, 0.0, 0.4, 40, 60, "P3", "Drums", True)]
    notes = spark.createDataFrame(rows, SCORE)
    pitches = lambda **how: [r.midi for r in cli.convert(notes, **how).orderBy("start", "midi").collect()]
    assert pitches() == [72, 73, 74, 75, 76, 77] == pitches(selectors=["vocal"]) == pitches(selectors=["p1"]) == pitches(selectors=["0"])
    assert set(pitches(selectors=["1"])) == set(pitches(voice=2)) == set(pitches(staff=2)) == {48}
    for wrong in ({"selectors": [""]}, {"selectors": ["organ"]}, {"selectors": ["drums"]}, {"voice": 7}, {"selectors": ["vocal"], "staff": 2}):
        with pytest.raises(ValueError, match="no notes"):
            cli.convert(notes, **wrong)
    folded = cli.convert(notes, transpose=36, selectors=["vocal"]).orderBy("start").collect()
    assert [r.midi for r in folded][:2] == [108, 97] and [r.folded for r in folded][:2] == [False, True]
    late = cli.convert(notes, offset=-0.45, scale=1.0, selectors=["vocal"]).orderBy("start").collect()
    assert len(late) == 5 and late[0].start == 0.05
    lined = spark.createDataFrame([("s", [0.0, 2.0], [1.0, 5.0], -12, 0.1, 4.0)], "path string, score_times array<double>, audio_times array<double>, pitch_shift int, cost double, rate double")
    frames = spark.createDataFrame([("s", f, [1.0 if p == (f // 4) % 12 else 0.5 for p in range(12)]) for f in range(30)], "path string, frame long, chroma array<double>")
    got = cli.convert(notes, selectors=["vocal"], alignment=lined, frames=frames).orderBy("start").collect()
    assert [r.start for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0, 5.5] and [r.midi for r in got] == [60, 61, 62, 63, 64, 65]
    # frame 4 is strongest in pitch class 1, the note has 0
    assert got[0].confidence == round(0.72 + 0.27 * 0.5, 3) and got[1].confidence == round(0.72 + 0.27 * 0.5, 3)
    assert [r.duration for r in got][:2] == [0.8, 0.8]
    with pytest.raises(ValueError, match="scale"):
        cli.convert(notes, scale=0.0)
