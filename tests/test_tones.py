"""Recordings given by their notes: blocks rendered where they are read, queries that store no samples."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.held import home
from chronoloom.operators import acoustics as C
from chronoloom.operators import signal as G
from chronoloom.registry import queries

BY, RATE = ["rec"], 8_000


def notes(spark, seconds=40):
    rng = np.random.default_rng(5)
    rows = [(rec, int(at), int(midi), float(level)) for rec, n in ((1, 50), (2, 3)) for at, midi, level in zip(rng.integers(0, seconds * 1_000_000, n), rng.integers(40, 96, n), rng.random(n))]
    rows += [(3, 11_999_000, 60, 0.5), (3, 11_999_000, 60, 0.5), (3, 500_000, 70, 0.9)]
    return spark.createDataFrame(rows, "rec long, start_us long, midi int, level double")


@pytest.mark.parametrize("kind", ["spectrum", "envelope", "onset_frames", "pitch_frames"])
def test_frames_of_tones_equal_those_of_rendered_samples(spark, kind):
    make = getattr(G, kind, None) or getattr(C, kind)
    rows = lambda source: sorted(map(str, make(source, BY, RATE).collect()))
    got = rows(G.Tones(notes(spark), RATE))
    assert got == rows(G.render(notes(spark), BY, RATE)) and len(got) > 500


@pytest.mark.parametrize("frames", [4096, 300])
def test_rhythms_of_tones_equal_those_of_samples(spark, frames):
    beats = spark.createDataFrame([(rec, int(k * 1e6 * gap), 60 + k % 5, 0.8) for rec, gap in ((1, 0.5), (2, 0.61)) for k in range(40)], "rec long, start_us long, midi int, level double")
    beats = beats.unionByName(notes(spark).withColumn("rec", F.col("rec") + 2))
    want = {r.rec: r for r in G.rhythms(G.envelope(G.render(beats, BY, RATE), BY, RATE), BY, RATE).collect()}
    got = {r.rec: r for r in G.rhythms_of(G.Tones(beats, RATE), BY, RATE, frames).collect()}
    assert got == want and got[1].bpm == 120 and len(got) == 5


def stored(spark) -> int:
    top = home(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(top) for name in names)


@pytest.mark.parametrize("name", ["seq18_tempo", "seq19_beats", "seq22_align", "src21_articulations", "inf06_pitch_estimates", "seq02_melody_states", "seq16_from_audio", "seq18_analysis"])
def test_queries_store_no_samples_or_frames(spark, sf_dir, name):
    """The samples of fifteen tracks are over 15 MB, the melody frames and products of their blocks over 3 MB."""
    before = stored(spark)
    assert queries()[name](spark, sf_dir).count() > 10
    assert stored(spark) - before < 1_000_000


def test_warping_kept_whole_equals_that_by_kept_diagonals(monkeypatch):
    from chronoloom.operators import align as A

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 7), (6, 1), (40, 55), (90, 70)):
        a, b = (A.unit_columns(np.round(rng.random((25, k)) * 2)) for k in (n, m))
        for run in (lambda: A.warp(a, b), lambda: A.warp(a, b, subsequence=True), lambda: A.warp_fine(a, b)):
            monkeypatch.setattr(A, "WHOLE", 1 << 20)
            whole = run()
            monkeypatch.setattr(A, "WHOLE", 0)
            parts = run()
            assert np.array_equal(whole[0], parts[0]) and whole[1] == parts[1]


def asked(spark):
    rows = [(r.rec, r.start_us, r.start_us + 30_000 + r.start_us % 700_000) for r in notes(spark).collect()] + [(1, 0, 9_000_000), (1, 0, 10), (1, 38_000_000, 60_000_000), (2, 45_000_000, 45_100_000), (9, 5, 900_000)]
    return spark.createDataFrame(rows, "rec long, start_us long, end_us long")


def near(got, want, count):
    assert got.keys() == want.keys() and len(got) > count
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6, nan_ok=True), k


@pytest.mark.parametrize("stretch", [1, 16])
def test_articulations_of_tones_equal_those_of_frames(spark, monkeypatch, stretch):
    monkeypatch.setattr(C, "STRETCH", stretch)
    sound, points = G.Tones(notes(spark), RATE), asked(spark).select("rec", F.col("start_us").alias("at_us"))
    table = lambda df: {(r.rec, r.at_us): tuple(r)[2:] for r in df.collect()}
    near(table(C.articulations_of(sound, points, BY, RATE)), table(C.articulations(C.onset_frames(sound, BY, RATE), points, BY, RATE)), 50)


@pytest.mark.parametrize("stretch", [1, 16])
def test_estimates_of_tones_equal_those_of_frames(spark, monkeypatch, stretch):
    monkeypatch.setattr(C, "STRETCH", stretch)
    sound = G.Tones(notes(spark), RATE)
    table = lambda df: {(r.rec, r.at_us, n): tuple(r)[2:] for n, r in enumerate(sorted(df.collect()))}
    near(table(C.estimates_of(sound, asked(spark), BY, RATE)), table(C.estimates(C.pitch_frames(sound, BY, RATE), asked(spark), BY, RATE)), 40)


@pytest.mark.parametrize("axis", [0, 1])
def test_moving_medians(axis):
    x = np.random.default_rng(2).random((40, 30))
    padded = np.pad(x, [(8, 8) if k == axis else (0, 0) for k in (0, 1)])
    assert np.array_equal(C._median(x, axis), np.median(np.lib.stride_tricks.sliding_window_view(padded, 17, axis=axis), axis=-1))


def test_melodies_decoded_side_by_side_equal_those_of_whole_matrices(monkeypatch):
    from chronoloom.operators import decode as D
    from chronoloom.operators import sequences as S

    rng, tracks = np.random.default_rng(11), []
    for n in (1, 2, 5, 40, 90, 200, 0):
        first = rng.integers(0, 1500, n)
        tracks.append((first, first + rng.integers(0, 60, n), rng.integers(0, S.SILENT, n), rng.integers(0, 101, n) / 100, rng.integers(0, 101, n) / 100, 1600))
    tracks += [(first := np.array([0, 3]), first + 9, np.array([5, 7]), np.array([0.9, 0.95]), np.array([0.0, 0.3]), 13), (np.array([0, 40]), np.array([38, 80]), np.array([30, 30]), np.array([0.8, 0.9]), np.array([0.7, 0.2]), 120)]
    monkeypatch.setattr(S, "PHRASE_CELLS", 3000)
    count = 0
    for t, got in zip(tracks, S.decode_notes(tracks)):
        first, until, pitch, sure, strong, frames = t
        act, onset = np.zeros((frames, S.SILENT)), np.zeros((frames, S.SILENT))
        for a, b, s, x, y in zip(first, until, pitch, sure, strong):
            act[a : b + 1, s] = np.maximum(act[a : b + 1, s], x)
            onset[a, s] = max(onset[a, s], y)
        assert got == S.decode_melody(act, onset, S.LOWEST)
        count += len(got)
        if len(first):
            o = np.argsort(first, kind="stable")
            phrase = S.phrases_of(first[o], until[o])
            begin = first[o][np.r_[0, np.flatnonzero(np.diff(phrase)) + 1]]
            ends = [until[o][phrase == p].max() == frames - 1 for p in range(len(begin))]
            paths = S.phrase_paths(phrase, first[o] - begin[phrase], until[o] - begin[phrase], pitch[o], sure[o], strong[o], np.array(ends), D.units)
            path = np.full(frames, S.SILENT)
            for at, p in zip(begin, paths):
                path[at : at + len(p)] = p
            attacks = np.c_[onset, np.zeros(frames)]
            assert np.array_equal(path, D.path_of(D.MELODY_START, D.units(S.melody_scores(act, onset)), lambda k: D._STEPS + D.units(D._GAIN * attacks[k][None])))
    assert count > 100


def test_analysis_of_tones_equals_that_of_samples(spark):
    from chronoloom.plans import analysis

    rows = lambda source: {r.rec: r.asDict(recursive=True) for r in analysis.analyse(source, BY, RATE).collect()}
    # notes without a level, so that every piece is rendered
    played = notes(spark).unionByName(spark.createDataFrame([(rec, at * 1_000_000, 60, 0.0) for rec in (1, 2, 3) for at in range(0, 40, 6)], "rec long, start_us long, midi int, level double"))
    got, want = rows(G.Tones(played, RATE)), rows(G.render(played, BY, RATE))
    assert got.keys() == want.keys() == {1, 2, 3}
    for k in got:
        assert got[k].pop("waveform") == pytest.approx(want[k].pop("waveform"), abs=1e-9) and got[k] == want[k]
    with pytest.raises(Exception, match="a sample is no number"):
        analysis.analyse(G.Tones(notes(spark).withColumn("level", F.lit(float("nan"))), RATE), BY, RATE).collect()
