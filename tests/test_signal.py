"""Signals: frames of split recordings, rhythm of click tracks, chords and melodies decoded in blocks, resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import decode as D
from chronoloom.operators import sequences as S
from chronoloom.operators import signal as G

from test_cases import ROLLS

RATE = 11_025
BY = ["rec"]


def tone(midi, seconds, rate=RATE, level=0.2):
    return level * np.sin(2 * np.pi * 440 * 2 ** ((midi - 69) / 12) * np.arange(round(seconds * rate)) / rate)


def clicks(bpm, seconds, hits=lambda beat: [(0.8, 0.0)], rate=RATE, width=0.025, decay=0.005, hertz=lambda beat: 1200):
    """Decaying clicks: hits gives each beat's amplitudes and offsets in beats."""
    x, beat, time = np.zeros(round(seconds * rate)), 0, 0.25
    while time < seconds:
        for level, offset in hits(beat):
            at = int(np.floor((time + offset * 60 / bpm) * rate + 0.5))
            i = np.arange(int(np.ceil(width * rate)))
            i = i[at + i < len(x)]
            x[at + i] += level * np.exp(-i / (rate * decay)) * np.cos(2 * np.pi * hertz(beat) * i / rate)
        beat, time = beat + 1, time + 60 / bpm
    return x


def pieces(spark, recordings, size=5000):
    rows = [(k, a, x[a : a + size].tolist()) for k, x in recordings.items() for a in range(0, len(x), size)]
    return spark.createDataFrame(rows[::-1], "rec long, at long, samples array<double>")


def plain_frames(x, rate):
    """The frames one by one, as the rules say."""
    size = G.frame_size(rate)
    hop, low, high = size // 4, max(2, int(60 * size / rate)), min(size // 2 - 2, int(np.ceil(2200 * size / rate)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    out = []
    for k in range(-(-len(x) // hop)):
        c = k * hop
        at = c - size // 2 + np.arange(size)
        mag = np.abs(np.fft.fft(np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 0) * window))
        part = x[max(0, c - hop // 2) : min(len(x), c + hop // 2)]
        power = mag[low : high + 1] ** 2 + 1e-16
        chroma = np.zeros(12)
        for b in range(low, high + 1):
            if mag[b] < mag[low : high + 1].max() * 0.025 or mag[b] <= mag[b - 1] or mag[b] < mag[b + 1]:
                continue
            l, m, r = np.log(mag[b - 1 : b + 2] + 1e-12)
            hz = (b + (np.clip(0.5 * (l - r) / (l - 2 * m + r), -0.5, 0.5) if l - 2 * m + r else 0)) * rate / size
            midi = 69 + 12 * np.log2(hz / 440)
            near = int(np.floor(midi + 0.5))
            if 35 <= near <= 96 and abs(midi - near) <= 0.46:
                chroma[near % 12] += mag[b] * np.clip((180 / hz) ** 0.25, 0.45, 1.8)
        out.append((k, c / rate, np.sqrt((part**2).sum() / max(1, len(part))), np.exp(np.log(power).mean()) / power.mean(), chroma / (chroma.sum() or 1)))
    return out


@pytest.mark.parametrize("frames", [1, 3, 64])
def test_frames_of_split_recordings(spark, frames):
    rng = np.random.default_rng(1)
    recs = {1: tone(60, 1.2) + tone(64, 1.2) + tone(67.2, 1.2), 2: rng.normal(0, 0.1, 9000), 3: np.r_[np.zeros(8000), tone(45, 0.6)], 4: np.zeros(3000), 5: np.array([0.5])}
    got = {(r.rec, r.frame): r for r in G.spectrum(pieces(spark, recs, 700), BY, RATE, frames).collect()}
    want = {(k, f[0]): f for k, x in recs.items() for f in plain_frames(x, RATE)}
    assert set(got) == set(want)
    for key, (_, time, rms, flat, chroma) in want.items():
        r = got[key]
        assert abs(r.time - time) < 1e-12 and abs(r.rms - rms) < 1e-9 and abs(r.flatness - flat) < 1e-6 * max(1, flat)
        assert np.allclose(r.chroma, chroma, atol=1e-6), key


def test_golden_chroma(spark):
    got = G.spectrum(pieces(spark, {k: tone(m, 2) for k, m in enumerate((60, 69, 45, 95))}), BY, RATE).where("frame = 10").orderBy("rec").collect()
    assert [int(np.argmax(r.chroma)) for r in got] == [0, 9, 9, 11] and all(max(r.chroma) > 0.99 for r in got)
    noise = np.random.default_rng(2).normal(0, 0.1, 30_000)
    assert all(r.flatness > 0.42 for r in G.spectrum(pieces(spark, {1: noise}), BY, RATE).where("frame between 3 and 20").collect())


@pytest.mark.parametrize("frames", [1, 7, 4096])
def test_envelope_of_split_recordings(spark, frames):
    x = np.random.default_rng(3).normal(0, 0.2, 4321)
    hop, size = G.envelope_steps(RATE)
    got = [r.level for r in G.envelope(pieces(spark, {1: x}, 333), BY, RATE, frames).orderBy("step").collect()]
    want = []
    for k in range(-(-len(x) // hop)):
        part = x[k * hop : k * hop + size]
        change = np.diff(np.r_[x[k * hop - 1] if k else 0, part])
        want.append(np.log1p(100 * np.sqrt((part**2).mean())) + 0.5 * np.log1p(150 * np.sqrt((change**2).mean())))
    assert np.allclose(got, want)


def rhythm_rows(spark, recs, rate=RATE):
    p = pieces(spark, recs, 20_000)
    return {r.rec: r for r in G.rhythms(G.envelope(p, BY, rate), BY, rate).collect()}


def test_tempo_and_beats_of_clicks(spark):
    got = rhythm_rows(spark, {bpm: clicks(bpm, 16) for bpm in (60, 90, 120, 150, 180)})
    for bpm, r in got.items():
        beats = np.array([t for t in r.beats if 0.3 < t < 15.5])
        cycles = (beats - 0.25) / (60 / bpm)
        assert abs(r.bpm - bpm) <= 2 and len(r.beats) > 8 and 0.2 / 1.45 <= r.confidence <= 0.9
        assert (np.abs(cycles - np.round(cycles)) * 60 / bpm).max() < 0.055


@pytest.mark.parametrize("rate", [RATE, 22_050])
def test_tempo_of_patterns(spark, rate):
    hertz = lambda beat: 760 if beat % 4 == 0 else 1180
    eighths = clicks(80, 24, lambda b: [((0.9, 0.62, 0.76, 0.55)[b % 4], 0), (0.3, 0.5)], rate, 0.035, 0.007, hertz)
    gaps = clicks(170, 24, lambda b: ([] if b % 5 == 3 else [((0.9, 0.68, 0.78, 0.6)[b % 4], 0)]) + ([(0.27, 0.55)] if b % 6 == 2 else []), rate, 0.035, 0.007, hertz)
    got = rhythm_rows(spark, {1: eighths, 2: gaps}, rate)
    assert 79 <= got[1].bpm <= 81 and 31 <= len(got[1].beats) <= 33
    assert 168 <= got[2].bpm <= 172 and 67 <= len(got[2].beats) <= 69


def test_no_tempo(spark):
    got = rhythm_rows(spark, {1: np.zeros(4 * RATE), 2: tone(60, 2), 3: clicks(60, 3.2)})
    assert all((r.bpm, r.beats, r.confidence) == (0, [], 0.0) for r in got.values())


def test_rhythm_parts_by_hand():
    # the circle of 0.5 s: onsets at 0.1 modulo it win over one stronger onset elsewhere
    times, strengths = np.array([0.1, 0.6, 0.85, 1.1, 1.6]), np.array([0.5, 0.5, 0.9, 0.5, 0.5])
    assert abs(G.best_phase(times, strengths, 0.5) - 0.1) < 1e-12
    # a near onset wins over a farther one of like strength, a strong far one over a weak near one; without one the grid stays
    beats = G.snapped_beats(np.array([0.48, 0.59, 1.02, 1.09]), np.array([0.5, 0.5, 0.1, 1.0]), 0.5, 0.0, 1.7)
    assert np.allclose(beats, [0.0, 0.48, 1.09, 1.5])
    # two beats nearer than 0.45 of the period: the second goes
    assert np.allclose(G.snapped_beats(np.array([0.1]), np.array([1.0]), 0.5, 0.0, 0.3), [0.1])
    assert len(G.regular_gaps(np.arange(9) * 0.5, np.ones(9))) == 8
    assert not len(G.regular_gaps(np.arange(9) * 0.5, np.array([1, 0.5] * 4 + [1.0])))  # every second one is weak
    assert not len(G.regular_gaps(np.arange(6) * 0.5, np.ones(6))) and not len(G.regular_gaps(np.arange(9) * 0.2, np.ones(9)))
    assert len(G.regular_gaps(np.array([0, 0.5, 1, 1.5, 2, 2.5, 3, 3.9]), np.ones(8))) == 6
    at, strong = G.onsets_of(np.array([0, 1.0, 0, 0, 0.5, 0, 0.05, 0]), 0.1, 10)
    assert np.allclose(at, [0.15, 0.45]) and np.allclose(strong, [1, 0.5])
    at, strong = G.onsets_of(np.array([0, 0.5, 0, 1.0, 0, 0]), 0.05, 10)  # 0.1 s apart: the stronger stays
    assert np.allclose(at, [0.175]) and np.allclose(strong, [1])
    r = np.zeros(400)
    r[50], r[100], r[150], r[30], r[60], r[90] = 0.6, 0.5, 0.4, 0.5, 0.1, 0.1
    assert G.best_lag(r, 0.01, False) == (50, 0.6 + 0.3 * 0.5 + 0.15 * 0.4)
    r = np.zeros(400)
    r[40], r[80], r[120], r[160] = 0.5, 0.49, 0.3, 0.3
    assert G.best_lag(r, 0.01, False)[0] == 80 and G.best_lag(r, 0.01, True)[0] == 40  # 150 bpm halves, unless it is a pulse
    assert G.correlations(np.array([1.0, 0, 1, 0, 1, 0]), 3)[2] == pytest.approx(1)


# ---- decoding in blocks --------------------------------------------------------------------------


def frame_table(spark, rows, extra):
    return spark.createDataFrame(rows, f"rec long, frame long, {extra}")


@pytest.mark.parametrize("block", [1, 7, 512])
def test_melody_paths_in_blocks(spark, block):
    rows, want = [], {}
    for k, name in enumerate(sorted(ROLLS)):
        n, active, attacks, _ = ROLLS[name]
        act, onset = np.zeros((n, 57)), np.zeros((n, 57))
        for midi, a, b, v in active:
            act[a:b, midi - 40] = v
        for midi, t, v in attacks:
            onset[t, midi - 40] = v
        rows += [(k, t, act[t].tolist(), onset[t].tolist()) for t in range(n)]
        want[k] = S.melody_path(act, onset).tolist()
    rng = np.random.default_rng(5)
    act, onset = rng.random((90, 57)) * (rng.random((90, 57)) < 0.1), rng.random((90, 57)) * (rng.random((90, 57)) < 0.05)
    rows += [(99, t, act[t].tolist(), onset[t].tolist()) for t in range(90)]
    want[99] = S.melody_path(act, onset).tolist()
    got = {}
    for r in D.best_path(frame_table(spark, rows, "act array<double>, onset array<double>"), BY, D.melody_model, D.MELODY_START, block).orderBy("rec", "frame").collect():
        got.setdefault(r.rec, []).append(r.state)
    assert got == want


def chord_cases():
    rng = np.random.default_rng(6)
    cases = {1: [0] * 15 + [21] * 15 + [5] * 15 + [7] * 15, 2: [3, 3, 9] * 7, 3: [4]}
    out = {}
    for k, path in cases.items():
        chroma = np.zeros((len(path), 12))
        for t, c in enumerate(path):
            chroma[t, S._TRIADS[c]] = 1
        out[k] = chroma
    out[4] = rng.random((40, 12))
    out[5] = np.zeros((9, 12))
    return out


@pytest.mark.parametrize("block", [1, 7, 512])
def test_chords_in_blocks(spark, block):
    rows, want = [], {}
    rng = np.random.default_rng(7)
    for k, chroma in chord_cases().items():
        n = len(chroma)
        rms, flat = rng.random(n) * (rng.random(n) < 0.9), rng.random(n) * 0.5
        rows += [(k, t, 0.2 * t, float(rms[t]), float(flat[t]), chroma[t].tolist()) for t in range(n)]
        want[k] = S.chord_runs(np.arange(n) * 0.2, rms, flat, chroma, n * 0.2) if n > 1 else [(0.0, 0.2, *S.chord_runs(np.zeros(1), rms, flat, chroma, 0.2)[0][2:])]
    frames = frame_table(spark, rows, "time double, rms double, flatness double, chroma array<double>")
    scored = D.chord_scores(frames, BY, block)
    durations = frames.groupBy("rec").agg((F.count("*") * 0.2).alias("duration"))
    got = {}
    for r in D.chords(scored, durations, BY, 0.2, block).orderBy("rec", "nth").collect():
        got.setdefault(r.rec, []).append((r.start, r.end, r.chord, r.confidence))
    assert {k: [c for _, _, c, _ in v] for k, v in got.items()} == {k: [c for _, _, c, _ in v] for k, v in want.items()}
    for k, v in want.items():
        assert np.allclose([(a, b, d) for a, b, _, d in got[k]], [(a, b, d) for a, b, _, d in v])


def sequence(chords, seconds, rate=RATE):
    out = []
    for notes in chords:
        n = round(seconds * rate)
        i = np.arange(n)
        rise = np.minimum(1, np.minimum(i, n - i) / (rate * 0.025))
        out.append(sum(tone(m, seconds, rate) for m in notes) * rise)
    return np.concatenate(out)


def test_analysis_of_samples(spark):
    from chronoloom.plans import analysis

    noise = np.random.default_rng(8).uniform(-0.15, 0.15, 4 * RATE)
    recs = {1: sequence([(48, 52, 55), (45, 48, 52), (53, 57, 60), (43, 47, 50)], 3), 2: np.zeros(4 * RATE), 3: noise, 4: sequence([(50, 54, 57)], 4)}
    got = {r.rec: r for r in analysis.analyse(pieces(spark, recs, 30_000), BY, RATE).collect()}
    at = lambda k, t: next(c.chord for c in got[k].chords if c.start <= t < c.end)
    assert [at(1, t) for t in (1.5, 4.5, 7.5, 10.5)] == ["C", "Am", "F", "G"] and at(4, 2) == "D"
    assert 0.5 < got[1].confidence <= 0.9 and got[1].chords[0].start == 0 and got[1].chords[-1].end == 12
    assert all(a.end == b.start for a, b in zip(got[1].chords, got[1].chords[1:]))
    assert [tuple(c) for c in got[2].chords] == [(0.0, 4.0, "N", 0.0)] and got[2].key is None and got[2].bpm == 0 and got[2].beats == []
    assert set(got[2].waveform) == {0.0} and len(got[1].waveform) == 640 and max(got[1].waveform) == 1.0
    assert sum(c.end - c.start for c in got[3].chords if c.chord == "N") > 3.5 and got[3].confidence < 0.15
    assert got[1].key is not None
    for bad, message in ((pieces(spark, {1: np.zeros(100)}), "too short"), (pieces(spark, {1: np.r_[np.zeros(9000), np.nan]}), "no number")):
        with pytest.raises(Exception, match=message):
            analysis.analyse(bad, BY, RATE).collect()
    with pytest.raises(ValueError, match="rate"):
        analysis.analyse(pieces(spark, {1: np.zeros(9000)}), BY, 100)


def test_analysis_of_files(spark, tmp_path):
    """Two WAV files of one piece at different rates give its chords; both are resampled where they have to be."""
    from chronoloom.plans import analysis
    from chronoloom.sources import sinks

    for rate in (11_025, 44_100):
        x = sequence([(48, 52, 55), (45, 48, 52)], 3, rate)
        wave = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(sinks.pcm16(F.col("x"), rate).alias("w")).first().w
        (tmp_path / f"{rate}.wav").write_bytes(bytes(wave))
    got = {r.path[-9:-4]: r for r in analysis.analyse_files(spark, str(tmp_path)).collect()}
    for r in got.values():
        at = lambda t: next(c.chord for c in r.chords if c.start <= t < c.end)  # noqa: E731, B023
        assert abs(r.duration - 6) < 0.01 and (at(1.5), at(4.5)) == ("C", "Am")
    assert len(got) == 2


# ---- resampling ----------------------------------------------------------------------------------


@pytest.mark.parametrize("rate, to", [(44_100, 11_025), (48_000, 44_100), (22_050, 11_025), (8_000, 11_025)])
def test_resampled_tones_keep_level_and_pitch(spark, rate, to):
    recs = {hz: np.sin(2 * np.pi * hz * np.arange(rate) / rate) for hz in (110, 1000, 3000)}
    whole = {}
    for width in (1 << 15, 1 << 12):
        rows = G.resample(pieces(spark, recs, 9000), BY, rate, to, width).orderBy("rec", "at").collect()
        got = {hz: np.concatenate([r.samples for r in rows if r.rec == hz]) for hz in recs}
        assert all(len(x) == to for x in got.values())
        if whole:
            assert all(np.allclose(whole[hz], got[hz], atol=1e-9) for hz in recs)  # blocks equal the whole
        whole = got
    for hz, x in whole.items():
        middle = slice(to // 4, 3 * to // 4)
        want = np.sin(2 * np.pi * hz * np.arange(to) / to)
        assert abs(20 * np.log10(np.sqrt((x[middle] ** 2).mean() / (want[middle] ** 2).mean()))) < 0.1
        assert np.abs(x[middle] - want[middle]).max() < 0.02


def test_resampling_drops_what_would_fold(spark):
    x = np.sin(2 * np.pi * 9000 * np.arange(44_100) / 44_100)
    got = np.concatenate([r.samples for r in G.resample(pieces(spark, {1: x}), BY, 44_100, 11_025).orderBy("at").collect()])
    assert np.sqrt((got[3000:8000] ** 2).mean()) < 1e-3


def test_nothing_in_nothing_out(spark):
    none = pieces(spark, {}).limit(0)
    assert G.spectrum(none, BY, RATE).count() == 0 and G.envelope(none, BY, RATE).count() == 0 and G.resample(none, BY, RATE, 8000).count() == 0


def test_melody_states_of_tracks_equal_the_one_task_path(spark, sf_dir):
    from chronoloom.plans import sequence_queries as Q
    from chronoloom.plans.window_queries import ended
    from chronoloom.registry import queries

    want = []
    for track, pdf in ended(spark, sf_dir).toPandas().groupby("track_id"):
        act, onset = (x[:, S.LOWEST - 21 : S.HIGHEST - 20] for x in Q.piano_roll(pdf))
        path = S.melody_path(act, onset)
        cut = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)]
        want += [(track, a, b, path[a] + S.LOWEST) for a, b in zip(cut, cut[1:]) if path[a] < S.SILENT]
    got = [tuple(r) for r in queries()["seq02_melody_states"](spark, sf_dir).select("track_id", "first", "until", "midi").collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
