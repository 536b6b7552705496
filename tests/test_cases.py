"""Literal cases of single operators."""

import math
import os
import random
import struct
import subprocess
import sys
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.functions import arrays as A
from chronoloom.functions import music as M
from chronoloom.functions import text as X
from chronoloom.operators import align as AL
from chronoloom.operators import joins as J
from chronoloom.operators import projections as P
from chronoloom.operators import sequences as S
from chronoloom.operators import windows as O
from chronoloom.plans import cli, refine
from chronoloom.sources import readers as R
from chronoloom.sources import sinks as K
from chronoloom.streaming import scoring


def values(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_grades(spark):
    d = spark.createDataFrame([(0, 0.08), (1, 0.080001), (2, 0.18), (3, -0.180001), (4, math.nan)], "i int, d double")
    assert [r.g for r in d.orderBy("i").select(M.grade(F.col("d")).alias("g")).collect()] == ["perfect", "good", "good", "miss", "miss"]


def test_nearest_and_ties(spark):
    beats = spark.createDataFrame([(1, 0, 500), (1, 1, 1000), (1, 2, 1500), (1, 3, 2000)], "t int, i int, at long")
    asked = spark.createDataFrame([(1, 0, 875), (1, 1, 1125), (1, 2, 1250), (2, 3, 5)], "t int, q int, x long")
    got = {r.q: (r.i, r["diff"]) for r in J.nearest(asked, beats, ["t"], "x", "at", ["i"], "i").collect()}
    assert got == {0: (1, -125), 1: (1, 125), 2: (2, -250), 3: (None, None)}
    got = {r.q: r.i for r in J.nearest(asked, beats, ["t"], "x", "at", ["i"], "i", tie_later=False).collect()}
    assert got[2] == 1


def test_interval_bounds(spark):
    segs = spark.createDataFrame([(1, i, n, i * 1000, i * 1000 + 1000) for i, n in enumerate(["C", "Am", "F", "G"])], "t int, k int, name string, lo long, hi long")
    pts = spark.createDataFrame([(1, 999), (1, 1000), (1, 4000)], "t int, at long")
    met = J.points_in_intervals(pts, segs, ["t"], "at", F.col("lo"), F.col("hi") - 1, 700)
    assert {(r.at, r.name) for r in met.collect()} == {(999, "C"), (1000, "Am")}


def test_overlaps_brute_force(spark):
    rng = random.Random(3)
    a = [(k, lo := rng.randrange(1000), lo + rng.randrange(300)) for k in range(60)]
    b = [(k, lo := rng.randrange(1000), lo + rng.randrange(300)) for k in range(60)]
    da, db = spark.createDataFrame([(1, *x) for x in a], "t int, i int, a0 long, a1 long"), spark.createDataFrame([(1, *x) for x in b], "t int, j int, b0 long, b1 long")
    got = sorted((r.i, r.j) for r in J.overlapping(da, db, ["t"], "a0", "a1", "b0", "b1", 64).collect())
    want = sorted((i, j) for i, p, q in a for j, r, s in b if p < q and r < s and p < s and r < q)
    assert got == want


def test_gaps(spark):
    e = spark.createDataFrame([(1, i, s, s + 1_000_000) for i, s in enumerate([3_000_000, 5_500_000, 9_000_000])], "track_id int, note_id int, start_us long, end_us long")
    got = sorted((r.gap_start, r.gap_end) for r in O.gaps(e, 13_000_000, 2_200_000, ["track_id"]).collect())
    assert got == [(0, 3_000_000), (6_500_000, 9_000_000), (10_000_000, 13_000_000)]


def test_normalise(spark):
    rows = spark.createDataFrame([(1, 0, 2.0, 10.0, 64.4, 2.0, -1.0), (1, 1, math.nan, 1.0, 60.0, 0.5, 0.5), (1, 2, 1.0, 0.01, 60.0, 0.7, 0.8)], "t int, i int, start double, duration double, midi double, confidence double, strength double")
    got = [tuple(r)[2:] for r in P.normalise_notes(rows, 4.0, ["t"], "i").orderBy("start").collect()]
    assert got == [(1.0, 0.045, 60, 0.7, 0.8), (2.0, 2.0, 64, 1.0, 0.0)]
    with pytest.raises(Exception, match="rows would be lost"):
        P.strict_notes(rows, 4.0, ["t"], "i", least=1).collect()


def test_monophonic_trim(spark):
    rows = spark.createDataFrame([(1, 0, 1_000_000, 700_000, 50, 62), (1, 1, 1_500_000, 400_000, 50, 62), (1, 2, 2_100_000, 400_000, 50, 64)], "track_id int, note_id long, start_us long, dur_us long, conf_pct long, midi int")
    got = [(r.start_us, r.dur_us) for r in S.monophonic(rows, ["track_id"], 5_000, 45_000).orderBy("start_us").collect()]
    assert got == [(1_000_000, 500_000), (1_500_000, 400_000), (2_100_000, 400_000)]


def test_monophonic_brute_force(spark):
    rng = random.Random(9)
    notes = [(1, i, rng.randrange(400) * 1000, rng.randrange(1, 300) * 1000, rng.randrange(100)) for i in range(120)]

    def plain():
        kept = []
        for _, i, s, d, c in sorted(notes, key=lambda n: (n[2], -n[4], n[1])):
            if kept and s - kept[-1][1] < 5000:
                if (c, d) > (kept[-1][3], kept[-1][2]):
                    kept[-1] = (i, s, d, c)
            else:
                kept.append((i, s, d, c))
        out = []
        for i, s, d, c in kept:
            if d < 45_000:
                continue
            if out:
                cut = min(out[-1][2], s - out[-1][1])
                if cut >= 45_000:
                    out[-1] = (out[-1][0], out[-1][1], cut)
                else:
                    out.pop()
            out.append((i, s, d))
        return sorted(out)

    rows = spark.createDataFrame(notes, "track_id int, note_id long, start_us long, dur_us long, conf_pct long")
    assert sorted((r.note_id, r.start_us, r.dur_us) for r in S.monophonic(rows, ["track_id"], 5_000, 45_000).collect()) == plain()


def test_anchored_not_chained(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 20, 30, 60])], "track_id int, note_id long, start_us long")
    assert [r.anchor for r in S.anchored_groups(rows, ["track_id"], 25).orderBy("start_us").collect()] == [0, 0, 30, 60]


def test_upper_voice(spark):
    rows = spark.createDataFrame([(1, 0, 2_100_000, 2_200_000, 55), (1, 1, 2_110_000, 2_250_000, 67), (1, 2, 2_300_000, 2_450_000, 69), (1, 3, 2_500_000, 2_700_000, 71)], "track_id int, note_id long, start_us long, end_us long, midi int")
    assert [(r.start_us, r.midi) for r in S.upper_voice(rows, ["track_id"], 65_000, 60_000).orderBy("start_us").collect()] == [(2_110_000, 67), (2_300_000, 69), (2_500_000, 71)]


def test_boundary_edit(spark):
    segs = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 1000) for i in range(4)], "t int, seg_idx int, start_us long, end_us long")
    got = [tuple(r)[1:] for r in P.move_boundary(segs, ["t"], 1, 750, 2250).orderBy("seg_idx").collect()]
    assert got == [(0, 0, 750, True), (1, 750, 2250, True), (2, 2250, 3000, True), (3, 3000, 4000, False)]


def test_fold_round_clock(spark):
    assert values(spark, M.fold_octave(F.lit(12), 24, 108), M.fold_octave(F.lit(120), 24, 108), M.round_half_up(F.lit(-0.5)), F.bround(F.lit(0.5))) == [24, 108, 0, 0]
    assert values(spark, X.clock(F.lit(75.9)), X.clock(F.lit(float("nan"))), X.clock(F.lit(-1.0))) == ["1:15", "0:00", "0:00"]


def test_text(spark):
    m = X.file_metadata(F.lit("/a/b/07 - Some One - A Song.mp3"))
    assert values(spark, m.artist, m.title) == ["Some One", "A Song"]
    c = X.chord_strict(F.lit("F#m"))
    assert values(spark, c.root, c.third, X.chord_strict(F.lit("C7")).root, X.chord_lenient(F.lit("C7/G")), X.chord_lenient(F.lit("?"))) == [6, 3, None, "C", "N"]
    assert values(spark, X.clean_text(F.lit(" a\x00\n b ")), X.clean_text(F.lit("  "))) == ["a b", None]
    assert values(spark, F.sha2(F.lit("abc").cast("binary"), 256))[0].startswith("ba7816bf")
    d = spark.createDataFrame([("Émile & Co.",), (None,)], "s string")
    assert [r[0] for r in d.select(X.normalised("s")).collect()] == ["emileco", None]


def test_normalise_query_keeps_whole_texts(spark, sf_dir):
    fold = lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t).lower() if x.isalnum())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = registry.queries()["str02_normalise"](spark, sf_dir).collect()
    assert max(len(r.text or "") for r in docs) > 1000
    assert sorted(((r.doc_id, r.folded) for r in got), key=str) == sorted(((r.doc_id, fold(r.text)) for r in docs), key=str)


def test_arrays(spark):
    a = F.array(*map(F.lit, [0.0, 1.0, 3.0]))
    assert values(spark, A.with_midpoints(a), A.pair_means(a), A.rotate(a, 1), A.arg_max(a), A.nearest_rank(a, 0.9)) == [[0.0, 0.5, 1.0, 2.0, 3.0], [0.5], [3.0, 0.0, 1.0], 2, 3.0]
    assert values(spark, A.known_ids(F.lit('["b","","a","b"]')), A.known_ids(F.lit("{bad"))) == [["b", "a"], []]
    assert [len(x) for x in values(spark, A.padded_frames(a, 2, 4, 3))[0]] == [4, 4]


def test_lanes(spark):
    rows = spark.createDataFrame([(1, 0, 0, 58), (1, 1, 1, 60), (1, 2, 2, 65), (2, 3, 0, 28), (2, 4, 1, 108)], "track_id int, note_id long, start_us long, midi int")
    got = {r.note_id: (r.string, r.fret) for r in S.lanes(rows, ["track_id"]).collect()}
    assert [got[k] for k in range(3)] == [(3, 3), (4, 1), (5, 1)]
    opened = (40, 45, 50, 55, 59, 64)
    assert opened[got[3][0]] + got[3][1] == 40 and opened[got[4][0]] + got[4][1] == 84


def test_alignment_is_best():
    rng = random.Random(5)
    for _ in range(40):
        a, b = (sorted(rng.random() * 2 for _ in range(rng.randrange(6))) for _ in range(2))

        def best(i, j):
            if i == len(a) or j == len(b):
                return (0, 0.0)
            out = max(best(i + 1, j), best(i, j + 1))
            if abs(a[i] - b[j]) <= 0.25:
                c, s = best(i + 1, j + 1)
                out = max(out, (c + 1, s - abs(a[i] - b[j])))
            return out

        pairs = S.align_monotone(a, b, 0.25)
        got = (len(pairs), -sum(abs(a[i] - b[j]) for i, j in pairs))
        want = best(0, 0)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert S.align_monotone([0, 0.2], [0.19, 0.21], 0.25) == [(0, 0), (1, 1)]


def test_alignment_ties():
    # two ways of one pair at one distance: the earlier onset is left out
    assert S.align_monotone([0.0], [-0.125, 0.125], 0.25) == [(0, 0)]
    assert S.align_monotone([0.0, 0.2], [0.1], 0.25) == [(0, 0)]
    rng = random.Random(3)
    a, b = (sorted(rng.randrange(60_000) / 100 for _ in range(3000)) for _ in range(2))
    pairs = S.align_monotone(a, b, 0.25)
    assert len(pairs) > 1500 and all(abs(a[i] - b[j]) <= 0.25 for i, j in pairs)


def test_skyline():
    assert S.skyline([(0, 1, 72, 90), (0.5, 0.25, 60, 90), (1, 0.5, 74, 90)]) == [0, 2]
    # out of range, too short, a short overlap before a lower note, one of two equal notes
    assert S.skyline([(0, 1, 30, 90), (0, 0.01, 70, 90), (0, 1, 60, 90), (0.95, 1, 55, 90)]) == [2, 3]
    assert S.skyline([(0, 0.5, 60, 90), (0.001, 0.8, 60, 80)], window=0.0) == [1]


def test_chords_of_triads(spark):
    rows = []
    for k, c in enumerate([0] * 15 + [21] * 15 + [5] * 15 + [7] * 15):
        chroma = np.zeros(12)
        chroma[S._TRIADS[c]] = 1
        rows.append((1, 0.2 * k, 1.0, 0.0, chroma.tolist()))
    got = S.decode_chords(spark.createDataFrame(rows, "t int, time double, rms double, flatness double, chroma array<double>"), ["t"], 0.2).orderBy("start").collect()
    assert [r.chord for r in got] == ["C", "Am", "F", "G"]
    # borders lie half a step before the first frame of a chord; the ends are the track's
    assert [round(r.start, 6) for r in got] == [0, 2.9, 5.9, 8.9] and round(got[-1].end, 6) == 12.0
    assert all(0.4 < r.confidence <= 0.9 for r in got)


def test_chord_scores_of_one_frame():
    chroma = np.zeros((1, 12))
    chroma[0, [0, 4, 7]] = 0.5, 0.3, 0.2
    scores, sure = S.chord_emissions(chroma, np.ones(1), np.full(1, 0.1))
    norm = math.sqrt(0.25 + 0.09 + 0.04)
    c = 0.8 * (0.5 + 0.9 * 0.3 + 0.75 * 0.2) / (norm * math.sqrt(2.3725)) + 0.2
    assert abs(scores[0, 0] - c) < 1e-9 and scores[0].argmax() == 0 and scores[0, 24] == 0.42
    assert abs(scores[0, 12] - (0.8 * (0.5 + 0.75 * 0.2) / (norm * math.sqrt(2.3725)) + 0.2 * 0.7 - 0.15)) < 1e-9
    second = np.sort(scores[0, :24])[-2]
    assert abs(sure[0] - min(0.9, 0.9 * (0.42 + 0.48 * min(1, (c - second) / 0.2)))) < 1e-9
    scores, sure = S.chord_emissions(np.zeros((4, 12)), np.zeros(4), np.zeros(4))
    assert (scores[:, 24] == 1.3).all() and (sure == 0).all()
    flat, sure = S.chord_emissions(chroma, np.ones(1), np.full(1, 0.5))
    assert flat[0, 24] == 1.3 and abs(flat[0, 0] - c / 4) < 1e-9 and sure[0] == 0


#: Activations as (pitch, first frame, end, value) and onsets as (pitch, frame, value) on some frames, and the pitches heard.
ROLLS = {
    "lowest": (28, [(40, 4, 24, 0.94)], [(40, 4, 0.9)], [40]),
    "highest": (28, [(96, 4, 24, 0.94)], [(96, 4, 0.9)], [96]),
    "low register": (58, [(43, 4, 18, 0.92), (45, 21, 35, 0.92), (47, 38, 52, 0.92)], [(43, 4, 0.8), (45, 21, 0.8), (47, 38, 0.8)], [43, 45, 47]),
    "over a bass": (52, [(48, 0, 52, 0.72), (64, 0, 26, 0.65), (67, 26, 52, 0.66)], [(64, 0, 0.9), (67, 26, 0.9)], [64, 67]),
    "far over a louder bass": (40, [(50, 0, 40, 0.75), (78, 0, 20, 0.6), (76, 20, 40, 0.62)], [(50, 0, 0.92), (78, 0, 0.86), (76, 20, 0.88)], [78, 76]),
    "weak flicker": (32, [(64, 0, 32, 0.66), (67, 12, 18, 0.85)], [(64, 0, 0.9)], [64]),
    "short attacked note": (31, [(64, 0, 12, 0.7), (67, 12, 19, 0.72), (69, 19, 31, 0.69)], [(64, 0, 0.9), (67, 12, 0.91), (69, 19, 0.89)], [64, 67, 69]),
    "three frames alone": (35, [(64, 0, 16, 0.75), (67, 16, 19, 0.95), (69, 19, 35, 0.75)], [(64, 0, 0.9), (67, 16, 0.9), (69, 19, 0.9)], [64, 67, 69]),
    "three frames over a voice": (35, [(64, 0, 35, 0.75), (67, 16, 19, 0.95)], [(64, 0, 0.9), (67, 16, 0.9)], [64]),
    "repeated attacks": (27, [(62, 0, 27, 0.72)], [(62, 0, 0.88), (62, 9, 0.81), (62, 18, 0.86)], [62, 62, 62]),
    "attack after six frames": (24, [(62, 0, 24, 0.72)], [(62, 0, 0.88), (62, 6, 0.81)], [62, 62]),
    "weak attack after a valley": (36, [(64, 4, 32, 0.92), (64, 14, 16, 0.12)], [(64, 4, 0.8), (64, 16, 0.57)], [64, 64]),
    "secondary peak": (24, [(62, 0, 24, 0.72)], [(62, 0, 0.88), (62, 5, 0.82)], [62]),
    "weak peaks": (36, [(64, 4, 32, 0.92)], [(64, 4, 0.8), (64, 12, 0.57), (64, 20, 0.52)], [64]),
    "background": (30, [(60, 0, 30, 0.08)], [(60, 0, 0.2)], []),
}


@pytest.mark.parametrize("name", sorted(ROLLS))
def test_melody_of_activations(name):
    n, active, attacks, want = ROLLS[name]
    act, onset = np.zeros((n, 88)), np.zeros((n, 88))
    for midi, a, b, v in active:
        act[a:b, midi - 21] = v
    for midi, t, v in attacks:
        onset[t, midi - 21] = v
    got = S.decode_melody(act, onset)
    assert [m for _, _, m, *_ in got] == want and [s for s, *_ in got] == sorted(s for s, *_ in got)
    if name == "three frames alone":
        assert got[1][1] == 0.045
    if name == "short attacked note":
        assert 0.07 <= got[1][1] < 0.1
    assert S.decode_melody(np.zeros((0, 88)), np.zeros((0, 88))) == []


def test_part_names(spark):
    names = spark.createDataFrame([("Lead Vocals", 21.0), ("Left Hand", -4.0), ("Piano RH", 1.0), ("DRUMS", -12.0), ("Accompaniment", -4.0), ("Flute", 0.0), (None, 0.0)], "name string, want double")
    assert all(r.got == r.want for r in names.select("want", X.name_score(F.col("name")).alias("got")).collect())


def test_streams_are_ranked(spark):
    rows = [(0, 0, 1, float(k), 0.5, 55 + k % 3, "Piano accompaniment", False) for k in range(20)] + [(1, 0, 1, float(k), 0.5, 69 + k % 5, "Vocal Melody", False) for k in range(20)] + [(2, 0, 0, float(k), 0.1, 90, "Voice of drums", True) for k in range(20)]
    notes = spark.createDataFrame(rows, "part_index int, voice int, staff int, start double, duration double, midi int, part_name string, is_drum boolean")
    got = cli.inspect(notes).collect()
    assert [r.part_index for r in got] == [1, 0, 2]
    whole = 19.5
    want = 15.0 + 1.5 + 1.4 * (71 - 45) / 35 + 0.8 * 1.0 + 0.8 + 2.0 + 0.7
    assert abs(got[0].score - want) < 1e-9 and whole > 0


def test_strong_attacks(spark):
    rows = [(0.5, 0.0, 2.2, 0.0, 2.1, 0.0, True, False), (0.5, 0.0, 2.2, 0.0, 0.0, 0.0, False, False), (0.7, 0.5, 3.5, 2.6, 0.0, 0.0, True, False), (0.8, 0.0, 2.8, 0.0, 0.0, 6.1, True, True), (None, None, None, None, None, None, False, False)]
    df = spark.createDataFrame(rows, "bp double, hp double, br double, hr double, rise double, reset double, plain boolean, strict boolean")
    cols = [F.col(c) for c in ("bp", "hp", "br", "hr", "rise", "reset")]
    got = df.select("plain", "strict", M.strong_attack(*cols).alias("p"), M.strong_attack(*cols, strict=True).alias("s")).collect()
    assert all((r.p, r.s) == (r.plain, r.strict) for r in got)


def test_strict_numbers_refuse(spark):
    for bad in ("x", "NaN", "11", None):
        with pytest.raises(Exception, match="not a number"):
            spark.createDataFrame([(bad,)], "v string").select(M.strict_number(F.col("v"), 0, 10, "v")).collect()


def test_strict_import_refuses(spark):
    note = lambda k, at: (1, k, at, 0.2, 60.0, 0.5, 0.5)
    schema = "track_id int, note_id long, start double, duration double, midi double, confidence double, strength double"
    good = [note(k, k / 2) for k in range(8)]
    assert P.strict_notes(spark.createDataFrame(good, schema), 80.0, ["track_id"], "note_id").count() == 8
    for bad in (good[:7], [*good, note(9, 0.001)]):
        with pytest.raises(Exception, match="rows would be lost"):
            P.strict_notes(spark.createDataFrame(bad, schema), 80.0, ["track_id"], "note_id").collect()


def test_folds_are_linear(spark):
    """A track of many notes in one group, and groups that span batches."""
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("track_id"), F.col("id").alias("note_id"), (F.col("id") * 10_000).alias("start_us"), F.lit(50_000).cast("long").alias("dur_us"), (F.col("id") % 101).alias("conf_pct"))
    assert S.monophonic(rows, ["track_id"], 5_000, 1_000).count() == n
    got = S.anchored_groups(rows, ["track_id"], 45_000).groupBy("anchor").count()
    assert got.count() == n // 5


def test_warp():
    x = np.eye(4)[:, [0, 1, 2, 3]]
    y = np.eye(4)[:, [0, 0, 1, 2, 2, 3]]
    assert AL.warp(x, y)[0].tolist() == [[0, 0], [0, 1], [1, 2], [2, 3], [2, 4], [3, 5]]


def test_interpolation_outside(spark):
    knots = spark.createDataFrame([(1, 0, 10), (1, 100, 210)], "t int, x long, y long")
    pts = spark.createDataFrame([(1, -5), (1, 50), (1, 120)], "t int, at long")
    assert [r.mapped for r in J.interpolate(pts, knots, ["t"], "at", "x", "y").orderBy("at").collect()] == [5.0, 110.0, 230.0]


def test_conditional_updates(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "id int, name string, v int")
    ch = spark.createDataFrame([(1, "A", None), (2, "B", 9), (4, "D", None)], "id int, name string, seen int")
    assert sorted(tuple(r) for r in K.update_if(t, ch, "id", {"v": "seen"}, ["name"]).collect()) == [(1, "A", None), (2, "b", 2), (3, "c", 3)]
    with pytest.raises(ValueError):
        K.no_alias("/a/b", "file:///a/./b")


def test_wave_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.5, -0.5, 1.0],)], "x array<double>")
    data = bytes(df.select(K.pcm16(F.col("x")).alias("w")).first().w)
    (tmp_path / "a.wav").write_bytes(data)
    row = R.wave_files(spark, str(tmp_path)).first()
    assert row.sample_rate == 44_100 and [round(v, 3) for v in row.samples] == [0.0, 0.5, -0.5, 1.0]
    assert len(data) == 44 + 8


def midi_file():
    def var(n):
        return bytes([n]) if n < 128 else bytes([128 | n >> 7, n & 127])

    body = b"".join(var(d) + e for d, e in [(0, b"\xff\x51\x03" + (500_000).to_bytes(3, "big")), (0, b"\x90\x3c\x64"), (96, b"\x80\x3c\x00"), (0, b"\xff\x51\x03" + (1_000_000).to_bytes(3, "big")), (0, b"\x90\x40\x50"), (96, b"\x90\x40\x00"), (0, b"\xff\x2f\x00")])
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(body)) + body


XML = b"""<score-partwise><part-list><score-part id="P1"><part-name>Vocal Melody</part-name></score-part></part-list><part id="P1"><measure><attributes><divisions>2</divisions></attributes><sound tempo="60"/>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note><note><rest/><duration>2</duration></note>
<note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><voice>1</voice><tie type="start"/></note></measure>
<measure><note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><voice>1</voice><tie type="stop"/></note></measure></part></score-partwise>"""


def test_score_readers(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(midi_file())
    (tmp_path / "b.musicxml").write_bytes(XML)
    rows = R.score_files(spark, str(tmp_path)).orderBy("path", "start").collect()
    assert [(r.path[-1], r.start, r.duration, r.midi) for r in rows] == [("d", 0.0, 0.5, 60), ("d", 0.5, 1.0, 64), ("l", 0.0, 1.0, 60), ("l", 2.0, 2.0, 66)]
    notes = R.score_files(spark, str(tmp_path))
    assert cli.convert(notes).count() == 4
    assert cli.inspect(notes.where("part_name = 'Vocal Melody'")).first().part_name == "Vocal Melody"


def bars(*specs):
    """A part of whole-note measures C, D, E ...: '|:' opens, ':|' closes, '[1' begins an ending, ']' ends one."""
    out = []
    for k, spec in enumerate(specs):
        left = '<repeat direction="forward"/>' if "|:" in spec else ""
        number = spec[spec.index("[") + 1 :].split(" ")[0] if "[" in spec else ""
        left += f'<ending number="{number}" type="start"/>' if number else ""
        right = '<ending number="1" type="stop"/>' if "]" in spec else ""
        right += '<repeat direction="backward"/>' if ":|" in spec else ""
        note = f'<note><pitch><step>{"CDEFGAB"[k]}</step><octave>4</octave></pitch><duration>4</duration></note>'
        out.append(f'<measure>{f"<barline>{left}</barline>" if left else ""}{note}{f"<barline>{right}</barline>" if right else ""}</measure>')
    return ('<score-partwise><part-list/><part id="P1">' + "".join(out) + "</part></score-partwise>").encode()


@pytest.mark.parametrize(
    ("specs", "played"),
    [
        (("", "", ""), "CDE"),
        (("", ":|", ""), "CDCDE"),
        (("", "|:", ":|", ""), "CDEDEF"),
        (("|:", "[1 ] :|", "[2 ]", ""), "CDCEF"),
        (("", "[1 ] :|", "", ""), "CDCEF"),
        (("|:", "[1,2 ] :|", "[3 ]"), "CDCDCE"),
        (("|:", "[1 ] :|", "[2 ] :|", ""), "CDCEF"),
        (("|:", "[1", "] :|", "[2 ]", ":|"), "CDECFGG"),
        (("|:", "[1 ] :|", "[2 ]", "|:", "[1 ] :|", "[2 ]"), "CDCEFGFA"),
    ],
)
def test_repeats_are_played(specs, played):
    names = {60: "C", 62: "D", 64: "E", 65: "F", 67: "G", 69: "A", 71: "B"}
    notes = R.parse_musicxml(bars(*specs))
    assert "".join(names[n[2]] for n in notes) == played
    assert [n[0] for n in notes] == [2.0 * k for k in range(len(played))]
    assert "".join(names[n[2]] for n in R.parse_musicxml(bars(*specs), unfold=False)) == "CDEFGAB"[: len(specs)]


def test_zipped_scores(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.mxl", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="s/a.xml"/></rootfiles></container>')
        z.writestr("s/a.xml", bars("", ":|"))
    assert [r.midi for r in R.score_files(spark, str(tmp_path)).orderBy("start").collect()] == [60, 62, 60, 62]
    assert [(r.start, r.midi) for r in R.score_files(spark, str(tmp_path), default_bpm=60.0, unfold=False).orderBy("start").collect()] == [(0.0, 60), (4.0, 62)]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id":"a","title":"A","version":"v1","bpm":80,"audioBytes":9239467},{"id":"b","title":"B","version":"v2","bpm":92.5,"more":1}]')
    assert [(r.id, r.bpm, r.audioBytes) for r in R.catalog(spark, f"{tmp_path}/c.json").orderBy("id").collect()] == [("a", 80.0, 9239467), ("b", 92.5, None)]
    (tmp_path / "d.json").write_text('[{"id":"a","title":"A"}]')
    with pytest.raises(Exception, match="lacks an id"):
        R.catalog(spark, f"{tmp_path}/d.json").collect()


def test_update_with_an_expression(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "id int, name string, v int")
    ask = spark.createDataFrame([(1, None), (1, None), (2, 9), (3, 3), (4, None)], "k int, seen int").withColumnRenamed("k", "id")
    run = lambda values, where=None: sorted(tuple(r) for r in K.update_with(t, ask, "id", {"v": "seen"}, values, where).collect())
    assert run({"name": F.upper("name")}) == [(1, "A", None), (2, "b", 2), (3, "C", 3)]
    assert run({"name": F.upper("name"), "id": F.lit(3)}) == [(1, "a", None), (2, "b", 2), (3, "C", 3)]
    assert run({"name": F.upper("name")}, F.col("v") > 2) == [(1, "a", None), (2, "b", 2), (3, "C", 3)]


def test_frame_times(spark):
    frames = [0, 1, 171, 172, 173, 5000]
    got = spark.createDataFrame([(f,) for f in frames], "f int").select(M.frame_time(F.col("f")).alias("t")).collect()
    assert [r.t for r in got] == pytest.approx([S.frame_time(f) for f in frames], abs=1e-9)


def test_compare_report(spark):
    ref = spark.createDataFrame([(1, 0.0, 60), (1, 1.0, 62), (1, 2.0, 64), (1, 3.0, 65)], "t int, start double, midi int")
    cand = spark.createDataFrame([(1, 0.05, 60), (1, 1.1, 74), (1, 2.0, 65), (1, 3.6, 65)], "t int, start double, midi int")
    r = cli.compare(ref, cand, ["t"], 0.15).first()
    assert (r.matched, r.exact, r.octave, r.wrong) == (3, 1, 1, 1)


def test_text_readers(spark, tmp_path):
    for name, text in (("a", '[{"start":0,"duration":1,"midi":60}]'), ("b", '{"melody":[{"start":1,"duration":1,"midi":61}]}'), ("c", '{"analysis":{"melody":[{"start":2,"duration":1,"midi":62}]}}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.midi for r in R.melody_files(spark, f"{tmp_path}/*.json").collect()) == [60, 61, 62]
    (tmp_path / "e.csv").write_text("start_time_s,end_time_s,pitch_midi,velocity\n0,1,70,50\n1,1.05,70,127\n2,3,70,127\n")
    assert [r.quality for r in R.evidence_csv(spark, f"{tmp_path}/e.csv").orderBy("start").collect()] == [0.5, 1.0, 1.0]
    assert [(r.start, r.amplitude) for r in R.lead_csv(spark, f"{tmp_path}/e.csv").collect()] == [(0.0, 50 / 127), (2.0, 1.0)]
    (tmp_path / "x.json").write_text('[{"start":0.5,"duration":1,"midi":60}]')
    assert R.event_json(spark, f"{tmp_path}/x.json").first().end == 1.5


def test_tags():
    frame = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\x03Title"
    assert R.parse_tags(b"ID3\x03\x00\x00" + bytes([0, 0, 0, len(frame)]) + frame) == {"title": "Title"}


def test_mp4_tags():
    box = lambda name, body: (8 + len(body)).to_bytes(4, "big") + name + body
    item = lambda name, text: box(name, box(b"data", bytes([0, 0, 0, 1, 0, 0, 0, 0]) + text.encode()))
    items = box(b"ilst", item(b"\xa9nam", "Título") + item(b"\xa9alb", "Album") + item(b"\xa9ART", "Singer"))
    file = box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"udta", box(b"meta", bytes(4) + items)))
    assert R.parse_tags(file) == {"title": "Título", "artist": "Singer"}
    assert R.parse_tags(file[:-20]) == {} and R.parse_tags(box(b"ftyp", b"M4A ")) == {}


def refine_tables(spark, notes, evidence, attacks=(), estimates=()):
    """The refinement's input from rows in seconds."""
    us = lambda x: round(x * 1_000_000)
    p = spark.createDataFrame([(1, k, us(a), us(b), m, *(rest or (90, 80))) for k, (a, b, m, *rest) in enumerate(notes)], "track_id long, note_id long, start_us long, end_us long, midi long, conf_pct long, strength_pct long")
    e = spark.createDataFrame([(1, k, us(a), us(b), m, *(rest or (90,))) for k, (a, b, m, *rest) in enumerate(evidence)], "track_id long, ev_id long, start_us long, end_us long, midi long, quality_pct long")
    ac = spark.createDataFrame([(1, us(at), peak, peak, ratio, ratio, rise, reset) for at, peak, ratio, rise, reset in attacks], "track_id long, at_us long, broad_peak double, harmonic_peak double, broad_ratio double, harmonic_ratio double, rise_db double, reset_db double") if attacks else None
    es = spark.createDataFrame([(1, us(at), m, mad) for at, m, mad in estimates], "track_id long, at_us long, median_midi double, mad_midi double") if estimates else None
    return p, e, ac, es


def refined(spark, **given):
    """(start, end, midi) of the refined notes, in seconds as given."""
    rows = refine.refine(*refine_tables(spark, **given)).orderBy("start_us").collect()
    return [(r.start_us / 1e6, r.end_us / 1e6, r.midi) for r in rows]


PLAIN, STRONG = (0.9, 3.2, 3.0, 7.0), (1.2, 3.8, 5.0, 9.0)
REFINED = {
    "borders of the evidence": (dict(notes=[(1.04, 1.47, 64)], evidence=[(1.0, 1.5, 64)]), [(1.0, 1.5, 64)]),
    "weak noise": (dict(notes=[(1.0, 1.1, 60, 50, 20), (1.3, 1.39, 62, 90, 70)], evidence=[(9.0, 9.5, 50)]), [(1.3, 1.39, 62)]),
    "repetition": (dict(notes=[(1.0, 1.2, 60), (1.23, 1.5, 60), (2.0, 2.2, 62), (2.24, 2.5, 62)], evidence=[(1.0, 1.5, 60), (2.0, 2.2, 62), (2.24, 2.5, 62)]), [(1.0, 1.5, 60), (2.0, 2.2, 62), (2.24, 2.5, 62)]),
    "split": (dict(notes=[(1.0, 1.8, 60)], evidence=[(1.0, 1.3, 60), (1.3, 1.8, 60)], attacks=[(1.3, *PLAIN)]), [(1.0, 1.288, 60), (1.3, 1.8, 60)]),
    "no reset": (dict(notes=[(1.0, 1.8, 60)], evidence=[(1.0, 1.3, 60), (1.3, 1.8, 60)], attacks=[(1.3, 0.9, 2.2, -1.0, 2.0)]), [(1.0, 1.8, 60)]),
    "three attacks": (dict(notes=[(1.0, 2.0, 60)], evidence=[(1.0, 1.25, 60), (1.25, 1.5, 60), (1.5, 1.75, 60), (1.75, 2.0, 60)], attacks=[(t, *PLAIN) for t in (1.25, 1.5, 1.75)]), [(1.0, 1.238, 60), (1.25, 1.488, 60), (1.5, 1.738, 60), (1.75, 2.0, 60)]),
    "connecting note": (dict(notes=[(1.0, 1.25, 60), (1.65, 2.0, 64)], evidence=[(1.0, 1.25, 60), (1.3, 1.56, 62, 86), (1.31, 1.56, 74, 97), (1.65, 2.0, 64)], attacks=[(1.3, *STRONG)]), [(1.0, 1.288, 60), (1.3, 1.638, 62), (1.65, 2.0, 64)]),
    "harmonic at an onset": (dict(notes=[(1.0, 1.4, 60), (1.7, 2.0, 62)], evidence=[(1.0, 1.4, 60), (1.01, 1.3, 72), (1.7, 2.0, 62)], attacks=[(1.01, 1.2, 4.0, 5.0, 10.0)]), [(1.0, 1.4, 60), (1.7, 2.0, 62)]),
    "confirmed semitone": (dict(notes=[(1.0, 1.4, 60), (2.0, 2.4, 60)], evidence=[(1.0, 1.4, 61, 95), (2.0, 2.4, 72, 95)], estimates=[(1.0, 61.05, 0.05), (2.0, 60.02, 0.05)]), [(1.0, 1.4, 61), (2.0, 2.4, 60)]),
    "confirmed octave": (dict(notes=[(1.0, 1.4, 56, 55, 80)], evidence=[(1.0, 1.4, 68)], estimates=[(1.0, 67.7, 0.1)]), [(1.0, 1.4, 68)]),
}


@pytest.mark.parametrize("name", sorted(REFINED))
def test_refinement(spark, name):
    given, want = REFINED[name]
    assert refined(spark, **given) == want


#: Of each refinement the counters that are not 0.
COUNTED = {
    "borders of the evidence": dict(primary=1, kept=1, anchored_starts=1, anchored_ends=1),
    "weak noise": dict(primary=2, kept=1, dropped=1),
    "repetition": dict(primary=4, kept=3, merged=1, anchored_starts=3, anchored_ends=3),
    "split": dict(primary=1, kept=2, articulation_candidates=1, articulations_added=1, anchored_starts=1, anchored_ends=1),
    "no reset": dict(primary=1, kept=1, articulation_candidates=1, articulations_rejected=1, anchored_starts=1, anchored_ends=1),
    "three attacks": dict(primary=1, kept=4, articulation_candidates=3, articulations_added=3, anchored_starts=1, anchored_ends=1),
    "connecting note": dict(primary=2, kept=3, evidence_note_candidates=1, evidence_notes_added=1, anchored_starts=2, anchored_ends=2),
    "harmonic at an onset": dict(primary=2, kept=2, anchored_starts=2, anchored_ends=2),
    "confirmed semitone": dict(primary=2, kept=2, pitch_candidates=2, semitone_pitch_candidates=1, octave_pitch_candidates=1, pitch_corrections=1, pitch_corrections_rejected=1, semitone_corrections=1, anchored_starts=1, anchored_ends=1),
    "confirmed octave": dict(primary=1, kept=1, pitch_candidates=1, octave_pitch_candidates=1, pitch_corrections=1, octave_corrections=1, anchored_starts=1, anchored_ends=1),
}


@pytest.mark.parametrize("name", sorted(COUNTED))
def test_refinement_counters(spark, name):
    given, want = REFINED[name]
    notes, counts = refine.refine_counted(*refine_tables(spark, **given))
    assert [(r.start_us / 1e6, r.end_us / 1e6, r.midi) for r in notes.orderBy("start_us").collect()] == want
    got = counts.drop("track_id").first().asDict()
    assert list(got) == refine.COUNTERS and {k: v for k, v in got.items() if v} == COUNTED[name]


def test_onset_collisions_are_counted(spark):
    given = dict(notes=[(1.0, 1.4, 60), (1.03, 1.5, 62), (1.05, 1.5, 65), (2.0, 2.3, 60)], evidence=[])
    _, counts = refine.refine_counted(*refine_tables(spark, **given))
    r = counts.first()
    assert (r.primary, r.kept, r.onset_collisions, r.merged) == (4, 2, 2, 0)


def test_intro(spark):
    """The upper line of chords before the voice comes in; equal pitches join, notes end before the next."""
    evidence = [(0.0, 0.5, 67, 80), (0.02, 0.6, 72, 60), (0.05, 0.4, 72, 90), (0.45, 1.2, 72, 50), (1.3, 1.38, 80, 90), (1.5, 2.4, 64, 90), (1.6, 2.6, 70, 44), (1.8, 2.5, 76, 70), (2.1, 2.6, 74, 90)]
    notes = [(1.0, 1.5, 60), (2.0, 2.4, 62), (2.2, 2.6, 64)]
    p, e, _, _ = refine_tables(spark, notes, evidence)
    line = [(r.start_us / 1e6, r.end_us / 1e6, r.midi, r.conf) for r in refine.intro_line(e, 2_000_000).orderBy("start_us").collect()]
    assert line == [(0.05, 1.2, 72, 0.9), (1.8, 2.0, 76, 0.7)]
    both = refine.with_intro(refine.refine(p, e), e, 2_000_000).orderBy("start_us").collect()
    assert [(r.start_us / 1e6, r.end_us / 1e6, r.midi, r.from_intro) for r in both] == [(0.05, 1.2, 72, True), (1.8, 1.988, 76, True), (2.0, 2.188, 62, False), (2.2, 2.6, 64, False)]


def test_scoring_rules():
    state, ms = scoring.fresh(), 1000
    cue = lambda due, ident, lane=0, chord=None: scoring.step(state, "cue", due - scoring.AHEAD_US, ident, lane, chord)
    hit = lambda at, ident, lane=0, chord=None: scoring.step(state, "hit", at, ident, lane, chord)
    cue(1000 * ms, 1), cue(1300 * ms, 2)
    # early: graded now, shown when due; the next gesture of the string within 38 ms counts for nothing
    assert hit(940 * ms, 10) == [(1, 10, 940 * ms, 1000 * ms, "perfect", 1, 1)]
    assert hit(970 * ms, 11) == []
    # soon after a hit and nearer to its cue than to an open one: the same pluck again
    assert hit(1030 * ms, 12) == [] and hit(1200 * ms, 13) == [(2, 13, 1200 * ms, 1300 * ms, "good", 2, 2)]
    # another chord ends the run and leaves the cue open, which is then missed
    cue(2000 * ms, 3, chord="C")
    assert hit(2000 * ms, 14, chord="G") == [] and state["combo"] == 0
    assert scoring.step(state, "end", 2221 * ms, 0, 0, None) == [(3, None, 2220 * ms, 2220 * ms, "miss", 0, 2)]
    for k in range(100):
        cue((3000 + 500 * k) * ms, 100 + k), hit((3000 + 500 * k) * ms, 200 + k)
    assert len(state["recent"]) == scoring.RECENT and state["best"] == 100


def test_takes(spark):
    rows = [(1, k, at) for k, at in enumerate([0, 100_000, 30_000, 200_000, 0, 10_000])]
    got = scoring.with_takes(spark.createDataFrame(rows, "track_id long, seq long, at_us long"), "seq").orderBy("seq").collect()
    assert [r.take for r in got] == [0, 0, 0, 0, 1, 1]


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(2)
    chord = lambda: rng.choice([None, "C", "G"])
    events = [(t, 0, "cue", rng.randrange(5_000_000) - scoring.AHEAD_US, 100 * t + k, rng.randrange(3), chord()) for t in range(3) for k in range(25)]
    events += [(t, 0, "hit", rng.randrange(5_000_000), 5000 + 100 * t + k, rng.randrange(3), chord()) for t in range(3) for k in range(40)]
    events += [(t, 0, "end", 9_000_000, 0, 0, None) for t in range(3)]
    whole = spark.createDataFrame(events, scoring.EVENTS)
    want = sorted(map(str, scoring.replay(whole).collect()))
    src = tmp_path / "in"
    for k, (lo, hi) in enumerate([(-(10**9), 2_000_000), (2_000_000, 10**9)]):
        whole.where(f"at_us >= {lo} and at_us < {hi}").coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(scoring.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{src}/*")
    scoring.run_available(scoring.score_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(str, spark.read.schema(scoring.OUT).parquet(str(tmp_path / "out")).collect())) == want and len(want) > 60


def test_misses_come_by_timer(spark, tmp_path):
    """A track that falls silent has its cues missed once other tracks' events move the watermark on."""
    silent, other = [(1, 0, "cue", 600_000, 7, 0, None)], [(2, 0, "hit", 9_000_000, 8, 0, None)]
    for k, rows in enumerate([silent, other, [(2, 0, "hit", 9_500_000, 9, 0, None)]]):
        spark.createDataFrame(rows, scoring.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(scoring.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    scoring.run_available(scoring.score_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(scoring.OUT).parquet(str(tmp_path / "out")).collect()
    assert [(r.cue_id, r.gesture_id, r.grade, r.at_us) for r in got] == [(7, None, "miss", 1_220_000)]


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:00:03")]
    spark.createDataFrame(rows, "id int, s string").selectExpr("id", "cast(s as timestamp) at").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = lambda: spark.readStream.schema("id int, at timestamp").parquet(f"{tmp_path}/in/*")
    scoring.run_available(scoring.distinct_events(stream(), ["id"], "at", "1 minute"), f"{tmp_path}/o1", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/o1").count() == 2
    counted = scoring.windowed_counts(stream(), "at", "0 seconds", "1 second", "id")
    scoring.run_available(counted.select(F.col("window.start").alias("w"), "id", "count"), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/o2").count() >= 2


@pytest.mark.parametrize("module", ["sequence_queries", "window_queries", "refine", "stream_queries", "cli"])
def test_modules_can_be_imported_first(module):
    """A task imports only the module whose function it runs."""
    subprocess.run([sys.executable, "-c", f"import chronoloom.plans.{module}"], check=True, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))})


def test_transpositions(spark):
    texts = ["auto", "0", "-24", "24", "7.0", "25", "-25", "1.5", "x", "nan", "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", M.transposition(F.col("t")).alias("v")).orderBy("k").collect()
    assert [(r.v.valid, r.v.shift) for r in got] == [(True, None), (True, 0), (True, -24), (True, 24), (True, 7), *[(False, None)] * 7]
    with pytest.raises(Exception, match="transpose must be"):
        spark.createDataFrame([("25",)], "t string").select(M.strict_transposition(F.col("t"))).collect()


def test_stale_and_trusted(spark):
    rows = [(None, None, 9), (None, 2.0, 9), (None, 3.0, 9), (None, 3.0, 7), (None, 4.0, 0), ("shop", None, 0), (None, float("nan"), 9)]
    got = spark.createDataFrame(rows, "source string, version double, usable int").select(P.stale(F.col("source"), F.col("version"), F.col("usable"), 3.0).alias("s")).collect()
    assert [r.s for r in got] == [True, True, False, True, False, False, True]
    digest = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    rows = [(None, None), ("shop", digest), ("shop", f" {digest.upper()} "), ("shop", digest[:40]), ("shop", "0" * 64), ("shop", None)]
    got = spark.createDataFrame(rows, "source string, claimed string").select(P.trusted(F.col("source"), F.col("claimed"), F.lit("hello")).alias("t")).collect()
    assert [r.t for r in got] == [True, True, True, False, False, False]


def test_one_document(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, "b", 0.5), (1, 'a "quoted"\nline', None)], "k int, s string, v double")
    K.write_document(df, str(tmp_path / "d"), "k")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "d"), wholetext=True).collect())
    assert json.loads(text) == [{"k": 1, "s": 'a "quoted"\nline'}, {"k": 2, "s": "b", "v": 0.5}] and '\n    "k" : 1' in text
    K.write_document(df.limit(0), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first().value == "[]"
    with pytest.raises(Exception, match="not finite"):
        K.write_document(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "f"))


def test_catalog_lookup(spark):
    catalog = spark.createDataFrame([(1, "song", "x", 1, None), (2, "song", "x", 2, "art2"), (3, "song", "y", 1, "art3"), (4, "only", "z", 1, "art4"), (5, "real", "x", 1, "art5"), (6, "bare", "x", 1, None)], "id int, title_key string, artist_key string, rank int, value string")
    songs = spark.createDataFrame([("a", "song", "x"), ("b", "song", None), ("c", "only", None), ("d", "alias", "x"), ("e", "none", "x"), ("f", "song", "q"), ("g", "bare", "x"), ("h", "alias", "y")], "k string, title_key string, artist_key string")
    known = spark.createDataFrame([("alias", "x", 5)], "title_key string, artist_key string, id int")
    got = {r.k: r.value for r in J.catalog_lookup(songs, catalog, "k", known).collect()}
    assert got == {"a": "art2", "b": None, "c": "art4", "d": "art5", "e": None, "f": None, "g": None, "h": None}


def test_gaussian_of_short_groups(spark):
    from chronoloom.operators import windows as O

    rows = [(1, 0, 3.0), (2, 0, 1.0), (2, 1, 5.0), *[(3, k, float(k == 0)) for k in range(6)]]
    got = {(r.g, r.k): r.s for r in O.gaussian(spark.createDataFrame(rows, "g int, k int, v double"), ["g"], ["k"], "v", 0.8, "s").collect()}
    w = np.exp(-0.5 * (np.arange(-4, 5) / 0.8) ** 2)
    w /= w.sum()
    assert got[1, 0] == pytest.approx(3.0) and got[2, 0] == pytest.approx(w[:5].sum() + 5 * w[5:].sum())
    assert [got[3, k] for k in range(4)] == pytest.approx([w[4] + w[3], w[3] + w[2], w[2] + w[1], w[1] + w[0]])
