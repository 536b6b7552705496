"""Takes that the stream opens itself, writes that can be repeated, bounded caches."""

import random

from chronoloom.operators import sequences as S
from chronoloom.streaming import scoring


def clocked(rng, tracks=3, n=80):
    """Events of tracks whose clocks run on and now and then jump back."""
    out = []
    for t in range(tracks):
        clock = 0
        for seq in range(n):
            clock += rng.randrange(150_000)
            if rng.random() < 0.05:
                clock = max(0, clock - rng.randrange(2_000_000))
            kind = rng.choice(["cue", "hit", "hit"])
            out.append((t, seq, kind, clock, 1000 * t + seq, rng.randrange(2), rng.choice([None, "C"])))
    return out


def brute(events):
    """Each track cut into takes first, each take then played by itself."""
    rows = []
    for t in sorted({e[0] for e in events}):
        take, last, state = 0, None, scoring.fresh()
        for _, _, *event in sorted((e for e in events if e[0] == t), key=lambda e: e[1]):
            if last is not None and event[1] < last - scoring.REWIND_US:
                take, state = take + 1, scoring.fresh()
            last = event[1]
            rows += [(t, take, *r) for r in scoring.step(state, *event)]
    return sorted(map(str, rows))


def test_clock_stream_equals_replay(spark, tmp_path):
    events = clocked(random.Random(9))
    whole = spark.createDataFrame(events, scoring.CLOCKED)
    want = brute(events)
    assert sorted(str(tuple(r)) for r in scoring.replay_clock(whole).collect()) == want
    assert len(want) > 40 and any(", 2, " in w[:8] for w in want)
    for k in range(8):  # micro-batches in order
        part = whole.where(f"seq div 10 = {k}").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in/{k}")
    read = lambda: spark.readStream.schema(scoring.CLOCKED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out, first = f"{tmp_path}/out", scoring.begin_revision(spark, f"{tmp_path}/out")
    scoring.run_gated(scoring.score_clock_stream(read()), out, f"{tmp_path}/cp", first)
    rows = lambda: sorted(str(tuple(r)) for r in scoring.read_results(spark, out, scoring.OUT).collect())
    assert rows() == want
    # the same batches once more, as after a lost commit: nothing is there twice
    scoring.run_gated(scoring.score_clock_stream(read()), out, f"{tmp_path}/cp2", first)
    assert rows() == want


def test_batches_are_written_once_and_old_revisions_not_at_all(spark, tmp_path):
    path, df = str(tmp_path / "r"), spark.createDataFrame([(1,), (2,)], "x long")
    see = lambda: sorted(r.x for r in scoring.read_results(spark, path, "x long").collect())
    assert scoring.current_revision(spark, path) == -1 and see() == []
    first = scoring.begin_revision(spark, path)
    assert scoring.write_once(df, 0, path, first) and scoring.write_once(df, 0, path, first) and see() == [1, 2]
    assert scoring.write_once(df.limit(1), 1, path, first) and len(see()) == 3
    second = scoring.begin_revision(spark, path)
    assert second == first + 1 and see() == []
    assert not scoring.write_once(df, 2, path, first) and see() == []
    assert scoring.write_once(df, 0, path, second) and see() == [1, 2]


def test_bounded_cache(spark):
    rows = [(1, k, c) for k, c in enumerate("abacbda")] + [(2, 0, None), (2, 1, None), (2, 2, "x")]
    got = S.bounded_cache(spark.createDataFrame(rows, "g long, n long, k string"), ["g"], ["n"], "k", 2).orderBy("g", "n").collect()
    assert [(r.k, r.hit, r.evicted) for r in got if r.g == 1] == [("a", False, None), ("b", False, None), ("a", True, None), ("c", False, "a"), ("b", True, None), ("d", False, "b"), ("a", False, "c")]
    assert [(r.k, r.hit) for r in got if r.g == 2] == [(None, False), (None, True), ("x", False)]
