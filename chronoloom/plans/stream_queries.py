"""Queries of the online operators in batch form; tests run the same operators as streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.operators import joins as J
from chronoloom.operators import sequences as Q
from chronoloom.registry import query
from chronoloom.streaming import scoring as S


@query("str02_scoring")
def str02(spark, d):
    """Hits and misses of each take (STR-02, STR-03, STR-05, STR-07, STR-08); a tenth of the gestures play another chord."""
    cues = V.cues(spark, d).withColumn("chord", (F.col("lane") % 2).cast("string"))
    played = F.when(F.col("gesture_id") % 10 == 0, F.lit("other")).otherwise((F.col("string_idx") % 2).cast("string"))
    return S.replay(S.timeline(cues, V.gestures(spark, d).withColumn("chord", played), V.TRACK_US + 1_000_000))


@query("str04_takes", V.sql(V.NOTES, V.GESTURES) + """
, b AS (SELECT *, CASE WHEN at_us < lag(at_us) OVER w - 80000 THEN 1 ELSE 0 END AS back FROM gestures WINDOW w AS (PARTITION BY track_id ORDER BY gesture_id))
SELECT track_id, gesture_id, sum(back) OVER (PARTITION BY track_id ORDER BY gesture_id)::BIGINT AS take FROM b""")
def str04(spark, d):
    """Gestures in the order of their ids, whose jitter moves the clock back now and then."""
    return S.with_takes(V.gestures(spark, d), "gesture_id").select("track_id", "gesture_id", "take")


@query("str06_dedup", V.sql(V.NOTES, V.GESTURES) + "SELECT track_id, string_idx, at_us // 100000 AS cell, min(gesture_id) AS gesture_id FROM gestures GROUP BY 1, 2, 3")
def str06(spark, d):
    return V.gestures(spark, d).groupBy("track_id", "string_idx", F.expr("at_us div 100000").alias("cell")).agg(F.min("gesture_id").alias("gesture_id"))


@query("str07_throttle", V.sql(V.NOTES, V.GESTURES, "n AS (SELECT *, row_number() OVER (PARTITION BY track_id, string_idx ORDER BY at_us, gesture_id) AS rn FROM gestures)", recursive=True) + """
, a AS (SELECT track_id, string_idx, rn, gesture_id, at_us AS last, true AS kept FROM n WHERE rn = 1
  UNION ALL SELECT n.track_id, n.string_idx, n.rn, n.gesture_id, CASE WHEN n.at_us - a.last >= 38000 THEN n.at_us ELSE a.last END, n.at_us - a.last >= 38000 FROM a JOIN n ON n.track_id = a.track_id AND n.string_idx = a.string_idx AND n.rn = a.rn + 1)
SELECT track_id, gesture_id FROM a WHERE kept""")
def str07(spark, d):
    from chronoloom.operators.sequences import anchored_groups

    g = V.gestures(spark, d)
    groups = anchored_groups(g, ["track_id", "string_idx"], 37_999, "at_us", "gesture_id")
    return groups.groupBy("track_id", "string_idx", "anchor").agg(F.min_by("gesture_id", F.struct("at_us", "gesture_id")).alias("gesture_id")).select("track_id", "gesture_id")


@query("str09_beat_trigger", V.sql(V.NOTES, V.SEGMENTS, V.GESTURES) + """
, g AS (SELECT g.*, s.seg_idx, s.start_us, row_number() OVER (PARTITION BY g.track_id, g.gesture_id ORDER BY abs(g.at_us - s.start_us), s.start_us DESC, s.seg_idx) AS rn FROM gestures g JOIN segments s ON g.track_id = s.track_id),
n AS (SELECT *, lag(seg_idx) OVER (PARTITION BY track_id ORDER BY at_us, gesture_id) AS before FROM g WHERE rn = 1 AND abs(at_us - start_us) < 40000)
SELECT track_id, gesture_id, seg_idx FROM n WHERE before IS DISTINCT FROM seg_idx""")
def str09(spark, d):
    beats = V.segments(spark, d).select("track_id", "seg_idx", "start_us")
    near = J.nearest(V.gestures(spark, d), beats, ["track_id"], "at_us", "start_us", ["seg_idx"], "seg_idx").where("abs(diff) < 40000")
    before = F.lag("seg_idx").over(W.partitionBy("track_id").orderBy("at_us", "gesture_id"))
    return near.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("seg_idx"))).select("track_id", "gesture_id", "seg_idx")


@query("str10_one_target", V.sql(V.NOTES, V.GESTURES) + """
SELECT track_id, cell, gesture_id FROM (SELECT track_id, at_us // 500000 AS cell, gesture_id, row_number() OVER (PARTITION BY track_id, at_us // 500000 ORDER BY string_idx, gesture_id) AS rn FROM gestures) WHERE rn = 1""")
def str10(spark, d):
    g = V.gestures(spark, d).withColumn("cell", F.expr("at_us div 500000"))
    return g.groupBy("track_id", "cell").agg(F.min_by("gesture_id", F.struct("string_idx", "gesture_id")).alias("gesture_id"))


@query("str04_clock_scoring")
def str04_clock(spark, d):
    """STR-04 inside the scoring: cues and gestures in the order of their ids, whose jitter moves the clock back now and then; tests hold the stream against this replay."""
    both = S.timeline(V.cues(spark, d), V.gestures(spark, d))
    order = F.col("id") * 2 + (F.col("kind") == "hit").cast("long")
    return S.replay_clock(both.withColumn("seq", order))


@query("srt05_bounded_cache", V.sql(V.NOTES, "r AS (SELECT track_id, note_id, midi, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM notes)", recursive=True) + """
, c AS (SELECT track_id, rn, note_id, midi, false AS hit, NULL::BIGINT AS evicted, [midi] AS held FROM r WHERE rn = 1
  UNION ALL SELECT r.track_id, r.rn, r.note_id, r.midi, list_contains(c.held, r.midi), CASE WHEN NOT list_contains(c.held, r.midi) AND len(c.held) >= 12 THEN c.held[1] END,
    CASE WHEN list_contains(c.held, r.midi) THEN c.held WHEN len(c.held) >= 12 THEN list_append(c.held[2:], r.midi) ELSE list_append(c.held, r.midi) END
  FROM c JOIN r ON r.track_id = c.track_id AND r.rn = c.rn + 1)
SELECT track_id, note_id, midi, hit, evicted FROM c""")
def srt05(spark, d):
    """Each track's notes ask for the voice of their pitch; twelve voices are held, first in first out."""
    return Q.bounded_cache(V.notes(spark, d), ["track_id"], ["start_us", "note_id"], "midi", 12).select("track_id", "note_id", "midi", "hit", "evicted")
