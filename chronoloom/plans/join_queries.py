"""Queries of the time joins, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.operators import joins as J
from chronoloom.registry import query

T = ["track_id"]


@query("jn01_point_in_interval", V.sql(V.NOTES, V.SEGMENTS) + """
SELECT n.track_id, n.note_id, min(s.seg_idx) AS seg_idx, arg_min(s.label, s.seg_idx) AS label FROM notes n JOIN segments s ON n.track_id = s.track_id AND n.start_us >= s.start_us AND n.start_us < s.end_us GROUP BY 1, 2""")
def jn01(spark, d):
    s = V.segments(spark, d).select("track_id", "seg_idx", "label", F.col("start_us").alias("s0"), F.col("end_us").alias("s1"))
    met = J.points_in_intervals(V.notes(spark, d), s, T, "start_us", F.col("s0"), F.col("s1") - 1, 4_000_000)
    return met.groupBy("track_id", "note_id").agg(F.min("seg_idx").alias("seg_idx"), F.min_by("label", "seg_idx").alias("label"))


_NEAREST = """
, g AS (SELECT g.*, s.seg_idx, s.start_us, abs(g.at_us - s.start_us) AS off, row_number() OVER (PARTITION BY g.track_id, g.gesture_id ORDER BY abs(g.at_us - s.start_us), s.start_us {tie}, s.seg_idx) AS rn
  FROM gestures g JOIN segments s ON g.track_id = s.track_id)
SELECT track_id, gesture_id, seg_idx, at_us - start_us AS diff FROM g WHERE rn = 1"""


@query("jn02_nearest", V.sql(V.NOTES, V.SEGMENTS, V.GESTURES) + _NEAREST.format(tie="DESC"))
def jn02(spark, d):
    beats = V.segments(spark, d).select("track_id", "seg_idx", "start_us")
    return J.nearest(V.gestures(spark, d), beats, T, "at_us", "start_us", ["seg_idx"], "seg_idx").where("seg_idx is not null").select("track_id", "gesture_id", "seg_idx", "diff")


@query("jn03_nearest_excluding", V.sql(V.NOTES, V.CUES, V.GESTURES) + """
, g AS (SELECT g.*, c.cue_id, c.time_us, row_number() OVER (PARTITION BY g.track_id, g.gesture_id ORDER BY abs(g.at_us - c.time_us), c.time_us, c.cue_id) AS rn
  FROM gestures g JOIN cues c ON g.track_id = c.track_id AND c.cue_id % 4 <> 0)
SELECT track_id, gesture_id, cue_id, at_us - time_us AS diff FROM g WHERE rn = 1""")
def jn03(spark, d):
    consumed = V.cues(spark, d).where("cue_id % 4 = 0").select("cue_id")
    free = V.cues(spark, d).join(consumed, "cue_id", "left_anti").select("track_id", "cue_id", "time_us")
    near = J.nearest(V.gestures(spark, d), free, T, "at_us", "time_us", ["cue_id"], "cue_id", tie_later=False)
    return near.where("cue_id is not null").select("track_id", "gesture_id", "cue_id", "diff")


_LANE = """
, g AS (SELECT g.*, c.cue_id, c.time_us, row_number() OVER (PARTITION BY g.track_id, g.gesture_id ORDER BY abs(g.at_us - c.time_us), c.time_us, c.cue_id) AS rn
  FROM gestures g JOIN cues c ON g.track_id = c.track_id AND g.string_idx = c.lane AND abs(g.at_us - c.time_us) <= {far})
SELECT track_id, gesture_id, cue_id, at_us - time_us AS diff FROM g WHERE rn = 1"""


def on_lane(spark, d, far):
    lanes = V.cues(spark, d).select("track_id", F.col("lane").alias("string_idx"), "cue_id", "time_us")
    near = J.nearest(V.gestures(spark, d), lanes, ["track_id", "string_idx"], "at_us", "time_us", ["cue_id"], "cue_id", tie_later=False)
    return near.where(F.abs("diff") <= far).select("track_id", "gesture_id", "cue_id", "diff")


@query("jn04_nearest_on_key", V.sql(V.NOTES, V.CUES, V.GESTURES) + _LANE.format(far=450_000))
def jn04(spark, d):
    return on_lane(spark, d, 450_000)


@query("jn06_current_target", V.sql(V.NOTES, V.CUES, V.GESTURES) + _LANE.format(far=180_000))
def jn06(spark, d):
    return on_lane(spark, d, 180_000)


@query("jn05_flight_window", V.sql(V.NOTES, V.CUES, V.GESTURES) + """
SELECT g.track_id, g.gesture_id, c.cue_id FROM gestures g JOIN cues c ON g.track_id = c.track_id AND c.time_us BETWEEN g.at_us - 400000 AND g.at_us + 2200000 WHERE c.cue_id % 4 <> 0""")
def jn05(spark, d):
    consumed = V.cues(spark, d).where("cue_id % 4 = 0").select("cue_id")
    free = V.cues(spark, d).join(consumed, "cue_id", "left_anti")
    windows = V.gestures(spark, d).select("track_id", "gesture_id", "at_us")
    return J.points_in_intervals(free, windows, T, "time_us", F.col("at_us") - 400_000, F.col("at_us") + 2_200_000, 2_000_000).select("track_id", "gesture_id", "cue_id")


#: Overlap over the shorter of the two (60 ms at least), closeness of the starts and quality: 0.55, 0.30 and 0.15 of a million each.
_SUPPORT = """(floor(550000 * least(1.0, greatest(0, least(n.end_us, e.end_us) - greatest(n.start_us, e.start_us))::DOUBLE / greatest(60000, least(n.end_us - n.start_us, e.end_us - e.start_us))))
  + floor(300000 * exp(-abs(n.start_us - e.start_us) / 65000.0::DOUBLE)) + 1500 * e.quality_pct)::BIGINT"""


def support(n0, n1, e0, e1, q):
    inter = F.greatest(F.lit(0), F.least(n1, e1) - F.greatest(n0, e0))
    shorter = F.greatest(F.lit(60_000), F.least(n1 - n0, e1 - e0))
    return F.floor(550_000 * F.least(F.lit(1.0), inter / shorter)) + F.floor(300_000 * F.exp(-F.abs(n0 - e0) / F.lit(65_000.0))) + 1500 * q


def supported(spark, d, offsets=(0,)):
    n = V.notes(spark, d).select("track_id", "note_id", F.col("start_us").alias("n0"), (F.col("start_us") + F.col("dur_us")).alias("n1"), F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), (F.col("midi") + o).alias("pitch"), F.lit(o).alias("shift")) for k, o in enumerate(offsets)))).alias("p"))
    n = n.select("track_id", "note_id", "n0", "n1", "p.*").withColumn("lo", F.col("n0") - 99_999).withColumn("hi", F.col("n1") + 100_000)
    e = V.evidence(spark, d).select("track_id", F.col("midi").alias("pitch"), "ev_id", F.col("start_us").alias("e0"), F.col("end_us").alias("e1"), "quality_pct")
    met = J.overlapping(n, e, ["track_id", "pitch"], "lo", "hi", "e0", "e1", 2_000_000)
    return met.withColumn("score", support(F.col("n0"), F.col("n1"), F.col("e0"), F.col("e1"), F.col("quality_pct")))


@query("jn07_best_support", V.sql(V.NOTES, V.EVIDENCE) + f"""
, m AS (SELECT n.track_id, n.note_id, e.ev_id, {_SUPPORT} AS score, e.start_us FROM (SELECT *, start_us + dur_us AS end_us FROM notes) n
  JOIN evidence e ON n.track_id = e.track_id AND n.midi = e.midi AND e.start_us < n.end_us + 100000 AND e.end_us > n.start_us - 99999)
SELECT track_id, note_id, arg_max(ev_id, (score, -start_us, -ev_id)) AS ev_id, max(score)::BIGINT AS score FROM m GROUP BY 1, 2""")
def jn07(spark, d):
    best = F.max(F.struct("score", (-F.col("e0")).alias("e"), (-F.col("ev_id")).alias("i"))).alias("b")
    return supported(spark, d).groupBy("track_id", "note_id").agg(best).select("track_id", "note_id", (-F.col("b.i")).alias("ev_id"), F.col("b.score").alias("score"))


@query("jn08_alternative_pitch", V.sql(V.NOTES, V.EVIDENCE) + f"""
, m AS (SELECT n.track_id, n.note_id, o.rank, o.shift, {_SUPPORT} AS score FROM (SELECT *, start_us + dur_us AS end_us FROM notes) n
  CROSS JOIN (VALUES (0, -12), (1, -1), (2, 1), (3, 12)) AS o(rank, shift)
  JOIN evidence e ON n.track_id = e.track_id AND n.midi + o.shift = e.midi AND e.start_us < n.end_us + 100000 AND e.end_us > n.start_us - 99999)
SELECT track_id, note_id, arg_max(shift, (score, -rank))::BIGINT AS shift, max(score)::BIGINT AS score FROM m GROUP BY 1, 2""")
def jn08(spark, d):
    best = F.max(F.struct("score", (-F.col("rank")).alias("r"), "shift")).alias("b")
    return supported(spark, d, (-12, -1, 1, 12)).groupBy("track_id", "note_id").agg(best).select("track_id", "note_id", F.col("b.shift").cast("long").alias("shift"), F.col("b.score").alias("score"))


@query("jn09_semi_band", V.sql(V.NOTES, V.EVIDENCE) + """
SELECT n.track_id, n.note_id FROM notes n WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.track_id = n.track_id AND e.midi = n.midi AND abs(e.start_us - n.start_us) <= 55000 AND e.quality_pct >= 55)""")
def jn09(spark, d):
    e = V.evidence(spark, d).where("quality_pct >= 55").select("track_id", "midi", F.col("start_us").alias("e0"))
    met = J.points_in_intervals(V.notes(spark, d), e, ["track_id", "midi"], "start_us", F.col("e0") - 55_000, F.col("e0") + 55_000, 1_000_000)
    return met.select("track_id", "note_id").distinct()


@query("jn10_nearest_key", V.sql(V.NOTES, V.EVIDENCE) + """
, m AS (SELECT n.track_id, n.note_id, e.ev_id, e.quality_pct, row_number() OVER (PARTITION BY n.track_id, n.note_id ORDER BY abs(n.start_us - e.start_us), e.start_us, e.ev_id) AS rn
  FROM notes n JOIN evidence e ON n.track_id = e.track_id AND abs(n.start_us - e.start_us) <= 15000)
SELECT track_id, note_id, ev_id, quality_pct FROM m WHERE rn = 1""")
def jn10(spark, d):
    e = V.evidence(spark, d).select("track_id", "ev_id", F.col("start_us").alias("e0"), "quality_pct")
    near = J.nearest(V.notes(spark, d), e, T, "start_us", "e0", ["ev_id", "quality_pct"], "ev_id", tie_later=False)
    return near.where(F.abs("diff") <= 15_000).select("track_id", "note_id", "ev_id", "quality_pct")


@query("jn11_anti_band", V.sql(V.NOTES, V.EVIDENCE) + """
SELECT e.track_id, e.ev_id FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE e.track_id = n.track_id AND abs(e.start_us - n.start_us) < 20000)""")
def jn11(spark, d):
    n = V.notes(spark, d).select("track_id", "note_id", F.col("start_us").alias("n0"))
    e = V.evidence(spark, d)
    near = J.nearest(e, n, T, "start_us", "n0", ["note_id"], "note_id")
    return near.where("note_id is null or abs(diff) >= 20000").select("track_id", "ev_id")


@query("jn13_beats_in_segments", V.sql(V.NOTES, V.SEGMENTS, V.GESTURES) + """
, m AS (SELECT g.track_id, g.gesture_id, g.at_us, s.seg_idx, s.end_us, s.label, row_number() OVER (PARTITION BY g.track_id, g.gesture_id ORDER BY s.start_us DESC, s.seg_idx DESC) AS rn FROM gestures g JOIN segments s ON g.track_id = s.track_id AND s.start_us <= g.at_us)
SELECT track_id, gesture_id, seg_idx FROM m WHERE rn = 1 AND at_us < end_us AND label <> 0""")
def jn13(spark, d):
    s = V.segments(spark, d).select("track_id", "seg_idx", "start_us", "end_us", "label")
    met = J.as_of(V.gestures(spark, d), s, T, "at_us", "start_us", ["seg_idx", "end_us", "label"], "seg_idx")
    return met.where("seg_idx is not null and at_us < end_us and label <> 0").select("track_id", "gesture_id", "seg_idx")


@query("jn14_normalised_keys", """
WITH a AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS k FROM part), b AS (SELECT k, count(*) AS n, min(p_partkey) AS first FROM a GROUP BY k)
SELECT a.p_partkey, b.first, b.n FROM a JOIN b ON a.k = b.k""")
def jn14(spark, d):
    from chronoloom.functions.text import ascii_key

    a = V.table(spark, d, "part").select("p_partkey", ascii_key(F.col("p_name")).alias("k"))
    return a.join(a.groupBy("k").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")), "k").select("p_partkey", "first", "n")


@query("jn15_reconcile", """
WITH lib AS (SELECT c_custkey AS id, c_nationkey AS version FROM customer WHERE c_custkey % 3 <> 0), cat AS (SELECT c_custkey AS id, 10 AS version FROM customer WHERE c_custkey % 5 <> 0),
known AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0)
SELECT cat.id, CASE WHEN lib.id IS NOT NULL AND lib.version >= cat.version THEN 'keep' WHEN lib.id IS NOT NULL THEN 'update' WHEN known.id IS NOT NULL THEN 'skip' ELSE 'insert' END AS action
FROM cat LEFT JOIN lib ON cat.id = lib.id LEFT JOIN known ON cat.id = known.id""")
def jn15(spark, d):
    from chronoloom.sources.sinks import reconcile

    c = V.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return reconcile(c.where("id % 5 <> 0").select("id", F.lit(10).alias("version")), c.where("id % 3 <> 0").select("id", F.col("c_nationkey").alias("version")), c.where("id % 4 = 0").select("id"))


@query("jn16_hits_to_cues", V.sql(V.NOTES, V.CUES) + """
SELECT h.note_id AS hit_id, c.cue_id, c.lane FROM notes h JOIN cues c ON c.cue_id = h.note_id // 2 * 2 WHERE h.note_id % 3 = 0""")
def jn16(spark, d):
    hits = V.notes(spark, d).where("note_id % 3 = 0").select(F.col("note_id").alias("hit_id"), F.expr("note_id div 2 * 2").alias("cue_id"))
    return hits.join(V.cues(spark, d).select("cue_id", "lane"), "cue_id").select("hit_id", "cue_id", "lane")


@query("jn17_gap_events", V.sql(V.NOTES, V.SEGMENTS, V.EVIDENCE) + """
SELECT s.track_id, s.seg_idx, e.ev_id FROM segments s JOIN evidence e ON s.track_id = e.track_id AND e.start_us >= s.start_us - 40000 AND e.start_us < s.end_us AND e.end_us > s.start_us WHERE s.label = 0""")
def jn17(spark, d):
    s = V.segments(spark, d).where("label = 0").select("track_id", "seg_idx", F.col("start_us").alias("s0"), F.col("end_us").alias("s1"))
    met = J.points_in_intervals(V.evidence(spark, d), s, T, "start_us", F.col("s0") - 40_000, F.col("s1") - 1, 4_000_000)
    return met.where("end_us > s0").select("track_id", "seg_idx", "ev_id")


@query("jn18_frames_in_notes", V.sql(V.NOTES, V.GESTURES) + """
, n AS (SELECT *, start_us + least(15000, dur_us * 15 // 100) AS lo, start_us + dur_us - least(15000, dur_us * 15 // 100) AS hi FROM notes)
SELECT n.track_id, n.note_id, count(*) AS frames, sum(g.string_idx)::BIGINT AS total FROM n JOIN gestures g ON n.track_id = g.track_id AND g.at_us BETWEEN n.lo AND n.hi GROUP BY 1, 2""")
def jn18(spark, d):
    trim = F.least(F.lit(15_000), F.expr("dur_us * 15 div 100"))
    n = V.notes(spark, d).select("track_id", "note_id", (F.col("start_us") + trim).alias("n0"), (F.col("start_us") + F.col("dur_us") - trim).alias("n1"))
    met = J.points_in_intervals(V.gestures(spark, d), n, T, "at_us", F.col("n0"), F.col("n1"), 1_000_000)
    return met.groupBy("track_id", "note_id").agg(F.count("*").alias("frames"), F.sum("string_idx").alias("total"))


@query("jn19_interpolate", V.sql(V.NOTES, V.SEGMENTS, V.GESTURES) + """
, k AS (SELECT track_id, start_us AS x, min(start_us + seg_idx * 10000) AS y FROM segments GROUP BY 1, 2),
s AS (SELECT track_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY track_id ORDER BY x)),
f AS (SELECT track_id, min(x) AS fx, arg_min(y, x) AS fy FROM k GROUP BY 1),
m AS (SELECT g.*, s.x0, s.y0, s.x1, s.y1, f.fx, f.fy FROM gestures g LEFT JOIN s ON g.track_id = s.track_id AND s.x0 <= g.at_us AND (s.x1 IS NULL OR g.at_us < s.x1) LEFT JOIN f ON g.track_id = f.track_id)
SELECT track_id, gesture_id, floor(CASE WHEN x0 IS NULL THEN (fy + (at_us - fx))::DOUBLE WHEN x1 IS NULL THEN (y0 + (at_us - x0))::DOUBLE ELSE y0 + ((at_us - x0) * (y1 - y0))::DOUBLE / (x1 - x0) END)::BIGINT AS mapped FROM m""")
def jn19(spark, d):
    k = V.segments(spark, d).groupBy("track_id", F.col("start_us").alias("x")).agg(F.min(F.col("start_us") + F.col("seg_idx") * 10_000).alias("y"))
    return J.interpolate(V.gestures(spark, d), k, T, "at_us", "x", "y").select("track_id", "gesture_id", F.floor("mapped").alias("mapped"))


@query("jn20_tempo_map", """
WITH c AS (SELECT c_nationkey AS score_id, c_custkey % 40 AS pos, arg_max(60 + c_custkey % 120, c_custkey) AS bpm FROM customer GROUP BY 1, 2),
full_map AS (SELECT * FROM c UNION ALL SELECT score_id, 0, 120 FROM c GROUP BY 1 HAVING min(pos) > 0),
l AS (SELECT *, lag(pos) OVER w AS p0, lag(bpm) OVER w AS b0 FROM full_map WINDOW w AS (PARTITION BY score_id ORDER BY pos)),
t AS (SELECT score_id, pos, bpm, coalesce(sum((pos - p0) * 60000000 // b0) OVER (PARTITION BY score_id ORDER BY pos), 0) AS base FROM l),
q AS (SELECT s_nationkey AS score_id, s_suppkey AS query_id, s_suppkey % 60 AS pos FROM supplier),
m AS (SELECT q.*, t.pos AS p0, t.bpm, t.base, row_number() OVER (PARTITION BY q.query_id ORDER BY t.pos DESC) AS rn FROM q JOIN t ON q.score_id = t.score_id AND t.pos <= q.pos)
SELECT query_id, (base + (pos - p0) * 60000000 // bpm)::BIGINT AS us FROM m WHERE rn = 1""")
def jn20(spark, d):
    from chronoloom.operators.sequences import tempo_times

    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("score_id"), (F.col("c_custkey") % 40).alias("pos"), (60 + F.col("c_custkey") % 120).alias("bpm"), F.col("c_custkey").alias("ord"))
    q = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("score_id"), F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 60).alias("pos"))
    return tempo_times(q, c, 120).where("us is not null").select("query_id", "us")


@query("jn21_closest_sample", V.sql(V.NOTES) + """
, k AS (SELECT unnest(range(40, 97, 3)) AS key), m AS (SELECT n.note_id, k.key, row_number() OVER (PARTITION BY n.note_id ORDER BY abs(n.midi - k.key), k.key) AS rn FROM notes n JOIN k ON abs(n.midi - k.key) <= 1)
SELECT note_id, key::BIGINT AS key FROM m WHERE rn = 1""")
def jn21(spark, d):
    keys = F.array(*(F.lit(k).cast("long") for k in range(40, 97, 3)))
    near = F.array_min(F.transform(F.filter(keys, lambda k: F.abs(F.col("midi") - k) <= 1), lambda k: F.struct(F.abs(F.col("midi") - k).alias("off"), k.alias("key"))))
    return V.notes(spark, d).select("note_id", near.getField("key").alias("key")).where("key is not null")


@query("jn22_expired", V.sql(V.NOTES, V.CUES, V.GESTURES) + """
SELECT c.track_id, c.cue_id FROM cues c WHERE c.time_us < 60000000 - 220000 AND NOT EXISTS (SELECT 1 FROM gestures g WHERE g.track_id = c.track_id AND g.string_idx = c.lane AND abs(g.at_us - c.time_us) <= 180000)""")
def jn22(spark, d):
    c = V.cues(spark, d).where(F.col("time_us") < 60_000_000 - 220_000).withColumnRenamed("lane", "string_idx")
    g = V.gestures(spark, d).select("track_id", "string_idx", "gesture_id", "at_us")
    near = J.nearest(c, g, ["track_id", "string_idx"], "time_us", "at_us", ["gesture_id"], "gesture_id")
    return near.where("gesture_id is null or abs(diff) > 180000").select("track_id", "cue_id")


@query("jn23_crossings", V.sql(V.NOTES, V.GESTURES) + """
, p AS (SELECT track_id, gesture_id, at_us % 700 AS x1, coalesce(lag(at_us % 700) OVER w, 0) AS x0 FROM gestures WINDOW w AS (PARTITION BY track_id ORDER BY at_us, gesture_id)),
lanes AS (SELECT unnest(range(6)) AS lane)
SELECT p.track_id, p.gesture_id, l.lane::BIGINT AS lane FROM p JOIN lanes l ON CASE WHEN x1 >= x0 THEN 50 + 100 * l.lane > x0 AND 50 + 100 * l.lane <= x1 ELSE 50 + 100 * l.lane < x0 AND 50 + 100 * l.lane >= x1 END""")
def jn23(spark, d):
    w = W.partitionBy("track_id").orderBy("at_us", "gesture_id")
    x = F.expr("at_us % 700")
    p = V.gestures(spark, d).select("track_id", "gesture_id", x.alias("x1"), F.coalesce(F.lag(x).over(w), F.lit(0)).alias("x0"))
    lanes = F.sequence(F.lit(0), F.lit(5))
    crossed = F.filter(lanes, lambda k: F.when(F.col("x1") >= F.col("x0"), (50 + 100 * k > F.col("x0")) & (50 + 100 * k <= F.col("x1"))).otherwise((50 + 100 * k < F.col("x0")) & (50 + 100 * k >= F.col("x1"))))
    return p.select("track_id", "gesture_id", F.explode(crossed).alias("lane")).withColumn("lane", F.col("lane").cast("long"))


@query("jn24_frets", V.sql(V.NOTES, V.SEGMENTS) + """
, open_strings AS (SELECT [40, 45, 50, 55, 59, 64] AS o), x AS (SELECT track_id, seg_idx, unnest(range(6)) AS s, label FROM segments)
SELECT track_id, seg_idx, s::BIGINT AS string_idx, CASE WHEN (label + s) % 4 = 3 THEN NULL ELSE o[s + 1] + (label + s) % 4 END::BIGINT AS midi FROM x, open_strings""")
def jn24(spark, d):
    from chronoloom.functions.music import string_midi

    rows = V.segments(spark, d).select("track_id", "seg_idx", "label", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    fret = F.when((F.col("label") + F.col("s")) % 4 == 3, -1).otherwise((F.col("label") + F.col("s")) % 4)
    return rows.select("track_id", "seg_idx", F.col("s").cast("long").alias("string_idx"), string_midi(F.col("s"), fret).alias("midi"))


@query("jn25_note_frames", V.sql(V.NOTES, V.CHROMA) + """
, n AS (SELECT note_id, midi % 12 AS pc, greatest(0, least(round_even(start_us / 100000.0, 0), (SELECT count(*) FROM chroma) - 1))::BIGINT AS frame FROM notes)
SELECT n.note_id, n.frame, chroma[n.pc + 1] AS own, list_max(chroma) AS top FROM n JOIN chroma c ON c.vec_id = n.frame""")
def jn25(spark, d):
    c = V.chroma(spark, d)
    last = c.agg((F.count("*") - 1).alias("last"))
    n = V.notes(spark, d).crossJoin(F.broadcast(last))  # one row
    frame = F.greatest(F.lit(0), F.least(F.bround(F.col("start_us") / 100_000).cast("long"), F.col("last")))
    n = n.select("note_id", (F.col("midi") % 12).cast("int").alias("pc"), frame.alias("frame"))
    return n.join(c, n.frame == c.vec_id).select("note_id", "frame", F.element_at("chroma", F.col("pc") + 1).alias("own"), F.array_max("chroma").alias("top"))


@query("jn26_cut_over", V.sql(V.NOTES, V.EVIDENCE) + """
, u AS (SELECT track_id, ev_id AS id, start_us, end_us, midi, 0 AS side FROM evidence WHERE start_us < 20000000 UNION ALL SELECT track_id, note_id, start_us, start_us + dur_us, midi, 1 FROM notes WHERE start_us >= 20000000),
l AS (SELECT *, lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, side, id) AS nxt FROM u)
SELECT track_id, id, side::BIGINT AS side, start_us, greatest(start_us + 60000, CASE WHEN nxt IS NULL THEN end_us ELSE least(end_us, nxt - 12000) END) AS end_us FROM l""")
def jn26(spark, d):
    e = V.evidence(spark, d).where("start_us < 20000000").select("track_id", F.col("ev_id").alias("id"), "start_us", "end_us", F.lit(0).cast("long").alias("side"))
    n = V.notes(spark, d).where("start_us >= 20000000").select("track_id", F.col("note_id").alias("id"), "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"), F.lit(1).cast("long").alias("side"))
    w = W.partitionBy("track_id").orderBy("start_us", "side", "id")
    nxt = F.lead("start_us").over(w)
    return e.unionByName(n).withColumn("end_us", F.greatest(F.col("start_us") + 60_000, F.coalesce(F.least(F.col("end_us"), nxt - 12_000), F.col("end_us"))))


@query("src16_catalog_lookup", """
WITH c AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS t, lower(p_brand) AS a, CASE WHEN p_partkey % 3 <> 0 THEN 'art/' || p_partkey END AS value FROM part),
s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'alias ' || p_partkey % 50 ELSE lower(split_part(p_name, ' ', 2)) END AS t, CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) END AS a FROM part),
k AS (SELECT 'alias ' || p_partkey % 50 AS t, lower(p_brand) AS a, min(p_partkey) AS id FROM part WHERE p_partkey % 11 = 0 GROUP BY 1, 2),
b AS (SELECT t, a, arg_min(value, id) FILTER (value IS NOT NULL) AS value FROM c GROUP BY 1, 2),
o AS (SELECT t, any_value(value) AS value FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT s.id, CASE WHEN s.a IS NULL THEN o.value WHEN k.id IS NOT NULL THEN c.value ELSE b.value END AS value
FROM s LEFT JOIN o ON s.t = o.t LEFT JOIN b ON s.t = b.t AND s.a = b.a LEFT JOIN k ON s.t = k.t AND s.a = k.a LEFT JOIN c ON c.id = k.id AND c.a = s.a""")
def src16(spark, d):
    """Songs by the second word of a part's name against a catalog by the first; some without an artist, some under another title."""
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    word = lambda n: F.lower(F.split_part("p_name", F.lit(" "), F.lit(n)))
    other, maker = F.concat(F.lit("alias "), (k % 50).cast("string")), F.lower("p_brand")
    catalog = p.select(k.alias("id"), word(1).alias("title_key"), maker.alias("artist_key"), k.alias("rank"), F.when(k % 3 != 0, F.concat(F.lit("art/"), k.cast("string"))).alias("value"))
    songs = p.select(k.alias("song"), F.when(k % 11 == 0, other).otherwise(word(2)).alias("title_key"), F.when(k % 3 > 0, maker).alias("artist_key"))
    known = p.where(k % 11 == 0).select(other.alias("title_key"), maker.alias("artist_key"), k.alias("id"))
    return J.catalog_lookup(songs, catalog, "song", known).select(F.col("song").alias("id"), "value")
