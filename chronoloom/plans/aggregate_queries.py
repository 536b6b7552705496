"""Queries of the grouped summaries, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.functions import arrays as A
from chronoloom.functions.text import name_score
from chronoloom.operators import aggregates as G
from chronoloom.operators import joins as J
from chronoloom.operators import windows as O
from chronoloom.plans.window_queries import ENDED, ended
from chronoloom.registry import query

T = ["track_id"]
PVS = ["part_index", "voice", "staff"]


@query("agg01_streams", V.sql(V.SCORE) + """
, o AS (SELECT part_index, voice, staff, start, count(*) AS n FROM score GROUP BY ALL), l AS (SELECT part_index, voice, staff, count(*) AS onsets, count(*) FILTER (n = 1) AS lone FROM o GROUP BY ALL),
s AS (SELECT part_index, voice, staff, count(*) AS notes, min(start) AS first, max(start + dur) AS last, min(midi) AS low, max(midi) AS high, median(midi) AS median_midi FROM score GROUP BY ALL)
SELECT s.*, l.lone, l.onsets FROM s JOIN l USING (part_index, voice, staff)""")
def agg01(spark, d):
    return G.summarise_streams(V.score(spark, d), PVS)


@query("agg02_monophony", V.sql(V.NOTES) + """
, o AS (SELECT track_id, start_us // 100000 AS cell, count(*) AS n FROM notes GROUP BY ALL) SELECT track_id, count(*) FILTER (n = 1) AS lone, count(*) AS groups FROM o GROUP BY 1""")
def agg02(spark, d):
    o = V.notes(spark, d).groupBy("track_id", F.expr("start_us div 100000").alias("cell")).agg(F.count("*").alias("n"))
    return o.groupBy("track_id").agg(F.count_if(F.col("n") == 1).alias("lone"), F.count("*").alias("groups"))


@query("agg03_waveform_bins", V.sql(V.NOTES) + """
, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM notes)
SELECT track_id, i * least(40, n) // n AS bin, sum(conf_pct * conf_pct)::BIGINT AS energy, max(conf_pct) AS peak, count(*) AS n FROM n GROUP BY 1, 2""")
def agg03(spark, d):
    w = W.partitionBy("track_id")
    n = V.notes(spark, d).withColumn("i", F.row_number().over(w.orderBy("start_us", "note_id")) - 1).withColumn("n", F.count("*").over(w))
    return G.equal_bins(n, T, "i", "n", 40).groupBy("track_id", "bin").agg(F.sum(F.col("conf_pct") * F.col("conf_pct")).alias("energy"), F.max("conf_pct").alias("peak"), F.count("*").alias("n"))


@query("agg06_tempo_shares", V.sql(V.NOTES) + """
, g AS (SELECT track_id, note_id, conf_pct, row_number() OVER w AS i, start_us - lag(start_us) OVER w AS gap FROM notes WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
m AS (SELECT track_id, median(gap) AS mid FROM g WHERE gap > 0 GROUP BY 1)
SELECT g.track_id, any_value(mid) AS median_gap, count(*) FILTER (gap > 0 AND abs(gap - mid) * 100 <= 12 * mid) AS steady, sum(conf_pct) FILTER (i % 2 = 1)::BIGINT AS odd, sum(conf_pct) FILTER (i % 2 = 0)::BIGINT AS even FROM g JOIN m USING (track_id) GROUP BY 1""")
def agg06(spark, d):
    w = W.partitionBy("track_id").orderBy("start_us", "note_id")
    g = V.notes(spark, d).select("track_id", "conf_pct", F.row_number().over(w).alias("i"), (F.col("start_us") - F.lag("start_us").over(w)).alias("gap"))
    m = g.where("gap > 0").groupBy("track_id").agg(F.median("gap").alias("mid"))
    parity = lambda k: F.sum(F.when(F.col("i") % 2 == k, F.col("conf_pct")))
    return g.join(m, "track_id").groupBy("track_id").agg(F.first("mid").alias("median_gap"), F.count_if((F.col("gap") > 0) & (F.abs(F.col("gap") - F.col("mid")) * 100 <= 12 * F.col("mid"))).alias("steady"), parity(1).alias("odd"), parity(0).alias("even"))


def _key_sql() -> str:
    rows = []
    for offset, base in ((0, G.MAJOR), (12, G.MINOR)):
        mean = sum(base) / 12
        for tonic in range(12):
            rows.append(f"({offset + tonic}, {[round((base[(k - tonic) % 12] - mean) * 100) for k in range(12)]})")
    return ", ".join(rows)


@query("agg07_key", V.sql(V.CHROMA) + f"""
, p AS (SELECT label, unnest(range(12)) AS pc, chroma, vec_id % 7 + 1 AS w FROM chroma), v AS (SELECT label, pc, sum(chroma[pc + 1] * w)::BIGINT AS value FROM p GROUP BY 1, 2),
t AS (SELECT * FROM (VALUES {_key_sql()}) AS t(key, weights)), s AS (SELECT label, key, sum(value * weights[pc + 1])::BIGINT AS score FROM v, t GROUP BY 1, 2)
SELECT label, arg_max(key, (score, -key))::BIGINT AS key, max(score) AS score FROM s GROUP BY 1""")
def agg07(spark, d):
    p = G.weighted_profile(V.chroma(spark, d).withColumn("w", F.col("vec_id") % 7 + 1), "chroma", "w", ["label"])
    arr = p.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "value"))), lambda x: x.value).alias("profile"))
    best = F.array_max(G.key_scores(F.col("profile")))
    return arr.select("label", (-best.neg_key).cast("long").alias("key"), best.score.alias("score"))


@query("agg08_weighted_confidence", V.sql(V.NOTES, V.SEGMENTS) + """
SELECT track_id, sum(conf_pct * (end_us - start_us))::BIGINT AS weighted, sum(end_us - start_us)::BIGINT AS duration FROM segments GROUP BY 1""")
def agg08(spark, d):
    length = F.col("end_us") - F.col("start_us")
    return V.segments(spark, d).groupBy("track_id").agg(F.sum(F.col("conf_pct") * length).alias("weighted"), F.sum(length).alias("duration"))


@query("agg09_label_runs", V.sql(V.NOTES, V.SEGMENTS) + """
, c AS (SELECT *, CASE WHEN label // 4 = lag(label // 4) OVER w THEN 0 ELSE 1 END AS changed FROM segments WINDOW w AS (PARTITION BY track_id ORDER BY seg_idx)), r AS (SELECT *, sum(changed) OVER (PARTITION BY track_id ORDER BY seg_idx)::BIGINT AS run FROM c)
SELECT track_id, run, min(start_us) AS start_us, max(end_us) AS end_us, sum(conf_pct)::BIGINT AS conf, count(*) AS n FROM r GROUP BY 1, 2""")
def agg09(spark, d):
    s = V.segments(spark, d).withColumn("family", F.expr("label div 4"))
    return O.run_ids(s, "family", T, "seg_idx").groupBy("track_id", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("conf_pct").alias("conf"), F.count("*").alias("n"))


@query("agg10_report", V.sql(V.NOTES, V.EVIDENCE) + """
, p AS (SELECT n.track_id, e.start_us - n.start_us AS diff, e.midi - n.midi AS pd FROM notes n JOIN evidence e ON n.track_id = e.track_id AND n.note_id = e.ev_id AND abs(e.start_us - n.start_us) <= 75000),
a AS (SELECT track_id, count(*) AS n_ref FROM notes GROUP BY 1), b AS (SELECT track_id, count(*) AS n_cand FROM evidence GROUP BY 1),
m AS (SELECT track_id, count(*) AS matched, count(*) FILTER (pd = 0) AS exact, count(*) FILTER (pd <> 0 AND pd % 12 = 0) AS octave, count(*) FILTER (pd % 12 <> 0) AS wrong, sum(abs(diff))::BIGINT AS total, quantile_cont(abs(diff), 0.95) AS p95 FROM p GROUP BY 1)
SELECT a.track_id, n_ref, coalesce(n_cand, 0) AS n_cand, coalesce(matched, 0) AS matched, coalesce(exact, 0) AS exact, coalesce(octave, 0) AS octave, coalesce(wrong, 0) AS wrong, round_even(total / matched, 0)::BIGINT AS mae, round_even(p95, 0)::BIGINT AS p95 FROM a LEFT JOIN b USING (track_id) LEFT JOIN m USING (track_id)""")
def agg10(spark, d):
    n, e = V.notes(spark, d), V.evidence(spark, d)
    p = n.join(e.select(F.col("track_id").alias("t"), F.col("ev_id").alias("note_id"), F.col("start_us").alias("e0"), F.col("midi").alias("em")), "note_id").where("t = track_id and abs(e0 - start_us) <= 75000")
    pairs = p.select("track_id", (F.col("e0") - F.col("start_us")).alias("diff"), (F.col("em") - F.col("midi")).alias("pitch_diff"))
    return G.report(pairs, n, e, T).withColumn("mae", F.bround("mae").cast("long")).withColumn("p95", F.bround("p95").cast("long"))


@query("agg11_diagnostics", V.sql(V.NOTES, ENDED) + """
SELECT track_id, count(*) AS notes, sum(dur_us)::BIGINT AS total, median(dur_us) AS median_dur, count(*) FILTER (dur_us < 150000) AS short, min(start_us) AS first, max(end_us) AS last, min(midi) AS low, max(midi) AS high FROM ended GROUP BY 1""")
def agg11(spark, d):
    return ended(spark, d).groupBy("track_id").agg(F.count("*").alias("notes"), F.sum("dur_us").alias("total"), F.median("dur_us").alias("median_dur"), F.count_if(F.col("dur_us") < 150_000).alias("short"), F.min("start_us").alias("first"), F.max("end_us").alias("last"), F.min("midi").alias("low"), F.max("midi").alias("high"))


@query("agg12_run_stats", V.sql(V.NOTES, ENDED) + f"""
, i AS (SELECT track_id, lead(start_us) OVER w - start_us AS ioi, lead(start_us) OVER w - end_us AS rest FROM ended WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id))
SELECT track_id, count(*) FILTER (ioi < 100000) AS quick, coalesce(max(rest), {V.TRACK_US}) AS longest_rest FROM i GROUP BY 1""")
def agg12(spark, d):
    return O.onset_intervals(ended(spark, d), T).groupBy("track_id").agg(F.count_if(F.col("ioi") < 100_000).alias("quick"), F.coalesce(F.max("rest"), F.lit(V.TRACK_US)).alias("longest_rest"))


@query("agg13_neighbourhood", V.sql(V.NOTES, V.GESTURES) + """
SELECT g.track_id, g.gesture_id, max(n.conf_pct) FILTER (abs(n.start_us - g.at_us) <= 70000) AS peak, median(n.conf_pct) AS floor, min(n.conf_pct) FILTER (n.start_us < g.at_us AND n.start_us >= g.at_us - 120000) AS before, max(n.conf_pct) FILTER (n.start_us >= g.at_us AND n.start_us <= g.at_us + 120000) AS after
FROM gestures g JOIN notes n ON g.track_id = n.track_id AND n.start_us BETWEEN g.at_us - 500000 AND g.at_us + 500000 GROUP BY 1, 2""")
def agg13(spark, d):
    g = V.gestures(spark, d).select("track_id", "gesture_id", "at_us")
    met = J.points_in_intervals(V.notes(spark, d), g, T, "start_us", F.col("at_us") - 500_000, F.col("at_us") + 500_000, 1_000_000)
    off = F.col("start_us") - F.col("at_us")
    return met.groupBy("track_id", "gesture_id").agg(F.max(F.when(F.abs(off) <= 70_000, F.col("conf_pct"))).alias("peak"), F.median("conf_pct").alias("floor"), F.min(F.when((off < 0) & (off >= -120_000), F.col("conf_pct"))).alias("before"), F.max(F.when((off >= 0) & (off <= 120_000), F.col("conf_pct"))).alias("after"))


@query("agg14_median_mad", V.sql(V.NOTES) + """
, m AS (SELECT track_id, median(midi) AS mid FROM notes GROUP BY 1) SELECT n.track_id, any_value(mid) AS median, median(abs(midi - mid)) AS mad FROM notes n JOIN m USING (track_id) GROUP BY 1""")
def agg14(spark, d):
    return G.deviation(V.notes(spark, d), T, "midi")


@query("agg15_counters", V.sql(V.NOTES, V.EVIDENCE) + """
SELECT count(*) AS candidates, count(*) FILTER (midi BETWEEN 48 AND 84) AS in_range, count(*) FILTER (conf_pct >= 72 OR dur_us >= 200000 AND conf_pct >= 60 AND strength_pct >= 42) AS clear,
  count(*) FILTER (NOT (midi BETWEEN 48 AND 84 AND (conf_pct >= 72 OR dur_us >= 200000 AND conf_pct >= 60 AND strength_pct >= 42))) AS rejected FROM notes""")
def agg15(spark, d):
    inside = F.col("midi").between(48, 84)
    clear = (F.col("conf_pct") >= 72) | ((F.col("dur_us") >= 200_000) & (F.col("conf_pct") >= 60) & (F.col("strength_pct") >= 42))
    return V.notes(spark, d).agg(F.count("*").alias("candidates"), F.count_if(inside).alias("in_range"), F.count_if(clear).alias("clear"), F.count_if(~(inside & clear)).alias("rejected"))


@query("agg16_interval_merge", V.sql(V.NOTES, V.EVIDENCE) + """
, o AS (SELECT *, max(end_us) OVER (PARTITION BY track_id, midi ORDER BY start_us, ev_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM evidence),
i AS (SELECT *, sum(CASE WHEN so_far IS NULL OR start_us - so_far > 24000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, midi ORDER BY start_us, ev_id) AS island FROM o)
SELECT track_id, midi, min(start_us) AS start_us, max(end_us) AS end_us, max(quality_pct) AS quality_pct FROM i GROUP BY track_id, midi, island""")
def agg16(spark, d):
    rows = O.islands(V.evidence(spark, d), 24_000, ["track_id", "midi"], tie="ev_id")
    return rows.groupBy("track_id", "midi", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("quality_pct").alias("quality_pct")).drop("island")


@query("agg17_score_rollup", V.sql(V.NOTES) + """
, h AS (SELECT *, note_id % 401 - 200 AS off FROM notes), g AS (SELECT *, CASE WHEN abs(off) <= 80 THEN 'perfect' WHEN abs(off) <= 180 THEN 'good' ELSE 'miss' END AS grade FROM h),
b AS (SELECT *, sum((grade = 'miss')::INT) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS broken FROM g), c AS (SELECT *, sum((grade <> 'miss')::INT) OVER (PARTITION BY track_id, broken ORDER BY start_us, note_id) AS combo FROM b)
SELECT track_id, count(*) FILTER (grade = 'perfect') AS perfect, count(*) FILTER (grade = 'good') AS good, count(*) FILTER (grade = 'miss') AS missed, max(combo)::BIGINT AS best, floor(100 * count(*) FILTER (grade <> 'miss') / count(*) + 0.5)::BIGINT AS accuracy FROM c GROUP BY 1""")
def agg17(spark, d):
    from chronoloom.functions.music import grade

    rows = V.notes(spark, d).withColumn("grade", grade(F.col("note_id") % 401 - 200, 80, 180)).withColumn("hit", F.col("grade") != "miss")
    rows = O.streaks(rows, "hit", T, "start_us", "note_id")
    n = lambda g: F.count_if(F.col("grade") == g)
    return rows.groupBy("track_id").agg(n("perfect").alias("perfect"), n("good").alias("good"), n("miss").alias("missed"), F.max("best").alias("best"), F.floor(100 * F.count_if("hit") / F.count("*") + 0.5).alias("accuracy"))


@query("agg18_unique_owner", """
SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_type) = 1 AS sure FROM part GROUP BY 1""")
def agg18(spark, d):
    t = F.count_distinct("p_type")
    return V.table(spark, d, "part").groupBy("p_brand").agg(t.alias("types"), (t == 1).alias("sure"))


@query("agg19_peak_normalise", V.sql(V.NOTES) + """
SELECT track_id, note_id, CASE WHEN max(abs(conf_pct - 50)) OVER (PARTITION BY track_id) > 0 THEN round((conf_pct - 50) / max(abs(conf_pct - 50)) OVER (PARTITION BY track_id), 6) ELSE 0.0 END AS level FROM notes""")
def agg19(spark, d):
    rows = V.notes(spark, d).withColumn("v", F.col("conf_pct") - 50)
    return G.peak_normalised(rows, "v", T).select("track_id", "note_id", F.round("level", 6).alias("level"))


@query("agg20_pitch_shift", V.sql(V.CHROMA) + """
, p AS (SELECT label, pc, sum(v)::BIGINT AS v FROM (SELECT label, unnest(range(12)) AS pc, unnest(chroma) AS v FROM chroma) GROUP BY 1, 2), r AS (SELECT pc, v FROM p WHERE label = 0), s AS (SELECT unnest(range(-6, 6)) AS shift),
x AS (SELECT p.label, s.shift, sum(p.v * r.v)::HUGEINT AS dot FROM p, s, r WHERE r.pc = (p.pc + s.shift + 12) % 12 GROUP BY 1, 2)
SELECT label, arg_max(shift, (dot, -abs(shift), -shift))::BIGINT AS shift FROM x GROUP BY 1""")
def agg20(spark, d):
    p = V.chroma(spark, d).select("label", F.posexplode("chroma").alias("pc", "v")).groupBy("label", "pc").agg(F.sum("v").alias("v"))
    arr = p.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "v"))), lambda x: x.v).alias("a"))
    ref = arr.where("label = 0").select(F.col("a").alias("b"))
    met = arr.crossJoin(F.broadcast(ref))  # one row
    return met.select("label", G.best_rotation(F.col("a"), F.col("b")).shift.cast("long").alias("shift"))


@query("agg21_collapse_path", V.sql(V.NOTES) + """
, m AS (SELECT track_id, start_us // 1000000 AS a, median(midi) AS mid FROM notes GROUP BY 1, 2) SELECT track_id, a, max(mid) OVER (PARTITION BY track_id ORDER BY a) AS b FROM m""")
def agg21(spark, d):
    from chronoloom.operators.sequences import collapse_path

    return collapse_path(V.notes(spark, d).select("track_id", F.expr("start_us div 1000000").alias("a"), F.col("midi").alias("b")), T)


@query("agg22_palette", V.sql(V.NOTES, V.SEGMENTS) + """
, f AS (SELECT track_id, label, min(seg_idx) AS first, count(*) AS n FROM segments GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY first) AS place FROM f) SELECT track_id, label, place, n FROM r WHERE place <= 8""")
def agg22(spark, d):
    f = V.segments(spark, d).groupBy("track_id", "label").agg(F.min("seg_idx").alias("first"), F.count("*").alias("n"))
    return f.withColumn("place", F.row_number().over(W.partitionBy("track_id").orderBy("first")).cast("long")).where("place <= 8").select("track_id", "label", "place", "n")


@query("agg23_folded", V.sql(V.SCORE) + """
SELECT part_index, count(*) FILTER (midi < 40 OR midi > 86) AS folded, count(*) AS n FROM score GROUP BY 1""")
def agg23(spark, d):
    return V.score(spark, d).groupBy("part_index").agg(F.count_if((F.col("midi") < 40) | (F.col("midi") > 86)).alias("folded"), F.count("*").alias("n"))


@query("agg24_nearest_rank", V.sql(V.NOTES) + """
, n AS (SELECT track_id, conf_pct, row_number() OVER (PARTITION BY track_id ORDER BY conf_pct) AS rn, count(*) OVER (PARTITION BY track_id) AS n FROM notes) SELECT track_id, min(conf_pct) AS bar FROM n WHERE rn = least(n, n * 9 // 10 + 1) GROUP BY 1""")
def agg24(spark, d):
    w = W.partitionBy("track_id")
    rows = V.notes(spark, d).select("track_id", "conf_pct", F.row_number().over(w.orderBy("conf_pct")).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.where("rn = least(n, n * 9 div 10 + 1)").groupBy("track_id").agg(F.min("conf_pct").alias("bar"))


@query("agg04_frame_flatness", V.sql(V.CHROMA) + """
SELECT vec_id, round(exp(list_avg(list_transform(chroma, lambda x: ln(x + 1)))) / (list_avg(chroma) + 1), 9) AS flatness, list_sum(chroma)::BIGINT AS total FROM chroma""")
def agg04(spark, d):
    logs = A.total(F.transform("chroma", lambda x: F.log(x + F.lit(1.0))), 0.0)
    total = F.aggregate("chroma", F.lit(0).cast("long"), lambda s, x: s + x)
    return V.chroma(spark, d).select("vec_id", F.round(F.exp(logs / 12) / (total / 12 + 1), 9).alias("flatness"), total.alias("total"))


@query("agg05_envelope", V.sql(V.NOTES) + """
, l AS (SELECT track_id, start_us // 10000 AS hop, sum(strength_pct)::BIGINT AS level FROM notes GROUP BY 1, 2)
SELECT track_id, hop, round(ln(1 + level) + 0.5 * ln(1 + abs(level - coalesce(lag(level) OVER (PARTITION BY track_id ORDER BY hop), 0))), 9) AS env FROM l""")
def agg05(spark, d):
    lev = V.notes(spark, d).groupBy("track_id", F.expr("start_us div 10000").alias("hop")).agg(F.sum("strength_pct").alias("level"))
    jump = F.abs(F.col("level") - F.coalesce(F.lag("level").over(W.partitionBy("track_id").orderBy("hop")), F.lit(0)))
    return lev.select("track_id", "hop", F.round(F.log1p("level") + 0.5 * F.log1p(jump), 9).alias("env"))


#: Names of parts as scores have them; each row of `part` gets two of them.
PART_NAMES = ["Lead Vocals", "Voice", "Melody RH", "Solo Singer", "Piano right hand", "LH", "Left Hand", "Drum Kit", "Percussion", "Bass", "Accompaniment", "Harmony", "Chords", "Flute"]
_NAMES_SQL = ", ".join(f"'{n}'" for n in PART_NAMES)


@query("agg_name_score", f"""
WITH named AS (SELECT p_partkey, lower([{_NAMES_SQL}][p_partkey % {len(PART_NAMES)} + 1] || ' ' || [{_NAMES_SQL}][p_size % {len(PART_NAMES)} + 1]) AS name FROM part),
hints AS (SELECT * FROM (VALUES ('vocal', 8.0), ('vocals', 8.0), ('voice', 7.0), ('melody', 7.0), ('lead', 5.0), ('singer', 5.0), ('solo', 2.0), ('right hand', 1.5), ('rh', 1.0),
  ('drum', -12.0), ('percussion', -12.0), ('bass', -5.0), ('left hand', -4.0), ('lh', -2.0), ('accompan', -4.0), ('harmony', -3.0), ('chord', -3.0)) AS t(hint, weight))
SELECT p_partkey, name, sum(CASE WHEN contains(name, hint) THEN weight ELSE 0 END)::DOUBLE AS score FROM named, hints GROUP BY 1, 2""")
def agg_name(spark, d):
    pick = lambda c: F.element_at(F.array(*map(F.lit, PART_NAMES)), (F.col(c) % len(PART_NAMES) + 1).cast("int"))
    named = V.table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", pick("p_partkey"), pick("p_size"))).alias("name"))
    return named.select("p_partkey", "name", name_score(F.col("name")).alias("score"))
