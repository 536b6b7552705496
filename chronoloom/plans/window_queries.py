"""Queries of the window operators, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.operators import windows as O
from chronoloom.registry import query

T = ["track_id"]


def ended(spark, d):
    return V.notes(spark, d).withColumn("end_us", F.col("start_us") + F.col("dur_us"))


ENDED = "ended AS (SELECT *, start_us + dur_us AS end_us FROM notes)"
ORD = "PARTITION BY track_id ORDER BY start_us, note_id"


@query("win06_gaps", V.sql(V.NOTES, ENDED) + f"""
, inner_gaps AS (SELECT track_id, coalesce(max(end_us) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, start_us AS gap_end FROM ended)
SELECT * FROM (SELECT * FROM inner_gaps UNION ALL SELECT track_id, max(end_us), {V.TRACK_US} FROM ended GROUP BY 1) WHERE gap_end - gap_start >= 2200000""")
def win06(spark, d):
    return O.gaps(ended(spark, d), V.TRACK_US, 2_200_000, T)


@query("win07_islands", V.sql(V.NOTES, ENDED) + f"""
, o AS (SELECT *, max(end_us) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM ended),
i AS (SELECT *, sum(CASE WHEN so_far IS NULL OR start_us - so_far > 24000 THEN 1 ELSE 0 END) OVER ({ORD}) AS island FROM o)
SELECT track_id, island::BIGINT AS island, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM i GROUP BY 1, 2""")
def win07(spark, d):
    return O.islands(ended(spark, d), 24_000, T).groupBy("track_id", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


@query("win08_repeats", V.sql(V.NOTES) + """
, l AS (SELECT *, lag(midi, 1) OVER w AS m1, lag(start_us, 1) OVER w AS s1, lag(midi, 2) OVER w AS m2, lag(start_us, 2) OVER w AS s2
  FROM notes WINDOW w AS (PARTITION BY track_id ORDER BY start_us, conf_pct DESC, midi, note_id))
SELECT track_id, note_id, start_us, midi FROM l WHERE NOT (coalesce(m1 = midi AND abs(start_us - s1) < 180000, false) OR coalesce(m2 = midi AND abs(start_us - s2) < 180000, false))""")
def win08(spark, d):
    order = ["start_us", F.col("conf_pct").desc(), "midi", "note_id"]
    return O.drop_repeats(V.notes(spark, d), 180_000, T, order).select("track_id", "note_id", "start_us", "midi")


@query("win09_trim", V.sql(V.NOTES, ENDED) + f"""
, l AS (SELECT *, lead(start_us) OVER ({ORD}) AS nxt FROM ended)
SELECT track_id, note_id, start_us, greatest(start_us + 60000, CASE WHEN nxt IS NULL THEN end_us ELSE least(end_us, nxt - 12000) END) AS end_us FROM l""")
def win09(spark, d):
    return O.trim_to_next(ended(spark, d), T, 12_000, 60_000).select("track_id", "note_id", "start_us", "end_us")


@query("win09_legato", V.sql(V.NOTES, ENDED) + f"""
, l AS (SELECT *, lead(start_us) OVER ({ORD}) AS nxt, lead(midi) OVER ({ORD}) AS other FROM ended)
SELECT track_id, note_id, CASE WHEN nxt - end_us > 0 AND nxt - end_us <= 120000 AND other <> midi THEN nxt ELSE end_us END AS end_us FROM l""")
def win09b(spark, d):
    return O.extend_legato(ended(spark, d), T, 120_000).select("track_id", "note_id", "end_us")


@query("win12_ioi", V.sql(V.NOTES, ENDED) + f"""
SELECT track_id, note_id, lead(start_us) OVER ({ORD}) - start_us AS ioi, lead(start_us) OVER ({ORD}) - end_us AS rest FROM ended""")
def win12(spark, d):
    return O.onset_intervals(ended(spark, d), T).select("track_id", "note_id", "ioi", "rest")


@query("win02_rise", V.sql(V.NOTES) + f"""
SELECT track_id, note_id, greatest(0, conf_pct - coalesce(lag(conf_pct) OVER ({ORD}), 0)) AS rise FROM notes""")
def win02(spark, d):
    return O.rectified_difference(V.notes(spark, d), "conf_pct", T, "start_us", "note_id").select("track_id", "note_id", "rise")


@query("win21_flux", V.sql(V.CHROMA) + """
, x AS (SELECT vec_id, label, unnest(range(12)) AS pc, chroma FROM chroma),
y AS (SELECT vec_id, label, pc::BIGINT AS pc, chroma[pc + 1] AS v FROM x)
SELECT vec_id, sum(greatest(0, v - coalesce(before, v)))::BIGINT AS flux FROM (SELECT *, lag(v) OVER (PARTITION BY label, pc ORDER BY vec_id) AS before FROM y) GROUP BY 1""")
def win21(spark, d):
    long = V.chroma(spark, d).select("vec_id", "label", F.posexplode("chroma").alias("pc", "v"))
    return O.rectified_difference(long, "v", ["label", "pc"], "vec_id", first_is_self=True).groupBy("vec_id").agg(F.sum("rise").alias("flux"))


@query("win03_centred_mean", V.sql(V.NOTES) + f"""
SELECT track_id, note_id, (10 * conf_pct * count(*) OVER w - 8 * sum(conf_pct) OVER w)::BIGINT AS excess, count(*) OVER w AS width
FROM notes WINDOW w AS ({ORD} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def win03(spark, d):
    rows = O.centred_mean(V.notes(spark, d), "conf_pct", 7, T, "start_us", "note_id")
    return rows.select("track_id", "note_id", (10 * F.col("conf_pct") * F.col("width") - 8 * F.col("total")).alias("excess"), "width")


@query("win04_peaks", V.sql(V.NOTES) + f"""
, l AS (SELECT *, coalesce(lag(conf_pct) OVER ({ORD}), 0) AS prev, coalesce(lead(conf_pct) OVER ({ORD}), 0) AS next, max(conf_pct) OVER (PARTITION BY track_id) AS top FROM notes)
SELECT track_id, note_id, conf_pct FROM l WHERE conf_pct >= prev AND conf_pct > next AND conf_pct * 100 >= 12 * top""")
def win04(spark, d):
    n = V.notes(spark, d)
    top = n.groupBy("track_id").agg(F.max("conf_pct").alias("top"))
    return O.local_peaks(n, "conf_pct", T, "start_us", "note_id").join(top, "track_id").where("conf_pct * 100 >= 12 * top").select("track_id", "note_id", "conf_pct")


@query("win14_onset_peaks", V.sql(V.NOTES) + """
, l AS (SELECT *, coalesce(lag(strength_pct) OVER w, 0) AS prev, coalesce(lead(strength_pct) OVER w, 0) AS next FROM notes WINDOW w AS (PARTITION BY track_id, midi ORDER BY start_us, note_id))
SELECT track_id, note_id, midi FROM l WHERE strength_pct >= prev AND strength_pct > next AND strength_pct >= 50""")
def win14(spark, d):
    return O.local_peaks(V.notes(spark, d), "strength_pct", ["track_id", "midi"], "start_us", "note_id").where("strength_pct >= 50").select("track_id", "note_id", "midi")


@query("win05_smooth", V.sql(V.NOTES) + f"""
SELECT track_id, note_id, (coalesce(lag(conf_pct, 2) OVER w, 0) + 2 * coalesce(lag(conf_pct) OVER w, 0) + 3 * conf_pct + 2 * coalesce(lead(conf_pct) OVER w, 0) + coalesce(lead(conf_pct, 2) OVER w, 0))::BIGINT AS smooth,
  (CASE WHEN lag(note_id, 2) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(note_id) OVER w IS NULL THEN 0 ELSE 2 END + 3 + CASE WHEN lead(note_id) OVER w IS NULL THEN 0 ELSE 2 END + CASE WHEN lead(note_id, 2) OVER w IS NULL THEN 0 ELSE 1 END)::BIGINT AS weight
FROM notes WINDOW w AS ({ORD})""")
def win05(spark, d):
    return O.weighted_neighbours(V.notes(spark, d), "conf_pct", (1, 2, 3, 2, 1), T, "start_us", "note_id").select("track_id", "note_id", "smooth", "weight")


@query("win10_accents", V.sql(V.NOTES) + f"""
, n AS (SELECT *, row_number() OVER ({ORD}) - 1 AS nth FROM notes)
SELECT track_id, note_id, nth % 4 = 0 AS accent, nth % 2 AS voicing FROM n""")
def win10(spark, d):
    nth = F.row_number().over(O.ordered(T, "start_us", "note_id")) - 1
    return V.notes(spark, d).select("track_id", "note_id", (nth % 4 == 0).alias("accent"), (nth % 2).cast("long").alias("voicing"))


@query("win11_running_max", V.sql(V.NOTES, ENDED) + f"""
SELECT track_id, note_id, max(end_us) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM ended""")
def win11(spark, d):
    return O.running_max(ended(spark, d), "end_us", T, "start_us", "note_id").select("track_id", "note_id", "top")


@query("win13_valley", V.sql(V.NOTES) + f"""
SELECT track_id, note_id, coalesce(min(conf_pct) OVER ({ORD} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) < 31, false) AS valley FROM notes""")
def win13(spark, d):
    return O.recent_valley(V.notes(spark, d), "conf_pct", 3, 31, T, "start_us", "note_id").select("track_id", "note_id", "valley")


@query("win15_runs", """
WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c)
SELECT conv_id, run, any_value(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM r GROUP BY 1, 2""")
def win15(spark, d):
    runs = O.run_ids(V.table(spark, d, "conversations"), "role", ["conv_id"], "turn")
    return runs.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("win16_streaks", V.sql(V.NOTES) + f"""
, h AS (SELECT *, conf_pct >= 30 AS hit, sum(CASE WHEN conf_pct >= 30 THEN 0 ELSE 1 END) OVER ({ORD}) AS broken FROM notes),
c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY track_id, broken ORDER BY start_us, note_id)::BIGINT AS combo FROM h)
SELECT track_id, note_id, combo, max(combo) OVER ({ORD}) AS best FROM c""")
def win16(spark, d):
    rows = V.notes(spark, d).withColumn("hit", F.col("conf_pct") >= 30)
    return O.streaks(rows, "hit", T, "start_us", "note_id").select("track_id", "note_id", "combo", "best")


@query("win18_prefix_onsets", V.sql(V.NOTES) + f"""
, p AS (SELECT *, coalesce(sum(dur_us) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS onset FROM notes)
SELECT track_id, note_id, onset FROM p WHERE conf_pct >= 20 AND dur_us >= 45000""")
def win18(spark, d):
    return O.prefix_onsets(V.notes(spark, d), "dur_us", T, "start_us", "note_id").where("conf_pct >= 20 and dur_us >= 45000").select("track_id", "note_id", "onset")


@query("win19_next_five", V.sql(V.NOTES) + f"""
, n AS (SELECT *, row_number() OVER ({ORD}) AS nth, count(*) FILTER (start_us <= 36000000) OVER (PARTITION BY track_id) AS upto FROM notes)
SELECT track_id, note_id, nth - greatest(upto, 1) AS ahead FROM n WHERE nth BETWEEN greatest(upto, 1) AND greatest(upto, 1) + 4""")
def win19(spark, d):
    from pyspark.sql import Window as W

    nth = F.row_number().over(O.ordered(T, "start_us", "note_id"))
    upto = F.greatest(F.lit(1), F.count_if(F.col("start_us") <= 36_000_000).over(W.partitionBy("track_id")))
    rows = V.notes(spark, d).withColumn("nth", nth).withColumn("upto", upto)
    return rows.where("nth between upto and upto + 4").select("track_id", "note_id", (F.col("nth") - F.col("upto")).alias("ahead"))


@query("win20_progress", """
SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS progress FROM conversations""")
def win20(spark, d):
    rows = V.table(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return O.running_max(rows, "n", ["conv_id"], "turn").select("conv_id", "turn", F.col("top").alias("progress"))


@query("win22_chunks", V.sql(V.NOTES) + """
SELECT track_id, note_id, greatest(0, least(floor((start_us - 2000000) / 16000000), 4))::BIGINT AS chunk FROM notes""")
def win22(spark, d):
    return O.own_chunks(V.notes(spark, d), 20_000_000, 4_000_000, V.TRACK_US).select("track_id", "note_id", "chunk")


@query("win01_frames", """
SELECT doc_id, unnest(range(0, greatest(0, ceil((n_chars - 256) / 64.0))::BIGINT + 1)) * 64 AS frame_start FROM documents""")
def win01(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.explode(O.frames(F.col("n_chars"), 256, 64)).alias("frame_start"))
