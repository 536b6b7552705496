"""Queries of validation, projection and set operators, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.functions import arrays as A
from chronoloom.functions import music as M
from chronoloom.functions import text as X
from chronoloom.operators import projections as P
from chronoloom.operators import windows as O
from chronoloom.plans.window_queries import ENDED, ended
from chronoloom.registry import query

T = ["track_id"]


@query("prj01_normalize", V.sql(V.NOTES) + """
, k AS (SELECT track_id, note_id, start_us / 1000000.0::DOUBLE AS start, greatest(0.045::DOUBLE, least(dur_us / 1000000.0::DOUBLE, least(6.0::DOUBLE, 60.0 - start_us / 1000000.0::DOUBLE))) AS duration, floor(midi + 0.5)::BIGINT AS midi, least(1.0, conf_pct / 90.0::DOUBLE) AS confidence FROM notes WHERE start_us < 60000000 AND midi BETWEEN 24 AND 90),
l AS (SELECT *, lag(midi, 1) OVER w AS m1, lag(start, 1) OVER w AS s1, lag(midi, 2) OVER w AS m2, lag(start, 2) OVER w AS s2 FROM k WINDOW w AS (PARTITION BY track_id ORDER BY start, confidence DESC, midi, note_id))
SELECT track_id, note_id, round(start, 6) AS start, round(duration, 6) AS duration, midi, round(confidence, 6) AS confidence FROM l WHERE NOT (coalesce(m1 = midi AND abs(start - s1) < 0.018, false) OR coalesce(m2 = midi AND abs(start - s2) < 0.018, false))""")
def prj01(spark, d):
    n = V.notes(spark, d).where("midi <= 90")
    rows = n.select("track_id", "note_id", (F.col("start_us") / 1e6).alias("start"), (F.col("dur_us") / 1e6).alias("duration"), F.col("midi").cast("double").alias("midi"), (F.col("conf_pct") / 90.0).alias("confidence"), F.lit(0.5).alias("strength"))
    out = P.normalise_notes(rows, 60.0, T, "note_id")
    return out.select("track_id", "note_id", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"), "midi", F.round("confidence", 6).alias("confidence"))


@query("prj04_render_filter", V.sql(V.NOTES, ENDED) + """
SELECT track_id, note_id, start_us, least(dur_us, 60000000 - start_us) AS dur_us, row_number() OVER (PARTITION BY track_id ORDER BY start_us, strength_pct DESC, note_id) AS place FROM ended WHERE start_us < 60000000 AND conf_pct > 0""")
def prj04(spark, d):
    w = W.partitionBy("track_id").orderBy("start_us", F.col("strength_pct").desc(), "note_id")
    kept = V.notes(spark, d).where("start_us < 60000000 and conf_pct > 0")
    return kept.select("track_id", "note_id", "start_us", F.least("dur_us", 60_000_000 - F.col("start_us")).alias("dur_us"), F.row_number().over(w).cast("long").alias("place"))


@query("prj05_violations", V.sql(V.SCORE) + """
SELECT count(*) FILTER (start < 0) AS early, count(*) FILTER (dur <= 0) AS empty, count(*) FILTER (midi < 0 OR midi > 127) AS pitch, count(*) AS n FROM score""")
def prj05(spark, d):
    return V.score(spark, d).agg(F.count_if(F.col("start") < 0).alias("early"), F.count_if(F.col("dur") <= 0).alias("empty"), F.count_if(~F.col("midi").between(0, 127)).alias("pitch"), F.count("*").alias("n"))


@query("prj06_score_projection", V.sql(V.SCORE) + """
SELECT orderkey, linenumber, greatest(0, start * 11 // 10 - 30) AS start, greatest(1, dur * 11 // 10) AS dur, midi + 12 * (ceil(greatest(0, 40 - midi) / 12.0)::BIGINT - ceil(greatest(0, midi - 86) / 12.0)::BIGINT) AS midi, round(greatest(0.25, least(1.0, velocity / 127.0)), 6) AS strength FROM score WHERE start * 11 // 10 - 30 + greatest(1, dur * 11 // 10) > 0""")
def prj06(spark, d):
    start, dur = F.expr("start * 11 div 10 - 30"), F.greatest(F.lit(1).cast("long"), F.expr("dur * 11 div 10"))
    return V.score(spark, d).where(start + dur > 0).select("orderkey", "linenumber", F.greatest(F.lit(0).cast("long"), start).alias("start"), dur.alias("dur"), M.fold_octave(F.col("midi"), 40, 86).alias("midi"), F.round(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("velocity") / 127.0)), 6).alias("strength"))


@query("prj07_beat_frames", V.sql(V.NOTES) + """
SELECT DISTINCT track_id, ceil(start_us * 22050 / 1000000.0)::BIGINT AS frame FROM notes WHERE start_us >= 0 AND start_us < 60000000""")
def prj07(spark, d):
    return V.notes(spark, d).where("start_us >= 0 and start_us < 60000000").select("track_id", F.ceil(F.col("start_us") * 22_050 / 1_000_000.0).alias("frame")).distinct()


@query("prj08_segment_clip", V.sql(V.NOTES, V.SEGMENTS) + """
SELECT track_id, seg_idx, greatest(0, start_us) AS start_us, least(50000000, end_us) AS end_us FROM segments WHERE end_us > start_us AND start_us < 50000000""")
def prj08(spark, d):
    s = V.segments(spark, d).where("end_us > start_us and start_us < 50000000")
    return s.select("track_id", "seg_idx", F.greatest(F.lit(0), "start_us").alias("start_us"), F.least(F.lit(50_000_000), "end_us").alias("end_us"))


@query("prj09_lead_filter", V.sql(V.NOTES) + "SELECT track_id, note_id FROM notes WHERE dur_us >= 90000 AND strength_pct >= 35 AND midi BETWEEN 65 AND 96")
def prj09(spark, d):
    return V.notes(spark, d).where("dur_us >= 90000 and strength_pct >= 35 and midi between 65 and 96").select("track_id", "note_id")


@query("prj10_evidence_filter", V.sql(V.NOTES, V.EVIDENCE) + "SELECT ev_id FROM evidence WHERE quality_pct >= 75 AND end_us - start_us >= 120000 OR start_us < 8000000 AND quality_pct >= 45 AND end_us - start_us >= 90000")
def prj10(spark, d):
    return V.evidence(spark, d).where("quality_pct >= 75 and end_us - start_us >= 120000 or start_us < 8000000 and quality_pct >= 45 and end_us - start_us >= 90000").select("ev_id")


@query("prj11_clear_notes", V.sql(V.NOTES) + "SELECT track_id, note_id, conf_pct >= 72 OR dur_us >= 200000 AND conf_pct >= 60 AND strength_pct >= 42 AS clear FROM notes WHERE midi BETWEEN 48 AND 84")
def prj11(spark, d):
    clear = (F.col("conf_pct") >= 72) | ((F.col("dur_us") >= 200_000) & (F.col("conf_pct") >= 60) & (F.col("strength_pct") >= 42))
    return V.notes(spark, d).where("midi between 48 and 84").select("track_id", "note_id", clear.alias("clear"))


@query("prj12_skyline_filter", V.sql(V.SCORE) + "SELECT orderkey, linenumber FROM score WHERE midi BETWEEN 48 AND 96 AND dur >= 2 AND part_index <> 7")
def prj12(spark, d):
    return V.score(spark, d).where("midi between 48 and 96 and dur >= 2 and part_index <> 7").select("orderkey", "linenumber")


@query("prj13_part_selector", """
SELECT p_partkey FROM part WHERE p_partkey = 7 OR lower(p_brand) = 'brand#12' OR contains(lower(p_name), 'a')""")
def prj13(spark, d):
    from chronoloom.plans.cli import selects

    p = V.table(spark, d, "part")
    return p.where(selects(["7", "brand#12", "a"], F.col("p_partkey"), F.col("p_brand"), F.col("p_name"))).select("p_partkey")


@query("prj14_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'brand#2')")
def prj14(spark, d):
    return V.table(spark, d, "part").where(X.matches_search("Brand#2", "p_name", "p_brand")).select("p_partkey")


@query("prj15_grade", V.sql(V.NOTES) + """
SELECT track_id, note_id, CASE WHEN abs(note_id % 401 - 200) <= 80 THEN 'perfect' WHEN abs(note_id % 401 - 200) <= 180 THEN 'good' ELSE 'miss' END AS grade FROM notes""")
def prj15(spark, d):
    return V.notes(spark, d).select("track_id", "note_id", M.grade(F.col("note_id") % 401 - 200, 80, 180).alias("grade"))


@query("prj16_high_match", V.sql(V.NOTES) + """
SELECT track_id, count(*) >= 6 AND floor(100 * count(*) FILTER (conf_pct >= 20) / count(*) + 0.5) >= 85 AS high FROM notes GROUP BY 1""")
def prj16(spark, d):
    acc = F.floor(100 * F.count_if(F.col("conf_pct") >= 20) / F.count("*") + 0.5)
    return V.notes(spark, d).groupBy("track_id").agg(((F.count("*") >= 6) & (acc >= 85)).alias("high"))


@query("prj17_valid_boundaries", V.sql(V.NOTES, V.SEGMENTS) + """
, l AS (SELECT *, end_us - start_us AS len, lag(end_us - start_us) OVER w AS a, lead(end_us - start_us) OVER w AS b FROM segments WINDOW w AS (PARTITION BY track_id ORDER BY seg_idx))
SELECT track_id, seg_idx, len >= 100000 AND coalesce(a >= 120000, true) AND coalesce(b >= 120000, true) AS valid FROM l""")
def prj17(spark, d):
    return P.valid_boundaries(V.segments(spark, d), T, 100_000, 120_000).select("track_id", "seg_idx", "valid")


@query("prj18_move_boundary", V.sql(V.NOTES, V.SEGMENTS) + """
SELECT track_id, seg_idx, CASE seg_idx WHEN 2 THEN 1000000 WHEN 3 THEN 2000000 ELSE start_us END AS start_us, CASE seg_idx WHEN 2 THEN 2000000 WHEN 1 THEN 1000000 ELSE end_us END AS end_us, abs(seg_idx - 2) <= 1 AS edited FROM segments""")
def prj18(spark, d):
    return P.move_boundary(V.segments(spark, d), T, 2, 1_000_000, 2_000_000).select("track_id", "seg_idx", "start_us", "end_us", "edited")


def beats(spark, d):
    return V.notes(spark, d).groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_us", "note_id"))), lambda x: x.start_us).alias("beats"))


BEATS = "beats AS (SELECT track_id, list(start_us ORDER BY start_us, note_id) AS beats FROM notes GROUP BY 1)"


@query("prj19_tempo_correction", V.sql(V.NOTES, BEATS) + """
SELECT track_id, unnest(range(0, len(beats), 2)) AS i, unnest([beats[k + 1] FOR k IN range(0, len(beats), 2)]) AS beat FROM beats""")
def prj19(spark, d):
    return beats(spark, d).select("track_id", F.posexplode(A.every_nth(F.col("beats"), 2)).alias("i", "beat")).select("track_id", (F.col("i") * 2).cast("long").alias("i"), "beat")


@query("prj20_shift_beats", V.sql(V.NOTES) + "SELECT track_id, start_us + 250000 AS beat FROM notes WHERE start_us + 250000 BETWEEN 0 AND 60000000")
def prj20(spark, d):
    return beats(spark, d).select("track_id", F.explode(A.shifted(F.col("beats"), 250_000, 0, 60_000_000)).alias("beat"))


@query("prj21_densify_beats", V.sql(V.NOTES) + """
, l AS (SELECT track_id, start_us, lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS nxt FROM notes)
SELECT track_id, (2 * start_us)::BIGINT AS half_us FROM l UNION ALL SELECT track_id, start_us + nxt FROM l WHERE nxt IS NOT NULL""")
def prj21(spark, d):
    return beats(spark, d).select("track_id", F.explode(A.with_midpoints(F.transform("beats", lambda x: x.cast("double")))).alias("b")).select("track_id", (F.col("b") * 2).cast("long").alias("half_us"))


@query("prj22_decimate", V.sql(V.NOTES, BEATS) + """
SELECT track_id, unnest([beats[k + 1] FOR k IN range(0, len(beats), greatest(1, ceil(len(beats) / 240.0)::BIGINT))]) AS beat FROM beats""")
def prj22(spark, d):
    step = F.greatest(F.lit(1), F.ceil(F.size("beats") / 240).cast("int"))
    return beats(spark, d).withColumn("k", step).select("track_id", F.explode(F.filter("beats", lambda x, i: i % F.col("k") == 0)).alias("beat"))


@query("prj23_pair_means", V.sql(V.CHROMA) + """
SELECT vec_id, p::BIGINT AS p, (chroma[2 * p + 1] + chroma[2 * p + 2]) AS twice FROM (SELECT vec_id, chroma, unnest(range(6)) AS p FROM chroma)""")
def prj23(spark, d):
    return V.chroma(spark, d).select("vec_id", F.posexplode(A.pair_means(F.col("chroma"))).alias("p", "m")).select("vec_id", F.col("p").cast("long").alias("p"), (F.col("m") * 2).cast("long").alias("twice"))


@query("prj24_padded_frames", V.sql(V.CHROMA) + """
, p AS (SELECT vec_id, list_concat(list_concat([0, 0, 0], chroma), [0, 0, 0, 0, 0, 0, 0, 0]) AS x FROM chroma)
SELECT vec_id, k::BIGINT AS frame, list_sum(x[k * 4 + 1 : k * 4 + 6])::BIGINT AS total FROM (SELECT *, unnest(range(ceil((15 - 6) / 4.0)::INT + 1)) AS k FROM p)""")
def prj24(spark, d):
    frames = A.padded_frames(F.transform("chroma", lambda x: x.cast("double")), 3, 6, 4)
    return V.chroma(spark, d).select("vec_id", F.posexplode(frames).alias("frame", "x")).select("vec_id", F.col("frame").cast("long").alias("frame"), A.total(F.col("x"), 0.0).cast("long").alias("total"))


@query("prj25_stale", V.sql(V.NOTES) + """
, s AS (SELECT track_id, CASE WHEN track_id % 4 = 3 THEN 'shop' END AS source, CASE WHEN track_id % 7 <> 0 THEN (track_id % 5)::DOUBLE END AS version, count(*) FILTER (conf_pct >= 85) AS usable FROM notes GROUP BY 1)
SELECT track_id, source IS NULL AND coalesce(version, 0) <= 3 AND (version IS DISTINCT FROM 3 OR usable < 8) AS stale FROM s""")
def prj25(spark, d):
    """Versions below, at and above the current one, and none; rows with a source."""
    n = V.notes(spark, d).groupBy("track_id").agg(F.count_if(F.col("conf_pct") >= 85).alias("usable"))
    key = F.col("track_id")
    return n.select("track_id", P.stale(F.when(key % 4 == 3, F.lit("shop")), F.when(key % 7 != 0, (key % 5).cast("double")), F.col("usable"), 3.0).alias("stale"))


@query("prj26_three_way_merge", """
WITH m AS (SELECT c_custkey, c_acctbal AS b1, c_nationkey AS b2, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c1, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c2, c_acctbal + 5 AS a1, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 9 END AS a2 FROM customer)
SELECT c_custkey, CASE WHEN c1 IS DISTINCT FROM b1 OR a1 IS NULL THEN c1 ELSE a1 END AS v, CASE WHEN c2 IS DISTINCT FROM b2 OR a2 IS NULL THEN c2 ELSE a2 END AS k FROM m""")
def prj26(spark, d):
    c = V.table(spark, d, "customer")
    key = F.col("c_custkey")
    base = c.select("c_custkey", F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("k"))
    current = c.select("c_custkey", F.when(key % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"), F.when(key % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("k"))
    auto = c.select("c_custkey", (F.col("c_acctbal") + 5).alias("v"), F.when(key % 7 != 0, F.col("c_nationkey") + 9).alias("k"))
    return P.merge_versions(base, current, auto, "c_custkey", ["v", "k"])


@query("prj29_gate", V.sql(V.NOTES) + """
SELECT note_id, CASE WHEN note_id % 3 = 0 THEN true ELSE midi % 12 IN (0, 4, 7) END AS passes, CASE WHEN note_id % 3 = 0 THEN 'free' WHEN conf_pct >= 50 THEN 'cue' ELSE 'string' END AS sound FROM notes""")
def prj29(spark, d):
    free = F.col("note_id") % 3 == 0
    return V.notes(spark, d).select("note_id", F.when(free, True).otherwise(M.pitch_class(F.col("midi")).isin(0, 4, 7)).alias("passes"), F.when(free, "free").when(F.col("conf_pct") >= 50, "cue").otherwise("string").alias("sound"))


@query("prj30_cue_ids", V.sql(V.NOTES) + """
SELECT track_id, note_id, concat('note-', row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) - 1, '-', (start_us + 500) // 1000, '-', midi) AS cue_id FROM notes""")
def prj30(spark, d):
    nth = F.row_number().over(O.ordered(T, "start_us", "note_id")) - 1
    return V.notes(spark, d).select("track_id", "note_id", X.cue_id(nth, F.col("start_us"), F.col("midi")).alias("cue_id"))


@query("prj31_low_confidence", V.sql(V.NOTES) + "SELECT note_id, conf_pct < 50 AND note_id % 9 <> 0 AS low FROM notes")
def prj31(spark, d):
    return V.notes(spark, d).select("note_id", ((F.col("conf_pct") < 50) & (F.col("note_id") % 9 != 0)).alias("low"))


@query("prj32_cover_precedence", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'data:' || page_id WHEN page_id % 5 <> 0 THEN url ELSE 'https://x/' || page_id END AS cover FROM pages""")
def prj32(spark, d):
    p = F.col("page_id").cast("string")
    new = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:"), p)).otherwise(F.concat(F.lit("https://x/"), p))
    old = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return V.table(spark, d, "pages").select("page_id", F.when(new.startswith("data:"), new).otherwise(F.coalesce(old, new)).alias("cover"))


@query("prj33_artwork_pick", """
SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey)) AS pick FROM orders WHERE o_totalprice <= 250000 GROUP BY 1""")
def prj33(spark, d):
    front = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return V.table(spark, d, "orders").where("o_totalprice <= 250000").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(front, "o_orderkey")).alias("pick"))


@query("srt01_multi_key", V.sql(V.NOTES) + """
SELECT track_id, note_id, row_number() OVER (PARTITION BY track_id ORDER BY start_us, conf_pct DESC, midi, note_id) AS place FROM notes""")
def srt01(spark, d):
    w = W.partitionBy("track_id").orderBy("start_us", F.col("conf_pct").desc(), "midi", "note_id")
    return V.notes(spark, d).select("track_id", "note_id", F.row_number().over(w).cast("long").alias("place"))


@query("srt03_top_stream", V.sql(V.SCORE) + """
, s AS (SELECT part_index, voice, staff, count(*) AS n FROM score GROUP BY ALL) SELECT part_index, voice, staff, n FROM (SELECT *, row_number() OVER (PARTITION BY part_index ORDER BY n DESC, voice, staff) AS rn FROM s) WHERE rn = 1""")
def srt03(spark, d):
    s = V.score(spark, d).groupBy("part_index", "voice", "staff").agg(F.count("*").alias("n"))
    return s.groupBy("part_index").agg(F.max(F.struct("n", (-F.col("voice")).alias("v"), (-F.col("staff")).alias("s"))).alias("b")).select("part_index", (-F.col("b.v")).alias("voice"), (-F.col("b.s")).alias("staff"), F.col("b.n").alias("n"))


@query("srt04_recent_hits", V.sql(V.NOTES) + """
SELECT track_id, note_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us DESC, note_id DESC) AS rn FROM notes) WHERE rn <= 64""")
def srt04(spark, d):
    w = W.partitionBy("track_id").orderBy(F.col("start_us").desc(), F.col("note_id").desc())
    return V.notes(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 64").select("track_id", "note_id")


@query("set01_union_trim", V.sql(V.NOTES, ENDED, V.EVIDENCE) + """
SELECT track_id, start_us, end_us, midi FROM ended WHERE midi < 70 UNION ALL SELECT track_id, start_us, end_us, midi FROM evidence WHERE midi >= 70""")
def set01(spark, d):
    cols = ["track_id", "start_us", "end_us", "midi"]
    return ended(spark, d).where("midi < 70").select(cols).unionByName(V.evidence(spark, d).where("midi >= 70").select(cols))


@query("set02_distinct", V.sql(V.NOTES) + "SELECT DISTINCT track_id, midi % 12 AS pc FROM notes")
def set02(spark, d):
    return V.notes(spark, d).select("track_id", (F.col("midi") % 12).alias("pc")).distinct()


@query("set03_except", V.sql(V.NOTES, V.EVIDENCE) + "SELECT note_id FROM notes WHERE note_id NOT IN (SELECT ev_id FROM evidence WHERE quality_pct >= 40)")
def set03(spark, d):
    return V.notes(spark, d).join(V.evidence(spark, d).where("quality_pct >= 40").select(F.col("ev_id").alias("note_id")), "note_id", "left_anti").select("note_id")


@query("set05_intersect", V.sql(V.NOTES, V.EVIDENCE) + "SELECT track_id, midi FROM notes INTERSECT SELECT track_id, midi FROM evidence")
def set05(spark, d):
    return V.notes(spark, d).select("track_id", "midi").intersect(V.evidence(spark, d).select("track_id", "midi"))


@query("set04_replace_row", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey <> 5 UNION ALL SELECT 5, 'replaced', 1.5""")
def set04(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = spark.range(1).select(F.lit(5).cast("long").alias("c_custkey"), F.lit("replaced").alias("c_name"), F.lit(1.5).alias("c_acctbal"))
    return c.join(new.select("c_custkey"), "c_custkey", "left_anti").unionByName(new)


@query("prj02_strict_import", V.sql(V.NOTES) + """
, n AS (SELECT track_id, note_id, midi, row_number() OVER (PARTITION BY track_id, midi ORDER BY start_us, note_id) AS rn FROM notes),
sized AS (SELECT track_id FROM notes GROUP BY 1 HAVING count(*) BETWEEN 8 AND 20000)
SELECT n.track_id, note_id, round((rn * 50 + midi) / 1000.0::DOUBLE, 6) AS start, midi FROM n JOIN sized USING (track_id)""")
def prj02(spark, d):
    """All notes of the tracks that the import accepts, at times that repeat no pitch: no row may be lost."""
    w = W.partitionBy("track_id", "midi").orderBy("start_us", "note_id")
    n = V.notes(spark, d).withColumn("at", (F.row_number().over(w) * 50 + F.col("midi")) / 1000)
    n = n.withColumn("size", F.count("*").over(W.partitionBy("track_id"))).where("size between 8 and 20000")
    rows = n.select("track_id", "note_id", F.col("at").alias("start"), (F.col("dur_us") / 1e6).alias("duration"), F.col("midi").cast("double").alias("midi"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("strength"))
    return P.strict_notes(rows, 2000.0, T, "note_id").select("track_id", "note_id", F.round("start", 6).alias("start"), "midi")


@query("prj27_catalog_merge", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN c_acctbal + (c_custkey % 3 = 0)::INT ELSE c_acctbal + 5 END AS bpm,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN c_acctbal ELSE c_acctbal + 5 END AS original_bpm,
  CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE c_name END AS melody,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 2 = 1 THEN 'dsp / catalog' ELSE 'dsp' END ELSE 'dsp / catalog' END AS algorithm FROM customer""")
def prj27(spark, d):
    """Tempos edited by hand (every third), beats edited (every fifth), rows that the catalog lacks (every fourth), entries without a tempo (every seventh)."""
    c, key = V.table(spark, d, "customer"), F.col("c_custkey")
    beats = F.array(F.lit(0.5), F.lit(1.0))
    songs = c.select(key.alias("id"), (F.col("c_acctbal") + F.when(key % 3 == 0, 1).otherwise(0)).alias("bpm"), F.when(key % 5 == 0, F.array(F.lit(0.6))).otherwise(beats).alias("beats"), F.col("c_acctbal").alias("original_bpm"), beats.alias("original_beats"), F.lit("old").alias("melody"), F.when(key % 2 == 1, "dsp / catalog").otherwise("dsp").alias("algorithm"))
    catalog = c.where(key % 4 != 0).select(key.alias("id"), F.col("c_name").alias("melody"), F.when(key % 7 != 0, F.col("c_acctbal") + 5).alias("bpm"))
    return P.merge_catalog(songs, catalog, "id", "catalog").select("id", "bpm", "original_bpm", "melody", "algorithm")


@query("prj28_trusted", """
SELECT page_id FROM pages WHERE page_id % 4 = 0 OR (page_id % 4 = 1 AND url IS NOT NULL)""")
def prj28(spark, d):
    """Local rows, and catalog rows whose claimed digest is their content's: some claims are in capitals, some are another row's, some are no digests."""
    key, real = F.col("page_id"), F.sha2(F.col("url").cast("binary"), 256)
    claimed = F.when(key % 4 == 1, F.concat(F.lit(" "), F.upper(real))).when(key % 4 == 2, F.sha2(F.concat("url", F.lit("x")).cast("binary"), 256)).otherwise(F.substring(real, 1, 40))
    return V.table(spark, d, "pages").where(P.trusted(F.when(key % 4 != 0, F.lit("shop")), claimed, F.col("url"))).select("page_id")


@query("srt02_best_lane", V.sql(V.NOTES) + """
, o AS (SELECT unnest(range(6)) AS s, unnest([40, 45, 50, 55, 59, 64]) AS m)
SELECT note_id, arg_min(s, ((midi - m) * 13 + greatest(0, midi - m - 12) * 20, -s))::BIGINT AS string_idx FROM notes, o WHERE midi - m BETWEEN 0 AND 22 GROUP BY 1""")
def srt02(spark, d):
    spots = F.array(*(F.struct(((F.col("midi") - m) * 13 + F.greatest(F.lit(0), F.col("midi") - m - 12) * 20).alias("cost"), F.lit(-s).alias("up"), (F.col("midi") - m).alias("fret")) for s, m in enumerate(M.OPEN_STRINGS)))
    best = F.array_min(F.filter(spots, lambda p: (p.fret >= 0) & (p.fret <= 22)))
    return V.notes(spark, d).select("note_id", (-best.up).cast("long").alias("string_idx")).where("string_idx is not null")


@query("inf05_fallback", V.sql(V.NOTES, V.EVIDENCE) + """
, good AS (SELECT track_id, count(*) FILTER (conf_pct >= 60) >= 8 AS enough FROM notes GROUP BY 1)
SELECT 'primary' AS model, n.track_id, note_id AS id, midi FROM notes n JOIN good g ON n.track_id = g.track_id AND enough WHERE conf_pct >= 60
UNION ALL SELECT 'secondary', e.track_id, ev_id, midi FROM evidence e JOIN good g ON e.track_id = g.track_id AND NOT enough""")
def inf05(spark, d):
    """The second model's notes are used where the first has under eight."""
    n, e = V.notes(spark, d), V.evidence(spark, d)
    good = n.groupBy("track_id").agg((F.count_if(F.col("conf_pct") >= 60) >= 8).alias("enough"))
    first = n.where("conf_pct >= 60").join(good.where("enough"), "track_id").select(F.lit("primary").alias("model"), "track_id", F.col("note_id").alias("id"), "midi")
    second = e.join(good.where("not enough"), "track_id").select(F.lit("secondary").alias("model"), "track_id", F.col("ev_id").alias("id"), "midi")
    return first.unionByName(second)
