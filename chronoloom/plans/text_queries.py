"""Queries of text, number and JSON functions, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.functions import arrays as A
from chronoloom.functions import music as M
from chronoloom.functions import text as X
from chronoloom.registry import query
from chronoloom.sources import readers as R


@query("str01_clean_text", r"""SELECT doc_id, nullif(substr(trim(regexp_replace(text, '[\x00-\x20\x7f]+', ' ', 'g')), 1, 300), '') AS clean FROM documents""")
def str01(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("str02_normalise")
def str02(spark, d):
    """No engine's SQL decomposes characters the same way: tests compare with unicodedata."""
    return V.table(spark, d, "documents").select("doc_id", X.normalised(F.col("text")).alias("folded"))


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' (feat. Someone)' WHEN 1 THEN p_name || ' ft. Other' WHEN 2 THEN p_name ELSE p_name || ' [Featuring X]' END"


@query("str03_title_key", rf"""SELECT p_partkey, trim(regexp_replace({_TITLE}, '(?i)\s*[\(\[]?\s*\b(feat|ft|featuring)\b\.?\s.*$', '')) AS title FROM part""")
def str03(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.strip_featured(F.expr(_TITLE)).alias("title"))


_FILE = "concat('/music/', lpad(cast(p_partkey % 99 as string), 2, '0'), ' - ', p_brand, ' - ', p_name, '.mp3')"


@query("str04_file_name", r"""
WITH f AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_extract('/music/' || lpad((p_partkey % 99)::VARCHAR, 2, '0') || ' - ' || p_brand || ' - ' || p_name || '.mp3', '([^/\\]*)$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '^\d{1,3}[\s._-]+', '') AS b FROM part)
SELECT p_partkey, trim(regexp_extract(b, '^(.*?)\s[-–—]\s', 1)) AS artist, trim(regexp_extract(b, '^.*?\s[-–—]\s(.*)$', 1)) AS title FROM f""")
def str04(spark, d):
    m = X.file_metadata(F.expr(_FILE))
    return V.table(spark, d, "part").select("p_partkey", m.getField("artist").alias("artist"), m.getField("title").alias("title"))


@query("str05_cover_url", r"""
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN regexp_replace('https://img' || (page_id % 7) || '.example.com/a/' || page_id || '/100x100bb.jpg', '/\d+x\d+([a-z-]*)\.(jpg|png|webp)$', '/1000x1000\1.\2') END AS big FROM pages""")
def str05(spark, d):
    p = F.col("page_id").cast("string")
    url = F.concat(F.when(F.col("page_id") % 3 != 0, "https://img").otherwise("http://img"), (F.col("page_id") % 7).cast("string"), F.lit(".example.com/a/"), p, F.lit("/100x100bb.jpg"))
    return V.table(spark, d, "pages").select("page_id", X.high_resolution(url, ("example.com",)).alias("big"))


_CHORD = "concat(substr('CDEFGAB', cast(p_partkey % 7 + 1 as int), 1), CASE p_partkey % 3 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN '7' WHEN 2 THEN '' WHEN 3 THEN 'm7/G' ELSE 'maj7' END)"
_SQL_ROOT = "(CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 9 ELSE 11 END + CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + 12) % 12"


@query("str06_chord_strict", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN {_SQL_ROOT} END::BIGINT AS root, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 2 THEN 4 END::BIGINT AS third FROM part""")
def str06(spark, d):
    c = X.chord_strict(F.expr(_CHORD))
    return V.table(spark, d, "part").select("p_partkey", c.getField("root").cast("long").alias("root"), c.getField("third").cast("long").alias("third"))


@query("str07_chord_lenient", """SELECT p_partkey, substr('CDEFGAB', (p_partkey % 7 + 1)::INT, 1) || CASE p_partkey % 3 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END || CASE WHEN p_partkey % 5 IN (0, 3) THEN 'm' ELSE '' END AS triad FROM part""")
def str07(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.chord_lenient(F.expr(_CHORD)).alias("triad"))


@query("str08_clock", """SELECT event_id, CASE WHEN value >= 0 THEN (floor(value)::BIGINT // 60) || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') ELSE '0:00' END AS shown FROM events""")
def str08(spark, d):
    return V.table(spark, d, "events").select("event_id", X.clock(F.col("value")).alias("shown"))


@query("str10_digest_text", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(coalesce(text, '')) END AS digest FROM documents""")
def str10(spark, d):
    raw = F.upper(F.concat(F.lit(" "), F.sha2(F.coalesce("text", F.lit("")), 256), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("x")))
    return V.table(spark, d, "documents").select("doc_id", X.sha256_text(raw).alias("digest"))


@query("str11_data_url", """SELECT p_partkey, 'data:image/jpeg;base64,' || to_base64(p_name::BLOB) AS url FROM part""")
def str11(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.data_url(F.col("p_name").cast("binary"), F.lit("image/jpg")).alias("url"))


@query("str13_suffix", r"""SELECT page_id, lower(regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1)) AS suffix, regexp_matches(page_id::VARCHAR, '^\d+$') AS digits FROM pages""")
def str13(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.suffix(F.col("url")).alias("suffix"), X.all_digits(F.col("page_id").cast("string")).alias("digits"))


@query("mth02_rounding", V.sql(V.NOTES) + """SELECT note_id, floor(midi / 2.0 + 0.5)::BIGINT AS up, round_even(midi / 2.0, 0)::BIGINT AS even FROM notes""")
def mth02(spark, d):
    return V.notes(spark, d).select("note_id", M.round_half_up(F.col("midi") / 2).alias("up"), F.bround(F.col("midi") / 2).cast("long").alias("even"))


@query("mth03_frequency", V.sql(V.NOTES) + """SELECT note_id, round(440 * pow(2.0, (midi - 69) / 12.0), 4) AS hz FROM notes""")
def mth03(spark, d):
    return V.notes(spark, d).select("note_id", F.round(M.to_frequency(F.col("midi")), 4).alias("hz"))


@query("mth04_pitch_class", V.sql(V.NOTES) + "SELECT note_id, ((midi - 100) % 12 + 12) % 12 AS pc FROM notes")
def mth04(spark, d):
    return V.notes(spark, d).select("note_id", M.pitch_class(F.col("midi") - 100).alias("pc"))


@query("mth05_octave_fold", V.sql(V.SCORE) + "SELECT orderkey, linenumber, midi + 12 * (ceil(greatest(0, 40 - midi) / 12.0)::BIGINT - ceil(greatest(0, midi - 86) / 12.0)::BIGINT) AS midi FROM score")
def mth05(spark, d):
    return V.score(spark, d).select("orderkey", "linenumber", M.fold_octave(F.col("midi"), 40, 86).alias("midi"))


@query("mth06_peak_offset", V.sql(V.NOTES) + """
, l AS (SELECT note_id, lag(conf_pct) OVER w AS a, conf_pct AS b, lead(conf_pct) OVER w AS c FROM notes WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id))
SELECT note_id, round(CASE WHEN a - 2 * b + c = 0 THEN 0.0 ELSE greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * b + c)::DOUBLE)) END, 9) + 0.0 AS off FROM l WHERE a IS NOT NULL AND c IS NOT NULL""")
def mth06(spark, d):
    from chronoloom.operators.windows import ordered

    w = ordered(["track_id"], "start_us", "note_id")
    l = V.notes(spark, d).select("note_id", F.lag("conf_pct").over(w).alias("a"), F.col("conf_pct").alias("b"), F.lead("conf_pct").over(w).alias("c")).where("a is not null and c is not null")  # noqa: E741
    return l.select("note_id", F.round(M.peak_offset(F.col("a"), F.col("b"), F.col("c")), 9).alias("off"))


@query("mth07_triads", V.sql(V.CHROMA) + """
, t AS (SELECT k % 12 AS root, k // 12 AS minor, k FROM (SELECT unnest(range(24)) AS k)), s AS (SELECT vec_id, k, chroma[root + 1] + chroma[(root + 4 - minor) % 12 + 1] + chroma[(root + 7) % 12 + 1] AS score FROM chroma, t)
SELECT vec_id, arg_max(k, (score, -k))::BIGINT AS triad, max(score) AS score FROM s GROUP BY 1""")
def mth07(spark, d):
    at = lambda i: F.element_at("chroma", i % 12 + 1)
    scores = F.array(*((at(k) + at(k + (4 if m == 0 else 3)) + at(k + 7)).cast("long") for m in (0, 1) for k in range(12)))
    return V.chroma(spark, d).select("vec_id", A.arg_max(scores).alias("triad"), F.array_max(scores).alias("score"))


@query("mth09_circular", V.sql(V.NOTES) + "SELECT note_id, least((start_us - 500000 + 1000000000) % 700000, 700000 - (start_us - 500000 + 1000000000) % 700000) AS off FROM notes")
def mth09(spark, d):
    return V.notes(spark, d).select("note_id", M.circular_distance(F.col("start_us") - 500_000 + 1_000_000_000, F.lit(0), 700_000).alias("off"))


@query("mth11_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS n FROM documents")
def mth11(spark, d):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return V.table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("n"))


@query("mth12_frame_time", """
SELECT event_id, round(greatest(0.0::DOUBLE, event_id * 256.0::DOUBLE / 22050 - (256.0::DOUBLE / 22050 * (172 - 43844.0::DOUBLE / 256) + 0.0018::DOUBLE) * (event_id // 172)), 6) AS seconds FROM events""")
def mth12(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(M.frame_time(F.col("event_id")), 6).alias("seconds"))


_TEXTS = ["auto", "?", "25", "x", "1.5", "-24", "7.0", None]


@query("mth14_strict_numbers", """
WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'auto' WHEN 1 THEN (event_id % 49 - 24)::VARCHAR WHEN 2 THEN '25' WHEN 3 THEN 'x' WHEN 4 THEN '1.5' WHEN 5 THEN '-24' WHEN 6 THEN '7.0' END AS t FROM events),
n AS (SELECT *, try_cast(t AS DOUBLE) AS x FROM t)
SELECT event_id, coalesce(t = 'auto' OR (abs(x) <= 24 AND x = floor(x)), false) AS valid, CASE WHEN abs(x) <= 24 AND x = floor(x) THEN x::INT END AS shift FROM n""")
def mth14(spark, d):
    """Transpositions as texts: automatic, whole and within bounds, or refused."""
    pick = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("event_id") % 8 + 1).cast("int"))
    text = F.when(F.col("event_id") % 8 == 1, (F.col("event_id") % 49 - 24).cast("string")).otherwise(pick)
    return V.table(spark, d, "events").select("event_id", M.transposition(text).alias("t")).select("event_id", "t.valid", "t.shift")


@query("str11b_loop_clock", V.sql(V.NOTES) + "SELECT note_id, CASE WHEN start_us < 9000000 THEN start_us ELSE 5000000 + (start_us - 5000000) % 4000000 END AS t FROM notes")
def loop_clock(spark, d):
    return V.notes(spark, d).select("note_id", M.loop_time(F.col("start_us"), F.lit(5_000_000), F.lit(9_000_000)).alias("t"))


@query("arr03_arg_max", V.sql(V.CHROMA) + "SELECT vec_id, (list_position(chroma, list_max(chroma)) - 1)::BIGINT AS place FROM chroma")
def arr03(spark, d):
    return V.chroma(spark, d).select("vec_id", A.arg_max(F.col("chroma")).alias("place"))


@query("arr04_rotate_dot", V.sql(V.CHROMA) + "SELECT vec_id, list_sum([chroma[(i + 9) % 12 + 1] * chroma[i + 1] FOR i IN range(12)])::BIGINT AS dot FROM chroma")
def arr04(spark, d):
    z = F.zip_with(A.rotate(F.col("chroma"), 3), F.col("chroma"), lambda x, y: x * y)
    return V.chroma(spark, d).select("vec_id", F.aggregate(z, F.lit(0).cast("long"), lambda s, x: s + x).alias("dot"))


@query("map02_defaults", V.sql(V.NOTES) + "SELECT note_id, CASE midi % 12 WHEN 0 THEN 10 WHEN 7 THEN 5 ELSE 1 END::BIGINT AS w FROM notes")
def map02(spark, d):
    m = F.create_map(F.lit(0), F.lit(10), F.lit(7), F.lit(5))
    return V.notes(spark, d).select("note_id", F.coalesce(F.try_element_at(m, (F.col("midi") % 12).cast("int")), F.lit(1)).cast("long").alias("w"))


@query("map01_group_lists", V.sql(V.NOTES) + "SELECT track_id, midi, count(*) AS n, min(note_id) AS first FROM notes GROUP BY 1, 2")
def map01(spark, d):
    lists = V.notes(spark, d).groupBy("track_id", "midi").agg(F.sort_array(F.collect_list("note_id")).alias("ids"))
    return lists.select("track_id", "midi", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"))


@query("src05_melody_texts", V.sql(V.NOTES) + """
SELECT note_id, start_us / 1e6 AS start, dur_us / 1e6 AS duration, midi::DOUBLE AS midi, conf_pct / 1e2 AS confidence, CASE WHEN note_id % 2 = 0 THEN strength_pct / 1e2 END AS strength FROM notes""")
def src05(spark, d):
    """Notes read from JSON texts of the three forms, some without a strength."""
    n = V.notes(spark, d)
    note = F.struct((F.col("start_us") / 1e6).alias("start"), (F.col("dur_us") / 1e6).alias("duration"), "midi", (F.col("conf_pct") / 1e2).alias("confidence"), F.when(F.col("note_id") % 2 == 0, F.col("strength_pct") / 1e2).alias("strength"))
    bare = F.to_json(F.array(note))
    form = F.col("note_id") % 3
    text = F.when(form == 0, bare).when(form == 1, F.concat(F.lit('{"melody":'), bare, F.lit("}"))).otherwise(F.concat(F.lit('{"analysis":{"melody":'), bare, F.lit("}}")))
    return n.select("note_id", F.inline(R.melody_json(text)))


@query("src17_known_ids", """SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1""")
def src17(spark, d):
    e = V.table(spark, d, "events").groupBy("user_id").agg(A.id_list(F.collect_list("event_type")).alias("j"))
    return e.select("user_id", F.size(A.known_ids(F.col("j"))).cast("long").alias("n"))


@query("jsn01_props", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def jsn01(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("src02_name_gate", r"""SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)\.html$')""")
def src02(spark, d):
    return V.table(spark, d, "pages").where(X.is_audio_name(F.col("url"), "html")).select("page_id")


@query("src11_ordered_scan", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def src11(spark, d):
    from pyspark.sql import Window as W

    return V.table(spark, d, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("src12_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def src12(spark, d):
    return V.table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("src18_fallback", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stem-' || c_custkey ELSE c_name END AS track, CASE WHEN c_custkey % 3 = 0 THEN 'stem' ELSE 'generated' END AS kind FROM customer""")
def src18(spark, d):
    from chronoloom.sources.readers import with_fallback

    c = V.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    stems = c.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("stem-"), F.col("id").cast("string"))).otherwise("").alias("stem"))
    return with_fallback(c, stems, F.col("c_name")).select(F.col("id").alias("c_custkey"), "track", "kind")
