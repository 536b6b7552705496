"""Timeline tables derived from the driver tables, in Spark and as SQL for the same rows.

All times are integer microseconds from a track's start, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 30 days of events are pressed into 72 seconds.
PRESS = 36_000
TRACK_US = 72_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {ts}) div {PRESS}"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed notes: track_id, note_id, start_us, dur_us, midi, conf_pct, strength_pct."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("note_id"),
        F.expr(_start("ts")).alias("start_us"),
        (F.lit(45_000) + (F.floor(F.col("value") * 100) * 37) % 1_500_000).cast("long").alias("dur_us"),
        (F.lit(40) + (F.col("event_id") * 7 + F.floor("value")) % 57).cast("long").alias("midi"),
        ((F.col("event_id") * 13) % 101).alias("conf_pct"),
        ((F.col("event_id") * 29) % 101).alias("strength_pct"),
    )


NOTES = f"""notes AS (
  SELECT user_id AS track_id, event_id AS note_id,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {PRESS} AS start_us,
    45000 + (floor(value * 100)::BIGINT * 37) % 1500000 AS dur_us,
    40 + (event_id * 7 + floor(value)::BIGINT) % 57 AS midi,
    (event_id * 13) % 101 AS conf_pct, (event_id * 29) % 101 AS strength_pct
  FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled half-open intervals that tile each track from its first segment on."""
    from pyspark.sql import Window as W

    w = W.partitionBy("track_id").orderBy("start_us", "note_id")
    picked = notes(spark, sf_dir)
    ends = picked.withColumn("end_us", F.coalesce(F.lead("start_us").over(w), F.lit(TRACK_US)))
    return ends.select("track_id", (F.row_number().over(w) - 1).cast("long").alias("seg_idx"), "start_us", "end_us", (F.col("midi") % 12).alias("label"), "conf_pct")


SEGMENTS = f"""segments AS (
  SELECT track_id, row_number() OVER w - 1 AS seg_idx, start_us, coalesce(lead(start_us) OVER w, {TRACK_US}) AS end_us, midi % 12 AS label, conf_pct
  FROM notes WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id))"""


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player gestures: one for each note, early or late by up to 200 ms."""
    return notes(spark, sf_dir).select("track_id", F.col("note_id").alias("gesture_id"), (F.col("start_us") + (F.col("note_id") % 401 - 200) * 1000).alias("at_us"), (F.col("midi") % 6).alias("string_idx"))


GESTURES = """gestures AS (
  SELECT track_id, note_id AS gesture_id, start_us + (note_id % 401 - 200) * 1000 AS at_us, midi % 6 AS string_idx FROM notes)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues to be played: the notes with a lane."""
    return notes(spark, sf_dir).select("track_id", F.col("note_id").alias("cue_id"), F.col("start_us").alias("time_us"), "dur_us", "midi", (F.col("midi") % 6).alias("lane"))


CUES = """cues AS (SELECT track_id, note_id AS cue_id, start_us AS time_us, dur_us, midi, midi % 6 AS lane FROM notes)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, noisy reading of the notes: jittered starts, some pitches off, a quality."""
    jitter = (F.col("note_id") * 37) % 181 - 90
    off = F.when(F.col("note_id") % 10 == 0, 12).when(F.col("note_id") % 10 == 1, 1).when(F.col("note_id") % 10 == 2, -1).otherwise(0)
    start = F.greatest(F.lit(0), F.col("start_us") + jitter * 1000)
    return notes(spark, sf_dir).select("track_id", F.col("note_id").alias("ev_id"), start.alias("start_us"), (start + F.col("dur_us")).alias("end_us"), (F.col("midi") + off).alias("midi"), ((F.col("note_id") * 17) % 101).alias("quality_pct"))


EVIDENCE = """evidence AS (
  SELECT track_id, note_id AS ev_id, greatest(0, start_us + ((note_id * 37) % 181 - 90) * 1000) AS start_us,
    greatest(0, start_us + ((note_id * 37) % 181 - 90) * 1000) + dur_us AS end_us,
    midi + CASE note_id % 10 WHEN 0 THEN 12 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS midi, (note_id * 17) % 101 AS quality_pct
  FROM notes)"""


def acoustic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack metrics at the starts of the evidence."""
    k = F.col("ev_id")
    metric = lambda step, span: ((k * step) % 101 / 100 * span)
    return evidence(spark, sf_dir).select("track_id", F.col("start_us").alias("at_us"), metric(13, 1.2).alias("broad_peak"), metric(29, 1.0).alias("harmonic_peak"), metric(31, 5.0).alias("broad_ratio"), metric(43, 4.0).alias("harmonic_ratio"), metric(53, 6.0).alias("rise_db"), metric(61, 9.0).alias("reset_db"))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch estimates at the starts of the notes, some of them a semitone or an octave away."""
    off = F.when(F.col("note_id") % 4 == 0, 12).when(F.col("note_id") % 4 == 1, 1).otherwise(0)
    return notes(spark, sf_dir).select("track_id", F.col("start_us").alias("at_us"), (F.col("midi") + off + (F.col("note_id") % 5) / 50).alias("median_midi"), ((F.col("note_id") % 7) / 20).alias("mad_midi"))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score notes of parts, voices and staves, from lineitem."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("part_index"), (F.col("l_linenumber") % 3).cast("long").alias("voice"), (F.col("l_linenumber") % 2).cast("long").alias("staff"),
        day.cast("long").alias("start"), (F.lit(1) + F.col("l_orderkey") % 5).alias("dur"), (F.lit(24) + F.col("l_partkey") % 85).alias("midi"), (F.lit(1) + F.col("l_orderkey") % 127).alias("velocity"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("linenumber"),
    )


SCORE = """score AS (
  SELECT l_suppkey % 8 AS part_index, (l_linenumber % 3)::BIGINT AS voice, (l_linenumber % 2)::BIGINT AS staff, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start,
    1 + l_orderkey % 5 AS dur, 24 + l_partkey % 85 AS midi, 1 + l_orderkey % 127 AS velocity, l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber FROM lineitem)"""


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve non-negative integer pitch class weights for each vector."""
    twelve = F.transform(F.slice("embedding", 1, 12), lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), twelve.alias("chroma"))


CHROMA = """chroma AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding[1:12], lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT) AS chroma FROM embeddings)"""


def sql(*views: str, recursive: bool = False) -> str:
    """WITH and the named views, in order, ready for a query's own parts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views)
