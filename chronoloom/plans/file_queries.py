"""Readers as queries: the notes are written by Spark in a format of files and come back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.held import home
from chronoloom.registry import query
from chronoloom.sources import readers as R


def seconds(spark: SparkSession, d: str) -> DataFrame:
    """track_id, start, duration in seconds, midi, confidence, strength of the notes."""
    share = lambda c: F.col(c) / 100
    return V.notes(spark, d).select("track_id", (F.col("start_us") / 1e6).alias("start"), (F.col("dur_us") / 1e6).alias("duration"), "midi", share("conf_pct").alias("confidence"), share("strength_pct").alias("strength"))


def place(spark: SparkSession, name: str) -> str:
    return f"{home(spark)}/{name}-{uuid.uuid4().hex}"


@query("src04_event_json", V.sql(V.NOTES) + """
SELECT start_us / 1e6 AS start, start_us / 1e6 + dur_us / 1e6 AS "end", midi::INT AS midi, conf_pct / 100 AS confidence, CASE WHEN track_id % 2 = 0 THEN strength_pct / 100 ELSE 0.5::DOUBLE END AS strength FROM notes""")
def src04(spark, d):
    """A JSON array for each track, half of them without strengths."""
    n = seconds(spark, d)
    event = F.struct("start", "duration", "midi", "confidence", F.when(F.col("track_id") % 2 == 0, F.col("strength")).alias("strength"))
    path = place(spark, "events")
    n.groupBy("track_id").agg(F.to_json(F.collect_list(event)).alias("value")).write.partitionBy("track_id").text(path)
    return R.event_json(spark, path)


@query("src05_melody_files", V.sql(V.NOTES) + """
SELECT start_us / 1e6 AS start, dur_us / 1e6 AS duration, midi::DOUBLE AS midi, conf_pct / 100 AS confidence FROM notes""")
def src05(spark, d):
    """A melody for each track, as an array, under melody, or under analysis."""
    notes = seconds(spark, d).groupBy("track_id").agg(F.collect_list(F.struct("start", "duration", F.col("midi").cast("double").alias("midi"), "confidence", "strength")).alias("melody"))
    kind = F.col("track_id") % 3
    text = F.when(kind == 0, F.to_json("melody")).when(kind == 1, F.to_json(F.struct("melody"))).otherwise(F.to_json(F.struct(F.struct("melody").alias("analysis"))))
    path = place(spark, "melodies")
    notes.select("track_id", text.alias("value")).write.partitionBy("track_id").text(path)
    return R.melody_files(spark, f"{path}/*/*.txt").select("start", "duration", "midi", "confidence")


def written_csv(spark: SparkSession, d: str) -> str:
    path = place(spark, "rows")
    end = F.col("start") + F.col("duration")
    rows = seconds(spark, d).select(F.col("start").alias("start_time_s"), end.alias("end_time_s"), F.col("midi").alias("pitch_midi"), (F.col("strength") * 127).alias("velocity"))
    rows.write.option("header", True).csv(path)
    return path


@query("src06_evidence_csv", V.sql(V.NOTES) + """
SELECT start_us / 1e6 AS start, start_us / 1e6 + dur_us / 1e6 AS "end", midi::INT AS midi, least(1.0::DOUBLE, strength_pct / 100 * 127 / 100) AS quality FROM notes""")
def src06(spark, d):
    return R.evidence_csv(spark, written_csv(spark, d))


@query("src07_lead_csv", V.sql(V.NOTES) + """
, r AS (SELECT start_us / 1e6 AS start, (start_us / 1e6 + dur_us / 1e6) - start_us / 1e6 AS duration, midi::INT AS midi, strength_pct / 100 * 127 / 127 AS amplitude FROM notes)
SELECT * FROM r WHERE duration >= 0.09::DOUBLE AND midi BETWEEN 65 AND 96 AND amplitude >= 0.35::DOUBLE""")
def src07(spark, d):
    return R.lead_csv(spark, written_csv(spark, d))
