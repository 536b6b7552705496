"""The refinement's first steps with all their gates, held against SQL: consensus corrections, kept and anchored notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.plans import refine
from chronoloom.plans.window_queries import ENDED, ended
from chronoloom.registry import query

#: Views of the SQL: notes in range, estimates, the support of evidence, the best of it at each shift, corrections.
_SCORE = """0.55::DOUBLE * least(1.0::DOUBLE, greatest(0, least(n1, e1) - greatest(n0, e0)) / greatest(60000, least(n1 - n0, e1 - e0))) + 0.30::DOUBLE * exp(-abs(n0 - e0) / 65000.0::DOUBLE) + 0.15::DOUBLE * quality"""
_BEST = "ORDER BY score DESC, e0, ev_id, e1 DESC"
_CORRECTED = f"""p AS (SELECT track_id, note_id, start_us AS n0, end_us AS n1, midi, conf_pct / 100 AS conf, strength_pct / 100 AS strength FROM ended WHERE midi BETWEEN 48 AND 84),
est AS (SELECT track_id, start_us AS at_us, midi + CASE note_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 1 ELSE 0 END + (note_id % 5) / 50 AS median_midi, (note_id % 7) / 20 AS mad_midi FROM notes),
e AS (SELECT track_id, ev_id, start_us AS e0, end_us AS e1, midi, quality_pct / 100 AS quality FROM evidence),
met AS (SELECT p.*, s.shift, s.rank, e.e0, e.e1, e.ev_id, e.quality FROM p, (VALUES (-12, 3), (-1, 2), (0, 0), (1, 1), (12, 0)) AS s(shift, rank), e
  WHERE e.track_id = p.track_id AND e.midi = p.midi + s.shift AND e.e0 < p.n1 + 100000 AND e.e1 > p.n0 - 100000),
scored AS (SELECT *, {_SCORE} AS score FROM met),
one AS (SELECT *, row_number() OVER (PARTITION BY track_id, note_id, shift {_BEST}) AS rn FROM scored),
other AS (SELECT *, row_number() OVER (PARTITION BY track_id, note_id ORDER BY score DESC, rank DESC) AS best FROM one WHERE rn = 1 AND shift <> 0),
near AS (SELECT p.track_id, p.note_id, est.median_midi, est.mad_midi, row_number() OVER (PARTITION BY p.track_id, p.note_id ORDER BY abs(p.n0 - est.at_us), est.at_us DESC, est.median_midi) AS rn
  FROM p JOIN est ON est.track_id = p.track_id AND abs(p.n0 - est.at_us) <= 15000),
v AS (SELECT p.*, coalesce(same.score, 0) AS same, other.score AS o_score, other.quality AS o_quality, CASE WHEN other.score > coalesce(same.score, 0) + 0.05::DOUBLE THEN other.shift END AS difference, near.median_midi, near.mad_midi
  FROM p LEFT JOIN one same ON same.track_id = p.track_id AND same.note_id = p.note_id AND same.shift = 0 AND same.rn = 1
  LEFT JOIN other ON other.track_id = p.track_id AND other.note_id = p.note_id AND other.best = 1
  LEFT JOIN near ON near.track_id = p.track_id AND near.note_id = p.note_id AND near.rn = 1),
g AS (SELECT *, abs(median_midi - (midi + difference)) AS off FROM v),
c AS (SELECT *, coalesce(CASE WHEN abs(difference) = 12 THEN o_score >= 0.55::DOUBLE AND o_quality >= 0.75::DOUBLE AND mad_midi <= 0.35::DOUBLE AND off <= 0.65::DOUBLE
    ELSE o_score >= 0.40::DOUBLE AND same <= 0.15::DOUBLE AND o_quality >= 0.80::DOUBLE AND n1 - n0 >= 140000 AND mad_midi <= 0.25::DOUBLE AND off <= 0.20::DOUBLE END, false) AS corrected FROM g)"""
_KEPT = f"""fixed AS (SELECT track_id, note_id, n0, n1, midi + CASE WHEN corrected THEN difference ELSE 0 END AS midi, conf, strength FROM c),
opens AS (SELECT *, CASE WHEN max(e1) OVER w IS NULL OR e0 - max(e1) OVER w > 24000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY track_id, midi ORDER BY e0, ev_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY track_id, midi ORDER BY e0, ev_id) AS run FROM opens),
joined AS (SELECT track_id, midi, min(ev_id) AS ev_id, min(e0) AS e0, max(e1) AS e1, max(quality) AS quality FROM runs GROUP BY track_id, midi, run),
held AS (SELECT f.*, j.e0, j.e1, j.ev_id, j.quality FROM fixed f JOIN joined j ON j.track_id = f.track_id AND j.midi = f.midi AND j.e0 < f.n1 + 100000 AND j.e1 > f.n0 - 100000),
rated AS (SELECT *, {_SCORE} AS score FROM held),
top AS (SELECT *, row_number() OVER (PARTITION BY track_id, note_id {_BEST}) AS rn FROM rated),
k AS (SELECT f.*, t.score, t.e0, t.e1, t.quality, coalesce(t.score, 0) AS support FROM fixed f LEFT JOIN top t ON t.track_id = f.track_id AND t.note_id = f.note_id AND t.rn = 1)"""


@query("seq15_corrections", V.sql(V.NOTES, ENDED, V.EVIDENCE, _CORRECTED) + "SELECT track_id, note_id, difference, corrected, midi + CASE WHEN corrected THEN difference ELSE 0 END AS midi FROM c")
def seq15_corrections(spark, d):
    """SEQ-15, JN-08: which notes better evidence and a steady estimate move by a semitone or an octave."""
    rows = refine.corrected(refine.in_range(ended(spark, d), 48, 84), V.evidence(spark, d), V.estimates(spark, d))
    return rows.select("track_id", "note_id", "difference", "corrected", "midi")


@query("seq16_kept", V.sql(V.NOTES, ENDED, V.EVIDENCE, _CORRECTED, _KEPT) + """
SELECT track_id, note_id, midi, CASE WHEN abs(e0 - n0) <= 90000 THEN e0 ELSE n0 END AS start_us, CASE WHEN abs(e1 - n1) <= 120000 THEN e1 ELSE n1 END AS end_us,
  round(CASE WHEN score IS NOT NULL THEN greatest(conf, least(0.99::DOUBLE, 0.46::DOUBLE + 0.50::DOUBLE * support)) ELSE conf END, 6) AS conf,
  round(CASE WHEN score IS NOT NULL THEN least(1.0::DOUBLE, 0.78::DOUBLE * strength + 0.22::DOUBLE * quality) ELSE strength END, 6) AS strength, round(support, 6) AS support
FROM k WHERE support >= 0.25::DOUBLE OR conf >= 0.72::DOUBLE OR (n1 - n0 >= 200000 AND conf >= 0.60::DOUBLE AND strength >= 0.42::DOUBLE)""")
def seq16_kept(spark, d):
    """SEQ-16: the notes that are supported or clear, with the borders, confidence and strength they take over."""
    evidence = V.evidence(spark, d)
    rows = refine.anchored(refine.corrected(refine.in_range(ended(spark, d), 48, 84), evidence, V.estimates(spark, d)), evidence)
    return rows.select("track_id", "note_id", "midi", "start_us", "end_us", *(F.round(c, 6).alias(c) for c in ("conf", "strength", "support")))


_METRIC = lambda step, span: f"((ev_id * {step}) % 101 / 100 * {span}::DOUBLE)"
#: Attacks at the starts of the evidence: of measurements at one time the one with the lowest first peak counts.
_ATTACKS = f"""measured AS (SELECT track_id, start_us AS t0, {_METRIC(13, 1.2)} AS bp, {_METRIC(29, 1.0)} AS hp, {_METRIC(31, 5.0)} AS br, {_METRIC(43, 4.0)} AS hr, {_METRIC(53, 6.0)} AS rise, {_METRIC(61, 9.0)} AS reset FROM evidence),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, t0 ORDER BY bp) AS rn FROM measured) WHERE rn = 1),
attack AS (SELECT track_id, t0, ((bp >= 0.45::DOUBLE AND br >= 2.1::DOUBLE) OR (hp >= 0.38::DOUBLE AND hr >= 2.05::DOUBLE))
  AND (rise >= 2.0::DOUBLE OR reset >= 3.9::DOUBLE OR (bp >= 0.65::DOUBLE AND hp >= 0.45::DOUBLE AND br >= 3.4::DOUBLE AND hr >= 2.5::DOUBLE)) AS strong FROM first)"""


@query("seq13_considered_cuts", V.sql(V.NOTES, ENDED, V.EVIDENCE, _ATTACKS, """p AS (SELECT track_id, note_id, start_us AS n0, start_us + 40 * dur_us AS n1, midi FROM ended WHERE midi BETWEEN 48 AND 84),
cand AS (SELECT p.track_id, p.note_id, e.start_us AS t0, e.quality_pct / 100 AS quality FROM evidence e JOIN p ON p.track_id = e.track_id AND p.midi = e.midi AND e.start_us BETWEEN p.n0 + 90000 AND p.n1 - 60000
  WHERE e.quality_pct >= 65 AND e.end_us - e.start_us >= 90000),
free AS (SELECT c.*, a.strong, row_number() OVER (PARTITION BY c.track_id, c.note_id ORDER BY c.t0, c.quality) AS rn FROM cand c JOIN attack a ON a.track_id = c.track_id AND a.t0 = c.t0
  WHERE NOT EXISTS (SELECT 1 FROM p s WHERE s.track_id = c.track_id AND abs(s.n0 - c.t0) < 90000))""", recursive=True) + """
, walk AS (SELECT track_id, note_id, rn, t0, quality, strong, true AS considered, CASE WHEN strong THEN t0 END AS last FROM free WHERE rn = 1
  UNION ALL SELECT f.track_id, f.note_id, f.rn, f.t0, f.quality, f.strong, w.last IS NULL OR f.t0 - w.last >= 90000, CASE WHEN (w.last IS NULL OR f.t0 - w.last >= 90000) AND f.strong THEN f.t0 ELSE w.last END
  FROM walk w JOIN free f ON f.track_id = w.track_id AND f.note_id = w.note_id AND f.rn = w.rn + 1)
SELECT track_id, note_id, t0 AS "at", quality, strong FROM walk WHERE considered""")
def seq13_considered(spark, d):
    """SEQ-13: where notes, held forty times as long, are struck anew, by evidence of their pitch and attacks in the audio, with all gates."""
    notes = ended(spark, d).withColumn("end_us", F.col("start_us") + 40 * F.col("dur_us"))
    return refine.considered_cuts(refine.in_range(notes, 48, 84), V.evidence(spark, d), V.acoustic(spark, d))
