"""Refinement of a transcribed voice by a second reading of the same audio.

primary: track_id, note_id, start_us, end_us, midi, conf_pct, strength_pct.
evidence: track_id, ev_id, start_us, end_us, midi, quality_pct.
acoustic: track_id, at_us and the metrics of strong_attack(); estimates: track_id, at_us, median_midi, mad_midi.
Times in microseconds. Steps that compare two tables are joins; steps that look at the note before are folds.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.music import strong_attack
from chronoloom.held import held
from chronoloom.operators import joins as J
from chronoloom.operators import sequences as S
from chronoloom.operators import windows as O

T = ["track_id"]
#: Fixed values, in microseconds: reach of evidence, shortest note, least distance of onsets and of attacks, rest before an
#: attack, rest over which one pitch is one note, reach of an attack and of a measurement.
REACH, SHORTEST, ONSET_GAP, ATTACK_GAP, BREATH, JOIN_GAP, ATTACK_REACH, MEASURED = 100_000, 60_000, 60_000, 90_000, 12_000, 55_000, 55_000, 15_000
METRICS = ["broad_peak", "harmonic_peak", "broad_ratio", "harmonic_ratio", "rise_db", "reset_db"]
NOTE = "note_id long, start_us long, end_us long, midi long, conf double, strength double, support double"


def support_score(n0: Column, n1: Column, e0: Column, e1: Column, quality: Column) -> Column:
    """0 to 1: overlap over the shorter of the two, closeness of the starts, quality of the evidence."""
    inter = F.greatest(F.lit(0), F.least(n1, e1) - F.greatest(n0, e0))
    shorter = F.greatest(F.lit(SHORTEST), F.least(n1 - n0, e1 - e0))
    return 0.55 * F.least(F.lit(1.0), inter / shorter) + 0.30 * F.exp(-F.abs(n0 - e0) / F.lit(65_000.0)) + 0.15 * quality


def best_support(notes: DataFrame, evidence: DataFrame, shifts: tuple[int, ...] = (0,)) -> DataFrame:
    """track_id, note_id, shift, score, ev0, ev1, quality: the best evidence of each note at each shift of its pitch."""
    pitches = F.explode(F.array(*(F.lit(s) for s in shifts)))
    n = notes.select(*T, "note_id", F.col("start_us").alias("n0"), F.col("end_us").alias("n1"), "midi", pitches.alias("shift"))
    n = n.withColumn("pitch", F.col("midi") + F.col("shift")).withColumn("lo", F.col("n0") - REACH).withColumn("hi", F.col("n1") + REACH)
    e = evidence.select(*T, F.col("midi").alias("pitch"), "ev_id", F.col("start_us").alias("e0"), F.col("end_us").alias("e1"), (F.col("quality_pct") / 100).alias("quality"))
    met = J.overlapping(n, e, [*T, "pitch"], "lo", "hi", "e0", "e1", 2_000_000)
    score = support_score(F.col("n0"), F.col("n1"), F.col("e0"), F.col("e1"), F.col("quality"))
    best = F.max(F.struct(score.alias("score"), (-F.col("e0")).alias("e"), (-F.col("ev_id")).alias("i"), "e1", "quality")).alias("b")
    return met.groupBy(*T, "note_id", "shift").agg(best).select(*T, "note_id", "shift", "b.score", (-F.col("b.e")).alias("ev0"), F.col("b.e1").alias("ev1"), "b.quality")


def coalesced(evidence: DataFrame, reach: int = 24_000) -> DataFrame:
    """Evidence of one pitch with rests of at most 24 ms is one note."""
    rows = O.islands(evidence, reach, ["track_id", "midi"], tie="ev_id")
    return rows.groupBy("track_id", "midi", "island").agg(F.min("ev_id").alias("ev_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("quality_pct").alias("quality_pct")).drop("island")


def corrected(primary: DataFrame, evidence: DataFrame, estimates: DataFrame | None) -> DataFrame:
    """primary with difference (the shift that evidence proposes) and corrected: a semitone or an octave is
    taken where clearly better evidence and a steady pitch estimate at the onset agree."""
    scores = best_support(primary, evidence, (-12, -1, 0, 1, 12))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in ((-12, 3), (-1, 2), (1, 1), (12, 0)) for x in pair)), F.col("shift"))
    other = F.max(F.when(F.col("shift") != 0, F.struct("score", rank.alias("rank"), "shift", "quality"))).alias("o")
    votes = scores.groupBy(*T, "note_id").agg(F.coalesce(F.max(F.when(F.col("shift") == 0, F.col("score"))), F.lit(0.0)).alias("same"), other)
    rows = primary.join(votes, [*T, "note_id"], "left").withColumn("difference", F.when(F.col("o.score") > F.col("same") + 0.05, F.col("o.shift")))
    if estimates is None:
        return rows.withColumn("corrected", F.lit(False)).drop("same", "o")
    at = J.nearest(primary.select(*T, "note_id", "start_us"), estimates, T, "start_us", "at_us", ["median_midi", "mad_midi"], "median_midi")
    rows = rows.join(at.where(F.abs("diff") <= MEASURED).select(*T, "note_id", "median_midi", "mad_midi"), [*T, "note_id"], "left")
    off = F.abs(F.col("median_midi") - (F.col("midi") + F.col("difference")))
    octave = (F.col("o.score") >= 0.55) & (F.col("o.quality") >= 0.75) & (F.col("mad_midi") <= 0.35) & (off <= 0.65)
    long = F.col("end_us") - F.col("start_us") >= 140_000
    semitone = (F.col("o.score") >= 0.40) & (F.col("same") <= 0.15) & (F.col("o.quality") >= 0.80) & long & (F.col("mad_midi") <= 0.25) & (off <= 0.20)
    good = F.coalesce(F.when(F.abs("difference") == 12, octave).otherwise(semitone), F.lit(False)) & F.col("difference").isNotNull()
    rows = rows.withColumn("corrected", good)
    return rows.withColumn("midi", F.when(F.col("corrected"), F.col("midi") + F.col("difference")).otherwise(F.col("midi"))).drop("same", "o", "median_midi", "mad_midi")


def anchored(notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Notes that are supported or clear in themselves; near borders of their evidence are taken over."""
    best = best_support(notes, coalesced(evidence)).drop("shift")
    rows = notes.join(best, [*T, "note_id"], "left").withColumn("support", F.coalesce("score", F.lit(0.0)))
    length = F.col("end_us") - F.col("start_us")
    clear = (F.col("support") >= 0.25) | (F.col("conf") >= 0.72) | ((length >= 200_000) & (F.col("conf") >= 0.60) & (F.col("strength") >= 0.42))
    near = lambda border, found, reach: F.coalesce(F.abs(F.col(found) - F.col(border)) <= reach, F.lit(False))
    take = lambda border, found, reach: F.when(near(border, found, reach), F.col(found)).otherwise(F.col(border))
    found = F.col("score").isNotNull()
    rows = rows.where(clear).withColumn("anchored_start", near("start_us", "ev0", 90_000)).withColumn("anchored_end", near("end_us", "ev1", 120_000))
    rows = rows.withColumn("start_us", take("start_us", "ev0", 90_000)).withColumn("end_us", take("end_us", "ev1", 120_000))
    rows = rows.withColumn("conf", F.when(found, F.greatest("conf", F.least(F.lit(0.99), 0.46 + 0.50 * F.col("support")))).otherwise(F.col("conf")))
    return rows.withColumn("strength", F.when(found, F.least(F.lit(1.0), 0.78 * F.col("strength") + 0.22 * F.col("quality"))).otherwise(F.col("strength"))).drop("score", "ev0", "ev1", "quality")


def one_line(notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Neighbours of one pitch without an attack of their own are one; of colliding onsets the better supported stays.

    joins, beaten: how many notes went into a kept one, and how many it or they collided with."""
    attack = evidence.where("quality_pct >= 55").select(*T, "midi", F.col("start_us").alias("a0"))
    hit = J.points_in_intervals(notes.select(*T, "midi", "note_id", "start_us"), attack, [*T, "midi"], "start_us", F.col("a0") - ATTACK_REACH, F.col("a0") + ATTACK_REACH, 1_000_000)
    notes = notes.join(hit.select(*T, "note_id").distinct().withColumn("attacked", F.lit(True)), [*T, "note_id"], "left")

    def merged(rows):
        last = None
        for name, start, end, midi, conf, strength, support, attacked in rows:
            if last and midi == last[3] and start - last[2] <= JOIN_GAP and not attacked:
                last = (*last[:2], max(last[2], end), midi, max(last[4], conf), max(last[5], strength), max(last[6], support), last[7] + 1)
            else:
                if last:
                    yield last
                last = (name, start, end, midi, conf, strength, support, 0)
        if last:
            yield last

    def step(rows):
        last = None
        rank = lambda r: 2 * r[6] + r[4] + r[5]
        for row in (r + (0,) for r in merged(rows)):
            if last and row[1] - last[1] < ONSET_GAP:
                best = row if rank(row) > rank(last) else last
                last = (*best[:7], last[7] + row[7], last[8] + 1)
            else:
                if last:
                    yield last
                last = row
        if last:
            yield last

    fields = [c.split()[0] for c in NOTE.split(", ")]
    return S.fold(notes.withColumn("weak", -F.col("strength")), T, ["start_us", "weak", "note_id"], [*fields, "attacked"], step, f"{NOTE}, joins long, beaten long")


def attacks(points: DataFrame, acoustic: DataFrame, strict: bool) -> DataFrame:
    """points (track_id, start_us, ...) with strong: whether the nearest measurement, if near, shows an attack."""
    met = J.nearest(points, acoustic, T, "start_us", "at_us", METRICS, "broad_peak")
    strong = strong_attack(*(F.col(c) for c in METRICS), strict=strict) & F.coalesce(F.abs("diff") <= MEASURED, F.lit(False))
    return met.withColumn("strong", strong).select(*points.columns, "strong")


def considered_cuts(notes: DataFrame, evidence: DataFrame, acoustic: DataFrame) -> DataFrame:
    """track_id, note_id, at, quality, strong: where evidence of a note's pitch starts anew inside it, away from starts
    and from the last strong cut; strong where the audio shows an attack."""
    good = evidence.where(f"quality_pct >= 65 and end_us - start_us >= {ATTACK_GAP}").select(*T, "midi", "start_us", (F.col("quality_pct") / 100).alias("quality"))
    inside = notes.select(*T, "midi", "note_id", F.col("start_us").alias("n0"), F.col("end_us").alias("n1"))
    cands = J.points_in_intervals(good, inside, [*T, "midi"], "start_us", F.col("n0") + ATTACK_GAP, F.col("n1") - SHORTEST, 1_000_000).select(*T, "note_id", "start_us", "quality")
    starts = notes.select(*T, F.col("start_us").alias("s0"), F.col("note_id").alias("near_id"))
    free = J.nearest(cands, starts, T, "start_us", "s0", ["near_id"], "near_id").where(F.abs("diff") >= ATTACK_GAP).select(*cands.columns)

    def step(rows):
        last = None
        for at, quality, strong in rows:
            if last is None or at - last >= ATTACK_GAP:
                yield at, quality, strong
                last = at if strong else last

    return S.fold(attacks(free, acoustic, False), [*T, "note_id"], ["start_us", "quality"], ["start_us", "quality", "strong"], step, "at long, quality double, strong boolean")


def split_attacks(notes: DataFrame, considered: DataFrame) -> DataFrame:
    """Each note cut at its strong considered cuts."""
    cuts = considered.where("strong").drop("strong")
    begins = notes.select(*T, "note_id", F.col("start_us").alias("at"), F.lit(None).cast("double").alias("quality")).unionByName(cuts)
    after = F.lead("at").over(W.partitionBy(*T, "note_id").orderBy("at"))
    pieces = begins.withColumn("after", after).join(notes, [*T, "note_id"])
    end = F.when(F.col("after").isNull(), F.col("end_us")).otherwise(F.greatest(F.col("at") + SHORTEST, F.col("after") - BREATH))
    last = F.col("after").isNull() & F.col("quality").isNotNull()
    conf = F.when(last, F.greatest("conf", F.least(F.lit(0.99), 0.50 + 0.45 * F.col("quality")))).otherwise(F.col("conf"))
    strength = F.when(last, F.greatest("strength", "quality")).otherwise(F.col("strength"))
    return pieces.select(*T, "note_id", F.col("at").alias("start_us"), end.alias("end_us"), "midi", conf.alias("conf"), strength.alias("strength"), "support")


def connecting(notes: DataFrame, evidence: DataFrame, acoustic: DataFrame, low: int, high: int) -> DataFrame:
    """In the rests of notes, evidence that fits both neighbours, reaches the next and is strongly attacked: a row for
    each group of it with considered, how many fit, and the note chosen or nulls."""
    good = evidence.where(f"midi between {low} and {high} and quality_pct >= 75 and end_us - start_us >= 120000")
    groups = S.anchored_groups(good, T, 65_000, "start_us", "ev_id").select(*T, "ev_id", "anchor")
    cands = attacks(good.select(*T, "ev_id", "start_us", "end_us", "midi", (F.col("quality_pct") / 100).alias("quality")), acoustic, True).join(groups, [*T, "ev_id"])
    w = W.partitionBy(*T).orderBy("start_us")
    around = notes.select(*T, F.col("start_us").alias("p0"), F.col("end_us").alias("p1"), F.col("midi").alias("pm"), F.lead("start_us").over(w).alias("f0"), F.lead("midi").over(w).alias("fm"))
    rows = J.as_of(cands, around.withColumn("at", F.col("p0")), T, "anchor", "at", ["p0", "p1", "pm", "f0", "fm"], "p0").where("p0 is not null and f0 is not null")

    def step(rows):
        put = None
        for anchor, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            p0, p1, pm, f0, fm = group[0][7:]
            near = [p0, f0] + ([put[1]] if put else [])
            if put and put[1] > p0:
                p1, pm = put[2], put[3]
            if min(abs(anchor - x) for x in near) < ATTACK_GAP or not p1 - 30_000 <= anchor <= p1 + 80_000:
                continue
            fits = [c for c in group if f0 - 100_000 <= c[3] <= f0 + 75_000 and max(abs(c[4] - pm), abs(c[4] - fm)) <= 7]
            viable = [c for c in fits if c[6]]
            if not viable:
                yield (None,) * 7 + (len(fits),)
                continue
            _, name, start, end, midi, quality, *_ = max(viable, key=lambda c: (4 * c[5] - 0.25 * (abs(c[4] - pm) + abs(c[4] - fm)), c[3] - c[2]))
            end = min(end, f0 - BREATH)
            if end - start < SHORTEST:
                yield (None,) * 7 + (len(fits),)
                continue
            put = (-name - 1, start, end, midi, min(0.99, 0.55 + 0.42 * quality), quality, quality)
            yield put + (len(fits),)

    fields = ["anchor", "ev_id", "start_us", "end_us", "midi", "quality", "strong", "p0", "p1", "pm", "f0", "fm"]
    return S.fold(rows, T, ["anchor", "start_us", "midi", "ev_id"], fields, step, f"{NOTE}, considered long")


def trimmed(notes: DataFrame) -> DataFrame:
    """One voice: a note ends before the next, and sounds on to it over a short rest if the pitch changes."""
    w = W.partitionBy(*T).orderBy("start_us", "note_id")
    after, pitch = F.lead("start_us").over(w), F.lead("midi").over(w)
    rows = notes.withColumn("after", after).withColumn("pitch", pitch).withColumn("cut", F.least("end_us", F.col("after") - BREATH))
    on = (F.col("midi") != F.col("pitch")) & (F.col("after") - F.col("cut")).between(1, 120_000)
    end = F.when(F.col("after").isNull(), F.col("end_us")).when(on, F.col("after") - BREATH).otherwise(F.col("cut"))
    return rows.withColumn("end_us", F.greatest(end, F.col("start_us") + SHORTEST)).drop("after", "pitch", "cut")


COLUMNS = [*T, *(c.split()[0] for c in NOTE.split(", "))]


def in_range(primary: DataFrame, low: int, high: int) -> DataFrame:
    return primary.where(F.col("midi").between(low, high)).select(*T, "note_id", "start_us", "end_us", "midi", (F.col("conf_pct") / 100).alias("conf"), (F.col("strength_pct") / 100).alias("strength"))


def stages(primary: DataFrame, evidence: DataFrame, acoustic: DataFrame | None, estimates: DataFrame | None, low: int, high: int, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """The tables of the chain by name: kept, line, and with acoustic cuts and put; last the notes. keep: what is done with each before the next reads it."""
    out = {"kept": keep(anchored(corrected(in_range(primary, low, high), evidence, estimates), evidence), "kept")}
    out["line"] = keep(one_line(out["kept"], evidence), "line")
    notes = out["line"].select(COLUMNS)
    if acoustic is not None:
        out["cuts"] = keep(considered_cuts(notes, evidence, acoustic), "cuts")
        notes = keep(split_attacks(notes, out["cuts"]).select(COLUMNS), "split")
        out["put"] = keep(connecting(notes, evidence, acoustic, low, high), "put")
        notes = notes.unionByName(out["put"].where("note_id is not null").select(COLUMNS))
    out["notes"] = trimmed(notes).withColumn("inserted", F.col("note_id") < 0)
    return out


def refine(primary: DataFrame, evidence: DataFrame, acoustic: DataFrame | None = None, estimates: DataFrame | None = None, low: int = 48, high: int = 84, keep=lambda df, name: df) -> DataFrame:
    """track_id, note_id, start_us, end_us, midi, conf, strength, support, inserted: correct, filter, anchor, merge,
    separate, split, connect, one voice. Without acoustic nothing is split or inserted, without estimates nothing corrected. keep: as in stages()."""
    return stages(primary, evidence, acoustic, estimates, low, high, keep)["notes"]


def refine_counted(primary: DataFrame, evidence: DataFrame, acoustic: DataFrame | None = None, estimates: DataFrame | None = None, low: int = 48, high: int = 84) -> tuple[DataFrame, DataFrame]:
    """(refine()'s notes, counters of each track): both from one run, whose stages are written to the shared folder once."""
    got = stages(primary, evidence, acoustic, estimates, low, high, held)
    notes = held(got["notes"], "notes")
    of = lambda size, more=F.lit(True): F.count_if((F.abs("difference") == size) & more)
    kept = got["kept"].groupBy(*T).agg(F.count(F.lit(1)).alias("clear"), of(1).alias("semitone_pitch_candidates"), of(12).alias("octave_pitch_candidates"), of(1, F.col("corrected")).alias("semitone_corrections"), of(12, F.col("corrected")).alias("octave_corrections"), F.count_if("anchored_start").alias("anchored_starts"), F.count_if("anchored_end").alias("anchored_ends"))
    parts = [kept, got["line"].groupBy(*T).agg(F.sum("joins").alias("merged"), F.sum("beaten").alias("onset_collisions")), notes.groupBy(*T).agg(F.count(F.lit(1)).alias("kept"))]
    if acoustic is not None:
        parts.append(got["cuts"].groupBy(*T).agg(F.count(F.lit(1)).alias("articulation_candidates"), F.count_if("strong").alias("articulations_added")))
        parts.append(got["put"].groupBy(*T).agg(F.sum("considered").alias("evidence_note_candidates"), F.count("note_id").alias("evidence_notes_added")))
    out = primary.groupBy(*T).agg(F.count(F.lit(1)).alias("primary"))
    for part in parts:
        out = out.join(part, T, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0).cast("long")
    pitch, fixed = n("semitone_pitch_candidates") + n("octave_pitch_candidates"), n("semitone_corrections") + n("octave_corrections")
    made = {"dropped": n("primary") - n("clear"), "pitch_candidates": pitch, "pitch_corrections": fixed, "pitch_corrections_rejected": pitch - fixed, "articulations_rejected": n("articulation_candidates") - n("articulations_added"), "evidence_notes_rejected": n("evidence_note_candidates") - n("evidence_notes_added")}
    return notes, out.select(*T, *((made[c] if c in made else n(c)).alias(c) for c in COUNTERS))


#: Notes shorter than this are counted apart in a report.
SHORT_US = 150_000


def diagnostics(notes: DataFrame, counters: DataFrame) -> DataFrame:
    """The counters of each track and what its notes are like: their number, sounding seconds, median length, short ones, first and last second, lowest and highest pitch."""
    length, second = F.col("end_us") - F.col("start_us"), lambda c: F.bround(c / 1e6, 3)
    shape = notes.groupBy(*T).agg(F.count(F.lit(1)).alias("output_notes"), second(F.sum(length)).alias("sounding_seconds"), second(F.median(length)).alias("median_duration"), F.count_if(length < SHORT_US).alias("shorter_than_150ms"), second(F.min("start_us")).alias("first_start"), second(F.max_by("end_us", F.struct("start_us", "note_id"))).alias("last_end"), F.min("midi").alias("midi_min"), F.max("midi").alias("midi_max"))
    return counters.join(shape, T, "left")


COUNTERS = (
    "primary kept dropped merged onset_collisions articulation_candidates articulations_added articulations_rejected evidence_note_candidates evidence_notes_added evidence_notes_rejected "
    "pitch_candidates semitone_pitch_candidates octave_pitch_candidates pitch_corrections pitch_corrections_rejected semitone_corrections octave_corrections anchored_starts anchored_ends"
).split()

#: Fixed values of an instrumental opening: its pitches, the least quality and length of a note, and the reaches within
#: which onsets are one chord and equal pitches one note.
INTRO_LOW, INTRO_HIGH, INTRO_QUALITY, INTRO_SHORTEST, CHORD_REACH, INTRO_JOIN = 65, 84, 45, 90_000, 65_000, 60_000


def intro_line(evidence: DataFrame, intro_end: int) -> DataFrame:
    """COLUMNS: the upper line of the evidence that starts before intro_end, as notes: of a chord the highest, then surest, then longest."""
    loud = evidence.where(F.col("midi").between(INTRO_LOW, INTRO_HIGH) & (F.col("start_us") < intro_end) & (F.col("quality_pct") >= INTRO_QUALITY) & (F.col("end_us") - F.col("start_us") >= INTRO_SHORTEST))

    def chords(rows):
        group = []
        for row in rows:
            if group and row[1] - group[0][1] > CHORD_REACH:
                yield max(group, key=lambda r: (r[3], r[4], r[2] - r[1]))
                group = []
            group.append(row)
        if group:
            yield max(group, key=lambda r: (r[3], r[4], r[2] - r[1]))

    def step(rows):
        last = None
        for name, start, end, midi, quality in chords(rows):
            end, sure = min(intro_end, end), quality / 100
            if last and midi == last[3] and start <= last[2] + INTRO_JOIN:
                last = (*last[:2], max(last[2], end), midi, max(last[4], sure), max(last[5], sure), None)
            else:
                if last:
                    yield last
                last = (name, start, end, midi, sure, sure, None)
        if last:
            yield last

    return cut_short(S.fold(loud, T, ["start_us", "ev_id"], ["ev_id", "start_us", "end_us", "midi", "quality_pct"], step, NOTE))


def cut_short(notes: DataFrame) -> DataFrame:
    """notes that end before the next one starts, as far as they stay long enough."""
    after = F.lead("start_us").over(W.partitionBy(*T).orderBy("start_us", F.col("strength").desc(), "note_id"))
    rows = notes.withColumn("after", after)
    end = F.when(F.col("after").isNull(), F.col("end_us")).otherwise(F.greatest(F.col("start_us") + SHORTEST, F.least(F.col("end_us"), F.col("after") - BREATH)))
    return rows.withColumn("end_us", end).drop("after")


def with_intro(notes: DataFrame, evidence: DataFrame, intro_end: int) -> DataFrame:
    """Refined notes from intro_end on, the upper line of the evidence before it; from_intro marks the latter."""
    line = intro_line(evidence, intro_end).withColumn("from_intro", F.lit(True))
    voice = notes.where(F.col("start_us") >= intro_end).select(*COLUMNS, F.lit(False).alias("from_intro"))
    return cut_short(line.unionByName(voice))


def connectors(notes: DataFrame, evidence: DataFrame, rest: int = 100_000) -> DataFrame:
    """Per rest between neighbours, the evidence note that fits it best and lies between their pitches."""
    w = W.partitionBy("track_id").orderBy("start_us", "note_id")
    gaps = notes.select("track_id", F.col("end_us").alias("g0"), F.lead("start_us").over(w).alias("g1"), F.col("midi").alias("m0"), F.lead("midi").over(w).alias("m1")).where(f"g1 - g0 >= {rest}")
    met = J.points_in_intervals(evidence.where("quality_pct >= 60"), gaps, T, "start_us", F.col("g0"), F.col("g1"), 2_000_000).where("end_us <= g1 and midi between least(m0, m1) - 2 and greatest(m0, m1) + 2")
    fit = 4 * F.col("quality_pct") - 25 * F.expr("abs(2 * midi - m0 - m1) div 2")
    best = F.max(F.struct(fit.alias("f"), (F.col("end_us") - F.col("start_us")).alias("len"), (-F.col("ev_id")).alias("id"), "midi", "start_us", "end_us")).alias("b")
    return met.groupBy("track_id", "g0", "g1").agg(best).select("track_id", "g0", (-F.col("b.id")).alias("ev_id"), "b.midi", "b.start_us", "b.end_us")
