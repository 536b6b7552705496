"""Commands over files: inspect, convert, compare and refine, with reports as text or as one JSON document."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.music import strict_transposition
from chronoloom.held import held
from chronoloom.operators import acoustics as C
from chronoloom.operators import align as A
from chronoloom.operators import signal as G
from chronoloom.plans import analysis, cli, refine
from chronoloom.sources import readers as R
from chronoloom.sources import sinks as K

STREAM_COLUMNS = ["path", "part_index", "voice", "staff", "notes", "low", "high", "lone", "onsets", "score", "part_name"]


def streams(notes: DataFrame) -> DataFrame:
    """Streams of each score file, the likeliest melody first."""
    return cli.ranked_streams(notes, ["path"]).select(STREAM_COLUMNS).orderBy("path", F.col("score").desc(), *cli.PVS)


def inspect(spark: SparkSession, args) -> str:
    rows = streams(R.score_files(spark, args.score, args.default_bpm, not args.no_unfold)).collect()  # a row for each voice of a score
    if args.json:
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2)
    lines = ["idx  voice staff notes  range   mono  score  name"]
    lines += [f"{r.part_index:>3}  {r.voice:>5} {r.staff:>5} {r.notes:>5}  {r.low:>3}-{r.high:<3} {r.lone / r.onsets:>5.2f} {r.score:>6.2f}  {r.part_name}" for r in rows]
    return "\n".join(lines + [f"Auto selection: {rows[0].part_index}:{rows[0].part_name} / voice {rows[0].voice} / staff {rows[0].staff}"] if rows else lines)


def sounds(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """path, at, samples of the WAV files at rate; see analysis.pieces_of()."""
    return held(analysis.pieces_of(spark, path, rate), "samples")


def convert(spark: SparkSession, args) -> str:
    K.no_alias(args.score, args.output, *filter(None, (args.audio, args.report)))
    notes = held(R.score_files(spark, args.score, args.default_bpm, not args.no_unfold), "score")
    shift = spark.range(1).select(strict_transposition(F.lit(args.transpose)).alias("s")).first().s
    how = {"offset": args.offset, "scale": args.time_scale, "selectors": args.part, "voice": args.voice, "staff": args.staff}
    if args.audio:
        rate = analysis.ANALYSIS_RATE
        # one recording for the scores that were asked for
        frames = held(G.spectrum(sounds(spark, args.audio, rate), ["path"], rate).drop("path").crossJoin(F.broadcast(notes.select("path").distinct())), "frames")
        score = notes.where(~F.col("is_drum")).withColumn("end", F.col("start") + F.col("duration"))
        aligned = held(A.align(score, frames, ["path"], rate / (G.frame_size(rate) // 4), args.aligner, shift), "alignment")
        out = cli.convert(notes, alignment=aligned, frames=frames, **how)
    else:
        out = cli.convert(notes, transpose=shift or 0, **how)
    out = held(out, "notes")
    K.write_document(out.drop("path", "folded"), args.output, "start", "midi")
    report = out.agg(F.count(F.lit(1)).alias("notes"), F.count_if("folded").alias("octaveFoldedNotes"), F.min("start").alias("firstStart"), F.max(F.col("start") + F.col("duration")).alias("lastEnd"))
    if args.audio:
        report = report.crossJoin(aligned.agg(F.first("pitch_shift").alias("pitchShift"), F.first("cost").alias("alignmentCost")))
    if args.report:
        K.write_document(report, args.report)
    r = report.first()
    return f"{r.notes} notes" + (f"; Folded {r.octaveFoldedNotes} transposed notes into range" if r.octaveFoldedNotes else "")


def compare(spark: SparkSession, args) -> str:
    if not args.tolerance > 0:
        raise ValueError("the tolerance must be positive")
    read = lambda path: R.melody_files(spark, path).select(F.lit(0).alias("all"), "start", F.bround("midi").cast("int").alias("midi"))
    report = held(cli.compare(read(args.reference), read(args.candidate), ["all"], args.tolerance).drop("all"), "report")
    if args.report:
        K.no_alias(args.reference, args.candidate, args.report)
        K.write_document(report, args.report)
    r = report.first()
    if r is None:
        return "no reference notes"
    share = lambda n, of: f"{n / of:.1%}" if of else "n/a"
    error = "n/a" if r.mae is None else f"{r.mae:.3f}s"
    return f"coverage={share(r.matched, r.n_ref)}, precision={share(r.matched, r.n_cand)}, exact-pitch={share(r.exact, r.matched)}, octave-errors={r.octave}, onset-MAE={error}"


def refined(spark: SparkSession, args) -> str:
    K.no_alias(args.primary, args.evidence, args.output, *filter(None, (args.audio, args.report)))
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    pct, one = lambda c: F.col(c) * 100, F.lit(0).cast("long").alias("track_id")
    number = F.monotonically_increasing_id()
    primary = held(R.event_json(spark, args.primary).select(one, number.alias("note_id"), us("start").alias("start_us"), us("end").alias("end_us"), F.col("midi").cast("long").alias("midi"), pct("confidence").alias("conf_pct"), pct("strength").alias("strength_pct")), "primary")
    evidence = held(R.evidence_csv(spark, args.evidence).select(one, number.alias("ev_id"), us("start").alias("start_us"), us("end").alias("end_us"), F.col("midi").cast("long").alias("midi"), pct("quality").alias("quality_pct")), "evidence")
    acoustic = estimates = None
    if args.audio:
        rate = analysis.REFINE_RATE
        sound = sounds(spark, args.audio, rate).select(one, "at", "samples")
        acoustic = held(C.articulations(C.onset_frames(sound, refine.T, rate), evidence.withColumnRenamed("start_us", "at_us"), refine.T, rate), "acoustic")
        estimates = held(C.estimates(C.pitch_frames(sound, refine.T, rate), primary, refine.T, rate), "estimates")
    notes, counters = refine.refine_counted(primary, evidence, acoustic, estimates)
    if args.intro_end:
        notes = refine.with_intro(notes, evidence, round(args.intro_end * 1e6))
    second = lambda c, name: F.bround(c / 1e6, 3).alias(name)
    K.write_document(notes.select(second(F.col("start_us"), "start"), second(F.col("end_us") - F.col("start_us"), "duration"), "midi", F.bround("conf", 3).alias("confidence"), F.bround("strength", 3).alias("strength")), args.output, "start", "midi")
    found = held(refine.diagnostics(notes, counters).drop("track_id"), "diagnostics")
    if args.report:
        K.write_document(found, args.report)
    r = found.first()
    return json.dumps(r.asDict() if r else {}, indent=2)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronoloom")
    sub = top.add_subparsers(dest="command", required=True)

    def scored(name, run, text):
        p = sub.add_parser(name, help=text)
        p.add_argument("score", help="a score file or a folder of them")
        p.add_argument("--default-bpm", type=float, default=120.0)
        p.add_argument("--no-unfold", action="store_true", help="keep the written order of bars")
        p.set_defaults(run=run)
        return p

    scored("inspect", inspect, "streams of scores, the likeliest melody first").add_argument("--json", action="store_true")
    p = scored("convert", convert, "a score's melody as application notes")
    p.add_argument("--output", required=True, help="a folder for the JSON document")
    p.add_argument("--part", action="append", help="a part's number, id or name; may be repeated")
    p.add_argument("--voice", type=int)
    p.add_argument("--staff", type=int)
    p.add_argument("--offset", type=float, default=0.0)
    p.add_argument("--time-scale", type=float, default=1.0)
    p.add_argument("--transpose", default="auto", help="auto or a whole number from -24 to 24")
    p.add_argument("--audio", help="a WAV file to lay the score onto")
    p.add_argument("--aligner", default="full", choices=sorted(A.ALIGNERS))
    p.add_argument("--report")
    p = sub.add_parser("compare", help="how well a melody matches another")
    p.add_argument("reference")
    p.add_argument("candidate")
    p.add_argument("--tolerance", type=float, default=0.25)
    p.add_argument("--report")
    p.set_defaults(run=compare)
    p = sub.add_parser("refine", help="a transcribed voice by a second reading and the audio")
    p.add_argument("primary", help="events as JSON")
    p.add_argument("evidence", help="the second reading as CSV")
    p.add_argument("--audio", help="a WAV file of the recording")
    p.add_argument("--intro-end", type=float, default=0.0, help="seconds of an instrumental opening")
    p.add_argument("--output", required=True)
    p.add_argument("--report")
    p.set_defaults(run=refined)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    print(args.run(spark or SparkSession.builder.appName("chronoloom").getOrCreate(), args))
    return 0
