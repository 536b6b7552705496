"""The commands on files, in process."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import acoustics as C
from chronoloom.plans import commands
from chronoloom.sources import readers as R
from chronoloom.sources import sinks

from test_scores import XML


def document(spark, path):
    return json.loads("\n".join(r.value for r in spark.read.text(str(path), wholetext=True).collect()))


def run(spark, capsys, *argv):
    assert commands.main([str(a) for a in argv], spark) == 0
    return capsys.readouterr().out


def tones(spark, path, notes, seconds, rate=22_050):
    x = np.zeros(round(seconds * rate))
    for start, length, midi in notes:
        t = np.arange(round(length * rate)) / rate
        s = round(start * rate)
        x[s : s + len(t)] += (0.4 * np.minimum(1, t / 0.004) * np.exp(-t / 0.4) * sum(np.sin(2 * np.pi * C.hertz(midi) * k * t) / k for k in (1, 2, 3)))[: max(0, len(x) - s)]
    path.write_bytes(bytes(spark.createDataFrame([(x.tolist(),)], "x array<double>").select(sinks.pcm16(F.col("x"), rate).alias("w")).first().w))


def test_inspect_and_convert(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    score = tmp_path / "in" / "a.musicxml"
    score.write_text(XML)
    text = run(spark, capsys, "inspect", score)
    assert "Auto selection: 0:Voice" in text and len(text.splitlines()) == 4
    assert [r["part_name"] for r in json.loads(run(spark, capsys, "inspect", score, "--json", "--no-unfold"))] == ["Voice", "Bass"]
    said = run(spark, capsys, "convert", score, "--output", tmp_path / "o", "--part", "voice", "--transpose", "24", "--report", tmp_path / "r")
    notes, report = document(spark, tmp_path / "o"), document(spark, tmp_path / "r")[0]
    assert [n["midi"] for n in notes][:4] == [96, 102, 94, 91] and report["notes"] == len(notes) and report["octaveFoldedNotes"] == 0 and "Folded" not in said
    assert "Folded" in run(spark, capsys, "convert", score, "--output", tmp_path / "p", "--staff", "2", "--transpose", "-24")
    for wrong in (["--transpose", "25"], ["--voice", "9"], ["--part", ""]):
        with pytest.raises(Exception, match="transpose must be|no notes"):
            commands.main(["convert", str(score), "--output", str(tmp_path / "q"), *wrong], spark)
    with pytest.raises(ValueError, match="the same"):
        commands.main(["convert", str(score), "--output", str(score)], spark)


def test_convert_onto_a_recording(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    score = tmp_path / "in" / "a.musicxml"
    score.write_text(XML)
    every = [(0.5 + 1.2 * s, 1.1 * d, m, part) for s, d, m, _, part, *_ in R.parse_musicxml(XML.encode())]
    tones(spark, tmp_path / "x.wav", [n[:3] for n in every], 15.5)
    played = [n[:3] for n in every if n[3] == 0]
    run(spark, capsys, "convert", score, "--output", tmp_path / "o", "--part", "voice", "--audio", tmp_path / "x.wav", "--report", tmp_path / "r")
    notes, report = document(spark, tmp_path / "o"), document(spark, tmp_path / "r")[0]
    assert report["pitchShift"] == 0 and [n["midi"] for n in notes] == [m for _, _, m in played]
    off = [abs(n["start"] - s) for n, (s, _, _) in zip(notes, played)]
    assert np.median(off) < 0.3 and all(0.72 <= n["confidence"] <= 0.99 for n in notes)


def test_compare(spark, tmp_path, capsys):
    for name, rows in (("a", [(0, 60), (1, 62), (2, 64), (3, 65)]), ("b", [(0.03, 60), (1.04, 74), (2.08, 63), (4, 70)])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"start": s, "duration": 0.4, "midi": m} for s, m in rows]))
    said = run(spark, capsys, "compare", tmp_path / "a.json", tmp_path / "b.json", "--tolerance", "0.15", "--report", tmp_path / "r")
    assert said.strip() == "coverage=75.0%, precision=75.0%, exact-pitch=33.3%, octave-errors=1, onset-MAE=0.050s"
    assert document(spark, tmp_path / "r")[0]["matched"] == 3
    with pytest.raises(ValueError, match="tolerance"):
        commands.main(["compare", "a", "b", "--tolerance", "0"], spark)


def test_refine(spark, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps([{"start": 0.2, "duration": 0.4, "midi": 61, "confidence": 0.8, "strength": 0.8}, {"start": 0.8, "duration": 1.05, "midi": 64, "confidence": 0.8, "strength": 0.8}]))
    (tmp_path / "e.csv").write_text("start_time_s,end_time_s,pitch_midi,velocity\n0.2,0.6,60,90\n0.8,1.3,64,90\n1.4,1.85,64,90\n")
    tones(spark, tmp_path / "x.wav", [(0.2, 0.45, 60), (0.8, 0.5, 64), (1.4, 0.5, 64)], 2.2)
    said = json.loads(run(spark, capsys, "refine", tmp_path / "p.json", tmp_path / "e.csv", "--audio", tmp_path / "x.wav", "--output", tmp_path / "o", "--report", tmp_path / "r"))
    notes = document(spark, tmp_path / "o")
    assert [(n["start"], n["midi"]) for n in notes] == [(0.2, 60), (0.8, 64), (1.4, 64)]
    assert said == document(spark, tmp_path / "r")[0] and said["semitone_corrections"] == 1 and said["articulations_added"] == 1 and said["output_notes"] == 3 and said["midi_min"] == 60
    plain = json.loads(run(spark, capsys, "refine", tmp_path / "p.json", tmp_path / "e.csv", "--output", tmp_path / "o2", "--intro-end", "0.7"))
    assert plain["output_notes"] == 1 and plain["articulation_candidates"] == 0
