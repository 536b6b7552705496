"""Readers of notes, evidence, samples and scores from files.

Text formats are read with explicit schemas; binary ones through `binaryFile` and a Python parser
that runs on the executors, one file a row. A bad file fails the query unless a reader says else.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources.scores import Bar, parse_kern, parse_mei, played

MOST_BYTES = 100 << 20
NOTE = "struct<start:double,duration:double,midi:double,confidence:double,strength:double>"
SCORE_NOTE = "path string, start double, duration double, midi int, velocity int, part_index int, part_id string, part_name string, voice int, staff int, is_drum boolean"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files; empty ones and those over 100 MiB are refused."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    ok = F.col("length").between(1, MOST_BYTES)
    return df.select("path", "length", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("empty or too large: "), "path")).cast("binary")).alias("content"))


def event_json(spark: SparkSession, path: str) -> DataFrame:
    """Strict JSON arrays of events: start, end, midi, confidence, strength; the last two default to 0.5."""
    raw = spark.read.schema("start double, duration double, midi double, confidence double, strength double").option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.col("start").isNotNull() & F.col("duration").isNotNull() & F.col("midi").isNotNull() & (F.col("start") >= 0) & (F.col("duration") > 0)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.5)))).alias(c)
    checked = raw.withColumn("start", F.when(ok, F.col("start")).otherwise(F.raise_error(F.lit("an event lacks a valid start, duration or pitch")).cast("double")))
    return checked.select("start", (F.col("start") + F.col("duration")).alias("end"), F.bround("midi").cast("int").alias("midi"), unit("confidence"), unit("strength"))


def melody_json(text: Column) -> Column:
    """The notes of a JSON text: an array, {melody: []} or {analysis: {melody: []}}."""
    return F.coalesce(
        F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{NOTE}>")),
        F.from_json(text, f"melody array<{NOTE}>").getField("melody"),
        F.from_json(text, f"analysis struct<melody:array<{NOTE}>>").getField("analysis").getField("melody"),
    )


def melody_files(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """path and the notes' fields of melody JSON files; a file with fewer than `least` notes raises."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), melody_json(F.col("value")).alias("notes"))
    ok = F.coalesce(F.size("notes"), F.lit(-1)) >= least
    notes = F.when(ok, F.col("notes")).otherwise(F.raise_error(F.concat(F.lit("no melody, or too few notes: "), "path")).cast(f"array<{NOTE}>"))
    return text.select("path", F.posexplode(notes).alias("note_idx", "n")).select("path", "note_idx", "n.*")


_EVIDENCE = "start_time_s double, end_time_s double, pitch_midi double, velocity double"


def evidence_csv(spark: SparkSession, path: str) -> DataFrame:
    """start, end, midi, quality: velocity in percent, 64 where the column is missing; no row is dropped."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    num = lambda c: F.col(c).cast("double")
    velocity = num("velocity") if "velocity" in raw.columns else F.lit(64.0)
    return raw.select(num("start_time_s").alias("start"), num("end_time_s").alias("end"), F.bround(num("pitch_midi")).cast("int").alias("midi"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), velocity / 100)).alias("quality"))


def lead_csv(spark: SparkSession, path: str) -> DataFrame:
    """start, duration, midi, amplitude: velocity over 127; long, high and loud enough rows only, by start, highest first."""
    raw = spark.read.schema(_EVIDENCE).option("header", True).option("mode", "FAILFAST").csv(path)
    rows = raw.select(F.col("start_time_s").alias("start"), (F.col("end_time_s") - F.col("start_time_s")).alias("duration"), F.bround("pitch_midi").cast("int").alias("midi"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("velocity") / 127)).alias("amplitude"))
    return rows.where("duration >= 0.09 and midi between 65 and 96 and amplitude >= 0.35").orderBy("start", F.col("midi").desc())


def parse_wave(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of a 16-bit PCM WAV file, channels averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or body is None or fmt[0] != 1 or fmt[5] != 16:
        raise ValueError("only 16-bit PCM is read")
    x = np.frombuffer(body[: len(body) // (2 * fmt[1]) * 2 * fmt[1]], "<i2").reshape(-1, fmt[1]).astype(np.float32) / 32768
    return fmt[2], x.mean(axis=1)


def wave_files(spark: SparkSession, path: str, rate: int | None = 44_100, shortest: float = 0.0, longest: float = 600.0) -> DataFrame:
    """path, sample_rate, samples of WAV files; a rate or a length out of bounds raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b.path, b.content):
                got, x = parse_wave(c)
                if rate and got != rate or not shortest <= len(x) / got <= longest:
                    raise ValueError(f"{p}: rate or length out of bounds")
                rows.append((p, got, x.tolist()))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"])

    return files(spark, path, "*.[wW][aA][vV]").mapInPandas(run, "path string, sample_rate int, samples array<float>")


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 127, at + 1
        if b < 128:
            return n, at


def parse_midi(data: bytes) -> list[tuple]:
    """(start, duration, midi, velocity, part, name, is_drum) of a standard MIDI file, tempo changes applied."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    tracks, division = struct.unpack(">HH", data[10:14])
    if division & 0x8000:
        raise ValueError("frame-based time is not read")
    at, tempos, raw = 14, [(0, 500_000)], []
    names: dict[int, str] = {}
    for track in range(tracks):
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, tick, status, held = at + 8, 0, 0, {}
        while at < end:
            delta, at = _varlen(data, at)
            tick += delta
            if data[at] & 0x80:
                status, at = data[at], at + 1
            if status == 0xFF:
                kind = data[at]
                size, at = _varlen(data, at + 1)
                if kind == 0x51:
                    tempos.append((tick, int.from_bytes(data[at : at + 3], "big")))
                elif kind == 0x03:
                    names[track] = data[at : at + size].decode("utf-8", "replace")
                at += size
            elif status in (0xF0, 0xF7):
                size, at = _varlen(data, at)
                at += size
            else:
                width = 1 if status >> 4 in (0xC, 0xD) else 2
                a, b = data[at], data[at + 1] if width == 2 else 0
                at += width
                key = (status & 15, a)
                if status >> 4 == 9 and b:
                    held.setdefault(key, []).append((tick, b))
                elif status >> 4 in (8, 9) and held.get(key):
                    t, v = held[key].pop(0)
                    raw.append((t, tick, a, v, track, status & 15))
        at = end
    tempos.sort()
    knots, seconds = [(0, 0.0, 500_000)], 0.0
    for t, us in tempos:
        seconds = knots[-1][1] + (t - knots[-1][0]) * knots[-1][2] / 1e6 / division
        knots = [k for k in knots if k[0] < t] + [(t, seconds, us)]
    ticks = [k[0] for k in knots]

    def when(t: int) -> float:
        k = knots[int(np.searchsorted(ticks, t, "right")) - 1]
        return k[1] + (t - k[0]) * k[2] / 1e6 / division

    parts = {p: k for k, p in enumerate(sorted({(r[4], r[5]) for r in raw}))}
    rows = [(when(a), when(b) - when(a), m, v, parts[tr, ch], names.get(tr, ""), ch == 9) for a, b, m, v, tr, ch in raw if b > a]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def unzipped(data: bytes) -> bytes:
    """The score of a compressed MusicXML file, by its container's first root file; other bytes as they are."""
    if data[:2] != b"PK":
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        name = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        if z.getinfo(name).file_size > MOST_BYTES:
            raise ValueError("the score is too large")
        return z.read(name)


def play_order(measures: list) -> list[int]:
    """Places of measures as they sound: repeats, endings by their numbers, leaps such as D.C. al Fine."""
    bars, now = [], frozenset()
    for m in measures:
        bar, stop = Bar(), False
        for line in m.findall("barline"):
            ending, repeat = line.find("ending"), line.find("repeat")
            if ending is not None:
                if ending.get("type") == "start":
                    now = frozenset(int(n) for n in re.findall(r"\d+", ending.get("number") or ""))
                else:
                    stop = True
            if repeat is not None and repeat.get("direction") == "forward":
                bar.opens = True
            elif repeat is not None:
                bar.closes = int(repeat.get("times") or 2)
        for sound in m.iter("sound"):
            bar.segno |= sound.get("segno") is not None
            bar.coda |= sound.get("coda") is not None
            bar.fine |= sound.get("fine") is not None
            bar.to_coda |= sound.get("tocoda") is not None
            bar.jump = "capo" if sound.get("dacapo") else "segno" if sound.get("dalsegno") else bar.jump
        bar.ends = now
        bars.append(bar)
        now = frozenset() if stop else now
    return played(bars)


def parse_musicxml(data: bytes, default_bpm: float = 120.0, unfold: bool = True) -> list[tuple]:
    """(start, duration, midi, velocity, part, id, name, voice, staff) of partwise MusicXML, plain or zipped.

    Ties are joined; repeats are played where unfold is set, else the written order is kept.
    """
    steps = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
    root = ElementTree.fromstring(unzipped(data))
    names = {p.get("id"): p.findtext("part-name") or "" for p in root.iter("score-part")}
    tempos, notes = [], []
    for k, part in enumerate(root.iter("part")):
        at, last = 0.0, 0.0
        open_ties: dict[tuple, int] = {}
        measures = part.findall("measure")
        units, per = [], 1
        for m in measures:
            units.append(per)
            per = int(m.findtext("attributes/divisions") or per)
        for place in play_order(measures) if unfold else range(len(measures)):
            divisions, furthest = units[place], at
            for e in measures[place]:
                furthest = max(furthest, at)
                if e.tag == "attributes" and e.findtext("divisions"):
                    divisions = int(e.findtext("divisions"))
                elif e.tag in ("sound", "direction"):
                    s = e if e.tag == "sound" else e.find("sound")
                    if s is not None and s.get("tempo"):
                        tempos.append((at, float(s.get("tempo"))))
                elif e.tag in ("backup", "forward"):
                    at += (-1 if e.tag == "backup" else 1) * int(e.findtext("duration")) / divisions
                elif e.tag == "note":
                    length = int(e.findtext("duration") or 0) / divisions
                    start = last if e.find("chord") is not None else at
                    if e.find("chord") is None:
                        last, at = at, at + length
                    pitch = e.find("pitch")
                    if pitch is None or not length:
                        continue
                    midi = 12 * (int(pitch.findtext("octave")) + 1) + steps[pitch.findtext("step")] + int(float(pitch.findtext("alter") or 0))
                    voice, staff = int(e.findtext("voice") or 1), int(e.findtext("staff") or 1)
                    ties = {t.get("type") for t in e.findall("tie")}
                    key = (midi, voice, staff)
                    if "stop" in ties and key in open_ties:
                        notes[open_ties[key]][1] = start + length
                    else:
                        notes.append([start, start + length, midi, 80, k, part.get("id"), names.get(part.get("id"), ""), voice, staff])
                        open_ties[key] = len(notes) - 1
                    if "start" not in ties:
                        open_ties.pop(key, None)
            at = max(furthest, at)
    changes = dict(sorted(tempos)) or {0.0: default_bpm}
    if min(changes) > 0:
        changes[0.0] = default_bpm
    knots, seconds = [], 0.0
    for pos, bpm in sorted(changes.items()):
        if knots:
            seconds += (pos - knots[-1][0]) * 60 / knots[-1][2]
        knots.append((pos, seconds, bpm))

    def when(q: float) -> float:
        k = [x for x in knots if x[0] <= q][-1]
        return k[1] + (q - k[0]) * 60 / k[2]

    return [(when(a), when(b) - when(a), *rest) for a, b, *rest in sorted(notes, key=lambda n: (n[0], n[2]))]


def _midi_rows(path: str, data: bytes):
    for s, du, m, v, p, name, drum in parse_midi(data):
        yield path, s, du, m, v, p, str(p), name, 0, 0, drum


def _xml_rows(path: str, data: bytes, default_bpm: float = 120.0, unfold: bool = True):
    for s, du, m, v, p, pid, name, voice, staff in parse_musicxml(data, default_bpm, unfold):
        yield path, s, du, m, v, p, pid, name, voice, staff, False


def _notated(parse: Callable):
    """Rows of a parser of the same tuples as parse_musicxml()."""

    def rows(path: str, data: bytes, default_bpm: float = 120.0, unfold: bool = True):
        for s, du, m, v, p, pid, name, voice, staff in parse(data, default_bpm, unfold):
            yield path, s, du, m, v, p, pid, name, voice, staff, False

    return rows


_kern_rows, _mei_rows = _notated(parse_kern), _notated(parse_mei)

#: Parsers by extension; register_score_format adds more.
SCORE_FORMATS: dict[str, Callable] = {".krn": _kern_rows, ".kern": _kern_rows, ".mei": _mei_rows, ".mid": _midi_rows, ".midi": _midi_rows, ".musicxml": _xml_rows, ".xml": _xml_rows, ".mxl": _xml_rows}


def register_score_format(extension: str, rows: Callable) -> None:
    """rows(path, bytes) yields tuples of SCORE_NOTE."""
    SCORE_FORMATS[extension.lower()] = rows


def score_files(spark: SparkSession, path: str, default_bpm: float = 120.0, unfold: bool = True) -> DataFrame:
    """Notes of score files by their extension; an unknown one or a note out of range raises.

    Notated scores take default_bpm before their first tempo, and play their repeats unless unfold is unset.
    """
    formats = {k: partial(v, default_bpm=default_bpm, unfold=unfold) if v in (_xml_rows, _kern_rows, _mei_rows) else v for k, v in SCORE_FORMATS.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCORE_NOTE.split(", ")]
        for b in batches:
            rows = []
            for p, c in zip(b.path, b.content):
                kind = p[p.rfind(".") :].lower()
                if kind not in formats:
                    raise ValueError(f"{p}: no reader for {kind}")
                got = list(formats[kind](p, c))
                if not got or any(not (r[1] >= 0 and r[2] > 0 and 0 <= r[3] <= 127) for r in got):
                    raise ValueError(f"{p}: no notes, or one out of range")
                rows += got
            yield pd.DataFrame(rows, columns=names)

    return files(spark, path).mapInPandas(run, SCORE_NOTE)


def _atoms(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the boxes of an MP4 file between two places."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield data[at + 4 : at + 8], at + head, at + size
        at += size


def _mp4_tags(data: bytes) -> dict[str, str]:
    spans = [(0, len(data))]
    for name in (b"moov", b"udta", b"meta", b"ilst"):
        skip = 4 if name == b"meta" else 0
        spans = [(a + skip, b) for lo, hi in spans for n, a, b in _atoms(data, lo, hi) if n == name]
    out: dict[str, str] = {}
    for lo, hi in spans:
        for name, a, b in _atoms(data, lo, hi):
            field = {b"\xa9nam": "title", b"\xa9ART": "artist"}.get(name)
            for kind, x, y in _atoms(data, a, b):
                if field and kind == b"data" and field not in out:
                    out[field] = data[x + 8 : y].decode("utf-8", "replace").strip("\0 ")
    return out


def parse_tags(data: bytes) -> dict[str, str]:
    """title and artist of an ID3v2 header or of an MP4 file's item list, if there is one."""
    out: dict[str, str] = {}
    if data[4:8] == b"ftyp":
        return _mp4_tags(data)
    if data[:3] != b"ID3":
        return out
    big = data[3] >= 4
    size = sum((b & 127) << 7 * k for k, b in enumerate(reversed(data[6:10])))
    at, end = 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at] != 0:
        raw = data[at + 4 : at + 8]
        n = sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw))) if big else int.from_bytes(raw, "big")
        name, body = data[at : at + 4], data[at + 10 : at + 10 + n]
        if name in (b"TIT2", b"TPE1") and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out["title" if name == b"TIT2" else "artist"] = body[1:].decode(code, "replace").strip("\0 ")
        at += 10 + n
    return out


def tagged_files(spark: SparkSession, path: str) -> DataFrame:
    """path, title, artist: tags first, then the file's name."""
    from chronoloom.functions.text import clean_text, file_metadata

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tags = [parse_tags(c) for c in b.content]
            yield pd.DataFrame({"path": b.path, "t": [t.get("title") for t in tags], "a": [t.get("artist") for t in tags]})

    named = files(spark, path).select("path", "content").mapInPandas(run, "path string, t string, a string").withColumn("m", file_metadata(F.col("path")))
    return named.select("path", F.coalesce(clean_text(F.col("t")), clean_text(F.col("m.title"))).alias("title"), F.coalesce(clean_text(F.col("a")), clean_text(F.col("m.artist"))).alias("artist"))


CATALOG = "id string, title string, artist string, fileName string, url string, melodyUrl string, backingUrl string, bpm double, sourceUrl string, sourceLabel string, preview boolean, version string, audioBytes long, audioSha256 string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of catalog files, JSON arrays of tracks; a malformed file or a track without an id, title or version raises."""
    raw = spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("version").isNotNull()
    return raw.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("a track lacks an id, title or version"))))


def with_fallback(songs: DataFrame, stems: DataFrame, generated: Column) -> DataFrame:
    """songs with track and kind: the separated stem if it is there and not empty, else the generated one."""
    met = songs.join(stems.select("id", "stem"), "id", "left")
    usable = F.col("stem").isNotNull() & (F.length("stem") > 0)
    return met.withColumn("track", F.when(usable, F.col("stem")).otherwise(generated)).withColumn("kind", F.when(usable, "stem").otherwise("generated")).drop("stem")


def infer(rows: DataFrame, load: Callable, predict: Callable, schema: str) -> DataFrame:
    """Pluggable inference: load() once for each Python worker's task, predict(model, batch) for each batch.

    No model ships with this package; rows may as well hold features computed elsewhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield predict(model, b)

    return rows.mapInPandas(run, schema)
