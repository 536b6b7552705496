"""Online scoring of gestures against cues, as a keyed stateful stream and as its batch replay.

Both run the same step over a track's events in order: cues arrive as events when they come into
reach, gestures are matched with the nearest open cue of their string, and cues that nobody played in
time are missed, in the stream by an event-time timer if no event comes. A clock that moves back begins
a new take.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.sequences import fold

PERFECT_US, GOOD_US, MISS_US = 80_000, 180_000, 220_000
#: Gestures of a string closer than this to the last are one; and gestures on a cue after it was played.
THROTTLE_US, COALESCE_US = 38_000, 100_000
#: A clock that moves back by more than this begins a new take.
REWIND_US = 80_000
#: Hits that are remembered.
RECENT = 64
#: Cues are announced so long before they are due.
AHEAD_US = 400_000
#: Where a track's time 0 lies in event time, so that no event is older than a new stream's watermark.
ORIGIN_US = 946_684_800_000_000

FIELDS = ["kind", "at_us", "id", "lane", "chord"]
EVENTS = "track_id long, take long, kind string, at_us long, id long, lane long, chord string"
OUT = "track_id long, take long, cue_id long, gesture_id long, at_us long, shown_us long, grade string, combo int, best int"


def fresh() -> dict:
    """open: for each string its open cues as [due, cue, chord] in order; recent: the last hits as [string, cue, due, at]."""
    return {"open": {}, "last": {}, "combo": 0, "best": 0, "recent": []}


def expire(state: dict, now: int) -> list[tuple]:
    """Misses of the cues whose time is over before now."""
    late = []
    for cues in state["open"].values():
        n = 0
        while n < len(cues) and cues[n][0] + MISS_US < now:
            n += 1
        late += cues[:n]
        del cues[:n]
    if late:
        state["combo"] = 0
    return [(cue, None, due + MISS_US, due + MISS_US, "miss", 0, state["best"]) for due, cue, _ in sorted(late, key=lambda c: c[:2])]


def step(state: dict, kind: str, at: int, ident: int, lane: int, chord: str | None) -> list[tuple]:
    """Apply one event to the state; (cue, gesture, at, shown, grade, combo, best) of what it settles.

    A hit before its cue is due is shown when that is due. A hit with another chord than its cue asks
    for ends the run of hits and leaves the cue open.
    """
    out, key = expire(state, at), str(lane)
    if kind == "cue":
        state["open"].setdefault(key, []).append([at + AHEAD_US, ident, chord])
        return out
    if kind != "hit" or at - state["last"].get(key, -(10**18)) < THROTTLE_US:
        return out
    state["last"][key] = at
    cues = [(abs(at - due), due, cue, asked) for due, cue, asked in state["open"].get(key, ()) if abs(at - due) <= GOOD_US]
    near = min(cues, key=lambda c: c[:3], default=None)
    again = [abs(at - due) for lane_, _, due, hit in state["recent"] if lane_ == key and at - hit < COALESCE_US]
    if near is None or (again and min(again) <= near[0]):
        return out
    off, due, cue, asked = near
    if asked is not None and asked != chord:
        state["combo"] = 0
        return out
    state["open"][key].remove([due, cue, asked])
    state["combo"] += 1
    state["best"] = max(state["best"], state["combo"])
    state["recent"] = [*state["recent"], [key, cue, due, at]][-RECENT:]
    out.append((cue, ident, at, max(at, due), "perfect" if off <= PERFECT_US else "good", state["combo"], state["best"]))
    return out


def play(state: dict, events: Iterable[tuple]) -> Iterator[tuple]:
    for event in events:
        yield from step(state, *event)


def timeline(cues: DataFrame, gestures: DataFrame, end_us: int | None = None) -> DataFrame:
    """EVENTS of both sides, and an end for each track. cues and gestures may have a column chord."""
    chord = lambda df: F.col("chord") if "chord" in df.columns else F.lit(None).cast("string")
    side = lambda df, kind, at, ident, lane: df.select("track_id", F.lit(0).cast("long").alias("take"), F.lit(kind).alias("kind"), at.alias("at_us"), F.col(ident).alias("id"), F.col(lane).cast("long").alias("lane"), chord(df).alias("chord"))
    both = side(cues, "cue", F.col("time_us") - AHEAD_US, "cue_id", "lane").unionByName(side(gestures, "hit", F.col("at_us"), "gesture_id", "string_idx"))
    if end_us is None:
        return both
    zero = F.lit(0).cast("long")
    ends = both.select("track_id", "take").distinct().select("track_id", "take", F.lit("end").alias("kind"), F.lit(end_us).cast("long").alias("at_us"), zero.alias("id"), zero.alias("lane"), F.lit(None).cast("string").alias("chord"))
    return both.unionByName(ends)


def with_takes(events: DataFrame, order: str) -> DataFrame:
    """events with take: a new one where a track's time, in the order they came, moves back by more than REWIND_US."""
    w = W.partitionBy("track_id").orderBy(order)
    back = F.coalesce(F.col("at_us") < F.lag("at_us").over(w) - REWIND_US, F.lit(False)).cast("long")
    return events.withColumn("back", back).withColumn("take", F.sum("back").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("back")


def replay(events: DataFrame) -> DataFrame:
    """The scores of whole takes in one batch: one pass over partitions sorted by take and time."""
    out = OUT.split(", ", 2)[2]
    return fold(events, ["track_id", "take"], ["at_us", "kind", "id"], FIELDS, lambda rows: play(fresh(), rows), out)


def score_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The same scores from a stream of EVENTS; each micro-batch must not be older than the ones before by more than delay."""

    def frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])
        return out.astype({"cue_id": "Int64", "gesture_id": "Int64"})

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else fresh()
        if state.hasTimedOut:
            rows = expire(now, state.getCurrentWatermarkMs() * 1000 - ORIGIN_US)
        else:
            batch = pd.concat(list(pdfs)).sort_values(["at_us", "kind", "id"])
            chords = [c if isinstance(c, str) else None for c in batch.chord]
            rows = list(play(now, zip(batch.kind, map(int, batch.at_us), map(int, batch.id), map(int, batch.lane), chords)))
        state.update((json.dumps(now),))
        due = min((cues[0][0] for cues in now["open"].values() if cues), default=None)
        if due is not None:
            state.setTimeoutTimestamp(max((due + MISS_US + ORIGIN_US) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield frame(key, rows)

    timed = events.withColumn("event_time", F.timestamp_micros(F.col("at_us") + ORIGIN_US)).withWatermark("event_time", delay)
    return timed.groupBy("track_id", "take").applyInPandasWithState(run, OUT, "state string", "append", "EventTimeTimeout")


# ---- takes that the stream opens itself ----------------------------------------------------------

CLOCKED = "track_id long, seq long, kind string, at_us long, id long, lane long, chord string"


def clock_step(state: dict, kind: str, at: int, ident: int, lane: int, chord: str | None) -> list[tuple]:
    """step() for a track whose clock may move back: by more than REWIND_US it opens a new take, which knows nothing of the one before.

    state: take, clock (the last event's time) and play, the take's own state; each result begins with its take.
    """
    if state["clock"] is not None and at < state["clock"] - REWIND_US:
        state.update(take=state["take"] + 1, play=fresh())
    state["clock"] = at
    return [(state["take"], *row) for row in step(state["play"], kind, at, ident, lane, chord)]


def fresh_clock() -> dict:
    return {"take": 0, "clock": None, "play": fresh()}


def replay_clock(events: DataFrame) -> DataFrame:
    """The scores of CLOCKED events in the order of seq, takes found on the way; one pass over sorted partitions."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = fresh_clock()
        for row in rows:
            yield from clock_step(state, *row)

    return fold(events, ["track_id"], ["seq"], FIELDS, run, OUT.split(", ", 1)[1])


def score_clock_stream(events: DataFrame) -> DataFrame:
    """replay_clock() of a stream of CLOCKED events whose micro-batches follow each other in seq; a cue is missed when a later event of its take shows it."""

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else fresh_clock()
        batch = pd.concat(list(pdfs)).sort_values("seq")
        chords = [c if isinstance(c, str) else None for c in batch.chord]
        rows = [(*key, *row) for event in zip(batch.kind, map(int, batch.at_us), map(int, batch.id), map(int, batch.lane), chords) for row in clock_step(now, *event)]
        state.update((json.dumps(now),))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        yield out.astype({"cue_id": "Int64", "gesture_id": "Int64"})

    return events.groupBy("track_id").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


# ---- writes that can be repeated -----------------------------------------------------------------


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def current_revision(spark: SparkSession, path: str) -> int:
    """The last revision begun at path, -1 before the first."""
    return max((int(n.removeprefix("revision-")) for n in _folders(spark, f"{path}/revisions") if n.startswith("revision-")), default=-1)


def begin_revision(spark: SparkSession, path: str) -> int:
    """A new revision of the results at path: from now on writers of earlier ones write nothing more, and readers see the new one only.

    Two that begin at once get different numbers or one of them an error: the marker is created once.
    """
    number = current_revision(spark, path) + 1
    spark.range(1).write.mode("error").parquet(f"{path}/revisions/revision-{number}")
    return number


def write_once(batch: DataFrame, batch_id: int, path: str, revision: int) -> bool:
    """Write a micro-batch under its revision and number, replacing what an earlier try left; False for a revision that is no longer the last."""
    if current_revision(batch.sparkSession, path) != revision:
        return False
    batch.write.mode("overwrite").parquet(f"{path}/data/revision-{revision}/batch-{batch_id}")
    return True


def run_gated(stream: DataFrame, path: str, checkpoint: str, revision: int) -> None:
    """Process what is there in micro-batches by write_once(): a batch that runs again writes nothing twice."""
    write = lambda batch, batch_id: write_once(batch, batch_id, path, revision) and None
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last revision."""
    home = f"{path}/data/revision-{current_revision(spark, path)}"
    parts = [f"{home}/{n}" for n in _folders(spark, home)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def distinct_events(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, delay: str, size: str, *keys: str) -> DataFrame:
    """Counts of tumbling event-time windows; later than the delay is dropped."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), *keys).count()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there in micro-batches into Parquet files, exactly once, and stop."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
