"""Continuous archives and capture stations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sigdiff import pipeline, sources
from sigdiff.options import CompareOptions
from sigdiff.pipeline import Standing


#: Files that a micro-batch of an archive has at most; their names go to the driver.
BATCH_FILES = 5000


def archive_stream(spark: SparkSession, path: str, delay: str = "7 days", max_files: int = BATCH_FILES) -> DataFrame:
    """Files as they arrive (path, ts, length, content_hash), each content once: a file with the bytes of one seen within the delay is dropped. Contents are hashed where they are read and go no further."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).load(path)
    hashed = files.select("path", F.col("modificationTime").alias("ts"), "length", F.sha2("content", 256).alias("content_hash"))
    return hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_compare(stream: DataFrame, compare: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """What compare makes of each micro-batch, by table in a folder a batch.

    A batch that is run again, as after a lost driver, replaces its own folders, so each batch counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        for name, table in compare(batch).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compare_archive(spark: SparkSession, path: str, describe: Callable[[DataFrame], DataFrame], standing: Standing, modes: DataFrame, types: DataFrame, o: CompareOptions, out: str, checkpoint: str, profiles: DataFrame | None = None, delay: str = "7 days", max_files: int = BATCH_FILES) -> StreamingQuery:
    """Every recording that arrives below path is compared with all standing references of its profile. Tables: bounds, matched, missing, extra, warnings and rejects.

    describe adds profile_id and mode_no to recordings (recording_id, path and facts). A batch reads its own files again by their names; references are neither searched nor transformed again.
    """
    stream = archive_stream(spark, path, delay, max_files)

    def run(batch: DataFrame) -> dict[str, DataFrame]:
        names = [r["path"] for r in batch.select("path").collect()]  # no more than max_files
        if not names:
            return {}
        recordings, files, rejects = sources.recording_files(spark, path, only=names)
        own = describe(recordings)
        refs = standing.recordings.select(F.col("recording_id").alias("ref_id"), "profile_id")
        pairs = own.select(F.col("recording_id").alias("comp_id"), "profile_id").join(refs, "profile_id").select(F.concat_ws("-", "ref_id", "comp_id").alias("pair_id"), "ref_id", "comp_id")
        found = pipeline.compare_recordings(own, files, modes, types, pairs, o, profiles=profiles, standing=standing)
        new = found.bounds.join(own.select("recording_id"), "recording_id", "left_semi")
        return {"bounds": new, "matched": found.matched, "missing": found.missing, "extra": found.extra, "warnings": found.warnings, "rejects": rejects}

    return stream_compare(stream, run, out, checkpoint)


def live_levels(stream: DataFrame, interval: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Peak and floor per source and window. stream: source, ts, level."""
    w = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return stream.withWatermark("ts", delay).groupBy("source", w.alias("w")).agg(F.count("*").alias("n"), F.max("level").alias("peak"), F.min("level").alias("floor"))


def signal_sessions(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """T4: stretches of activity."""
    return stream.withWatermark("ts", delay).groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


TRAIN = "source long, start timestamp, end timestamp"
MACHINE = "on boolean, length long, count long, start timestamp, last timestamp"
BLANK = (False, 0, 0, None, None)


def advance(on, length, count, start, ts, pulse, pulses, longest, rows=1):
    """The train machine over a run of equal observations, the first at ts: the new state, and the start of a train that it completes."""
    done = None
    if pulse == on:
        length += rows
    else:
        if pulse:
            start = ts if count == 0 else start
        else:
            count += 1 if start is not None and length <= longest else 0
            if count == pulses:
                done, count, start = start, 0, None
        on, length = pulse, rows
    if length > longest and (pulse == on) and (rows > 1 or length > 1):
        count, start = 0, None
    return on, length, count, start, done


def follow(state: tuple, runs: Iterable[tuple], pulses: int, longest: int, gap: pd.Timedelta) -> tuple[tuple, list[tuple]]:
    """The machine over runs (pulse, rows, first, last) in order: the state after them, and start and end of each train found. More than gap without a row blanks the state."""
    *machine, last = state
    found = []
    for pulse, rows, first, own_last in runs:
        if last is not None and first - last > gap:
            machine = list(BLANK[:4])
        *machine, done = advance(*machine, first, pulse, pulses, longest, rows)
        last = own_last
        if done is not None:
            found.append((done, first))
    return (*machine, last), found


def observed_runs(df: DataFrame, gap: str) -> DataFrame:
    """W4 of observations (source, ts, pulse): source, pulse, rows, first, last of each run; more than gap between two rows ends one. Of rows of one time and source those without a pulse come first."""
    w = Window.partitionBy("source").orderBy("ts", "pulse")
    apart = ~F.lag("pulse").over(w).eqNullSafe(F.col("pulse")) | (F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {gap}"))
    each = df.withColumn("_n", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("source", "_n", "pulse").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("_n")


def pulse_trains(df: DataFrame, pulses: int, longest: int, gap: str = "1 day") -> DataFrame:
    """T3 in batch form: source, start and end of each train of df (source, ts, pulse). Rows become runs before a source's machine sees them."""
    limit = pd.Timedelta(gap)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["first", "pulse"])
        _, found = follow(BLANK, zip(own["pulse"].astype(bool), own["rows"], own["first"], own["last"], strict=True), pulses, longest, limit)
        return pd.DataFrame([(key[0], *f) for f in found], columns=["source", "start", "end"])

    return observed_runs(df, gap).groupBy("source").applyInPandas(run, TRAIN)


def in_runs(rows: pd.DataFrame, gap: pd.Timedelta) -> list[tuple]:
    """The same runs of rows (ts, pulse) in any order."""
    own = rows.sort_values(["ts", "pulse"])
    if own.empty:
        return []
    number = ((own["pulse"] != own["pulse"].shift()) | (own["ts"].diff() > gap)).cumsum()
    made = own.groupby(number, sort=True).agg(pulse=("pulse", "first"), rows=("ts", "size"), first=("ts", "first"), last=("ts", "last"))
    return [(bool(r.pulse), int(r.rows), r.first, r.last) for r in made.itertuples(index=False)]


class TrainFinder(StatefulProcessor):
    """Per source: the machine's state, and the rows that the watermark has not passed, since earlier ones may still come. A timer at the last of them takes them in order once it has; another one ends a source that has been idle for more than gap."""

    def __init__(self, pulses: int, longest: int, gap: str):
        self.pulses, self.longest, self.gap = pulses, longest, pd.Timedelta(gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", MACHINE)
        self.waiting = handle.getListState("waiting", "ts timestamp, pulse boolean")

    def _take(self, key, watermark: int, more: list[tuple]) -> pd.DataFrame:
        rows = [*self.waiting.get(), *more] if self.waiting.exists() else more
        frame = pd.DataFrame(rows, columns=["ts", "pulse"])
        frame["ts"] = pd.to_datetime(frame["ts"])
        passed = frame["ts"] <= pd.Timestamp(watermark, unit="ms")
        later = frame[~passed]
        if len(later):
            self.waiting.put([(t.to_pydatetime(), bool(p)) for t, p in zip(later["ts"], later["pulse"], strict=True)])
            self.handle.registerTimer(self._ms(later["ts"].max()))
        elif self.waiting.exists():
            self.waiting.clear()
        held = self.machine.get() if self.machine.exists() else BLANK
        held = (*held[:3], *(None if v is None or v is pd.NaT else pd.Timestamp(v) for v in held[3:]))
        held, found = follow(held, in_runs(frame[passed], self.gap), self.pulses, self.longest, self.gap)
        if passed.any():
            self.machine.update((bool(held[0]), int(held[1]), int(held[2]), *(None if v is None else v.to_pydatetime() for v in held[3:])))
            self.handle.registerTimer(self._ms(held[4] + self.gap) + 1)
        return pd.DataFrame([(key[0], *f) for f in found], columns=["source", "start", "end"])

    @staticmethod
    def _ms(ts: pd.Timestamp) -> int:
        return -(-ts.value // 1_000_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(t, bool(p)) for df in rows for t, p in zip(df["ts"], df["pulse"], strict=True)]
        yield self._take(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        yield self._take(key, now, [])
        if self.machine.exists() and not self.waiting.exists() and self._ms(pd.Timestamp(self.machine.get()[4]) + self.gap) < now:
            self.machine.clear()

    def close(self) -> None:
        pass


def live_pulse_trains(stream: DataFrame, pulses: int, longest: int, gap: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """Trains as they end, the same as in batch form for rows in any order that are no later than delay. stream: source, ts, pulse.

    A train is ``pulses`` runs of level, each followed by silence, none of it longer than ``longest`` rows. Needs a state store with timers and lists, RocksDB's.
    """
    return stream.withWatermark("ts", delay).groupBy("source").transformWithStateInPandas(TrainFinder(pulses, longest, gap), TRAIN, "append", "eventtime")
