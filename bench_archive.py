"""Times whole comparisons of a made-up archive: recordings of a minute, 48 kHz, 16 bits, two channels, each against one reference. Prints one JSON line.

ARCHIVE_RECORDINGS (default 16) and BENCH_CPUS (default 8) may be set.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import time
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigdiff import pipeline, sources
from sigdiff.options import CompareOptions

COUNT, CPUS = int(os.environ.get("ARCHIVE_RECORDINGS", "16")), os.environ.get("BENCH_CPUS", "8")
RATE, MS, HZ = 48000, 16.6884, 8820
LINES = [("sync", -2, 1, 20, "m"), ("silence", -1, 1, 20, "m"), ("user", 1, 96, 20, "S"), ("user", 2, 60, 20, "m"), ("silence", -1, 1, 20, "m"), ("sync", -2, 1, 20, "m")]


def recording(number: int) -> bytes:
    rng = np.random.default_rng(number)
    parts = [np.zeros(int((0.3 + 0.01 * number) * RATE))]
    for kind, _, count, frames, _ in LINES:
        for k in range(count):
            t = np.arange(round(frames * MS / 1000 * RATE)) / RATE
            x = np.zeros(len(t))
            if kind == "sync":
                x = 0.8 * np.sin(2 * np.pi * HZ * t) * ((t * 1000 / MS % 2) < 1)
            elif kind == "user":
                x = sum(0.3 / h * np.sin(2 * np.pi * 55 * 2 ** (k / 16) * h * t) for h in range(1, 9) if 55 * 2 ** (k / 16) * h < 20000)
            parts.append(x)
    x = np.concatenate([*parts, np.zeros(RATE // 2)])
    both = np.stack([x, x * 0.9], 1) * (1 - 0.02 * (number % 9)) + rng.normal(0, 3e-4, (len(x), 2))
    data = np.clip(np.round(both * 30000), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, RATE, RATE * 4, 4, 16) + b"data" + struct.pack("<I", len(data)) + data


def main() -> None:
    base = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.checkpoint.dir", f"file://{base}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for k in range(COUNT + 1):
        Path(base, f"r{k:05d}.wav").write_bytes(recording(k))
    size = sum(f.stat().st_size for f in Path(base).glob("*.wav"))
    types = spark.createDataFrame([("p", i, str(i), *line[:4], 0, line[4]) for i, line in enumerate(LINES)], "profile_id string, ord int, type_name string, kind string, type_id int, elements int, frames int, cut_frames int, channel string")
    modes = spark.createDataFrame([("p", 0, MS, HZ, 14, 10)], "profile_id string, mode_no int, ms_per_frame double, pulse_hz int, pulse_frames int, pulse_count int")
    profiles = spark.createDataFrame([("p", "sync", None, None, None, None, 0, None, None)], "profile_id string, kind string, sync_kind string, clk_block int, clk_hz double, clk_types array<int>, balance_block int, wm_valid_hz int, wm_invalid_hz int")
    took = {}
    for n in (1, COUNT):
        began = time.perf_counter()
        own, files, _ = sources.recording_files(spark, f"{base}/*.wav")
        own = own.withColumn("profile_id", F.lit("p")).withColumn("mode_no", F.lit(0)).where(F.substring("recording_id", 2, 9).cast("int") <= n)
        pairs = own.where("recording_id <> 'r00000'").select(F.concat(F.lit("0-"), "recording_id").alias("pair_id"), F.lit("r00000").alias("ref_id"), F.col("recording_id").alias("comp_id"))
        found = pipeline.compare_recordings(own, files, modes, types, pairs, CompareOptions(), profiles=profiles)
        bins = found.matched.count()
        took[f"{n} pairs"] = {"sec": round(time.perf_counter() - began, 1), "sec_per_pair": round((time.perf_counter() - began) / n, 2), "matched": bins, "ok": found.bounds.where("status = 'ok'").count()}
    print(json.dumps({"metric": "whole comparisons", "mb": round(size / 1e6), "cpus": int(CPUS), "runs": took}))
    spark.stop()


if __name__ == "__main__":
    main()
