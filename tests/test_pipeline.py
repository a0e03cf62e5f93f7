"""Whole comparisons of made-up recordings: the scenarios that the method is meant for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigdiff import pipeline
from sigdiff.options import CompareOptions

MS, HZ = 20.0, 1000
#: Lines: sync, silence, tones in mono and stereo, silence, sync.
LINES = [("Sync", "sync", -2, 1, 20, "m"), ("Silence", "silence", -1, 1, 10, "m"), ("Mono", "user", 1, 4, 10, "m"), ("Stereo", "user", 2, 4, 10, "S"), ("Silence", "silence", -1, 1, 10, "m"), ("Sync", "sync", -2, 1, 20, "m")]
TONES = [(150, 400, 900), (200, 650, 1100), (250, 500, 1250), (300, 800, 1400)]


def recording(rate, left=1.0, right=1.0, low_pass=None, lead=0.25, ms=MS):
    """Both channels of the scripted signal at any rate, times counted in frames of ms."""
    noise = np.random.default_rng(7)
    parts = [np.zeros((int(lead * rate), 2))]
    at = 0
    stretch = []
    for _, kind, type_id, count, frames, _ in LINES:
        for k in range(count):
            stretch.append((at, frames, kind, type_id, k))
            at += frames
    total = int(round(at * ms / 1000 * rate))
    t = np.arange(total) / rate
    x = np.zeros((total, 2))
    for start, frames, kind, type_id, k in stretch:
        on = (t >= start * ms / 1000 - 1e-9) & (t < (start + frames) * ms / 1000 - 1e-9)
        own = t[on] - start * ms / 1000
        if kind == "sync":
            x[on] = (np.sin(2 * np.pi * HZ * own) * ((own * 1000 / ms % 2) < 1 - 1e-9))[:, None]
        elif kind == "user":
            for j, f in enumerate(TONES[k]):
                gain = 0.5 / (1 + j) * (1 if low_pass is None or f < low_pass else 0.05)
                x[on] += gain * np.sin(2 * np.pi * f * own)[:, None] * ([1.0, 0.2] if type_id == 2 else [1.0, 1.0])
    x += noise.normal(0, 1e-5, x.shape)
    parts += [x, np.zeros((int(0.3 * rate), 2))]
    return np.concatenate(parts) * [left, right]


@pytest.fixture(scope="module")
def tables(spark):
    made = {"plain": (8000, recording(8000)), "again": (8000, recording(8000, lead=0.4)), "quiet": (8000, recording(8000, 0.5, 0.5)), "dull": (8000, recording(8000, low_pass=700)), "other": (12000, recording(12000)), "turned": (8000, recording(8000)[:, ::-1])}
    recordings = spark.createDataFrame([(k, float(r), "p", 0) for k, (r, _) in made.items()], "recording_id string, sample_rate double, profile_id string, mode_no int")
    chunks = [(k, float(r), i, i * r, x[i * r : (i + 1) * r, 0].tolist(), x[i * r : (i + 1) * r, 1].tolist()) for k, (r, x) in made.items() for i in range(-(-len(x) // r))]
    chunks = spark.createDataFrame(chunks, "recording_id string, sample_rate double, chunk_no long, start_frame long, left array<double>, right array<double>")
    modes = spark.createDataFrame([("p", 0, MS, HZ, 17, 10)], "profile_id string, mode_no int, ms_per_frame double, pulse_hz int, pulse_frames int, pulse_count int")
    types = spark.createDataFrame([("p", i, *line[:5], 0, line[5]) for i, line in enumerate(LINES)], "profile_id string, ord int, type_name string, kind string, type_id int, elements int, frames int, cut_frames int, channel string")
    pairs = spark.createDataFrame([(k, "plain", k) for k in made], "pair_id string, ref_id string, comp_id string")
    return recordings, chunks, modes, types, pairs


def test_scenarios(spark, tables):
    o = CompareOptions(start_hz=20, end_hz=2000, top=40)
    found = pipeline.compare_recordings(*tables, o)
    bounds = {r.recording_id: r for r in found.bounds.collect()}
    assert all(r.status == "ok" and abs(r.ms_per_frame - MS) < 0.05 for r in bounds.values())
    assert abs(bounds["plain"].start_frame - 2000) <= 8 and abs(bounds["again"].start_frame - 3200) <= 8
    worst = {r.pair_id: r for r in found.matched.where("ref_amplitude > -40").groupBy("pair_id").agg(F.max(F.abs("diff_amplitude")).alias("most"), F.count("*").alias("n")).collect()}
    loud = found.missing.where("amplitude > -40").groupBy("pair_id").count().collect()
    assert worst["plain"].most < 1e-9 and worst["plain"].n >= 4 * 3 + 8 * 3
    assert worst["again"].most < 0.5 and worst["quiet"].most < 0.5 and worst["other"].most < 0.5, worst
    dull = found.matched.where("pair_id = 'dull' AND ref_amplitude > -40").groupBy((F.col("hertz") < 690).alias("low")).agg(F.avg("diff_amplitude").alias("d")).collect()
    by = {r.low: r.d for r in dull}
    assert abs(by[True]) < 0.5 and -30 < by[False] < -20
    assert not [r for r in loud if r.pair_id in ("plain", "again", "quiet", "other")], loud
    told = {(r.pair_id, r.warning) for r in found.warnings.collect()}
    assert ("turned", "channels_reversed") in told and not any(p in ("plain", "again", "quiet", "other") for p, w in told if w == "channels_reversed")
    shares = {(r.pair_id, r.type_id, r.channel): r.within_pct for r in found.shares(o).collect()}
    assert shares["plain", 1, "l"] == 100 and shares["quiet", 2, "r"] > 60


def test_every_block_is_transformed_once(spark, tables):
    found = pipeline.compare_recordings(*tables, CompareOptions(start_hz=20, end_hz=2000, top=40))
    for df in (found.matched, found.missing, found.extra):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_padding_to_equal_bins(spark, tables):
    o = CompareOptions(start_hz=20, end_hz=2000, top=40, align_hz=1, normalise="none")
    spec = pipeline.compare_recordings(*tables, o).spectra
    assert {r.boxsize_ms for r in spec.select("boxsize_ms").distinct().collect()} == {1000}
