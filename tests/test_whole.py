"""Comparisons of made-up archives: every way in which a recording can be found, moved, scaled or refused, and every option."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigdiff import pipeline, samples, search, sources
from sigdiff.options import CompareOptions

MS, HZ, RATE = 20.0, 1000, 8000
O = CompareOptions(start_hz=20, end_hz=2000, top=40)
TYPE = "profile_id string, ord int, type_name string, kind string, type_id int, elements int, frames int, cut_frames int, channel string, mask string, tone_hz int, tone_seconds double"
TONES = [(150, 400, 900), (200, 650, 1100), (250, 500, 1250), (300, 800, 1400)]
SYNC = ("sync", -2, 1, 20, "m")
QUIET = ("silence", -1, 1, 10, "m")
#: Lines of each profile: kind, type, elements, frames, channel, then mask or hertz and seconds of a tone.
PROFILES = {
    "plain": [SYNC, QUIET, ("user", 1, 2, 10, "m"), ("user", 2, 4, 10, "S"), QUIET, SYNC],
    "marked": [SYNC, QUIET, ("user", 1, 2, 10, "m"), QUIET, SYNC, ("internal_sync_unknown", -5, 1, 2, "m", None, 1600, 0.1), ("user", 2, 2, 10, "m"), ("internal_sync_unknown", -5, 1, 2, "m", None, 0, 0.0), ("skip", -6, 1, 5, "m"),
               ("internal_sync", -4, 1, 2, "m", None, 1600, 0.1), ("user", 3, 2, 10, "m"), ("internal_sync", -4, 1, 2, "m", None, 0, 0.0), ("user", 4, 1, 10, "m")],
    "water": [SYNC, QUIET, ("user", 1, 4, 10, "m"), ("watermark", -9, 1, 10, "m"), QUIET, SYNC],
    "masked": [SYNC, QUIET, ("user", 1, 4, 10, "m", "*"), QUIET, SYNC],
    **{f"free{k}": [QUIET, ("user", 1, 4, 10, "m")] if k in "ML" else [("user", 1, 4, 10, "m"), QUIET] for k in "AMLD"},
}


def signal(profile, rate=RATE, ms=MS, lead=0.25, tail=0.3, gains=(1.0, 1.0), pitch=1.0, delays=(), water=0.0, noise=1e-5, weak=1.0):
    """Both channels of a profile's signal; delays: seconds before each marker's tone; pitch: of tones, not of pulses."""
    parts, delays = [np.zeros((int(lead * rate), 2))], list(delays)
    opened = False
    for kind, type_id, count, frames, _, *more in PROFILES[profile]:
        for k in range(count):
            t = np.arange(round(frames * ms / 1000 * rate)) / rate
            x = np.zeros((len(t), 2))
            if kind == "sync":
                x[:] = (weak * np.sin(2 * np.pi * HZ * t) * ((t * 1000 / ms % 2) < 1 - 1e-9))[:, None]
            elif kind in ("user", "watermark"):
                for j, f in enumerate(TONES[(k + type_id) % 4] if kind == "user" else (500 + water,)):
                    x += 0.5 / (1 + j) * np.sin(2 * np.pi * f * pitch * t)[:, None] * ([1.0, 0.2] if type_id == 2 else [1.0, 1.0])
            parts.append(x)
            if kind.startswith("internal"):
                opened = not opened
                if opened:
                    hz, seconds = more[1], more[2]
                    n = int(seconds * rate / 2)
                    wait = int(delays.pop(0) * rate)
                    tone = np.sin(2 * np.pi * hz * np.arange(n) / rate)
                    parts.append(np.repeat(np.concatenate([np.zeros(wait), tone, np.zeros(n)])[:, None], 2, 1))
    x = np.concatenate([*parts, np.zeros((int(tail * rate), 2))])
    return (x + np.random.default_rng(7).normal(0, noise, x.shape)) * gains


def archive(spark, made, pairs, as_chunks=True):
    """made: recording -> (profile, rate, samples)."""
    recordings = spark.createDataFrame([(k, float(r), p, 0, len(x), 16) for k, (p, r, x) in made.items()], "recording_id string, sample_rate double, profile_id string, mode_no int, n_frames long, bits int")
    chunks = [(k, float(r), i, i * r, x[i * r : (i + 1) * r, 0].tolist(), x[i * r : (i + 1) * r, 1].tolist()) for k, (_, r, x) in made.items() for i in range(-(-len(x) // r))]
    chunks = spark.createDataFrame(chunks if as_chunks else [], "recording_id string, sample_rate double, chunk_no long, start_frame long, left array<double>, right array<double>")
    modes = spark.createDataFrame([(p, 0, MS, HZ, 17, 10) for p in PROFILES], "profile_id string, mode_no int, ms_per_frame double, pulse_hz int, pulse_frames int, pulse_count int")
    rows = [(p, i, str(i), kind, t, n, f, 0, c, *(more + [None, None, None])[:3]) for p, lines in PROFILES.items() for i, (kind, t, n, f, c, *more) in enumerate(lines)]
    types = spark.createDataFrame(rows, TYPE)
    kinds = [(p, "nosync" if p.startswith("free") else "sync", p[-1] if p.startswith("free") else None, 2 if p == "plain" else None, 650.0 if p == "plain" else None, [1, 2] if p == "plain" else None, 0, *((500, 700) if p == "water" else (None, None))) for p in PROFILES]
    profiles = spark.createDataFrame(kinds, "profile_id string, kind string, sync_kind string, clk_block int, clk_hz double, clk_types array<int>, balance_block int, wm_valid_hz int, wm_invalid_hz int")
    return recordings, chunks, modes, types, spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "pair_id string, ref_id string, comp_id string"), profiles


def compared(spark, made, pairs, o=O, **more):
    recordings, chunks, modes, types, pairs, profiles = archive(spark, made, pairs)
    return pipeline.compare_recordings(recordings, chunks, modes, types, pairs, o, profiles=profiles, **more)


def worst(found, least=-35):
    return {r.pair_id: (round(r.d, 3), r.n) for r in found.matched.where(f"ref_amplitude > {least}").groupBy("pair_id").agg(F.max(F.abs("diff_amplitude")).alias("d"), F.count("*").alias("n")).collect()}


def lost(found, least=-35):
    return {r.pair_id for df in (found.missing, found.extra) for r in df.where(f"amplitude > {least}").select("pair_id").distinct().collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    made = {
        "m0": ("marked", RATE, signal("marked", delays=(0.0, 0.0))),
        "m1": ("marked", RATE, signal("marked", delays=(0.3125, 0.1))),
        "m2": ("marked", RATE, signal("marked", delays=(0.05, 0.0), lead=0.4)),
        "w0": ("water", RATE, signal("water")),
        "w1": ("water", RATE, signal("water", water=200.0, lead=0.3)),
        **{f"{k}{i}": (f"free{k}", RATE, signal(f"free{k}", lead=0.0 if k in "ML" else 0.2 + 0.1 * i, noise=0 if k == "D" else 1e-5, tail=0.0 if k == "M" else 0.3)) for k in "AMLD" for i in (0, 1)},
        "short": ("freeL", RATE, signal("freeL", lead=0.0)[:4000]),
        "who": ("unknown", RATE, signal("plain")),
        "noise": ("plain", RATE, np.random.default_rng(1).normal(0, 0.1, (20000, 2))),
        "slow": ("plain", RATE, signal("plain", ms=20.5)),
        "p0": ("plain", RATE, signal("plain")),
    }
    pairs = [("m0", "m1"), ("m0", "m2"), ("w0", "w1"), *((f"{k}0", f"{k}1") for k in "AMLD"), ("p0", "who"), ("p0", "noise"), ("p0", "slow"), ("L0", "short")]
    return compared(spark, made, pairs)


def test_every_recording_has_a_status(mixed):
    got = {r.recording_id: r.status for r in mixed.bounds.collect()}
    assert got == {**{k: "ok" for k in ("m0", "m1", "m2", "w0", "w1", "A0", "A1", "M0", "M1", "L0", "L1", "D0", "D1", "p0")}, "short": "too short", "who": "no profile", "noise": "no sync", "slow": "rejected"}
    told = {(r.pair_id, r.warning) for r in mixed.warnings.collect()}
    assert {("p0-who", "comp_not_compared"), ("p0-noise", "comp_no_sync"), ("p0-slow", "comp_not_compared"), ("L0-short", "comp_not_compared"), ("L0-short", "comp_file_too_short")} <= told


def test_recordings_without_sync(mixed):
    start = {r.recording_id: r.start_frame for r in mixed.bounds.collect()}
    assert start["M0"] == start["L0"] == 0
    assert abs(start["D0"] - 0.2 * RATE) <= 1 and start["D1"] - start["D0"] == 800 and abs(start["A0"] - 0.2 * RATE) <= 8 and start["A1"] - start["A0"] == 800
    found = worst(mixed)
    assert all(found[f"{k}0-{k}1"][0] < 0.01 and found[f"{k}0-{k}1"][1] >= 12 for k in "AMLD"), found


def test_markers_inside(mixed):
    got = {(r.recording_id, r.marker): r for r in mixed.delays.collect()}
    assert all(r.found for r in got.values()) and len(got) == 6
    for k, ms in ((("m0", 1), 0), (("m1", 1), 312.5), (("m1", 2), 100), (("m2", 1), 50)):
        assert abs(got[k].delay_ms - ms) < 0.3
    half = int(0.05 * RATE)
    assert abs(got["m1", 1].carried - (2500 + 2 * half)) <= 2 and abs(got["m1", 2].shift - (got["m1", 1].carried + 800 + 2 * half)) <= 2 and got["m1", 2].carried == got["m1", 1].carried
    # all blocks but the one after a known segment, which stays where the layout has it, are found
    found = mixed.matched.where("ref_amplitude > -35 AND type_id < 4").groupBy("pair_id").agg(F.max(F.abs("diff_amplitude")).alias("d"), F.max(F.abs("diff_phase")).alias("p"), F.count("*").alias("n"))
    by = {r.pair_id: r for r in found.collect()}
    assert all(by[p].d < 0.05 and by[p].p < 1 and by[p].n >= 18 for p in ("m0-m1", "m0-m2")), by


def test_waveforms_of_blocks_and_markers(spark, mixed):
    made = {"m1": ("marked", RATE, signal("marked", delays=(0.3125, 0.1)))}
    chunks = archive(spark, made, [("m1", "m1")])[1]
    rows = pipeline.waveform_tables(chunks, mixed, ("sync", "marker"), 40).where("recording_id = 'm1'").collect()
    top = lambda block, slot: max((r.high for r in rows if (r.block_no, r.slot) == (block, slot)), default=None)
    assert top(0, None) > 0.9 and top(1, 1) > 0.9 and top(1, 0) < 0.1 and top(2, 2) < 0.1 and {r.channel for r in rows} == {"l", "r"}
    soft = pipeline.waveform_tables(chunks, mixed, ("sync",), 40, "h").where("recording_id = 'm1' AND block_no = 0 AND part = 0").first()
    assert soft.high < 0.01


def test_watermarks_are_reported_and_not_compared(mixed):
    assert {r.recording_id: r.watermark for r in mixed.watermarks.collect()} == {"w0": "valid", "w1": "invalid"}
    assert ("w0-w1", "comp_watermark_invalid") in {(r.pair_id, r.warning) for r in mixed.warnings.collect()}
    assert not mixed.sides.where("kind <> 'user'").count() and "w0-w1" not in lost(mixed) and worst(mixed)["w0-w1"][0] < 0.01


def test_options_change_results(spark):
    made = {"a": ("plain", RATE, signal("plain")), "b": ("plain", RATE, signal("plain", gains=(0.8, 0.4), lead=0.31)), "fast": ("plain", RATE, signal("plain", pitch=1.005)), "far": ("plain", RATE, signal("plain", ms=20.5))}
    pairs = [("a", "b"), ("a", "fast"), ("a", "far")]
    found = compared(spark, made, pairs)
    assert worst(found)["a-b"][0] < 0.1 and "a-b" not in lost(found) and "a-fast" in lost(found) 
    told = {(r.pair_id, r.warning) for r in found.warnings.collect()}
    assert ("a-b", "comp_imbalance") in told and ("a-b", "ref_imbalance") not in told
    assert abs({r.recording_id: r.imbalance_db for r in found.probes.collect()}["b"] - 6.02) < 0.05
    sets = found.datasets(O)
    assert all(df.count() > 0 for k, df in sets.items() if k not in ("high_difference",)), {k: df.count() for k, df in sets.items()}
    plain = compared(spark, made, pairs, CompareOptions(start_hz=20, end_hz=2000, top=40, balance=False, align_clock=True, clock_seconds=20, ignore_framerate=True, normalise="time"))
    assert worst(plain)["a-b"][0] > 5 and "a-far" in {r.pair_id for r in plain.facts.collect()} and "a-far" not in {r.pair_id for r in found.facts.collect()}
    assert "a-fast" not in lost(plain, -25) and worst(plain, -25)["a-fast"][0] < 1.5, worst(plain, -25)
    scale = {r.pair_id: (r.ref_gain, r.comp_gain) for r in plain.facts.collect()}
    assert abs(scale["a-b"][1] * 0.8 / scale["a-b"][0] - 1) < 0.01
    assert abs({r.pair_id: r.clock_cents for r in plain.pairs.collect()}["a-fast"] - 8.6) < 2


def test_unknown_values_are_refused(spark):
    for wrong in ({"normalise": "loud"}, {"adjust_rates": "all"}, {"window": "x"}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            pipeline.compare_recordings(*[None] * 5, CompareOptions(**wrong))


def test_rates_and_masks(spark):
    made = {"a": ("masked", RATE, signal("masked")), "b": ("masked", RATE, signal("masked", ms=20.15)), "c": ("plain", RATE, signal("plain")), "d": ("plain", RATE, signal("plain", ms=20.04, pitch=1 / 1.002))}
    found = compared(spark, made, [("a", "b"), ("c", "d")], CompareOptions(start_hz=20, end_hz=2000, top=40, adjust_rates="comp"))
    own = {r.recording_id: r for r in found.bounds.collect()}
    assert own["a"].rate == RATE and abs(own["d"].rate - RATE * 1.002) < 1 and abs(own["d"].ms_per_frame - MS) < 1e-6
    assert worst(found, -25)["c-d"][0] < 0.6 and "c-d" not in lost(found, -25)
    trimmed = compared(spark, made, [("a", "b")])
    assert {(r.ref_trim, r.comp_trim) for r in trimmed.pairs.collect()} <= {(0, 11), (0, 12)}
    box = trimmed.spectra.where("kind = 'user'").select("boxsize_ms").distinct().collect()
    assert {r.boxsize_ms for r in box} == {200} and worst(trimmed, -20)["a-b"][0] < 0.2


def wav(x):
    data = np.round(x * 30000).astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 2, RATE, RATE * 4, 4, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def test_files_are_cut_where_they_are_decoded(spark, tmp_path):
    made = {"a": ("plain", RATE, signal("plain")), "b": ("plain", RATE, signal("plain", lead=0.4))}
    for k, (_, _, x) in made.items():
        (tmp_path / f"{k}.wav").write_bytes(wav(x))
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    recordings, files, rejects = sources.recording_files(spark, f"{tmp_path}/*.wav")
    assert {r.recording_id: r.n_frames for r in recordings.collect()} == {k: len(x) for k, (_, _, x) in made.items()} and [r.recording_id for r in rejects.collect()] == ["broken"]
    _, _, modes, types, pairs, profiles = archive(spark, made, [("a", "b")], False)
    own = recordings.withColumn("profile_id", F.lit("plain")).withColumn("mode_no", F.lit(0))
    found = pipeline.compare_recordings(own, files, modes, types, pairs, O, profiles=profiles)
    assert worst(found)["a-b"][0] < 0.05 and {r.status for r in found.bounds.collect()} == {"ok"}
    bounds = spark.createDataFrame([("a", 7, -3, 10, 8000.0), ("a", 8, 100, 50, 8000.0), ("b", 9, len(made["b"][2]) - 4, 9, 8000.0)], "recording_id string, block_no int, start_frame long, n_frames long, sample_rate double")
    at_file, at_chunks = samples.cut(files, bounds), samples.cut(sources.decoded_chunks(files).drop("n_frames"), bounds)
    assert {r.block_no: (r.left, r.right) for r in at_file.collect()} == {r.block_no: (r.left, r.right) for r in at_chunks.collect()}
    plan = at_file._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]


@pytest.mark.parametrize(("rate", "hz"), [(44100, 8820), (48000, 8820), (48000, 2000)])
def test_starts_to_two_samples(spark, rate, hz):
    rng = np.random.default_rng(3)
    length = 0.0166884 * rate
    t = np.arange(int(20 * length)) / rate
    train = np.sin(2 * np.pi * hz * t) * ((t * rate / length) % 2 < 1)
    at = [12345, 12345 + round(60 * length)]
    x = rng.normal(0, 0.003, at[1] + len(t) + 9000)
    for a in at:
        x[a : a + len(t)] += 0.3 * train
    chunks = spark.createDataFrame([("r", i, i * rate, x[i * rate : (i + 1) * rate].tolist(), None) for i in range(-(-len(x) // rate))], "recording_id string, chunk_no long, start_frame long, left array<double>, right array<double>")
    facts = spark.createDataFrame([("r", float(rate), len(x), 16.6884, hz, 14.0, 10, 60)], "recording_id string, sample_rate double, n_frames long, ms_per_frame double, pulse_hz int, pulse_ms double, pulse_count int, sync_frames long")
    row = search.sync_bounds(chunks, facts).first()
    assert abs(row.start_at - at[0]) <= 2 and abs(row.end_at - at[1]) <= 2


def test_damaged_trains_by_tolerance(spark):
    rate, hz = 8000, 1000
    length = 160
    one = np.sin(2 * np.pi * hz * np.arange(length) / rate)
    whole = np.concatenate([np.concatenate([one, np.zeros(length)]) for _ in range(10)])
    gap = np.concatenate([whole[: 4 * 320], np.zeros(320), whole[5 * 320 :]])
    cut = whole[2 * 320 + 60 :]
    rng = np.random.default_rng(5)
    made = {"good": (whole, whole), "weak": (0.02 * whole, 0.01 * whole), "gap": (gap, whole), "cut": (cut, whole), "two": (whole, np.concatenate([whole[:2240], np.zeros(960)]))}
    rows, facts, at = [], [], {}
    for k, (a, b) in made.items():
        lead = 0 if k == "cut" else 900
        x = np.concatenate([np.zeros(lead), a, 0.3 * np.sin(2 * np.arange(4800)), np.zeros(1600), b, np.zeros(4000)])
        at[k] = (lead - (len(whole) - len(cut)) if k == "cut" else lead, lead + len(a) + 9600 - len(whole))
        x += rng.normal(0, 0.002 if k == "weak" else 1e-4, len(x))
        rows += [(k, i, i * rate, x[i * rate : (i + 1) * rate].tolist(), None) for i in range(-(-len(x) // rate))]
        facts.append((k, float(rate), len(x), 20.0, hz, 17.0, 10, 60))
    chunks = spark.createDataFrame(rows, "recording_id string, chunk_no long, start_frame long, left array<double>, right array<double>")
    facts = spark.createDataFrame(facts, "recording_id string, sample_rate double, n_frames long, ms_per_frame double, pulse_hz int, pulse_ms double, pulse_count int, sync_frames long")
    found = {t: {r.recording_id: r for r in search.sync_bounds(chunks, facts, t).collect()} for t in (0, 3)}
    assert set(found[0]) == {"good", "weak"} and set(found[3]) == set(made)
    for k, r in found[3].items():
        assert abs(r.start_at - at[k][0]) <= 4 and abs(r.end_at - at[k][1]) <= 4, (k, r, at[k])
    assert {k: r.sync_tolerance for k, r in found[3].items()} == {"good": 0, "weak": 0, "gap": 1, "cut": 3, "two": 3}


def test_reconstruction_adds_up(spark, tmp_path):
    from sigdiff import rebuild

    made = {"a": ("plain", RATE, signal("plain")), "b": ("plain", 12000, signal("plain", rate=12000, noise=0.001))}
    recordings, chunks, modes, types, pairs, profiles = archive(spark, made, [("a", "b")])
    blocks = pipeline.profile_layout(types, O)
    ends = pipeline.find_bounds(chunks, recordings, modes, blocks, O, profiles).withColumn("rate", F.col("sample_rate"))
    places, _ = pipeline.block_places(chunks, ends, blocks)
    rebuild.write_reconstruction(rebuild.reconstruct_recordings(chunks, ends, places, O), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("recording_id", "part", "channel", "start_frame").collect()
    for k, (_, _, x) in made.items():
        part = {(p, c): np.concatenate([r.samples for r in rows if (r.recording_id, r.part, r.channel) == (k, p, c)]) for p in ("used", "discarded") for c in "lr"}
        for c in "lr":
            assert np.abs(part["used", c] + part["discarded", c] - x[:, "lr".index(c)]).max() < 1e-9
            assert 0 < np.abs(part["discarded", c]).max() < 0.05 and np.abs(part["used", c]).max() > 0.4
