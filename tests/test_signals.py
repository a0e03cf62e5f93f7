import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigdiff import compare, exprs, layout, levels, queries, samples, search, series, sources, spectrum, sync
from sigdiff.options import CompareOptions

RATE = 8000


def wav(x, bits=16, rate=RATE, kind=1):
    x = np.atleast_2d(np.asarray(x, float).T).T
    if kind == 3:
        data = x.astype("<f4" if bits == 32 else "<f8").tobytes()
    elif bits == 24:
        data = b"".join(struct.pack("<i", int(v))[:3] for v in x.ravel())
    else:
        data = ((x + 128).astype("u1") if bits == 8 else x.astype({16: "<i2", 32: "<i4"}[bits])).tobytes()
    c = x.shape[1]
    fmt = struct.pack("<HHIIHH", kind, c, rate, rate * c * bits // 8, c * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data


def test_ingest(spark, tmp_path):
    x = np.round(np.sin(np.arange(RATE * 2 + 5)) * 100)
    files = {"a8": wav(x, 8), "a16": wav(x, 16), "a24": wav(x, 24), "a32": wav(x, 32), "f32": wav(x, 32, kind=3), "f64": wav(x, 64, kind=3), "st": wav(np.stack([x, -x], 1), 16), "bad": b"RIFF....", "six": wav(np.stack([x] * 6, 1), 16)}
    for name, raw in files.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    recordings, chunks, rejects = sources.read_recordings(spark, f"{tmp_path}/*.wav")
    assert {r.recording_id: r.reason for r in rejects.collect()} == {"bad": "no RIFF WAVE header", "six": "only one or two channels"}
    assert {r.n_frames for r in recordings.collect()} == {len(x)} and recordings.count() == 7
    for name in ("a8", "a16", "a24", "a32", "f32", "f64", "st"):
        rows = chunks.where(F.col("recording_id") == name).orderBy("chunk_no").collect()
        assert np.allclose(np.concatenate([r.left for r in rows]), x, atol=1e-3) and [r.start_frame for r in rows] == [0, RATE, 2 * RATE]
    assert np.allclose(chunks.where("recording_id = 'st' AND chunk_no = 0").first().right, -x[:RATE])
    facts = sources.recording_facts(recordings, 20000.0, 5.0).first()
    assert facts.end_hz == RATE / 2 and facts.nyquist_limited and facts.too_short
    assert {r.bits: r.lowest_dbfs for r in sources.full_scale(recordings).collect()}[16] == -96.33


PROFILE = """Profile 2.3 ; version
Own test signal ; what it is
[VideoModes] 2
NTSC 16.6884 262 8820 1 10 ; mode
PAL 20.1205 312.5 8820 1 10
Chip y 3 8000 4.5 1 2
[MonoBalanceBlock] 5   ; a block
[ToneLines] 12
Sync s 1 20 0 red m
Silence n 1 20 0 red m
Tones 1 4 20 -2 blue S *
More 1 2 10 0 blue m
Quiet N 1 9 0 gray m
Wave t 2 6 0 green m
Gap k 1 5 0 red m
Mark W 1 4 aqua m 1000 2000 Old_copy
Start i 1 2 red m 8000 0.300
Noise 3 5 4 -1 orange n
Stop i 1 2 red m 0 0
Sync s 1 20 0 red m
"""


def test_profiles(spark, tmp_path):
    (tmp_path / "own.mfn").write_text(PROFILE)
    head, modes, types, rejects = sources.read_profiles(spark, f"{tmp_path}/*.mfn")
    h = head.first()
    assert (h.name, h.kind, h.version, h.clk_name, h.clk_block, h.clk_hz, h.clk_ratio, h.clk_types, h.balance_block) == ("Own test signal", "sync", "2.3", "Chip", 3, 8000.0, 4.5, [1, 2], 5)
    assert (h.wm_valid_hz, h.wm_invalid_hz, h.wm_name) == (1000, 2000, "Old_copy")
    assert [(m.mode_no, m.mode_name, m.ms_per_frame, m.line_count, m.pulse_hz) for m in modes.orderBy("mode_no").collect()] == [(0, "NTSC", 16.6884, 262.0, 8820), (1, "PAL", 20.1205, 312.5, 8820)]
    rows = types.orderBy("ord").collect()
    want = [("Sync", "sync", -2, 1, 0, "red", "m", None), ("Silence", "silence", -1, 1, 0, "red", "m", None), ("Tones", "user", 1, 4, 2, "blue", "S", "*"), ("More", "user", 1, 2, 0, "blue", "m", None), ("Quiet", "silence_override", -8, 1, 0, "gray", "m", None), ("Wave", "time_domain", -7, 2, 0, "green", "m", None), ("Gap", "skip", -6, 1, 0, "red", "m", None), ("Mark", "watermark", -9, 1, 0, "aqua", "m", None), ("Start", "internal_sync", -4, 1, 0, "red", "m", None), ("Noise", "user", 3, 5, 1, "orange", "n", None), ("Stop", "internal_sync", -4, 1, 0, "red", "m", None), ("Sync", "sync", -2, 1, 0, "red", "m", None)]
    assert [(r.type_name, r.kind, r.type_id, r.elements, r.cut_frames, r.colour, r.channel, r["mask"]) for r in rows] == want
    assert [(r.tone_hz, r.tone_seconds) for r in rows if r.kind == "internal_sync"] == [(8000, 0.3), (0, 0.0)]
    assert layout.block_layout(types).count() == 21 and layout.validate_profiles(types).count() == 0 and rejects.count() == 0
    assert layout.mark_addons(types, False).where("is_addon AND type_id > 0").first().kind == "time_domain"
    assert layout.flatten_balance(types, head).first().balance_block == 2


def test_profile_lines_that_do_not_fit_are_rejects(spark, tmp_path):
    bad = PROFILE.replace("Tones 1 4 20 -2 blue S *", "Tones 1 4 20 blue S").replace("NTSC 16.6884 262 8820 1 10 ; mode", "NTSC fast 262 8820 1 10").replace("Chip y 3 8000 4.5 1 2", "Chip y 3")
    (tmp_path / "bad.mfn").write_text(bad)
    (tmp_path / "old.mfn").write_text(PROFILE.replace("2.3", "2.2").replace("Gap k 1 5 0 red m\n", ""))
    _, _, types, rejects = sources.read_profiles(spark, f"{tmp_path}/*.mfn")
    assert sorted((r.profile_id, r.reason) for r in rejects.collect()) == [("bad", "clock line"), ("bad", "mode line"), ("bad", "type line"), ("old", "number of lines"), ("old", "version")]
    assert types.where("profile_id = 'bad'").count() == 11


def test_profiles_without_sync(spark, tmp_path):
    (tmp_path / "free.mfn").write_text("SomeNoSyncProfile 2.3\nFree\n16.6884\n20.1205\nD\n3\nQuiet n 1 10 red m\nTones 1 4 20 blue S\nMark W 1 4 aqua m 1000 2000 Old\n")
    head, modes, types, rejects = sources.read_profiles(spark, f"{tmp_path}/*.mfn")
    h = head.first()
    assert (h.kind, h.sync_kind, h.balance_block, h.wm_valid_hz) == ("nosync", "D", None, 1000) and rejects.count() == 0
    assert [(m.mode_name, m.ms_per_frame) for m in modes.orderBy("mode_no").collect()] == [("reference", 16.6884), ("comparison", 20.1205)]
    assert [(r.kind, r.colour, r.channel) for r in types.orderBy("ord").collect()] == [("silence", "red", "m"), ("user", "blue", "S"), ("watermark", "aqua", "m")]


def test_ids_of_nested_files_and_long_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.wav").write_bytes(wav(np.arange(50.0)))
    (tmp_path / "a" / "big.wav").write_bytes(wav(np.zeros(5000)))
    recordings, chunks, rejects = sources.read_recordings(spark, f"{tmp_path}/*/*.wav", file_limit=5000)
    assert sorted(r.recording_id for r in recordings.collect()) == ["a/same", "b/same"] and chunks.count() == 2
    assert [(r.recording_id, r.reason) for r in rejects.collect()] == [("a/big", "too long")]


def test_pieces_lie_on_one_grid(spark):
    rate, n = 44100, 44
    x = np.sin(2 * np.pi * 3000 * np.arange(2 * rate + 100) / rate)
    chunks = spark.createDataFrame([("r", k, k * rate, x[k * rate : (k + 1) * rate].tolist()) for k in range(3)], "recording_id string, chunk_no long, start_frame long, left array<double>")
    rows = sync.pulse_chunks(chunks, rate).orderBy("start_frame").collect()
    assert [r.start_frame for r in rows] == [k * n for k in range(len(x) // n)]
    whole = 2 * np.abs(np.fft.rfft(x[: len(x) // n * n].reshape(-1, n), axis=1)) / n
    assert np.allclose([r.magnitude for r in rows], whole[:, 1:22].max(1))


def test_gaps_in_chunks_and_peaks_over_chunk_edges(spark):
    x = np.arange(1.0, 2001.0)
    rows = [("r", k, k * 500, x[k * 500 : (k + 1) * 500].tolist(), (-2 * x[k * 500 : (k + 1) * 500]).tolist()) for k in (0, 2, 3)]
    chunks = spark.createDataFrame(rows, "recording_id string, chunk_no long, start_frame long, left array<double>, right array<double>")
    bounds = spark.createDataFrame([("r", 0, 450, 700), ("r", 1, 5000, 10), ("r", 2, 1990, 20)], "recording_id string, block_no int, start_frame long, n_frames long")
    got = {r.block_no: r for r in samples.cut_blocks(chunks, bounds, 500).collect()}
    assert got[0].left == [*x[450:500], *[0.0] * 500, *x[1000:1150]] and got[0].right[0] == -2 * x[450]
    assert got[1].left == [0.0] * 10 and got[2].left == [*x[1990:2000], *[0.0] * 10]
    around = spark.createDataFrame([("r", 1495, 1000.0)], "recording_id string, frame long, sample_rate double")
    assert samples.local_sample_peak(chunks, around, 500).first().peak == 2 * (1495 + 17 + 1)


def test_bounds_carry_fractions_and_blocks_are_cut(spark):
    seconds = [0.3337] * 7
    rows = [("r", 1000.0, i, s) for i, s in enumerate(seconds)]
    b = layout.block_bounds(spark.createDataFrame(rows, "recording_id string, sample_rate double, block_no int, seconds double")).orderBy("block_no").collect()
    at, carry = 0, 0.0
    for r in b:
        assert (r.start_frame, r.n_frames) == (at, 333)
        carry += 0.7
        at += 333 + int(carry + 1e-9)
        carry -= int(carry + 1e-9)
    x = np.arange(2500.0)
    chunks = spark.createDataFrame([("r", k, k * 500, x[k * 500 : (k + 1) * 500].tolist(), None) for k in range(5)], "recording_id string, chunk_no long, start_frame long, left array<double>, right array<double>")
    bounds = spark.createDataFrame([("r", r.block_no, r.start_frame, r.n_frames) for r in b] + [("r", 99, 2400, 300)], "recording_id string, block_no int, start_frame long, n_frames long")
    got = {r.block_no: r.left for r in samples.cut_blocks(chunks, bounds, 500).collect()}
    assert all(got[r.block_no] == x[r.start_frame : r.start_frame + 333].tolist() for r in b)
    assert got[99] == x[2400:].tolist() + [0.0] * 200
    peak = samples.local_sample_peak(chunks, spark.createDataFrame([("r", 600, 1000.0)], "recording_id string, frame long, sample_rate double"), 500).first()
    assert peak.peak == 617.0


def blocks(spark, signals):
    rows = [(r, b, "l", "user", 1, x.tolist()) for (r, b), x in signals.items()]
    return spark.createDataFrame(rows, "recording_id long, block_no long, channel string, kind string, type_id int, samples array<double>")


def compared(spark, a, b, o=CompareOptions(start_hz=1, end_hz=400, top=50)):
    spec = spectrum.block_spectra(blocks(spark, {(0, 0): a, (1, 0): b}), 1000.0, o)
    pairs = spark.createDataFrame([("p", 0, 1)], "pair_id string, ref_id long, comp_id long")
    zero = levels.pair_zero(pairs, levels.peaks(spec))
    gain = levels.normalise_frequency(pairs, spec).first()
    sides = [spectrum.significant(levels.levels(zero, spec, s), -60, s) for s in ("ref", "comp")]
    return compare.match(*sides), compare.missing(*sides), gain


def tones(*parts, n=1000):
    t = np.arange(n) / 1000
    return sum(a * np.sin(2 * np.pi * f * t) for f, a in parts)


def test_scenarios(spark):
    a = tones((50, 1.0), (120, 0.5), (333, 0.2))
    same, lost, gain = compared(spark, a, a)
    assert same.count() == 3 and lost.count() == 0 and abs(gain.ref_gain - 1) < 1e-9 and same.where("diff_amplitude <> 0").count() == 0
    half, lost, gain = compared(spark, a, a / 2)
    assert lost.count() == 0 and abs(gain.ref_gain - 0.5) < 1e-9
    assert all(abs(r.diff_amplitude + 20 * np.log10(2)) < 1e-6 for r in half.collect())
    _, lost, _ = compared(spark, a, tones((50, 1.0), (120, 0.5)))
    assert [round(r.hertz) for r in lost.collect()] == [333]


def test_spectrum_of_exact_tones_and_windows(spark):
    for kind in "ntfhm":
        o = CompareOptions(window=kind, start_hz=1, end_hz=400, top=1)
        row = spectrum.block_spectra(blocks(spark, {(0, 0): tones((77, 0.25)), (0, 1): np.zeros(1000)}), 1000.0, o).where("block_no = 0").first()
        assert row.hertz == 77
        table = spectrum.window_table(spark.createDataFrame([(64,)], "size int"), kind).first().w
        assert np.allclose(table, spectrum.coefficients(64, kind))


def test_reconstruction_splits_the_band(spark):
    x = tones((50, 1.0), (120, 0.01)) + 0.5
    cut = spark.createDataFrame([(0, 0.1)], "recording_id long, cutoff double")
    got = {r.part: np.array(r.samples) for r in samples.reconstruct(blocks(spark, {(0, 0): x}), cut, 1000.0, 1, 400).collect()}
    assert np.allclose(got["used"], tones((50, 1.0)) + 0.5, atol=1e-9) and np.allclose(got["discarded"], tones((120, 0.01)) + 0.5, atol=1e-9)


def test_balance_scale_and_waveforms(spark):
    rows = [(0, 0, "l", 10, 1.0, 1), (0, 0, "r", 10, 0.5, 1), (1, 0, "l", 10, 1.0, 1), (1, 0, "r", 11, 1.0, 1)]
    got = {r.recording_id: r for r in samples.stereo_balance(spark.createDataFrame(rows, "recording_id long, block_no long, channel string, bin int, magnitude double, rank int")).collect()}
    assert got[0].channel == "l" and got[0].gain == 0.5 and abs(got[0].db - 6.0206) < 1e-3 and got[1].status == "no common bin"
    b = blocks(spark, {(0, 0): np.array([1.0, -4, 2, 3, 9])})
    assert [(r.low, r.high) for r in samples.waveforms(b, 2).orderBy("part").collect()] == [(-4, 1), (2, 3), (9, 9)]
    assert samples.sample_peak(b, ["recording_id"]).first().peak == 9
    balanced = samples.apply_balance(b, spark.createDataFrame([(0, "l", 0.5, "ok")], "recording_id long, channel string, gain double, status string")).first()
    assert balanced.samples == [0.5, -2, 1, 1.5, 4.5]


def test_pulse_train(spark):
    rate, piece = 8000, 8
    pulse = np.sin(2 * np.pi * 2000 * np.arange(16 * piece) / rate) * 10000
    gap = np.zeros(16 * piece)
    x = np.concatenate([np.zeros(4000), *[np.concatenate([pulse, gap]) for _ in range(10)], np.zeros(4000)])
    chunks = spark.createDataFrame([("r", k, k * rate, x[k * rate : (k + 1) * rate].tolist()) for k in range(-(-len(x) // rate))], "recording_id string, chunk_no long, start_frame long, left array<double>")
    pieces = sync.pulse_chunks(chunks, rate)
    assert sync.digital_start(chunks).first().start_frame == 4001  # a sine starts at zero
    assert sync.signal_start(pieces).first().start_frame == 4000
    assert 11 < sync.pulse_threshold(sync.pulse_db(pieces), 2000.0).first().hit_pct < 13
    loud = sync.pulse_db(pieces)
    assert search.signal_start(loud).first().start_frame == 4000
    facts = spark.createDataFrame([("r", 8000.0, len(x), 16.0, 2000.0, 14.0, 10, 20)], FACTS)
    islands = search.tone_islands(chunks.withColumn("right", F.lit(None).cast("array<double>")), facts.select("recording_id", "sample_rate", F.col("pulse_hz").alias("tone_hz"), F.lit(128.0).alias("least"), F.lit(0).alias("from_frame")))
    found = search.opening_train(search.trains(islands, facts, 0), facts.withColumn("sync_frames", F.lit(10)))
    assert [(r.start_frame, r.pulses, r.tolerance) for r in found.collect()] == [(4000, 10, 0)]
    assert sync.signal_start(pieces, 2000.0, 16).first().start_frame == 4000


def test_rates_clock_watermark_and_manual_sync(spark):
    row = sync.frame_rate(spark.createDataFrame([("r", 0, 80100, 48000.0, 100, 16.6884), ("s", 0, 90000, 48000.0, 100, 16.6884)], "recording_id string, start_frame long, end_frame long, sample_rate double, sync_frames int, expected_ms double")).orderBy("recording_id").collect()
    assert [r.status for r in row] == ["ok", "rejected"] and abs(row[0].ms_per_frame - 16.6875) < 1e-9
    spec = spark.createDataFrame([("r", 1, 100.0, 1.0, -5.0), ("r", 2, 220.0, 0.5, -9.0), ("s", 1, 100.0, 1.0, -5.0)], "recording_id string, bin int, hertz double, magnitude double, amplitude double")
    want = spark.createDataFrame([("r", 215.0), ("s", 215.0)], "recording_id string, clk_hz double")
    assert {r.recording_id: (r.clock_hz, r.not_found) for r in sync.clock_hz(spec, want).collect()} == {"r": (220.0, False), "s": (100.0, True)}
    assert {r.watermark for r in sync.watermark_state(spec, 110.0, 900.0, -66.0).collect()} == {"valid"}
    bounds = spark.createDataFrame([("r", 5, 9, "ok"), ("s", 1, 2, "ok")], "recording_id string, start_frame long, end_frame long, status string")
    got = sources.apply_manual_sync(bounds, spark.createDataFrame([("r", 7, 8)], "recording_id string, start_frame long, end_frame long"))
    assert sorted(map(tuple, got.select("recording_id", "start_frame", "status").collect())) == [("r", 7, "manual"), ("s", 1, "ok")]


def test_pairs_and_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "recording_id string, card int")
    assert {x.pair_id for x in sources.make_pairs(r, "all", []).collect()} == {"a-b", "a-c", "b-c"}
    with pytest.raises(ValueError):
        sources.make_pairs(r, "all")
    own = spark.createDataFrame([("c", "a"), ("c", "a"), ("a", "a"), ("a", "zz")], "ref_id string, comp_id string")
    assert [x.pair_id for x in sources.make_pairs(r, "list", listed=own).collect()] == ["c-a"]
    modes = spark.createDataFrame([("p", 0, "NTSC", 16.0), ("p", 1, "PAL", 20.0)], "profile_id string, mode_no int, mode_name string, ms_per_frame double").selectExpr("*", "262.0D AS line_count", "8000 AS pulse_hz", "1 AS pulse_frames", "10 AS pulse_count")
    by_name = sources.resolve_modes(spark.createDataFrame([("p", "pal", "ntsc"), ("p", "secam", "PAL")], "profile_id string, ref_mode string, comp_mode string"), modes, "mode_name").collect()
    assert sorted((x.ref_ms or 0, x.comp_ms) for x in by_name) == [(0, 20.0), (20.0, 16.0)]
    assert {x.pair_id for x in sources.make_pairs(r, "all", ["card"]).collect()} == {"a-b"}
    assert {x.pair_id for x in sources.make_pairs(r, "one_to_many", references=r.where("recording_id = 'b'")).collect()} == {"b-a", "b-c"}
    m = spark.createDataFrame([("p", "user", 1, 5.0, -3.0, 2.0, 0, "l", 0.0), ("p", "user", 1, 6.0, -90.0, 2.0, 0, "l", 3.0)], "pair_id string, kind string, type_id int, hertz double, ref_amplitude double, diff_amplitude double, block_no int, channel string, diff_phase double")
    sources.write_differences(m, -66.0, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    lost = spark.createDataFrame([("p", 0, "l", 7.0, -4.0)], "pair_id string, block_no int, channel string, hertz double, amplitude double")
    report = sources.difference_report(m, lost)
    assert sorted((r.finding, r.hertz, r["rank"]) for r in report.collect()) == [("differing", 5.0, 1), ("differing", 6.0, 2), ("missing", 7.0, 1), ("phase", 6.0, 1)]
    assert {(r.finding, r.n) for r in sources.report_totals(report).where("block_no IS NULL").collect()} == {("differing", 2), ("missing", 1), ("phase", 1)}
    sources.write_block_samples(spark.createDataFrame([("r", 0, [1.0])], "recording_id string, block_no int, samples array<double>"), str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).first().samples == [1.0]


def test_pairs_of_a_large_group_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "PART_ROWS", 20, raising=False)
    rows = [(f"r{k:03d}", "big") for k in range(100)] + [("x", "one"), ("y", "two"), ("z", "two"), ("r007", "big"), (None, "big"), ("u", None), ("v", None)]
    spark.createDataFrame(rows, "recording_id string, card string").coalesce(1).write.parquet(str(tmp_path / "r"))
    found = sources.make_pairs(spark.read.parquet(str(tmp_path / "r")), "all", ["card"])
    got = sorted((r.ref_id, r.comp_id, r.pair_id) for r in found.collect())
    assert got == sorted((a, b, f"{a}-{b}") for a, c in rows for b, d in rows if a and b and c and c == d and a < b)
    a_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(a_task) > 3 and max(a_task) < len(got) / 2


def test_warnings_travel_with_the_recordings(spark):
    rows = [(k, k % 2, k % 3 == 0, None if k == 4 else k % 5 == 1) for k in range(30)]
    facts = spark.createDataFrame(rows, "recording_id long, card int, short boolean, mono boolean")
    pairs = sources.make_pairs(facts, "all", ["card"], carried=["short", "mono"])
    found = series.pair_warnings(pairs, carried=["short", "mono"])
    want = {(f"{a[0]}-{b[0]}", f"{side}_{name}") for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] for side, own in (("ref", a), ("comp", b)) for name, on in (("short", own[2]), ("mono", own[3])) if on}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    joined = series.pair_warnings(pairs.select("pair_id", "ref_id", "comp_id"), facts.select("recording_id", "short", "mono"))
    assert sorted(map(tuple, joined.collect())) == sorted(got)
    assert {t for r in pairs.collect() for t in [(r.ref_id, r.comp_id, r.pair_id)]} == {(a[0], b[0], f"{a[0]}-{b[0]}") for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]}
    with pytest.raises(ValueError):
        sources.make_pairs(facts, "all", [], carried=["short"])


@pytest.mark.parametrize("name", ["d13_warnings", "u11_align_clock"])
def test_nothing_is_joined_to_pairs_of_a_group(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.split("\n") if "Join " in line)
    assert "_low" in top  # the topmost join is that of the pairs


def test_bounds_of_many_blocks_are_running_sums(spark):
    ms = 16.6875
    blocks = spark.range(20000).selectExpr("if(id % 4 = 0, 's', 'r') AS recording_id", "1000.0D AS sample_rate", "CAST(id DIV 4 AS int) AS block_no", f"(id % 51 + 2) * {ms}D / 1000 AS seconds", "id % 4 AS part")
    found = layout.block_bounds(blocks.where("part IN (0, 1)").drop("part"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()  # no recording in one row
    got = {(r.recording_id, r.block_no): (r.start_frame, r.n_frames) for r in found.collect()}
    assert len(got) == 10000
    for name, first in (("s", 0), ("r", 1)):
        sixteenths = 0
        for k in range(5000):
            length = (((4 * k + first) % 51) + 2) * 267
            assert got[name, k] == (sixteenths // 16, length // 16)
            sixteenths += length
    gap = spark.createDataFrame([("r", 1.0, 0, 3.5), ("r", 1.0, 1, None), ("r", 1.0, 2, 2.0), ("r", 2.0, 0, 1.75), ("r", 2.0, 1, 1.0)], "recording_id string, sample_rate double, block_no int, seconds double")
    assert sorted(map(str, map(tuple, layout.block_bounds(gap).collect()))) == sorted(map(str, [("r", 0, 0, 3), ("r", 1, 3, None), ("r", 2, None, 2), ("r", 0, 0, 3), ("r", 1, 3, 2)]))


def test_phase_wraps(spark):
    got = spark.createDataFrame([(170.0, -170.0), (-170.0, 170.0), (10.0, 30.0)], "a double, b double").select(exprs.phase_difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [20.0, -20.0, 20.0]


FACTS = "recording_id string, sample_rate double, n_frames long, ms_per_frame double, pulse_hz double, pulse_ms double, pulse_count int, sync_frames long"


def train(rate=8000, hz=2000):
    pulse = np.sin(2 * np.pi * hz * np.arange(128) / rate) * 10000
    return np.concatenate([np.concatenate([pulse, np.zeros(128)]) for _ in range(10)])


def chunked(spark, x, rate=8000):
    return spark.createDataFrame([("r", k, k * rate, x[k * rate : (k + 1) * rate].tolist(), None) for k in range(-(-len(x) // rate))], "recording_id string, chunk_no long, start_frame long, left array<double>, right array<double>")


def test_sync_and_markers_over_chunk_edges(spark):
    rate, t = 8000, train()
    tone = np.sin(2 * np.pi * 1000 * np.arange(800) / rate) * 10000
    x = np.concatenate([np.zeros(4000), t, np.zeros(8000), tone, np.zeros(8000), t, np.zeros(4000)])
    chunks = chunked(spark, x)
    facts = spark.createDataFrame([("r", 8000.0, len(x), 16.0, 2000.0, 14.0, 10, (len(t) + 16800) // 128)], FACTS)
    found = search.sync_bounds(chunks, facts).first()
    assert abs(found.start_at - 4000) <= 1 and abs(found.end_at - 4000 - len(t) - 16800) <= 1
    at = 4000 + len(t) + 7600
    markers = spark.createDataFrame([("r", 8000.0, 1, at, 1000.0, 800, False), ("r", 8000.0, 2, at + 100, 1000.0, 800, True)], "recording_id string, sample_rate double, marker int, search_frame long, tone_hz double, half long, known boolean")
    tones = search.tone_islands(chunks, markers.select("recording_id", "sample_rate", "tone_hz", F.lit(800.0).alias("least"), F.lit(at).alias("from_frame")).distinct())
    rows = search.marker_shifts(search.exact_tones(chunks, tones, markers), markers).orderBy("marker").collect()
    assert abs(rows[0].delay - 400) <= 1 and abs(rows[0].shift - 2000) <= 2 and rows[0].carried == rows[0].shift and rows[0].found
    # the next one is looked for behind that, where there is none
    assert (rows[1].found, rows[1].shift, rows[1].carried) == (False, rows[0].carried, rows[0].carried)
    moved = search.shifted_bounds(spark.createDataFrame([("r", b, b * 100, m, i) for b, m, i in ((0, 0, False), (1, 1, True), (2, 1, False))], "recording_id string, block_no int, start_frame long, marker int, inside boolean"), spark.createDataFrame([("r", 1, 7, 3)], "recording_id string, marker int, shift long, carried long"))
    assert [r.start_frame for r in moved.orderBy("block_no").collect()] == [0, 107, 203]
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, comp_id string")
    row = sync.align_clock(pairs, spark.createDataFrame([("a", 100.0), ("b", 125.0)], "recording_id string, clock_hz double")).first()
    assert (row.ref_factor, row.comp_factor) == (1.0, 0.8)


def test_closing_train_is_the_nearest_of_the_tail_not_the_first(spark):
    t = train()
    x = np.concatenate([np.zeros(4000), t, np.zeros(12000), t, np.zeros(4000), t, np.zeros(4000), t, np.zeros(4000)])
    facts = spark.createDataFrame([("r", 8000.0, len(x), 16.0, 2000.0, 14.0, 10, (2 * len(t) + 16000) // 128)], FACTS)
    row = search.sync_bounds(chunked(spark, x), facts).first()
    assert abs(row.start_at - 4000) <= 1 and abs(row.end_at - 4000 - 2 * len(t) - 16000) <= 1


def test_nearest_bin_is_what_its_query_checks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sigdiff import queries

    monkeypatch.setattr(queries.u, "nearest_bin", lambda *a: F.lit(-1.0))
    assert {r.hz for r in queries.queries()["j7_nearest_bin"](spark, "/root/testdata/sf0.001").collect()} == {-1.0}


def test_thresholds_of_every_case(spark):
    """Hits of mean m and sd s, and other pieces, for each case of both searches."""
    cases = [(False, 20, 5, 50, 0), (False, 20, 5, 3, 0.5), (False, 12, 15, 50, 0.25), (False, 5, 2, 50, 2), (False, 50, 5, 50, -1), (False, 45, 60, 50, -0.5), (True, 20, 5, 100, 0.25), (True, 20, 5, 95, 0), (True, 20, 5, 70, 0), (True, 15, 20, 70, 0.25), (True, 50, 5, 70, -1), (True, 45, 60, 70, -0.5), (True, 20, 5, 30, 1), (True, 15, 20, 30, 0.25)]
    for detail, mean, sd, pct, k in cases:
        n = 20
        x = np.linspace(-1, 1, n) if mean >= sd * 1.6 else np.array([-0.3] * (n - 2) + [2.7] * 2)
        x = (x - x.mean()) / x.std(ddof=1) * sd + mean
        others = round(n * 100 / pct) - n
        rows = [("r", 1000.0, -float(abs(v))) for v in x] + [("r", 440.0, -3.0)] * others
        got = sync.pulse_threshold(spark.createDataFrame(rows, "recording_id string, hertz double, amplitude double"), 1000.0, detail=detail).first()
        level = np.abs(x)
        assert np.isclose(got.threshold_db, -(level.mean() + k * level.std(ddof=1))), (detail, mean, sd, pct)
    one = spark.createDataFrame([("r", 1000.0, -3.0), ("r", 5.0, -3.0)], "recording_id string, hertz double, amplitude double")
    assert sync.pulse_threshold(one, 1000.0).first().threshold_db == 0


def test_refined_start_is_centred():
    rate, hz, n = 8000, 1000.0, 400
    x = np.zeros(1200)
    x[500:900] = np.sin(2 * np.pi * hz * np.arange(n) / rate) * np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / 60)
    assert abs(search.pulse_edges(x, rate, hz, n, 480)[0] - 500) <= 4
    assert search.pulse_edges(np.zeros(1200), rate, hz, n, 480) is None and search.pulse_edges(np.ones(9), rate, hz, n, 0) is None


def test_levels_rules(spark):
    rows = [("a", -50.0, -90.0, -60.0, -10.0), ("b", -100.0, -70.0, -10.0, -10.0), ("c", -100.0, -30.0, -10.0, -10.0), ("d", None, -70.0, -10.0, -10.0), ("e", -35.0, -80.0, -10.0, -10.0)]
    facts = spark.createDataFrame(rows, "pair_id string, ref_floor double, comp_floor double, ref_mean double, comp_mean double")
    got = {r.pair_id: r for r in levels.significance(facts).collect()}
    assert {k: r.significance for k, r in got.items()} == {"a": -66.0, "b": -70.0, "c": -100.0, "d": -66.0, "e": -35.0}
    assert {k for k, r in got.items() if r.ref_floor_too_high} == {"a", "e"} and {k for k, r in got.items() if r.comp_floor_too_high} == {"c"} and {k for k, r in got.items() if r.floors_differ} == {"b"}
    assert {r.significance for r in levels.significance(facts, False).collect()} == {-66.0, -35.0}


def test_second_pass_and_reversed_channels(spark):
    row = lambda r, b, c, k, m, rank: (r, b, c, "user", k, float(k), m, rank)
    rows = [row(0, 0, "l", 100, 9.0, 1), row(0, 0, "l", 300, 0.1, 2), row(0, 1, "l", 50, 8.0, 1), row(0, 1, "r", 50, 1.0, 1), *(row(0, 2, "l", 400 + i, 0.01, 1) for i in range(9))]
    rows += [row(1, 0, "l", 103, 4.5, 1), row(1, 1, "l", 52, 1.0, 1), row(1, 1, "r", 52, 9.0, 1)]
    spec = spark.createDataFrame(rows, "recording_id long, block_no long, channel string, kind string, bin int, hertz double, magnitude double, rank int")
    pairs = spark.createDataFrame([("p", 0, 1)], "pair_id string, ref_id long, comp_id long")
    gain = levels.normalise_frequency(pairs, spec)
    assert [(r.ref_gain, r.second_pass) for r in gain.collect()] == [(0.5, True)]
    flags = levels.normalisation_warnings(pairs, gain, spec).first()
    assert flags.channels_reversed and not flags.means_too_far


def test_small_operators(spark):
    b = blocks(spark, {(0, 0): np.array([1.0, -4.0])})
    scaled = samples.scale_waveforms(b, spark.createDataFrame([(0, 4.0)], "recording_id long, peak double"), 100.0).first().samples
    assert np.allclose(scaled, [100 * 10 ** (-3 / 20) / 4, -100 * 10 ** (-3 / 20)])
    g = samples.time_gains(spark.createDataFrame([("p", 2.0, 4.0, 3.0)], "pair_id string, ref_peak double, comp_peak double, comp_local double"), 100.0).first()
    assert (g.comp_gain, g.ref_gain) == (25.0, 37.5)
    rows = spark.createDataFrame([(1.0, -9.0, -3.0, 2.0), (2.0, -3.0, -9.0, 1.0), (3.0, -5.0, -5.0, 9.0)], "hertz double, ref_amplitude double, comp_amplitude double, diff_amplitude double")
    order = {k: [r.hertz for r in series.ordered(rows, k).collect()] for k in ("ref", "comp", "diff", "hertz")}
    assert order == {"ref": [2, 3, 1], "comp": [1, 3, 2], "diff": [3, 1, 2], "hertz": [1, 2, 3]}
    trimmed = layout.trim_by_framerate(spark.createDataFrame([("*", 10, 16.0, 20.0), (None, 10, 16.0, 20.0)], "mask string, frames int, ref_ms double, comp_ms double")).collect()
    assert [(r.ref_trim, r.comp_trim) for r in trimmed] == [(0.0, 0.04), (0.0, 0.0)]
    bad = layout.validate_profiles(spark.createDataFrame([("p", i, k, t, 1, 5, 0, c, "m") for i, (k, t, c) in enumerate((("sync", -2, "red"), ("user", 1, "blue"), ("user", 1, "mauve"), ("sync", -2, "red")))], "profile_id string, ord int, kind string, type_id int, elements int, frames int, cut_frames int, colour string, channel string"))
    assert {r.rule for r in bad.collect()} == {"known colour", "colour of the type"}


def test_clock_and_balance_spectra(spark):
    rate = 1000.0
    tone = lambda f, k=1.0: (k * np.sin(2 * np.pi * f * np.arange(1000) / rate)).tolist()
    rows = [(0, "p", 0, tone(100), tone(100, 0.5)), (0, "p", 1, tone(50), tone(50))]
    b = spark.createDataFrame(rows, "recording_id long, profile_id string, block_no long, left array<double>, right array<double>")
    own = samples.balance_spectra(b, spark.createDataFrame([("p", 0)], "profile_id string, balance_block int"), rate, 400.0)
    row = samples.stereo_balance(own).first()
    assert row.channel == "l" and abs(row.gain - 0.5) < 1e-6 and abs(exprs_value(spark, row.db) - 100) < 1
    k = b.withColumn("samples", F.slice("left", 1, 700)).withColumn("channel", F.lit("l")).withColumn("kind", F.lit("clock")).withColumn("type_id", F.lit(-10))
    spec = spectrum.clock_spectra(k, spark.createDataFrame([("p", 1)], "profile_id string, clk_block_no long"), rate, 1, 400.0)
    assert {r.block_no for r in spec.select("block_no").distinct().collect()} == {1} and spec.where("rank = 1").first().hertz == 50.0


def exprs_value(spark, db):
    return spark.range(1).select(exprs.imbalance_pct(F.lit(db))).first()[0]


def test_clock_alignment_transforms_again(spark):
    rate = 1000.0
    x = {(0, 0): tones((100, 1.0)), (0, 1): tones((60, 1.0)), (1, 0): tones((125, 1.0)), (1, 1): tones((75, 1.0))}
    rows = [(r, b, "l", "user", 1 + b, s.tolist()) for (r, b), s in x.items()]
    b = spark.createDataFrame(rows, "recording_id long, block_no long, channel string, kind string, type_id int, samples array<double>")
    o = CompareOptions(start_hz=1, end_hz=400, top=1)
    spec = spectrum.block_spectra(b, rate, o)
    pairs = spark.createDataFrame([("p", 0, 1)], "pair_id string, ref_id long, comp_id long")
    aligned = sync.align_clock(pairs, spark.createDataFrame([(0, 100.0), (1, 125.0)], "recording_id long, clock_hz double"))
    got = {(r.side, r.block_no): round(r.hertz) for r in sync.realigned_spectra(b, spec, aligned, rate, o, [1]).collect()}
    assert got == {("ref", 0): 100, ("ref", 1): 60, ("comp", 0): 100, ("comp", 1): 75}
