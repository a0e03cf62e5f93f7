"""From recordings and profiles to differences: synchronisation, blocks, spectra once a recording, and the comparison of pairs.

Recordings come as files, which each task decodes where it needs samples, or as chunks of a second. What a pair asks of a recording beyond its own spectra (another rate by the clock, a shorter block by
the frame rate) is a variant of the recording; each distinct variant is transformed once for all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigdiff import compare, layout, levels, samples, search, series, spectrum, sync
from sigdiff.options import CENTS_LIMIT, SIGNIFICANT_DB, CompareOptions, checked
from sigdiff.sources import full_scale
from sigdiff.storage import stored

#: Pairs that are broadcast to spectra; more are joined by shuffle. Tables of profiles, a few hundred rows of text for each kind of machine, are broadcast whole.
BROADCAST_PAIRS = 500_000
ROUTED = ("user", "silence", "watermark")


@dataclass(frozen=True)
class Comparison:
    """Tables of a comparison. All but the last three know recordings by their ids; in spectra, facts and what is made of them recording_id, ref_id and comp_id are 64-bit numbers of recordings or their variants.

    bounds: a row a recording with its status; places: its blocks; delays: what internal synchronisation found; probes: balance and clock of each recording; sides: all significant bins of both sides of the pairs, joined.
    """

    bounds: DataFrame
    places: DataFrame
    delays: DataFrame
    probes: DataFrame
    watermarks: DataFrame
    pairs: DataFrame
    spectra: DataFrame
    facts: DataFrame
    sides: DataFrame
    matched: DataFrame
    missing: DataFrame
    extra: DataFrame
    warnings: DataFrame
    offsets: DataFrame

    def shares(self, o: CompareOptions) -> DataFrame:
        """A15 and A18 of each pair, type and channel."""
        by = ["pair_id", "type_id", "channel"]
        within = compare.share_within(self.matched, o.match_db).select(*by, F.col("total").alias("n_matched"), F.col("pct").alias("within_pct"))
        lost = self.missing.groupBy(*by).agg(F.count("*").alias("n_missing"))
        more = self.extra.groupBy(*by).agg(F.count("*").alias("n_extra"))
        return within.join(lost, by, "full").join(more, by, "full").fillna(0, ["n_matched", "n_missing", "n_extra"])

    def levels(self, side: str) -> DataFrame:
        """One side's significant bins of every pair, with amplitude."""
        amplitude, phase = F.col(f"{side}_amplitude"), F.col(f"{side}_phase")
        return self.sides.where(amplitude.isNotNull()).select(*compare.KEY, "kind", "type_id", "hertz", amplitude.alias("amplitude"), phase.alias("phase"), F.lit(side).alias("recording_id"))

    def datasets(self, o: CompareOptions) -> dict[str, DataFrame]:
        """D1-D3, D5-D7 and D12, the counters and the blocks that differ most, as the options weigh, average and limit them."""
        limit = self.facts.select("pair_id", "significance")
        matched = self.matched.join(limit, "pair_id")
        within, perfect = compare.share_within(self.matched, o.match_db), compare.share_perfect(self.matched)
        side = lambda n: self.levels(n).where("kind = 'user'")
        lost = compare.share_unmatched(side("ref"), self.missing)
        more = compare.share_unmatched(side("comp"), self.extra)
        high = compare.high_difference_blocks(self.sides.join(limit, "pair_id"), F.col("significance"), o.high_difference_db, o.high_difference_pct)
        return {
            "differences": series.difference_series(matched, F.col("significance"), o.weight),
            "averaged": series.averaged_series(matched, F.col("significance"), o.period),
            "spectrogram": series.spectrogram(self.levels("ref")).unionByName(series.spectrogram(self.levels("comp"))),
            "time_spectrogram": series.time_spectrogram(self.levels("ref"), self.offsets),
            "unmatched": series.unmatched_spectrogram(self.missing, self.extra, self.offsets),
            "phase": series.phase_series(self.matched),
            "bars": series.match_bars(within, perfect, lost, more),
            "counters": compare.counters(self.sides),
            "worst": compare.worst_type(within),
            "outside": compare.share_outside(self.matched, o.range_db),
            "range": compare.fit_range(self.matched, o.range_db),
            "high_difference": high,
        }


@dataclass(frozen=True)
class Standing:
    """References that many comparisons share: their recordings, source and stored bounds and spectra, which are not searched for or transformed again."""

    recordings: DataFrame
    source: DataFrame
    bounds: DataFrame
    spectra: DataFrame


def standing_references(recordings: DataFrame, source: DataFrame, modes: DataFrame, types: DataFrame, o: CompareOptions, profiles: DataFrame | None = None) -> Standing:
    """The references' own bounds and spectra, stored. arguments as of compare_recordings."""
    blocks = stored(profile_layout(types, o), "layout")
    found = stored(find_bounds(source, recordings, modes, blocks, o, profiles), "bounds")
    alone = recordings.select(F.col("recording_id").alias("pair_id"), F.col("recording_id").alias("ref_id"), F.col("recording_id").alias("comp_id"))
    ends = _usable(found, alone, o)
    places = stored(block_places(source, ends, blocks)[0], "places")
    probes = stored(probe_recordings(source, places, profiles, o), "probed") if profiles is not None else None
    variants = ends.select("recording_id", F.lit(1.0).alias("factor"), F.lit(0).cast("long").alias("trim"), F.xxhash64("recording_id").alias("variant"))
    spec = stored(recording_spectra(source, places, variants, o, profiles, probes), "spectra")
    return Standing(recordings, source, found, spec)


def profile_layout(types: DataFrame, o: CompareOptions) -> DataFrame:
    """The blocks of each profile."""
    lines = layout.mark_addons(layout.resolve_silence(types), o.use_extra)
    return layout.marked(layout.block_layout(layout.flatten_profile(lines) if o.flatten else lines))


def find_bounds(source: DataFrame, recordings: DataFrame, modes: DataFrame, blocks: DataFrame, o: CompareOptions, profiles: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Where each recording's signal begins and ends, its frame rate and sample rate, and its status. No recording is lost.

    recordings: recording_id, sample_rate, profile_id, mode_no, and n_frames if it is known. profiles (profile_id, kind, sync_kind) tells which have no sync. Pulses may differ from recording to recording. start_frame is where the first sync
    block begins, or without sync the first block; a mode's pulse_frames is the least length of a pulse in milliseconds.
    """
    marks = layout.landmarks(blocks)
    at = lambda which: blocks.join(marks.select("profile_id", F.col(which).alias("block_no")), ["profile_id", "block_no"]).select("profile_id", F.col("frame_offset").alias(which))
    apart = at("first_sync").join(at("last_sync"), "profile_id").select("profile_id", (F.col("last_sync") - F.col("first_sync")).alias("sync_frames"))
    total = blocks.groupBy("profile_id").agg(F.max(F.col("frame_offset") + F.col("frames")).alias("total_frames"))
    own = recordings.select([c for c in ("recording_id", "sample_rate", "profile_id", "mode_no", "n_frames", "bits") if c in recordings.columns])
    if "n_frames" not in own.columns:
        own = own.join(samples.chunks_of(source).groupBy("recording_id").agg(F.max(F.col("start_frame") + F.size("left")).alias("n_frames")), "recording_id", "left")
    timing = modes.select("profile_id", "mode_no", F.col("ms_per_frame").alias("expected_ms"), "pulse_hz", F.col("pulse_frames").cast("double").alias("pulse_ms"), "pulse_count", *(["line_count"] if "line_count" in modes.columns else []))
    own = own.join(timing, ["profile_id", "mode_no"], "left").join(apart, "profile_id", "left").join(total, "profile_id", "left")
    if profiles is None:
        own = own.withColumn("kind", F.lit("sync")).withColumn("sync_kind", F.lit(None).cast("string"))
    else:
        own = own.join(profiles.select("profile_id", "kind", "sync_kind"), "profile_id", "left")
    own = stored(own, "recordings")
    usable = own.where("expected_ms IS NOT NULL AND n_frames > 0 AND total_frames > 0")
    facts = usable.where("kind = 'sync' AND sync_frames > 0 AND pulse_hz > 0").withColumn("ms_per_frame", F.col("expected_ms"))
    ends = search.sync_bounds(source, facts, o.sync_tolerance)
    rates = sync.frame_rate(facts.drop("ms_per_frame").join(ends, "recording_id").withColumn("start_frame", F.col("start_at")).withColumn("end_frame", F.col("end_at")))
    # a distance that is right to a sample is right: no better is known
    exact = F.abs(F.col("end_at") - F.col("start_at") - F.col("sync_frames") * F.col("expected_ms") / 1000 * F.col("sample_rate")) < 1
    for c, value in (("ms_per_frame", F.col("expected_ms")), ("sample_rate_adj", F.col("sample_rate")), ("cents", F.lit(0.0))):
        rates = rates.withColumn(c, F.when(exact, value).otherwise(F.col(c)))
    for c in ("start_frame", "end_frame"):
        rates = rates.withColumn(c, F.floor(F.col(c) + 0.5))
    found = rates.select("recording_id", "start_frame", "end_frame", "sync_tolerance", "ms_per_frame", "cents", "sample_rate_adj", "status")
    free = usable.where("kind = 'nosync'")
    ref = free.select(F.col("recording_id").alias("ref_id"), F.col("n_frames").alias("_n"), F.col("sample_rate").alias("_r"), F.col("expected_ms").alias("_ms"))
    length = F.col("_n") / F.col("_r") * 1000 / F.col("_ms")
    if pairs is not None:
        its = pairs.select("ref_id", F.col("comp_id").alias("recording_id")).where("ref_id <> recording_id").join(ref, "ref_id").groupBy("recording_id").agg(F.min_by(length, "ref_id").alias("ref_frames"))
        refs = pairs.select(F.col("ref_id").alias("recording_id")).distinct().withColumn("_ref", F.lit(True))
        free = free.join(its, "recording_id", "left").join(refs, "recording_id", "left").withColumn("ref_frames", F.when(F.col("_ref").isNull(), F.col("ref_frames")))
    else:
        free = free.withColumn("ref_frames", F.lit(None).cast("double"))
    open_ends = search.free_bounds(source, free)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    found = found.unionByName(open_ends.select("recording_id", "start_frame", "end_frame", none("int", "sync_tolerance"), "ms_per_frame", none("double", "cents"), none("double", "sample_rate_adj"), "status"))
    status = F.when(F.col("expected_ms").isNull() | F.col("kind").isNull() | F.col("total_frames").isNull(), "no profile").when(F.coalesce(F.col("n_frames"), F.lit(0)) <= 0, "no samples").when(F.col("status").isNull(), "no sync").otherwise(F.col("status"))
    out = own.join(found, "recording_id", "left").withColumn("status", status)
    seconds = F.col("n_frames") / F.col("sample_rate")
    out = out.withColumn("file_too_short", F.coalesce(seconds < F.col("total_frames") * F.col("expected_ms") / 1000, F.lit(False)))
    return out.withColumn("rate_differs", F.coalesce(F.abs("cents") >= CENTS_LIMIT, F.lit(False)))


def _adjusted(ends: DataFrame, pairs: DataFrame, o: CompareOptions) -> DataFrame:
    """Rate, the sample rate in use: the file's, or, on the sides that the option names, that which the distance of both trains asks for. A recording that is on both sides is adjusted if either side is named."""
    named = ("ref", "comp") if o.adjust_rates == "both" else (o.adjust_rates,) if o.adjust_rates != "none" else ()
    if not named:
        return ends.withColumn("rate", F.col("sample_rate"))
    roles = pairs.select(F.explode(F.array(*(F.col(f"{n}_id") for n in named))).alias("recording_id")).distinct().withColumn("_named", F.lit(True))
    use = F.col("_named") & F.col("sample_rate_adj").isNotNull() & F.col("status").isin("ok", "manual")
    both = ends.join(roles, "recording_id", "left")
    fixed = sync.correct_rates(both.where(use), True).withColumn("rate", F.col("sample_rate"))
    return fixed.unionByName(both.where(~F.coalesce(use, F.lit(False))).withColumn("rate", F.col("sample_rate"))).drop("_named")


def _usable(ends: DataFrame, pairs: DataFrame, o: CompareOptions) -> DataFrame:
    """Bounds with every column that a comparison reads, frame rates let pass and sample rates adjusted as the options say; stored."""
    if o.ignore_framerate:
        ends = ends.withColumn("status", F.when(F.col("status") == "rejected", "ok").otherwise(F.col("status")))
    for name, value in (("expected_ms", F.col("ms_per_frame")), ("kind", F.lit("sync")), ("sample_rate_adj", F.lit(None).cast("double")), ("file_too_short", F.lit(False)), ("rate_differs", F.lit(False)), ("sync_tolerance", F.lit(0))):
        ends = ends if name in ends.columns else ends.withColumn(name, value)
    return stored(_adjusted(ends, pairs, o), "bounds")


def block_places(source: DataFrame, ends: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recording_id, block_no, start_frame, n_frames, sample_rate, rate and what the layout says) of all blocks that are transformed, and the delays of markers.

    Inside of a segment blocks last as long as the mode says, outside as long as the recording's own frame rate says. n_frames: without the cut frames, which are taken from the end.
    """
    first = blocks.join(layout.landmarks(blocks).select("profile_id", F.col("first_sync").alias("block_no")), ["profile_id", "block_no"]).select("profile_id", F.col("frame_offset").alias("_sync_at"))
    each = ends.where("status IN ('ok', 'manual')").drop("kind").join(blocks, "profile_id").join(first, "profile_id", "left")
    each = each.withColumn("_ms", F.when(F.col("inside"), F.col("expected_ms")).otherwise(F.col("ms_per_frame")))
    timed = each.select("recording_id", F.col("rate").alias("sample_rate"), "block_no", (F.col("frames") * F.col("_ms") / 1000).alias("seconds"))
    at = F.when(F.col("kind_of") == "nosync", 0).otherwise(F.floor(F.coalesce("_sync_at", F.lit(0)) * F.col("ms_per_frame") / 1000 * F.col("rate") + 1e-6))
    zero = ends.withColumnRenamed("kind", "kind_of").join(first, "profile_id", "left").select("recording_id", (F.col("start_frame") - at).alias("_zero"))
    kept = ["recording_id", "block_no", "profile_id", "rate", "sample_rate", "ms_per_frame", "kind", "type_id", F.col("channel").alias("routing"), "frames", "marker", "inside"]
    facts = each.select(*kept, *(F.col(c) for c in ("mask", "tone_hz", "tone_seconds") if c in each.columns), F.floor(F.col("cut_frames") * F.col("_ms") / 1000 * F.col("rate")).cast("long").alias("cut_n"))
    places = layout.block_bounds(timed).join(zero, "recording_id").join(facts, ["recording_id", "block_no"])
    places = places.withColumn("start_frame", F.col("start_frame") + F.col("_zero")).drop("_zero")
    if "tone_hz" not in places.columns:
        return places.withColumn("n_frames", F.col("n_frames") - F.col("cut_n")).drop("cut_n"), None
    places = stored(places, "places")
    half = F.floor(F.col("tone_seconds") * F.col("rate") / 2)
    opening = places.where(F.col("kind").isin(*layout.MARKERS) & ~F.col("inside") & (F.col("tone_hz") > 0))
    markers = opening.select("recording_id", "sample_rate", (F.col("marker") + 1).alias("marker"), (F.col("start_frame") + F.col("n_frames")).alias("search_frame"), F.col("tone_hz").cast("double").alias("tone_hz"), half.cast("long").alias("half"), (F.col("kind") == "internal_sync").alias("known"))
    wanted = markers.groupBy("recording_id", "sample_rate", "tone_hz").agg(F.min("half").cast("double").alias("least"), F.min("search_frame").alias("from_frame"))
    tones = search.exact_tones(source, stored(search.tone_islands(source, wanted), "tones"), markers)
    shifts = stored(search.marker_shifts(tones, markers), "markers")
    moved = search.shifted_bounds(places, shifts)
    delays = shifts.withColumn("delay_ms", F.col("delay") * 1000.0 / F.col("sample_rate")).join(markers.select("recording_id", "marker", "half"), ["recording_id", "marker"])
    return moved.withColumn("n_frames", F.col("n_frames") - F.col("cut_n")).drop("cut_n"), delays


def probe_recordings(source: DataFrame, places: DataFrame, profiles: DataFrame, o: CompareOptions) -> DataFrame:
    """recording_id, imbalance_db, gain_l, gain_r, balance_status, clock_hz, clock_not_found, clock_peak, from each recording's balance block (the first mono block where the profile has 0) and clock block, which alone are cut out."""
    mono = places.where("kind = 'user' AND routing = 'm'").groupBy("profile_id").agg(F.min("block_no").alias("_mono"))
    own = profiles.where("kind = 'sync'").join(mono, "profile_id", "left").select("profile_id", "clk_block", "clk_hz", F.coalesce(F.when(F.col("balance_block") > 0, F.col("balance_block")), "_mono").alias("balance_block"))
    near = places.join(F.broadcast(own), "profile_id").where("block_no = clk_block OR block_no = balance_block")
    blocks = stored(samples.cut(source, near.select("recording_id", "start_frame", "n_frames", "sample_rate", "rate", "profile_id", "block_no", "kind", "type_id", "routing", "clk_block", "clk_hz", "balance_block")), "probes")
    number = F.xxhash64("recording_id")
    known = blocks.select("recording_id").distinct().withColumn("_id", number)
    balance = samples.stereo_balance(samples.balance_spectra(blocks.withColumn("recording_id", number), own.select("profile_id", "balance_block"), "rate", o.end_hz))
    gain = lambda c: F.coalesce(F.when((F.col("status") == "ok") & (F.col("channel") == c), F.col("gain")), F.lit(1.0)).alias(f"gain_{c}")
    balance = balance.select(F.col("recording_id").alias("_id"), F.col("db").alias("imbalance_db"), gain("l"), gain("r"), F.col("status").alias("balance_status"))
    clocked = spectrum.route_channels(blocks.where("block_no = clk_block").withColumn("recording_id", number).withColumn("routing", F.lit("m")))
    spec = spectrum.clock_spectra(clocked, own.select("profile_id", F.col("clk_block").alias("clk_block_no")), "rate", o.clock_seconds, o.end_hz)
    spec = stored(spec, "clocks")
    expected = blocks.where("block_no = clk_block").select(number.alias("recording_id"), "clk_hz").distinct()
    clock = sync.clock_hz(spec, expected).join(sync.clock_levels(spec), "recording_id").select(F.col("recording_id").alias("_id"), "clock_hz", F.col("not_found").alias("clock_not_found"), F.col("peak").alias("clock_peak"))
    return known.join(balance, "_id", "left").join(clock, "_id", "left").drop("_id")


def pair_variants(pairs: DataFrame, ends: DataFrame, places: DataFrame, probes: DataFrame | None, o: CompareOptions) -> DataFrame:
    """Pairs whose sides can be compared, with a factor of the sample rate and frames trimmed off the longest masked block for either side; ref_id and comp_id are names of recordings still.

    A clock that is not within reach of the profile's counts as none.
    """
    side = lambda n: ends.where("status IN ('ok', 'manual')").select(F.col("recording_id").alias(f"{n}_id"), F.col("ms_per_frame").alias(f"{n}_ms"), F.col("rate").alias(f"{n}_rate"), F.col("profile_id").alias(f"{n}_profile"))
    out = pairs.select("pair_id", "ref_id", "comp_id").join(side("ref"), "ref_id").join(side("comp"), "comp_id")
    if o.align_clock and probes is not None:
        clocks = probes.where("clock_hz IS NOT NULL AND NOT clock_not_found").select("recording_id", "clock_hz")
        factors = sync.align_clock(pairs.select("pair_id", "ref_id", "comp_id"), clocks).select("pair_id", "ref_factor", "comp_factor", F.col("cents").alias("clock_cents"))
        out = out.join(factors, "pair_id", "left").fillna(1.0, ["ref_factor", "comp_factor"])
    else:
        out = out.withColumn("ref_factor", F.lit(1.0)).withColumn("comp_factor", F.lit(1.0)).withColumn("clock_cents", F.lit(None).cast("double"))
    if "mask" not in places.columns:
        return out.withColumn("ref_trim", F.lit(0).cast("long")).withColumn("comp_trim", F.lit(0).cast("long"))
    longest = places.where("mask = '*' AND kind = 'user' AND NOT inside").groupBy("profile_id").agg(F.max("frames").alias("frames"))
    trim = layout.trim_by_framerate(out.join(longest.withColumnRenamed("profile_id", "ref_profile"), "ref_profile", "left"))
    # both lengths as the blocks' bounds count them, in whole frames
    size = lambda s, ms: F.floor(F.col("frames") * ms / 1000 * F.col(f"{s}_rate"))
    n = lambda s: F.coalesce(F.when(F.col(f"{s}_trim") > 0, size(s, F.col(f"{s}_ms")) - size(s, F.least("ref_ms", "comp_ms"))), F.lit(0)).cast("long")
    return trim.withColumn("ref_trim", n("ref")).withColumn("comp_trim", n("comp")).drop("frames", "window_seconds")


def _variant(n: str):
    plain = (F.col(f"{n}_factor") == 1) & (F.col(f"{n}_trim") == 0)
    return F.when(plain, F.xxhash64(f"{n}_id")).otherwise(F.xxhash64(f"{n}_id", f"{n}_factor", f"{n}_trim"))


def recording_spectra(source: DataFrame, places: DataFrame, variants: DataFrame, o: CompareOptions, profiles: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """The spectra of all variants of recordings. variants: recording_id, factor, trim and variant, the 64-bit number that spectra know it by.

    Of files no samples are shuffled: each block goes from its file through channel gains and routing to its transform in one task.
    """
    own = places.where(F.col("kind").isin(*ROUTED)).join(variants, "recording_id")
    longest = own.where("mask = '*' AND NOT inside").groupBy("profile_id").agg(F.max("frames").alias("_most")) if "mask" in own.columns else None
    if longest is not None:
        share = F.when((F.col("mask") == "*") & ~F.col("inside"), F.floor(F.col("trim") * F.col("frames") / F.col("_most") + 0.5)).otherwise(0)
        own = own.join(F.broadcast(longest), "profile_id", "left").withColumn("n_frames", F.col("n_frames") - F.coalesce(share, F.lit(0)).cast("long"))
    listed = F.lit(True)
    if profiles is not None and "clk_types" in profiles.columns:
        own = own.join(F.broadcast(profiles.select("profile_id", "clk_types")), "profile_id", "left")
        listed = F.col("clk_types").isNull() | F.array_contains("clk_types", F.col("type_id"))
    # at the other rate a block lasts longer; it is cut to as long as it was, so that both sides have the same bins
    factor = F.when(listed & (F.col("kind") != "silence"), F.col("factor")).otherwise(1.0)
    own = own.withColumn("n_frames", F.when(factor == 1, F.col("n_frames")).otherwise(F.floor(F.col("n_frames") * factor + 0.5))).withColumn("rate", F.col("rate") * factor)
    facts = ["block_no", "start_frame", "n_frames", "sample_rate", "rate", "kind", "type_id", "routing", "variant"]
    if o.balance and probes is not None:
        own = own.join(probes.select("recording_id", "gain_l", "gain_r"), "recording_id", "left").fillna(1.0, ["gain_l", "gain_r"])
        facts += ["gain_l", "gain_r"]
    cut = samples.cut(source, stored(own.select("recording_id", *facts), "blocks"))
    if "gain_l" in facts:
        for side, gain in (("left", "gain_l"), ("right", "gain_r")):
            cut = cut.withColumn(side, F.when(F.col(gain) == 1, F.col(side)).otherwise(F.expr(f"transform({side}, s -> s * {gain})")))
    routed = spectrum.route_channels(cut.drop("recording_id").withColumnRenamed("variant", "recording_id"))
    n = F.size("samples")
    pad = F.lit(0)
    if o.pad_to_longest:
        most = own.groupBy("sample_rate").agg(F.max("n_frames").alias("_longest"))
        routed, pad = routed.join(F.broadcast(most), "sample_rate"), F.col("_longest") - n
    if o.align_hz:
        seconds = F.ceil((n + pad) / F.col("rate") / o.align_hz - 1e-9) * o.align_hz
        pad = F.floor(seconds * F.col("rate") + 0.5) - n
    return spectrum.block_spectra(routed.withColumn("_zeros", pad.cast("int")), "rate", o, "_zeros")


def _time_gains(source: DataFrame, of: DataFrame, ends: DataFrame) -> DataFrame:
    """Gains of both sides from sample peaks; the reference's peak is looked for around its place in the comparison. A gain does the same to a spectrum as to its samples."""
    used = ends.where("status IN ('ok', 'manual')").select("recording_id", "start_frame", "ms_per_frame", "rate", "sample_rate")
    tops = stored(samples.peak_frames(samples.chunks_of(source)), "peaks")
    side = lambda n: tops.join(used, "recording_id").select(F.col("recording_id").alias(f"{n}_id"), *(F.col(c).alias(f"{n}_{c}") for c in ("peak", "frame", "start_frame", "ms_per_frame", "rate", "sample_rate")))
    both = of.select("pair_id", "ref_id", "comp_id").join(side("ref"), "ref_id").join(side("comp"), "comp_id")
    c = F.col
    at = samples.comparison_frame(c("ref_frame"), c("ref_start_frame"), c("comp_start_frame"), c("ref_rate"), c("comp_rate"), c("ref_ms_per_frame"), c("comp_ms_per_frame"))
    reach = F.ceil(c("comp_sample_rate") / 60)
    near = both.select("pair_id", c("comp_id").alias("recording_id"), F.greatest(at - reach, F.lit(0)).cast("long").alias("start_frame"), (2 * reach + 1).cast("long").alias("n_frames"), c("comp_sample_rate").alias("sample_rate"), F.lit(0).alias("block_no"))
    cut = samples.cut(source, stored(near, "near"))
    top = lambda s: F.array_max(F.transform(s, F.abs))
    local = cut.groupBy("pair_id").agg(F.max(F.greatest(top("left"), top("right"))).alias("comp_local"))
    return samples.time_gains(both.join(local, "pair_id"), 1.0).select("pair_id", "ref_gain", "comp_gain")


def _floors(df: DataFrame, noise: DataFrame, lowest: DataFrame, n: str) -> DataFrame:
    """A6-A8 and A4 of one side of the pairs: the loudest silence bin, where blocks of a noise channel exist the quieter of it and their cut-off, and without silence bins 1.2 times the lowest level of the depth."""
    by_pair = df.drop("recording_id").withColumnRenamed("pair_id", "recording_id")
    silence = by_pair.where("kind = 'silence'").groupBy("recording_id").agg(F.max("amplitude").alias("floor_db"), F.max("hertz").alias("floor_hz"))
    cut = levels.noise_cutoff(by_pair.join(noise, ["recording_id", "type_id"], "left_semi"), None).select("recording_id", "cutoff_db")
    known = by_pair.select("recording_id").distinct().join(silence, "recording_id", "left").join(cut, "recording_id", "left").join(lowest, "recording_id", "left")
    floor = F.coalesce(F.least("floor_db", F.coalesce("cutoff_db", "floor_db")), F.floor(1.2 * F.col("lowest_dbfs")).cast("double"))
    loud = by_pair.where("kind = 'user' AND rank = 1").groupBy("recording_id").agg(F.avg("amplitude").alias(f"{n}_mean"))
    return known.select("recording_id", F.when(F.col("floor_db").isNull(), floor).otherwise(F.least("floor_db", F.coalesce("cutoff_db", "floor_db"))).alias(f"{n}_floor")).join(loud, "recording_id", "left").withColumnRenamed("recording_id", "pair_id")


def compare_recordings(recordings: DataFrame, source: DataFrame, modes: DataFrame, types: DataFrame, pairs: DataFrame, o: CompareOptions, bounds: DataFrame | None = None, profiles: DataFrame | None = None, standing: Standing | None = None) -> Comparison:
    """The whole comparison. recordings: recording_id, sample_rate, profile_id, mode_no (and n_frames, bits); source: files (recording_id, content) or chunks of a second; pairs: pair_id, ref_id, comp_id (recording ids).

    profiles: what read_profiles gives; without it there is no clock, balance, watermark or profile without sync. bounds in place of find_bounds(), if given. standing: references that pairs may name beside the recordings.
    """
    o = checked(o)
    blocks = stored(profile_layout(types, o), "layout")
    ends = find_bounds(source, recordings, modes, blocks, o, profiles, pairs) if bounds is None else bounds
    if standing is not None:
        ends = ends.unionByName(standing.bounds, allowMissingColumns=True)
        source = source.unionByName(standing.source, allowMissingColumns=True)
    ends = _usable(ends, pairs, o)
    places, delays = block_places(source, ends, blocks)
    places = stored(places, "places")
    probes = stored(probe_recordings(source, places, profiles, o), "probed") if profiles is not None else None
    used = stored(pair_variants(pairs, ends, places, probes, o).withColumn("ref_variant", _variant("ref")).withColumn("comp_variant", _variant("comp")), "pairs")
    side = lambda n: used.select(F.col(f"{n}_id").alias("recording_id"), F.col(f"{n}_factor").alias("factor"), F.col(f"{n}_trim").alias("trim"), F.col(f"{n}_variant").alias("variant"))
    variants = stored(side("ref").unionByName(side("comp")).distinct(), "variants")
    new = variants if standing is None else variants.join(standing.spectra.select(F.col("recording_id").alias("variant")).distinct(), "variant", "left_anti")
    spec = stored(recording_spectra(source, places, new, o, profiles, probes), "spectra")
    if standing is not None:
        spec = spec.unionByName(standing.spectra)
    of = used.select("pair_id", F.col("ref_variant").alias("ref_id"), F.col("comp_variant").alias("comp_id"))
    audible = spectrum.only(spec, "user", "silence")
    if o.normalise == "frequency":
        gains = levels.normalise_frequency(of, audible).withColumn("comp_gain", F.lit(1.0))
    elif o.normalise == "average":
        gains = levels.normalise_average(of, audible)
    elif o.normalise == "time":
        gains = _time_gains(source, used, ends)
    else:
        gains = of.select("pair_id", F.lit(1.0).alias("ref_gain"), F.lit(1.0).alias("comp_gain"))
    if "ratio_too_high" not in gains.columns:
        gains = gains.withColumn("ratio_too_high", F.lit(False))
    gains = stored(gains, "gains")
    peak = lambda n: levels.peaks(audible).select(F.col("recording_id").alias(f"{n}_id"), F.col("magnitude").alias(f"{n}_peak"))
    zero = of.join(gains.select("pair_id", "ref_gain", "comp_gain"), "pair_id").join(peak("ref"), "ref_id").join(peak("comp"), "comp_id")
    zero = stored(zero.withColumn("zero_db", F.greatest(F.col("ref_peak") * F.col("ref_gain"), F.col("comp_peak") * F.col("comp_gain"))), "zero")
    few = zero.count() <= BROADCAST_PAIRS
    loud = {n: levels.levels(F.broadcast(zero) if few else zero, audible, n, f"{n}_gain") for n in ("ref", "comp")}
    facts = zero.select("pair_id", "ref_id", "comp_id", "zero_db", "ref_gain", "comp_gain")
    if o.ignore_floor:
        for name in ("ref_floor", "comp_floor", "ref_mean", "comp_mean"):
            facts = facts.withColumn(name, F.lit(None).cast("double"))
    else:
        noisy = places.where("routing = 'n' AND kind = 'user'").select("profile_id", "type_id").distinct()
        noise = used.select(F.col("pair_id").alias("recording_id"), F.col("ref_profile").alias("profile_id")).join(F.broadcast(noisy), "profile_id").select("recording_id", "type_id")
        for n, df in loud.items():
            depth = full_scale(ends.where("bits IS NOT NULL")).select("recording_id", "lowest_dbfs") if "bits" in ends.columns else ends.select("recording_id", F.lit(None).cast("double").alias("lowest_dbfs"))
            lowest = used.select("pair_id", F.col(f"{n}_id").alias("recording_id")).join(depth, "recording_id").select(F.col("pair_id").alias("recording_id"), "lowest_dbfs")
            facts = facts.join(_floors(df, noise, lowest, n), "pair_id", "left")
    facts = stored(levels.significance(facts, o.auto_significance).withColumn("significance", F.coalesce("significance", F.lit(SIGNIFICANT_DB))), "facts")
    if not o.auto_significance or o.ignore_floor:
        facts = facts.withColumn("significance", F.lit(o.significance) if o.ignore_floor else F.greatest("significance", F.lit(o.significance)))
    limit = F.broadcast(facts.select("pair_id", "significance")) if few else facts.select("pair_id", "significance")
    heard = {n: spectrum.significant(spectrum.only(df, "user").join(limit, "pair_id"), F.col("significance"), n) for n, df in loud.items()}
    sides = stored(compare.both_sides(heard["ref"], heard["comp"]), "sides")
    matched = compare.of_both(sides)
    missing = compare.unmatched(sides, "ref")
    extra = compare.unmatched(sides.join(limit, "pair_id"), "comp", F.col("significance"))
    if o.recentre:
        matched = compare.recentre(matched)
    marks = watermark_states(spec, variants, ends, profiles, o)
    alone = ends.select("recording_id", (F.col("status") == "no sync").alias("no_sync"), (~F.col("status").isin("ok", "manual", "no sync")).alias("not_compared"), "file_too_short", "rate_differs", (F.coalesce("sync_tolerance", F.lit(0)) > 0).alias("sync_tolerance_used"))
    flags = [facts.select("pair_id", "ref_floor_too_high", "comp_floor_too_high", "floors_differ"), levels.normalisation_warnings(of, gains, audible), gains.select("pair_id", "ratio_too_high"), alone]
    flags.append(marks.select("recording_id", (F.col("watermark") == "invalid").alias("watermark_invalid"), (F.col("watermark") == "unknown").alias("watermark_unknown")))
    if probes is not None:
        flags.append(probes.select("recording_id", F.coalesce("clock_not_found", F.lit(False)).alias("clock_not_found"), (F.coalesce("balance_status", F.lit("ok")) != "ok").alias("balance_not_found"), (F.coalesce(F.abs("imbalance_db"), F.lit(0.0)) >= 0.0001).alias("imbalance")))
    if delays is not None:
        flags.append(delays.groupBy("recording_id").agg((F.count_if(~F.col("found")) > 0).alias("internal_sync_not_found")))
    warned = series.pair_warnings(pairs, *flags)
    offsets = blocks.join(used.select(F.col("ref_profile").alias("profile_id")).distinct(), "profile_id").select("block_no", "frame_offset").distinct()
    return Comparison(ends, places, delays, probes, marks, used, spec, facts, sides, matched, missing, extra, warned, offsets)


def waveform_tables(source: DataFrame, found: Comparison, kinds: tuple[str, ...], k: int, window: str | None = None) -> DataFrame:
    """Least and greatest sample of every k frames of the blocks of some kinds of all recordings that can be compared, under a window if one is named: recording_id, block_no, slot (null but in markers), channel, part, low, high.

    Kind marker stands for what internal synchronisation found: block_no is the marker's number, slot 0 before the tone, 1 the tone, 2 the silence after it.
    """
    none = F.lit(None).cast("int").alias("slot")
    wanted = found.places.where(F.col("kind").isin(*kinds)).select("recording_id", F.col("block_no").cast("long").alias("block_no"), none, "start_frame", "n_frames", "sample_rate")
    if "marker" in kinds and found.delays is not None:
        slots = search.marker_slots(found.delays.drop("half"), found.delays.select("recording_id", "marker", "half"))
        wanted = wanted.unionByName(slots.select("recording_id", F.col("marker").cast("long").alias("block_no"), "slot", "start_frame", "n_frames", "sample_rate"))
    cut = samples.cut(source, stored(wanted, "waves")).withColumn("routing", F.lit("S"))
    sides = spectrum.route_channels(cut)
    sides = sides if window is None else samples.windowed(sides, window)
    parts = samples.waveforms(sides.withColumn("block_no", F.struct("block_no", "slot")), k)
    return parts.select("recording_id", "block_no.block_no", "block_no.slot", "channel", "part", "low", "high")


def watermark_states(spec: DataFrame, variants: DataFrame, ends: DataFrame, profiles: DataFrame | None, o: CompareOptions) -> DataFrame:
    """J12 of each recording whose profile has a watermark: recording_id, watermark (valid, invalid or unknown). Levels are against the recording's own peak."""
    if profiles is None or "wm_valid_hz" not in profiles.columns:
        return ends.where("false").select("recording_id", F.lit(None).cast("string").alias("watermark"))
    own = ends.join(F.broadcast(profiles.where("wm_valid_hz > 0 AND wm_invalid_hz > 0").select("profile_id", "wm_valid_hz", "wm_invalid_hz")), "profile_id").select("recording_id", "wm_valid_hz", "wm_invalid_hz")
    plain = own.join(variants.where("factor = 1 AND trim = 0"), "recording_id").select(F.col("recording_id").alias("_name"), F.col("variant").alias("recording_id"), "wm_valid_hz", "wm_invalid_hz")
    heard = spectrum.only(levels.self_normalise(spec), "watermark").join(plain, "recording_id").drop("recording_id").withColumnRenamed("_name", "recording_id")
    return sync.watermark_state(heard, F.col("wm_valid_hz"), F.col("wm_invalid_hz"), o.significance)
