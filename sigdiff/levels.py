"""Peaks, decibels, normalisation, noise floors and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.exprs import decibels
from sigdiff.options import LINE_BINS, LOUDEST_FLOOR_DB, NORMALISE_DB, REVERSED_DB, SIGNIFICANT_DB


def peaks(spec: DataFrame) -> DataFrame:
    """A1: the loudest bin of each recording outside silence."""
    best = F.max_by(F.struct("block_no", "channel", "bin", "hertz", "magnitude"), F.struct("magnitude", -F.col("block_no"), -F.col("bin"))).alias("p")
    return spec.where("kind <> 'silence'").groupBy("recording_id").agg(best).select("recording_id", "p.*")


def pair_zero(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """A2: zero_db, the greater of both peaks."""
    side = lambda n: top.select(F.col("recording_id").alias(f"{n}_id"), F.col("magnitude").alias(f"{n}_peak"))
    return pairs.join(side("ref"), "ref_id").join(side("comp"), "comp_id").withColumn("zero_db", F.greatest("ref_peak", "comp_peak"))


def levels(zeroed: DataFrame, spec: DataFrame, side: str, gain: str = "1.0") -> DataFrame:
    """One side's spectrum of every pair, with amplitude in dB. Stored spectra are made once for all pairs."""
    own = zeroed.select("pair_id", F.col(f"{side}_id").alias("recording_id"), "zero_db", F.expr(gain).alias("_gain"))
    out = spec.join(own, "recording_id").withColumn("magnitude", F.col("magnitude") * F.col("_gain"))
    return out.withColumn("amplitude", decibels(F.col("magnitude"), F.col("zero_db"))).drop("_gain")


def self_normalise(spec: DataFrame) -> DataFrame:
    """A3: decibels against the recording's own peak, silence included."""
    top = spec.groupBy("recording_id").agg(F.max("magnitude").alias("top"))
    return spec.join(top, "recording_id").withColumn("amplitude", decibels(F.col("magnitude"), F.col("top"))).drop("top")


def fundamental_stats(spec: DataFrame, column: str) -> DataFrame:
    """A4, A5: over the first bins of blocks outside silence."""
    return spec.where("rank = 1 AND kind <> 'silence'").groupBy("recording_id").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))


def silence_floor(spec: DataFrame) -> DataFrame:
    """The loudest silence bin; spec has amplitudes."""
    best = F.max_by(F.struct("hertz", "amplitude"), F.struct("amplitude", -F.col("bin"))).alias("p")
    return spec.where("kind = 'silence' AND amplitude IS NOT NULL").groupBy("recording_id").agg(best).select("recording_id", F.col("p.hertz").alias("floor_hz"), F.col("p.amplitude").alias("floor_db"))


def noise_cutoff(spec: DataFrame, kind: str | None = "silence") -> DataFrame:
    """-(mean + sd of |dB|) and the share of bins below it, of blocks of a kind, or of all of spec."""
    of = spec.where(F.col("amplitude").isNotNull() if kind is None else (F.col("kind") == kind) & F.col("amplitude").isNotNull())
    cut = of.groupBy("recording_id").agg((-(F.avg(F.abs("amplitude")) + F.stddev_samp(F.abs("amplitude")))).alias("cutoff_db"))
    return of.join(cut, "recording_id").groupBy("recording_id", "cutoff_db").agg((100 * F.count_if(F.col("amplitude") < F.col("cutoff_db")) / F.count("*")).alias("left_out_pct"))


def floor_level(silence: DataFrame, cutoff: DataFrame, lowest_dbfs: float) -> DataFrame:
    """The quieter of both; without silence floor(1.2 * lowest dBFS)."""
    both = silence.join(cutoff, "recording_id", "full")
    return both.select("recording_id", F.coalesce(F.when(F.col("floor_db").isNotNull(), F.least("floor_db", F.coalesce("cutoff_db", "floor_db"))), F.floor(F.lit(1.2 * lowest_dbfs)).cast("double")).alias("floor_db"))


def significance(facts: DataFrame, auto: bool = True) -> DataFrame:
    """A10: facts: ref_floor, comp_floor (null without silence), ref_mean, comp_mean (mean fundamentals), all in dB.

    A floor above its own recording's mean fundamental is replaced by the default. The reference's floor counts, raised to the comparison's where that is
    higher but not above the loudest floor allowed, if the result would be below the default; without auto it is never below the default.
    """
    kept = lambda side: F.when(F.col(f"{side}_floor") > F.col(f"{side}_mean"), SIGNIFICANT_DB).otherwise(F.col(f"{side}_floor"))
    ref, comp = kept("ref"), kept("comp")
    plain = F.coalesce(ref, F.lit(SIGNIFICANT_DB))
    raised = F.coalesce((plain < SIGNIFICANT_DB) & (comp <= LOUDEST_FLOOR_DB) & (ref < comp), F.lit(False)) if auto else F.lit(False)
    out = facts.withColumn("significance", F.when(raised, comp).otherwise(plain) if auto else F.greatest(plain, F.lit(SIGNIFICANT_DB)))
    for side, own in (("ref", ref), ("comp", comp)):
        too_high = (F.col(f"{side}_floor") > F.col(f"{side}_mean")) | (own > LOUDEST_FLOOR_DB)
        out = out.withColumn(f"{side}_floor_too_high", F.coalesce(too_high, F.lit(False)))
    return out.withColumn("floors_differ", raised & (F.abs(ref - comp) > 20))


def mean_floor(spec: DataFrame, floors: DataFrame, top: int = 50, depth_db: float = 30.0) -> DataFrame:
    """Mean of the loudest silence bins above floor - depth."""
    near = spec.where("kind = 'silence'").join(floors, "recording_id").where(F.col("amplitude") > F.col("floor_db") - depth_db)
    w = Window.partitionBy("recording_id").orderBy(F.desc("amplitude"), "block_no", "bin")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).groupBy("recording_id").agg(F.avg("amplitude").alias("mean_floor_db"))


def standalone_floor(spec: DataFrame) -> DataFrame:
    """The loudest bin of the first silence block against the loudest fundamental."""
    first = spec.where("kind = 'silence'").groupBy("recording_id").agg(F.min_by(F.col("magnitude"), F.struct("block_no", "rank")).alias("quiet"))
    top = spec.where("kind <> 'silence' AND rank = 1").groupBy("recording_id").agg(F.max("magnitude").alias("loud"))
    return first.join(top, "recording_id").select("recording_id", (20 * F.log10(F.col("quiet") / F.col("loud"))).alias("floor_db"))


def tag_noise_lines(spec: DataFrame, lines: DataFrame, width_bins: int = LINE_BINS) -> DataFrame:
    """Lines (line, target_hz, exact, of all recordings or each with its recording_id) is a handful of rows a recording. Adds line to the bins near it."""
    wide = F.abs(F.col("hertz") - F.col("target_hz")) <= F.when(F.col("exact"), 0.5).otherwise(float(width_bins)) * 1000.0 / F.col("boxsize_ms")
    if "recording_id" in lines.columns:
        return spec.join(lines, "recording_id").where(wide)
    return spec.join(F.broadcast(lines), wide)


def noise_lines(recordings: DataFrame) -> DataFrame:
    """recording_id, line, target_hz, exact: the frame rate 1000 / ms, times the lines of a frame, and half of that. recordings: recording_id, ms_per_frame, line_count."""
    frame = 1000.0 / F.col("ms_per_frame")
    scan = frame * F.col("line_count")
    row = lambda name, hz, exact: F.struct(F.lit(name).alias("line"), hz.alias("target_hz"), F.lit(exact).alias("exact"))
    lines = F.array(row("vertical", frame, True), row("scan", scan, False), row("cross", scan / 2, False))
    return recordings.select("recording_id", F.explode(lines).alias("l")).select("recording_id", "l.*").where("target_hz > 0")


def noise_line_levels(tagged: DataFrame) -> DataFrame:
    """A9."""
    return tagged.where("kind = 'silence'").groupBy("recording_id", "line").agg(F.max("amplitude").alias("line_db"))


def local_peak(ref_peaks: DataFrame, comp_spec: DataFrame, bins: int = 0) -> DataFrame:
    """J8 (bins = 0) and J9: the comparison's strongest bin at or near the reference's peak. ref_peaks: pair_id, comp_id, block_no, channel, bin, ref_magnitude."""
    own = comp_spec.select(F.col("recording_id").alias("comp_id"), "block_no", "channel", F.col("bin").alias("comp_bin"), F.col("magnitude").alias("comp_magnitude"))
    near = ref_peaks.withColumn("comp_bin", F.explode(F.sequence(F.col("bin") - max(bins - 1, 0), F.col("bin") + max(bins - 1, 0))))
    found = near.join(own, ["comp_id", "block_no", "channel", "comp_bin"])
    best = F.max_by(F.struct("comp_bin", "comp_magnitude"), F.struct("comp_magnitude", -F.col("comp_bin"))).alias("p")
    return found.groupBy(*ref_peaks.columns).agg(best).select(*ref_peaks.columns, "p.*")


def peak_candidates(spec: DataFrame, n: int = 500) -> DataFrame:
    """K2: the loudest bins above mean + sd, outside silence, numbered."""
    own = spec.where("kind <> 'silence'")
    limit = own.groupBy("recording_id").agg((F.avg("magnitude") + F.stddev_samp("magnitude")).alias("limit"))
    w = Window.partitionBy("recording_id").orderBy(F.desc("magnitude"), "block_no", "bin")
    return own.join(limit, "recording_id").where(F.col("magnitude") > F.col("limit")).drop("limit").withColumn("number", F.row_number().over(w)).where(F.col("number") <= n)


def normalise_frequency(pairs: DataFrame, spec: DataFrame, bins: int = 5) -> DataFrame:
    """ref_gain = comparison at the candidate / reference; the first candidate within 30 dB, else the one nearest to it.

    Pairs without any candidate in the comparison are gone over again, with bins around each candidate.
    """
    cand = peak_candidates(spec).select(F.col("recording_id").alias("ref_id"), "number", "block_no", "channel", "bin", F.col("magnitude").alias("ref_magnitude"))
    every = pairs.select("pair_id", "ref_id", "comp_id").join(cand, "ref_id").select("pair_id", "comp_id", "number", "block_no", "channel", "bin", "ref_magnitude")
    exact = _first_candidate(local_peak(every, spec)).withColumn("second_pass", F.lit(False))
    wide = _first_candidate(local_peak(every.join(exact, "pair_id", "left_anti"), spec, bins)).withColumn("second_pass", F.lit(True))
    return exact.unionByName(wide)


def _first_candidate(found: DataFrame) -> DataFrame:
    found = found.withColumn("gap", F.abs(20 * F.log10(F.col("comp_magnitude") / F.col("ref_magnitude"))))
    order = F.when(F.col("gap") <= NORMALISE_DB, F.struct(F.lit(0.0).alias("a"), F.col("number").alias("b"))).otherwise(F.struct(F.col("gap").alias("a"), F.col("number").alias("b")))
    best = F.min_by(F.struct("number", "gap", (F.col("comp_magnitude") / F.col("ref_magnitude")).alias("ref_gain")), order).alias("p")
    return found.groupBy("pair_id").agg(best).select("pair_id", F.col("p.number").alias("candidate"), "p.ref_gain", (F.col("p.gap") > NORMALISE_DB).alias("ratio_too_high"))


def normalisation_warnings(pairs: DataFrame, gains: DataFrame, spec: DataFrame) -> DataFrame:
    """pair_id and two flags: mean fundamentals more than 30 to 1 apart after normalisation, and channels that look reversed: on the reference's
    loudest stereo block the louder side differs, and both gaps between the sides are above 8.5 dB."""
    m = fundamental_stats(spec, "magnitude")
    side = lambda n: m.select(F.col("recording_id").alias(f"{n}_id"), F.col("mean").alias(f"{n}_mean"))
    both = pairs.select("pair_id", "ref_id", "comp_id").join(gains.select("pair_id", "ref_gain"), "pair_id").join(side("ref"), "ref_id").join(side("comp"), "comp_id")
    ratio = F.col("ref_mean") * F.col("ref_gain") / F.col("comp_mean")
    far = F.greatest(ratio, 1 / ratio) > NORMALISE_DB
    top = spec.where("rank = 1 AND kind <> 'silence'").groupBy("recording_id", "block_no").agg(F.max(F.when(F.col("channel") == "l", F.col("magnitude"))).alias("l"), F.max(F.when(F.col("channel") == "r", F.col("magnitude"))).alias("r"))
    tilt = top.where("l > 0 AND r > 0").withColumn("tilt", 20 * F.log10(F.col("l") / F.col("r")))
    loudest = tilt.groupBy("recording_id").agg(F.max_by(F.struct("block_no", "tilt"), F.struct(F.abs("tilt"), -F.col("block_no"))).alias("b"))
    facing = pairs.select("pair_id", "ref_id", "comp_id").join(loudest.select(F.col("recording_id").alias("ref_id"), F.col("b.block_no").alias("block_no"), F.col("b.tilt").alias("ref_tilt")), "ref_id")
    facing = facing.join(tilt.select(F.col("recording_id").alias("comp_id"), "block_no", F.col("tilt").alias("comp_tilt")), ["comp_id", "block_no"])
    turned = facing.select("pair_id", ((F.abs("ref_tilt") > REVERSED_DB) & (F.abs("comp_tilt") > REVERSED_DB) & (F.col("ref_tilt") * F.col("comp_tilt") < 0)).alias("channels_reversed"))
    return both.select("pair_id", far.alias("means_too_far")).join(turned, "pair_id", "left").fillna(False, ["channels_reversed"])


def normalise_average(pairs: DataFrame, spec: DataFrame) -> DataFrame:
    """The quieter recording is scaled up by the ratio of mean fundamentals."""
    m = fundamental_stats(spec, "magnitude")
    side = lambda n: m.select(F.col("recording_id").alias(f"{n}_id"), F.col("mean").alias(f"{n}_mean"))
    both = pairs.join(side("ref"), "ref_id").join(side("comp"), "comp_id")
    ratio = F.col("comp_mean") / F.col("ref_mean")
    return both.select("pair_id", F.greatest(ratio, F.lit(1.0)).alias("ref_gain"), F.greatest(1 / ratio, F.lit(1.0)).alias("comp_gain"))
