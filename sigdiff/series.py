"""Result datasets and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.exprs import weight


def difference_series(matched: DataFrame, significance: float | Column, curve: int = 0) -> DataFrame:
    """With a weight of the reference's loudness."""
    loud = 1 - F.col("ref_amplitude") / (significance if isinstance(significance, Column) else F.lit(significance))
    return matched.where("kind <> 'silence'").withColumn("weight", weight(F.greatest(F.least(loud, F.lit(1.0)), F.lit(0.0)), curve))


def mean_per_hertz(matched: DataFrame, by: list[str]) -> DataFrame:
    """The true mean."""
    return matched.groupBy(*by, "hertz").agg(F.avg("diff_amplitude").alias("diff_amplitude"))


def peak_per_hertz(spec: DataFrame, by: list[str]) -> DataFrame:
    """A30."""
    return spec.groupBy(*by, "bin").agg(F.max("amplitude").alias("amplitude"))


def moving_average(df: DataFrame, order: str, value: str, period: int, by: list[str]) -> DataFrame:
    """Mean of the last period rows; the first period rows are dropped."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("average", F.avg(value).over(w.rowsBetween(-(period - 1), 0)))
    return out.where(F.col("_n") > period).drop("_n")


def averaged_series(matched: DataFrame, significance: float | Column, period: int = 4) -> DataFrame:
    """Of the reference's louder half in dB."""
    own = matched.where((F.col("kind") != "silence") & (F.col("ref_amplitude") > significance / 2))
    by = ["pair_id", "type_id", "channel"]
    return moving_average(mean_per_hertz(own, by), "hertz", "diff_amplitude", period, by)


def noise_difference_series(matched: DataFrame, period: int = 50) -> DataFrame:
    """Of silence."""
    return moving_average(mean_per_hertz(matched.where("kind = 'silence'"), ["pair_id"]), "hertz", "diff_amplitude", period, ["pair_id"])


def time_spectrogram(levels: DataFrame, offsets: DataFrame) -> DataFrame:
    """X is the block's frame offset (offsets: block_no, frame_offset, as block_layout gives them for a profile); the louder side wins where both channels hold a hertz."""
    out = levels.groupBy("pair_id", "block_no", "type_id", "hertz").agg(F.max("amplitude").alias("amplitude"))
    return out.join(offsets.select("block_no", F.col("frame_offset").alias("x")), "block_no")


def spectrogram(levels: DataFrame, channel: str | None = None) -> DataFrame:
    """D3: the peak of each hertz by type and channel of a recording, of one channel if named."""
    own = levels.where("kind <> 'silence'")
    return peak_per_hertz(own if channel is None else own.where(F.col("channel") == channel), ["recording_id", "type_id", "channel"])


def phase_series(matched: DataFrame) -> DataFrame:
    """D7."""
    return matched.where("kind <> 'silence'").select("pair_id", "type_id", "channel", "hertz", "diff_phase")


def match_bars(within: DataFrame, perfect: DataFrame, lost: DataFrame, more: DataFrame) -> DataFrame:
    """Shares of a pair and type with warn levels."""
    by = ["pair_id", "type_id"]
    pct = lambda d, n: d.groupBy(*by).agg((100 * F.sum("hits") / F.sum("total")).alias(n))
    out = pct(within, "within_pct").join(pct(perfect, "perfect_pct"), by, "full").join(pct(lost, "missing_pct"), by, "full").join(pct(more, "extra_pct"), by, "full")
    return out.withColumn("warn", (F.col("within_pct") < 90) | (F.col("missing_pct") > 10) | (F.col("extra_pct") > 10))


def warnings(facts: DataFrame, flags: list[str]) -> DataFrame:
    """A row for each pair and warning that holds."""
    each = F.array(*(F.when(F.col(f), F.lit(f)) for f in flags))
    return facts.select("pair_id", F.explode(each).alias("warning")).where("warning IS NOT NULL")


def pair_warnings(pairs: DataFrame, *tables: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """D13 from the tables that compute them: each has either pair_id or recording_id and boolean columns, the warnings. Those of a recording get ref_ or comp_ before them.
    carried: warnings of recordings that pairs have as ref_ and comp_ columns already (of make_pairs), so that nothing is joined to the pairs for them."""
    flags = [f"{n}_{f}" for n in ("ref", "comp") for f in carried or []]
    every = pairs.select("pair_id", "ref_id", "comp_id", *flags)
    for t in tables:
        own = [n for n, kind in t.dtypes if kind == "boolean"]
        if "pair_id" in t.columns:
            every, flags = every.join(t.select("pair_id", *own), "pair_id", "left"), flags + own
            continue
        for n in ("ref", "comp"):
            every = every.join(t.select(F.col("recording_id").alias(f"{n}_id"), *(F.col(f).alias(f"{n}_{f}") for f in own)), f"{n}_id", "left")
            flags += [f"{n}_{f}" for f in own]
    return warnings(every, flags)


def runs(df: DataFrame, state: str, order: list[str], by: list[str]) -> DataFrame:
    """Islands of equal state, numbered, with their lengths and starts. The window is one source's rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    out = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*by, "run", state).agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("start"))


def ordered(df: DataFrame, series: str) -> DataFrame:
    """K3: by the reference's loudness, the comparison's, the difference, or hertz; ties go on by hertz."""
    return df.orderBy(*{"ref": [F.desc("ref_amplitude"), "hertz"], "comp": [F.desc("comp_amplitude"), "hertz"], "diff": [F.desc("diff_amplitude"), "hertz"], "hertz": [F.asc("hertz")]}[series])


def noise_spectrogram(levels: DataFrame, tagged: DataFrame) -> DataFrame:
    """The peak of each silence bin, with the noise line (of tag_noise_lines) that it lies on, if any."""
    top = levels.where("kind = 'silence'").groupBy("recording_id", "bin", "hertz").agg(F.max("amplitude").alias("amplitude"))
    line = tagged.where("kind = 'silence'").groupBy("recording_id", "bin").agg(F.min("line").alias("line"))
    return top.join(line, ["recording_id", "bin"], "left")


def unmatched_spectrogram(missing: DataFrame, extra: DataFrame, offsets: DataFrame) -> DataFrame:
    """Offsets as for time_spectrogram."""
    side = lambda df, name: df.select("pair_id", F.lit(name).alias("side"), "block_no", "hertz", "amplitude")
    every = side(missing, "missing").unionByName(side(extra, "extra"))
    return every.join(offsets.select("block_no", F.col("frame_offset").alias("x")), "block_no").select("pair_id", "side", "x", "hertz", "amplitude")


def clock_series(clock_spec: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clock spectra of both sides in dB of the louder clock."""
    top = clock_spec.groupBy("recording_id").agg(F.max("magnitude").alias("peak"))
    side = lambda n: top.select(F.col("recording_id").alias(f"{n}_id"), F.col("peak").alias(f"{n}_peak"))
    zero = pairs.join(side("ref"), "ref_id").join(side("comp"), "comp_id").withColumn("zero", F.greatest("ref_peak", "comp_peak"))
    each = zero.select("pair_id", "zero", F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("ref_id").alias("recording_id")), F.struct(F.lit("comp").alias("side"), F.col("comp_id").alias("recording_id")))).alias("s")).select("pair_id", "zero", "s.side", "s.recording_id")
    return clock_spec.join(each, "recording_id").select("pair_id", "side", "bin", "hertz", F.when(F.col("magnitude") > 0, 20 * F.log10(F.col("magnitude") / F.col("zero"))).alias("amplitude"))


def high_difference_waveforms(blocks: DataFrame, pairs: DataFrame, waves: DataFrame) -> DataFrame:
    """The waveforms (D10) of both sides of highly different blocks."""
    both = blocks.select("pair_id", "block_no").join(pairs, "pair_id").select("pair_id", "block_no", F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("ref_id").alias("recording_id")), F.struct(F.lit("comp").alias("side"), F.col("comp_id").alias("recording_id")))).alias("s"))
    return both.select("pair_id", "block_no", "s.side", "s.recording_id").join(waves, ["recording_id", "block_no"])
