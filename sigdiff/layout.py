"""Profiles to block layouts: expansion, offsets, bounds, overrides, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.exprs import COLOURS


def block_layout(types: DataFrame) -> DataFrame:
    """A row for each element of each type line, with block_no, sub_index and frame_offset."""
    each = types.where("elements > 0").withColumn("sub_index", F.explode(F.sequence(F.lit(0), F.col("elements") - 1)))
    w = Window.partitionBy("profile_id").orderBy("ord", "sub_index")
    out = each.withColumn("block_no", F.row_number().over(w) - 1)
    return out.withColumn("frame_offset", F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def cumulative(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Sum of the rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("position", F.coalesce(F.sum(value).over(w), F.lit(0)))


def block_seconds(layout: DataFrame) -> DataFrame:
    """Needs ms_per_frame."""
    return layout.withColumn("seconds", F.col("frames") * F.col("ms_per_frame") / 1000.0)


def block_bounds(layout: DataFrame, rate: str = "sample_rate") -> DataFrame:
    """Each block floors its samples and carries the fraction; a whole carried sample is skipped.

    Running sums of whole samples, which are exact, and of fractions over the blocks of a recording before; after a block of unknown length no start is known.
    """
    w = Window.partitionBy("recording_id", rate).orderBy("block_no", "seconds").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("seconds") * F.col(rate)
    whole = F.floor(length)
    before = lambda v: F.coalesce(F.sum(v).over(w), F.lit(0))
    at = before(whole) + F.floor(before(length - whole) + 1e-9)
    return layout.select("recording_id", "block_no", F.when(F.count_if(length.isNull()).over(w) == 0, at).alias("start_frame"), whole.alias("n_frames"))


def trim_by_framerate(seconds: DataFrame) -> DataFrame:
    """ref_ms and comp_ms are the pair's frame rates; on lines with the mask * (all, without a column mask) the longer side drops its tail, both are windowed for the shorter."""
    marked = F.col("mask") == "*" if "mask" in seconds.columns else F.lit(True)
    least = F.least("ref_ms", "comp_ms")
    if "mask" in seconds.columns:
        own = lambda ms: F.when(marked, F.col("frames") * (F.col(ms) - least) / 1000.0).otherwise(0.0)
        return seconds.withColumn("window_seconds", F.when(marked, F.col("frames") * least / 1000.0)).withColumn("ref_trim", own("ref_ms")).withColumn("comp_trim", own("comp_ms"))
    low = least
    return seconds.withColumn("window_seconds", F.col("frames") * low / 1000.0).withColumn("ref_trim", F.col("frames") * (F.col("ref_ms") - low) / 1000.0).withColumn("comp_trim", F.col("frames") * (F.col("comp_ms") - low) / 1000.0)


def resolve_silence(layout: DataFrame) -> DataFrame:
    """P5: with an override line in the profile, silence is skipped and the override is silence."""
    has = F.max((F.col("kind") == "silence_override").cast("int")).over(Window.partitionBy("profile_id")) == 1
    return layout.withColumn("kind", F.when(has & (F.col("kind") == "silence"), "skip").when(F.col("kind") == "silence_override", "silence").otherwise(F.col("kind")))


def mark_addons(types: DataFrame, use_extra: bool) -> DataFrame:
    """A later line of a type that is there already."""
    again = (F.col("type_id") >= 0) & (F.row_number().over(Window.partitionBy("profile_id", "type_id").orderBy("ord")) > 1)
    out = types.withColumn("is_addon", again)
    return out if use_extra else out.withColumn("kind", F.when(F.col("is_addon"), "time_domain").otherwise(F.col("kind")))


def flatten_balance(types: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with balance_block, a block number of the whole layout, changed to the number of the line that holds it."""
    w = Window.partitionBy("profile_id").orderBy("ord")
    line = types.withColumn("_line", F.row_number().over(w) - 1).withColumn("_to", F.sum("elements").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = profiles.join(line.select("profile_id", "_line", "_to", F.col("elements").alias("_n")), "profile_id").where((F.col("balance_block") < F.col("_to")) & (F.col("balance_block") >= F.col("_to") - F.col("_n")))
    return profiles.join(held.select("profile_id", "_line"), "profile_id", "left").withColumn("balance_block", F.coalesce("_line", "balance_block")).drop("_line")


def flatten_profile(types: DataFrame) -> DataFrame:
    """Each line as one long block."""
    return types.withColumn("frames", F.col("frames") * F.col("elements")).withColumn("cut_frames", F.col("cut_frames") * F.col("elements")).withColumn("elements", F.lit(1))


def pad_length(layout: DataFrame) -> DataFrame:
    """Frames up to the profile's longest block."""
    return layout.withColumn("pad_frames", F.max("frames").over(Window.partitionBy("profile_id")) - F.col("frames"))


def align_bins(layout: DataFrame, k: int = 1) -> DataFrame:
    """Seconds up to whole multiples of k."""
    return layout.withColumn("pad_seconds", F.ceil(F.col("seconds") / k) * k - F.col("seconds"))


def landmarks(layout: DataFrame) -> DataFrame:
    """W5."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("block_no")))
    last = F.max(F.when(F.col("kind") == "sync", F.col("block_no")))
    out = layout.groupBy("profile_id").agg(first("sync").alias("first_sync"), last.alias("last_sync"), first("silence").alias("first_silence"), F.collect_list(F.when(F.col("kind") == "silence", F.col("block_no"))).alias("_s"))
    return out.select("profile_id", "first_sync", "last_sync", "first_silence", F.array_max(F.filter("_s", lambda b: b < F.col("last_sync"))).alias("closing_silence"))


#: Kinds of lines that mark segments: of known length, and of a length that only the next marker tells.
MARKERS = ("internal_sync", "internal_sync_unknown")


def segments(layout: DataFrame) -> DataFrame:
    """Markers of both kinds come in pairs; segment numbers the pair that a block lies between, else null."""
    w = Window.partitionBy("profile_id").orderBy("block_no")
    is_marker = F.col("kind").isin(*MARKERS)
    mark = F.sum(is_marker.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = layout.withColumn("_m", mark).withColumn("segment", F.when((F.col("_m") % 2 == 1) & ~is_marker, F.floor((F.col("_m") + 1) / 2).cast("long"))).drop("_m")
    return out.withColumn("segment_frames", F.when(F.col("segment").isNotNull(), F.sum("frames").over(Window.partitionBy("profile_id", "segment"))))


def marked(layout: DataFrame) -> DataFrame:
    """Adds marker, the number of opening markers up to a block, and inside, whether a block comes after an opening marker and not after its closing one."""
    w = Window.partitionBy("profile_id").orderBy("block_no")
    before = F.coalesce(F.sum(F.col("kind").isin(*MARKERS).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return layout.withColumn("marker", F.floor((before + 1) / 2).cast("long")).withColumn("inside", before % 2 == 1)


def active_types(layout: DataFrame) -> DataFrame:
    """X2."""
    return layout.where("type_id >= 1").select("profile_id", "type_id").distinct()


def validate_profiles(types: DataFrame) -> DataFrame:
    """A row for each profile and broken rule."""
    row = lambda df, rule: df.select("profile_id", F.lit(rule).alias("rule")).distinct()
    n_sync = types.groupBy("profile_id").agg(F.count_if(F.col("kind") == "sync").alias("n"), F.count_if(F.col("kind").isin(*MARKERS)).alias("i"), F.count_if(F.col("kind") == "silence_override").alias("o"))
    out = row(n_sync.where("n <> 2"), "two sync lines")
    for condition, rule in (("elements <= 0 OR frames <= 0", "no zero counts"), ("cut_frames >= frames", "cut below frames"), ("kind <> 'user' AND channel = 'S'", "no stereo control lines")):
        out = out.unionByName(row(types.where(condition), rule))
    if "colour" in types.columns:
        first = Window.partitionBy("profile_id", "type_id").orderBy("ord")
        later = types.withColumn("_first", F.first("colour").over(first)).where("type_id >= 0 AND colour <> _first")
        known = F.lower("colour").rlike(f"^d?({'|'.join(COLOURS)})$")
        out = out.unionByName(row(types.where(~known), "known colour")).unionByName(row(later, "colour of the type"))
    return out.unionByName(row(n_sync.where("i % 2 = 1"), "internal sync in pairs")).unionByName(row(n_sync.where("o > 0 AND i > 2"), "override with one internal sync"))


def profile_stats(types: DataFrame, modes: DataFrame) -> DataFrame:
    """Modes has a row a profile (profile_id, ms_per_frame)."""
    each = types.join(modes, "profile_id")
    return each.groupBy("profile_id").agg(
        F.sum("elements").alias("blocks"), F.sum(F.col("elements") * F.col("frames")).alias("frames"), (F.sum(F.col("elements") * F.col("frames") * F.col("ms_per_frame")) / 1000.0).alias("seconds"),
        F.min("frames").alias("min_frames"), F.max("frames").alias("max_frames"), F.avg("frames").alias("mean_frames"), F.stddev_samp("frames").alias("sd_frames"),
        F.sum(F.when(F.col("type_id") >= 1, F.col("elements")).otherwise(0)).alias("active_blocks"), F.countDistinct(F.when(F.col("type_id") >= 1, F.col("type_id"))).alias("types"),
    )
