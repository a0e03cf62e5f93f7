"""Whole recordings split into what a comparison uses and what it leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigdiff import levels, samples, spectrum
from sigdiff.options import CompareOptions
from sigdiff.sources import _in_buckets
from sigdiff.storage import stored


def stretches(ends: DataFrame, places: DataFrame) -> DataFrame:
    """Every frame of each recording in order: recording_id, block_no, start_frame, n_frames, sample_rate, kind. What lies between blocks has kind gap and comes in stretches of a second at most, with negative numbers.

    ends: recording_id, n_frames, sample_rate; places: recording_id, block_no, start_frame, n_frames, kind. A block that begins within the one before it, as after a shifted segment, is cut short at its beginning.
    """
    own = ends.select("recording_id", F.col("n_frames").alias("_all"), "sample_rate")
    inside = places.join(own.drop("sample_rate"), "recording_id").withColumn("_end", F.least(F.col("start_frame") + F.col("n_frames"), F.col("_all")))
    w = Window.partitionBy("recording_id").orderBy("start_frame", "block_no")
    before = F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("_before", before).withColumn("start_frame", F.greatest("start_frame", "_before")).withColumn("n_frames", F.col("_end") - F.col("start_frame"))
    blocks = inside.where("n_frames > 0").select("recording_id", "block_no", "start_frame", "n_frames", "kind")
    tail = own.join(inside.groupBy("recording_id").agg(F.max("_end").alias("_last")), "recording_id", "left").select("recording_id", F.coalesce("_last", F.lit(0)).alias("_from"), F.col("_all").alias("_to"))
    gaps = inside.select("recording_id", F.col("_before").alias("_from"), F.col("start_frame").alias("_to")).unionByName(tail).where("_to > _from").join(own, "recording_id")
    step = F.floor("sample_rate").cast("long")
    gaps = gaps.withColumn("start_frame", F.explode(F.sequence("_from", F.col("_to") - 1, step))).withColumn("n_frames", F.least(step, F.col("_to") - F.col("start_frame")))
    gaps = gaps.select("recording_id", (-1 - F.col("start_frame")).alias("block_no"), "start_frame", "n_frames", F.lit("gap").alias("kind"))
    return blocks.withColumn("block_no", F.col("block_no").cast("long")).unionByName(gaps).join(own.drop("_all"), "recording_id")


def cutoffs(spec: DataFrame, o: CompareOptions) -> DataFrame:
    """The magnitude below which a block's bins are left out: recording_id, block_no, channel, cutoff: the weakest of its bins that are kept at all, but no less than the significance and, unless it is ignored, the recording's floor."""
    top = spec.groupBy("recording_id").agg(F.max("magnitude").alias("_top"))
    floor = levels.silence_floor(levels.self_normalise(spec)).select("recording_id", "floor_db")
    limit = F.lit(o.significance) if o.ignore_floor else F.greatest(F.lit(o.significance), F.coalesce("floor_db", F.lit(o.significance)))
    least = spec.where(F.col("rank") <= o.top).groupBy("recording_id", "block_no", "channel").agg(F.min("magnitude").alias("_least"))
    out = least.join(top, "recording_id").join(floor, "recording_id", "left")
    return out.select("recording_id", "block_no", "channel", F.greatest("_least", F.col("_top") * F.pow(F.lit(10.0), limit / 20)).alias("cutoff"))


def reconstruct_recordings(source: DataFrame, ends: DataFrame, places: DataFrame, o: CompareOptions) -> DataFrame:
    """U12 of whole recordings: recording_id, part (used or discarded), channel, start_frame, n_frames, samples, which cover each recording without gaps; both parts add up to it.

    source: files or chunks; ends, places: as the comparison has them. Blocks go through a transform of each channel and back; what lies between blocks is used as it is.
    """
    known = ends.where("status IN ('ok', 'manual')").select("recording_id", "n_frames", "sample_rate")
    every = stored(stretches(known, places.where(F.col("kind").isin("user", "silence", "watermark"))).withColumn("type_id", F.lit(1)).withColumn("routing", F.lit("S")), "stretches")
    cut = samples.cut(source, every)
    routed = spectrum.route_channels(cut).withColumn("_name", F.col("recording_id")).withColumn("recording_id", F.xxhash64("recording_id"))
    routed = stored(routed, "routed")
    blocks = routed.where("kind <> 'gap'")
    limits = cutoffs(stored(spectrum.block_spectra(blocks, "sample_rate", o), "spectra"), o)
    parts = samples.reconstruct(blocks, limits, "sample_rate", o.start_hz, o.end_hz, shared=False)
    at = routed.select("recording_id", "block_no", "channel", F.col("_name").alias("name"), "start_frame", "n_frames")
    # blocks too short for any bin, and gaps, have no transform
    made = at.join(parts, ["recording_id", "block_no", "channel"]).select(F.col("name").alias("recording_id"), "part", "channel", "start_frame", "n_frames", "samples")
    plain = routed.join(limits.select("recording_id", "block_no", "channel"), ["recording_id", "block_no", "channel"], "left_anti")
    zero = F.transform("samples", lambda v: v * 0)
    both = F.array(F.struct(F.lit("used").alias("part"), F.col("samples").alias("samples")), F.struct(F.lit("discarded").alias("part"), zero.alias("samples")))
    kept = plain.select(F.col("_name").alias("recording_id"), "channel", "start_frame", "n_frames", F.explode(both).alias("_p")).select("recording_id", "_p.part", "channel", "start_frame", "n_frames", "_p.samples")
    return made.unionByName(kept)


def write_reconstruction(parts: DataFrame, path: str, buckets: int = 64) -> None:
    """Parts of recordings in folders by a hash of the recording, each in order of recording, part, channel and frame, so that a recording can be read as one stream. A task sorts, on disk if it has to, and holds one row at a time."""
    _in_buckets(parts, "recording_id", buckets).sortWithinPartitions("bucket", "recording_id", "part", "channel", "start_frame").write.partitionBy("bucket").parquet(path)
