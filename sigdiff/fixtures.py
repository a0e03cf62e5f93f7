"""The driver's tables seen as recordings, spectra, profiles and pulses."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigdiff import compare, layout, levels, sources, spectrum
from sigdiff.options import CompareOptions
from sigdiff.storage import stored

OPTIONS = CompareOptions(top=20, start_hz=1.0, end_hz=32.0, significance=-12.0)


class Fixture:
    """embeddings as blocks of 64 samples at 64 Hz of five recordings; all pairs of recordings. Nothing is computed until it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cached_property
    def blocks(self) -> DataFrame:
        block = F.expr("vec_id div 5")
        silent = block % 10 == 9
        return self.read("embeddings").select((F.col("vec_id") % 5).alias("recording_id"), block.alias("block_no"), F.lit("l").alias("channel"), F.when(silent, "silence").otherwise("user").alias("kind"), F.when(silent, -1).otherwise(block % 4 + 1).cast("int").alias("type_id"), F.col("embedding").cast("array<double>").alias("samples"))

    @cached_property
    def spec(self) -> DataFrame:
        """Stored, so that no query transforms a block twice."""
        return stored(spectrum.block_spectra(self.blocks, 64.0, OPTIONS), "spectra")

    @cached_property
    def pairs(self) -> DataFrame:
        """Every two of the five recordings."""
        return sources.make_pairs(self.blocks.select("recording_id").distinct(), "all", [])

    @cached_property
    def zero(self) -> DataFrame:
        return levels.pair_zero(self.pairs, levels.peaks(self.spec))

    @cached_property
    def ref(self) -> DataFrame:
        return spectrum.significant(levels.levels(self.zero, self.spec, "ref"), OPTIONS.significance, "ref")

    @cached_property
    def comp(self) -> DataFrame:
        return spectrum.significant(levels.levels(self.zero, self.spec, "comp"), OPTIONS.significance, "comp")

    @cached_property
    def sides(self) -> DataFrame:
        """Both sides of user blocks in one join, for what needs matched and unmatched bins."""
        return compare.both_sides(self.ref.where("kind = 'user'"), self.comp.where("kind = 'user'"))

    @cached_property
    def matched(self) -> DataFrame:
        return compare.match(self.ref, self.comp)

    @cached_property
    def audible(self) -> DataFrame:
        return self.matched.where("kind = 'user'")

    @cached_property
    def missing(self) -> DataFrame:
        return compare.missing(self.ref, self.comp).where("kind = 'user'")

    @cached_property
    def extra(self) -> DataFrame:
        return compare.extra(self.ref, self.comp, OPTIONS.significance).where("kind = 'user'")

    @cached_property
    def own_levels(self) -> DataFrame:
        return levels.self_normalise(self.spec)

    @cached_property
    def observations(self) -> DataFrame:
        """events as levels over time: pulse where the value is at least 50."""
        return self.read("events").select(F.col("user_id").alias("source"), "ts", "event_id", F.col("value").alias("level"), (F.col("value") >= 50).alias("pulse"))

    @cached_property
    def types(self) -> DataFrame:
        """part as profile type lines: a profile for each size, a line for each part of it."""
        kind = F.element_at(F.array(*map(F.lit, ("sync", "silence", "internal_sync", "silence_override", "user", "user", "user", "user"))), (F.col("p_partkey") % 8 + 1).cast("int"))
        return self.read("part").select((F.col("p_partkey") % 40).alias("profile_id"), F.col("p_partkey").alias("ord"), kind.alias("kind"), F.when(kind == "user", F.col("p_partkey") % 5 + 1).otherwise(-1).cast("int").alias("type_id"), (F.col("p_partkey") % 4).cast("int").alias("elements"), (F.col("p_size") + 1).cast("int").alias("frames"), (F.col("p_size") % 3).cast("int").alias("cut_frames"), F.when(F.col("p_partkey") % 7 == 0, "S").otherwise("m").alias("channel"))

    @cached_property
    def offsets(self) -> DataFrame:
        """The layout of the recordings' profile: a line for each block, of 18 to 22 frames."""
        lines = self.blocks.groupBy("block_no", "kind", "type_id").agg(F.lit(1).alias("elements")).select(F.lit(0).alias("profile_id"), F.col("block_no").alias("ord"), "kind", "type_id", "elements", (18 + F.col("block_no") % 5).cast("int").alias("frames"))
        return layout.block_layout(lines).select("block_no", "frame_offset")

    @cached_property
    def chunks(self) -> DataFrame:
        """embeddings as the samples of five recordings, 64 to a chunk; each seventh chunk is absent, the right channel is the left one turned over and halved."""
        left = F.col("embedding").cast("array<double>")
        right = F.transform(left, lambda v: v * -0.5)
        row = self.read("embeddings").where("vec_id % 7 <> 3")
        return row.select((F.col("vec_id") % 5).cast("string").alias("recording_id"), F.expr("vec_id div 5").alias("chunk_no"), F.expr("vec_id div 5 * 64").alias("start_frame"), left.alias("left"), right.alias("right"))

    @cached_property
    def files(self) -> DataFrame:
        """Every 200 embeddings as a WAV file of 32-bit floats, two channels, 64 frames a second."""
        row = self.read("embeddings").select(F.expr("vec_id div 200").cast("string").alias("recording_id"), F.struct("vec_id", F.col("embedding").cast("array<float>").alias("x")).alias("v"))
        whole = row.groupBy("recording_id").agg(F.array_sort(F.collect_list("v")).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for own in batch.column("v"):
                    x = own.values.field("x").flatten().to_numpy()
                    data = np.stack([x, -x / 2], 1).astype("<f4").tobytes()
                    fmt = struct.pack("<HHIIHH", 3, 2, 64, 64 * 8, 8, 32)
                    out.append(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data)
                yield pa.record_batch([batch.column("recording_id"), pa.array(out, pa.binary())], ["recording_id", "content"])

        return whole.mapInArrow(run, "recording_id string, content binary")

    @cached_property
    def pulses(self) -> DataFrame:
        """events as short pieces: three tones, and levels of up to some dozen dB below the peak."""
        level = F.col("value")
        return self.read("events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("start_frame"), (1000.0 + 1000 * (F.col("event_id") % 3)).alias("hertz"), (level + 1).alias("magnitude"), (-level / 3).alias("amplitude"))
