"""Samples in time: cutting blocks, peaks, gains, balance and reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.exprs import window_value
from sigdiff.options import CompareOptions
from sigdiff.sources import decoded_chunks, parse_wav
from sigdiff.spectrum import alike, block_spectra, coefficients, route_channels
from sigdiff.storage import stored


def _value(x) -> Column:
    """A number, or the name of a column that holds it."""
    return F.col(x) if isinstance(x, str) else F.lit(x)


#: Blocks, windows or other stretches of samples whose places are broadcast to the files that they are cut from.
BROADCAST_BOUNDS = 3_000_000


def chunks_of(source: DataFrame) -> DataFrame:
    """Chunks of recordings, given as such or as files with their content; files are decoded in the task that reads them."""
    return decoded_chunks(source) if "content" in source.columns else source


def cut(source: DataFrame, bounds: DataFrame) -> DataFrame:
    """J1 for both kinds of sources: chunks of a second, or files with their content, from which samples go nowhere but into their block. bounds has sample_rate."""
    return cut_at_file(source, bounds) if "content" in source.columns else cut_blocks(source, bounds, "sample_rate")


def cut_at_file(files: DataFrame, bounds: DataFrame, broadcast_rows: int = BROADCAST_BOUNDS) -> DataFrame:
    """J1 where a file is decoded: its bounds come to it as one array, and each block is cut out at its place, zero where the file has no samples. No samples are shuffled.

    files: recording_id, content. bounds: recording_id, start_frame, n_frames and more, which stays. Arrays of more than broadcast_rows bounds are joined by shuffles, which move the files' bytes.
    """
    kept = [c for c in bounds.columns if c != "recording_id"]
    every = bounds.where("n_frames > 0")
    few = every.count() <= broadcast_rows
    arrays = every.groupBy("recording_id").agg(F.collect_list(F.struct(*kept)).alias("bounds"))
    joined = files.select("recording_id", "content").join(F.broadcast(arrays) if few else arrays, "recording_id")
    kinds = dict(bounds.dtypes)
    names = ["recording_id", *kept, "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, x = parse_wav(batch.column("content")[k].as_py())
                own = batch.column("bounds")[k].values
                at, n = own.field("start_frame").to_numpy(zero_copy_only=False), own.field("n_frames").to_numpy(zero_copy_only=False)
                low = 0
                while low < len(own):
                    high = low + max(1, int(np.searchsorted(np.cumsum(n[low:]), 2_000_000, side="right")))
                    sides = []
                    for c in range(x.shape[1]):
                        parts = [np.pad(x[max(0, a) : max(0, a + m), c], (min(m, max(0, -a)), 0))[:m] for a, m in zip(at[low:high].tolist(), n[low:high].tolist(), strict=True)]
                        flat = np.concatenate([np.pad(p, (0, m - len(p))) for p, m in zip(parts, n[low:high].tolist(), strict=True)])
                        edges = np.concatenate(([0], np.cumsum(n[low:high]))).astype(np.int32)
                        sides.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)))
                    if len(sides) == 1:
                        sides.append(pa.nulls(high - low, pa.list_(pa.float64())))
                    part = own.slice(low, high - low)
                    yield pa.record_batch([pa.array([batch.column("recording_id")[k].as_py()] * (high - low), pa.string()), *(part.field(c) for c in kept), *sides], names)
                    low = high

    schema = "recording_id string, " + ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", left array<double>, right array<double>"
    return joined.mapInArrow(run, schema)


def cut_blocks(chunks: DataFrame, bounds: DataFrame, chunk_frames: int | str) -> DataFrame:
    """Samples of [start_frame, start_frame + n_frames) of each block, each at its place, zero where no chunk has them.

    The interval join is an equality join on chunk numbers. chunk_frames: a number or a column of bounds (sample_rate for chunks of a second). A
    block beyond the recording is all zeros. right is null where the chunks have none. Further columns of bounds stay.
    """
    size = _value(chunk_frames)
    wanted = bounds.where("n_frames > 0").withColumnRenamed("start_frame", "_at")
    wanted = wanted.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("n_frames") - 1) / size))))
    joined = wanted.join(chunks.select("recording_id", "chunk_no", F.col("start_frame").alias("_from"), F.col("left").alias("_l"), F.col("right").alias("_r")), ["recording_id", "chunk_no"], "left")
    skip = F.greatest(F.col("_at") - F.col("_from"), F.lit(0))
    take = F.greatest(F.least(F.col("_at") + F.col("n_frames") - F.col("_from"), F.size("_l").cast("long")) - skip, F.lit(0))
    part = lambda c: F.slice(c, (skip + 1).cast("int"), take.cast("int"))
    piece = F.when(F.col("_from").isNotNull(), F.struct(F.greatest(F.col("_from") - F.col("_at"), F.lit(0)).alias("at"), part("_l").alias("l"), part("_r").alias("r")))
    kept = [c for c in bounds.columns if c != "start_frame"]
    pieces = joined.groupBy(*kept, "_at").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))
    placed = lambda c: F.aggregate("_p", F.array().cast("array<double>"), lambda out, p: F.concat(out, zeros(p["at"] - F.size(out)), p[c]))
    whole = lambda c: F.concat(placed(c), zeros(F.col("n_frames") - F.size(placed(c))))
    both = (F.size("_p") > 0) & F.forall("_p", lambda p: p["r"].isNotNull())
    lead = [c for c in ("recording_id", "block_no") if c in kept]
    return pieces.select(*lead, F.col("_at").alias("start_frame"), "n_frames", *(c for c in kept if c not in (*lead, "n_frames")), whole("l").alias("left"), F.when(both, whole("r")).alias("right"))


def sample_peak(blocks: DataFrame, by: list[str], column: str = "samples") -> DataFrame:
    """A23."""
    return blocks.groupBy(*by).agg(F.max(F.array_max(F.transform(column, F.abs))).alias("peak"))


def peak_frames(chunks: DataFrame) -> DataFrame:
    """A23 of whole recordings: recording_id, peak and frame of the first sample, of either channel, that is furthest from zero."""
    level = lambda c: F.coalesce(F.array_max(F.transform(c, F.abs)), F.lit(0.0))
    top = F.greatest(level("left"), level("right"))
    found = chunks.where("size(left) > 0").withColumn("_top", top)
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.transform(c, F.abs), F.col("_top")), F.lit(0)), F.lit(2**62))
    at = F.col("start_frame") + F.least(place("left"), place("right")) - 1
    return found.groupBy("recording_id").agg(F.max("_top").alias("peak"), F.min_by(at, F.struct(-F.col("_top"), "start_frame")).alias("frame")).where("peak > 0")


def comparison_frame(ref_frame: Column, ref_start: Column, comp_start: Column, ref_rate: Column, comp_rate: Column, ref_ms: Column, comp_ms: Column) -> Column:
    """Where the reference's frame lies in the comparison, whose rate of samples and of frames may differ."""
    return comp_start + F.floor((ref_frame - ref_start) / ref_rate * comp_rate * comp_ms / ref_ms + 0.5)


def local_sample_peak(chunks: DataFrame, around: DataFrame, chunk_frames: int | str) -> DataFrame:
    """Around: recording_id, frame, sample_rate. The peak of both channels within 1/60 s of the frame; chunk_frames as for cut_blocks."""
    size, reach = _value(chunk_frames), F.ceil(F.col("sample_rate") / 60)
    near = around.withColumn("_low", F.greatest(F.col("frame") - reach, F.lit(0))).withColumn("_high", F.col("frame") + reach)
    near = near.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size)))).drop("sample_rate")
    begin = F.greatest(F.col("_low") - F.col("start_frame"), F.lit(0))
    length = F.greatest(F.col("_high") - F.col("start_frame") - begin + 1, F.lit(0))
    top = lambda c: F.array_max(F.transform(F.slice(c, (begin + 1).cast("int"), length.cast("int")), F.abs))
    found = near.join(chunks.select("recording_id", "chunk_no", "start_frame", "left", "right"), ["recording_id", "chunk_no"]).withColumn("_p", F.greatest(top("left"), top("right")))
    return found.groupBy("recording_id", "frame").agg(F.max("_p").alias("peak"))


def scale_waveforms(blocks: DataFrame, peaks: DataFrame, full_scale: float) -> DataFrame:
    """To -3 dBFS of full scale by the reference's peak (recording_id, peak)."""
    gain = full_scale * 10 ** (-3 / 20) / F.col("peak")
    return blocks.join(peaks, "recording_id").withColumn("_g", gain).withColumn("samples", F.expr("transform(samples, s -> s * _g)")).drop("_g", "peak")


def time_gains(pairs: DataFrame, full_scale: float) -> DataFrame:
    """Pairs with ref_peak, comp_peak and comp_local; the comparison to full scale, the reference's peak to the comparison's local one."""
    comp = full_scale / F.col("comp_peak")
    return pairs.withColumn("comp_gain", comp).withColumn("ref_gain", F.col("comp_local") * comp / F.col("ref_peak"))


def stereo_balance(spec: DataFrame) -> DataFrame:
    """Fundamentals of a mono test block in both channels: the same bin, or the right one's second; imbalance in dB and the gain of the louder channel."""
    l = spec.where("channel = 'l' AND rank = 1").select("recording_id", "block_no", "bin", F.col("magnitude").alias("ml"))
    r = spec.where("channel = 'r' AND rank <= 2").select("recording_id", "block_no", "bin", F.col("magnitude").alias("mr"))
    out = l.join(r, ["recording_id", "block_no", "bin"], "left")
    db = 20 * F.log10(F.col("ml") / F.col("mr"))
    return out.select("recording_id", db.alias("db"), (F.least("ml", "mr") / F.greatest("ml", "mr")).alias("gain"), F.when(F.col("ml") > F.col("mr"), "l").when(F.col("mr") > F.col("ml"), "r").alias("channel"), F.when(F.col("mr").isNull(), "no common bin").otherwise("ok").alias("status"))


def balance_spectra(blocks: DataFrame, profiles: DataFrame, sample_rate: float | str, end_hz: float = 20000.0) -> DataFrame:
    """Flat-top spectra, two bins a channel, of each recording's balance block. blocks: recording_id, profile_id, block_no, left, right; profiles: profile_id, balance_block."""
    own = blocks.join(F.broadcast(profiles.where("balance_block >= 0").select("profile_id", F.col("balance_block").alias("block_no"))), ["profile_id", "block_no"])
    sides = route_channels(own.where("right IS NOT NULL").withColumn("routing", F.lit("S")).withColumn("kind", F.lit("user")).withColumn("type_id", F.lit(1)))
    return block_spectra(sides, sample_rate, CompareOptions(window="f", top=2, end_hz=end_hz))


def apply_balance(blocks: DataFrame, balance: DataFrame) -> DataFrame:
    """The louder channel is scaled down."""
    own = balance.where("status = 'ok' AND channel IS NOT NULL").select("recording_id", "channel", F.col("gain").alias("_g"))
    return blocks.join(own, ["recording_id", "channel"], "left").withColumn("samples", F.expr("if(_g IS NULL, samples, transform(samples, s -> s * _g))")).drop("_g")


def reconstruct(blocks: DataFrame, cutoffs: DataFrame, sample_rate: float | str, start_hz: float, end_hz: float, window: str = "n", shared: bool = True) -> DataFrame:
    """Cutoffs: recording_id, or with it block_no and channel, and cutoff (magnitude). Both outputs in one pass: used has the bins of the band at or above the cut-off, discarded the others.

    The mean and bins from the limit up are in both; without shared the mean is used and those bins are discarded, so that both add up to the block. sample_rate: a number or a column of blocks. Blocks of one length and rate are transformed together.
    """
    schema = "recording_id long, block_no long, channel string, part string, samples array<double>"

    def rows(part: pa.RecordBatch, n: int, rate: float) -> Iterator[pa.RecordBatch]:
        s = np.fft.rfft(part.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) * coefficients(n, window), axis=1)
        low, high = int(np.ceil(start_hz * n / rate)), min(int(np.floor(end_hz * n / rate)), n // 2)
        bins = np.arange(s.shape[1])
        inner = (bins >= max(low, 1)) & (bins < high)
        both = (bins == 0) | (bins >= high)
        loud = 2 * np.abs(s) / n >= part.column("cutoff").to_numpy()[:, None]
        for name, keep in (("used", inner & loud), ("discarded", ~(inner & loud) & ~both)):
            rest = both if shared else (bins == 0) if name == "used" else both & (bins > 0)
            out = np.fft.irfft(np.where(keep | rest, s, 0), n, axis=1)
            edges = np.arange(len(out) + 1, dtype=np.int32) * n
            own = [part.column(c) for c in ("recording_id", "block_no", "channel")]
            yield pa.record_batch([*own, pa.array([name] * len(out)), pa.ListArray.from_arrays(pa.array(edges), pa.array(out.ravel()))], [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, rate, _ in alike(batch):
                yield from rows(part, n, rate)

    own = blocks.join(cutoffs, [c for c in ("recording_id", "block_no", "channel") if c in cutoffs.columns]).select("recording_id", "block_no", "channel", "samples", "cutoff", _value(sample_rate).cast("double").alias("_rate"), F.lit(0).alias("_pad"))
    return own.mapInArrow(run, schema)


def windowed(blocks: DataFrame, kind: str) -> DataFrame:
    """Samples as a transform sees them, under a window."""
    n = F.size("samples").cast("double")
    return blocks.withColumn("samples", F.transform("samples", lambda v, i: v * window_value(i.cast("double"), n, kind)))


def waveforms(blocks: DataFrame, k: int) -> DataFrame:
    """Least and greatest sample of every k frames."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / k).cast("int")), lambda i: F.slice("samples", i * k + 1, F.lit(k)))
    each = blocks.select("recording_id", "block_no", "channel", F.posexplode(parts).alias("part", "s"))
    return each.select("recording_id", "block_no", "channel", "part", F.array_min("s").alias("low"), F.array_max("s").alias("high"))
