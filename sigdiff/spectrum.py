"""Block samples to spectra: windows, transforms, ranks, bands and channel routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.exprs import FLAT_TOP, window_value
from sigdiff.options import COMP_MARGIN_DB, SILENCE_LIMIT_DB, CompareOptions

SPECTRUM = "recording_id long, block_no long, channel string, kind string, type_id int, boxsize_ms int, bin int, hertz double, magnitude double, phase double, rank int"


def window_table(lengths: DataFrame, kind: str) -> DataFrame:
    """Size and w (array) of each distinct length."""
    each = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: window_value(i.cast("double"), F.col("size").cast("double"), kind))
    return lengths.select("size").distinct().withColumn("w", each)


def coefficients(n: int, kind: str) -> np.ndarray:
    """The same windows in numpy."""
    i = np.arange(n)
    turn = 2 * np.pi * i / max(n - 1, 1)
    if kind == "h":
        return 0.5 - 0.5 * np.cos(turn)
    if kind == "m":
        return 0.54 - 0.46 * np.cos(turn)
    if kind == "f":
        return sum((-1) ** k * a * np.cos(k * turn) for k, a in enumerate(FLAT_TOP))
    if kind == "t":
        edge = 0.65 * (n - 1) / 2
        near = np.minimum(i, n - 1 - i)
        return np.where(near < edge, 0.5 * (1 + np.cos(np.pi * (near / edge - 1))), 1.0)
    return np.ones(n)


def route_channels(blocks: DataFrame) -> DataFrame:
    """Left, right (null if mono) and routing (m, s, S, n) to one row a channel: stereo blocks l and r, others the mean as l."""
    both = F.col("right").isNotNull()
    mean = F.zip_with("left", "right", lambda a, b: (a + b) / 2)
    row = lambda name, samples: F.struct(F.lit(name).alias("channel"), samples.alias("samples"))
    stereo = F.array(row("l", F.col("left")), row("r", F.col("right")))
    rows = F.when(~both, F.array(row("l", F.col("left")))).when(F.lower("routing") == "s", stereo).otherwise(F.array(row("l", mean)))
    return blocks.withColumn("_r", F.explode(rows)).select(*[c for c in blocks.columns if c not in ("left", "right")], "_r.channel", "_r.samples")


def alike(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, float, int]]:
    """Rows of a batch with equal lengths of samples, rates (_rate) and padding (_pad), some million samples at once."""
    samples, rates, pads = batch.column("samples"), batch.column("_rate").to_numpy(), batch.column("_pad").to_numpy()
    keys = np.stack([np.array([len(s) for s in samples], float), rates, pads.astype(float)], 1) if batch.num_rows else np.zeros((0, 3))
    for n, rate, pad in np.unique(keys, axis=0).tolist():
        at = np.flatnonzero((keys == (n, rate, pad)).all(1))
        step = max(1, 4_000_000 // max(1, int(n + pad)))
        for k in range(0, len(at), step):
            if n > 1:
                yield batch.take(pa.array(at[k : k + step])), int(n), rate, int(pad)


def block_spectra(blocks: DataFrame, sample_rate: float | str, o: CompareOptions, pad: int | str = 0) -> DataFrame:
    """U1 with W1 and K1: windowed real transforms of equal lengths at once; the ranks and the cut to the strongest bins stay in the task.

    blocks: recording_id, block_no, channel, kind, type_id, samples. sample_rate and pad (zeros after the samples) are numbers or columns of
    blocks, so that one table may hold several rates and P12's and P13's padding. Silence keeps all bins. No shuffle.
    """

    def rows(part: pa.RecordBatch, n: int, rate: float, zeros: int) -> pa.RecordBatch:
        x = part.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        w = coefficients(n, o.window)
        size = n + zeros
        spectrum = np.fft.rfft(x * w, size, axis=1)
        enbw = float(int((w * w).sum()))
        box = round(size / rate, 3)
        low, high = int(np.ceil(o.start_hz * box)), int(min(np.floor(o.end_hz * box), size // 2))
        bins = np.arange(low, high)
        s = spectrum[:, low:high]
        mag, ph = 2 * np.abs(s) / enbw, np.degrees(np.arctan2(s.imag, s.real))
        order = np.argsort(-mag, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(bins))[None, :] + 1, 1)
        keep = (rank <= o.top) | (np.array(part.column("kind").to_pylist()) == "silence")[:, None]
        r, c = np.nonzero(keep)
        take = pa.array(r)
        own = [part.column(k).take(take) for k in ("recording_id", "block_no", "channel", "kind", "type_id")]
        return pa.record_batch([*own, pa.array(np.full(len(r), round(box * 1000)), pa.int32()), pa.array(bins[c], pa.int32()), pa.array(bins[c] / box), pa.array(mag[r, c]), pa.array(ph[r, c]), pa.array(rank[r, c], pa.int32())], [x.split()[0] for x in SPECTRUM.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, rate, zeros in alike(batch):
                yield rows(part, n, rate, zeros)

    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    cols = [F.col("recording_id").cast("long"), F.col("block_no").cast("long"), "channel", "kind", F.col("type_id").cast("int"), F.col("samples").cast("array<double>"), value(sample_rate).cast("double").alias("_rate"), value(pad).cast("int").alias("_pad")]
    return blocks.where("samples IS NOT NULL").select(*cols).mapInArrow(run, SPECTRUM)


def clock_spectra(blocks: DataFrame, profiles: DataFrame, sample_rate: float | str, k: int = 1, end_hz: float = 20000.0) -> DataFrame:
    """The clock block of each recording again, with a Hamming window and padded to a multiple of k seconds.

    blocks: recording_id, profile_id, block_no, channel, kind, type_id, samples; profiles: profile_id, clk_block (from 1 among the profile's user blocks, with
    the block_no that it stands for in clk_block_no). Few blocks, so the join is a broadcast of the profiles' rows.
    """
    rate = F.col(sample_rate) if isinstance(sample_rate, str) else F.lit(sample_rate)
    own = blocks.join(F.broadcast(profiles.select("profile_id", F.col("clk_block_no").alias("block_no"))), ["profile_id", "block_no"]).withColumn("_own_rate", rate.cast("double"))
    n = F.size("samples")
    pad = F.ceil(n / F.col("_own_rate") / k) * k * F.col("_own_rate") - n
    return block_spectra(own.withColumn("_zeros", F.floor(pad + 0.5).cast("int")), "_own_rate", CompareOptions(window="m", end_hz=end_hz), "_zeros")


def rank_bins(spec: DataFrame) -> DataFrame:
    """W1 for spectra from elsewhere."""
    w = Window.partitionBy("recording_id", "block_no", "channel").orderBy(F.desc("magnitude"), "bin")
    return spec.withColumn("rank", F.row_number().over(w))


def top_bins(spec: DataFrame, n: int) -> DataFrame:
    """K1."""
    return spec.where((F.col("rank") <= n) | (F.col("kind") == "silence"))


def band(spec: DataFrame, start_hz: float, end_hz: float) -> DataFrame:
    """P10."""
    box = F.col("boxsize_ms") / 1000.0
    return spec.where((F.col("bin") >= F.ceil(start_hz * box)) & (F.col("bin") < F.floor(end_hz * box)))


def significant(levels: DataFrame, s: float | Column, role: str) -> DataFrame:
    """The reference above s (a number, or a column as it differs from pair to pair), the comparison above s - 20 dB, silence above -220 dBFS."""
    limit = s - (COMP_MARGIN_DB if role == "comp" else 0)
    return levels.where(F.col("amplitude") > F.when(F.col("kind") == "silence", SILENCE_LIMIT_DB).otherwise(limit))


def only(spec: DataFrame, *kinds: str) -> DataFrame:
    """P11."""
    return spec.where(F.col("kind").isin(*kinds))


def nearest_bin(hz, boxsize_ms, start_hz: float, end_hz: float):
    """The bin's hertz, 0 outside the band."""
    box = boxsize_ms / 1000.0
    b = F.ceil(F.lit(hz) * box - 0.5)
    return F.when((b >= F.ceil(start_hz * box)) & (b < F.floor(end_hz * box)), b / box).otherwise(0.0)
