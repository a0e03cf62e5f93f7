"""Where signals lie in a recording: islands of a tone, pulse trains, refined starts, markers inside, starts without sync.

Samples are looked at once, piece by piece of an eighth or a quarter of a millisecond, and become islands of a tone at a ladder of thresholds, some hundred rows a recording. All further
search is joins, windows and folds over islands, for all thresholds and tolerances at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigdiff import samples
from sigdiff.sync import LIMIT_HZ, pulse_chunks, pulse_db

ISLANDS = "recording_id string, tone_hz double, rung int, start_frame long, frames long"
#: Steps of the ladder in dB, and how many it has below the loudest piece of a chunk.
STEP_DB, RUNGS = 3.0, 16
#: Below this, pieces are twice as long.
LOW_HZ = 6000.0
#: Rows of facts, one a recording and tone, that are broadcast to the samples.
BROADCAST_FACTS = 1_000_000


def piece_frames(rate: float, hz: float) -> int:
    """Frames of a piece: an eighth of a millisecond, a quarter for low tones, but a whole period at least."""
    return max(4, round(rate / (8000 if hz >= LOW_HZ else 4000)), int(np.ceil(rate / hz)))


def _islands(x: np.ndarray, at: int, rate: float, hz: float, least: float) -> Iterator[tuple[int, int, int]]:
    """(rung, first frame, frames) of stretches in which the tone's bin is the strongest one and at least as loud as the rung; gaps and islands below a tenth of least are noise, but at the ends."""
    n = piece_frames(rate, hz)
    pieces = x[: len(x) // n * n].reshape(-1, n)
    mag = 2 * np.abs(np.fft.rfft(pieces, axis=1)) / n
    bins = mag[:, 1 : int(np.ceil(LIMIT_HZ * n / rate - 1e-9))]
    if not bins.size:
        return
    target = min(max(0, round(hz * n / rate) - 1), bins.shape[1] - 1)
    level = np.where(bins.argmax(1) == target, bins[:, target], 0.0)
    if not level.max() > 0:
        return
    small = max(2, int(0.1 * least / n))
    top = int(np.floor(20 * np.log10(level.max()) / STEP_DB))
    for rung in range(top, top - RUNGS, -1):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], level >= 10 ** (rung * STEP_DB / 20), [False])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        apart = np.concatenate(([True], start[1:] - end[:-1] > small))
        start, end = start[apart], np.append(end[:-1][apart[1:]], end[-1:])
        keep = (end - start > small) | (start == 0) | (end == len(level))
        for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True):
            yield rung, at + a * n, (b - a) * n


def tone_islands(source: DataFrame, tones: DataFrame, broadcast_rows: int = BROADCAST_FACTS) -> DataFrame:
    """Islands (recording_id, tone_hz, rung, start_frame, frames) of tones in the left channel.

    tones: recording_id, sample_rate, tone_hz, least (frames of the shortest stretch that matters) and from_frame, before which nothing is looked at; one or more rows a recording. Chunks go
    to the task they are in, and islands that go on in the next chunk are joined afterwards.
    """
    own = tones.groupBy("recording_id", F.col("sample_rate").cast("double").alias("rate")).agg(F.collect_list(F.struct(F.col("tone_hz").cast("double").alias("hz"), F.col("least").cast("double").alias("least"), F.col("from_frame").cast("long").alias("from"))).alias("tones"))
    few = own.count() <= broadcast_rows
    chunks = samples.chunks_of(source).where("size(left) > 0").select("recording_id", "start_frame", "left")
    own = own.withColumn("_from", F.array_min(F.transform("tones", lambda t: t["from"])))
    joined = chunks.join(F.broadcast(own) if few else own, "recording_id").where(F.col("start_frame") + F.size("left") > F.col("_from")).drop("_from")
    names = [c.split()[0] for c in ISLANDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                x = batch.column("left")[k].values.to_numpy(zero_copy_only=False)
                at, rate, own = (batch.column(c)[k].as_py() for c in ("start_frame", "rate", "tones"))
                for t in own:
                    skip = min(max(0, t["from"] - at), len(x))
                    rows += [(batch.column("recording_id")[k].as_py(), t["hz"], *found) for found in _islands(x[skip:], at + skip, rate, t["hz"], t["least"])]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()))], names)

    found = joined.mapInArrow(run, ISLANDS)
    gap = F.greatest(F.lit(2.0), 0.1 * F.col("least"))
    return join_islands(found.join(tones.select("recording_id", F.col("tone_hz").cast("double").alias("tone_hz"), "least").distinct(), ["recording_id", "tone_hz"]), gap).select(*names)


def join_islands(islands: DataFrame, gap) -> DataFrame:
    """Islands of one rung that are no further apart than gap become one; those not longer than it go."""
    w = Window.partitionBy("recording_id", "tone_hz", "rung").orderBy("start_frame")
    apart = F.coalesce(F.col("start_frame") - F.lag(F.col("start_frame") + F.col("frames")).over(w) > gap, F.lit(True))
    each = islands.withColumn("_gap", gap).withColumn("_n", apart.cast("int")).withColumn("_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = each.groupBy("recording_id", "tone_hz", "rung", "_n", "_gap").agg(F.min("start_frame").alias("start_frame"), (F.max(F.col("start_frame") + F.col("frames")) - F.min("start_frame")).alias("frames"))
    return one.where(F.col("frames") > F.col("_gap")).drop("_n", "_gap")


def trains(islands: DataFrame, facts: DataFrame, tolerance: int = 3) -> DataFrame:
    """U4: every pulse train of every rung and of every tolerance from 0 up: pulses of one frame, one frame apart.

    facts: recording_id, sample_rate, ms_per_frame, pulse_ms (least length of a pulse), pulse_count. The tolerance allows lengths and distances to be further off, and as many pulses to be missing, at the ends or in
    between. Adds start_frame (of the whole train, which may lie before the recording), found_frame (of the first pulse that is there), pulses, and jitter, the pulses' mean deviation in length.
    """
    each = islands.join(facts.select("recording_id", "pulse_count", (F.col("pulse_ms") / 1000 * F.col("sample_rate")).alias("_least"), (F.col("ms_per_frame") / 1000 * F.col("sample_rate")).alias("_l")), "recording_id")
    each = each.withColumn("tolerance", F.explode(F.sequence(F.lit(0), F.lit(tolerance))))
    t, length = F.col("tolerance"), F.col("_l")
    off = F.abs(F.col("frames") - length) / length
    # a grid of pieces can cut both ends
    fits = (off <= 0.12 + 0.08 * t) & (F.col("frames") >= F.col("_least") * (0.9 - 0.1 * t))
    w = Window.partitionBy("recording_id", "rung", "tolerance").orderBy("start_frame")
    step = F.col("start_frame") - F.lag("start_frame").over(w)
    slots = F.greatest(F.round(step / (2 * length)), F.lit(1.0))
    follows = (F.abs(step - slots * 2 * length) <= (0.15 + 0.1 * t) * length) & (slots <= 1 + t)
    each = each.where(fits).withColumn("_off", off).withColumn("_n", F.coalesce(~follows, F.lit(True)).cast("int")).withColumn("_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = each.groupBy("recording_id", "rung", "tolerance", "_n", "_l", "pulse_count").agg(F.count("*").alias("pulses"), F.min("start_frame").alias("found_frame"), F.max("start_frame").alias("_last"), F.avg("_off").alias("jitter"))
    whole = F.round((F.col("_last") - F.col("found_frame")) / (2 * length)) + 1
    lost = F.col("pulse_count") - whole
    # what is missing was cut off by the recording's beginning if it would have to lie before it
    front = F.when(F.col("found_frame") - lost * 2 * length < length, lost).otherwise(0)
    chain = chain.where((whole <= F.col("pulse_count")) & (F.col("pulses") >= F.col("pulse_count") - t) & (F.col("pulses") >= 2))
    return chain.select("recording_id", "rung", "tolerance", "pulses", "jitter", "found_frame", F.floor(F.col("found_frame") - front * 2 * length + 0.5).alias("start_frame"))


def _best(found: DataFrame, order) -> DataFrame:
    kept = ["tolerance", "pulses", "start_frame", "found_frame"]
    return found.groupBy("recording_id").agg(F.min_by(F.struct(*kept), order).alias("_b")).select("recording_id", *(F.col(f"_b.{c}").alias(c) for c in kept))


def opening_train(found: DataFrame, facts: DataFrame) -> DataFrame:
    """U4: of trains, the one of least tolerance that leaves room for the signal; of those the first one, and of its rungs the one with most and evenest pulses. facts: also n_frames, sync_frames."""
    own = facts.select("recording_id", "n_frames", (F.col("ms_per_frame") / 1000 * F.col("sample_rate")).alias("_l"), "sync_frames")
    room = found.join(own, "recording_id").where(F.col("start_frame") + 0.9 * F.col("sync_frames") * F.col("_l") <= F.col("n_frames"))
    return _best(room, F.struct("tolerance", F.floor(F.col("start_frame") / (4 * F.col("_l"))), -F.col("pulses"), F.round("jitter", 6), -F.col("rung"), "start_frame"))


def closing_train(found: DataFrame, opening: DataFrame, facts: DataFrame) -> DataFrame:
    """Of trains in the second half, the one of least tolerance that is, in steps of a pulse and its pause, nearest to where the layout puts it; then as for the opening one. Adds opened."""
    own = facts.select("recording_id", (F.col("ms_per_frame") / 1000 * F.col("sample_rate")).alias("_l"), "sync_frames")
    tail = found.join(opening.select("recording_id", F.col("start_frame").alias("opened")), "recording_id").join(own, "recording_id")
    off = F.col("start_frame") - F.col("opened") - F.col("sync_frames") * F.col("_l")
    tail = tail.where(off > -0.5 * F.col("sync_frames") * F.col("_l"))
    return _best(tail, F.struct("tolerance", F.floor(F.abs(off) / (2 * F.col("_l"))), -F.col("pulses"), F.round("jitter", 6), -F.col("rung"), "start_frame"))


def pulse_edges(x: np.ndarray, rate: float, hz: float, length: float, expected: float) -> tuple[float, float] | None:
    """Where in x the pulse begins and ends that overlaps most with the expected place.

    A transform at the pulse's hertz slides over the frames, four periods wide, each value made from the one before by what comes in and goes out, as differences of a running sum. It is as loud, against the pulse's level, as the share of the window
    that lies on the pulse, and what it adds up to around an edge tells where the edge is. A pulse whose length is not the expected one has faded edges and is centred.
    """
    p = max(2, min(round(4 * rate / hz), int(length / 4)))
    if len(x) < 2 * p:
        return None
    total = np.concatenate(([0], np.cumsum(x * np.exp(-2j * np.pi * hz / rate * np.arange(len(x))))))
    mag = np.abs(total[p:] - total[:-p])
    if not mag.max() > 0:
        return None
    low, high = int(max(0, expected - p / 2)), int(min(len(mag), expected + length))
    level = np.quantile(mag[low:high], 0.7) if high > low else mag.max()
    on = mag >= level / 2
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    both = np.minimum(end, expected - p / 2 + length) - np.maximum(start, expected - p / 2)
    k = int(np.argmax(both))

    def share(i: int) -> float:
        """The level around an edge, added up; where a wave passes zero the slope has steps, and a crossing would be uncertain."""
        low, high = i - p, i + p
        inside = np.minimum(mag[max(0, low) : high] / level, 1.0)
        # what lies beyond the window goes on as its last value does
        return float(inside.sum()) + max(0, -low) * float(inside[0]) + max(0, high - len(mag)) * float(inside[-1])

    first = start[k] + 1.5 * p - 0.5 - share(int(start[k]))
    last = end[k] - 0.5 * p - 0.5 + share(int(end[k]))
    return (first if abs(last - first - length) <= 0.02 * length else (first + last - length) / 2), last


def refine_starts(source: DataFrame, starts: DataFrame) -> DataFrame:
    """Starts (recording_id, which, sample_rate, pulse_hz, length, found_frame and more) with start and stop, to a fraction of a frame: windows around the found pulses are cut out, each in the task that has the samples.

    Where the window holds no pulse, start is found_frame and stop a length later. length: frames of a pulse.
    """
    cols = starts.columns
    before = F.ceil(1.5 * F.col("length"))
    windows = starts.select(*cols, F.greatest(F.col("found_frame") - before, F.lit(0)).cast("long").alias("start_frame"), F.ceil(4 * F.col("length")).cast("long").alias("n_frames"))
    cut = samples.cut(source, windows)
    kinds = dict(cut.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                value = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                found = pulse_edges(batch.column("left")[k].values.to_numpy(zero_copy_only=False), value("sample_rate"), value("pulse_hz"), value("length"), value("found_frame") - value("start_frame"))  # noqa: B023
                whole = (float(value("found_frame")), value("found_frame") + value("length"))
                out.append(whole if found is None else tuple(value("start_frame") + v for v in found))
            yield pa.record_batch([*(batch.column(c) for c in cols), *(pa.array([r[i] for r in out], pa.float64()) for i in (0, 1))], [*cols, "start", "stop"])

    return cut.select(*cols, "start_frame", "left").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", start double, stop double")


def sync_bounds(source: DataFrame, facts: DataFrame, tolerance: int = 0) -> DataFrame:
    """start_at and end_at (fractions of frames) of recordings with sync (facts: recording_id, sample_rate, n_frames, ms_per_frame, pulse_hz, pulse_ms, pulse_count, sync_frames), the starts of both trains, and
    sync_tolerance, the greatest tolerance that was needed. A recording without both has no row."""
    tone = facts.select("recording_id", "sample_rate", F.col("pulse_hz").cast("double").alias("tone_hz"), (F.col("ms_per_frame") / 1000 * F.col("sample_rate")).alias("least"), F.lit(0).cast("long").alias("from_frame"))
    found = trains(tone_islands(source, tone), facts, tolerance)
    found = samples.stored(found, "trains")
    opening = opening_train(found, facts)
    closing = closing_train(found, opening, facts)
    both = opening.withColumn("which", F.lit(0)).unionByName(closing.withColumn("which", F.lit(1)))
    length = (F.col("ms_per_frame") / 1000 * F.col("sample_rate")).alias("length")
    starts = both.join(facts.select("recording_id", "sample_rate", F.col("pulse_hz").cast("double").alias("pulse_hz"), length), "recording_id")
    exact = refine_starts(source, samples.stored(starts.withColumnRenamed("start_frame", "_train"), "starts"))
    at = F.col("start") + F.col("_train") - F.col("found_frame")
    side = lambda k: F.max(F.when(F.col("which") == k, at))
    out = exact.groupBy("recording_id").agg(side(0).alias("start_at"), side(1).alias("end_at"), F.max("tolerance").alias("sync_tolerance"))
    return out.where("start_at IS NOT NULL AND end_at IS NOT NULL")


def free_bounds(source: DataFrame, facts: DataFrame) -> DataFrame:
    """start_frame, end_frame, ms_per_frame and status of recordings of profiles without sync.

    facts: recording_id, sample_rate, n_frames, sync_kind, expected_ms, total_frames (of the layout) and ref_frames (of the reference's length, null for references). A: from the first sound; D: from the first frame that is not
    zero; L: the file's beginning, and it has to be long enough; M: the whole file, whose frame rate is that which makes it as many frames as its reference.
    """
    chunks = samples.chunks_of(source)
    auto = facts.where("sync_kind = 'A'").select("recording_id", "sample_rate", "n_frames")
    digital = facts.where("sync_kind = 'D'").select("recording_id")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_FACTS else df
    # A sound is looked for in the first sixth.
    head = chunks.drop("sample_rate", "n_frames").join(small(auto), "recording_id").where(F.col("start_frame") <= F.col("n_frames") / 6)
    sound = signal_start(pulse_db(pulse_chunks(head, "sample_rate"))).select("recording_id", F.col("start_frame").alias("_a"))
    first = first_sound(chunks.join(small(digital), "recording_id")).select("recording_id", F.col("start_frame").alias("_d"))
    every = facts.join(sound, "recording_id", "left").join(first, "recording_id", "left")
    kind, ms = F.col("sync_kind"), F.col("expected_ms")
    start = F.when(kind == "A", F.col("_a")).when(kind == "D", F.col("_d")).otherwise(0)
    length = F.floor(F.col("total_frames") * ms / 1000 * F.col("sample_rate") + 0.5)
    own = F.col("n_frames") * 1000.0 / F.col("sample_rate") / F.col("ref_frames")
    found = every.select("recording_id", start.cast("long").alias("start_frame"), F.when(kind == "M", F.col("n_frames")).otherwise(start + length).cast("long").alias("end_frame"), F.when((kind == "M") & F.col("ref_frames").isNotNull(), own).otherwise(ms).alias("ms_per_frame"), ms.alias("expected_ms"), "n_frames", kind.alias("_k"))
    far = F.abs(F.col("ms_per_frame") / F.col("expected_ms") - 1) > 0.01
    status = F.when(F.col("start_frame").isNull(), "no sound").when((F.col("_k") == "L") & (F.col("end_frame") > F.col("n_frames")), "too short").when(far, "rejected").otherwise("ok")
    return found.withColumn("status", status).drop("n_frames", "_k", "expected_ms")


def first_sound(chunks: DataFrame) -> DataFrame:
    """U8 for chunks without a right channel as well."""
    first = lambda c: F.nullif(F.array_position(F.transform(c, lambda s: s != 0), True), F.lit(0))
    return chunks.withColumn("_f", F.least(first("left"), first("right"))).where("_f > 0").groupBy("recording_id").agg(F.min(F.col("start_frame") + F.col("_f") - 1).alias("start_frame"))


def signal_start(pulses: DataFrame) -> DataFrame:
    """U7 on levels against the loudest piece (pulse_db): the first piece whose dB, times 1.5, is above the mean up to it."""
    w = Window.partitionBy("recording_id").orderBy("start_frame").rowsBetween(Window.unboundedPreceding, 0)
    return pulses.withColumn("_mean", F.avg("amplitude").over(w)).where(F.col("amplitude") * 1.5 > F.col("_mean")).groupBy("recording_id").agg(F.min("start_frame").alias("start_frame"))


def marker_shifts(tones: DataFrame, markers: DataFrame) -> DataFrame:
    """The markers of each recording gone through in order. A row a marker: recording_id, marker (from 1), known, delay (frames from where the tone is looked for), shift (of the blocks up to the closing marker), carried (of all
    blocks after that), found, tone_start and tone_frames of the tone, sample_rate.

    markers: recording_id, marker, search_frame (where the layout puts the end of the marker's line), tone_hz, half (frames of the tone, and of the silence after it), known. tones: exact_tones. The search begins where the shifts so far have
    moved it. After the tone and as much silence the segment begins: a known one is shifted by itself; one of unknown length ends that silence after the tone's own end, and all that follows is shifted with it. A tone that is not found shifts nothing more.
    """
    heard = tones.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("start_frame", "frames", "tone_hz"))).alias("heard"))
    row = F.struct("marker", F.col("search_frame").cast("long").alias("search_frame"), F.col("tone_hz").cast("double").alias("tone_hz"), F.col("half").cast("long").alias("half"), "known")
    own = markers.groupBy("recording_id", "sample_rate").agg(F.array_sort(F.collect_list(row)).alias("marks")).join(heard, "recording_id", "left").withColumn("heard", F.coalesce("heard", F.expr("cast(array() as array<struct<start_frame:bigint,frames:bigint,tone_hz:double>>)")))
    fold = F.expr(
        """aggregate(marks, named_struct('carry', 0L, 'out', cast(array() as array<struct<marker:bigint,known:boolean,delay:bigint,shift:bigint,carried:bigint,found:boolean,tone_start:bigint,tone_frames:bigint>>)), (s, m) ->
            transform(array(get(filter(heard, h -> h.tone_hz = m.tone_hz AND h.start_frame + h.frames / 2 >= m.search_frame + s.carry AND h.frames >= m.half * 0.5D AND h.frames <= m.half * 2), 0)), h ->
                transform(array(named_struct('delay', h.start_frame - m.search_frame - s.carry, 'shift', CASE WHEN h IS NULL THEN s.carry WHEN m.known THEN h.start_frame - m.search_frame + 2 * m.half ELSE h.start_frame + h.frames + m.half - m.search_frame END)), d ->
                    named_struct('carry', CASE WHEN m.known THEN s.carry ELSE d.shift END, 'out', concat(s.out, array(named_struct('marker', cast(m.marker as bigint), 'known', m.known, 'delay', d.delay, 'shift', d.shift, 'carried', CASE WHEN m.known THEN s.carry ELSE d.shift END, 'found', h IS NOT NULL, 'tone_start', h.start_frame, 'tone_frames', h.frames)))))[0])[0])"""
    )
    return own.withColumn("_o", F.explode(fold["out"])).select("recording_id", "sample_rate", "_o.*")


def exact_tones(source: DataFrame, tones: DataFrame, facts: DataFrame) -> DataFrame:
    """Of tone_islands those nine decibels below the loudest, of a length that a marker's tone may have, with both ends to the frame. facts: recording_id, sample_rate, tone_hz, half."""
    top = F.max("rung").over(Window.partitionBy("recording_id", "tone_hz"))
    kinds = facts.select("recording_id", F.col("sample_rate").cast("double").alias("sample_rate"), F.col("tone_hz").cast("double").alias("tone_hz"), "half").distinct()
    own = tones.withColumn("_top", top).where(F.col("rung") == F.col("_top") - 3).join(kinds, ["recording_id", "tone_hz"]).where("frames >= 0.5 * half AND frames <= 2 * half")
    starts = own.groupBy("recording_id", "sample_rate", F.col("tone_hz").alias("pulse_hz"), F.col("start_frame").alias("found_frame")).agg(F.max("frames").cast("double").alias("length"))
    exact = refine_starts(source, samples.stored(starts, "tones"))
    at = lambda c: F.floor(F.col(c) + 0.5)
    return exact.select("recording_id", F.col("pulse_hz").alias("tone_hz"), at("start").alias("start_frame"), (at("stop") - at("start")).alias("frames"))


def marker_slots(shifts: DataFrame, markers: DataFrame) -> DataFrame:
    """What a found marker is made of: recording_id, marker, slot, start_frame, n_frames, sample_rate; slot 0 is what comes before the tone, 1 the tone, 2 the silence after it."""
    half = markers.select("recording_id", "marker", "half")
    slot = lambda k, at, n: F.struct(F.lit(k).alias("slot"), at.cast("long").alias("start_frame"), n.cast("long").alias("n_frames"))
    c = F.col
    slots = F.array(slot(0, c("tone_start") - c("delay"), c("delay")), slot(1, c("tone_start"), c("tone_frames")), slot(2, c("tone_start") + c("tone_frames"), c("half")))
    found = shifts.where("found").join(half, ["recording_id", "marker"]).withColumn("_s", F.explode(slots))
    return found.select("recording_id", "marker", "_s.*", "sample_rate").where("n_frames > 0")


def shifted_bounds(bounds: DataFrame, shifts: DataFrame) -> DataFrame:
    """Bounds (recording_id, start_frame, marker: opening markers up to the block, inside: whether it lies before the closing one, and more) moved by marker_shifts."""
    own = shifts.select("recording_id", "marker", "shift", "carried")
    out = bounds.join(own, ["recording_id", "marker"], "left")
    return out.withColumn("start_frame", F.col("start_frame") + F.coalesce(F.when(F.col("inside"), F.col("shift")).otherwise(F.col("carried")), F.lit(0))).drop("shift", "carried")
