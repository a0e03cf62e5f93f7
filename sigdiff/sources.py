"""Reading recordings and profiles, pairing, and writing results."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigdiff.storage import stored

#: Lowest dBFS and largest integer by bit depth.
FULL_SCALE = [(8, -48.16, 127.0), (16, -96.33, 32767.0), (24, -144.49, 8388607.0), (32, -192.66, 2147483647.0), (64, -192.66, 2147483647.0)]
CHUNKS = "recording_id string, path string, sample_rate double, channels int, bits int, is_float boolean, n_frames long, chunk_no long, start_frame long, left array<double>, right array<double>, reason string"


def parse_wav(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header facts and frames (frames, channels) of a RIFF file; raises ValueError with the reason where it is not accepted."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, fmt, data = 12, None, None
    while at + 8 <= len(raw) and data is None:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            fmt = raw[at + 8 : at + 8 + size]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or len(fmt) < 16:
        raise ValueError("no format chunk")
    if data is None:
        raise ValueError("no data chunk")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if kind == 0xFFFE and len(fmt) >= 26:
        kind = struct.unpack_from("<H", fmt, 24)[0]
    if channels not in (1, 2):
        raise ValueError("only one or two channels")
    dtype = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "24", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((kind, bits))
    if dtype is None:
        raise ValueError(f"format {kind} of {bits} bits")
    frame = channels * bits // 8
    data = data[: len(data) // frame * frame]
    if not data:
        raise ValueError("no samples")
    if dtype == "24":
        three = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16).astype(np.int32)
        x = np.where(x >= 1 << 23, x - (1 << 24), x).astype(np.float64)
    else:
        x = np.frombuffer(data, dtype).astype(np.float64)
        if bits == 8:
            x -= 128
    return {"sample_rate": float(rate), "channels": channels, "bits": bits, "is_float": kind == 3}, x.reshape(-1, channels)


#: Bytes of a file that Spark can hand to a task, at most.
FILE_LIMIT = 2_000_000_000


def _root(path: str) -> str:
    """The part of a path or pattern before its first folder or name with a wildcard, without scheme and host."""
    plain = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", path, flags=re.I)
    head = re.split(r"[*?\[{]", plain)[0]
    return head if head == plain and not plain.endswith("/") and "." not in plain.rsplit("/", 1)[-1] else head.rsplit("/", 1)[0]


def read_recordings(spark: SparkSession, path: str, file_limit: int = FILE_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, sample_chunks, rejects). Each file is decoded once, into chunks of one second, which are stored.

    A recording's id is its path below the pattern's fixed folder, without the extension. Files that are no accepted recordings, or longer than
    file_limit bytes, are rejects with a reason; the long ones are never read.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
        made = lambda row: pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
        for batch in batches:
            for own, where, content in zip(batch.column("recording_id").to_pylist(), batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    facts, x = parse_wav(content.as_py())
                except ValueError as e:
                    yield made([own, where, *[None] * 9, str(e)])
                    continue
                step = int(facts["sample_rate"]) or 1
                for k in range(0, -(-len(x) // step)):
                    part = x[k * step : (k + 1) * step]
                    yield made([own, where, facts["sample_rate"], facts["channels"], facts["bits"], facts["is_float"], len(x), k, k * step, part[:, 0], part[:, 1] if facts["channels"] == 2 else None, None])

    files = _files(spark, path)
    every = stored(files.where(F.col("length") <= file_limit).select("recording_id", "path", "content").mapInArrow(run, CHUNKS), "recordings")
    long = files.where(F.col("length") > file_limit).select("recording_id", "path", F.lit("too long").alias("reason"))
    recordings = every.where("chunk_no = 0").select(*names[:7])
    return recordings, every.where("reason IS NULL").select("recording_id", "sample_rate", *names[7:11]), every.where("reason IS NOT NULL").select("recording_id", "path", "reason").unionByName(long)


def _files(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Of the files of a path or pattern, or of only some of them: recording_id (the path below the pattern's fixed folder, without the extension), path, length, modificationTime and content of files."""
    root = _root(path).rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    below = F.when(F.startswith(bare, F.lit(root)), F.substring(bare, len(root) + 1, 2**31 - 1)).otherwise(bare)
    return spark.read.format("binaryFile").load(path if only is None else only).withColumn("recording_id", F.regexp_replace(below, r"\.[^./]*$", ""))


def recording_files(spark: SparkSession, path: str, file_limit: int = FILE_LIMIT, only: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1 without storing samples: (recordings, files, rejects). files (recording_id, content) is a source for all that needs samples, decoded by each task that reads a part of it; recordings and rejects are stored."""
    facts = [c for c in CHUNKS.split(", ") if c.split()[0] not in ("chunk_no", "start_frame", "left", "right")]
    files = _files(spark, path, only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for own, where, content in zip(batch.column("recording_id").to_pylist(), batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    found, x = parse_wav(content.as_py())
                    rows.append((own, where, found["sample_rate"], found["channels"], found["bits"], found["is_float"], len(x), None))
                except ValueError as e:
                    rows.append((own, where, *[None] * 5, str(e)))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in facts])

    short = files.where(F.col("length") <= file_limit)
    every = stored(short.select("recording_id", "path", "content").mapInArrow(run, ", ".join(facts)), "recordings")
    long = files.where(F.col("length") > file_limit).select("recording_id", "path", F.lit("too long").alias("reason"))
    good = every.where("reason IS NULL")
    return good.drop("reason"), short.select("recording_id", "content"), every.where("reason IS NOT NULL").select("recording_id", "path", "reason").unionByName(long)


def decoded_chunks(files: DataFrame) -> DataFrame:
    """Chunks of a second of files (recording_id, content) as they are read; files that are no accepted recordings have none."""
    schema = "recording_id string, sample_rate double, n_frames long, chunk_no long, start_frame long, left array<double>, right array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, content in zip(batch.column("recording_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    facts, x = parse_wav(content.as_py())
                except ValueError:
                    continue
                step = int(facts["sample_rate"]) or 1
                for k in range(0, -(-len(x) // step)):
                    part = x[k * step : (k + 1) * step]
                    row = (own, facts["sample_rate"], len(x), k, k * step, part[:, 0], part[:, 1] if facts["channels"] == 2 else None)
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return files.select("recording_id", "content").mapInArrow(run, schema)


def recording_facts(recordings: DataFrame, end_hz: float, profile_seconds: float, needs_stereo: bool = False) -> DataFrame:
    """S2."""
    nyquist = F.col("sample_rate") / 2
    seconds = F.col("n_frames") / F.col("sample_rate")
    out = recordings.withColumn("seconds", seconds).withColumn("end_hz", F.least(nyquist, F.lit(end_hz))).withColumn("nyquist_limited", nyquist < end_hz)
    return out.withColumn("too_short", seconds < profile_seconds).withColumn("not_stereo", F.col("channels") < 2 if needs_stereo else F.lit(False))


def pair_full_scale(pairs: DataFrame, recordings: DataFrame) -> DataFrame:
    """S3 for pairs: the deeper side's values hold for both."""
    each = full_scale(recordings).select("recording_id", "bits", "lowest_dbfs", "full_scale")
    side = lambda n: each.select(F.col("recording_id").alias(f"{n}_id"), F.struct("bits", "lowest_dbfs", "full_scale").alias(n))
    both = pairs.join(side("ref"), "ref_id").join(side("comp"), "comp_id").withColumn("deep", F.greatest("ref", "comp"))
    return both.select(*pairs.columns, "deep.lowest_dbfs", "deep.full_scale")


def full_scale(recordings: DataFrame) -> DataFrame:
    """S3: lowest_dbfs and full_scale by depth; the lookup has five rows."""
    look = recordings.sparkSession.createDataFrame(FULL_SCALE, "bits int, lowest_dbfs double, full_scale double")
    return recordings.join(F.broadcast(look), "bits")


#: Fixed letters of type lines in profile files, with kinds and type ids.
KINDS = {"s": ("sync", -2), "n": ("silence", -1), "k": ("skip", -6), "t": ("time_domain", -7), "N": ("silence_override", -8), "W": ("watermark", -9), "i": ("internal_sync", -4), "I": ("internal_sync_unknown", -5)}
#: Fixed forms of the lines. Of type lines by kind: name, type, elements, frames, then what differs.
VERSION = "2.3"
_START = r"^\S+\s+{}\s+\d+\s+\d+\s+"
LINES = {
    "regular": _START.format(r"(-?\d+|[snktN])") + r"-?\d+\s+\S+\s+[mSsn](\s+\S)?$",
    "internal": _START.format("[iI]") + r"\S+\s+[mSsn]\s+\d+\s+[\d.]+$",
    "watermark": _START.format("W") + r"\S+\s+[mSsn]\s+\d+\s+\d+\s+\S+$",
    "nosync": _START.format(r"(-?\d+|[snktN])") + r"\S+\s+[mSsn]$",
    "mode": r"^\S+\s+[\d.]+\s+[\d.]+\s+\d+\s+\d+\s+\d+$",
    "clock": r"^\S+\s+(n.*|y\s+\d+\s+[\d.]+\s+[\d.]+(\s+(\*|[\d\s]+))?)$",
}


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles, video_modes, profile_types, rejects) of text profiles; what follows a semicolon is a comment.

    With sync: version; name; [VideoModes] n; n lines ``name ms_per_frame lines hertz frames pulses``; clock ``name y block hertz ratio [types]`` or ``name n``;
    [MonoBalanceBlock] b; [ToneLines] n; n type lines. Without: version; name; milliseconds a frame of both sides; A, M, D or L; n; n type lines.
    A line that does not have its place's form is a reject with a reason, and so is a profile with another version or number of type lines.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("profile_id"), F.split("value", r"\r?\n").alias("raw"))
    kept = F.filter(F.transform("raw", lambda x: F.trim(F.regexp_replace(x, r";.*$|\t", " "))), lambda x: x != "")
    whole = text.select("profile_id", kept.alias("lines"))
    line = lambda k: F.coalesce(F.get("lines", k), F.lit(""))
    head = whole.withColumn("kind", F.when(F.lower(line(0)).contains("nosync"), "nosync").otherwise("sync"))
    head = head.withColumn("version", F.regexp_extract(line(0), r"^\S+\s+([\d.]+)$", 1)).withColumn("name", line(1))
    count = lambda c, form: F.coalesce(F.expr("try_cast({} AS int)".format(c)), F.lit(0)).alias(form)
    head = head.withColumn("n_modes", F.when(F.col("kind") == "sync", count(r"regexp_extract(get(lines, 2), '^.VideoModes.\\s+(\\d+)$', 1)", "n")).otherwise(F.lit(2)))
    head = head.withColumn("n_lines", F.when(F.col("kind") == "sync", count(r"regexp_extract(get(lines, n_modes + 5), '^.ToneLines.\\s+(\\d+)$', 1)", "n")).otherwise(count("get(lines, 5)", "n")))
    head = head.withColumn("first", F.when(F.col("kind") == "sync", F.col("n_modes") + 6).otherwise(6))
    each = head.select("profile_id", "kind", "n_modes", "n_lines", "first", F.posexplode("lines").alias("ord", "line")).withColumn("p", F.split("line", r"\s+"))
    sync = F.col("kind") == "sync"

    mode_lines = each.where(sync & (F.col("ord") >= 3) & (F.col("ord") < F.col("n_modes") + 3))
    p = lambda k: F.get("p", k)
    fits = lambda form: F.col("line").rlike(LINES[form])
    modes = mode_lines.where(fits("mode")).select("profile_id", (F.col("ord") - 3).alias("mode_no"), p(0).alias("mode_name"), p(1).cast("double").alias("ms_per_frame"), p(2).cast("double").alias("line_count"), p(3).cast("int").alias("pulse_hz"), p(4).cast("int").alias("pulse_frames"), p(5).cast("int").alias("pulse_count"))
    free = head.where("kind = 'nosync'").select("profile_id", F.posexplode(F.slice("lines", 3, 2)).alias("mode_no", "ms"))
    none = lambda kind: F.lit(None).cast(kind)
    free = free.select("profile_id", "mode_no", F.element_at(F.array(F.lit("reference"), F.lit("comparison")), F.col("mode_no") + 1).alias("mode_name"), F.expr("try_cast(ms AS double)").alias("ms_per_frame"), none("double").alias("line_count"), *(none("int").alias(c) for c in ("pulse_hz", "pulse_frames", "pulse_count")))

    types = each.where((F.col("ord") >= F.col("first")) & (F.col("ord") < F.col("first") + F.col("n_lines")))
    letter = F.substring(p(1), 1, 1)
    form = F.when(letter == "W", "watermark").when(sync & letter.isin("i", "I"), "internal").when(sync, "regular").otherwise("nosync")
    good = F.when(letter == "W", fits("watermark")).when(sync & letter.isin("i", "I"), fits("internal")).when(sync, fits("regular")).otherwise(fits("nosync"))
    types = types.withColumn("form", form).withColumn("good", good)
    look = lambda k: F.coalesce(*(F.when(letter == c, F.lit(v[k])) for c, v in KINDS.items()))
    own = F.expr("try_cast(p[1] AS int)")
    shift = F.when(F.col("form") == "regular", 1).otherwise(0)  # a regular line has cut frames before its colour
    at = lambda k: F.get("p", F.lit(k) + shift)
    special = lambda kind, k, t: F.when(F.col("form") == kind, F.expr(f"try_cast(get(p, {k}) AS {t})"))
    lines = types.where("good").select(
        "profile_id", (F.col("ord") - F.col("first")).alias("ord"), p(0).alias("type_name"),
        F.when(own >= 1, "user").otherwise(F.coalesce(look(0), F.lit("silence"))).alias("kind"), F.coalesce(own, look(1)).alias("type_id"),
        p(2).cast("int").alias("elements"), p(3).cast("int").alias("frames"), F.when(F.col("form") == "regular", F.abs(p(4).cast("int"))).otherwise(0).alias("cut_frames"),
        at(4).alias("colour"), at(5).alias("channel"), F.when(F.col("form") == "regular", F.get("p", F.lit(7))).alias("mask"),
        special("internal", 6, "int").alias("tone_hz"), special("internal", 7, "double").alias("tone_seconds"),
        special("watermark", 6, "int").alias("valid_hz"), special("watermark", 7, "int").alias("invalid_hz"), special("watermark", 8, "string").alias("mark_name"),
    )

    clock = F.split(F.when(F.col("kind") == "sync", F.expr("get(lines, n_modes + 3)")), r"\s+")
    marks = lines.where("kind = 'watermark'").groupBy("profile_id").agg(*(F.min(c).alias(n) for c, n in (("valid_hz", "wm_valid_hz"), ("invalid_hz", "wm_invalid_hz"), ("mark_name", "wm_name"))))
    listed = F.expr("filter(transform(slice(clk, 6, size(clk)), x -> try_cast(x AS int)), x -> x IS NOT NULL)")
    profiles = head.withColumn("clk", clock).withColumn("clocked", F.get("clk", 1) == "y").select(
        "profile_id", "name", "version", "kind", F.when(~sync, line(4)).alias("sync_kind"), F.get("clk", 0).alias("clk_name"),
        *(F.expr(f"IF(clocked, try_cast(get(clk, {k}) AS {t}), NULL)").alias(n) for k, t, n in ((2, "int", "clk_block"), (3, "double", "clk_hz"), (4, "double", "clk_ratio"))),
        F.when(F.col("clocked") & (F.size(listed) > 0), listed).alias("clk_types"),
        F.expr(r"IF(kind = 'sync', try_cast(regexp_extract(get(lines, n_modes + 4), '^.MonoBalanceBlock.\\s+(-?\\d+)', 1) AS int), NULL)").alias("balance_block"),
    ).join(marks, "profile_id", "left")

    bad = lambda df, reason: df.select("profile_id", "ord", "line", F.lit(reason).alias("reason"))
    of_file = lambda condition, reason: bad(head.where(condition).select("profile_id", F.lit(0).alias("ord"), line(0).alias("line")), reason)
    rejects = bad(types.where("NOT good"), "type line").unionByName(bad(mode_lines.where(~fits("mode")), "mode line")).unionByName(bad(each.where(sync & (F.col("ord") == F.col("n_modes") + 3) & ~fits("clock")), "clock line"))
    rejects = rejects.unionByName(of_file(F.col("version") != VERSION, "version")).unionByName(of_file(F.size("lines") != F.col("first") + F.col("n_lines"), "number of lines"))
    return profiles, modes.unionByName(free), lines.drop("valid_hz", "invalid_hz", "mark_name"), rejects


#: About as many recordings of a group are in a part; each two parts of a group are paired apart.
PART_ROWS = 1000


def _pairs_within(recordings: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """Each two recordings of a group. A group is cut into parts by a hash of the id, and each two of its parts, or a part and itself, are one key of the join, so that
    large groups are spread over all tasks and no task holds more than a part. Rows of two parts make one pair each, and only the smaller id has to be found.

    The shuffle has few bytes for its many pairs; the number of tasks is therefore given, four for each of spark.sql.shuffle.partitions, and not left to their bytes.
    """
    tasks = 4 * int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = recordings.where("recording_id IS NOT NULL")
    sizes = known.groupBy(*group).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    dealt = known.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64("recording_id"), "_parts").cast("int"))
    key, names = [*group, "_low", "_high"], {"recording_id": "id"} | {c: c for c in carried}  # ids as text are made once a recording, not once a pair
    own = lambda side: [F.col("recording_id").cast("string").alias(f"{side}text"), *(F.col(c).alias(f"{side}{n}") for c, n in names.items())]
    low = dealt.select(*group, *own("_a_"), F.col("_part").alias("_low"), F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("_high")).repartition(tasks, *key)
    high = dealt.select(*group, *own("_b_"), F.explode(F.sequence(F.lit(0), "_part")).alias("_low"), F.col("_part").alias("_high")).repartition(tasks, *key)
    rises = F.col("_a_id") < F.col("_b_id")
    found = low.join(high.hint("merge"), key).where((F.col("_low") < F.col("_high")) | rises)
    sides = (F.when(rises, F.col(f"{first}{n}")).otherwise(F.col(f"{second}{n}")).alias(f"{side}_{n}") for side, first, second in (("ref", "_a_", "_b_"), ("comp", "_b_", "_a_")) for n in names.values())
    return found.select(*group, *sides, F.when(rises, F.concat_ws("-", "_a_text", "_b_text")).otherwise(F.concat_ws("-", "_b_text", "_a_text")).alias("pair_id"))


def make_pairs(recordings: DataFrame, mode: str, group: list[str] | None = None, references: DataFrame | None = None, listed: DataFrame | None = None, carried: list[str] | None = None) -> DataFrame:
    """Mode all (each two of a group), one_to_many (references: recording_id and the group columns) or list (listed: ref_id, comp_id).

    Pairs of a group come from a join on the group. Without a group, mode all is every two recordings, as many as the square of their
    number, which has to be asked for by an empty list. carried, with mode all and a group: columns of recordings that each pair has as ref_ and comp_, so that they need not
    be joined to the pairs, which are many more than the recordings.
    """
    if carried and not (mode == "all" and group):
        raise ValueError("columns are carried with mode all and a group")
    if mode == "list":
        known = lambda n: recordings.select(F.col("recording_id").alias(n))
        return listed.where("ref_id <> comp_id").join(known("ref_id"), "ref_id", "left_semi").join(known("comp_id"), "comp_id", "left_semi").select("ref_id", "comp_id").distinct().withColumn("pair_id", F.concat_ws("-", "ref_id", "comp_id"))
    if mode == "all" and group is None:
        raise ValueError("name the columns of a group, or [] for every two recordings")
    group = group or []
    if mode == "all" and group:
        return _pairs_within(recordings, group, carried or [])
    a = (references if mode == "one_to_many" else recordings).select(F.col("recording_id").alias("ref_id"), *group)
    b = recordings.select(F.col("recording_id").alias("comp_id"), *group)
    differ = F.col("ref_id") != F.col("comp_id") if mode == "one_to_many" else F.col("ref_id") < F.col("comp_id")
    found = a.join(b, group).where(differ) if group else a.join(b, differ)
    return found.withColumn("pair_id", F.concat_ws("-", "ref_id", "comp_id"))


def resolve_modes(pairs: DataFrame, modes: DataFrame, by: str = "mode_no") -> DataFrame:
    """ms_per_frame, lines and pulses of both sides by mode number, or by mode_name (in any case); a profile has nine modes at most.

    pairs: profile_id, ref_mode, comp_mode. Pairs whose modes the profile does not have keep nulls.
    """
    key = lambda c: F.lower(c) if by == "mode_name" else F.col(c)
    facts = {"ms_per_frame": "ms", "line_count": "lines", "pulse_hz": "pulse_hz", "pulse_frames": "pulse_frames", "pulse_count": "pulses"}
    side = lambda n: modes.select("profile_id", key(by).alias(f"_{n}"), *(F.col(c).alias(f"{n}_{v}") for c, v in facts.items()))
    out = pairs.withColumn("_ref", key("ref_mode")).withColumn("_comp", key("comp_mode"))
    return out.join(side("ref"), ["profile_id", "_ref"], "left").join(side("comp"), ["profile_id", "_comp"], "left").drop("_ref", "_comp")


def apply_manual_sync(bounds: DataFrame, manual: DataFrame) -> DataFrame:
    """The user's start and end frames override what was found."""
    own = manual.select("recording_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    out = bounds.join(own, "recording_id", "left")
    return out.withColumn("start_frame", F.coalesce("_s", "start_frame")).withColumn("end_frame", F.coalesce("_e", "end_frame")).withColumn("status", F.when(F.col("_s").isNotNull(), "manual").otherwise(F.col("status"))).drop("_s", "_e")


def _in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df with a folder number, and all rows of one in one task, so that each folder has one file and there are no more folders than buckets."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")


def write_differences(matched: DataFrame, significance: float, path: str, buckets: int = 64) -> None:
    """Text with pair_id, type_id, hertz, diff_amplitude, in folders by a hash of the pair."""
    own = matched.where((F.col("kind") == "user") & (F.col("ref_amplitude") > significance)).select("pair_id", "type_id", "hertz", "diff_amplitude")
    _in_buckets(own, "pair_id", buckets).write.partitionBy("bucket").csv(path, header=True)


def difference_report(matched: DataFrame, missing: DataFrame) -> DataFrame:
    """A row for each block and finding (differing, phase, missing), ranked within them by loudness of the reference."""
    row = lambda df, name, value: df.select("pair_id", "block_no", "channel", F.lit(name).alias("finding"), "hertz", F.col("ref_amplitude").alias("amplitude"), value.alias("value"))
    a = row(matched.where("abs(diff_amplitude) >= 1e-5"), "differing", F.col("diff_amplitude"))
    b = row(matched.where("abs(diff_phase) >= 1e-5"), "phase", F.col("diff_phase"))
    c = row(missing.withColumnRenamed("amplitude", "ref_amplitude"), "missing", F.lit(None).cast("double"))
    w = Window.partitionBy("pair_id", "block_no", "channel", "finding").orderBy(F.desc("amplitude"), "hertz")
    return a.unionByName(b).unionByName(c).withColumn("rank", F.row_number().over(w))


def report_totals(report: DataFrame) -> DataFrame:
    """Findings of each pair and block, and of each pair (block_no null)."""
    sets = [[F.col("pair_id"), F.col("finding")], [F.col("pair_id"), F.col("block_no"), F.col("finding")]]
    return report.groupingSets(sets, "pair_id", "block_no", "finding").agg(F.count("*").alias("n"))


def write_block_samples(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """In folders by a hash of the recording, so that a recording's blocks lie together."""
    _in_buckets(blocks, "recording_id", buckets).write.partitionBy("bucket").parquet(path)
