"""More registered queries and their SQL: samples, synchronisation, levels, datasets, reports and streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigdiff import compare as c
from sigdiff import exprs as e
from sigdiff import layout as p
from sigdiff import levels as a
from sigdiff import samples as sa
from sigdiff import series as d
from sigdiff import sources as so
from sigdiff import spectrum as u
from sigdiff import streaming as st
from sigdiff import sync as sy
from sigdiff.fixtures import OPTIONS, Fixture
from sigdiff.queries import TYPES, S, _query, n, r4, r6
from sigdiff.storage import shared_path

OFFSETS = """, o AS (
  SELECT block_no, coalesce(sum(18 + block_no % 5) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x
  FROM (SELECT DISTINCT vec_id // 5 AS block_no FROM embeddings)
)
"""
CHUNKS = """
WITH s AS (
  SELECT (vec_id % 5)::VARCHAR AS recording_id, vec_id // 5 * 64 + unnest(range(64)) AS frame, unnest(embedding)::DOUBLE AS x
  FROM embeddings WHERE vec_id % 7 <> 3
), r AS (SELECT DISTINCT (vec_id % 5)::VARCHAR AS recording_id, vec_id // 5 AS block_no FROM embeddings)
"""

# ---- rows of spectra ----


@_query("w1_rank_bins", "SELECT recording_id, block_no, bin, rank FROM spec")
def _w1(x: Fixture) -> DataFrame:
    return u.rank_bins(x.spec.drop("rank")).select("recording_id", "block_no", n("bin"), n("rank"))


@_query("a3_self_normalise", "SELECT recording_id, block_no, bin, round(amplitude, 4) AS amplitude FROM own")
def _a3(x: Fixture) -> DataFrame:
    return x.own_levels.select("recording_id", "block_no", n("bin"), r4("amplitude"))


@_query("p9_significant", "SELECT pair_id, 'ref' AS side, block_no, bin FROM ref UNION ALL SELECT pair_id, 'comp', block_no, bin FROM comp")
def _p9(x: Fixture) -> DataFrame:
    side = lambda df, name: df.select("pair_id", F.lit(name).alias("side"), "block_no", n("bin"))
    return side(x.ref, "ref").unionByName(side(x.comp, "comp"))


@_query("p10_band", "SELECT recording_id, block_no, bin FROM spec WHERE bin >= 4 AND bin < 20")
def _p10(x: Fixture) -> DataFrame:
    return u.band(x.spec, 3.5, 20.2).select("recording_id", "block_no", n("bin"))


@_query("p11_only", "SELECT recording_id, block_no, bin FROM spec WHERE kind = 'silence'")
def _p11(x: Fixture) -> DataFrame:
    return u.only(x.spec, "silence").select("recording_id", "block_no", n("bin"))


@_query(
    "k2_peak_candidates",
    """, l AS (SELECT recording_id, avg(magnitude) + stddev_samp(magnitude) AS lim FROM spec WHERE kind <> 'silence' GROUP BY 1),
    q AS (SELECT s.*, row_number() OVER (PARTITION BY s.recording_id ORDER BY magnitude DESC) AS number FROM spec s JOIN l USING (recording_id) WHERE kind <> 'silence' AND magnitude > lim)
    SELECT recording_id, number, block_no, bin FROM q WHERE number <= 500""",
)
def _k2(x: Fixture) -> DataFrame:
    return a.peak_candidates(x.spec).select("recording_id", n("number"), "block_no", n("bin"))


@_query("j2b_match_tolerance", "SELECT pair_id, block_no, hertz, round(diff_amplitude, 4) AS diff_amplitude FROM every")
def _j2b(x: Fixture) -> DataFrame:
    return c.match(x.ref, x.comp, 1e-5).select("pair_id", "block_no", "hertz", r4("diff_amplitude"))


# ---- clock: a block of ten is a reading of the clock ----


@_query(
    "j11_clock",
    """, k3 AS (SELECT * FROM spec WHERE block_no % 10 = 3)
    SELECT recording_id, coalesce(arg_max(hertz, magnitude) FILTER (abs(hertz - 12) <= 0.6), arg_max(hertz, magnitude)) AS clock_hz FROM k3 GROUP BY 1""",
)
def _j11(x: Fixture) -> DataFrame:
    expected = x.spec.select("recording_id").distinct().withColumn("clk_hz", F.lit(12.0))
    return sy.clock_hz(x.spec.where("block_no % 10 = 3"), expected).select("recording_id", "clock_hz")


@_query("a26_clock_levels", "SELECT recording_id, round(max(magnitude), 6) AS peak FROM spec WHERE block_no % 10 = 3 GROUP BY 1")
def _a26(x: Fixture) -> DataFrame:
    return sy.clock_levels(x.spec.where("block_no % 10 = 3")).select("recording_id", r6("peak"))


@_query(
    "d9_clock_series",
    """, k3 AS (SELECT * FROM spec WHERE block_no % 10 = 3), t AS (SELECT recording_id, max(magnitude) AS p FROM k3 GROUP BY 1),
    z AS (SELECT pair_id, ref_id, comp_id, greatest(r.p, q.p) AS z FROM pairs JOIN t r ON r.recording_id = ref_id JOIN t q ON q.recording_id = comp_id)
    SELECT pair_id, 'ref' AS side, bin, round(20 * log10(magnitude / z), 4) AS amplitude FROM z JOIN k3 ON recording_id = ref_id
    UNION ALL SELECT pair_id, 'comp', bin, round(20 * log10(magnitude / z), 4) FROM z JOIN k3 ON recording_id = comp_id""",
)
def _d9(x: Fixture) -> DataFrame:
    return d.clock_series(x.spec.where("block_no % 10 = 3"), x.pairs).select("pair_id", "side", n("bin"), r4("amplitude"))


# ---- levels ----

#: lineitem as levels of a recording (supplier): its floor and mean in dB of its own peak.
FLOORS = """
WITH l AS (SELECT l_suppkey AS k, (l_extendedprice * l_quantity * (l_discount + 0.001))::DOUBLE AS v FROM lineitem),
m AS (SELECT k, max(v) AS top FROM l GROUP BY 1),
f AS (SELECT k, 20 * log10(min(v) / max(top)) AS floor, avg(20 * log10(v / top)) AS mean FROM l JOIN m USING (k) GROUP BY 1),
g AS (SELECT r.k AS ref_id, q.k AS comp_id, r.floor AS rf, q.floor AS cf, r.mean AS rm, q.mean AS cm FROM f r JOIN f q ON q.k = r.k + 1),
h AS (SELECT *, CASE WHEN rf > rm THEN -66 ELSE rf END AS r1, CASE WHEN cf > cm THEN -66 ELSE cf END AS c1 FROM g)
"""


@_query(
    "a10_significance",
    FLOORS
    + """SELECT ref_id, comp_id, round(CASE WHEN r1 < -66 AND c1 <= -40 AND r1 < c1 THEN c1 ELSE r1 END, 4) AS significance,
    rf > rm OR r1 > -40 AS ref_floor_too_high, cf > cm OR c1 > -40 AS comp_floor_too_high, r1 < -66 AND c1 <= -40 AND r1 < c1 AND abs(r1 - c1) > 20 AS floors_differ FROM h""",
    False,
)
def _a10(x: Fixture) -> DataFrame:
    v = (F.col("l_extendedprice") * F.col("l_quantity") * (F.col("l_discount") + 0.001)).cast("double")
    rows = x.read("lineitem").select(F.col("l_suppkey").alias("recording_id"), F.lit("user").alias("kind"), F.lit(1).alias("rank"), v.alias("magnitude"))
    own = a.self_normalise(rows)
    facts = own.groupBy("recording_id").agg(F.min("amplitude").alias("floor")).join(a.fundamental_stats(own, "amplitude").select("recording_id", "mean"), "recording_id")
    side = lambda name, key: facts.select(key.alias("key"), F.col("recording_id").alias(f"{name}_id"), F.col("floor").alias(f"{name}_floor"), F.col("mean").alias(f"{name}_mean"))
    pairs = side("ref", F.col("recording_id") + 1).join(side("comp", F.col("recording_id")), "key")
    return a.significance(pairs).select("ref_id", "comp_id", r4("significance"), "ref_floor_too_high", "comp_floor_too_high", "floors_differ")


@_query(
    "j10_line_frequencies",
    """SELECT p_partkey AS recording_id, unnest(['vertical', 'scan', 'cross']) AS line,
    round(unnest([1000 / (16 + p_size / 10.0), 1000 / (16 + p_size / 10.0) * (200 + p_size), 1000 / (16 + p_size / 10.0) * (200 + p_size) / 2]), 6) AS target_hz FROM part""",
    False,
)
def _j10(x: Fixture) -> DataFrame:
    rows = x.read("part").select(F.col("p_partkey").alias("recording_id"), (16 + F.col("p_size") / 10.0).alias("ms_per_frame"), (200 + F.col("p_size")).alias("line_count"))
    return a.noise_lines(rows).select("recording_id", "line", r6("target_hz"))


# ---- samples ----


@_query(
    "j1_cut_blocks",
    CHUNKS
    + """SELECT r.recording_id, block_no, 130 AS n_frames, round(coalesce(sum(x), 0), 4) AS total, round(coalesce(sum(x * (frame - block_no * 64 - 37)), 0), 3) AS moment, count(x) > 0 AS has_right
    FROM r LEFT JOIN s ON s.recording_id = r.recording_id AND frame BETWEEN block_no * 64 + 37 AND block_no * 64 + 166 GROUP BY ALL""",
    False,
)
def _j1(x: Fixture) -> DataFrame:
    """Blocks of 130 frames over three chunks each; some chunks are absent, and the last blocks go beyond the recording."""
    bounds = x.read("embeddings").select((F.col("vec_id") % 5).cast("string").alias("recording_id"), F.expr("vec_id div 5").alias("block_no"), F.expr("vec_id div 5 * 64 + 37").alias("start_frame"), F.lit(130).cast("long").alias("n_frames")).distinct()
    cut = sa.cut_blocks(x.chunks, bounds, 64)
    total = F.aggregate("left", F.lit(0.0), lambda t, v: t + v)
    moment = F.aggregate(F.transform("left", lambda v, i: v * i), F.lit(0.0), lambda t, v: t + v)
    return cut.select("recording_id", "block_no", F.size("left").alias("n_frames"), r4(total, "total"), F.round(moment, 3).alias("moment"), F.col("right").isNotNull().alias("has_right"))


@_query(
    "a24_local_sample_peak",
    CHUNKS
    + """SELECT r.recording_id, block_no * 64 + 30 AS frame, round(max(abs(x)), 6) AS peak
    FROM r JOIN s ON s.recording_id = r.recording_id AND frame BETWEEN block_no * 64 + 30 - 64 AND block_no * 64 + 30 + 64 GROUP BY ALL""",
    False,
)
def _a24(x: Fixture) -> DataFrame:
    around = x.read("embeddings").select((F.col("vec_id") % 5).cast("string").alias("recording_id"), F.expr("vec_id div 5 * 64 + 30").alias("frame"), F.lit(3840.0).alias("sample_rate")).distinct()
    return sa.local_sample_peak(x.chunks, around, 64).select("recording_id", "frame", r6("peak"))


@_query(
    "u8_digital_start",
    CHUNKS + "SELECT recording_id, min(frame) AS start_frame FROM s WHERE abs(x) > 2 * (SELECT stddev_samp(x) FROM s) GROUP BY 1",
    False,
)
def _u8(x: Fixture) -> DataFrame:
    """Quiet samples become zero; the right channel is silent."""
    limit = x.chunks.select(F.explode("left").alias("x")).agg((2 * F.stddev_samp("x")).alias("limit"))
    gated = x.chunks.join(F.broadcast(limit)).withColumn("left", F.expr("transform(left, v -> if(abs(v) > limit, v, 0D))")).withColumn("right", F.expr("transform(right, v -> 0D)"))
    return sy.digital_start(gated).select("recording_id", "start_frame")


@_query(
    "p3_block_bounds",
    TYPES + """, q AS (SELECT profile_id AS recording_id, block_no, frames * 16.6875::DOUBLE / 1000.0::DOUBLE * 1000.0::DOUBLE AS w FROM b)
    SELECT recording_id, block_no, floor(coalesce(sum(w) OVER (PARTITION BY recording_id
  ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1e-6)::BIGINT AS start_frame, floor(w)::BIGINT AS n_frames
  FROM q""",
    False,
)
def _p3(x: Fixture) -> DataFrame:
    blocks = p.block_seconds(p.block_layout(x.types).withColumn("ms_per_frame", F.lit(16.6875)))
    return p.block_bounds(blocks.select(F.col("profile_id").alias("recording_id"), F.lit(1000.0).alias("sample_rate"), F.col("block_no").cast("int").alias("block_no"), "seconds")).select("recording_id", n("block_no"), "start_frame", "n_frames")


@_query(
    "w3_cumulative",
    TYPES + "SELECT profile_id, ord, coalesce(sum(frames) OVER (PARTITION BY profile_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM t",
    False,
)
def _w3(x: Fixture) -> DataFrame:
    return p.cumulative(x.types, "frames", ["ord"], ["profile_id"]).select("profile_id", "ord", n("position"))


# ---- synchronisation ----

#: A27 written out case by case.
PULSES = "WITH q AS (SELECT user_id AS recording_id, event_id, 1000.0 + 1000 * (event_id % 3) AS hertz, value + 1 AS magnitude, -value / 3 AS amplitude FROM events)"


def _a27_sql(detail: bool) -> str:
    first = """CASE WHEN m <= 40 AND m >= 10 AND s < m AND pct > 5 THEN -m WHEN m <= 40 AND m >= 10 AND s < m THEN -(m + s / 2) WHEN m <= 40 AND m >= 10 THEN -(m + s / 4)
      WHEN m <= 40 THEN -(m + 2 * s) WHEN s < m THEN -(m - s) ELSE -(m - s / 2) END"""
    second = """CASE WHEN pct = 100 THEN -(m + s / 4) WHEN pct > 90 THEN -m WHEN pct > 55 AND m <= 40 AND s < m THEN -m WHEN pct > 55 AND m <= 40 THEN -(m + s / 4)
      WHEN pct > 55 AND s < m THEN -(m - s) WHEN pct > 55 THEN -(m - s / 2) WHEN s < m OR s + m <= 20 THEN -(m + s) ELSE -(m + s / 4) END"""
    return f""", g AS (SELECT recording_id, avg(abs(amplitude)) FILTER (h) AS m, stddev_samp(abs(amplitude)) FILTER (h) AS s, 100.0 * count(*) FILTER (h) / count(*) AS pct, count(*) FILTER (h) AS k
      FROM (SELECT *, hertz IN (1000, 2000, 3000) AND (hertz <> 3000 OR {'true' if not detail else 'false'}) AS h FROM q) GROUP BY 1)
    SELECT recording_id, round(pct, 4) AS hit_pct, round(CASE WHEN k <= 1 THEN 0 ELSE {second if detail else first} END, 4) AS threshold_db FROM g"""


@_query("a27_pulse_threshold", PULSES + _a27_sql(False), False)
def _a27(x: Fixture) -> DataFrame:
    return sy.pulse_threshold(x.pulses, 1000.0).select("recording_id", r4("hit_pct"), r4("threshold_db"))


@_query("a27_pulse_threshold_detail", PULSES + _a27_sql(True), False)
def _a27_detail(x: Fixture) -> DataFrame:
    return sy.pulse_threshold(x.pulses, 1000.0, harmonics=1, detail=True).select("recording_id", r4("hit_pct"), r4("threshold_db"))


@_query(
    "u7_signal_start",
    PULSES + """, m AS (SELECT recording_id, event_id, 20 * log10(magnitude) AS db, avg(20 * log10(magnitude)) OVER (PARTITION BY recording_id
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean
  FROM q)
    SELECT recording_id, min(event_id) AS start_frame FROM m WHERE db - mean > 0.5 * abs(mean) GROUP BY 1""",
    False,
)
def _u7(x: Fixture) -> DataFrame:
    return sy.signal_start(x.pulses).select("recording_id", "start_frame")


@_query(
    "j12_watermark",
    """, q AS (SELECT recording_id * 10 + type_id AS recording_id, bin * 50.0 AS hertz, amplitude, row_number() OVER v AS k, count(*) OVER (PARTITION BY recording_id, type_id) AS total
      FROM own WHERE kind = 'user' WINDOW v AS (PARTITION BY recording_id, type_id ORDER BY amplitude DESC)),
    g AS (SELECT recording_id, k, CASE WHEN abs(hertz - 500) <= 20 THEN 'valid' WHEN abs(hertz - 900) <= 20 THEN 'invalid' END AS state
  FROM q
  WHERE k <= greatest(ceil(total / 100), 1) AND amplitude > -33)
    SELECT r.recording_id, coalesce(arg_min(state, k) FILTER (state IS NOT NULL), 'unknown') AS watermark
  FROM (SELECT DISTINCT recording_id
  FROM q) r
  LEFT
  JOIN g USING (recording_id)
  GROUP BY 1""",
)
def _j12(x: Fixture) -> DataFrame:
    own = x.own_levels.where("kind = 'user'").withColumn("recording_id", F.col("recording_id") * 10 + F.col("type_id")).withColumn("hertz", F.col("bin") * 50.0)
    return sy.watermark_state(own, 500.0, 900.0, -66.0).select("recording_id", "watermark")


@_query(
    "j5_resolve_modes",
    """WITH m AS (SELECT n_regionkey AS profile_id, row_number() OVER (PARTITION BY n_regionkey
  ORDER BY n_nationkey) - 1 AS mode_no, 16 + n_nationkey / 10.0 AS ms, (200.0 + n_nationkey)::DOUBLE AS lines
  FROM nation),
    q AS (SELECT c_custkey, c_nationkey % 5 AS profile_id, c_custkey % 6 AS rm, c_nationkey % 4 AS cm FROM customer)
    SELECT c_custkey, round(r.ms, 4) AS ref_ms, round(k.ms, 4) AS comp_ms, r.lines AS ref_lines, k.lines AS comp_lines
    FROM q LEFT JOIN m r ON r.profile_id = q.profile_id AND r.mode_no = rm LEFT JOIN m k ON k.profile_id = q.profile_id AND k.mode_no = cm""",
    False,
)
def _j5(x: Fixture) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    free = lambda name: F.lit(None).cast("int").alias(name)
    modes = x.read("nation").select(F.col("n_regionkey").alias("profile_id"), number.alias("mode_no"), (16 + F.col("n_nationkey") / 10.0).alias("ms_per_frame"), (200.0 + F.col("n_nationkey")).alias("line_count"), free("pulse_hz"), free("pulse_frames"), free("pulse_count"))
    pairs = x.read("customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("profile_id"), (F.col("c_custkey") % 6).alias("ref_mode"), (F.col("c_nationkey") % 4).alias("comp_mode"))
    return so.resolve_modes(pairs, modes).select("c_custkey", r4("ref_ms"), r4("comp_ms"), "ref_lines", "comp_lines")


@_query(
    "u10_frame_rate_without_sync",
    "SELECT p_partkey, round((p_size + 1600) * 1000.0 / 48000 / 2, 6) AS ms_per_frame, round(1200 * log2(16.6884 / ((p_size + 1600) * 1000.0 / 48000 / 2)), 4) AS cents FROM part",
    False,
)
def _u10(x: Fixture) -> DataFrame:
    rows = x.read("part").select("p_partkey", F.lit(0).alias("start_frame"), (F.col("p_size") + 1600).alias("end_frame"), F.lit(48000.0).alias("sample_rate"), F.lit(2).alias("profile_frames"), F.lit(16.6884).alias("expected_ms"))
    return sy.frame_rate_without_sync(rows).select("p_partkey", r6("ms_per_frame"), r4("cents"))


# ---- datasets and reports ----


@_query("d3_spectrogram", "SELECT recording_id, type_id, bin, round(max(amplitude), 4) AS amplitude FROM own WHERE kind <> 'silence' GROUP BY 1, 2, 3")
def _d3(x: Fixture) -> DataFrame:
    return d.spectrogram(x.own_levels).select("recording_id", "type_id", n("bin"), r4("amplitude"))


@_query("d5_time_spectrogram", OFFSETS + "SELECT pair_id, x, hertz, round(max(amplitude), 4) AS amplitude FROM ref JOIN o USING (block_no) WHERE kind = 'user' GROUP BY 1, 2, 3")
def _d5(x: Fixture) -> DataFrame:
    return d.time_spectrogram(x.ref.where("kind = 'user'"), x.offsets).select("pair_id", "x", "hertz", r4("amplitude"))


@_query(
    "d6_unmatched_spectrogram",
    OFFSETS + """SELECT pair_id, 'missing' AS side, x, hertz, round(amplitude, 4) AS amplitude FROM missing JOIN o USING (block_no)
UNION ALL
SELECT pair_id, 'extra', x, hertz, round(amplitude, 4) FROM extra JOIN o USING (block_no)""",
)
def _d6(x: Fixture) -> DataFrame:
    return d.unmatched_spectrogram(x.missing, x.extra, x.offsets).withColumn("amplitude", r4("amplitude"))


@_query(
    "d11_high_difference_waveforms",
    """, h AS (SELECT pair_id, block_no FROM matched GROUP BY 1, 2 HAVING avg(abs(diff_amplitude)) >= 3),
    w AS (SELECT recording_id, block_no, n // 16 AS part, min(x) AS low, max(x) AS high FROM x GROUP BY 1, 2, 3)
    SELECT pair_id, side, w.block_no, part, round(low, 6) AS low, round(high, 6) AS high
  FROM h
  JOIN (SELECT pair_id, 'ref' AS side, ref_id AS recording_id
  FROM pairs
UNION ALL
SELECT pair_id, 'comp', comp_id FROM pairs) USING (pair_id)
    JOIN w USING (recording_id, block_no)""",
)
def _d11(x: Fixture) -> DataFrame:
    high = c.high_difference_blocks(x.sides, S, 3.0, 100.0)
    return d.high_difference_waveforms(high, x.pairs, sa.waveforms(x.blocks, 16)).select("pair_id", "side", "block_no", n("part"), r6("low"), r6("high"))


@_query(
    "d12_match_bars",
    """, m AS (SELECT pair_id, type_id, 100.0 * count(*) FILTER (abs(diff_amplitude) <= 1) / count(*) AS w, 100.0 * count(*) FILTER (abs(diff_amplitude) < 1e-5) / count(*) AS p
  FROM matched
  GROUP BY 1, 2),
    r AS (SELECT pair_id, type_id, count(*) AS k FROM ref WHERE kind = 'user' GROUP BY 1, 2),
l AS (SELECT pair_id, type_id, count(*) AS k FROM missing GROUP BY 1, 2),
    t AS (SELECT pair_id, type_id, count(*) AS k FROM comp WHERE kind = 'user' GROUP BY 1, 2),
e AS (SELECT pair_id, type_id, count(*) AS k FROM extra GROUP BY 1, 2)
    SELECT pair_id, type_id, round(w, 4) AS within_pct, round(p, 4) AS perfect_pct, round(100.0 * coalesce(l.k, 0) / r.k, 4) AS missing_pct, round(100.0 * coalesce(e.k, 0) / t.k, 4) AS extra_pct,
    w < 90 OR 100.0 * coalesce(l.k, 0) / r.k > 10 OR 100.0 * coalesce(e.k, 0) / t.k > 10 AS warn
    FROM m JOIN r USING (pair_id, type_id) JOIN t USING (pair_id, type_id) LEFT JOIN l USING (pair_id, type_id) LEFT JOIN e USING (pair_id, type_id)""",
)
def _d12(x: Fixture) -> DataFrame:
    user = lambda df: df.where("kind = 'user'")
    bars = d.match_bars(c.share_within(x.audible, OPTIONS.match_db), c.share_perfect(x.audible), c.share_unmatched(user(x.ref), x.missing), c.share_unmatched(user(x.comp), x.extra))
    return bars.select("pair_id", "type_id", r4("within_pct"), r4("perfect_pct"), r4("missing_pct"), r4("extra_pct"), "warn")


@_query(
    "d13_warnings",
    """, q AS (SELECT c_custkey AS recording_id, c_nationkey, c_mktsegment, (c_custkey % 90 + 1) * 1000 < 20000 * 2 AS nyquist_limited, c_acctbal < 4000 AS too_short, c_custkey % 3 = 0 AS not_stereo
  FROM customer),
    z AS (SELECT a.recording_id || '-' || b.recording_id AS pair_id, a AS r, b AS k
  FROM q a
  JOIN q b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.recording_id < b.recording_id)
    SELECT pair_id, unnest(list_filter([CASE WHEN r.nyquist_limited THEN 'ref_nyquist_limited' END, CASE WHEN r.too_short THEN 'ref_too_short' END, CASE WHEN r.not_stereo THEN 'ref_not_stereo' END,
      CASE WHEN k.nyquist_limited THEN 'comp_nyquist_limited' END, CASE WHEN k.too_short THEN 'comp_too_short' END, CASE WHEN k.not_stereo THEN 'comp_not_stereo' END], lambda w: w IS NOT NULL)) AS warning
  FROM z""",
)
def _d13(x: Fixture) -> DataFrame:
    """S2's flags of customers as recordings, of S10's pairs within a nation and segment."""
    rate = (F.col("c_custkey") % 90 + 1) * 1000
    rows = x.read("customer").select(F.col("c_custkey").alias("recording_id"), "c_nationkey", "c_mktsegment", rate.alias("sample_rate"), (F.col("c_acctbal") * rate).alias("n_frames"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("channels"))
    facts, flags = so.recording_facts(rows, 20000.0, 4000.0, needs_stereo=True), ["nyquist_limited", "too_short", "not_stereo"]
    return d.pair_warnings(so.make_pairs(facts, "all", ["c_nationkey", "c_mktsegment"], carried=flags), carried=flags)


@_query(
    "s8_difference_report",
    """, f AS (SELECT pair_id, block_no, 'differing' AS finding, hertz, ref_amplitude AS amplitude, diff_amplitude AS value
  FROM matched
  WHERE abs(diff_amplitude) >= 1e-5
     
UNION ALL
SELECT pair_id, block_no, 'phase', hertz, ref_amplitude, diff_phase FROM matched WHERE abs(diff_phase) >= 1e-5
UNION ALL
SELECT pair_id, block_no, 'missing', hertz, amplitude, NULL FROM missing)
    SELECT pair_id, block_no, finding, hertz, round(value, 4) AS value, row_number() OVER (PARTITION BY pair_id, block_no, finding
  ORDER BY amplitude DESC) AS rank
  FROM f""",
)
def _s8(x: Fixture) -> DataFrame:
    return so.difference_report(x.audible, x.missing).select("pair_id", "block_no", "finding", "hertz", r4("value"), n("rank"))


@_query(
    "s8_report_totals",
    """, f AS (SELECT pair_id, block_no, 'differing' AS finding FROM matched WHERE abs(diff_amplitude) >= 1e-5 UNION ALL SELECT pair_id, block_no, 'phase' FROM matched WHERE abs(diff_phase) >= 1e-5
      UNION ALL SELECT pair_id, block_no, 'missing' FROM missing)
    SELECT pair_id, block_no, finding, count(*) AS n FROM f GROUP BY GROUPING SETS ((pair_id, finding), (pair_id, block_no, finding))""",
)
def _s8_totals(x: Fixture) -> DataFrame:
    return so.report_totals(so.difference_report(x.audible, x.missing)).select("pair_id", "block_no", "finding", "n")


@_query("s7_differences", f"SELECT pair_id, type_id, hertz, round(diff_amplitude, 4) AS diff_amplitude FROM matched WHERE ref_amplitude > {S} / 2")
def _s7(x: Fixture) -> DataFrame:
    """Written as CSV and read again."""
    base = shared_path(x.pairs.sparkSession, "differences")
    so.write_differences(x.audible, S / 2, base)
    back = x.pairs.sparkSession.read.schema("pair_id string, type_id int, hertz double, diff_amplitude double").csv(base, header=True)
    return back.select("pair_id", "type_id", "hertz", r4("diff_amplitude"))


@_query(
    "s10_pairs_of_a_group",
    """SELECT a.c_custkey AS ref_id, b.c_custkey AS comp_id
  FROM customer a
  JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey""",
    False,
)
def _s10(x: Fixture) -> DataFrame:
    customers = x.read("customer").select(F.col("c_custkey").alias("recording_id"), "c_nationkey", "c_mktsegment")
    return so.make_pairs(customers, "all", ["c_nationkey", "c_mktsegment"]).select("ref_id", "comp_id")


@_query(
    "s3_pair_full_scale",
    """WITH q AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN -48.16 WHEN 1 THEN -96.33 WHEN 2 THEN -144.49 ELSE -192.66 END AS v FROM customer)
    SELECT a.k AS ref_id, b.k AS comp_id, least(a.v, b.v)::DOUBLE AS lowest_dbfs FROM q a JOIN q b ON b.k = a.k * 2 + 1""",
    False,
)
def _s3(x: Fixture) -> DataFrame:
    recordings = x.read("customer").select(F.col("c_custkey").alias("recording_id"), ((F.col("c_custkey") % 4 + 1) * 8).cast("int").alias("bits"))
    listed = recordings.select(F.col("recording_id").alias("ref_id"), (F.col("recording_id") * 2 + 1).alias("comp_id"))
    return so.pair_full_scale(so.make_pairs(recordings, "list", listed=listed), recordings).select("ref_id", "comp_id", "lowest_dbfs")


# ---- scalar functions ----


@_query(
    "f_more_scalars",
    """SELECT p_partkey, abs(v - w) <= 2.220446049250313e-16 * greatest(v, w) OR abs(v - w) < 1e-5 AS same, round(2 * sqrt(v * v + w * w) / 64, 6) AS magnitude, round(degrees(atan2(w, v)), 4) AS phase, round(3000 * 10 ** (-w / 20), 4) AS level,
    p_size * 1000.0 / (p_size + 3) AS hz, round(p_size * 16.6884 / 1000, 6) AS seconds, round(p_size * 1000 / 16.6884, 6) AS frames, floor(p_size * 1.37 * 441)::BIGINT AS samples, p_size / 441.0 AS back, floor(p_size * 16.6884 / 1000 * 44100)::BIGINT AS of_frames,
    round(p_size / 44100.0 * 1000 / 16.6884, 6) AS to_frames, p_size * 2 * 16 / 8.0 AS bytes, p_size * 8 / 2.0 / 16 AS of_bytes, round(20000 / log10(20000) * log10(p_size + 1), 4) AS axis
  FROM (SELECT *, p_retailprice / 100 AS v, p_size + p_partkey % 3 * 1e-6 AS w
  FROM part)""",
    False,
)
def _f(x: Fixture) -> DataFrame:
    size, ms, rate = F.col("p_size"), F.lit(16.6884), F.lit(44100.0)
    v, w = F.col("p_retailprice").cast("double") / 100, size + F.col("p_partkey") % 3 * F.lit(1e-6)
    return x.read("part").select(
        "p_partkey", e.almost_equal(v, w).alias("same"), F.round(e.magnitude(v, w, F.lit(64)), 6).alias("magnitude"), F.round(e.phase(v, w), 4).alias("phase"), F.round(e.from_decibels(-w, F.lit(3000)), 4).alias("level"),
        e.hertz(size, size + 3).alias("hz"), F.round(e.frames_to_seconds(size, ms), 6).alias("seconds"), F.round(e.seconds_to_frames(size, ms), 6).alias("frames"), e.seconds_to_samples(size * F.lit(1.37), F.lit(441)).alias("samples"),
        e.samples_to_seconds(size, F.lit(441.0)).alias("back"), e.frames_to_samples(size, ms, rate).alias("of_frames"), F.round(e.samples_to_frames(size, ms, rate), 6).alias("to_frames"),
        e.samples_to_bytes(size, F.lit(2), F.lit(16)).alias("bytes"), e.bytes_to_samples(size, F.lit(2), F.lit(16)).alias("of_bytes"), F.round(e.log_axis(size + 1, 20000.0), 4).alias("axis"),
    )


@_query(
    "f14_correction_factor",
    """WITH s AS (SELECT DISTINCT p_size + 8 AS size FROM part)
    SELECT size, round(size / list_sum(list_transform(range(size), lambda i: 0.54 - 0.46 * cos(2 * pi() * i / (size - 1)))), 6) AS factor, round(size * 1.85196, 6)::DOUBLE AS raised FROM s""",
    False,
)
def _f14(x: Fixture) -> DataFrame:
    table = u.window_table(x.read("part").select((F.col("p_size") + 8).alias("size")), "m")
    return table.select("size", F.round(e.correction_factor(F.col("w")), 6).alias("factor"), F.round(F.col("size") * e.window_factor("m"), 6).alias("raised"))


@_query(
    "f15_colour",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'gray' WHEN 2 THEN 'cyan' WHEN 3 THEN 'green' END AS colour FROM part",
    False,
)
def _f15(x: Fixture) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("Red", "grey", "AQUA", "dgreen", "mauve"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return x.read("part").select("p_partkey", e.colour(word).alias("colour"))


# ---- streams in batch form ----


@_query(
    "t2_live_levels",
    """SELECT user_id AS source, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(max(value), 4) AS peak, round(min(value), 4) AS floor
  FROM events
  GROUP BY 1, 2""",
    False,
)
def _t2(x: Fixture) -> DataFrame:
    return st.live_levels(x.observations, "1 hour").select("source", F.col("w.start").alias("hour"), "n", r4("peak"), r4("floor"))


@_query(
    "t4_signal_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id AS source, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
    False,
)
def _t4(x: Fixture) -> DataFrame:
    return st.signal_sessions(x.observations, "30 minutes").select("source", F.col("w.start").alias("start"), "n")


@_query(
    "archive_match_rows",
    """WITH l AS (SELECT l_suppkey AS k, ascii(l_returnflag) AS t, l_partkey AS b, max(l_extendedprice)::DOUBLE AS m, l_linestatus AS s
  FROM lineitem
  GROUP BY ALL),
    z AS (SELECT k, max(m) AS z FROM l GROUP BY 1),
r AS (SELECT l.* FROM l JOIN z USING (k) WHERE s = 'F'),
q AS (SELECT l.* FROM l JOIN z USING (k) WHERE s = 'O')
    SELECT k AS recording_id, count(*) FILTER (r.b IS NOT NULL AND q.b IS NOT NULL) AS matched, count(*) FILTER (q.b IS NULL) AS missing, count(*) FILTER (r.b IS NULL) AS extra
  FROM r
  FULL
  JOIN q USING (k, t, b)
  GROUP BY 1""",
    False,
)
def _archive(x: Fixture) -> DataFrame:
    """lineitem as a large ready-made spectrum: a supplier's F rows are the reference, its O rows the comparison, matched by the engine's own operators."""
    key = [F.col("l_suppkey").alias("pair_id"), F.ascii("l_returnflag").cast("long").alias("block_no"), F.lit("l").alias("channel"), F.lit(1000).alias("boxsize_ms"), F.col("l_partkey").alias("bin")]
    rows = x.read("lineitem").groupBy(*key, "l_linestatus").agg(F.max(F.col("l_extendedprice").cast("double")).alias("magnitude"))
    top = x.read("lineitem").groupBy(F.col("l_suppkey").alias("pair_id")).agg(F.max(F.col("l_extendedprice").cast("double")).alias("zero_db"))
    full = rows.join(top, "pair_id").withColumn("amplitude", e.decibels(F.col("magnitude"), F.col("zero_db"))).select("*", F.lit("user").alias("kind"), F.lit(1).alias("type_id"), F.col("bin").cast("double").alias("hertz"), F.lit(0.0).alias("phase"))
    ref, comp = (u.significant(full.where(F.col("l_linestatus") == s), -100.0, "ref") for s in "FO")
    each = c.both_sides(ref, comp).groupBy("pair_id").agg(*(F.count_if(F.col("side") == k).alias(name) for k, name in (("both", "matched"), ("ref", "missing"), ("comp", "extra"))))
    return each.select(F.col("pair_id").alias("recording_id"), "matched", "missing", "extra")
