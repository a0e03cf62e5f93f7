"""Registered queries, one for each operator that SQL can check, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigdiff import compare as c
from sigdiff import exprs as e
from sigdiff import layout as p
from sigdiff import levels as a
from sigdiff import samples as sa
from sigdiff import series as d
from sigdiff import sources as so
from sigdiff import spectrum as u
from sigdiff import sync as sy
from sigdiff.fixtures import OPTIONS, Fixture

S = OPTIONS.significance

#: Common table expressions: the fixture's spectra, pairs, sides and matches.
BASE = f"""
WITH x AS (SELECT vec_id % 5 AS recording_id, vec_id // 5 AS block_no, unnest(range(64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
k AS (SELECT unnest(range(1, 32)) AS bin),
raw AS (SELECT recording_id, block_no, bin, sum(x * cos(2 * pi() * bin * n / 64)) AS re, -sum(x * sin(2 * pi() * bin * n / 64)) AS im FROM x, k GROUP BY ALL),
sp AS (SELECT recording_id, block_no, 'l' AS channel, CASE WHEN block_no % 10 = 9 THEN 'silence' ELSE 'user' END AS kind, CAST(CASE WHEN block_no % 10 = 9 THEN -1 ELSE block_no % 4 + 1 END AS INTEGER) AS type_id,
  bin, CAST(bin AS DOUBLE) AS hertz, 2 * sqrt(re * re + im * im) / 64 AS magnitude, degrees(atan2(im, re)) AS phase, row_number() OVER (PARTITION BY recording_id, block_no ORDER BY 2 * sqrt(re * re + im * im) / 64 DESC, bin) AS rank FROM raw),
spec AS (SELECT * FROM sp WHERE kind = 'silence' OR rank <= 20),
peaks AS (SELECT recording_id, max(magnitude) AS magnitude FROM spec WHERE kind <> 'silence' GROUP BY 1),
pairs AS (SELECT r.recording_id AS ref_id, q.recording_id AS comp_id, r.recording_id || '-' || q.recording_id AS pair_id, greatest(r.magnitude, q.magnitude) AS zero_db FROM peaks r JOIN peaks q ON r.recording_id < q.recording_id),
ref0 AS (SELECT pair_id, s.*, CASE WHEN magnitude > 0 AND magnitude <= zero_db THEN 20 * log10(magnitude / zero_db) END AS amplitude FROM pairs JOIN spec s ON s.recording_id = ref_id),
comp0 AS (SELECT pair_id, s.*, CASE WHEN magnitude > 0 AND magnitude <= zero_db THEN 20 * log10(magnitude / zero_db) END AS amplitude FROM pairs JOIN spec s ON s.recording_id = comp_id),
ref AS (SELECT * FROM ref0 WHERE amplitude > CASE WHEN kind = 'silence' THEN -220 ELSE {S} END),
comp AS (SELECT * FROM comp0 WHERE amplitude > CASE WHEN kind = 'silence' THEN -220 ELSE {S} - 20 END),
matched0 AS (SELECT r.pair_id, r.block_no, r.channel, r.bin, r.kind, r.type_id, r.hertz, r.amplitude AS ref_amplitude, q.amplitude AS comp_amplitude, abs(r.amplitude) - abs(q.amplitude) AS diff_amplitude, q.phase - r.phase AS dp FROM ref r JOIN comp q USING (pair_id, block_no, channel, bin)),
every AS (SELECT *, CASE WHEN dp > 180 THEN dp - 360 WHEN dp <= -180 THEN dp + 360 ELSE dp END AS diff_phase FROM matched0),
matched AS (SELECT * FROM every WHERE kind = 'user'),
missing AS (SELECT r.* FROM ref r ANTI JOIN comp q USING (pair_id, block_no, channel, bin) WHERE r.kind = 'user'),
extra AS (SELECT q.* FROM comp q ANTI JOIN ref r USING (pair_id, block_no, channel, bin) WHERE q.kind = 'user' AND q.amplitude > {S}),
own AS (SELECT s.*, CASE WHEN magnitude > 0 THEN 20 * log10(magnitude / (max(magnitude) OVER (PARTITION BY recording_id))) END AS amplitude FROM spec s)
"""

_found: dict[str, tuple[Callable[[Fixture], DataFrame], str]] = {}


def _query(name: str, sql: str, base: bool = True):
    def keep(f: Callable[[Fixture], DataFrame]):
        _found[name] = (f, (BASE if base else "") + sql)
        return f

    return keep


def r4(x: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(x) if isinstance(x, str) else x, 4)
    return out.alias(name or (x if isinstance(x, str) else "value"))


def r6(x: str, name: str | None = None) -> Column:
    return F.round(F.col(x), 6).alias(name or x)


def n(x: str) -> Column:
    return F.col(x).cast("long").alias(x)


@_query(
    "flagship",
    """, w AS (SELECT type_id, count(*) AS n_matched, count(*) FILTER (abs(diff_amplitude) <= 1) AS n_within FROM matched GROUP BY 1),
m AS (SELECT type_id, count(*) AS n_missing FROM missing GROUP BY 1)
SELECT type_id, n_matched, n_within, n_missing, round(100.0 * n_within / n_matched, 4) AS within_pct, round(100.0 * n_missing / (n_missing + n_matched), 4) AS missing_pct
  FROM w
  JOIN m USING (type_id)""",
)
def _flagship(x: Fixture) -> DataFrame:
    both = F.col("side") == "both"
    out = x.sides.groupBy("type_id").agg(F.count_if(both).alias("n_matched"), F.count_if(both & (F.abs("diff_amplitude") <= OPTIONS.match_db)).alias("n_within"), F.count_if(F.col("side") == "ref").alias("n_missing"))
    out = out.where("n_matched > 0 AND n_missing > 0").withColumn("within_pct", 100 * F.col("n_within") / F.col("n_matched"))
    return out.withColumn("missing_pct", 100 * F.col("n_missing") / (F.col("n_missing") + F.col("n_matched"))).select("type_id", "n_matched", "n_within", "n_missing", r4("within_pct"), r4("missing_pct"))


@_query(
    "u1_block_spectra",
    """SELECT recording_id, block_no, bin, round(magnitude, 6) AS magnitude FROM spec""",
)
def _u1_block_spectra(x: Fixture) -> DataFrame:
    return u.block_spectra(x.blocks, 64.0, OPTIONS).select("recording_id", "block_no", n("bin"), r6("magnitude"))


@_query(
    "k1_top_bins",
    """SELECT recording_id, count(*) AS n, round(sum(magnitude), 4) AS total FROM spec WHERE kind = 'silence' OR rank <= 7 GROUP BY 1""",
)
def _k1_top_bins(x: Fixture) -> DataFrame:
    return u.top_bins(x.spec, 7).groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.sum("magnitude"), 4).alias("total"))


@_query(
    "p8_route_channels",
    """SELECT vec_id, channel, round(total, 4) AS total
 
  FROM (SELECT vec_id, 'l' AS channel, CASE WHEN vec_id % 3 = 0 THEN list_sum(embedding::DOUBLE[]) WHEN vec_id % 3 = 1 THEN 1.5 * list_sum(embedding::DOUBLE[]) ELSE list_sum(embedding::DOUBLE[]) END AS total
  FROM embeddings
UNION ALL
SELECT vec_id, 'r', 2 * list_sum(embedding::DOUBLE[]) FROM embeddings WHERE vec_id % 3 = 2)""",
    False,
)
def _p8_route_channels(x: Fixture) -> DataFrame:
    return (
        u.route_channels(x.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("left"), F.when(F.col("vec_id") % 3 > 0, F.transform(F.col("embedding").cast("array<double>"), lambda v: 2 * v)).alias("right"), F.when(F.col("vec_id") % 3 == 2, "S").otherwise("m").alias("routing")))
        .select("vec_id", "channel", r4(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v), "total"))
    )


@_query(
    "j6_window_table",
    """SELECT size, round(list_sum(list_transform(range(size), lambda i: 0.5 - 0.5 * cos(2 * pi() * i / (size - 1)))), 4) AS total
  FROM (SELECT DISTINCT p_size + 8 AS size
  FROM part)""",
    False,
)
def _j6_window_table(x: Fixture) -> DataFrame:
    return (
        u.window_table(x.read("part").select((F.col("p_size") + 8).alias("size")), "h")
        .select("size", r4(F.aggregate("w", F.lit(0.0), lambda s, v: s + v), "total"))
    )


@_query(
    "j7_nearest_bin",
    """SELECT p_partkey, CASE WHEN b >= 2 AND b < 30 THEN b ELSE 0 END AS hz FROM (SELECT p_partkey, ceil(p_retailprice / 40 - 0.5) AS b FROM part)""",
    False,
)
def _j7_nearest_bin(x: Fixture) -> DataFrame:
    return x.read("part").select("p_partkey", u.nearest_bin(F.col("p_retailprice") / 40, F.lit(1000.0), 2.0, 30.0).alias("hz"))


@_query(
    "a1_peaks",
    """SELECT recording_id, arg_max(block_no, magnitude) AS block_no, arg_max(bin, magnitude) AS bin, round(max(magnitude), 6) AS magnitude
  FROM spec
  WHERE kind <> 'silence'
  GROUP BY 1""",
)
def _a1_peaks(x: Fixture) -> DataFrame:
    return a.peaks(x.spec).select("recording_id", "block_no", n("bin"), r6("magnitude"))


@_query(
    "a2_zero_reference",
    """SELECT pair_id, round(zero_db, 6) AS zero_db FROM pairs""",
)
def _a2_zero_reference(x: Fixture) -> DataFrame:
    return x.zero.select("pair_id", r6("zero_db"))


@_query(
    "a4_fundamental_magnitude",
    """SELECT recording_id, round(avg(magnitude), 6) AS mean, round(stddev_samp(magnitude), 6) AS sd, count(*) AS n
  FROM spec
  WHERE rank = 1 AND kind <> 'silence'
  GROUP BY 1""",
)
def _a4_fundamental_magnitude(x: Fixture) -> DataFrame:
    return a.fundamental_stats(x.spec, "magnitude").select("recording_id", r6("mean"), r6("sd"), "n")


@_query(
    "a5_fundamental_amplitude",
    """SELECT recording_id, round(avg(amplitude), 4) AS mean FROM own WHERE rank = 1 AND kind <> 'silence' GROUP BY 1""",
)
def _a5_fundamental_amplitude(x: Fixture) -> DataFrame:
    return a.fundamental_stats(x.own_levels, "amplitude").select("recording_id", r4("mean"))


@_query(
    "a6_silence_floor",
    """SELECT recording_id, arg_max(hertz, amplitude) AS floor_hz, round(max(amplitude), 4) AS floor_db FROM own WHERE kind = 'silence' GROUP BY 1""",
)
def _a6_silence_floor(x: Fixture) -> DataFrame:
    return a.silence_floor(x.own_levels).select("recording_id", "floor_hz", r4("floor_db"))


@_query(
    "a7_noise_cutoff",
    """, q AS (SELECT recording_id, amplitude, -(avg(abs(amplitude)) OVER v + stddev_samp(abs(amplitude)) OVER v) AS cutoff
  FROM own
  WHERE kind = 'silence'
  WINDOW v AS (PARTITION BY recording_id))
SELECT recording_id, round(cutoff, 4) AS cutoff_db, round(100.0 * count(*) FILTER (amplitude < cutoff) / count(*), 4) AS left_out_pct
  FROM q
  GROUP BY recording_id, round(cutoff, 4)""",
)
def _a7_noise_cutoff(x: Fixture) -> DataFrame:
    return a.noise_cutoff(x.own_levels).select("recording_id", r4("cutoff_db"), r4("left_out_pct"))


@_query(
    "a8_floor_level",
    """, q AS (SELECT recording_id, least(max(amplitude), -(avg(abs(amplitude)) + stddev_samp(abs(amplitude)))) AS f
  FROM own
  WHERE kind = 'silence'
  GROUP BY 1)
SELECT recording_id, round(f, 4) AS floor_db FROM q""",
)
def _a8_floor_level(x: Fixture) -> DataFrame:
    return (
        a.floor_level(a.silence_floor(x.own_levels), a.noise_cutoff(x.own_levels).select("recording_id", "cutoff_db"), -96.33)
        .select("recording_id", r4("floor_db"))
    )

LINES = [("vertical", 10.0, True), ("scan", 24.0, False)]


@_query(
    "j10_noise_lines",
    """, l AS (SELECT * FROM (VALUES ('vertical', 10.0, true), ('scan', 24.0, false)) t(line, hz, exact))
SELECT recording_id, line, count(*) AS n FROM spec JOIN l ON abs(hertz - hz) <= CASE WHEN exact THEN 0.5 ELSE 8 END GROUP BY 1, 2""",
)
def _j10_noise_lines(x: Fixture) -> DataFrame:
    return (
        a.tag_noise_lines(x.spec, x.spec.sparkSession.createDataFrame(LINES, "line string, target_hz double, exact boolean"))
        .groupBy("recording_id", "line")
        .agg(F.count("*").alias("n"))
    )


@_query(
    "a9_noise_line_levels",
    """, l AS (SELECT * FROM (VALUES ('vertical', 10.0, true), ('scan', 24.0, false)) t(line, hz, exact))
SELECT recording_id, line, round(max(amplitude), 4) AS line_db
  FROM own
  JOIN l ON abs(hertz - hz) <= CASE WHEN exact THEN 0.5 ELSE 8 END
  WHERE kind = 'silence'
  GROUP BY 1, 2""",
)
def _a9_noise_line_levels(x: Fixture) -> DataFrame:
    return (
        a.noise_line_levels(a.tag_noise_lines(x.own_levels, x.spec.sparkSession.createDataFrame(LINES, "line string, target_hz double, exact boolean")))
        .select("recording_id", "line", r4("line_db"))
    )


@_query(
    "a11_mean_floor",
    """, q AS (SELECT recording_id, amplitude, row_number() OVER (PARTITION BY recording_id
  ORDER BY amplitude DESC) AS n, max(amplitude) OVER (PARTITION BY recording_id) AS f
  FROM own
  WHERE kind = 'silence')
SELECT recording_id, round(avg(amplitude), 4) AS mean_floor_db FROM q WHERE n <= 50 AND amplitude > f - 30 GROUP BY 1""",
)
def _a11_mean_floor(x: Fixture) -> DataFrame:
    return a.mean_floor(x.own_levels, a.silence_floor(x.own_levels).select("recording_id", "floor_db")).select("recording_id", r4("mean_floor_db"))


@_query(
    "a12_standalone_floor",
    """, q AS (SELECT recording_id, arg_min(magnitude, block_no * 100 + rank) AS quiet FROM spec WHERE kind = 'silence' GROUP BY 1)
SELECT recording_id, round(20 * log10(quiet / magnitude), 4) AS floor_db FROM q JOIN peaks USING (recording_id)""",
)
def _a12_standalone_floor(x: Fixture) -> DataFrame:
    return a.standalone_floor(x.spec).select("recording_id", r4("floor_db"))


@_query(
    "j9_local_peak",
    """, pk AS (SELECT recording_id, arg_max(block_no, magnitude) AS block_no, arg_max(bin, magnitude) AS bin FROM spec WHERE kind <> 'silence' GROUP BY 1)
SELECT pair_id, arg_max(s.bin, s.magnitude) AS comp_bin, round(max(s.magnitude), 6) AS comp_magnitude
  FROM pairs
  JOIN pk ON pk.recording_id = ref_id
  JOIN spec s ON s.recording_id = comp_id AND s.block_no = pk.block_no AND abs(s.bin - pk.bin) < 5
  GROUP BY 1""",
)
def _j9(x: Fixture) -> DataFrame:
    top = a.peaks(x.spec).select(F.col("recording_id").alias("ref_id"), "block_no", "channel", "bin", F.col("magnitude").alias("ref_magnitude"))
    return a.local_peak(x.pairs.join(top, "ref_id").select("pair_id", "comp_id", "block_no", "channel", "bin", "ref_magnitude"), x.spec, 5).select("pair_id", n("comp_bin"), r6("comp_magnitude"))


@_query("j8_local_peak_exact", """, pk AS (SELECT recording_id, arg_max(block_no, magnitude) AS block_no, arg_max(bin, magnitude) AS bin FROM spec WHERE kind <> 'silence' GROUP BY 1)
SELECT pair_id, round(s.magnitude, 6) AS comp_magnitude FROM pairs JOIN pk ON pk.recording_id = ref_id JOIN spec s ON s.recording_id = comp_id AND s.block_no = pk.block_no AND s.bin = pk.bin""")
def _j8(x: Fixture) -> DataFrame:
    top = a.peaks(x.spec).select(F.col("recording_id").alias("ref_id"), "block_no", "channel", "bin", F.col("magnitude").alias("ref_magnitude"))
    return a.local_peak(x.pairs.join(top, "ref_id").select("pair_id", "comp_id", "block_no", "channel", "bin", "ref_magnitude"), x.spec).select("pair_id", r6("comp_magnitude"))


@_query(
    "n1_frequency_domain",
    """, l AS (SELECT recording_id, avg(magnitude) + stddev_samp(magnitude) AS lim FROM spec WHERE kind <> 'silence' GROUP BY 1),
q AS (SELECT s.*, row_number() OVER (PARTITION BY s.recording_id
  ORDER BY magnitude DESC, block_no, bin) AS number
  FROM spec s
  JOIN l USING (recording_id)
  WHERE kind <> 'silence' AND magnitude > lim),
f AS (SELECT pair_id, number, t.magnitude / q.magnitude AS ratio, abs(20 * log10(t.magnitude / q.magnitude)) AS gap
  FROM pairs
  JOIN q ON q.recording_id = ref_id AND number <= 500
  JOIN spec t ON t.recording_id = comp_id AND t.block_no = q.block_no AND t.bin = q.bin)
SELECT pair_id, arg_min(number, CASE WHEN gap <= 30 THEN number ELSE 1000 + gap END) AS candidate, round(arg_min(ratio, CASE WHEN gap <= 30 THEN number ELSE 1000 + gap END), 6) AS ref_gain
  FROM f
  GROUP BY 1""",
)
def _n1_frequency_domain(x: Fixture) -> DataFrame:
    return a.normalise_frequency(x.pairs, x.spec).select("pair_id", n("candidate"), r6("ref_gain"))


@_query(
    "n2_average",
    """, m AS (SELECT recording_id, avg(magnitude) AS m FROM spec WHERE rank = 1 AND kind <> 'silence' GROUP BY 1)
SELECT pair_id, round(greatest(q.m / r.m, 1), 6) AS ref_gain, round(greatest(r.m / q.m, 1), 6) AS comp_gain
  FROM pairs
  JOIN m r ON r.recording_id = ref_id
  JOIN m q ON q.recording_id = comp_id""",
)
def _n2_average(x: Fixture) -> DataFrame:
    return a.normalise_average(x.pairs, x.spec).select("pair_id", r6("ref_gain"), r6("comp_gain"))


@_query(
    "j2a_match",
    """SELECT pair_id, block_no, bin, type_id, round(diff_amplitude, 4) AS diff_amplitude FROM every""",
)
def _j2a_match(x: Fixture) -> DataFrame:
    return x.matched.select("pair_id", "block_no", n("bin"), "type_id", r4("diff_amplitude"))


@_query(
    "j3_missing",
    """SELECT pair_id, block_no, bin, round(amplitude, 4) AS amplitude FROM missing""",
)
def _j3_missing(x: Fixture) -> DataFrame:
    return x.missing.select("pair_id", "block_no", n("bin"), r4("amplitude"))


@_query(
    "j4_extra",
    """SELECT pair_id, block_no, bin, round(amplitude, 4) AS amplitude FROM extra""",
)
def _j4_extra(x: Fixture) -> DataFrame:
    return x.extra.select("pair_id", "block_no", n("bin"), r4("amplitude"))


@_query(
    "j13_rank_listing",
    """, mk AS (SELECT pair_id, block_no, bin FROM every)
SELECT pair_id, block_no, rank, r.bin AS ref_bin, q.bin AS comp_bin, mk.bin IS NOT NULL AS is_matched
  FROM ref r
  FULL
  JOIN comp q USING (pair_id, block_no, rank)
  LEFT
  JOIN mk USING (pair_id, block_no)
  WHERE FALSE
UNION ALL
SELECT coalesce(r.pair_id, q.pair_id), coalesce(r.block_no, q.block_no), coalesce(r.rank, q.rank), r.bin, q.bin, EXISTS (SELECT 1
  FROM mk
  WHERE mk.pair_id = r.pair_id AND mk.block_no = r.block_no AND mk.bin = r.bin)
  FROM ref r
  FULL
  JOIN comp q ON r.pair_id = q.pair_id AND r.block_no = q.block_no AND r.rank = q.rank""",
)
def _j13_rank_listing(x: Fixture) -> DataFrame:
    return c.rank_listing(x.ref, x.comp).select("pair_id", "block_no", n("rank"), n("ref_bin"), n("comp_bin"), "is_matched")


@_query(
    "j14_threshold_listing",
    """SELECT pair_id, block_no, bin, round(diff_amplitude, 4) AS diff_amplitude FROM matched WHERE abs(diff_amplitude) > 12""",
)
def _j14_threshold_listing(x: Fixture) -> DataFrame:
    return c.threshold_listing(x.audible, 12.0).select("pair_id", "block_no", n("bin"), r4("diff_amplitude"))


@_query(
    "a13_counters",
    """, z AS (SELECT pair_id, channel, block_no, diff_amplitude, diff_phase, 0 AS lost FROM matched
UNION ALL
SELECT pair_id, channel, block_no, NULL, NULL, 1 FROM missing)
SELECT pair_id, channel, block_no, count(*) AS compared, count(*) FILTER (abs(diff_amplitude) < 1e-5) AS perfect, count(*) FILTER (abs(diff_amplitude) >= 1e-5) AS differing, CAST(sum(lost) AS BIGINT) AS missing, count(*) FILTER (abs(diff_phase) >= 1e-5) AS phase_differing
  FROM z
  GROUP BY GROUPING SETS ((pair_id), (pair_id, channel), (pair_id, block_no), (pair_id, channel, block_no))""",
)
def _a13_counters(x: Fixture) -> DataFrame:
    return c.counters(x.sides)


@_query(
    "a14_mean_difference",
    """SELECT pair_id, round(avg(diff_amplitude), 4) AS mean_diff FROM matched GROUP BY 1""",
)
def _a14_mean_difference(x: Fixture) -> DataFrame:
    return c.mean_difference(x.matched).select("pair_id", r4("mean_diff"))


@_query(
    "a14_recentre",
    """SELECT pair_id, block_no, bin, round(diff_amplitude - avg(diff_amplitude) OVER (PARTITION BY pair_id), 4) AS diff_amplitude FROM matched""",
)
def _a14_recentre(x: Fixture) -> DataFrame:
    return c.recentre(x.audible).select("pair_id", "block_no", n("bin"), r4("diff_amplitude"))


@_query(
    "a15_share_within",
    """SELECT pair_id, type_id, channel, count(*) FILTER (abs(diff_amplitude) <= 1) AS hits, count(*) AS total, round(100.0 * count(*) FILTER (abs(diff_amplitude) <= 1) / count(*), 4) AS pct
  FROM matched
  GROUP BY 1, 2, 3""",
)
def _a15_share_within(x: Fixture) -> DataFrame:
    return c.share_within(x.audible, 1.0).select("pair_id", "type_id", "channel", "hits", "total", r4("pct"))


@_query(
    "a16_share_differing",
    """SELECT pair_id, type_id, count(*) FILTER (abs(diff_amplitude) >= 1e-5) AS hits, count(*) AS total FROM matched GROUP BY 1, 2""",
)
def _a16_share_differing(x: Fixture) -> DataFrame:
    return c.share_differing(x.audible).drop("pct")


@_query(
    "a17_share_perfect",
    """SELECT pair_id, type_id, count(*) FILTER (abs(diff_amplitude) < 1e-5) AS hits, count(*) AS total FROM matched GROUP BY 1, 2""",
)
def _a17_share_perfect(x: Fixture) -> DataFrame:
    return c.share_perfect(x.audible).drop("pct")


@_query(
    "a18_missing_share",
    """, t AS (SELECT pair_id, type_id, channel, count(*) AS total FROM ref WHERE kind = 'user' GROUP BY 1, 2, 3),
h AS (SELECT pair_id, type_id, channel, count(*) AS hits FROM missing GROUP BY 1, 2, 3)
SELECT pair_id, type_id, channel, coalesce(hits, 0) AS hits, total, round(100.0 * coalesce(hits, 0) / total, 4) AS pct
  FROM t
  LEFT
  JOIN h USING (pair_id, type_id, channel)""",
)
def _a18_missing_share(x: Fixture) -> DataFrame:
    return c.share_unmatched(x.ref.where("kind = 'user'"), x.missing).withColumn("pct", r4("pct"))


@_query(
    "a18_extra_share",
    f""", t AS (SELECT pair_id, type_id, channel, count(*) AS total FROM comp WHERE kind = 'user' AND amplitude > {S} GROUP BY 1, 2, 3),
h AS (SELECT pair_id, type_id, channel, count(*) AS hits FROM extra GROUP BY 1, 2, 3)
SELECT pair_id, type_id, channel, coalesce(hits, 0) AS hits, total, round(100.0 * coalesce(hits, 0) / total, 4) AS pct
  FROM t
  LEFT
  JOIN h USING (pair_id, type_id, channel)""",
)
def _a18_extra_share(x: Fixture) -> DataFrame:
    return c.share_unmatched(x.comp.where(f"kind = 'user' AND amplitude > {S}"), x.extra).withColumn("pct", r4("pct"))


@_query(
    "a19_worst_type",
    """, s AS (SELECT pair_id, type_id, 100.0 * count(*) FILTER (abs(diff_amplitude) <= 1) / count(*) AS pct FROM matched GROUP BY 1, 2)
SELECT pair_id, type_id, round(pct, 4) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pct, type_id) AS n FROM s) WHERE n = 1""",
)
def _a19_worst_type(x: Fixture) -> DataFrame:
    return c.worst_type(c.share_within(x.audible, 1.0)).select("pair_id", "type_id", r4("pct"))


@_query(
    "a20_share_outside",
    """, b AS (SELECT pair_id, block_no, type_id, count(*) FILTER (abs(diff_amplitude) > 6) AS o, count(*) AS n FROM matched GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN lag(type_id) OVER v = type_id THEN 0 ELSE 1 END AS ch FROM b WINDOW v AS (PARTITION BY pair_id ORDER BY block_no)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY pair_id ORDER BY block_no) AS run FROM g),
e AS (SELECT pair_id, run, type_id, 100.0 * sum(o) / sum(n) AS pct FROM r GROUP BY 1, 2, 3)
SELECT pair_id, CAST(run AS BIGINT) AS run, type_id, round(pct, 4) AS pct
  FROM (SELECT *, row_number() OVER (PARTITION BY pair_id
  ORDER BY pct DESC, run) AS k
  FROM e)
  WHERE k = 1""",
)
def _a20_share_outside(x: Fixture) -> DataFrame:
    return c.share_outside(x.audible, 6.0).select("pair_id", n("run"), "type_id", r4("pct"))


@_query(
    "a21_fit_range",
    """, t AS (SELECT pair_id, type_id, avg(abs(diff_amplitude)) AS m, stddev_samp(abs(diff_amplitude)) AS sd, 100.0 * count(*) FILTER (abs(diff_amplitude) > 3) / count(*) AS o
  FROM matched
  GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY o DESC, type_id) AS k FROM t)
SELECT pair_id, type_id, round(o, 4) AS outside, CASE WHEN o < 25 THEN 3.0 WHEN ceil(m + sd) > 3 THEN ceil(m + sd) ELSE ceil(m + 2 * sd) END AS range_db
  FROM w
  WHERE k = 1""",
)
def _a21_fit_range(x: Fixture) -> DataFrame:
    return c.fit_range(x.audible, 3.0).select("pair_id", "type_id", r4("outside"), "range_db")


@_query(
    "a22_high_difference",
    """, m AS (SELECT pair_id, block_no, avg(abs(diff_amplitude)) AS a, count(*) AS n FROM matched GROUP BY 1, 2),
l AS (SELECT pair_id, block_no, count(*) AS l FROM missing GROUP BY 1, 2),
q AS (SELECT pair_id, block_no, count(*) AS e FROM extra GROUP BY 1, 2),
z AS (SELECT pair_id, block_no, a, coalesce(n, 0) AS n, coalesce(l, 0) AS l, coalesce(e, 0) AS e
  FROM m
  FULL
  JOIN l USING (pair_id, block_no)
  FULL
  JOIN q USING (pair_id, block_no)),
y AS (SELECT pair_id, block_no, a, 100.0 * l / greatest(l + n, 1) AS mp, 100.0 * e / greatest(e + n, 1) AS ep FROM z)
SELECT pair_id, block_no, round(a, 4) AS mean_abs, round(mp, 4) AS missing_pct, round(ep, 4) AS extra_pct FROM y WHERE a >= 6 OR mp > 50 OR ep > 50""",
)
def _a22_high_difference(x: Fixture) -> DataFrame:
    return c.high_difference_blocks(x.sides, S, 6.0, 50.0).select("pair_id", "block_no", r4("mean_abs"), r4("missing_pct"), r4("extra_pct"))


@_query(
    "a29_mean_per_hertz",
    """SELECT pair_id, type_id, hertz, round(avg(diff_amplitude), 4) AS diff_amplitude FROM matched GROUP BY 1, 2, 3""",
)
def _a29_mean_per_hertz(x: Fixture) -> DataFrame:
    return d.mean_per_hertz(x.audible, ["pair_id", "type_id"]).withColumn("diff_amplitude", r4("diff_amplitude"))


@_query(
    "a30_peak_per_hertz",
    """SELECT recording_id, type_id, bin, round(max(amplitude), 4) AS amplitude FROM own GROUP BY 1, 2, 3""",
)
def _a30_peak_per_hertz(x: Fixture) -> DataFrame:
    return d.peak_per_hertz(x.own_levels, ["recording_id", "type_id"]).select("recording_id", "type_id", n("bin"), r4("amplitude"))


@_query(
    "d1_difference_series",
    f"""SELECT pair_id, block_no, bin, round(diff_amplitude, 4) AS diff_amplitude, round(sqrt(greatest(least(1 - ref_amplitude / {S}, 1), 0)) * 0.85 + 0.15, 4) AS weight
  FROM matched""",
)
def _d1_difference_series(x: Fixture) -> DataFrame:
    return d.difference_series(x.matched, S, 1).select("pair_id", "block_no", n("bin"), r4("diff_amplitude"), r4("weight"))


@_query(
    "d2_averaged_series",
    f""", h AS (SELECT pair_id, type_id, hertz, avg(diff_amplitude) AS v FROM matched WHERE ref_amplitude > {S} / 2 GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER w AS n, avg(v) OVER (PARTITION BY pair_id, type_id
  ORDER BY hertz ROWS 3 PRECEDING) AS average
  FROM h
  WINDOW w AS (PARTITION BY pair_id, type_id
  ORDER BY hertz))
SELECT pair_id, type_id, hertz, round(average, 4) AS average FROM q WHERE n > 4""",
)
def _d2_averaged_series(x: Fixture) -> DataFrame:
    return d.averaged_series(x.matched, S).select("pair_id", "type_id", "hertz", r4("average"))


@_query(
    "d7_phase_series",
    """SELECT pair_id, type_id, channel, hertz, round(diff_phase, 3) AS diff_phase FROM matched""",
)
def _d7_phase_series(x: Fixture) -> DataFrame:
    return d.phase_series(x.matched).withColumn("diff_phase", F.round("diff_phase", 3))


@_query(
    "d8_noise_difference",
    """, h AS (SELECT pair_id, hertz, avg(diff_amplitude) AS v FROM every WHERE kind = 'silence' GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER w AS n, avg(v) OVER (PARTITION BY pair_id
  ORDER BY hertz ROWS 9 PRECEDING) AS average
  FROM h
  WINDOW w AS (PARTITION BY pair_id
  ORDER BY hertz))
SELECT pair_id, hertz, round(average, 4) AS average FROM q WHERE n > 10""",
)
def _d8_noise_difference(x: Fixture) -> DataFrame:
    return d.noise_difference_series(x.matched, 10).select("pair_id", "hertz", r4("average"))


@_query(
    "w4_runs",
    """, o AS (SELECT user_id, ts, event_id, value >= 50 AS pulse FROM events),
g AS (SELECT *, CASE WHEN lag(pulse) OVER w = pulse THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
SELECT user_id AS source, CAST(run AS BIGINT) AS run, pulse, count(*) AS length FROM r GROUP BY 1, 2, 3""",
)
def _w4_runs(x: Fixture) -> DataFrame:
    return d.runs(x.observations, "pulse", ["ts", "event_id"], ["source"]).select("source", n("run"), "pulse", "length")


TYPES = """WITH t AS (SELECT p_partkey % 40 AS profile_id, p_partkey AS ord, ['sync','silence','internal_sync','silence_override','user','user','user','user'][p_partkey % 8 + 1] AS kind, CAST(CASE WHEN p_partkey % 8 >= 4 THEN p_partkey % 5 + 1 ELSE -1 END AS INTEGER) AS type_id, CAST(p_partkey % 4 AS INTEGER) AS elements, p_size + 1 AS frames, p_size % 3 AS cut_frames, CASE WHEN p_partkey % 7 = 0 THEN 'S' ELSE 'm' END AS channel FROM part),
b0 AS (SELECT *, unnest(range(elements)) AS sub_index FROM t), b AS (SELECT *, row_number() OVER w - 1 AS block_no, coalesce(sum(frames) OVER (PARTITION BY profile_id ORDER BY ord, sub_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame_offset FROM b0 WINDOW w AS (PARTITION BY profile_id ORDER BY ord, sub_index)) """


@_query(
    "p1_block_layout",
    TYPES + """SELECT profile_id, block_no, ord, sub_index FROM b""",
    False,
)
def _p1_block_layout(x: Fixture) -> DataFrame:
    return p.block_layout(x.types).select("profile_id", n("block_no"), "ord", n("sub_index"))


@_query(
    "p2_frame_offsets",
    TYPES + """SELECT profile_id, block_no, CAST(frame_offset AS BIGINT) AS frame_offset FROM b""",
    False,
)
def _p2_frame_offsets(x: Fixture) -> DataFrame:
    return p.block_layout(x.types).select("profile_id", n("block_no"), "frame_offset")


@_query(
    "p5_resolve_silence",
    TYPES + """SELECT profile_id, ord, CASE WHEN kind = 'silence' AND bool_or(kind = 'silence_override') OVER (PARTITION BY profile_id) THEN 'skip' WHEN kind = 'silence_override' THEN 'silence' ELSE kind END AS kind
  FROM t""",
    False,
)
def _p5_resolve_silence(x: Fixture) -> DataFrame:
    return p.resolve_silence(x.types).select("profile_id", "ord", "kind")


@_query(
    "p6_addons",
    TYPES + """SELECT profile_id, ord, CASE WHEN a THEN 'time_domain' ELSE kind END AS kind, a AS is_addon
  FROM (SELECT *, type_id >= 0 AND row_number() OVER (PARTITION BY profile_id, type_id
  ORDER BY ord) > 1 AS a
  FROM t)""",
    False,
)
def _p6_addons(x: Fixture) -> DataFrame:
    return p.mark_addons(x.types, False).select("profile_id", "ord", "kind", "is_addon")


@_query(
    "p7_flatten",
    TYPES + """SELECT profile_id, ord, frames * elements AS frames FROM t""",
    False,
)
def _p7_flatten(x: Fixture) -> DataFrame:
    return p.flatten_profile(x.types).select("profile_id", "ord", "frames")


@_query(
    "p12_pad_length",
    TYPES + """SELECT profile_id, block_no, max(frames) OVER (PARTITION BY profile_id) - frames AS pad_frames FROM b""",
    False,
)
def _p12_pad_length(x: Fixture) -> DataFrame:
    return p.pad_length(p.block_layout(x.types)).select("profile_id", n("block_no"), "pad_frames")


@_query(
    "p14_block_seconds",
    TYPES + """SELECT profile_id, block_no, round(frames * 16.6884 / 1000, 6) AS seconds, round(ceil(frames * 16.6884 / 1000) - frames * 16.6884 / 1000, 6) AS pad_seconds
  FROM b""",
    False,
)
def _p14_block_seconds(x: Fixture) -> DataFrame:
    return (
        p.align_bins(p.block_seconds(p.block_layout(x.types).withColumn("ms_per_frame", F.lit(16.6884))))
        .select("profile_id", n("block_no"), r6("seconds"), r6("pad_seconds"))
    )


@_query(
    "p4_trim",
    """SELECT p_partkey, round(p_size * least(16.6884, 16 + p_size / 100.0) / 1000, 6) AS window_seconds, round(p_size * (16.6884 - least(16.6884, 16 + p_size / 100.0)) / 1000, 6) AS ref_trim
  FROM part""",
    False,
)
def _p4_trim(x: Fixture) -> DataFrame:
    return (
        p.trim_by_framerate(x.read("part").select("p_partkey", F.col("p_size").alias("frames"), F.lit(16.6884).alias("ref_ms"), (16 + F.col("p_size") / 100.0).alias("comp_ms")))
        .select("p_partkey", r6("window_seconds"), r6("ref_trim"))
    )


@_query(
    "w5_landmarks",
    TYPES + """, l AS (SELECT profile_id, min(block_no) FILTER (kind = 'sync') AS first_sync, max(block_no) FILTER (kind = 'sync') AS last_sync, min(block_no) FILTER (kind = 'silence') AS first_silence
  FROM b
  GROUP BY 1)
SELECT l.profile_id, first_sync, last_sync, first_silence, (SELECT max(block_no)
  FROM b
  WHERE b.profile_id = l.profile_id AND kind = 'silence' AND block_no < last_sync) AS closing_silence
  FROM l""",
    False,
)
def _w5_landmarks(x: Fixture) -> DataFrame:
    return p.landmarks(p.block_layout(x.types)).select("profile_id", n("first_sync"), n("last_sync"), n("first_silence"), n("closing_silence"))


@_query(
    "w6_segments",
    TYPES + """, m AS (SELECT *, sum(CASE WHEN kind = 'internal_sync' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY block_no) AS m FROM b),
s AS (SELECT profile_id, block_no, frames, CASE WHEN m % 2 = 1 AND kind <> 'internal_sync' THEN CAST((m + 1) // 2 AS BIGINT) END AS segment FROM m)
SELECT profile_id, block_no, segment, CASE WHEN segment IS NOT NULL THEN CAST(sum(frames) OVER (PARTITION BY profile_id, segment) AS BIGINT) END AS segment_frames
  FROM s""",
    False,
)
def _w6_segments(x: Fixture) -> DataFrame:
    return p.segments(p.block_layout(x.types)).select("profile_id", n("block_no"), "segment", n("segment_frames"))


@_query(
    "x2_active_types",
    TYPES + """SELECT DISTINCT profile_id, type_id FROM b WHERE type_id >= 1""",
    False,
)
def _x2_active_types(x: Fixture) -> DataFrame:
    return p.active_types(p.block_layout(x.types))


@_query(
    "s6_violations",
    TYPES + """, g AS (SELECT profile_id, count(*) FILTER (kind = 'sync') AS s, count(*) FILTER (kind = 'internal_sync') AS i, count(*) FILTER (kind = 'silence_override') AS o
  FROM t
  GROUP BY 1)
SELECT profile_id, 'two sync lines' AS rule FROM g WHERE s <> 2
UNION ALL
SELECT DISTINCT profile_id, 'no zero counts' FROM t WHERE elements <= 0 OR frames <= 0
UNION ALL
SELECT DISTINCT profile_id, 'cut below frames' FROM t WHERE cut_frames >= frames
UNION ALL
SELECT DISTINCT profile_id, 'no stereo control lines' FROM t WHERE kind <> 'user' AND channel = 'S'
UNION ALL
SELECT profile_id, 'internal sync in pairs' FROM g WHERE i % 2 = 1
UNION ALL
SELECT profile_id, 'override with one internal sync' FROM g WHERE o > 0 AND i > 2""",
    False,
)
def _s6_violations(x: Fixture) -> DataFrame:
    return p.validate_profiles(x.types)


@_query(
    "a28_profile_stats",
    TYPES + """SELECT profile_id, CAST(sum(elements) AS BIGINT) AS blocks, CAST(sum(elements * frames) AS BIGINT) AS frames, round(sum(elements * frames * 16.6884) / 1000, 4) AS seconds, round(avg(frames), 4) AS mean_frames, round(stddev_samp(frames), 4) AS sd_frames, count(DISTINCT CASE WHEN type_id >= 1 THEN type_id END) AS types
  FROM t
  GROUP BY 1""",
    False,
)
def _a28_profile_stats(x: Fixture) -> DataFrame:
    return (
        p.profile_stats(x.types, x.types.select("profile_id").distinct().withColumn("ms_per_frame", F.lit(16.6884)))
        .select("profile_id", "blocks", "frames", r4("seconds"), r4("mean_frames"), r4("sd_frames"), "types")
    )


@_query(
    "f_scalars",
    """SELECT p_partkey, sign(v) * floor(abs(v) * 100 + 0.5) / 100 AS rounded, round(20 * log10(p_retailprice / 3000), 4) AS db, round(1200 * log2(p_retailprice / 1000), 4) AS cents, round((10 * x ** 3 - 15 * x ** 4 + 6 * x ** 5) * 0.85 + 0.15, 6) AS weight, replace(p_name, '_', ' ') AS name, round(100 * (10 ** (x / 20) - 1), 6) AS imbalance
  FROM (SELECT *, p_retailprice / 7 AS v, p_size / 50.0 AS x
  FROM part)""",
    False,
)
def _f_scalars(x: Fixture) -> DataFrame:
    return (
        x.read("part")
        .select("p_partkey", e.round_half_away(F.col("p_retailprice") / 7, 2).alias("rounded"), F.round(e.decibels(F.col("p_retailprice"), F.lit(3000.0)), 4).alias("db"), F.round(e.cents(F.col("p_retailprice"), F.lit(1000.0)), 4).alias("cents"), F.round(e.weight(F.col("p_size") / 50.0, 2), 6).alias("weight"), e.display_name(F.col("p_name")).alias("name"), F.round(e.imbalance_pct(F.col("p_size") / 50.0), 6).alias("imbalance"))
    )


@_query(
    "s2_recording_facts",
    """SELECT p_partkey, p_retailprice * 100 / (p_size * 1000) AS seconds, least(p_size * 500.0, 20000.0) AS end_hz, p_size * 500 < 20000 AS nyquist_limited, p_retailprice * 100 / (p_size * 1000) < 10 AS too_short
  FROM part""",
    False,
)
def _s2_recording_facts(x: Fixture) -> DataFrame:
    return (
        so.recording_facts(x.read("part").select("p_partkey", (F.col("p_retailprice") * 100).alias("n_frames"), (F.col("p_size") * 1000).alias("sample_rate")), 20000.0, 10.0)
        .select("p_partkey", "seconds", "end_hz", "nyquist_limited", "too_short")
    )


@_query(
    "s3_full_scale",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN -48.16 WHEN 1 THEN -96.33 WHEN 2 THEN -144.49 ELSE -192.66 END AS lowest_dbfs FROM part""",
    False,
)
def _s3_full_scale(x: Fixture) -> DataFrame:
    return so.full_scale(x.read("part").select("p_partkey", ((F.col("p_partkey") % 4 + 1) * 8).cast("int").alias("bits"))).select("p_partkey", "lowest_dbfs")


@_query(
    "s11_manual_sync",
    """SELECT p_partkey AS recording_id, CASE WHEN s_suppkey IS NULL THEN p_size ELSE s_suppkey * 2 END AS start_frame, CASE WHEN s_suppkey IS NULL THEN 'ok' ELSE 'manual' END AS status
  FROM part
  LEFT
  JOIN supplier ON s_suppkey = p_partkey""",
    False,
)
def _s11_manual_sync(x: Fixture) -> DataFrame:
    return (
        so.apply_manual_sync(x.read("part").select(F.col("p_partkey").alias("recording_id"), F.col("p_size").cast("long").alias("start_frame"), F.lit(0).alias("end_frame"), F.lit("ok").alias("status")), x.read("supplier").select(F.col("s_suppkey").alias("recording_id"), (F.col("s_suppkey") * 2).alias("start_frame"), F.lit(1).alias("end_frame")))
        .select("recording_id", "start_frame", "status")
    )


@_query(
    "a23_sample_peak",
    """SELECT vec_id % 5 AS recording_id, round(max(list_max(list_transform(embedding, lambda v: abs(v))))::DOUBLE, 6) AS peak FROM embeddings GROUP BY 1""",
    False,
)
def _a23_sample_peak(x: Fixture) -> DataFrame:
    return sa.sample_peak(x.blocks, ["recording_id"]).select("recording_id", r6("peak"))


@_query(
    "d10_waveforms",
    """SELECT vec_id % 5 AS recording_id, vec_id // 5 AS block_no, part, round(list_min(embedding[part * 8 + 1:part * 8 + 8])::DOUBLE, 6) AS low, round(list_max(embedding[part * 8 + 1:part * 8 + 8])::DOUBLE, 6) AS high
  FROM embeddings, (SELECT unnest(range(8)) AS part)""",
    False,
)
def _d10_waveforms(x: Fixture) -> DataFrame:
    return sa.waveforms(x.blocks, 8).select("recording_id", "block_no", n("part"), r6("low"), r6("high"))


@_query(
    "u10_frame_rate",
    """SELECT p_partkey, round((p_size + 1600) * 1000.0 / 48000 / 2, 6) AS ms_per_frame, CASE WHEN abs((p_size + 1600) * 1000.0 / 48000 / 2 / 16.6884 - 1) > 0.01 THEN 'rejected' ELSE 'ok' END AS status
  FROM part""",
    False,
)
def _u10_frame_rate(x: Fixture) -> DataFrame:
    return (
        sy.frame_rate(x.read("part").select("p_partkey", F.lit(0).alias("start_frame"), (F.col("p_size") + 1600).alias("end_frame"), F.lit(48000.0).alias("sample_rate"), F.lit(2).alias("sync_frames"), F.lit(16.6884).alias("expected_ms")))
        .select("p_partkey", r6("ms_per_frame"), "status")
    )


@_query(
    "d4_noise_spectrogram",
    """, t AS (SELECT recording_id, bin, hertz, max(amplitude) AS a FROM own WHERE kind = 'silence' GROUP BY 1, 2, 3)
SELECT recording_id, bin, round(a, 4) AS amplitude, CASE WHEN hertz BETWEEN 16 AND 32 THEN 'scan' WHEN hertz = 10 THEN 'vertical' END AS line FROM t""",
)
def _d4_noise_spectrogram(x: Fixture) -> DataFrame:
    return (
        d.noise_spectrogram(x.own_levels, a.tag_noise_lines(x.own_levels, x.spec.sparkSession.createDataFrame(LINES, "line string, target_hz double, exact boolean")))
        .select("recording_id", n("bin"), r4("amplitude"), "line")
    )


def _more() -> None:
    """The queries of the other modules, which take their registry from here."""
    from sigdiff import queries_more, queries_rows  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return {name: (lambda spark, sf_dir, f=f: f(Fixture(spark, sf_dir))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _more()
    return {name: sql for name, (_, sql) in _found.items()}
