"""Matching two spectra and counting what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.exprs import amplitude_difference, phase_difference
from sigdiff.options import TOLERANCE_HZ

KEY = ["pair_id", "block_no", "channel", "boxsize_ms", "bin"]


def _sides(ref: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = ref.select(*KEY, "kind", "type_id", "hertz", F.col("amplitude").alias("ref_amplitude"), F.col("phase").alias("ref_phase"))
    return a, comp.select(*KEY, F.col("hertz").alias("comp_hertz"), F.col("amplitude").alias("comp_amplitude"), F.col("phase").alias("comp_phase"))


def _differences(found: DataFrame) -> DataFrame:
    out = found.withColumn("diff_amplitude", amplitude_difference(F.col("ref_amplitude"), F.col("comp_amplitude")))
    return out.withColumn("diff_phase", phase_difference(F.col("ref_phase"), F.col("comp_phase")))


def match(ref: DataFrame, comp: DataFrame, tolerance_hz: float | None = None) -> DataFrame:
    """Equal bins. J2b: hertz within a tolerance, by cells of its width of which the comparison takes three."""
    a, b = _sides(ref, comp)
    if tolerance_hz is None:
        return _differences(a.join(b.drop("comp_hertz"), KEY))
    cell = lambda c: F.floor(F.col(c) / tolerance_hz)
    a = a.withColumn("_cell", cell("hertz"))
    b = b.drop("boxsize_ms", "bin").withColumn("_cell", F.explode(F.array(cell("comp_hertz") - 1, cell("comp_hertz"), cell("comp_hertz") + 1)))
    found = a.join(b, ["pair_id", "block_no", "channel", "_cell"]).where(F.abs(F.col("hertz") - F.col("comp_hertz")) < tolerance_hz)
    return _differences(found.drop("_cell", "comp_hertz"))


def both_sides(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """J2a, J3 and J4 in one full outer join: a row for each bin of either side. What is significant is up to the caller; side is both, ref or comp."""
    a, _ = _sides(ref, comp)
    b = comp.select(*KEY, F.col("kind").alias("_kind"), F.col("type_id").alias("_type"), F.col("hertz").alias("_hertz"), F.col("amplitude").alias("comp_amplitude"), F.col("phase").alias("comp_phase"))
    out = a.join(b, KEY, "full").withColumn("side", F.when(F.col("comp_amplitude").isNull(), "ref").when(F.col("ref_amplitude").isNull(), "comp").otherwise("both"))
    for own, other in (("kind", "_kind"), ("type_id", "_type"), ("hertz", "_hertz")):
        out = out.withColumn(own, F.coalesce(own, other))
    return _differences(out.drop("_kind", "_type", "_hertz"))


def of_both(sides: DataFrame) -> DataFrame:
    """J2a from both_sides."""
    return sides.where("side = 'both'").drop("side")


def unmatched(sides: DataFrame, side: str, significance: float | Column | None = None) -> DataFrame:
    """J3 (side ref) and J4 (side comp, above the significance) from both_sides."""
    level = F.col(f"{side}_amplitude")
    own = sides.where(F.col("side") == side)
    return (own if significance is None else own.where(level > significance)).select(*KEY, "kind", "type_id", "hertz", level.alias("amplitude"))


def missing(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """Significant reference bins without a partner."""
    return ref.join(comp.select(*KEY), KEY, "left_anti").select(*KEY, "kind", "type_id", "hertz", "amplitude")


def extra(ref: DataFrame, comp: DataFrame, significance: float | Column) -> DataFrame:
    """Comparison bins above the significance without a partner."""
    return comp.where(F.col("amplitude") > significance).join(ref.select(*KEY), KEY, "left_anti").select(*KEY, "kind", "type_id", "hertz", "amplitude")


def rank_listing(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """Both spectra side by side by rank, with a mark where the reference's bin has a partner."""
    by = ["pair_id", "block_no", "channel", "rank"]
    a = ref.select(*by, F.col("bin").alias("ref_bin"), F.col("amplitude").alias("ref_amplitude"))
    b = comp.select(*by, F.col("bin").alias("comp_bin"), F.col("amplitude").alias("comp_amplitude"))
    marks = match(ref, comp).select("pair_id", "block_no", "channel", F.col("bin").alias("ref_bin"), F.lit(True).alias("is_matched"))
    return a.join(marks, ["pair_id", "block_no", "channel", "ref_bin"], "left").join(b, by, "full").withColumn("is_matched", F.coalesce("is_matched", F.lit(False)))


def threshold_listing(matched: DataFrame, db: float) -> DataFrame:
    """J14."""
    return matched.where(F.abs("diff_amplitude") > db)


def counters(sides: DataFrame) -> DataFrame:
    """A13 from both_sides, without a second join: by pair, channel, block and both, as grouping sets; null where a column is not grouped by. What only the comparison has is not counted."""
    small = F.abs("diff_amplitude") < TOLERANCE_HZ
    sets = [["pair_id"], ["pair_id", "channel"], ["pair_id", "block_no"], ["pair_id", "channel", "block_no"]]
    return (
        sides.where("side <> 'comp'")
        .withColumn("lost", F.col("ref_amplitude").isNotNull().cast("int") - F.col("comp_amplitude").isNotNull().cast("int"))
        .groupingSets([[F.col(c) for c in s] for s in sets], "pair_id", "channel", "block_no")
        .agg(F.count("*").alias("compared"), F.count_if(small).alias("perfect"), F.count_if(~small).alias("differing"), F.sum("lost").alias("missing"), F.count_if(F.abs("diff_phase") >= TOLERANCE_HZ).alias("phase_differing"))
    )


def mean_difference(matched: DataFrame) -> DataFrame:
    """A14."""
    return matched.where("kind <> 'silence'").groupBy("pair_id").agg(F.avg("diff_amplitude").alias("mean_diff"))


def recentre(matched: DataFrame) -> DataFrame:
    """A mean is a row a pair, joined back."""
    return matched.join(mean_difference(matched), "pair_id").withColumn("diff_amplitude", F.col("diff_amplitude") - F.col("mean_diff")).drop("mean_diff")


def share(matched: DataFrame, hit, by: tuple[str, ...] = ("pair_id", "type_id", "channel")) -> DataFrame:
    return matched.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total")).withColumn("pct", 100 * F.col("hits") / F.col("total"))


def share_within(matched: DataFrame, db: float, count_perfect: bool = True) -> DataFrame:
    """A15."""
    own = matched if count_perfect else matched.where(F.abs("diff_amplitude") >= TOLERANCE_HZ)
    return share(own, F.abs("diff_amplitude") <= db)


def share_differing(matched: DataFrame) -> DataFrame:
    """A16."""
    return share(matched, F.abs("diff_amplitude") >= TOLERANCE_HZ, ("pair_id", "type_id"))


def share_perfect(matched: DataFrame) -> DataFrame:
    """A17."""
    return share(matched, F.abs("diff_amplitude") < TOLERANCE_HZ, ("pair_id", "type_id"))


def share_unmatched(side: DataFrame, lost: DataFrame) -> DataFrame:
    """Of the reference (with missing) or of the comparison (with extra)."""
    by = ["pair_id", "type_id", "channel"]
    return side.groupBy(*by).agg(F.count("*").alias("total")).join(lost.groupBy(*by).agg(F.count("*").alias("hits")), by, "left").select(*by, F.coalesce("hits", F.lit(0)).alias("hits"), "total", (100 * F.coalesce("hits", F.lit(0)) / F.col("total")).alias("pct"))


def worst_type(shares: DataFrame) -> DataFrame:
    """The type with the least share."""
    best = F.min_by(F.struct("type_id", "channel", "pct"), F.struct("pct", "type_id", "channel")).alias("p")
    return shares.groupBy("pair_id").agg(best).select("pair_id", "p.*")


def share_outside(matched: DataFrame, db: float) -> DataFrame:
    """Per run of blocks of one type; the worst run of each pair."""
    blocks = matched.groupBy("pair_id", "block_no", "type_id").agg(F.count_if(F.abs("diff_amplitude") > db).alias("out"), F.count("*").alias("n"))
    w = Window.partitionBy("pair_id").orderBy("block_no")
    change = F.when(F.lag("type_id").over(w) == F.col("type_id"), 0).otherwise(1)
    runs = blocks.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("pair_id", "run", "type_id").agg((100 * F.sum("out") / F.sum("n")).alias("pct"))
    return each.groupBy("pair_id").agg(F.max_by(F.struct("run", "type_id", "pct"), F.struct("pct", -F.col("run"))).alias("p")).select("pair_id", "p.*")


def fit_range(matched: DataFrame, range_db: float) -> DataFrame:
    """Mean + k sd of |difference| of the worst type, if 25 % or more is outside the range."""
    own = matched.groupBy("pair_id", "type_id").agg(F.avg(F.abs("diff_amplitude")).alias("mean"), F.stddev_samp(F.abs("diff_amplitude")).alias("sd"), (100 * F.count_if(F.abs("diff_amplitude") > range_db) / F.count("*")).alias("outside"))
    worst = own.groupBy("pair_id").agg(F.max_by(F.struct("type_id", "mean", "sd", "outside"), F.struct("outside", -F.col("type_id"))).alias("p")).select("pair_id", "p.*")
    one, two = F.ceil(F.col("mean") + F.col("sd")), F.ceil(F.col("mean") + 2 * F.col("sd"))
    fitted = F.when(F.col("outside") < 25, F.lit(range_db)).when(one > range_db, one.cast("double")).otherwise(two.cast("double"))
    return worst.select("pair_id", "type_id", "outside", fitted.alias("range_db"))


def high_difference_blocks(sides: DataFrame, significance: float | Column, db: float, pct: float) -> DataFrame:
    """A22 from both_sides, without a second join. significance: what a bin that only the comparison has must be above."""
    side = F.col("side")
    n, lost = F.count_if(side == "both"), F.count_if(side == "ref")
    more = F.count_if((side == "comp") & (F.col("comp_amplitude") > significance))
    share = lambda k: 100 * k / F.greatest(k + n, F.lit(1))
    out = sides.groupBy("pair_id", "block_no").agg(F.avg(F.when(side == "both", F.abs("diff_amplitude"))).alias("mean_abs"), share(lost).alias("missing_pct"), share(more).alias("extra_pct"))
    return out.where((F.col("mean_abs") >= db) | (F.col("missing_pct") > pct) | (F.col("extra_pct") > pct))
