"""Allele-frequency spectra and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.functions.expressions import erfc, ks_tail, ratio
from dosewise.operators.frequency import folded, polymorphic


def folded_spectrum(stats: DataFrame, group: str = "population") -> DataFrame:
    """(group, mac, n_loci, share): polymorphic loci by count of the rarer allele, empty classes included."""
    some = stats.where(polymorphic()).select(group, F.least(F.col("alt"), 2 * F.col("n") - F.col("alt")).alias("mac"))
    counts = some.groupBy(group, "mac").agg(F.count("*").alias("n_loci"))
    size = stats.groupBy(group).agg(F.max("n").alias("n"), F.count_if(polymorphic()).alias("total"))
    classes = size.where("n > 0").select(group, "total", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("mac"))
    return classes.join(counts, [group, "mac"], "left").select(group, "mac", F.coalesce("n_loci", F.lit(0)).alias("n_loci"), ratio(F.coalesce("n_loci", F.lit(0)), "total").alias("share"))


def spectrum_summary(stats: DataFrame, group: str = "population") -> DataFrame:
    maf = F.when(polymorphic(), folded())
    return stats.groupBy(group).agg(F.count_if(polymorphic()).alias("n_polymorphic"), F.avg(maf).alias("mean_maf"), F.median(maf).alias("median_maf"))


def _distinct(values: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both samples at each distinct value: what rank tests need, and small where values are ratios of counts."""
    return values.where("x is not null").groupBy(*by, "x").agg(F.count_if("first").alias("k1"), F.count_if(~F.col("first")).alias("k2"))


def ks_two_sample(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, n1, n2, ks_d, ks_p) from rows (by, first, x): the largest distance of two distribution functions and its asymptotic level."""
    steps = _distinct(values, by)
    up = W.partitionBy(*by).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.select(*by, "k1", "k2", F.sum("k1").over(up).alias("c1"), F.sum("k2").over(up).alias("c2"))
    totals = steps.groupBy(*by).agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"))
    d = steps.join(totals, by).groupBy(*by).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.abs(ratio("c1", "n1") - ratio("c2", "n2"))).alias("ks_d"))
    ne = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return d.withColumn("ks_p", ks_tail((ne + 0.12 + 0.11 / ne) * F.col("ks_d")))


def mann_whitney(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, n1, n2, u, z, p) from rows (by, first, x): U of the first sample, tie-corrected; z and p are null if all values tie."""
    steps = _distinct(values, by).withColumn("t", F.col("k1") + F.col("k2"))
    before = W.partitionBy(*by).orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = steps.groupBy(*by).agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("k1") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - ratio("ties", n * (n - 1))))
    out = sums.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("z", F.when(sd > 0, (F.col("u") - n1 * n2 / 2) / sd))
    return out.select(*by, "n1", "n2", "u", "z", erfc(F.abs("z") / F.sqrt(F.lit(2.0))).alias("p"))


def focal_against(stats: DataFrame, focal: str, group: str) -> DataFrame:
    """Rows (other, first, x) of folded frequencies: the focal group's, once for each other group, and that group's own."""
    maf = stats.where(polymorphic()).select(group, folded().alias("x"))
    names = stats.where(F.col(group) != focal).agg(F.collect_set(group)).scalar()
    mine = maf.where(F.col(group) == focal).select(F.explode(names).alias("other"), F.lit(True).alias("first"), "x")
    return mine.union(maf.where(F.col(group) != focal).select(group, F.lit(False), "x"))


def gap_decomposition(focal: Column, full: Column, matched: Column) -> list[Column]:
    """How much of the difference between a focal and another value is due to sample size: difference, matched difference, per cent."""
    return [(focal - full).alias("gap"), (focal - matched).alias("matched_gap"), (100 * (1 - ratio(focal - matched, focal - full))).alias("pct_artefact")]


# ---------------------------------------------------------------- draws against a focal spectrum


def exact_folded(stats: DataFrame) -> DataFrame:
    """The polymorphic rows with their folded frequency `x`, a ratio of counts, so that equal frequencies are equal numbers."""
    return stats.where(polymorphic()).withColumn("x", F.least(F.col("alt"), 2 * F.col("n") - F.col("alt")) / (2 * F.col("n")))


def ks_by_draw(drawn: DataFrame, focal: DataFrame, by: str = "draw") -> DataFrame:
    """(by, ks_d): the largest distance of each draw's distribution function (by, x, k), k loci of value x, from the focal one (x); only distinct values with their numbers meet."""
    mine = focal.groupBy("x").agg(F.count("*").alias("k1")).agg(F.collect_list(F.struct("x", "k1"))).scalar()  # distinct frequencies: ratios of counts within one group
    theirs = drawn.groupBy(by, "x").agg(F.sum("k").alias("k2"))
    steps = theirs.select(by).distinct().select(by, F.explode(mine).alias("s")).select(by, "s.x", "s.k1", F.lit(0).cast("long").alias("k2"))
    steps = steps.union(theirs.select(by, "x", F.lit(0).cast("long"), "k2")).groupBy(by, "x").agg(F.sum("k1").alias("k1"), F.sum("k2").alias("k2"))
    up, all_ = W.partitionBy(by).orderBy("x").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(by)
    share = lambda k: ratio(F.sum(k).over(up), F.sum(k).over(all_))
    return steps.select(by, F.abs(share("k1") - share("k2")).alias("d")).groupBy(by).agg(F.max("d").alias("ks_d"))


def matched_table(draws: DataFrame, drawn: DataFrame, focal: DataFrame, full: DataFrame) -> DataFrame:
    """A row a population: of its draws (population, draw), whose values are in drawn (draw, x, k), k loci of value x, the mean folded frequency with deviation and 95 % range, polymorphic loci, distance from the focal
    spectrum, the share that reaches the focal mean; the whole population's mean (population, unmatched) and the per cent of its difference from the
    focal one that is due to size; and, the same in all rows, the envelope of the populations' means and whether the focal one is within."""
    mean = focal.agg(F.avg("x")).scalar()
    each = drawn.groupBy("draw").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("m")).join(ks_by_draw(drawn, focal), "draw")
    each = draws.join(each, "draw", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reaches = F.when(F.col("m").isNotNull(), (F.round("m", 9) >= F.round("focal_mean", 9)).cast("int"))
    out = each.withColumn("focal_mean", mean).groupBy("population").agg(
        F.count("*").alias("n_draws"), F.avg("m").alias("matched"), F.stddev_samp("m").alias("sd"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg("n").alias("n_polymorphic_mean"),
        F.stddev_samp("n").alias("n_polymorphic_sd"), F.avg("ks_d").alias("ks_d_mean"), F.stddev_samp("ks_d").alias("ks_d_sd"), F.avg(reaches).alias("p"), F.first("focal_mean").alias("focal_mean"),
    )
    ends = out.agg(F.min("matched").alias("a"), F.max("matched").alias("b"))
    out = out.join(full, "population").withColumns({"envelope_lo": ends.select("a").scalar(), "envelope_hi": ends.select("b").scalar()})
    within = F.round("focal_mean", 9).between(F.round("envelope_lo", 9), F.round("envelope_hi", 9))
    return out.select("*", *gap_decomposition(F.col("focal_mean"), F.col("unmatched"), F.col("matched")), within.alias("focal_within"))
