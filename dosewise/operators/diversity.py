"""Diversity of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.expressions import rarefied_richness, ratio
from dosewise.operators.frequency import folded, polymorphic


def diversity(stats: DataFrame, group: str = "population") -> DataFrame:
    """A row a group: size, loci, heterozygosities with standard errors over all loci, F_IS, polymorphism and folded frequency."""
    return stats.groupBy(group).agg(
        F.max("n").alias("n"), F.count("*").alias("n_loci"),
        F.avg("ho").alias("ho"), (F.stddev_samp("ho") / F.sqrt(F.count("ho"))).alias("ho_se"),
        F.avg("he_unb").alias("he_unbiased"), (F.stddev_samp("he_unb") / F.sqrt(F.count("he_unb"))).alias("he_se"),
        F.avg("he_hw").alias("he_hw"), ratio(F.sum("b"), F.sum(F.col("b") + F.col("c"))).alias("fis_wc"),
        F.count_if(polymorphic()).alias("n_polymorphic"), F.avg(polymorphic().cast("int")).alias("prop_polymorphic"),
        F.avg(F.when(polymorphic(), folded())).alias("mean_folded_maf"),
    )


def fis_jackknife(stats: DataFrame, group: str = "population") -> DataFrame:
    """(group, fis_wc, fis_jack_se): delete-one-locus, over the deletions that leave a ratio."""
    totals = stats.groupBy(group).agg(F.sum("b").alias("sum_b"), F.sum(F.col("b") + F.col("c")).alias("sum_bc"))
    left = stats.join(totals, group).select(group, "sum_b", "sum_bc", ratio(F.col("sum_b") - F.col("b"), F.col("sum_bc") - F.col("b") - F.col("c")).alias("theta"))
    m = F.count("theta")
    return left.groupBy(group).agg(ratio(F.first("sum_b"), F.first("sum_bc")).alias("fis_wc"), F.sqrt((m - 1) * F.var_pop("theta")).alias("fis_jack_se"))


def allelic_richness(stats: DataFrame, g: int | list[int] = 16, group: str = "population") -> DataFrame:
    """(group, g, ar, ar_se, n_loci): mean rarefied number of alleles among g genes, over loci with so many; null where there is none.

    Loci of equal sample size and allele count are one evaluation, weighted by their number.
    """
    levels = F.array(*map(F.lit, [g] if isinstance(g, int) else g))
    few = stats.groupBy(group, "n", "alt").agg(F.count("*").alias("k"))
    few = few.select("*", F.explode(levels).alias("g")).withColumn("a", rarefied_richness(2 * F.col("n"), "alt", F.col("g")))
    k = F.sum(F.when(F.col("a").isNotNull(), F.col("k")))
    sums = few.groupBy(group, "g").agg(k.alias("n_loci"), F.sum(F.col("k") * F.col("a")).alias("s"), F.sum(F.col("k") * F.col("a") * F.col("a")).alias("s2"))
    mean = F.col("s") / F.col("n_loci")
    spread = F.greatest(F.col("s2") - F.col("s") * mean, F.lit(0.0))
    return sums.select(group, "g", mean.alias("ar"), F.sqrt(ratio(spread, F.col("n_loci") - 1) / F.col("n_loci")).alias("ar_se"), F.coalesce("n_loci", F.lit(0)).alias("n_loci"))


def focal_ratios(values: DataFrame, focal: str, group: str, measures: list[str]) -> DataFrame:
    """(measure, focal, others_mean, pct_of_others, is_lowest): a focal group against the unweighted mean of the other groups' values."""
    long = values.unpivot([group], measures, "measure", "x")
    mine = F.col(group) == focal
    out = long.groupBy("measure").agg(F.max(F.when(mine, F.col("x"))).alias("focal"), F.avg(F.when(~mine, F.col("x"))).alias("others_mean"), F.min("x").alias("least"))
    return out.select("measure", "focal", "others_mean", (100 * ratio("focal", "others_mean")).alias("pct_of_others"), (F.col("focal") == F.col("least")).alias("is_lowest"))


def old_against_new(new: DataFrame, old: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Each group's measures now, before, their difference and change in per cent; null where there was no value before."""
    before = old.select(group, *[F.col(m).alias(f"{m}_old") for m in measures])
    out = new.join(before, group, "left")
    columns = [c for m in measures for c in (F.col(m), F.col(f"{m}_old"), (F.col(m) - F.col(f"{m}_old")).alias(f"{m}_delta"), (100 * (ratio(m, f"{m}_old") - 1)).alias(f"{m}_pct"))]
    return out.select(group, *columns)


def published_table(stats: DataFrame, samples: DataFrame, intervals: DataFrame, g: int = 16, group: str = "population") -> DataFrame:
    """A row a group with its region, sizes, heterozygosities, F_IS with its jackknife error and the interval of `intervals` (group, lo, hi), polymorphism, richness
    among g genes with its error, and folded frequency. A group whose samples are of several regions has the first by name."""
    where = samples.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("region").alias("region"), F.count("*").alias("n_samples"))
    error = fis_jackknife(stats, group).select(group, "fis_jack_se")
    rich = allelic_richness(stats, g, group).select(group, F.col("ar").alias(f"ar_g{g}"), F.col("ar_se").alias(f"ar_g{g}_se"))
    ends = intervals.select(group, F.col("lo").alias("fis_boot_lo"), F.col("hi").alias("fis_boot_hi"))
    out = diversity(stats, group).drop("n")
    for more in (where, error, rich, ends):  # a row a group each
        out = out.join(more, group, "left")
    return out.select(
        group, "region", F.col("n_samples").alias("n"), "n_loci", "ho", "ho_se", "he_unbiased", "he_se", "he_hw", "fis_wc", "fis_jack_se", "fis_boot_lo", "fis_boot_hi",
        "n_polymorphic", "prop_polymorphic", f"ar_g{g}", f"ar_g{g}_se", "mean_folded_maf",
    )
