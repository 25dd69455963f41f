"""Counts, frequencies and heterozygosities of loci by group: the fact table that other operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.expressions import ratio


def group_sizes(samples: DataFrame, group: str = "population", order: str | None = None) -> DataFrame:
    """(group, size, ord): samples of each group; `ord` is the declared order, or the name. Samples without a group are in none."""
    return samples.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"), F.min(order or group).alias("ord"))


def locus_counts(geno: DataFrame, samples: DataFrame, group: str = "population") -> DataFrame:
    """(group, locus_idx, alt, het, hom, missing) of what is stored: one shuffle, of rows that are already summed by task."""
    cells = geno.join(samples.select("sample_idx", group).where(F.col(group).isNotNull()), "sample_idx")
    dose = F.col("dose")
    return cells.groupBy(group, "locus_idx").agg(
        F.coalesce(F.sum("dose"), F.lit(0)).alias("alt"), F.count_if(dose == 1).alias("het"), F.count_if(dose == 2).alias("hom"), F.count_if(dose.isNull()).alias("missing")
    )


def locus_stats(geno: DataFrame, samples: DataFrame, loci: DataFrame, group: str = "population", order: str | None = None, stored: bool = False) -> DataFrame:
    """(group, ord, locus_idx, n, alt, het, p, ho, he_hw, he_unb, b, c) of every group and locus, one row each.

    With `stored`, only of groups and loci that have a stored cell: elsewhere all samples are called with dose 0, and every statistic is 0.
    n counts called samples; a locus nobody is called at has null statistics, as unbiased ones have below two samples.
    b and c are the within-group components: F_IS is sum(b) / sum(b + c).
    """
    sizes = group_sizes(samples, group, order)
    counts = locus_counts(geno, samples, group)
    if stored:
        stats = counts.join(sizes, group)
    else:
        # every group's size comes with its name: joined to them, the grid would count as small as the loci and be broadcast
        groups = sizes.agg(F.collect_list(F.struct(group, "size", "ord"))).scalar()
        grid = loci.select("locus_idx", F.explode(groups).alias("_g")).select("locus_idx", "_g.*")
        stats = grid.join(counts, [group, "locus_idx"], "left").fillna(0, ["alt", "het", "hom", "missing"])
    stats = stats.withColumn("n", F.col("size") - F.col("missing")).withColumn("p", ratio("alt", 2 * F.col("n")))
    n, p = F.col("n"), F.col("p")
    stats = stats.withColumn("ho", ratio("het", n)).withColumn("he_hw", 2 * p * (1 - p))
    return stats.select(
        group, "ord", "locus_idx", "n", "alt", "het", "p", "ho", "he_hw",
        F.when(n > 1, 2 * n / (2 * n - 1) * F.col("he_hw")).alias("he_unb"),
        F.when(n > 1, n / (n - 1) * (p * (1 - p) - (2 * n - 1) / (4 * n) * F.col("ho"))).alias("b"),
        F.when(n > 1, F.col("ho") / 2).alias("c"),
    )


def whole(samples: DataFrame, name: str = "all") -> DataFrame:
    """The samples as one group, `panel`."""
    return samples.withColumn("panel", F.lit(name))


def genotype_counts(geno: DataFrame, samples: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_idx, n0, n1, n2, called, call_rate, p) of the whole panel; p is masked: of called samples only."""
    counts = locus_counts(geno, whole(samples), "panel").drop("panel")
    size = samples.agg(F.count("*")).scalar()
    out = loci.select("locus_idx").join(counts, "locus_idx", "left").fillna(0, ["alt", "het", "hom", "missing"]).withColumn("size", size)
    called = F.col("size") - F.col("missing")
    return out.select("locus_idx", (called - F.col("het") - F.col("hom")).alias("n0"), F.col("het").alias("n1"), F.col("hom").alias("n2"), called.alias("called"), ratio(called, "size").alias("call_rate"), ratio("alt", 2 * called).alias("p"))


def polymorphic(p: str = "p"):
    return (F.col(p) > 0) & (F.col(p) < 1)


def folded(p: str = "p"):
    """Frequency of the rarer allele."""
    return F.least(F.col(p), 1 - F.col(p))
