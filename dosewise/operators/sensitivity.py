"""The same statistics over other sets of loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.expressions import ratio
from dosewise.operators.diversity import diversity
from dosewise.operators.frequency import folded, polymorphic
from dosewise.operators.quality import first_per_key


def scenario_loci(joint: DataFrame, scenarios: list[tuple[str, float, int]]) -> DataFrame:
    """(locus_idx, locus_set): loci that meet each scenario's least frequency and count of the rarer allele in the joint panel."""
    named = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(float(f)).alias("maf"), F.lit(int(c)).alias("mac")) for s, f, c in scenarios])
    mac = F.least(F.col("alt"), 2 * F.col("n") - F.col("alt"))
    met = F.filter(named, lambda s: (folded() >= s["maf"]) & (mac >= s["mac"]))
    return joint.select("locus_idx", F.explode(met).alias("s")).select("locus_idx", F.col("s.name").alias("locus_set"))


def over_sets(stats: DataFrame, sets: DataFrame, group: str = "population") -> DataFrame:
    """Diversity of each group over each set of loci; sets may overlap, and all are one job."""
    both = stats.join(sets, "locus_idx").withColumn("_key", F.struct("locus_set", group))
    return diversity(both.drop(group, "locus_set"), "_key").select("_key.*", "*").drop("_key")


def retained_by_rule(loci: DataFrame, earlier: DataFrame) -> DataFrame:
    """(locus_idx, locus_set): loci whose clone is in both reports with equal first values, `retained`, and the others, `lost`.

    Both have clone_id, snp and row; of several rows of a clone the first counts.
    """
    now, then = (first_per_key(df, "clone_id", "snp", "row").withColumnRenamed("snp", name) for df, name in ((loci, "now"), (earlier, "then")))
    # clones grow with the loci: where their columns count as small they would be broadcast
    kept = now.join(then.hint("merge"), "clone_id").where(F.col("now") == F.col("then")).select("clone_id", F.lit("retained").alias("locus_set"))
    return loci.join(kept.hint("merge"), "clone_id", "left").select("locus_idx", F.coalesce("locus_set", F.lit("lost")).alias("locus_set"))


def inflation(by_set: DataFrame, all_loci: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Per cent by which a set's values differ from those over all loci."""
    base = all_loci.select(group, *[F.col(m).alias(f"{m}_all") for m in measures])
    return by_set.join(base, group).withColumns({f"{m}_inflation_pct": 100 * (ratio(m, f"{m}_all") - 1) for m in measures}).drop(*[f"{m}_all" for m in measures])


def call_rate_sets(calls: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_loci, n_polymorphic): loci that reach each call rate; missing calls are masked in frequencies."""
    levels = F.array(*map(F.lit, thresholds))
    rows = calls.select("call_rate", "p", F.explode(levels).alias("threshold"))
    ok = F.col("call_rate") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(ok).alias("n_loci"), F.count_if(ok & polymorphic()).alias("n_polymorphic"))


def character(joint: DataFrame, sides: DataFrame, sets: DataFrame) -> DataFrame:
    """(locus_set, ...): of each set (locus_idx, locus_set) the mean and median frequency of the rarer allele among all samples, the per cent of loci
    below 0.01 and of those that do not vary, their mean expected heterozygosity, and how many and which share vary among the focal samples and
    the rest (`side`). Loci that nobody is called at count as neither."""
    maf, p = F.least(F.col("p"), 1 - F.col("p")), F.col("p")
    pct = lambda ok: 100 * F.avg(ok.cast("int"))
    all_ = joint.join(sets, "locus_idx").groupBy("locus_set").agg(F.count("*").alias("n_loci"), F.avg(maf).alias("mean_maf"), F.median(maf).alias("median_maf"), pct(maf < 0.01).alias("pct_below_001"), pct((p == 0) | (p == 1)).alias("pct_monomorphic"), F.avg("he_unb").alias("mean_he"))
    varies = lambda side: F.count_if((F.col("side") == side) & polymorphic())
    by_side = sides.join(sets, "locus_idx").groupBy("locus_set").agg(varies("focal").alias("n_poly_focal"), varies("rest").alias("n_poly_rest"))
    return all_.join(by_side, "locus_set").select("*", *[F.try_divide(F.col(f"n_poly_{s}"), F.col("n_loci")).alias(f"prop_poly_{s}") for s in ("focal", "rest")])
