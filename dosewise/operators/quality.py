"""Loci and samples: annotation, filters and the counts that audit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.functions.expressions import chi2_critical, ratio
from dosewise.operators.frequency import polymorphic


def classified(samples: DataFrame, id: str, excluded: list[str], focal_pattern: str, known: str) -> DataFrame:
    """samples with include and reason: focal ids by pattern, excluded ones by list, others by whether a population is known."""
    name = F.trim(F.col(id))
    reason = F.when(name.isin(excluded), "excluded").when(name.rlike(focal_pattern), "focal").when(F.col(known).isNull(), "no population").otherwise("mainland")
    return samples.withColumn("reason", reason).withColumn("include", F.col("reason").isin("focal", "mainland"))


def recoded(df: DataFrame, column: str, table: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """df with values of a column replaced by the table's, itself where it has none; of several entries for a value the last by `row` counts."""
    order = "row" if "row" in table.columns else new
    last = table.groupBy(F.col(old).alias("_old")).agg(F.max_by(new, order).alias("_new"))
    return df.join(last, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_per_key(df: DataFrame, key: str, value: str, row: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, row).alias(value))


def crosswalk(loci: DataFrame, anchors: DataFrame, sex: list[str], unplaced_prefix: str) -> DataFrame:
    """(scaffold, refseq_majority, chrom_label, purity, n_anchor_loci, class) of every scaffold.

    anchors (locus_idx, refseq) are loci placed by an earlier report. A scaffold takes the reference that most of its anchors have, of
    equal ones that seen first by row; a scaffold without anchors is unanchored, with an empty reference.
    """
    scaffolds = loci.where("scaffold <> ''").select("scaffold", "locus_idx")
    # anchors grow with the loci: where their columns count as small they would be broadcast
    votes = scaffolds.join(anchors.where("refseq <> ''").select("locus_idx", "refseq").hint("merge"), "locus_idx")
    votes = votes.groupBy("scaffold", "refseq").agg(F.count("*").alias("votes"), F.min("locus_idx").alias("seen"))
    best = votes.groupBy("scaffold").agg(F.max_by("refseq", F.struct("votes", -F.col("seen"))).alias("refseq_majority"), F.max("votes").alias("most"), F.sum("votes").alias("n_anchor_loci"))
    out = scaffolds.select("scaffold").distinct().join(best, "scaffold", "left")
    ref = F.col("refseq_majority")
    kind = F.when(ref.isNull(), "unanchored").when(ref.isin(sex), "sex").when(ref.startswith(unplaced_prefix), "unplaced").otherwise("autosome")
    return out.select(
        "scaffold", F.coalesce(ref, F.lit("")).alias("refseq_majority"), F.when(kind.isin("unanchored", "unplaced"), kind).otherwise(ref).alias("chrom_label"),
        ratio("most", "n_anchor_loci").alias("purity"), F.coalesce("n_anchor_loci", F.lit(0)).alias("n_anchor_loci"), kind.alias("class"),
    )


def annotated(loci: DataFrame, walk: DataFrame) -> DataFrame:
    """loci with class and refseq_majority of their scaffold; without a scaffold they are unaligned."""
    small = walk.select("scaffold", F.col("class").alias("_class"), F.col("refseq_majority").alias("_ref"))
    out = loci.join(small, "scaffold", "left")
    kind = F.when(F.coalesce("scaffold", F.lit("")) == "", "unaligned").otherwise(F.coalesce("_class", F.lit("unanchored")))
    return out.select(*[loci[c] for c in loci.columns], kind.alias("class"), F.coalesce("_ref", F.lit("")).alias("refseq_majority"))


def crosswalk_confusion(loci: DataFrame, anchors: DataFrame, sex: list[str]) -> DataFrame:
    """One row: loci by what their anchor and their scaffold say, sex or not, and the share that agree. loci are annotated."""
    both = loci.where("class not in ('unaligned', 'unanchored')").join(anchors.select("locus_idx", F.col("refseq").alias("direct")), "locus_idx")
    direct, walk = F.col("direct").isin(sex), F.col("class") == "sex"
    counts = both.agg(F.count_if(direct & walk).alias("sex_sex"), F.count_if(direct & ~walk).alias("sex_auto"), F.count_if(~direct & walk).alias("auto_sex"), F.count_if(~direct & ~walk).alias("auto_auto"))
    return counts.withColumn("agreement", ratio(F.col("sex_sex") + F.col("auto_auto"), F.col("sex_sex") + F.col("sex_auto") + F.col("auto_sex") + F.col("auto_auto")))


def one_per_clone(loci: DataFrame, rank_by: list[Column]) -> DataFrame:
    """Of each clone the locus that ranks first, ties to the smaller index."""
    order = W.partitionBy("clone_id").orderBy(*rank_by, "locus_idx")
    return loci.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sex_linked(by_sex: DataFrame, least: int = 20) -> DataFrame:
    """(locus_idx, h_f, h_m, sex_linked) from locus statistics grouped by `sex`: heterozygous in females, hardly in males; a flag, no filter."""
    both = by_sex.groupBy("locus_idx").agg(
        F.max(F.when(F.col("sex") == "F", F.col("ho"))).alias("h_f"), F.max(F.when(F.col("sex") == "M", F.col("ho"))).alias("h_m"),
        F.max(F.when(F.col("sex") == "F", F.col("n"))).alias("n_f"), F.max(F.when(F.col("sex") == "M", F.col("n"))).alias("n_m"),
    )
    flag = (F.col("n_f") >= least) & (F.col("n_m") >= least) & (F.col("h_f") > 0.05) & (F.col("h_m") < 0.1 * F.col("h_f"))
    return both.select("locus_idx", "h_f", "h_m", F.coalesce(flag, F.lit(False)).alias("sex_linked"))


def hwe_chi2() -> Column:
    """Goodness of fit to Hardy-Weinberg proportions from n, alt, het and p; 0 for a fixed locus or a single sample."""
    n, p = F.col("n"), F.col("p")
    n2 = (F.col("alt") - F.col("het")) / 2
    n0 = n - F.col("het") - n2
    e0, e1, e2 = n * (1 - p) * (1 - p), 2 * n * p * (1 - p), n * p * p
    chi = (n0 - e0) * (n0 - e0) / e0 + (F.col("het") - e1) * (F.col("het") - e1) / e1 + (n2 - e2) * (n2 - e2) / e2
    return F.when(polymorphic() & (n > 1), chi).otherwise(0.0)


def hwe_failures(stats: DataFrame, group: str = "population", least_size: int = 19, family: float = 0.05) -> DataFrame:
    """(locus_idx, tests, failures) over groups of least_size or more; alpha is the family's level over loci and groups.

    The level needs the number of loci and of groups that are tested, which is a small query of its own.
    """
    sized = stats.groupBy(group).agg(F.max("n").alias("size")).where(F.col("size") >= least_size).select(group)
    tested = stats.join(sized, group, "left_semi")
    counts = tested.agg(F.count_distinct("locus_idx").alias("loci"), F.count_distinct(group).alias("groups")).first()
    critical = chi2_critical(family / max(counts["loci"] * counts["groups"], 1))
    return tested.groupBy("locus_idx").agg(F.count("*").alias("tests"), F.count_if(hwe_chi2() > critical).alias("failures"))


def cascade(flags: DataFrame, steps: list[str]) -> DataFrame:
    """(step, name, standalone, cumulative): loci that pass each boolean column by itself and with all before it, in one pass."""
    counts, so_far = [F.count("*").alias("s0"), F.count("*").alias("c0")], F.lit(True)
    for i, name in enumerate(steps, 1):
        ok = F.coalesce(F.col(name), F.lit(False))
        so_far = so_far & ok
        counts += [F.count_if(ok).alias(f"s{i}"), F.count_if(so_far).alias(f"c{i}")]
    rows = ", ".join(f"{i}, '{name}', s{i}, c{i}" for i, name in enumerate(["input", *steps]))
    return flags.agg(*counts).selectExpr(f"stack({len(steps) + 1}, {rows}) AS (step, name, standalone, cumulative)")


def cascade_deltas(steps: DataFrame) -> DataFrame:
    """The cascade with what each step removes; a cascade has a handful of rows."""
    at = W.partitionBy(F.lit(1)).orderBy("step")
    before = F.lag("cumulative").over(at)
    return steps.select("*", (before - F.col("cumulative")).alias("removed"), (100 * ratio(before - F.col("cumulative"), before)).alias("pct_removed"))


def quality_flags(loci: DataFrame, calls: DataFrame, hwe: DataFrame, least_rep: float, least_aln: int, least_call: float) -> DataFrame:
    """Annotated loci with a boolean for every filter; a value that is no number passes none."""
    return (
        loci.join(calls.select("locus_idx", "call_rate"), "locus_idx", "left").join(hwe.select("locus_idx", "failures"), "locus_idx", "left")
        .withColumns({
            "pass_reproducible": F.coalesce(F.nanvl("rep_score", F.lit(None)) >= least_rep, F.lit(False)), "pass_aligned": F.coalesce(F.col("aln_cnt") >= least_aln, F.lit(False)),
            "pass_autosome": F.col("class") != "sex", "pass_call_rate": F.coalesce(F.col("call_rate") >= least_call, F.lit(False)), "pass_hwe": F.coalesce("failures", F.lit(0)) < 2,
        })
    )


def cascade_variants(loci: DataFrame, calls: DataFrame, stats: DataFrame, joint: DataFrame, least_rep: float, least_aln: int, call_rates: list[float], group: str = "population", least_size: int = 19, family: float = 0.05) -> DataFrame:
    """(call_rate, unanchored, hwe_mode, alpha, n_before, n_failed, n_final): the whole cascade for every call rate, with unanchored loci kept or dropped, and the
    Hardy-Weinberg test by group (two failures of the larger groups remove a locus) or of all samples at once.

    A variant's level is the family's over the loci that its own earlier filters leave, times the groups that are tested; so a first pass counts those, a row a
    variant comes to the driver, and the second passes on what a locus needs for every level: the second largest of its groups' statistics,
    and that of all samples. Of a clone one locus stays, with the largest call rate, then rep_score, then the smallest number. A variant without loci has no level.
    loci are annotated with `class`; calls has call_rate.
    """
    spark = loci.sparkSession
    large = stats.groupBy(group).agg(F.max("n").alias("size")).where(F.col("size") >= least_size).select(group)
    each = stats.join(large, group, "left_semi").groupBy("locus_idx").agg(F.sort_array(F.collect_list(hwe_chi2()), asc=False).alias("chi"))  # a number a group
    each = each.select("locus_idx", F.try_element_at("chi", F.lit(2)).alias("second"))
    base = loci.where((F.nanvl("rep_score", F.lit(None)) >= least_rep) & (F.col("aln_cnt") >= least_aln) & (F.col("class") != "sex"))
    rows = base.select("locus_idx", "clone_id", "rep_score", "class").join(calls.select("locus_idx", F.col("call_rate").alias("called")), "locus_idx").join(each, "locus_idx", "left").join(joint.select("locus_idx", hwe_chi2().alias("once")), "locus_idx", "left")
    variant = ["call_rate", "unanchored", "hwe_mode"]
    variants = F.array(*[F.struct(F.lit(float(c)).alias("call_rate"), F.lit(u).alias("unanchored"), F.lit(m).alias("hwe_mode")) for c in call_rates for u in ("keep", "drop") for m in ("each", "joint")])
    left = rows.withColumn("v", F.explode(variants)).select("*", *[F.col(f"v.{c}") for c in variant]).drop("v").where((F.col("called") >= F.col("call_rate")) & ((F.col("unanchored") == "keep") | (F.col("class") != "unanchored")))
    groups = large.count()
    known = {tuple(r[c] for c in variant): r["n"] for r in left.groupBy(*variant).agg(F.count("*").alias("n")).collect()}  # a row a variant
    levels = []
    for c in call_rates:
        for u in ("keep", "drop"):
            for m in ("each", "joint"):
                n = known.get((float(c), u, m), 0)
                tests = n * (groups if m == "each" else 1)
                alpha = family / tests if tests else None
                levels.append((float(c), u, m, alpha, n, chi2_critical(alpha) if alpha else None))
    levels = F.broadcast(spark.createDataFrame(levels, "call_rate double, unanchored string, hwe_mode string, alpha double, n_before long, critical double"))
    failed = F.coalesce(F.when(F.col("hwe_mode") == "each", F.col("second")).otherwise(F.col("once")) > F.col("critical"), F.lit(False))
    tested = left.join(levels.select(*variant, "critical"), variant).withColumn("failed", failed)
    best = W.partitionBy(*variant, "clone_id", "failed").orderBy(F.desc("called"), F.desc("rep_score"), "locus_idx")
    counts = tested.withColumn("first", F.row_number().over(best) == 1).groupBy(*variant).agg(F.count_if("failed").alias("n_failed"), F.count_if(~F.col("failed") & F.col("first")).alias("n_final"))
    return levels.drop("critical").join(counts, variant, "left").fillna(0, ["n_failed", "n_final"])


def class_counts(by_batch: DataFrame, by_focal: DataFrame, sets: DataFrame, batches: tuple[str, str]) -> DataFrame:
    """(locus_set, n_loci, eight classes): polymorphism by batch and by focal group over sets of loci that overlap.

    by_batch and by_focal are locus statistics grouped by `batch` and by `side` (focal or rest); sets is (locus_idx, locus_set).
    """
    a, b = batches
    poly = lambda col, name: F.coalesce(F.bool_or(F.when(F.col(col) == name, polymorphic())), F.lit(False))
    batch = by_batch.groupBy("locus_idx").agg(poly("batch", a).alias("pa"), poly("batch", b).alias("pb"))
    at = lambda name: F.max(F.when(F.col("side") == name, F.col("p")))
    focal = by_focal.groupBy("locus_idx").agg(poly("side", "focal").alias("pf"), poly("side", "rest").alias("pr"), at("focal").alias("p_f"), at("rest").alias("p_r"))
    rows = sets.join(batch, "locus_idx").join(focal, "locus_idx")
    pa, pb, pf, pr = (F.col(c) for c in ("pa", "pb", "pf", "pr"))
    fixed = ((F.col("p_f") == 0) & (F.col("p_r") == 1)) | ((F.col("p_f") == 1) & (F.col("p_r") == 0))
    return rows.groupBy("locus_set").agg(
        F.count("*").alias("n_loci"), F.count_if(pa).alias("poly_a"), F.count_if(pb).alias("poly_b"), F.count_if(~pa & pb).alias("only_b"), F.count_if(pa & ~pb).alias("only_a"),
        F.count_if(~pa & ~pb).alias("mono_both"), F.count_if(~pr & pf).alias("only_focal"), F.count_if(pr & ~pf).alias("only_rest"), F.count_if(fixed).alias("fixed_difference"),
    )
