"""The operators as queries over the star schema's genotypes; sql.py has the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.functions.expressions import chi2_tail
from dosewise.operators import checks, differentiation, diversity, geometry, individual, ordination, quality, resample, sensitivity, spectrum, streams, tables
from dosewise.operators.frequency import genotype_counts, locus_stats, polymorphic, whole
from dosewise.sources import files, sinks
from dosewise.sources.star import Panel, panel, table

FOCAL, FOCAL_REGION, N_FOCAL = "NATION_0", "AFRICA", 8
#: The published counts of bootstrap replicates and of draws, and the levels of rarefaction.
REPS, F_REPS, DRAWS, LEVELS = 1000, 1000, 200, (5, 8, 10, 15, 20)
#: Cells of a part in which they are counted one by one, about.
PART_CELLS = 1 << 20
SEX, UNPLACED = ["PROMO"], "S"
LEAST_REP, LEAST_ALN, LEAST_CALL = 920.0, 5, 0.999
MEASURES = ["ho", "he_unbiased", "fis_wc", "mean_folded_maf"]
SCENARIOS = [("none", 0.0, 0), ("mac3", 0.0, 3), ("maf01", 0.01, 0), ("maf02", 0.02, 0), ("maf05", 0.05, 0)]
CALL_RATES = [1.0, 0.9999, 0.9995, 0.999, 0.99]
RING = [(-0.1, -0.1), (0.12, -0.15), (0.02, 0.0), (0.2, 0.15), (-0.15, 0.1)]
BOX = (-0.05, -0.05, 0.1, 0.2)

QUERIES: dict = {}


def query(f):
    """Registers f(spark, sf_dir); doubles are rounded to twelve and then six places, integers are long."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        near = lambda c: F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(F.round(c, 12), 6))
        return df.select(*[near(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[f.__name__] = run
    return f


def stats_of(p: Panel, group: str = "population", samples: DataFrame | None = None) -> DataFrame:
    return locus_stats(p.geno, p.samples if samples is None else samples, p.loci, group, "pop_ord" if group == "population" else None)


def joint(p: Panel) -> DataFrame:
    return locus_stats(p.geno, whole(p.samples), p.loci, "panel")


# ---------------------------------------------------------------- frequencies and diversity


@query
def diversity_by_population(spark, sf_dir):
    return diversity.diversity(stats_of(panel(spark, sf_dir)))


@query
def locus_statistics(spark, sf_dir):
    return stats_of(panel(spark, sf_dir)).drop("ord")


@query
def call_rate(spark, sf_dir):
    return genotype_counts(*panel(spark, sf_dir))


@query
def encoding_check(spark, sf_dir):
    """The panel's frequencies and call rates from genotype counts against the same from the statistics of all populations."""
    p = panel(spark, sf_dir)
    size = p.samples.agg(F.count("*")).scalar()
    other = stats_of(p).groupBy("locus_idx").agg((F.sum("alt") / (2 * F.sum("n"))).alias("p"), (F.sum("n") / F.first(size)).alias("call_rate"))
    return checks.worst_difference(genotype_counts(*p).select("locus_idx", "p", "call_rate"), other, ["locus_idx"], ["p", "call_rate"])


@query
def fis_jackknife(spark, sf_dir):
    return diversity.fis_jackknife(stats_of(panel(spark, sf_dir)))


@query
def fis_bootstrap(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    weights = resample.bootstrap_weights(p.loci, REPS)
    return resample.bootstrap_ratio(stats_of(p), weights, F.col("b"), F.col("b") + F.col("c"), ["population"], REPS)


@query
def allelic_richness_g16(spark, sf_dir):
    return diversity.allelic_richness(stats_of(panel(spark, sf_dir)), 16)


@query
def allelic_richness_curve(spark, sf_dir):
    return diversity.allelic_richness(stats_of(panel(spark, sf_dir)), list(range(2, 17, 2)))


@query
def focal_ratios(spark, sf_dir):
    return diversity.focal_ratios(diversity.diversity(stats_of(panel(spark, sf_dir))), FOCAL, "population", ["ho", "he_unbiased", "mean_folded_maf"])


# ---------------------------------------------------------------- quality


def anchors(p: Panel) -> DataFrame:
    return p.loci.where("aln_cnt > 10").select("locus_idx", "refseq")


def placed(p: Panel) -> DataFrame:
    return quality.annotated(p.loci, quality.crosswalk(p.loci, anchors(p), SEX, UNPLACED))


def flags(p: Panel) -> DataFrame:
    return quality.quality_flags(placed(p), genotype_counts(*p), quality.hwe_failures(stats_of(p)), LEAST_REP, LEAST_ALN, LEAST_CALL)


STEPS = ["pass_reproducible", "pass_aligned", "pass_autosome", "pass_call_rate", "pass_hwe"]


def final_loci(p: Panel) -> DataFrame:
    ok = flags(p).where(" and ".join(STEPS))
    ranked = ok.select("locus_idx", "clone_id", "call_rate", "rep_score")
    return quality.one_per_clone(ranked, [F.desc("call_rate"), F.desc("rep_score")]).select("locus_idx")


@query
def scaffold_crosswalk(spark, sf_dir):
    p = panel(spark, sf_dir)
    return quality.crosswalk(p.loci, anchors(p), SEX, UNPLACED)


@query
def crosswalk_confusion(spark, sf_dir):
    p = panel(spark, sf_dir)
    return quality.crosswalk_confusion(placed(p), anchors(p), SEX)


@query
def one_snp_per_clone(spark, sf_dir):
    p = panel(spark, sf_dir)
    ranked = p.loci.select("locus_idx", "clone_id", "rep_score").join(genotype_counts(*p).select("locus_idx", "call_rate"), "locus_idx")
    return quality.one_per_clone(ranked, [F.desc("call_rate"), F.desc("rep_score")])


@query
def hwe_fail_counts(spark, sf_dir):
    return quality.hwe_failures(stats_of(panel(spark, sf_dir)))


@query
def hwe_sensitivity(spark, sf_dir):
    p = panel(spark, sf_dir)
    each = quality.hwe_failures(stats_of(p)).select("locus_idx", (F.col("failures") >= 2).alias("each"))
    once = quality.hwe_failures(joint(p), "panel").select("locus_idx", (F.col("failures") >= 1).alias("once"))
    return each.join(once, "locus_idx", "full").agg(F.count_if("each").alias("fail_by_group"), F.count_if("once").alias("fail_joint"), F.count_if(F.col("each") & F.col("once")).alias("fail_both"))


@query
def sexlinked_flag(spark, sf_dir):
    return quality.sex_linked(stats_of(panel(spark, sf_dir), "sex"))


@query
def sample_selection(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_name").alias("id"), F.col("c_mktsegment").alias("population"))
    recode = spark.createDataFrame([(0, "BUILDING", "X"), (1, "BUILDING", "CONSTRUCTION"), (2, "MACHINERY", "CONSTRUCTION"), (3, "FURNITURE", None)], "row int, old string, new string")
    known = quality.recoded(customers, "population", recode).withColumn("known", F.nullif("population", F.lit("FURNITURE")))
    return quality.classified(known, "id", ["Customer#000000003", "Customer#000000005"], "^Customer#0000000[0-9]{2}$", "known").select("sample_idx", "population", "include", "reason")


@query
def duplicate_ids(spark, sf_dir):
    return quality.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query
def filter_cascade(spark, sf_dir):
    return quality.cascade(flags(panel(spark, sf_dir)), STEPS)


@query
def cascade_deltas(spark, sf_dir):
    return quality.cascade_deltas(quality.cascade(flags(panel(spark, sf_dir)), STEPS))


@query
def locus_audit_table(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = flags(p).join(joint(p).select("locus_idx", "n", "p", "ho", "he_unb"), "locus_idx").join(final_loci(p).withColumn("kept", F.lit(True)), "locus_idx", "left")
    return out.select("locus_idx", "clone_id", "scaffold", "class", "refseq_majority", "call_rate", "n", "p", "ho", "he_unb", *STEPS, F.coalesce("kept", F.lit(False)).alias("final"))


# ---------------------------------------------------------------- differentiation


@query
def fst_pairwise(spark, sf_dir):
    return differentiation.fst_pairwise(stats_of(panel(spark, sf_dir)))


@query
def gst_pairwise(spark, sf_dir):
    return differentiation.gst_pairwise(stats_of(panel(spark, sf_dir)))


NATIONS = [f"NATION_{i}" for i in range(25)]


@query
def fst_matrix(spark, sf_dir):
    return sinks.matrix(differentiation.fst_pairwise(stats_of(panel(spark, sf_dir))), "population_i", "population_j", "fst_wc", NATIONS)


@query
def fst_focal_summary(spark, sf_dir):
    pairs = differentiation.fst_pairwise(stats_of(panel(spark, sf_dir))).withColumn("fst_wc", F.round("fst_wc", 9))
    return differentiation.focal_summary(pairs, FOCAL)


@query
def fst_bootstrap(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return resample.bootstrap_fst(stats_of(p), resample.bootstrap_weights(p.loci, REPS), REPS)


# ---------------------------------------------------------------- individuals


def own_frame(p: Panel) -> tuple[DataFrame, DataFrame]:
    return p.samples.select("sample_idx", F.col("population").alias("frame")), individual.frame_of(stats_of(p), "population")


def pooled_frame(p: Panel) -> tuple[DataFrame, DataFrame]:
    rest = whole(p.samples.where(F.col("population") != FOCAL), "others")
    return p.samples.select("sample_idx", F.lit("others").alias("frame")), individual.frame_of(stats_of(p, "panel", rest), "panel")


@query
def individual_ho(spark, sf_dir):
    return individual.individual_ho(*panel(spark, sf_dir))


@query
def smlh(spark, sf_dir):
    return individual.smlh(individual.individual_ho(*panel(spark, sf_dir)))


@query
def individual_f_own(spark, sf_dir):
    p = panel(spark, sf_dir)
    return individual.individual_f(p.geno, *own_frame(p))


@query
def points_in_shapes(spark, sf_dir):
    """How many points of every label lie within the ring of each: all of a label's points, in the order of their angles around its centre."""
    checkpointed(spark)
    some = points(spark, sf_dir).where("x is not null and y is not null and label is not null")
    centre = some.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    turned = some.join(centre, "label").withColumn("angle", F.round(F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")), 9))
    edges = geometry.ring_edges(turned, "label", ["angle", "vec_id"])
    inside = geometry.points_in_shapes(some, edges, "vec_id", cell=0.05)
    return inside.join(some.select("vec_id", "label"), "vec_id").groupBy("shape", "label").agg(F.count("*").alias("n_inside"))


@query
def individual_f_pooled(spark, sf_dir):
    p = panel(spark, sf_dir)
    return individual.individual_f(p.geno, *pooled_frame(p))


@query
def individual_f_bootstrap(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return individual.f_uni_bootstrap(p.geno, *own_frame(p), resample.bootstrap_weights(p.loci, F_REPS), F_REPS)


@query
def kinship_pairs(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return individual.kinship_pairs(p.geno, *own_frame(p))


@query
def kinship_summary(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return individual.kinship_summary(p.geno, *own_frame(p))


@query
def kinship_individual(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return individual.kinship_by_individual(p.geno, *own_frame(p))


@query
def empirical_null(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return individual.kinship_percentiles(p.geno, *own_frame(p._replace(samples=p.samples.where(F.col("population") != FOCAL))))


# ---------------------------------------------------------------- intervals from numpy's stream, as published


@query
def fis_interval(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return streams.ratio_interval(stats_of(p), p.loci, F.col("b"), F.col("b") + F.col("c"), ["population"], REPS)


@query
def fst_interval(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return streams.fst_interval(stats_of(p), p.loci, REPS)


@query
def individual_f_interval(spark, sf_dir):
    """Against each sample's own population, and against all but the focal one together, whose stream has the next seed."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    p = p._replace(geno=p.geno.checkpoint())  # read for each of the frames and their cells
    own, pooled = (streams.f_uni_interval(p.geno, *frame, F_REPS, seed) for frame, seed in ((own_frame(p), streams.SEED), (pooled_frame(p), streams.SEED + 1)))
    return own.withColumn("against", F.lit("own")).union(pooled.withColumn("against", F.lit("pooled")))


# ---------------------------------------------------------------- draws of equal size


def draw_stats(p: Panel, k: int, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Draws of k samples with their statistics; `chosen` in place of those by hash."""
    checkpointed(p.samples.sparkSession)
    picks = resample.drawn(resample.draws(p.samples, k, DRAWS) if chosen is None else chosen)
    stats = locus_stats(p.geno, picks, p.loci, "draw", stored=True)
    return picks, stats.withColumn("population", F.substring_index("draw", ":", 1))


@query
def matched_n_null(spark, sf_dir):
    return null_of(spark, panel(spark, sf_dir))


@query
def matched_n_null_published(spark, sf_dir):
    """The null of the draws that one numpy generator gives population after population."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return null_of(spark, p, streams.choices(p.samples, [N_FOCAL], DRAWS, order="pop_ord").drop("level"))


def null_of(spark: SparkSession, p: Panel, chosen: DataFrame | None = None) -> DataFrame:
    checkpointed(spark)
    chosen = resample.draws(p.samples, N_FOCAL, DRAWS) if chosen is None else chosen.checkpoint()
    # what is read several times is made once: the draws, the cells of their samples, which do not grow with the panel, and their frequencies
    p = p._replace(geno=p.geno.join(chosen.select("sample_idx").distinct(), "sample_idx", "left_semi").checkpoint())
    picks, stats = draw_stats(p, N_FOCAL, chosen)
    members = picks.select("sample_idx", F.col("draw").alias("frame"))
    frame = individual.frame_of(stats, "draw").checkpoint()
    pairs = individual.kinship_pairs(p.geno, members, frame)
    f = individual.individual_f(p.geno, members, frame)
    names = lambda df, v, kind: df.select(F.substring_index("frame", ":", 1).alias("population"), F.lit(kind).alias("measure"), F.col(v).alias("x"))
    values = names(pairs, "kinship", "kinship").union(names(f, "f_uni", "f_uni")).checkpoint()
    return individual.null_percentiles(values, "x", ["population", "measure"])


@query
def rarefaction(spark, sf_dir):
    return rarefied(panel(spark, sf_dir))


@query
def rarefaction_published(spark, sf_dir):
    """The draws of one numpy generator, population after population and level after level."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    return rarefied(p, streams.choices(p.samples, list(LEVELS), DRAWS, order="pop_ord").checkpoint())


def rarefied(p: Panel, chosen: DataFrame | None = None) -> DataFrame:
    """Means and deviations over draws at each level, and the mean of polymorphic loci in per cent of the whole group's."""
    full = spectrum.spectrum_summary(stats_of(p)).select("population", F.col("n_polymorphic").alias("full"))
    measures = ("ho", "he_unbiased", "fis_wc", "n_polymorphic", "ar")
    parts = []
    for k in LEVELS:
        picks, stats = draw_stats(p, k, None if chosen is None else chosen.where(F.col("level") == k).drop("level"))
        values = resample.draw_summary(stats.drop("population"), picks, p.loci, k).groupBy("population").agg(*[f(m).alias(f"{m}_{n}") for m in measures for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
        parts.append(values.withColumn("level", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.join(full, "population").withColumn("pct_of_full", 100 * F.col("n_polymorphic_mean") / F.nullif("full", F.lit(0))).drop("full")


def matched(p: Panel, k: int = N_FOCAL) -> DataFrame:
    """(draw, population, n_polymorphic, mean_maf) of every draw."""
    picks, stats = draw_stats(p, k)
    return resample.draw_summary(stats.drop("population"), picks, p.loci, k).select("draw", "population", "n_polymorphic", "mean_maf")


@query
def polymorphism_matched_n(spark, sf_dir):
    p = panel(spark, sf_dir)
    full = spectrum.spectrum_summary(stats_of(p)).select("population", F.col("n_polymorphic").alias("full"))
    drawn = matched(p).groupBy("population").agg(F.avg("n_polymorphic").alias("matched"))
    return full.join(drawn, "population", "left").withColumn("pct", 100 * F.col("matched") / F.nullif("full", F.lit(0)))


@query
def folded_sfs(spark, sf_dir):
    return spectrum.folded_spectrum(stats_of(panel(spark, sf_dir)))


@query
def sfs_summary(spark, sf_dir):
    return spectrum.spectrum_summary(stats_of(panel(spark, sf_dir)))


@query
def rarefied_sfs(spark, sf_dir):
    picks, stats = draw_stats(panel(spark, sf_dir), N_FOCAL)
    counts = stats.where(polymorphic()).groupBy("draw", F.least(F.col("alt"), 2 * F.col("n") - F.col("alt")).alias("mac")).agg(F.count("*").alias("n_loci"))
    classes = picks.select("population", "draw").distinct().withColumn("mac", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_FOCAL).cast("long"))))
    classes = classes.join(counts, ["draw", "mac"], "left").fillna(0, ["n_loci"])
    return classes.groupBy("population", "mac").agg(F.avg("n_loci").alias("mean"), F.percentile("n_loci", 0.025).alias("lo"), F.percentile("n_loci", 0.975).alias("hi"))


@query
def empirical_p(spark, sf_dir):
    p = panel(spark, sf_dir)
    seen = spectrum.spectrum_summary(stats_of(p)).where(F.col("population") == FOCAL).agg(F.round(F.max("mean_maf"), 9)).scalar()
    drawn = matched(p).withColumns({"mean_maf": F.round("mean_maf", 9), "observed": seen})
    return resample.empirical_p(drawn, "mean_maf", F.col("observed"), ["population"])


@query
def gap_decomposition(spark, sf_dir):
    p = panel(spark, sf_dir)
    full = spectrum.spectrum_summary(stats_of(p)).select("population", F.col("mean_maf").alias("full"))
    drawn = matched(p).groupBy("population").agg(F.avg("mean_maf").alias("matched"))
    focal = full.where(F.col("population") == FOCAL).agg(F.max("full")).scalar()
    rows = full.where(F.col("population") != FOCAL).join(drawn, "population").withColumn("focal", focal)
    return rows.select("population", *spectrum.gap_decomposition(F.col("focal"), F.col("full"), F.col("matched")))


@query
def ks_two_sample(spark, sf_dir):
    return spectrum.ks_two_sample(spectrum.focal_against(stats_of(panel(spark, sf_dir)), FOCAL, "population"), ["other"])


@query
def mann_whitney(spark, sf_dir):
    return spectrum.mann_whitney(spectrum.focal_against(stats_of(panel(spark, sf_dir)), FOCAL, "population"), ["other"])


# ---------------------------------------------------------------- sensitivities


@query
def maf_sensitivity(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = sensitivity.over_sets(stats_of(p), sensitivity.scenario_loci(joint(p), SCENARIOS))
    return out.select("locus_set", "population", "n_loci", "ho", "he_unbiased", "fis_wc")


@query
def callrate_sensitivity(spark, sf_dir):
    return sensitivity.call_rate_sets(genotype_counts(*panel(spark, sf_dir)), CALL_RATES)


def rule_sets(p: Panel) -> DataFrame:
    """Clones by an earlier report, which lists the loci with few alignments from the last to the first."""
    rows = p.loci.select("locus_idx", "clone_id", F.col("refseq").alias("snp"), F.col("locus_idx").alias("row"))
    earlier = p.loci.where("aln_cnt <= 40").select("clone_id", F.col("refseq").alias("snp"), (-F.col("locus_idx")).alias("row"))
    return sensitivity.retained_by_rule(rows, earlier)


@query
def bias_partition(spark, sf_dir):
    p = panel(spark, sf_dir)
    stats = stats_of(p)
    by_set = sensitivity.over_sets(stats, rule_sets(p)).select("locus_set", "population", "n_loci", "ho", "he_unbiased", "fis_wc", "n_polymorphic")
    return sensitivity.inflation(by_set, diversity.diversity(stats), "population", ["ho", "he_unbiased"])


@query
def locus_class_recovery(spark, sf_dir):
    p = panel(spark, sf_dir)
    side = p.samples.withColumn("side", F.when(F.col("population") == FOCAL, "focal").otherwise("rest"))
    sets = p.loci.select("locus_idx", F.lit("input").alias("locus_set")).union(rule_sets(p)).union(final_loci(p).select("locus_idx", F.lit("final")))
    return quality.class_counts(stats_of(p, "batch"), stats_of(p, "side", side), sets, ("batch_a", "batch_b"))


@query
def old_vs_new(spark, sf_dir):
    p = panel(spark, sf_dir)
    before = diversity.diversity(stats_of(p, samples=p.samples.where("batch = 'batch_a'")))
    return diversity.old_against_new(diversity.diversity(stats_of(p)), before, "population", MEASURES)


# ---------------------------------------------------------------- ordination, geometry, checks


def scored(p: Panel) -> tuple[DataFrame, list[float]]:
    return ordination.pca(p.geno, p.samples, joint(p), k=4)


@query
def pca_scores(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    scores, share = scored(p)
    return scores.join(p.samples.select("sample_idx", "population"), "sample_idx").select("sample_idx", "population", *[F.col("scores")[j].alias(f"pc{j + 1}") for j in range(4)], F.array(*map(F.lit, share)).alias("variance_pct"))


@query
def pca_overlap(spark, sf_dir):
    p = panel(spark, sf_dir)
    checkpointed(spark)
    scores, _ = scored(p)
    return ordination.axis_overlap(scores.join(p.samples.select("sample_idx", "population"), "sample_idx"), F.col("population") == FOCAL, 4)


def checkpointed(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the session's; one of this machine only where it names none, as in local runs."""
    import tempfile

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="dosewise-"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


@query
def conf_ellipse(spark, sf_dir):
    return ordination.ellipse(points(spark, sf_dir), "label")


@query
def centroids(spark, sf_dir):
    return ordination.centroids(points(spark, sf_dir), "label")


@query
def nearest_cross_distance(spark, sf_dir):
    return ordination.nearest_cross(points(spark, sf_dir).withColumn("focal", F.col("label") == 0), 0.5)


@query
def point_in_ring(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", geometry.in_ring(F.col("x"), F.col("y"), geometry.ring(RING)).alias("inside"))


@query
def bbox_filter(spark, sf_dir):
    boxes = points(spark, sf_dir).groupBy("label").agg(*[f(c).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))])
    box: dict[str, Column] = {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), BOX, strict=True)}
    return boxes.where(geometry.boxes_meet({k: F.col(k) for k in box}, box))


@query
def assertion_ledger(spark, sf_dir):
    p = panel(spark, sf_dir)
    v = F.col("value")
    # in parts of a bounded size, and of their own: in the genotypes' own parts two tables of all cells would be in memory at once
    parts = table(spark, sf_dir, "lineitem").count() // PART_CELLS + int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = p.geno.select("sample_idx", "locus_idx").repartition(parts, "sample_idx", "locus_idx").groupBy("sample_idx", "locus_idx").agg(F.count("*").alias("k"))
    return checks.ledger([
        ("doses are 1, 2 or missing", p.geno, F.count_if(~F.col("dose").isin(1, 2)), "0", v == 0), ("cells are unique", cells, F.count_if(F.col("k") > 1), "0", v == 0),
        ("populations", p.samples, F.count_distinct("population"), "25", v == 25), ("loci are unique", p.loci, F.count("*") - F.count_distinct("locus_idx"), "0", v == 0),
        ("no call is missing", p.geno, F.count_if(F.col("dose").isNull()), "0", v == 0),
    ])


# ---------------------------------------------------------------- the focal group against its null, individuals in their ranks


@query
def focal_kinship_null(spark, sf_dir):
    """Kinship of the focal group's pairs against that of draws of as many samples from the other groups together."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    focal = individual.kinship_sides(p.geno, *own_frame(p._replace(samples=p.samples.where(F.col("population") == FOCAL))))
    others = p.samples.where(F.col("population") != FOCAL).select("sample_idx", F.lit("others").alias("population"))
    picks = resample.drawn(resample.draws(others, N_FOCAL, DRAWS))
    members = picks.select("sample_idx", F.col("draw").alias("frame"))
    frame = individual.frame_of(locus_stats(p.geno, picks, p.loci, "draw", stored=True), "draw")
    null = individual.kinship_pairs(p.geno, members, frame).select(F.col("frame").alias("draw"), "kinship")
    return individual.against_null(focal, null, "kinship")


@query
def individual_summary(spark, sf_dir):
    """Focal individuals: their estimates, and where they stand among all others."""
    p = panel(spark, sf_dir)
    values = individual.individual_f(p.geno, *pooled_frame(p)).join(p.samples.select("sample_idx", "population"), "sample_idx")
    return individual.percentile_ranks(values, "f_uni", F.col("population") == FOCAL).select("sample_idx", "f_hom", "f_uni", "pct_rank", "n_reaching")


# ---------------------------------------------------------------- the cascade in its modes


def flags_of(p: Panel, call: float = LEAST_CALL, hwe_mode: str = "each") -> DataFrame:
    """Flags with two more columns: whether the scaffold is anchored, and the Hardy-Weinberg test by group or of all samples at once."""
    each, once = quality.hwe_failures(stats_of(p)), quality.hwe_failures(joint(p), "panel")
    once = once.select("locus_idx", "tests", (2 * F.col("failures")).alias("failures"))  # one failure of the single test is enough
    out = quality.quality_flags(placed(p), genotype_counts(*p), each if hwe_mode == "each" else once, LEAST_REP, LEAST_ALN, call)
    return out.withColumn("pass_anchored", ~F.col("class").isin("unanchored", "unaligned"))


@query
def cascade_modes(spark, sf_dir):
    """The cascade with unanchored loci kept and dropped, and with both forms of the Hardy-Weinberg test."""
    p = panel(spark, sf_dir)
    parts = []
    for mode in ("each", "joint"):
        f = flags_of(p, hwe_mode=mode)
        for name, steps in (("keep", STEPS), ("drop", [*STEPS[:2], "pass_anchored", *STEPS[2:]])):
            parts.append(quality.cascade(f, steps).select(F.lit(mode).alias("hwe_mode"), F.lit(name).alias("unanchored"), "step", "name", "standalone", "cumulative"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query
def callrate_cascade(spark, sf_dir):
    """What is left of the whole cascade, one locus a clone, and the focal group's diversity over it, at each call rate."""
    p = panel(spark, sf_dir)
    f = flags_of(p)
    levels = F.explode(F.array(*map(F.lit, CALL_RATES)))
    steps = [s for s in STEPS if s != "pass_call_rate"]
    ok = f.where(" and ".join(steps)).select("locus_idx", "clone_id", "call_rate", "rep_score", levels.alias("threshold")).where("call_rate >= threshold")
    ok = ok.withColumn("clone_id", F.struct("threshold", "clone_id"))
    kept = quality.one_per_clone(ok, [F.desc("call_rate"), F.desc("rep_score")]).select("threshold", "locus_idx")
    focal = stats_of(p).where(F.col("population") == FOCAL)
    out = kept.join(focal, "locus_idx").groupBy("threshold").agg(F.count("*").alias("n_loci"), F.avg("ho").alias("ho"), F.avg("he_unb").alias("he_unbiased"), F.count_if(polymorphic()).alias("n_polymorphic"))
    every = spark.createDataFrame([(x,) for x in CALL_RATES], "threshold double")
    return every.join(out, "threshold", "left").fillna(0, ["n_loci", "n_polymorphic"])


@query
def cascade_published(spark, sf_dir):
    """Every variant of the cascade, each with the Hardy-Weinberg level of the loci that its own filters leave."""
    p = panel(spark, sf_dir)
    out = quality.cascade_variants(placed(p), genotype_counts(*p), stats_of(p), joint(p), LEAST_REP, LEAST_ALN, CALL_RATES)
    return out.withColumn("alpha", F.col("alpha") * 1e6)  # in millionths


@query
def hwe_form_shift(spark, sf_dir):
    """Loci left under each form of the Hardy-Weinberg test, and the largest change of a group's expected heterozygosity between them."""
    p = panel(spark, sf_dir)
    stats, parts = stats_of(p), []
    for mode in ("each", "joint"):
        left = flags_of(p, hwe_mode=mode).where(" and ".join(STEPS)).select("locus_idx")
        parts.append(stats.join(left, "locus_idx").groupBy("population").agg(F.count("*").alias(f"n_{mode}"), F.avg("he_unb").alias(f"he_{mode}")))
    both = parts[0].join(parts[1], "population", "full")
    return both.agg(F.max("n_each").alias("n_each"), F.max("n_joint").alias("n_joint"), F.max(F.abs(F.col("he_each") - F.col("he_joint"))).alias("largest_shift"))


@query
def chi2_levels(spark, sf_dir):
    """Levels of the goodness-of-fit statistics of all samples at once."""
    return joint(panel(spark, sf_dir)).select("locus_idx", quality.hwe_chi2().alias("chi2"), chi2_tail(F.least(quality.hwe_chi2(), F.lit(50.0))).alias("level"))


# ---------------------------------------------------------------- result tables

FST_STEPS = [(0.005, "none"), (0.015, "slight"), (0.03, "moderate")]


def rounded_fst(spark, sf_dir) -> DataFrame:
    return differentiation.fst_pairwise(stats_of(panel(spark, sf_dir))).select("population_i", "population_j", F.round("fst_wc", 9).alias("fst"))


@query
def fst_ranked(spark, sf_dir):
    """Pairs by F_ST, the largest first, with a label."""
    out = tables.ranked(rounded_fst(spark, sf_dir), [F.desc("fst"), F.col("population_i"), F.col("population_j")])
    return out.withColumn("label", tables.labelled(F.col("fst"), FST_STEPS, "great"))


@query
def fst_above_p95(spark, sf_dir):
    return tables.above_quantile(rounded_fst(spark, sf_dir), "fst", 0.95, [F.desc("fst"), F.col("population_i"), F.col("population_j")])


@query
def pair_keys(spark, sf_dir):
    """Pairs of the F_ST table against those of the samples, written the other way round and without one population."""
    p = panel(spark, sf_dir)
    names = p.samples.select("population").distinct()
    other = names.select(F.col("population").alias("population_j")).join(names.select(F.col("population").alias("population_i")), F.col("population_j") < F.col("population_i"))
    return tables.unmatched_pairs(rounded_fst(spark, sf_dir), other.where(F.col("population_i") != FOCAL), "population_i", "population_j")


@query
def populations_ordered(spark, sf_dir):
    """Populations by the number in their names."""
    sizes = panel(spark, sf_dir).samples.groupBy("population").agg(F.count("*").alias("n"))
    return tables.ranked(sizes, [tables.digits("population"), F.col("population")])


@query
def region_lists(spark, sf_dir):
    """Each region's populations, the first three by size named."""
    sizes = panel(spark, sf_dir).samples.groupBy("region", "population").agg(F.count("*").alias("n"))
    return tables.truncated(sizes.drop("n").join(sizes.select("population", "n"), "population"), ["region"], "population", [F.desc("n"), F.col("population")], 3)


@query
def anchor_slice(spark, sf_dir):
    """The anchors in places 11 to 20 of their order."""
    rows = anchors(panel(spark, sf_dir))
    return tables.sliced(rows, [F.col("refseq"), F.desc("locus_idx")], 11, 20)


@query
def score_histogram(spark, sf_dir):
    return tables.fixed_histogram(panel(spark, sf_dir).loci, "rep_score", 900.0, 50.0, 24)


@query
def score_ranges(spark, sf_dir):
    """Range of the reproducibility score by reference, with a row for all loci."""
    return tables.range_summary(panel(spark, sf_dir).loci, "refseq", "rep_score")


@query
def point_override(spark, sf_dir):
    """Sizes of segments after one sample is moved."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.trim("c_mktsegment").alias("segment"))
    moved = tables.overridden(customers, F.col("c_custkey") == 1, "segment", "MOVED")
    return moved.groupBy("segment").agg(F.count("*").alias("n"))


@query
def widest_distance(spark, sf_dir):
    return ordination.widest_pair(points(spark, sf_dir))


# ---------------------------------------------------------------- results written, checked and kept


@query
def run_ledger(spark, sf_dir):
    """Genotypes and statistics published with their checks as metrics of the jobs that write them: the ledger, but for its times."""
    p = panel(spark, sf_dir)
    out = f"{files.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    run = checks.Run(spark)
    dose = F.col("dose")
    guarded = checks.guarded(p.geno, {"doses are 1, 2 or missing": dose.isNull() | dose.isin(1, 2), "cells have a sample and a locus": F.col("sample_idx").isNotNull() & F.col("locus_idx").isNotNull()})
    run.publish("genotypes", guarded, f"{out}/genotypes", [checks.Check("doses out of range", F.count_if(~dose.isin(1, 2))), checks.Check("cells without a key", F.count_if(F.col("sample_idx").isNull() | F.col("locus_idx").isNull()))])
    kept = Panel(spark.read.parquet(f"{out}/genotypes"), p.samples, p.loci)
    run.publish("statistics", stats_of(kept), f"{out}/statistics", [
        checks.Check("frequencies out of range", F.count_if((F.col("p") < 0) | (F.col("p") > 1))),
        checks.Check("largest excess of alleles over twice the calls", F.greatest(F.max(F.col("alt") - 2 * F.col("n")), F.lit(0))),
        checks.Check("largest difference of 2 p q", F.max(F.abs(F.col("he_hw") - 2 * F.col("p") * (1 - F.col("p")))), 0.0, 1e-12),
    ])
    run.compare("genotypes again", kept.geno, p.geno)
    return run.finish().select("step", "name", "value", "expected", "passed", "rows")


@query
def input_digests(spark, sf_dir):
    """SHA-256 of the files that genotypes are made from."""
    names = ("nation", "region", "customer", "part", "orders", "lineitem")
    found = files.digests(spark, *[f"{sf_dir}/{t}.parquet" for t in names])
    return found.select(F.regexp_extract("file", "([^/]+)[.]parquet", 1).alias("name"), "bytes", "sha256")


@query
def filter_cascade_kept(spark, sf_dir):
    """The cascade from genotypes and statistics that are made once for these inputs and read ever after."""
    kept = files.Catalogue(spark, f"{files.shared_folder(spark)}/kept")
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "customer", "part", "orders", "lineitem")]
    p = panel(spark, sf_dir)
    p = p._replace(geno=kept.kept("genotypes", inputs, lambda: p.geno, version=1))
    stats = kept.kept("statistics", inputs, lambda: stats_of(p), group="population", version=1)
    every = kept.kept("calls", inputs, lambda: genotype_counts(*p), version=1)
    return quality.cascade(quality.quality_flags(placed(p), every, quality.hwe_failures(stats), LEAST_REP, LEAST_ALN, LEAST_CALL), STEPS)


@query
def diversity_packaged(spark, sf_dir):
    """Diversity as it is read back from a package of the written tables, whose files are first held against the manifest."""
    out = f"{files.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    stats = stats_of(panel(spark, sf_dir))
    table = diversity.diversity(stats)
    run = checks.Run(spark)
    run.publish("diversity", table, f"{out}/diversity")
    run.publish("spectrum", spectrum.folded_spectrum(stats), f"{out}/spectrum")
    run.finish()
    files.packaged(spark, {"diversity": f"{out}/diversity", "spectrum": f"{out}/spectrum"}, f"{out}/package")
    checks.enforce(files.verified(spark, f"{out}/package").select(F.concat_ws(" ", "file", "state").alias("name"), F.lit(False).alias("passed")))
    return spark.read.schema(table.schema).parquet(f"{out}/package/diversity")


# ---------------------------------------------------------------- tables with the published columns


def focal_size(p: Panel) -> int:
    return p.samples.where(F.col("population") == FOCAL).count()


@query
def focal_kinship_published(spark, sf_dir):
    """Kinship of the focal group's pairs against all pairs of draws of as many samples within each other population, drawn as numpy draws them."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    focal = p.samples.where(F.col("population") == FOCAL)
    mine = individual.kinship_sides(p.geno, focal.select("sample_idx", F.col("population").alias("frame")), individual.frame_of(stats_of(p, samples=focal), "population"))
    others = p.samples.where(F.col("population") != FOCAL)
    picks = resample.drawn(streams.choices(others, [focal_size(p)], DRAWS, order="pop_ord").drop("level")).checkpoint()
    frame = individual.frame_of(locus_stats(p.geno, picks, p.loci, "draw", stored=True), "draw")
    null = individual.kinship_sides(p.geno, picks.select("sample_idx", F.col("draw").alias("frame")), frame)
    return individual.against_matched(mine, null)


@query
def rarefaction_table(spark, sf_dir):
    """Rarefaction with richness among 16 genes, null where a draw has fewer, mean frequencies, and heterozygosity in per cent of the whole group's."""
    p = panel(spark, sf_dir)
    full = diversity.diversity(stats_of(p)).select("population", F.col("he_unbiased").alias("he_full"), F.col("n").alias("n_full"))
    names = {"ho": "ho", "he": "he_unbiased", "fis": "fis_wc", "n_poly": "n_polymorphic", "maf": "mean_maf"}
    parts = []
    for k in LEVELS:
        picks, stats = draw_stats(p, k)
        drawn = resample.draw_summary(stats.drop("population"), picks, p.loci, k, g=16)
        means = [f(c).alias(f"{name}_{kind}") for name, c in names.items() for f, kind in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
        parts.append(drawn.groupBy("population").agg(*means, F.avg("ar").alias("ar_g16_mean")).withColumn("level", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.join(full, "population").withColumn("he_pct_of_full", 100 * F.try_divide("he_mean", "he_full")).drop("he_full")


@query
def spectrum_matched(spark, sf_dir):
    """Spectra of draws of the focal group's size: frequencies, classes' agreement with the focal spectrum, and how much of the difference is one of size."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    k = focal_size(p)
    picks = resample.draws(p.samples, k, DRAWS).where(F.col("population") != FOCAL)
    own = stats_of(p)
    focal = spectrum.exact_folded(own.where(F.col("population") == FOCAL)).select("x")
    others = picks.select("population", "rep").distinct().withColumn("draw", F.concat_ws(":", "population", "rep")).drop("rep")
    drawn = resample.draw_spectra(p.geno, picks, k, DRAWS).select(F.concat_ws(":", "population", "rep").alias("draw"), (F.col("mac") / (2 * F.col("n"))).alias("x"), "k").checkpoint()  # read for each of its figures
    full = spectrum.exact_folded(own).groupBy("population").agg(F.avg("x").alias("unmatched"))
    return spectrum.matched_table(others, drawn, focal, full)


@query
def locus_character(spark, sf_dir):
    """Frequencies of the loci that the earlier rule keeps and of those that it loses, and the share that varies within the focal group and outside."""
    p = panel(spark, sf_dir)
    side = p.samples.withColumn("side", F.when(F.col("population") == FOCAL, "focal").otherwise("rest"))
    return sensitivity.character(joint(p), stats_of(p, "side", side), rule_sets(p))


@query
def individual_ranges(spark, sf_dir):
    """Heterozygosity and F_UNI of the focal individuals against those of all others."""
    p = panel(spark, sf_dir)
    group = p.samples.select("sample_idx", (F.col("population") == FOCAL).alias("focal"))
    ho = individual.individual_ho(*p).select("sample_idx", F.col("ho").alias("x"))
    uni = individual.individual_f(p.geno, *pooled_frame(p)).select("sample_idx", F.col("f_uni").alias("x"))
    checkpointed(spark)
    parts = [individual.ranges(v.join(group, "sample_idx"), "x", "focal").withColumn("measure", F.lit(name)) for name, v in (("ho", ho), ("f_uni", uni))]
    return parts[0].union(parts[1])


@query
def diversity_table(spark, sf_dir):
    """The whole published row of each population, with intervals over draws by hash."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    stats = stats_of(p).checkpoint()  # read for each of its figures
    ends = resample.bootstrap_ratio(stats, resample.bootstrap_weights(p.loci, REPS), F.col("b"), F.col("b") + F.col("c"), ["population"], REPS)
    return diversity.published_table(stats, p.samples, ends)


@query
def diversity_table_published(spark, sf_dir):
    """The same with the intervals of numpy's generator."""
    p = panel(spark, sf_dir)
    checkpointed(spark)
    stats = stats_of(p).checkpoint()
    ends = streams.ratio_interval(stats, p.loci, F.col("b"), F.col("b") + F.col("c"), ["population"], REPS)
    return diversity.published_table(stats, p.samples, ends)
