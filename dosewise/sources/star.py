"""Genotypes from the star schema: individuals are customers, loci are parts, a dose is a capped purchase count.

The genotype table is sparse: a cell that is absent is dose 0, a null dose is a missing call.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENO = "sample_idx long, locus_idx long, dose int"


class Panel(NamedTuple):
    geno: DataFrame
    samples: DataFrame
    loci: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> Panel:
    """All customers, parts and purchases as samples, loci and genotypes."""
    t = lambda name: table(spark, sf_dir, name)
    segment = F.col("c_mktsegment")
    samples = (
        t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("sample_idx"), F.col("n_name").alias("population"), F.col("r_name").alias("region"), F.col("n_nationkey").alias("pop_ord"),
            F.when(segment.isin("BUILDING", "AUTOMOBILE"), "M").when(segment.isin("HOUSEHOLD", "MACHINERY"), "F").otherwise("unknown").alias("sex"),
            F.when(F.col("c_acctbal") < 0, "batch_b").otherwise("batch_a").alias("batch"),
        )
    )
    loci = t("part").select(
        F.col("p_partkey").alias("locus_idx"), F.floor(F.col("p_partkey") / 2).alias("clone_id"), F.col("p_brand").alias("scaffold"), F.col("p_type").alias("refseq"),
        F.col("p_size").alias("aln_cnt"), F.col("p_retailprice").alias("rep_score"), F.col("p_name").alias("snp"),
    )
    missing = (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08) & (F.col("l_quantity") >= 45)
    bought = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("locus_idx"), missing.alias("missing"))
    # orders grow with the purchases: two columns of a compressed file count as small long after they are not, and would be broadcast
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("sample_idx")).hint("merge")
    bought = bought.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    geno = bought.groupBy("sample_idx", "locus_idx").agg(F.when(~F.bool_or("missing"), F.least(F.count("*"), F.lit(2)).cast("int")).alias("dose"))
    return Panel(geno, samples, loci)
