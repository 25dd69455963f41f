"""Differentiation between groups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.expressions import ratio


def locus_pairs(stats: DataFrame, group: str = "population") -> DataFrame:
    """Statistics of two groups at a locus, for groups i before j in declared order and loci that are called in both.

    A locus has as many rows as there are groups, so pairs grow with the square of that number and with nothing else.
    """
    side = lambda s: stats.where("n > 0").select("locus_idx", *[F.col(c).alias(f"{c}_{s}") for c in (group, "ord", "n", "p", "ho")])
    return side("i").join(side("j"), "locus_idx").where("ord_i < ord_j")


def with_components(pairs: DataFrame) -> DataFrame:
    """pairs with the variance components a, b and c of Weir and Cockerham (1984) for two groups."""
    n1, n2, p1, p2, h1, h2 = (F.col(c) for c in ("n_i", "n_j", "p_i", "p_j", "ho_i", "ho_j"))
    total, mean = n1 + n2, (n1 + n2) / 2
    pairs = pairs.withColumns({"_m": mean, "_nc": total - (n1 * n1 + n2 * n2) / total, "_p": (n1 * p1 + n2 * p2) / total, "_h": (n1 * h1 + n2 * h2) / total})
    m, p, h = F.col("_m"), F.col("_p"), F.col("_h")
    pairs = pairs.withColumn("_s2", (n1 * (p1 - p) * (p1 - p) + n2 * (p2 - p) * (p2 - p)) / m)
    spread = p * (1 - p) - F.col("_s2") / 2
    a = ratio(m, "_nc") * (F.col("_s2") - ratio(spread - h / 4, m - 1))
    b = ratio(m, m - 1) * (spread - (2 * m - 1) / (4 * m) * h)
    return pairs.withColumns({"a": a, "b": b, "c": h / 2}).drop("_m", "_nc", "_p", "_h", "_s2")


def components(n1: np.ndarray, n2: np.ndarray, p1: np.ndarray, p2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of arrays; NaN for null."""
    total, m = n1 + n2, (n1 + n2) / 2
    nc, p, h = total - (n1 * n1 + n2 * n2) / total, (n1 * p1 + n2 * p2) / total, (n1 * h1 + n2 * h2) / total
    s2 = (n1 * (p1 - p) * (p1 - p) + n2 * (p2 - p) * (p2 - p)) / m
    spread = p * (1 - p) - s2 / 2
    less, nc = np.where(m == 1, np.nan, m - 1), np.where(nc == 0, np.nan, nc)
    return m / nc * (s2 - (spread - h / 4) / less), m / less * (spread - (2 * m - 1) / (4 * m) * h), h / 2


def expanded(group: str):
    """What replicates.block_sums() makes of groups (group, ord) with n, p and ho: a and a + b + c of each two, in declared order."""

    def work(names: list[str], values: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
        groups = [json.loads(x) for x in names]
        order = sorted(range(len(groups)), key=lambda i: groups[i]["ord"])
        n, p, h = values
        for k, i in enumerate(order):
            later = [j for j in order[k + 1 :] if groups[j]["ord"] > groups[i]["ord"]]
            if later:
                a, b, c = components(n[i], n[later], p[i], p[later], h[i], h[later])
                yield [json.dumps({f"{group}_i": groups[i][group], f"{group}_j": groups[j][group]}) for j in later], np.stack([a, a + b + c])

    return work


def fst_pairwise(stats: DataFrame, group: str = "population") -> DataFrame:
    """(group_i, group_j, n_i, n_j, n_loci, fst_wc): a ratio of sums over loci."""
    parts = with_components(locus_pairs(stats, group))
    by = [f"{group}_i", f"{group}_j"]
    return parts.groupBy(*by).agg(F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"), F.count("*").alias("n_loci"), ratio(F.sum("a"), F.sum(F.col("a") + F.col("b") + F.col("c"))).alias("fst_wc"))


def gst_pairwise(stats: DataFrame, group: str = "population") -> DataFrame:
    """(group_i, group_j, hs, ht, gst_nei, gstpp_hedrick): means over loci first, with harmonic sample sizes, then the ratios."""
    pairs = locus_pairs(stats, group)
    n = 2 / (1 / F.col("n_i") + 1 / F.col("n_j"))
    inside = F.col("p_i") * (1 - F.col("p_i")) + F.col("p_j") * (1 - F.col("p_j"))
    ho, p = (F.col("ho_i") + F.col("ho_j")) / 2, (F.col("p_i") + F.col("p_j")) / 2
    hs = ratio(n, n - 1) * (inside - ho / (2 * n))
    ht = 2 * p * (1 - p) + hs / (2 * n) - ho / (4 * n)
    means = pairs.groupBy(f"{group}_i", f"{group}_j").agg(F.avg(hs).alias("hs"), F.avg(ht).alias("ht"))
    s, t = F.col("hs"), F.col("ht")
    return means.withColumns({"gst_nei": F.when(t > 0, (t - s) / t), "gstpp_hedrick": F.when((2 * t - s > 0) & (s < 1), 2 * (t - s) / ((2 * t - s) * (1 - s)))})


def focal_summary(pairs: DataFrame, focal: str, value: str = "fst_wc", group: str = "population") -> DataFrame:
    """(side, n_pairs, mean, least, least_pair, most, most_pair): pairs with the focal group, and pairs of others."""
    side = F.when((F.col(f"{group}_i") == focal) | (F.col(f"{group}_j") == focal), "focal").otherwise("others")
    name = F.concat_ws("-", f"{group}_i", f"{group}_j")
    return pairs.groupBy(side.alias("side")).agg(F.count("*").alias("n_pairs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.min_by(name, F.struct(value, name)).alias("least_pair"), F.max(value).alias("most"), F.max_by(name, F.struct(value, name)).alias("most_pair"))
