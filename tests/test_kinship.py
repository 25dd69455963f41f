"""Figures of all pairs against numpy, with sides, blocks and strips of any size, and without a list of the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import gram, individual
from dosewise.operators.frequency import locus_stats
from dosewise.plans.queries import QUERIES, checkpointed
from tests.test_plans import explained


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpointed(spark)


#: As they are; several sides; several blocks of loci as well.
SIZES = [{}, {"SIDE": 100, "LEAST_SIDE": 10}, {"SIDE": 128, "LEAST_SIDE": 64, "CELLS": 300}]


@pytest.fixture(scope="module")
def panel_and_values(spark):
    """Two frames, one with a locus that all carry and one sample without cells, and each frame's kinship as numpy has it."""
    rng = np.random.default_rng(3)
    n, loci = 330, 50
    dose = rng.binomial(2, rng.uniform(0.02, 0.6, loci), (n, loci)).astype(float)
    dose[:, 0], dose[7] = 1 + rng.integers(0, 2, n), 0
    dose[rng.random(dose.shape) < 0.02] = np.nan
    rows = [(i, j, None if np.isnan(d) else int(d)) for (i, j), d in np.ndenumerate(dose) if d != 0]
    geno = spark.createDataFrame(rows, "sample_idx long, locus_idx long, dose int").checkpoint()
    samples = spark.range(n).select(F.col("id").alias("sample_idx"), F.when(F.col("id") < 270, "f").otherwise("g").alias("frame"))
    frame = individual.frame_of(locus_stats(geno, samples, spark.range(loci).select(F.col("id").alias("locus_idx")), "frame"), "frame").checkpoint()
    values = {}
    for name, some in (("f", dose[:270]), ("g", dose[270:])):
        p = np.nanmean(some, axis=0) / 2
        use = (p > 0) & (p < 1)
        z = (np.where(np.isnan(some), 2 * p, some) - 2 * p)[:, use] / np.sqrt(2 * p * (1 - p))[use]
        values[name] = z @ z.T / use.sum()
    return (geno, samples, frame), values


@pytest.mark.parametrize("sizes", SIZES)
def test_figures_equal_numpy(spark, panel_and_values, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(gram, k, v)
    args, values = panel_and_values
    flat = {f: k[np.triu_indices(len(k), 1)] for f, k in values.items()}
    for r in individual.kinship_summary(*args).collect():
        x = flat[r["frame"]]
        assert (r["n_pairs"], r["n_above_0125"], r["n_above_025"]) == (len(x), (x > 0.125).sum(), (x > 0.25).sum())
        assert [r["mean"], r["sd"], r["least"], r["most"]] == pytest.approx([x.mean(), x.std(ddof=1), x.min(), x.max()], abs=1e-12)
    got = {r["sample_idx"]: r for r in individual.kinship_by_individual(*args).collect()}
    assert len(got) == 330
    for first, k in ((0, values["f"]), (270, values["g"])):
        for i in range(len(k)):
            x = np.delete(k[i], i)
            assert (got[first + i]["mean_kinship"], got[first + i]["max_kinship"]) == pytest.approx((x.mean(), x.max()), abs=1e-12)
    pairs = individual.kinship_pairs(*args).collect()
    assert len(pairs) == sum(map(len, flat.values()))
    assert max(abs(r["kinship"] - values[r["frame"]][r["sample_i"] - (f := 270 * (r["frame"] == "g")), r["sample_j"] - f]) for r in pairs) < 1e-12


@pytest.mark.parametrize("kept", [1 << 22, 500, 1])
def test_percentiles_of_all_pairs_equal_numpy(spark, panel_and_values, monkeypatch, kept):
    """Sorted at once; after one count in bins; and when only ever finer bins are left."""
    monkeypatch.setattr(individual, "KEPT", kept)
    args, values = panel_and_values
    x = np.concatenate([k[np.triu_indices(len(k), 1)] for k in values.values()])
    r = individual.kinship_percentiles(*args).first()
    assert r["n"] == len(x) and [r[c] for c in ("p5", "p50", "p95", "p99", "p99_9")] == pytest.approx(np.percentile(x, [5, 50, 95, 99, 99.9]), abs=1e-9)
    assert r["most"] == pytest.approx(x.max(), abs=1e-12)


def test_percentiles_without_pairs_or_of_equal_ones(spark):
    geno = spark.createDataFrame([(0, 0, 1), (2, 1, 1)], "sample_idx long, locus_idx long, dose int")
    for ids, want in (([0], (0, None, None)), ([1, 3, 4], (0, None, None)), ([0, 2], (1, -2 / 3, -2 / 3))):
        samples = spark.createDataFrame([(i,) for i in ids], "sample_idx long").withColumn("frame", F.lit("f"))
        loci = spark.range(2).select(F.col("id").alias("locus_idx"))
        frame = individual.frame_of(locus_stats(geno.join(samples, "sample_idx", "left_semi"), samples, loci, "frame"), "frame")
        r = individual.kinship_percentiles(geno, samples, frame).first()
        assert (r["n"], r["p50"], r["most"]) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("share,strip", [(1 / 64, 1 << 22), (0.0, 1 << 22), (1.0, 1 << 22), (1.0, 50)])
def test_products_however_dense(monkeypatch, share, strip):
    monkeypatch.setattr(gram, "DENSE_SHARE", share)
    monkeypatch.setattr(gram, "STRIP", strip)
    rng = np.random.default_rng(1)
    x, y = (np.where(rng.random((n, 40)) < np.linspace(0, 1, 40), rng.random((n, 40)), 0) for n in (30, 21))

    def cells(m):
        loci, r = np.nonzero(m.T)
        return gram._Cells(np.arange(len(m)), np.zeros(len(m)), r, loci, m[r, loci])

    assert np.allclose(gram._products_of(cells(x), cells(y)), x @ y.T)


@pytest.mark.parametrize("name", ["kinship_summary", "kinship_individual", "empirical_null", "kinship_pairs", "focal_kinship_null", "focal_kinship_published"])
def test_no_product_of_pairs_is_shuffled(spark, tiny, monkeypatch, name):
    """What tasks make of pairs is reduced before an exchange: neither arrays of products nor pairs are sent."""
    seen = []
    real = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df: (seen.append(explained(df)), real(df))[1])
    seen.append(explained(QUERIES[name](spark, tiny)))
    assert not [x for x in seen if "sums#" in x or "FlatMapGroupsInArrow" in x]


def test_focal_pairs_against_a_null_without_draws(spark, panel_and_values):
    args, values = panel_and_values
    null = spark.createDataFrame([], "draw string, kinship double")
    r = individual.against_null(individual.kinship_sides(*args), null, "kinship").first()
    x = np.concatenate([k[np.triu_indices(len(k), 1)] for k in values.values()])
    assert (r["n"], r["n_above_p95"], r["n_above_p99"], r["null_mean"], r["p"]) == (len(x), 0, 0, None, None) and r["mean"] == pytest.approx(x.mean())


def test_matched_null_without_pairs(spark, panel_and_values):
    args, values = panel_and_values
    none = individual.kinship_sides(args[0], args[1].where("false"), args[2])
    r = individual.against_matched(individual.kinship_sides(*args), none).first()
    x = np.concatenate([k[np.triu_indices(len(k), 1)] for k in values.values()])
    assert (r["n_pairs"], r["n_above_p95"], r["n_above_null"], r["null_n"], r["null_mean"], r["p_largest"]) == (len(x), 0, 0, 0, None, None)
    r = individual.against_matched(none, individual.kinship_sides(*args)).first()
    assert (r["n_pairs"], r["largest"], r["null_n"], r["p_largest"]) == (0, None, len(x), None) and r["null_sd"] == pytest.approx(x.std(ddof=1))
