"""Products by tiles, numbering, kinship and principal components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import gram, individual, ordination
from dosewise.operators.frequency import locus_stats, whole
from dosewise.plans.queries import QUERIES, checkpointed
from dosewise.sources.star import panel


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpointed(spark)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    got = sorted((r["ord"], r["k"]) for r in gram.numbered(df, "k").collect())
    assert got == [(i, i) for i in range(1000)]
    assert gram.numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n,loci", [(3, 5), (300, 40), (600, 300)])
def test_tiles_equal_numpy(spark, n, loci):
    rng = np.random.default_rng(n)
    x = np.where(rng.random((n, loci)) < 0.3, rng.normal(size=(n, loci)), 0)
    rows = [(f, int(i), int(j), float(x[i, j])) for f in ("a", "b") for i, j in zip(*np.nonzero(x), strict=True) if f == "a" or i % 3 == 0]
    cells = spark.createDataFrame(rows, "frame string, sample_idx long, locus_idx long, x double")
    members = gram.placed(spark.range(n).select(F.lit("a").alias("frame"), F.col("id").alias("sample_idx")).union(spark.range(0, n, 3).select(F.lit("b"), "id")))
    got = {"a": np.zeros((n, n)), "b": np.zeros(((n + 2) // 3, (n + 2) // 3))}
    for r in gram.tiles(cells, members).collect():
        i, j, s = r["ta"] * gram.TILE, r["tb"] * gram.TILE, np.array(r["sums"]).reshape(r["na"], r["nb"])
        got[r["frame"]][i : i + r["na"], j : j + r["nb"]] = s
        got[r["frame"]][j : j + r["nb"], i : i + r["na"]] = s.T
    assert np.allclose(got["a"], x @ x.T) and np.allclose(got["b"], x[::3] @ x[::3].T)


def test_kinship_over_several_tiles(spark):
    rng = np.random.default_rng(3)
    n, loci = 530, 60
    dose = rng.binomial(2, rng.uniform(0.02, 0.98, loci), (n, loci)).astype(float)
    dose[:, 0] = 1 + rng.integers(0, 2, n)  # a locus that everybody carries
    dose[rng.random(dose.shape) < 0.02] = np.nan
    rows = [(i, j, None if np.isnan(d) else int(d)) for (i, j), d in np.ndenumerate(dose) if d != 0]
    geno = spark.createDataFrame(rows, "sample_idx long, locus_idx long, dose int")
    samples, sites = spark.range(n).select(F.col("id").alias("sample_idx"), F.lit("f").alias("frame")), spark.range(loci).select(F.col("id").alias("locus_idx"))
    stats = locus_stats(geno, samples, sites, "frame")
    pairs = individual.kinship_pairs(geno, samples, individual.frame_of(stats, "frame")).collect()
    p = np.nanmean(dose, axis=0) / 2
    some = (p > 0) & (p < 1)
    z = (np.where(np.isnan(dose), 2 * p, dose) - 2 * p)[:, some] / np.sqrt(2 * p * (1 - p))[some]
    k = z @ z.T / some.sum()
    assert len(pairs) == n * (n - 1) // 2 and all(r["sample_i"] < r["sample_j"] for r in pairs)
    assert max(abs(r["kinship"] - k[r["sample_i"], r["sample_j"]]) for r in pairs) < 1e-9


def numpy_scores(spark, folder, k):
    p = panel(spark, folder)
    samples = [r[0] for r in p.samples.select("sample_idx").orderBy("sample_idx").collect()]
    loci = [r[0] for r in p.loci.select("locus_idx").orderBy("locus_idx").collect()]
    g = p.geno.toPandas()
    dose = np.zeros((len(samples), len(loci)))
    dose[np.searchsorted(samples, g["sample_idx"]), np.searchsorted(loci, g["locus_idx"])] = g["dose"].astype(float)
    f = np.nanmean(dose, axis=0) / 2
    x = (np.where(np.isnan(dose), 2 * f, dose) - 2 * f) / np.where(f * (1 - f) > 0, np.sqrt(2 * f * (1 - f)), 1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return samples, u[:, :k] * s[:k], 100 * s[:k] ** 2 / (s**2).sum()


def agree(got, want):
    for j in range(want.shape[1]):
        assert np.abs(got[:, j] * np.sign(got[:, j] @ want[:, j]) - want[:, j]).max() < 1e-6
        assert got[np.abs(got[:, j]).argmax(), j] > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_numpy(spark, sf):
    samples, want, share = numpy_scores(spark, f"/root/testdata/{sf}", 4)
    rows = QUERIES["pca_scores"](spark, f"/root/testdata/{sf}").orderBy("sample_idx").collect()
    assert [r["sample_idx"] for r in rows] == samples
    agree(np.array([[r[f"pc{j}"] for j in range(1, 5)] for r in rows]), want)
    assert rows[0]["variance_pct"] == pytest.approx(list(share), abs=1e-8)


def test_krylov_equals_numpy(spark):
    """The way for many samples; too few steps are an error."""
    rng = np.random.default_rng(5)
    p = rng.uniform(0.05, 0.95, (3, 120))
    dose = rng.binomial(2, p[np.arange(60) % 3]).astype(float)
    dose[rng.random(dose.shape) < 0.03] = np.nan
    rows = [(i, j, None if np.isnan(d) else int(d)) for (i, j), d in np.ndenumerate(dose) if d != 0]
    geno = spark.createDataFrame(rows, "sample_idx long, locus_idx long, dose int")
    samples, loci = spark.range(60).select(F.col("id").alias("sample_idx")), spark.range(120).select(F.col("id").alias("locus_idx"))
    joint = locus_stats(geno, whole(samples), loci, "panel")
    f = np.nanmean(dose, axis=0) / 2
    x = (np.where(np.isnan(dose), 2 * f, dose) - 2 * f) / np.sqrt(2 * f * (1 - f))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    scores, share = ordination.pca(geno, samples, joint, k=2, dense_samples=0)
    agree(np.array([r["scores"] for r in scores.orderBy("sample_idx").collect()]), u[:, :2] * s[:2])
    assert share == pytest.approx(list(100 * s[:2] ** 2 / (s**2).sum()), abs=1e-8)
    with pytest.raises(RuntimeError, match="did not converge"):
        ordination.pca(geno, samples, joint, k=2, dense_samples=0, steps=1)
