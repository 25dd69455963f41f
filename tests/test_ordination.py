"""Principal components against numpy, exact quantiles, and distances against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import individual, ordination
from dosewise.operators.frequency import locus_stats, whole
from dosewise.plans.queries import checkpointed


@pytest.fixture(scope="module")
def groups(spark):
    """Doses of 60 samples in three groups at 200 loci, some missing: the groups' frequencies differ, so two axes stand out."""
    checkpointed(spark)
    rng = np.random.default_rng(5)
    p = rng.uniform(0.05, 0.95, (3, 200))
    dose = rng.binomial(2, p[np.arange(60) % 3]).astype(float)
    dose[rng.random(dose.shape) < 0.03] = np.nan
    dose[:, 7] = 0
    rows = [(i, j, None if np.isnan(d) else int(d)) for (i, j), d in np.ndenumerate(dose) if d != 0]
    return dose, spark.createDataFrame(rows, "sample_idx long, locus_idx long, dose int")


def test_pca_equals_numpy(spark, groups):
    dose, geno = groups
    samples = spark.range(60).select(F.col("id").alias("sample_idx"))
    loci = spark.range(200).select(F.col("id").alias("locus_idx"))
    scores, share = ordination.pca(geno, samples, locus_stats(geno, whole(samples), loci, "panel"), k=2)
    p = np.nanmean(dose, axis=0) / 2
    x = (np.where(np.isnan(dose), 2 * p, dose) - 2 * p) / np.where(p * (1 - p) > 0, np.sqrt(2 * p * (1 - p)), 1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2]
    got = np.array([r["scores"] for r in scores.orderBy("sample_idx").collect()])
    for j in range(2):
        assert np.abs(got[:, j] * np.sign(got[:, j] @ want[:, j]) - want[:, j]).max() < 1e-6
        assert got[np.abs(got[:, j]).argmax(), j] > 0
    assert share == pytest.approx(list(100 * s[:2] ** 2 / (s**2).sum()), abs=1e-8)


@pytest.mark.parametrize("by", [None, ["g"]])
def test_quantiles_equal_percentile(spark, by):
    checkpointed(spark)
    rng = np.random.default_rng(3)
    rows = [(("a", "b", "c")[i % 3] if i > 5 else "d", float(x)) for i, x in enumerate(np.round(rng.normal(size=5000), 2))] + [("a", None), ("e", None), ("f", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = (0.0, 0.05, 0.5, 0.95, 0.999, 1.0)
    got = {(r["g"] if by else None, r["q"]): r["x"] for r in individual.at_quantiles(df, "v", points, by).collect()}
    each = df.where("v is not null").groupBy(*(by or [])).agg(F.percentile("v", F.array(*map(F.lit, points))).alias("x")).collect()
    want = {(r["g"] if by else None, q): x for r in each for q, x in zip(points, r["x"], strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_null_percentiles_of_nothing(spark):
    checkpointed(spark)
    df = spark.createDataFrame([("a", None)], "g string, v double")
    row = individual.null_percentiles(df, "v").first()
    assert row["n"] == 0 and row["p50"] is None and row["most"] is None
    row = individual.null_percentiles(df, "v", ["g"]).first()
    assert row["g"] == "a" and row["n"] == 0 and row["p99_9"] is None


@pytest.mark.parametrize("cell", [0.01, 0.5, 100.0])
def test_distances_equal_brute_force(spark, cell):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(60, 2)) + 9])
    df = spark.createDataFrame([(i < 40, float(x), float(y)) for i, (x, y) in enumerate(xy)], "focal boolean, x double, y double")
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    assert ordination.nearest_cross(df, cell).first()["least"] == pytest.approx(d[:40, 40:].min(), abs=1e-12)
    assert ordination.widest_pair(df).first()["most"] == pytest.approx(d.max(), abs=1e-12)


def _circle(n: int) -> np.ndarray:
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return np.column_stack([np.cos(a), np.sin(a)]) * 3 + 100


WIDE = {
    "none": np.zeros((0, 2)), "one": np.array([[2.0, 3.0]]), "two": np.array([[0.0, 0.0], [3.0, 4.0]]), "one place": np.ones((50, 2)), "a line": np.column_stack([np.arange(60.0), 2 * np.arange(60.0)]),
    "a square": np.array([(x, y) for x in range(8) for y in range(8)], float), "odd circle": _circle(4001), "thin": np.random.default_rng(1).normal(size=(3000, 2)) * [100, 1e-6],
    "cloud": np.random.default_rng(2).normal(size=(3000, 2)), "far away": np.random.default_rng(3).normal(size=(500, 2)) + 1e7,
}


@pytest.mark.parametrize("name", WIDE)
@pytest.mark.parametrize("partitions", [1, 7])
def test_widest_pair_equals_brute_force(spark, name, partitions):
    checkpointed(spark)
    xy = WIDE[name]
    df = spark.createDataFrame([*map(tuple, xy.tolist()), (None, 1.0), (float("nan"), 1.0)], "x double, y double").repartition(partitions)
    got = ordination.widest_pair(df, sector_points=100).first()["most"]
    if not len(xy):
        assert got is None
    else:
        want = max(np.hypot(*(xy - p).T).max() for p in xy)
        assert got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_no_sector_of_a_circle_has_all_corners(spark):
    """As many corners as points: sectors get shares of them, and the work is near linear."""
    checkpointed(spark)
    df = spark.range(0, 200_000, numPartitions=8).select((F.cos(F.col("id") * 2 * np.pi / 200_000)).alias("x"), F.sin(F.col("id") * 2 * np.pi / 200_000).alias("y"))
    corners = df.mapInArrow(ordination._corners, "x double, y double, lo double, hi double").checkpoint()
    begins = [i * np.pi / 40 for i in range(40)]
    sizes = [r["count"] for r in corners.mapInArrow(ordination._dealt(begins), "sector int, x double, y double").groupBy("sector").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 200_000 / 40 + 50
    assert ordination.widest_pair(df).first()["most"] == pytest.approx(2.0, abs=1e-12)
