import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.llm import queries, vp_search


def brute(ids, rows, asked, k):
    out = []
    for q in np.flatnonzero(asked):
        s = (rows * rows[q]).sum(axis=1)
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out += [(ids[q], r + 1, v, -x) for r, (x, v) in enumerate(best)]
    return out


def packed(df):
    rows = df.orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_has_the_recall_of_brute_force(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    ids, rows = packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    want = brute(ids, rows, np.array(ids) % 20 == 0, 20)
    found = [tuple(r) for r in queries.op4_vp_search(spark, sf_dir).collect()]
    assert len(found) == len(want)
    hits = {(q, v) for q, _, v, _ in want} & {(q, v) for q, _, v, _ in found}
    assert len(hits) >= 0.9 * len(want)
    at = {i: k for k, i in enumerate(ids)}
    for q, _, v, s in found:
        assert abs(s - float(rows[at[q]] @ rows[at[v]])) < 1e-12


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1500, 8)) * rng.gamma(2, size=(1500, 1))
    rows[700:760] = rows[5]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, part string")
    want = brute(list(range(1500)), rows, np.arange(1500) % 10 == 0, 20)
    found = [tuple(r) for r in vp_search.nearest(df, F.col("vec_id") % 10 == 0, factor=1.0, shard_rows=400).collect()]
    assert sorted((q, r, v) for q, r, v, _ in found) == sorted((q, r, v) for q, r, v, _ in want)


def test_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (40, [1.0, 2.0, 3.0]), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "dim": F.lit(2), "score": F.lit(3)})
    found = sorted(tuple(r) for r in vp_search.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 1.0)]
    assert vp_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_of_different_vectors_go_to_smaller_ids(spark):
    """400 binary vectors with one product: at factor 1 the smallest ids are found, as brute force has them."""
    rng = np.random.default_rng(3)
    rows = np.zeros((401, 24))
    rows[0, 0] = 1
    for i in range(1, 401):
        rows[i, 0] = 1
        rows[i, 1 + rng.permutation(23)[:8]] = 1
    order = rng.permutation(400) + 1
    df = spark.createDataFrame([(0, rows[0].tolist())] + [(int(i), rows[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in vp_search.nearest(df, F.col("vec_id") == 0, k=25, factor=1.0, shard_rows=150).orderBy("rank").collect()]
    assert [v for _, _, v, _ in found] == list(range(1, 26))
    binary = rng.integers(0, 2, (300, 12)).astype(float)
    binary[:, 0] = 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(binary)], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in vp_search.nearest(df, F.col("vec_id") % 3 == 0, k=20, factor=1.0, shard_rows=70).collect())
    assert found == sorted(brute(list(range(300)), binary, np.arange(300) % 3 == 0, 20))
