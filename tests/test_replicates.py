"""Packed weights, and sums over loci under all replicates, against numpy and against rows joined one by one."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dosewise.operators import differentiation, replicates, resample, streams
from dosewise.plans.queries import QUERIES, checkpointed, stats_of
from dosewise.sources.star import panel
from tests.test_plans import explained


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpointed(spark)


def test_weights_of_any_size_come_back():
    """Counts above 15 take several rows; blocks without a draw none."""
    counts = np.zeros(3 * replicates.BLOCK - 7, np.int64)
    counts[[0, 1, replicates.BLOCK - 1, len(counts) - 1]] = [1, 40, 15, 16]
    rows = pa.Table.from_batches(replicates.packed("all", 3, counts))
    got = np.zeros(3 * replicates.BLOCK, np.int64)
    for block, w in zip(rows["block"].to_pylist(), replicates.unpacked(rows["w"].combine_chunks(), replicates.BLOCK), strict=True):
        got[block * replicates.BLOCK : (block + 1) * replicates.BLOCK] += w
    assert (got[: len(counts)] == counts).all() and set(rows["block"].to_pylist()) == {0, 2}


def matrix(weights, reps: int, n: int) -> np.ndarray:
    out = np.zeros((reps, -(-n // replicates.BLOCK) * replicates.BLOCK), np.int64)
    rows = weights.toArrow()
    for block, rep, w in zip(rows["block"].to_pylist(), rows["rep"].to_pylist(), replicates.unpacked(rows["w"].combine_chunks(), replicates.BLOCK), strict=True):
        out[rep, block * replicates.BLOCK : (block + 1) * replicates.BLOCK] += w
    return out[:, :n]


@pytest.mark.parametrize("n", [1, 2, 777, 90_000])
def test_numpys_weights(spark, n):
    rng = np.random.default_rng(43)
    want = np.array([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(5)])
    assert (matrix(streams.replicate_weights(spark.createDataFrame([("a", n)], "frame string, n long"), 5, 43), 5, n) == want).all()


def test_weights_by_hash(spark):
    n, reps = 30, 7
    w = resample.bootstrap_weights(spark.range(100, 100 + n).select(F.col("id").alias("locus_idx")), reps)
    want = np.zeros((reps, n), np.int64)
    for rep in range(reps):
        for k in range(n):
            want[rep, int(hashlib.md5(f"42:{rep}:{k}".encode()).hexdigest()[:8], 16) % n] += 1
    assert (matrix(w.packed, reps, n) == want).all()
    assert sorted((r["locus_idx"], r["ord"]) for r in w.index.collect()) == [(100 + i, i) for i in range(n)]


def test_pairs_within_blocks_are_those_of_a_join(spark, tiny):
    """A pair's sums under one replicate that draws each locus once are the sums over the joined pairs."""
    p = panel(spark, tiny)
    stats = stats_of(p).where("population in ('NATION_0', 'NATION_3', 'NATION_7')").checkpoint()
    loci = [r[0] for r in p.loci.select("locus_idx").orderBy("locus_idx").collect()]
    index = spark.createDataFrame([("all", x, i) for i, x in enumerate(loci)], "frame string, locus_idx long, ord long")
    weights = spark.createDataFrame([(r["frame"], r["block"], 0, r["w"]) for b in replicates.packed("all", 0, np.ones(len(loci), np.int64)) for r in b.to_pylist()], replicates.WEIGHTS)
    got = replicates.block_sums(stats.where("n > 0").withColumn("frame", F.lit("all")), index, weights, [F.col(c) for c in ("n", "p", "ho")], ["population", "ord"], 1, differentiation.expanded("population"))
    parts = differentiation.with_components(differentiation.locus_pairs(stats)).groupBy("population_i", "population_j")
    want = {(r[0], r[1]): [r[2], r[3]] for r in parts.agg(F.sum("a"), F.sum(F.col("a") + F.col("b") + F.col("c"))).collect()}
    found = {tuple(json.loads(r["key"]).values()): r["sums"] for r in got.collect()}
    assert found.keys() == want.keys() and len(want) == 3
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("name", ["fst_interval", "fst_bootstrap"])
def test_pairs_of_groups_are_not_joined_locus_by_locus(spark, tiny, name):
    assert "population_j#" not in explained(QUERIES[name](spark, tiny)).split("MapInArrow")[-1]


@pytest.mark.parametrize("name", ["fis_bootstrap", "fis_interval", "diversity_table", "diversity_table_published"])
def test_draws_are_packed_before_they_are_sent(spark, tiny, name):
    """No list of replicates by locus, and no copies of weights by part."""
    plan = explained(QUERIES[name](spark, tiny))
    assert "picks#" not in plan and "times#" not in plan and "w#" in plan


@pytest.mark.parametrize("name", ["individual_f_bootstrap", "individual_f_interval"])
def test_no_sums_of_samples_are_sent(spark, tiny, name):
    """Arrays of a sample's replicates stay in the task that makes them."""
    assert "sums#" not in explained(QUERIES[name](spark, tiny))


def test_intervals_leave_out_what_is_not_finite():
    theta = np.array([[1.0, 2.0, 3.0, 4.0], [np.nan, 2.0, np.inf, 4.0], [np.nan] * 4])
    got = replicates.interval(theta, 0.5).to_pylist()
    assert got == [{"lo": 1.75, "hi": 3.25}, {"lo": 2.5, "hi": 3.5}, {"lo": None, "hi": None}]
