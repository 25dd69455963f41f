"""Spectra of draws from bits of membership, against the statistics of every draw."""

import re

import pytest
from pyspark.sql import functions as F

from dosewise.operators import resample
from dosewise.operators.frequency import locus_stats, polymorphic
from dosewise.plans.queries import QUERIES, checkpointed
from dosewise.sources.star import panel
from tests.test_plans import explained


@pytest.mark.parametrize("k,reps", [(3, 5), (5, 64), (5, 70)])
@pytest.mark.parametrize("rows", [10_000, 3])
def test_counts_are_those_of_every_draw(spark, tiny, k, reps, rows):
    """Loci whose cells are in several batches, too, and draws beyond one word of bits."""
    checkpointed(spark)
    p = panel(spark, tiny)
    picks = resample.draws(p.samples, k, reps)
    stats = locus_stats(p.geno, resample.drawn(picks), p.loci, "draw", stored=True).where(polymorphic())
    want = stats.groupBy("draw", F.least(F.col("alt"), 2 * F.col("n") - F.col("alt")).alias("mac"), "n").agg(F.count("*").alias("k"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = resample.draw_spectra(p.geno, picks, k, reps).select(F.concat_ws(":", "population", "rep"), "mac", "n", "k").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and got


def test_cells_are_not_repeated_by_draw(spark, tiny, monkeypatch):
    seen = []
    real = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df: (seen.append(explained(df)), real(df))[1])
    seen.append(explained(QUERIES["spectrum_matched"](spark, tiny)))
    assert not [x for x in seen if re.search(r"keys=\[draw#\d+, locus_idx", x)]
    assert any("b3#" in x and "MapInArrow" in x for x in seen)
