"""What plans may not do: send a table that grows with the input to the driver."""

import re

import pytest

from dosewise.operators import individual
from dosewise.plans import queries
from dosewise.sources.star import panel
from tests.conftest import DATA


def under(plan: str, node: str) -> list[str]:
    """The parts of a plan, as explained, that lie below each node of that name."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(re.match(r"[\s:|+\-]*", x)[0])
    for i, line in enumerate(lines):
        if re.match(rf"[\s:|+\-]*{node}\b", line):
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            out.append("\n".join(below))
    return out


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_of_groups_and_loci_is_never_broadcast(spark, tiny):
    plan = explained(queries.stats_of(panel(spark, tiny)))
    assert "Generate explode" in plan
    assert not [x for x in under(plan, "BroadcastExchange") if "Generate explode" in x]


def test_ranges_read_their_values_once(spark):
    values = spark.range(50).selectExpr("id % 7 / 3.0 AS x", "id % 5 = 0 AS focal")
    got = individual.ranges(values, "x", "focal")
    assert "Range (" in explained(values) and "Range (" not in explained(got)
    assert got.first()["focal_max"] == 2.0


def test_the_null_reads_genotypes_and_draws_once(spark, tiny, monkeypatch):
    monkeypatch.setattr(queries, "DRAWS", 2)
    got = explained(queries.QUERIES["matched_n_null_published"](spark, tiny))
    assert "FileScan" not in got and "MapInArrow" not in got


def test_cells_are_counted_in_parts_that_grow_in_number_with_the_input(spark, tiny, monkeypatch):
    monkeypatch.setattr(queries, "PART_CELLS", 100)
    rows = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    parts = rows // 100 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {parts}), REPARTITION_BY_NUM" in explained(queries.QUERIES["assertion_ledger"](spark, tiny))


def test_anchors_are_not_broadcast_to_place_loci(spark, tiny):
    below = under(explained(queries.placed(panel(spark, tiny))), "BroadcastExchange")
    assert all("Aggregate" in x for x in below)  # scaffolds alone


def test_clones_are_not_broadcast_for_the_rule_on_two_reports(spark, tiny):
    assert not under(explained(queries.rule_sets(panel(spark, tiny))), "BroadcastExchange")


#: Queries whose driver once held a table that grows with the input.
LEAN = ["allelic_richness_g16", "diversity_by_population", "diversity_table", "fis_jackknife", "focal_ratios", "folded_sfs", "fst_above_p95", "fst_focal_summary", "fst_matrix", "fst_pairwise", "fst_ranked", "gap_decomposition", "gst_pairwise", "hwe_fail_counts", "hwe_sensitivity"]


@pytest.mark.parametrize("name", LEAN)
def test_only_nations_and_regions_are_broadcast_as_read(spark, monkeypatch, name):
    """At sf0.01 every table is below the threshold, so whatever a plan leaves to it is broadcast there; nations and regions are the smallest."""
    monkeypatch.setattr(queries, "DRAWS", 2)
    monkeypatch.setattr(queries, "REPS", 2)
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df: df)  # the plan of what is written, too
    below = under(explained(queries.QUERIES[name](spark, f"{DATA}/sf0.01")), "BroadcastExchange")
    # what is summed by group is small
    read = {x for b in below if "Aggregate" not in b for x in re.findall(r"FileScan parquet \[(\w)_", b)}
    assert read <= {"n", "r"}
