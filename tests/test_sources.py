"""Reports, small tables and sinks on files written here."""

from pyspark.sql import functions as F

from dosewise.functions import expressions
from dosewise.operators import geometry
from dosewise.operators.diversity import diversity
from dosewise.operators.frequency import locus_stats
from dosewise.sources import reports, sinks


def report(tmp_path, rows):
    """Seven lines of preamble, the last the header, then a line a locus: two columns about it and four calls."""
    head = ["*,*,b1,b1,b2,b2", *[f"*,*,{k},,," for k in range(5)], "AlleleID,CloneID,s1,s2,s3,s4"]
    path = tmp_path / "report.csv"
    path.write_text("\n".join([*head, *rows]) + "\n")
    return f"file://{path}"


def test_call_report(spark, tmp_path):
    path = report(tmp_path, ['a1,"c,1",0,1,2,-', "a2,c2,2,2,0,0", "broken,row", "a3,c3,1,1,1,1", "a4,c4,,0,0,2"])
    loci, samples, geno = reports.call_report(spark, path, n_meta=2)
    assert [(r["locus_idx"], r["AlleleID"], r["CloneID"]) for r in loci.orderBy("locus_idx").collect()] == [(0, "a1", "c,1"), (1, "a2", "c2"), (3, "a3", "c3"), (4, "a4", "c4")]
    assert [tuple(r) for r in samples.orderBy("sample_idx").collect()] == [(0, "b1", "s1"), (1, "b1", "s2"), (2, "b2", "s3"), (3, "b2", "s4")]
    want = {(0, 1): 2, (0, 2): 1, (0, 3): None, (1, 0): 1, (1, 1): 1, (3, 0): 2, (3, 1): 2, (3, 2): 2, (3, 3): 2, (4, 0): None, (4, 3): 1}
    assert {(r["locus_idx"], r["sample_idx"]): r["dose"] for r in geno.collect()} == want
    rows = {r["batch"]: r for r in diversity(locus_stats(geno, samples, loci, "batch"), "batch").collect()}
    assert rows["b1"]["n_loci"] == 4 and abs(rows["b1"]["ho"] - (0 + 1 + 0 + 0) / 4) < 1e-12
    assert abs(rows["b2"]["ho"] - (1 + 0 + 0 + 0.5) / 4) < 1e-12


def test_small_tables(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿Type,Name\nauto,1\nsex,x\n".encode())
    df = reports.csv_table(spark, f"file://{tmp_path}/bom.csv", "Type string, Name int")
    assert [tuple(r) for r in df.collect()] == [("auto", 1), ("sex", None)]
    (tmp_path / "bare.csv").write_text("a,b\nc,d\n")
    assert reports.csv_table(spark, f"file://{tmp_path}/bare.csv", "old string, new string", header=False).count() == 2
    (tmp_path / "x.json").write_text('{"a": {"ho": NaN, "n": 3}, "b": [1.5, NaN]}')
    row = reports.json_document(spark, f"file://{tmp_path}/x.json", "a struct<ho:double,n:int>, b array<double>").first()
    assert row["a"]["ho"] is None and row["a"]["n"] == 3 and row["b"] == [1.5, None]
    (tmp_path / "m.csv").write_text("AlleleID,s1,s2\na,0,2\nb,,1\n")
    assert {(r["AlleleID"], r["sample"]): r["dose"] for r in reports.dosage_matrix(spark, f"file://{tmp_path}/m.csv").collect()} == {("a", "s1"): 0, ("a", "s2"): 2, ("b", "s1"): None, ("b", "s2"): 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 2.5, None)], "name string, x double, n int")
    sinks.write_table(df, f"file://{tmp_path}/out", "csv", files=1)
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 2
    assert sorted(r[0] for r in sinks.as_json(df).collect()) == ['{"name":"a","x":null,"n":1}', '{"name":"b","x":2.5,"n":null}']
    assert sinks.markdown(df.orderBy("name").select("name", "n")) == "| name | n |\n| --- | --- |\n| a | 1 |\n| b | — |"


def test_expressions_and_rings(spark):
    df = spark.createDataFrame([("1.5", "a_b_c"), ("nan", "a"), ("x", None)], "v string, k string")
    rows = df.select(expressions.as_number("v"), expressions.prefix_tokens("k"), expressions.shown(expressions.as_number("v"), 1, True)).collect()
    assert [tuple(r) for r in rows] == [(1.5, "a_b", "+1.5"), (None, None, "—"), (None, None, "—")]
    square = lambda a, b: geometry.ring([(a, a), (b, a), (b, b), (a, b)])
    inside = spark.range(1).select(*[geometry.in_rings(F.lit(x), F.lit(x), F.array(square(0, 4), square(1, 2))).alias(f"i{i}") for i, x in enumerate((1.5, 3.0, 5.0))]).first()
    assert tuple(inside) == (True, True, False)
    kept = spark.range(1).select(geometry.thinned(geometry.ring([(0, 0), (0.1, 0), (3, 0), (3, 3), (0, 3)]), 1.0).alias("a"), geometry.thinned(geometry.ring([(0, 0), (0.1, 0), (0.2, 0), (0.2, 0.1)]), 9.0).alias("b")).first()
    assert [(p["x"], p["y"]) for p in kept["a"]] == [(0, 0), (3, 0), (3, 3), (0, 3)] and len(kept["b"]) == 4
    assert expressions.chi2_critical(1e-30) < 200 and abs(spark.range(1).select(expressions.chi2_tail(F.lit(expressions.chi2_critical(0.05)))).first()[0] - 0.05) < 1e-9
