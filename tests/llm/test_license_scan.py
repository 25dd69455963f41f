from pyspark.sql import functions as F

from dosewise.llm import license_scan, queries


def test_query_finds_license_lines(spark, tiny, texts):
    rows = {r["doc_id"]: r for r in queries.op9_license_scan(spark, tiny).collect()}
    assert sorted(rows) == sorted(texts)
    # a plain second opinion: the families' own names within a line about licences
    for i, t in texts.items():
        lines = [x.lower() for x in (t or "").split("\n")]
        named = {f for x in lines for f, key in (("apache", "apache license"), ("mit", "mit license"), ("gpl", "gnu general public license")) if key in x and "licen" in x}
        assert named <= set(rows[i]["licences"].split(",")), (i, named, rows[i])
        if not any("licen" in x or "permission" in x or "cc by" in x or "redistribution" in x for x in lines):
            assert rows[i]["licences"] == ""


def test_families_and_unknown(spark):
    held = [
        ("apache", "# Licensed under the Apache License, Version 2.0 by the authors"), ("mit", "released under the MIT license."), ("gpl", "This work is licensed under the GNU General Public License, version 3 or any later version"),
        ("cc-by", "Content licensed under CC BY 4.0"), ("cc-by-sa", "text: licensed under CC BY-SA 4.0"), ("", "The general public needs a license to fish"), ("", "All rights reserved"), ("", "Licensed premises under new rules"), ("", ""), ("", None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(held)], "doc_id long, text string, family string")
    found = {r["doc_id"]: r["licences"] for r in license_scan.scan(df).collect()}
    assert [found[i] for i in range(len(held))] == [f for f, _ in held]


def test_no_python_on_the_main_path(spark, documents):
    plan = license_scan.scan(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_messy(messy, none):
    assert license_scan.scan(messy).count() == messy.count() and license_scan.scan(none).count() == 0
    found = license_scan.license_paragraphs(messy.withColumn("text", F.lit("x\n\nReleased under the MIT License")), ["doc_id"]).collect()
    assert all(r["paragraph"] == 2 and r["family"] == "mit" for r in found)
