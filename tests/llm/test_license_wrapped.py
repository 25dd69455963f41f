import textwrap

import pytest
from pyspark.sql import functions as F

from dosewise.llm import license_scan

LONG = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts if len(t.split()) > 12]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "REM ", "dnl ", "\trem\t"])
def test_wrapped_notices(spark, mark):
    rows, want = [], {}
    for width in (20, 24, 28, 34, 60, 76):
        for family, notice in LONG:
            body = [mark + x for x in textwrap.wrap(notice + ".", width)]
            rows.append((len(rows), "\n".join(["The weather was fine.", mark.rstrip(), *body, mark.rstrip(), "It rained later."])))
            want[rows[-1][0]] = (family, 1)
    found = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def test_within_other_lines_and_apart(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    first, rest = grant.split("\n", 1)
    rows = [
        (0, f"Copyright 2019 the authors\n{grant}\nThe weather was fine."), (1, f"{first}\n\n{rest}"), (2, f"Released under the MIT License\n{grant}"), (3, "Released under\nthe MIT\nLicense"),
        (4, "one\nReleased under the MIT License\ntwo"), (5, None), (6, f"{grant}\n\n{grant}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in license_scan.scan(df).collect()}
    assert found == {0: ("mit", 1), 1: ("", 0), 2: ("mit", 2), 3: ("mit", 1), 4: ("mit", 1), 5: ("", 0), 6: ("mit", 2)}
    at = license_scan.license_paragraphs(df.where(F.col("doc_id") == 6), ["doc_id"]).collect()
    assert sorted(r["paragraph"] for r in at) == [0, 4]


def test_short_notices_behind_marks_and_line_breaks_of_other_kinds(spark):
    rows = [(0, "REM Released under\nREM the MIT\nREM License"), (1, "REM Released under\r\nREM the MIT\r\nREM License"), (2, "REM\nReleased under the\nREM MIT License"), (3, "rem Released\nremnants under\nrem the MIT License")]
    found = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: "mit", 1: "mit", 2: "mit", 3: ""}
