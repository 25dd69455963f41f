"""Checks within the writing job, digests, packages and kept tables."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from dosewise.operators import checks
from dosewise.operators.checks import Check
from dosewise.plans.queries import QUERIES
from dosewise.sources import files


@pytest.fixture
def here(tmp_path):
    return f"file://{tmp_path}"


def test_publish_counts_in_the_writing_job(spark, here):
    df = spark.range(1000).select("id", (F.col("id") * 2.0).alias("x")).repartition(5, "id")
    run = checks.Run(spark)
    assert run.publish("doubled", df, f"{here}/t", [Check("negative", F.count_if(F.col("x") < 0)), Check("mean", F.avg("x"), 999.0, 1e-9)])
    assert run.publish("no checks", df.limit(3), f"{here}/u")
    rows = run.finish().collect()
    assert [(r["step"], r["name"], r["passed"], r["rows"]) for r in rows] == [("doubled", "negative", True, 1000), ("doubled", "mean", True, 1000), ("no checks", None, True, 3)]
    assert all(r["seconds"] > 0 and r["at"] >= r["seconds"] for r in rows) and rows[1]["tolerance"] == 1e-9
    assert spark.read.parquet(f"{here}/t").count() == 1000
    assert sorted(os.listdir(here.removeprefix("file://"))) == ["t", "u"]


@pytest.mark.parametrize("value", ["count_if(x > 5)", "max(y)", "max(double('NaN'))"])
def test_a_failed_check_leaves_no_output(spark, here, value):
    """A wrong number, one that is null because the column is, and NaN."""
    df = spark.createDataFrame([(i, float(i), None) for i in range(10)], "id int, x double, y double")
    run = checks.Run(spark)
    with pytest.raises(AssertionError, match="failed: wrong"):
        run.publish("bad", df, f"{here}/t", [Check("fine", F.count_if(F.col("x") < 0)), Check("wrong", F.expr(value))])
    assert os.listdir(here.removeprefix("file://")) == []
    late = checks.Run(spark, stop=False)
    assert not late.publish("bad", df, f"{here}/t", [Check("wrong", F.expr(value))])
    assert late.publish("good", df, f"{here}/u")
    with pytest.raises(AssertionError, match="failed: wrong"):
        late.finish()
    assert os.listdir(here.removeprefix("file://")) == ["u"]


def test_empty_tables_and_names_taken(spark, here):
    none = spark.createDataFrame([], "id int, x double")
    run = checks.Run(spark)
    assert run.publish("none", none, f"{here}/t", [Check("negative", F.count_if(F.col("x") < 0))])
    assert run.ledger().first()["rows"] == 0 and spark.read.parquet(f"{here}/t").count() == 0
    with pytest.raises(FileExistsError):
        run.publish("again", none, f"{here}/t")


def test_guarded_stops_the_job(spark, here):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert checks.guarded(df.where("x is not null"), {"x is small": F.col("x") < 9}).count() == 2
    for some in (df, df.fillna(10)):
        with pytest.raises(Exception, match="failed: x is small"):
            checks.Run(spark).publish("guarded", checks.guarded(some, {"x is small": F.col("x") < 9}), f"{here}/t")
    assert os.listdir(here.removeprefix("file://")) == []


def test_compare(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert checks.Run(spark).compare("same", a, a.orderBy("k"))
    late = checks.Run(spark, stop=False)
    assert not late.compare("a repeated row is not one", a, a.distinct())
    assert late.ledger().first()["value"] == 1.0


def test_digests_of_any_size(spark, tmp_path):
    """An empty file, one of several chunks and one beyond two gigabytes, most of it a hole."""
    (tmp_path / "none").write_bytes(b"")
    (tmp_path / "100% & a,b").write_bytes(b"odd name")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "chunks").write_bytes(os.urandom(files.CHUNK * 2 + 17))
    size = (1 << 31) + 123
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    got = {r["file"].rpartition("/")[2]: (r["bytes"], r["sha256"]) for r in files.digests(spark, f"file://{tmp_path}").collect()}
    for name, path in (("none", tmp_path / "none"), ("100% & a,b", tmp_path / "100% & a,b"), ("chunks", tmp_path / "sub" / "chunks"), ("large", tmp_path / "large")):
        with open(path, "rb") as f:
            assert got[name] == (path.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest()), name


def test_provenance(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    row = files.provenance(spark, f"file://{tmp_path}", seed=42, begun=time.time() - 5).first()
    assert row["sha256"] == hashlib.sha256(b"x").hexdigest() and row["seed"] == 42 and row["spark"] == spark.version and 5 <= row["seconds"] < 60


def test_combined_is_of_rows_not_of_order(spark):
    df = spark.createDataFrame([(str(i % 7), i // 2) for i in range(50)] + [(None, 1)], "a string, b int")
    one = files.combined(df.repartition(7), "a", "b")
    assert one == files.combined(df.coalesce(1).orderBy(F.desc("b")), "a", "b")
    assert one != files.combined(df.where("b > 0"), "a", "b") != files.combined(df.union(df.limit(1)), "a", "b")


def test_package_and_what_changes_in_it(spark, here, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{here}/made")
    (tmp_path / "note.txt").write_text("as it was")
    (tmp_path / "none.txt").write_text("")
    manifest = files.packaged(spark, {"table": f"{here}/made", "docs/note.txt": f"{here}/note.txt", "none": f"{here}/none.txt"}, f"{here}/package")
    rows = {r["file"]: r for r in manifest.collect()}
    assert len(rows) == 5 and rows["none"]["bytes"] == 0 and rows["docs/note.txt"]["sha256"] == hashlib.sha256(b"as it was").hexdigest() and rows["docs/note.txt"]["bytes"] == 9
    assert sorted(r[0] for r in spark.read.parquet(f"{here}/package/table").collect()) == list(range(100))
    assert files.verified(spark, f"{here}/package").isEmpty()
    with pytest.raises(FileExistsError):
        files.packaged(spark, {"table": f"{here}/made"}, f"{here}/package")
    package = tmp_path / "package"
    (package / "docs" / "note.txt").write_text("as it is ")
    gone = next((package / "table").glob("part-*"))
    gone.rename(package / "docs" / "part.parquet")
    states = {(r["file"].partition("/")[0], r["state"]) for r in files.verified(spark, f"{here}/package").collect()}
    assert states == {("docs", "changed"), ("docs", "added"), ("table", "missing")}
    assert not [p for p in os.listdir(tmp_path) if "making" in p]


def test_catalogue_makes_a_table_once_for_its_inputs(spark, here, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("1\n2\n")
    calls = []

    def make():
        calls.append(1)
        return spark.read.schema("x int").csv(f"{here}/in")

    def total(trust=True, **parameters):
        return files.Catalogue(spark, f"{here}/kept", trust).kept("numbers", [f"{here}/in"], make, **parameters).agg(F.sum("x")).first()[0]

    assert total(version=1) == total(version=1) == total(trust=False, version=1) == 3 and len(calls) == 1
    assert total(version=2) == 3 and len(calls) == 2
    (source / "a.csv").write_text("1\n5\n")
    os.utime(source / "a.csv", (1, 1))
    assert total(version=1) == 6 and len(calls) == 3
    (source / "b.csv").write_text("")
    assert total(version=1) == 6 and len(calls) == 4
    (source / "b.csv").unlink()
    assert total(version=1) == 6 and len(calls) == 4
    assert len(os.listdir(tmp_path / "kept" / "numbers")) == 4 and os.listdir(tmp_path / "kept" / "making") == []


def test_catalogue_keeps_nothing_of_what_fails(spark, here, tmp_path):
    (tmp_path / "in").write_text("1")
    kept = files.Catalogue(spark, f"{here}/kept")
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        kept.kept("t", [f"{here}/in"], lambda: bad.select(F.col("x").cast("string")))
    assert kept.kept("t", [f"{here}/in"], lambda: spark.range(3)).count() == 3


def test_a_second_run_reads_genotypes_and_statistics(spark, tiny, monkeypatch):
    made = []
    whole = files.Catalogue.kept

    def watched(self, name, *args, **parameters):
        out = whole(self, name, *args, **parameters)
        made.extend(self.made)
        self.made.clear()
        return out

    monkeypatch.setattr(files.Catalogue, "kept", watched)
    first = QUERIES["filter_cascade_kept"](spark, tiny).collect()
    made.clear()
    assert QUERIES["filter_cascade_kept"](spark, tiny).collect() == first and made == []


def test_query_of_digests(spark, tiny):
    for r in QUERIES["input_digests"](spark, tiny).collect():
        with open(f"{tiny}/{r['name']}.parquet", "rb") as f:
            assert r["sha256"] == hashlib.file_digest(f, "sha256").hexdigest()
