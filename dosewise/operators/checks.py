"""Assertions: recorded with what was expected, and counted by the job that writes the result."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dosewise.sources import files


def ledger(checks: list[tuple[str, DataFrame, Column, str, Column]]) -> DataFrame:
    """(name, value, expected, passed) from (name, table, aggregate, what is expected in words, test on the column `value`)."""
    rows = [df.agg(value.alias("value")).select(F.lit(name).alias("name"), F.col("value").cast("string").alias("text"), F.lit(expected).alias("expected"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, df, value, expected, ok in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumnRenamed("text", "value")


def enforce(checks: DataFrame) -> DataFrame:
    """The ledger, if all passed; else an error that names those that failed."""
    failed = [r["name"] for r in checks.where("not passed").limit(50).collect()]
    if failed:
        raise AssertionError("failed: " + ", ".join(failed))
    return checks


def worst_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(measure, worst, unmatched): the largest difference of each column over rows of equal keys, and rows without a partner."""
    both = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(1).alias("_b")), keys, "full")
    one = both.agg(*[F.max(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))).alias(c) for c in columns], F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))
    return one.unpivot(["unmatched"], columns, "measure", "worst").select("measure", "worst", "unmatched")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows that one table has more often than the other."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.agg(F.count("*").alias("only_a")).withColumn("only_b", right.agg(F.count("*")).scalar())


# ---------------------------------------------------------------- checks within the job that writes


class Check(NamedTuple):
    """An aggregate of the table that is written (not a distinct one), and the number that it should be, within a tolerance; null and NaN fail."""

    name: str
    value: Column
    expected: float = 0.0
    tolerance: float = 0.0


def guarded(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """df, whose job stops with the condition's name at the first row where one is not true; a null is not true."""
    for name, ok in conditions.items():
        df = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"failed: {name}")).cast("boolean")))
    return df


LEDGER = "step string, name string, value double, expected double, tolerance double, passed boolean, rows long, seconds double, at double"


class Run:
    """Tables published one after the other, with a ledger of their checks, rows and times.

    A table's checks are metrics of the very job that writes it: no second pass over it. They are counted in the tasks that write, once a partition however
    often a task is repeated. The table is written beside and appears under its name only if all its checks pass. With `stop` a failed check is an
    error at once; else later tables go on and `finish` raises for all. A step without checks has one row, without a name.
    """

    def __init__(self, spark: SparkSession, stop: bool = True, clock: Callable[[], float] = time.monotonic):
        self.spark, self.stop, self.clock, self.rows = spark, stop, clock, []
        self.begun = clock()

    def publish(self, step: str, df: DataFrame, path: str, checks: list[Check] | None = None, kind: str = "parquet") -> bool:
        """Whether the table is now at `path`, which must be free."""
        if files.exists(self.spark, path):
            raise FileExistsError(path)
        checks, begun = checks or [], self.clock()
        seen, making = Observation(f"run-{uuid.uuid4().hex}"), f"{path.rstrip('/')}.making-{uuid.uuid4().hex}"
        try:
            watched = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.value.cast("double").alias(f"_c{i}") for i, c in enumerate(checks)])
            watched.write.format(kind).save(making)
            found = seen.get
            seconds, at = self.clock() - begun, self.clock() - self.begun
            failed = []
            for i, c in enumerate(checks):
                value = found[f"_c{i}"]
                passed = value is not None and abs(value - c.expected) <= c.tolerance
                self.rows.append((step, c.name, value, float(c.expected), float(c.tolerance), passed, found["_rows"], seconds, at))
                failed += [] if passed else [c.name]
            if not checks:
                self.rows.append((step, None, None, None, None, True, found["_rows"], seconds, at))
            if failed:
                if self.stop:
                    enforce(self.ledger())
                return False
            if not files.moved(self.spark, making, path):
                raise FileExistsError(path)
            return True
        finally:
            files.deleted(self.spark, making)

    def compare(self, step: str, a: DataFrame, b: DataFrame) -> bool:
        """Whether two tables have the same rows, for what is built again from what was written; one row of the ledger."""
        begun = self.clock()
        found = same_rows(a, b).first()
        differ = float(found["only_a"] + found["only_b"])
        self.rows.append((step, "rows that differ", differ, 0.0, 0.0, differ == 0, None, self.clock() - begun, self.clock() - self.begun))
        if differ and self.stop:
            enforce(self.ledger())
        return not differ

    def ledger(self) -> DataFrame:
        """(step, name, value, expected, tolerance, passed, rows, seconds, at): a row a check, `at` in seconds since the run began."""
        return self.spark.createDataFrame(self.rows, LEDGER)

    def finish(self) -> DataFrame:
        """The ledger; an error if a check failed on the way."""
        return enforce(self.ledger())
