"""Small operations over result tables: histograms, summaries with a total, overrides, labels, ranks and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fixed_histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of bins of one width from low on, empty ones included; the last holds its upper end, and values outside are in none."""
    x = F.col(value)
    top = low + width * bins
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    counts = df.where((x >= low) & (x <= top)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def range_summary(df: DataFrame, group: str, value: str, total: str = "total") -> DataFrame:
    """(group, n, least, most, mean) of each group, and of all rows under the name `total`."""
    sums = df.rollup(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.grouping(group).alias("_all"))
    return sums.select(F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), "n", "least", "most", "mean")


def overridden(df: DataFrame, where: Column, column: str, value) -> DataFrame:
    """df with one row's value replaced; an error unless exactly one row meets the condition."""
    found = df.where(where).limit(2).count()
    if found != 1:
        raise ValueError(f"an override must meet exactly one row, not {'none' if not found else 'several'}")
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def labelled(value: Column, steps: list[tuple[float, str]], above: str) -> Column:
    """The label of the first threshold that a value is below, else `above`; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for least, label in steps:
        out = out.when(value < least, label)
    return out.otherwise(above)


def unmatched_pairs(a: DataFrame, b: DataFrame, i: str, j: str) -> DataFrame:
    """(n_a, n_b, only_a, only_b): pairs of two tables, in whichever order each has them, and those that the other lacks."""
    key = lambda df, side: df.select(F.least(i, j).alias("_i"), F.greatest(i, j).alias("_j"), F.lit(1).alias(side)).distinct()
    both = key(a, "in_a").join(key(b, "in_b"), ["_i", "_j"], "full")
    return both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df with `rank` from 1 in that order, within `by` or over all rows: for tables of pairs or groups, which one task can hold."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*(by or [F.lit(1)])).orderBy(*order)))


def sliced(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows first to last, counted from 1 in an order: a limit sorts within tasks first."""
    return ranked(df.orderBy(*order).limit(last), order).where(F.col("rank") >= first)


def digits(x: str | Column) -> Column:
    """A key that orders names by the number within them; names without one come first."""
    return F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("long"), F.lit(-1))


def truncated(df: DataFrame, by: list[str], name: str, order: list[Column], most: int) -> DataFrame:
    """(by, n, shown): how many names a group has, and the first of them in order, joined, with dots where more follow."""
    first = ranked(df, order, by).groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.col(name).alias("x"))))).alias("l"))
    text = F.array_join(F.col("l")["x"], ", ")
    return first.select(*by, "n", F.when(F.col("n") > most, F.concat(text, F.lit(", ..."))).otherwise(text).alias("shown"))


def above_quantile(df: DataFrame, value: str, q: float, order: list[Column]) -> DataFrame:
    """Ranked rows whose value is above the exact quantile of all."""
    bound = df.agg(F.percentile(value, q)).scalar()
    return ranked(df.where(F.col(value) > bound), order)
