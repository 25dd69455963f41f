"""What results are written as: Parquet is the store; CSV and JSON are for small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", files: int | None = None) -> None:
    """A result as Parquet, or CSV with a header; nulls are blank."""
    out = df if files is None else df.coalesce(files)
    if kind == "csv":
        out.write.mode("overwrite").csv(path, header=True)
    else:
        out.write.mode("overwrite").format(kind).save(path)


def matrix(pairs: DataFrame, i: str, j: str, value: str, names: list[str]) -> DataFrame:
    """A symmetric matrix of named rows and columns from (i, j, value), i before j; the diagonal is 0."""
    both = pairs.select(F.col(i).alias("name"), F.col(j).alias("other"), F.col(value).alias("x")).union(pairs.select(F.col(j), F.col(i), F.col(value)))
    diagonal = pairs.select(F.col(i).alias("name")).union(pairs.select(F.col(j))).distinct().select("name", F.col("name").alias("other"), F.lit(0.0).alias("x"))
    return both.union(diagonal).groupBy("name").pivot("other", names).agg(F.first("x"))


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as a JSON text; what is undefined is null, never NaN."""
    columns = [F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small report table; more than `most` rows are an error, for a report is no place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    line = lambda cells: "| " + " | ".join("—" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
