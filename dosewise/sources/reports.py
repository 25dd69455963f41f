"""Call reports and the small tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls of the report, and the doses that they stand for; any other text is a missing call.
CALLS = {"0": 0, "1": 2, "2": 1}


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, line): the lines of one text file or of several in the order of their names, numbered from 0 in file order.

    Spark reads a file in blocks, which it may deal out in any order. A line's number is its place in its block behind the sizes of the blocks
    before; only those sizes, one a block, are sorted. Lines are kept once, so that both passes see the same blocks. Needs a checkpoint folder.
    """
    block = ["file", "start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_id")).checkpoint()
    sizes = lines.groupBy(*block).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy(F.lit(1)).orderBy(*block)) - F.col("_rows")
    return lines.join(F.broadcast(sizes.select(*block, "_first", before.alias("_before"))), block).select((F.col("_id") - F.col("_first") + F.col("_before")).alias("row"), "line")


def report_lines(spark: SparkSession, path: str, preamble: int = 7) -> tuple[list[str], DataFrame]:
    """The preamble lines, and (row, line) of what follows, rows numbered from 0 in file order; only the preamble comes to the driver."""
    rows = file_rows(spark, path)
    head = [r["line"] for r in rows.where(F.col("row") < preamble).orderBy("row").collect()]
    return head, rows.where(F.col("row") >= preamble).select((F.col("row") - preamble).alias("row"), "line")


def fields_of(width: int, line: str = "line") -> Column:
    """The fields of a comma-separated line as an array, quotes taken off; null unless there are `width` of them."""
    fields = F.from_csv(F.col(line), ", ".join([*[f"c{i} string" for i in range(width)], "_other string"]), {"columnNameOfCorruptRecord": "_other", "mode": "PERMISSIVE", "escape": '"', "emptyValue": "", "nullValue": "\u0000"})
    return F.when(fields["_other"].isNull(), F.transform(F.array(*[fields[f"c{i}"] for i in range(width)]), lambda x: F.coalesce(x, F.lit(""))))


def projected(spark: SparkSession, path: str, columns: list[str], preamble: int = 7) -> DataFrame:
    """(row, columns): some columns of a report by name, numbered rows of any other width than the header's left out."""
    head, lines = report_lines(spark, path, preamble)
    names = [x.strip().strip('"') for x in head[-1].split(",")]
    at = {c: len(names) - 1 - names[::-1].index(c) for c in columns}  # of equal names the last, as in a map of names
    return lines.select("row", fields_of(len(names)).alias("f")).where("f is not null").select("row", *[F.col("f")[i].alias(c) for c, i in at.items()])


def aligned(a: DataFrame, b: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """(row, column, left, right): where two tables differ at a position, a row that only one has included; empty if they are aligned."""
    sides = [df.select(row, *[F.col(c).cast("string").alias(f"{s}_{c}") for c in columns], F.lit(True).alias(f"{s}_here")) for s, df in (("left", a), ("right", b))]
    both = sides[0].join(sides[1], row, "full")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"left_{c}").alias("left"), F.col(f"right_{c}").alias("right")) for c in columns]))
    return both.select(row, "left_here", "right_here", pairs.alias("p")).where("left_here is null or right_here is null or not (p.left <=> p.right)").select(row, "p.*")


def call_report(spark: SparkSession, path: str, n_meta: int = 26, preamble: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loci, samples, genotypes) of a call report.

    The preamble's first line has each column's order, its last the header. Rows of any other width than the header are
    malformed and left out; loci keep their row as locus_idx, samples are numbered by column, and only doses other than 0 become rows.
    """
    head, lines = report_lines(spark, path, preamble)
    orders, names = ([x.strip().strip('"') for x in head[k].split(",")] for k in (0, -1))
    samples = spark.createDataFrame([(i, orders[n_meta + i] if n_meta + i < len(orders) else "", name) for i, name in enumerate(names[n_meta:])], "sample_idx long, batch string, report_id string")
    rows = lines.select("row", fields_of(len(names)).alias("f")).where("f is not null")
    loci = rows.select(F.col("row").alias("locus_idx"), *[F.col("f")[i].alias(c) for i, c in enumerate(names[:n_meta])])
    calls = rows.select(F.col("row").alias("locus_idx"), F.posexplode(F.slice("f", n_meta + 1, len(names) - n_meta)).alias("sample_idx", "call"))
    return loci, samples, calls.select(F.col("sample_idx").cast("long").alias("sample_idx"), "locus_idx", decoded("call").alias("dose")).where("dose is null or dose > 0")


def decoded(call: str) -> Column:
    """The dose of a call; null for a missing one."""
    text = F.trim(F.col(call))
    out = F.lit(None).cast("int")
    for code, dose in CALLS.items():
        out = F.when(text == code, F.lit(dose)).otherwise(out)
    return out


def dosage_matrix(spark: SparkSession, path: str, key: str = "AlleleID") -> DataFrame:
    """(key, sample, dose) of a wide table of one row a locus, one column a sample; nulls are missing calls, zeros are rows too."""
    wide = spark.read.csv(path, header=True)
    return wide.unpivot([key], [c for c in wide.columns if c != key], "sample", "dose").withColumn("dose", F.col("dose").try_cast("double").cast("int"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A small table; without a header the schema names its columns; a byte order mark is taken off."""
    if not header:
        return spark.read.schema(schema).csv(path)
    df = spark.read.csv(path, header=True)
    df = df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})
    if schema is None:
        return df
    kinds = T._parse_datatype_string(schema)
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document whose numbers may be the word NaN, read as null."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?<=[:\[,\s])-?(NaN|Infinity)(?=[,\s\]}])", "null").alias("value"))
    return whole.select(F.from_json("value", schema).alias("d")).select("d.*")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
