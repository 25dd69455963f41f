"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination and mixing over documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs the stages writes each result as Parquet and reads it
again as the next one's docs. All stages but the last return the columns of docs, whatever further columns these have: names that an
operator uses itself are set aside meanwhile. An empty table gives an empty result; null texts and ids are stated by stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from dosewise.llm.common import saved, small_or_shuffled


def _aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work's result over the columns in names, with all others of docs beside it in the struct `_rest`."""
    rest = [c for c in docs.columns if c not in names]
    return work(docs.select(*names, (F.struct(*rest) if rest else F.lit(None)).alias("_rest")))


def _back(docs: DataFrame, names: tuple[str, ...]) -> list:
    return [F.col(c) if c in names else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; the others go.

    Rejected are texts without a letter (nulls too) and those whose cosine with every prototype is below half of the least that a learning
    text of like length has: what is written in none of them. Repeated rows, and those without an id, are judged each.
    """
    names = ("doc_id", "text", "lang")
    kept = _aside(docs, names, language_id.judged).where("fits")
    return kept.select(*_back(docs, names))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand elsewhere; n_chars follows the text. Texts that lose all of theirs go.

    Null texts and ids stay; rows equal in id and text keep or lose the same lines."""
    names = ("doc_id", "text", "n_chars")
    kept = _aside(docs, names, line_dedup.remove_repeated).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_back(docs, names))


#: Rows without an id are numbered from here on by their text.
UNNAMED = 1 << 62


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram links join, the one with the smallest doc_id; one row of each id.

    Five-word shingles and a Jaccard similarity of 0.8. Rows that repeat an id are one document, and of their texts one stays. Rows without an id
    are one document a text, in groups as others are, behind all that have an id. Documents without words are in no group.
    """
    numbered = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1)) + F.lit(UNNAMED)))
    groups = ngram_join.jaccard_groups(numbered.select("_id", "text"), id="_id", n=5, percent=80)
    gone = groups.where("component_id <> _id").select("_id").distinct()
    first = numbered.join(small_or_shuffled(saved(gone, "gone")), "_id", "left_anti")
    # a repeated id keeps the text with the smallest hash, once
    several = first.groupBy("_id").agg(F.count("*").alias("_rows"), F.min(F.xxhash64("text")).alias("_least")).where("_rows > 1")
    if (several := saved(several, "several")).isEmpty():
        return first.select(*docs.columns)
    first = first.join(small_or_shuffled(several), "_id", "left")
    other = first.where(F.col("_rows").isNotNull() & (F.xxhash64("text") == F.col("_least"))).dropDuplicates(["_id"])
    return first.where("_rows is null").union(other).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item; rows without an id are judged as any, null texts hold nothing and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64("doc_id", "text")
    leaked = decontaminate.leaks(docs.select(key.alias("_key"), "text"), benchmark, id="_key").select("_key").distinct()
    return docs.withColumn("_key", key).join(small_or_shuffled(saved(leaked, "leaked")), "_key", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, each document as often as the mix takes it, numbered by `copy` (in place of a column of that name).

    A null source is one of its own; null and empty texts have no words, and are taken as often as the whole copies of their source."""
    names = ("doc_id", "text", "source")
    taken = _aside(docs, names, lambda d: mixing.mix(d, tilt=F.sqrt)).where("copies > 0")
    return taken.select(*[c for c, name in zip(_back(docs, names), docs.columns, strict=True) if name != "copy"], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near), ("benchmark decontamination", clean), ("mixing sources", mixed)]
#: SQL can express neither learned languages nor rolling hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
