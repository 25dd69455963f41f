"""Secret scans over a ledger of blobs: every distinct text is scanned once for each version of a rule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, saved

LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """kind@version; a match counts if `group` of it has `least` characters or more.

    `needs` are strings of which any match holds at least one: texts without them are not searched.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = 0
    version: int = 1
    needs: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds first, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE, needs=(":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # the runs [0-9a-f]+ of 32 or more
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, needs=("PRIVATE KEY-----",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)


def find(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule, in code points, end exclusive."""
    if rule.needs and not any(x in text for x in rule.needs):
        return []
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {r.name: (r, re.compile(r.pattern, r.flags)) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            blobs, texts, todo = batch.columns
            spans = [
                [{"rule": name, "start": s, "end": e} for name in names for s, e in find(text.as_py(), *known[name])]
                for text, names in zip(texts, todo.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([blobs, todo, pa.array(spans, kind)], ["blob", "rules", "spans"])

    return scan


def scan_versions(versions: DataFrame, paths: list[str], text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The `paths` columns of every version, its blob, and `spans`: what the rules find in its text, by start and kind.

    A version is any row; its content address is the SHA-256 of its text. Pairs of blob and rule version that the
    ledger (a Parquet folder, appended to; none: everything is unseen) lacks are scanned, each on one copy of the
    text, and findings are joined back to all rows with that blob. Pairs that the ledger holds more than once, as two runs at
    once leave them, count once. A null text counts as empty; repeated rows give
    repeated rows; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    spark = versions.sparkSession
    bound_batches(spark)
    names = [r.name for r in rules]
    whole = versions.select(
        F.struct(*paths).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2("text", 256))
    ids = whole.select("path", "blob")
    todo = ids.groupBy("blob").agg(F.min(F.xxhash64("path")).alias("pick"))
    old = None
    if ledger is not None:
        old = spark.read.schema(LEDGER).parquet(ledger) if _exists(spark, ledger) else None
    every = F.array(*map(F.lit, names))
    if old is not None:
        seen = old.select("blob", F.array_intersect("rules", every).alias("r")).groupBy("blob").agg(F.flatten(F.collect_list("r")).alias("r"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("r", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0).drop("r")
    else:
        todo = todo.withColumn("todo", every)
    # sorted by both, so that of rows with one path and text only the first is scanned
    unseen = whole.select("blob", F.xxhash64("path").alias("pick"), "text").join(todo.hint("merge"), ["blob", "pick"]).dropDuplicates(["blob", "pick"])
    found = unseen.select("blob", "text", "todo").mapInArrow(_scanner(rules), LEDGER)
    if ledger is not None:
        found.write.mode("append").parquet(ledger)
        found = spark.read.schema(LEDGER).parquet(ledger)
    else:
        found = saved(found, "ledger")
    rank = F.array(*map(F.lit, names))
    hits = (
        found.where(F.size("spans") > 0)
        .groupBy("blob")  # as many rows a blob as there were scans of it
        .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        .select("blob", F.filter("spans", lambda s: F.array_contains(rank, s["rule"])).alias("spans"))
    )
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["rule"]).alias("at"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind")))
    )
    none = F.array().cast("array<struct<start:int,at:bigint,end:int,kind:string>>")
    return ids.join(hits, "blob", "left").select("path.*", "blob", F.coalesce(ordered, none).alias("spans"))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of some kinds), joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
