"""URL filters as a sort-merge range join: rule prefixes are intervals of reversed-host keys."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import partitions, saved

#: Keys that set the bounds of the ranges, for each range.
KEYS_A_RANGE = 30
#: Bounds are cut to so many characters; cut bounds still order whole keys.
BOUND_CHARS = 200


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = _rest(url)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise("")


def _rest(url: str | Column) -> Column:
    """Host and path: between the first :// and the first ? or # behind it."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    after = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.substring_index(F.substring_index(after, "?", 1), "#", 1)).otherwise("")


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _bounds(keys: DataFrame, n: int) -> list[str]:
    """n - 1 keys that cut all keys into ranges of about equal size; a frequent key may be several of them."""
    some = [r[0] for r in keys.select(F.substring("key", 1, BOUND_CHARS).alias("key"), F.xxhash64("key", "host", "path").alias("h")).orderBy("h").limit(KEYS_A_RANGE * n).select("key").collect()]
    some.sort(key=lambda s: s.encode())
    return [some[len(some) * i // n] for i in range(1, n)] if some else []


def _dealer(bounds: list[str]):
    """Adds each key's range; a rule goes to every range that its interval meets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [b.encode() for b in bounds]
        for batch in batches:
            rows, part = [], []
            for i, (key, salt, rule) in enumerate(zip(batch["key"].to_pylist(), batch["salt"].to_pylist(), batch["rule"].to_pylist(), strict=True)):
                k = key.encode()
                low, high = bisect.bisect_left(cuts, k), bisect.bisect_right(cuts, k)
                if rule is None:  # a key that is a bound, and maybe several, can go to any range beside it
                    part.append(low + salt % (high - low + 1))
                    rows.append(i)
                else:
                    # every range that may hold a key beginning with k
                    high = bisect.bisect_right(cuts, k + b"\xff")
                    part += range(low, high + 1)
                    rows += [i] * (high - low + 1)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *out.columns], ["part", *out.schema.names])

    return deal


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows by range and key, rules before urls: the stack holds the rules whose interval is open, each nested in the one below."""
    stack: list[tuple[str, str, str]] = []
    now = None
    for batch in batches:
        hosts, paths, rules, verdicts = [], [], [], []
        part, key, host, path, rule, verdict = (batch[c].to_pylist() for c in ("part", "key", "host", "path", "rule", "verdict"))
        for p, k, h, w, r, v in zip(part, key, host, path, rule, verdict, strict=True):
            if p != now:
                stack.clear()
                now = p
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if r is not None:
                stack.append((k, r, v))
            elif stack:
                hosts.append(h)
                paths.append(w)
                rules.append(stack[-1][1])
                verdicts.append(stack[-1][2])
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string())})


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """`pages` with host, path, rule (as `host/path`) and verdict: that of the longest rule that fits, else the default.

    `rules` has host, path (with or without the leading /) and verdict. A rule fits its host and all subdomains where
    the url's path starts with its own path. A rule's key is its reversed host, a /, and its path; a url has one key for each
    host that it lies under, so "fits" means that the key lies in the rule's interval, and a sorted sweep with a
    stack of open rules finds the longest at each host level. Ranges of keys are dealt to tasks; a very frequent key
    is spread over several ranges, each with the rules that are open there.
    Of rules that are equal in host and path, block wins; length is that of `host/path` in characters, ties
    going to the longer host. A url that is null or has no :// has an empty host and path and no rule; columns of pages named
    host, path, rule or verdict are replaced; repeated rows stay repeated.
    """
    spark = pages.sparkSession
    n = ranges or partitions(spark)
    row = F.struct(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    pages = pages.select(row.alias("row"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    whole = pages.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # no rule lies under more labels than the deepest has, so longer hosts need no further keys
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.array_join(F.reverse(F.slice(labels, F.size(labels) - i + 1, i)), "."))
    keys = whole.select("host", "path", F.explode(levels).alias("level")).select(
        F.concat("level", F.when(F.col("path") == "", "/").otherwise(F.col("path"))).alias("key"), "host", "path"
    ).withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    tidy = rules.select(F.lower("host").alias("h"), F.ltrim(F.coalesce("path", F.lit("")), F.lit("/")).alias("p"), F.col("verdict").alias("v")).where("h <> ''")
    tidy = tidy.groupBy("h", "p").agg(F.max("v").alias("v"))  # block sorts after allow
    opens = tidy.select(
        F.concat(reversed_host(F.col("h")), F.lit("/"), "p").alias("key"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0).cast("long").alias("salt"),
        F.concat_ws("/", "h", "p").alias("rule"), F.col("v").alias("verdict"),
    )
    keys = saved(keys, "urls")
    dealt = keys.unionByName(opens).mapInArrow(_dealer(_bounds(keys, n)), "part int, key string, host string, path string, salt long, rule string, verdict string")
    swept = dealt.repartition(n, "part").sortWithinPartitions("part", "key", F.col("rule").isNull()).mapInArrow(_sweep, "host string, path string, rule string, verdict string")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)), "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
