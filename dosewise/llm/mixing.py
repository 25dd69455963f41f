"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.llm.common import bound_batches, saved, word_counts

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
#: Ranks of a source are first cut at one of so many bins, then exactly within it.
BINS = 4096


@F.arrow_udf(T.LongType())
def words_in(text: pa.Array) -> pa.Array:
    return word_counts(text)


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, source_size): weights repeat over sources in order, null last, and share
    the sum of all sizes; a target stops at `most` times its source's size and the excess is shared again by weight."""
    # one row a source: their places in order are counted in one task, of names alone
    ranked = totals.select("source", "source_size", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("i"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", weight.alias("w")), "sources")
    cap, share = most * F.col("source_size"), 0.0
    while True:  # the share of a unit of weight grows as sources reach their cap
        full = F.col("w") * share > cap
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("w"))).alias("free")).first()
        after = (r["all"] - (r["capped"] or 0.0)) / r["free"] if r["free"] else share
        if after <= share:
            break
        share = after
    return ranked.select("source", "source_size", F.least(cap, F.col("w") * share).alias("target"))


def _exact_sum(x: Column) -> Column:
    """The same sum in any order of the rows."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def certain_chances(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(_c, scale) of each source: a row's chance is scale times its weight, so that the words expected of rows whose chance is below one,
    and those of the certain rest, are together what the source lacks."""
    plan = F.broadcast(plan.select(F.col("_s").alias("_c"), "lack"))  # one row a source
    joined = slim.join(plan, F.col("source").eqNullSafe(F.col("_c"))).select("_c", "lack", "size", "_w")
    now = saved(joined.groupBy("_c", "lack").agg(_exact_sum(F.col("_w") * F.col("size")).alias("all")).select("_c", "lack", F.when(F.col("all") > 0, F.col("lack") / F.col("all")).otherwise(0.0).alias("scale"), F.lit(0).cast("long").alias("sure")), "scales")
    before = 0
    while True:  # the scale grows as rows become certain, whose number is all that reaches the driver
        sure = F.col("_w") * F.col("scale") >= 1
        rows = joined.join(F.broadcast(now.select(F.col("_c").alias("_d"), "scale")), F.col("_c").eqNullSafe(F.col("_d")))
        sums = rows.groupBy("_c", "lack", "scale").agg(F.sum(sure.cast("long")).alias("sure"), F.sum(F.when(sure, F.col("size")).otherwise(0)).alias("taken"), _exact_sum(F.when(sure, 0.0).otherwise(F.col("_w") * F.col("size"))).alias("free"))
        left = F.col("lack") - F.col("taken")
        after = saved(sums.select("_c", "lack", F.when((F.col("free") > 0) & (left > 0), F.greatest("scale", left / F.col("free"))).otherwise(F.col("scale")).alias("scale"), "sure"), "scales")
        count = after.agg(F.sum("sure")).first()[0] or 0
        if count == before:
            return after.select("_c", "scale")
        now, before = after, count


def mix(
    documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", tilt: str | Callable[[Column], Column] | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7
) -> DataFrame:
    """All columns of documents with size, source_size, target, copies and taken (= size * copies).

    A document of a source whose target is r times its size is wanted r times: int(r) copies are certain, and the rest is a sample.
    Its inclusion chance p is in proportion to its weight: `tilt`, a column of positive weights or a function of the size; without it all of a
    source are alike. Documents whose chance would reach 1 are certain, and the others' chances make up for it.
    Pareto order sampling ranks documents by u / (1 - u) over p / (1 - p), u a uniform number that the id, the
    text and the seed fix, and takes the lowest ranks up to the words that the source still lacks, to the nearest document. So
    the taken words of a source miss its target by half a document at most, the one at the border, and reruns agree.

    Size is the number of words (null: 0). A null source is one of its own, the last. Rows that are equal in id and text share
    a rank; where the border falls among them, as many are taken as come nearest to the target, any of them.
    Columns with the added names are replaced; an empty table gives an empty result.
    """
    bound_batches(documents.sparkSession)
    added = ("size", "source_size", "target", "copies", "taken")
    row = F.struct(*[c for c in documents.columns if c not in added])
    bits = F.shiftrightunsigned(F.xxhash64(F.col(id), F.col(text), F.lit(seed)), 11)
    sized = documents.select(row.alias("row"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), ((bits + 0.5) * 2.0**-53).alias("_u"), *([F.col(tilt).cast("double").alias("_t")] if isinstance(tilt, str) else []))
    lean = F.lit(1.0) if tilt is None else F.coalesce(F.col("_t"), F.lit(1.0)) if isinstance(tilt, str) else tilt(F.col("size")).cast("double")
    sized = sized.withColumn("_w", F.greatest(lean, F.lit(1e-12))).drop("_t")
    slim = saved(sized.drop("row"), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.col("whole")).withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = saved(plan.withColumnRenamed("source", "_s"), "plan")
    plan = plan.join(certain_chances(slim, plan.where("part > 0")), F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c")

    chance = F.least(F.col("scale") * F.col("_w"), F.lit(1.0))
    odds = F.col("_u") / (1 - F.col("_u")) * (1 - chance) / F.greatest(chance, F.lit(1e-300))
    # orders as odds do, within 0 and 1; the certain ones come first, in the order of their random numbers
    place = F.when(chance >= 1, F.col("_u") * 1e-30).otherwise(odds / (1 + odds))
    part = F.least(F.floor(place * BINS), F.lit(BINS - 1))
    ranked = slim.join(plan.where("part > 0"), F.col("source").eqNullSafe(F.col("_s"))).select("_s", "size", "lack", place.alias("place"), part.alias("bin"))
    by_bin = ranked.groupBy("_s", "bin", "lack").agg(F.sum("size").alias("size"))
    run = W.partitionBy("_s").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    crossing = saved(by_bin.where("before < lack and before + size >= lack").select("_s", "bin", "before"), "crossing")
    inside = ranked.join(crossing.select(F.col("_s").alias("_t"), F.col("bin").alias("_b"), "before"), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("bin") == F.col("_b")))
    inside = inside.groupBy("_s", "place", "lack", "before").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    run = W.partitionBy("_s").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    # of the rows that share a place, as many as come nearest to what is lacking
    fit = F.when(F.col("size") > 0, F.round((F.col("lack") - F.col("at")) / (F.col("size") / F.col("rows")))).otherwise(F.when(F.col("at") <= F.col("lack"), F.col("rows")).otherwise(0))
    inside = inside.withColumn("fit", F.least(fit, "rows").cast("long"))
    cut = inside.groupBy("_s").agg(F.max(F.when(F.col("fit") >= F.col("rows"), F.col("place"))).alias("cut"), F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("rows")), F.struct("place", "fit"))).alias("some"))
    cuts = crossing.select(F.col("_s").alias("_t"), "bin").join(cut, F.col("_t").eqNullSafe(F.col("_s")), "left").select("_t", "bin", "cut", "some")
    plan = saved(plan.join(cuts, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "cuts")

    # without a crossing bin, the words still lacking are all of the source's or none
    extra = F.when(F.col("part") <= 0, False).when(F.col("bin").isNull(), F.col("lack") > 0).otherwise((part < F.col("bin")) | ((part == F.col("bin")) & (place <= F.coalesce("cut", F.lit(-1.0)))))
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("extra", extra.cast("int"))
    if not plan.where("some is not null").isEmpty():
        tied = (F.col("extra") == 0) & F.coalesce((part == F.col("bin")) & (place == F.col("some.place")), F.lit(False))
        out = out.where(~tied).unionByName(_some_of(out.where(tied)))
    copies = F.col("whole") + F.col("extra")
    return out.select("row.*", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


#: Parts in which rows that share a place are numbered.
SALTS = 64


def _some_of(tied: DataFrame) -> DataFrame:
    """Rows of one place a source, `some.fit` of each source's with extra 1: numbered part by part, behind the rows of the parts before."""
    tied = saved(tied.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).withColumn("order", F.monotonically_increasing_id()), "tied")
    before = tied.groupBy("_s", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("_s").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_s").alias("_t"), F.col("salt").alias("_p"), "before")
    numbered = tied.withColumn("number", F.row_number().over(W.partitionBy("_s", "salt").orderBy("order"))).join(F.broadcast(before), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("salt") == F.col("_p")))
    return numbered.withColumn("extra", (F.col("before") + F.col("number") <= F.col("some.fit")).cast("int")).drop("salt", "order", "number", "_t", "_p", "before")
