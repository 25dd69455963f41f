"""Heterozygosity and inbreeding of individuals, from the cells that are stored: what zeros add is one number a frame."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.functions.expressions import ratio
from dosewise.operators import gram, replicates
from dosewise.operators.frequency import polymorphic

if TYPE_CHECKING:
    from dosewise.operators.resample import Weights


def frame_of(stats: DataFrame, group: str) -> DataFrame:
    """(frame, locus_idx, p, n) of a group's polymorphic loci."""
    return stats.where(polymorphic()).select(F.col(group).alias("frame"), "locus_idx", "p", "n")


def individual_ho(geno: DataFrame, samples: DataFrame, loci: DataFrame) -> DataFrame:
    """(sample_idx, n_loci, ho) of every sample: heterozygous calls over calls."""
    cells = geno.groupBy("sample_idx").agg(F.count_if(F.col("dose") == 1).alias("het"), F.count_if(F.col("dose").isNull()).alias("missing"))
    size = loci.agg(F.count("*")).scalar()
    out = samples.select("sample_idx").join(cells, "sample_idx", "left").fillna(0, ["het", "missing"]).withColumn("n_loci", size - F.col("missing"))
    return out.select("sample_idx", "n_loci", ratio("het", "n_loci").alias("ho"))


def smlh(ho: DataFrame) -> DataFrame:
    """(sample_idx, ho, smlh): heterozygosity over the mean of all samples."""
    mean = ho.agg(F.avg("ho")).scalar()
    return ho.select("sample_idx", "ho").withColumn("smlh", ratio("ho", mean))


def f_terms() -> dict:
    """What a dose adds to each estimator, and what dose 0 adds, as columns of p, n and dose."""
    p, g = F.col("p"), F.col("dose")
    pq2 = 2 * p * (1 - p)
    return {
        "uni0": p / (1 - p), "grm0": 2 * p / (1 - p), "hom0": 1 - pq2 * 2 * F.col("n") / (2 * F.col("n") - 1),
        "uni": (g * g - (1 + 2 * p) * g + 2 * p * p) / pq2, "grm": (g - 2 * p) * (g - 2 * p) / pq2,
    }


def individual_f(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """(frame, sample_idx, n_loci, f_hom, f_uni, f_grm); samples has (sample_idx, frame), a sample may be in several frames.

    Each estimator is the frame's sum for an all-zero genotype, plus differences at stored cells, less what missing calls would have added.
    """
    t = f_terms()
    zero = frame.groupBy("frame").agg(F.count("*").alias("loci"), *[F.sum(t[k]).alias(k) for k in ("uni0", "grm0", "hom0")])
    members = samples.select("sample_idx", "frame")
    cells = geno.join(members, "sample_idx").join(frame, ["frame", "locus_idx"])
    part = lambda k: F.sum(F.coalesce(t[k] - t[f"{k}0"], -t[f"{k}0"]))
    missing = F.col("dose").isNull()
    sums = cells.groupBy("frame", "sample_idx").agg(part("uni").alias("du"), part("grm").alias("dg"), F.count_if(missing).alias("missing"), F.count_if(F.col("dose") == 1).alias("het"), F.sum(F.when(missing, t["hom0"]).otherwise(0.0)).alias("mh"))
    out = members.join(sums, ["frame", "sample_idx"], "left").fillna(0, ["du", "dg", "missing", "het", "mh"]).join(zero, "frame")
    n = F.col("loci") - F.col("missing")
    expected = F.col("hom0") - F.col("mh")
    return out.select("frame", "sample_idx", n.alias("n_loci"), ratio(n - F.col("het") - expected, n - expected).alias("f_hom"), ratio(F.col("uni0") + F.col("du"), n).alias("f_uni"), (ratio(F.col("grm0") + F.col("dg"), n) - 1).alias("f_grm"))


def _by_locus(reps: int):
    """A block's weights by locus, a replicate after the other, packed as they were by replicate."""

    def work(weights: pa.Table) -> pa.Table:
        w = replicates.matrix(weights, reps).T.astype(np.int64)
        places, out = np.flatnonzero(w.any(axis=1)), []
        left = np.pad(w[places], ((0, 0), (0, reps % 2)))
        while left.any():
            now = np.minimum(left, 15)
            left -= now
            some = np.flatnonzero(now.any(axis=1))
            bits = (now[:, 0::2] | now[:, 1::2] << 4).astype(np.uint8)
            out.append(pa.table({"ord": pa.array(weights["block"][0].as_py() * replicates.BLOCK + places[some]), "w": pa.array([bits[i].tobytes() for i in some], pa.binary())}))
        return pa.concat_tables(out) if out else pa.table({"ord": pa.array([], pa.int64()), "w": pa.array([], pa.binary())})

    return work


#: Cells whose weights a task unfolds at once, and samples whose replicates it holds.
UNFOLDED, HELD = 1024, 256


def _sample_ends(reps: int, alpha: float, zero: dict[str, np.ndarray]):
    """Percentiles over replicates: a frame's two sums for doses of 0 plus those over a sample's cells of their two values times their loci's weights.
    A sample's cells follow each other, and it has one at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, total = [], None, None

        def out() -> pa.RecordBatch:
            sums = np.stack([zero[k[0]] + t for k, t in done])
            with np.errstate(divide="ignore", invalid="ignore"):
                theta = np.where(sums[:, 1] != 0, sums[:, 0] / sums[:, 1], np.nan)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.string()), pa.array([k[1] for k, _ in done], pa.int64()), *replicates.interval(theta, alpha).columns], ["frame", "sample_idx", "lo", "hi"])

        for whole in batches:
            for at in range(0, whole.num_rows, UNFOLDED):
                batch = whole.slice(at, UNFOLDED)
                w = replicates.unpacked(batch["w"], reps).astype(np.float64)
                names, ids = batch["frame"].to_numpy(zero_copy_only=False), batch["sample_idx"].to_numpy()
                cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (ids[1:] != ids[:-1])) + 1).tolist(), len(ids)]
                values = np.stack([batch["v0"].to_numpy(), batch["v1"].to_numpy()])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if key != (names[a], int(ids[a])):
                        if key:
                            done.append((key, total))
                        if len(done) == HELD:
                            yield out()
                            done = []
                        key, total = (names[a], int(ids[a])), np.zeros((2, reps))
                    total += values[:, a:b] @ w[a:b]
        if key:
            done.append((key, total))
            yield out()

    return work


def f_uni_bootstrap(geno: DataFrame, samples: DataFrame, frame: DataFrame, weights: Weights, reps: int, alpha: float = 0.05) -> DataFrame:
    """(frame, sample_idx, lo, hi) of F_UNI over replicates of loci; weights as bootstrap_weights gives them.

    A cell gets its locus's weights, four bits a replicate, and goes with them to its sample's task, which sends on two numbers. The sums for doses of 0, two arrays
    a frame, are in every task. Needs a checkpoint folder."""
    gram.bound_batches(geno.sparkSession)
    t = f_terms()
    packed = weights.packed.checkpoint()  # read twice, and dear
    zero = replicates.block_sums(frame.select(F.col("frame").cast("string").alias("of"), F.lit("all").alias("frame"), "locus_idx", "p", "n"), weights.index, packed, [t["uni0"], F.lit(1)], ["of"], reps)
    zero = {r["of"]: np.array(r["sums"]).reshape(2, reps) for r in replicates.named(zero, "`of` string", ["of"]).select("of", "sums").collect()}
    members = samples.select("sample_idx", "frame")
    by_locus = packed.groupBy("frame", "block").applyInArrow(_by_locus(reps), "ord long, w binary").join(weights.index.drop("frame"), "ord").drop("ord")
    d, missing = F.coalesce(t["uni"] - t["uni0"], -t["uni0"]), F.col("dose").isNull().cast("double")
    cells = geno.join(members, "sample_idx").join(frame, ["frame", "locus_idx"]).select("frame", "sample_idx", "locus_idx", d.alias("v0"), (-missing).alias("v1"))
    none = F.lit(bytearray((reps + 1) // 2))
    rows = cells.join(by_locus, "locus_idx").select("frame", "sample_idx", "v0", "v1", "w").union(members.where(F.col("frame").isin(*zero)).select("frame", "sample_idx", F.lit(0.0), F.lit(0.0), none))
    rows = rows.withColumn("frame", F.col("frame").cast("string")).repartition("frame", "sample_idx").sortWithinPartitions("frame", "sample_idx")
    return rows.mapInArrow(_sample_ends(reps, alpha, zero), "frame string, sample_idx long, lo double, hi double")


def kinship_sides(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """What kinship is made from: samples by sides, as gram.reduced() takes them.

    With doses standardised by the frame's frequencies the products of a pair are a constant of the frame, less a term of each sample, plus
    products at loci where both have a stored cell; a missing call counts as the mean. All pairs of two sides are made in one task, and only what
    it reduces them to leaves it. A sample is in a frame once. Needs a checkpoint folder.
    """
    zero = frame.groupBy(F.col("frame").cast("string").alias("frame")).agg(F.count("*").alias("loci"), F.sum(2 * F.col("p") / (1 - F.col("p"))).alias("c"))
    p, g = F.col("p"), F.coalesce(F.col("dose"), 2 * F.col("p"))
    cells = geno.join(samples.select("sample_idx", "frame"), "sample_idx").join(frame, ["frame", "locus_idx"])
    cell = F.struct(F.col("locus_idx").cast("long").alias("l"), (g / F.sqrt(2 * p * (1 - p))).alias("x"))
    own = cells.groupBy(F.col("frame").cast("string").alias("frame"), "sample_idx").agg(F.sum(g / (1 - p)).alias("a"), F.collect_list(cell).alias("cells"))
    rows = gram.placed(samples).join(own, ["frame", "sample_idx"], "left")
    none = F.expr("cast(array() as array<struct<l: bigint, x: double>>)")
    rows = rows.select("frame", "sample_idx", "i", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("cells", none).alias("cells")).checkpoint()  # read for its size, too
    return gram.sides(rows, zero)


def _pairs(strips: Iterator[gram.Strip]) -> Iterator[pa.RecordBatch]:
    for s in strips:
        for i, j in enumerate(s.rows):
            # a row's pairs: those of a strip would be many at once
            some = np.ones(len(s.columns), bool) if s.mask is None else s.mask[i]
            n = int(some.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([s.frame]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, j)), pa.array(s.columns[some]), pa.array(s.values[i][some]), pa.array(np.full(n, s.loci))], ["frame", "sample_i", "sample_j", "kinship", "n_loci"])


def kinship_pairs(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """(frame, sample_i, sample_j, kinship, n_loci) of all pairs i < j within a frame. The pairs themselves are the result, so their number is the square
    of a frame's size; what only needs figures of them has kinship_summary and those below. Needs a checkpoint folder."""
    return gram.reduced(kinship_sides(geno, samples, frame), _pairs, "frame string, sample_i long, sample_j long, kinship double, n_loci long")


#: Kinships above which pairs are counted.
ABOVE = (0.125, 0.25)


def _summed(above: tuple[float, ...], digits: int | None = None):
    """Count, mean, squares about the mean, range and numbers above each bound of a strip's pairs, which are rounded first where digits are given."""

    def work(strips: Iterator[gram.Strip]) -> Iterator[pa.RecordBatch]:
        for s in strips:
            if len(x := s.pairs()):
                mean = x.mean()
                y = x if digits is None else np.round(x, digits)
                figures = [len(x), mean, ((x - mean) ** 2).sum(), x.min(), x.max(), [int((y > t).sum()) for t in above]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([s.frame, *figures], [pa.string(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.int64())], strict=True)], ["frame", "n", "mean", "squares", "least", "most", "above"])

    return work


def kinship_figures(sides: DataFrame, above: tuple[float, ...], by: list[str], digits: int | None = None) -> DataFrame:
    """(by, n, mean, sd, least, most, above_0, ...) of all pairs; `by` is the frame or nothing."""
    parts = gram.reduced(sides, _summed(above, digits), "frame string, n long, mean double, squares double, least double, most double, above array<long>").checkpoint()  # a row a strip
    means = parts.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    both = parts.join(means, by) if by else parts.crossJoin(F.broadcast(means))  # without groups, of one row
    off = F.col("mean") - F.col("_mean")
    n = F.sum("n")
    squares = F.sum(F.col("squares") + F.col("n") * off * off)
    return both.groupBy(*by).agg(n.alias("n"), F.first("_mean").alias("mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).alias("sd"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.coalesce(F.sum(F.col("above")[i]), F.lit(0)).alias(f"above_{i}") for i in range(len(above))])


def kinship_summary(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """(frame, n_pairs, mean, sd, least, most, n_above_0125, n_above_025) of each frame's pairs, which are reduced where they arise. Needs a checkpoint folder."""
    out = kinship_figures(kinship_sides(geno, samples, frame), ABOVE, ["frame"])
    return out.select("frame", F.col("n").alias("n_pairs"), "mean", "sd", "least", "most", F.col("above_0").alias("n_above_0125"), F.col("above_1").alias("n_above_025"))


def _by_sample(strips: Iterator[gram.Strip]) -> Iterator[pa.RecordBatch]:
    """Sums and largest of each sample's pairs: of a strip's rows at once, of its columns when their two sides end."""
    total = most = None
    out = lambda s, ids, n, t, m: pa.RecordBatch.from_arrays([pa.array([s.frame] * len(ids), pa.string()), pa.array(ids), pa.array(np.broadcast_to(n, len(ids)).astype(np.int64)), pa.array(t), pa.array(m)], ["frame", "sample_idx", "n", "total", "most"])
    for s in strips:
        if total is None:
            total, most, count = np.zeros(len(s.columns)), np.full(len(s.columns), -np.inf), np.zeros(len(s.columns), np.int64)
        values, high = (s.values, s.values) if s.mask is None else (np.where(s.mask, s.values, 0.0), np.where(s.mask, s.values, -np.inf))
        yield out(s, s.rows, len(s.columns) if s.mask is None else s.mask.sum(axis=1), values.sum(axis=1), high.max(axis=1))
        total += values.sum(axis=0)
        most = np.maximum(most, high.max(axis=0))
        count += len(s.rows) if s.mask is None else s.mask.sum(axis=0)
        if s.last:
            yield out(s, s.columns, count, total, most)
            total = None


def kinship_by_individual(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """(frame, sample_idx, mean_kinship, max_kinship) over a sample's pairs; a sample alone in its frame has no row. Needs a checkpoint folder."""
    parts = gram.reduced(kinship_sides(geno, samples, frame), _by_sample, "frame string, sample_idx long, n long, total double, most double").where("n > 0")
    return parts.groupBy("frame", "sample_idx").agg((F.sum("total") / F.sum("n")).alias("mean_kinship"), F.max("most").alias("max_kinship"))


#: Bins of a bracket of values, and values that are sorted at last.
BINS, KEPT = 1 << 16, 1 << 22


def _inside(x: np.ndarray, path: list[tuple[float, float, int]]) -> np.ndarray:
    for low, high, at in path:
        x = x[_bin(x, low, high) == at]
    return x


def _bin(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The bin between low and high, which never falls as x grows."""
    return np.clip((x - low) * (BINS / (high - low)), 0, BINS - 1).astype(np.int32)


def _binned(paths: list, brackets: list):
    def work(strips: Iterator[gram.Strip]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(paths), BINS), np.int64)
        for s in strips:
            x = s.pairs()
            for i, (path, (low, high)) in enumerate(zip(paths, brackets, strict=True)):
                counts[i] += np.bincount(_bin(_inside(x, path), low, high), minlength=BINS)
        at, bins = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(counts[at, bins])], ["bracket", "bin", "k"])

    return work


def _taken(paths: list):
    def work(strips: Iterator[gram.Strip]) -> Iterator[pa.RecordBatch]:
        for s in strips:
            x = s.pairs()
            for i, path in enumerate(paths):
                if len(some := _inside(x, path)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some)], ["bracket", "x"])

    return work


def kinship_quantiles(sides: DataFrame, n: int, least: float, most: float, points: tuple[float, ...]) -> dict[float, float | None]:
    """Exact quantiles, interpolated between neighbours, of n pairs' values from least to most, without a list of them: counts in bins say in which bins the
    wanted ranks are, these are counted in finer bins, and when few values are left there they are sorted. Pairs are made anew each time, so sides must not
    change: a checkpoint."""
    if not n:
        return dict.fromkeys(points)
    at = {q: q * (n - 1) for q in points}
    ranks = sorted({int(f(v)) for v in at.values() for f in (np.floor, np.ceil)})
    # each rank is in a bracket: what leads to it, how many values are before it, and its ends
    found: dict[int, float] = {r: least for r in ranks} if most <= least else {}
    open_ = {r: ((), 0, n, least, most) for r in ranks if r not in found}
    while open_:
        paths = list(dict.fromkeys(v[0] for v in open_.values()))
        if sum({v[0]: v[2] for v in open_.values()}.values()) <= KEPT:
            rows = gram.reduced(sides, _taken(paths), "bracket int, x double")
            wanted = F.array(*[F.struct(F.lit(paths.index(v[0])).alias("bracket"), F.lit(r - v[1] + 1).alias("place"), F.lit(r).alias("rank")) for r, v in open_.items()])
            wanted = sides.sparkSession.range(1).select(F.explode(wanted).alias("w")).select("w.*")
            placed = rows.withColumn("place", F.row_number().over(W.partitionBy("bracket").orderBy("x")))
            found |= {r["rank"]: r["x"] for r in placed.join(F.broadcast(wanted), ["bracket", "place"]).collect()}  # two rows a quantile
            break
        ends = {v[0]: v[3:] for v in open_.values()}
        bins = gram.reduced(sides, _binned([list(p) for p in paths], [ends[p] for p in paths]), "bracket int, bin int, k long").groupBy("bracket", "bin").agg(F.sum("k").alias("k"))
        bins = bins.withColumn("before", F.sum("k").over(W.partitionBy("bracket").orderBy("bin")) - F.col("k")).checkpoint()  # BINS rows a bracket
        some = F.lit(False)
        for r, v in open_.items():
            some = some | ((F.col("bracket") == paths.index(v[0])) & (F.col("before") <= r - v[1]) & (F.col("before") + F.col("k") > r - v[1]))
        rows = bins.where(some).collect()  # a row a rank
        for r, (path, before, _, low, high) in list(open_.items()):
            (row,) = (x for x in rows if x["bracket"] == paths.index(path) and x["before"] <= r - before < x["before"] + x["k"])
            width = (high - low) / BINS
            a, b = low + width * row["bin"], low + width * (row["bin"] + 1)
            if width <= 1e-14 * max(abs(low), abs(high)):
                found[r] = (a + b) / 2  # equal but for rounding
                del open_[r]
            else:
                open_[r] = ((*path, (low, high, row["bin"])), before + row["before"], row["k"], a, b)
    share = lambda v: v - np.floor(v)
    return {q: float((1 - share(v)) * found[int(np.floor(v))] + share(v) * found[int(np.ceil(v))]) for q, v in at.items()}


#: The percentiles of a null.
TAILS = (0.05, 0.5, 0.95, 0.99, 0.999)


def kinship_percentiles(geno: DataFrame, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """null_percentiles of the kinship of all frames' pairs, of which no list is made. Needs a checkpoint folder."""
    sides = kinship_sides(geno, samples, frame).checkpoint()
    whole = kinship_figures(sides, (), []).first()
    n, least, most = whole["n"] or 0, whole["least"], whole["most"]
    at = kinship_quantiles(sides, n, least, most, TAILS)
    names = ["n", *[tail_name(q) for q in TAILS], "most"]
    return sides.sparkSession.createDataFrame([(n, *at.values(), most)], ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in names))


def tail_name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def at_quantiles(values: DataFrame, value: str, points: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, q, x): exact quantiles, interpolated between neighbours, nulls apart; no row where there are no values.

    All values are sorted over the cluster by ranges; a row's rank is its place in its partition behind the sizes of those before, so no
    task holds a group, and what is kept are two rows a quantile. Needs a checkpoint folder."""
    by = by or []
    rows = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    rows = rows.repartitionByRange(*by, "_x").sortWithinPartitions(*by, "_x").withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))  # a row a group and partition
    group = W.partitionBy(*(by or [F.lit(1)]))
    sizes = sizes.withColumn("_n", F.sum("_rows").over(group)).withColumn("_before", F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows"))
    wanted = sizes.withColumn("_q", F.explode(F.array(*map(F.lit, points)))).withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    wanted = wanted.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows")))
    wanted = wanted.select("_q", "_at", "_rank", *by, (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_id"))
    found = rows.select("_id", "_x").join(wanted, "_id")
    share = F.when(F.col("_rank") == F.col("_at"), 1.0).otherwise(1 - F.abs(F.col("_rank") - F.col("_at")))
    return found.groupBy(*by, F.col("_q").alias("q")).agg(F.sum(share * F.col("_x")).alias("x"))


def null_percentiles(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact percentiles 5, 50, 95, 99 and 99.9, and the largest."""
    points = TAILS
    by = by or []
    sides = values.groupBy(*by).agg(F.count(value).alias("n"), F.max(value).alias("most"))
    names = {q: tail_name(q) for q in points}
    wide = at_quantiles(values, value, points, by).groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("x"))).alias(name) for q, name in names.items()])
    both = sides.join(wide, by, "left") if by else sides.crossJoin(F.broadcast(wide))  # without groups, of one row each
    return both.select(*by, "n", *names.values(), "most")


def against_null(focal: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """(n, mean, null_mean, p, n_above_p95, n_above_p99): values of the focal pairs, by sides, against those of the draws' null: how many draws reach the focal mean,
    and how many focal values are above the null's percentiles. null has (draw, value). Needs a checkpoint folder."""
    null = null.select("draw", value).checkpoint()  # read for each of its figures
    ends = null_percentiles(null, value).first()
    bounds = tuple(float("inf") if ends[c] is None else round(ends[c], 9) for c in ("p95", "p99"))
    out = kinship_figures(focal, bounds, [], digits=9).select(F.coalesce("n", F.lit(0)).alias("n"), "mean", F.col("above_0").alias("n_above_p95"), F.col("above_1").alias("n_above_p99")).checkpoint()
    by_draw = null.groupBy("draw").agg(F.avg(value).alias("x"))
    p = by_draw.agg(F.avg((F.round("x", 9) >= F.round(out.select("mean").scalar(), 9)).cast("int"))).scalar()
    return out.withColumns({"null_mean": null.agg(F.avg(value)).scalar(), "p": p})


def percentile_ranks(values: DataFrame, value: str, focal: Column) -> DataFrame:
    """values of the focal rows with `pct_rank`, the share of all other rows that are below, and `n_reaching`, how many of those reach it.

    Equal values are counted once with their number, so that ranks need one row a distinct value."""
    x = F.round(F.col(value), 9)
    others = values.where(~focal & F.col(value).isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("k"))
    mine = values.where(focal & F.col(value).isNotNull()).select(x.alias("x")).distinct().withColumn("k", F.lit(0))
    steps = others.union(mine).groupBy("x").agg(F.sum("k").alias("k"))
    total = others.agg(F.coalesce(F.sum("k"), F.lit(0))).scalar()
    below = steps.withColumn("below", F.coalesce(F.sum("k").over(W.partitionBy(F.lit(1)).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranks = below.select(F.col("x").alias("_x"), ratio("below", total).alias("pct_rank"), (total - F.col("below")).alias("n_reaching"))
    return values.where(focal).withColumn("_x", x).join(ranks, "_x", "left").drop("_x")


def against_matched(focal: DataFrame, null: DataFrame) -> DataFrame:
    """Focal pairs' values against all those of the null together, both by sides, one row: how many are above its 95 % point and its largest, the share of the null that reaches
    the largest focal value, and how many are above 1/8 and 1/4. No list of pairs is made. Needs a checkpoint folder.

    Values within 1e-9 count as equal. Without a null its columns are null and nothing is above it."""
    focal, null = focal.checkpoint(), null.checkpoint()  # read for each of their figures
    most = kinship_figures(focal, (), []).first()["most"]
    # what is not below it, of values that are multiples of 1e-9
    s = kinship_figures(null, (float("inf") if most is None else round(most, 9) - 5e-10,), [], digits=9).first()
    n = s["n"] or 0
    p95 = kinship_quantiles(null, n, s["least"], s["most"], (0.95,))[0.95]
    out = kinship_figures(focal, (*(float("inf") if x is None else round(x, 9) for x in (p95, s["most"])), *ABOVE), [], digits=9)
    names = ("n_above_p95", "n_above_null", "n_above_0125", "n_above_025")
    out = out.select(F.coalesce("n", F.lit(0)).alias("n_pairs"), "mean", "least", F.col("most").alias("largest"), *[F.col(f"above_{i}").alias(c) for i, c in enumerate(names)])
    reach = s["above_0"] / n if n and most is not None else None
    return out.withColumns({"null_n": F.lit(n).cast("long"), **{c: F.lit(v).cast("double") for c, v in (("null_mean", s["mean"]), ("null_sd", s["sd"]), ("p_largest", reach))}})


def ranges(values: DataFrame, value: str, focal: str) -> DataFrame:
    """One row of focal values against all others (focal is a boolean column): both ranges and means, focal values below and above all others, others
    below the largest focal value, the per cent of others below the focal mean, and the others' 95 % point. Nulls apart; values within 1e-9
    count as equal. Needs a checkpoint folder."""
    x, mine = F.round(F.col(value), 9), F.col(focal)
    both = values.where(x.isNotNull()).select(x.alias("_x"), F.col(value).cast("double").alias("_v"), mine.alias("_f")).checkpoint()  # read for each of its figures
    side = lambda f, ok: f(F.when(ok, F.col("_v")))
    own, other = F.col("_f"), ~F.col("_f")
    s = both.agg(*[side(f, ok).alias(f"{who}_{name}") for who, ok in (("focal", own), ("other", other)) for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))], F.count_if(other).alias("n_other"))
    at = s.select(*[F.round(c, 9).alias(c) for c in ("focal_max", "focal_mean", "other_min", "other_max")])
    bound = {c: at.select(c).scalar() for c in at.columns}
    counts = both.agg(
        F.count_if(own & (F.col("_x") < bound["other_min"])).alias("n_below_others"), F.count_if(own & (F.col("_x") > bound["other_max"])).alias("n_above_others"),
        F.count_if(other & (F.col("_x") < bound["focal_max"])).alias("n_others_below_max"), F.count_if(other & (F.col("_x") < bound["focal_mean"])).alias("_below"),
    )
    p95 = at_quantiles(both.where(other), "_v", (0.95,)).agg(F.max("x").alias("other_p95"))
    out = s.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(p95))  # of one row each
    return out.withColumn("pct_below_mean", 100 * ratio("_below", "n_other")).drop("_below", "n_other")
