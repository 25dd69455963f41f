"""Products of all pairs of samples: by tiles, whose dense blocks are multiplied within tasks and summed by pair of tiles, or by sides, whose sparse
rows meet in one task each two, which reduces what it makes of their pairs, so that no product is sent anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a tile and loci of a block.
TILE, BLOCK = 256, 256
#: Tasks among which the blocks of one pair of tiles are divided.
SPREAD = 8
#: Bytes of an Arrow batch to Python: a row can be a megabyte.
BATCH_BYTES = 16 << 20

TILES = "frame string, ta long, tb long, na int, nb int, sums array<double>"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def numbered(df: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """df with its rows' numbers from 0 in the order of `by`, which no two rows share: a sort by ranges, then a row's place in its partition behind the
    sizes of those before. Nothing but the partitions' sizes is in one task."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_rows")
    sizes = sizes.select("_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def placed(members: DataFrame) -> DataFrame:
    """(frame, sample_idx, i, size): the samples of each frame numbered from 0 in order; frames are named by text."""
    rows = numbered(members.select(F.col("frame").cast("string").alias("frame"), "sample_idx"), "frame", "sample_idx", name="_at")
    frames = rows.groupBy("frame").agg(F.min("_at").alias("_first"), F.count("*").alias("size"))
    return rows.join(frames, "frame").select("frame", "sample_idx", (F.col("_at") - F.col("_first")).alias("i"), "size")


def _dense(cells: pa.Array, rows: int) -> np.ndarray:
    """A list's cells as a matrix of rows x BLOCK."""
    out = np.zeros((rows, BLOCK))
    out[cells.field("r").to_numpy(), cells.field("c").to_numpy()] = cells.field("x").to_numpy()
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of a pair of tiles that follow each other."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in key[:1]] + [pa.array([x], pa.int64()) for x in key[1:3]] + [pa.array([x], pa.int32()) for x in key[3:]] + [pa.array([total.ravel()], pa.list_(pa.float64()))], ["frame", "ta", "tb", "na", "nb", "sums"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = tuple(batch[c][i].as_py() for c in ("frame", "ta", "tb", "na", "nb"))
            if now != key:
                if key:
                    yield out()
                key, total = now, np.zeros(now[3:])
            total += _dense(batch["a"][i].values, now[3]) @ _dense(batch["b"][i].values, now[4]).T
    if key:
        yield out()


def _added(parts: pa.Table) -> pa.Table:
    total = np.sum([s.values.to_numpy() for s in parts["sums"]], axis=0)
    return parts.slice(0, 1).set_column(parts.schema.get_field_index("sums"), "sums", pa.array([total], pa.list_(pa.float64())))


def tiles(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(frame, ta, tb, na, nb, sums): for each pair of tiles ta <= tb of a frame that has common cells the products of their samples, na x nb by rows.

    cells is (frame, sample_idx, locus_idx, x), absent ones 0, each once; members as placed() gives it. A task holds two dense blocks and one
    sum, whatever a locus's carriers; a tile's cells are sent once for each tile that it meets.
    """
    spark = cells.sparkSession
    bound_batches(spark)
    columns = numbered(cells.select("locus_idx").distinct(), "locus_idx", name="l")
    at = cells.withColumn("frame", F.col("frame").cast("string")).join(members, ["frame", "sample_idx"]).join(columns, "locus_idx")
    tile, block = F.floor(F.col("i") / TILE), F.floor(F.col("l") / BLOCK)
    cell = F.struct((F.col("i") % TILE).cast("int").alias("r"), (F.col("l") % BLOCK).cast("int").alias("c"), F.col("x").cast("double").alias("x"))
    packs = at.groupBy("frame", block.alias("block"), tile.alias("tile")).agg(F.first("size").alias("size"), F.collect_list(cell).alias("cells"))  # TILE x BLOCK cells at most
    packs = packs.withColumn("n", F.least(F.lit(TILE), F.col("size") - F.col("tile") * TILE).cast("int"))
    a, b = (packs.select("frame", "block", F.col("tile").alias(f"t{s}"), F.col("n").alias(f"n{s}"), F.col("cells").alias(s)) for s in "ab")
    pairs = a.join(b, ["frame", "block"]).where("ta <= tb").select("frame", "ta", "tb", "na", "nb", "a", "b", F.pmod("block", F.lit(SPREAD)).alias("part"))
    pairs = pairs.repartition("frame", "ta", "tb", "part").sortWithinPartitions("frame", "ta", "tb")
    return pairs.select("frame", "ta", "tb", "na", "nb", "a", "b").mapInArrow(_products, TILES).groupBy("frame", "ta", "tb").applyInArrow(_added, TILES)


# ---------------------------------------------------------------- pairs by sides

#: Samples of a side at most, and at most where their cells are cut into blocks of loci; cells of a side or block, on average; pairs of a strip.
SIDE, LEAST_SIDE, CELLS, STRIP = 1 << 14, 1 << 10, 1 << 20, 1 << 22
#: A locus at which so large a share of a strip's pairs have common cells is multiplied densely, as are so many such loci at once.
DENSE_SHARE, DENSE_LOCI = 1 / 64, 256


class Strip(NamedTuple):
    """Values of some samples of a side with all of another, rows by columns; `mask` says which are pairs, where not all are; `last` is the last of its two sides."""

    frame: str
    loci: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    mask: np.ndarray | None
    last: bool

    def pairs(self) -> np.ndarray:
        return self.values.ravel() if self.mask is None else self.values[self.mask]


class _Cells(NamedTuple):
    ids: np.ndarray
    own: np.ndarray
    r: np.ndarray
    l: np.ndarray  # in order
    x: np.ndarray

    def of(self, a: int, b: int) -> _Cells:
        some = (self.r >= a) & (self.r < b)
        return _Cells(self.ids[a:b], self.own[a:b], self.r[some] - a, self.l[some], self.x[some])


def sides(samples: DataFrame, zero: DataFrame) -> DataFrame:
    """The cells of each frame's samples, once for every two sides that its sample's side is one of, in the order in which reduced() reads them.

    samples is (frame, sample_idx, i, a, cells): numbered from 0 in a frame, cells an array of (l, x) and empty where there are none; zero is (frame, loci, c).
    A side has as many samples as have CELLS cells on average, SIDE at most; where these would be below LEAST_SIDE, so many, and their loci are dealt to blocks. So a
    sample is sent once for each SIDE samples of its frame: the square of a frame's size is work of the tasks, and on no disk."""
    bound_batches(samples.sparkSession)
    shape = samples.groupBy("frame").agg(F.count("*").alias("m"), F.sum(F.size("cells")).alias("k")).join(zero, "frame")
    each = F.greatest(F.col("k") / F.col("m"), F.lit(1.0))
    shape = shape.withColumn("side", F.least(F.lit(SIDE), F.greatest(F.lit(LEAST_SIDE), F.floor(CELLS / each))))
    shape = shape.select("frame", "loci", "c", "side", F.ceil(F.col("m") / F.col("side")).alias("sides"), F.greatest(F.ceil(F.col("side") * each / CELLS), F.lit(1)).alias("blocks"))
    rows = samples.join(shape, "frame").withColumn("side", F.floor(F.col("i") / F.col("side")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    here = F.when(F.col("blocks") == 1, F.col("cells")).otherwise(F.filter("cells", lambda c: F.pmod(F.xxhash64(c["l"]), F.col("blocks")) == F.col("block")))
    rows = rows.select("frame", F.least("side", "other").alias("ta"), F.greatest("side", "other").alias("tb"), "block", "side", "i", "sample_idx", "a", "loci", "c", "blocks", here["l"].alias("l"), here["x"].alias("x"))
    parts = 4 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # two sides are one task's, whatever their bytes
    return rows.repartition(parts, "frame", "ta", "tb").sortWithinPartitions("frame", "ta", "tb", "block", "side", "i")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Cells, _Cells]]:
    """(frame, ta, tb, block, blocks, loci, c) with both sides' cells, as rows follow each other."""
    key, held = None, []

    def out():
        side, ids, own, count, l, x = (np.concatenate(v) for v in zip(*held, strict=True))  # noqa: E741
        both = []
        for t in dict.fromkeys(key[1:3]):
            at = side == t
            r, some = np.repeat(np.arange(at.sum()), count[at]), np.repeat(at, count)
            order = np.argsort(l[some], kind="stable")
            both.append(_Cells(ids[at], own[at], r[order], l[some][order], x[some][order]))
        return key, both[0], both[-1]

    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch[c].to_numpy(zero_copy_only=False) for c in ("frame", "ta", "tb", "block")]
        ends = [*(np.flatnonzero(np.any([v[1:] != v[:-1] for v in named], axis=0)) + 1).tolist(), batch.num_rows]
        at = 0
        for end in ends:
            now = (named[0][at], *(int(v[at]) for v in named[1:]), *(batch[c][at].as_py() for c in ("blocks", "loci", "c")))
            if key is not None and now[:4] != key[:4]:
                yield out()
                held = []
            some, key = batch.slice(at, end - at), now
            held.append([*(some[c].to_numpy() for c in ("side", "sample_idx", "a")), some["l"].value_lengths().to_numpy(), some["l"].flatten().to_numpy(), some["x"].flatten().to_numpy()])
            at = end
    if key is not None:
        yield out()


def _products_of(a: _Cells, b: _Cells) -> np.ndarray:
    """Products of all samples of a with all of b: at each locus of its carriers, or of all where many are."""
    h, w = len(a.ids), len(b.ids)
    out = np.zeros(h * w)
    first, behind = np.searchsorted(b.l, a.l), np.searchsorted(b.l, a.l, side="right")
    met = behind - first
    # carriers of a cell's locus in a
    mine = np.searchsorted(a.l, a.l, side="right") - np.searchsorted(a.l, a.l)
    many = mine * met > max(h * w * DENSE_SHARE, 1)
    if many.any():
        some = np.unique(a.l[many])
        matrix = out.reshape(h, w)
        for i in range(0, len(some), DENSE_LOCI):
            part = some[i : i + DENSE_LOCI]
            sparse = []
            for side in (a, b):
                at = np.minimum(np.searchsorted(part, side.l), len(part) - 1)
                mine = part[at] == side.l
                dense = np.zeros((len(side.ids), len(part)))
                dense[side.r[mine], at[mine]] = side.x[mine]
                sparse.append(dense)
            matrix += sparse[0] @ sparse[1].T
    few = np.flatnonzero(~many & (met > 0))
    sums = np.cumsum(met[few])
    at = 0
    while at < len(few):  # so many products at once as a strip has pairs, or those of one cell
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + STRIP, side="right")))
        some = few[at:end]
        k = met[some]
        j = np.repeat(first[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        place, value = np.repeat(a.r[some] * w, k) + b.r[j], np.repeat(a.x[some], k) * b.x[j]
        if len(place) * 8 > len(out):
            out += np.bincount(place, weights=value, minlength=len(out))
        else:
            np.add.at(out, place, value)
        at = end
    return out.reshape(h, w)


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[Strip]:
    """(c - a_i - a_j + products) / loci of all pairs i < j."""
    total = None
    for (frame, ta, tb, block, blocks, loci, c), a, b in _runs(batches):
        if blocks > 1:
            total = _products_of(a, b) if block == 0 else total + _products_of(a, b)
            if block < blocks - 1:
                continue
        high = len(a.ids) if blocks > 1 else max(1, STRIP // len(b.ids))
        for r in range(0, len(a.ids), high):
            some = a.of(r, r + high)
            values = total if blocks > 1 else _products_of(some, b)
            values += c - some.own[:, None]
            values -= b.own[None, :]
            values /= loci
            mask = np.arange(len(b.ids))[None, :] > (r + np.arange(len(some.ids)))[:, None] if ta == tb else None
            yield Strip(frame, loci, some.ids, b.ids, values, mask, r + high >= len(a.ids))


def reduced(sides: DataFrame, by: Callable[[Iterator[Strip]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `by` makes of the values of all pairs, strip by strip in tasks."""
    return sides.mapInArrow(lambda batches: by(_strips(batches)), schema)
