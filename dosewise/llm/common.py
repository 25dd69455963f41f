"""What the corpus operators share: shared storage, byte-level words and hashes, components."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Rows of (id, id) that may be broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="dosewise-")  # driver and executors are one process
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs one task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if (on_the_way := _ON_THE_WAY.get()) is not None:
        on_the_way.append(out)
    return out


#: The tables saved within the innermost call of `settled`.
_ON_THE_WAY: contextvars.ContextVar[list | None] = contextvars.ContextVar("on_the_way", default=None)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """saved(make(), name); the tables that were saved on the way to it are deleted, for nothing else can read them."""
    token = _ON_THE_WAY.set([])
    try:
        out = saved(make(), name)
        on_the_way = _ON_THE_WAY.get()
    finally:
        _ON_THE_WAY.reset(token)
    dropped(*(t for t in on_the_way if t is not out))
    if (outer := _ON_THE_WAY.get()) is not None:
        outer.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, so that they do not hold disk until the session ends."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: a batch of 10,000 rows has no bound where texts are long. A smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (of a few numbers); else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes, words, hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    up, down = _powers(1 << max(12, int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Consecutive texts as one run of bytes: text i holds buf[offsets[i]:offsets[i + 1]]; a null is empty."""

    def __init__(self, first: int, offsets: np.ndarray, buf: np.ndarray):
        self.first, self.offsets, self.buf, self.n = first, offsets, buf, len(offsets) - 1

    def words(self, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words (runs without space or \\t-\\r, or without the bytes marked in `between`), and where each text's words begin."""
        space = between[self.buf]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.buf))]
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[cuts], after[cuts - 1] = True, True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words with A-Z lower-cased, and where each text's words begin."""
        starts, ends, first = self.words()
        return span_hashes(_LOWER[self.buf], starts, ends), first


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[Texts]:
    """A string column in steps of a bounded number of bytes; a longer text is a step of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    kinds = np.int64 if wide else np.int32
    _, raw, data = texts.buffers()
    at = np.frombuffer(raw, kinds, count=len(texts) + 1, offset=texts.offset * np.dtype(kinds).itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may still span bytes
        texts = texts.fill_null("")
        yield from steps(texts, most)
        return
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Texts(i, at[i : j + 1] - at[i], bytes_[at[i] : at[j]])
        i = j


def word_counts(texts: pa.Array) -> pa.Array:
    """Number of words of each text; null has none."""
    parts = [np.diff(t.words()[2]) for t in steps(texts)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[buf]


def marked(chars: bytes) -> np.ndarray:
    """A table of all bytes that is true at those given."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def spans_text(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_row: int = 1) -> pa.Array:
    """A string a row from the bytes of per_row spans each, one behind the other."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = buf[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts) // per_row, [None, pa.py_buffer(at[::per_row].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def listed(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# ---------------------------------------------------------------- filters of a bounded size

#: log2 of the bits of a filter that is sent to all tasks: from 1 to 8 MB, eight bits a hash while they suffice.
FILTER_BITS = (23, 26)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """The bits, by the low bits of each, of the hashes in the column `hash`; false hits are left to a join on whole hashes."""
    least, most = FILTER_BITS
    size = min(most, max(least, (8 * hashes.count()).bit_length()))
    cell = f"hash & {(1 << size) - 1}"
    # one row a byte: at most 2**size / 8 come to the driver
    bytes_ = hashes.selectExpr(f"cast(shiftright({cell}, 3) as int) AS byte", f"shiftleft(1, cast({cell} & 7 as int)) AS bit").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 3), np.uint8)
    bits[bytes_["byte"].to_numpy()] = bytes_["bits"].to_numpy()
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where uint64 hashes may be among those of the filter."""
    cell = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in edges, comp the smallest id of its component.

    Large-star and small-star steps by turns until nothing changes; each round is a saved table that replaces the last, and only
    counts reach the driver. A hub costs pre-aggregated rows in the groupings; in the joins, least neighbours are broadcast while
    there are few, and else saved first, so that adaptive execution can split a hub's partition.
    Null ends, loops and repeated edges are ignored; without edges the result is empty.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges"
    )
    few, before = now.count() <= BROADCAST_ROWS, None
    while True:
        least = lambda links: F.broadcast(links) if few else saved(links, "least")
        both = now.union(now.select("v", "u"))  # large-star: larger neighbours link to the smallest around u
        around = least(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(around, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else saved(large, "large")
        below = least(large.groupBy("u").agg(F.min("v").alias("m")))  # small-star: smaller neighbours and u link to the smallest
        small = large.join(below, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m")
        after = saved(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        dropped(now, *(t for t in (around, large, below) if hasattr(t, "saved_at")))
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return ids.union(now.select(F.col("v").alias("id"), F.col("v").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))
