"""Token counts of documents in flat token files without an index: a separator scan over blocks, stitched by a prefix scan."""

from __future__ import annotations

import base64
import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.llm.common import saved

BLOCK_BYTES = 1 << 20
#: Bytes of token files a task scans, and blocks of a run of the prefix scan.
TASK_BYTES = 64 << 20
SPAN = 1024
#: Where the public tokenizers' vocabularies are installed; a parameter of the query.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256


# ---------------------------------------------------------------- writing token files


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:  # a local file of every machine, as libraries are
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_bytes(tokenizer: str = TOKENIZER, width: int = 2):
    """A function of a text column: its token ids as little-endian integers of `width` bytes; null: none."""

    @F.arrow_udf("binary")
    def encode(text: pa.Array) -> pa.Array:
        encoding = _encoding(tokenizer)
        out = [np.array(encoding.encode_ordinary(t.as_py() or ""), f"<u{width}").tobytes() for t in text]
        return pa.array(out, pa.binary())

    return encode


def write_token_files(documents: DataFrame, path: str, text: str = "text", tokenizer: str = TOKENIZER, end: int = END, width: int = 2) -> None:
    """Flat token files, one a partition: each document's ids and the end-of-document id behind them, and nothing else."""
    tokens = documents.select(token_bytes(tokenizer, width)(F.col(text)).cast("string").alias("value"))
    # the text writer copies bytes as they are and ends each row with its line separator
    separator = int(end).to_bytes(width, "little").decode("latin-1")
    tokens.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def places(documents: DataFrame, *columns: str) -> DataFrame:
    """(columns, file_no, ordinal): where write_token_files puts each row of the same DataFrame, which must read files in a fixed order, as a scan does.

    Right only if its scan is cut into the same partitions as that of the write, which depends on the executors at that time: see write_with_places."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return documents.select(*columns, F.spark_partition_id().alias("file_no"), row.alias("ordinal"))


@contextlib.contextmanager
def _same_splits(spark: SparkSession):
    """Scans of the same files are cut alike meanwhile, whether executors come or go: the number of partitions that Spark aims at is fixed once."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def write_with_places(documents: DataFrame, path: str, *columns: str, **options) -> DataFrame:
    """write_token_files, and the table of places (columns, file_no, ordinal), written in the same go with the same partitions, so that what comes later, such as
    another parallelism, cannot part them. Options are those of write_token_files."""
    with _same_splits(documents.sparkSession):
        write_token_files(documents, path, **options)
        return saved(places(documents, *columns), "places")


def with_columns(found: DataFrame, at: DataFrame) -> DataFrame:
    """Documents found by document_tokens in files of write_with_places with the columns of their places; a document without a place, or a place
    without a document, is an error."""
    found = found.withColumns({"file_no": F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "_found": F.lit(True)})
    both = found.join(at.withColumn("_placed", F.lit(True)), ["file_no", "ordinal"], "full")
    whole = F.when(F.col("_found") & F.col("_placed"), F.lit(True)).otherwise(F.raise_error(F.lit("token files and places do not fit each other")).cast("boolean"))
    return both.where(whole).drop("_found", "_placed")


# ---------------------------------------------------------------- scanning


@functools.cache
def _file_system(root: str):
    return pafs.FileSystem.from_uri(root)


def _read_range(path: str, start: int, length: int) -> memoryview:
    """Bytes of a file by its Spark path: only this range is read."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        files, name = pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        host, _, inner = rest.removeprefix("//").partition("/")
        files, top = _file_system(f"{scheme}://{host}/")
        name = f"{top.rstrip('/')}/{inner}"
    with files.open_input_file(name) as file:
        return memoryview(file.read_at(length, start))


#: File systems of which a Python task can read a range; of others Spark reads files whole.
RANGED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _scan(raw, end: int, width: int) -> tuple[int, np.ndarray]:
    ids = np.frombuffer(raw, f"<u{width}")  # an error where a file ends within an id
    return len(ids), np.flatnonzero(ids == end).astype(np.int32)


_FOUND = "file string, block int, is_last boolean, n long, ends array<int>"


def _scanned(file, block, is_last, n: int, ends: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([is_last]), pa.array([n], pa.int64()), lists], ["file", "block", "is_last", "n", "ends"])


def _range_scan(end: int, width: int, block_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                raw = _read_range(x["file"], x["block"] * block_bytes, x["bytes"])
                yield _scanned(x["file"], x["block"], x["is_last"], *_scan(raw, end, width))

    return scan


def _block_scan(end: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, is_last, raw in zip(*(batch[c] for c in ("file", "block", "is_last", "raw")), strict=True):
                yield _scanned(file.as_py(), block.as_py(), is_last.as_py(), *_scan(raw.as_buffer(), end, width))

    return scan


def document_tokens(spark: SparkSession, path: str, end: int = END, width: int = 2, block_bytes: int = BLOCK_BYTES, pattern: str = "*") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the files under path, counted from 0 in each file.

    A document is what stands before an end id, without it; two ends in a row make one of no tokens. Tokens behind a file's last end are a
    document that is not closed; an empty file has none. Every block is searched by itself, by a task that reads only its range of bytes, so
    files may have any size and a large one is spread over all tasks. A prefix scan in two levels, within runs of SPAN blocks and over the runs
    of a file, gives the number of ends before a block and where its first document began. Blocks hold whole ids; a file
    whose length is no multiple of the width is an error. On a file system outside RANGED, Spark's reader takes files whole, up to 2 GB each.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).where("length > 0")
    last = F.floor((F.col("length") - 1) / block_bytes).cast("int")
    listed = files.select("path", "length")
    total, schemes = listed.agg(F.sum("length"), F.collect_set(F.regexp_extract("path", "^([A-Za-z0-9+.-]*):", 1))).first()
    blocks = F.explode(F.sequence(F.lit(0), last)).alias("block")
    is_last = (F.col("block") == F.col("last")).alias("is_last")
    if set(schemes) <= set(RANGED):
        blocks = listed.select(F.col("path").alias("file"), "length", last.alias("last"), blocks)
        size = F.least(F.lit(block_bytes).cast("long"), F.col("length") - F.col("block").cast("long") * block_bytes)
        tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))
        blocks = blocks.select("file", "block", is_last, size.alias("bytes")).repartition(tasks, "file", "block")
        found = blocks.mapInArrow(_range_scan(end, width, block_bytes), _FOUND)
    else:
        blocks = files.select(F.col("path").alias("file"), "content", last.alias("last"), blocks)
        raw = F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes))
        found = blocks.select("file", "block", is_last, raw.alias("raw")).mapInArrow(_block_scan(end, width), _FOUND)

    per = block_bytes // width
    first = F.col("block").cast("long") * per
    found = found.withColumns({
        "span": F.floor(F.col("block") / SPAN).cast("int"),
        "begins": F.when(F.size("ends") > 0, first + F.element_at("ends", -1) + 1),  # where the document behind the block's last end begins
    })
    found = saved(found, "blocks")

    def running(df: DataFrame, keys: list[str], by: str, count, name: str) -> DataFrame:
        """Ends before each row of its key, and the last place where a document begins there."""
        before = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({f"{name}_ends": F.coalesce(F.sum(count).over(before), F.lit(0)), f"{name}_begins": F.max("begins").over(before)})

    spans = found.groupBy("file", "span").agg(F.sum(F.size("ends")).alias("count"), F.max("begins").alias("begins"))
    spans = running(spans, ["file"], "span", F.col("count"), "span").select("file", "span", "span_ends", "span_begins")
    found = running(found, ["file", "span"], "block", F.size("ends"), "block").join(spans, ["file", "span"])
    found = found.withColumn("ordinal", F.col("span_ends") + F.col("block_ends")).withColumn("begun", F.coalesce("block_begins", "span_begins", F.lit(0)))
    # an unclosed document ends with its file
    stop = F.when(F.col("is_last"), F.array(F.struct((first + F.col("n")).alias("stop"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<stop:bigint,closed:boolean>>"))
    stops = F.concat(F.transform("ends", lambda e: F.struct((first + e).alias("stop"), F.lit(True).alias("closed"))), stop)
    docs = found.select("file", "ordinal", "begun", stops.alias("stops")).select("file", "ordinal", "begun", "stops", F.posexplode("stops").alias("k", "s"))
    start = F.when(F.col("k") == 0, F.col("begun")).otherwise(F.get("stops", F.col("k") - 1)["stop"] + 1)
    docs = docs.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("s.stop") - start).alias("n_tokens"), F.col("s.closed").alias("closed"))
    return docs.where("closed or n_tokens > 0")
