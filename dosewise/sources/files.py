"""Files as they are: digests of any size, copies with a manifest, and tables that appear whole or not at all."""

from __future__ import annotations

import functools
import hashlib
import platform
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds at once.
CHUNK = 4 << 20
MANIFEST = "manifest"

# ---------------------------------------------------------------- in tasks


@functools.cache
def _file_system(root: str):
    return pafs.FileSystem.from_uri(root)


def handle(path: str):
    """(file system, name on it) of a Spark path: of this machine where it has no scheme or `file`, else as pyarrow knows it (HDFS, S3, GS, ABFS)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    host, _, inner = rest.removeprefix("//").partition("/")
    files, top = _file_system(f"{scheme}://{host}/")
    return files, f"{top.rstrip('/')}/{inner}"


def _streamed(path: str, to: str | None = None) -> str:
    """SHA-256 of a file, a chunk at a time; with `to` the chunks are written there as they pass."""
    digest = hashlib.sha256()
    files, name = handle(path)
    out = None
    if to is not None:
        there, target = handle(to)
        there.create_dir(target.rpartition("/")[0], recursive=True)
        out = there.open_output_stream(target)
    with files.open_input_stream(name, buffer_size=0) as source:
        while chunk := source.read(CHUNK):
            digest.update(chunk)
            if out is not None:
                out.write(chunk)
    if out is not None:
        out.close()
    return digest.hexdigest()


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        targets = batch["to"].to_pylist()
        found = [_streamed(f, t) for f, t in zip(batch["file"].to_pylist(), targets, strict=True)]
        yield batch.append_column("sha256", pa.array(found, pa.string()))


def _work(files: DataFrame) -> DataFrame:
    """files (file, ..., to) with sha256: each read once by some task, in chunks; large and small ones are dealt over all tasks."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(tasks, 1), "file").mapInArrow(_hashing, f"{kinds}, sha256 string")


# ---------------------------------------------------------------- digests


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, modified) of every file under the paths, empty ones too; contents are not read. Hidden files are left out, as Spark does."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    some = source.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    names = [re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", unquote(n)) for n in source.inputFiles()]  # URIs, as paths
    if some.count() == len(names):
        return some
    # a scan passes over empty files, though its listing has them
    empty = [r["file"] for r in spark.createDataFrame([(n,) for n in names], "file string").join(some, "file", "left_anti").toLocalIterator()]
    rows = []
    for name in empty:
        where, system = _at(spark, name)
        rows.append((name, 0, datetime.fromtimestamp(system.getFileStatus(where).getModificationTime() / 1000, UTC)))
    return some.union(spark.createDataFrame(rows, some.schema))


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, modified, sha256) of every file under the paths, of any size: tasks read them in chunks of a few megabytes."""
    return _work(listed(spark, *paths).withColumn("to", F.lit(None).cast("string"))).drop("to")


def combined(files: DataFrame, *columns: str) -> str:
    """One digest of rows whatever their order: digests of 4,096 parts by hash, each sorted, then one of these; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = files.select(row.alias("row")).groupBy(F.substring("row", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ","), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "d"))), ","), 256)).first()[0]


def provenance(spark: SparkSession, *paths: str, seed: int, begun: float) -> DataFrame:
    """The digests of inputs beside what a run is made of: versions, seed, when it was and the seconds since `begun` (as time.time() gives)."""
    now = time.time()
    return digests(spark, *paths).select(
        "*", F.lit(spark.version).alias("spark"), F.lit(platform.python_version()).alias("python"), F.lit(np.__version__).alias("numpy"), F.lit(pa.__version__).alias("pyarrow"),
        F.lit(seed).alias("seed"), F.timestamp_seconds(F.lit(begun)).alias("begun"), F.lit(round(now - begun, 1)).alias("seconds"),
    )


# ---------------------------------------------------------------- the driver's file system


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine only where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="dosewise-")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return bool(system.exists(where))


def deleted(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return bool(system.delete(where, True))


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder to a name that is free; False, and nothing done, where another is there already. One step where the file system
    renames in one (HDFS, local); on an object store, readers wait for `_SUCCESS`, which is copied with the rest."""
    source, system = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    system.mkdirs(target.getParent())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(source), system.makeQualified(target), how)
    except Exception:
        if system.exists(target):
            return False
        raise
    return True


# ---------------------------------------------------------------- packages


def packaged(spark: SparkSession, outputs: dict[str, str], folder: str) -> DataFrame:
    """Copies of named outputs, files or folders, as folder/name, with a manifest; returns it: (name, file, bytes, sha256), `file` within the package.

    The package appears when all copies are there: it is made beside and renamed. A folder of that name is an error. Each file is read once
    for its copy and its digest; Spark's own markers are left behind."""
    if exists(spark, folder):
        raise FileExistsError(folder)
    making = f"{folder.rstrip('/')}.making-{uuid.uuid4().hex}"
    parts = None
    for name, path in sorted(outputs.items()):
        where, system = _at(spark, path)
        root = system.makeQualified(where).toUri().getPath()
        below = F.substring(F.regexp_replace("file", "^[A-Za-z0-9+.-]+:/*", "/"), len(root.rstrip("/")) + 1, 1 << 20)
        files = listed(spark, path).withColumn("name", F.lit(name)).withColumn("below", F.concat(F.lit(name), below))
        parts = files if parts is None else parts.union(files)
    if parts is None:
        raise ValueError("a package needs an output")
    copied = _work(parts.select("name", "below", "bytes", "file", F.concat(F.lit(making + "/"), "below").alias("to")))
    try:
        copied.select("name", F.col("below").alias("file"), "bytes", "sha256").write.parquet(f"{making}/{MANIFEST}")
        if not moved(spark, making, folder):
            raise FileExistsError(folder)
    except BaseException:
        deleted(spark, making)
        raise
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(file, state): what of a package is `changed`, `missing` or `added` since it was made; no rows if nothing is."""
    known = spark.read.parquet(f"{folder}/{MANIFEST}").select("file", F.col("sha256").alias("was"))
    where, system = _at(spark, folder)
    root = system.makeQualified(where).toUri().getPath().rstrip("/")
    name = F.substring(F.regexp_replace("file", "^[A-Za-z0-9+.-]+:/*", "/"), len(root) + 2, 1 << 20)
    now = digests(spark, folder).select(name.alias("file"), F.col("sha256").alias("now")).where(~F.col("file").startswith(MANIFEST + "/"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("now") != F.col("was"), "changed")
    return known.join(now, "file", "full").select("file", state.alias("state")).where("state is not null")


# ---------------------------------------------------------------- derived tables kept by content


class Catalogue:
    """Derived tables in a folder, each under a key made of its name, its parameters and the digests of the files that it is made from.

    A table whose key is there is read, not made. Digests of inputs are remembered by path, length and time of change, so an unchanged file is read once;
    `trust=False` reads it each time. A table appears when it is whole; of two runs that make the same, the first stays. Nothing is removed by itself."""

    def __init__(self, spark: SparkSession, root: str, trust: bool = True):
        self.spark, self.root, self.trust, self.made = spark, root.rstrip("/"), trust, []

    def input_digest(self, *paths: str) -> str:
        """One digest of the contents and names of all files under the paths."""
        memory = f"{self.root}/digests"
        files = listed(self.spark, *paths).withColumn("to", F.lit(None).cast("string"))
        keys = ["file", "bytes", "modified"]
        if self.trust and exists(self.spark, memory):
            known = self.spark.read.schema("file string, bytes long, modified timestamp, sha256 string").parquet(memory).dropDuplicates(keys)
            new = files.join(known, keys, "left_anti")
        else:
            known, new = None, files
        if not new.isEmpty():
            if self.trust:
                _work(new).drop("to").write.mode("append").parquet(memory)
                known = self.spark.read.parquet(memory).dropDuplicates(keys)
            else:
                known = _work(new).drop("to")
        if known is None:
            known = _work(files).drop("to")
        return combined(files.join(known, keys).select("file", "bytes", "sha256"), "file", "bytes", "sha256")

    def key(self, name: str, inputs: list[str], **parameters) -> str:
        import json

        text = json.dumps([name, self.input_digest(*inputs), parameters], sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    def kept(self, name: str, inputs: list[str], make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The table of this name, inputs and parameters (of JSON's kinds); `make` is called only if it is not there. Change a parameter, such as
        a version, when what `make` does changes: code is not part of the key."""
        path = f"{self.root}/{name}/{self.key(name, inputs, **parameters)}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            making = f"{self.root}/making/{uuid.uuid4().hex}"
            try:
                make().write.parquet(making)
                moved(self.spark, making, path)
            finally:
                deleted(self.spark, making)
            self.made.append(name)
        return self.spark.read.parquet(path)
