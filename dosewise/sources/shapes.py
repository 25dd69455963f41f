"""Shapefiles as a Spark source: `spark.read.format("shapes").load("….shp")` after `register(spark)`.

A partition is a run of records whose bytes the index file names, so that tasks read ranges of one file. Filters on the bounding box are
applied to a record's first bytes, before its points are parsed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Records of a partition.
PART_RECORDS = 4096
#: Fixed values of the format: lengths of the file header, an index entry and a record header; shape kinds that are points, or have points
#: without parts (the last two also come with z or m values behind, which are not read).
HEADER, ENTRY, RECORD = 100, 8, 8
POINTS, MULTIPOINTS = (1, 11, 21), (8, 18, 28)

SCHEMA = "record long, kind int, x0 double, y0 double, x1 double, y1 double, parts array<int>, xs array<double>, ys array<double>, attributes map<string,string>"
ARROW = pa.schema([("record", pa.int64()), ("kind", pa.int32()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")], ("parts", pa.list_(pa.int32())), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("attributes", pa.map_(pa.string(), pa.string()))])

_TESTS = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__", EqualTo: "__eq__"}


class _File:
    """Bytes of a file of any file system that pyarrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def size(self) -> int:
        info = self.system.get_file_info(self.path)
        return info.size if info.is_file else -1

    def read(self, start: int, size: int) -> bytes:
        with self.system.open_input_file(self.path) as f:
            return f.read_at(size, start)


def _beside(path: str, suffix: str) -> str:
    return path[: -len(".shp")] + suffix if path.lower().endswith(".shp") else path + suffix


class _Range(InputPartition):
    def __init__(self, first: int, records: int):
        super().__init__((first, records))
        self.first, self.records = first, records


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_records: int):
        self.path, self.part_records, self.tests = path, part_records, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("x0", "y0", "x1", "y1") and isinstance(f.value, (int, float)):
                self.tests.append(("xyxy".index(f.attribute[0][0]) + 2 * int(f.attribute[0][1]), _TESTS[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        size = _File(_beside(self.path, ".shx")).size()
        if size < HEADER:
            raise FileNotFoundError(f"{self.path} needs its index file, .shx")
        n = (size - HEADER) // ENTRY
        return [_Range(a, min(self.part_records, n - a)) for a in range(0, n, self.part_records)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records
            return
        index = np.frombuffer(_File(_beside(self.path, ".shx")).read(HEADER + ENTRY * partition.first, ENTRY * partition.records), ">i4").reshape(-1, 2).astype(np.int64) * 2  # 16-bit words
        start, end = int(index[:, 0].min()), int((index[:, 0] + RECORD + index[:, 1]).max())
        data = _File(self.path).read(start, end - start)
        rows, attributes = [], _attributes(_beside(self.path, ".dbf"), partition)
        for i, (at, size) in enumerate(index.tolist()):
            body = memoryview(data)[at - start + RECORD : at - start + RECORD + size]
            if (row := parsed(body, self.tests)) is not None:
                rows.append((partition.first + i, *row, attributes[i]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def parsed(body: memoryview, tests: list[tuple[int, str, float]]) -> tuple | None:
    """(kind, box, parts, xs, ys) of a record's content; None where the box fails a test, and then nothing behind the box is looked at. A null shape has
    neither box nor points, and fails every test."""
    (kind,) = struct.unpack_from("<i", body)
    if kind == 0:
        return None if tests else (0, None, None, None, None, [], [], [])
    box = struct.unpack_from("<2d", body, 4) * 2 if kind in POINTS else struct.unpack_from("<4d", body, 4)
    if not all(getattr(box[place], test)(value) for place, test, value in tests):
        return None
    if kind in POINTS:
        return (kind, *box, [0], [box[0]], [box[1]])
    if kind in MULTIPOINTS:
        (n_points,), parts, at = struct.unpack_from("<i", body, 36), [0], 40
    else:
        n_parts, n_points = struct.unpack_from("<2i", body, 36)
        parts, at = list(struct.unpack_from(f"<{n_parts}i", body, 44)), 44 + 4 * n_parts
    xy = np.frombuffer(body, "<f8", 2 * n_points, at).reshape(-1, 2)
    return (kind, *box, parts, xy[:, 0], xy[:, 1])


def _attributes(path: str, partition: _Range) -> list[list[tuple[str, str | None]]]:
    """The attribute table's fields of a partition's records, as trimmed text; none where there is no such file."""
    file = _File(path)
    if file.size() < 32:
        return [[] for _ in range(partition.records)]
    header_size, record_size = struct.unpack("<2H", file.read(8, 4))
    header = file.read(0, header_size)
    fields, at = [], 1  # a record begins with a mark
    for k in range(32, header_size - 1, 32):
        if header[k] == 0x0D:
            break
        fields.append((header[k : k + 11].split(b"\0")[0].decode("utf-8", "replace"), at, header[k + 16]))
        at += header[k + 16]
    data = file.read(header_size + record_size * partition.first, record_size * partition.records)
    text = lambda i, a, n: data[i * record_size + a : i * record_size + a + n].decode("utf-8", "replace").strip(" \0") or None
    return [[(name, text(i, a, n)) for name, a, n in fields] for i in range(partition.records)]


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partRecords", PART_RECORDS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shapes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def shapes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, part_records: int = PART_RECORDS) -> DataFrame:
    """SCHEMA: a row a record, numbered from 0; with a box (x0, y0, x1, y1), of those alone whose own box has a point in common with it."""
    register(spark)
    out = spark.read.format("shapes").option("partRecords", part_records).load(path)
    if box is None:
        return out
    x0, y0, x1, y1 = map(float, box)
    return out.where((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1))


def rings(shapes: DataFrame) -> DataFrame:
    """(record, ring, points): each part of each record as an array of x, y."""
    end = F.coalesce(F.try_element_at(F.col("parts"), F.col("ring") + 2), F.size("xs"))
    parts = shapes.select("*", F.posexplode("parts").alias("ring", "from"))
    cut = lambda c: F.slice(c, F.col("from") + 1, end - F.col("from"))
    return parts.select("record", "ring", F.zip_with(cut("xs"), cut("ys"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("points"))


def edges(rings: DataFrame, shape: str | Column = "record", points: str = "points") -> DataFrame:
    """(shape, ax, ay, bx, by): a row for each side of rings given as arrays, which close themselves."""
    key = F.col(shape) if isinstance(shape, str) else shape
    p = F.col(points)
    sides = F.arrays_zip(p.alias("a"), F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)).alias("b"))
    return rings.where(F.size(p) > 0).select(key.alias("shape"), F.explode(sides).alias("e")).select("shape", *[F.col(f"e.{s}.{c}").alias(s + c) for s in "ab" for c in "xy"])
