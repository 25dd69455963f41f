"""Shapefiles written here and read back, many points in many shapes against brute force, and lines numbered without a driver's pass."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import geometry
from dosewise.plans.queries import checkpointed
from dosewise.sources import reports, shapes


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpointed(spark)


def written(path, bodies, names=None):
    """A shapefile of record contents, its index, and a table of names."""
    at, index, data = 100, b"", b""
    for i, body in enumerate(bodies):
        index += struct.pack(">2i", at // 2, len(body) // 2)
        data += struct.pack(">2i", i + 1, len(body) // 2) + body
        at += 8 + len(body)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    open(path, "wb").write(head(at) + data)
    open(path[:-4] + ".shx", "wb").write(head(100 + len(index)) + index)
    if names:
        fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15) + b"COUNT".ljust(11, b"\0") + b"N" + bytes(4) + bytes([4]) + bytes(15)
        rows = b"".join(b" " + n.encode().ljust(8) + str(i).rjust(4).encode() for i, n in enumerate(names))
        open(path[:-4] + ".dbf", "wb").write(struct.pack("<4BI2H", 3, 124, 1, 1, len(names), 32 + len(fields) + 1, 13).ljust(32, b"\0") + fields + b"\r" + rows)
    return path


def polygon(*rings, kind=5):
    points = [p for r in rings for p in r]
    xs, ys = zip(*points, strict=True)
    starts = np.cumsum([0] + [len(r) for r in rings[:-1]])
    return struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def square(x, y, r):
    return [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r), (x - r, y - r)]


def test_reader(spark, tmp_path):
    bodies = [polygon(square(k, 0, 0.4), square(k, 0, 0.1)) for k in range(20)] + [struct.pack("<i", 0), struct.pack("<i2d", 1, 3.0, 9.0), polygon([(0, 5), (1, 6), (2, 5)], kind=3), struct.pack("<i4di", 8, 1, 1, 2, 2, 2) + struct.pack("<4d", 1, 1, 2, 2)]
    path = written(str(tmp_path / "a.shp"), bodies, [f"n{i}" for i in range(len(bodies))])
    rows = shapes.shapes(spark, path, part_records=7).orderBy("record").collect()
    assert [r["record"] for r in rows] == list(range(24)) and [r["kind"] for r in rows[19:]] == [5, 0, 1, 3, 8]
    assert rows[4]["attributes"] == {"NAME": "n4", "COUNT": "4"} and list(rows[4]["parts"]) == [0, 5] and len(rows[4]["xs"]) == 10 and rows[4]["x1"] == pytest.approx(4.4)
    assert rows[20]["x0"] is None and rows[20]["xs"] == [] and (rows[21]["x0"], rows[21]["y1"]) == (3.0, 9.0) and rows[23]["xs"] == [1.0, 2.0]
    assert shapes.shapes(spark, path, part_records=7).rdd.getNumPartitions() == 4
    found = shapes.rings(shapes.shapes(spark, path).where("kind = 5")).collect()
    assert len(found) == 40 and all(len(r["points"]) == 5 for r in found)


def test_box_reaches_the_reader(spark, tmp_path):
    path = written(str(tmp_path / "b.shp"), [polygon(square(k, 0, 0.4)) for k in range(50)] + [struct.pack("<i", 0)])
    some = shapes.shapes(spark, path, (10.0, -1.0, 12.0, 1.0))
    assert sorted(r["record"] for r in some.collect()) == [10, 11, 12]
    reader = shapes._Reader(path, 4096)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual, StringContains

    left = list(reader.pushFilters([GreaterThanOrEqual(("x1",), 10.0), LessThanOrEqual(("x0",), 12.0), StringContains(("name",), "x")]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3  # 48 of 51 end at their box
    cut = memoryview(polygon(square(3, 0, 0.4)))[:36]  # nothing behind the box is there to be looked at
    assert shapes.parsed(cut, [(2, "__ge__", 10.0)]) is None


def test_no_records(spark, tmp_path):
    path = written(str(tmp_path / "c.shp"), [])
    assert shapes.shapes(spark, path).count() == 0


def inside(x, y, edges):
    out = np.zeros(len(x), int)
    for ax, ay, bx, by in edges:
        with np.errstate(all="ignore"):
            out += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out % 2 == 1


@pytest.mark.parametrize("cell", [0.07, 0.5, 40.0])
def test_points_in_shapes(spark, cell):
    """Overlapping stars, squares with holes and islands within them, sides on the cells' borders, points on sides and corners."""
    rng = np.random.default_rng(4)
    rings = {"holes": [square(0, 0, 3), square(0, 0, 2)[::-1], square(0, 0, 1)], "thin": [[(-4, 0.01), (4, 0.012), (4, 0.013)]], "border": [square(1, 1, 0.5)]}
    for k in range(4):
        a = np.sort(rng.uniform(0, 2 * np.pi, 80))
        r = rng.uniform(0.3, 2.5, 80)
        rings[f"star{k}"] = [list(zip(k - 2 + r * np.cos(a), r * np.sin(a), strict=True))]
    rows = [(s, [{"x": float(x), "y": float(y)} for x, y in ring]) for s, some in rings.items() for ring in some]
    edges = shapes.edges(spark.createDataFrame(rows, "name string, points array<struct<x: double, y: double>>"), "name")
    xy = np.vstack([rng.uniform(-5, 5, (1500, 2)), np.round(rng.uniform(-4, 4, (300, 2)) * 2) / 2, [[0, 0], [3, 3], [-3, -3]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(None, 0.0, 0.0), (9999, None, 0.0)], "id long, x double, y double")
    got = {(r["id"], r["shape"]) for r in geometry.points_in_shapes(points, edges, "id", cell).collect()}
    want = set()
    for s, some in rings.items():
        sides = [(*p, *q) for ring in some for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
        want |= {(int(i), s) for i in np.flatnonzero(inside(xy[:, 0], xy[:, 1], sides))}
    assert got == want and len(want) > 500


def test_ring_edges(spark):
    rows = [("a", i, float(i), float(i * i)) for i in range(10)] + [("b", 5, 1.0, 1.0)]
    got = geometry.ring_edges(spark.createDataFrame(rows, "s string, i long, x double, y double").repartition(4), "s", ["i"]).collect()
    a = sorted((r["ax"], r["bx"]) for r in got if r["shape"] == "a")
    assert a == [(float(i), float((i + 1) % 10)) for i in range(10)] and len(got) == 11


def test_lines_in_file_order(spark, tmp_path):
    """A file of many blocks of unlike sizes."""
    lines = [f"{i}," + "x" * (i * 37 % 211) for i in range(4000)]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        rows = sorted((r["row"], r["line"]) for r in reports.file_rows(spark, str(tmp_path / "r.csv")).collect())
        head, rest = reports.report_lines(spark, str(tmp_path / "r.csv"), 3)
        assert head == lines[:3] and rest.agg(F.min("row"), F.max("row")).first() == (0, 3996)
    finally:
        spark.conf.set(name, before)
    assert rows == list(enumerate(lines))


def test_fields_and_projection(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\nid,name,x\n1,"q, ""r""",5\n2,short\n3,,7\n4,a,b,c\n,,\n')
    rows = reports.projected(spark, str(tmp_path / "p.csv"), ["x", "name"], preamble=2).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(0, "5", 'q, "r"'), (2, "7", ""), (4, "", "")]


def test_alignment_by_position(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2), (2, None, 3)], "row long, k string, v int")
    b = spark.createDataFrame([(0, "x", 1), (1, "y", 9), (3, "z", 3)], "row long, k string, v int")
    assert reports.aligned(a, a, ["k", "v"]).count() == 0
    got = {(r["row"], r["column"], r["left"], r["right"]) for r in reports.aligned(a, b, ["k", "v"]).collect()}
    assert got == {(1, "v", "2", "9"), (2, "k", None, None), (2, "v", "3", None), (3, "k", None, "z"), (3, "v", None, "3")}
