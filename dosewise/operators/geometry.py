"""Predicates over rings (arrays of x, y structs) and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.operators.gram import numbered


def ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses an odd number of edges; the ring closes itself."""
    size = F.size(points)
    edges = F.zip_with(points, F.concat(F.slice(points, 2, size), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is in any of several rings."""
    return F.exists(rings, lambda r: in_ring(x, y, r))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether boxes of x0, y0, x1, y1 have a point in common."""
    return (a["x1"] >= b["x0"]) & (a["x0"] <= b["x1"]) & (a["y1"] >= b["y0"]) & (a["y0"] <= b["y1"])


def thinned(points: Column, least: float) -> Column:
    """A ring's vertices without those nearer than `least` (sum of both coordinates' differences) to the last one kept; the first and last stay.

    A ring of fewer than four vertices is left as it is, and so is one of which fewer than three would stay."""
    first = F.slice(points, 1, 1)
    far = lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) >= least
    kept = F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), first, lambda acc, v: F.when(far(F.element_at(acc, -1), v), F.concat(acc, F.array(v))).otherwise(acc))
    last = F.element_at(points, -1)
    whole = F.when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last)))
    return F.when((F.size(points) < 4) | (F.size(whole) < 3), points).otherwise(whole)


# ---------------------------------------------------------------- many points and many shapes


def ring_edges(vertices: DataFrame, shape: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(shape, ax, ay, bx, by): the sides of one ring a shape, whose vertices follow each other in `order`; the last joins the first. Needs a checkpoint folder."""
    rows = numbered(vertices.select(F.col(shape).alias("shape"), *order, F.col(x).alias("ax"), F.col(y).alias("ay")), "shape", *order, name="at")
    ends = rows.groupBy("shape").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    after = rows.select((F.col("at") - 1).alias("at"), "shape", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    closing = rows.join(ends, "shape").where("at = first").select(F.col("last").alias("at"), "shape", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return rows.join(after.unionByName(closing), ["shape", "at"]).select("shape", "ax", "ay", "bx", "by")


def _row_crossings(points: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by): points (cy, x, y) with the number of sides, met by shape and row of cells, that a ray to the right crosses, if it is odd."""
    met = points.join(edges, ["shape", "cy"]).where("(ay > y) <> (by > y)").where(F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    return met.groupBy(*by).agg(F.count("*").alias("crossed")).where("crossed % 2 = 1").select(*by)


def points_in_shapes(points: DataFrame, edges: DataFrame, id: str, cell: float) -> DataFrame:
    """(id, shape): every pair of a point (id, x, y) and a shape (shape, ax, ay, bx, by) that holds it by the even-odd rule over all its sides, so that a
    ring within another is a hole; shapes may overlap. Rings must be closed.

    Shapes are covered by square cells. Cells that no side touches lie wholly in or out: one point of each run of them decides, and points in
    them are never tested. Others meet only the sides of their own shape in their own row of cells, so a long ring is split by rows and no
    point meets all rings. A side's cells are found with some slack, which can only send a cell to the test. `cell` sets how fine the cover is, not the result.
    Points without coordinates or id are in none, sides without a coordinate are left out; repeated ids are one point a place.
    """
    slack = cell * 1e-9
    sides = edges.where("shape is not null and ax is not null and ay is not null and bx is not null and by is not null")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = sides.withColumn("cy", F.explode(F.sequence(F.floor((low - slack) / cell), F.floor((high + slack) / cell))))
    # the part of a side within its row of cells
    share = lambda y: F.least(F.greatest(F.coalesce((y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    at = lambda t: F.col("ax") + t * (F.col("bx") - F.col("ax"))
    level = F.col("ay") == F.col("by")
    one, two = F.when(level, F.col("ax")).otherwise(at(share(F.col("cy") * cell - slack))), F.when(level, F.col("bx")).otherwise(at(share((F.col("cy") + 1) * cell + slack)))
    touched = rows.select("shape", "cy", F.explode(F.sequence(F.floor((F.least(one, two) - slack) / cell), F.floor((F.greatest(one, two) + slack) / cell))).alias("cx")).distinct()
    rows = rows.select("shape", "cy", "ax", "ay", "bx", "by")

    line = W.partitionBy("shape", "cy").orderBy("cx")
    gaps = touched.withColumn("next", F.lead("cx").over(line)).where("next > cx + 1").select("shape", "cy", (F.col("cx") + 1).alias("from"), (F.col("next") - 1).alias("to"))
    centres = gaps.withColumns({"x": (F.col("from") + 0.5) * cell, "y": (F.col("cy") + 0.5) * cell})
    inner = _row_crossings(centres, rows, ["shape", "cy", "from", "to"]).select("shape", "cy", F.explode(F.sequence("from", "to")).alias("cx"), F.lit(True).alias("whole"))
    cover = touched.withColumn("whole", F.lit(False)).unionByName(inner)

    placed = points.where(F.col(id).isNotNull()).where("x is not null and y is not null").select(F.col(id).alias("_id"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).distinct()
    met = placed.join(cover, ["cx", "cy"])
    tested = _row_crossings(met.where("not whole").select("_id", "shape", "cy", "x", "y"), rows, ["_id", "shape", "x", "y"])
    return met.where("whole").select("_id", "shape").union(tested.select("_id", "shape")).distinct().withColumnRenamed("_id", id)
