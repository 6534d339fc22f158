"""Spatial joins as grid equi-joins: both sides are dealt to cells, joined on the cell and refined exactly.

A pair is kept only in the cell that holds the lower left corner of the two boxes' intersection, so no
second shuffle removes duplicates. Cost follows the local density, not the product of the sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs


def with_cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str, cell: float) -> DataFrame:
    """[P-32, G-11] a row for each cell (cx, cy) that the box touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return df.withColumn("cx", span(x0, x1)).withColumn("cy", span(y0, y1))


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """[J-06, J-19] pairs of boxes that touch; left has lx0, ly0, lx1, ly1 and right rx0, ry0, rx1, ry1."""
    a, b = with_cells(left, "lx0", "ly0", "lx1", "ly1", cell), with_cells(right, "rx0", "ry0", "rx1", "ry1", cell)
    x, y = F.greatest("lx0", "rx0"), F.greatest("ly0", "ry0")
    own = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    meet = (x <= F.least("lx1", "rx1")) & (y <= F.least("ly1", "ry1"))
    return a.join(b.hint("merge"), ["cx", "cy"]).filter(own & meet).drop("cx", "cy")


def overlap() -> Column:
    """Area that the two boxes of a row share."""
    side = lambda a0, a1, b0, b1: F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return side("lx0", "lx1", "rx0", "rx1") * side("ly0", "ly1", "ry0", "ry1")


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """[J-05, F-02] points (x, y) with the boxes (rx0..ry1) that cover them, border included."""
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    b = with_cells(boxes, "rx0", "ry0", "rx1", "ry1", cell)
    return p.join(b.hint("merge"), ["cx", "cy"]).filter(F.col("x").between(F.col("rx0"), F.col("rx1")) & F.col("y").between(F.col("ry0"), F.col("ry1"))).drop("cx", "cy")


def outside_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """[J-12] points (x, y) that no box (rx0..ry1) covers, border included."""
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    b = with_cells(boxes.select("rx0", "ry0", "rx1", "ry1"), "rx0", "ry0", "rx1", "ry1", cell).withColumnsRenamed({"cx": "bx", "cy": "by"})
    inside = F.col("x").between(F.col("rx0"), F.col("rx1")) & F.col("y").between(F.col("ry0"), F.col("ry1"))
    return p.join(b.hint("merge"), (F.col("cx") == F.col("bx")) & (F.col("cy") == F.col("by")) & inside, "left_anti").drop("cx", "cy")


#: Ids of one place that go together.
TOGETHER = 1000


def near_pairs(points: DataFrame, tolerance: float, together: int = TOGETHER) -> DataFrame:
    """[J-17] pairs a < b of points (id, x, y) within `tolerance` on each axis.

    Points of one place go as lists of about `together` ids: lists are dealt to their cell and, once each, to the four cells ahead of
    it, so what is shuffled grows with the points, and distances are taken between places. Pairs themselves grow with the square of
    the points where places fill up.
    """
    held = points.select("id", "x", "y").filter("id is not null and x is not null and y is not null")
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.count(F.lit(1)).over(W.partitionBy("x", "y")) / together)))
    lists = held.groupBy("x", "y", "part").agg(F.collect_list("id").alias("ids"))
    a = lists.select(F.struct("x", "y", "part").alias("p"), F.col("ids").alias("own"), F.floor(F.col("x") / tolerance).alias("cx"), F.floor(F.col("y") / tolerance).alias("cy"))
    ahead = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    b = a.select(F.col("p").alias("q"), F.col("own").alias("others"), "cx", "cy", ahead.alias("d")).select("q", "others", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("here"))
    near = (F.abs(F.col("p.x") - F.col("q.x")) < tolerance) & (F.abs(F.col("p.y") - F.col("q.y")) < tolerance)
    # lists are small beside the pairs they give: tasks must not be united by the bytes that they read
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(tasks, "cx", "cy").join(b.repartition(tasks, "cx", "cy").hint("merge"), ["cx", "cy"]).filter(near & (~F.col("here") | (F.col("p") <= F.col("q"))))
    met = met.select((F.col("here") & (F.col("p") == F.col("q"))).alias("same"), F.explode("own").alias("i"), "others").select("same", "i", F.explode("others").alias("j"))
    return met.filter(F.when(F.col("same"), F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j"))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def clusters(points: DataFrame, tolerance: float) -> DataFrame:
    """[A-17] id, cluster of points (id, x, y): the least id that steps within `tolerance` on each axis lead to.

    Points on one place are one from the start: pairs are sought between places, whose least id stands for them.
    """
    places = graphs.cut(points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.min("id").alias("id")))
    found = places.join(graphs.components(near_pairs(places, tolerance)).hint("merge"), "id", "left").select("x", "y", F.coalesce("label", "id").alias("cluster"))
    return points.join(found.hint("merge"), ["x", "y"], "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def merge_intervals(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """[W-07] key, lo, hi of the unions of intervals that overlap or touch."""
    order = W.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(lo) > before).cast("int"), F.lit(1)))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


#: Metres around all outlines, and the longest side of an extent.
AROUND, MOST_EXTENT = 30.0, 2000.0


def extents(df: DataFrame, key: str, around: float = AROUND, most: float = MOST_EXTENT) -> DataFrame:
    """[A-05, A-06, P-22, P-30] per key: bounds of all boxes with a margin, their centre, the least known ground (0 if none), crs and a reason.

    Rows have x0, y0, x1, y1, ground and fictitious. Bounds that look like degrees are EPSG:4326, others
    EPSG:2154. The reason is fictitious_outline if any row is fictitious, invalid_extent for coordinates that
    are null or not finite, extent_limit for a side beyond `most`, and null where the bounds may be used.
    """
    corners = ["x0", "y0", "x1", "y1"]
    sound = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)
    rows = df.select(key, "ground", "fictitious", *(F.col(c).cast("double").alias(c) for c in corners))
    g = rows.groupBy(key).agg(
        *(f(c).alias(c) for c, f in zip(corners, (F.min, F.min, F.max, F.max), strict=True)),
        F.coalesce(F.min("ground"), F.lit(0.0)).alias("ground"),
        F.coalesce(F.bool_or("fictitious"), F.lit(False)).alias("fictitious"),
        F.bool_and(sound("x0") & sound("y0") & sound("x1") & sound("y1")).alias("sound"),
    )
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * around
    degrees = (F.greatest(F.abs("x0"), F.abs("x1")) <= 180) & (F.greatest(F.abs("y0"), F.abs("y1")) <= 90)
    reason = F.when(F.col("fictitious"), "fictitious_outline").when(~F.col("sound"), "invalid_extent").when(side > most, "extent_limit")
    margins = [(F.col(c) + (around if c.endswith("1") else -around)).alias(n) for c, n in zip(corners, ("west", "south", "east", "north"), strict=True)]
    centre = [((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"centre_{c}") for c in "xy"]
    return g.select(key, *margins, *centre, F.col("ground").alias("reference_elevation"), F.when(degrees, "EPSG:4326").otherwise("EPSG:2154").alias("crs"), reason.alias("reason"))
