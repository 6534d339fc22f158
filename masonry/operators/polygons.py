"""Joins and measures over general polygons: rows with `rings`, see functions.rings. No UDFs, no geometry library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as P
from . import graphs
from .spatial import box_join


def covering(points: DataFrame, polygons: DataFrame, key: str, ident: str, cell: float) -> DataFrame:
    """[J-05, F-02] key, ident of each point (key, x, y) and each polygon (ident, rings) that covers it, border included.

    Edges are dealt to the bands of y that they span, and there to the cells of x from their polygon's left side to their
    own right end; a point meets the edges dealt to its cell, which hold all that a ray to the right can cross. The parity
    of the crossings of each point and polygon tells inside from outside, holes included.
    """
    e = polygons.select(ident, P.bounds(F.col("rings"))["x0"].alias("left"), F.explode(P.edges(F.col("rings"))).alias("e")).select(ident, "left", "e.*")
    span = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    dealt = e.withColumn("cy", span(F.least("ay", "by"), F.greatest("ay", "by"))).withColumn("cx", span(F.col("left"), F.greatest("ax", "bx")))
    x, y, ax, ay, bx, by = map(F.col, ("x", "y", "ax", "ay", "bx", "by"))
    p = points.select(key, x.cast("double").alias("x"), y.cast("double").alias("y")).withColumn("cx", F.floor(x / cell)).withColumn("cy", F.floor(y / cell))
    crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    border = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    met = p.join(dealt.hint("merge"), ["cx", "cy"]).select(key, ident, F.when(crossed, 1).otherwise(0).alias("crossed"), border.alias("border"))
    found = met.groupBy(key, ident).agg(F.sum("crossed").alias("n"), F.bool_or("border").alias("border"))
    return found.filter((F.col("n") % 2 == 1) | F.col("border")).select(key, ident)


def _sides(polygons: DataFrame, ident: str, side: str) -> DataFrame:
    rings = F.col("rings")
    b = P.bounds(rings)
    # measured before the join, once a polygon
    rows = polygons.select(F.col(ident).alias("a" if side == "l" else "b"), *(b[c].alias(side + c) for c in ("x0", "y0", "x1", "y1")), F.struct(F.abs(P.area(rings)).alias("area"), P.edges(rings).alias("edges")).alias("measured"))
    return P.once(rows, side, F.col("measured")).drop("measured")


def overlaps(left: DataFrame, right: DataFrame, cell: float, ident: str = "code") -> DataFrame:
    """[J-06] a, b, left_area, right_area, shared of polygons (ident, rings) whose areas overlap.

    Candidates are boxes that touch; the shared area is a sum over pairs of edges (see rings.below), holes by their sign.
    """
    near = box_join(_sides(left, ident, "l"), _sides(right, ident, "r"), cell)
    pairs = near.select("a", "b", F.col("l.area").alias("left_area"), F.col("r.area").alias("right_area"), F.col("ly0").alias("base"), F.col("l.edges").alias("e"), F.col("r.edges").alias("f"))
    pairs = pairs.withColumn("e", F.explode("e")).withColumn("f", F.explode("f"))
    shared = F.abs(F.sum(P.below(F.col("e"), F.col("f"), F.col("base"))))
    return pairs.groupBy("a", "b").agg(F.first("left_area").alias("left_area"), F.first("right_area").alias("right_area"), shared.alias("shared")).filter("shared > 1e-9")


def agreement(outlines: DataFrame, models: DataFrame, cell: float, ident: str = "code") -> DataFrame:
    """[A-13] ident, iou, coverage, precision, filled (area of the outline's holes that the model covers) and reasons of each outline and the model of the same ident.

    Without a model, or one that lies apart, the shares are 0.
    """
    courts = outlines.select(ident, F.explode(F.slice(F.col("rings"), F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0)))).alias("ring")).select(ident, F.array("ring").alias("rings"))
    own = lambda pairs: pairs.filter("a = b").select(F.col("a").alias(ident), "shared")
    filled = own(overlaps(courts, models, cell, ident)).groupBy(ident).agg(F.sum("shared").alias("filled"))
    area = F.abs(P.area(F.col("rings")))
    rows = outlines.select(ident, area.alias("outline")).join(models.select(ident, area.alias("model")).hint("merge"), ident, "left").join(own(overlaps(outlines, models, cell, ident)).hint("merge"), ident, "left").join(filled.hint("merge"), ident, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.select(
        ident,
        zero(F.col("shared") / (F.col("outline") + F.col("model") - F.col("shared"))).alias("iou"),
        zero(F.col("shared") / F.col("outline")).alias("coverage"),
        zero(F.col("shared") / F.col("model")).alias("precision"),
        zero(F.col("filled")).alias("filled"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("filled") > 0.01, "fills_courtyard"), F.when((F.col("coverage") < 0.98) | (F.col("precision") < 0.98), "outline_mismatch")))
    return rows.withColumn("reasons", reasons)


def cells(polygons: DataFrame, ident: str, size: float) -> DataFrame:
    """[G-11] ident, cx, cy, area: the part of each polygon in each cell of a grid; slivers up to 1e-10 are left out.

    The rings are clipped to columns first, then each column to its cells, so a cell costs what its column holds.
    """
    spread = lambda lo, hi: F.sequence(F.floor(lo / size), F.greatest(F.ceil(hi / size) - 1, F.floor(lo / size)))
    def strip(rings: Column, cx: Column) -> Column:
        kept = P.clip(P.clip(rings, lambda p: p["x"] - cx * size), lambda p: (cx + 1) * size - p["x"])
        return F.struct(cx.alias("cx"), kept.alias("rings"))

    def part(rings: Column, cy: Column) -> Column:
        kept = P.clip(P.clip(rings, lambda p: p["y"] - cy * size), lambda p: (cy + 1) * size - p["y"])
        return F.struct(cy.alias("cy"), F.abs(P.area(kept)).alias("area"))

    b = P.bounds(F.col("rings"))
    columns = F.transform(F.sequence(F.floor(b["x0"] / size), F.ceil(b["x1"] / size) - 1), lambda cx: strip(F.col("rings"), cx))
    strips = P.once(polygons.select(ident, "rings"), "s", columns).select(ident, F.explode("s").alias("s")).select(ident, "s.*").filter(F.size("rings") > 0)
    b = P.bounds(F.col("rings"))
    parts = F.transform(spread(b["y0"], b["y1"]), lambda cy: part(F.col("rings"), cy))
    return P.once(strips, "c", parts).select(ident, "cx", F.explode("c").alias("c")).select(ident, "cx", "c.*").filter("area > 1e-10")


def cell_evidence(grid: DataFrame, occupied: DataFrame, ident: str) -> DataFrame:
    """[A-10, A-11] ident, area, coverage (share of the area in occupied cells), gap (area without) and largest (area of the largest 4-connected gap).

    grid: see cells; occupied: cells (ident, cx, cy) with a return, repeats allowed.
    """
    marked = graphs.cut(grid.join(occupied.select(ident, "cx", "cy").distinct().withColumn("hit", F.lit(True)).hint("merge"), [ident, "cx", "cy"], "left"))
    gap = marked.filter("hit is null").select(F.struct(ident, "cx", "cy").alias("id"), "area")
    step = lambda dx, dy: F.struct(F.col("id")[ident].alias(ident), (F.col("id.cx") + dx).alias("cx"), (F.col("id.cy") + dy).alias("cy"))
    near = gap.select(F.col("id").alias("a"), F.explode(F.array(step(0, 1), step(1, 0))).alias("b")).join(gap.select(F.col("id").alias("b")).hint("merge"), "b")
    parts = gap.join(graphs.components(near).hint("merge"), "id", "left").groupBy(F.coalesce("label", "id").alias("label")).agg(F.sum("area").alias("area"))
    gaps = parts.groupBy(F.col("label")[ident].alias(ident)).agg(F.sum("area").alias("gap"), F.max("area").alias("largest"))
    sums = marked.groupBy(ident).agg(F.sum("area").alias("area"), F.sum(F.when(F.col("hit"), F.col("area")).otherwise(0.0)).alias("covered"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return sums.join(gaps.hint("merge"), ident, "left").select(ident, "area", (F.col("covered") / F.col("area")).alias("coverage"), zero("gap"), zero("largest"))
