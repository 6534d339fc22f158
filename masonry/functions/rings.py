"""Column functions over rings: array<struct<x, y>> or array<struct<x, y, z>>, open (the last vertex joins the first).

A polygon or face is an array of rings, the exterior first; holes turn the other way, so sums over all rings
take them off. Every function is linear in the vertices of a row, and none is a UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is evaluated once, however often it is used: the variable of a transform over one element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row: what later filters or explodes by a plain one would be pushed below it and compute it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def total(values: Column) -> Column:
    """The sum of an array of doubles; 0 if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def following(ring: Column, i: Column) -> Column:
    """The vertex after the i-th (from 0), round the ring."""
    return F.get(ring, F.pmod(i + 1, F.size(ring)))


def edges(rings: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of all rings."""

    def edge(ring: Column) -> Callable[[Column, Column], Column]:
        return lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), following(ring, i)["x"].alias("bx"), following(ring, i)["y"].alias("by"))

    return F.flatten(F.transform(rings, lambda ring: F.transform(ring, edge(ring))))


def area(rings: Column) -> Column:
    """[A-19] area inside the exterior and outside the holes, by signs; positive where the exterior is counter-clockwise."""

    def turns(ring: Column) -> Column:
        first = F.get(ring, F.lit(0))  # coordinates relative to a vertex keep their digits
        return total(F.transform(ring, lambda p, i: (p["x"] - first["x"]) * (following(ring, i)["y"] - first["y"]) - (following(ring, i)["x"] - first["x"]) * (p["y"] - first["y"])))

    return total(F.transform(rings, turns)) / 2


def bounds(rings: Column) -> Column:
    """struct<x0, y0, x1, y1> of the exterior."""
    outer = F.get(rings, F.lit(0))
    side = lambda f, c: f(F.transform(outer, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def clipped(ring: Column, inside: Callable[[Column], Column], axes: str = "xy") -> Column:
    """[T-10] the part of a ring where `inside`, a linear function of a vertex, is not negative; empty if there is none.

    What falls apart stays one ring, joined along the border, so areas and bounds are right but the ring may touch itself.
    """

    def crossing(p: Column, q: Column) -> Column:
        t = inside(p) / (inside(p) - inside(q))
        return F.struct(*((p[c] + (q[c] - p[c]) * t).alias(c) for c in axes))

    def kept(p: Column, i: Column) -> Column:
        q = following(ring, i)
        here, there = inside(p) >= 0, inside(q) >= 0
        end = F.struct(*(q[c].alias(c) for c in axes))
        return F.when(here & there, F.array(end)).when(here, F.array(crossing(p, q))).when(there, F.array(crossing(p, q), end)).otherwise(F.slice(F.array(end), 1, 0))

    return F.flatten(F.transform(ring, kept))


def clip(rings: Column, inside: Callable[[Column], Column], axes: str = "xy") -> Column:
    """clipped for all rings; those of which nothing is left go."""
    return F.filter(F.transform(rings, lambda r: clipped(r, inside, axes)), lambda r: F.size(r) >= 3)


def below(e: dict, f: dict, base: Column) -> Column:
    """[J-06] signed area under both of two edges and above `base`, where they share a stretch of x.

    Upper edges of a counter-clockwise polygon run to lower x and count positive, lower ones negative, so summed over
    all pairs of edges of two polygons this is the area that these share.
    """
    low = F.greatest(F.least(e["ax"], e["bx"]), F.least(f["ax"], f["bx"]))
    high = F.least(F.greatest(e["ax"], e["bx"]), F.greatest(f["ax"], f["bx"]))
    at = lambda g, x: g["ay"] + (g["by"] - g["ay"]) * (x - g["ax"]) / (g["bx"] - g["ax"]) - base
    e0, e1, f0, f1 = at(e, low), at(e, high), at(f, low), at(f, high)
    t = (e0 - f0) / ((e0 - f0) - (e1 - f1))
    middle = e0 + t * (e1 - e0)
    apart = (e0 - f0) * (e1 - f1) < 0
    mean = F.when(apart, t * (F.least(e0, f0) + middle) / 2 + (1 - t) * (middle + F.least(e1, f1)) / 2).otherwise((F.least(e0, f0) + F.least(e1, f1)) / 2)
    sign = F.when((e["ax"] > e["bx"]) == (f["ax"] > f["bx"]), 1.0).otherwise(-1.0)
    return F.when(low < high, sign * (high - low) * mean).otherwise(0.0)


def straight_runs(ring: Column, joinable: Callable[[Column], Column] | None = None) -> Column:
    """[W-06] array<struct<start, n>>: maximal runs of n collinear edges round a ring of struct<x, y>, each from the vertex where it begins.

    Edges meet in a run where they go the same way, within 1e-9 of their lengths' product, and `joinable` of the vertex' number
    allows it; the last run joins the first across the ring's start. Empty for a ring that never turns.
    """
    n = F.size(ring)

    def breaks(i: Column) -> Column:
        a, b, c = F.get(ring, F.pmod(i - 1, n)), F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        straight = (ux * vx + uy * vy > 0) & (F.abs(ux * vy - uy * vx) <= 1e-9 * F.hypot(ux, uy) * F.hypot(vx, vy))
        return ~(straight & joinable(i)) if joinable else ~straight

    found = F.filter(F.sequence(F.lit(0), n - 1), breaks)
    length = lambda own: lambda i, k: F.struct(i.alias("start"), F.when(F.size(own) == 1, n).otherwise(F.pmod(F.get(own, F.pmod(k + 1, F.size(own))) - i, n)).alias("n"))
    return let(found, lambda own: F.transform(own, length(own)))
