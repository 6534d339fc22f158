"""How well measured points bear out a reconstructed unit: nearest bounded planes, coverage, agreement, and the verdict.

Faces are rows (unit, face, semantic, rings) with rings of struct<x, y, z>, points rows (id, x, y, z, class). No UDFs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as P
from . import polygons as Q
from .faces import newell
from .graphs import cut
from .reconcile import unions

#: Classes of points, metres round the ground, cells of coverage, and least or greatest values of an accepted unit.
ROOF_CLASS, GROUND_CLASS, AROUND, CELL = 6, 2, 2.0, 0.5
LEAST = {"roof_points": 20, "ground_points": 10, "density": 1.0, "coverage": 0.8, "surface_coverage": 0.7, "agreement": 0.98}
MOST = {"filled": 0.01, "gap_area": 1.0, "gap_share": 0.1, "median": 0.2, "p95": 0.5}
KNOWN = ("RoofSurface", "GroundSurface", "WallSurface", "OuterFloorSurface", "OuterCeilingSurface")
#: Residuals are rounded to so many decimals before quantiles, which bounds a unit's distinct values.
DECIMALS = 6


def flat(rings: Column) -> Column:
    """Rings of struct<x, y> seen from above."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def _edges(rings: Column) -> Column:
    """array<struct<a, b>> of the ends of all edges."""
    return F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), P.following(r, i).alias("b")))))


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a place seen from above lies within the edges, by parity."""
    hit = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def _nearest_edge(edges: Column, p: dict[str, Column], axes: str) -> Column:
    """struct<d, z> of the place on any edge that is nearest to p by `axes`: distance and height; of equal ones the lowest."""

    def place(e: Column) -> Column:
        d = {c: e["b"][c] - e["a"][c] for c in axes}
        length = sum((d[c] * d[c] for c in axes[1:]), d[axes[0]] * d[axes[0]])
        along = sum((d[c] * (p[c] - e["a"][c]) for c in axes[1:]), d[axes[0]] * (p[axes[0]] - e["a"][axes[0]]))
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / length))).otherwise(0.0)
        return P.let(t, lambda s: F.struct(F.sqrt(sum(((e["a"][c] + s * d[c] - p[c]) ** 2 for c in axes[1:]), (e["a"][axes[0]] + s * d[axes[0]] - p[axes[0]]) ** 2)).alias("d"), (e["a"]["z"] + s * (e["b"]["z"] - e["a"]["z"])).alias("z")))

    return F.array_min(F.transform(edges, place))


def nearest(points: DataFrame, faces: DataFrame, cell: float, level: bool = False) -> DataFrame:
    """[J-14] unit, id, residual of each point (unit, id, x, y, z) to the nearest face of its unit; units without faces give none, and `id` must tell a unit's points apart.

    The residual is the distance in space to the bounded face: to its plane where the foot lies within the rings, else to the nearest
    edge. level: the face nearest seen from above counts (of equal ones the lowest `face`), and the residual is the difference in
    height at its nearest place. Faces must not be vertical (their normal's z at least 1e-6).

    Points are gathered in cells; a face is tried in a cell only if its box can be nearer to the cell's points than the farthest
    corner of every other face's box, so the exact test meets few faces, and the answer is exact.
    """
    axes = "xy" if level else "xyz"
    size = lambda c: F.floor(F.col(c) / cell).alias(f"c{c}")
    held = cut(points.select("unit", "id", *(F.col(c).cast("double").alias(c) for c in "xyz")).select("*", size("x"), size("y")))
    corner = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    boxed = cut(faces.select("unit", "face", "rings", *(corner(f, c).alias(f"{c}{i}") for c in axes for i, f in enumerate((F.array_min, F.array_max)))))
    cells = held.groupBy("unit", "cx", "cy").agg(*(f(c).alias(f"p{c}{i}") for c in axes for i, f in enumerate((F.min, F.max))))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"p{c}1"), F.col(f"p{c}0") - F.col(f"{c}1"))
    far = lambda c: F.greatest(F.col(f"{c}1") - F.col(f"p{c}0"), F.col(f"p{c}1") - F.col(f"{c}0"))
    norm = lambda f: sum((f(c) ** 2 for c in axes[1:]), f(axes[0]) ** 2)
    tried = cut(cells.join(boxed.drop("rings").hint("merge"), "unit").select("unit", "cx", "cy", "face", norm(gap).alias("low"), norm(far).alias("high")))
    bound = tried.groupBy("unit", "cx", "cy").agg(F.min("high").alias("bound"))
    near = tried.join(bound.hint("merge"), ["unit", "cx", "cy"]).filter(F.col("low") <= F.col("bound") * (1 + 1e-9)).select("unit", "cx", "cy", "face")

    vector = newell(F.get("rings", F.lit(0)))
    normal = P.let(vector, lambda n: F.struct(*((n[c] / F.sqrt(n["x"] ** 2 + n["y"] ** 2 + n["z"] ** 2)).alias(c) for c in "xyz")))
    planes = boxed.select("unit", "face", _edges(F.col("rings")).alias("edges"), F.get(F.get("rings", F.lit(0)), F.lit(0)).alias("o"), normal.alias("n"))
    met = held.join(near.join(planes, ["unit", "face"]).hint("merge"), ["unit", "cx", "cy"])
    p = {c: F.col(c) for c in "xyz"}
    n, o = F.col("n"), F.col("o")
    if level:
        on_plane = o["z"] - (n["x"] * (p["x"] - o["x"]) + n["y"] * (p["y"] - o["y"])) / n["z"]
        found = F.when(_inside(F.col("edges"), p["x"], p["y"]), F.struct(F.lit(0.0).alias("d"), on_plane.alias("z"))).otherwise(_nearest_edge(F.col("edges"), p, "xy"))
        rows = met.select("unit", "cx", "cy", "id", "z", "face", found.alias("f"))
        best = F.min(F.struct(F.col("f.d").alias("d"), "face", F.abs(F.col("z") - F.col("f.z")).alias("r")))["r"]
    else:
        height = sum((n[c] * (p[c] - o[c]) for c in "yz"), n["x"] * (p["x"] - o["x"]))
        foot = met.withColumn("h", height)
        x, y = p["x"] - F.col("h") * n["x"], p["y"] - F.col("h") * n["y"]
        distance = F.when(_inside(F.col("edges"), x, y), F.abs("h")).otherwise(_nearest_edge(F.col("edges"), p, "xyz")["d"])
        rows = foot.select("unit", "cx", "cy", "id", distance.alias("d"))
        best = F.min("d")
    return rows.groupBy("unit", "cx", "cy", "id").agg(best.alias("residual")).select("unit", "id", "residual")


def near_polygons(points: DataFrame, polygons: DataFrame, reach: float, cell: float) -> DataFrame:
    """[J-13] distinct unit, id, x, y, z of the points within `reach` of any of a unit's polygons (unit, rings), borders included.

    reach 0 takes the crossings of `polygons.covering`; otherwise a polygon is dealt to the cells that its box, grown by reach, touches.
    """
    xyz = points.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    at = F.struct("id", "x", "y", "z")
    if not reach:
        numbered = cut(polygons.select(F.struct("unit", F.monotonically_increasing_id().alias("k")).alias("ident"), "rings"))
        met = Q.covering(xyz.select(at.alias("key"), "x", "y"), numbered, "key", "ident", cell)
        return met.select("ident.unit", "key.*").distinct()
    b = P.bounds(F.col("rings"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor((b[lo] - reach) / cell), F.floor((b[hi] + reach) / cell)))
    around = reach * (1 + 1e-9) + 1e-9
    box = F.struct(*((b[c] + (around if c.endswith("1") else -around)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    dealt = polygons.select("unit", "rings", span("x0", "x1").alias("cx")).select("unit", "rings", "cx", span("y0", "y1").alias("cy"), box.alias("box"))
    spaced = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"))))
    dealt = dealt.select("unit", "cx", "cy", "box", _edges(spaced).alias("edges"))
    met = xyz.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(dealt.hint("merge"), ["cx", "cy"])
    p = {c: F.col(c) for c in "xyz"}
    close = _inside(F.col("edges"), p["x"], p["y"]) | (_nearest_edge(F.col("edges"), p, "xy")["d"] <= reach)
    # most points of a cell are off the grown box: that is compared first, so few come to the edges
    within = F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1"))
    return met.filter(within & close).select("unit", "id", "x", "y", "z").distinct()


def assess(outlines: DataFrame, faces: DataFrame, points: DataFrame, cell: float, size: float = CELL) -> DataFrame:
    """[T-21, J-13, J-14, A-08, A-10, A-11, A-13] measures of each unit, reasons against it and status: evidence_passed or needs_review.

    outlines: unit, rings, outline_type; faces: unit, face, semantic, rings; points: id, x, y, z, class. `cell` deals rows for joins, `size` is the
    grid of coverage. Reasons stand in a fixed order. Roof points lie in the outline or under a roof, ground points within AROUND of
    outline or ground. Points with a null, NaN or infinite coordinate take no part; if there are any, every unit has the reason
    nonfinite_lidar_coordinates. Quantiles take all residuals, not a sample. Hausdorff distances are not measured.
    Outlines of unknown type are taken as roofprints that walls follow.
    """
    finite = F.coalesce(F.abs("x") + F.abs("y") + F.abs("z") < math.inf, F.lit(False))
    sound = points.filter(finite)
    invalid = points.filter(~finite).agg((F.count(F.lit(1)) > 0).alias("invalid"))
    kinds = faces.groupBy("unit").agg(
        F.bool_or(~F.coalesce(F.col("semantic").isin(*KNOWN), F.lit(False))).alias("unknown"), F.bool_or(F.col("semantic").like("Outer%")).alias("overhang"),
        *(F.count_if(F.col("semantic") == s).alias(n) for s, n in (("RoofSurface", "roofs"), ("GroundSurface", "grounds"))),
    )
    area = F.abs(P.area(F.col("rings")))
    base = cut(outlines.select("unit", "rings", "outline_type", area.alias("area")))
    of = {n: cut(faces.filter(F.col("semantic") == s).select("unit", "face", "rings", flat(F.col("rings")).alias("plan"))) for n, s in (("roof", "RoofSurface"), ("ground", "GroundSurface"))}
    outline = base.select("unit", "rings")
    plan = {n: df.select("unit", F.col("plan").alias("rings")) for n, df in of.items()}
    chosen = {
        "roof": cut(near_polygons(sound.filter(F.col("class") == ROOF_CLASS), outline.union(plan["roof"]), 0, cell)),
        "ground": cut(near_polygons(sound.filter(F.col("class") == GROUND_CLASS), outline.union(plan["ground"]), AROUND, cell)),
    }
    out = base.drop("rings").join(kinds.hint("merge"), "unit", "left")
    for name, least in chosen.items():
        out = out.join(least.groupBy("unit").agg(F.count(F.lit(1)).alias(f"{name}_points")).hint("merge"), "unit", "left")
        found = nearest(least, of[name], cell, level=name == "ground").withColumn("residual", F.round("residual", DECIMALS))
        out = out.join(found.groupBy("unit").agg(F.percentile("residual", 0.5).alias(f"{name}_median"), F.percentile("residual", 0.95).alias(f"{name}_p95")).hint("merge"), "unit", "left")
    inside = Q.covering(chosen["roof"].select(F.struct("unit", "id").alias("key"), "x", "y"), outline, "key", "unit", cell).filter("key.unit = unit")
    out = out.join(inside.groupBy("unit").agg(F.count(F.lit(1)).alias("outline_points")).hint("merge"), "unit", "left")

    hit = lambda c: F.floor(F.col(c) / size).alias(f"c{c}")
    occupied = cut(chosen["roof"].select("unit", hit("x"), hit("y")).distinct())
    out = out.join(Q.cell_evidence(Q.cells(outline, "unit", size), occupied, "unit").select("unit", "coverage", F.col("largest").alias("largest_gap")).hint("merge"), "unit", "left")
    roofs = Q.cells(of["roof"].select(F.struct("unit", "face").alias("k"), F.col("plan").alias("rings")), "k", size).withColumn("unit", F.col("k.unit"))
    marked = roofs.join(occupied.withColumn("hit", F.lit(True)).hint("merge"), ["unit", "cx", "cy"], "left").groupBy("k")
    share = marked.agg((F.sum(F.when(F.col("hit"), F.col("area")).otherwise(0.0)) / F.sum("area")).alias("s"))
    out = out.join(share.groupBy(F.col("k.unit").alias("unit")).agg(F.min("s").alias("surface_coverage")).hint("merge"), "unit", "left")

    courts = cut(base.select("unit", F.explode(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0)))).alias("ring"), F.monotonically_increasing_id().alias("k")))
    for name in chosen:
        both = outline.select("unit", F.lit(True).alias("own"), "rings").union(plan[name].select("unit", F.lit(False).alias("own"), "rings"))
        shared = unions(both, "unit", cell).filter("whole > 0")
        holes = courts.select(F.struct("unit", "k").alias("key"), F.lit(True).alias("own"), F.array("ring").alias("rings"))
        models = courts.select("unit", "k").join(plan[name].hint("merge"), "unit").select(F.struct("unit", "k").alias("key"), F.lit(False).alias("own"), "rings")
        filled = unions(holes.union(models), "key", cell).groupBy(F.col("key.unit").alias("unit")).agg(F.sum("inside").alias(f"{name}_filled"))
        out = out.join(shared.select("unit", F.col("whole").alias(f"{name}_area"), F.col("inside").alias(f"{name}_shared")).hint("merge"), "unit", "left").join(filled.hint("merge"), "unit", "left")

    counts = [c for c in ("roofs", "grounds", "roof_points", "ground_points", "outline_points")]
    out = out.crossJoin(F.broadcast(invalid)).withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    out = out.withColumn("density", F.col("outline_points") / F.col("area"))
    ratios = {}
    for name in chosen:
        whole, both = F.col(f"{name}_area"), F.col(f"{name}_shared")
        ratios |= {f"{name}_iou": both / (F.col("area") + whole - both), f"{name}_outline_coverage": both / F.col("area"), f"{name}_outline_precision": both / whole}
    out = out.withColumns(ratios)
    when = lambda test, reason: F.when(F.coalesce(test, F.lit(False)), reason)
    col, empty = F.col, F.col("unknown").isNull()
    agree = [r for n, has in (("roof", "roofs"), ("ground", "grounds")) for r in (
        when((col(has) > 0) & (col(f"{n}_filled") > MOST["filled"]), f"{n}_fills_courtyard"),
        when((col(has) > 0) & (F.least(f"{n}_outline_coverage", f"{n}_outline_precision") < LEAST["agreement"]), f"{n}_outline_mismatch"))]
    tests = [
        when(~F.coalesce(col("outline_type").isin("roofprint", "wall_footprint", "unknown"), F.lit(False)), "undefined_outline_semantics"),
        when(col("unknown"), "undefined_surface_semantics"), when(col("overhang"), "unsupported_overhang_surface_evidence"),
        when(col("roofs") == 0, "missing_roof_surfaces"), when(col("grounds") == 0, "missing_ground_surfaces"), *agree,
        when(col("invalid"), "nonfinite_lidar_coordinates"),
        when(col("roof_points") < LEAST["roof_points"], "insufficient_roof_points"), when(col("ground_points") < LEAST["ground_points"], "insufficient_ground_points"),
        when(col("density") < LEAST["density"], "insufficient_roof_density"), when(col("coverage") < LEAST["coverage"], "insufficient_roof_coverage"),
        when(col("surface_coverage") < LEAST["surface_coverage"], "insufficient_roof_surface_coverage"),
        when(col("largest_gap") > F.greatest(F.lit(MOST["gap_area"]), MOST["gap_share"] * col("area")), "large_roof_evidence_gap"),
        *(when((col(f"{n}_median") > MOST["median"]) | (col(f"{n}_p95") > MOST["p95"]), f"{n}_residual_threshold_exceeded") for n in chosen),
    ]
    bare = F.array_compact(F.array(F.lit("missing_reconstructed_surfaces"), when(col("invalid"), "nonfinite_lidar_coordinates")))
    reasons = F.when(empty, bare).otherwise(F.array_compact(F.array(*tests)))
    measures = ["roof_points", "ground_points", "outline_points", "density", "coverage", "largest_gap", "surface_coverage", *(f"{n}_{m}" for n in chosen for m in ("iou", "outline_coverage", "outline_precision", "filled", "median", "p95"))]
    return out.withColumn("reasons", reasons).select("unit", *measures, "reasons", F.when(F.size("reasons") == 0, "evidence_passed").otherwise("needs_review").alias("status"))
