"""Faces and solids as rows: (solid, face, rings) with rings of struct<x, y, z>, the exterior first. Planes and volumes are NumPy over Arrow batches, the rest expressions and joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import rings as P
from . import graphs, spatial

#: Fixed values in metres: how far a vertex may be off its plane, and what counts as nothing.
PLANARITY, TINY = 1e-3, 1e-6
#: Vertices are one if they agree in so many decimals.
DECIMALS = 8


def faces(vertices: DataFrame, keys: tuple[str, ...] = ("solid", "face")) -> DataFrame:
    """Face rows of vertex rows (keys, ring, pos, x, y, z), in the order of ring and pos."""
    at = F.struct("ring", "pos", F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz")).alias("p"))
    grouped = vertices.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("v"))
    numbers = F.array_distinct(F.transform("v", lambda v: v["ring"]))
    rings = F.transform(numbers, lambda k: F.transform(F.filter("v", lambda v: v["ring"] == k), lambda v: v["p"]))
    return P.once(grouped, "rings", rings).select(*keys, "rings")


def _minus(a: Column, b: Column) -> dict[str, Column]:
    return {c: a[c] - b[c] for c in "xyz"}


def _cross(a: dict, b: dict) -> dict[str, Column]:
    return {c: a[d] * b[e] - a[e] * b[d] for c, d, e in ("xyz", "yzx", "zxy")}


def _dot(a, b) -> Column:
    return sum((a[c] * b[c] for c in "yz"), a["x"] * b["x"])


def _vector(parts: dict[str, Column]) -> Column:
    return F.struct(*(parts[c].alias(c) for c in "xyz"))


def newell(ring: Column) -> Column:
    """[A-19] twice the area vector of a ring: the sum of cross products about its first vertex."""
    first = F.get(ring, F.lit(0))
    turn = lambda c: lambda p, i: _cross(_minus(p, first), _minus(P.following(ring, i), first))[c]
    return _vector({c: P.total(F.transform(ring, turn(c))) for c in "xyz"})


def _column(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


def _vectors(v: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v[:, k]) for k in range(3)], list("xyz"), mask=pa.array(~there))


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of rings: the face of each ring, the ring of each vertex, and the vertices (n by 3, NaN for what is null)."""
    of_face = np.repeat(np.arange(len(rings)), rings.value_lengths().fill_null(0).to_numpy())
    ring = rings.flatten()
    of_ring = np.repeat(np.arange(len(ring)), ring.value_lengths().fill_null(0).to_numpy())
    at = ring.flatten()
    parts = dict(zip((f.name for f in at.type), at.flatten(), strict=True))
    return of_face, of_ring, np.stack([parts[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"], 1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def _measured(rings: pa.Array, planarity: float) -> pa.Array:
    """PLANE of each of a batch's faces."""
    n = len(rings)
    face, ring, v = _flat(rings)
    size = np.bincount(ring, minlength=len(face))
    start = np.cumsum(size) - size
    first = v[start[ring]]
    i = np.arange(len(v))
    p, q = v - first, v[np.where(i + 1 == start[ring] + size[ring], start[ring], i + 1)] - first
    turns = np.stack([p[:, 1] * q[:, 2] - p[:, 2] * q[:, 1], p[:, 2] * q[:, 0] - p[:, 0] * q[:, 2], p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]], 1)
    vector = np.stack([np.bincount(ring, turns[:, k], len(face)) for k in range(3)], 1)

    count = np.bincount(face, minlength=n)
    unsound = np.bincount(face, (size < 3) | (np.bincount(ring, ~(np.abs(v).sum(1) < np.inf), len(face)) > 0), n) > 0
    ok = (count > 0) & ~unsound
    scaled = np.abs(v) * 10.0**DECIMALS
    named = np.where(scaled < 2.0**53, np.copysign(np.floor(scaled + 0.5), v) + 0.0, v)
    order = np.lexsort((named[:, 2], named[:, 1], named[:, 0], ring))
    again = (ring[order[1:]] == ring[order[:-1]]) & (named[order[1:]] == named[order[:-1]]).all(1)
    repeated = np.bincount(face[ring[order[1:]]], again, n) > 0

    heads = np.cumsum(count) - count  # the exterior of each face, where it has rings
    some = np.flatnonzero(ok)
    outer = heads[some]
    normal, u, origin, second = (np.full((n, 3), np.nan) for _ in range(4))
    origin[some], second[some], normal[some] = v[start[outer]], v[start[outer] + 1], vector[outer]
    length = np.sqrt(_dots(normal, normal))
    flat = ok & ~(length < TINY**2)
    normal /= length[:, None]
    side = second - origin
    u = side - normal * _dots(side, normal)[:, None]
    length = np.sqrt(_dots(u, u))
    sided = flat & ~(length < TINY)
    u /= length[:, None]
    across = np.stack([normal[:, 1] * u[:, 2] - normal[:, 2] * u[:, 1], normal[:, 2] * u[:, 0] - normal[:, 0] * u[:, 2], normal[:, 0] * u[:, 1] - normal[:, 1] * u[:, 0]], 1)

    turned = _dots(vector, normal[face]) / 2
    area = np.bincount(face, turned, n)
    deviation = np.full(n, -np.inf)
    owner = face[ring]
    np.maximum.at(deviation, owner, np.abs(_dots(v - origin[owner], normal[owner])))
    inner = np.arange(len(face)) != heads[face]
    holes = np.bincount(face, inner & ~(turned <= 0), n) > 0
    tests = {
        "invalid_coordinates": ~ok, "repeated_vertices": repeated, "degenerate_face": ~flat, "zero_length_edge": ~sided,
        "planarity_tolerance_exceeded": ~(deviation <= planarity), "hole_orientation": holes, "invalid_topology": area <= TINY**2,
    }
    which = np.select(list(tests.values()), range(len(tests)), -1)
    reason = pa.array(list(tests)).take(pa.array(which, mask=which < 0))
    return pa.StructArray.from_arrays(
        [_vectors(origin, ok), _vectors(u, sided), _vectors(across, sided), _vectors(normal, flat), _column(area, flat | (count == 0) & rings.is_valid().to_numpy(zero_copy_only=False)), _column(deviation, flat), reason],
        ["origin", "u", "v", "normal", "area", "deviation", "reason"],
    )


#: What `planes` gives of a face.
PLANE = ", ".join([f"{c} struct<x: double, y: double, z: double>" for c in ("origin", "u", "v", "normal")] + ["area double", "deviation double", "reason string"])


def planes(df: DataFrame, planarity: float = PLANARITY) -> DataFrame:
    """[T-01] each face with origin, u, v and normal (structs; u along the first edge), area (less holes), deviation and reason.

    reason is the first that applies: invalid_coordinates (a ring of fewer than three vertices, null or not finite),
    repeated_vertices, degenerate_face, zero_length_edge, planarity_tolerance_exceeded, hole_orientation (a hole that turns as the exterior does),
    invalid_topology (no area is left), else null. Crossing rings aren't looked for. Sums run over a batch's vertices in NumPy: as expressions over arrays they took thirty times as long.
    """

    def measured(rings: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return _measured(rings, planarity)

    # marked so that filters on what it gives don't compute it again
    plane = F.arrow_udf(measured, PLANE).asNondeterministic()
    return df.withColumn("_plane", plane("rings")).select(*df.columns, "_plane.*")


def projected(p: Column, origin: Column, u: Column, v: Column) -> Column:
    """[T-02] a point in the coordinates of a plane: struct<x, y>."""
    d = _minus(p, origin)
    return F.struct(_dot(d, u).alias("x"), _dot(d, v).alias("y"))


def lifted(q: Column, origin: Column, u: Column, v: Column) -> Column:
    """[T-02] the point of a plane that has these coordinates."""
    return _vector({c: origin[c] + u[c] * q["x"] + v[c] * q["y"] for c in "xyz"})


def clipped(df: DataFrame, z: Column, above: bool) -> DataFrame:
    """[T-10] the parts of faces on one side of a height; faces of which nothing is left go."""
    inside = (lambda p: p["z"] - z) if above else (lambda p: z - p["z"])
    return P.once(df, "rings", P.clip(F.col("rings"), inside, "xyz")).filter(F.size("rings") > 0)


def _edges(df: DataFrame, *keep: str) -> DataFrame:
    """solid, face, a, b of every edge, its ends rounded, and the columns `keep`."""
    size = 10.0**DECIMALS
    named = lambda v: F.when(F.abs(v) * size < 2.0**53, F.rint(v * size) / size).otherwise(v) + F.lit(0.0)  # noqa: E731  adding zero makes -0.0 equal 0.0
    ends = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(*(named(p[c]).alias(c) for c in "xyz"))))
    edge = lambda ring: lambda p, i: F.struct(p.alias("a"), P.following(ring, i).alias("b"))
    e = F.explode(F.flatten(F.transform("_ends", lambda ring: F.transform(ring, edge(ring)))))
    return P.once(df, "_ends", ends).select("solid", "face", *keep, e.alias("e")).select("solid", "face", "e.a", "e.b", *keep)


def edge_uses(df: DataFrame) -> DataFrame:
    """[A-20] solid, u, v, uses, turns (0 if as often one way as the other), first and last face of every undirected edge."""
    way = F.when(F.col("a") < F.col("b"), 1).otherwise(-1)
    e = _edges(df).select("solid", "face", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), way.alias("way"))
    return e.groupBy("solid", "u", "v").agg(F.count(F.lit(1)).alias("uses"), F.sum("way").alias("turns"), F.min("face").alias("first"), F.max("face").alias("last"))


def _six(rings: pa.Array, o: pa.Array) -> pa.Array:
    face, ring, v = _flat(rings)
    n, size = len(rings), np.bincount(ring, minlength=len(face))
    start = (np.cumsum(size) - size)[ring]
    at = dict(zip((f.name for f in o.type), o.flatten(), strict=True))
    around = np.stack([at[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"], 1)[face[ring]]
    i = np.arange(len(v))
    fan = np.flatnonzero((i > start) & (i + 1 < start + size[ring]))
    f, p, q = v[start[fan]] - around[fan], v[fan] - around[fan], v[fan + 1] - around[fan]
    with np.errstate(all="ignore"):
        cross = np.stack([p[:, 1] * q[:, 2] - p[:, 2] * q[:, 1], p[:, 2] * q[:, 0] - p[:, 0] * q[:, 2], p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]], 1)
        six = np.bincount(face, np.bincount(ring[fan], _dots(f, cross), len(face)), n)
    parts = rings.flatten().flatten().flatten()
    lacks = np.zeros(len(v), bool)
    for part in (*parts, *(at[c].take(pa.array(face[ring])) for c in "xyz")):
        lacks |= part.is_null().to_numpy(zero_copy_only=False)
    lost = np.bincount(face, (np.bincount(ring, lacks, len(face)) > 0) & (size >= 3) | rings.flatten().is_null().to_numpy(zero_copy_only=False), n) > 0
    return pa.array(six, mask=lost | ~rings.is_valid().to_numpy(zero_copy_only=False))


def _with_six(df: DataFrame) -> DataFrame:
    """[A-18] `df` with `six`: six times a face's signed tetrahedra, over fans of its rings, about a vertex of the solid."""
    rows = df.withColumn("_o", F.min(F.get(F.get("rings", F.lit(0)), F.lit(0))).over(W.partitionBy("solid")))
    return rows.withColumn("six", F.arrow_udf(_six, "double").asNondeterministic()("rings", "_o")).select(*df.columns, "six")


def volumes(df: DataFrame) -> DataFrame:
    """[A-18] solid, volume: signed tetrahedra over fans of all rings, about a vertex of the solid."""
    return _with_six(df).groupBy("solid").agg((F.sum("six") / 6).alias("volume"))


def shells(df: DataFrame, uses: DataFrame) -> DataFrame:
    """[A-21] solid, parts (connected groups of faces), pinched (vertices whose faces don't all hang together by edges at that vertex)."""
    shared = uses.filter("uses = 2").select("solid", "u", "v", "first", "last")
    node = lambda face: F.struct(F.col("solid"), F.col(face).alias("face"))
    label = graphs.components(shared.select(node("first").alias("a"), node("last").alias("b")))
    parts = df.select("solid", node("face").alias("id")).distinct().join(label.hint("merge"), "id", "left").groupBy("solid").agg(F.count_distinct(F.coalesce("label", "id")).alias("parts"))
    fan = lambda face: F.struct(F.col("solid"), F.col("at"), F.col(face).alias("face"))
    met = shared.withColumn("at", F.explode(F.array("u", "v")))
    label = graphs.components(met.select(fan("first").alias("a"), fan("last").alias("b")))
    corners = _edges(df).select("solid", F.struct("solid", F.col("a").alias("at"), "face").alias("id")).distinct().join(label.hint("merge"), "id", "left")
    fans = corners.groupBy("solid", F.col("id.at").alias("at")).agg(F.count_distinct(F.coalesce("label", "id")).alias("n"))
    return parts.join(fans.groupBy("solid").agg(F.count_if(F.col("n") > 1).alias("pinched")).hint("merge"), "solid")


def _not_plain(met: DataFrame) -> DataFrame:
    """`met` without the corners at which just three faces meet, two and two along an edge: these hang together."""
    corner = met.groupBy("solid", "at").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{k}") for c in ("first", "last") for k, f in (("sum", F.sum), ("min", F.min), ("max", F.max))))
    a, b, c = F.col("first_min"), F.col("first_max"), F.col("last_max")
    plain = (F.col("n") == 3) & (a < b) & (b < c) & (F.col("last_min") == b) & (F.col("first_sum") == 2 * a.cast("long") + b) & (F.col("last_sum") == 2 * c.cast("long") + b)
    return met.join(corner.filter(~plain).select("solid", "at").hint("merge"), ["solid", "at"])


def _sound_shells(uses: DataFrame) -> DataFrame:
    """`shells` of solids whose edges are all used twice: each face and corner is on such an edge, so the edges suffice and faces aren't joined."""
    node = lambda face: F.struct(F.col("solid"), F.col(face).alias("face"))
    head = F.col("id") == F.col("label")  # one node of each group
    parts = graphs.components(uses.select(node("first").alias("a"), node("last").alias("b"))).filter(head).groupBy("id.solid").agg(F.count(F.lit(1)).alias("parts"))
    fan = lambda face: F.struct(F.col("solid"), F.col("at"), F.col(face).alias("face"))
    met = uses.select("solid", "first", "last", F.explode(F.array("u", "v")).alias("at"))
    if isinstance(met.schema["first"].dataType, IntegralType):
        met = _not_plain(met)
    fans = graphs.components(met.select(fan("first").alias("a"), fan("last").alias("b"))).filter(head).groupBy("id.solid", "id.at").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(fans.filter("n > 1").groupBy("solid").agg(F.count(F.lit(1)).alias("pinched")).hint("merge"), "solid", "left")


def checked(df: DataFrame, planarity: float = PLANARITY) -> DataFrame:
    """[T-07] solid, n_faces, n_edges, volume, deviation and reason of every solid.

    reason is the first that applies: too_few_faces, duplicate_face, the least of the faces' own, non_manifold_edge (an edge
    that isn't used twice, once each way), disconnected_shell, non_manifold_vertex, non_positive_volume, else null.
    Self-intersections aren't looked for.
    """
    own = planes(_with_six(df), planarity).groupBy("solid").agg(
        F.count(F.lit(1)).alias("n_faces"), F.count_distinct("face").alias("n_ids"), F.max("deviation").alias("deviation"), F.min("reason").alias("face_reason"), (F.sum("six") / 6).alias("volume")
    )
    bad = (F.col("uses") != 2) | (F.col("turns") != 0)
    # marked in a window while edges are dealt by solid; shells of solids with an edge that isn't used twice aren't asked for
    uses = graphs.cut(edge_uses(df).withColumn("open", F.max(F.col("uses") != 2).over(W.partitionBy("solid"))))
    open_edges = uses.groupBy("solid").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(bad).alias("bad"))
    rows = own.join(open_edges.hint("merge"), "solid", "left").join(_sound_shells(uses.filter("not open")).hint("merge"), "solid", "left")
    reason = (
        F.when(F.col("n_faces") < 4, "too_few_faces").when(F.col("n_ids") < F.col("n_faces"), "duplicate_face").when(F.col("face_reason").isNotNull(), F.col("face_reason")).when(F.col("bad") > 0, "non_manifold_edge")
        .when(F.col("parts") > 1, "disconnected_shell").when(F.col("pinched") > 0, "non_manifold_vertex").when(~F.coalesce(F.col("volume") > TINY**3, F.lit(False)), "non_positive_volume")
    )
    return rows.select("solid", "n_faces", "n_edges", "volume", "deviation", reason.alias("reason"))


#: Fixed value in metres: within this a vertex is on an edge, and two vertices are one.
PARTY_WALL = 0.0127


def _finite(p: Column) -> Column:
    return F.coalesce(F.abs(p["x"]) + F.abs(p["y"]) + F.abs(p["z"]) < float("inf"), F.lit(False))


def _met_boxes(df: DataFrame, cell: float, around: float) -> DataFrame:
    """solid, x0, x1, y0, y1, z0, z1: for each solid the boxes of the other solids that come within `around` of its own, grown by it."""
    names = [(c, i) for c in "xyz" for i in (0, 1)]
    flat = P.once(df.select("solid", "rings"), "flat", F.filter(F.flatten("rings"), _finite))
    face = flat.select("solid", *((F.array_max if i else F.array_min)(F.col(f"flat.{c}")).alias(f"{c}{i}") for c, i in names))
    box = graphs.cut(face.groupBy("solid").agg(*((F.max if i else F.min)(f"{c}{i}").alias(f"{c}{i}") for c, i in names)).filter("x0 is not null"))
    grown = box.select(F.col("solid").alias("other"), *((F.col(f"{c}{i}") + (around if i else -around)).alias(f"r{c}{i}") for c, i in names))
    met = spatial.box_join(box.withColumnsRenamed({f"{c}{i}": f"l{c}{i}" for c, i in names}), grown, cell)
    met = met.filter((F.col("solid") != F.col("other")) & (F.col("lz0") <= F.col("rz1")) & (F.col("rz0") <= F.col("lz1")))
    return graphs.cut(met.select("solid", *(F.col(f"r{c}{i}").alias(f"{c}{i}") for c, i in names)))


def junctions(df: DataFrame, cell: float, tolerance: float = PARTY_WALL) -> DataFrame:
    """[J-18] solid, a, b, p, t, distance: vertices p of other solids within `tolerance` of an edge (a, b) of a solid, between its ends, where the solid has no vertex nearby.

    Only edges and vertices within another solid's box, grown by the tolerance, can meet: no others are dealt. Edges go to the
    cells of the ground that they cross, column by column, with the tolerance around; a vertex is in one
    cell. Distances are in space, t is the share of the edge up to p; a distance of 1e-8 or less is none.
    Edges with an end that is null or not finite are none.
    """
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    boxes = _met_boxes(df, cell, tolerance + TINY)
    e = _edges(df.join(boxes.hint("merge"), "solid"), *(f"{c}{i}" for c in "xyz" for i in (0, 1))).filter(_finite(a))
    inside = lambda low, high: reduce(and_, ((high(c) >= F.col(f"{c}0")) & (low(c) <= F.col(f"{c}1")) for c in "xyz"))
    held, crosses = inside(lambda c: a[c], lambda c: a[c]), _finite(b) & inside(lambda c: F.least(a[c], b[c]), lambda c: F.greatest(a[c], b[c]))
    e = graphs.cut(e.select("solid", "a", "b", held.alias("held"), crosses.alias("crosses")).filter("held or crosses"))
    edges = e.filter("crosses").select("solid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    owned = e.filter("held").select("solid", F.col("a").alias("p")).distinct()
    floor = lambda v: F.floor(v / cell)
    columns = edges.withColumn("cx", F.explode(F.sequence(floor(F.least("a.x", "b.x") - tolerance), floor(F.greatest("a.x", "b.x") + tolerance))))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    share = lambda x: F.when(dx == 0, None).otherwise(F.least(F.greatest((x - a["x"]) / dx, F.lit(0.0)), F.lit(1.0)))
    enters, leaves = a["y"] + dy * F.coalesce(share(F.col("cx") * cell - tolerance), F.lit(0.0)), a["y"] + dy * F.coalesce(share((F.col("cx") + 1) * cell + tolerance), F.lit(1.0))
    dealt = columns.withColumn("cy", F.explode(F.sequence(floor(F.least(enters, leaves) - tolerance), floor(F.greatest(enters, leaves) + tolerance))))
    points = owned.select("p").distinct().select("p", floor(F.col("p.x")).alias("cx"), floor(F.col("p.y")).alias("cy"))
    # the box of an edge is compared first, so few pairs come to the distance
    around = F.lit(True)
    for c in "xyz":
        around = around & p[c].between(F.least(a[c], b[c]) - tolerance, F.greatest(a[c], b[c]) + tolerance)
    met = P.once(points.join(dealt.hint("merge"), ["cx", "cy"]).filter(around), "ab", _vector(_minus(b, a))).filter(_dot(F.col("ab"), F.col("ab")) > TINY**2)
    ab = F.col("ab")
    met = P.once(met, "t", _dot(_minus(p, a), ab) / _dot(ab, ab))
    off = {c: p[c] - a[c] - F.col("t") * ab[c] for c in "xyz"}
    met = P.once(met.filter((F.col("t") > 0) & (F.col("t") < 1)), "distance", F.sqrt(_dot(off, off)))
    met = graphs.cut(met.filter((F.col("distance") > 1e-8) & (F.col("distance") < tolerance)).drop("cx", "cy", "ab"))
    key = lambda v: [F.floor(v[c] / tolerance) for c in "xyz"]
    own = owned.select("solid", F.col("p").alias("q"), *(k.alias(f"k{c}") for c, k in zip("xyz", key(p), strict=True)))
    spread = met
    for c, k in zip("xyz", key(p), strict=True):
        spread = spread.withColumn(f"k{c}", F.explode(F.sequence(k - 1, k + 1)))
    near = F.greatest(*(F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "xyz")) < tolerance
    taken = spread.join(own.hint("merge"), ["solid", "kx", "ky", "kz"]).filter(near).select("solid", "p").distinct()
    return met.join(taken.hint("merge"), ["solid", "p"], "left_anti").select("solid", "a", "b", "p", "t", "distance")


#: Normals are opposite from this product on, planes one within TINY. Sizes of the keys that such faces share, and how far the offsets of two that meet may differ.
OPPOSITE = -1 + 1e-9
NORMAL_KEY, OFFSET_KEY, OFFSET_NEAR = 1e-3, 0.1, 5e-3


def _near_keys(v: Column, size: float, tolerance: float) -> Column:
    return F.explode(F.array_distinct(F.array(F.floor((v - tolerance) / size + 0.5), F.floor((v + tolerance) / size + 0.5))))


def interfaces(df: DataFrame, cell: float) -> DataFrame:
    """[J-16] a, a_face, b, b_face, shared: faces of two solids (a < b) on one plane with opposite normals whose areas overlap.

    Faces that reach into another solid's box are dealt to the cells of the ground that their boxes touch. There the plane is a key: the normal and the
    offset from the cell's corner, rounded down; the other side, turned round, takes the neighbouring keys too where it
    is within tolerance of a border. The shared area is a sum over pairs of edges in the plane of a. Faces that have a
    reason (see planes) take no part.
    """
    # only faces that reach into another solid's box can meet its faces; written once with their rings
    boxes = _met_boxes(df, cell, OFFSET_NEAR).groupBy("solid").agg(F.collect_list(F.struct(*(f"{c}{i}" for c in "xyz" for i in (0, 1)))).alias("_boxes"))
    side = lambda f, c: f(F.col(f"_flat.{c}"))
    touches = F.exists("_boxes", lambda o: reduce(and_, ((F.col(f"_{c}1") >= o[f"{c}0"]) & (F.col(f"_{c}0") <= o[f"{c}1"]) for c in "xyz")))
    near = P.once(df.select("solid", "face", "rings").join(boxes.hint("merge"), "solid"), "_flat", F.flatten("rings"))
    near = near.select("solid", "face", "rings", "_boxes", *(side(f, c).alias(f"_{c}{i}") for c in "xyz" for i, f in enumerate((F.array_min, F.array_max)))).filter(touches)
    sides = [(F.col(f"_{c}{i}") + (TINY if i else -TINY)).alias(f"{c}{i}") for i in (0, 1) for c in "xy"]
    rows = graphs.cut(planes(near).filter("reason is null").select("solid", "face", "rings", "origin", "u", "v", "normal", *sides))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    dealt = rows.select("solid", "face", "origin", "normal", "x0", "y0", span("x0", "x1").alias("cx"), "y1").withColumn("cy", span("y0", "y1"))
    offset = (F.col("origin.x") - F.col("cx") * cell) * F.col("normal.x") + (F.col("origin.y") - F.col("cy") * cell) * F.col("normal.y") + F.col("origin.z") * F.col("normal.z")
    near = 5e-5  # normals whose product is OPPOSITE differ by less in each component
    box = [F.col(c) for c in ("solid", "face", "origin", "normal", "x0", "y0")]
    key = lambda v, size: F.floor(v / size + 0.5)  # noqa: E731  zero and one, which most normals have, lie in the middle of their keys, so few rows take two
    left = dealt.select("cx", "cy", *(key(F.col(f"normal.{c}"), NORMAL_KEY).alias(f"n{c}") for c in "xyz"), key(offset, OFFSET_KEY).alias("k"), F.struct(*box).alias("l"))
    right = dealt.withColumn("k", _near_keys(-offset, OFFSET_KEY, OFFSET_NEAR))
    for c in "xyz":
        right = right.withColumn(f"n{c}", _near_keys(-F.col(f"normal.{c}"), NORMAL_KEY, near))
    right = right.select("cx", "cy", "nx", "ny", "nz", "k", F.struct(*box).alias("r"))
    own = (F.floor(F.greatest("l.x0", "r.x0") / cell) == F.col("cx")) & (F.floor(F.greatest("l.y0", "r.y0") / cell) == F.col("cy"))
    normal = F.col("l.normal")
    met = left.join(right.hint("merge"), ["cx", "cy", "nx", "ny", "nz", "k"]).filter(
        (F.col("l.solid") < F.col("r.solid")) & own & (_dot(normal, F.col("r.normal")) <= OPPOSITE) & (F.abs(_dot(_minus(F.col("r.origin"), F.col("l.origin")), normal)) <= TINY)
    )
    names = ["a", "a_face", "b", "b_face"]
    pairs = graphs.cut(met.select(F.col("l.solid").alias("a"), F.col("l.face").alias("a_face"), F.col("r.solid").alias("b"), F.col("r.face").alias("b_face")))
    one = rows.select(F.col("solid").alias("a"), F.col("face").alias("a_face"), "rings", "origin", "u", "v")
    other = rows.select(F.col("solid").alias("b"), F.col("face").alias("b_face"), F.col("rings").alias("others"))
    flat_edges = lambda c: P.edges(F.transform(c, lambda ring: F.transform(ring, lambda p: projected(p, F.col("origin"), F.col("u"), F.col("v")))))
    drawn = pairs.join(one.hint("merge"), ["a", "a_face"]).join(other.hint("merge"), ["b", "b_face"]).select(*names, flat_edges("rings").alias("e"), flat_edges("others").alias("f"))
    drawn = graphs.cut(drawn).select(*names, F.explode("e").alias("e"), "f").select(*names, "e", F.explode("f").alias("f"))
    shared = F.abs(F.sum(P.below(F.col("e"), F.col("f"), F.lit(0.0))))
    return drawn.groupBy(*names).agg(shared.alias("shared")).filter(F.col("shared") > TINY**2 * 100)


def boundaries(df: DataFrame, shared: DataFrame) -> DataFrame:
    """[J-16, J-23] solid, face, area, interfaces, interior (area shared with other solids) and remainder of every face without a reason.

    Each interface counts for both of its sides, so the interior areas of all faces sum to twice the shared area.
    """
    sides = shared.select(F.explode(F.array(F.struct(F.col("a").alias("solid"), F.col("a_face").alias("face")), F.struct(F.col("b").alias("solid"), F.col("b_face").alias("face")))).alias("s"), "shared")
    sums = sides.groupBy("s.solid", "s.face").agg(F.count(F.lit(1)).alias("interfaces"), F.sum("shared").alias("interior"))
    rows = planes(df).filter("reason is null").select("solid", "face", "area").join(sums.hint("merge"), ["solid", "face"], "left")
    interior = F.coalesce("interior", F.lit(0.0))
    return rows.select("solid", "face", "area", F.coalesce("interfaces", F.lit(0)).cast("long").alias("interfaces"), interior.alias("interior"), F.greatest(F.col("area") - interior, F.lit(0.0)).alias("remainder"))
