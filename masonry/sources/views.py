"""Synthetic portfolio views over the driver's tables; integral coordinates, so doubles are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Buildings in a partition, at most about: what is drawn from one is up to a few thousand rows.
DEALT = 10_000


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part, dealt by code: its file is so small that one task would read it all and draw all cells and faces of it."""
    p = table(spark, sf_dir, "part")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), p.count() // DEALT)
    return p.select(
        F.col("p_partkey").alias("code"),
        ((F.col("p_partkey") % 50) * 20).alias("x0"),
        (F.floor(F.col("p_partkey") / 50) * 20).alias("y0"),
        (5 + F.col("p_size") % 10).alias("w"),
        (5 + F.col("p_size") % 7).alias("d"),
        F.when(F.col("p_size") % 5 != 0, 1 + F.col("p_size") % 6).alias("storeys"),
        F.when(F.col("p_partkey") % 7 != 0, (3 * (1 + F.col("p_size") % 6)).cast("double")).alias("height"),
        F.concat("p_type", F.element_at(F.array(*map(F.lit, [" tuiles", " Béton", " Ardoise", ""])), F.col("p_size") % 4 + 1)).alias("material"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
    ).repartition(parts, "code")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1000).alias("x"),
        ((F.col("l_partkey") * 11 + F.col("l_linenumber") * 3) % 800).alias("y"),
        F.col("l_quantity").alias("z"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 6).otherwise(67).alias("class"),
        F.col("l_shipdate").alias("t"),
        F.col("l_extendedprice").alias("e"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("ln"),
    )


#: The same views for DuckDB.
BLD = """bld AS (SELECT p_partkey AS code, (p_partkey % 50) * 20 AS x0, (p_partkey // 50) * 20 AS y0, 5 + p_size % 10 AS w, 5 + p_size % 7 AS d,
 CASE WHEN p_size % 5 <> 0 THEN 1 + p_size % 6 END AS storeys, CASE WHEN p_partkey % 7 <> 0 THEN CAST(3 * (1 + p_size % 6) AS DOUBLE) END AS height,
 p_type || CASE p_size % 4 WHEN 0 THEN ' tuiles' WHEN 1 THEN ' Béton' WHEN 2 THEN ' Ardoise' ELSE '' END AS material, p_name AS name, p_brand AS brand, p_size AS size FROM part)"""
PT = """pt AS (SELECT (l_orderkey * 7 + l_linenumber * 13) % 1000 AS x, (l_partkey * 11 + l_linenumber * 3) % 800 AS y, l_quantity AS z,
 CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 6 ELSE 67 END AS class, l_shipdate AS t, l_extendedprice AS e, l_orderkey AS o, l_linenumber AS ln FROM lineitem)"""
FULL = """full_bld AS (SELECT *, coalesce(storeys, greatest(1, CAST(round_even(height / 3.0, 0) AS INTEGER)), 1) AS n, coalesce(height, coalesce(storeys, 1) * 3.0) AS h FROM bld)"""

#: Corners of an outline as shares of a building's box: a ring with a notch and, for some, a hole that turns the other way.
OUTER = [(0, 0), (1, 0), (1, 1), (0.5, 0.75), (0, 1)]
HOLE = [(0.5, 0.25), (0.25, 0.375), (0.5, 0.5), (0.75, 0.375)]


def outlines(spark: SparkSession, sf_dir: str, dx: int = 0, dy: int = 0, grow: int = 0) -> DataFrame:
    """code, rings: general polygons for the buildings, moved by (dx, dy) and grown; every third has a hole."""
    at = lambda c, size, share, d: (F.col(c) + d + (F.col(size) + grow) * share).cast("double")
    ring = lambda corners: F.array(*(F.struct(at("x0", "w", fx, dx).alias("x"), at("y0", "d", fy, dy).alias("y")) for fx, fy in corners))
    return buildings(spark, sf_dir).select("code", F.when(F.col("code") % 3 == 0, F.array(ring(OUTER), ring(HOLE))).otherwise(F.array(ring(OUTER))).alias("rings"))


def outline_edges_sql(name: str, dx: int = 0, dy: int = 0, grow: int = 0) -> str:
    """The edges (code, ring, ax, ay, ex, ey) of outlines() for DuckDB, after BLD."""
    corners = ", ".join(f"({r}, {k}, {fx}, {fy})" for r, ring in enumerate((OUTER, HOLE)) for k, (fx, fy) in enumerate(ring))
    nxt = lambda c: f"coalesce(lead({c}) OVER (PARTITION BY code, ring ORDER BY pos), first_value({c}) OVER (PARTITION BY code, ring ORDER BY pos))"
    return f"""{name}_v AS (SELECT code, ring, pos, CAST(x0 + {dx} + (w + {grow}) * fx AS DOUBLE) AS x, CAST(y0 + {dy} + (d + {grow}) * fy AS DOUBLE) AS y FROM bld, (VALUES {corners}) AS c(ring, pos, fx, fy) WHERE ring = 0 OR code % 3 = 0),
 {name} AS (SELECT code, ring, x AS ax, y AS ay, {nxt('x')} AS ex, {nxt('y')} AS ey FROM {name}_v)"""

#: Vertices of a building with a shed roof and a shaft through it: face, then its rings of (corner, top).
CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1), (0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]
FACES = [
    [[(0, 0), (3, 0), (2, 0), (1, 0)], [(4, 0), (5, 0), (6, 0), (7, 0)]],
    [[(0, 1), (1, 1), (2, 1), (3, 1)], [(4, 1), (7, 1), (6, 1), (5, 1)]],
    *([[(i, 0), ((i + 1) % 4, 0), ((i + 1) % 4, 1), (i, 1)]] for i in range(4)),
    *([[((i + 1) % 4 + 4, 0), (i + 4, 0), (i + 4, 1), ((i + 1) % 4 + 4, 1)]] for i in range(4)),
]
SLOPE = 0.5


def _template() -> list[tuple]:
    return [(f, r, k, float(CORNERS[c][0]), float(CORNERS[c][1]), top, c) for f, rings in enumerate(FACES) for r, ring in enumerate(rings) for k, (c, top) in enumerate(ring)]


def solid_vertices(spark: SparkSession, sf_dir: str, touching: bool = False) -> DataFrame:
    """solid, face, ring, pos, x, y, z of the buildings as solids with sloped roofs and a shaft.

    Some are unsound: the roof is turned round (every 11th), one of its corners is raised (13th), a wall is missing (17th), a hole
    turns like its face (19th) or all faces look inwards (23rd). touching: none is unsound, every third reaches the next one's wall but for 4e-7.
    """
    from ..functions import scalars as S

    b = buildings(spark, sf_dir)
    _, h = S.completed(F.col("height"), F.col("storeys"))
    w = F.when(F.col("code") % 3 == 0, 20 + (4e-7 if touching else 0)).otherwise(F.col("w")) if touching else F.col("w")
    b = b.select("code", "x0", "y0", w.cast("double").alias("w"), "d", h.cast("double").alias("h"))
    corner = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("face", "ring", "pos", "fx", "fy", "top", "corner"), t, strict=True))) for t in _template())))
    rows = b.select("*", corner.alias("t")).select("code", "x0", "y0", "w", "d", "h", "t.*")
    code, top, face = F.col("code"), F.col("top") == 1, F.col("face")
    every = lambda n: F.lit(False) if touching else code % n == 0
    turned = (every(11) & (face == 1)) | (every(19) & (face == 0) & (F.col("ring") == 1)) | every(23)
    z = F.when(top, F.col("h") + SLOPE * F.col("w") * F.col("fx") + F.when(every(13) & (F.col("corner") == 2), 0.5).otherwise(0.0)).otherwise(0.0)
    return rows.filter(~(every(17) & (face == 5))).select(
        code.alias("solid"), "face", "ring", F.when(turned, -F.col("pos")).otherwise(F.col("pos")).alias("pos"), (F.col("x0") + F.col("w") * F.col("fx")).alias("x"), (F.col("y0") + F.col("d") * F.col("fy")).cast("double").alias("y"), z.alias("z")
    )


def solid_vertices_sql() -> str:
    """The same vertices (a table sv) for DuckDB, after BLD and FULL, with the next one (qx, qy, qz) and the ring's first (ox, oy, oz)."""
    rows = ", ".join(str(t) for t in _template())
    ends = ", ".join(f"coalesce(lead({c}) OVER r, first_value({c}) OVER r) AS q{c}, first_value({c}) OVER r AS o{c}" for c in "xyz")
    return f"""sv0 AS (SELECT code AS solid, face, ring, CASE WHEN (code % 11 = 0 AND face = 1) OR (code % 19 = 0 AND face = 0 AND ring = 1) OR code % 23 = 0 THEN -pos ELSE pos END AS pos, CAST(x0 + w * fx AS DOUBLE) AS x, CAST(y0 + d * fy AS DOUBLE) AS y,
 CASE WHEN "top" = 1 THEN h + {SLOPE} * w * fx + CASE WHEN code % 13 = 0 AND corner = 2 THEN 0.5 ELSE 0 END ELSE 0.0 END AS z FROM full_bld, (VALUES {rows}) AS c(face, ring, pos, fx, fy, "top", corner) WHERE NOT (code % 17 = 0 AND face = 5)),
 sv AS (SELECT *, {ends} FROM sv0 WINDOW r AS (PARTITION BY solid, face, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
