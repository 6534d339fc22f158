"""Queries over cells, vertices and levels of the portfolio views; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs
from ..operators import relations as R
from ..operators import spatial as G
from ..sources.views import BLD, FULL, buildings, table
from .portfolio import LINKS, _links, full, long, query

CELL = f"{BLD}, xs AS (SELECT *, unnest(range(x0, x0 + w)) AS x FROM bld), cell AS (SELECT code, x, y, (x * x * 31 + y * y * 17 + x * y * 7) % 11 < 6 AS hit FROM (SELECT *, unnest(range(y0, y0 + d)) AS y FROM xs))"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """code, x, y, hit: the unit cells of each building, some of them without a return."""
    span = lambda low, size: F.explode(F.sequence(long(F.col(low)), long(F.col(low) + F.col(size)) - 1))
    c = buildings(spark, sf).withColumn("x", span("x0", "w")).withColumn("y", span("y0", "d"))
    x, y = F.col("x"), F.col("y")
    return c.select("code", "x", "y", ((x * x * 31 + y * y * 17 + x * y * 7) % 11 < 6).alias("hit"))


@query(f"WITH RECURSIVE {CELL}, g AS (SELECT code, x, y FROM cell WHERE NOT hit), r AS (SELECT code, x, y, x * 100000 + y AS root FROM g UNION SELECT g.code, g.x, g.y, r.root FROM r JOIN g ON g.code = r.code AND abs(g.x - r.x) + abs(g.y - r.y) = 1), l AS (SELECT code, x, y, min(root) AS root FROM r GROUP BY 1, 2, 3), s AS (SELECT code, root, count(*) AS n FROM l GROUP BY 1, 2) SELECT bld.code, CAST(coalesce(sum(n), 0) AS BIGINT) AS gaps, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM bld LEFT JOIN s USING (code) GROUP BY 1")
def largest_gap_component(spark, sf):
    """[A-11] size of the largest 4-connected group of cells without a return; cells of one building only meet each other."""
    gap = _cells(spark, sf).filter(~F.col("hit")).select("code", "x", "y")
    # cells are dealt by code already: neighbours meet in windows within their building, and so do its edges in one task
    follows = lambda c, own: F.coalesce(F.lead(c).over(W.partitionBy("code", own).orderBy(c)) == F.col(c) + 1, F.lit(False))
    gap = gap.withColumn("up", follows("y", "x")).withColumn("right", follows("x", "y"))
    step = lambda dx, dy: F.struct("code", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ends = F.array_compact(F.array(F.when(F.col("up"), step(0, 1)), F.when(F.col("right"), step(1, 0)), F.when(~F.col("up") & ~F.col("right"), step(0, 0))))
    edges = gap.select(step(0, 0).alias("a"), F.explode(ends).alias("b"))
    named = graphs.components(edges).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label.code", "n")
    sizes = named.groupBy("code").agg(F.sum("n").alias("gaps"), F.max("n").alias("largest"))
    return buildings(spark, sf).select("code").join(sizes.hint("merge"), "code", "left").select("code", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.coalesce("largest", F.lit(0)).cast("long").alias("largest"))


SCATTER = "v AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey * p_partkey * 31 + p_partkey * 17) % 307 AS DOUBLE) AS x, CAST((p_partkey * p_partkey * p_partkey + p_partkey * 11) % 263 AS DOUBLE) AS y FROM part)"


@query(f"WITH RECURSIVE {SCATTER}, r AS (SELECT id, id AS root, x, y FROM v UNION SELECT v.id, r.root, v.x, v.y FROM r JOIN v ON abs(v.x - r.x) < 3 AND abs(v.y - r.y) < 3 AND v.id <> r.id) SELECT id, min(root) AS cluster FROM r GROUP BY 1")
def vertex_clusters(spark, sf):
    """[A-17] vertices within tolerance of each other are one, transitively; the least id stands for them."""
    k = long(F.col("p_partkey"))
    v = table(spark, sf, "part").select(k.alias("id"), ((k * k * 31 + k * 17) % 307).cast("double").alias("x"), ((k * k * k + k * 11) % 263).cast("double").alias("y"))
    return G.clusters(v, 3)


@query(f"WITH {CELL}, e AS (SELECT code, o, x + dx AS x, y + dy AS y FROM cell, (VALUES ('h', 0, 0), ('h', 0, 1), ('v', 0, 0), ('v', 1, 0)) AS s(o, dx, dy) WHERE hit), k AS (SELECT code, o, x, y FROM e GROUP BY ALL HAVING count(*) = 1) SELECT code, count(*) AS n_edges FROM k GROUP BY 1")
def outline_edges(spark, sf):
    """[A-28] edges that one cell alone uses are the outline."""
    edge = lambda o, dx, dy: F.struct(F.lit(o).alias("o"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    e = _cells(spark, sf).filter("hit").select("code", F.explode(F.array(edge("h", 0, 0), edge("h", 0, 1), edge("v", 0, 0), edge("v", 1, 0))).alias("e"))
    return e.groupBy("code", "e").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").groupBy("code").agg(F.count(F.lit(1)).alias("n_edges"))


TURNS = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]


@query(f"WITH {CELL}, e AS (SELECT code, x, y, x + ax AS ax, y + ay AS ay, x + bx AS bx, y + by_ AS by_ FROM cell, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) AS s(ax, ay, bx, by_) WHERE hit) SELECT l.code, l.x, l.y, count(*) AS neighbours FROM e l JOIN e r ON l.code = r.code AND l.ax = r.bx AND l.ay = r.by_ AND l.bx = r.ax AND l.by_ = r.ay GROUP BY 1, 2, 3")
def edge_neighbours(spark, sf):
    """[J-24] the region across an edge uses the same edge backwards."""
    corner = lambda p: F.struct((F.col("x") + p[0]).alias("x"), (F.col("y") + p[1]).alias("y"))
    ends = F.array(*(F.struct(corner(a).alias("a"), corner(b).alias("b")) for a, b in TURNS))
    e = _cells(spark, sf).filter("hit").select("code", "x", "y", F.explode(ends).alias("e")).select("code", "x", "y", "e.a", "e.b")
    # both ways of an edge meet in a window within their building, which is dealt by code already
    e = e.select("code", "x", "y", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), (F.col("a") < F.col("b")).alias("up"))
    up, both = F.col("up"), W.partitionBy("code", "u", "v")
    met = e.withColumn("n", F.when(up, F.count_if(~up).over(both)).otherwise(F.count_if(up).over(both)))
    return met.groupBy("code", "x", "y").agg(F.sum("n").alias("neighbours")).filter("neighbours > 0")


@query("WITH RECURSIVE z AS (SELECT o_custkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS z FROM orders), s AS (SELECT k, min(z) AS s FROM z GROUP BY k UNION ALL SELECT s.k, min(z.z) FROM s JOIN z ON z.k = s.k AND z.z > s.s + 20 GROUP BY s.k), c AS (SELECT z.k, z.z, max(s.s) AS s FROM (SELECT k, z, row_number() OVER () AS i FROM z) z JOIN s ON s.k = z.k AND s.s <= z.z GROUP BY z.k, z.z, z.i) SELECT k AS o_custkey, s AS start, count(*) AS n, round(avg(z), 6) AS level FROM c GROUP BY 1, 2")
def level_clusters(spark, sf):
    """[A-16] levels in ascending order; a new cluster begins beyond the tolerance from the first level of the last one."""
    z = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.floor(F.col("o_totalprice") / 1000).cast("long"))).alias("z"))
    return S.greedy_levels(z, "z", 20).select("o_custkey", "c.start", "c.n", F.round(F.col("c.total") / F.col("c.n"), 6).alias("level"))


@query(f"WITH {BLD}, p AS (SELECT code, x0 || ' ' || y0 AS a, (x0 + w) || ' ' || y0 AS b, (x0 + w) || ' ' || (y0 + d) AS c, x0 || ' ' || (y0 + d) AS e FROM bld) SELECT code, sha256(least(concat_ws(',', a, b, c, e), concat_ws(',', b, c, e, a), concat_ws(',', c, e, a, b), concat_ws(',', e, a, b, c))) AS hash FROM p")
def ring_hash(spark, sf):
    """[A-27] the hash of a ring doesn't depend on the corner that it starts from."""
    ring = F.transform(S.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("d")), lambda p: F.concat_ws(" ", long(p["x"]), long(p["y"])))
    turned = buildings(spark, sf).select("code", S.rotated(ring, (F.col("code") % 4).cast("int")).alias("ring"))
    return turned.select("code", F.sha2(S.least_rotation(F.col("ring")), 256).alias("hash"))


@query(f"WITH {BLD}, l AS (SELECT code AS a, x0 AS ax0, y0 AS ay0, x0 + w AS ax1, y0 + d AS ay1 FROM bld), r AS (SELECT code AS b, x0 + code % 17 AS bx0, y0 + code % 13 AS by0, x0 + code % 17 + 3 AS bx1, y0 + code % 13 + 4 AS by1 FROM bld), j AS (SELECT a, b, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS area, power(greatest(0, ax0 - bx1, bx0 - ax1), 2) + power(greatest(0, ay0 - by1, by0 - ay1), 2) AS gap FROM l JOIN r ON ax0 - 20 <= bx1 AND bx0 <= ax1 + 20 AND ay0 - 20 <= by1 AND by0 <= ay1 + 20), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY area DESC, gap, b) AS i FROM j) SELECT a, b, CAST(area AS BIGINT) AS area, CAST(gap AS BIGINT) AS gap FROM n WHERE i = 1")
def nearest_part(spark, sf):
    """[J-15, O-06] the part of greatest overlap, else the nearest within reach; ties go to the least id."""
    b = buildings(spark, sf)
    x, y = F.col("x0") + F.col("code") % 17, F.col("y0") + F.col("code") % 13
    left = b.select(F.col("code").alias("a"), *((F.col(c) + k).alias(n) for c, k, n in (("x0", -20, "lx0"), ("y0", -20, "ly0"))), (F.col("x0") + F.col("w") + 20).alias("lx1"), (F.col("y0") + F.col("d") + 20).alias("ly1"))
    right = b.select(F.col("code").alias("b"), x.alias("rx0"), y.alias("ry0"), (x + 3).alias("rx1"), (y + 4).alias("ry1"))
    met = G.box_join(left, right, 40).withColumns({"lx0": F.col("lx0") + 20, "ly0": F.col("ly0") + 20, "lx1": F.col("lx1") - 20, "ly1": F.col("ly1") - 20})
    apart = lambda c: F.greatest(F.lit(0), F.col(f"l{c}0") - F.col(f"r{c}1"), F.col(f"r{c}0") - F.col(f"l{c}1"))
    met = met.select("a", "b", long(G.overlap()).alias("area"), long(apart("x") * apart("x") + apart("y") * apart("y")).alias("gap"))
    best = met.groupBy("a").agg(F.min(F.struct((-F.col("area")).alias("less"), "gap", "b")).alias("m"))
    return best.select("a", "m.b", (-F.col("m.less")).alias("area"), "m.gap")


@query(f"WITH {BLD}, k AS (SELECT * FROM (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) AS s(i, j)), p AS (SELECT code, x0 + i * w AS x, y0 + j * d AS y FROM bld, k), q AS (SELECT code, x0 + code % 3 + i * (w + code % 2) AS x, y0 + j * (d + code % 4) AS y FROM bld, k), m AS (SELECT p.code, p.x, p.y, min(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))) AS r FROM p JOIN q ON p.code = q.code GROUP BY 1, 2, 3) SELECT code, round(max(r), 6) AS adjustment FROM m GROUP BY 1")
def vertex_adjustment(spark, sf):
    """[A-26] the farthest that a vertex is from the nearest vertex of the adjusted ring."""
    code = F.col("code")
    old = S.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("d"))
    new = S.box_ring(F.col("x0") + code % 3, F.col("y0"), F.col("w") + code % 2, F.col("d") + code % 4)
    rings = buildings(spark, sf).select("code", old.alias("old"), new.alias("new"))
    far = F.transform("old", lambda p: F.array_min(F.transform("new", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    return rings.select("code", F.round(F.array_max(far), 6).alias("adjustment"))


@query("SELECT o_custkey, count(*) AS n, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS BIGINT) AS n_explicit, count(DISTINCT sha256(o_orderstatus)) > 1 AS conflict FROM orders GROUP BY 1")
def union_conflict(spark, sf):
    """[U-02] explicit and context rows in one table; rows of one id must agree."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.sha2("o_orderstatus", 256).alias("hash"))
    rows = o.filter("o_orderkey % 2 = 0").withColumn("source", F.lit("explicit")).unionByName(o.filter("o_orderkey % 2 <> 0").withColumn("source", F.lit("context")))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "explicit").alias("n_explicit"), (F.min("hash") != F.max("hash")).alias("conflict"))


@query(f"WITH {BLD}, {FULL}, s AS (SELECT code, i, i * 3 AS low, i * 3 + CASE WHEN code % 10 = 0 AND i = 1 THEN 2 ELSE 3 END AS high FROM (SELECT *, unnest(range(0, n)) AS i FROM full_bld)), l AS (SELECT *, lead(low) OVER (PARTITION BY code ORDER BY i) AS nxt FROM s) SELECT code, count(*) AS storeys, bool_and(nxt IS NULL OR nxt = high) AS contiguous FROM l GROUP BY 1")
def storey_continuity(spark, sf):
    """[W-09] the top of each storey is the floor of the next."""
    s = full(spark, sf).select("code", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    s = s.withColumn("low", F.col("i") * 3).withColumn("high", F.col("low") + F.when((F.col("code") % 10 == 0) & (F.col("i") == 1), 2).otherwise(3))
    following = F.lead("low").over(W.partitionBy("code").orderBy("i"))
    s = s.withColumn("ok", following.isNull() | (following == F.col("high")))
    return s.groupBy("code").agg(F.count(F.lit(1)).alias("storeys"), F.bool_and("ok").alias("contiguous"))


@query(f"WITH {BLD} SELECT code, CASE WHEN code % 3 > 0 THEN name || ' Part ' || i ELSE name END AS part FROM (SELECT *, unnest(range(1, code % 3 + 2)) AS i FROM bld)")
def numbered_parts(spark, sf):
    """[W-10] parts are numbered where there are several."""
    parts = buildings(spark, sf).select("code", "name", F.explode(F.sequence(F.lit(1), (F.col("code") % 3 + 1).cast("int"))).alias("i"))
    return parts.select("code", F.when(F.col("code") % 3 > 0, F.concat("name", F.lit(" Part "), F.col("i").cast("string"))).otherwise(F.col("name")).alias("part"))


@query("WITH p AS (SELECT l_suppkey, l_linenumber AS page, CAST(sum(l_partkey % 3) % 4 AS BIGINT) AS signature FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) AS pages, count(*) > count(DISTINCT signature) AS repeated FROM p GROUP BY 1")
def page_guard(spark, sf):
    """[W-12] a page with the content of an earlier one doesn't advance."""
    p = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.sum(F.col("l_partkey") % 3) % 4).alias("signature"))
    return p.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pages"), (F.count(F.lit(1)) > F.count_distinct("signature")).alias("repeated"))


@query(f"WITH {LINKS}, {BLD}, c AS (SELECT unit, height FROM l JOIN bld ON code = source), a AS (SELECT unit, count(DISTINCT height) AS k, count(height) = count(*) AS whole, min(height) AS h FROM c GROUP BY 1) SELECT unit, CASE WHEN unit % 4 = 0 THEN 9.0 WHEN k = 1 AND whole AND h > 0 AND h <= 300 THEN h END::DOUBLE AS height FROM a")
def assumed_height(spark, sf):
    """[T-20] an explicit height, else the one that all sources give; sources that differ or lack it give none."""
    sources = _links(spark, sf).distinct().join(buildings(spark, sf).select(F.col("code").alias("source"), "height").hint("merge"), "source")
    found = R.consensus(sources, "unit", "height")
    return found.select("unit", F.when(F.col("unit") % 4 == 0, F.lit(9.0)).when(F.col("value").between(1e-300, 300.0), F.col("value")).alias("height"))
