"""Which building groups and physical outlines belong together: explicit identifiers first, then areas that cover each other.

Outlines are given as parts: rows (ident, rings), several for an ident of several parts. Nothing is gathered into lists of a
side's members: unions of outlines are measured by sweeps over the edges of a strip, as joins, windows and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rings as P
from . import polygons as Q
from .graphs import cut

#: The share of itself that must be covered, and how far a sum of areas may exceed their union.
LEAST, SLACK = 0.9, 1.05


def unions(polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """[J-07] key, whole, inside: the area that a key's members cover together, and the part of it within the key's own outline.

    polygons: key, own (whether it is the key's outline or a member) and rings. Edges are dealt to strips of x as wide as `cell`; a strip is
    cut where edges end or cross. Between two cuts heights are linear in x, so the middle gives the area: in order of height a
    running sum of entries and exits tells what is covered. A strip of a key is one task's unit, not the whole key.
    """
    rings = F.col("rings")
    turn = F.when(P.area(rings) < 0, -1).otherwise(1)
    e = polygons.select(key, "own", turn.alias("turn"), F.explode(P.edges(rings)).alias("e")).select(key, "own", "turn", "e.*").filter("ax <> bx")
    right = F.col("ax") < F.col("bx")
    end = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b))
    e = e.select(key, "own", (F.col("turn") * F.when(right, 1).otherwise(-1)).alias("step"), end("ax", "bx").alias("x0"), end("ay", "by").alias("y0"), end("bx", "ax").alias("x1"), end("by", "ay").alias("y1"))
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.greatest(F.ceil(F.col("x1") / cell) - 1, F.floor(F.col("x0") / cell)))))
    at = lambda x, s="": F.col(s + "y0") + (F.col(s + "y1") - F.col(s + "y0")) * (x - F.col(s + "x0")) / (F.col(s + "x1") - F.col(s + "x0"))
    e = cut(e.withColumns({"lo": F.greatest("x0", F.col("strip") * cell), "hi": F.least("x1", (F.col("strip") + 1) * cell)}).filter("lo < hi"))
    names = ("x0", "y0", "x1", "y1", "lo", "hi")
    other = e.select(key, "strip", *(F.col(c).alias(f"f{c}") for c in names))
    lo, hi = F.greatest("lo", "flo"), F.least("hi", "fhi")
    pairs = e.join(other.hint("merge"), [key, "strip"]).filter((lo < hi) & (F.struct(*names[:4]) < F.struct(*(f"f{c}" for c in names[:4]))))
    d0, d1 = at(lo) - at(lo, "f"), at(hi) - at(hi, "f")
    crossings = pairs.filter(d0 * d1 < 0).select(key, "strip", (lo + (hi - lo) * d0 / (d0 - d1)).alias("x"))
    cuts = e.select(key, "strip", F.explode(F.array("lo", "hi")).alias("x")).union(crossings).distinct()
    slabs = cuts.withColumn("to", F.lead("x").over(W.partitionBy(key, "strip").orderBy("x"))).filter("to is not null")
    met = e.join(slabs.hint("merge"), [key, "strip"]).filter((F.col("lo") <= F.col("x")) & (F.col("hi") >= F.col("to")))
    met = met.select(key, "strip", "x", "to", "own", "step", at((F.col("x") + F.col("to")) / 2).alias("y"))
    column = W.partitionBy(key, "strip", "x").orderBy("y")
    depth = lambda own: F.sum(F.when(F.col("own") == own, F.col("step")).otherwise(0)).over(column.rowsBetween(W.unboundedPreceding, 0))
    swept = met.select(key, depth(False).alias("members"), depth(True).alias("outline"), ((F.col("to") - F.col("x")) * (F.lead("y").over(column) - F.col("y"))).alias("area"))
    covered = F.when(F.col("members") > 0, F.col("area")).otherwise(0.0)
    return swept.groupBy(key).agg(F.sum(covered).alias("whole"), F.sum(F.when(F.col("outline") > 0, covered).otherwise(0.0)).alias("inside"))


def _area() -> Column:
    return F.abs(P.area(F.col("rings")))


def shared_parts(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """[J-06] a, b, shared of idents whose parts overlap; parts of one ident lie apart, so their shares add up."""
    return Q.overlaps(left, right, cell, "ident").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def associate(groups: DataFrame, outlines: DataFrame, cell: float, shares: DataFrame | None = None, least: float = LEAST, slack: float = SLACK) -> DataFrame:
    """[J-07] a, b, shared, decision for each group and outline (parts: ident, rings) that overlap.

    Outlines that lie in a group by `least` are linked to it if together they cover it by `least`, and groups that lie in
    an outline likewise to that. Where those together are larger than their union by `slack`, they are ambiguous. Equal
    rows count twice. A side with one member needs no union; the others are measured by `unions`. shares: see shared_parts, if known.
    """
    sized = lambda df, k, n: df.groupBy(F.col("ident").alias(k)).agg(F.sum(_area()).alias(n))
    pairs = (shared_parts(groups, outlines, cell) if shares is None else shares).join(sized(groups, "a", "la").hint("merge"), "a").join(sized(outlines, "b", "ra").hint("merge"), "b")
    pairs = cut(pairs)

    def side(key: str, member: str, own: DataFrame, members: DataFrame, size: str, other: str) -> DataFrame:
        inside = pairs.filter(F.col("shared") >= least * F.col(other))
        sums = inside.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(other).alias("sum"), F.sum("shared").alias("in"), F.first(size).alias("size"))
        several = sums.filter("n > 1").select(key)
        parts = inside.select(key, member).join(several.hint("merge"), key).join(members.withColumnRenamed("ident", member).hint("merge"), member).select(key, F.lit(False).alias("own"), "rings")
        whole = unions(parts.union(own.withColumnRenamed("ident", key).join(several.hint("merge"), key).select(key, F.lit(True).alias("own"), "rings")), key, cell)
        joined = sums.join(whole.hint("merge"), key, "left")
        return joined.select(key, (F.col("sum") > slack * F.coalesce("whole", "sum")).alias(f"{key}_ambiguous"), (F.coalesce("inside", "in") >= least * F.col("size") - 1e-9).alias(f"{key}_covered"))

    joined = pairs.join(side("a", "b", groups, outlines, "la", "ra").hint("merge"), "a", "left").join(side("b", "a", outlines, groups, "ra", "la").hint("merge"), "b", "left")
    met = lambda what: F.coalesce((F.col("shared") >= least * F.col("ra")) & F.col(f"a_{what}"), F.lit(False)) | F.coalesce((F.col("shared") >= least * F.col("la")) & F.col(f"b_{what}"), F.lit(False))
    decision = F.when(met("ambiguous"), "ambiguous_overlap").when(met("covered"), "spatial_union").otherwise("insufficient_bidirectional_coverage")
    return joined.select("a", "b", "shared", decision.alias("decision"))


def explicit(relations: DataFrame, features: DataFrame) -> DataFrame:
    """[J-04, U-05] group_id, source_id, method: links by identifier; explicit_bdtopo goes before explicit_rnb.

    relations: group_id, bdtopo_ids and rnb_ids (arrays); features: source_id and rnb_ids. Nulls and unknown identifiers link nothing.
    """
    ids = lambda df, key, c, name: df.select(key, F.explode(c).alias(name)).distinct()
    known = features.select("source_id")
    direct = ids(relations, "group_id", "bdtopo_ids", "source_id").join(known.hint("merge"), "source_id").select("group_id", "source_id", F.lit("explicit_bdtopo").alias("method"))
    rnb = ids(relations, "group_id", "rnb_ids", "rnb").join(ids(features, "source_id", "rnb_ids", "rnb").hint("merge"), "rnb").select("group_id", "source_id", F.lit("explicit_rnb").alias("method"))
    return direct.union(rnb).groupBy("group_id", "source_id").agg(F.min("method").alias("method"))


def _attributed(members: DataFrame, relations: DataFrame, features: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """[J-09] unit, bdnb_construction and rnb (arrays) and direct, for each relation row of a unit's groups.

    A row belongs to the unit if it names the outline or one of its RNB numbers, or if its own shape, unless fictitious, and
    the part cover each other by LEAST; other rows' identifiers stay unresolved.
    """
    rows = relations.withColumn("rel", F.monotonically_increasing_id())
    rows = cut(rows)
    shapes = rows.filter("rings is not null and not coalesce(fictitious, false)").select(F.col("rel").alias("ident"), "rings")
    near = Q.overlaps(shapes, parts.select(F.col("unit").alias("ident"), "rings"), cell, "ident")
    near = near.filter((F.col("shared") >= LEAST * F.col("left_area")) & (F.col("shared") >= LEAST * F.col("right_area"))).select(F.col("a").alias("rel"), F.col("b").alias("unit"), F.lit(True).alias("near"))
    joined = members.join(rows.drop("rings").hint("merge"), "group_id").join(features.select("source_id", F.col("rnb_ids").alias("own_rnb")).hint("merge"), "source_id").join(near.hint("merge"), ["rel", "unit"], "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    direct = true(F.array_contains("bdtopo_ids", F.col("source_id"))) | true(F.arrays_overlap("rnb_ids", "own_rnb")) | true(F.col("near"))
    return joined.select("unit", F.col("construction_ids").alias("bdnb_construction"), F.col("rnb_ids").alias("rnb"), direct.alias("direct"))


def reconcile(groups: DataFrame, relations: DataFrame, features: DataFrame, parts: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """[J-04, J-07, J-08, J-09, A-12] units and links of building groups and physical outlines.

    groups: group_id, rings (parts; null rings where there is no outline or a fictitious one). relations: group_id, construction_ids,
    bdtopo_ids, rnb_ids (arrays), rings and fictitious of a construction. features: source_id, rnb_ids, outline_type, one row each.
    parts: source_id, part (from 0), rings.

    units: unit (recon- and 20 hexadecimal digits of a hash of source and part), source_id, part, outline_type, role (target if a
    group belongs to it, else context), n_groups. links: unit, source_type, source_id, method, relationship (see relations.cardinality,
    or unresolved), shared, source_coverage, physical_coverage, iou, confidence and reason. An explicit link holds without
    an outline or overlap; a spatial one only for parts that overlap the group. Groups in no unit: see `unresolved`.
    """
    unit = F.concat(F.lit("recon-"), F.substring(F.sha2(F.concat_ws(":", F.col("source_id").cast("string"), F.col("part").cast("string")), 256), 1, 20))
    parts = cut(parts.withColumn("unit", unit).withColumn("part_area", _area()))
    shaped = groups.filter("rings is not null").select(F.col("group_id").alias("ident"), "rings")
    outlined = groups.filter("rings is not null").groupBy("group_id").agg(F.sum(_area()).alias("group_area"))
    shares = cut(shared_parts(shaped, parts.select(F.col("unit").alias("ident"), "rings"), cell).join(parts.select(F.col("unit").alias("b"), "source_id").hint("merge"), "b"))
    whole = shares.groupBy("a", F.col("source_id").alias("b")).agg(F.sum("shared").alias("shared"))
    decided = associate(shaped, parts.select(F.col("source_id").alias("ident"), "rings"), cell, whole).select(F.col("a").alias("group_id"), F.col("b").alias("source_id"), "decision")
    known = explicit(relations, features).join(groups.select("group_id").distinct().hint("merge"), "group_id")
    both = cut(known.join(decided.hint("merge"), ["group_id", "source_id"], "full").select("group_id", "source_id", F.coalesce("method", F.when(F.col("decision") == "spatial_union", F.col("decision"))).alias("method"), "decision"))
    shares = shares.select(F.col("a").alias("group_id"), F.col("b").alias("unit"), "shared")
    met = both.join(parts.select("source_id", "unit", "part_area").hint("merge"), "source_id").join(shares.hint("merge"), ["group_id", "unit"], "left").join(outlined.hint("merge"), "group_id", "left")
    met = cut(met.filter("shared is not null or method like 'explicit%'"))
    spatial = F.col("method").isNull() | (F.col("method") == "spatial_union")
    resolved = F.col("method").isNotNull()
    shared = F.when(F.col("group_area").isNotNull(), F.coalesce("shared", F.lit(0.0)))
    sized = {"shared": shared, "source_coverage": shared / F.col("group_area"), "physical_coverage": shared / F.col("part_area"), "iou": shared / (F.col("group_area") + F.col("part_area") - shared)}
    text = lambda c: F.col(c).cast("string").alias("source_id")
    by_group = met.select(
        "unit", F.lit("bdnb_group").alias("source_type"), text("group_id"), F.when(spatial, "spatial_verified").otherwise("source_relation").alias("method"), resolved.alias("resolved"), *(v.alias(k) for k, v in sized.items()),
        F.when(~resolved, "unresolved").when(spatial, "high").otherwise("confirmed").alias("confidence"),
        F.when(resolved, F.col("method")).when(F.col("decision") == "ambiguous_overlap", F.col("decision")).otherwise("insufficient_bidirectional_coverage").alias("reason"),
    )
    members = met.filter(resolved).select("group_id", "unit", "source_id")
    rows = cut(_attributed(members, relations, features, parts, cell))
    named = lambda kind: rows.select("unit", F.lit(kind).alias("source_type"), F.explode(F.col(kind).cast("array<string>")).alias("source_id"), "direct")
    own = parts.select("unit", F.lit("bdtopo").alias("source_type"), text("source_id"), F.lit(True).alias("direct"))
    rnb = parts.select("unit", "source_id").join(features.select("source_id", "rnb_ids").hint("merge"), "source_id").select("unit", F.lit("rnb").alias("source_type"), F.explode(F.col("rnb_ids").cast("array<string>")).alias("source_id"), F.lit(True).alias("direct"))
    idents = own.union(rnb).union(named("bdnb_construction")).union(named("rnb")).distinct()
    by_ident = idents.select("unit", "source_type", "source_id", F.lit("source_relation").alias("method"), F.col("direct").alias("resolved"), F.when(F.col("direct"), "confirmed").otherwise("unresolved").alias("confidence"), F.when(~F.col("direct"), "physical_attribution_unresolved").alias("reason"))
    links = cut(by_group.unionByName(by_ident, allowMissingColumns=True))

    sure = links.filter("resolved").select("unit", "source_type", "source_id")
    by_unit = sure.groupBy("unit", "source_type").agg(F.count(F.lit(1)).alias("s"))
    by_source = sure.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("u"))
    kind = F.when(~F.col("resolved"), "unresolved").when(F.col("s") > 1, "shared_physical_unit").when(F.col("u") > 1, "group_member").otherwise("one_to_one")
    links = links.join(by_unit.hint("merge"), ["unit", "source_type"], "left").join(by_source.hint("merge"), ["source_type", "source_id"], "left")
    links = links.select("unit", "source_type", "source_id", "method", kind.alias("relationship"), *sized, "confidence", "reason")
    counted = members.groupBy("unit").agg(F.count(F.lit(1)).alias("n_groups"))
    units = parts.join(features.select("source_id", "outline_type").hint("merge"), "source_id").join(counted.hint("merge"), "unit", "left")
    units = units.select("unit", "source_id", "part", "outline_type", F.when(F.col("n_groups") > 0, "target").otherwise("context").alias("role"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))
    return units, links


def unresolved(groups: DataFrame, links: DataFrame) -> DataFrame:
    """[F-11, J-25, U-04] group_id of the groups that belong to no unit."""
    held = links.filter("source_type = 'bdnb_group' and relationship <> 'unresolved'").select("source_id").distinct()
    return groups.select("group_id").distinct().join(held.hint("merge"), F.col("group_id").cast("string") == F.col("source_id"), "left_anti")
