"""Relational operators with stated null and order semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graphs import cut
from .spatial import box_join, overlap


def drift_select(df: DataFrame, wanted: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """[S-05, S-06] the wanted columns (name: type); those the table lacks are null, a required one raises."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()))


def fill_from(base: DataFrame, extra: DataFrame, key: str, columns: list[str], absent: dict[str, Column] | None = None) -> DataFrame:
    """[J-02] left join; a null is filled, but a column named in `absent` only where that flag says it was never given."""
    held = extra.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(held.hint("merge"), key, "left")
    pick = lambda c: F.when(absent[c], F.col(f"_{c}")).otherwise(F.col(c)) if absent and c in absent else F.coalesce(c, f"_{c}")
    return joined.select(*(pick(c).alias(c) if c in columns else F.col(c) for c in base.columns))


def tagged_union(tables: dict[str, DataFrame]) -> DataFrame:
    """[S-08, U-01] rows of all tables with their table's name; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("source_table", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """[W-01, O-01, O-02] the first k rows of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


#: What a British building feature calls its properties.
FEATURE = {"top": "height_relativeroofbase_m", "most": "height_relativemax_m", "floors": "numberoffloors", "ground": "height_absolutemin_m", "area": "geometry_area_m2", "shape": "roofshapeaspect_shape", "material": "roofmaterial_primarymaterial"}


def british_buildings(features: DataFrame) -> DataFrame:
    """[P-10, S-12] building rows of GeoJSON features (column `feature`, one text each); `reason` says why one gives none.

    The height up to the roof's base comes first; the greatest height holds the roof already, so such a roof
    counts as flat. Storeys must be a whole number. A feature without an identifier or a geometry is kept as
    a row of nulls with the reason missing_id_or_geometry, a text that is no JSON object as malformed.
    """
    at = lambda path: F.get_json_object("feature", path)
    prop = lambda k, positive=True: S.finite(at(f"$.properties.{FEATURE[k]}"), positive)
    rows = features.select(at("$.properties.osid").alias("osid"), at("$.id").alias("id"), at("$.geometry").alias("geometry"), at("$").alias("whole"), *(prop(k, k != "ground").alias(k) for k in ("top", "most", "floors", "ground", "area")), F.lower(at(f"$.properties.{FEATURE['shape']}")).alias("shape"), at(f"$.properties.{FEATURE['material']}").alias("material"))
    code = F.coalesce(F.nullif("osid", F.lit("")), F.nullif("id", F.lit("")))
    fine = code.isNotNull() & ~F.coalesce("geometry", F.lit("")).isin("", "{}")
    shape = F.when(F.col("top").isNull() & F.col("most").isNotNull(), F.lit("flat")).when(F.col("shape").isin("flat", "pitched"), F.col("shape"))
    whole = F.when((F.col("floors") % 1 == 0) & (F.col("floors") < 2**31), F.col("floors").cast("int"))
    values = {"code": code, "height": F.coalesce("top", "most"), "storeys": whole, "ground_elevation": F.col("ground"), "footprint_area": F.col("area"), "roof_shape": shape, "roof_material": F.col("material")}
    reason = F.when(~F.coalesce(F.ltrim("whole"), F.lit("")).startswith("{"), "malformed").when(~fine, "missing_id_or_geometry")
    return rows.withColumn("reason", reason).select(*(F.when(F.col("reason").isNull(), v).alias(k) for k, v in values.items()), "reason")


#: Columns of a building group's row.
GROUP_TEXTS = {"geometry": "geom_groupe", "address": "libelle_adr_principale_ban", "city": "libelle_commune_insee", "roof_type": "type_plancher_haut_deperditif"}
GROUP_NUMBERS = {"height": "hauteur_mean", "ground_elevation": "altitude_sol_mean", "footprint_area": "s_geom_groupe", "glazed_ratio": "pourcentage_surface_baie_vitree_exterieur", "wall_area": "surface_mur_exterieur"}
GROUP_LABELS = {"wall_insulation": "type_isolation_mur_exterieur", "upper_floor_insulation": "type_isolation_plancher_haut", "lower_floor_insulation": "type_isolation_plancher_bas", "glazing_type": "type_vitrage"}
GROUP_THERMAL = {"wall_u_value": "u_mur_exterieur", "roof_u_value": "u_plancher_haut_deperditif", "floor_u_value": "u_plancher_bas_brut_deperditif", "window_u_value": "uw", "window_solar_factor": "facteur_solaire_baie_vitree"}
GLAZED = {"north": "surface_vitree_nord", "east": "surface_vitree_est", "south": "surface_vitree_sud", "west": "surface_vitree_ouest"}
ROOF = ("materiaux_toiture_simplifie", "mat_toit_txt", "type_plancher_haut_deperditif")


def building_groups(rows: DataFrame, *keep: str) -> DataFrame:
    """[P-07, P-35, F-06] `keep` columns and building groups of JSON rows (column `row`, one object each); unreadable values are null.

    A label that the row lacks is "not provided", one given as null stays null. glazed_areas: facing and area
    above zero, north to west. roof_unknown: neither material nor type is given. A text that is no JSON object
    gives a row with an empty code. Numbers given for the fictitious flag are read like texts.
    """
    parsed = rows.select(*keep, F.coalesce(F.from_json("row", "map<string,string>"), F.expr("cast(map() as map<string,string>)")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    areas = S.glazed_areas(*(S.as_float(at(c)) for c in GLAZED.values()))
    values = {
        "code": F.coalesce(at("batiment_groupe_id"), F.lit("")),
        "construction_id": F.coalesce(S.as_code(at("batiment_construction_id")), S.as_code(at("rnb_id"))),
        **{k: at(c) for k, c in GROUP_TEXTS.items()},
        **{k: S.as_float(at(c)) for k, c in GROUP_NUMBERS.items()},
        "storeys": S.as_int(at("nb_niveau")),
        "fictitious": S.as_bool(at("contient_fictive_geom_groupe")),
        "glazed_areas": areas,
        "orientations": F.coalesce(S.as_text_array(at("l_orientation_baie_vitree")), F.expr("cast(array() as array<string>)")),
        "roof_material": F.coalesce(F.nullif(at(ROOF[0]), F.lit("")), at(ROOF[1])),
        **{k: F.when(F.map_contains_key("m", F.lit(c)), at(c)).otherwise(S.NOT_PROVIDED) for k, c in GROUP_LABELS.items()},
        **{k: S.bounded(S.as_float(at(c)), k == "window_solar_factor") for k, c in GROUP_THERMAL.items()},
        "roof_unknown": F.coalesce(*map(at, ROOF)).isNull(),
    }
    return parsed.select(*keep, *(v.alias(k) for k, v in values.items()))


def best_match(df: DataFrame, key: str, ident: str, score: str, country: str, order: str, least: float = 0.8, margin: float = 0.05, served: tuple = ("E", "W", "S")) -> DataFrame:
    """[S-10, W-03] per key the best candidate and a reason: low_score, ambiguous, unsupported_country, missing_id or matched.

    A missing score counts as 0, equal ones stand by `order`. A close runner-up is ambiguous only if its id differs.
    """
    value = F.coalesce(F.col(score), F.lit(0.0))
    ranked = W.partitionBy(key).orderBy(value.desc(), F.col(order))
    ahead = lambda c: F.lead(c).over(ranked)
    rows = df.select(key, ident, value.alias(score), country, order, F.row_number().over(ranked).alias("_n"), ahead(value).alias("_next"), ahead(F.col(ident)).alias("_id"))
    close = F.col("_next").isNotNull() & ~F.col("_id").eqNullSafe(F.col(ident)) & (F.col(score) - F.col("_next") < margin)
    reason = F.when(F.col(score) < least, "low_score").when(close, "ambiguous").when(~F.coalesce(F.col(country).isin(*served), F.lit(False)), "unsupported_country").when(F.col(ident).isNull(), "missing_id").otherwise("matched")
    return rows.filter("_n = 1").select(key, ident, score, reason.alias("reason"))


def consensus(df: DataFrame, key: str, value: str, unknown: tuple = ()) -> DataFrame:
    """[A-04] per key a value that all sources give, and the status: missing, conflicting, incomplete_source_coverage or available.

    Null, and what `unknown` lists (such as "" and a sentinel), is not known. Only where all sources agree is there a value.
    """
    known = F.when(~F.col(value).isin(*unknown), F.col(value)) if unknown else F.col(value)
    n, k = F.count(F.lit(1)), F.count(known)
    status = F.when(k == 0, "missing").when(F.min(known) != F.max(known), "conflicting").when(k < n, "incomplete_source_coverage").otherwise("available")
    return df.groupBy(key).agg(status.alias("status"), F.when((k == n) & (F.min(known) == F.max(known)), F.min(known)).alias("value"), k.alias("n_known"), n.alias("n_sources"))


def union_coverage(groups: DataFrame, outlines: DataFrame, cell: float, least: float = 0.9, slack: float = 1.05) -> DataFrame:
    """[J-07] a, b, decision for each group (a, x0, y0, x1, y1) and outline (b, likewise) that overlap.

    Outlines that lie in a group by `least` are linked to it if their union covers it by `least`, and groups that lie
    in an outline likewise to that. Where those together are larger than their union by `slack`, they are ambiguous.
    """
    corners = ("x0", "y0", "x1", "y1")
    pairs = box_join(groups.withColumnsRenamed({c: f"l{c}" for c in corners}), outlines.withColumnsRenamed({c: f"r{c}" for c in corners}), cell)
    pairs = cut(pairs.withColumn("area", overlap()).filter("area > 0"))
    size = lambda s: (F.col(f"{s}x1") - F.col(f"{s}x0")) * (F.col(f"{s}y1") - F.col(f"{s}y0"))
    box = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, corners, strict=True)))
    common = box(F.greatest("lx0", "rx0"), F.greatest("ly0", "ry0"), F.least("lx1", "rx1"), F.least("ly1", "ry1"))

    def side(key: str, own: str, other: str) -> DataFrame:
        """Of each `key`: whether the members that lie in it are ambiguous, and whether they cover it."""
        inside = pairs.filter(F.col("area") >= least * size(other))
        sums = inside.groupBy(key).agg(F.sum(size(other)).alias("sum"), F.first(size(own)).alias("size"), F.collect_list(box(*(F.col(f"{other}{c}") for c in corners))).alias("whole"), F.collect_list(common).alias("clipped"))
        return sums.select(key, (F.col("sum") > slack * S.union_area(F.col("whole"))).alias(f"{key}_ambiguous"), (S.union_area(F.col("clipped")) >= least * F.col("size")).alias(f"{key}_covered"))

    joined = pairs.join(side("a", "l", "r").hint("merge"), "a", "left").join(side("b", "r", "l").hint("merge"), "b", "left")
    met = lambda what: F.coalesce((F.col("area") >= least * size("r")) & F.col(f"a_{what}"), F.lit(False)) | F.coalesce((F.col("area") >= least * size("l")) & F.col(f"b_{what}"), F.lit(False))
    decision = F.when(met("ambiguous"), "ambiguous_overlap").when(met("covered"), "spatial_union").otherwise("insufficient_bidirectional_coverage")
    return joined.select("a", "b", decision.alias("decision"))


def cardinality(links: DataFrame, source: str, unit: str) -> DataFrame:
    """[A-12] shared_physical_unit, group_member or one_to_one for each link."""
    pairs = links.select(source, unit).distinct()
    by_unit = pairs.groupBy(unit).agg(F.count(F.lit(1)).alias("_s"))
    by_source = pairs.groupBy(source).agg(F.count(F.lit(1)).alias("_u"))
    kind = F.when(F.col("_s") > 1, "shared_physical_unit").when(F.col("_u") > 1, "group_member").otherwise("one_to_one")
    return pairs.join(by_unit.hint("merge"), unit).join(by_source.hint("merge"), source).select(source, unit, kind.alias("relationship"))


def _placed(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """The rows with their place (from 0) in the whole order, and _n, the number of all.

    Ranges of the order are sorted apart and numbered as they are written; the counts of the ranges before (a row for
    each shuffle partition) give each range its first place. One shuffle; no task has more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(2**33 - 1)
    ranged = cut(ranged.withColumn("_part", part).withColumn("_i", within).drop("_id"))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.orderBy("_part")
    before = counts.select("_part", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.sum("_c").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"))
    return ranged.join(F.broadcast(before), "_part").withColumn(place, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def ordered(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """[O-03] the rows with their place (from 0) in the whole order; see _placed."""
    return _placed(df, order, place).drop("_n")


def stride_sample(df: DataFrame, order: list[str], most: int = 20_000) -> DataFrame:
    """[W-02] every stride-th row in order, with the least stride that leaves at most `most` rows."""
    stride = F.ceil(F.col("_n") / most)
    return _placed(df, order, "_place").filter(F.col("_place") % stride == 0).drop("_place", "_n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """[U-06, M-09] rows that one side has more often, as often as that, with the side's name; none if the inventories are equal."""
    columns = a.columns
    both = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    side = F.when(F.col("_d") > 0, "left").otherwise("right").alias("side")
    return net.select(*columns, side, F.explode(F.sequence(F.lit(1), F.abs("_d"))).alias("_k")).drop("_k")
