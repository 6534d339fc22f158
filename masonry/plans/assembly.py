"""Queries from addresses to building groups; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..sources.views import table
from .portfolio import query


@query("""WITH rel AS (SELECT o_custkey AS key, o_orderkey AS pos, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey % 200 END AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
 own AS (SELECT key, k, min(pos) AS place FROM rel WHERE n <= 4 AND k IS NOT NULL GROUP BY ALL), adr AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS key FROM customer),
 f AS (SELECT query, k, place, CASE WHEN adr.key IS NULL THEN 'address_not_found' WHEN k IS NULL THEN 'building_not_found' END AS reason FROM adr LEFT JOIN own USING (key)), p AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 13 > 0)
 SELECT query, place, reason, 'g' || k AS code, CASE WHEN k % 4 > 0 THEN s / 4.0 END AS height, CASE WHEN k % 5 = 0 THEN 1.5 WHEN k % 2 = 0 THEN 2.5 END AS window_u_value,
 CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'double' ELSE 'not provided' END AS glazing_type, CASE WHEN k % 2 = 0 THEN 'ITE' ELSE 'not provided' END AS wall_insulation,
 CASE WHEN k % 6 = 0 THEN 'TUILES' WHEN k % 3 = 0 THEN 'ARDOISES' WHEN k % 5 = 0 THEN 'ZINC' END AS roof_material, CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_walls, k % 3 > 0 AND k % 5 > 0 AS roof_unknown FROM f JOIN p USING (k) WHERE reason IS NULL
 UNION ALL SELECT query, NULL, reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE reason IS NOT NULL""")
def address_buildings(spark, sf):
    """[S-07, S-09, S-26, J-01 to J-03] addresses to completed building groups with their walls; keys that are unknown, groups without a row."""
    k = F.col("p_partkey")
    part, ident = table(spark, sf, "part"), F.concat(F.lit("g"), k.cast("string")).alias("batiment_groupe_id")
    piece = lambda keep, text: F.when(keep, text).otherwise("")
    row = F.concat(
        F.lit('{"batiment_groupe_id": "g'), k.cast("string"), F.lit('", "hauteur_mean": '), F.when(k % 4 > 0, (F.col("p_size") / 4).cast("string")).otherwise("null"),
        piece(k % 6 == 0, ', "mat_toit_txt": "TUILES"'), piece(k % 3 == 0, ', "type_vitrage": null'), piece(k % 5 == 0, ', "uw": 1.5'), F.lit("}"),
    )
    fixed = lambda keep, text: part.filter(keep).select(ident, F.lit(text).alias("row"))
    dpe = fixed(k % 2 == 0, '{"type_vitrage": "double", "uw": 2.5, "type_isolation_mur_exterieur": "ITE"}')
    roofs = [fixed(k % 3 == 0, '{"mat_toit_txt": "ARDOISES", "uw": 9}'), fixed(k % 5 == 0, '{"materiaux_toiture_simplifie": "ZINC"}')]
    walls = part.filter(k % 4 < 3).select(ident, F.when(k % 4 == 0, '[{"area": 3}, 5, {"area": 4}]').when(k % 4 == 1, '{"area": 1}').otherwise("oops").alias("wall_dict"))
    rows = A.completed(part.filter(k % 13 > 0).select(ident, row.alias("row")), dpe, roofs)
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    addresses = table(spark, sf, "customer").select(c.alias("query"), F.when(c % 11 > 0, c).alias("key"))
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), o.alias("pos"), F.when(o % 17 > 0, F.concat(F.lit("g"), (o % 200).cast("string"))).alias("batiment_groupe_id"))
    found = A.buildings_of(A.addressed(addresses, links, 4), rows, walls)
    return found.select("query", "place", "reason", "code", "height", "window_u_value", "glazing_type", "wall_insulation", "roof_material", F.when(F.col("walls").isNotNull(), F.size("walls")).cast("long").alias("n_walls"), "roof_unknown")
