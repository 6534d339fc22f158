"""Queries on metadata; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as M
from ..sources.views import BLD, buildings
from .portfolio import query

#: Eighths hold ties of two decimals, sevenths none.
KNOWN = f"""{BLD}, k AS (SELECT code, CASE WHEN code % 9 > 0 THEN w * d / 8.0 END AS area, storeys, height / 7.0 AS height, CASE WHEN code % 4 > 0 THEN (code % 100) / 8.0 END AS ground, CASE code % 3 WHEN 0 THEN 'bdnb' WHEN 1 THEN 'os' END AS provider, name, CASE WHEN code % 2 = 0 THEN material END AS material FROM bld)"""


def _known(spark, sf):
    code = F.col("code")
    return buildings(spark, sf).select(
        "code", F.when(code % 9 > 0, F.col("w") * F.col("d") / 8).alias("footprint_area"), "storeys", (F.col("height") / 7).alias("height"), F.when(code % 4 > 0, code % 100 / 8).alias("ground_elevation"),
        F.when(code % 3 == 0, "bdnb").when(code % 3 == 1, "os").alias("provider"), F.col("name").alias("address"), F.when(code % 2 == 0, F.col("material")).alias("roof_material"), F.lit("GB").alias("country"),
    )


@query(f"""WITH {KNOWN} SELECT CAST(code AS VARCHAR) AS building_id, provider, name AS address, round_even(area, 2) AS footprint_area_m2, storeys AS number_of_storeys, round_even(height, 2) AS height_m, round_even(ground, 2) AS ground_elevation_m, round_even(area * storeys, 2) AS estimated_floor_area_m2, material AS roof_material,
 CASE WHEN provider = 'bdnb' THEN 'representative_dpe_not_face_measurements' ELSE 'provider_building_not_face_measurements' END AS scope, CASE WHEN provider = 'bdnb' THEN CAST(code AS VARCHAR) END AS bdnb_id, CASE WHEN provider = 'os' THEN CAST(code AS VARCHAR) END AS os_id FROM k""")
def building_metadata(spark, sf):
    """[P-25, P-26] what is known of each building; ties of two decimals go to the even digit."""
    known = _known(spark, sf)
    names = ("building_id", "provider", "address", "footprint_area_m2", "number_of_storeys", "height_m", "ground_elevation_m", "estimated_floor_area_m2", "roof_material", "bdnb_id", "os_id")
    return known.select(M.building_metadata(known).alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in names), F.col("m.thermal_properties.scope").alias("scope"))


@query(f"""WITH {KNOWN}, r AS (SELECT code, row_number() OVER (ORDER BY code) AS place, round_even(area, 2) AS area, storeys FROM k), n AS (SELECT count(*) AS n FROM bld)
 SELECT place, CAST(code AS VARCHAR) AS building_id, area AS footprint_area_m2, CAST(storeys AS BIGINT) AS number_of_storeys, place > 1 AS comma FROM r UNION ALL SELECT 0, NULL, NULL, NULL, false UNION ALL SELECT n + 1, NULL, NULL, NULL, false FROM n""")
def portfolio_document(spark, sf):
    """[K-01] the lines of a portfolio's JSON document, read back: buildings in order between the totals and the end."""
    lines = M.portfolio_lines(_known(spark, sf), ["code"])
    at = lambda k: F.get_json_object(F.ltrim(F.col("line"), F.lit(",")), f"$.{k}")
    return lines.select("place", at("building_id").alias("building_id"), at("footprint_area_m2").cast("double").alias("footprint_area_m2"), at("number_of_storeys").cast("long").alias("number_of_storeys"), F.col("line").startswith(",").alias("comma"))


@query(f"WITH {KNOWN} SELECT count(*) AS building_count, round(sum(round_even(area, 2)), 2) AS total_footprint_area_m2, round(sum(round_even(area * storeys, 2)), 2) AS total_estimated_floor_area_m2 FROM k")
def portfolio_summary(spark, sf):
    """[K-01, A-02] totals of a portfolio's metadata."""
    known = _known(spark, sf)
    return M.portfolio_totals(known.select(M.building_metadata(known).alias("metadata")))
