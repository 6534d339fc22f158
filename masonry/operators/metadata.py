"""Descriptions of source buildings and of a portfolio as JSON; unknown values stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relations import ordered

#: Columns of a building and what the metadata call them; numbers are rounded to two decimals.
MEASURES = {"footprint_area": "footprint_area_m2", "height": "height_m", "ground_elevation": "ground_elevation_m", "glazed_ratio": "glazing_ratio"}
TEXTS = ("glazing_type", "wall_insulation", "upper_floor_insulation", "lower_floor_insulation", "roof_material", "roof_type", "roof_shape")
THERMAL = {"wall_u_value": "wall_u_value_w_m2k", "roof_u_value": "upper_floor_u_value_w_m2k", "floor_u_value": "lower_floor_raw_u_value_w_m2k", "window_u_value": "window_uw_w_m2k", "window_solar_factor": "window_solar_factor"}
TYPES = {"code": "string", "provider": "string", "country": "string", "crs": "string", "address": "string", "city": "string", "storeys": "int", "fictitious": "boolean", **dict.fromkeys((*MEASURES, *THERMAL), "double"), **dict.fromkeys(TEXTS, "string")}


def building_metadata(df: DataFrame) -> Column:
    """[P-25, P-26, K-01] a struct of what is known of a building; columns that `df` lacks are null.

    The floor area is known only where both area and storeys are. Thermal values of provider bdnb describe a
    representative dwelling, which `scope` says. `bdnb_id` or `os_id` repeats the code for these two providers and is null otherwise.
    """
    at = lambda c: F.col(c).cast(TYPES[c]) if c in df.columns else F.lit(None).cast(TYPES[c])
    bdnb, named = F.coalesce(at("provider") == "bdnb", F.lit(False)), lambda c: (at(c).alias(c))
    measure = lambda c: S.rounded(at(c)).alias(MEASURES[c])
    scope = F.when(bdnb, "representative_dpe_not_face_measurements").otherwise("provider_building_not_face_measurements").alias("scope")
    return F.struct(
        at("code").alias("building_id"), *map(named, ("provider", "country", "crs", "address", "city")),
        measure("footprint_area"), at("storeys").alias("number_of_storeys"), measure("height"), measure("ground_elevation"),
        S.rounded(at("footprint_area") * at("storeys")).alias("estimated_floor_area_m2"), at("fictitious").alias("fictitious_geometry"), measure("glazed_ratio"), *map(named, TEXTS),
        F.struct(scope, *(at(c).alias(n) for c, n in THERMAL.items())).alias("thermal_properties"),
        F.when(bdnb, at("code")).alias("bdnb_id"), F.when(at("provider") == "os", at("code")).alias("os_id"),
        S.description(at("storeys"), at("address"), at("city"), at("footprint_area"), at("height"), F.coalesce(at("country") == "FR", F.lit(False))).alias("description"),
    )


def portfolio_totals(described: DataFrame) -> DataFrame:
    """[A-01, A-02, K-01] one row of the totals of `metadata` (see building_metadata): sums of the rounded areas that are known, null if none is."""
    total = lambda c: S.rounded(F.sum(F.col("metadata")[c])).alias(f"total_{c}")
    return described.agg(F.count(F.lit(1)).alias("building_count"), total("footprint_area_m2"), total("estimated_floor_area_m2"))


def portfolio_lines(buildings: DataFrame, order: list[str], source_addresses: list[str] = ()) -> DataFrame:
    """[K-01] place, line: the lines of one JSON document in order: totals, then a line for each building, then the end.

    `order` must tell all rows apart. Lines are made where the rows are; only the totals are one row. See save_portfolio.
    """
    described = buildings.withColumn("metadata", building_metadata(buildings))
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    rows = ordered(described.select(*order, text(F.col("metadata")).alias("json")), order, "place")
    body = rows.select((F.col("place") + 1).alias("place"), F.concat(F.when(F.col("place") > 0, ",").otherwise(""), F.col("json")).alias("line"))
    totals = portfolio_totals(described)
    addresses = F.array(*map(F.lit, source_addresses)) if source_addresses else F.array().cast("array<string>")
    head = text(F.struct(addresses.alias("source_addresses"), "building_count", "total_footprint_area_m2", "total_estimated_floor_area_m2"))
    opening = totals.select(F.lit(0).cast("long").alias("place"), F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"buildings":[')).alias("line"))
    return body.union(opening).union(totals.select((F.col("building_count") + 1).alias("place"), F.lit("]}").alias("line")))


def save_portfolio(buildings: DataFrame, path: str, order: list[str], source_addresses: list[str] = ()) -> None:
    """[K-01] the document as text files in `path`, ranges of its lines: read in the order of their names they are one JSON text in UTF-8.

    An existing folder is an error.
    """
    lines = portfolio_lines(buildings, order, source_addresses)
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(path)
