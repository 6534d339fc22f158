import json
import random

from pyspark.sql import functions as F

from masonry.functions import scalars as S
from masonry.operators import metadata as M


def test_rounding_follows_binary_values(spark):
    rng = random.Random(5)
    xs = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 1e15 + 0.3, 0.0, 5.0] + [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.randrange(10**6) / 8 for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.rounded(F.col("x")).alias("two"), S.rounded(F.col("x"), 0).alias("none")).collect()
    assert [(r.two, r.none) for r in rows] == [(round(x, 2), round(x, 0)) for x in xs]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(S.rounded(F.col("x"))).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and odd[2][0] == float("inf")


BUILDING = "code string, provider string, country string, address string, city string, footprint_area double, storeys int, height double, wall_u_value double"


def test_portfolio_is_one_document(spark, tmp_path):
    rows = [("b", "bdnb", "FR", "1 rue d'Été 31000 Toulouse", "Toulouse", 115.004, 5, 15.0, 1.234567), ("a", "os", "GB", '1 "High" Street', None, 499.0, 5, None, None), ("c", None, None, None, None, None, 3, None, None)]
    path = str(tmp_path / "out")
    M.save_portfolio(spark.createDataFrame(rows, BUILDING), path, ["code"], ["here"])
    text = "\n".join(p.read_text("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    found = json.loads(text)
    assert [b["building_id"] for b in found["buildings"]] == ["a", "b", "c"] and "Été" in text
    assert {k: v for k, v in found.items() if k != "buildings"} == {"source_addresses": ["here"], "building_count": 3, "total_footprint_area_m2": 614.0, "total_estimated_floor_area_m2": 3070.02}
    a, b, c = found["buildings"]
    assert (b["footprint_area_m2"], b["estimated_floor_area_m2"], b["bdnb_id"], b["os_id"], b["thermal_properties"]["wall_u_value_w_m2k"]) == (115.0, 575.02, "b", None, 1.234567)
    assert (a["os_id"], a["address"], a["height_m"], c["footprint_area_m2"], c["estimated_floor_area_m2"]) == ("a", '1 "High" Street', None, None, None)
    assert b["description"].startswith("5-storey building located at 1 rue d'Été, in Toulouse, with an approximate footprint of 115 m²")
    assert c["description"] == "3-storey building."


def test_empty_portfolio(spark, tmp_path):
    empty = spark.createDataFrame([], BUILDING)
    lines = [r.line for r in M.portfolio_lines(empty, ["code"]).orderBy("place").collect()]
    assert json.loads("".join(lines)) == {"source_addresses": [], "building_count": 0, "total_footprint_area_m2": None, "total_estimated_floor_area_m2": None, "buildings": []}
