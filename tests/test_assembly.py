from pyspark.sql import functions as F

from masonry.operators import assembly as A

TABLE = "batiment_groupe_id string, row string"


def test_rows_are_completed(spark):
    groups = spark.createDataFrame([("a", '{"batiment_groupe_id": "a", "type_vitrage": null, "uw": null, "l_orientation_baie_vitree": ["nord"]}'), ("b", '{"batiment_groupe_id": "b", "mat_toit_txt": "TUILES", "uw": 1}'), ("c", "[oops"), (None, "{}")], TABLE)
    dpe = spark.createDataFrame([("a", '{"type_vitrage": "double", "type_isolation_plancher_bas": "ITI", "uw": 2.5}'), ("b", '{"uw": 9, "type_vitrage": null}')], TABLE)
    roofs = [spark.createDataFrame(r, TABLE) for r in ([("b", '{"mat_toit_txt": "ZINC"}'), ("a", '{"mat_toit_txt": null, "uw": 7}')], [("a", '{"materiaux_toiture_simplifie": "ARDOISES"}'), ("b", '{"materiaux_toiture_simplifie": "BETON"}')])]
    rows = A.completed(groups, dpe, roofs)
    links = spark.createDataFrame([("k", 3, "b"), ("k", 1, None), ("k", 2, "a"), ("k", 4, "a"), ("k", 5, "z"), ("k", 6, "c"), ("e", 1, "")], "key string, pos int, batiment_groupe_id string")
    addresses = spark.createDataFrame([("q1", "k"), ("q2", None), ("q3", "e"), ("q4", "none")], "query string, key string")
    walls = spark.createDataFrame([("a", '[{"area": 3, "type": "roof"}, "x", null]')], "batiment_groupe_id string, wall_dict string")
    found = {(r.query, r.code): r for r in A.buildings_of(A.addressed(addresses, links), rows, walls).collect()}
    assert set(found) == {("q1", "a"), ("q1", "b"), ("q2", None), ("q3", None), ("q4", None)}
    a, b = found["q1", "a"], found["q1", "b"]
    assert (a.place, a.glazing_type, a.lower_floor_insulation, a.window_u_value, a.roof_material, a.orientations, a.walls) == (2, None, "ITI", 2.5, "ARDOISES", ["nord"], [{"area": "3", "type": "roof"}])
    assert (b.place, b.glazing_type, b.window_u_value, b.roof_material, b.walls) == (3, None, 1.0, "TUILES", [])
    assert [found[q, None].reason for q in ("q2", "q3", "q4")] == ["address_not_found", "building_not_found", "building_not_found"]
    assert {r.batiment_groupe_id for r in A.addressed(addresses, links, 2).filter("reason is null").collect()} == {"a"}


def test_walls(spark):
    cases = ['[{"a": 1}, 2, null, {"b": null}]', '{"a": 1}', "oops", "", None, "[]", "5"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(A.wall_list(F.col("v"))).collect()
    assert [r[0] for r in rows] == [[{"a": "1"}, {"b": None}], [{"a": "1"}], [], [], [], [], []]
