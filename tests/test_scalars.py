"""Column functions on literal cases."""

from pyspark.sql import functions as F

from masonry.functions import scalars as S
from masonry.operators import relations as R
from masonry.operators import spatial as G


def values(spark, rows, column, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_lenient_numbers_and_ids(spark):
    assert values(spark, ["1.5", " 2 ", "x", "", None], S.as_float) == [1.5, 2.0, None, None, None]
    assert values(spark, ["7.9", "-7.9", "NaN", "inf", "x", None], S.as_int) == [7, -7, None, None, None, None]
    assert values(spark, ["Vrai", " T ", "yes", "1", "no", "", None], S.as_bool) == [True, True, True, True, False, False, None]
    assert values(spark, [" a ", "  ", None], S.as_code) == ["a", None, None]


def test_arrays(spark):
    assert values(spark, ['{a, "b" ,,c}', "x", "", None], S.as_text_array) == [["a", "b", "c"], ["x"], [], None]
    ids = values(spark, ["A,B", ' ["b", "a", "b", "", 3] ', '{b,"a", }', "", "x", "[oops", None], S.identifiers)
    assert ids == [["A,B"], ["3", "a", "b"], ["a", "b"], [], ["x"], None, []]


def test_labels_and_folding(spark):
    assert values(spark, ["ÉTANCHÉITÉ œuvre", "é", "Tôle", None], S.fold) == ["etancheite œuvre", "e", "tole", None]
    assert values(spark, [" Inconnu ", "NON RENSEIGNÉE", "n/a", "Isolé ", "-", "autre", None], S.label) == [None, None, None, "Isolé", None, "autre", None]
    assert values(spark, ["Bac Acier", "Étanchéité", "lauze", "béton et tuiles", None], S.roof_pitch) == [30.0, 0.0, None, 30.0, None]


def test_orientations_and_areas(spark):
    frame = spark.createDataFrame([(["Sud-Est", "Ouest, sud"], 0.0, 2.0), (["?"], 1.0, 0.0), (None, None, None)], "t array<string>, n double, e double")
    areas = S.glazed_areas(F.col("n"), F.col("e"), F.lit(None), F.lit(-1.0))
    rows = frame.select(S.orientations(F.col("t"), areas), F.transform(areas, lambda g: g["facing"])).collect()
    assert [tuple(r) for r in rows] == [(["south", "east", "west"], ["east"]), (["north"], ["north"]), ([], [])]


def test_pitch_and_bounds(spark):
    frame = spark.createDataFrame([("flat", 20.0, "tuile", None), ("pitched", None, None, None), (None, 80.0, None, None), (None, None, None, "Combles"), (None, None, "béton", "tuile"), (None, 3.0, "tuile", None)], "s string, w double, m string, f string")
    assert [r[0] for r in frame.select(S.envelope_pitch(*map(F.col, "swmf"))).collect()] == [None, 30.0, 70.0, 30.0, None, None]
    assert values(spark, [0.5, 0.0, -1.0, float("nan"), float("inf")], S.bounded, "double") == [0.5, None, None, None, None]
    assert values(spark, [0.0, 1.0, 1.1, float("nan")], lambda v: S.bounded(v, solar=True), "double") == [0.0, 1.0, None, None]


def test_addresses(spark):
    rows = ["1 rue X 75002 Paris", "10 Downing St SW1A 2AA", "a, Royaume-Uni", "GIR0AA", "1 St BT1 5GS", "x, Northern Ireland", "75002 uk", "Munuk", "allée X", "avenue X", " ", None, "31000, France"]
    assert values(spark, rows, S.country) == ["FR", "UK", "UK", "UK", "unsupported", "unsupported", "conflict", "unknown", "FR", "unknown", "empty", "empty", "FR"]
    assert values(spark, ["x", "1 St BT1 5GS", ""], lambda v: S.country(v, "gb")) == ["UK", "unsupported", "empty"]
    assert values(spark, ["1 rue X 75002 Paris 31000 Y", " 75002 Paris", "High St", "", None], S.street) == ["1 rue X", "75002 Paris", "High St", None, None]


def test_description(spark):
    frame = spark.createDataFrame([(5, "1 rue X 31000 Y", "Y", 115.4, 9.0), (None, None, "Y", None, None), (2, "High St", None, 10.0, None), (None, "", "", None, 3.25)], "n int, a string, c string, f double, h double")
    got = [r[0] for r in frame.select(S.description(*map(F.col, "nacfh"), F.lit(True))).collect()]
    assert got == [
        "5-storey building located at 1 rue X, in Y, with an approximate footprint of 115 m², an estimated floor area of 577 m², and a height of 9.0 m.",
        "Building located in Y.",
        "2-storey building located at High St, with an approximate footprint of 10 m², and an estimated floor area of 20 m².",
        "Building, with a height of 3.2 m.",
    ]


def test_rings_and_unions(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    frame = spark.createDataFrame([(ring((0, 0), (0.0006, 0), (0.0012, 0), (1, 0), (1, 1), (0, 0)),), (ring((0, 0), (0, 0.0001), (0, 0)),)], "r array<struct<x:double,y:double>>")
    got = [r[0] and [tuple(p) for p in r[0]] for r in frame.select(S.clean_ring(F.col("r"))).collect()]
    assert got == [[(0, 0), (0.0012, 0), (1, 0), (1, 1)], None]
    boxes = spark.createDataFrame([([(0, 0, 4, 4), (2, 2, 6, 6), (0, 0, 1, 1)],), ([],)], "b array<struct<x0:int,y0:int,x1:int,y1:int>>")
    assert [r[0] for r in boxes.select(S.union_area(F.col("b"))).collect()] == [28.0, 0.0]


def test_order_sample_and_difference(spark):
    frame = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k int, v int").repartition(4)
    assert [(r.k, r.n) for r in R.ordered(frame, ["k"], "n").orderBy("k").collect()] == [(i, i) for i in range(101)]
    assert sorted(r.k for r in R.stride_sample(frame, ["k"], 20).collect()) == list(range(0, 101, 6))
    a, b = (spark.createDataFrame([(x,) for x in t], "x string") for t in ("aabc", "abbd"))
    assert sorted(map(tuple, R.difference(a, b).collect())) == [("a", "left"), ("b", "right"), ("c", "left"), ("d", "right")]


def test_british_features(spark):
    features = [
        '{"id": "f1", "geometry": {"type": "Point"}, "properties": {"osid": "o1", "height_relativeroofbase_m": 6, "height_relativemax_m": 9, "numberoffloors": 2.0, "roofshapeaspect_shape": "Pitched"}}',
        '{"id": "f2", "geometry": {"type": "Point"}, "properties": {"osid": "", "height_relativeroofbase_m": 0, "height_relativemax_m": "9", "numberoffloors": 2.5, "roofshapeaspect_shape": "Pitched", "height_absolutemin_m": -3}}',
        '{"id": "f3", "properties": {}}',
        "[oops",
        "",
        None,
    ]
    rows = R.british_buildings(spark.createDataFrame([(f,) for f in features], "feature string")).collect()
    assert tuple(rows[0])[:6] == ("o1", 6.0, 2, None, None, "pitched") and rows[0].reason is None
    assert tuple(rows[1])[:6] == ("f2", 9.0, None, -3.0, None, "flat") and rows[1].reason is None
    assert [r.reason for r in rows[2:]] == ["missing_id_or_geometry", "malformed", "malformed", "malformed"]
    assert all(v is None for r in rows[2:] for v in tuple(r)[:-1])


def test_building_groups(spark):
    texts = [
        '{"batiment_groupe_id": "g1", "rnb_id": " r ", "type_vitrage": null, "surface_vitree_est": "2.5", "surface_vitree_nord": -1, "uw": -1, "facteur_solaire_baie_vitree": 0, "l_orientation_baie_vitree": "{est,\\"sud\\"}", "nb_niveau": "x"}',
        '{"batiment_groupe_id": "g2", "mat_toit_txt": "TUILES", "uw": 1.4, "facteur_solaire_baie_vitree": 1.2, "hauteur_mean": 7, "unknown_column": {"a": 1}}',
        "[oops",
        None,
    ]
    a, b, c, d = R.building_groups(spark.createDataFrame([(t,) for t in texts], "row string")).collect()
    assert (a.code, a.construction_id, a.glazing_type, a.wall_insulation, a.storeys) == ("g1", "r", None, "not provided", None)
    assert [tuple(g) for g in a.glazed_areas] == [("east", 2.5)] and a.orientations == ["est", "sud"]
    assert (a.window_u_value, a.window_solar_factor, a.roof_unknown) == (None, 0.0, True)
    assert (b.roof_material, b.window_u_value, b.window_solar_factor, b.height, b.roof_unknown) == ("TUILES", 1.4, None, 7.0, False)
    arrays = ['["nord", null, "Sud-Est"]', "{est, ,\"ouest\"}", "[]", "[oops", "null"]
    rows = spark.createDataFrame([('{"l_orientation_baie_vitree": %s, "surface_vitree_nord": 2}' % (x if x.startswith('["') or x in ("[]", "null") else '"' + x.replace('"', '\\"') + '"'),) for x in arrays], "row string")
    got = R.building_groups(rows).select("orientations", S.orientations(F.col("orientations"), F.col("glazed_areas"))).collect()
    assert [tuple(r) for r in got] == [(["nord", "Sud-Est"], ["north", "south", "east"]), (["est", "ouest"], ["east", "west"]), ([], ["north"]), (["[oops"], ["north"]), ([], ["north"])]
    assert c.code == d.code == "" and c.glazed_areas == [] and c.orientations == []


def test_extents(spark):
    rows = [("a", 0.0, 0.0, 4.0, 2.0, 5.0, False), ("a", 10.0, 0.0, 12.0, 6.0, None, None), ("b", 0.0, 0.0, 5000.0, 1.0, None, False), ("c", 0.0, 0.0, 1.0, 1.0, None, True), ("d", 0.0, float("nan"), 1.0, 1.0, None, False), ("d", 0.0, 0.0, None, 1.0, None, False)]
    found = {r.k: r for r in G.extents(spark.createDataFrame(rows, "k string, x0 double, y0 double, x1 double, y1 double, ground double, fictitious boolean"), "k").collect()}
    assert tuple(found["a"]) == ("a", -30.0, -30.0, 42.0, 36.0, 6.0, 3.0, 5.0, "EPSG:4326", None)
    assert (found["b"].reason, found["b"].crs, found["b"].reference_elevation) == ("extent_limit", "EPSG:2154", 0.0)
    assert (found["c"].reason, found["d"].reason) == ("fictitious_outline", "invalid_extent")
