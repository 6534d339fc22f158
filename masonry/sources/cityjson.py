"""Reader of CityJSONSeq: a header line for each file, then a feature on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings as P

#: Versions that are read, and the level of detail that is taken unless another is named.
VERSIONS, LOD = ["1.0", "1.1", "2.0"], "2.2"

_LINE = """struct<type: string, version: string, transform: struct<scale: array<double>, translate: array<double>>, vertices: array<array<double>>,
    CityObjects: map<string, struct<type: string, geometry: array<struct<type: string, lod: string, boundaries: string>>>>>"""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source (the file), value of every line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")


def solids(df: DataFrame, lod: str = LOD) -> DataFrame:
    """[S-21] source, solid, shell (its faces: rings of struct<x, y, z>), reason of every object with geometry in lines (source, value).

    The header may be in any split of its file; its transform is joined to the file's features, and vertices are
    taken by their index from the feature's own. reason: cityjson_invalid for lines that are no JSON (solid is null),
    files without exactly one header of a known version, features with a transform of their own, without readable vertices or with an index
    beyond them; lod_unavailable without a geometry of the level named; unsupported_geometry for others than Solids of
    one shell, or several of that level. shell is null then.
    """
    rows = P.once(df.filter(F.trim("value") != ""), "j", F.from_json("value", _LINE, {"mode": "PERMISSIVE"})).select("source", "j")
    head = rows.filter(F.col("j.type") == "CityJSON").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("j.version").alias("version"), F.min("j.transform").alias("h"))
    fine = (F.col("n") == 1) & F.col("version").isin(VERSIONS) & (F.col("h").isNull() | ((F.size("h.scale") == 3) & (F.size("h.translate") == 3) & F.forall("h.scale", lambda v: v > 0)))
    rest = rows.filter(F.coalesce(F.col("j.type") != "CityJSON", F.lit(True))).join(F.broadcast(head.withColumn("fine", F.coalesce(fine, F.lit(False)))), "source", "left")
    objects = rest.select("source", "h", "fine", "j", F.explode_outer(F.map_entries("j.CityObjects")).alias("o")).select("source", "h", "fine", F.col("o.key").alias("solid"), F.col("j.type").alias("type"), F.col("j.transform").alias("own"), F.col("j.vertices").alias("vertices"), F.col("o.value.geometry").alias("geometry"))
    objects = objects.filter(F.col("solid").isNull() | (F.size("geometry") > 0))
    named = objects.withColumn("g", F.filter("geometry", lambda g: g["lod"] == lod))
    shells = F.from_json(F.get("g", F.lit(0))["boundaries"], "array<array<array<array<int>>>>")
    # F.min of headers could hide a second one, so files with more than one are not fine
    named = named.withColumn("shells", shells).withColumn("index", F.flatten(F.flatten(F.flatten("shells"))))
    broken = ~F.coalesce(F.col("fine"), F.lit(False)) | F.col("solid").isNull() | (F.col("type") != "CityJSONFeature") | F.col("own").isNotNull() | ~F.coalesce(F.forall("vertices", lambda v: F.size(v) == 3), F.lit(False))
    beyond = F.coalesce(F.exists("index", lambda i: (i < 0) | (i >= F.size("vertices"))), F.lit(False))
    solid = (F.size("g") == 1) & (F.get("g", F.lit(0))["type"] == "Solid") & (F.size("shells") == 1)
    reason = F.when(broken, "cityjson_invalid").when(F.size("g") == 0, "lod_unavailable").when(~F.coalesce(solid, F.lit(False)), "unsupported_geometry").when(beyond, "cityjson_invalid")
    axis = lambda v, k: v[k] * F.coalesce(F.col("h.scale")[k], F.lit(1.0)) + F.coalesce(F.col("h.translate")[k], F.lit(0.0))
    at = lambda i: F.struct(*(axis(F.get("vertices", i), k).alias(c) for k, c in enumerate("xyz")))
    drawn = F.transform(F.get("shells", F.lit(0)), lambda face: F.transform(face, lambda ring: F.transform(ring, at)))
    return P.once(named, "reason", reason).select("source", "solid", F.when(F.col("reason").isNull(), drawn).alias("shell"), "reason")


def faces(df: DataFrame) -> DataFrame:
    """Face rows (solid, face, rings) of the solids without a reason."""
    return df.filter("reason is null").select("solid", F.posexplode("shell").alias("face", "rings"))
