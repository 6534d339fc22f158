"""From addresses to building groups: relations, rows completed from other tables, and walls, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relations as R

#: Labels that the merged table keeps even where it gives null, and columns that the roof tables add.
KEPT_NULL = list(R.GROUP_LABELS.values())
ROOF_COLUMNS = ["mat_toit_txt", "materiaux_toiture_simplifie"]

_MAP = "map<string,string>"


def merged(row: Column, extra: Column, keep_null: list[str], only: list[str] | None = None) -> Column:
    """[J-02] a map completed from another: nulls are filled, but a key in keep_null only where the row lacks it; `only` names the keys that may be added."""
    held = lambda k: F.try_element_at(row, k)
    wanted = lambda k: k.isin(only) if only else F.lit(True)
    added = F.map_filter(extra, lambda k, v: wanted(k) & F.when(k.isin(keep_null), ~F.map_contains_key(row, k)).otherwise(v.isNotNull() & held(k).isNull()))
    return F.when(extra.isNull(), row).otherwise(F.map_concat(F.map_filter(row, lambda k, v: ~F.map_contains_key(added, k)), added))


def wall_list(v: Column) -> Column:
    """[S-09] the walls of a JSON list or single object as array<map<string, string>>; what is no object is left out, unreadable texts have none."""
    t = F.trim(v)
    items = F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t), "array<string>")
    objects = F.filter(F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x: F.from_json(x, _MAP)), lambda m: m.isNotNull())
    return F.coalesce(objects, F.expr(f"cast(array() as array<{_MAP}>)"))


def _one_row(df: DataFrame, value: str, name: str) -> DataFrame:
    """A row for each group: a table's least text, should it have several."""
    return df.filter(F.col("batiment_groupe_id").isNotNull()).groupBy("batiment_groupe_id").agg(F.min(value).alias(name))


def completed(groups: DataFrame, dpe: DataFrame, roofs: list[DataFrame]) -> DataFrame:
    """[J-02, S-26] batiment_groupe_id, row: JSON rows of groups completed from those of the energy table, then from each roof table while the roof is unknown.

    All tables have (batiment_groupe_id, row). Values that are arrays stay texts in the row given.
    """
    parsed = lambda df, name: _one_row(df, "row", name).select("batiment_groupe_id", F.from_json(name, _MAP).alias(name))
    out = parsed(groups, "m").filter("m is not null").join(parsed(dpe, "e"), "batiment_groupe_id", "left")
    out = out.select("batiment_groupe_id", merged(F.col("m"), F.col("e"), KEPT_NULL).alias("m"))
    for table, column in zip(roofs, ROOF_COLUMNS, strict=True):
        known = F.coalesce(*(F.try_element_at("m", F.lit(c)) for c in R.ROOF)).isNotNull()
        out = out.join(parsed(table, "e"), "batiment_groupe_id", "left")
        out = out.select("batiment_groupe_id", F.when(known, F.col("m")).otherwise(merged(F.col("m"), F.col("e"), [], [column])).alias("m"))
    return out.select("batiment_groupe_id", F.to_json("m").alias("row"))


def addressed(addresses: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """[S-07, J-01, W-01, O-01] query, batiment_groupe_id, place, reason: the groups of each address (query, key), in order.

    Of the links (key, pos, batiment_groupe_id) of a key the first `most` are read; of repeated groups among them the first counts, blanks don't.
    reason is address_not_found for a null key, building_not_found for one without a group; the group is null then.
    """
    read = R.first_rows(links.filter(F.col("key").isNotNull()), ["key"], ["pos", "batiment_groupe_id"], most).filter("batiment_groupe_id <> ''")
    own = read.groupBy("key", "batiment_groupe_id").agg(F.min("pos").alias("place"))
    reason = F.when(F.col("key").isNull(), "address_not_found").when(F.col("batiment_groupe_id").isNull(), "building_not_found")
    return addresses.select("query", "key").join(own, "key", "left").select("query", "batiment_groupe_id", "place", reason.alias("reason"))


def buildings_of(found: DataFrame, rows: DataFrame, walls: DataFrame) -> DataFrame:
    """[S-26, J-01, J-03] query, place, reason, walls and the columns of building_groups for addressed groups.

    A group without a row is left out; addresses with a reason stay, with null values. walls: (batiment_groupe_id, wall_dict), of which a group may have none.
    """
    held = _one_row(walls, "wall_dict", "wall_dict").select("batiment_groupe_id", wall_list(F.col("wall_dict")).alias("walls"))
    whole = found.filter("reason is null").join(rows, "batiment_groupe_id").join(held, "batiment_groupe_id", "left")
    built = R.building_groups(whole, "query", "place", "reason", "walls").withColumn("walls", F.coalesce("walls", F.expr(f"cast(array() as array<{_MAP}>)")))
    return built.unionByName(found.filter("reason is not null").select("query", "place", "reason"), allowMissingColumns=True)
