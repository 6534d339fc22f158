"""Column functions: lenient coercions, bounded values, classifiers and derived attributes. No UDFs.

"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults that change results.
STOREY_HEIGHT, WWR_LEAST, WWR_MOST = 3.0, 0.01, 0.9
PITCH_DEFAULT, PITCH_LEAST, PITCH_MOST = 30.0, 5.0, 70.0
#: Substrings (accents folded, lower case) of pitched and of flat roof materials.
PITCHED = ["tuile", "ardoise", "zinc", "alumin", "chaume", "bardeau", "shingle", "tole", "bac acier", "fibro", "amiante", "comble", "rampant", "charpente"]
FLAT = ["beton", "terrasse", "gravier", "bitume", "etanch", "membrane"]
#: Labels that mean "unknown".
UNKNOWN = ["", "-", "unknown", "inconnu", "inconnue", "non renseigne", "non renseignee", "non disponible", "not provided", "not_available", "none", "null", "n/a", "na", "nc", "nr", "conflict", "conflicting"]
NOT_PROVIDED = "not provided"
#: What makes an address British or French. Areas outside Great Britain aren't served.
POSTCODE = r"(?i)\b(?:GIR\s*0AA|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
SUFFIX = r"(?i)(?:^|[,\s])(france|fr|uk|gb|united kingdom|great britain|england|scotland|wales|royaume[- ]uni)\s*$"
STREETS = r"(?i)\b(?:rue|chemin|impasse|allee|allée)\b"
NOT_SERVED = r"(?i)^(BT|JE|GY|IM)"


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and the letters without."""
    pairs = {}
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            pairs[chr(i)] = base
    return "".join(pairs), "".join(pairs.values())


def as_float(v: Column) -> Column:
    """[P-01] a double, or null for what is none."""
    return v.try_cast("double")


def finite(v: Column, positive: bool = False) -> Column:
    """[P-09] a finite double, above zero if asked for, else null."""
    x = as_float(v)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~(bad | (x <= 0) if positive else bad), x)


def rounded(v: Column, digits: int = 2) -> Column:
    """[P-26] a double rounded to `digits` decimals by its binary value, as languages with exact decimal conversion do: 2.675 is below the tie and gives 2.67, 0.125 is one and goes to the even 0.12.

    Null stays null, NaN and infinities stay as they are. Where the scaled value passes 2^52 the decimal text is rounded instead.
    The product with 10^digits and its exact error come from splitting the factor in two halves of 26 bits.
    """
    x, scale = v.cast("double"), float(10**digits)
    split = x * 134217729.0
    high = split - (split - x)
    p = x * scale
    error = (high * scale - p) + (x - high) * scale
    f = F.floor(p)
    above = p - f
    up = (above > 0.5) | ((above == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(f, F.lit(2)) == 1))))
    return F.when(~(F.abs(x) < float("inf")), x).when(F.abs(p) < 2.0**52, (f + up.cast("int")) / scale).otherwise(F.round(x, digits))


def as_int(v: Column) -> Column:
    """[P-02] truncated toward zero; null for text, NaN and infinity."""
    x = as_float(v)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x.try_cast("int"))


def as_bool(v: Column) -> Column:
    """[P-03] of a text: true for a few words, false for other text, null for null."""
    return F.when(v.isNotNull(), F.lower(F.trim(v)).isin("true", "t", "vrai", "1", "yes"))


def as_code(v: Column) -> Column:
    """[P-04] trimmed; blank is null."""
    return F.nullif(F.trim(v), F.lit(""))


def as_text_array(v: Column) -> Column:
    """[P-05] a JSON array or `{a,"b"}` to an array of texts: nulls of the one and blanks of the other go. A text in brackets that is no JSON array is read like a braced one."""
    t = F.trim(v)
    listed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    items = F.split(F.regexp_replace(t, r"^[{}]+|[{}]+$", ""), ",")
    braced = F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))
    return F.coalesce(F.filter(listed, lambda x: x.isNotNull()), braced)


def identifiers(v: Column) -> Column:
    """[P-06] the ids of a JSON list, a braced list or a single id: sorted and distinct; none for null and blank, null for a malformed list."""
    t = F.trim(v)
    braced = F.split(F.substring(t, F.lit(2), F.length(t) - 2), ",")
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.startswith("{") & t.endswith("}"), braced).when(t != "", F.array(t)).otherwise(F.expr("cast(array() as array<string>)"))
    whole = F.when(t.startswith("[") | t.startswith("{"), F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))).otherwise(items)
    return F.array_sort(F.array_distinct(whole))


def bounded(v: Column, solar: bool = False) -> Column:
    """[P-08, P-13] a finite physical value: above 0, or within 0 to 1 for a solar factor."""
    inside = v.between(0.0, 1.0) if solar else (v > 0) & (v < float("inf")) & ~F.isnan(v)
    return F.when(inside, v)


def fold(v: Column) -> Column:
    """[P-11] lower case without accents: marks are dropped, and Latin letters with marks lose them."""
    return F.regexp_replace(F.lower(F.translate(v, *_plain_letters())), "[\u0300-\u036f]", "")


def label(v: Column) -> Column:
    """[P-12] trimmed; unknown labels are null."""
    return F.when(~fold(F.trim(v)).isin(*UNKNOWN), F.trim(v))


def ratio(v: Column) -> Column:
    """[P-14] a fraction, or a percentage above 1, as a fraction; null unless positive."""
    return F.when(v > 1, v / 100).when(v > 0, v)


def window_to_wall(published: Column, glazed: Column, wall: Column, default: Column) -> Column:
    """[P-15] published ratio, else glazed area over wall area, else the default; tiny is null, capped."""
    found = F.coalesce(ratio(published), F.when((glazed > 0) & (wall > 0), glazed / wall), default)
    return F.when(found >= WWR_LEAST, F.least(found, F.lit(WWR_MOST)))


def orientations(tokens: Column, glazed: Column | None = None) -> Column:
    """[P-16] French and English words to cardinal names, ordered and distinct; if there are none, the sides with a glazed area (see glazed_areas)."""
    words = F.create_map(*(F.lit(x) for pair in {"nord": "north", "north": "north", "sud": "south", "south": "south", "est": "east", "east": "east", "ouest": "west", "west": "west"}.items() for x in pair))
    parts = F.flatten(F.transform(tokens, lambda t: F.split(fold(t), "[^a-z0-9]+")))
    found = F.coalesce(F.array_distinct(F.filter(F.transform(parts, lambda p: F.try_element_at(words, p)), lambda x: x.isNotNull())), F.expr("cast(array() as array<string>)"))
    return found if glazed is None else F.when(F.size(found) > 0, found).otherwise(F.transform(glazed, lambda g: g["facing"]))


def glazed_areas(north: Column, east: Column, south: Column, west: Column) -> Column:
    """[P-35] array<struct<facing, area>> of the positive areas, north to west."""
    sides = F.array(*(F.struct(F.lit(n).alias("facing"), c.cast("double").alias("area")) for n, c in (("north", north), ("east", east), ("south", south), ("west", west))))
    return F.filter(sides, lambda g: (g["area"] > 0) & ~F.isnan(g["area"]))


def cardinal(azimuth: Column) -> Column:
    """[P-17, V-03]"""
    turn = F.pmod(F.pmod(azimuth, F.lit(360)) + 45, F.lit(360))
    return F.element_at(F.array(*map(F.lit, ["north", "east", "south", "west"])), (F.floor(turn / 90) + 1).cast("int"))


def _any(v: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(v, F.lit(w)) for w in words))


def roof_pitch(material: Column, default: float = PITCH_DEFAULT) -> Column:
    """[P-18] default pitch for pitched materials, 0 for flat ones (pitched is tested first), else null."""
    return F.when(_any(fold(material), PITCHED), F.lit(default)).when(_any(fold(material), FLAT), F.lit(0.0))


def envelope_pitch(shape: Column, walls: Column, *materials: Column) -> Column:
    """[P-19] flat shape, pitched shape, mean of wall records, then materials in order (roof, upper floor); below the least pitch null."""
    found = F.coalesce(F.when(shape == "flat", 0.0).when(shape == "pitched", PITCH_DEFAULT), F.when(walls.isNotNull(), F.least(walls, F.lit(PITCH_MOST))), *map(roof_pitch, materials))
    return F.when(found >= PITCH_LEAST, found)


def completed(height: Column, storeys: Column, default: float = STOREY_HEIGHT) -> tuple[Column, Column]:
    """[P-20] (storeys, height) with what is missing filled in; half storeys round to even."""
    h, n = F.when(height > 0, height), F.when(storeys > 0, storeys)
    full = F.coalesce(n, F.greatest(F.lit(1), F.bround(h / default).cast("int")), F.lit(1))
    return full, F.coalesce(h, full * F.lit(default))


def country(address: Column, override: str = "auto") -> Column:
    """[P-21] FR, UK or a reason (empty, unsupported, conflict, unknown): suffix and postcode, then French street words.

    Northern Ireland and the Crown Dependencies are unsupported, also where `override` names a country.
    """
    if override.upper() not in ("AUTO", "FR", "UK", "GB"):
        raise ValueError(f"unsupported country: {override}")
    postcode, suffix = F.regexp_extract(address, POSTCODE, 0), F.lower(F.regexp_extract(address, SUFFIX, 1))
    unserved = postcode.rlike(NOT_SERVED) | address.rlike(r"(?i)\bnorthern ireland\b")
    explicit = F.when(suffix.isin("fr", "france"), "FR").when(suffix != "", "UK")
    postal = F.when(postcode != "", "UK").when(address.rlike(r"\b\d{5}\b"), "FR")
    routed = F.when(explicit != postal, "conflict").otherwise(F.coalesce(explicit, postal, F.when(address.rlike(STREETS), "FR"), F.lit("unknown")))
    given = routed if override == "auto" else F.lit(override.upper().replace("GB", "UK"))
    return F.when(F.coalesce(F.trim(address), F.lit("")) == "", "empty").when(unserved, "unsupported").otherwise(given)


def model_name(first: Column, count: Column) -> Column:
    """[P-27]"""
    return F.when(count > 1, F.concat(first, F.lit(" and "), (count - 1).cast("string"), F.lit(" more"))).otherwise(first)


def file_name(name: Column) -> Column:
    """[P-27] runs of anything but word characters, dots and dashes to one underscore, trimmed."""
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.-]+", "_"), r"^[._]+|[._]+$", "")


def street(address: Column) -> Column:
    """[P-23] what stands before the postcode; the whole if nothing does."""
    before = F.trim(F.get(F.split(address, r"\s+\d{5}\b", 2), F.lit(0)))
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(F.trim(address), F.lit("")))


def description(storeys: Column, address: Column, city: Column, area: Column, height: Column, french: Column) -> Column:
    """[P-24] a sentence of the known facts only."""
    where = F.when(french, street(address)).otherwise(F.nullif(address, F.lit("")))
    town = F.nullif(city, F.lit(""))
    place = F.when(where.isNotNull() & town.isNotNull(), F.concat(F.lit(" located at "), where, F.lit(", in "), town)).when(where.isNotNull(), F.concat(F.lit(" located at "), where)).when(town.isNotNull(), F.concat(F.lit(" located in "), town)).otherwise("")
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    facts = F.array_compact(F.array(
        F.concat(F.lit("an approximate footprint of "), whole(area), F.lit(" m²")),
        F.concat(F.lit("an estimated floor area of "), whole(area * storeys), F.lit(" m²")),
        F.when(height.isNotNull(), F.concat(F.lit("a height of "), F.format_string("%.1f", F.bround(height, 1)), F.lit(" m"))),
    ))
    n = F.size(facts)
    listed = F.when(n == 0, "").when(n == 1, F.concat(F.lit(", with "), F.get(facts, F.lit(0)))).otherwise(F.concat(F.lit(", with "), F.array_join(F.slice(facts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.get(facts, n - 1)))
    return F.concat(F.coalesce(F.concat(storeys.cast("string"), F.lit("-storey building")), F.lit("Building")), place, listed, F.lit("."))


def resistance(u: Column, inside: float = 0.13, outside: float = 0.04) -> Column:
    """[M-10] of the layer behind a U-value, less the films; null unless positive."""
    r = 1 / bounded(u) - inside - outside
    return F.when(r > 0, r)


def ring_area(ring: Column) -> Column:
    """[G-03, A-19] signed area of an open ring array<struct<x, y>>; positive if counter-clockwise."""
    turn = lambda p, i: p["x"] * F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] * p["y"]
    return F.aggregate(F.transform(ring, turn), F.lit(0.0), lambda a, x: a + x) / 2


def clean_ring(ring: Column, tolerance: float = 1e-3) -> Column:
    """[W-04] without vertices near the one kept before them, and without a last one near the first; null below three vertices."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < tolerance) & (F.abs(p["y"] - q["y"]) < tolerance)
    step = lambda kept, p: F.when(F.coalesce(near(F.try_element_at(kept, F.lit(-1)), p), F.lit(False)), kept).otherwise(F.array_append(kept, p))
    closed = lambda kept: F.when((F.size(kept) > 1) & near(F.get(kept, F.lit(0)), F.try_element_at(kept, F.lit(-1))), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return F.aggregate(ring, F.slice(ring, 1, 0), step, lambda kept: F.when(F.size(closed(kept)) >= 3, closed(kept)))


def union_area(boxes: Column) -> Column:
    """[J-07] area that a few boxes array<struct<x0, y0, x1, y1>> cover together, over the grid of their edges."""
    edges = lambda a, b: F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda r: r[a]), F.transform(boxes, lambda r: r[b]))))
    xs, ys = edges("x0", "x1"), edges("y0", "y1")
    steps = lambda e: F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = lambda x, y: F.exists(boxes, lambda r: (r["x0"] <= x["a"]) & (x["b"] <= r["x1"]) & (r["y0"] <= y["a"]) & (y["b"] <= r["y1"]))
    zero, add = F.lit(0.0), lambda s, v: s + v
    column = lambda x: F.aggregate(F.transform(steps(ys), lambda y: F.when(inside(x, y), (y["b"] - y["a"]).cast("double")).otherwise(0.0)), zero, add)
    return F.when(F.size(boxes) > 0, F.aggregate(F.transform(steps(xs), lambda x: (x["b"] - x["a"]) * column(x)), zero, add)).otherwise(0.0)


def box_ring(x0: Column, y0: Column, w: Column, d: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x0 + w, y0), corner(x0 + w, y0 + d), corner(x0, y0 + d))


def rotated(ring: Column, k: Column) -> Column:
    """[A-27] the ring from its k-th corner on (from 0)."""
    n = F.size(ring)
    return F.concat(F.slice(ring, k + 1, n), F.slice(ring, F.lit(1), k))


def least_rotation(ring: Column) -> Column:
    """[A-27] corners (texts) joined by commas, from the corner that gives the least text."""
    starts = F.sequence(F.lit(0), F.size(ring) - 1)
    return F.array_min(F.transform(starts, lambda k: F.array_join(rotated(ring, k), ",")))


def greedy_levels(df: DataFrame, levels: str, tolerance: int) -> DataFrame:
    """[A-16] a row for each cluster c (start, n, total) of an ascending array of levels.

    A level starts a cluster when it is more than `tolerance` above the start of the last one, so each
    cluster depends on the one before it: a fold over the (short) array of one row.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,n:bigint,total:bigint>>)")
    cluster = lambda start, n, total: F.array(F.struct(start.cast("long").alias("start"), n.cast("long").alias("n"), total.cast("long").alias("total")))

    def add(found: Column, z: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        within = F.coalesce(z - last["start"] <= tolerance, F.lit(False))
        grown = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), cluster(last["start"], last["n"] + 1, last["total"] + z))
        return F.when(within, grown).otherwise(F.concat(found, cluster(z, F.lit(1), z)))

    return df.withColumn("c", F.explode(F.aggregate(levels, none, add)))


def canonical_json(v: Column) -> Column:
    """[K-02] a JSON text without spaces, keys in order at every level, and numbers and escapes in one form, so equal values give equal texts.

    Null for what is no JSON: NaN and infinities, repeated keys, texts that end too early. What follows the value isn't looked at. Keys
    are ordered by UTF-16 units. Decimal numbers lose zeros at their end (1.0 becomes 1); those with an exponent become doubles.
    """
    return F.to_json(F.try_parse_json(v))


def content_hash(v: Column) -> Column:
    """[P-31] SHA-256 of the canonical form, in hexadecimal."""
    return F.sha2(canonical_json(v), 256)
