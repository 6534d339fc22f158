"""Quality rules: distribution divergence from language references. DataFrame functions only.

A document's histogram over character classes, and its histogram over the commonest words of its
language, are compared with the pooled histograms of that language by Jensen-Shannon distance. Short
texts give noisy histograms, so each comparison has a least length. Which words are the commonest is
counted over all documents of the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, materialise, table

#: Words of a language whose shares are compared (the rest is pooled as "other"), and bytes of the longest word that is counted.
N_COMMON, LONGEST = 25, 24
#: A language has a reference of its own from one in LEAST_SHARE words on, so there are at most so many; the others share one.
LEAST_SHARE = 1000
#: Greatest Jensen-Shannon distance (base 2, 0 to 1) that is kept, and least code points or words to be judged.
MOST_CLASSES, MOST_WORDS = 0.28, 0.3
LEAST_CHARS, LEAST_WORDS = 300, 150

_LETTERED, SLOTS = "ABCDEFGHIJKLMNOPQRSTUVWXY", 256  # a letter for each common word, and entries of the table they are looked up in
_LETTERS, _CAPITALS, _DIGITS, _SPACES, _SYMBOLS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r", "#*$%&|<>"
_REST = "".join(chr(c) for c in range(128) if chr(c) not in _LETTERS + _CAPITALS + _DIGITS + _SPACES + _SYMBOLS)


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: inside other lambdas a column expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Up to so many different repeated windows are looked up one by one; beyond, all windows are sorted with their places.
FEW = 48


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more in the text."""
    keys = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    placed = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    equal = lambda s, j, p: (j > 0) & (p == F.get(s, F.greatest(j - 1, F.lit(0))))
    again = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda p, j: equal(s, j, p))))
    same = lambda p, q: p["h"] == q["h"]
    before = lambda s, j, p: (j > 0) & same(p, F.get(s, F.greatest(j - 1, F.lit(0))))
    twice = lambda s: F.filter(s, lambda p, j: F.coalesce(before(s, j, p) | same(p, F.get(s, j + 1)), before(s, j, p)))
    by_lookup = lambda h, d: F.transform(F.filter(placed(h), lambda p: F.array_contains(d, p["h"])), lambda p: p["i"])
    by_sorting = lambda h: let(F.sort_array(placed(h)), lambda s: F.sort_array(F.transform(twice(s), lambda p: p["i"])))
    steps = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    count = lambda places: let(places, lambda at: F.aggregate(steps(at), F.lit(0), lambda a, x: a + x))
    places = lambda h, d: F.when(F.size(d) <= FEW, by_lookup(h, d)).otherwise(by_sorting(h))
    covered = let(words, lambda w: let(keys(w), lambda h: let(again(h), lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(count(places(h, d))))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered).cast("long")


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def common_words(docs: DataFrame) -> DataFrame:
    """ref, list: the N_COMMON commonest words, lower case, of each language with enough text, and of all others together (`*`).

    Counts are summed before the shuffle and only the best of each part are ranked, so a frequent word or
    language gathers no rows in one task.
    """
    words = F.split(F.lower(as_text(F.col("text").cast("string"))), _SPACE)
    each = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(words).alias("w")).filter((F.col("w") != "") & (F.octet_length("w") <= LONGEST))
    counts = each.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("m")).filter((F.col("m") * LEAST_SHARE >= total) & F.col("lang").isNotNull()).select("lang", F.col("lang").alias("ref")))
    by_ref = counts.join(own, "lang", "left").groupBy(F.coalesce("ref", F.lit("*")).alias("ref"), "w").agg(F.sum("n").alias("n"))
    best = by_ref.withColumn("r", F.row_number().over(W.partitionBy("ref").orderBy(F.col("n").desc(), "w"))).filter(F.col("r") <= N_COMMON)
    return materialise(best.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("list")), "lists")


def word_slots(words: Column) -> Column:
    """SLOTS entries: the words of a list whose hash falls into the entry and their letters; null where there are none."""
    lettered = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(F.lit(list(_LETTERED)), i).alias("code")))
    of = lambda k: F.filter(lettered, lambda x: F.pmod(F.xxhash64(x["w"]), F.lit(SLOTS)) == k)
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: let(of(k), lambda x: F.when(F.size(x) > 0, F.struct(x["w"].alias("words"), x["code"].alias("codes")))))


def common_counts(words: Column, slots: Column) -> Column:
    """N_COMMON + 1 numbers: words that are not in the list, then how often each word of it occurs, without regard to case."""
    letter = lambda w, s: F.when(s.isNotNull(), F.get(s["codes"], F.array_position(s["words"], w).cast("int") - 1))
    lower = F.transform(words, lambda w: F.lower(w))
    codes = F.array_join(F.transform(lower, lambda w: letter(w, F.get(slots, F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))), "")
    start = F.struct(codes.alias("t"), F.expr("cast(array() as array<bigint>)").alias("n"))
    grown = lambda a, rest: F.concat(a["n"], F.array((F.octet_length(a["t"]) - F.octet_length(rest)).cast("long")))
    cut = lambda a, c: let(F.replace(a["t"], c, F.lit("")), lambda rest: F.struct(rest.alias("t"), grown(a, rest).alias("n")))
    others = lambda n: F.size(words) - F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)
    return let(F.aggregate(F.lit(list(_LETTERED)), start, cut, lambda a: a["n"]), lambda n: F.concat(F.array(others(n)), n))


def measure(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, lang, ref, the base counts and the two histograms of every row. Null text counts as empty. lists: see common_words."""
    text = as_text(F.col("text").cast("string"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t0"))
    own = F.broadcast(lists.filter("ref <> '*'").select(F.col("ref").alias("own")))  # at most LEAST_SHARE rows
    base = base.join(own, F.col("lang") == F.col("own"), "left").withColumn("ref", F.coalesce("own", F.lit("*"))).drop("own")
    base = base.join(F.broadcast(lists.select("ref", word_slots(F.col("list")).alias("slots"))), "ref", "left")
    for k, chars in enumerate((_LETTERS, _SPACES, _CAPITALS, _DIGITS, _SYMBOLS, _REST)):
        base = base.withColumn(f"t{k + 1}", F.translate(f"t{k}", chars, ""))
    base = base.withColumn("ws", F.filter(F.split("t0", _SPACE), lambda w: w != ""))
    lines = F.filter(F.split("t0", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    base = base.withColumn("lines", lines)
    count = lambda k: F.length(f"t{k}") - F.length(f"t{k + 1}")
    return base.select(
        "doc_id",
        "lang",
        "ref",
        F.size("ws").cast("long").alias("n_words"),
        (F.length("t0") - count(1)).cast("long").alias("word_chars"),
        count(4).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("ws")).alias("n_repeat_words"),
        F.array(*(count(k).cast("long") for k in range(6)), F.length("t6").cast("long")).alias("classes"),
        common_counts(F.col("ws"), F.col("slots")).alias("common"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of counts; null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    share = lambda h: let(total(h), lambda t: F.transform(h, lambda x: F.try_divide(x.cast("double"), t)))
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(share(p), share(q), lambda a, b: (part(a, b) + part(b, a)) / 2)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))
    return F.when((total(p) > 0) & (total(q) > 0), distance)


def references(measured: DataFrame) -> DataFrame:
    """ref, ref_classes, ref_common: summed over all documents that pass the base rules."""
    sums = lambda c, n: F.array(*(F.sum(F.col(c)[k]) for k in range(n)))
    return measured.filter(~F.col("base_failed")).groupBy("ref").agg(sums("classes", 7).alias("ref_classes"), sums("common", N_COMMON + 1).alias("ref_common"))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, both distances and kept, for every row of docs (doc_id, text, lang).

    base_failed: under 50 words, or over half of the words in repeated windows. A document whose language is
    null, or has too little text for a reference, is compared with the pool of such documents. Texts under the
    least length, and those without a reference, are not judged by that comparison. An empty text fails the
    base rules. Rows that repeat a doc_id are judged each by itself; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialise(measure(docs, common_words(docs)).withColumn("base_failed", failed), "rules")
    joined = measured.join(F.broadcast(references(measured)), "ref", "left")  # at most LEAST_SHARE + 1 rows
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumn("d_classes", F.when(chars >= LEAST_CHARS, divergence(F.col("classes"), F.col("ref_classes"))))
    joined = joined.withColumn("d_words", F.when(F.col("n_words") >= LEAST_WORDS, divergence(F.col("common"), F.col("ref_common"))))
    near = (F.coalesce("d_classes", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("d_words", F.lit(0.0)) <= MOST_WORDS)
    return joined.withColumn("kept", ~F.col("base_failed") & near)


def op8_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances of every row of `documents`; see judge."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d_classes", "d_words")
