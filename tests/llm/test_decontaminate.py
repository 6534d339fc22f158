import random
import re

from pyspark.sql import functions as F

from masonry.llm import decontaminate as d


def brute(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, other in items:
        own = find(other)
        for i in range(max(1, len(own) - 9) if own else 0):
            part = own[i : i + 10]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(item)
    return len(words), len(hit), len(found), d.items_hash(list(found)), bool(hit)


def items(texts):
    return [("9", None), ("10", ""), ("8", "--"), ("2", texts[5][60:400]), ("1", "MAIL... me,at"), ("3", texts[11]), ("4", "aa aa"), ("5", "漢字 words"), ("6", "Never said anywhere at all")]


def test_like_brute_force(spark, docs, texts):
    bench = spark.createDataFrame(items(texts), "item_id string, text string").withColumn("doc_id", F.lit("clash"))
    for limit in (d.BENCHMARK_BYTES, 150):  # one automaton, and blocks of items
        got = {r.doc_id: tuple(r)[1:] for r in d.digest(d.find_benchmark(docs, bench, benchmark_bytes=limit)).collect()}
        assert got == {3 * i: brute(t, items(texts)) for i, t in enumerate(texts)}


def test_spans_are_of_the_original(spark):
    docs = spark.createDataFrame([(1, "é é. One -- TWO three! é"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two THREE")], "item_id long, text string")
    row = d.find_benchmark(docs, bench).filter("doc_id = 1").first()
    (span,) = row.spans
    assert "é é. One -- TWO three! é"[span.start : span.end] == "One -- TWO three" and row.items == ["7"] and (span.lo, span.hi) == (2, 5)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_benchmark(docs, none).filter("size(spans) > 0").count() == 0
    assert d.find_benchmark(empty, none).count() == 0


def test_every_window_of_overlapping_items(spark):
    """Items that share words, repeat themselves and meet in a text at every offset."""
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choices("abcd", k=n))
    bench = [(str(k), some(rng.randint(1, 30))) for k in range(40)] + [("0", some(14)), ("x", "a " * 25)]
    given = {i: some(rng.randint(0, 80)) for i in range(60)} | {99: "a " * 60}
    docs, items = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id string, text string")
    want = {i: brute(t, bench) for i, t in given.items()}
    spans = []
    for limit in (d.BENCHMARK_BYTES, 200):
        found = d.find_benchmark(docs, items, benchmark_bytes=limit).cache()
        assert {r.doc_id: tuple(r)[1:] for r in d.digest(found).collect()} == want
        spans.append(sorted((r.doc_id, r.spans) for r in found.collect()))
        clean = d.drop_contaminated(docs, items, benchmark_bytes=limit)
        assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    assert spans[0] == spans[1]


def test_repeated_and_null_ids(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "else"), (None, "one two three"), (None, None), (2, "four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("clash"))
    items = spark.createDataFrame([(None, "two three"), ("7", "one two three"), ("7", "four"), (None, None)], "item_id string, text string")
    want = sorted([(1, 3, 3, 1, True)] * 2 + [(1, 1, 0, 0, False), (None, 3, 3, 1, True), (None, 0, 0, 0, False), (2, 2, 1, 1, True)], key=str)
    for limit in (d.BENCHMARK_BYTES, 4):
        found = d.digest(d.find_benchmark(docs, items, benchmark_bytes=limit)).drop("items_sha256")
        assert sorted(map(tuple, found.collect()), key=str) == want
        clean = d.drop_contaminated(docs, items, benchmark_bytes=limit)
        assert clean.columns == docs.columns and sorted((r.doc_id, r.text) for r in clean.fillna(-1, "doc_id").collect()) == sorted([(-1, None), (1, "else")], key=str)


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items(texts), "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = d.op5_benchmark_decontamination(spark, str(tmp_path))
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == {3 * i: brute(t, items(texts)) for i, t in enumerate(texts)}
