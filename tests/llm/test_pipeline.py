import os
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[11].split("\n")[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, seen = str(tmp_path), docs
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "personal data", "best-fit packing"]
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf).cache()
        assert after.columns == docs.columns and after.count() <= seen.count()
        seen = after
    ids = {r.doc_id for r in seen.collect()}
    assert not ids & {30, 33} and not {15, 18} <= ids  # passages of the benchmark; copies
    assert "<EMAIL>" in seen.filter("doc_id = 51").first().text
    packed = pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == ids
    assert os.path.isdir(sf)


def test_near_copies_from_four_fifths_on(spark, docs):
    """Pairs whose five-word shingles have a similarity between 0.80 and 0.90 are near copies; below they are not."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts, expected = {}, set()
    for kind in ("longer", "shorter", "changed", "apart"):
        for _ in range(3):
            words = [word() for _ in range(180)]
            other = {"longer": words + [word() for _ in range(31)], "shorter": words[:153], "changed": list(words), "apart": words + [word() for _ in range(60)]}[kind]
            if kind == "changed":
                other[60], other[120] = word(), word()
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, other))
            share = len(a & b) / len(a | b)
            assert share < 0.8 if kind == "apart" else 0.8 <= share < 0.9
            first = len(texts)
            texts[first], texts[first + 1] = " ".join(words), " ".join(other)
            expected |= {first} if kind != "apart" else {first, first + 1}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], docs.schema).repartition(3)
    assert {r.doc_id for r in pipeline.one_of_each_group(spark, frame, "").collect()} == expected


def test_odd_rows_and_columns(spark, docs, empty, texts, tmp_path):
    """Null and repeated ids, null and empty texts, more columns called like the stages' own, and an empty table."""
    spark.createDataFrame([(3 * i, 1, 0) for i in range(len(texts))] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[11].split("\n")[0]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id here", "en", "s", 10), (57, texts[19], "en", "s", None), (57, texts[19], "en", "s", 1), (60, "", None, None, 0)], docs.schema)
    frame = docs.union(odd).selectExpr("*", "'x' as spans", "1 as Score", "2 as label", "array(1) as keys", "'y' as found", "3 as component_id", "4 as n_words").repartition(3)
    for rows in (frame, empty):
        seen = rows
        for _, stage in pipeline.STAGES[:-1]:
            seen = stage(spark, seen, str(tmp_path)).cache()
            assert seen.columns == rows.columns
        kept = seen.count()
        packed = pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
        assert (kept == 0) == (not packed) and (rows is frame) == bool(kept)
