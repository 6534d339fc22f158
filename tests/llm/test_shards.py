import zlib

import numpy as np
from pyspark.sql import functions as F

from masonry.llm import shards
from masonry.llm.common import work_dir


def test_rows_law_and_whole_records(spark, docs, texts):
    odd = docs.withColumns({c: F.lit("clash") for c in ("bucket", "first", "Tie", "_bucket", "_first", "g", "n")})
    given = odd.withColumn("shard", F.lit("clash")).unionByName(odd.withColumn("shard", F.lit("again")))
    one, two = (shards.shuffle_into_shards(g, work_dir(spark, "s"), bucket_bytes=4000) for g in (given, given.repartition(5)))
    rows = one.collect()
    assert sorted((r.doc_id, r.text or "", r.source) for r in rows) == sorted((r.doc_id, r.text or "", r.source) for r in given.collect())
    sizes = [r["count"] for r in one.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == shards.SHARDS
    for k in range(shards.SHARDS):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in two.collect())
    files = {}
    for path, slot in one.select(F.input_file_name(), "slot").collect():
        files.setdefault(path, []).append(slot)
    assert all(own == sorted(own) for own in files.values())


def test_seed_and_nulls(spark, empty):
    rows = spark.createDataFrame([(None, None)] * 3 + [(i, "t") for i in range(200)], "doc_id long, text string")
    a, b = (shards.shuffle_into_shards(rows, work_dir(spark, "s"), seed=seed) for seed in (1, 2))
    assert a.count() == b.count() == 203
    assert {(r.doc_id, r.shard, r.slot) for r in a.collect()} != {(r.doc_id, r.shard, r.slot) for r in b.collect()}
    empty.write.mode("overwrite").parquet(path := work_dir(spark, "none"))
    assert shards.shuffle_into_shards(spark.read.parquet(path), work_dir(spark, "s")).count() == 0


def test_ranges():
    for total in (0, 3, 8, 17, 100):
        shard, slot = shards.shard_of(np.arange(total), total, 8)
        assert list(slot) == [int((shard[:p] == shard[p]).sum()) for p in range(total)]
        sizes = np.bincount(shard, minlength=8)
        assert sizes.max() - sizes.min() <= 1 and (np.diff(shard) >= 0).all()


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = shards.op7_two_pass_shuffle(spark, str(tmp_path)).collect()
    want = {3 * i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
