import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import tokens
from masonry.llm.common import work_dir

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def plain_ids(texts):
    t = tokenizers.Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [tokens.END] for x in texts]


def test_store_round_trip(spark, docs, texts):
    store = work_dir(spark, "store")
    tokens.write_store(docs.withColumn("ids", F.lit(1)).withColumn("key", F.lit("clash")), store)
    want = plain_ids(texts)
    ids = {r.doc_id: r.ids for r in tokens.read_ids(spark, store).collect()}
    assert ids == {3 * i: x for i, x in enumerate(want)}
    start = 0
    for row, x in zip(tokens.read_checksums(spark, store).orderBy("doc_id").collect(), want, strict=True):
        assert (row.start, row.n_tokens) == (start, len(x))
        assert row.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes())
        start += len(x)


def test_chunks_are_stored_once_and_damage_is_found(spark, docs):
    store = work_dir(spark, "store")
    tokens.write_store(docs, store)
    held, used = spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/recipes").select(F.explode("keys").alias("key"))
    assert held.count() == held.select("key").distinct().count() == used.distinct().count() < used.count()
    for damage in (held.withColumn("ids", F.when(F.octet_length("ids") > 200, F.reverse(F.col("ids").cast("string")).cast("binary")).otherwise(F.col("ids"))), held.limit(3)):
        broken = work_dir(spark, "broken")
        damage.write.parquet(f"{broken}/chunks")
        spark.read.parquet(f"{store}/recipes").write.parquet(f"{broken}/recipes")
        with pytest.raises(Exception, match="damaged"):
            tokens.read_checksums(spark, broken).collect()


def test_repeated_and_null_ids(spark):
    """Each row is a document of its own, and starts add up."""
    rows = [(5, "one two"), (5, "three"), (5, "one two"), (None, "four"), (None, None), (2, "five six seven")]
    store = work_dir(spark, "store")
    tokens.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), store)
    want = {t: plain_ids([t])[0] for _, t in rows}
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_checksums(spark, store).collect())
    assert [g[1] for g in got] == [None, None, 2, 5, 5, 5]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:k]) for k in range(6)]
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == sorted((str(d), len(want[t]), zlib.crc32(np.array(want[t], "<u4").tobytes())) for d, t in rows)


def test_empty_table(spark, empty):
    store = work_dir(spark, "store")
    tokens.write_store(empty, store)
    assert tokens.read_checksums(spark, store).count() == 0


def test_chunk_lengths_and_shift():
    ids = np.random.default_rng(1).integers(0, 50_000, 60_000).astype(np.uint32)
    twice = np.concatenate([ids, ids[100:]])
    a, b = tokens.chunk_ends(twice, np.array([0, len(ids)]), np.array([len(ids), len(ids) - 100]))
    assert a[-1] == len(ids) and np.diff(np.append(0, a)).max() <= tokens.CHUNK_MAX and np.diff(a[:-1]).min() >= tokens.CHUNK_MIN
    assert len(set(a.tolist()) & set((b + 100).tolist())) > 0.9 * len(b)
    x, y = b"some bytes", b"that follow each other"
    assert int(tokens.crc_shift(np.array([zlib.crc32(x)]), np.array([len(y)]))[0]) ^ zlib.crc32(y) == zlib.crc32(x + y)


def test_query_encodes_as_an_untouched_tokenizer(spark, docs, texts, tmp_path):
    """The library's defaults, also where a text holds the content of an added token."""
    mark = "<|endoftext|>"
    more = [mark, f"a{mark}b1 {mark}\n{mark} c", f"don't  stop {mark}\n\nx1", f"a <|endof text|> {mark[:-1]} {mark[1:]}", f" {mark} x", f"<{mark}>" * 40, mark[6:] + " end " + mark[:6]]
    everything = texts + more
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(everything)], "doc_id long, text string").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    plain = tokenizers.Tokenizer.from_file(tokens.vocabulary_path())
    start = 0
    for row, t in zip(tokens.op3_token_store(spark, str(tmp_path)).orderBy("doc_id").collect(), everything, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [tokens.END]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
