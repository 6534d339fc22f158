"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by a seeded hash. Pass two orders each
bucket by key, applies a seeded Fisher-Yates shuffle and writes the records in that order. The
concatenated buckets are one random permutation; it is cut into equal ranges, a shard each, so shard
sizes differ by one row at most (law ``rows``). A bucket falls into one shard, or two at a cut, and its
rows have neighbouring slots: every file holds whole buckets, in the order of slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, free_name, small_batches, table, work_dir

SHARDS, SEED = 8, 17
#: Text bytes that a bucket may be expected to hold.
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1 (NumPy's permutation is a Fisher-Yates shuffle)."""
    return np.random.default_rng([seed, bucket]).permutation(n)


def shard_of(place: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of places 0..total-1 of the permutation, cut into ranges that differ by one row at most."""
    size, longer = divmod(total, shards)
    ends = np.cumsum(np.full(shards, size) + (np.arange(shards) < longer))
    shard = np.searchsorted(ends, place, side="right")
    return shard, place - np.append(0, ends)[shard]


def _with_text(change):
    """Map a batch's text column by `change` (bytes to bytes); null stays null."""

    def of(batch, at: int, kind: pa.DataType):
        texts = [change(t.as_buffer()) if t.is_valid else None for t in batch.column(at)]
        return batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.binary()).cast(kind))

    return of


def _fields(docs: DataFrame, kinds: dict[str, str]) -> str:
    return ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in docs.schema.fields)


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with compressed texts, so that the shuffle moves about half."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = _with_text(zstandard.ZstdCompressor(level=3).compress)
        for batch in batches:
            yield pack(batch, at, pa.binary())

    return docs.mapInArrow(run, _fields(docs, {"text": "binary"}))


def shuffle_into_shards(docs: DataFrame, out: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows, whole, as Parquet into `out`/shard=K and return them as read back, with shard and slot.

    The result depends on the rows and the seed, not on how they lay. Rows with equal doc_id are told
    apart by a hash of their text; rows equal in both may be in either order. Null doc_id and text are kept.
    Columns of the input named shard or slot are replaced; others may have any name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("shard", "slot")
    names, tie, bucket, first = docs.columns, *(free_name(c, docs.columns) for c in ("tie", "bucket", "first"))
    total, rows = docs.agg(F.sum(F.octet_length(as_text(F.col("text"))) + 64), F.count(F.lit(1))).first()
    n = max(1, math.ceil((total or 0) / bucket_bytes))
    marked = docs.withColumn(tie, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    marked = marked.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), tie), F.lit(n)).cast("int"))
    counts = marked.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    # first places of the buckets: a running sum in two levels, so no task has more than about sqrt(n) rows
    wide = max(1, math.isqrt(n))
    grouped = counts.withColumn("g", F.floor(F.col(bucket) / wide))
    inner = grouped.withColumn("inner", F.sum("n").over(W.partitionBy("g").orderBy(bucket)) - F.col("n"))
    outer = grouped.groupBy("g").agg(F.sum("n").alias("t")).select("g", (F.sum("t").over(W.orderBy("g")) - F.col("t")).alias("outer"))
    places = inner.join(outer, "g").select(bucket, (F.col("inner") + F.col("outer")).alias(first))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, own = _with_text(zstandard.ZstdDecompressor().decompress), pa.Table.from_batches(list(batches))
        order = np.lexsort((own[tie].to_numpy(), own["doc_id"].fill_null(-1).to_numpy()))
        order = order[fisher_yates(own.num_rows, seed, key[0].as_py())]
        shard, slot = shard_of(own[first][0].as_py() + np.arange(own.num_rows), rows, shards)
        mixed = own.select(names).take(pa.array(order))
        mixed = mixed.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot.astype(np.int64)))
        at = mixed.column_names.index("text")
        for batch in mixed.to_batches(max_chunksize=1000):
            yield unpack(batch, at, pa.string())

    # both sides are dealt by the bucket, and the groups are those of the join: the texts move once
    scattered = _packed(marked).join(places.hint("merge"), bucket)
    dealt = scattered.groupBy(bucket).applyInArrow(run, f"{_fields(docs, {})}, shard int, slot long")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(out)
    return spark.read.schema(dealt.schema).parquet(out)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `documents`; see shuffle_into_shards. The law is `rows`."""
    rows = shuffle_into_shards(table(spark, sf_dir, "documents"), work_dir(spark, "shards"))
    text = as_text(F.col("text"))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
