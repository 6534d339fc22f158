"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt into groups of a bounded number of pieces. In each group pieces go, longest first,
to the open bin with the least room that still holds them and that they don't conflict with: bins stand
ordered by room, the search starts at the first bin with room enough and moves on to its successors
until a compatible one is found; if none is, a bin is opened. A bin carries a bitmap of the duplicate
clusters in it (none may come twice) and a bitmap of the sources that have used up their quota in it.

A source has used up its quota in a bin when it has LEAST_PIECES there and SLACK times its share of the
group's length: a bin is as mixed as the data allow, and a source that is alone is no conflict.
Sources and clusters that make up many of the pieces have successor lists of their own, which hold only
the bins still open to them, so the search doesn't pass the same full bins for each of their pieces.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, table

CAPACITY = 2048
#: Pieces of one source that a bin takes at least, and how far beyond its share a source may go.
LEAST_PIECES, SLACK = 2, 1.5
#: A source or cluster with at least one in LISTED pieces has a successor list.
LISTED = 24
#: Pieces that a group may be expected to hold.
GROUP_PIECES = 20_000


def quotas(lengths: list[int], sources: list[int], capacity: int = CAPACITY) -> dict[int, float]:
    """Length of each source from which a bin takes no more of it."""
    share = Counter()
    for n, s in zip(lengths, sources, strict=True):
        share[s] += n
    return {s: SLACK * capacity * n / max(1, sum(lengths)) for s, n in share.items()}


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY, quota: dict[int, float] | None = None) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece, in the order given (longest first packs tightest).

    Negative sources and clusters are never in conflict. A piece must not be longer than the capacity.
    """
    quota = quotas(lengths, sources, capacity) if quota is None else quota
    often = lambda values: {v: i for i, v in enumerate(sorted(v for v, n in Counter(values).items() if v >= 0 and n > 1 and n * LISTED >= len(values)))}
    repeated = {c: i for i, c in enumerate(sorted(c for c, n in Counter(clusters).items() if c >= 0 and n > 1))}  # only these can be in conflict
    listed_c, listed_s = often(clusters), often(sources)
    source_bit = {s: i for i, s in enumerate(sorted(quota)) if s >= 0}
    # successor lists of (room, bin), ascending: of all open bins, and of those open to one source or cluster
    every: list[tuple[int, int]] = []
    by_cluster, by_source = [[] for _ in listed_c], [[] for _ in listed_s]
    cluster_map, full_map, used = [], [], []  # per bin: bitmap of clusters, bitmap of sources at their quota, pieces and length of each source
    out = []
    for size, s, c in zip(lengths, sources, clusters, strict=True):
        c_bit = 1 << repeated[c] if c in repeated else 0
        s_bit = 1 << source_bit[s] if s >= 0 else 0
        order = by_cluster[listed_c[c]] if c in listed_c else by_source[listed_s[s]] if s in listed_s else every
        at = bisect_left(order, (size, -1))
        while at < len(order) and (cluster_map[order[at][1]] & c_bit or full_map[order[at][1]] & s_bit):
            at += 1
        if at < len(order):
            room, k = order[at]
            for own in (every, *by_cluster, *by_source):
                place = bisect_left(own, (room, k))
                if place < len(own) and own[place] == (room, k):
                    del own[place]
        else:
            room, k = capacity, len(cluster_map)
            cluster_map.append(0)
            full_map.append(0)
            used.append({})
        cluster_map[k] |= c_bit
        if s_bit:
            pieces, length = used[k].get(s, (0, 0))
            used[k][s] = pieces + 1, length + size
            if pieces + 1 >= LEAST_PIECES and length + size >= quota[s]:
                full_map[k] |= s_bit
        out.append((k, capacity - room))
        if room > size:
            insort(every, (room - size, k))
            for own, c2 in zip(by_cluster, listed_c, strict=True):
                if not cluster_map[k] >> repeated[c2] & 1:
                    insort(own, (room - size, k))
            for own, s2 in zip(by_source, listed_s, strict=True):
                if not full_map[k] >> source_bit[s2] & 1:
                    insort(own, (room - size, k))
    return out


OUT = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long"


def _numbered(values: pa.ChunkedArray) -> np.ndarray:
    """0, 1, .. for the distinct values in the order of their first place; -1 for null."""
    codes = values.combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return codes.indices.fill_null(-1).to_numpy().astype(np.int64)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset for docs (doc_id, length, source, cluster).

    A document longer than a bin is cut: its full pieces fill bins of their own, the rest is packed as
    other documents are. Documents of length 0 or null, and null doc_ids, take a piece of length 0 in
    whatever bin fits. Null sources and clusters are never in conflict. Rows that
    repeat a doc_id are packed each by itself. The result depends on the rows alone; equal rows may change places.
    """
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("length"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    pieces = base.agg(F.sum(F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)))).first()[0] or 0
    n = max(1, math.ceil(pieces / group_pieces))
    base = base.withColumn("group", F.pmod(F.xxhash64(F.lit(11), "doc_id", "length", "cluster"), F.lit(n)).cast("int"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("doc_id", "length", "source", "cluster")]).combine_chunks()
        doc, length = (rows[c].fill_null(-1).to_numpy() for c in ("doc_id", "length"))
        source, cluster = _numbered(rows["source"]), _numbered(rows["cluster"])
        full, rest = length // capacity, length % capacity
        last = (rest > 0) | (full == 0)
        order = np.lexsort((cluster, source, doc, -rest))
        order = order[last[order]]
        placed = best_fit(rest[order].tolist(), source[order].tolist(), cluster[order].tolist(), capacity)
        bins = max((k for k, _ in placed), default=-1) + 1
        owner = np.repeat(np.arange(len(doc)), full)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        first = key[0].as_py() << 32
        index, piece = np.concatenate([owner, order]), np.concatenate([part, full[order]])
        columns = {
            "doc_id": rows["doc_id"].combine_chunks().take(pa.array(index.astype(np.int64))),
            "piece": pa.array(piece.astype(np.int32)),
            "start": pa.array(piece.astype(np.int64) * capacity),
            "length": pa.array(np.concatenate([np.full(len(owner), capacity), rest[order]]).astype(np.int64)),
            "bin_id": pa.array(np.concatenate([bins + np.arange(len(owner)), [k for k, _ in placed]]).astype(np.int64) + first),
            "bin_offset": pa.array(np.concatenate([np.zeros(len(owner)), [o for _, o in placed]]).astype(np.int64)),
        }
        yield from pa.table(columns).to_batches(max_chunksize=50_000)

    return base.groupBy("group").applyInArrow(run, OUT)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, length in words, source, and a hash of the text (without case and spacing) as cluster. A null text has no length and no cluster."""
    text = as_text(F.col("text").cast("string"))
    return docs.select("doc_id", F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("length"), "source", F.when(F.col("text").isNotNull(), F.xxhash64(F.lower(F.regexp_replace(text, r"\s+", " ")))).alias("cluster"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset of every row of `documents`, lengths in words; see pack."""
    return pack(measured(table(spark, sf_dir, "documents")))
