"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Both sides are lower-cased (A-Z) and cut into words, which are numbered. A window is ten consecutive
words of a benchmark item, or the whole of a shorter one. Every window holds one of the item's parts, five
words long and six apart, so the automaton has the parts and the short items as patterns: about a node
for each word of the benchmark. Each document is scanned once; where a part occurs, the words on both sides
are compared with the item's, and a run of ten or more is a hit. Hits are mapped to code points of the
original text.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table

WINDOW = 10
#: Benchmark text that one automaton holds (about 20 bytes of memory for each); a larger benchmark is matched in blocks of items.
BENCHMARK_BYTES = 8 << 20

#: Bytes 0-9, a-z and all of non-ASCII text make words; A-Z fold to a-z; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<lo:long,hi:long,start:long,end:long>>"
_HELD: dict = {}  # on a worker: the automaton that was built last


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Matcher:
    """Finds windows of `items` (item_id, text) in texts. Items without words never occur; one without an id occurs, but isn't named."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.window, self.part = window, max(1, window // 2)
        self.reach = window - self.part  # words on each side of a part that its windows can hold
        self.names = [item for item, _ in items]
        self.numbers: dict[bytes, int] = {}
        flat, starts, at = [np.full(window, -1, np.int64)], [], window
        parts: dict[tuple[int, ...], list[int]] = {}
        whole: dict[tuple[int, ...], list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in word_list(text)]
            starts.append(at)
            if len(ids) < window and ids:
                whole.setdefault(tuple(ids), []).append(k)
            for i in range(0, len(ids) - self.part + 1 if len(ids) >= window else 0, self.reach + 1):
                parts.setdefault(tuple(ids[i : i + self.part]), []).append(at + i)
            flat.append(np.array([*ids, *[-1] * window], np.int64))
            at += len(ids) + window
        self.flat, self.starts = np.concatenate(flat), np.array(starts, np.int64)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in parts.keys() | whole.keys():
            self.trie.add_word(key, (len(key), np.array(parts.get(key, []), np.int64), whole.get(key, [])))
        if len(self.trie):
            self.trie.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(words, merged ranges of words hit, names of the items found)."""
        found = word_list(text)
        if not found or not len(self.trie):
            return len(found), [], []
        number, none = self.numbers.get, 0
        ids = tuple([number(w, none) for w in found])
        hits, items, own = set(), set(), None
        back, ahead = -1 - np.arange(self.reach), self.part + np.arange(self.reach)
        for last, (size, places, short) in self.trie.iter(ids):
            first = last + 1 - size
            if short:
                hits.add((first, last + 1))
                items.update(short)
            if not len(places):
                continue
            if own is None:
                own = np.concatenate((np.full(self.window, -2), np.array(ids, np.int64), np.full(self.window, -2)))
            at = first + self.window
            left, right = (np.logical_and.accumulate(self.flat[places[:, None] + step] == own[at + step], 1).sum(1) for step in (back, ahead))
            full = left + right + self.part >= self.window
            hits.update(zip((first - left[full]).tolist(), (first + self.part + right[full]).tolist(), strict=True))
            items.update((np.searchsorted(self.starts, places[full], side="right") - 1).tolist())
        return len(found), merged(sorted(hits)), sorted({self.names[k] for k in items} - {None})


def merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges [lo, hi) in order, those that overlap or touch united."""
    out: list[list[int]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _code_point_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges [lo, hi) of the text with their code points in it."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    solid = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"lo": lo, "hi": hi, "start": int(points[starts[lo]]), "end": int(points[ends[hi - 1]])} for lo, hi in ranges]


def _matcher(shared: Broadcast, key: str, window: int) -> Matcher:
    """The automaton of a block of the benchmark; a worker keeps the last one for its next tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Matcher(shared.value, window)
    return _HELD[key]


def _benchmark_blocks(benchmark: DataFrame, most: int) -> Iterator[Broadcast]:
    """The items, as one broadcast list, or as several of about `most` bytes. Only one list is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / most))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.filter(block == i).collect()])


def _scan(docs: DataFrame, shared: Broadcast, window: int, all_rows: bool) -> DataFrame:
    """doc_id, tag, n_words, items, spans of docs (doc_id, tag, text): of all rows, or of those with a hit."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, window)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [matcher.scan(t) for t in texts]
            keep = [i for i, f in enumerate(found) if all_rows or f[1]]
            spans = [_code_point_spans(texts[i], found[i][1]) if found[i][1] else [] for i in keep]
            columns = [pa.array([found[i][0] for i in keep], pa.int64()), pa.array([found[i][2] for i in keep], pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)), *columns], ["doc_id", "tag", "n_words", "items", "spans"])

    return docs.mapInArrow(run, f"doc_id long, tag long, n_words long, items array<string>, spans {_SPANS}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (the last column) of several blocks, those of neighbouring words united, as one scan gives them."""
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            start, end = {s["lo"]: s["start"] for s in spans}, {s["hi"]: s["end"] for s in spans}
            ranges = merged(sorted((s["lo"], s["hi"]) for s in spans))
            out.append([{"lo": lo, "hi": hi, "start": start[lo], "end": end[hi]} for lo, hi in ranges])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(_SPAN))], batch.schema.names)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """doc_id, n_words, items, spans for every row of `docs` (doc_id, text); repeated and null doc_ids keep a row each.

    spans: the ranges of words hit (lo, hi) and the code points of the original text that they take (start, end).
    The benchmark is a stated query set: its size is measured, and beyond `benchmark_bytes` it is matched in
    blocks of whole items whose hits are then united; the result is the same. Null or empty text: no words and
    no hits. A null or wordless item never occurs; one without an id counts for spans, but not among items.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    parts = [_scan(docs, shared, window, i == 0) for i, shared in enumerate(_benchmark_blocks(benchmark, benchmark_bytes))]
    if len(parts) == 1:
        return parts[0].drop("tag")
    # rows that are equal have equal hits, so hits are united by doc_id and text and joined to the rows again
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    united = reduce(DataFrame.unionByName, parts).filter(F.size("spans") > 0).groupBy("doc_id", "tag").agg(F.array_sort(flat("items")).alias("i"), flat("spans").alias("s"))
    united = united.mapInArrow(_united, united.schema)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))
    joined = parts[0].join(united.withColumnsRenamed({"doc_id": "d", "tag": "t"}), same, "left")
    return joined.select("doc_id", "n_words", F.coalesce("i", "items").alias("items"), F.coalesce("s", "spans").alias("spans"))


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def items_hash(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark window occurs; without a shuffle where the benchmark is one block."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    small_batches(spark)
    shares = list(_benchmark_blocks(benchmark, benchmark_bytes))
    if len(shares) > 1:
        tag, bad_id, bad_tag = (free_name(c, docs.columns) for c in ("tag", "bad_id", "bad_tag"))
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
        bad = reduce(DataFrame.unionByName, [_scan(given, shared, window, False) for shared in shares]).select(F.col("doc_id").alias(bad_id), F.col("tag").alias(bad_tag)).distinct()
        marked = docs.withColumn(tag, F.xxhash64("text"))
        return marked.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(tag) == F.col(bad_tag)), "left_anti").select(docs.columns)
    shared = shares[0]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, window)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.scan(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of `documents`; see find_benchmark."""
    return digest(find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: The same by joining word windows; one row per document word, so for small tables.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + 9], ' ') AS pat FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM p),
d AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS pat FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
h AS (SELECT d.doc_id, d.i, d.k, p.item_id FROM d JOIN p ON d.k = p.k AND d.pat = p.pat),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
