"""Exact n-gram Jaccard join in metric space.

Documents are sets of word shingles under the Jaccard distance. Shingles stand in one global order, the
rarest words first. Each shingle that stands early in a document (within the prefix that a partner at
the least similarity must meet) makes the document a member of that shingle's region; a second window,
on the size of the set (its distance from the full set), puts it also into the next size band. Linked
documents therefore share a region. Within a region the first document is the pivot: one distance per
member is computed, and members within the threshold are linked to it. What is left - members of
different components - is joined recursively: pivots among the members create Voronoi cells of the members
nearest to them, within twice the threshold; members of other cells or of none that are within three times the
threshold (a window that follows from the triangle inequality) are copied to the cell; and what no pivot was
near goes to new pivots, as long as these find members. The distance there is a lower bound that is a metric itself: a bitmap holds
the parity of the shingles that fall on each bit, and two sets differ at least in as many shingles as their
bitmaps differ in bits. Pairs that the cells leave, that pass this bound and whose exact distances to the
region's pivot differ by no more than the threshold, are tested exactly on their texts.

Documents with equal sets are joined before. README says why regions come from shingles first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, discard, materialise, mix, small_batches, span_hashes, table, text_view, unzip, with_group, words, zipped

SHINGLE, PERCENT = 3, 90
#: A word is common from this share of all words on; so there are at most 1 / COMMON such words.
COMMON = 2e-5
#: Members of a region that are joined in one block, and rows that a task of blocks may be expected to hold.
BLOCK, TASK_ROWS = 2048, 20_000
#: Pivots at a time, members that get no pivots any more, and members a pivot must find on average for more to be tried.
PIVOTS, SMALL, LEAST_MET = 8, 48, 3


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    return span_hashes(LOWER[data], starts, ends), first


def common_words(docs: DataFrame, share: float = COMMON) -> dict[int, int]:
    """hash -> class (1 and up, higher is commoner) of the words that make up at least `share` of all words.

    A word so common is at least as common in some task, so tasks report only words above a quarter of
    the share among their own; what is collected is bounded by the share, not by the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for i, j in blocks(offsets):
                hashes, _ = _word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += len(hashes)
                own, n = np.unique(hashes, return_counts=True)
                keys, counts = np.concatenate((keys, own)), np.concatenate((counts, n))
            if len(keys) > 2_000_000:
                keys, counts = _summed(keys, counts)
        keys, counts = _summed(keys, counts)
        often = counts >= max(1, total * share / 4)
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often]), pa.array(np.zeros(often.sum(), np.int64))], ["w", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["w", "n", "total"])

    counted = docs.select("text").mapInArrow(run, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = materialise(counted, "words")
    total = counted.agg(F.sum("total")).first()[0] or 0
    rows = counted.filter(F.col("n") >= max(2, total * share)).select("w", "n").collect()
    discard(counted)
    return {w & (2**64 - 1): 1 + max(0, int(np.log2(n / (total * share)))) for w, n in rows}


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, counts, len(own)).astype(np.int64)


class Shingler:
    """Sets of shingle keys; the top six bits of a key are its class, so keys in ascending order put rare words first."""

    def __init__(self, common: dict[int, int], size: int = SHINGLE):
        self.size = size
        self.keys = np.array(sorted(common), np.uint64)
        self.classes = np.array([min(63, common[int(k)]) for k in self.keys], np.uint64)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all texts, ascending and distinct in each, first key of each text and the end)."""
        hashes, first = _word_hashes(data, offsets)
        n, count = len(offsets) - 1, np.diff(first)
        rank = np.zeros(len(hashes), np.uint64)
        if len(self.keys) and len(hashes):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            rank = np.where(self.keys[at] == hashes, self.classes[at], np.uint64(0))
        full = np.maximum(0, count - self.size + 1)
        start = np.repeat(first[:-1], full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
        owner = np.repeat(np.arange(n), full)
        key, low = np.zeros(len(start), np.uint64), np.full(len(start), 63, np.uint64)
        for k in range(self.size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k])
            low = np.minimum(low, rank[start + k])
        short = np.flatnonzero((count > 0) & (count < self.size))
        whole = [mix(np.array([sum(int(h) * 31**k for k, h in enumerate(hashes[first[i] : first[i + 1]].tolist())) + int(count[i])], object) % 2**64)[0] for i in short]
        key = np.concatenate((key, np.array(whole, np.uint64)))
        low = np.concatenate((low, np.zeros(len(short), np.uint64)))
        owner = np.concatenate((owner, short))
        key = (low << np.uint64(58)) | (key >> np.uint64(6))
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[keep], owner[keep]
        return key, np.searchsorted(owner, np.arange(n + 1))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its first keys a set of n must show for every partner to meet one: n less the least overlap, plus one."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def signatures(docs: DataFrame, shingler: Shingler, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, f1, f2 (a 128-bit fingerprint of the set), keys (the prefix), bits (the parity bitmap, a power of two of at least n bits) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(shingler)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in blocks(offsets):
                keys, first = shared.value.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(first)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(s)), dtype=np.uint64)))[first] for s in (1, 2)]
                take = prefix_length(n, percent)
                at = np.repeat(first[:-1], take) + (np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(keys[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array((s[1:] - s[:-1]).view(np.int64)) for s in sums), lists, _bitmaps(keys, n)], ["doc_id", "n", "f1", "f2", "keys", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>, bits array<long>")


def _bitmaps(keys: np.ndarray, n: np.ndarray) -> pa.Array:
    size = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(1, n))).astype(np.int64))
    start = np.cumsum(size) - size
    bit = (mix(keys + np.uint64(3)) & (np.repeat(size, n) - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(np.repeat(start, n) + bit, minlength=int(size.sum())) & 1).astype(np.uint8)
    flat = np.packbits(parity, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.append(start, size.sum()).astype(np.int64) // 64).cast(pa.int32()), pa.array(flat))


def _differing(a: str, b: str):
    """Bits that differ in two bitmaps; the longer one (at most twice as long here) is folded to the other's length."""
    size = F.least(F.size(a), F.size(b))
    fold = lambda c: F.when(F.size(c) > size, F.zip_with(F.slice(c, 1, size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _most_differing(na, nb, percent: int):
    """Shingles that two sets of these sizes may differ in and still link."""
    return (na + nb) * (100 - percent) // (100 + percent) if isinstance(na, np.ndarray) else F.floor((na + nb) * (100 - percent) / (100 + percent))


def near_in_cells(bits: np.ndarray, inner: np.ndarray, outer: np.ndarray, radius: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of `inner`, those they are to be compared with): every pair of an inner member and an outer one - and of two inner ones if `within` - whose bitmaps differ in at most `radius` bits is in one of them."""
    while len(inner) > SMALL:
        every = np.concatenate((inner, outer))
        pivots = inner[np.linspace(0, len(inner) - 1, PIVOTS).astype(np.int64)]
        far = np.stack([np.bitwise_count(bits[every] ^ bits[p]).sum(1, dtype=np.int64) for p in pivots], 1)
        mine = np.arange(len(every)) < len(inner)
        home = np.where(mine & (far.min(1) <= 2 * radius), far.argmin(1), -1)
        for k in range(PIVOTS):
            if (home == k).any():
                yield every[home == k], every[(far[:, k] <= 3 * radius) & (home != k) & (~mine | within)]
        inner = every[mine & (home < 0)]
        if (home >= 0).sum() < LEAST_MET * PIVOTS:
            break
    if len(inner):
        yield inner, outer


def _block_pairs(percent: int):
    """Pairs (a, b) of the rows of each block - or of its two sides - that differ in component and pass size and bitmap."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("unit", "ascending"), ("side", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        unit, side, doc, n, own = (rows[c].to_numpy() for c in ("unit", "side", "doc_id", "n", "own"))
        d = rows["d"].to_numpy()
        lists = rows["bits"].chunk(0) if rows.num_rows else None
        flat, ends = (lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))) if lists is not None else (None, None)
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in zip(heads, np.append(heads[1:], len(unit)), strict=True) if len(unit) else []:
            if np.all(own[i:j] == own[i]):
                continue
            width = int(np.diff(ends[i : j + 1]).min())
            bits = np.zeros((j - i, width), np.uint64)
            for k in range(i, j):
                bits[k - i] = np.bitwise_xor.reduce(flat[ends[k] : ends[k + 1]].reshape(-1, width), 0)
            split = int(np.searchsorted(side[i:j], 1))
            within, most = split == j - i, int(n[i:j].max())
            radius = int(_most_differing(np.array([most]), most, percent)[0])
            for inner, outer in near_in_cells(bits, np.arange(split), np.arange(split, j - i), radius, within):
                for k, x in enumerate(inner):
                    at = np.concatenate((inner[k + 1 :], outer)) if within else outer
                    at = at[(own[i + at] != own[i + x]) & (100 * np.minimum(n[i + at], n[i + x]) >= percent * np.maximum(n[i + at], n[i + x]))]
                    at = at[~(np.abs(d[i + at] - d[i + x]) > 1 - percent / 100 + 1e-9)]
                    at = at[np.bitwise_count(bits[at] ^ bits[x]).sum(1, dtype=np.int64) <= _most_differing(n[i + at], n[i + x : i + x + 1], percent)]
                    if len(at):
                        out.append((np.minimum(doc[i + at], doc[i + x]), np.maximum(doc[i + at], doc[i + x])))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), ())))
        pairs = np.unique(np.stack((a, b), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def distances(pairs: DataFrame, texts: DataFrame, shingler: Shingler) -> DataFrame:
    """a, b, shared, na, nb of pairs (a, b): sizes of the two sets and of their intersection. texts: see zipped."""
    shared = pairs.sparkSession.sparkContext.broadcast(shingler)
    one, two = (texts.select(F.col("doc_id").alias(x), F.col("z").alias(f"t{x}")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (text_view(unzip(batch.column(k))) for k in (2, 3))
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, j in blocks(left[1] + right[1]):
                (a, fa), (b, fb) = (shared.value.sets(d[o[i] : o[j]], o[i : j + 1] - o[i]) for d, o in (left, right))
                for k in range(j - i):
                    x, y = a[fa[k] : fa[k + 1]], b[fb[k] : fb[k + 1]]
                    out[:, i + k] = len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], ["a", "b", "shared", "na", "nb"])

    # few pairs would be broadcast and many not; by shuffles it takes the same at every size
    joined = pairs.select("a", "b").hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long, shared long, na long, nb long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, label: for every document in an edge (a, b) the smallest document it can reach.

    Labels spread to neighbours and jump to the label of the label until none changes; each pass is a
    few joins and a written table, so nothing but a count comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("doc_id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        spread = labels.select("doc_id", "label").join(near, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        grown = materialise(spread.join(jump, "label", "left").select("doc_id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(labels)
        if not grown.filter("label <> old").limit(1).count():
            discard(both)
            return grown.select("doc_id", "label")
        labels = grown


def _alike(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def regions(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """region, doc_id, n, bits of every region with two or more members; of regions with the same members one stays.

    Counts and marks are summed before they are shuffled, and the semi-joins can be split, so a shingle of
    very many documents doesn't gather its rows in one task.
    """
    rows = reps.select(F.explode("keys").alias("key"), "doc_id", "n", "f1")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    banded = rows.join(often, "key", "left_semi").withColumn("band", F.explode(F.array(band, band + 1)))
    members = materialise(banded.select(F.xxhash64("key", "band").alias("region"), "doc_id", "n", "f1"), "members")
    marks = members.groupBy("region").agg(F.count(F.lit(1)).alias("c"), *(F.bit_xor(F.xxhash64(F.lit(k), "doc_id", "f1")).alias(f"x{k}") for k in (1, 2))).filter("c > 1")
    one = marks.groupBy("c", "x1", "x2").agg(F.min("region").alias("region")).select("region")
    kept = members.join(one, "region", "left_semi")
    out = materialise(kept.hint("merge").join(reps.select("doc_id", "f1", "bits"), ["doc_id", "f1"]).select("region", "doc_id", "n", "bits"), "regions")
    discard(members)
    return out


def links(texts: DataFrame, member: DataFrame, shingler: Shingler, percent: int = PERCENT) -> DataFrame | None:
    """doc_id, label of all documents with a link; None if there is no link."""
    fits = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (_differing("bits", "p.bits") <= _most_differing(F.col("n"), F.col("p.n"), percent))
    pivots = member.groupBy("region").agg(F.min(F.struct("doc_id", "n", "bits")).alias("p"))
    met = member.join(pivots, "region").filter((F.col("doc_id") != F.col("p.doc_id")) & fits)
    tested = materialise(distances(met.select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), texts, shingler), "tested")
    linked = tested.filter(_alike(percent)).select("a", "b")
    labels = components(linked) if linked.limit(1).count() else None
    # what is left of each region without its pivot, where there is more than one component
    rest = member.join(pivots.select("region", F.col("p.doc_id").alias("pivot")), "region").filter("doc_id <> pivot")
    rest = rest.join(labels, "doc_id", "left").withColumn("own", F.coalesce("label", "doc_id")) if labels is not None else rest.withColumn("own", F.col("doc_id"))
    mixed = rest.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("region", "m")
    far = tested.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("d"))
    rest = rest.join(mixed, "region").join(far, ["pivot", "doc_id"], "left")
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    rest = rest.withColumn("k", F.pmod(F.xxhash64(F.lit(7), "doc_id"), n).cast("int"))
    to = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.least(i, F.col("k")).alias("i"), F.greatest(i, F.col("k")).alias("j"), F.when(i < F.col("k"), 1).otherwise(0).alias("side"))))
    dealt = rest.withColumn("to", to).select(F.xxhash64("region", "to.i", "to.j").alias("unit"), "to.side", "doc_id", "n", "own", F.coalesce("d", F.lit(float("nan"))).alias("d"), "bits")
    dealt = materialise(dealt, "blocks")
    tasks = max(1, dealt.count() // TASK_ROWS)
    pairs = dealt.withColumn("task", F.pmod("unit", F.lit(tasks))).groupBy("task").applyInArrow(_block_pairs(percent), "a long, b long").distinct()
    more = distances(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts, shingler).filter(_alike(percent)).select("a", "b")
    more = materialise(more, "more")
    discard(dealt)
    if more.limit(1).count():
        labels = components(linked.union(more))
    discard(tested, more)
    return labels


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of
    `size` words (the whole text as one shingle if it has fewer). Null, empty and blank texts have empty
    sets and no links. Rows that repeat a doc_id have a row each, but are one document: what one of them
    links with, all do. A row with a null doc_id has the component of an equal set, else null, and links
    nothing. Other columns are ignored. Shingles are compared by 58-bit hashes (and a class of six bits).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shingler = Shingler(common_words(docs), size)
    base = materialise(signatures(docs, shingler, percent), "signatures")
    full = base.filter("n > 0")
    # the least document stands for a set; null ids come first in no order, and stand for none
    reps = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("rep is not null")
    reps = materialise(reps, "sets")
    first = reps.select("n", "f1", "f2", F.col("rep").alias("doc_id"), "c")
    same = ["doc_id", "n", "f1", "f2"]
    members = full.join(first.select(*same).hint("merge"), same, "left_semi").dropDuplicates(same)
    member = regions(members, percent)
    rows = materialise(base.select("doc_id", "n", "f1", "f2"), "rows")
    discard(base)  # keys and bits are in the regions now
    texts = materialise(zipped(docs).join(member.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    labels = links(texts, member, shingler, percent) if member.limit(1).count() else None
    if labels is None:
        labels = spark.createDataFrame([], "doc_id long, label long")
    named = materialise(reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("component_id"), "c"), "named")
    total = rows.count()
    discard(reps, member, texts)
    found = with_group(rows, named, ["n", "f1", "f2"], total)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents`: three words, from 0.90 on; see jaccard_components."""
    return jaccard_components(table(spark, sf_dir, "documents"))
