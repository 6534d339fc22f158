"""MinHash near-duplicate removal with sequential Bayesian verification.

Each text is a set of word shingles. BANDS bands of ROWS minimum hashes each deal the sets into buckets; two
sets that share a bucket are candidates. Candidates are compared by CHECKS further minimum hashes, which the
bands don't use, a batch at a time: with a uniform prior the similarity after m matches in n hashes is
Beta(m + 1, n - m + 1), and a pair goes as soon as the posterior probability that it reaches the threshold is
below MISS. What survives all batches is verified exactly on the full sets of both texts.

Buckets are not expanded into all pairs. Equal sets are united first; the least document of a bucket is
compared with others, until each is in its component; only the members of buckets that then still hold several
components meet each other, in blocks of BLOCK members, sorted by the sizes of their sets, which are verified within the block.

At a similarity of exactly 0.80 a pair shares no bucket with a probability of (1 - 0.8 ** 7) ** 64 = 3e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, discard, materialise, mix, ragged, small_batches, table, text_view, unzip, with_group, zipped
from .similar import Shingler, components, distances, regions

SHINGLE, PERCENT = 2, 80
#: Bands and the minimum hashes in each; further hashes of 16 bits that candidates are compared by, and those of a batch.
BANDS, ROWS, CHECKS, BATCH = 64, 7, 128, 32
#: A candidate goes once the probability that it reaches the threshold is below this.
MISS = 1e-6
#: Members of a bucket that are compared in one block, and rows and shingles that a task of blocks may be expected to hold.
BLOCK, TASK_ROWS, TASK_SHINGLES = 2048, 20_000, 20_000_000
#: Shingles of a strip of a block's members that are tested on their full sets at a time.
STRIP = 1_000_000
#: Text bytes that are hashed at a time, so that their shingles stay in a core's cache.
HASH_BYTES = 1 << 18

_CONSTANTS = np.random.default_rng(11).integers(0, 1 << 32, (BANDS * ROWS + CHECKS, 3), dtype=np.uint64).astype(np.uint32) | np.array([0, 1, 1], np.uint32)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches that keep a pair) after each batch.

    P(Beta(m + 1, n - m + 1) >= s) is the probability of at most m successes in n + 1 trials of probability s.
    """
    s, out = percent / 100, []
    for n in range(BATCH, CHECKS + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if below >= miss:
                break
        out.append((n, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the pairs - rows of both signature matrices, or one row against all - that no batch prunes, their matches)."""
    alive, matches, done = np.arange(len(right)), np.zeros(len(right), np.int64), 0
    for n, enough in least:
        one = left[:, done:n] if len(left) == 1 else left[alive, done:n]
        matches[alive] += (one == right[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= enough], n
        if not len(alive):
            break
    return alive, matches[alive]


def minimum_hashes(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A row for each set (keys from one head to the next, none empty), a column for each hash function."""
    x = (keys >> np.uint64(16)).astype(np.uint32)
    h, low = np.empty_like(x), np.empty_like(x)
    out = np.empty((len(heads), len(_CONSTANTS)), np.uint32)
    for k, (c, a, d) in enumerate(_CONSTANTS):
        np.bitwise_xor(x, c, out=h)
        np.multiply(h, a, out=h)
        np.right_shift(h, np.uint32(16), out=low)
        np.bitwise_xor(h, low, out=h)
        np.multiply(h, d, out=h)
        out[:, k] = np.minimum.reduceat(h, heads)
    return out


def signatures(docs: DataFrame, shingler: Shingler) -> DataFrame:
    """doc_id, n, f1, f2 (a 128-bit fingerprint of the set), keys (a hash for each band), bits (CHECKS hashes of 16 bits) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(shingler)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in blocks(offsets, HASH_BYTES):
                keys, first = shared.value.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(first)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(s)), dtype=np.uint64)))[first] for s in (1, 2)]
                full = np.flatnonzero(n)
                low = minimum_hashes(keys, first[:-1][full]) if len(full) else np.zeros((0, len(_CONSTANTS)), np.uint32)
                bands = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(full), 0)
                for k in range(ROWS):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + low[:, k : BANDS * ROWS : ROWS])
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                checks = iter(low[:, -CHECKS:].astype("<u2"))
                bits = pa.array([next(checks).tobytes() if x else b"" for x in n], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array((s[1:] - s[:-1]).view(np.int64)) for s in sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64))), bits],
                    ["doc_id", "n", "f1", "f2", "keys", "bits"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>, bits binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return text_view(column)[0].view("<u2").reshape(len(column), CHECKS)


def _pruned(least: list[tuple[int, int]]):
    """Of the pairs (a, b, one signature, the other) those that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = pa.array(surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), least)[0])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(alive) for k in (0, 1)], ["a", "b"])

    return run


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
    """(the rows in order of unit, side, n and doc_id, where each unit that holds several components begins and ends)."""
    rows = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("unit", "side", "n", "doc_id")]).combine_chunks()
    unit, own = (rows[c].to_numpy() for c in ("unit", "own"))
    heads = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
    return rows, [(i, j) for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True) if np.any(own[i:j] != own[i])]


def _unit_pairs(rows: pa.Table, percent: int, least: list[tuple[int, int]], best: bool):
    """A function of a unit's bounds: each row x with the rows at, of another component - and of the other side, if there are two -, that no batch prunes; with `best` only that of most matches."""
    side, n, own = (rows[c].to_numpy() for c in ("side", "n", "own"))
    bits = _matrix(rows["bits"].combine_chunks())

    def run(i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
        split = i + int(np.searchsorted(side[i:j], 1))
        for x in range(i, split):
            low, high = (x + 1, split) if split == j else (split, j)
            low += np.searchsorted(n[low:high], -(-n[x] * percent // 100))
            high = low + np.searchsorted(n[low:high], n[x] * 100 // percent, side="right")
            at = np.arange(low, high)
            at = at[own[at] != own[x]]
            alive, matches = surviving(bits[x : x + 1], bits[at], least)
            at = at[alive[[matches.argmax()]] if best and len(alive) else alive]
            if len(at):
                yield x, at

    return run


def _likeliest(percent: int, least: list[tuple[int, int]]):
    """For each row of a block, a pair (a, b) with the likeliest of another component, if one survives."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, units = _sorted_rows(batches)
        doc, pairs = rows["doc_id"].to_numpy(), _unit_pairs(rows, percent, least, True)
        found = [(doc[x], doc[at[0]]) for i, j in units for x, at in pairs(i, j)]
        a, b = np.unique(np.sort(np.array(found, np.int64).reshape(-1, 2), 1), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    return run


def confirmed(pairs: list[tuple[int, np.ndarray]], sets, size: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links among the pairs (x, each of at) that join two labels; label is brought up to date, so a pair within one needs no test.

    sets: gives (keys of some rows, first key of each and the end). Rows meet by strips of about STRIP shingles (size: of each row), so
    that no more than two strips are in memory, however many the pairs are.
    """
    if not pairs:
        return
    left, right = np.repeat([x for x, _ in pairs], [len(at) for _, at in pairs]), np.concatenate([at for _, at in pairs])
    rows = np.union1d(left, right)
    strip = (np.cumsum(size[rows]) - size[rows]) // STRIP
    of = lambda x: strip[np.searchsorted(rows, x)]
    for s, t in np.unique(np.stack((of(left), of(right)), 1), axis=0):
        here = (of(left) == s) & (of(right) == t)
        own, x_all, y_all = rows[(strip == s) | (strip == t)], left[here], right[here]
        keys, first = sets(own)
        key = np.unique(keys, return_inverse=True)[1]
        marked, n = np.zeros(int(key.max(initial=0)) + 1, np.int64), np.diff(first)
        for x, low in zip(*np.unique(x_all, return_index=True), strict=True):  # left is in order
            y = y_all[low : np.searchsorted(x_all, x, side="right")]
            y = y[label[y] != label[x]]
            p, q = np.searchsorted(own, x), np.searchsorted(own, y)
            marked[key[first[p] : first[p + 1]]] = 1
            sums = np.append(0, np.cumsum(marked[key[np.repeat(first[q], n[q]) + ragged(n[q])]]))
            marked[key[first[p] : first[p + 1]]] = 0
            ends = np.append(0, np.cumsum(n[q]))
            shared = sums[ends[1:]] - sums[ends[:-1]]
            for z in y[(shared > 0) & (100 * shared >= percent * (n[p] + n[q] - shared))]:
                if label[z] != label[x]:
                    label[label == label[z]] = label[x]
                    yield int(x), int(z)


def _block_links(percent: int, least: list[tuple[int, int]], shingler: Broadcast):
    """Links (a, b) that unite the components within each block - or of its two sides -: the pairs that survive, tested on the full sets where the texts are.

    A block gives fewer links than it has rows, whatever the number of pairs tested.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, units = _sorted_rows(batches)
        doc, n, own = (rows[c].to_numpy() for c in ("doc_id", "n", "own"))
        pairs, texts = _unit_pairs(rows, percent, least, False), rows["z"].combine_chunks()
        sets = lambda some: shingler.value.sets(*text_view(unzip(texts.take(pa.array(some)))))
        found = []
        for i, j in units:
            label = np.full(len(own), -1)
            label[i:j] = np.unique(own[i:j], return_inverse=True)[1]
            found += [(doc[x], doc[y]) for x, y in confirmed(list(pairs(i, j)), sets, n, label, percent)]
        a, b = np.sort(np.array(found, np.int64).reshape(-1, 2), 1).T
        yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, shingler: Shingler, percent: int) -> DataFrame:
    tested = distances(pairs, texts, shingler)
    return tested.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b").distinct()


def _with_labels(member: DataFrame, labels: DataFrame) -> DataFrame:
    """member with own: the component of each document so far."""
    return member.join(labels, "doc_id", "left").withColumn("own", F.coalesce("label", "doc_id")).drop("label")


def _roots(parents: DataFrame) -> DataFrame:
    """doc_id, label: the end of the way that each document b goes by its one, smaller parent a; it jumps to the parent's parent until none moves."""
    labels = materialise(parents.select(F.col("b").alias("doc_id"), F.col("a").alias("label")), "labels")
    while True:
        up = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        grown = materialise(labels.select("doc_id", "label").join(up, "label", "left").select("doc_id", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "labels")
        discard(labels)
        if grown.filter("moved").isEmpty():
            return grown.select("doc_id", "label")
        labels = grown


def _united(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after links (a, b) among documents, too: only components are joined, so it costs what they are, not their members."""
    of = lambda c: labels.select(F.col("doc_id").alias(c), F.col("label").alias(f"{c}_label"))
    roots = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    roots = materialise(roots.filter("a <> b").distinct(), "roots")
    if roots.isEmpty():
        return labels
    found = components(roots)
    moved = labels.join(found.select(F.col("doc_id").alias("label"), F.col("label").alias("further")), "label", "left").select("doc_id", F.coalesce("further", "label").alias("label"))
    return materialise(moved.union(found.filter("doc_id <> label").select("doc_id", "label")), "labels")


def links(texts: DataFrame, member: DataFrame, shingler: Shingler, percent: int = PERCENT) -> DataFrame:
    """doc_id, label of all documents that link with a smaller one, or more, among `member` (see similar.regions).

    Rounds: each document with the least of its buckets' least documents; then, in buckets that hold several components,
    each document with that bucket's; then, where there are several still, each with the likeliest of another component,
    until that finds no link; then all those of different components, where the texts are: no pair becomes a row, and a
    block gives only the links that unite its components. A pair within a component needs no test, so a large group of
    near copies costs a few tests for each of its members; one whose members are just below the threshold is tested whole.
    """
    least = least_matches(percent)
    linked = lambda pairs: materialise(_linked(pairs, texts, shingler, percent), "linked")

    def met(rows: DataFrame, pivots: DataFrame, apart) -> DataFrame:
        fits = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
        return rows.join(pivots, "region").filter(fits & apart).select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("p.bits").alias("one"), F.col("bits").alias("other"))

    prune = lambda pairs: pairs.mapInArrow(_pruned(least), "a long, b long").distinct()
    head = F.min(F.struct("doc_id", "n", "bits")).alias("p")
    near = met(member, member.groupBy("region").agg(head), F.col("doc_id") != F.col("p.doc_id"))
    labels = _roots(linked(prune(near.groupBy("b").agg(F.min(F.struct("a", "one", "other")).alias("s")).select("s.a", "b", "s.one", "s.other"))))

    several = [F.count(F.lit(1)).alias("m"), F.min("own").alias("low"), F.max("own").alias("high")]
    rows = _with_labels(member, labels)
    mixed = rows.groupBy("region").agg(F.min(F.struct("doc_id", "n", "bits", "own")).alias("p"), *several).filter("low <> high").select("region", "p")
    tested = materialise(prune(met(rows, mixed, F.col("own") != F.col("p.own"))), "candidates")
    labels = _united(labels, linked(tested))

    def dealt() -> DataFrame:
        """The members of buckets with several components, dealt to blocks of BLOCK and to pairs of such."""
        rows = _with_labels(member, labels)
        mixed = rows.groupBy("region").agg(*several).filter("low <> high").select("region", "m")
        n = F.ceil(F.col("m") / BLOCK).cast("int")
        rows = rows.join(mixed, "region").withColumn("k", F.pmod(F.xxhash64(F.lit(7), "doc_id"), n).cast("int"))
        to = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.least(i, F.col("k")).alias("i"), F.greatest(i, F.col("k")).alias("j"), F.when(i < F.col("k"), 1).otherwise(0).alias("side"))))
        return materialise(rows.withColumn("to", to).select(F.xxhash64("region", "to.i", "to.j").alias("unit"), "to.side", "doc_id", "n", "own", "bits"), "blocks")

    def by_task(rest: DataFrame, rows: DataFrame):
        count, shingles = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        tasks = max(1, count // TASK_ROWS, shingles // TASK_SHINGLES)
        return rows.withColumn("task", F.pmod("unit", F.lit(tasks))).groupBy("task")

    tests, more = [tested], True
    while more:
        rest = dealt()
        pairs = by_task(rest, rest).applyInArrow(_likeliest(percent, least), "a long, b long").distinct()
        tests.append(materialise(pairs.join(reduce(DataFrame.union, tests), ["a", "b"], "left_anti"), "candidates"))
        found = linked(tests[-1])
        labels, more = _united(labels, found), not found.isEmpty()
        discard(rest)
    discard(*tests)

    rest, shared = dealt(), texts.sparkSession.sparkContext.broadcast(shingler)
    whole = rest.hint("merge").join(texts, "doc_id")
    found = materialise(by_task(rest, whole).applyInArrow(_block_links(percent, least, shared), "a long, b long").distinct(), "linked")
    discard(rest)
    return _united(labels, found)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of `size`
    words (the whole text as one shingle if it has fewer), found by buckets and posterior bounds and confirmed on
    the full sets; kept marks the least doc_id of a component. Null, empty and blank texts have empty sets and no
    links. Rows that repeat a doc_id have a row each, but are one document: what one of them links with, all do,
    and all of them are kept or none. A row with a null doc_id has the component of an equal set and isn't kept
    then; else its component is null and it is kept. Other columns are ignored. Shingles are compared by 58-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shingler = Shingler({}, size)
    base = materialise(signatures(docs, shingler), "signatures")
    full = base.filter("n > 0")
    reps = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("rep is not null")
    reps = materialise(reps, "sets")
    same = ["doc_id", "n", "f1", "f2"]
    first = reps.select("n", "f1", "f2", F.col("rep").alias("doc_id")).select(*same)
    members = full.join(first.hint("merge"), same, "left_semi").dropDuplicates(same)
    member = regions(members, percent)
    rows = materialise(base.select(*same), "rows")
    discard(base)
    texts = materialise(zipped(docs).join(member.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    labels = links(texts, member, shingler, percent)
    named = materialise(reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("component_id"), "c"), "named")
    total = rows.count()
    discard(reps, member, texts)
    found = with_group(rows, named, ["n", "f1", "f2"], total)
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `documents`: two words, from 0.80 on; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), shingled as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
        else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
    from worded
), sets as materialized (
    select doc_id, len(s) as n, s from shingled
), same as materialized (
    select min(doc_id) as rep, n, list_sort(s) as s from sets where n > 0 group by n, list_sort(s)
), exploded as materialized (
    select rep, n, unnest(s) as x from same
), numbered as materialized (
    select rep, n, dense_rank() over (order by x) as x from exploded
), often as materialized (
    select x, count(*) as c from numbered group by x having count(*) > 1
), ranked as materialized (
    select rep, n, x, row_number() over (partition by rep order by coalesce(c, 1), x) as k from numbered left join often using (x)
), candidates as materialized (
    select distinct a.rep as a, b.rep as b, a.n as na, b.n as nb
    from ranked a join ranked b on a.x = b.x and a.rep < b.rep
    where a.k <= a.n - (80 * a.n + 99) // 100 + 1 and b.k <= b.n - (80 * b.n + 99) // 100 + 1
        and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), edges as materialized (
    select a, b from candidates c join numbered x on x.rep = c.a join numbered y on y.rep = c.b and y.x = x.x
    group by a, b, na, nb having 100 * count(*) >= 80 * (na + nb - count(*))
), both_ways as materialized (
    select a, b from edges union select b, a from edges
), reach(a, b) as (
    select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b
), label as (
    select a as rep, least(a, min(b)) as component from reach group by a
), named as (
    select s.doc_id, s.n, coalesce(l.component, m.rep, s.doc_id) as component
    from sets s left join same m on m.n = s.n and m.s = list_sort(s.s) left join label l on l.rep = m.rep
)
select doc_id, cast(n as bigint) as n_shingles, component as component_id, doc_id = component as kept from named
"""
