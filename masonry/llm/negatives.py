"""Hard negatives by partial products in a rotated space.

Vectors are scaled to whole numbers. An orthogonal rotation onto the principal axes of their second moments,
summed over all rows, puts most of a product into its leading components. For each anchor these are
accumulated, a stage of components at a time, and what the rest can still add is at most the product of the
two residual norms, plus a slack for rounding; rows whose bounds exclude them go at once, and the scores of
those that survive are products of the whole numbers. So no score depends on the rotation.

Anchors meet all rows in tiles: rows are dealt to groups and anchors to groups of bounded size, each tile
keeps the best of its rows for each of its anchors, and a ranked window over the tiles' rows gives the first.
Two rounds: the positives of an anchor, whose scores set its bands; then the negatives within each band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, text_view

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Numbers in the vectors of a tile's rows and of its anchors; rows that make a group of their own worthwhile.
ROW_CELLS, ANCHOR_CELLS, LEAST_ROWS = 1 << 22, 1 << 20, 1024
#: Rows and anchors whose products are accumulated together, and pairs that are verified together.
CHUNK_ROWS, CHUNK_ANCHORS, VERIFIED = 1024, 256, 1 << 15
#: Below this share of surviving pairs, components are accumulated for each pair instead of for whole chunks.
SPARSE = 0.1
#: A null vec_id comes after all others, as in SQL.
LAST = np.iinfo(np.int64).max


def vectors(embeddings: DataFrame) -> DataFrame:
    """place, vec_id, label, q of the rows that take part: q has the whole numbers as 32-bit integers.

    Out are null labels and vectors, null and non-finite components, and vectors whose squared norm after
    scaling is 2 ** 62 or more, whose scores might not fit 64 bits.
    """
    infinite = F.lit(float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False))))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            length = lists.value_lengths().to_numpy().astype(np.int64)
            with np.errstate(over="ignore"):
                q = np.floor(SCALE * lists.flatten().to_numpy())
                norms = np.bincount(np.repeat(np.arange(len(length)), length), q * q, len(length))
            fits = norms < 2.0**62
            q = np.where(np.repeat(fits, length), q, 0).astype("<i4")
            ends = np.append(0, np.cumsum(4 * length)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(q)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), packed], ["place", "vec_id", "label", "q"]).filter(pa.array(fits))

    numbered = rows.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", "v")
    return materialise(numbered.mapInArrow(run, "place long, vec_id long, label long, q binary"), "vectors")


def _whole(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The vectors of a column q, a row each; what a shorter one lacks is 0."""
    raw, offsets = text_view(column)
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None] < np.diff(offsets)[:, None] // 4] = raw.view("<i4")
    return out


def second_moments(points: DataFrame, d: int) -> np.ndarray:
    """The sums of products of all pairs of components over all rows; a line of them for each component is what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((d, d))
        for batch in batches:
            x = _whole(batch.column(1), d).astype(np.float64)
            sums += x.T @ x
            slot = batch.column(0)[0].as_py() if batch.num_rows else 0
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, slot)), pa.array(np.arange(d)), pa.array([s.tobytes() for s in sums], pa.binary())], ["slot", "line", "sums"])

    def add(lines: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in lines["sums"]], 0)
        return pa.table({"slot": lines["slot"][:1], "line": lines["line"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "slot long, line long, sums binary"
    parts = points.select(F.pmod(F.spark_partition_id(), F.lit(64)).cast("long").alias("slot"), "q").mapInArrow(run, kind)
    lines = parts.groupBy("slot", "line").applyInArrow(add, kind).groupBy("line").applyInArrow(add, kind)
    out = np.zeros((d, d))
    for r in lines.collect():
        out[r.line] = np.frombuffer(r.sums)
    return out


def rotation(moments: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes, the strongest first."""
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


class Rotated:
    """Whole-number vectors `q`, their rotated images `x`, and the norms of what each stage leaves."""

    def __init__(self, q: np.ndarray, axes: np.ndarray):
        d = len(axes)
        self.q, self.x = q, q.astype(np.float64) @ axes
        self.cuts = sorted({-(-d * k // 8) for k in (2, 4, 6, 7)})
        self.rest = [np.sqrt((self.x[:, k:] ** 2).sum(1)) for k in self.cuts]
        #: Rounding of d products of rotated components stays far below this times both norms.
        self.slack = np.sqrt((self.x**2).sum(1)) * ((d + 8) * 2.0**-26)

    def bound(self, stage: int, at) -> tuple[np.ndarray, np.ndarray]:
        return self.rest[stage][at], self.slack[at]


def surviving(anchors: Rotated, a: np.ndarray, rows: Rotated, b: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b` of all pairs - but for those not `allowed` - that may score from low to high (a number for each of `a`)."""
    alive = np.ones((len(a), len(b)), bool) if allowed is None else allowed.copy()
    part, done = np.zeros(alive.shape), 0
    i = j = p = None
    for stage, cut in enumerate(anchors.cuts):
        (ra, sa), (rb, sb) = anchors.bound(stage, a), rows.bound(stage, b)
        if i is None and alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            p = part[i, j]
        if i is None:
            part += anchors.x[a, done:cut] @ rows.x[b, done:cut].T
            rest = ra[:, None] * rb[None] + sa[:, None] * sb[None]
            alive &= (part + rest >= low[:, None]) & (part - rest <= high[:, None])
        else:
            p = p + np.einsum("ij,ij->i", anchors.x[a[i], done:cut], rows.x[b[j], done:cut])
            rest = ra[i] * rb[j] + sa[i] * sb[j]
            kept = (p + rest >= low[i]) & (p - rest <= high[i])
            i, j, p = i[kept], j[kept], p[kept]
        done = cut
    if i is None:
        i, j = np.nonzero(alive)
    return i, j


def products(anchors: Rotated, i: np.ndarray, rows: Rotated, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), VERIFIED):
        part = slice(at, at + VERIFIED)
        out[part] = np.einsum("ij,ij->i", anchors.q[i[part]], rows.q[j[part]])
    return out


class Best:
    """The first `most` (score, id) of each group: higher scores first, ties by smaller ids."""

    def __init__(self, groups: int, most: int):
        self.most, self.groups = most, groups
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        self.group, self.score, self.id = (x[rank < self.most] for x in (group, score, ids))

    def least(self) -> np.ndarray:
        """What a score must reach to count; lowest where a group isn't full."""
        out = np.full(self.groups, -np.inf)
        first = np.searchsorted(self.group, np.arange(self.groups))
        full = np.flatnonzero(np.bincount(self.group, minlength=self.groups) >= self.most)
        out[full] = self.score[first[full] + self.most - 1]
        return out


def _chunks(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that grow up to `most`, so that the first ones set bounds for the rest."""
    at, size = 0, min(64, most)
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(2 * size, most)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy()


def _named(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == LAST)


def _positives(axes: np.ndarray, most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        anchors, rows = anchors.sort_by("label"), rows.sort_by("label")
        one, other = (Rotated(_whole(t["q"], len(axes)), axes) for t in (anchors, rows))
        key, own, ids, la, lb = anchors["key"].to_numpy(), _ids(anchors["vec_id"]), _ids(rows["vec_id"]), anchors["label"].to_numpy(), rows["label"].to_numpy()
        out = [pa.table({"key": key[:0], "positive_id": _named(ids[:0]), "positive_score": ids[:0]})]
        for label in np.unique(la):
            at = np.flatnonzero(la == label)
            first, end = np.searchsorted(lb, label), np.searchsorted(lb, label, side="right")
            for i in range(0, len(at), CHUNK_ANCHORS):
                a = at[i : i + CHUNK_ANCHORS]
                best = Best(len(a), most)
                for low, high in _chunks(end - first, CHUNK_ROWS):
                    b = np.arange(first + low, first + high)
                    x, y = surviving(one, a, other, b, best.least(), np.full(len(a), np.inf), own[a][:, None] != ids[b][None])
                    best.add(x, products(one, a[x], other, b[y]), ids[b[y]])
                out.append(pa.table({"key": key[a[best.group]], "positive_id": _named(best.id), "positive_score": best.score}))
        return pa.concat_tables(out)

    return run


def _negatives(axes: np.ndarray, most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        one, other = (Rotated(_whole(t["q"], len(axes)), axes) for t in (anchors, rows))
        key, ids, la, lb = anchors["key"].to_numpy(), _ids(rows["vec_id"]), anchors["label"].to_numpy(), rows["label"].to_numpy()
        lists = anchors["scores"].combine_chunks()
        count = lists.value_lengths().to_numpy() if len(key) else np.zeros(0, np.int64)
        width = max(1, count.max(initial=0))
        has = np.arange(width)[None] < count[:, None]
        scores = np.full((len(key), width), -1, np.int64)
        scores[has] = lists.flatten().to_numpy()
        # 50 * positive <= 100 * negative <= 95 * positive in whole numbers; never where the positive is negative
        bottom, top = -(-scores // 2), scores + (-scores) // 20
        band = has & (bottom <= top)
        out = [pa.table({"key": key[:0], "p": ids[:0], "negative_id": _named(ids[:0]), "negative_score": ids[:0]})]
        at = np.flatnonzero(band.any(1))
        for i in range(0, len(at), CHUNK_ANCHORS):
            a = at[i : i + CHUNK_ANCHORS]
            own, floor, roof = band[a], bottom[a], top[a]
            best, high = Best(len(a) * width, most), np.where(own, roof, -np.inf).max(1)
            for start, end in _chunks(len(ids), CHUNK_ROWS):
                b = np.arange(start, end)
                low = np.where(own, np.maximum(best.least().reshape(-1, width), floor), np.inf).min(1)
                x, y = surviving(one, a, other, b, low, high, la[a][:, None] != lb[b][None])
                score = products(one, a[x], other, b[y])
                fits = own[x] & (score[:, None] >= floor[x]) & (score[:, None] <= roof[x])
                z, p = np.nonzero(fits)
                best.add(x[z] * width + p, score[z], ids[b[y[z]]])
            out.append(pa.table({"key": key[a[best.group // width]], "p": best.group % width + 1, "negative_id": _named(best.id), "negative_score": best.score}))
        return pa.concat_tables(out)

    return run


def _first(found: DataFrame, by: list[str], score: str, name: str, rank: str, most: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.col(name).asc_nulls_last()))
    return found.withColumn(rank, place).filter(F.col(rank) <= most)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, embedding).

    Rows with a null label or vector, or with a null or non-finite component, take no part, nor do vectors
    too long for 64-bit scores (see vectors). Components that a shorter vector lacks count as 0. Each row counts,
    repeated ones too, but a row with the anchor's vec_id is no other row, so no positive; an anchor that repeats
    gives its rows as often. A null vec_id is no anchor and comes last among ties. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    points = vectors(embeddings)
    anchor = F.coalesce(F.col("vec_id") % ANCHOR_EVERY == 0, F.lit(False))
    n, m, d = points.agg(F.count(F.lit(1)), F.sum(anchor.cast("long")), F.max(F.length("q") / 4).cast("int")).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not m:
        return spark.createDataFrame([], kind)
    d = max(1, d)
    axes = rotation(second_moments(points, d))
    parallel = min(n // LEAST_ROWS, 2 * spark.sparkContext.defaultParallelism)
    groups, blocks = max(1, -(-n * d // ROW_CELLS), parallel), -(-m * d // ANCHOR_CELLS)

    def met(chosen: DataFrame, tile, kind: str) -> DataFrame:
        """Each anchor goes to one block and to every group, each row to one group and to every block."""
        every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
        # anchors' places may be alike modulo a number, so they are hashed
        left = chosen.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))
        right = points.withColumn("g", F.pmod("place", F.lit(groups)).cast("int")).withColumn("b", every(blocks))
        return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(tile, kind)

    chosen = points.filter(anchor).select(F.col("place").alias("key"), *(F.col(c).alias(c) for c in ("vec_id", "label", "q")))
    found = met(chosen, _positives(axes, positives), "key long, positive_id long, positive_score long")
    near = materialise(_first(found, ["key"], "positive_score", "positive_id", "p", positives), "positives")
    scores = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("s")).select("key", F.col("s.positive_score").alias("scores"))
    found = met(chosen.join(scores, "key"), _negatives(axes, negatives), "key long, p long, negative_id long, negative_score long")
    found = _first(found, ["key", "p"], "negative_score", "negative_id", "rank", negatives)
    named = near.join(chosen.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.join(named, ["key", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of `embeddings`; see hard_negatives."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = """
with points as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), scored as materialized (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
    from points a join points b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
    s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""
