import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    points = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            points.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, q in points:
        if i is None or i % 50:
            continue
        score = lambda p: sum(x * y for x, y in zip(q, p[2], strict=False))
        same = sorted(((score(p), p[0]) for p in points if p[1] == label and p[0] != i), key=order)[:5]
        other = sorted(((score(p), p[0]) for p in points if p[1] != label), key=order)
        for s, p in same:
            hard = [x for x in other if 50 * s <= 100 * x[0] <= 95 * s][:3]
            out += [(i, p, k + 1, n, s, x) for k, (x, n) in enumerate(hard)]
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("q", F.lit("clash")).withColumn("PLACE", F.lit(1)).withColumn("key", F.lit(None))
    return sorted(map(tuple, negatives.hard_negatives(frame).collect()), key=str)


def cloud(seed, n, d, spread):
    """Vectors around a few directions of very different strength, so that bounds both prune and come near the bands."""
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(4, d)) * spread
    x = axes[rng.integers(0, 4, n)] + rng.normal(size=(n, d)) * np.geomspace(1, 0.05, d)
    return [(i, (v / 4).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("cells", [300, 1 << 22])
def test_like_brute_force(spark, monkeypatch, cells):
    """Several tiles of both sides, and one."""
    monkeypatch.setattr(negatives, "ROW_CELLS", 10 * cells)
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", cells // 4)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 100)
    rows = cloud(1, 700, 16, 1.0)
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 50


def test_odd_rows(spark):
    """Nulls, gaps, lengths, ties, repeated rows and ids, zero and negative scores, numbers beyond 64-bit scores."""
    rows = cloud(2, 160, 5, 0.3)
    inf, nan = float("inf"), float("nan")
    rows += [(50, None, 1), (100, [1.0, None, 0.0, 0.0, 0.0], 1), (150, [1.0, nan, 0.0, 0.0, 0.0], 2), (7, [inf] * 5, 2), (3, [1.0] * 5, None), (8, [-inf] * 5, 1)]
    rows += [(None, [0.5] * 5, 1), (None, [0.5] * 5, 2), (None, None, None)]
    rows += rows[:60]  # repeated rows, anchors among them
    rows += [(200, [], 1), (201, [0.25], 1), (202, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 3), (250, [0.0] * 5, 2), (251, [0.0] * 5, 2), (252, [0.0] * 5, 3)]
    rows += [(300, [1e300] * 5, 1), (301, [1e8, -1e8, 0.0, 0.0, 0.0], 1), (350, [2e6, 0.0, 0.0, 0.0, 0.0], 4), (351, [2e6, 0.0, 0.0, 0.0, 0.0], 4), (352, [1.5e6, 3.0, 0.0, 0.0, 0.0], 5)]
    rows += [(400 + k, [0.5, 0.5, 0.0, 0.0, 0.0], 6) for k in range(12)] + [(420 + k, [0.4, 0.5, 0.0, 0.0, 0.0], 7) for k in range(12)]  # ties
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [0.5], 1)]) == []
    assert got(spark, [(50, [0.5], 1), (51, [], 1)]) == brute([(50, [0.5], 1), (51, [], 1)])


def test_bounds_keep_what_counts_and_prune():
    rng = np.random.default_rng(6)
    q = np.floor(256 * rng.normal(size=(900, 32)) * np.geomspace(1, 0.02, 32)).astype(np.int64) @ np.eye(32, dtype=np.int64)
    axes = negatives.rotation((q.T @ q).astype(float))
    assert np.allclose(axes.T @ axes, np.eye(32), atol=1e-12)
    one, other = negatives.Rotated(q[:40], axes), negatives.Rotated(q, axes)
    scores = q[:40] @ q.T
    low, high = np.quantile(scores, 0.98, axis=1), np.quantile(scores, 0.995, axis=1)
    i, j = negatives.surviving(one, np.arange(40), other, np.arange(900), low, high)
    met = defaultdict(set)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        met[a].add(b)
    assert all(set(np.flatnonzero((scores[a] >= low[a]) & (scores[a] <= high[a])).tolist()) <= met[a] for a in range(40))
    assert len(i) < 0.1 * scores.size
    assert (negatives.products(one, i, other, j) == scores[i, j]).all()


def test_second_moments(spark):
    points = negatives.vectors(spark.createDataFrame(cloud(3, 100, 4, 1.0), SCHEMA).repartition(3))
    q = np.array([np.frombuffer(r.q, "<i4") for r in points.collect()], float)
    assert np.allclose(negatives.second_moments(points, 4), q.T @ q)


def test_query(spark, tmp_path):
    rows = cloud(4, 120, 6, 1.0)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, negatives.op13_hard_negatives(spark, str(tmp_path)).collect()), key=str) == brute(rows)
