import collections
import random

import pytest
from pyspark.sql import functions as F

from masonry.llm import packing


def slow(lengths, sources, clusters, capacity, quota):
    """The tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and b["room"] > 0 and (c < 0 or c not in b["c"]) and (s < 0 or len(b["s"].get(s, [])) < 2 or sum(b["s"][s]) < quota)]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "c": set(), "s": {}})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= n
        bins[k]["c"].add(c)
        bins[k]["s"].setdefault(s, []).append(n)
    return out


def test_like_the_slow_search():
    rng = random.Random(4)
    for quota in (1, 40, 70):
        lengths = sorted((rng.randint(0, 90) for _ in range(300)), reverse=True)
        sources, clusters = ([rng.randint(-1, m) for _ in lengths] for m in (5, 60))
        assert packing.best_fit(lengths, sources, clusters, 100, dict.fromkeys(sources, quota)) == slow(lengths, sources, clusters, 100, quota)
    # a source and a cluster that a third of the pieces have, and many of each
    sources, clusters = ([0 if rng.random() < 0.34 else rng.randint(1, m) for _ in lengths] for m in (400, 200))
    assert packing.best_fit(lengths, sources, clusters, 100, dict.fromkeys(sources, 50)) == slow(lengths, sources, clusters, 100, 50)


@pytest.mark.parametrize("n_sources", [1, 2, 40])
def test_bins_are_full_whatever_the_sources(n_sources):
    rng = random.Random(n_sources)
    lengths = sorted((rng.randint(20, 500) for _ in range(3000)), reverse=True)
    sources = [rng.randrange(n_sources) for _ in lengths]
    placed = packing.best_fit(lengths, sources, [-1] * len(lengths))
    bins = max(k for k, _ in placed) + 1
    assert sum(lengths) / (bins * packing.CAPACITY) > 0.94
    most, used = packing.quotas(lengths, sources), collections.defaultdict(list)
    for (k, _), s, n in zip(placed, sources, lengths, strict=True):
        used[k, s].append(n)
    assert all(len(own) <= 2 or sum(own[:-1]) < most[s] for (_, s), own in used.items())


def test_query(spark, docs, texts, tmp_path):
    docs.unionByName(docs.limit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op10_best_fit_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {3 * i for i in range(len(texts))} and all(0 <= r.bin_offset and r.bin_offset + r.length <= packing.CAPACITY for r in rows)


def test_pieces_cover_documents_and_bins_hold(spark, docs, texts, empty):
    given = packing.measured(docs.withColumn("length", F.lit("clash")))
    rows = packing.pack(given, capacity=100, group_pieces=10).collect()
    length = {3 * i: len((t or "").split()) for i, t in enumerate(texts)}
    for doc in length:
        pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == doc)
        assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[1] == 100 * p[0] for p in pieces)
        assert abs(sum(p[2] for p in pieces) - length[doc]) <= 2  # Python splits at more characters
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length))
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 100
    again = packing.pack(given.repartition(5), capacity=100, group_pieces=10).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert packing.pack(packing.measured(empty)).count() == 0


def test_nulls(spark):
    rows = packing.pack(spark.createDataFrame([(None, None, None, None), (1, -5, "a", 1), (1, 0, None, 1)], "doc_id long, length long, source string, cluster long")).collect()
    assert len(rows) == 3 and all(r.length == 0 for r in rows)
