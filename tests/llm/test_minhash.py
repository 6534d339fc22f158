import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import minhash
from .conftest import prose


def brute(texts, size=2, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    label = {i: i for i in texts}
    edges = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: (len(sets[i]), label[i], label[i] == i) for i in texts}


def got(frame):
    rows = minhash.near_duplicates(frame).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def test_like_brute_force(docs, texts):
    clashing = docs.withColumn("n", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("KEPT", F.lit(2)).withColumn("bits", F.lit(3))
    assert got(clashing) == brute({3 * i: t for i, t in enumerate(texts)})


@pytest.mark.parametrize("block", [4, 2048])
def test_chains_passages_and_groups(spark, monkeypatch, block):
    """Chains of near copies whose ends don't link, many texts with one passage, and sizes at the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    passage, texts = prose(rng, 60), {}
    for g in range(4):
        words = prose(rng, 120).split()
        for k in range(9):
            texts[len(texts)] = " ".join(words)
            for _ in range(4):
                words[rng.randrange(120)] = f"new{g}{k}{rng.random()}"
    for _ in range(30):
        texts[len(texts)] = passage + " " + prose(rng, rng.randint(10, 40))
    words = prose(rng, 92).split()
    for cut in (92, 83, 74, 66, 59, 58):
        texts[len(texts)] = " ".join(words[:cut])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert got(frame) == want and len({c for _, c, _ in want.values()}) > 6


def test_pairs_left_to_the_blocks(spark, monkeypatch):
    """Buckets whose least document links with none: the rest is compared in blocks."""
    monkeypatch.setattr(minhash, "ROWS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(5)
    passage, texts = prose(rng, 30), {0: prose(rng, 30)}
    texts[0] = passage + " " + texts[0]
    for _ in range(8):
        words = (passage + " " + prose(rng, 30)).split()
        for _ in range(3):
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(60)] = prose(rng, 1)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert got(frame) == brute(texts)


def test_groups_below_the_threshold_give_no_rows_for_pairs(spark, monkeypatch):
    """Many members that are pairwise just below the threshold, a few linked: blocks give links that unite, not pairs."""
    rng = random.Random(22)
    base, texts = prose(rng, 150).split(), {}
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(150), 6):
            words[at] = f"own{k}x{at}"
        texts[k] = " ".join(words)
    for k in range(5):
        texts[200 + k] = texts[7 * k] + f" end{k}"
    rows, links = [], minhash._united
    monkeypatch.setattr(minhash, "_united", lambda labels, edges: (rows.append(edges.count()), links(labels, edges))[1])
    candidates, write = [], minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name: (out := write(df, name), name == "candidates" and candidates.append(out.count()))[0])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert got(frame) == want and len({c for _, c, _ in want.values()}) > 20
    assert max(candidates) <= 15 * len(texts) and max(rows) <= 15 * len(texts)  # of 11,935 pairs


def test_confirmed_links_like_brute_force():
    """Strips of a few members or all in one: the components of the links are those of all pairs."""
    rng = np.random.default_rng(6)
    base = np.arange(60)
    members = [np.unique(np.concatenate((rng.choice(base, 54, replace=False), rng.integers(1000, 9000, 2)))) for _ in range(40)] + [np.zeros(0, np.int64)] * 2
    size = np.array([len(m) for m in members])
    sets = lambda some: (np.concatenate([members[k] for k in some]).astype(np.uint64), np.append(0, np.cumsum(size[some])))
    pairs = [(x, np.arange(x + 1, 42)) for x in range(41)]
    linked = [(x, y) for x, ys in pairs for y in ys if (s := len(np.intersect1d(members[x], members[y]))) and 100 * s >= 80 * (size[x] + size[y] - s)]
    want = np.arange(42)
    for _ in range(42):
        for x, y in linked:
            want[want == max(want[x], want[y])] = min(want[x], want[y])
    for strip in (100, 1_000_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash, "STRIP", strip)
            label = np.arange(42)
            found = list(minhash.confirmed(pairs, sets, size, label, 80))
        assert len(found) == 42 - len(set(want.tolist())) and set(found) <= set(linked)
        assert all((label[x] == label[y]) == (want[x] == want[y]) for x in range(42) for y in range(42))


def test_empty(empty):
    assert got(empty) == {}


def test_repeated_and_null_ids(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, a), (5, b), (9, a + " end"), (3, b + " end"), (7, c), (None, a), (None, "other words here"), (None, None), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()), key=str)
    n = {t: brute({0: t})[0][0] for _, t in rows}
    label = {5: 3, 9: 3, 3: 3, 7: 7, 8: 8}
    want = [(d or 0, n[t], label[d] if d else 3 if t == a else None, d == label[d] if d else t != a) for d, t in rows]
    assert out == sorted(want, key=str)


def test_posterior_bounds():
    """The least matches are where the posterior probability, integrated numerically, passes the miss probability."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in minhash.least_matches(80, 1e-6):
        tail = []
        for k in (m - 1, m):
            density = k * np.log(x) + (n - k) * np.log1p(-x)
            density = np.exp(density - density.max())
            tail.append(density[x >= 0.8].sum() / density.sum())
        assert tail[0] < 1e-6 <= tail[1] * 1.001


def test_few_linked_pairs_are_pruned():
    """Signatures of pairs at the threshold nearly all survive, those at half of it hardly ever."""
    rng, least = np.random.default_rng(2), minhash.least_matches()
    left = rng.integers(0, 1 << 16, (20_000, minhash.CHECKS)).astype(np.uint16)
    for share, low, high in ((0.8, 0.9999, 1), (0.4, 0, 0.02)):
        right = np.where(rng.random(left.shape) < share, left, left + np.uint16(1))
        assert low <= len(minhash.surviving(left, right, least)[0]) / len(left) <= high


def test_minimum_hashes_estimate_similarity():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    one, two = np.sort(keys[:1000]), np.sort(keys[500:])
    low = minhash.minimum_hashes(np.concatenate((one, two)), np.array([0, 1000]))
    assert abs((low[0] == low[1]).mean() - 1 / 3) < 0.08


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = minhash.op12_minhash_near_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute({3 * i: t for i, t in enumerate(texts)})
