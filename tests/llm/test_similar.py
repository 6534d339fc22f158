import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import similar
from .conftest import prose


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in texts}
    edges = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in texts:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: (len(sets[i]), label[i]) for i in texts}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in similar.jaccard_components(frame).collect()}


def test_like_brute_force(docs, texts):
    assert got(docs.withColumn("n", F.lit("clash")).withColumn("label", F.lit(1))) == brute({3 * i: t for i, t in enumerate(texts)})


@pytest.mark.parametrize("block", [4, 2048])
def test_chains_passages_and_groups(spark, monkeypatch, block):
    """Chains of near copies whose ends don't link, many texts with one passage, and sizes at the threshold."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(block)
    passage, texts = prose(rng, 60), {}
    for g in range(4):
        words = prose(rng, 120).split()
        for k in range(7):
            texts[len(texts)] = " ".join(words)
            for _ in range(2):
                words[rng.randrange(120)] = f"new{g}{k}{rng.random()}"
    for _ in range(8):
        texts[len(texts)] = passage + " " + prose(rng, 25)
    words = prose(rng, 92).split()
    for cut in (92, 83, 82, 74):
        texts[len(texts)] = " ".join(words[:cut])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert got(frame) == brute(texts)


def test_empty(empty):
    assert got(empty) == {}


def test_cells_hold_every_near_pair():
    """Recursion over Voronoi cells leaves out no pair within the radius, and spares most others where there are groups."""
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 2**64, (30, 8), dtype=np.uint64)
    bits = np.concatenate([np.repeat(groups, 20, 0), rng.integers(0, 2**64, (100, 8), dtype=np.uint64)])
    for k in range(600):
        for _ in range(rng.integers(0, 12)):
            bits[k, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64)
    for split, within in ((700, True), (350, False)):
        want = {(a, b) for a, b in np.argwhere(far <= 16).tolist() if a < b and (within or a < split <= b)}
        got, tested = set(), 0
        for inner, outer in similar.near_in_cells(bits, np.arange(split), np.arange(split, 700), 16, within):
            for k, x in enumerate(inner.tolist()):
                others = np.concatenate((inner[k + 1 :], outer)) if within else outer
                tested += len(others)
                got |= {(min(x, y), max(x, y)) for y in others.tolist()}
        assert want <= got and tested < 0.5 * (700 * 699 / 2 if within else 350 * 350)


def test_many_clusters_with_one_passage(spark, monkeypatch):
    """A region of many members in many components."""
    monkeypatch.setattr(similar, "BLOCK", 100)
    monkeypatch.setattr(similar, "COMMON", 0.5)
    rng = random.Random(12)
    passage, texts = prose(rng, 40), {}
    for _ in range(45):
        words = prose(rng, 70).split()
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(70)] = prose(rng, 1)
            texts[len(texts)] = passage + " " + " ".join(changed)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert got(frame) == brute(texts)


def test_repeated_and_null_ids(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, a), (5, b), (9, a + " end"), (3, b + " end"), (7, c), (None, a), (None, "other words here"), (None, None), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in similar.jaccard_components(frame).collect()), key=str)
    n = {t: brute({0: t})[0][0] for _, t in rows}
    label = {5: 3, 9: 3, 3: 3, 7: 7, 8: 8}
    assert out == sorted(((d or 0, n[t], label[d] if d else 3 if t == a else None) for d, t in rows), key=str)


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = similar.op6_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute({3 * i: t for i, t in enumerate(texts)})
