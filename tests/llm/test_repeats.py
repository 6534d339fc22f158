import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import repeats
from .conftest import prose


def brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = True
        seen.update(own)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def got(frame, **sizes):
    return {r.doc_id: tuple(r)[1:5] for r in repeats.remove_repeats(frame, **sizes).collect()}


def test_like_brute_force(docs, texts):
    want = brute({3 * i: t for i, t in enumerate(texts)})
    given = docs.withColumn("keys", F.lit("clash")).withColumn("hash", F.lit("clash"))
    assert got(given) == want
    assert got(given, hash_bucket=20_000, text_bucket=5_000) == want


def test_periodic_bytes_and_order_of_ids(spark):
    rng = random.Random(5)
    passage = prose(rng, 30)
    texts = {9: "ab" * 300, 2: "ba" * 40 + passage, 7: passage[:-1], 4: "\x00" * 120, 5: "\x00" * 60 + "é" * 80, 1: "é" * 30, 3: passage + passage, 8: "x" + "é" * 27}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(frame) == brute(texts)


def test_empty_and_null_ids(spark, empty):
    assert got(empty) == {}
    rows = repeats.remove_repeats(spark.createDataFrame([(None, "y" * 80), (1, "y" * 80)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in rows] == [0, 0]


def test_boundaries_are_those_of_the_prefixes():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([np.append(rng.integers(1, 4, 200), 0) for _ in range(5)]).astype(np.uint16)
    order = repeats.suffix_order(symbols, 6)
    cut = repeats.boundaries(symbols, order, 6)
    text = bytes(symbols.astype(np.uint8))
    parts = [text[p : p + 6] for p in order]
    for i in range(1, len(parts)):
        if len(parts[i]) == 6 and 0 not in parts[i] and 0 not in parts[i - 1] and len(parts[i - 1]) == 6:
            assert cut[i] == (parts[i] != parts[i - 1])


def test_repeated_ids_and_rows(spark):
    """A row for each input row; those of one id are judged against smaller ids only."""
    a, b, c = ("".join(random.Random(k).choices(letters, k=200)) for k, letters in enumerate(("abcdefgh", "ijklmnop", "qrstuvwx")))
    rows = [(1, a), (5, b + a), (5, a[:90] + c), (7, b), (7, b), (9, c), (5, b + a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect())
    assert got == [(1, 200, 0, 0), (5, 290, 90, 1), (5, 400, 200, 1), (5, 400, 200, 1), (7, 200, 200, 1), (7, 200, 200, 1), (9, 200, 200, 1)]


@pytest.mark.parametrize("taken, most_held", [(1, 1 << 30), (3000, 1), (20_000, 9000)])
def test_passage_with_many_surroundings(spark, taken, most_held):
    """Buckets that are read in parts or hand their windows on give what one look gives."""
    rng = random.Random(8)
    passage = prose(rng, 25)
    texts = {i: prose(rng, rng.randint(1, 9)) + passage[rng.randint(0, 5) :] + prose(rng, rng.randint(1, 9)) for i in range(120)}
    texts |= {200 + i: texts[i * 7] for i in range(9)} | {300: passage * 3, 301: "ab" * 400, 302: "ba" * 300}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert got(frame, text_bucket=4000, taken=taken, most_held=most_held) == brute(texts)


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = repeats.op1_suffix_array_dedup(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == brute({3 * i: t for i, t in enumerate(texts)})


def test_only_open_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(5)
    for symbols in (rng.integers(0, 3, 3000), np.tile(rng.integers(1, 257, 40), 9), np.array([7])):
        order = repeats.suffix_order(symbols.astype(np.uint16), 50)
        padded = np.append(symbols, np.zeros(50, symbols.dtype)).tolist()
        strings = [padded[i : i + 50] for i in order]
        assert sorted(order.tolist()) == list(range(len(symbols))) and strings == sorted(strings)
    sorted_rows, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_rows.append(len(x)) or argsort(x, *a, **k))
    repeats.suffix_order(np.append(rng.integers(1, 257, 9000), np.tile(rng.integers(1, 257, 100), 10)).astype(np.uint16), 50)
    assert sorted_rows[0] == 10000 and sum(sorted_rows) < 14000  # before, all were sorted in every round
