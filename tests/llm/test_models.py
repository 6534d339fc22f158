import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from masonry.llm import language, quality
from .conftest import prose


def test_languages_held_out(spark, docs, empty):
    rng = random.Random(1)
    words = {"en": ["the", "house", "water", "with"], "fr": ["été", "maison", "où", "eau"], "de": ["straße", "über", "haus", "und"]}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i in range(240) for x in [list(words)[i % 3]]]
    frame = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "en"), (902, "12 - !", None), (903, "straße " * 20_000, None)], "doc_id long, text string, lang string")
    names, logs = language.learn(language.training_rows(frame))
    assert names == ["de", "en", "fr"] and logs.shape == (language.BUCKETS, 3)
    found = {r.doc_id: r for r in language.identify(frame, names, logs).collect()}
    assert len(found) == 244 and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == x for i, _, x in rows)
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert language.identify(docs, [], np.zeros((1, 0))).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, names, logs).count() == 0


def test_quality_of_held_out_rows(spark, empty):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(60, 200)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 80).split()) if i % 2 else (prose(rng, 1) + " ") * 90 for i in range(60)]
    texts = [x for i in range(60) for x in (*good[5 * i : 5 * i + 5], bad[i])]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 != 5)) for i in range(360) if i % 4 != 1] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(frame, labels)
    scored = {r.doc_id: r.score for r in quality.score(frame, model, "doc_id").collect()}
    assert len(scored) == 362 and all(0 <= x <= 1 for x in scored.values())
    right = [(scored[i] >= 0.5) == (i % 6 != 5) for i in range(360)]
    assert np.mean(right) > 0.95
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(x >= 0.5 for x in scored.values())
    nothing = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros((0, len(quality.FEATURES))))
    assert quality.score(empty, nothing, "doc_id").count() == 0


def test_prior_without_negative_labels():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (4000, len(quality.FEATURES))), rng.normal(4, 1, (1000, len(quality.FEATURES)))
    model = quality.fit(good[:2000], np.concatenate((good[2000:], bad)))
    assert abs(model.prior - 2 / 3) < 0.12
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def test_rare_languages_are_learned(spark):
    """A common language must not push a rare one out of the bounded sample."""
    rows = [(i, "house water with the " * 3, "en") for i in range(3000)] + [(10_000 + i, "straße über haus und " * 3, "de") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.lang: r["count"] for r in language.training_rows(frame, 100).groupBy("lang").count().collect()}
    usable = {r.lang: r["count"] for r in frame.filter(language.fold("doc_id", language.HELD_OUT[0]) != language.HELD_OUT[1]).groupBy("lang").count().collect()}
    assert kept["de"] == usable["de"] > 0 and 20 <= kept["en"] <= 100
    names, logs = language.learn(language.training_rows(frame, 100))
    found = language.identify(frame, names, logs).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"en": 3000, "de": 8}


def test_more_than_256_languages(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)]
    frame = spark.createDataFrame([(3 * i + k, f"{w} " * 20, f"x{i:03}") for i, w in enumerate(vocabulary) for k in range(3)], "doc_id long, text string, lang string")
    training = language.training_rows(frame)
    names, logs = language.learn(training)
    learned = {r.lang for r in training.select("lang").distinct().collect()}
    assert len(names) == len(learned) > 256 and logs.shape == (language.BUCKETS, len(names))
    found = {r.doc_id: r for r in language.identify(frame, names, logs).collect()}
    assert all(found[3 * int(x[1:])].lang_pred == x for x in learned)


def test_a_few_wrong_positive_labels_do_not_move_one_half_into_the_junk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, len(quality.FEATURES))), rng.normal(4, 1, (1000, len(quality.FEATURES)))
    wrong = rng.normal(4, 1, (20, len(quality.FEATURES)))
    model = quality.fit(np.concatenate((good[:2000], wrong)), np.concatenate((good[2000:], bad)), 2 / 3)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def slow_rows(text):
    """Matrix rows of all n-grams, one by one."""
    fold = lambda c: c.lower() if len(c.lower()) == 1 else c
    points = [ord(fold(c)) if unicodedata.category(c)[0] in "LM" else 32 for c in text]
    out = []
    for i in range(len(points)):
        key = 0
        for n in range(1, min(language.LONGEST, len(points) - i) + 1):
            key = ((key + points[i + n - 1]) * 0x9E3779B1 & 0xFFFFFFFF) ^ (key >> 15)
            out.append((((key ^ (key >> 16)) * 0x85EBCA6B & 0xFFFFFFFF) >> 16) % language.BUCKETS)
    return out


def test_scores_like_brute_force(spark, docs, texts, monkeypatch):
    """Counts, log probabilities and posteriors computed n-gram by n-gram, also where long texts come in pieces."""
    rng = random.Random(9)
    monkeypatch.setattr(language, "PIECE", 1 << 12)
    train = [(i, prose(rng, 30) + x, x) for i in range(12) for x in ["aé", "bß", "c漢"][i % 3 : i % 3 + 1]]
    names, logs = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(2))
    counts = np.zeros((language.BUCKETS, 3))
    for _, t, x in train:
        np.add.at(counts[:, names.index(x)], slow_rows(t), 1)
    want = np.log((counts + language.SMOOTHING) / (counts.sum(0) + language.SMOOTHING * language.BUCKETS))
    assert np.allclose(logs, want, atol=1e-5)
    given = docs.withColumn("lang_pred", F.lit("clash")).unionByName(docs.withColumn("lang_pred", F.lit("again")))
    rows = language.identify(given, names, logs).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        t = texts[r.doc_id // 3]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        sums = logs.astype(float)[slow_rows(t)].sum(0)
        assert r.lang_pred == names[int(sums.argmax())] and abs(r.score - 1 / np.exp(sums - sums.max()).sum()) < 1e-6


def test_pieces_give_each_ngram_once():
    text = "aé漢😀 b" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.bincount(slow_rows(text), minlength=language.BUCKETS)
    for most in (3, 25, 64, 10_000):
        got = np.zeros(language.BUCKETS)
        for _, part, own, lead in language.pieces(data, np.array([0, len(data)]), most):
            np.add.at(got, language.ngrams(part, own, lead)[1], 1)
        assert (got == whole).all()


def test_queries(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * i, int(i % 4 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held_out = lambda n, k: {3 * i for i in range(len(texts)) if zlib.crc32(str(3 * i).encode()) % n == k}
    for rows, fold in ((language.op2_language_id(spark, str(tmp_path)), (4, 2)), (quality.op4_quality_classifier(spark, str(tmp_path)), (3, 1))):
        rows = rows.collect()
        assert sorted(r.doc_id for r in rows) == [3 * i for i in range(len(texts))]
        assert {r.doc_id for r in rows if r.held_out} == held_out(*fold) and all(0 <= r.score <= 1 for r in rows)
