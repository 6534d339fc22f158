"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer over binned text statistics by
minimising the non-negative unbiased risk  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])  with
logistic loss l. The class prior pi is estimated as the share of 1 among the labels outside the held-out
fold where both labels occur there; else from the scores of a first positive-against-unlabelled fit, as
the least ratio of tail masses of unlabelled and positive scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, fold, mix, small_batches, span_hashes, table, text_view, words

#: Most trusted positives and most unlabelled texts that the scorer is fitted on.
POSITIVES, UNLABELLED = 20_000, 20_000
HELD_OUT = (3, 1)
#: Quantiles of the unlabelled texts that part the bins: finer in the tails, where rare junk lies.
EDGES = [0.005, 0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.94, 0.96, 0.975, 0.985, 0.993]
BINS, STEPS, RATE, DECAY = len(EDGES), 400, 0.05, 1e-4
#: Share of the trusted positives that may fall below one half if the prior is too low; as many of them may be labelled wrongly.
LOST = 0.02

FEATURES = ["log_words", "word_length", "distinct", "top_word", "upper", "digit", "symbol", "bar", "bang", "punctuation", "line_words", "repeated_lines", "next_same", "symbol_words"]

_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
_KIND[[ord(c) for c in "#*$%&<>"]] = 4
_KIND[ord("|")], _KIND[ord("!")], _KIND[[ord(c) for c in ".,;:?'\"()-_/"]] = 5, 6, 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
    letters = np.maximum(1, kinds[:, 1] + kinds[:, 2])
    starts, ends, first = words(data, offsets)
    count = np.maximum(1, np.diff(first))
    owner = np.repeat(np.arange(n), np.diff(first))
    hashes = span_hashes(LOWER[data], starts, ends)
    own, seen = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[0:2]
    times = np.bincount(seen)
    where = np.zeros(len(own), np.int64)
    where[seen] = owner
    top = np.zeros(n, np.int64)
    np.maximum.at(top, where, times)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    ends_odd = np.isin(_KIND[data[ends - 1]], (4, 5, 6)) if len(ends) else np.zeros(0, bool)
    line_break = np.zeros(256, bool)
    line_break[10] = True
    ls, le, lf = words(data, offsets, line_break)
    lines = np.maximum(1, np.diff(lf))
    line_owner = np.repeat(np.arange(n), np.diff(lf))
    line_keys = mix(span_hashes(data, ls, le) + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(line_keys, return_index=True)
    out[:, 0] = np.log1p(np.diff(first))
    out[:, 1] = np.bincount(owner, (ends - starts).astype(float), n) / count
    out[:, 2] = np.bincount(where, minlength=n) / count
    out[:, 3] = top / count
    out[:, 4] = kinds[:, 2] / letters
    for k, kind in ((5, 3), (6, 4), (7, 5), (8, 6), (9, 7)):
        out[:, k] = kinds[:, kind] / size
    out[:, 10] = np.log1p(np.diff(first) / lines)
    out[:, 11] = 1 - np.bincount(line_owner[at], minlength=n) / lines
    out[:, 12] = np.bincount(owner, same.astype(float), n) / count
    out[:, 13] = np.bincount(owner, ends_odd.astype(float), n) / count
    out[np.diff(first) == 0] = 0
    return out


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and x array<double> of every row of docs (text, keep...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets))])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat], [*keep, "x"])

    chosen = docs.select("text", *keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{fields}, x array<double>")


@dataclass
class Scorer:
    """Bins of each statistic (edges from the training rows) with a weight each, and a bias."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        places = [np.searchsorted(self.edges[k], x[:, k], side="left") + k * (BINS + 1) for k in range(x.shape[1])]
        return np.stack(places, 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.rows(x)].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(model: Scorer, gradient, steps: int = STEPS) -> Scorer:
    """Adam on the full batch; gradient(model) -> (d weights, d bias)."""
    m, v = np.zeros(len(model.weights) + 1), np.zeros(len(model.weights) + 1)
    theta = np.append(model.weights, model.bias)
    for t in range(1, steps + 1):
        model.weights, model.bias = theta[:-1], theta[-1]
        dw, db = gradient(model)
        g = np.append(dw + DECAY * model.weights, db)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = theta[:-1], float(theta[-1])
    return model


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Scorer:
    """The scorer for two feature matrices. Without positives or unlabelled rows every score is one half."""
    edges = np.quantile(unlabelled, EDGES, axis=0).T if len(unlabelled) else np.zeros((len(FEATURES), BINS))
    size = len(FEATURES) * (BINS + 1)
    model = Scorer(edges, np.zeros(size), 0.0, 0.5)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.rows(positive), model.rows(unlabelled)

    def back(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float]:
        d = d / len(rows)
        return np.bincount(rows.ravel(), np.repeat(d, rows.shape[1]), size), float(d.sum())

    def plain(m: Scorer):
        gp, gu = m.weights[p[::2]].sum(1) + m.bias, m.weights[u[::2]].sum(1) + m.bias
        a, b = back(p[::2], -_sigmoid(-gp)), back(u[::2], _sigmoid(gu))
        return a[0] + b[0], a[1] + b[1]

    if prior is None:
        first = _descend(Scorer(edges, np.zeros(size), 0.0, 0.5), plain, STEPS // 2)
        # on the rows that it was not fitted on
        sp, su = np.sort(first.margin(positive[1::2])), np.sort(first.margin(unlabelled[1::2]))
        at = np.quantile(sp, np.linspace(0.0, 0.7, 71)) if len(sp) else np.zeros(0)
        tail = lambda s: 1 - np.searchsorted(s, at) / len(s)
        prior = (tail(su) / tail(sp)).min() if len(sp) and len(su) else 0.5
    prior = float(np.clip(prior, 0.02, 0.98))
    model.prior = prior

    def risk(m: Scorer):
        gp, gu = m.weights[p].sum(1) + m.bias, m.weights[u].sum(1) + m.bias
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, un = back(p, -prior * _sigmoid(-gp)), back(u, _sigmoid(gu))
        off = back(p, -prior * _sigmoid(gp))
        if negative < 0:  # the non-negative correction: undo the overfitted part only
            return -(un[0] + off[0]), -(un[1] + off[1])
        return up[0] + un[0] + off[0], up[1] + un[1] + off[1]

    model = _descend(model, risk)
    # one half is put where the share of unlabelled texts above it equals the prior; a prior that would cost more than LOST of the positives is not followed
    mu, mp = np.sort(model.margin(unlabelled)), np.sort(model.margin(positive))
    cut = min(np.quantile(mu, 1 - prior), np.quantile(mp, LOST))
    below = mu[mu < cut - 1e-9]
    model.bias -= float(cut + (below[-1] if len(below) else cut - 1)) / 2
    return model


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Fit on at most about `positives` trusted rows and `unlabelled` texts, both chosen by a hash of doc_id.

    A document is a trusted positive if all its labels outside the held-out fold are 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pick = lambda seed, n, most: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))
    marks = labels.filter((fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted = marks.filter("q = 1").select("doc_id")
    seen = marks.agg(F.count("q").alias("n"), F.sum("q").alias("p")).first()
    n_p, n_u = seen.p or 0, docs.count()
    prior = n_p / seen.n if 0 < n_p < seen.n else None
    # at most about `positives` ids, so small enough to broadcast
    ids = F.broadcast(trusted.filter(pick(3, n_p, positives)).withColumn("_p", F.lit(1)))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").withColumn("_u", pick(4, n_u, unlabelled).cast("int"))
    rows = feature_rows(marked.filter("_p = 1 or _u = 1"), "_p", "_u").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # sums must not depend on the order of arrival
    x, p, u = x[order], rows["_p"].eq(1).to_numpy(bool)[order], rows["_u"].eq(1).to_numpy(bool)[order]
    return fit(x[p], x[u], prior)


def score(docs: DataFrame, model: Scorer, *keep: str) -> DataFrame:
    """`keep` columns and score (0 to 1) of every row; null and empty texts are scored as texts without words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.score(x))], [*keep, "score"])

    chosen = docs.select(F.col("text").alias("_scored"), *keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{fields}, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`, repeated ones too; see train.

    Null and empty texts are scored like others, from counts of zero. Equal texts have equal scores, and 0.5 counts as 1. A null
    doc_id trains nothing and has a null held_out.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores `least` or more; no shuffle."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(at))
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets))])
            yield batch.filter(pa.array(shared.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
