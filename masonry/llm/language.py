"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language give a matrix of log probabilities with a bounded number of
rows; it is broadcast. Whole texts are scored in batches: the n-grams of a batch are counted to a sparse
matrix (text, row, count), and each text's sum of count times log probabilities is its score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fold, small_batches, table, text_view

#: Rows of the matrix, longest n-gram, additive smoothing.
BUCKETS, LONGEST, SMOOTHING = 1 << 16, 3, 0.5
#: Documents that counts are learned from (chosen by a hash of doc_id), shared evenly by the languages, and the least share of a language.
TRAIN_DOCS, LEAST_DOCS = 20_000, 50
#: Languages whose columns are gathered at a time, and bytes of a text that are counted at a time.
COLUMNS, PIECE = 16, 1 << 20
HELD_OUT = (4, 2)


@cache
def _folds() -> np.ndarray:
    """For each code point its lower case if it is a letter or mark, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, matrix row) of each n-gram, n = 1..LONGEST, that lies in one text. Runs of anything but letters and marks count as blanks; case is folded.

    Of those within the first `lead` code points none is given: they were given with the piece before.
    """
    points = _folds()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    size = np.diff(at)
    key = np.zeros(len(points), np.uint32)
    texts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    owner = np.repeat(np.arange(len(size)), size)
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        key[:m] = (key[:m] + points[n - 1 :]) * np.uint32(0x9E3779B1) ^ (key[:m] >> np.uint32(15))
        row = (((key[:m] ^ (key[:m] >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) % BUCKETS
        inside = owner[:m] == owner[n - 1 :]
        inside[: max(0, lead - n + 1)] = False
        texts.append(owner[:m][inside])
        rows.append(row[inside])
    return np.concatenate(texts), np.concatenate(rows)


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, bytes, offsets, code points known) of blocks of texts; a long text comes in several, each with the last LONGEST - 1 code points of the one before."""
    most = max(most, 8 * LONGEST)
    for i, j in blocks(offsets, most):
        start, end, lead = int(offsets[i]), int(offsets[j]), 0
        if end - start <= most:
            yield i, data[start:end], offsets[i : j + 1] - start, 0
            continue
        while start < end:
            stop = min(end, start + most)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop += 1
            yield i, data[start:stop], np.array([0, stop - start]), lead
            if stop == end:
                break
            start, lead = stop, LONGEST - 1
            for _ in range(lead):
                start -= 1
                while data[start] & 0xC0 == 0x80:
                    start -= 1


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece the sparse counts (text, row, count), in order of text."""
    for i, part, own, lead in pieces(data, offsets):
        text, row = ngrams(part, own, lead)
        seen = np.sort((text.astype(np.uint32) << np.uint32(16)) | row.astype(np.uint32))
        head = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])) if len(seen) else np.zeros(0, np.int64)
        yield i + (seen[head] >> np.uint32(16)).astype(np.int64), (seen[head] & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.append(head, len(seen)))


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) from rows of text, lang.

    The matrix has 256 KB for each language (512 KB while it is made on the driver), which bounds their number.
    """
    names = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for text, row, count in counted(data, offsets):
                seen, back = np.unique(langs[text] * BUCKETS + row, return_inverse=True)
                lang, bucket = np.divmod(seen, BUCKETS)
                n = np.bincount(back, count, len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "bucket", "n"])

    total = labelled.select("text", "lang").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    counts[total["bucket"].to_numpy(int), total["lang"].to_numpy(int)] = total["n"].to_numpy(float)
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)) if names else counts
    return names, logs.astype(np.float32)


def identify(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row: the likeliest language under equal priors and its posterior.

    A text that is null or has no letter, and any text if nothing was learned, is `und` with score 0; of languages
    that are equally likely the first by name is given. Rows that repeat a doc_id are judged each by itself, and
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, matrix = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            sums = np.zeros((batch.num_rows, len(names)))
            for text, row, count in counted(data, offsets) if names else ():
                heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
                for c in range(0, len(names), COLUMNS) if len(heads) else ():
                    sums[text[heads], c : c + COLUMNS] += np.add.reduceat(matrix[:, c : c + COLUMNS][row] * count[:, None], heads, axis=0, dtype=np.float64)
            known = np.array([bool(names) and x is not None and letter.search(x) is not None for x in batch.column(1).to_pylist()], bool)
            if names:
                best = sums.argmax(1)
                score = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            pred = [names[best[i]] if known[i] else "und" for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score if names else 0.0, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """text, lang of documents outside the held-out fold, chosen by a hash of doc_id.

    Each language gives at most about its even share of `most`, LEAST_DOCS if that is less, and all it has
    if it has no more; so none is lost because others are common.
    """
    usable = docs.filter((fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    each = F.broadcast(counts.join(F.broadcast(counts.agg(F.greatest(F.lit(LEAST_DOCS), F.floor(F.lit(most) / F.count(F.lit(1)))).alias("_each")))))
    chosen = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 40)) < (1 << 40) * F.col("_each") / F.col("_n")
    return usable.join(each, "lang").filter(chosen).select("text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`; see training_rows and identify."""
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    found = identify(docs, *learn(training_rows(docs)))
    return found.select("doc_id", (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score")
