"""A corpus pipeline: each stage takes what the one before it kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal data, best-fit packing. All
but the last return the columns of `documents`. Each stage's output is written to the cluster's shared
folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masonry.llm import decontaminate, packing, personal, quality, similar
from masonry.llm.common import as_text, free_name, materialise, table

#: Near duplicates of the stage: shingles of five words, from a similarity of 0.80 on.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: Model fitting, graph components and best-fit search are beyond SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the labels outside the held-out fold, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least doc_id; rows with a null doc_id stay."""
    found = similar.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT)
    others = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").hint("shuffle_hash")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the new text."""
    text, spans = as_text(F.col("text").cast("string")), free_name("spans", docs.columns)
    spotted = materialise(docs.withColumn(spans, personal.candidates(text)), "spotted")
    weights = personal.fit(spotted.select(F.col(spans).alias("found")))
    clean = spotted.withColumn(spans, personal.decided(F.col(spans), weights))
    clean = clean.withColumn("text", F.when(F.size(spans) == 0, F.col("text")).otherwise(personal.masked(text, F.col(spans))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clean.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or piece of a long one, in the training sequences."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("personal data", without_personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
