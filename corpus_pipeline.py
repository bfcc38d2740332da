"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes the documents that its predecessor kept, written as Parquet and read again. The
first four return the columns of `documents`; the last one returns token counts and digests.
Rows without a doc_id are judged by their text in the first stage and pass the second and third,
which name what they drop by id; their secrets are masked like any other's. Rows that repeat a doc_id share its fate.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import bpe, decontamination, jaccard_join, quality_knn, secrets_crf
from opinara.llm.queries import tokenizer_path
from opinara.session import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = quality_knn.labelled_sample(docs, labels, "quality", quality_knn.LABELLED, 4, 2)
    return quality_knn.kept(docs, quality_knn.fit(sample))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id.

    Rows without an id cannot name a group and stay. Texts link from a similarity of 0.8 on five-word shingles; op9 has its own rule.
    """
    group = jaccard_join.jaccard_components(docs, k=5, percent=80)
    first = group.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi")
    return named.unionByName(docs.filter("doc_id IS NULL").select(named.columns)).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    out = secrets_crf.mask(docs, secrets_crf.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return bpe.encode_digest(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", secrets_masked),
    ("bpe", token_ids),
]

# Classifier, alignment, field and tokenizer cannot be said in SQL; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each result written to the shared folder."""
    root = str(Path(__file__).resolve().parent)
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
