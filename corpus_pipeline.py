"""Training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` with ``docs`` as its predecessor left them and returns the documents it keeps, with the columns of
``documents``; the last returns packed pieces.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm import decontam, jaccard_tgm, pii_fpe, quality_fm, seqpack
from barlattice.llm.queries import PII_KEY, fit_quality, table, tokenizer
from barlattice.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_FROM = 0.7  # least quality score of a document that stays


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least ``KEEP_FROM`` by the factorisation machine fitted on the labelled rows.

    Null and empty texts are scored like others; repeated rows share their fate; long texts are read whole; no documents give none.
    """
    scored = quality_fm.score(docs.select(*COLUMNS), fit_quality(spark, sf_dir), out="_score")
    return scored.filter(F.col("_score") >= KEEP_FROM).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8, the one of smallest doc_id.

    Of rows that share the smallest id, one stays for each different text; rows without an id can't be told apart by links and stay, one for each text.
    """
    found = jaccard_tgm.near_duplicates(docs.select("doc_id", "text"), n=5, num=80)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.select(*COLUMNS).filter(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside a ten-word window of a benchmark item.

    Null and empty texts have no words and stay; rows of one id go together if any of them is hit; a null id is one id; no documents give none.
    """
    numbered = docs.select(*COLUMNS)
    hit = decontam.scan(numbered, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")
    return numbered.join(hit, numbered["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, validated personal values replaced by keyed pseudonyms of the same format; null and empty texts stay, equal rows stay equal."""
    return pii_fpe.pseudonymise(docs.select(*COLUMNS), PII_KEY, counts="_pii").select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cost-balanced packing of all documents that are left; one row per piece, a null or empty text its end id alone, repeated rows each their own pieces."""
    return seqpack.pack(docs, tokenizer(), cache_entries=100_000)  # workers of all stages stay, with their caches


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("sequence_packing", sequence_packing),
]
#: Two stages (the fitted classifier, the tokenizer) have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a run has its own folder beside the checkpoints."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
