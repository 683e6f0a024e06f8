"""From raw documents to a training mixture: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.llm import decontam, langid, mixing, secrets, simhash
from gridtrack.llm.common import fresh, scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter (null and empty texts too) and the ambiguous ones go.

    Rows with null ids are judged like others and repeated rows stay repeated; an empty table stays
    empty.  Where nothing is labelled nothing can be learned, and no document is kept.
    """
    own = tuple(fresh(docs, "lang_pred", "score", "ambiguous"))
    found = langid.predicted(docs, langid.fit(docs), names=own)
    return found.where((F.col(own[0]) != "und") & ~F.col(own[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, a null one only in a group without others.  Null and texts without words are
    alike; of repeated rows one stays.
    """
    return simhash.deduplicated(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; a null text holds none, an empty benchmark keeps all."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null texts stay null, repeated rows repeated."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens): what the mixture takes of each document.

    A null or empty text has no tokens and is never taken; null lang or source is a leaf named ``?``.
    """
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("mixture", mixture),
]

#: No stage but the mixture has a SQL form; tests/llm/test_pipeline.py compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; intermediate tables lie in the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
