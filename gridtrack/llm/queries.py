"""Queries of the text operators over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, collocations, decontam, jaccard, langid, licences, mixing, quality, repeats, secrets, simhash, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; see :func:`simhash.near_duplicates`."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, bits=3)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in each document; see :func:`decontam.judged`."""
    return decontam.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document; see :func:`secrets.scanned`."""
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the licences of the rules that fit, of each document; see :func:`licences.scanned`."""
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated chunks in each document; see :func:`chunks.deduplicated`."""
    return chunks.deduplicated(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document; see :func:`mixing.mixed`."""
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeated strings cover; see :func:`repeats.counted`."""
    return repeats.counted(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; see :func:`langid.identified`."""
    return langid.identified(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of each document and its host's verdict; see :func:`quality.judged`."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document; see :func:`toxicity.judged`."""
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lang's phrases of 2 to 5 words that occur 100 times or more, the first 2000 by score; see :func:`collocations.collocations`."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under a similarity of 85 % of 4-word shingle sets; see :func:`jaccard.joined`."""
    return jaccard.joined(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations, a row for each node; see :func:`trie.trie`."""
    return trie.trie(_table(spark, sf_dir, "conversations")).drop("preorder", "preorder_end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_chunks, op3_mixing, op4_repeats, op5_langid, op6_quality, op7_decontam, op8_secrets, op9_licences, op10_toxicity, op11_collocations, op12_jaccard, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality": quality.oracle(), "op9_licences": licences.oracle(), "op11_collocations": collocations.oracle(), "op12_jaccard": jaccard.oracle(), "op13_trie": trie.oracle()}
