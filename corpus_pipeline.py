"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before has
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm import language, minhash, mixing, packing, quality
from clipweave.llm.common import keep, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express the trained models or the packing; tests/llm compares stages with brute force.
ORACLE_SQL = None


def _with(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` whose id is in ``decided (doc_id)``; a null id or text has no decision and goes."""
    return docs.join(decided.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    verdicts = quality.classify(docs, load(spark, sf_dir, "labels"))
    return _with(docs, verdicts.where("accepted"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in their text; the predicted language fills a missing ``lang`` and rejects nothing."""
    found = language.identify(docs).where(F.col("lang_pred") != language.UNKNOWN)
    named = found.groupBy("doc_id").agg(F.min("lang_pred").alias("_pred"))
    filled = docs.join(named, "doc_id").withColumn("lang", F.coalesce("lang", "_pred"))
    return filled.select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets overlap by 0.8 or more."""
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    return _with(docs, groups.where("kept")).dropDuplicates(["doc_id"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the Poisson law of their source says, in random order."""
    return mixing.poisson_mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
