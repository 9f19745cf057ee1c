"""One registered query per operator, each over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipweave.llm import (
    alignment,
    attribution,
    cross_polytope,
    extraction,
    impact,
    language,
    minhash,
    mixing,
    packing,
    quality,
    repair,
    shards,
    sql,
    winnowing,
)
from clipweave.llm.common import load


def op1_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.exact_top_k(load(spark, sf_dir, "embeddings"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.hilbert_shards(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "documents"))


def op4_dom_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(load(spark, sf_dir, "pages"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(load(spark, sf_dir, "documents"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(load(spark, sf_dir, "embeddings"))


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(load(spark, sf_dir, "documents"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), words=2)


def op11_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(load(spark, sf_dir, "conversations")))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, _ = winnowing.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return winnowing.digest(counted)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_impact_top_k,
        op2_hilbert_shards,
        op3_language_id,
        op4_dom_tree_text,
        op5_poisson_mix,
        op6_cross_polytope,
        op7_residual_packing,
        op8_cotrained_quality,
        op9_section_tokens,
        op10_hyperminhash,
        op11_branch_and_bound,
        op12_winnowing,
        op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {**sql.ORACLES}
