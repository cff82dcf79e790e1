"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import (
    bitsliced,
    chat,
    covertree,
    decontamination,
    jaccard,
    lattice,
    mixing,
    repeats,
    resampling,
    rollups,
    spelling,
    surrogates,
    toxicity,
)
from touchline.llm.common import find_package
from touchline.llm.common import read as table
from touchline.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    find_package(spark)
    return table(spark, sf, name)


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.drop("spans")


def op2_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.scores(read(spark, sf, "documents"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf, "documents"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(read(spark, sf, "documents"))


def op6_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.digests(chat.formatted_turns(chat.with_hostile(read(spark, sf, "conversations"))))


def op7_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.surrogate_documents(read(spark, sf, "documents"))


def op8_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resampled(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op9_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    return covertree.top_k(read(spark, sf, "embeddings"))


def op10_rollups(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.maintained(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op11_bitsliced(spark: SparkSession, sf: str) -> DataFrame:
    return bitsliced.ranked(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op12_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digests(read(spark, sf, "documents"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(read(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    find_package(spark)
    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_lattice": op2_lattice,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_surrogates": op7_surrogates,
    "op8_resampling": op8_resampling,
    "op9_cover_tree": op9_cover_tree,
    "op10_rollups": op10_rollups,
    "op11_bitsliced": op11_bitsliced,
    "op12_suffixes": op12_suffixes,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}
