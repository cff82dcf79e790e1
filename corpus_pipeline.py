"""The corpus pipeline: documents in, a mixed training set out, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import read
from touchline.llm.decontamination import without_contaminated
from touchline.llm.jaccard import one_of_each
from touchline.llm.mixing import documents_taken
from touchline.llm.surrogates import pseudonymised
from touchline.llm.toxicity import without_toxic
from touchline.session import new_run_dir


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars, if there is one, follows the text."""
    done = pseudonymised(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(done.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed)
    return done.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size in words and the words taken.

    The two columns are named size and taken, with underscores behind them where documents have such columns.
    """
    return documents_taken(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("source_mix", source_mix),
]

#: The toxicity model and keyed surrogates are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    run_dir = new_run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{run_dir}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
