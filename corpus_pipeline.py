"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of ``documents``; the stages that shorten texts also set
``n_chars``. Later stages judge what earlier ones kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm import decontaminate, jaccard_join, mixing, suffix_dedup, toxicity
from cirrostrat.runtime import materialize

#: Bytes of a passage that may stand once only: fewer than fifty words take in the corpus' languages.
PASSAGE_BYTES = 200
#: Rows whose label is held out for evaluation, as in the toxicity query.
FOLDS = 5


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; null and empty texts are judged as texts of no words."""
    learn = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    return toxicity.drop_toxic(docs, learn)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, that of the least doc_id stays."""
    return jaccard_join.keep_one_of_each(docs, size=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_BYTES`` or more stay where they stand first; every document stays."""
    return _sized(suffix_dedup.without_repeats(docs, least=PASSAGE_BYTES, keep_first=True))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with test items go, and whole documents of which they are more than half."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _sized(decontaminate.decontaminate(docs, items, window=10, most=0.5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, its copies counted in ``copy``."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("benchmark passages", drop_benchmark_passages),
    ("mixing", mix),
]

#: SQL can't express the trained stage, nor the draws of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
