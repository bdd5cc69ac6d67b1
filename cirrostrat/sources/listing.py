"""File tables: paths with the times in their names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.functions.filetime import file_time

IMAGE_PATTERNS = ("*.nc", "*.nc4", "*.nc.gz", "*.nc4.gz")


def list_files(spark: SparkSession, root: str, patterns: Sequence[str] = IMAGE_PATTERNS) -> DataFrame:
    """(path) of the files below ``root``; only names are read, not contents."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    parts = [read.option("pathGlobFilter", p).load(root).select("path") for p in patterns]
    return reduce(DataFrame.unionByName, parts).distinct()


def timed(files: DataFrame) -> DataFrame:
    """(path, ts) of the files that have a time in their name."""
    return files.select("path", file_time(F.col("path")).alias("ts")).where("ts is not null")


def in_period(df: DataFrame, start: str | Column, end: str | Column, ts: str = "ts") -> DataFrame:
    """Rows of a period, both ends included."""
    lo, hi = (F.lit(v).cast("timestamp") if isinstance(v, str) else v for v in (start, end))
    return df.where(F.col(ts).between(lo, hi))


def period_files(spark: SparkSession, root: str, start: str, end: str, patterns: Sequence[str] = IMAGE_PATTERNS) -> DataFrame:
    """(path, ts) of a period in the order of time."""
    return in_period(timed(list_files(spark, root, patterns)), start, end).orderBy("ts", "path")


def at_exact_time(files: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, path): for each wanted time the first file by path of exactly that time, or null."""
    first = files.groupBy("ts").agg(F.min("path").alias("path"))
    return times.select("ts").join(first, "ts", "left")
