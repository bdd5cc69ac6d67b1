"""Timestamps in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The base name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)(?:\.[^/]*)?$", 1)


def _first_that_parses(text: Column, digits: int, pattern: str) -> Column:
    # look-ahead, so that windows at every offset are tried
    windows = F.regexp_extract_all(text, F.lit(rf"(?=(\d{{{digits}}}))"), F.lit(1))
    times = F.filter(F.transform(windows, lambda w: F.try_to_timestamp(w, F.lit(pattern))), lambda t: t.isNotNull())
    return F.try_element_at(times, F.lit(1))


def file_time(path: Column) -> Column:
    """The time in a file's name, null if there is none.

    In this order: a trailing ``YYYYMMDD_HHMM``; the first fourteen digits that read as a time; the
    first twelve; an ISO time with dashes; the first twelve digits once every T is deleted.
    """
    name = stem(path)
    tail = F.nullif(F.regexp_extract(name, r"(\d{8}_\d{4})$", 1), F.lit(""))
    iso = F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(tail, F.lit("yyyyMMdd_HHmm")),
        _first_that_parses(name, 14, "yyyyMMddHHmmss"),
        _first_that_parses(name, 12, "yyyyMMddHHmm"),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH-mm-ss")),
        _first_that_parses(F.replace(name, F.lit("T"), F.lit("")), 12, "yyyyMMddHHmm"),
    )
