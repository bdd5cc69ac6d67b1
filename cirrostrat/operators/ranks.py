"""Exact percentiles of large groups by selecting ranks over radix histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.runtime import discard, materialize

#: Parts into which the range of values that still holds a rank is cut each time.
PARTS = 4096


def percentile_by_rank(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, ``name``): the percentile ``q`` (0 to 1) of each group, interpolated between the two ranks beside it, exact for any number of values.

    Values are first counted, each once a group, by partial aggregates whose shuffle deals a group's values over all tasks. A group's rank then narrows its range:
    a histogram of up to ``PARTS`` equal parts names the part that holds the rank, and only values there are counted again, until
    parts hold one value. Histograms of all groups go side by side; a group keeps one row a part in any task. Nulls and NaN
    take no part; groups without a value have no row. Keys must not be null.
    """
    v = F.col(value).cast("double")
    counts = materialize(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c")), "value-counts")
    whole = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = (F.col("n") - 1) * F.lit(float(q))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("rank")))
    ranked = whole.withColumn("part", (at - F.floor(at)).alias("part")).select(*keys, "part", "lo", "hi", F.explode(ends).alias("e"))
    open_ = materialize(ranked.select(*keys, "part", F.col("e.end").alias("end"), F.col("e.rank").alias("rank"), "lo", "hi"), "ranks")
    found: DataFrame | None = None
    while True:
        done = open_.where("lo = hi").select(*keys, "part", "end", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        left = open_.where("lo < hi")
        if left.isEmpty():
            break
        bins = counts.join(left, list(keys)).where("v between lo and hi")
        x, lo, hi, far = F.col("v"), F.col("lo"), F.col("hi"), F.lit(float("inf"))
        width = (hi - lo) / PARTS
        # ranges without a width in doubles, or with infinite ends, are cut in two
        bin_ = F.when(width == 0, (x > lo).cast("long")).when(hi == far, (x == far).cast("long")).when(lo == -far, (x > lo).cast("long"))
        bin_ = bin_.when(width == far, (x > lo / 2 + hi / 2).cast("long")).otherwise(F.least(F.floor((x - lo) / width), F.lit(PARTS - 1)))
        hist = bins.groupBy(*keys, "end", bin_.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"), F.first("part").alias("part"))
        before = F.sum("c").over(Window.partitionBy(*keys, "end").orderBy("bin")) - F.col("c")
        hist = hist.withColumn("rank", F.col("rank") - before).where("rank >= 0 and rank < c")
        open_ = materialize(hist.select(*keys, "part", "end", "rank", "lo", "hi"), "ranks")
    ends_of = found.groupBy(*keys).agg(F.max("part").alias("part"), F.max(F.when(F.col("end") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("v"))).alias("b"))
    out = materialize(ends_of.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(name)), "percentiles")
    discard(counts, open_)
    return out
