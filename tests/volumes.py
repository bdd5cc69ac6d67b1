"""A volume of moving cold blobs."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gaussian blobs: t0, y0, x0, vy, vx, amplitude, st, sr.
BLOBS = (
    (6, 8, 8, 0.4, 0.3, 95, 4, 12), (10, 20, 12, -0.3, 0.2, 88, 5, 20), (16, 14, 22, 0.2, -0.5, 102, 3, 9),
    (20, 24, 24, 0, 0, 70, 3, 14), (8, 25, 5, 0.5, 0.5, 60, 2, 6), (14, 5, 25, -0.4, 0.1, 92, 6, 16),
)


def blob_voxels(spark: SparkSession, slots: int = 24, side: int = 30) -> DataFrame:
    """(t, y, x, bt) of moving cold blobs on a warm ground."""
    n = side * side
    v = spark.range(slots * n).select((F.col("id") / n).cast("int").alias("t"), (F.col("id") % n / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))

    def depth(b):
        t0, y0, x0, vy, vx, amp, st, sr = b
        s = F.col("t") - t0
        return amp * F.exp(-F.pow(s / st, F.lit(2)) - (F.pow(F.col("y") - y0 - vy * s, F.lit(2)) + F.pow(F.col("x") - x0 - vx * s, F.lit(2))) / sr)

    return v.withColumn("bt", F.round(F.lit(290) - reduce(lambda a, b: a + b, map(depth, BLOBS)), 2))
