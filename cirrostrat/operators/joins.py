"""Joins of images, labels and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_seconds: int = 60, ts: str = "ts", payload: str = "path") -> DataFrame:
    """``left`` with the nearest row of ``right`` within a tolerance (ends included), else nulls: matched_ts, matched.

    Times fall into buckets of the tolerance, so a match lies in the same bucket or a neighbouring
    one: an equi-join on three buckets instead of a comparison of all pairs. Equal distances take the
    earlier row, then the lesser payload. Right rows of one time are first reduced to one. Left rows
    of one time share one match, whatever their number.
    """
    def bucket(c):
        return F.floor(F.unix_micros(c.cast("timestamp")) / (tolerance_seconds * 1_000_000))

    r = right.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("matched_ts")).agg(F.min(payload).alias("matched")).withColumn("b", bucket(F.col("matched_ts")))
    times = left.where(F.col(ts).isNotNull()).select(F.col(ts).alias("lt")).distinct()
    near = times.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col("lt")) + d))).join(r, "b")
    gap = F.abs(F.unix_micros(F.col("lt").cast("timestamp")) - F.unix_micros(F.col("matched_ts").cast("timestamp")))
    best = near.withColumn("gap", gap).where(F.col("gap") <= tolerance_seconds * 1_000_000).groupBy("lt").agg(F.min(F.struct("gap", "matched_ts", "matched")).alias("m"))
    return left.join(best, left[ts] == best["lt"], "left").select(*[left[c] for c in left.columns], F.col("m.matched_ts").alias("matched_ts"), F.col("m.matched").alias("matched"))


def unused(right: DataFrame, left: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of ``right`` whose exact time no row of ``left`` has (also those that match inexactly)."""
    return right.join(left.select(ts).distinct(), ts, "left_anti")


def pixels(labels: DataFrame, images: DataFrame, grid: DataFrame) -> DataFrame:
    """(ts, y, x, label, bt, lat, lon, area) of the labelled pixels; Spark broadcasts the grid if it is small enough."""
    return labels.join(images.select("ts", "y", "x", "bt"), ["ts", "y", "x"]).join(grid, ["y", "x"])


def at_cells(points: DataFrame, grid: DataFrame, y: str, x: str) -> DataFrame:
    """Coordinates of the grid cells that ``y`` and ``x`` name: lat, lon."""
    g = grid.select(F.col("y").alias("_gy"), F.col("x").alias("_gx"), "lat", "lon")
    return points.join(g, (points[y] == F.col("_gy")) & (points[x] == F.col("_gx")), "left").drop("_gy", "_gx")


def carried_over(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """Voxels with the labels that an earlier chunk gave them."""
    known = labels.select("t", "y", "x", F.col("label").alias("_l"))
    own = F.col("label") if "label" in voxels.columns else F.lit(None).cast("int")
    return voxels.join(known, ["t", "y", "x"], "left").withColumn("label", F.coalesce("_l", own)).drop("_l")


def still_present(seeds: DataFrame, overlap: DataFrame) -> DataFrame:
    """Seeds whose label occurs in the overlap of two chunks."""
    return seeds.join(overlap.where("label is not null").select("label").distinct(), "label", "left_semi")


def rebased(seeds: DataFrame, overlap: DataFrame) -> DataFrame:
    """Seeds whose label occurs in the overlap, with ``index``: their place counted from the least label that occurs there."""
    least = overlap.where("label is not null").agg(F.min("label").alias("_least"))  # one row
    return still_present(seeds, overlap).crossJoin(F.broadcast(least)).withColumn("index", F.col("label") - F.col("_least")).drop("_least")


def assign_chunks(slots: DataFrame, length: int, overlap: int, last_slot: int) -> DataFrame:
    """(t, chunk): every chunk that a slot belongs to, in closed form."""
    stride = length - overlap
    t = F.col("t")
    first = F.greatest(F.lit(0), F.ceil((t - length + 1) / F.lit(stride)))
    chunk = F.explode(F.sequence(first.cast("int"), F.floor(t / F.lit(stride)).cast("int")))
    out = slots.select("t", chunk.alias("chunk"))
    return out.where(((F.col("chunk") == 0) & F.lit(last_slot > 0)) | ((F.col("chunk") >= 1) & (F.col("chunk") * stride + overlap < last_slot)))
