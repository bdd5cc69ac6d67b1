"""Voxel volumes from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the event volume: its start (UTC seconds) and length.
EPOCH, SLOT_SECONDS, WIDTH = 1704067200, 43200, 15


def event_voxels(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """(t, y, x, bt): events in slots of twelve hours, users as pixels, the coldest of a voxel's values."""
    t = F.expr(f"cast((unix_seconds(cast(ts as timestamp)) - {EPOCH}) div {SLOT_SECONDS} as int)")
    keyed = events.select(t.alias("t"), F.expr(f"cast(user_id div {width} as int)").alias("y"), (F.col("user_id") % width).cast("int").alias("x"), "value")
    return keyed.groupBy("t", "y", "x").agg(F.round(F.min(180 + F.col("value")), 2).alias("bt"))


def slot_time(t: str = "t"):
    return F.timestamp_seconds(F.lit(EPOCH) + F.col(t) * SLOT_SECONDS)


def event_grid(voxels: DataFrame, width: int = WIDTH) -> DataFrame:
    """A regular half-degree grid below the event volume."""
    rows = voxels.select("y").distinct()
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return cells.select("y", "x", (F.col("y") * 0.5 - 10).alias("lat"), (F.col("x") * 0.5 - 20).alias("lon"), F.lit(19.8).alias("area"))
