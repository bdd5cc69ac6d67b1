"""Tracking tables from label images and temperature images, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.operators.joins import asof_nearest, pixels
from cirrostrat.operators.lifecycle import life_cycle, summary, with_velocity
from cirrostrat.sources.gridfiles import read_grids, read_platform_grids
from cirrostrat.sources.listing import in_period
from cirrostrat.sources.readers import read_labels
from cirrostrat.sources.sinks import LABEL_VARIABLE, published_cycle, published_systems, write_tracking


def matched_pixels(labels: DataFrame, images: DataFrame, grid: DataFrame, tolerance_seconds: int = 60) -> DataFrame:
    """Labelled pixels with the temperature of the image nearest in time, at the times of the images.

    Only the times are matched, one row of each. Label images without an image within the tolerance are left out, as are images without labels.
    """
    times = images.select("ts").distinct().withColumn("path", F.col("ts"))
    labels = read_labels(labels)
    masks = labels.select("ts").distinct().withColumn("path", F.col("ts"))
    pairs = asof_nearest(times, masks, tolerance_seconds).where("matched is not null").select(F.col("ts").alias("image_ts"), F.col("matched").alias("ts"))
    own = labels.join(pairs, "ts").select(F.col("image_ts").alias("ts"), "y", "x", "label")
    return pixels(own, images, grid)


def track(labels: DataFrame, images: DataFrame, grid: DataFrame, start: str, end: str, slot_minutes: int = 30, tolerance_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(systems, life cycle) of a period: one row per system, and one per system and image in which it is seen."""
    found = matched_pixels(in_period(labels, start, end), in_period(images, start, end), grid, tolerance_seconds)
    lc = with_velocity(life_cycle(found, grid))
    return summary(lc, slot_minutes), lc


def run_tracking(labels: DataFrame, images: DataFrame, grid: DataFrame, start: str, end: str, path: str, slot_minutes: int = 30, ellipses: bool = False) -> None:
    """Track and write the two published tables below ``path``."""
    systems, lc = track(labels, images, grid, start, end, slot_minutes)
    write_tracking(published_systems(systems), published_cycle(lc, ellipses), path)


def track_files(spark: SparkSession, masks: str, images: str, platform: str, grid: DataFrame, start: str, end: str, path: str, slot_minutes: int = 30, ellipses: bool = False) -> None:
    """``run_tracking`` over the gridded label images and images of a platform below two folders: only files of the period are opened."""
    labels = read_grids(spark, masks, LABEL_VARIABLE, start=start, end=end).where("value > 0").select("ts", "y", "x", F.col("value").cast("int").alias("label"))
    run_tracking(labels, read_platform_grids(spark, images, platform, start=start, end=end), grid, start, end, path, slot_minutes, ellipses)
