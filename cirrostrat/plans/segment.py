"""Segmentation from images to label tables, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.config import RunParams, read_params, run_params
from cirrostrat.plans.ladder import run_chunks
from cirrostrat.sources.grid import apply_crop, crop_mask
from cirrostrat.sources.gridfiles import read_platform_grids
from cirrostrat.sources.listing import in_period
from cirrostrat.sources.readers import volume
from cirrostrat.sources.sinks import last_chunk_wins, write_grid, write_label_images, write_labels


def cropped(images: DataFrame, grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images and grid inside the rectangle around a box, with indices from zero, and the one row of its bounds in the indices before."""
    bounds = crop_mask(grid, lat, lon)
    return apply_crop(images, bounds), apply_crop(grid, bounds), bounds


def segment(images: DataFrame, grid: DataFrame, start: str, end: str, params: RunParams | None = None) -> DataFrame:
    """(ts, y, x, label) of the systems in images (ts, y, x, bt) of a period, in overlapping chunks.

    Slots are numbered over the images of the period, and chunks cut by that number; of slots in two chunks the later one's
    labels count. Only voxels up to the warmest threshold are read on. An empty period gives no rows.
    """
    params = params or RunParams()
    warmest = max(t for pair in params.ladder() for t in pair)
    slots = volume(images, start, end).select("t", "ts").distinct()
    size = grid.agg(F.max("y"), F.max("x")).first()
    last = slots.agg(F.max("t")).first()[0]
    if last is None or None in size:
        return images.select("ts", "y", "x", F.lit(None).cast("int").alias("label")).where("false")
    cold = images.where(F.col("bt") <= warmest).join(slots, "ts").join(grid.select("y", "x", F.col("area").cast("double").alias("area")), ["y", "x"])
    labelled = run_chunks(cold.select("t", "y", "x", "bt", "area"), params, size[0] + 1, size[1] + 1, last + 1)
    if labelled is None:  # one slot is no chunk
        return images.select("ts", "y", "x", F.lit(None).cast("int").alias("label")).where("false")
    return last_chunk_wins(labelled.join(slots, "t").drop("t")).select("ts", "y", "x", "label")


def run_segmentation(images: DataFrame, grid: DataFrame, start: str, end: str, lat: tuple[float, float], lon: tuple[float, float], path: str, params: RunParams | None = None, files: dict[str, str] | None = None) -> None:
    """Crop, segment and write: ``path``/labels by day and slot, ``path``/grid with the indices of the crop.

    ``files`` (root, version, region, prefix and further attributes): the label images too, one gridded file for each slot of the period.
    """
    near, cells, bounds = cropped(images, grid, lat, lon)
    b = bounds.first()
    write_grid(cells.withColumns({"crop_y0": F.lit(b.y0), "crop_y1": F.lit(b.y1), "crop_x0": F.lit(b.x0), "crop_x1": F.lit(b.x1)}), f"{path}/grid")
    labels = segment(near, cells, start, end, params)
    write_labels(labels.withColumn("chunk", F.lit(0)), f"{path}/labels")
    if files:
        slots = in_period(near, start, end).select("ts").distinct()
        own = near.sparkSession.read.parquet(f"{path}/labels").join(slots, "ts", "left_semi")
        write_label_images(own, cells, slots, scan_minutes=(params or RunParams()).slot_minutes, **files)


def run_files(spark: SparkSession, config: str, images: str, platform: str, grid: DataFrame, start: str, end: str, lat: tuple[float, float], lon: tuple[float, float], path: str, files: dict[str, str] | None = None) -> None:
    """A run from its parameter file and the gridded files of a platform: only those of the period are opened."""
    params = run_params(read_params(spark, config))
    run_segmentation(read_platform_grids(spark, images, platform, start=start, end=end), grid, start, end, lat, lon, path, params, files)
