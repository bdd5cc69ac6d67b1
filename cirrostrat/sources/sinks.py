"""Tables that a run leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.scalar import BACKGROUND, MISSING, epoch_seconds, scan_end, slot_path, with_background
from cirrostrat.operators.lifecycle import dense
from cirrostrat.sources.gridfiles import write_grids

#: The variable of label images (a fixed value of the output format).
LABEL_VARIABLE = "DCS_number"


def last_chunk_wins(labels: DataFrame) -> DataFrame:
    """Of slots that several chunks write, the images of the latest chunk (labels: chunk, ts, y, x, label)."""
    last = labels.groupBy("ts").agg(F.max("chunk").alias("chunk"))
    return labels.join(last, ["ts", "chunk"])


def export_labels(labels: DataFrame, grid: DataFrame, slots: DataFrame) -> DataFrame:
    """Dense label images: a row for every slot and grid cell, background where there is no label."""
    cells = slots.select("ts").distinct().crossJoin(grid.select("y", "x", "lat", "lon"))  # the images themselves
    return cells.join(labels.select("ts", "y", "x", "label"), ["ts", "y", "x"], "left").withColumn("label", with_background(F.col("label")))


def write_labels(labels: DataFrame, path: str) -> None:
    """Sparse label images by day and slot; of slots in several chunks the last is kept.

    Only the slots that ``labels`` holds are replaced. A slot is a task's work at most, and its rows lie in order, so readers can skip.
    """
    last = last_chunk_wins(labels).withColumns({"day": F.to_date("ts"), "slot": F.date_format("ts", "HHmm")})
    last.repartition("day", "slot").sortWithinPartitions("day", "slot", "y", "x").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "slot").parquet(path)


def label_images(labels: DataFrame, grid: DataFrame, slots: DataFrame, root: str, version: str, region: str, prefix: str, scan_minutes: int = 0) -> DataFrame:
    """Dense label images with the ``path`` under which each slot is filed and the end of its scan."""
    images = export_labels(labels, grid, slots)
    return images.withColumns({"path": slot_path(root, version, F.lit(region), F.lit(prefix), F.col("ts")), "scan_end": scan_end(F.col("ts"), scan_minutes)})


def write_label_images(labels: DataFrame, grid: DataFrame, slots: DataFrame, root: str, version: str, region: str, prefix: str, scan_minutes: int = 0, **told: str) -> None:
    """One gridded file a slot under its dated path, with the published variable, its metadata and whatever attributes are ``told``.

    Later runs replace the slots they hold. The grid decides the layout: without coordinates, with axes, or with two-dimensional ones.
    """
    images = label_images(labels, grid, slots, root, version, region, prefix, scan_minutes).withColumnRenamed("label", "value")
    names = {"long_name": "number of Deep Cloud Systems", "standard_name": "number_of_Deep_Cloud_Systems"}
    write_grids(images, root, LABEL_VARIABLE, type="int", fill=BACKGROUND, missing=MISSING, **names, attr_conventions="CF-1.6", attr_version=version, **{f"attr_{k}": v for k, v in told.items()})


def write_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").parquet(path)


def write_tracking(summary: DataFrame, life_cycle: DataFrame, path: str) -> None:
    """The per-system table and the per-slot table of a run."""
    summary.write.mode("overwrite").parquet(f"{path}/systems")
    life_cycle.write.mode("overwrite").parquet(f"{path}/life_cycle")


#: Names of the published summary for our columns (fixed values of the output format).
PUBLISHED = {
    "label": "DCS_number", "duration_hours": "INT_duration", "utc_init": "INT_UTC_timeInit", "utc_end": "INT_UTC_timeEnd",
    "lon_init": "INT_lonInit", "lat_init": "INT_latInit", "lon_end": "INT_lonEnd", "lat_end": "INT_latEnd",
    "tb_min": "INT_tbmin", "surfmax_235": "INT_surfmaxkm2_235K", "surfcum_235": "INT_surfcumkm2_235K", "distance_km": "INT_distance", "velocity_ms": "INT_velocityAvg", "quality": "QCgeo_DCS",
}


def published(summary: DataFrame) -> DataFrame:
    """The summary under its published names."""
    return summary.select(*[F.col(c).alias(n) for c, n in PUBLISHED.items() if c in summary.columns])


#: Names of the full table of systems for our columns, in its order (fixed values of the output format).
SYSTEM_NAMES = {
    "label": "INT_DCSnumber", "quality": "INT_DCS_qualitycontrol", "class_a": "INT_classif", "duration_hours": "INT_duration", "utc_init": "INT_UTC_timeInit", "utc_end": "INT_UTC_timeEnd",
    "lon_init": "INT_lonInit", "lat_init": "INT_latInit", "lon_end": "INT_lonEnd", "lat_end": "INT_latEnd", "velocity_ms": "INT_velocityAvg", "distance_km": "INT_distance",
    "lon_min": "INT_lonmin", "lon_max": "INT_lonmax", "lat_min": "INT_latmin", "lat_max": "INT_latmax", "tb_min": "INT_tbmin",
    "surfmax_235": "INT_surfmaxkm2_235K", "surfmax_220": "INT_surfmaxkm2_220K", "surfmax_210": "INT_surfmaxkm2_210K", "surfmax_200": "INT_surfmaxkm2_200K", "surfcum_235": "INT_surfcumkm2_235K",
    "class_b": "INT_classif_JIRAK", "class_c": "INT_classif_MADDOX", "storm_number": "INT_TS_number_IBTRACS", "storm_nature": "INT_TS_nature_IBTRACS", "storm_distance": "INT_TS_mindistance_IBTRACS",
}
#: Names of the life-cycle table for our columns, likewise.
CYCLE_NAMES = {
    "tbmin": "LC_tbmin", "tbavg_235": "LC_tbavg_235K", "tbavg_208": "LC_tbavg_208K", "tbavg_200": "LC_tbavg_200K", "tb90": "LC_tb90th", "utc": "LC_UTC_time", "lon": "LC_lon", "lat": "LC_lat",
    "cx": "LC_x", "cy": "LC_y", "velocity": "LC_velocity", "pix_235": "LC_surfPix_235K", "pix_210": "LC_surfPix_210K",
    "km2_235": "LC_surfkm2_235K", "km2_220": "LC_surfkm2_220K", "km2_210": "LC_surfkm2_210K", "km2_200": "LC_surfkm2_200K",
}
#: Names of the older table of systems for our columns (``finish_tracks``), and of its life cycle.
LEGACY_SYSTEM_NAMES = {
    "label": "INT_DCSnumber", "duration_hours": "INT_duration", "utc_init": "INT_UTC_timeInit", "utc_end": "INT_UTC_timeEnd", "lat_init": "INT_latInit", "lon_init": "INT_lonInit",
    "lat_end": "INT_latEnd", "lon_end": "INT_lonEnd", "distance_km": "INT_distance", "velocity_ms": "INT_velocityAvg", "tb_min": "INT_tbmin", "surfmax": "INT_surfmaxkm2_235K", "surfcum": "INT_surfcumkm2_235K",
}
LEGACY_CYCLE_NAMES = {"lat": "LC_lat", "lon": "LC_lon", "tbmin": "LC_tbmin", "km2": "LC_surfkm2_235K", "utc": "LC_UTC_time"}
#: Ellipses of the life-cycle table, for each threshold; the format fills them with missing values so far.
ELLIPSE_NAMES = {"semiminor": "LC_semiminor", "semimajor": "LC_semimajor", "ratio": "LC_ecc", "orientation": "LC_orientation"}


def published_systems(summary: DataFrame) -> DataFrame:
    """One row per system with every name of the published table."""
    return summary.select(*[F.col(c).alias(n) for c, n in SYSTEM_NAMES.items()])


def published_cycle(lc: DataFrame, ellipses: bool = False) -> DataFrame:
    """A row for every system and time (DCS, time in seconds) with every name of the published life cycle.

    Missing values stand where a system was not seen or has no value; so do ellipses unless they are asked for.
    """
    own = lc.withColumn("utc", epoch_seconds(F.col("ts")))
    shapes = {f"{c}_{k}": f"{n}_{k}K" for k in (235, 220) for c, n in ELLIPSE_NAMES.items()}
    if not ellipses:
        own = own.withColumns({c: F.lit(None).cast("double") for c in shapes})
    names = CYCLE_NAMES | shapes
    return dense(own, list(names)).select(F.col("label").alias("DCS"), epoch_seconds(F.col("ts")).alias("time"), F.lit(1).alias("QCgeo_IRimage"), *[F.col(c).alias(n) for c, n in names.items()])


def legacy_systems(tracks: DataFrame) -> DataFrame:
    """The incremental tracker's systems under the names of the older table."""
    return tracks.select(*[F.col(c).alias(n) for c, n in LEGACY_SYSTEM_NAMES.items()])


def legacy_cycle(places: DataFrame, tracks: DataFrame) -> DataFrame:
    """Its life cycles (label, ts, lat, lon, tbmin, km2) of the systems in ``tracks``, under the names of the older table."""
    own = places.join(tracks.select("label"), "label", "left_semi").withColumn("utc", epoch_seconds(F.col("ts")))
    return dense(own, list(LEGACY_CYCLE_NAMES)).select(F.col("label").alias("DCS"), epoch_seconds(F.col("ts")).alias("time"), *[F.col(c).alias(n) for c, n in LEGACY_CYCLE_NAMES.items()])
