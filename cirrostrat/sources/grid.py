"""Navigation grids and crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which grids carry their coordinates (fixed values of the input formats).
LAT_NAMES = ("lat", "latitude", "mat_latitude", "matlat")
LON_NAMES = ("lon", "longitude", "mat_longitude", "matlon")
AREA_NAMES = ("mat_surfacePix", "surface", "area")
Y_NAMES = ("y", "lat", "latitude", "ny", "nlat", "rows")
X_NAMES = ("x", "lon", "longitude", "nx", "nlon", "cols")


def resolve(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is among the columns, whatever its case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def load_grid(raw: DataFrame) -> DataFrame:
    """``grid(y, x, lat, lon, area)`` from a table of cells; a grid without areas counts pixels of one."""
    lat, lon, area = (resolve(raw.columns, names) for names in (LAT_NAMES, LON_NAMES, AREA_NAMES))
    if lat is None or lon is None:
        raise ValueError(f"no coordinates among {raw.columns}")
    return raw.select("y", "x", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), (F.col(area) if area else F.lit(1.0)).cast("float").alias("area"))


def _bounds(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def crop_axes(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """One row y0, y1, x0, x1 for a grid of separable axes: the index ranges from the first to the last coordinate inside."""
    y = grid.where(F.col("lat").between(*lat)).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    x = grid.where(F.col("lon").between(*lon)).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return y.crossJoin(x)  # two rows of one


def crop_mask(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """One row y0, y1, x0, x1: the rectangle around all cells inside the box, which keeps cells outside the box but inside the rectangle."""
    return _bounds(grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon)))


def apply_crop(cells: DataFrame, bounds: DataFrame, rebase: bool = True) -> DataFrame:
    """Cells or voxels inside the bounds (ends included), with indices from zero if ``rebase``. An empty crop raises."""
    b = bounds.first()
    if b is None or None in (b.y0, b.y1, b.x0, b.x1):
        raise ValueError("no grid cell lies in the crop")
    inside = cells.where(F.col("y").between(b.y0, b.y1) & F.col("x").between(b.x0, b.x1))
    return inside.withColumns({"y": F.col("y") - b.y0, "x": F.col("x") - b.x0}) if rebase else inside


def crop_box(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells inside a box by their own coordinates, whichever way latitudes run."""
    return cells.where(F.col("lat").between(min(lat), max(lat)) & F.col("lon").between(min(lon), max(lon)))
