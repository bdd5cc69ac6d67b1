"""Image volumes by platform, as sparse voxel tables.

Images come as Parquet tables of pixels: ts, y, x and the platform's variable (and further
dimensions). A reader decodes the variable to brightness temperature ``bt`` in kelvin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.functions.filetime import file_time
from cirrostrat.functions.scalar import decode, olr_to_bt
from cirrostrat.sources.grid import X_NAMES, Y_NAMES, resolve
from cirrostrat.sources.listing import in_period


@dataclass(frozen=True)
class Platform:
    """How a platform stores its images (variable names are fixed values of the formats)."""

    variables: tuple[str, ...]
    fixed: tuple[str, ...] = ()
    convert: Callable[[Column], Column] | None = None


PLATFORMS = {
    "MSG": Platform(("Harmonized_irBT",)),
    "MSGnative": Platform(("IR_108",)),
    "ARPEGE": Platform(("BT",), fixed=("spec",)),
    "ICON": Platform(("BT",)),
    "SAM": Platform(("rlut", "LWNTA"), convert=olr_to_bt),
}


def read_images(raw: DataFrame, platform: str, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> DataFrame:
    """``(ts, y, x, bt)`` from a platform's pixel table; missing values are null. An unknown platform raises.

    Extra dimensions of the platform keep their first index; dimension names are matched whatever their case.
    """
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}; known are {', '.join(PLATFORMS)}")
    p = PLATFORMS[platform]
    variable, y, x = resolve(raw.columns, p.variables), resolve(raw.columns, Y_NAMES), resolve(raw.columns, X_NAMES)
    if None in (variable, y, x):
        raise ValueError(f"{platform} needs one of {p.variables} and y, x among {raw.columns}")
    for dim in p.fixed:
        if dim in raw.columns:
            raw = raw.where(F.col(dim) == 0)
    bt = decode(F.col(variable), scale, offset, fill)
    return raw.select("ts", F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"), (p.convert(bt) if p.convert else bt).alias("bt"))


def read_platform(spark: SparkSession, path: str, platform: str, **packing: float) -> DataFrame:
    """Images of a platform's tables; where these have no times, or none in a row, the time in the file's name counts."""
    raw = spark.read.parquet(path)
    named = file_time(F.col("_metadata.file_path"))
    return read_images(raw.withColumn("ts", F.coalesce("ts", named) if "ts" in raw.columns else named), platform, **packing)


def volume(images: DataFrame, start: str, end: str, coldest: float | None = None) -> DataFrame:
    """``(t, ts, y, x, bt)`` of a period; ``t`` numbers the slots that have images.

    Slots are numbered over their distinct times, one row for each, so no window sees the pixels.
    ``coldest``: keep voxels up to this temperature only, the sparse form that detection needs.
    """
    own = in_period(images, start, end).select("ts", "y", "x", "bt")
    slots = own.select("ts").distinct().select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("t"))
    own = own if coldest is None else own.where(F.col("bt") <= coldest)
    return own.where("bt is not null").join(slots, "ts").select("t", "ts", "y", "x", "bt")


def read_labels(raw: DataFrame, variable: str = "label") -> DataFrame:
    """``(ts, y, x, label)`` of label images, without background."""
    return raw.where(F.col(variable) > 0).select("ts", "y", "x", F.col(variable).cast("int").alias("label"))
