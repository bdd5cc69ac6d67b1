"""Scalar expressions: voxel indices, brightness temperatures, distances, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed physical constants.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
STEFAN_BOLTZMANN = 5.670374419e-8
#: Missing and background values of the exported tables.
MISSING, BACKGROUND = -999, -998


def voxel_index(t: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    """Linear index in C order."""
    return (t.cast("long") * (ny * nx) + y * nx + x).cast("long")


def voxel_position(index: Column, ny: int, nx: int) -> tuple[Column, Column, Column]:
    """t, y and x of a linear index."""
    plane = F.pmod(index, F.lit(ny * nx))
    return F.floor(index / (ny * nx)).cast("int"), F.floor(plane / nx).cast("int"), F.pmod(plane, F.lit(nx)).cast("int")


def olr_to_bt(olr: Column) -> Column:
    """Brightness temperature of an outgoing long-wave flux (W/m2): its black-body value through a quadratic fit with fixed coefficients."""
    tb = F.pow(olr / STEFAN_BOLTZMANN, F.lit(0.25))
    return tb * tb * 0.00443828 - tb * 0.543846 + 129.544


def decode(raw: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> Column:
    """Packed values; the fill value and NaN become null."""
    value = F.nanvl(raw.cast("double"), F.lit(None).cast("double")) * scale + offset
    return value if fill is None else F.when(raw == fill, None).otherwise(value)


def centikelvin(bt: Column) -> Column:
    """Hundredths of a kelvin, cut toward zero, from single precision."""
    return (bt.cast("float") * F.lit(100).cast("float")).cast("int")


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def chord_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance through the earth, which tracking uses for displacements and velocities."""
    return 2 * EARTH_RADIUS_KM * F.sqrt(_half_chord(lat1, lon1, lat2, lon2))


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """x and y around a point, on a flat earth."""
    return (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * KM_PER_DEGREE


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def normalised(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / (high - low + 1e-6)


def padded(values: Column, before: int, after: int, fill: Column) -> Column:
    """An array with constant padding on both sides."""
    return F.concat(F.array_repeat(fill, before), values, F.array_repeat(fill, after))


def with_background(label: Column) -> Column:
    """Labels for export: none or zero becomes the background value."""
    return F.when(F.coalesce(label, F.lit(0)) == 0, BACKGROUND).otherwise(label)


def slot_path(root: str, version: str, region: Column, prefix: Column, ts: Column) -> Column:
    """Where the image of a slot is filed: by year and day, named by its minute."""
    return F.concat_ws(
        "/", F.lit(f"{root}/labels_{version}"), region, F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy_MM_dd"),
        F.concat(prefix, F.date_format(ts, "yyyyMMdd_HHmm"), F.lit(".nc")),
    )


def scan_end(ts: Column, minutes: int) -> Column:
    return ts + F.make_interval(mins=F.lit(minutes))
