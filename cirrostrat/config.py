"""Run parameters, and the ``key = value`` files that hold them."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunParams:
    """Parameters of detection, growth and chunking; temperatures in kelvin, areas in km2, lengths in slots."""

    min_bt: int = 190
    max_bt: int = 235
    step_bt: int = 2
    delta_spread: float = 1.0
    final_delta: float = 10.0
    min_area_seed: float = 625.0
    min_lifetime: int = 3
    first_label: int = 1
    volume_slots: int = 96
    overlap_slots: int = 8
    slot_minutes: int = 30
    scan_rules: bool = False
    #: Seeds by one scan whose order decides, instead of components; larger regions need ``divided``.
    exact_scan: bool = False

    def ladder(self) -> list[tuple[int, int]]:
        """(threshold, next threshold); the last threshold overshoots ``max_bt`` where the step does not divide the range, the next one never does."""
        return [(t, min(t + self.step_bt, self.max_bt)) for t in range(self.min_bt, self.max_bt + self.step_bt, self.step_bt)]


#: Keys of parameter files for the fields above (fixed values of the file format).
FILE_KEYS = {
    "minBT_threshold": "min_bt",
    "maxBT_threshold": "max_bt",
    "stepBT_threshold": "step_bt",
    "deltaBT_Spread": "delta_spread",
    "minAreaSeed": "min_area_seed",
    "minLifetime": "min_lifetime",
    "firstlabel": "first_label",
    "VolumeImage": "volume_slots",
    "overlap_window_size": "overlap_slots",
    "temporalresolution": "slot_minutes",
}


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value, kind) of ``key = value`` lines, one row per line that holds a pair.

    Blank lines, those that begin with ``;`` and those without ``=`` are skipped; the first ``=``
    divides. ``kind`` is int, float or string, by what the value reads as; quotes around strings go.
    Keys that repeat give several rows. Null lines are skipped.
    """
    line = F.trim(F.col(column))
    pair = lines.where(line.contains("=") & ~F.startswith(line, F.lit(";")))
    parts = F.split(line, "=", 2)
    raw = F.trim(parts[1])
    kind = F.when(raw.rlike(r"^[+-]?\d+$"), "int").when(raw.try_cast("double").isNotNull(), "float").otherwise("string")
    value = F.when(kind == "int", raw.try_cast("long").cast("string")).when(kind == "float", raw.try_cast("double").cast("string")).otherwise(F.regexp_replace(raw, "^[\"']+|[\"']+$", ""))
    return pair.select(F.trim(parts[0]).alias("key"), value.alias("value"), kind.alias("kind"))


def read_params(spark: SparkSession, path: str) -> dict[str, Any]:
    """A parameter file as a dict; keys that repeat become lists. Files are a few dozen lines."""
    cast = {"int": int, "float": float, "string": str}
    out: dict[str, Any] = {}
    for row in parse_lines(spark.read.text(path)).toLocalIterator():
        value = cast[row.kind](row.value)
        out[row.key] = value if row.key not in out else [*(out[row.key] if isinstance(out[row.key], list) else [out[row.key]]), value]
    return out


def run_params(values: dict[str, Any]) -> RunParams:
    """Parameters from file values; missing keys keep their defaults."""
    kinds = {f.name: type(f.default) for f in fields(RunParams)}
    return RunParams(**{name: kinds[name](values[key]) for key, name in FILE_KEYS.items() if key in values})
