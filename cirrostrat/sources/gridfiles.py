"""Gridded image files as a Spark data source: one partition a file, files and rows outside the filters never opened; one file a slot on writing.

Files lie in a folder that driver and executors share (a mounted path).
"""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cirrostrat.sources.classic import ClassicReader, write_classic
from cirrostrat.sources.readers import PLATFORMS, read_images

NAME, SUFFIX = "grid_files", ".nc"
#: Cells that a task hands on at once.
CELLS = 1 << 18
_KINDS = {"short": np.int16, "int": np.int32, "float": np.float32, "double": np.float64}


def time_in_name(path: str) -> dt.datetime | None:
    """The time in a file's name by the rules of ``functions.filetime.file_time``, in UTC."""
    name = re.split(r"\.", os.path.basename(path))[0]

    def first(windows: Iterable[str], pattern: str) -> dt.datetime | None:
        for w in windows:
            try:
                return dt.datetime.strptime(w, pattern).replace(tzinfo=dt.UTC)
            except ValueError:
                continue
        return None

    def digits(text: str, n: int) -> list[str]:
        return re.findall(rf"(?=([0-9]{{{n}}}))", text)

    tries = (
        (re.findall(r"([0-9]{8}_[0-9]{4})$", name), "%Y%m%d_%H%M"), (digits(name, 14), "%Y%m%d%H%M%S"), (digits(name, 12), "%Y%m%d%H%M"),
        (re.findall(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}-[0-9]{2})", name)[:1], "%Y-%m-%dT%H-%M-%S"), (digits(name.replace("T", ""), 12), "%Y%m%d%H%M"),
    )
    return next((t for windows, pattern in tries if (t := first(windows, pattern)) is not None), None)


@dataclass
class FilePartition(InputPartition):
    path: str
    ts: dt.datetime | None


class _Bounds:
    """Inclusive bounds of ts, y and x."""

    def __init__(self):
        self.lo: dict[str, Any] = {}
        self.hi: dict[str, Any] = {}

    def narrow(self, name: str, lo: Any = None, hi: Any = None) -> None:
        if lo is not None:
            self.lo[name] = max(lo, self.lo.get(name, lo))
        if hi is not None:
            self.hi[name] = min(hi, self.hi.get(name, hi))

    def holds(self, name: str, value: Any) -> bool:
        return (name not in self.lo or value >= self.lo[name]) and (name not in self.hi or value <= self.hi[name])


def _utc(value: Any) -> dt.datetime:
    value = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.variables = options["path"].removeprefix("file://"), options["variable"].split(",")
        self.bounds = _Bounds()
        self.bounds.narrow("ts", *(_utc(options[k]) if k in options else None for k in ("start", "end")))
        for c in ("y", "x"):
            self.bounds.narrow(c, *(int(options[c + k]) if c + k in options else None for k in ("0", "1")))

    def partitions(self) -> list[FilePartition]:
        """A partition for each file whose name has a time within the bounds, or none; only names are read."""
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.endswith(SUFFIX) and not n.startswith("."))
        timed = [FilePartition(p, time_in_name(p)) for p in found]
        return [p for p in timed if p.ts is None or self.bounds.holds("ts", p.ts)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            file = ClassicReader(f)
            variable = next((v for v in self.variables if v in file.variables), None)
            if variable is None:
                raise ValueError(f"{partition.path} has none of {self.variables}, but {sorted(file.variables)}")
            ts = partition.ts
            if ts is None:
                if "time" not in file.variables:
                    raise ValueError(f"{partition.path} has no time, in its name or within")
                ts = dt.datetime.fromtimestamp(float(file.rows("time")[0, 0]), dt.UTC)
            if not self.bounds.holds("ts", ts):
                return
            ny, nx = (1, 1, *file.variables[variable].shape)[-2:]
            y0, y1 = max(0, self.bounds.lo.get("y", 0)), min(ny - 1, self.bounds.hi.get("y", ny - 1))
            x0, x1 = max(0, self.bounds.lo.get("x", 0)), min(nx - 1, self.bounds.hi.get("x", nx - 1))
            step = max(1, CELLS // nx)
            for lo in range(y0, y1 + 1, step):
                values = file.decoded(variable, lo, min(y1, lo + step - 1))[:, x0 : x1 + 1]
                n = values.size
                y, x = np.repeat(np.arange(lo, lo + len(values), dtype=np.int32), values.shape[1]), np.tile(np.arange(x0, x1 + 1, dtype=np.int32), len(values))
                value = values.ravel()
                stamp = pa.array([ts] * n, pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), stamp, pa.array(y), pa.array(x), pa.array(value, mask=np.isnan(value))], names=["path", "ts", "y", "x", "value"])


class PushingReader(GridReader):
    """For sessions that push filters down to Python sources; Spark refuses a reader that could where it does not."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of ts, y and x narrow what is opened and read; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in ("ts", "y", "x"):
                name, value = f.attribute[0], _utc(f.value) if f.attribute[0] == "ts" else f.value
                self.bounds.narrow(name, value if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None, value if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None)
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it lies until the commit, where it goes)


class GridWriter(DataSourceArrowWriter):
    """Files are written aside, under the job's name, and put in their places when all tasks have ended."""

    def __init__(self, options: dict[str, str]):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, str]] = []
        path, held = None, []
        try:
            for batch in iterator:
                for lo, hi in _runs(batch.column("path")):
                    part = batch.slice(lo, hi - lo)
                    if held and part.column("path")[0].as_py() != path:
                        files.append(self._image(path, held))
                        held = []
                    path = part.column("path")[0].as_py()
                    held.append(part)
            if held:
                files.append(self._image(path, held))
        except BaseException:
            for aside, _ in files:
                os.unlink(aside)
            raise
        return Written(files)

    def _image(self, path: str, parts: list[pa.RecordBatch]) -> tuple[str, str]:
        path = path.removeprefix("file://")
        aside = f"{os.path.dirname(path)}/.{self.job}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(aside, "wb") as f:
                write_classic(f, *_contents(pa.Table.from_batches(parts), self.options))
        except BaseException:
            if os.path.exists(aside):
                os.unlink(aside)
            raise
        return aside, path

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({path for _, path in files}) < len(files):
            self.abort(messages)
            raise ValueError("the rows of an image lie in several tasks")
        for aside, path in files:
            os.replace(aside, path)
        self._clear({os.path.dirname(path) for _, path in files})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear({d for d, _, _ in os.walk(self.options["path"].removeprefix("file://"))})

    def _clear(self, folders: set[str]) -> None:
        """Delete what attempts that did not count have left."""
        for folder in folders:
            for name in os.listdir(folder) if os.path.isdir(folder) else ():
                if name.startswith(f".{self.job}-"):
                    os.unlink(os.path.join(folder, name))


def _runs(paths: pa.Array) -> Iterator[tuple[int, int]]:
    codes = paths.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(codes)]
    return zip(bounds[:-1], bounds[1:], strict=True) if len(codes) else iter(())


def _contents(t: pa.Table, options: dict[str, str]) -> tuple[dict, list, dict]:
    """Dimensions, variables and attributes of one image: on rows and columns alone, on axes of latitude and longitude, or on two-dimensional ones."""
    y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    ny, nx = int(y.max()) + 1, int(x.max()) + 1
    kind, fill = _KINDS[options.get("type", "int")], float(options.get("fill", "-998"))
    scale, offset = float(options.get("scale", "1")), float(options.get("offset", "0"))

    def grid(name: str, empty: float) -> np.ndarray:
        out = np.full((ny, nx), empty)
        out[y, x] = t.column(name).cast(pa.float64()).fill_null(empty).to_numpy()
        return out

    raw = grid("value", np.nan)
    packed = np.where(np.isnan(raw), fill, (raw - offset) / scale)
    packed = np.rint(packed) if np.issubdtype(kind, np.integer) else packed
    attrs: dict[str, Any] = {"_FillValue": kind(fill)} | ({"missing_value": kind(float(options["missing"]))} if "missing" in options else {})
    attrs |= {"scale_factor": scale, "add_offset": offset} if (scale, offset) != (1.0, 0.0) else {}
    attrs |= {k: options[k] for k in ("long_name", "standard_name") if k in options}
    ts, end = (t.column(c)[0].as_py() if c in t.column_names else None for c in ("ts", "scan_end"))
    lat, lon = (grid(c, np.nan) if c in t.column_names else np.full((1, 1), np.nan) for c in ("lat", "lon"))
    degrees = [{"units": f"degrees_{d}", "long_name": n} for d, n in (("north", "latitude"), ("east", "longitude"))]
    coords: list[tuple] = []
    if np.isnan(lat).any() or np.isnan(lon).any():
        names = ("y", "x")
        coords = [("y", ("y",), np.arange(ny, dtype=np.int32), {}), ("x", ("x",), np.arange(nx, dtype=np.int32), {})]
    elif (lat == lat[:, :1]).all() and (lon == lon[:1]).all():
        names = ("latitude", "longitude")
        coords = [("latitude", names[:1], lat[:, 0], degrees[0]), ("longitude", names[1:], lon[0], degrees[1])]
    else:
        names = ("y", "x")
        coords = [("latitude", names, lat, degrees[0]), ("longitude", names, lon, degrees[1])]
    seconds = np.array([ts.replace(tzinfo=ts.tzinfo or dt.UTC).timestamp()])
    time = ("time", ("time",), seconds, {"standard_name": "time", "long_name": "scan start time", "units": "seconds since 1970-01-01 00:00:00 UTC"})
    image = (options.get("variable", "value"), ("time", *names), packed.astype(kind)[None], attrs)
    told = {k.removeprefix("attr_"): v for k, v in options.items() if k.startswith("attr_")}
    told |= {"scan_start_time": f"{ts:%H-%M-%S} UTC", "image_time": f"{ts:%Y-%m-%d-T%H-%M-%S} UTC"} | ({"scan_end_time": f"{end:%H-%M-%S} UTC"} if end else {})
    return {"time": None, names[0]: ny, names[1]: nx}, [*coords, time, image], told


class GridFiles(DataSource):
    """``spark.read.format("grid_files")``: path, ts, y, x, value of all images below ``path``.

    Options: ``path``, ``variable`` (or several, of which the first present counts), ``start`` and ``end`` (UTC), ``y0``, ``y1``, ``x0``, ``x1``, all bounds
    included. Dimensions before the last two keep their first index; scale and offset are applied, fill and missing values are null.
    ``pushdown`` (set it where ``spark.sql.python.filterPushdown.enabled`` is, as ``read_grids`` does): comparisons of ts, y and x do as these options.
    Writing takes path, ts, y, x, value and, if there are, lat, lon, scan_end; the rows of a path in one task, in its order.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, ts timestamp, y int, x int, value double"

    def reader(self, schema) -> GridReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown") == "true" else GridReader)(options)

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options))


def read_grids(spark: SparkSession, path: str, variable: str, **bounds: Any) -> DataFrame:
    """(path, ts, y, x, value) of the images below ``path``; ``bounds`` are the options of ``GridFiles``."""
    spark.dataSource.register(GridFiles)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(path=path, variable=variable, pushdown=pushes, **{k: str(v) for k, v in bounds.items() if v is not None}).load()


def read_platform_grids(spark: SparkSession, path: str, platform: str, **bounds: Any) -> DataFrame:
    """(ts, y, x, bt) of a platform's gridded files, with ``bounds`` as in ``read_grids``."""
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}; known are {', '.join(PLATFORMS)}")
    names = PLATFORMS[platform].variables
    return read_images(read_grids(spark, path, ",".join(names), **bounds).withColumnRenamed("value", names[0]), platform)


def write_grids(images: DataFrame, path: str, variable: str, **options: Any) -> None:
    """Write (path, ts, y, x, value and, if there are, lat, lon, scan_end) as one file for each path, below the folder ``path``; files of these paths are replaced.

    An image is one task's work; none is seen before all are written, and what failed or lost attempts leave is deleted.
    """
    images.sparkSession.dataSource.register(GridFiles)
    held = ("path", "ts", "y", "x", "value", "lat", "lon", "scan_end")
    rows = images.select(*[F.col(c) for c in held if c in images.columns])
    dealt = rows.repartition("path").sortWithinPartitions("path", "y", "x")
    dealt.write.format(NAME).mode("append").options(path=path, variable=variable, **{k: str(v) for k, v in options.items()}).save()
