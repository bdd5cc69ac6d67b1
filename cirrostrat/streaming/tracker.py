"""Label images as a stream: running tracks, tracks that close, and chunks of slots in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cirrostrat.config import RunParams
from cirrostrat.operators.joins import carried_over
from cirrostrat.operators.lifecycle import track_columns
from cirrostrat.plans.ladder import Segmentation, detect_and_spread
from cirrostrat.runtime import delete

_STATE = "n long, first_ts timestamp, first_lat double, first_lon double, last_ts timestamp, last_lat double, last_lon double, tb_min double, surfmax double, surfcum double"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_OUT = f"label int, {_STATE}"
_PLACE = ["ts", "lat", "lon"]


def _value(v: Any) -> Any:
    return None if pd.isna(v) else v


def _summary(batch: pd.DataFrame) -> dict[str, Any]:
    """A batch's rows of one system as a state; missing values (NaN too) count in ``n`` only, as nulls do in an aggregate."""
    b = batch.sort_values(_PLACE, na_position="first")
    (ts0, lat0, lon0), (ts1, lat1, lon1) = ([_value(v) for v in b[_PLACE].iloc[i]] for i in (0, -1))
    values = {"tb_min": b["tbmin"].min(), "surfmax": b["km2"].max(), "surfcum": b["km2"].sum(min_count=1)}
    return {"n": len(b), "first_ts": ts0, "first_lat": lat0, "first_lon": lon0, "last_ts": ts1, "last_lat": lat1, "last_lon": lon1} | {k: _value(v) for k, v in values.items()}


def _merged(a: dict[str, Any] | None, b: dict[str, Any]) -> dict[str, Any]:
    if a is None:
        return b

    def place(s: dict[str, Any], end: str) -> tuple:
        return tuple((s[f"{end}_{c}"] is not None, s[f"{end}_{c}"] or 0) if c != "ts" else s[f"{end}_ts"] for c in _PLACE)

    def both(name: str, f: Callable) -> Any:
        have = [s[name] for s in (a, b) if s[name] is not None]
        return f(have) if have else None

    first, last = min((a, b), key=lambda s: place(s, "first")), max((a, b), key=lambda s: place(s, "last"))
    out = {"n": a["n"] + b["n"]} | {f"first_{c}": first[f"first_{c}"] for c in _PLACE} | {f"last_{c}": last[f"last_{c}"] for c in _PLACE}
    return out | {"tb_min": both("tb_min", min), "surfmax": both("surfmax", max), "surfcum": both("surfcum", sum)}


def _update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    have = {n: _value(v) for n, v in zip(_NAMES, state.get, strict=True)} if state.exists else None
    for batch in rows:
        if len(batch):
            have = _merged(have, _summary(batch))
    if have is not None:
        state.update(tuple(have[n] for n in _NAMES))
        yield pd.DataFrame([{"label": key[0], **have}])


def running_tracks(slots: DataFrame) -> DataFrame:
    """A stream of (label, ts, lat, lon, tbmin, km2) rows to the track of each label so far (update mode).

    State is one row per system and stays; late rows move its first place, extremes and sums. ``closed_tracks`` lets go of systems.
    """
    return slots.where("ts is not null").groupBy("label").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


class _Closer(StatefulProcessor):
    """One state row a system, and a timer that moves with its last slot."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.track = handle, handle.getValueState("track", _STATE)

    def _have(self) -> dict[str, Any] | None:
        return {n: _value(v) for n, v in zip(_NAMES, self.track.get(), strict=True)} if self.track.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        have = self._have()
        for batch in rows:
            if len(batch):
                have = _merged(have, _summary(batch))
        if have is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(pd.Timestamp(have["last_ts"]).tz_localize("UTC").timestamp() * 1000) + self.gap_ms)
            self.track.update(tuple(have[n] for n in _NAMES))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        have = self._have()
        self.track.clear()
        if have is not None and have["n"] >= 2:
            yield pd.DataFrame([{"label": key[0], **have}])

    def close(self) -> None:
        pass


def closed_tracks(slots: DataFrame, slot_minutes: int = 30, unseen_slots: int = 3, late: str = "0 seconds") -> DataFrame:
    """A stream of (label, ts, lat, lon, tbmin, km2) rows to the summary of each system once it has ended (append mode): the columns of ``finish_tracks``.

    A system unseen for ``unseen_slots`` slots, by the watermark that lies ``late`` behind the newest time, is given out once and its
    state dropped; one seen in a single row is dropped without a word. Rows older than the watermark are left out by the stream; rows
    that come late but within it count as if in time. A label seen again after it has ended starts a new track. Rows
    without time or label are left out, other missing values skipped as in an aggregate. Needs the RocksDB state store and times in UTC.
    """
    keyed = slots.where("ts is not null and label is not null").withWatermark("ts", late).groupBy("label")
    gap = slot_minutes * unseen_slots * 60_000
    ended = keyed.transformWithStateInPandas(_Closer(gap), _OUT, "Append", "EventTime")
    places = {"a": ("first_ts", "first_lat", "first_lon"), "z": ("last_ts", "last_lat", "last_lon")}
    return track_columns(ended.withColumns({k: F.struct(*[F.col(c).alias(n) for c, n in zip(cols, _PLACE, strict=True)]) for k, cols in places.items()}))


def slot_sums(pixels: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Cold surfaces per window of a stream of labelled pixels, closed by a watermark."""
    return pixels.withWatermark("ts", late).groupBy(F.window("ts", length), "label").agg(F.count("*").alias("n"), F.min("bt").alias("tb_min"), F.sum("area").alias("area"))


def chunk_writer(params: RunParams, ny: int, nx: int, sink: Callable[[Segmentation, int], None], path: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: segments each micro-batch as a chunk that begins with the last labels of the one before.

    What a batch hands on lies below ``path``, a folder that survives the driver, by batch: the labels of its last ``overlap_slots``
    slots, then, as the mark that they are whole, the last id given. A batch starts from the newest marked one below its own number, so a batch that
    runs again after a restart does what it did at first, and writes over what it left. ``sink`` (segmentation, batch) must be as idempotent.
    The newest ``keep`` batches stay. Empty batches change nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        start = spark.createDataFrame([(params.first_label,)], "last_label int")
        start.write.mode("ignore").parquet(f"{path}/batch=-1/last")
        marks = spark.read.option("basePath", path).parquet(f"{path}/batch=*/last")
        older = marks.where(F.col("batch") < number).orderBy("batch").collect()  # a handful
        before = older[-1]
        part = batch if before.batch < 0 else carried_over(batch, spark.read.parquet(f"{path}/batch={before.batch}/labels"))
        delete(spark, f"{path}/batch={number}/last")  # of an earlier try; its labels are about to change
        seg = detect_and_spread(part, params, ny, nx, before.last_label)
        sink(seg, number)
        top = batch.agg(F.max("t")).first()[0]
        handed = seg.voxels.where(F.col("label").isNotNull() & (F.col("t") > top - params.overlap_slots)).select("t", "y", "x", "label")
        handed.write.mode("overwrite").parquet(f"{path}/batch={number}/labels")
        spark.createDataFrame([(seg.last_label,)], "last_label int").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}/last")
        for old in [r.batch for r in older if r.batch >= 0][: -(keep - 1) or None]:
            delete(spark, f"{path}/batch={old}")

    return run
