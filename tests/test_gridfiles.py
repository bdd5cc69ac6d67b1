"""Gridded files: the layout, filters that keep files closed, images that appear whole or not at all."""

import datetime as dt
import io
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.config import RunParams
from cirrostrat.functions.filetime import file_time
from cirrostrat.plans import segment, track
from cirrostrat.sources import sinks
from cirrostrat.sources.adapters import slot_time
from cirrostrat.sources.classic import ClassicReader, write_classic
from cirrostrat.sources.gridfiles import read_grids, read_platform_grids, time_in_name, write_grids
from tests.volumes import blob_voxels

NAMES = [
    "mask_20120801_1430.nc", "img_msg04_202303192130.nc", "x_2023-03-19T21-30-00.nc", "20230319T2130.nc4", "20230319T213045.nc4", "99920230319213000.nc", "navigation.nc", "a20230319_2130_x.nc", "S202303191.nc",
    "d/20239919213000_202303192130.nc", "20120801_9930.nc", "",
]


def written(dims, variables, attrs):
    f = io.BytesIO()
    write_classic(f, dims, variables, attrs)
    f.seek(0)
    return f


def test_layout_round_trip():
    a, b = np.arange(24, dtype=np.int16).reshape(1, 4, 6), np.linspace(-3, 3, 5)
    f = written({"time": None, "y": 4, "x": 6, "n": 5}, [("img", ("time", "y", "x"), a, {"scale_factor": 0.5, "_FillValue": np.int16(7)}), ("axis", ("n",), b, {"units": "degrees"})], {"title": "Ténèbres", "k": np.int32(3)})
    data = f.getvalue()
    assert data[:4] == b"CDF\x02" and struct.unpack(">i", data[4:8])[0] == 1
    r = ClassicReader(f)
    assert r.dims == {"time": 0, "y": 4, "x": 6, "n": 5} and r.attrs == {"title": "Ténèbres", "k": 3}
    assert r.variables["img"].dims == ("time", "y", "x") and r.variables["axis"].attrs == {"units": "degrees"}
    np.testing.assert_array_equal(r.rows("img", 1, 2), a[0, 1:3])
    np.testing.assert_array_equal(r.rows("axis")[0], b)
    want = a[0] * 0.5
    want[a[0] == 7] = np.nan
    np.testing.assert_array_equal(r.decoded("img"), want)
    for broken in (b"CDF\x05....", b"HDF", data[:40]):
        with pytest.raises(ValueError):
            ClassicReader(io.BytesIO(broken))


def test_the_small_layout_of_32_bit_offsets():
    """Written by hand from the description of the format."""
    def name(s):
        return struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")

    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0)
    entry = name("v") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 3, 8)
    head += struct.pack(">ii", 11, 1) + entry
    data = head + struct.pack(">i", len(head) + 4) + struct.pack(">hhh", 5, -6, 7)
    assert ClassicReader(io.BytesIO(data)).rows("v").tolist() == [[5, -6, 7]]


def test_times_in_names_are_those_of_the_expression(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "path string").select("path", F.unix_seconds(file_time(F.col("path"))).alias("s")).collect()
    for r in rows:
        t = time_in_name(r.path)
        assert r.s == (None if t is None else int(t.timestamp())), r.path


def images(spark, slots=6, ny=4, nx=5):
    v = spark.range(slots * ny * nx).selectExpr(f"cast(id div {ny * nx} as int) t", f"cast(id % {ny * nx} div {nx} as int) y", f"cast(id % {nx} as int) x", "cast(200 + id % 37 as double) / 4 value")
    return v.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 1800))


def with_paths(df, root):
    return df.withColumn("path", F.concat(F.lit(f"{root}/"), F.date_format("ts", "yyyy_MM_dd"), F.lit("/bt_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.lit(".nc")))


def test_files_and_rows_outside_the_filters_stay_closed(spark, tmp_path):
    root = f"{tmp_path}/in"
    write_grids(with_paths(images(spark).where("value <> 55"), root), root, "IR_108", type="short", scale=0.01, offset=50, fill=-32768)
    (tmp_path / "in" / "2024_01_01" / "bt_20240101_1130.nc").write_bytes(b"nothing to open")  # later than all others
    (tmp_path / "in" / "readme.txt").write_text("x")
    want = {(r.t, r.y, r.x): None if r.value == 55 else r.value for r in images(spark).collect()}
    part = read_platform_grids(spark, root, "MSGnative", start="2024-01-01 00:30:00", end="2024-01-01 01:30:00", y1=2, x0=1, x1=3)
    assert part.rdd.getNumPartitions() == 3
    got = {(int(r.ts.timestamp() - 1704067200) // 1800, r.y, r.x): r.bt for r in part.collect()}
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == {k: v for k, v in want.items() if 1 <= k[0] <= 3 and k[1] <= 2 and 1 <= k[2] <= 3}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read_grids(spark, root, "IR_108").where("ts < timestamp'2024-01-01 01:00:00Z' and y = 3 and x >= 4 and value > 0")
        assert pushed.rdd.getNumPartitions() <= 3 and {(r.y, r.x) for r in pushed.collect()} == {(3, 4)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="classic layout"):
        read_grids(spark, root, "IR_108").count()
    with pytest.raises(Exception, match="has none of"):
        read_grids(spark, root, "other", end="2024-01-01 01:00:00").count()
    with pytest.raises(ValueError, match="unknown platform"):
        read_platform_grids(spark, root, "OTHER")


def files_below(root):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names)


def test_a_failed_write_leaves_nothing_and_later_ones_replace(spark, tmp_path):
    root = f"{tmp_path}/out"
    all_ = with_paths(images(spark), root)
    fail = F.when((F.col("t") == 4) & (F.col("y") == 3), F.raise_error(F.lit("poison")).cast("double")).otherwise(F.col("value"))
    with pytest.raises(Exception, match="poison"):
        write_grids(all_.withColumn("value", fail), root, "v", type="double")
    assert files_below(root) == []
    write_grids(all_.where("t < 3"), root, "v", type="double")
    before = files_below(root)
    with pytest.raises(Exception, match="poison"):
        write_grids(all_.withColumn("value", F.when(F.col("t") == 1, fail + 1).otherwise(fail)), root, "v", type="double")
    assert files_below(root) == before and len(before) == 3 and not read_grids(spark, root, "v").where("value > 200").count()
    write_grids(all_.where("t in (2, 3)").withColumn("value", F.lit(7.0)), root, "v", type="double")
    got = {(r.t, r.value) for r in read_grids(spark, root, "v").selectExpr("(unix_seconds(ts) - 1704067200) div 1800 as t", "value").where("t >= 2").collect()}
    assert got == {(2, 7.0), (3, 7.0)} and len(files_below(root)) == 4


@pytest.mark.parametrize("layout", ["rows", "axes", "grid"])
def test_label_images_in_three_layouts(spark, tmp_path, layout):
    root = str(tmp_path)
    cells = spark.range(12).selectExpr("cast(id div 4 as int) y", "cast(id % 4 as int) x")
    lat = {"rows": F.lit(None).cast("double"), "axes": F.col("y") * 0.5, "grid": F.col("y") * 0.5 + F.col("x") * 0.01}[layout]
    lon = {"rows": F.lit(None).cast("double"), "axes": F.col("x") * 0.25, "grid": F.col("x") * 0.25 - F.col("y") * 0.01}[layout]
    grid = cells.select("y", "x", lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    slots = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 10:30:00",)], "s string").selectExpr("cast(s as timestamp) ts")
    labels = slots.where("minute(ts) = 0").select("ts", F.lit(1).alias("y"), F.lit(2).alias("x"), F.lit(42).alias("label"))
    sinks.write_label_images(labels, grid, slots, root, "2.08", "AFRICA", "mask_", scan_minutes=30, platform="MSG")
    path = f"{root}/labels_2.08/AFRICA/2024/2024_01_01/mask_20240101_1000.nc"
    with open(path, "rb") as f:
        r = ClassicReader(f)
        want = np.full((3, 4), -998)
        want[1, 2] = 42
        np.testing.assert_array_equal(r.rows("DCS_number"), want)
        v = r.variables["DCS_number"]
        assert v.attrs["_FillValue"] == -998 and v.attrs["missing_value"] == -999 and r.attrs["platform"] == "MSG" and r.attrs["scan_end_time"] == "10-30-00 UTC"
        assert v.dims == {"rows": ("time", "y", "x"), "axes": ("time", "latitude", "longitude"), "grid": ("time", "y", "x")}[layout]
        assert float(r.rows("time")[0, 0]) == dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC).timestamp()
        if layout != "rows":
            assert r.variables["latitude"].dims == (("latitude",) if layout == "axes" else ("y", "x")) and r.variables["longitude"].attrs["units"] == "degrees_east"
    back = read_grids(spark, root, "DCS_number").where("value is not null").collect()
    assert [(b.y, b.x, b.value) for b in back] == [(1, 2, 42.0)]


def test_a_run_from_files_to_files(spark, tmp_path):
    """Parameter file and images in, label images out: the same labels as a run over tables."""
    p = RunParams(min_bt=220, max_bt=235, step_bt=15, min_area_seed=4, min_lifetime=3, volume_slots=24, overlap_slots=4)
    (tmp_path / "p.dat").write_text("minBT_threshold = 220\nmaxBT_threshold = 235\nstepBT_threshold = 15\nminAreaSeed = 4\nminLifetime = 3\nVolumeImage = 24\noverlap_window_size = 4\n")
    v = blob_voxels(spark, slots=24).withColumn("ts", slot_time())
    cells = v.select("y", "x").distinct().select("y", "x", (F.col("y") * 0.5).alias("lat"), (F.col("x") * 0.5).alias("lon"), F.lit(1.0).alias("area"))
    root = f"{tmp_path}/images"
    write_grids(with_paths(v.withColumn("value", F.col("bt")), root), root, "BT", type="double", fill=-1)
    segment.run_files(spark, f"file://{tmp_path}/p.dat", root, "ICON", cells, "2024-01-01 00:00:00", "2024-02-01 00:00:00", (-90, 90), (-180, 180), f"{tmp_path}/run", {"root": f"{tmp_path}/masks", "version": "1", "region": "R", "prefix": "m_"})
    want = {(r.ts, r.y, r.x): r.label for r in segment.segment(v.select("ts", "y", "x", "bt"), cells, "2024-01-01 00:00:00", "2024-02-01 00:00:00", p).collect()}
    got = {(r.ts, r.y, r.x): int(r.value) for r in read_grids(spark, f"{tmp_path}/masks", "DCS_number").where("value is not null").collect()}
    assert got == want and len(set(want.values())) >= 2 and len(files_below(f"{tmp_path}/masks")) == 24
    track.track_files(spark, f"{tmp_path}/masks", root, "ICON", cells, "2024-01-01 00:00:00", "2024-02-01 00:00:00", f"{tmp_path}/tracks", 720)
    systems = spark.read.parquet(f"{tmp_path}/tracks/systems").collect()
    assert {r.INT_DCSnumber for r in systems} == set(want.values())
