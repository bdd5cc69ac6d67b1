import pytest
from pyspark.sql import functions as F

from cirrostrat.functions import scalar
from cirrostrat.operators.lifecycle import dense, life_cycle, with_velocity
from cirrostrat.sources import grid, listing, readers, sinks


def test_listing_reads_names_only(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    for name in ("a_20240101_0000.nc", "a_20240101_0030.nc4", "a_20240102_0000.nc", "readme.txt", "grid.nc"):
        (tmp_path / "2024" / name).write_text("x")
    root = f"file://{tmp_path}"
    assert listing.list_files(spark, root).count() == 4
    got = [r.path.rsplit("/", 1)[1] for r in listing.period_files(spark, root, "2024-01-01 00:00:00", "2024-01-01 00:30:00").collect()]
    assert got == ["a_20240101_0000.nc", "a_20240101_0030.nc4"]


@pytest.mark.parametrize(("platform", "columns"), [("MSG", "ts, y, x, 21000 as Harmonized_irBT"), ("MSGnative", "ts, y, x, 21000 as IR_108"), ("ARPEGE", "ts, lat as Latitude, lon as LON, spec, 21000 as BT"), ("ICON", "ts, y, x, 21000 as bt")])
def test_platforms(spark, platform, columns):
    raw = spark.sql("select timestamp'2024-01-01' ts, 0 y, 1 x, 0 lat, 1 lon, explode(array(0, 1)) spec").selectExpr(*columns.split(", "))
    rows = readers.read_images(raw, platform, scale=0.01).collect()
    assert all((r.y, r.x, r.bt) == (0, 1, 210.0) for r in rows) and len(rows) == (1 if platform == "ARPEGE" else 2)


def test_flux_becomes_temperature(spark):
    raw = spark.sql("select timestamp'2024-01-01' ts, 0 y, 0 x, cast(v as double) LWNTA from values ('200.0'), ('nan'), (null) t(v)")
    got = sorted((r.bt for r in readers.read_images(raw, "SAM").collect()), key=lambda v: v is not None)
    assert got[:2] == [None, None] and got[2] == pytest.approx(260.59592675825054)  # (200 / sigma) ** 0.25 through the fixed quadratic


def test_times_from_file_names(spark, tmp_path):
    rows = spark.sql("select 0 y, explode(array(0, 1)) x, 210.0D IR_108")
    rows.coalesce(1).write.parquet(f"{tmp_path}/raw")
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "image_20230319_2130.parquet")
    got = readers.read_platform(spark, f"file://{tmp_path}/image_20230319_2130.parquet", "MSGnative").selectExpr("string(ts) ts", "bt").collect()
    assert [tuple(r) for r in got] == [("2023-03-19 21:30:00", 210.0)] * 2


def test_volume_numbers_slots_with_images(spark):
    rows = spark.sql("select timestamp_seconds(1704067200 + 1800 * s) ts, 0 y, 0 x, cast(b as double) bt from values (0, 200), (3, 210), (5, 300) t(s, b)")
    v = readers.volume(rows, "2024-01-01 00:00:00", "2024-01-01 02:30:00", coldest=236)
    assert sorted((r.t, r.bt) for r in v.collect()) == [(0, 200.0), (1, 210.0)]


def test_grid_names_and_areas(spark):
    g = grid.load_grid(spark.sql("select 0 y, 0 x, 1.5 matlat, 2.5 mat_longitude")).first()
    assert (g.lat, g.lon, g.area) == (1.5, 2.5, 1.0)
    with pytest.raises(ValueError):
        grid.load_grid(spark.sql("select 0 y, 0 x"))


def test_index_round_trip_and_padding(spark):
    t, y, x = scalar.voxel_position(F.col("id"), 7, 9)
    df = spark.range(200).select("id", t.alias("t"), y.alias("y"), x.alias("x"))
    assert df.where(scalar.voxel_index(F.col("t"), F.col("y"), F.col("x"), 7, 9) != F.col("id")).isEmpty()
    assert spark.sql("select array(1, 2) a").select(scalar.padded(F.col("a"), 1, 2, F.lit(0))).first()[0] == [0, 1, 2, 0, 0]


def test_life_cycle_of_few_pixels(spark):
    g = spark.range(25).selectExpr("cast(id div 5 as int) y", "cast(id % 5 as int) x").selectExpr("y", "x", "y * 1.0D lat", "x * 1.0D lon", "2.0D area")
    px = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, 0, s) ts, y, x, 1 label, cast(b as double) bt from values (0, 1, 1, 200), (0, 1, 2, 230), (2, 3, 3, null) t(s, y, x, b)").join(g, ["y", "x"])
    lc = with_velocity(life_cycle(px, g)).orderBy("ts").collect()
    assert (lc[0].n, lc[0].cy, lc[0].cx, lc[0].tbmin, lc[0].pix_220, lc[0].km2_235, lc[0].semimajor_235, lc[0].velocity) == (2, 1, 1, 200.0, 1, 4.0, None, -999.0)
    assert (lc[1].n, lc[1].tbmin, lc[1].km2_235) == (1, None, 0.0) and 40 < lc[1].velocity < 45
    m = dense(with_velocity(life_cycle(px, g)), ["tbmin"]).orderBy("ts").collect()
    assert [r.tbmin for r in m] == [200.0, -999.0]


def test_tracking_tables(spark, tmp_path):
    a, b = spark.sql("select 1 label, 2.0D duration_hours"), spark.sql("select 1 label, 5 n")
    sinks.write_tracking(a, b, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/systems")).count() == spark.read.parquet(str(tmp_path / "run/life_cycle")).count() == 1
    sinks.write_grid(a, str(tmp_path / "grid"))
    assert sinks.published(a).columns == ["DCS_number", "INT_duration"]


def test_segmentation_and_tracking_end_to_end(spark, tmp_path):
    """Images in, label images by slot, then the tables of systems: two blobs that last become two systems with their numbers of slots."""
    from cirrostrat.config import RunParams
    from cirrostrat.plans import segment, track

    cold = {(t, y, x) for t in range(4) for y in range(2, 5) for x in range(2, 5)} | {(t, y, x) for t in range(1, 5) for y in range(10, 13) for x in range(10, 13)}
    rows = [(t, y, x, 195.0 if (t, y, x) in cold else 280.0) for t in range(6) for y in range(16) for x in range(16)]
    images = spark.createDataFrame(rows, "s int, y int, x int, bt double").selectExpr("timestamp_seconds(1704067200 + 1800 * s) ts", "y", "x", "bt")
    grid_ = spark.range(256).selectExpr("cast(id div 16 as int) y", "cast(id % 16 as int) x").selectExpr("y", "x", "y * 1.0D lat", "x * 1.0D lon", "20.0D area")
    p = RunParams(min_bt=190, max_bt=230, step_bt=20, min_area_seed=100, min_lifetime=3, volume_slots=4, overlap_slots=2)
    period = ("2024-01-01 00:00:00", "2024-01-01 02:30:00")
    segment.run_segmentation(images, grid_, *period, (1, 14), (0, 15), str(tmp_path / "run"), p)
    labels, cells = spark.read.parquet(str(tmp_path / "run/labels")), spark.read.parquet(str(tmp_path / "run/grid"))
    assert (cells.count(), cells.first().crop_y0, cells.first().crop_y1) == (14 * 16, 1, 14)
    got = {(r.s, r.y + 1, r.x) for r in labels.selectExpr("cast((unix_seconds(ts) - 1704067200) / 1800 as int) s", "y", "x").collect()}
    assert got == cold and labels.select("label").distinct().count() == 2
    systems, lc = track.track(labels.select("ts", "y", "x", "label"), segment.cropped(images, grid_, (1, 14), (0, 15))[0], cells, *period)
    assert sorted(r.duration_hours for r in systems.collect()) == [2.0, 2.0] and lc.count() == 8
    track.run_tracking(labels.select("ts", "y", "x", "label"), segment.cropped(images, grid_, (1, 14), (0, 15))[0], cells, *period, str(tmp_path / "out"))
    assert len(spark.read.parquet(str(tmp_path / "out/systems")).columns) == 27 and spark.read.parquet(str(tmp_path / "out/life_cycle")).count() == 10
    assert segment.segment(images.where("false"), grid_, *period, p).isEmpty()
    late = labels.select((F.col("ts") + F.expr("interval 30 seconds")).alias("ts"), "y", "x", "label")
    assert track.matched_pixels(late, images, grid_).count() == labels.count() and track.matched_pixels(late, images, grid_, 10).isEmpty()
    old = sinks.legacy_systems(lifecycle_tracks(track.matched_pixels(labels, images, grid_), grid_))
    assert len(old.columns) == 13 and old.count() == 2


def lifecycle_tracks(pixels, grid_):
    from cirrostrat.operators.lifecycle import online_tracks

    return online_tracks(pixels, grid_)
