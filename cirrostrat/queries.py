"""Every operator over the shared tables, with the SQL that says the same in DuckDB.

Volumes are the event volume of ``sources.adapters`` (twelve-hour slots, users as pixels). Labelled voxels of the statistics are tiles of five by five pixels, up to 235 K.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat import config
from cirrostrat.functions import filetime, scalar
from cirrostrat.operators import components, growth, joins, lifecycle, neighbors, seeds
from cirrostrat.plans import ladder, segment, track
from cirrostrat.runtime import shared_dir
from cirrostrat.sources import adapters, grid, gridfiles, listing, readers, sinks
from cirrostrat.streaming import tracker

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

V = """v AS (SELECT CAST((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 43200 AS INT) AS t, CAST(user_id // 15 AS INT) AS y, CAST(user_id % 15 AS INT) AS x, round(min(180 + value), 2) AS bt FROM events GROUP BY 1, 2, 3)"""
G = "g AS (SELECT y, x, CAST(-10 + 0.5 * y AS DOUBLE) AS lat, CAST(-20 + 0.5 * x AS DOUBLE) AS lon, CAST(19.8 AS DOUBLE) AS area FROM (SELECT DISTINCT y FROM v), (SELECT CAST(unnest(range(15)) AS INT) AS x))"
P = f"{V}, {G}, p AS (SELECT v.t, v.y, v.x, bt, 1 + y // 5 * 3 + x // 5 AS label, lat, lon, area, CAST(1704067200 + 43200 * v.t AS BIGINT) AS s FROM v JOIN g USING (y, x) WHERE bt <= 235)"
LC = f"""{P}, lc AS (SELECT c.*, g.lat, g.lon FROM (SELECT label, t, s, count(*) AS n, CAST(trunc(avg(y)) AS INT) AS cy, CAST(trunc(avg(x)) AS INT) AS cx, min(bt) AS tbmin, quantile_cont(bt, 0.9) AS tb90,
 avg(bt) FILTER (bt <= 235) AS a235, avg(bt) FILTER (bt <= 208) AS a208, avg(bt) FILTER (bt <= 200) AS a200,
 count(*) FILTER (bt <= 235) AS p235, count(*) FILTER (bt <= 220) AS p220, count(*) FILTER (bt <= 210) AS p210, count(*) FILTER (bt <= 200) AS p200,
 CAST(19.8 AS DOUBLE) * count(*) FILTER (bt <= 235) AS k235, CAST(19.8 AS DOUBLE) * count(*) FILTER (bt <= 220) AS k220, CAST(19.8 AS DOUBLE) * count(*) FILTER (bt <= 210) AS k210, CAST(19.8 AS DOUBLE) * count(*) FILTER (bt <= 200) AS k200
 FROM p GROUP BY ALL) c JOIN g ON g.y = cy AND g.x = cx)"""
OFF = "o(k, dt, dy, dx) AS (VALUES (0,1,0,0),(1,-1,0,0),(2,0,0,-1),(3,0,0,1),(4,0,1,-1),(5,0,1,0),(6,0,1,1),(7,0,-1,-1),(8,0,-1,0),(9,0,-1,1))"
CHORD = "2 * 6371.0 * sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))"
#: Components of the voxels up to 190 K, by recursion.
CC = f"""{V}, {OFF}, c AS (SELECT t, y, x, CAST(t AS BIGINT) * 100000 + y * 15 + x AS id FROM v WHERE bt <= 190),
 e AS (SELECT a.id AS a, b.id AS b FROM c a, o, c b WHERE b.t = a.t + o.dt AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
 r(id, lab) AS (SELECT id, id FROM c UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.id WHERE r.lab < e.b),
 cc AS (SELECT id, min(lab) AS component FROM r GROUP BY 1)"""
#: Seeds among them: whole km2 per slot, runs of three slots or more.
SEEDS = f"""{CC}, f AS (SELECT component, t, 19 * count(*) AS area FROM cc JOIN c USING (id) GROUP BY ALL),
 big AS (SELECT component, t, t - row_number() OVER (PARTITION BY component ORDER BY t) AS run FROM f WHERE area >= 19),
 runs AS (SELECT component, run, count(*) AS n, min(t) AS t0 FROM big GROUP BY ALL),
 pr AS (SELECT component, max(n) AS longest_run, min(t0) FILTER (n >= 3) AS af FROM runs GROUP BY 1),
 du AS (SELECT component, count(*) AS duration FROM big JOIN pr USING (component) WHERE t >= af GROUP BY 1),
 s AS (SELECT f.component, min(t) AS t_min, max(t) AS t_max, max(t) - min(t) + 1 AS span, sum(area) AS total_area, any_value(longest_run) AS longest_run, coalesce(any_value(duration), 0) AS duration,
   max(t) - min(t) + 1 >= 3 AND any_value(af) IS NOT NULL AND sum(area) >= 57 AS accepted FROM f LEFT JOIN pr USING (component) LEFT JOIN du USING (component) GROUP BY 1)"""
RC = "WITH RECURSIVE "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_voxels(_read(spark, d, "events"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_grid(_voxels(spark, d))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d).where("bt <= 235").withColumn("label", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)")).withColumn("ts", adapters.slot_time())
    return joins.pixels(v.select("ts", "y", "x", "label"), v.select("ts", "y", "x", "bt"), _grid(spark, d))


def _life(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.life_cycle(_pixels(spark, d), _grid(spark, d))


def _height(spark: SparkSession, d: str) -> int:
    return int(_voxels(spark, d).agg(F.max("y")).first()[0] or 0) + 1


def _slot(column: str = "ts"):
    return F.expr(f"cast((unix_seconds(cast({column} as timestamp)) - 1704067200) div 43200 as int)").alias("t")


_CLICK = "l AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT ts AS rts, min(event_id) AS matched FROM events WHERE event_type = 'view' GROUP BY 1)"


def _kind(spark, d, kind):
    return _read(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "ts")


# ---- scans, filters, crops -------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def period_filter(spark, d):
    return listing.in_period(_read(spark, d, "events"), "2024-01-05 00:00:00", "2024-01-10 12:00:00").select("event_id", "user_id", "value")


@query(f"WITH {V} SELECT min(t) AS t_min, max(t) AS t_max, count(*) AS n FROM v WHERE bt <= 236 AND t BETWEEN 4 AND 30")
def extract_volume(spark, d):
    images = _voxels(spark, d).withColumn("ts", adapters.slot_time())
    v = readers.volume(readers.read_images(images.withColumnRenamed("bt", "BT"), "ICON"), "2024-01-03 00:00:00", "2024-01-16 00:00:00", coldest=236)
    return v.agg((F.min("t") + 4).alias("t_min"), (F.max("t") + 4).alias("t_max"), F.count("*").alias("n"))


_PACK = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 1000 AS DOUBLE) * 0.01 + 200 END AS bt FROM events"


@query(_PACK)
def decode_packed(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, -32768).otherwise(F.col("event_id") % 1000)
    return _read(spark, d, "events").select("event_id", scalar.decode(raw, 0.01, 200.0, -32768).alias("bt"))


@query(f"WITH {V}, {G} SELECT y0, y1, x0, x1 FROM (SELECT min(y) AS y0, max(y) AS y1 FROM g WHERE lat BETWEEN -9.6 AND -7.4), (SELECT min(x) AS x0, max(x) AS x1 FROM g WHERE lon BETWEEN -18.2 AND -15.4)")
def crop_bbox(spark, d):
    return grid.crop_axes(_grid(spark, d), (-9.6, -7.4), (-18.2, -15.4))


@query(f"WITH {V}, {G} SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM g WHERE lat BETWEEN -9.6 AND -7.4 AND lon BETWEEN -18.2 AND -15.4")
def crop_rect_2d(spark, d):
    return grid.crop_mask(_grid(spark, d), (-9.6, -7.4), (-18.2, -15.4))


@query(f"WITH {V} SELECT t, y, x - 3 AS x, bt FROM v WHERE x BETWEEN 3 AND 9")
def crop_voxels(spark, d):
    bounds = spark.sql("select 0 as y0, 1000000 as y1, 3 as x0, 9 as x1")
    return grid.apply_crop(_voxels(spark, d), bounds)


#: Shapes of file names by order key; the time is that of the order's date, with its key as hour, minute and second.
_SHAPES_OF_NAMES = (
    ("mask_", "yyyyMMdd_HHmm", "%Y%m%d_%H%M", ".nc"), ("img_msg04_", "yyyyMMddHHmm", "%Y%m%d%H%M", ".nc"), ("x_", "yyyy-MM-dd'T'HH-mm-ss", "%Y-%m-%dT%H-%M-%S", ".nc"),
    ("", "yyyyMMdd'T'HHmm", "%Y%m%dT%H%M", ".nc4"), ("", "yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", ".nc4"), ("img", "yyyyMMddHHmmss", "%Y%m%d%H%M%S", "0.nc"), ("navigation_", "yyyy", "%Y", ".nc"),
)


def _filename_sql() -> str:
    names = " ".join(f"WHEN {k} THEN '{head}' || strftime(ts, '{form}') || '{end}'" for k, (head, _, form, end) in enumerate(_SHAPES_OF_NAMES))
    timed = "CASE o_orderkey % 7 WHEN 2 THEN s WHEN 5 THEN s WHEN 6 THEN NULL ELSE s // 60 * 60 END"  # names without seconds, and the one that loses them
    return f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_seconds(o_orderkey % 59) AS ts FROM orders)
SELECT path, {timed} AS s FROM (SELECT o_orderkey, epoch_us(ts) // 1000000 AS s, CASE o_orderkey % 7 {names} END AS path FROM o)"""


@query(_filename_sql())
def filename_datetime(spark, d):
    """Times in the names of files, one for each order."""
    key = F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(key % 24).cast("int"), mins=(key % 60).cast("int"), secs=(key % 59).cast("int"))
    name = F.lit(None).cast("string")
    for k, (head, form, _, end) in enumerate(_SHAPES_OF_NAMES):
        name = F.when(key % len(_SHAPES_OF_NAMES) == k, F.concat(F.lit(head), F.date_format(ts, form), F.lit(end))).otherwise(name)
    return _read(spark, d, "orders").select(name.alias("path")).select("path", F.unix_seconds(filetime.file_time(F.col("path"))).alias("s"))


@query("""SELECT * FROM (SELECT 'size' || p_partkey AS key, CAST(p_size AS VARCHAR) AS value, 'int' AS kind FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT 'price', CAST(CAST(p_partkey % 1000 AS DOUBLE) / 8 AS VARCHAR), 'float' FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT 'name' || p_partkey, p_name, 'string' FROM part WHERE p_partkey % 6 = 2
UNION ALL SELECT 'eq', 'a=' || p_partkey, 'string' FROM part WHERE p_partkey % 6 = 3)""")
def param_parse(spark, d):
    """Lines of parameters made of the parts: numbers with leading zeros, decimals, quoted names, values that hold the sign; comments and lines without one are skipped."""
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("  size"), key, F.lit(" = 00"), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("price = "), (F.col("p_partkey") % 1000 / 8).cast("string")))
    line = line.when(k == 2, F.concat(F.lit("name"), key, F.lit("='"), F.col("p_name"), F.lit("' "))).when(k == 3, F.concat(F.lit("eq = a="), key))
    line = line.when(k == 4, F.concat(F.lit("; size = "), key)).otherwise(F.concat(F.lit("no pair "), key))
    return config.parse_lines(_read(spark, d, "part").select(line.alias("value")))


@query(f"WITH {V} SELECT t, y, x, bt FROM v WHERE t BETWEEN 20 AND 33 AND y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 14")
def grid_files(spark, d):
    """The event volume as packed gridded files, one a slot, read back by time, row and column; files of other slots are not opened."""
    v = _voxels(spark, d).withColumn("ts", adapters.slot_time())
    root = _folder(spark, "grids")
    images = v.select(scalar.slot_path(root, "1", F.lit("EVENTS"), F.lit("bt_"), F.col("ts")).alias("path"), "ts", "y", "x", F.col("bt").alias("value"))
    gridfiles.write_grids(images, root, "Harmonized_irBT", type="int", scale=0.01, offset=100, fill=-32768)
    back = gridfiles.read_platform_grids(spark, root, "MSG", start="2024-01-11 00:00:00", end="2024-01-17 12:00:00", y0=2, y1=5, x0=3)
    return back.where("bt is not null").select(_slot(), "y", "x", F.round("bt", 2).alias("bt"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {V} SELECT DISTINCT t FROM v WHERE t BETWEEN 20 AND 33")
def period_files(spark, d):
    """Slots of the files of a period, by the times in their names."""
    v, root = _voxels(spark, d).withColumn("ts", adapters.slot_time()), _folder(spark, "files")
    images = v.select(scalar.slot_path(root, "1", F.lit("EVENTS"), F.lit("bt_"), F.col("ts")).alias("path"), "ts", "y", "x", F.col("bt").alias("value"))
    gridfiles.write_grids(images, root, "BT", type="float", fill=-1)
    return listing.period_files(spark, root, "2024-01-11 00:00:00", "2024-01-17 12:00:00").select(_slot())


@query(f"WITH {V} SELECT t, y, x, CAST(1 + y // 5 * 3 + x // 5 AS INT) AS label FROM v WHERE bt <= 190")
def label_image_files(spark, d):
    """Label images written as one file a slot with their metadata, and read back."""
    v, root = _voxels(spark, d).withColumn("ts", adapters.slot_time()), _folder(spark, "masks")
    labels = v.where("bt <= 190").select("ts", "y", "x", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)").alias("label"))
    sinks.write_label_images(labels, _grid(spark, d), v.select("ts"), root, "1", "EVENTS", "mask_", scan_minutes=720)
    back = gridfiles.read_grids(spark, root, sinks.LABEL_VARIABLE).where("value is not null")
    return back.select(_slot(), "y", "x", F.col("value").cast("int").alias("label"))


@query(f"WITH {V}, {G}, b AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM g WHERE lat BETWEEN -10.2 AND -7.4 AND lon BETWEEN -18.2 AND -15.4) SELECT y - y0 AS y, x - x0 AS x, round(lat, 4) AS lat, round(lon, 4) AS lon FROM g, b WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")
def written_grid(spark, d):
    """The cropped grid as a run leaves it."""
    path = _folder(spark, "grid")
    sinks.write_grid(segment.cropped(_voxels(spark, d), _grid(spark, d), (-10.2, -7.4), (-18.2, -15.4))[1], path)
    return spark.read.parquet(path).select("y", "x", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("""SELECT 'MSGnative' AS platform, CAST(event_id AS INT) AS y, CASE WHEN event_id % 1000 <> 7 THEN round(event_id % 1000 * 0.01 + 200, 4) END AS bt FROM events
UNION ALL SELECT 'MSG', CAST(event_id AS INT), CASE WHEN event_id % 1000 <> 7 THEN round(event_id % 1000 * 0.25, 4) END FROM events
UNION ALL SELECT 'ARPEGE', CAST(event_id AS INT), round(180 + value, 4) FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 'ICON', CAST(event_id AS INT), round(180 + value, 4) FROM events""")
def platform_readers(spark, d):
    """Packed, levelled and plain images of four platforms, dimension names in any case."""
    e = _read(spark, d, "events").select("ts", F.col("event_id").alias("Lat"), F.lit(0).alias("LON"), (F.col("event_id") % 2).alias("spec"), (F.col("event_id") % 1000).cast("int").alias("raw"), (180 + F.col("value")).alias("BT"))
    packed = {"MSGnative": ("IR_108", {"scale": 0.01, "offset": 200.0}), "MSG": ("Harmonized_irBT", {"scale": 0.25})}
    parts = [readers.read_images(e.drop("BT", "spec").withColumnRenamed("raw", n), p, fill=7, **how).withColumn("platform", F.lit(p)) for p, (n, how) in packed.items()]
    parts += [readers.read_images(e.drop("raw"), p).withColumn("platform", F.lit(p)) for p in ("ARPEGE", "ICON")]
    return reduce(DataFrame.unionByName, parts).select("platform", "y", F.round("bt", 4).alias("bt"))


# ---- scalar functions ------------------------------------------------------------------------


@query("SELECT event_id, round(pow(b, 2) * 0.00443828 - b * 0.543846 + 129.544, 4) AS bt FROM (SELECT event_id, pow((100 + value) / 5.670374419e-8, 0.25) AS b FROM events)")
def olr_to_irbt(spark, d):
    return _read(spark, d, "events").select("event_id", F.round(scalar.olr_to_bt(100 + F.col("value")), 4).alias("bt"))


@query(f"WITH {V} SELECT t, y, x, CAST(trunc(CAST(bt AS FLOAT) * CAST(100 AS FLOAT)) AS INT) AS q FROM v")
def quantise_bt(spark, d):
    return _voxels(spark, d).select("t", "y", "x", scalar.centikelvin(F.col("bt")).alias("q"))


@query(f"WITH {V}, h AS (SELECT max(y) + 1 AS ny FROM v) SELECT CAST(t AS BIGINT) * ny * 15 + y * 15 + x AS id, t, y, x FROM v, h")
def voxel_round_trip(spark, d):
    """The linear index of the table's own height, and the position that it leads back to."""
    ny = _height(spark, d)
    t, y, x = scalar.voxel_position(F.col("id"), ny, 15)
    return _voxels(spark, d).select(scalar.voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, 15).alias("id")).select("id", t.alias("t"), y.alias("y"), x.alias("x"))


@query("SELECT c_custkey, round((lon - 10.5) * 111 * cos(radians(5.25)), 6) AS east, round((lat - 5.25) * 111, 6) AS north FROM (SELECT c_custkey, (c_custkey % 120) - 60.0 AS lat, (c_custkey % 350) - 175.0 AS lon FROM customer)")
def local_projection(spark, d):
    at = _read(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 120) - 60.0).alias("lat"), ((F.col("c_custkey") % 350) - 175.0).alias("lon"))
    east, north = scalar.local_km(F.col("lat"), F.col("lon"), F.lit(5.25), F.lit(10.5))
    return at.select("c_custkey", F.round(east, 6).alias("east"), F.round(north, 6).alias("north"))


@query("SELECT c_custkey, round(" + CHORD.format(a="lat", b="lat + 1.5", c="lon", d="lon + 2.25") + ", 5) AS km FROM (SELECT c_custkey, (c_custkey % 120) - 60.0 AS lat, (c_custkey % 350) - 175.0 AS lon FROM customer)")
def chord_distance(spark, d):
    lat, lon = F.col("c_custkey") % 120 - 60.0, F.col("c_custkey") % 350 - 175.0
    return _read(spark, d, "customer").select("c_custkey", F.round(scalar.chord_km(lat, lon, lat + 1.5, lon + 2.25), 5).alias("km"))


@query("SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 5) AS km FROM (SELECT c_custkey, pow(sin(radians(1.5) / 2), 2) + cos(radians(lat)) * cos(radians(lat + 1.5)) * pow(sin(radians(2.25) / 2), 2) AS h FROM (SELECT c_custkey, (c_custkey % 120) - 60.0 AS lat FROM customer))")
def haversine_distance(spark, d):
    lat, lon = F.col("c_custkey") % 120 - 60.0, F.lit(0.0)
    return _read(spark, d, "customer").select("c_custkey", F.round(scalar.great_circle_km(lat, lon, lat + 1.5, lon + 2.25), 5).alias("km"))


@query(f"WITH {V}, m AS (SELECT min(bt) AS lo, max(bt) AS hi FROM v) SELECT t, y, x, round((bt - lo) / (hi - lo + 1e-6), 6) AS bt_norm FROM v, m")
def normalise_bt(spark, d):
    return lifecycle.normalised_bt(_voxels(spark, d)).select("t", "y", "x", F.round("bt_norm", 6).alias("bt_norm"))


@query("SELECT o_orderkey, 'out/labels_2.08/AFRICA/' || strftime(o_orderdate, '%Y/%Y_%m_%d/') || 'mask_' || strftime(o_orderdate, '%Y%m%d_%H%M') || '.nc' AS path, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 + 1800 AS s FROM orders")
def slot_paths(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    path = scalar.slot_path("out", "2.08", F.lit("AFRICA"), F.lit("mask_"), ts)
    return _read(spark, d, "orders").select("o_orderkey", path.alias("path"), scalar.epoch_seconds(scalar.scan_end(ts, 30)).alias("s"))


@query("SELECT n_nationkey, list_aggregate(list_concat([0, 0], [n_nationkey, n_regionkey], [0]), 'string_agg', ',') AS padded FROM nation")
def pad_arrays(spark, d):
    values = F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"))
    return _read(spark, d, "nation").select("n_nationkey", F.array_join(scalar.padded(values, 2, 1, F.lit(0).cast("long")), ",").alias("padded"))


@query("SELECT event_id AS y, round(pow(b, 2) * 0.00443828 - b * 0.543846 + 129.544, 4) AS bt FROM (SELECT event_id, pow((90 + value) / 5.670374419e-8, 0.25) AS b FROM events WHERE event_id % 5 <> 0) UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def flux_reader(spark, d):
    raw = _read(spark, d, "events").select("ts", F.col("event_id").cast("int").alias("lat"), F.lit(0).alias("lon"), F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(90 + F.col("value")).alias("LWNTA"))
    return readers.read_images(raw, "SAM", fill=-1.0).select(F.col("y").cast("long").alias("y"), F.round("bt", 4).alias("bt"))


@query(f"WITH {V} SELECT DISTINCT t AS slot, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INTEGER) AS t FROM v WHERE t % 3 <> 1")
def slot_index(spark, d):
    images = _voxels(spark, d).where("t % 3 <> 1").withColumn("ts", adapters.slot_time())
    v = readers.volume(images, "2024-01-01 00:00:00", "2024-03-01 00:00:00")
    return v.select(F.expr("cast((unix_seconds(ts) - 1704067200) div 43200 as int)").alias("slot"), "t").distinct()


@query(f"WITH {_CLICK}, m AS (SELECT DISTINCT event_id FROM l JOIN r ON abs(epoch_us(l.ts) - epoch_us(rts)) <= 60000000) SELECT count(*) AS images, count(m.event_id) AS matched, count(*) - count(m.event_id) AS unmatched FROM l LEFT JOIN m USING (event_id)")
def asof_report(spark, d):
    m = joins.asof_nearest(_kind(spark, d, "click"), _kind(spark, d, "view"), 60, payload="event_id")
    return m.agg(F.count("*").alias("images"), F.count("matched").alias("matched"), F.count(F.when(F.col("matched").isNull(), 1)).alias("unmatched"))


# ---- neighbourhoods, components, seeds -------------------------------------------------------


@query(f"WITH {V}, {OFF}, c AS (SELECT * FROM v WHERE bt <= 190) SELECT a.t, a.y, a.x, o.k, b.t AS nt, b.y AS ny, b.x AS nx FROM c a, o, c b WHERE b.t = a.t + o.dt AND b.y = a.y + o.dy AND b.x = a.x + o.dx")
def neighbour_edges(spark, d):
    return neighbors.neighbours(_voxels(spark, d).where("bt <= 190")).select("t", "y", "x", "k", "nt", "ny", "nx")


@query(f"WITH {V}, c AS (SELECT * FROM v WHERE bt <= 195) SELECT a.t, a.y, a.x, count(b.t) AS n FROM c a LEFT JOIN c b ON abs(a.t - b.t) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND 2 AND abs(a.t - b.t) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def neighbour_degree_18(spark, d):
    return neighbors.degree(_voxels(spark, d).where("bt <= 195"), neighbors.EIGHTEEN)


@query(f"WITH {V}, {OFF}, c AS (SELECT * FROM v WHERE bt <= 195) SELECT a.t, a.y, a.x, count(b.t) AS n FROM c a CROSS JOIN o LEFT JOIN c b ON b.t = a.t + o.dt AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL")
def neighbour_degree(spark, d):
    return neighbors.degree(_voxels(spark, d).where("bt <= 195"))


@query(f"""WITH {V}, o(k, dt, dy, dx) AS (VALUES (0,0,0,0), (1,0,0,1), (2,0,0,-1), (3,0,1,-1), (4,0,1,0), (5,0,1,1), (6,0,-1,-1), (7,0,-1,0), (8,0,-1,1), (9,-1,0,0), (10,1,0,0)),
lab AS (SELECT t, y, x, 1 + y // 5 * 3 + x // 5 AS label FROM v WHERE bt > 190 AND bt <= 200),
f AS (SELECT a.t, a.y, a.x, label, min(k) AS k FROM v a, o, lab WHERE a.bt <= 200 AND lab.t = a.t + o.dt AND lab.y = a.y + o.dy AND lab.x = a.x + o.dx GROUP BY ALL)
SELECT t, y, x, string_agg(CAST(label AS VARCHAR), ',' ORDER BY k) AS labels, count(*) AS n_labels FROM f GROUP BY ALL""")
def labels_around(spark, d):
    v = _voxels(spark, d).where("bt <= 200")
    lab = v.where("bt > 190").withColumn("label", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)"))
    found = neighbors.labels_around(v, lab)
    return found.select("t", "y", "x", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.size("labels").cast("long").alias("n_labels"))


@query(f"WITH {V}, o(dy, dx) AS (VALUES (0,1),(0,-1),(1,-1),(1,0),(1,1),(-1,-1)), c AS (SELECT * FROM v WHERE bt <= 190) SELECT t, y, x FROM c a WHERE NOT EXISTS (SELECT 1 FROM o, c b WHERE b.t = a.t AND b.y = a.y + o.dy AND b.x = a.x + o.dx)")
def isolated_voxels(spark, d):
    return neighbors.isolated(_voxels(spark, d).where("bt <= 190"))


def _candidates(spark, d, ny):
    return _voxels(spark, d).where(seeds.candidates(200)).select("t", "y", "x", "bt", neighbors.is_edge(ny, 15).alias("edge"))


@query(f"WITH {V} SELECT t, y, x, bt, x IN (0, 14) OR y IN (0, (SELECT max(y) FROM v)) AS edge FROM v WHERE bt > 0 AND bt <= 200")
def seed_candidates_own_rim(spark, d):
    """The candidates with the rim of the table itself, whatever its height."""
    return _candidates(spark, d, _height(spark, d))


@query(f"WITH {V}, l AS (SELECT unnest(range(190, 237, 2)) AS threshold) SELECT CAST(threshold AS INT) AS threshold, CAST(least(threshold + 2, 235) AS INT) AS next, count(*) FILTER (bt <= threshold) AS n, count(*) FILTER (bt < threshold) AS n_below FROM l, v GROUP BY 1, 2")
def threshold_counts(spark, d):
    v, aggs = _voxels(spark, d), []
    steps = config.RunParams().ladder()
    for t, _ in steps:
        aggs += [F.count(F.when(F.col("bt") <= t, 1)).alias(f"n{t}"), F.count(F.when(F.col("bt") < t, 1)).alias(f"b{t}")]
    one = v.agg(*aggs)  # all thresholds in one pass
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(n).alias("next"), F.col(f"n{t}").alias("n"), F.col(f"b{t}").alias("n_below")) for t, n in steps])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _components(spark, d):
    cold = _voxels(spark, d).where("bt <= 190")
    return components.voxel_components(cold, ny=_height(spark, d), nx=15)


@query(RC + CC + " SELECT t, y, x, row_number() OVER (PARTITION BY component ORDER BY t, y, x) = 1 AS is_first, count(*) OVER (PARTITION BY component) AS size FROM cc JOIN c USING (id)")
def connected_components(spark, d):
    w = Window.partitionBy("component")
    return _components(spark, d).select("t", "y", "x", (F.row_number().over(w.orderBy("t", "y", "x")) == 1).alias("is_first"), F.count("*").over(w).alias("size"))


_RIM = f"""{V}, {OFF}, six(dy, dx) AS (VALUES (0,1),(0,-1),(1,-1),(1,0),(1,1),(-1,-1)), c AS (SELECT t, y, x, CAST(t AS BIGINT) * 100000 + y * 15 + x AS id FROM v WHERE bt <= 190),
 i AS (SELECT id FROM c WHERE x NOT IN (0, 14) AND y NOT IN (0, (SELECT max(y) FROM v)) AND EXISTS (SELECT 1 FROM six, c b WHERE b.t = c.t AND b.y = c.y + six.dy AND b.x = c.x + six.dx)),
 e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN i USING (id), o, c b WHERE b.t = a.t + o.dt AND b.y = a.y + o.dy AND b.x = a.x + o.dx), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(id, lab) AS (SELECT id, id FROM (SELECT id FROM i UNION SELECT b FROM e) UNION SELECT e2.b, r.lab FROM r JOIN e2 ON e2.a = r.id WHERE r.lab < e2.b), cc AS (SELECT id, min(lab) AS component FROM r GROUP BY 1)"""


@query(RC + _RIM + " SELECT t, y, x, count(*) OVER (PARTITION BY component) AS size FROM cc JOIN c USING (id)")
def components_own_rim(spark, d):
    """Components with scan rules and the rim of the table itself, whatever its height."""
    return _scanned(spark, d, _height(spark, d))


def _scanned(spark, d, rows):
    v = _voxels(spark, d).withColumn("label", F.lit(None).cast("int"))
    parts = components.voxel_components(v.where("bt <= 190"), _height(spark, d), 15, visits=seeds.visitors(v, 190, rows, 15))
    return parts.select("t", "y", "x", F.count("*").over(Window.partitionBy("component")).alias("size"))


def _frames(spark, d):
    return seeds.frame_areas(_components(spark, d).withColumn("area", F.lit(19.8)))


@query(RC + SEEDS + " SELECT t, CAST(area AS BIGINT) AS area, count(*) AS n FROM f GROUP BY ALL")
def seed_area_per_frame(spark, d):
    return _frames(spark, d).groupBy("t", F.col("area").cast("long").alias("area")).agg(F.count("*").alias("n"))


@query(RC + SEEDS + " SELECT t_min, t_max, CAST(span AS INT) AS span, CAST(total_area AS BIGINT) AS total_area, longest_run, duration, accepted, count(*) AS n FROM s GROUP BY ALL")
def seed_run_filter(spark, d):
    r = seeds.seed_records(_frames(spark, d), 19, 3)
    return r.groupBy("t_min", "t_max", "span", F.col("total_area").cast("long").alias("total_area"), "longest_run", "duration", "accepted").agg(F.count("*").alias("n"))


@query(RC + SEEDS + " SELECT CAST(1 + row_number() OVER (ORDER BY component) AS INT) AS label, t_min, t_max FROM s WHERE accepted")
def seed_renumber(spark, d):
    return seeds.numbered(seeds.seed_records(_frames(spark, d), 19, 3), 1).select("label", "t_min", "t_max")


def _tiled(spark, d):
    return _voxels(spark, d).where("bt <= 200").withColumn("label", F.expr("case when bt <= 186 then cast(1 + y div 5 * 3 + x div 5 as int) end"))


_TILED = f"{V}, {OFF}, w AS (SELECT *, CASE WHEN bt <= 186 THEN 1 + y // 5 * 3 + x // 5 END AS label, CAST(trunc(CAST(bt AS FLOAT) * CAST(100 AS FLOAT)) AS INT) AS q FROM v WHERE bt <= 200)"


@query(f"WITH {_TILED} SELECT b.t, b.y, b.x, CAST(arg_min(a.label, (CAST(a.t AS BIGINT) * 100000 + a.y * 15 + a.x) * 10 + k) AS INT) AS label FROM w a, o, w b WHERE a.label IS NOT NULL AND b.label IS NULL AND b.t = a.t + o.dt AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.q + 100 >= a.q GROUP BY ALL")
def grow_one_level(spark, d):
    v = _tiled(spark, d)
    start = growth.start_frontier(v.where("label is not null"), _height(spark, d), 15)
    free = v.where("label is null").select("t", "y", "x", scalar.centikelvin(F.col("bt")).alias("q"))
    return growth.grow_level(start, free, 1.0).select("t", "y", "x", "label")


#: Level by level: the least path (source, then neighbour numbers) that reaches a voxel wins, as in a queue.
_GROWN = f"""WITH RECURSIVE {_TILED.replace("w AS (SELECT *,", "w AS (SELECT *, CAST(t AS BIGINT) * 100000000 + y * 15 + x AS id,")},
 r(id, t, y, x, q, label, path) USING KEY (id) AS (SELECT id, t, y, x, q, label, printf('%016d', id) FROM w WHERE label IS NOT NULL
 UNION SELECT b.id, any_value(b.t), any_value(b.y), any_value(b.x), any_value(b.q), arg_min(r.label, r.path || CAST(k AS VARCHAR)), min(r.path || CAST(k AS VARCHAR))
 FROM r, o, w b WHERE b.label IS NULL AND b.t = r.t + o.dt AND b.y = r.y + o.dy AND b.x = r.x + o.dx AND b.q + 100 >= r.q AND b.id NOT IN (SELECT id FROM recurring.r) GROUP BY b.id)
 SELECT w.t, w.y, w.x, w.bt, CAST(r.label AS INT) AS label FROM w LEFT JOIN r USING (id)"""


@query(_GROWN)
def grow_full(spark, d):
    """Growth to the end."""
    return growth.grow(_tiled(spark, d), F.col("bt") <= 200, 1.0, _height(spark, d), 15)


@query(RC + CC + ", lab AS (SELECT t, y, x, 1 + y // 5 * 3 + x // 5 AS label FROM v WHERE bt > 190 AND bt <= 192) SELECT CAST(min(label) AS INT) AS absorb_to, arg_min(c.t, c.id) AS t, arg_min(c.y, c.id) AS y, arg_min(c.x, c.id) AS x FROM cc JOIN c USING (id), o, lab WHERE lab.t = c.t + o.dt AND lab.y = c.y + o.dy AND lab.x = c.x + o.dx GROUP BY component")
def seed_absorb(spark, d):
    v = _voxels(spark, d)
    parts = _components(spark, d)
    fixed = v.where("bt > 190 and bt <= 192").withColumn("label", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)")).select("t", "y", "x", "label")
    to = seeds.absorbing(parts, fixed)
    touching = neighbors.neighbours(parts, fixed).join(parts, ["t", "y", "x"]).groupBy("component").agg(F.min(F.struct("t", "y", "x")).alias("f"))
    return to.join(touching, "component").select("absorb_to", "f.t", "f.y", "f.x")


def _event_volume(spark, d):
    return _voxels(spark, d).withColumn("area", F.lit(19.8))


@query()
def label_ladder(spark, d):
    """The whole ladder (24 thresholds, canonical seeds, one volume) over all events; the tests compare it with a plain model."""
    seg = ladder.detect_and_spread(_event_volume(spark, d), config.RunParams(), _height(spark, d), adapters.WIDTH)
    return seg.voxels.where("label is not null").select("t", "y", "x", "label")


#: Accepted seeds by their labels.
_NUMBERED = f"{SEEDS}, n AS (SELECT component, CAST(1 + row_number() OVER (ORDER BY component) AS INT) AS label FROM s WHERE accepted)"
#: A ladder of one threshold.
ONE_STEP = config.RunParams(min_bt=190, max_bt=190, min_area_seed=19, min_lifetime=3)


def _one_step(spark, d):
    return ladder.detect_and_spread(_event_volume(spark, d), ONE_STEP, _height(spark, d), adapters.WIDTH)


@query(RC + _NUMBERED + " SELECT c.t, c.y, c.x, label FROM cc JOIN c USING (id) JOIN n USING (component)")
def ladder_one_step(spark, d):
    """The ladder's whole run at one threshold: grown, detected, filtered, numbered, grown again."""
    return _one_step(spark, d).voxels.where("label is not null").select("t", "y", "x", "label")


@query(RC + _NUMBERED + " SELECT label, f.t, CAST(f.area AS BIGINT) AS area FROM f JOIN n USING (component)")
def seed_frames(spark, d):
    """Areas of the accepted seeds by slot."""
    return _one_step(spark, d).frames.select("label", "t", "area")


@query()
def label_ladder_scan(spark, d):
    """The whole ladder in the exact scan mode, whose seeds depend on the order of one scan; the tests compare it with a plain model."""
    seg = ladder.detect_and_spread(_event_volume(spark, d), config.RunParams(exact_scan=True), _height(spark, d), adapters.WIDTH, divided=True)
    return seg.voxels.where("label is not null").select("t", "y", "x", "label")


#: Slots of a chunk, and those shared with the one before: the sixty slots of the events make four chunks.
CHUNKED = config.RunParams(volume_slots=24, overlap_slots=8)


@query()
def label_ladder_chunks(spark, d):
    """The same ladder in overlapping chunks, whose labels are carried on."""
    v = _event_volume(spark, d)
    slots = int(v.agg(F.max("t")).first()[0] or 0) + 1
    return ladder.run_chunks(v, CHUNKED, _height(spark, d), adapters.WIDTH, slots)


@query()
def label_ladder_stitched(spark, d):
    """The chunks segmented apart, all in one run, and their labels joined up by what they share in the overlaps."""
    v = _event_volume(spark, d)
    slots = int(v.agg(F.max("t")).first()[0] or 0) + 1
    return ladder.run_chunks_apart(v, CHUNKED, _height(spark, d), adapters.WIDTH, slots)


# ---- chunks and joins ------------------------------------------------------------------------


def _chunk_sql(z: int, o: int) -> str:
    """Chunks of the slots in ``v``, up to its last one."""
    return f"SELECT t, CAST(k AS INT) AS chunk FROM (SELECT DISTINCT t FROM v) s, (SELECT max(t) AS e FROM v) l, (SELECT unnest(range(1000)) AS k) c WHERE t BETWEEN k * {z - o} AND least(k * {z - o} + {z - 1}, e) AND ((k = 0 AND e > 0) OR (k >= 1 AND k * {z - o} + {o} < e))"


def _chunks(spark, d):
    slots = _voxels(spark, d).select("t").distinct()
    return joins.assign_chunks(slots, 12, 3, int(slots.agg(F.max("t")).first()[0] or 0))


@query(f"WITH {V} {_chunk_sql(12, 3)}")
def chunk_assign(spark, d):
    return _chunks(spark, d)


@query(f"WITH {V}, s AS (SELECT DISTINCT 1 + y // 5 * 3 + x // 5 AS label FROM v WHERE bt <= 185) SELECT CAST(label AS BIGINT) AS label FROM s WHERE label IN (SELECT 1 + y // 5 * 3 + x // 5 FROM v WHERE t >= 55 AND bt <= 185)")
def overlap_semi_join(spark, d):
    v = _voxels(spark, d).where("bt <= 185").select("t", F.expr("1 + y div 5 * 3 + x div 5").alias("label"))
    return joins.still_present(v.select("label").distinct(), v.where("t >= 55"))


@query(f"WITH {V}, s AS (SELECT DISTINCT 1 + y // 5 * 3 + x // 5 AS label FROM v WHERE bt <= 185), o AS (SELECT DISTINCT 1 + y // 5 * 3 + x // 5 AS label FROM v WHERE t >= 55 AND bt <= 185) SELECT CAST(label AS BIGINT) AS label, CAST(label - (SELECT min(label) FROM o) AS BIGINT) AS index FROM s SEMI JOIN o USING (label)")
def overlap_rebased(spark, d):
    v = _voxels(spark, d).where("bt <= 185").select("t", F.expr("1 + y div 5 * 3 + x div 5").alias("label"))
    return joins.rebased(v.select("label").distinct(), v.where("t >= 55"))


@query(f"WITH {V}, c AS ({_chunk_sql(12, 3)}) SELECT t, y, x, max(chunk) AS chunk FROM v JOIN c USING (t) WHERE bt <= 190 GROUP BY ALL")
def last_chunk_wins(spark, d):
    v = _voxels(spark, d).where("bt <= 190").join(_chunks(spark, d), "t").withColumn("ts", F.col("t"))
    return sinks.last_chunk_wins(v).select("t", "y", "x", "chunk")


@query(f"WITH {_CLICK}, m AS (SELECT event_id, r.matched, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(rts)), rts) AS n FROM l JOIN r ON abs(epoch_us(l.ts) - epoch_us(rts)) <= 60000000) SELECT l.event_id, m.matched FROM l LEFT JOIN m ON m.event_id = l.event_id AND n = 1")
def asof_nearest(spark, d):
    return joins.asof_nearest(_kind(spark, d, "click"), _kind(spark, d, "view"), 60, payload="event_id").select("event_id", "matched")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts NOT IN (SELECT ts FROM events WHERE event_type = 'click')")
def asof_unused_anti(spark, d):
    return joins.unused(_kind(spark, d, "view"), _kind(spark, d, "click")).select("event_id")


@query(f"WITH {V}, s AS (SELECT CAST(unnest(range(60)) AS INT) AS t), f AS (SELECT t, min(y * 15 + x) AS path FROM v WHERE t % 3 = 0 AND bt <= 181 GROUP BY 1) SELECT s.t AS ts, f.path FROM s LEFT JOIN f USING (t)")
def exact_time_lookup(spark, d):
    files = _voxels(spark, d).where("t % 3 = 0 and bt <= 181").select(F.col("t").alias("ts"), F.expr("y * 15 + x").alias("path"))
    return listing.at_exact_time(files, spark.range(60).select(F.col("id").cast("int").alias("ts")))


@query(f"WITH {P} SELECT t, y, x, label, bt, round(lat, 4) AS lat, round(lon, 4) AS lon FROM p")
def label_bt_grid_join(spark, d):
    return _pixels(spark, d).select(_slot(), "y", "x", "label", "bt", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(f"WITH {V} SELECT a.t, a.y, a.x, CASE WHEN b.bt <= 185 THEN 1 + a.x // 5 END AS label FROM v a LEFT JOIN v b ON a.t = b.t AND a.y = b.y AND a.x = b.x AND b.t < 10 WHERE a.bt <= 190 AND a.t < 20")
def label_carry_over(spark, d):
    v = _voxels(spark, d)
    old = v.where("bt <= 185 and t < 10").select("t", "y", "x", F.expr("cast(1 + x div 5 as int)").alias("label"))
    return joins.carried_over(v.where("bt <= 190 and t < 20"), old).select("t", "y", "x", "label")


# ---- statistics ------------------------------------------------------------------------------


@query(f"WITH {P} SELECT label, count(*) AS n FROM p GROUP BY 1")
def cluster_sizes(spark, d):
    return lifecycle.label_sizes(_pixels(spark, d))


@query(f"WITH {V} SELECT min(bt) AS bt_min, max(bt) AS bt_max FROM v")
def bt_range(spark, d):
    return lifecycle.bt_range(_voxels(spark, d))


@query(f"WITH {P} SELECT t, round(sum(area), 4) AS area FROM p GROUP BY 1")
def area_per_timestep(spark, d):
    return lifecycle.area_per_slot(_pixels(spark, d).withColumn("t", _slot())).select("t", F.round("area", 4).alias("area"))


@query(f"WITH {LC} SELECT label, t, n, cy, cx, round(lat, 4) AS lat, round(lon, 4) AS lon FROM lc")
def label_centroid(spark, d):
    return _life(spark, d).select("label", _slot(), "n", "cy", "cx", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(f"WITH {LC} SELECT label, t, " + ", ".join(f"CAST(p{k} AS INT) AS pix_{k}, round(k{k}, 4) AS km2_{k}" for k in (235, 220, 210, 200)) + " FROM lc")
def cold_surfaces(spark, d):
    return _life(spark, d).select("label", _slot(), *[f"pix_{k}" for k in lifecycle.SURFACES], *[F.round(f"km2_{k}", 4).alias(f"km2_{k}") for k in lifecycle.SURFACES])


@query(f"WITH {LC} SELECT label, t, tbmin, round(tb90, 4) AS tb90 FROM lc")
def tb_min_p90(spark, d):
    life = lifecycle.life_cycle(_pixels(spark, d), _grid(spark, d), by_rank=True)
    return life.select("label", _slot(), "tbmin", F.round("tb90", 4).alias("tb90"))


@query(f"WITH {LC} SELECT label, t, round(a235, 6) AS tbavg_235, round(a208, 6) AS tbavg_208, round(a200, 6) AS tbavg_200 FROM lc")
def tb_avg_thresholds(spark, d):
    return _life(spark, d).select("label", _slot(), *[F.round(f"tbavg_{k}", 6).alias(f"tbavg_{k}") for k in lifecycle.MEANS])


def _ellipse_tables(k: int, s: str = "") -> str:
    """Tables c to h: the pixels up to ``k``, the cell of their mean position, their places in km around it, covariances, principal axes."""
    return f"""c{s} AS (SELECT * FROM p WHERE bt <= {k}), m{s} AS (SELECT label, t, count(*) AS n, CAST(trunc(avg(y)) AS INT) AS y0, CAST(trunc(avg(x)) AS INT) AS x0 FROM c{s} GROUP BY ALL),
 km{s} AS (SELECT c.label, c.t, n, (c.lon - g.lon) * 111 * cos(radians(g.lat)) AS xk, (c.lat - g.lat) * 111 AS yk FROM c{s} c JOIN m{s} USING (label, t) JOIN g ON g.y = y0 AND g.x = x0),
 e{s} AS (SELECT label, t, var_samp(xk) AS sxx, var_samp(yk) AS syy, covar_samp(xk, yk) AS sxy FROM km{s} WHERE n >= 5 GROUP BY ALL), h{s} AS (SELECT *, (sxx + syy) / 2 AS m, sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy) AS r FROM e{s})"""


def _ellipse_sql(k: int) -> str:
    return f"""WITH {LC}, {_ellipse_tables(k)}
 SELECT lc.label, lc.t, round(2 * sqrt(m + r), 4) AS semimajor, CASE WHEN m IS NOT NULL THEN round(2 * sqrt(greatest(m - r, 0)), 3) END AS semiminor FROM lc LEFT JOIN h USING (label, t)"""


def _ellipse(spark, d, k):
    return _life(spark, d).select("label", _slot(), F.round(f"semimajor_{k}", 4).alias("semimajor"), F.round(f"semiminor_{k}", 3).alias("semiminor"))


@query(_ellipse_sql(235))
def ellipse_235(spark, d):
    return _ellipse(spark, d, 235)


@query(_ellipse_sql(220))
def ellipse_220(spark, d):
    return _ellipse(spark, d, 220)


def _shape_sql(k: int) -> str:
    """The ratio of the axes and the direction of the longer one; a shape that is a circle or a line to rounding has neither."""
    e = _ellipse_sql(k)
    head = e[: e.index("\n SELECT lc.label")]
    return f"{head} SELECT lc.label, lc.t, CASE WHEN m - r > 1e-3 THEN round(sqrt((m - r) / (m + r)), 4) END AS ratio, CASE WHEN r > 1e-3 AND abs(sxy) > 1e-6 THEN round(degrees(atan2(2 * sxy, sxx - syy) / 2), 3) END AS orientation FROM lc LEFT JOIN h USING (label, t)"


def _shape(spark, d, k):
    major, minor = F.col(f"semimajor_{k}"), F.col(f"semiminor_{k}")
    ratio = F.when(F.pow(minor / 2, F.lit(2)) > 1e-3, F.round(f"ratio_{k}", 4)).alias("ratio")
    r = (F.pow(major / 2, F.lit(2)) - F.pow(minor / 2, F.lit(2))) / 2
    turned = F.abs(F.sin(F.radians(2 * F.col(f"orientation_{k}"))) * r) > 1e-6
    return _life(spark, d).select("label", _slot(), ratio, F.when((r > 1e-3) & turned, F.round(f"orientation_{k}", 3)).alias("orientation"))


@query(_shape_sql(235))
def ellipse_shape_235(spark, d):
    return _shape(spark, d, 235)


@query(_shape_sql(220))
def ellipse_shape_220(spark, d):
    return _shape(spark, d, 220)


@query(f"WITH {LC} SELECT label, t, round(coalesce(1000 * " + CHORD.format(a="plat", b="lat", c="plon", d="lon") + f" / nullif(s - ps, 0), -999), 6) AS velocity FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(s) OVER w AS ps FROM lc WINDOW w AS (PARTITION BY label ORDER BY t))")
def inst_velocity(spark, d):
    return lifecycle.with_velocity(_life(spark, d)).select("label", _slot(), F.round("velocity", 6).alias("velocity"))


_INT = f"""{LC}, i AS (SELECT label, CAST(count(*) * 12 AS DOUBLE) AS duration_hours, min(s) AS utc_init, max(s) AS utc_end, arg_min(lon, s) AS lon_init, arg_min(lat, s) AS lat_init, arg_max(lon, s) AS lon_end, arg_max(lat, s) AS lat_end,
 min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max, min(tbmin) AS tb_min, max(k235) AS m235, max(k220) AS m220, max(k210) AS m210, max(k200) AS m200, sum(k235) AS c235 FROM lc GROUP BY 1)"""


@query(f"WITH {_INT} SELECT label, duration_hours, utc_init, utc_end, tb_min, round(m235, 4) AS surfmax_235, round(m220, 4) AS surfmax_220, round(m210, 4) AS surfmax_210, round(m200, 4) AS surfmax_200, round(c235, 3) AS surfcum_235, round({CHORD.format(a='lat_init', b='lat_end', c='lon_init', d='lon_end')}, 5) AS distance_km, round({CHORD.format(a='lat_init', b='lat_end', c='lon_init', d='lon_end')} * 1000 / (duration_hours * 3600), 6) AS velocity_ms, 11100 AS quality, -999 AS class_a FROM i")
def int_summary(spark, d):
    s = lifecycle.summary(_life(spark, d), 720)
    return s.select("label", "duration_hours", "utc_init", "utc_end", "tb_min", *[F.round(f"surfmax_{k}", 4).alias(f"surfmax_{k}") for k in lifecycle.SURFACES], F.round("surfcum_235", 3).alias("surfcum_235"), F.round("distance_km", 5).alias("distance_km"), F.round("velocity_ms", 6).alias("velocity_ms"), "quality", "class_a")


@query(f"WITH {_INT} SELECT label, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("lon_init", "lat_init", "lon_end", "lat_end", "lon_min", "lon_max", "lat_min", "lat_max")) + " FROM i")
def int_bbox(spark, d):
    return lifecycle.summary(_life(spark, d), 720).select("label", *[F.round(c, 4).alias(c) for c in ("lon_init", "lat_init", "lon_end", "lat_end", "lon_min", "lon_max", "lat_min", "lat_max")])


@query(f"WITH {_INT} SELECT label AS DCS_number, duration_hours AS INT_duration, utc_init AS INT_UTC_timeInit, 11100 AS QCgeo_DCS FROM i")
def published_summary(spark, d):
    return sinks.published(lifecycle.summary(_life(spark, d), 720)).select("DCS_number", "INT_duration", "INT_UTC_timeInit", "QCgeo_DCS")


_SYSTEMS = {
    "label": "INT_DCSnumber", "11100": "INT_DCS_qualitycontrol", "duration_hours": "INT_duration", "utc_init": "INT_UTC_timeInit", "utc_end": "INT_UTC_timeEnd",
    "round(lon_init, 4)": "INT_lonInit", "round(lat_init, 4)": "INT_latInit", "round(lon_end, 4)": "INT_lonEnd", "round(lat_end, 4)": "INT_latEnd",
    f"round({CHORD.format(a='lat_init', b='lat_end', c='lon_init', d='lon_end')} * 1000 / (duration_hours * 3600), 6)": "INT_velocityAvg", f"round({CHORD.format(a='lat_init', b='lat_end', c='lon_init', d='lon_end')}, 5)": "INT_distance",
    "round(lon_min, 4)": "INT_lonmin", "round(lon_max, 4)": "INT_lonmax", "round(lat_min, 4)": "INT_latmin", "round(lat_max, 4)": "INT_latmax", "tb_min": "INT_tbmin",
    "round(m235, 4)": "INT_surfmaxkm2_235K", "round(m220, 4)": "INT_surfmaxkm2_220K", "round(m210, 4)": "INT_surfmaxkm2_210K", "round(m200, 4)": "INT_surfmaxkm2_200K", "round(c235, 3)": "INT_surfcumkm2_235K",
}
_UNKNOWN = ("INT_classif", "INT_classif_JIRAK", "INT_classif_MADDOX", "INT_TS_number_IBTRACS", "INT_TS_nature_IBTRACS", "INT_TS_mindistance_IBTRACS")
_PLACES = {"INT_lonInit": 4, "INT_latInit": 4, "INT_lonEnd": 4, "INT_latEnd": 4, "INT_velocityAvg": 6, "INT_distance": 5, "INT_lonmin": 4, "INT_lonmax": 4, "INT_latmin": 4, "INT_latmax": 4, "INT_surfcumkm2_235K": 3} | {f"INT_surfmaxkm2_{k}K": 4 for k in (235, 220, 210, 200)}


def _rounded(df, places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def _tracked(spark, d):
    """The end-to-end run over the events as images, with tiles as label images."""
    v = _voxels(spark, d).withColumn("ts", adapters.slot_time())
    labels = v.where("bt <= 235").select("ts", "y", "x", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)").alias("label"))
    return track.track(labels, v.select("ts", "y", "x", "bt"), _grid(spark, d), "2000-01-01 00:00:00", "2100-01-01 00:00:00", 720)


@query(f"WITH {_INT} SELECT " + ", ".join(f"{e} AS {n}" for e, n in _SYSTEMS.items()) + ", " + ", ".join(f"-999 AS {n}" for n in _UNKNOWN) + " FROM i")
def tracked_systems(spark, d):
    return _rounded(sinks.published_systems(_tracked(spark, d)[0]), _PLACES)


_CYCLE = {
    "tbmin": "LC_tbmin", "round(a235, 6)": "LC_tbavg_235K", "round(a208, 6)": "LC_tbavg_208K", "round(a200, 6)": "LC_tbavg_200K", "round(tb90, 4)": "LC_tb90th", "s": "LC_UTC_time", "round(lon, 4)": "LC_lon", "round(lat, 4)": "LC_lat",
    "cx": "LC_x", "cy": "LC_y", "round(velocity, 6)": "LC_velocity", "p235": "LC_surfPix_235K", "p210": "LC_surfPix_210K", "round(k235, 4)": "LC_surfkm2_235K", "round(k220, 4)": "LC_surfkm2_220K", "round(k210, 4)": "LC_surfkm2_210K", "round(k200, 4)": "LC_surfkm2_200K",
}
_SHAPES = [f"LC_{n}_{k}K" for k in (235, 220) for n in ("semiminor", "semimajor", "ecc", "orientation")]
_VEL = f"lv AS (SELECT *, coalesce(1000 * {CHORD.format(a='plat', b='lat', c='plon', d='lon')} / nullif(s - ps, 0), -999) AS velocity FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(s) OVER w AS ps FROM lc WINDOW w AS (PARTITION BY label ORDER BY t)))"


@query(f"WITH {LC}, {_VEL} SELECT l.label AS DCS, a.s AS time, 1 AS QCgeo_IRimage, " + ", ".join(f"CAST(coalesce({e}, -999) AS DOUBLE) AS {n}" for e, n in ({k.replace("lon,", "lv.lon,").replace("lat,", "lv.lat,"): v for k, v in _CYCLE.items()} | {"lv.s": "LC_UTC_time"}).items() if e != "s") + ", " + ", ".join(f"CAST(-999 AS DOUBLE) AS {n}" for n in _SHAPES) + " FROM (SELECT DISTINCT label FROM lc) l CROSS JOIN (SELECT DISTINCT t, s FROM lc) a LEFT JOIN lv ON lv.label = l.label AND lv.t = a.t")
def tracked_cycle(spark, d):
    places = {"LC_tbavg_235K": 6, "LC_tbavg_208K": 6, "LC_tbavg_200K": 6, "LC_tb90th": 4, "LC_lon": 4, "LC_lat": 4, "LC_velocity": 6} | {f"LC_surfkm2_{k}K": 4 for k in (235, 220, 210, 200)}
    return _rounded(sinks.published_cycle(_tracked(spark, d)[1]), places)


def _published_shapes_sql() -> str:
    tables = ", ".join(_ellipse_tables(k, str(k)) for k in (235, 220))
    axes = ", ".join(f"coalesce(round(2 * sqrt(h{k}.m + h{k}.r), 3), -999) AS LC_semimajor_{k}K, coalesce(CASE WHEN h{k}.m IS NOT NULL THEN round(2 * sqrt(greatest(h{k}.m - h{k}.r, 0)), 2) END, -999) AS LC_semiminor_{k}K" for k in (235, 220))
    return f"WITH {LC}, {tables} SELECT l.label AS DCS, a.s AS time, {axes} FROM (SELECT DISTINCT label FROM lc) l CROSS JOIN (SELECT DISTINCT t, s FROM lc) a LEFT JOIN h235 ON h235.label = l.label AND h235.t = a.t LEFT JOIN h220 ON h220.label = l.label AND h220.t = a.t"


@query(_published_shapes_sql())
def tracked_shapes(spark, d):
    """The ellipses of the published life cycle, which fills them if asked to."""
    cycle = sinks.published_cycle(_tracked(spark, d)[1], ellipses=True)
    return _rounded(cycle, {f"LC_semimajor_{k}K": 3 for k in (235, 220)} | {f"LC_semiminor_{k}K": 2 for k in (235, 220)}).select("DCS", "time", *[f"LC_{c}_{k}K" for k in (235, 220) for c in ("semimajor", "semiminor")])


@query()
def segmented_images(spark, d):
    """The end-to-end run over the events as images: slots, chunks of the production length, the whole ladder."""
    v = _voxels(spark, d).withColumn("ts", adapters.slot_time())
    return segment.segment(v.select("ts", "y", "x", "bt"), _grid(spark, d), "2000-01-01 00:00:00", "2100-01-01 00:00:00")


@query(f"WITH {LC} SELECT l.label, a.t, coalesce(tbmin, -999) AS tbmin, CAST(coalesce(n, -999) AS DOUBLE) AS n FROM (SELECT DISTINCT label FROM lc) l CROSS JOIN (SELECT DISTINCT t FROM lc) a LEFT JOIN lc USING (label, t)")
def lc_dense_matrix(spark, d):
    return lifecycle.dense(_life(spark, d), ["tbmin", "n"]).select("label", _slot(), "tbmin", "n")


@query(f"WITH {V}, {G} SELECT s.t, g.y, g.x, CASE WHEN bt <= 190 THEN CAST(1 + g.y // 5 * 3 + g.x // 5 AS INT) ELSE -998 END AS label FROM (SELECT DISTINCT t FROM v) s CROSS JOIN g LEFT JOIN v ON v.t = s.t AND v.y = g.y AND v.x = g.x")
def label_fill_export(spark, d):
    v = _voxels(spark, d).withColumn("ts", adapters.slot_time())
    labels = v.where("bt <= 190").select("ts", "y", "x", F.expr("cast(1 + y div 5 * 3 + x div 5 as int)").alias("label"))
    return sinks.export_labels(labels, _grid(spark, d), v.select("ts")).select(_slot(), "y", "x", "label")


@query(f"WITH {P}, c AS (SELECT label, t, s, CAST(round_even(avg(y), 0) AS INT) AS cy, CAST(round_even(avg(x), 0) AS INT) AS cx, min(bt) AS tbmin, sum(area) AS km2 FROM p GROUP BY ALL), q AS (SELECT c.*, lat, lon FROM c JOIN g ON y = cy AND x = cx) SELECT label, count(*) AS n, CAST((max(s) - min(s)) / 3600 AS DOUBLE) AS duration_hours, min(tbmin) AS tb_min, round(max(km2), 3) AS surfmax, round(sum(km2), 3) AS surfcum FROM q GROUP BY 1 HAVING count(*) >= 2")
def legacy_tracker(spark, d):
    return lifecycle.online_tracks(_pixels(spark, d), _grid(spark, d)).select("label", "n", "duration_hours", "tb_min", F.round("surfmax", 3).alias("surfmax"), F.round("surfcum", 3).alias("surfcum"))


@query(f"WITH {P} SELECT label, CAST(s // 86400 * 86400 AS BIGINT) AS day, count(*) AS n, min(bt) AS tb_min, round(sum(area), 3) AS area FROM p GROUP BY ALL")
def slot_sums(spark, d):
    """The windowed sums of the stream, over a table."""
    return tracker.slot_sums(_pixels(spark, d)).select("label", scalar.epoch_seconds(F.col("window.start")).alias("day"), "n", "tb_min", F.round("area", 3).alias("area"))


@query(f"WITH {P} SELECT DISTINCT t FROM p")
def global_time_axis(spark, d):
    return lifecycle.time_axis(_pixels(spark, d)).select(_slot())


@query(f"WITH {V} SELECT min(y) AS y0, count(*) AS n FROM v WHERE -10 + 0.5 * y BETWEEN -9 AND -8 AND -20 + 0.5 * x BETWEEN -19 AND -15")
def latlon_subset(spark, d):
    v = _voxels(spark, d).withColumns({"lat": F.col("y") * 0.5 - 10, "lon": F.col("x") * 0.5 - 20})
    return grid.crop_box(v, (-8, -9), (-19, -15)).agg(F.min("y").alias("y0"), F.count("*").alias("n"))
