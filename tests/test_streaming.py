import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cirrostrat.config import RunParams
from cirrostrat.operators.lifecycle import dense, finish_tracks
from cirrostrat.operators.ranks import percentile_by_rank
from cirrostrat.sources import sinks
from cirrostrat.streaming.tracker import chunk_writer, closed_tracks, running_tracks
from tests.volumes import blob_voxels

SCHEMA = "label int, s string, lat double, lon double, tbmin double, km2 double"
ROWS = [
    (1, "2024-01-01 00:00:00", 0.0, 0.0, None, 5.0), (1, "2024-01-01 01:00:00", 0.5, 0.5, 190.0, 9.0), (2, "2024-01-01 01:00:00", 3.0, 3.0, 210.0, 1.0),
    (1, "2024-01-01 02:00:00", 1.0, 1.0, 205.0, None), (3, "2024-01-01 02:00:00", None, 2.0, None, None), (3, "2024-01-01 02:30:00", 4.0, None, None, None), (3, "2024-01-01 02:30:00", 4.0, 1.0, None, None),
]
#: A later system, and one far later that moves the watermark past all others.
LATER = [(4, "2024-01-01 03:00:00", 7.0, 7.0, 200.0, 2.0), (1, "2024-01-01 03:00:00", 2.0, 2.0, 201.0, 7.0), (4, "2024-01-01 03:30:00", 7.5, 7.0, 199.0, 3.0)]
LAST = [(99, "2024-02-01 00:00:00", 0.0, 0.0, 200.0, 1.0)]


def slots(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("label", "cast(s as timestamp) ts", "lat", "lon", "tbmin", "km2")


def fed(spark, tmp_path, parts, stream_of, mode, name):
    """What a query gives out over parts of its input, with a restart from its checkpoint before each."""
    out = []
    for k, rows in enumerate(parts):
        slots(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(slots(spark, rows).schema).parquet(str(tmp_path / "in"))

        def keep(batch, number):
            out.extend(batch.collect())

        q = stream_of(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
    return out


def test_running_tracks_equal_the_batch_summary(spark, tmp_path):
    got = {r.label: r for r in fed(spark, tmp_path, [ROWS[:3], ROWS[3:]], running_tracks, "update", "running")}
    want = {r.label: r for r in finish_tracks(slots(spark, ROWS)).collect()}
    assert got[1].n == 3 and got[2].n == 1 and set(want) == {1, 3}
    for name, w in want.items():
        assert (got[name].n, got[name].tb_min, got[name].surfcum, got[name].surfmax, got[name].first_lat, got[name].last_lon) == (w.n, w.tb_min, w.surfcum, w.surfmax, w.lat_init, w.lon_end)
    assert got[1].tb_min == 190.0 and got[3].tb_min is None and got[3].surfcum is None  # the first row of 1 had no temperature


def test_closed_tracks_equal_the_batch_after_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = fed(spark, tmp_path, [ROWS, LATER, LAST, [(98, "2024-02-01 00:00:00", 0.0, 0.0, 200.0, 1.0)]], lambda s: closed_tracks(s, 30, 3, "1 hour"), "append", "closed")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = finish_tracks(slots(spark, ROWS + LATER)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r.label for r in got} == {1, 3, 4}  # 2 was seen once


def test_chunks_as_micro_batches(spark, tmp_path):
    """Batches hand labels on; a replay and a restart between batches give the same tables as one run."""
    p = RunParams(min_bt=220, max_bt=235, step_bt=15, min_area_seed=4, min_lifetime=3, overlap_slots=4)
    v = blob_voxels(spark).withColumn("area", F.lit(1.0)).where("bt <= 235").cache()
    batches = [v.where("t < 10"), v.where("t >= 6 and t < 16"), v.where("t >= 12")]

    def sink(into):
        return lambda seg, k: into.__setitem__(k, (seg.last_label, {(r.t, r.y, r.x): r.label for r in seg.voxels.where("label is not null").collect()}))

    one, two = {}, {}
    write = chunk_writer(p, 30, 30, sink(one), f"file://{tmp_path}/one")
    for k, b in enumerate(batches):
        write(b, k)
    assert one[1][0] >= one[0][0] > p.first_label
    assert all(one[1][1][w] == lab for w, lab in one[0][1].items() if w[0] >= 6 and w in one[1][1])
    for k in (0, 1, 1, 2):  # every batch by a driver that knows nothing
        chunk_writer(p, 30, 30, sink(two), f"file://{tmp_path}/two", keep=2)(batches[k], k)
    chunk_writer(p, 30, 30, sink(two), f"file://{tmp_path}/two")(v.where("false"), 3)
    assert one == two
    assert {x.name for x in (tmp_path / "two").iterdir()} == {"batch=-1", "batch=1", "batch=2"}


def test_sinks_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(0, "2024-01-01", 0, 0, 1), (1, "2024-01-01", 0, 1, 2), (1, "2024-01-02", 0, 1, 2)], "chunk int, s string, y int, x int, label int").selectExpr("chunk", "cast(s as timestamp) ts", "y", "x", "label")
    sinks.write_labels(labels, str(tmp_path / "labels"))
    back = spark.read.parquet(str(tmp_path / "labels"))
    assert sorted((r.chunk, r.x) for r in back.collect()) == [(1, 1), (1, 1)]
    assert "day" in back.columns


@pytest.mark.parametrize("q", [0.9, 0.0, 0.5, 1.0])
def test_percentiles_by_rank(spark, q):
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(220, 15) for _ in range(3000)], "ties": [200.0] * 50 + [201.0], "one": [7.0], "wide": [-1e308, 1e308, 0.0, 5e-324, 1e-323], "close": [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)],
        "gap": [0.0, 1e-9, 2e-9, 1e9],
    }
    rows = [(g, 1, float(v)) for g, vs in groups.items() for v in vs] + [("hot", 1, None), ("hot", 1, float("nan")), ("empty", 1, None)]
    got = {r.g: r.p for r in percentile_by_rank(spark.createDataFrame(rows, "g string, end int, x double").repartition(5), ["g"], "x", q, "p").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "wide":
            assert got[g] == pytest.approx(np.percentile(vs, 100 * q), rel=1e-12, abs=0)
        else:
            assert got[g] == {0.9: pytest.approx(6e307), 0.0: -1e308, 0.5: 5e-324, 1.0: 1e308}[q]
    assert percentile_by_rank(spark.createDataFrame([], "g string, x double"), ["g"], "x", q, "p").isEmpty()


def test_dense_rows_never_cross(spark):
    rows = [(1, 10, 1.0), (1, 30, None), (1, 30, 3.0), (2, 20, 5.0), (3, 50, 7.0), (3, 10, 8.0), (4, None, 9.0)]
    lc = spark.createDataFrame(rows, "label int, ts int, a double").withColumn("b", F.col("a") * 2)
    out = dense(lc, ["a", "b"])
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    have = pd.DataFrame(rows, columns=["label", "ts", "a"]).dropna(subset=["ts"])
    want = []
    for label in (1, 2, 3):
        for ts in (10, 20, 30, 50):
            here = have[(have.label == label) & (have.ts == ts)].a.tolist() or [None]
            want += [(label, ts, -999.0, -999.0) if v is None or np.isnan(v) else (label, ts, v, 2 * v) for v in here]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert dense(lc.where("false"), ["a"]).isEmpty()
