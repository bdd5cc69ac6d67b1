"""Statistics of each system in each slot, and of the whole of its life."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.functions.scalar import KM_PER_DEGREE, MISSING, chord_km, epoch_seconds, great_circle_km, normalised
from cirrostrat.operators.joins import at_cells
from cirrostrat.operators.ranks import percentile_by_rank
from cirrostrat.runtime import materialize

#: Thresholds (K) of cold surfaces, mean temperatures and ellipses in the published tables.
SURFACES, MEANS, ELLIPSES = (235, 220, 210, 200), (235, 208, 200), (235, 220)
QUALITY = 11100


def label_sizes(voxels: DataFrame) -> DataFrame:
    return voxels.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def bt_range(voxels: DataFrame) -> DataFrame:
    bt = F.nanvl(F.col("bt").cast("double"), F.lit(None).cast("double"))
    return voxels.agg(F.min(bt).alias("bt_min"), F.max(bt).alias("bt_max"))


def normalised_bt(voxels: DataFrame) -> DataFrame:
    """``voxels`` with ``bt_norm`` between 0 and 1 over the whole table; the range is one row, joined to all."""
    return voxels.crossJoin(F.broadcast(bt_range(voxels))).withColumn("bt_norm", normalised(F.col("bt"), F.col("bt_min"), F.col("bt_max"))).drop("bt_min", "bt_max")


def area_per_slot(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("t").agg(F.sum("area").alias("area"))


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def ellipse(lat: Column, lon: Column, inside: Column, k: int) -> dict[str, Column]:
    """Aggregates of the ellipse of the pixels where ``inside`` holds, with the cell of their own mean position; coordinates in degrees, finished by ``finish_ellipse``."""
    return {
        f"_n{k}": F.count(_when(inside, lat)), f"_sxx{k}": F.var_samp(_when(inside, lon)), f"_syy{k}": F.var_samp(_when(inside, lat)),
        f"_sxy{k}": F.covar_samp(_when(inside, lon), _when(inside, lat)), f"_cy{k}": F.avg(_when(inside, F.col("y"))).cast("int"), f"_cx{k}": F.avg(_when(inside, F.col("x"))).cast("int"),
    }


def finish_ellipse(k: int, lat0: Column) -> dict[str, Column]:
    """Semi-axes (km), their ratio and the orientation (degrees, in (-90, 90]) from the principal axes; null below five pixels.

    A local projection scales longitudes by the cosine of the latitude ``lat0`` of the centre of the pixels inside, so variances in
    kilometres follow from those in degrees.
    """
    c = KM_PER_DEGREE * F.cos(F.radians(lat0))
    sxx, syy, sxy = F.col(f"_sxx{k}") * c * c, F.col(f"_syy{k}") * KM_PER_DEGREE**2, F.col(f"_sxy{k}") * c * KM_PER_DEGREE
    half, root = (sxx + syy) / 2, F.sqrt(F.pow((sxx - syy) / 2, F.lit(2)) + sxy * sxy)
    major, minor = 2 * F.sqrt(half + root), 2 * F.sqrt(F.greatest(half - root, F.lit(0.0)))
    enough = F.col(f"_n{k}") >= 5
    return {
        f"semimajor_{k}": F.when(enough, major), f"semiminor_{k}": F.when(enough, minor), f"ratio_{k}": F.when(enough & (major > 0), F.try_divide(minor, major)),
        f"orientation_{k}": F.when(enough, F.degrees(F.atan2(2 * sxy, sxx - syy) / 2)),
    }


def life_cycle(pixels: DataFrame, grid: DataFrame, surfaces: Sequence[int] = SURFACES, means: Sequence[int] = MEANS, ellipses: Sequence[int] = ELLIPSES, by_rank: bool = False) -> DataFrame:
    """One row per (label, ts) of labelled pixels (ts, y, x, label, bt, lat, lon, area).

    Count, centre (mean position cut to a cell, with that cell's coordinates), coldest and 90th
    percentile temperature, means and cold surfaces by threshold, ellipses around the centres of their own cold pixels. One
    aggregate computes all of it; pixels without temperature count in ``n`` only. ``by_rank``: the percentile comes from counts of ranks
    over all tasks, for systems whose images hold too many different temperatures for the one map that the aggregate keeps for each.
    """
    cold = {k: F.col("bt") <= k for k in {*surfaces, *means, *ellipses}}
    aggs = [F.count("*").alias("n"), F.avg("y").cast("int").alias("cy"), F.avg("x").cast("int").alias("cx"), F.min("bt").alias("tbmin")]
    aggs += [] if by_rank else [F.percentile("bt", 0.9).alias("tb90")]
    aggs += [F.avg(F.when(cold[k], F.col("bt"))).alias(f"tbavg_{k}") for k in means]
    aggs += [F.count(F.when(cold[k], F.lit(1))).cast("int").alias(f"pix_{k}") for k in surfaces]
    aggs += [F.coalesce(F.sum(F.when(cold[k], F.col("area").cast("double"))), F.lit(0.0)).alias(f"km2_{k}") for k in surfaces]
    for k in ellipses:
        aggs += [c.alias(n) for n, c in ellipse(F.col("lat"), F.col("lon"), cold[k], k).items()]
    per = pixels.groupBy("label", "ts").agg(*aggs)
    if by_rank:
        per = per.join(percentile_by_rank(pixels, ["label", "ts"], "bt", 0.9, "tb90"), ["label", "ts"], "left")
    for k in ellipses:
        per = at_cells(per, grid, f"_cy{k}", f"_cx{k}").drop("lon").withColumnRenamed("lat", f"_lat{k}")
        per = per.withColumns(finish_ellipse(k, F.col(f"_lat{k}")))
    return at_cells(per, grid, "cy", "cx").drop(*[f"_{m}{k}" for m in ("n", "sxx", "syy", "sxy", "cy", "cx", "lat") for k in ellipses])


def with_velocity(lc: DataFrame) -> DataFrame:
    """``velocity`` in m/s since the slot before in which the system was seen; missing for its first."""
    w = Window.partitionBy("label").orderBy("ts")
    lat, lon, seconds = F.col("lat"), F.col("lon"), epoch_seconds(F.col("ts"))
    km, dt = chord_km(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon), seconds - F.lag(seconds).over(w)
    return lc.withColumn("velocity", F.when(dt > 0, km * 1000 / dt).otherwise(F.lit(float(MISSING))))


def summary(lc: DataFrame, slot_minutes: int) -> DataFrame:
    """One row per system: duration over observed slots, first and last place, bounds, extremes, displacement.

    First and last go by time; a label that has two rows of one time takes the lesser place.
    """
    first, last = F.min(F.struct("ts", "lat", "lon")).alias("a"), F.max(F.struct("ts", "lat", "lon")).alias("z")
    bounds = [f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
    surf = [F.max(f"km2_{k}").alias(f"surfmax_{k}") for k in SURFACES]
    d = lc.groupBy("label").agg(F.count("*").alias("n"), first, last, *bounds, F.min("tbmin").alias("tb_min"), *surf, F.sum("km2_235").alias("surfcum_235"))
    hours = F.col("n") * slot_minutes / 60.0
    km = chord_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"))
    return d.select(
        "label", hours.alias("duration_hours"), epoch_seconds(F.col("a.ts")).alias("utc_init"), epoch_seconds(F.col("z.ts")).alias("utc_end"),
        F.col("a.lon").alias("lon_init"), F.col("a.lat").alias("lat_init"), F.col("z.lon").alias("lon_end"), F.col("z.lat").alias("lat_end"),
        "lon_min", "lon_max", "lat_min", "lat_max", "tb_min", *[f"surfmax_{k}" for k in SURFACES], "surfcum_235",
        km.alias("distance_km"), (km * 1000 / (hours * 3600)).alias("velocity_ms"), F.lit(QUALITY).alias("quality"),
        *[F.lit(MISSING).alias(c) for c in ("class_a", "class_b", "class_c", "storm_number", "storm_nature", "storm_distance")],
    )


def time_axis(lc: DataFrame) -> DataFrame:
    return lc.select("ts").distinct().orderBy("ts")


def dense(lc: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for every system and every time of the axis, with missing values where a system was not seen.

    Times get their place on the axis; each system's rows are sorted by it into one array, whose gaps are filled with
    missing values, and the array becomes rows again. So systems and times never cross, and one shuffle by system does it.
    Rows without time take no part; a system that has several rows of one time keeps them all.
    """
    place = (F.row_number().over(Window.orderBy("ts")) - 1).alias("i")
    axis = materialize(lc.where("ts is not null").select("ts").distinct().select("ts", place), "axis")  # one row a slot
    slots, gap = axis.count(), F.lit(float(MISSING))
    nothing = F.struct(*[gap.alias(c) for c in columns])
    seen = lc.select("label", "ts", F.struct(*[F.coalesce(F.col(c).cast("double"), gap).alias(c) for c in columns]).alias("v")).join(axis, "ts")

    def missing(after: Column, before: Column) -> Column:
        steps = F.transform(F.sequence(after + 1, before - 1), lambda k: F.struct(k.alias("i"), nothing.alias("v")))
        return F.when(before - after > 1, steps).otherwise(F.slice(F.array(F.struct(after.alias("i"), nothing.alias("v"))), 1, 0))

    one = seen.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e"))
    e = F.col("e")
    filled = F.transform(e, lambda r, j: F.concat(missing(F.when(j > 0, F.get(e, j - 1)["i"]).otherwise(F.lit(-1)), r["i"]), F.array(r)))
    whole = F.flatten(F.concat(filled, F.array(missing(F.get(e, F.size(e) - 1)["i"], F.lit(slots)))))
    rows = one.select("label", F.explode(whole).alias("r")).select("label", F.col("r.i").alias("i"), "r.v.*")
    return rows.join(axis, "i").select("label", "ts", *columns)


def online_places(pixels: DataFrame, grid: DataFrame, threshold: float = 235) -> DataFrame:
    """The incremental tracker's rows of (label, ts): centres rounded to even cells, coldest temperature, cold surface."""
    per = pixels.groupBy("label", "ts").agg(
        F.rint(F.avg("y")).cast("int").alias("cy"), F.rint(F.avg("x")).cast("int").alias("cx"), F.min("bt").alias("tbmin"),
        F.coalesce(F.sum(F.when(F.col("bt") <= threshold, F.col("area").cast("double"))), F.lit(0.0)).alias("km2"),
    )
    return at_cells(per, grid, "cy", "cx")


def online_tracks(pixels: DataFrame, grid: DataFrame, threshold: float = 235) -> DataFrame:
    """The incremental tracker's summary: systems seen once dropped, great-circle distances."""
    return finish_tracks(online_places(pixels, grid, threshold))


def finish_tracks(per: DataFrame) -> DataFrame:
    """Summaries of (label, ts, lat, lon, tbmin, km2) rows, one row per system seen at two times or more."""
    d = per.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("ts", "lat", "lon")).alias("a"), F.max(F.struct("ts", "lat", "lon")).alias("z"), F.min("tbmin").alias("tb_min"), F.max("km2").alias("surfmax"), F.sum("km2").alias("surfcum")).where("n >= 2")
    return track_columns(d)


def track_columns(d: DataFrame) -> DataFrame:
    """The summary's columns from (label, n, a, z, tb_min, surfmax, surfcum), a and z the first and last (ts, lat, lon)."""
    first, last = epoch_seconds(F.col("a.ts")), epoch_seconds(F.col("z.ts"))
    km = great_circle_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"))
    return d.select(
        "label", "n", ((last - first) / 3600).alias("duration_hours"), "tb_min", "surfmax", "surfcum", km.alias("distance_km"), F.try_divide(km * 1000, last - first).alias("velocity_ms"),
        first.alias("utc_init"), last.alias("utc_end"), F.col("a.lat").alias("lat_init"), F.col("a.lon").alias("lon_init"), F.col("z.lat").alias("lat_end"), F.col("z.lon").alias("lon_end"),
    )
