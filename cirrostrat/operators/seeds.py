"""Seeds: components of cold voxels that last long enough over a large enough area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.operators.neighbors import is_edge, isolated, neighbours
from cirrostrat.runtime import materialize


def candidates(threshold: float) -> Column:
    return (F.col("bt") > 0) & (F.col("bt") <= threshold)


def frame_areas(parts: DataFrame, area: str = "area") -> DataFrame:
    """(component, t, area): km2 per slot; each pixel's area is cut to whole km2 first."""
    return parts.groupBy("component", "t").agg(F.sum(F.floor(area)).alias("area"))


def seed_records(frames: DataFrame, min_area: float, min_lifetime: int) -> DataFrame:
    """One row per component: first and last slot, span, total area, longest run, duration, accepted.

    A run is a stretch of consecutive slots of ``min_area`` or more. A component is accepted if its
    span and one of its runs reach ``min_lifetime`` and its total area the product of the limits;
    its duration then counts the first such run up to the limit and all later large slots.
    """
    large = frames.where(F.col("area") >= min_area)
    order = Window.partitionBy("component").orderBy("t")
    runs = large.withColumn("run", F.col("t") - F.row_number().over(order)).groupBy("component", "run").agg(F.count("*").alias("n"), F.min("t").alias("from"))
    long_ = F.when(F.col("n") >= min_lifetime, F.col("from"))
    per_run = runs.groupBy("component").agg(F.max("n").alias("longest_run"), F.min(long_).alias("accepted_from"))
    whole = frames.groupBy("component").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sum("area").alias("total_area"))
    lasting = large.join(per_run, "component").where(F.col("t") >= F.col("accepted_from")).groupBy("component").agg(F.count("*").alias("duration"))
    out = whole.join(per_run, "component", "left").join(lasting, "component", "left")
    ok = (F.col("t_max") - F.col("t_min") + 1 >= min_lifetime) & F.col("accepted_from").isNotNull() & (F.col("total_area") >= min_area * min_lifetime)
    return out.select(
        "component", "t_min", "t_max", (F.col("t_max") - F.col("t_min") + 1).alias("span"), "total_area",
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.coalesce("duration", F.lit(0)).alias("duration"), ok.alias("accepted"),
    )


def numbered(records: DataFrame, last_label: int) -> DataFrame:
    """Accepted components with ``label``: from ``last_label + 1`` in the order of their first voxel.

    One row per accepted system passes the window, not its voxels.
    """
    return records.where("accepted").withColumn("label", (F.row_number().over(Window.orderBy("component")) + last_label).cast("int"))


def absorbing(parts: DataFrame, labelled: DataFrame) -> DataFrame:
    """(component, absorb_to): the least label among the labelled neighbours of a component."""
    touch = neighbours(parts, labelled).join(labelled.select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"), "label"), ["nt", "ny", "nx"])
    return touch.join(parts, ["t", "y", "x"]).groupBy("component").agg(F.min("label").alias("absorb_to"))


def visitors(voxels: DataFrame, threshold: float, ny: int, nx: int) -> DataFrame:
    """The unlabelled candidates that a scan visits: off the domain's rim and not isolated among all candidates."""
    cold = voxels.where(candidates(threshold))
    return cold.where(F.col("label").isNull() & ~is_edge(ny, nx)).select("t", "y", "x").join(isolated(cold), ["t", "y", "x"], "left_anti")


def named_systems(swept: DataFrame, threshold: float, min_area: float, min_lifetime: int, last_label: int) -> tuple[DataFrame, DataFrame, int]:
    """Label the parts that a sweep has found (swept: t, area, label, component, beside and other columns).

    Returns the voxels with new labels, the accepted seeds and the last label given. Parts that fail join the least
    labelled system that they touch, or stay unlabelled.
    """
    found = swept.where("component is not null")
    records = seed_records(frame_areas(found), min_area, min_lifetime)
    new = materialize(numbered(records, last_label).withColumn("threshold", F.lit(threshold).cast("int")), "accepted")
    beside = found.where("beside is not null").groupBy("component").agg(F.min("beside").alias("_new")).join(new.select("component"), "component", "left_anti")
    given = new.select("component", F.col("label").alias("_new")).union(beside)
    out = swept.drop("beside").join(given, "component", "left").withColumn("label", F.coalesce("label", "_new")).drop("_new", "component")
    return out, new, last_label + new.count()
