"""Voxel neighbourhoods as joins on shifted positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offset = tuple[int, int, int]

#: The ten neighbours (dt, dy, dx) in the order in which growth visits them.
TEN: tuple[Offset, ...] = ((1, 0, 0), (-1, 0, 0), (0, 0, -1), (0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (0, -1, -1), (0, -1, 0), (0, -1, 1))
#: All within two steps along the axes, none of them further than one along each.
EIGHTEEN: tuple[Offset, ...] = tuple((dt, dy, dx) for dt in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 < abs(dt) + abs(dy) + abs(dx) <= 2)
#: A voxel and its neighbours in the order in which a scan lists their labels.
SCAN: tuple[Offset, ...] = ((0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (0, -1, -1), (0, -1, 0), (0, -1, 1), (-1, 0, 0), (1, 0, 0))
#: The six that decide whether a voxel is isolated (its row, and the row above but for two).
SIX: tuple[Offset, ...] = ((0, 0, 1), (0, 0, -1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (0, -1, -1))


def offsets(pattern: Sequence[Offset]) -> Column:
    """An array of (k, dt, dy, dx), a literal that needs no join."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dt"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for k, (a, b, c) in enumerate(pattern)])


def shifted(voxels: DataFrame, pattern: Sequence[Offset] = TEN) -> DataFrame:
    """``voxels`` once for each neighbour position: k, nt, ny, nx."""
    o = F.col("_o")
    out = voxels.withColumn("_o", F.explode(offsets(pattern)))
    return out.withColumns({"k": o["k"], "nt": F.col("t") + o["dt"], "ny": F.col("y") + o["dy"], "nx": F.col("x") + o["dx"]}).drop("_o")


def neighbours(voxels: DataFrame, others: DataFrame | None = None, pattern: Sequence[Offset] = TEN) -> DataFrame:
    """(t, y, x, k, nt, ny, nx): pairs of a voxel and a neighbour in ``others``; an equi-join, so it shuffles by position and never crosses."""
    near = shifted(voxels.select("t", "y", "x"), pattern)
    there = (voxels if others is None else others).select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(there, ["nt", "ny", "nx"])


def degree(voxels: DataFrame, pattern: Sequence[Offset] = TEN) -> DataFrame:
    """(t, y, x, n): how many neighbours of each voxel are voxels too; counted at the neighbours, without a second join."""
    votes = shifted(voxels.select("t", "y", "x"), [(-a, -b, -c) for a, b, c in pattern])
    counts = votes.groupBy(F.col("nt").alias("t"), F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.count("*").alias("n"))
    return voxels.select("t", "y", "x").join(counts, ["t", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def isolated(voxels: DataFrame) -> DataFrame:
    """Voxels none of whose six deciding neighbours is a voxel."""
    return degree(voxels, SIX).where("n = 0").select("t", "y", "x")


def labels_around(voxels: DataFrame, labelled: DataFrame, pattern: Sequence[Offset] = SCAN) -> DataFrame:
    """(t, y, x, labels): the distinct labels (not 0) at a voxel and around it, in the order of the pattern.

    Voxels without any have no row; repeated voxels have one. No list is longer than the pattern.
    """
    there = labelled.where("label <> 0").select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"), "label").distinct()
    near = shifted(voxels.select("t", "y", "x").distinct(), pattern).join(there, ["nt", "ny", "nx"])
    met = F.array_sort(F.collect_list(F.struct("k", "label")))
    return near.groupBy("t", "y", "x").agg(F.array_distinct(F.transform(met, lambda e: e["label"])).alias("labels"))


def is_edge(ny: int, nx: int) -> Column:
    """On the rim of the domain, where no seed starts."""
    return F.col("x").isin(0, nx - 1) | F.col("y").isin(0, ny - 1)
