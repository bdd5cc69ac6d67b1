"""Connected components of voxels: within tiles first, then across the faces of tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.scalar import voxel_index
from cirrostrat.operators import stencil
from cirrostrat.operators.graph import connected_components
from cirrostrat.operators.neighbors import TEN, Offset, shifted
from cirrostrat.runtime import materialize

#: Slots, rows and columns of a tile (a quarter of a million voxels at most), which one task joins up at a time.
TILE = (16, 128, 128)
#: Voxels of a region that one task holds whole, and of a group of small regions.
REGION_VOXELS = 500_000


def _tile_parts(pattern: Sequence[Offset]):
    def run(table: pa.Table) -> pa.Table:
        t, y, x, own, starts = (table.column(c).to_numpy() for c in ("t", "y", "x", "own", "starts"))
        order = stencil.scan_order(t, y, x)
        t, y, x, own, starts = t[order], y[order], x[order], own[order], starts[order]
        root = stencil.parts(stencil.neighbour_table(t, y, x, pattern), np.ones(len(t), bool), starts)
        named = root >= 0
        return pa.table({"t": t, "y": y, "x": x, "own": own, "starts": starts, "named": named, "root": np.where(named, own[root], own)})

    return run


def voxel_components(voxels: DataFrame, ny: int, nx: int, pattern: Sequence[Offset] = TEN, visits: DataFrame | None = None, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """(t, y, x, component): component is the smallest linear index of the voxels that hang together.

    A voxel without neighbours is a component of its own. ``visits`` (t, y, x) names the voxels that may start a
    component or hand it on; the others can only be reached, and have no row if they are not.
    Every tile is joined up in one task; only voxels on its faces meet those of other tiles, and the graph that is
    contracted has the parts of tiles as its nodes. The pattern is taken both ways, as neighbours are mutual.
    """
    own = voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx)
    v = voxels.select("t", "y", "x").distinct().withColumn("own", own)
    if visits is None:
        v = v.withColumn("starts", F.lit(True))
    else:
        v = v.join(visits.select(own.alias("own")).distinct().withColumn("_visits", F.lit(True)), "own", "left")
        v = v.select("t", "y", "x", "own", F.coalesce("_visits", F.lit(False)).alias("starts"))
    of = {c: F.floor(F.col(c) / n).cast("int") for c, n in zip("tyx", tile, strict=True)}
    tiled = v.withColumns({f"tile_{c}": e for c, e in of.items()})
    local = tiled.groupBy(*[f"tile_{c}" for c in of]).applyInArrow(_tile_parts(pattern), "t int, y int, x int, own long, starts boolean, named boolean, root long")
    local = materialize(local, "parts")
    face = F.lit(False)
    for c, n in zip("tyx", tile, strict=True):
        face = face | F.pmod(c, F.lit(n)).isin(0, n - 1)
    rim = local.where(face)
    apart = F.lit(False)
    for c, n in zip("tyx", tile, strict=True):
        apart = apart | (F.floor(F.col(f"n{c}") / n) != F.floor(F.col(c) / n))
    beside = shifted(rim.where("starts").select("t", "y", "x", "root"), pattern).where(apart)
    there = rim.select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("root").alias("other"))
    joined = connected_components(beside.join(there, ["nt", "ny", "nx"]).select("root", "other"), "root", "other")
    out = local.join(joined.withColumnRenamed("id", "root"), "root", "left")
    return out.select("t", "y", "x", F.coalesce("component", F.when(F.col("named"), F.col("root"))).alias("component")).where("component is not null")


def with_groups(voxels: DataFrame, ny: int, nx: int, pattern: Sequence[Offset] = TEN, most: int = REGION_VOXELS) -> DataFrame:
    """``voxels`` plus ``group``: whole regions of neighbouring voxels share one, about ``most`` voxels together.

    What spreads from neighbour to neighbour never leaves its region, so groups can be worked on apart. A region of
    more than ``most`` voxels has no group.
    """
    parts = materialize(voxel_components(voxels, ny, nx, pattern), "regions")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    whole = sizes.where(F.col("n") <= most)
    bins = 1 + int((whole.agg(F.sum("n")).first()[0] or 0) // most)
    named = whole.select("component", F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int").alias("group"))
    return voxels.drop("group").join(parts.join(named, "component", "left").drop("component"), ["t", "y", "x"])
