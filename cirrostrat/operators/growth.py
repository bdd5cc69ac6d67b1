"""Conditional growth of labels over a volume.

A queue that starts with all labelled voxels in scan order and hands each label to neighbours in a
fixed order resolves conflicts by who came first. Growth never leaves a region of neighbouring voxels that are
labelled or free, so regions of a bounded size are grown each in one task, by whole frontiers at a time.

What the queue gives a voxel is the label of the nearest source, in steps; of several that are equally near, of the first in scan order:
voxels leave the queue by level, and within a level by the source that reached them. So (level, source) is a key
that only falls, and larger regions are grown by correcting keys tile by tile: a tile runs its own queue to the end,
hands on the keys of its faces that became less, and runs again when it receives such. Rounds follow the tiles that
growth crosses, not its levels, and between rounds only keys of faces are kept.

``grow_level`` is one level of the queue as a join, with the path that reached each voxel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.scalar import centikelvin, voxel_index
from cirrostrat.operators import stencil
from cirrostrat.operators.components import REGION_VOXELS, TILE, voxel_components, with_groups
from cirrostrat.operators.neighbors import SIX, TEN, Offset, neighbours, shifted
from cirrostrat.runtime import discard, materialize

#: A key of a voxel on the face of a tile: steps from its source, the source's linear index and label.
_FACE = "t int, y int, x int, q int, level int, source long, label int"
_NO_Q = 1 << 30


def start_frontier(labelled: DataFrame, ny: int, nx: int) -> DataFrame:
    """(t, y, x, label, q, path) of all labelled voxels."""
    index = voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx)
    return labelled.select("t", "y", "x", "label", centikelvin(F.col("bt")).alias("q"), F.lpad(F.hex(index), 16, "0").alias("path"))


def grow_level(frontier: DataFrame, free: DataFrame, delta: float, pattern: Sequence[Offset] = TEN) -> DataFrame:
    """The voxels of ``free`` (t, y, x, q) that the frontier reaches, with label, q and path.

    A step is allowed where the neighbour's temperature plus ``delta`` is at least the centre's, in
    hundredths of a kelvin: labels spread freely to warmer voxels and a little way to colder ones.
    """
    step = shifted(frontier, pattern).select(F.col("nt").alias("t"), F.col("ny").alias("y"), F.col("nx").alias("x"), "label", F.col("q").alias("from_q"), F.concat("path", F.lpad(F.hex("k"), 2, "0")).alias("path"))
    reached = step.join(free, ["t", "y", "x"]).where(F.col("q") + int(round(100 * delta)) >= F.col("from_q"))
    best = reached.groupBy("t", "y", "x").agg(F.min(F.struct("path", "label", "q")).alias("b"))
    return best.select("t", "y", "x", "b.label", "b.q", "b.path")


class Settled:
    """A tile after its growth, from its cells (``t``, ``y``, ``x``, ``q``, ``free``, ``label``, ``own``) and the keys of the faces that it was told.

    Voxels are in scan order, those of other tiles among them; ``row`` names the row of cells of those ``inside``.
    """

    def __init__(self, cells: dict[str, np.ndarray], faces: pa.Table, pattern: Sequence[Offset], delta: int):
        own, k = len(cells["t"]), faces.num_rows
        t, y, x = (np.r_[cells[c], faces.column(c).to_numpy()] for c in "tyx")
        q = np.r_[cells["q"], faces.column("q").to_numpy()].astype(np.int64)
        free = np.r_[cells["free"], np.zeros(k, bool)]
        label = np.r_[cells["label"], faces.column("label").to_numpy()].astype(np.int64)
        source = np.r_[np.where(label[:own] != 0, cells["own"], -1), faces.column("source").to_numpy()]
        level = np.r_[np.where(label[:own] != 0, 0, -1), faces.column("level").to_numpy()]
        order = stencil.scan_order(t, y, x)
        # a cell of this tile whose key came back keeps its row, the face's row names the key it had
        t, y, x, q, free, label, source, level, mine = (a[order] for a in (t, y, x, q, free, label, source, level, np.arange(own + k) < own))
        twin = np.r_[False, (t[1:] == t[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1])]
        first = np.flatnonzero(~twin)
        slot = np.cumsum(~twin) - 1
        n = len(first)
        at = np.full(n, -1)  # the row of each voxel's cell, if it lies in this tile
        at[slot[mine]] = np.flatnonzero(mine)
        self.inside, row = at >= 0, np.where(at >= 0, at, first)
        self.row = order[row]
        self.names, rank = np.unique(source[source >= 0], return_inverse=True)
        key = np.full(n, stencil.FAR)
        np.minimum.at(key, slot[source >= 0], (level[source >= 0].astype(np.int64) << 32) | rank)
        self.had = np.full(n, stencil.FAR)
        known = ~mine
        np.minimum.at(self.had, slot[known], (level[known].astype(np.int64) << 32) | np.searchsorted(self.names, source[known]))
        self.label_of = np.zeros(len(self.names), np.int64)
        self.label_of[rank] = label[source >= 0]
        self.t, self.y, self.x, self.q = t[row], y[row], x[row], q[row]
        self.near = stencil.neighbour_table(self.t, self.y, self.x, pattern)
        self.key = stencil.least_keys(self.near, key, self.inside & free[row], self.q, delta)

    def labels(self) -> np.ndarray:
        """The label of each voxel, 0 if it has none."""
        known = self.key < stencil.FAR
        out = np.zeros(len(self.key), np.int64)
        out[known] = self.label_of[self.key[known] & 0xFFFFFFFF]
        return out

    def told(self, tile: tuple[int, int, int]) -> dict[str, np.ndarray]:
        """The keys of the tile's faces that are less than those it has told before."""
        rim = np.zeros(len(self.key), bool)
        for c, size in zip((self.t, self.y, self.x), tile, strict=True):
            rim |= (c % size == 0) | (c % size == size - 1)
        out = np.flatnonzero(self.inside & rim & (self.key < self.had) & (self.q < _NO_Q))
        won = self.key[out] & 0xFFFFFFFF
        return {"t": self.t[out], "y": self.y[out], "x": self.x[out], "q": self.q[out].astype(np.int32), "level": (self.key[out] >> 32).astype(np.int32), "source": self.names[won], "label": self.label_of[won]}


def _grow_tile(pattern: Sequence[Offset], delta: int, tile: tuple[int, int, int], finish: bool):
    def run(cells: pa.Table, faces: pa.Table) -> pa.Table:
        if not cells.num_rows:  # nothing to grow beside this face
            return pa.table({n: pa.array([], t) for n, t in zip(("t", "y", "x", "label"), [pa.int32()] * 4, strict=True)} if finish else {f.split()[0]: pa.array([], pa.int64() if "long" in f else pa.int32()) for f in _FACE.split(", ")})
        own = {c: cells.column(c).to_numpy() for c in ("t", "y", "x", "own")}
        own |= {"q": cells.column("q").fill_null(_NO_Q).to_numpy(), "free": cells.column("free").to_numpy(zero_copy_only=False), "label": cells.column("label").fill_null(0).to_numpy()}
        settled = Settled(own, faces, pattern, delta)
        if finish:
            out = np.flatnonzero(settled.inside & (settled.key < stencil.FAR) & (settled.key >> 32 > 0))
            return pa.table({"t": settled.t[out], "y": settled.y[out], "x": settled.x[out], "label": settled.labels()[out].astype(np.int32)})
        told = settled.told(tile)
        return pa.table(told | {"label": told["label"].astype(np.int32)})

    return run


def grow_by_tiles(voxels: DataFrame, mask: Column, delta: float, ny: int, nx: int, pattern: Sequence[Offset] = TEN, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """``voxels`` with labels grown tile by tile, for regions of any size.

    In each round only tiles run that receive a lesser key for a voxel next to them; one more run of all tiles with the keys of
    their faces gives the labels. The pattern must hold each offset with its opposite, and reach one step.
    """
    tiles = [f"tile_{c}" for c in "tyx"]

    def of(names: Sequence[str]) -> dict[str, Column]:
        return {t: F.floor(F.col(c) / n).cast("int") for t, c, n in zip(tiles, names, tile, strict=True)}

    free = F.col("label").isNull() & F.coalesce(mask & F.col("bt").isNotNull(), F.lit(False))
    cells = voxels.where(F.col("label").isNotNull() | free).select("t", "y", "x", "label", centikelvin(F.col("bt")).alias("q"), free.alias("free"), voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx).alias("own"))
    cells = materialize(cells.withColumns(of("tyx")), "cells")

    def near(faces: DataFrame) -> DataFrame:
        """Each face once for every tile that it touches, its own too."""
        beside = shifted(faces, [(0, 0, 0), *pattern]).withColumns(of(["nt", "ny", "nx"]))
        return beside.select(*faces.columns, *tiles).dropDuplicates(["t", "y", "x", *tiles])

    step, rounds = int(round(100 * delta)), 0
    faces: DataFrame | None = None
    new = cells.where("label is not null").select(*tiles).distinct()  # tiles with sources run first
    while True:
        active = cells.join(new, tiles, "left_semi")
        known = (near(faces).join(new, tiles, "left_semi") if faces is not None else cells.sparkSession.createDataFrame([], _FACE).withColumns(of("tyx"))).withColumnsRenamed({t: f"to_{t}" for t in tiles})
        out = active.groupBy(*tiles).cogroup(known.groupBy(*[f"to_{t}" for t in tiles])).applyInArrow(_grow_tile(pattern, step, tile, False), _FACE)
        less = materialize(out, "faces")
        if less.isEmpty():
            discard(less)
            break
        rounds += 1
        merged = less if faces is None else materialize(faces.join(less.select("t", "y", "x"), ["t", "y", "x"], "left_anti").unionByName(less), "faces")
        passed = shifted(less.select("t", "y", "x"), pattern)
        elsewhere = F.lit(False)
        for c, n in zip("tyx", tile, strict=True):
            elsewhere = elsewhere | (F.floor(F.col(f"n{c}") / n) != F.floor(F.col(c) / n))
        reached = materialize(passed.where(elsewhere).select(*of(["nt", "ny", "nx"]).values()).toDF(*tiles).distinct(), "reached")
        if faces is not None:
            discard(faces, less)
        if rounds > 1:
            discard(new)
        faces, new = merged, reached
    known = (near(faces) if faces is not None else cells.sparkSession.createDataFrame([], _FACE).withColumns(of("tyx"))).withColumnsRenamed({t: f"to_{t}" for t in tiles})
    ends = cells.groupBy(*tiles).cogroup(known.groupBy(*[f"to_{t}" for t in tiles])).applyInArrow(_grow_tile(pattern, step, tile, True), "t int, y int, x int, label int")
    grown = materialize(ends.withColumnRenamed("label", "_new"), "grown")
    discard(cells, *([faces] if faces is not None else []))
    return voxels.join(grown, ["t", "y", "x"], "left").withColumn("label", F.coalesce("label", "_new")).drop("_new").select(voxels.columns)


def _sweep_group(deltas: list[int], finds: bool, scan_rules: bool):
    def run(table: pa.Table) -> pa.Table:
        t, y, x = (table.column(c).to_numpy() for c in "tyx")
        order = stencil.scan_order(t, y, x)
        table = table.take(order)
        near = stencil.neighbour_table(t[order], y[order], x[order], TEN)
        label = table.column("label").fill_null(0).to_numpy().astype(np.int64)
        q = table.column("_q").fill_null(1 << 30).to_numpy().astype(np.int64)  # a voxel without temperature hands on nothing
        for k, delta in enumerate(deltas):
            label = stencil.grown(near, label, table.column(f"_free{k}").to_numpy(), q, delta)
        out = table.drop_columns(["_q", "_own", "_cold", "_rim", *(f"_free{k}" for k in range(len(deltas)))])
        out = out.set_column(out.column_names.index("label"), "label", pa.array(label.astype(np.int32), mask=label == 0))
        if finds:
            own, cold = table.column("_own").to_numpy(), table.column("_cold").to_numpy()
            member = cold & (label == 0)
            starts = member
            if scan_rules:
                six = [TEN.index(o) for o in SIX]
                starts = member & ~table.column("_rim").to_numpy() & np.r_[cold, False][near[:, six]].any(1)
            root = stencil.parts(near, member, starts)
            beside = stencil.least_beside(near, label, root >= 0)
            out = out.append_column("component", pa.array(own[root], mask=root < 0)).append_column("beside", pa.array(beside.astype(np.int32), mask=beside == 0))
        return out

    return run


def sweep(grouped: DataFrame, steps: Sequence[tuple[Column, float]], ny: int, nx: int, cold: Column | None = None, scan_rules: bool = False, large: bool = True, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """``grouped`` (t, y, x, bt, label, group and other columns) after growth steps (where it may go, margin), one after the other.

    With ``cold``, the unlabelled voxels where it holds are joined up after the growth: ``component`` is the smallest linear
    index of each part, ``beside`` the least label next to a voxel of a part. ``scan_rules``: voxels on the rim, and those without a cold one among
    their six deciding neighbours, start no part and hand none on. ``large``: whether some voxels have no group.
    """
    finds, types = cold is not None, grouped.schema
    rim = F.col("x").isin(0, nx - 1) | F.col("y").isin(0, ny - 1)
    holds = lambda c: F.coalesce(c, F.lit(False))
    flags = {f"_free{k}": holds(mask) for k, (mask, _) in enumerate(steps)} | {"_cold": holds(cold) if finds else F.lit(False), "_rim": rim}
    ready = grouped.withColumns({"_q": centikelvin(F.col("bt")), "_own": voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx), **flags})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields) + (", component long, beside int" if finds else "")
    deltas = [int(round(100 * delta)) for _, delta in steps]
    out = ready.where("group is not null").groupBy("group").applyInArrow(_sweep_group(deltas, finds, scan_rules), schema)
    if not large:
        return out
    rest = grouped.where("group is null")
    for mask, delta in steps:
        rest = materialize(grow_by_tiles(rest, mask, delta, ny, nx, tile=tile), "grown")
    if finds:
        rest = materialize(rest, "grown")
        free = rest.where(F.col("label").isNull() & cold).select("t", "y", "x")
        visits = None
        if scan_rules:
            six = neighbours(rest.where(cold), pattern=SIX).select("t", "y", "x").distinct()
            visits = free.where(~rim).join(six, ["t", "y", "x"], "left_semi")
        found = materialize(voxel_components(free, ny, nx, visits=visits), "components")
        fixed = rest.where("label is not null").select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("label").alias("l"))
        beside = neighbours(found, rest.where("label is not null")).join(fixed, ["nt", "ny", "nx"]).groupBy("t", "y", "x").agg(F.min("l").alias("beside"))
        rest = rest.join(found.join(beside, ["t", "y", "x"], "left"), ["t", "y", "x"], "left").select(*types.names, "component", "beside")
    return out.unionByName(rest)


def grow(voxels: DataFrame, mask: Column, delta: float, ny: int, nx: int, most: int = REGION_VOXELS, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """``voxels`` (t, y, x, bt, label) with labels grown into the unlabelled voxels where ``mask`` holds.

    Voxels that no label reaches keep a null label, and so do all if there is no label. Null temperatures neither
    take nor hand on a label. ``most``: voxels of a region up to which one task grows it whole; ``tile``: what a task holds of larger ones.
    """
    inside = F.col("label").isNotNull() | F.coalesce(mask, F.lit(False))
    grouped = materialize(with_groups(voxels.where(inside), ny, nx, most=most), "grouped")
    large = not grouped.where("group is null").isEmpty()
    out = sweep(grouped, [(mask, delta)], ny, nx, large=large, tile=tile).drop("group")
    return out.union(voxels.where(~inside).select(out.columns)).select("t", "y", "x", "bt", "label")
