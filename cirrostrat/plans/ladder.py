"""The threshold ladder, over one volume or in overlapping chunks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.config import RunParams
from cirrostrat.functions.scalar import centikelvin, voxel_index
from cirrostrat.operators import stencil
from cirrostrat.operators.components import REGION_VOXELS, TILE, with_groups
from cirrostrat.operators.graph import LAST_EDGES, connected_components, joined_up
from cirrostrat.operators.growth import Settled
from cirrostrat.operators.joins import assign_chunks, carried_over
from cirrostrat.operators.neighbors import SCAN, SIX, TEN, is_edge, offsets, shifted
from cirrostrat.operators.seeds import seed_records
from cirrostrat.runtime import discard, materialize

_LABELLED = "t int, y int, x int, bt double, area double, label int, seed long, detected int"


@dataclass
class Segmentation:
    """Labelled voxels, accepted seeds (with the threshold of their detection), the last label, and the seeds' areas by slot (label, t, area)."""

    voxels: DataFrame
    seeds: DataFrame
    last_label: int
    frames: DataFrame | None = None


def _ladder_group(params: RunParams):
    """The whole ladder over one group of regions; new systems are named by their first voxel and the threshold that found them."""
    six = [TEN.index(o) for o in SIX]

    def run(table: pa.Table) -> pa.Table:
        t, y, x = (table.column(c).to_numpy() for c in "tyx")
        table = table.take(stencil.scan_order(t, y, x))
        t, y, x, own = (table.column(c).to_numpy() for c in ("t", "y", "x", "own"))
        near = stencil.neighbour_table(t, y, x, TEN)
        around = stencil.neighbour_table(t, y, x, SCAN) if params.exact_scan else None
        bt, q = table.column("bt").to_numpy().astype(float), table.column("q").fill_null(1 << 30).to_numpy().astype(np.int64)
        km2 = np.nan_to_num(np.floor(table.column("area").to_numpy(zero_copy_only=False).astype(float)))
        carried = table.column("label").fill_null(0).to_numpy().astype(np.int64)
        kept, label = np.unique(np.r_[0, carried], return_inverse=True)  # labels count from 1 within the group, in their order
        label, detected, names = label[1:], np.zeros(len(t), np.int32), [-1] * len(kept)
        rim = table.column("rim").to_numpy(zero_copy_only=False)
        delta, after = int(round(100 * params.delta_spread)), None
        for threshold, following in params.ladder():
            if after is not None:
                label = stencil.grown(near, label, bt <= after, q, delta)
            label = stencil.grown(near, label, bt < threshold, q, delta)
            cold = (bt > 0) & (bt <= threshold)
            member = cold & (label == 0)
            if params.exact_scan:
                root, given = stencil.scanned(around, cold, label, rim)
            else:
                starts = member & ~rim & np.r_[cold, False][near[:, six]].any(1) if params.scan_rules else member
                root = stencil.parts(near, member, starts)
                given = stencil.least_of_parts(root, stencil.least_beside(near, label, root >= 0))
            found = np.flatnonzero(root >= 0)
            if len(found):
                new = stencil.lasting(root[found], t[found], km2[found], params.min_area_seed, params.min_lifetime)
                given[new] = len(names) + np.arange(len(new))
                names += own[new].tolist()
                label = np.where(root >= 0, given[root], label)
                detected[found[np.isin(root[found], new)]] = threshold
            after = following
        label = stencil.grown(near, label, bt <= after, q, delta)
        label = stencil.grown(near, label, bt <= after, q, int(round(100 * params.final_delta)))
        seed, old = np.array(names)[label], kept[np.minimum(label, len(kept) - 1)]
        out = table.select(["t", "y", "x", "bt", "area"])
        out = out.append_column("label", pa.array(old.astype(np.int32), mask=(label == 0) | (seed >= 0)))
        return out.append_column("seed", pa.array(seed, mask=seed < 0)).append_column("detected", pa.array(detected, mask=detected == 0))

    return run


def _steps(params: RunParams) -> list[tuple[float, bool, int, int | None]]:
    """The ladder as growths (limit, only below it, margin in hundredths), each with the threshold of the detection after it, if any.

    A growth below a threshold that the growth before has reached would find nothing more, and is left out.
    """
    delta, out, after = int(round(100 * params.delta_spread)), [], None
    for threshold, following in params.ladder():
        if after is None or threshold > after:
            out += [(after, False, delta, None)] if after is not None else []
            out.append((threshold, True, delta, threshold))
        else:
            out.append((after, False, delta, threshold))
        after = following
    return [*out, (after, False, delta, None), (after, False, int(round(100 * params.final_delta)), None)]


def _tile_shape(sizes: tuple[int, int, int], cells: int) -> tuple[int, int, int]:
    """Slots, rows and columns of a tile of at most ``cells`` voxels: the volume, halved along its longest side until it fits."""
    shape = [max(1, n) for n in sizes]
    while shape[0] * shape[1] * shape[2] > max(1, cells):
        longest = shape.index(max(shape))
        shape[longest] = -(-shape[longest] // 2)
    return tuple(shape)


def _ladder_tile(params: RunParams, step: tuple[float, bool, int, int | None], ends: tuple[tuple[int, int], ...], tile: tuple[int, int, int], finish: bool):
    """A step of the ladder in one tile: the keys that its growth tells other tiles, or its cells after the step.

    Notes are keys of faces, and the labels that parts across tiles (with ``exact_scan``: voxels) were given after the step before. Parts that end inside the tile are decided
    here (``exact_scan``: a scan follows, which reads the voxels of role 1); voxels of others keep the part's first voxel in the tile (root), what they touch (beside) and their role (2: hands the part on, 1: reached, 0: reached by none here).
    """
    limit, below, delta, threshold = step

    def run(cells: pa.Table, notes: pa.Table) -> pa.Table:
        kinds = _CELL if finish else _FACE
        if not cells.num_rows:
            return pa.table({f.split()[0]: pa.array([], _ARROW[f.split()[1]]) for f in kinds.split(", ")})
        t, y, x, q, own, bt = (cells.column(c).to_numpy() for c in ("t", "y", "x", "q", "own", "bt"))
        label, detected, root = (cells.column(c).fill_null(none).to_numpy().copy() for c, none in (("label", 0), ("detected", 0), ("root", -1)))
        is_face = notes.column("face").to_numpy(zero_copy_only=False)
        given, faces = notes.filter(pa.array(~is_face)), notes.filter(pa.array(is_face))
        if given.num_rows:
            names, first = np.unique(given.column("source").to_numpy(), return_index=True)
            of = own if params.exact_scan else root
            at = np.minimum(np.searchsorted(names, of), len(names) - 1)
            hit = (of >= 0) & (names[at] == of)
            label[hit], detected[hit] = (given.column(c).to_numpy()[first][at[hit]] for c in ("label", "level"))
        free = (label == 0) & ((bt < limit) if below else (bt <= limit))
        s = Settled({"t": t, "y": y, "x": x, "q": q, "free": free, "label": label, "own": own}, faces, TEN, delta)
        if not finish:
            return pa.table(s.told(tile))
        n, labels, inside = len(s.t), s.labels(), np.flatnonzero(s.inside)
        row = s.row[inside]
        found, role, beside, index = np.full(n, -1), np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, -1)
        index[inside] = own[row]
        seen = np.zeros(n, np.int32)
        seen[inside] = detected[row]
        if threshold is not None and params.exact_scan:  # the scan reads what lies within two steps of free voxels, here or beyond a face
            role[inside] = (label[row] == 0) & (labels[inside] == 0) & (bt[row] > 0) & (bt[row] <= threshold)
            for _ in range(2):
                role = np.maximum(role, np.r_[role, 0][s.near].max(1))
            for c, size, (low, high) in zip((s.t, s.y, s.x), tile, ends, strict=True):
                start = c // size * size
                role[((c - start < 2) & (start > low)) | ((c - start >= size - 2) & (start + size <= high))] = 1
        elif threshold is not None:
            temperature, km2 = np.full(n, np.nan), np.zeros(n)
            temperature[inside] = bt[row]
            km2[inside] = np.nan_to_num(np.floor(cells.column("area").to_numpy(zero_copy_only=False).astype(float)))[row]
            member = (temperature > 0) & (temperature <= threshold) & (labels == 0)
            starts = member
            if params.scan_rules:
                starts = starts.copy()
                starts[inside] &= cells.column("visited").fill_null(np.inf).to_numpy()[row] <= threshold
            part = stencil.parts(s.near, member, starts)
            border = np.zeros(n, bool)
            for c, size, (low, high) in zip((s.t, s.y, s.x), tile, ends, strict=True):
                border |= ((c % size == 0) & (c > low)) | ((c % size == size - 1) & (c < high))
            role = np.where(starts, 2, np.where(part >= 0, 1, 0)).astype(np.int32)
            waits = np.flatnonzero(member & border & (part < 0))
            part[waits] = waits
            goes_on = np.zeros(n, bool)
            goes_on[part[border & (part >= 0)]] = True
            apart = (part >= 0) & goes_on[part]
            beside = stencil.least_beside(s.near, labels, part >= 0)
            closed = np.flatnonzero((part >= 0) & ~apart)
            if len(closed):
                to = stencil.least_of_parts(np.where(apart, -1, part), beside)
                new = stencil.lasting(part[closed], s.t[closed], km2[closed], params.min_area_seed, params.min_lifetime)
                to[new] = _name(threshold - params.min_bt) | index[new]
                labels[closed] = to[part[closed]]
                seen[closed[np.isin(part[closed], new)]] = threshold
            found[apart] = index[part[apart]]
        labels, seen, found, role, beside = (a[inside] for a in (labels, seen, found, role, beside))
        out = cells.take(pa.array(row)).select([f.split()[0] for f in _CELL.split(", ")])
        pending = found >= 0
        for name, values, none in (("label", labels, labels == 0), ("detected", seen, seen == 0), ("root", found, ~pending), ("role", role, role == 0 if params.exact_scan else ~pending), ("beside", beside, ~pending | (beside == 0))):
            out = out.set_column(out.column_names.index(name), name, pa.array(values, mask=none))
        return out

    return run


#: Systems of large regions are named by their threshold and the first voxel of their seed until the end, above all labels carried over; names come in the order of the numbers.
_CELL = "t int, y int, x int, bt double, area double, q int, own long, visited double, label long, detected int, root long, role int, beside long"
_FACE = "t int, y int, x int, q int, level int, source long, label long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_OWN = (1 << 48) - 1


def _name(above: int) -> int:
    return (above + 1) << 48


def _given(state: DataFrame, step: tuple, params: RunParams, ny: int, nx: int, tile: tuple[int, int, int], rim: int) -> DataFrame:
    """(root, label, detected) of the parts of tiles that hang together across faces: a new system's name if they last, else the least label that they touch."""
    threshold = step[3]
    pending = state.where("root is not null")
    face, elsewhere = F.lit(False), F.lit(False)
    for c, n in zip("tyx", tile, strict=True):
        face = face | F.pmod(c, F.lit(n)).isin(0, n - 1)
        elsewhere = elsewhere | (F.floor(F.col(f"n{c}") / n) != F.floor(F.col(c) / n))
    ends = pending.where(face).select("t", "y", "x", "root", "role")
    there = ends.select(F.col("t").alias("nt"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("root").alias("other"))
    edges = shifted(ends.where("role = 2"), TEN).where(elsewhere).join(there, ["nt", "ny", "nx"]).select("root", "other")
    joined = (joined_up(edges, "root", "other") if rim * len(TEN) <= LAST_EDGES else connected_components(edges, "root", "other")).withColumnRenamed("id", "root")
    parts = pending.groupBy("root", "t").agg(F.sum(F.floor("area")).alias("area"), F.min("beside").alias("beside"), F.max("role").alias("role"))
    lone = pending.where("role = 0").select("root").distinct().withColumn("lone", F.lit(True))  # by its own tile's starts not reached
    named = parts.join(joined, "root", "left").join(lone, "root", "left").withColumn("component", F.coalesce("component", F.when(F.col("lone").isNull(), F.col("root"))))
    named = materialize(named.where("component is not null").select("root", "component", "t", "area", "beside"), "parts")
    frames = named.groupBy("component", "t").agg(F.sum("area").alias("area"))
    new = seed_records(frames, params.min_area_seed, params.min_lifetime).where("accepted").select("component", F.col("component").bitwiseOR(F.lit(_name(threshold - params.min_bt))).alias("name"))
    touched = named.groupBy("component").agg(F.min("beside").alias("beside"))
    out = named.select("root", "component").distinct().join(touched, "component").join(new, "component", "left")
    given = materialize(out.select("root", F.coalesce("name", "beside").alias("label"), F.when(F.col("name").isNotNull(), threshold).otherwise(0).alias("detected")).where("label is not null"), "given")
    discard(named)
    return given


_SCANNED = "kind int, cell long, by long, part long, km2 double, tile_t int, tile_y int, tile_x int"
#: What a tile tells of its scan: voxels of its own and their part, names that its visits give on and beyond its faces, tiles next to those that changed (in cell, by, part), and what parts met.
_OF_PART, _GIVEN, _AGAIN, _MET = range(4)


def _scan_tile(threshold: int, ny: int, nx: int, tile: tuple[int, int, int]):
    """The visits of one scan in a tile, beside names that visits in other tiles give, as they told; cells are the tile's and those next to it."""

    def run(cells: pa.Table, notes: pa.Table) -> pa.Table:
        fields = [f.split() for f in _SCANNED.split(", ")]
        here = cells.column("here").to_numpy(zero_copy_only=False)
        if not here.any():
            return pa.table({name: pa.array([], _ARROW[kind]) for name, kind in fields})
        cells = cells.take(stencil.scan_order(*(cells.column(c).to_numpy() for c in "tyx")))
        here = cells.column("here").to_numpy(zero_copy_only=False)
        t, y, x, own, bt, km2 = (cells.column(c).to_numpy() for c in ("t", "y", "x", "own", "bt", "km2"))
        label = cells.column("label").fill_null(0).to_numpy()
        first = int(np.argmax(here))
        mine = [int(c[first]) // n for c, n in zip((t, y, x), tile, strict=True)]

        def visited_here(by: np.ndarray) -> np.ndarray:
            at = (by // (ny * nx), by // nx % ny, by % nx)
            return (by >= 0) & np.logical_and.reduce([c // n == m for c, n, m in zip(at, tile, mine, strict=True)])

        cell, by, part = (notes.column(c).to_numpy() for c in ("cell", "by", "part"))
        before = visited_here(by)
        had = set(zip(cell[before].tolist(), by[before].tolist(), part[before].tolist(), strict=True))
        cell, by, part = (a[~before][np.argsort(by[~before], kind="stable")] for a in (cell, by, part))
        at = np.minimum(np.searchsorted(own, cell), len(own) - 1)
        known = own[at] == cell
        told = list(zip(by[known].tolist(), at[known].tolist(), (~part[known]).tolist(), strict=True))
        rim = (x == 0) | (x == nx - 1) | (y == 0) | (y == ny - 1)
        name, gave, met = stencil.scan(stencil.neighbour_table(t, y, x, SCAN), own, (bt > 0) & (bt <= threshold), label, here & ~rim, told)
        face = ~here
        for c, n in zip((t, y, x), tile, strict=True):
            face |= (c % n == 0) | (c % n == n - 1)
        of_part, given = np.flatnonzero(here & (name < 0)), np.flatnonzero(face & visited_here(gave))
        now = set(zip(own[given].tolist(), gave[given].tolist(), (~name[given]).tolist(), strict=True))
        changed = np.unique(np.array([c for c, _, _ in had ^ now], np.int64))
        places = np.stack([changed // (ny * nx), changed // nx % ny, changed % nx], 1)
        again = np.unique((places[:, None, :] + np.array(((0, 0, 0), *TEN))[None]).reshape(-1, 3) // np.array(tile), axis=0) if len(changed) else np.empty((0, 3), np.int64)
        again = again[(again != np.array(mine)).any(1)]
        pairs = np.array([(other, when, ~p) for p, others in met.items() for other, when in others.items()], np.int64).reshape(-1, 3)
        sizes = [len(of_part), len(given), len(again), len(pairs)]
        out = {
            "kind": np.repeat(np.array([_OF_PART, _GIVEN, _AGAIN, _MET], np.int32), sizes),
            "cell": np.r_[own[of_part], own[given], again[:, 0], pairs[:, 0]],
            "by": np.r_[gave[of_part], gave[given], again[:, 1], pairs[:, 1]],
            "part": np.r_[~name[of_part], ~name[given], again[:, 2], pairs[:, 2]],
            "km2": np.r_[km2[of_part], np.zeros(sum(sizes[1:]))],
        }
        return pa.table(out | {f"tile_{c}": np.full(sum(sizes), m, np.int32) for c, m in zip("tyx", mine, strict=True)})

    return run


def _absorbing(table: pa.Table) -> pa.Table:
    """(component, last): the systems that absorb some components, by all that their parts met (part, other, when)."""
    table = table.sort_by([("part", "ascending"), ("when", "ascending")])
    met: dict[int, list[int]] = {}
    for part, other in zip(table.column("part").to_pylist(), table.column("other").to_pylist(), strict=True):
        met.setdefault(~part, []).append(other)
    _, absorbs = stencil.joined_in_order(met)
    return pa.table({"component": pa.array([~p for p in absorbs], pa.int64()), "last": pa.array(list(absorbs.values()), pa.int64())})


def _scan_of_large(state: DataFrame, threshold: int, params: RunParams, ny: int, nx: int, tile: tuple[int, int, int], slots: tuple[int, int]) -> DataFrame:
    """(own, label, detected, tile) of the voxels that one scan over all tiles names: ``stencil.scanned``, divided.

    A voxel is named once, by the first visit that reaches it, so what a visit finds follows from the visits before it alone. Every tile runs its own visits beside the names that
    visits of other tiles give to voxels next to it, as far as it was told, and tells them its own; it runs again when some that it was told changed. When none does, all
    is as the one scan has it: the first visit that differed would have been told right. Only names on faces are kept between rounds. Components of parts that fail and touch
    several systems are walked in the order of the scan, each as the graph of its parts; all others need no order.
    """
    tiles, position = [f"tile_{c}" for c in "tyx"], lambda c: (F.floor(c / (ny * nx)).cast("int"), (F.floor(c / nx) % ny).cast("int"), (c % nx).cast("int"))
    last = (slots[1], ny - 1, nx - 1)

    def near(df: DataFrame, at: Sequence[Column]) -> DataFrame:
        """Rows once for each tile that their voxel lies in (``here``) or next to."""
        face, touches, o = F.lit(False), F.lit(True), F.col("_o")
        for c, n in zip(at, tile, strict=True):
            face = face | F.pmod(c, F.lit(n)).isin(0, n - 1)
        to = df.drop(*tiles).withColumn("_o", F.explode(F.when(face, offsets(((0, 0, 0), *TEN))).otherwise(offsets(((0, 0, 0),)))))
        to = to.withColumns({name: (F.floor(c / n) + o[f"d{axis}"]).cast("int") for name, c, n, axis in zip(tiles, at, tile, "tyx", strict=True)})
        for name, c, n, end, low, axis in zip(tiles, at, tile, last, (slots[0], 0, 0), "tyx", strict=True):
            d, within = o[f"d{axis}"], F.pmod(c, F.lit(n))
            touches = touches & ((d == 0) | ((d == -1) & (within == 0)) | ((d == 1) & (within == n - 1))) & F.col(name).between(low // n, end // n)
        return to.where(touches).withColumn("here", o["k"] == 0).drop("_o")

    cold = (F.col("bt") > 0) & (F.col("bt") <= threshold)
    cells = state.where((F.col("role") == 1) & (cold | F.col("label").isNotNull())).select("t", "y", "x", "own", "bt", F.coalesce(F.floor(F.nanvl("area", F.lit(None).cast("double"))), F.lit(0)).cast("double").alias("km2"), "label")
    cells = near(cells, [F.col(c) for c in "tyx"])
    rounds: list[tuple[DataFrame, DataFrame | None]] = []

    def latest() -> DataFrame:
        out = rounds[0][0]
        for told, ran in rounds[1:]:
            out = out.join(F.broadcast(ran), tiles, "left_anti").unionByName(told)
        return out

    only: DataFrame | None = None
    while True:
        notes = latest().where(F.col("kind") == _GIVEN) if rounds else cells.where("false").select(F.col("own").alias("cell"), F.col("own").alias("by"), F.col("own").alias("part"))
        notes = near(notes.select("cell", "by", "part"), position(F.col("cell")))
        active = cells
        if only is not None:
            active, notes = (df.join(F.broadcast(only), tiles, "left_semi") for df in (cells, notes))  # a row for each tile, at most ten times
        notes = notes.withColumnsRenamed({c: f"to_{c}" for c in tiles})
        out = active.groupBy(*tiles).cogroup(notes.groupBy(*[f"to_{c}" for c in tiles])).applyInArrow(_scan_tile(threshold, ny, nx, tile), _SCANNED)
        seen = Observation()
        rounds.append((materialize(out.observe(seen, F.count(F.when(F.col("kind") == _AGAIN, 1)).alias("again")), "scanned"), only))
        if not seen.get["again"]:
            break
        only = rounds[-1][0].where(F.col("kind") == _AGAIN).select(*[F.col(c).cast("int").alias(name) for c, name in zip(("cell", "by", "part"), tiles, strict=True)])
        if len(rounds) > 6:  # plans stay short however many rounds there are
            whole = materialize(latest(), "scanned")
            only = materialize(only.distinct(), "again")
            discard(*[df for df, _ in rounds])
            rounds = [(whole, None)]
    found, part = latest(), F.col("part")
    seen = Observation()
    met = found.where(F.col("kind") == _MET).groupBy("part", F.col("cell").alias("other")).agg(F.min("by").alias("when"))
    met = materialize(met.observe(seen, F.count("*").alias("n")), "met")
    edges = met.where("other < 0").select("part", F.bitwise_not("other").alias("other")).where("part < other")
    joined = (joined_up(edges, "part", "other") if seen.get["n"] <= 2 * LAST_EDGES else connected_components(edges, "part", "other")).withColumnRenamed("id", "part")
    frames = found.where(F.col("kind") == _OF_PART).groupBy("part", F.floor(F.col("cell") / (ny * nx)).cast("int").alias("t")).agg(F.sum("km2").alias("area"))
    named = materialize(frames.join(joined, "part", "left").withColumn("component", F.coalesce("component", part)), "parts")
    new = seed_records(named.groupBy("component", "t").agg(F.sum("area").alias("area")), params.min_area_seed, params.min_lifetime).where("accepted")
    new = materialize(new.select("component", F.col("component").bitwiseOR(F.lit(_name(threshold - params.min_bt))).alias("name")), "new")
    parts = named.select("part", "component").distinct()
    touched = met.where("other > 0").join(parts, "part").groupBy("component").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    touched = materialize(touched.join(new, "component", "left_anti"), "touched")
    bins = 1 + seen.get["n"] // LAST_EDGES
    several = met.join(parts, "part").join(touched.where("least < most").select("component"), "component", "left_semi").withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins)))
    absorbed = several.select("bin", "part", "other", "when").groupBy("bin").applyInArrow(_absorbing, "component long, last long")
    label = F.coalesce("name", "last", "least")
    given = parts.join(new, "component", "left").join(touched.select("component", "least"), "component", "left").join(absorbed, "component", "left")
    given = given.select("part", label.alias("label"), F.when(F.col("name").isNotNull(), threshold).otherwise(0).alias("detected")).where("label is not null")
    out = found.where(F.col("kind") == _OF_PART).select(F.col("cell").alias("own"), "part", *tiles).join(given, "part").drop("part")
    out = materialize(out, "given")
    discard(met, named, new, touched, *[df for df, _ in rounds])
    return out


def _ladder_of_large(v: DataFrame, params: RunParams, ny: int, nx: int, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """The ladder over regions that no task holds whole: voxels as ``_ladder_group`` gives them.

    The volume is cut into tiles. At each step of the ladder tiles grow until no face has news for another (``growth.Settled``), then detect; only parts on faces, as one row for
    each slot, meet those of other tiles, and what they become reaches the voxels with the next step's notes. Voxels join in when they get cold enough for a step.
    """
    low, high = v.agg(F.min("t"), F.max("t")).first()
    tile = tile or _tile_shape((high + 1, ny, nx), TILE[0] * TILE[1] * TILE[2])
    ends = ((low, high), (0, ny - 1), (0, nx - 1))
    own = v.withColumns({"q": centikelvin(F.col("bt")), "own": voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx), "visited": F.lit(None).cast("double"), "label": F.col("label").cast("long")})
    if params.scan_rules:  # the coldest of the six that decide whether a voxel is isolated
        six = shifted(v.where("bt > 0").select("t", "y", "x", "bt"), [tuple(-d for d in o) for o in SIX]).groupBy("nt", "ny", "nx").agg(F.min("bt").alias("visited"))
        here = six.select(F.col("nt").alias("t"), F.col("ny").alias("y"), F.col("nx").alias("x"), "visited")
        own = own.drop("visited").join(here, ["t", "y", "x"], "left").withColumn("visited", F.when(~is_edge(ny, nx), F.col("visited")))
    none = {"detected": "int", "root": "long", "role": "int", "beside": "long"}
    own = own.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()}).select([f.split()[0] for f in _CELL.split(", ")])
    if params.scan_rules:
        own = materialize(own, "cells")
    tiles = [f"tile_{c}" for c in "tyx"]

    def of(t: Column, y: Column, x: Column) -> dict[str, Column]:
        return {name: F.floor(c / n).cast("int") for name, c, n in zip(tiles, (t, y, x), tile, strict=True)}

    def here(df: DataFrame) -> DataFrame:
        return df.withColumns(of(F.col("t"), F.col("y"), F.col("x")))

    def beside(faces: DataFrame) -> DataFrame:
        """Each face once for every tile that it touches, its own too."""
        shift = shifted(faces, [(0, 0, 0), *TEN])
        return shift.withColumns(of(F.col("nt"), F.col("ny"), F.col("nx"))).select(*faces.columns, *tiles).dropDuplicates(["t", "y", "x", *tiles])

    def news(faces: DataFrame) -> DataFrame:
        """The tiles next to faces."""
        elsewhere = F.lit(False)
        for c, n in zip("tyx", tile, strict=True):
            elsewhere = elsewhere | (F.floor(F.col(f"n{c}") / n) != F.floor(F.col(c) / n))
        return shifted(faces.select("t", "y", "x"), TEN).where(elsewhere).select([c.alias(n) for n, c in of(F.col("nt"), F.col("ny"), F.col("nx")).items()]).distinct()

    state, given, reached, labelled, steps = own.where("label is not null"), None, None, True, _steps(params)
    for at, step in enumerate(steps):
        limit = max(step[0], step[3] or step[0], reached or step[0])
        fresh = own.where("label is null")
        fresh = fresh if reached is None else fresh.where(F.col("bt") > reached)
        cells = here(state.unionByName(fresh if at == len(steps) - 1 else fresh.where(F.col("bt") <= limit)))
        told: list[DataFrame] = []
        named = {"t": "t", "y": "y", "x": "x", "q": "q", "source": "own", "label": "label"}  # columns of their own: the first step's cells are rows of ``own`` too, and joined with these
        empty = own.where("false").select(*[F.col(c).alias(n) for n, c in named.items()], *[F.lit(0).alias(n) for n in ("level", *tiles)], F.lit(True).alias("face"))
        root = F.col("root")
        known = empty if given is None else given.select(
            *[F.lit(0).alias(c) for c in ("t", "y", "x", "q")], F.col("detected").cast("int").alias("level"), F.col("own").alias("source"), "label", *tiles, F.lit(False).alias("face"),
        ) if params.exact_scan else given.select(
            *[F.lit(0).alias(c) for c in ("t", "y", "x", "q")], F.col("detected").cast("int").alias("level"), root.alias("source"), "label",
            *[c.alias(n) for n, c in of(F.floor(root / (ny * nx)), F.floor(root / nx) % ny, root % nx).items()], F.lit(False).alias("face"),
        )

        def notes(known: DataFrame = known, told: Sequence[DataFrame] = told) -> DataFrame:
            out = known
            for faces in told:
                out = out.unionByName(beside(faces).withColumn("face", F.lit(True)))
            return out

        def run(cells: DataFrame, notes: DataFrame, finish: bool, step: tuple = step) -> DataFrame:
            told = notes.withColumnsRenamed({t: f"to_{t}" for t in tiles})
            return cells.groupBy(*tiles).cogroup(told.groupBy(*[f"to_{t}" for t in tiles])).applyInArrow(_ladder_tile(params, step, ends, tile, finish), _CELL if finish else _FACE)

        while labelled:
            active, heard = cells, notes()
            if len(told) > 1:  # the first faces reach nearly every tile
                only = news(told[-1])
                active, heard = cells.join(only, tiles, "left_semi"), heard.join(only, tiles, "left_semi")
            seen = Observation()
            less = materialize(run(active, heard, False).observe(seen, F.count("*").alias("n")), "faces")
            if not seen.get["n"]:
                discard(less)
                break
            told.append(less)
        seen, old = Observation(), (state, *([given] if given is not None else []), *told)
        face = F.lit(False)
        for c, n in zip("tyx", tile, strict=True):
            face = face | F.pmod(c, F.lit(n)).isin(0, n - 1)
        held = F.col("label").isNull() & (F.col("bt") > 0) & (F.col("bt") <= step[3]) if params.exact_scan and step[3] is not None else root.isNotNull()
        state = materialize(run(cells, notes(), True).observe(seen, F.count("label").alias("labels"), F.count(F.when(root.isNotNull() & face, 1)).alias("rim"), F.count(F.when(held, 1)).alias("pending")), "swept")
        discard(*old)
        if not seen.get["pending"]:
            given = None
        elif params.exact_scan:
            given = _scan_of_large(state, step[3], params, ny, nx, tile, (low, high))
        else:
            given = _given(state, step, params, ny, nx, tile, seen.get["rim"])
        labelled = seen.get["labels"] > 0 or given is not None
        reached = limit
    label = F.col("label")
    return state.select("t", "y", "x", "bt", "area", F.when(label <= _OWN, label).cast("int").alias("label"), F.when(label > _OWN, label.bitwiseAND(F.lit(_OWN))).alias("seed"), "detected")


def detect_and_spread(voxels: DataFrame, params: RunParams, ny: int, nx: int, last_label: int | None = None, most: int = REGION_VOXELS, tile: tuple[int, int, int] | None = None, divided: bool = False) -> Segmentation:
    """Segment a volume (t, y, x, bt, area and, for labels carried over, label).

    For each threshold, coldest first: grow the labels into colder voxels, detect new seeds, grow up
    to the next threshold; at last grow once more with a wide temperature margin. Only voxels up to
    the warmest threshold take part. Nothing passes between regions of those that do not touch each other, so regions of up to
    ``most`` voxels go through all thresholds in one task. New systems are named by the first voxel of their seed there, and numbered once at
    the end, by threshold and that voxel, which is the order in which one threshold after the other would number them.
    With ``exact_scan`` seeds, and the systems that absorb what fails, are those of one scan whose order decides (``stencil.scanned``); volumes
    with a larger region are refused unless ``divided``, which runs that scan by tiles in rounds with the same result.
    """
    last = params.first_label if last_label is None else last_label
    warmest = max(t for pair in params.ladder() for t in pair)
    v = voxels if "label" in voxels.columns else voxels.withColumn("label", F.lit(None).cast("int"))
    v = v.where(F.col("bt") <= warmest).select("t", "y", "x", F.col("bt").cast("double").alias("bt"), F.col("area").cast("double").alias("area"), "label")
    v = materialize(with_groups(v, ny, nx, most=most), "volume")
    ready = v.where("group is not null").withColumns({"q": centikelvin(F.col("bt")), "own": voxel_index(F.col("t"), F.col("y"), F.col("x"), ny, nx), "rim": is_edge(ny, nx)})
    swept = materialize(ready.groupBy("group").applyInArrow(_ladder_group(params), _LABELLED), "laddered")
    if not v.where("group is null").isEmpty():
        if params.exact_scan and not divided:
            raise ValueError(f"a region holds more than {most} voxels: set `divided` to scan it by tiles, raise `most`, or leave exact_scan")
        swept = swept.unionByName(_ladder_of_large(v.where("group is null").drop("group"), params, ny, nx, tile))
    frames = swept.where("detected is not null").groupBy(F.col("seed").alias("component"), F.col("detected").alias("threshold"), "t").agg(F.sum(F.floor("area")).alias("area"))
    frames = materialize(frames, "frames")
    found = frames.select("component", "threshold").distinct()
    number = (F.row_number().over(Window.orderBy("threshold", "component")) + last).cast("int")  # a row for each system, not its voxels
    seeds = seed_records(frames, params.min_area_seed, params.min_lifetime).join(found, "component").withColumn("label", number)
    seeds = materialize(seeds, "seeds")
    named = swept.join(seeds.select(F.col("component").alias("seed"), F.col("label").alias("_new")), "seed", "left")
    out = materialize(named.select("t", "y", "x", "bt", "area", F.coalesce("_new", "label").alias("label")), "segmented")
    discard(v, swept)
    by_slot = frames.join(seeds.select("component", "label"), "component").select("label", "t", "area")
    return Segmentation(out, seeds, last + seeds.count(), by_slot)


def chunk_bounds(slots: int, length: int, overlap: int) -> list[tuple[int, int]]:
    """First and last slot of each chunk of ``length``, each overlapping the one before; a lone slot at the end is left out."""
    out, k, end = [], 0, slots - 1
    while (k == 0 and end > 0) or (k >= 1 and k * (length - overlap) + overlap < end):
        lo = k * (length - overlap)
        out.append((lo, min(lo + length - 1, end)))
        k += 1
    return out


def run_chunks(voxels: DataFrame, params: RunParams, ny: int, nx: int, slots: int) -> DataFrame:
    """(chunk, t, y, x, label) of a series cut into overlapping chunks.

    The labels of the last ``overlap_slots`` of a chunk start the next one, and ids go on counting.
    """
    last, before, out = params.first_label, None, None
    for k, (lo, hi) in enumerate(chunk_bounds(slots, params.volume_slots, params.overlap_slots)):
        part = voxels.where(F.col("t").between(lo, hi))
        if before is not None:
            part = carried_over(part, before.where(F.col("t") >= lo))
        seg = detect_and_spread(part, params, ny, nx, last)
        last = seg.last_label
        before = seg.voxels.where("label is not null").select("t", "y", "x", "label")
        labelled = before.select(F.lit(k).alias("chunk"), "t", "y", "x", "label")
        out = labelled if out is None else out.union(labelled)
    return out


def matches(labelled: DataFrame) -> DataFrame:
    """(src, dst): labels of neighbouring chunks (chunk, t, y, x, label) that share most of their voxels with each other; ties go to lesser labels."""
    here, there = (labelled.select((F.col("chunk") + k).alias("at"), "t", "y", "x", F.col("label").alias(n)) for k, n in ((1, "src"), (0, "dst")))
    shared = materialize(here.join(there, ["at", "t", "y", "x"]).groupBy("src", "dst").agg(F.count("*").alias("n")), "shared")
    best = [shared.groupBy(a).agg(F.max(F.struct(F.col("n"), (-F.col(b)).alias("m"))).alias("m")).select(a, (-F.col("m.m")).alias(b)) for a, b in (("src", "dst"), ("dst", "src"))]
    return best[0].join(best[1], ["src", "dst"])


def run_chunks_apart(voxels: DataFrame, params: RunParams, ny: int, nx: int, slots: int) -> DataFrame:
    """(chunk, t, y, x, label) as ``run_chunks``, but all chunks side by side: none waits for the labels of the one before.

    The chunks are put into one volume with an empty slot between them, so nothing passes from one to the next. Systems of neighbouring
    chunks are one if each is the other's largest share of their common slots, and chains of such matches are joined up and numbered
    in the order of their least label. Where systems lie apart this is ``run_chunks`` up to names; where they touch, borders may differ, as a chunk
    does not know how the one before drew them. A system that is found in an overlap by one chunk only keeps a name of its own.
    """
    stride, length = params.volume_slots - params.overlap_slots, params.volume_slots + 1
    own = voxels.join(assign_chunks(voxels.select("t").distinct(), params.volume_slots, params.overlap_slots, slots - 1), "t")
    side = own.withColumn("t", (F.col("chunk") * length + F.col("t") - F.col("chunk") * stride).cast("int"))
    seg = detect_and_spread(side.select("t", "y", "x", "bt", "area"), params, ny, nx)
    chunk = F.floor(F.col("t") / length).cast("int")
    found = seg.voxels.where("label is not null").select(chunk.alias("chunk"), (F.col("t") - chunk * (length - stride)).cast("int").alias("t"), "y", "x", F.col("label").cast("long").alias("label"))
    found = materialize(found, "apart")
    chains = connected_components(matches(found), "src", "dst").select(F.col("id").alias("label"), "component")
    names = found.select("label").distinct().join(chains, "label", "left").withColumn("component", F.coalesce("component", "label"))
    order = (F.dense_rank().over(Window.orderBy("component")) + params.first_label).cast("int")  # a row for each system of a chunk
    return found.join(names.select("label", order.alias("_new")), "label").select("chunk", "t", "y", "x", F.col("_new").alias("label"))
