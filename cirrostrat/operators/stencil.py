"""Neighbourhoods inside one bounded group of voxels, as arrays (helpers that run inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np

from cirrostrat.operators.graph import least_reached
from cirrostrat.operators.neighbors import Offset


def scan_order(t: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.lexsort((x, y, t))


def neighbour_table(t: np.ndarray, y: np.ndarray, x: np.ndarray, pattern: Sequence[Offset]) -> np.ndarray:
    """For voxels in scan order, the index of each neighbour of the pattern; the number of voxels where there is none."""
    n = len(t)
    reach = max(max(abs(d) for d in o) for o in pattern)
    high, wide = int(y.max() - y.min()) + 1 + 2 * reach, int(x.max() - x.min()) + 1 + 2 * reach
    key = ((t - t.min()).astype(np.int64) * high + (y - y.min() + reach)) * wide + (x - x.min() + reach)
    near = np.empty((n, len(pattern)), np.int32)
    for k, (dt, dy, dx) in enumerate(pattern):
        want = key + (dt * high + dy) * wide + dx
        at = np.searchsorted(key, want)
        near[:, k] = np.where(key[np.minimum(at, n - 1)] == want, at, n)
    return near


def grown(near: np.ndarray, label: np.ndarray, free: np.ndarray, q: np.ndarray, delta: int) -> np.ndarray:
    """Labels (0: none) after growth into ``free``, as a queue over the labelled voxels in scan order gives them.

    All that one pass over the frontier reaches is what the queue reaches before it comes to those voxels themselves; the
    first frontier voxel, and its first neighbour number, claims.
    """
    n, label = len(label), label.copy()
    frontier = np.flatnonzero(label)
    while len(frontier):
        to, of = near[frontier].ravel(), np.repeat(frontier, near.shape[1])
        there = to < n
        to, of = to[there], of[there]
        open_ = free[to] & (label[to] == 0) & (q[to] + delta >= q[of])
        to, of = to[open_], of[open_]
        first = np.sort(np.unique(to, return_index=True)[1])
        frontier = to[first]
        label[frontier] = label[of[first]]
    return label


#: A key that no source has reached.
FAR = np.iinfo(np.int64).max


def least_keys(near: np.ndarray, key: np.ndarray, free: np.ndarray, q: np.ndarray, delta: int) -> np.ndarray:
    """Least keys (level << 32 | rank of the source) after growth into ``free``, from keys that sources and faces of other tiles have.

    Voxels are settled level by level, so each hands on its key once.
    """
    n, key = len(key), key.copy()
    waits = np.flatnonzero(key < FAR)
    waits = waits[np.argsort(key[waits], kind="stable")]
    told = key[waits] >> 32
    level, taken, frontier = (int(told[0]) if len(waits) else 0), 0, np.empty(0, np.int64)
    while taken < len(waits) or len(frontier):
        if not len(frontier):
            level = int(told[taken])
        upto = int(np.searchsorted(told, level, side="right"))
        late = waits[taken:upto]
        frontier, taken = np.unique(np.r_[frontier, late[key[late] >> 32 == level]]), upto
        to, of = near[frontier].ravel(), np.repeat(frontier, near.shape[1])
        there = to < n
        to, of = to[there], of[there]
        offer = ((level + 1) << 32) | (key[of] & 0xFFFFFFFF)
        better = free[to] & (offer < key[to]) & (q[to] + delta >= q[of])
        to, offer = to[better], offer[better]
        np.minimum.at(key, to, offer)
        frontier, level = np.unique(to), level + 1
    return key


def parts(near: np.ndarray, member: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each voxel the least index of the members that hang together with it, or -1.

    Pairs lead from members that start a component or hand it on to any member.
    """
    n, root = len(member), np.where(member & starts, np.arange(len(member)), -1)
    of = np.repeat(np.flatnonzero(member & starts), near.shape[1])
    to = near[member & starts].ravel()
    there = to < n
    to, of = to[there], of[there]
    pair = member[to]
    nodes, least = least_reached(of[pair].astype(np.int64), to[pair].astype(np.int64))
    root[nodes] = least
    return root


def least_beside(near: np.ndarray, label: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The least label (0: none) among the neighbours of each member."""
    far = np.iinfo(np.int64).max
    padded = np.r_[np.where(label > 0, label, far), far]
    least = padded[near].min(1)
    return np.where(member & (least < far), least, 0)


def least_of_parts(root: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """By root, the least label (0: none) beside the voxels of its part."""
    least = np.full(len(root), FAR)
    touch = np.flatnonzero((root >= 0) & (beside > 0))
    np.minimum.at(least, root[touch], beside[touch])
    return np.where(least < FAR, least, 0)


def lasting(part: np.ndarray, slot: np.ndarray, km2: np.ndarray, min_area: float, min_lifetime: int) -> np.ndarray:
    """The parts (of voxels' part, slot and whole km2) that last: the rule of ``seeds.seed_records``."""
    parts, of = np.unique(part, return_inverse=True)
    slots = slot - slot.min()
    cell, at = np.unique(of * (int(slots.max()) + 1) + slots, return_inverse=True)
    owner, when = np.divmod(cell, int(slots.max()) + 1)
    area = np.bincount(at, km2)
    first, last = np.full(len(parts), when.max() + 1), np.full(len(parts), -1)
    np.minimum.at(first, owner, when)
    np.maximum.at(last, owner, when)
    large = np.flatnonzero(area >= min_area)
    owns, whens = owner[large], when[large]
    begins = np.r_[True, (owns[1:] != owns[:-1]) | (whens[1:] != whens[:-1] + 1)] if len(large) else np.empty(0, bool)
    runs = np.bincount(np.cumsum(begins) - 1) if len(large) else np.empty(0, np.int64)
    longest = np.zeros(len(parts), np.int64)
    np.maximum.at(longest, owns[begins], runs)
    total = np.bincount(owner, area, len(parts))
    return parts[(last - first + 1 >= min_lifetime) & (longest >= max(1, min_lifetime)) & (total >= min_area * min_lifetime)]


def scan(
    near: np.ndarray, own: np.ndarray, cold: np.ndarray, label: np.ndarray, mayvisit: np.ndarray, told: Sequence[tuple[int, int, int]] = ()
) -> tuple[np.ndarray, np.ndarray, dict[int, dict[int, int]]]:
    """One scan over voxels in order of ``own``, visit by visit: the name of each voxel, the visit that gave it (-1: none), and what each part met, and when.

    ``near`` has a voxel and its neighbours in the pattern ``SCAN``. Voxels are visited in order, but for those that ``mayvisit`` rules out and those without a cold
    one among their six deciding neighbours. A visit with no name around starts a part; the first name around, if it is a part's, spreads to the free
    cold voxels around; several names around become neighbours of the first, and it theirs. Names above 0 are systems' labels; a part's is the complement of the
    ``own`` of its first voxel. A voxel is named once and for all; ``told`` (visit, voxel, name), by visits, are names that visits elsewhere give.
    """
    n, held = len(label), np.r_[cold & (label == 0), False]
    beside = np.r_[cold, False][near[:, 1:7]].any(1)
    visits = np.flatnonzero(cold & mayvisit & beside & held[near].any(1))  # elsewhere a visit finds nothing to spread to, nor a part
    lab, free, gave = [*label.tolist(), 0], held.tolist(), [-1] * n
    met: dict[int, dict[int, int]] = {}
    waits, news = len(told), 0
    for i, when, cells in zip(visits.tolist(), own[visits].tolist(), near[visits].tolist(), strict=True):
        while news < waits and told[news][0] < when:
            by, c, name = told[news]
            news += 1
            if free[c]:
                lab[c], free[c], gave[c] = name, False, by
        around = list(dict.fromkeys([k for c in cells if (k := lab[c])]))
        if not around:
            around = [~when]
            met[~when] = {}
            lab[i], free[i], gave[i] = ~when, False, when
        first = around[0]
        if first < 0:
            for c in cells:
                if free[c]:
                    lab[c], free[c], gave[c] = first, False, when
        if len(around) > 1:
            for k, other in enumerate(around):
                if first < 0:
                    met.setdefault(first, {}).setdefault(other, 16 * when + k)
                if other < 0:
                    met.setdefault(other, {}).setdefault(first, 16 * when + k)
    for by, c, name in told[news:]:
        if free[c]:
            lab[c], free[c], gave[c] = name, False, by
    return np.array(lab[:n], np.int64), np.array(gave, np.int64), met


def joined_in_order(met: Mapping[int, Iterable[int]]) -> tuple[dict[int, int], dict[int, int]]:
    """The oldest part that each part of a scan hangs together with, and for these the system that would absorb the whole.

    Parts join up from the oldest on, depth first and in the order in which neighbours were met, but never through a system; the last system met so absorbs.
    """
    top: dict[int, int] = {}
    absorbs: dict[int, int] = {}
    for part in sorted(met, reverse=True):
        if part in top:
            continue
        top[part], ways = part, [iter(met[part])]
        while ways:
            other = next(ways[-1], None)
            if other is None:
                ways.pop()
            elif other > 0:
                absorbs[part] = other
            elif other not in top:
                top[other] = part
                ways.append(iter(met[other]))
    return top, absorbs


def scanned(near: np.ndarray, cold: np.ndarray, label: np.ndarray, rim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that one scan over all voxels finds: for each voxel the one that started its part or -1, and for each that started one the label that would absorb it."""
    n = len(label)
    name, _, met = scan(near, np.arange(n), cold, label, ~rim)
    top, absorbs = joined_in_order(met)
    begun, absorbed = np.full(n + 1, -1), np.zeros(n, np.int64)
    for part, first in top.items():
        begun[~part] = ~first
    for part, system in absorbs.items():
        absorbed[~part] = system
    return begun[np.where(name < 0, ~name, n)], absorbed
