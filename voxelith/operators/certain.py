"""Compact floods in blocks that settle what nothing from outside can change.

A voxel's key is (height, label, source): of the offers (level / LEVELS + scale * distance to
the source seed) on the way to it the highest, and whose way it is.  A voxel hands on (height
or offer, whichever is higher; its own label and source), and the flood takes voxels in the
order of keys.  That is the flood of the least open offer: what is offered below the height
is taken at once, by the same source, before anything else that lies open.  So keys give the labels of
the chains in ``fronts``, of which they are the beginnings.

A block does not know the keys of open voxels around it, but bounds that they are not below.
It floods from the known voxels, and from these bounds as from one more label that costs no
distance and comes first among equal heights.  Nothing from outside comes to a voxel before
that label does, so a voxel that a source takes first has its final key.  What the label takes
stays open, with the height at which it came as the bound: no key of the voxel is less.

Open voxels, which lie near the faces of blocks, go with the known ones beside them into the
next phase, over blocks with faces elsewhere, which grow from the third on or where a phase
settles little (few seeds, costs alike over long ways).  Where it does and blocks are as large
as they may be, what is left runs as in ``fronts``, with the known ones as sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import inf, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..grid import AXES, Grid, shifted, stencil, with_blocks
from ..lineage import written

#: Kinds of places: of no use, to be settled, known, open and beyond the block.
NOWHERE, OPEN, KNOWN, BEYOND = range(4)
#: Places of the largest blocks, of about 0.8 kB each.
AT_ONCE = 1 << 20
_STATE = ["x", "y", "z", "level", "height", "label", "source", "known"]


def settle(cost: np.ndarray, kind: np.ndarray, height: np.ndarray, rank: np.ndarray, seeds: list[tuple[int, int, int]], scale: float, connectivity: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, rank, reached) of the open places of arrays (z, y, x) with a margin of places of no use.

    ``rank``: of the source of a known place, ``seeds`` its place; -1 comes out where something
    from beyond may come first.  ``height``: keys of known places, bounds of others.
    """
    ny, nx = kind.shape[1:]
    steps = [(dz * ny * nx + dy * nx + dx, 2 * dz, 2 * dy, 2 * dx, dz * dz + dy * dy + dx * dx) for dz, dy, dx in stencil(connectivity)]
    beside = np.any([shifted(kind == OPEN, *d, False) for d in stencil(connectivity)], axis=0)
    start = np.flatnonzero((kind >= KNOWN) & beside)
    free = bytearray((kind == OPEN).astype(np.uint8).tobytes())  # 1: open, 2: a source that has not handed on
    for i in start.tolist():
        free[i] = 2
    own, bound, least = cost.ravel().tolist(), height.ravel().tolist(), [inf] * kind.size
    zs, ys, xs = (a.ravel().tolist() for a in np.indices(kind.shape))
    high, by = bound.copy(), rank.ravel().tolist()
    heap = list(zip(height.ravel()[start].tolist(), rank.ravel()[start].tolist(), start.tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        far, r, at = heapq.heappop(heap)
        if not free[at]:
            continue
        free[at] = 0
        taken = [at]
        if r < 0:
            while taken:
                at = taken.pop()
                high[at], by[at] = far, r
                for step in steps:
                    j = at + step[0]
                    if free[j] == 1:
                        offer = bound[j]
                        if offer <= far:
                            free[j] = 0
                            taken.append(j)
                        elif offer <= least[j]:
                            least[j] = offer
                            heapq.heappush(heap, (offer, r, j))
            continue
        sz, sy, sx = seeds[r]
        while taken:
            at = taken.pop()
            high[at], by[at] = far, r
            dz, dy, dx = zs[at] - sz, ys[at] - sy, xs[at] - sx
            d2 = dz * dz + dy * dy + dx * dx
            for s, az, ay, ax, c in steps:
                j = at + s
                if free[j] == 1 and own[j] <= least[j]:
                    offer = own[j] + scale * sqrt(d2 + az * dz + ay * dy + ax * dx + c)
                    if offer <= far:
                        free[j] = 0
                        taken.append(j)
                    elif offer <= least[j]:
                        least[j] = offer
                        heapq.heappush(heap, (offer, r, j))
    reached = np.frombuffer(bytes(free), np.uint8) != 1
    return np.array(high).reshape(kind.shape), np.array(by, np.int64).reshape(kind.shape), reached.reshape(kind.shape)


def _block(table: pa.Table, dims: tuple[int, int, int], levels: int, scale: float, connectivity: int, first: bool) -> pa.Table:
    """A phase of one block: its voxels that became known (``fresh``), stay open, or are known beside open ones (``needed``)."""
    xyz = [np.asarray(table.column(a)).astype(np.int64) for a in AXES]
    low = [int(c.min()) - 1 for c in xyz]
    shape = tuple(int(c.max()) + 2 - lo for c, lo in zip(reversed(xyz), reversed(low), strict=True))
    at = np.ravel_multi_index(tuple(c - lo for c, lo in zip(reversed(xyz), reversed(low), strict=True)), shape)
    level, tall, label, source, known, own = (np.asarray(table.column(k)) for k in ("level", "height", "label", "source", "known", "own"))
    cost, kind, height, rank = (np.full(int(np.prod(shape)), v, t) for v, t in ((0.0, float), (NOWHERE, np.int8), (0.0, float), (-1, np.int64)))
    cost[at] = level / levels
    kind[at] = np.where(known, KNOWN, np.where(own, OPEN, BEYOND))
    height[at] = np.where(known, tall, np.maximum(tall, cost[at]))
    pairs, which = np.unique(np.stack([label[known], source[known]], axis=1), axis=0, return_inverse=True)
    rank[at[known]] = which.ravel()
    seeds = [(s // (dims[0] * dims[1]) - low[2], s // dims[0] % dims[1] - low[1], s % dims[0] - low[0]) for s in pairs[:, 1].tolist()]
    cost, kind, height, rank = (a.reshape(shape) for a in (cost, kind, height, rank))
    high, by, reached = settle(cost, kind, height, rank, seeds, scale, connectivity)

    still = (kind == BEYOND) | ((kind == OPEN) & reached & (by < 0))
    beside = np.any([shifted(still, *d, False) for d in stencil(connectivity)], axis=0)
    open_ = own & ~known & still.ravel()[at]
    fresh = own & ~open_ & (~known | first)
    needed = own & ~open_ & beside.ravel()[at]
    some = open_ | fresh | needed
    at, known, named = at[some], known[some], by.ravel()[at[some]]
    taken = ~known & (named >= 0)
    label, source, tall = label[some].copy(), source[some].copy(), np.where(known, tall[some], high.ravel()[at])
    label[taken], source[taken] = pairs[named[taken]].T
    keys = {k: table.column(k).filter(pa.array(some)) for k in ("bx", "by", "bz", *AXES, "level")}
    return pa.table(keys | {"height": tall, "label": label, "source": source, "known": ~open_[some], "fresh": fresh[some], "needed": needed[some]})


def _shares() -> Iterator[float]:
    """Where along their edges the blocks of a phase are cut; as blocks grow, away from the faces of those before."""
    yield from (0, 1 / 2, 3 / 8, 7 / 16)
    k = 0
    while True:
        k += 1
        yield k * (sqrt(5) - 1) / 2 % 1


def _grown(edges: tuple[int, int, int], dims: tuple[int, int, int]) -> tuple[int, int, int]:
    """Blocks up to eight times as large, their shortest sides doubled first, of at most ``AT_ONCE`` places."""
    out = list(edges)
    for _ in range(3):
        shorter = [k for k in range(3) if out[k] < dims[k]]
        if not shorter or 2 * prod(min(n, e) for n, e in zip(dims, out, strict=True)) > AT_ONCE:
            break
        out[min(shorter, key=lambda k: out[k])] *= 2
    return tuple(out)


def phases(vox: DataFrame, grid: Grid, edges: tuple[int, int, int], levels: int, scale: float, connectivity: int) -> tuple[DataFrame, DataFrame | None]:
    """(x, y, z, label of what was settled; what is left open with the known voxels beside it, or None).

    ``vox``: x, y, z, level, marker.  What is left: x, y, z, level, height, label, source, known.
    """
    dims, settled = grid.dims, None
    state = vox.select(*AXES, "level", F.lit(0.0).alias("height"), F.col("marker").alias("label"), grid.scan_index().alias("source"), (F.col("marker") != 0).alias("known"))
    schema = "bx int, by int, bz int, x int, y int, z int, level int, height double, label long, source long, known boolean, fresh boolean, needed boolean"
    for k, share in enumerate(_shares()):
        seen = with_blocks(state, grid, edges, 1, offset=tuple(int(share * e) if e < n else 0 for e, n in zip(edges, dims, strict=True)))
        counts = Observation()
        out = seen.groupBy("bx", "by", "bz").applyInArrow(_phase(dims, levels, scale, connectivity, settled is None), schema)
        out = written(out.observe(counts, F.count_if("fresh").alias("fresh"), F.count_if(~F.col("known")).alias("open")), "settled")
        new = out.filter("fresh").select(*AXES, "label")
        settled = new if settled is None else settled.unionByName(new)
        if not counts.get["open"]:
            return settled, None
        state = out.filter("needed or not known").select(*_STATE)
        slow, before = counts.get["open"] > 3 * counts.get["fresh"], edges
        if slow or k:  # few voxels are left, or faces are in the way
            edges = _grown(edges, dims)
        if slow and edges == before:
            return settled, state


def _phase(dims: tuple[int, int, int], levels: int, scale: float, connectivity: int, first: bool):
    def run(table: pa.Table) -> pa.Table:
        return _block(table, dims, levels, scale, connectivity, first)

    return run
