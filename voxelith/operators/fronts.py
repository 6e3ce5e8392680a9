"""Floods of volumes of any size, block by block, equal to the flood of the whole.

A voxel's key is (level, steps, label).  A flood takes voxels in the order of their keys; a
marker has key (0, 0, label), and a voxel the least of what its neighbours hand on:

    geodesic: (max(level, own level), steps + 1, label)
    arrival:  (own level, 0, label) where the flood has to rise, else (level, steps + 1, label)

A compact flood takes the least of the offers (level / LEVELS + scale * distance to the source
seed, label, source, place) that lie open, which may be less than one taken before.  There a
key is the chain of offers on the way that exceed all later ones, compared from the first (a
beginning is less than what it begins): of two offers the one behind the lower highest offer
is taken first; if that is the same, what comes behind it decides, in the same way.  Handing
on drops the offers at the chain's end that are less than the new one, and adds that.

Handing on makes keys greater, so with n's key final before j's is taken the equations
key(j) = least handed-on key of j's neighbours have one solution.  Blocks solve their own
equations, with the keys of the voxels around them as those blocks last told them, again
whenever one of these changes, from scratch.  Where no block changes, all equations hold, so
the keys are those of the whole.

It ends: of the voxels with a wrong key after a round let m be the least of their present and
final keys.  A wrong key comes from a wrong one that is less, before or after; following these
leads out of the block, to a voxel that was wrong a round earlier and whose key is less.  So m
grows with each round, and there are finitely many keys.  Keys may rise again on the way (of
compact floods), so a block never keeps an old key for being less.

Levels and steps settle one after the other.  A way with few steps may turn out not to be the
one on the lowest level; blocks would then hand its steps back and forth, one more each time,
until they exceed the right ones.  So blocks first tell each other levels alone, which only
fall; these fix from where a key may come.  Then they tell steps and labels, with UNKNOWN for
voxels nothing was told of yet, and over fixed pairs these only fall too (by ``arrival`` labels
follow when the steps are right).  Each takes as many rounds as ways cross blocks.

The volume is written once, a row of arrays a block; rounds move only the keys of voxels at
blocks' faces, and only blocks that were told something new work.

A compact flood first settles in phases all that a block can settle without being told (see
``certain``); only what these leave open is told as chains.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Grid, joined_blocks, stencil
from ..lineage import discard, written
from . import certain

RULES = ("geodesic", "arrival")
LEVELS = 65535
#: Steps and label of a voxel whose level only is told yet.
UNKNOWN = (1 << 46, (1 << 62) - 1)
#: Arrays of fewer places are flooded place by place.
SMALL = 4096
_BLOCK = ["bx", "by", "bz"]
_KEY = "level int, steps long, label long"
_CHAIN = "chain binary, label long"


def extents(dims: tuple[int, int, int], edge: int) -> tuple[int, int, int]:
    """Sizes of a block: cubes of ``edge``; where a volume is thinner, as many voxels along its other axes."""
    out = [min(edge, n) for n in dims]
    for k in sorted(range(3), key=lambda k: dims[k]):
        out[k] = max(1, min(dims[k], max(out[k], edge**3 * out[k] // max(1, out[0] * out[1] * out[2]))))
    return tuple(out)


def _once(j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each place of ``j`` once; ``at`` is room for an index a place."""
    n = np.arange(len(j))
    at[j] = n
    return j[at[j] == n]


class _Slow(Exception):
    """Fronts so thin that array operations do not pay."""


def block_edge(dims: tuple[int, int, int]) -> int:
    """64; in volumes of more than 2^23 places up to 128, so that there are 32 blocks and few rounds."""
    return min(128, max(64, round((dims[0] * dims[1] * dims[2] / 32) ** (1 / 3))))


def settle(level: np.ndarray, sources: Iterable[tuple[int, int, int, int]], connectivity: int = 6, rule: str = "geodesic", only_levels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, steps, label) of each place of an array of levels; where nothing came level is -1.

    ``level``: -1 outside the domain; ``sources``: (flat index, level, steps, label), they keep
    their keys; ``only_levels``: steps and labels are not wanted.

    Whole fronts of places move at once.  First the levels, the least over all ways of the
    highest level on the way, in bands from below.  They fix from where a key may come: n hands
    its level on to j only where max(level of n, own level of j) is j's.  Over these pairs steps
    are those of a breadth-first search (by ``arrival`` from all places that a lower one rises
    to), and the label is the least one among the ways with fewest steps.  Winding ways, whose
    fronts are few places each, and small arrays are taken in the order of keys instead.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    sources = list(sources)
    if level.size < SMALL:
        return settle_in_order(level, sources, connectivity, rule)
    try:
        return _fronts(level, sources, connectivity, rule == "arrival", only_levels)
    except _Slow:
        return settle_in_order(level, sources, connectivity, rule)


def _fronts(level: np.ndarray, sources: list[tuple[int, int, int, int]], connectivity: int, rises: bool, only_levels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, far, inner = tuple(n + 2 for n in level.shape), np.int64(1) << 62, (slice(1, -1),) * 3
    own = np.full(shape, -1, np.int64)
    own[inner] = level
    own = own.ravel()
    high, steps, label, room = (np.full(own.size, v, np.int64) for v in (far, far, far, 0))
    step = [dz * shape[1] * shape[2] + dy * shape[2] + dx for dz, dy, dx in stencil(connectivity)]
    free = own >= 0
    given = np.array(sources, np.int64).reshape(-1, 4)
    start = np.ravel_multi_index(tuple(k + 1 for k in np.unravel_index(given[:, 0], level.shape)), shape) if len(given) else np.zeros(0, np.int64)
    free[start] = False  # nothing is handed to a source
    high[start], steps[start], label[start] = given[:, 1:].T
    left = 1000 + own.size // 40

    def turn() -> None:
        nonlocal left
        left -= 1
        if left < 0:
            raise _Slow

    later = [start]
    for limit in (*np.unique(np.quantile(own[free], np.linspace(0, 1, 33)[1:-1], method="lower") if free.any() else []), far):
        waiting = _once(np.concatenate(later), room)
        below = high[waiting] <= limit
        front, later = waiting[below], [waiting[~below]]
        while len(front):
            turn()
            from_, found = high[front], []
            for s in step:
                j = front + s
                new = np.maximum(from_, own[j])
                less = free[j] & (new < high[j])
                j = j[less]
                high[j] = new[less]
                found.append(j)
            front = _once(np.concatenate(found), room)
            below = high[front] <= limit
            later.append(front[~below])
            front = front[below]

    if only_levels:
        return np.where(high == far, -1, high).reshape(shape)[inner], steps.reshape(shape)[inner], label.reshape(shape)[inner]
    if rises:
        lower = np.zeros(own.size, bool)
        at = np.flatnonzero(free & (own == high))
        for s in step:
            lower[at] |= high[at + s] < high[at]
        roots = np.flatnonzero(lower)
        steps[roots] = 0
        begin = np.concatenate([start, roots])
    else:
        begin = start
    begin = begin[np.argsort(steps[begin], kind="stable")]
    counts, firsts = np.unique(steps[begin], return_index=True)
    ends, k, n, front = [*firsts[1:].tolist(), len(begin)], 0, 0, np.zeros(0, np.int64)
    while len(front) or k < len(counts):
        if not len(front):
            n = int(counts[k])
        if k < len(counts) and counts[k] == n:
            front = np.concatenate([front, begin[firsts[k] : ends[k]]])
            k += 1
        turn()
        from_, named, found = high[front], label[front], []
        for s in step:
            j = front + s
            some = free[j] & (steps[j] > n)
            some &= high[j] == (from_ if rises else np.maximum(from_, own[j]))
            j = j[some]
            fresh = steps[j] > n + 1
            if not rises:
                label[j] = np.where(fresh, named[some], np.minimum(label[j], named[some]))
            j = j[fresh]
            steps[j] = n + 1
            found.append(j)
        front, n = np.concatenate(found), n + 1

    front = start if rises else front[:0]
    while len(front):
        turn()
        from_, count, named, found = high[front], steps[front], label[front], []
        for s in step:
            j = front + s
            up = (high[j] > from_) & (own[j] == high[j])
            less = free[j] & (up | (high[j] == from_) & (steps[j] == count + 1)) & (named < label[j])
            j = j[less]
            label[j] = named[less]
            found.append(j)
        front = _once(np.concatenate(found), room)

    none = high == far
    out = np.where(none, -1, high), np.where(none, 0, steps), np.where(none, 0, label)
    return tuple(a.reshape(shape)[inner] for a in out)


def settle_in_order(level: np.ndarray, sources: Iterable[tuple[int, int, int, int]], connectivity: int = 6, rule: str = "geodesic") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``settle``, one place after the other: keys are packed into one integer, in whose order they are taken."""
    rises = rule == "arrival"
    shape = tuple(n + 2 for n in level.shape)
    c = np.full(shape, -1, np.int64)
    c[1:-1, 1:-1, 1:-1] = level
    step = [dz * shape[1] * shape[2] + dy * shape[2] + dx for dz, dy, dx in stencil(connectivity)]
    sources = list(sources)
    names = sorted({s[3] for s in sources})
    rank = {v: k for k, v in enumerate(names)}
    place, label_bits = int(c.size).bit_length(), len(names).bit_length()
    down, up = place + label_bits, place + label_bits + 48
    mask, steps_mask = (1 << place) - 1, (1 << 48) - 1
    cost, best = c.ravel().tolist(), {}
    heap = []
    for i, high, steps, label in sources:
        z, y, x = np.unravel_index(i, level.shape)
        at = int(((z + 1) * shape[1] + y + 1) * shape[2] + x + 1)
        cost[at] = -1  # nothing is handed to a source
        entry = (((high << 48 | steps) << label_bits | rank[label]) << place) | at
        best[at] = entry
        heap.append(entry)
    heapq.heapify(heap)
    one = 1 << down
    while heap:
        entry = heapq.heappop(heap)
        at = entry & mask
        if best[at] != entry:
            continue
        high, key = entry >> up, entry - at
        for s in step:
            j = at + s
            own = cost[j]
            if own < 0:
                continue
            if own <= high:
                new = key + one + j
            elif rises:
                new = (own << up) | (key & (one - 1)) | j
            else:
                new = (own << up) | (key + one & (one << 48) - 1) | j
            if j not in best or new < best[j]:
                best[j] = new
                heapq.heappush(heap, new)
    high, steps, label = np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    if best:
        at = np.fromiter(best.keys(), np.int64, len(best))
        entries = list(best.values())
        high.ravel()[at] = [e >> up for e in entries]
        steps.ravel()[at] = [e >> down & steps_mask for e in entries]
        label.ravel()[at] = np.array(names, np.int64)[[e >> place & (1 << label_bits) - 1 for e in entries]]
    inner = (slice(1, -1),) * 3
    return high[inner], steps[inner], label[inner]


def settle_chains(level: np.ndarray, sources: Iterable[tuple[int, tuple]], low: Iterable[int], dims: tuple[int, int, int], scale: float, connectivity: int = 6) -> dict[int, tuple]:
    """Chain of each reached place (flat index) of an array of levels whose first voxel is ``low`` (x, y, z).

    ``level``: -1 outside the domain; ``sources``: (flat index, chain), they keep their chains.
    A chain is one flat tuple of offers.
    """
    lx, ly, lz = low
    nz, ny, nx = (n + 2 for n in level.shape)
    c = np.full((nz, ny, nx), -1, np.int64)
    c[1:-1, 1:-1, 1:-1] = level
    step = [(dz * ny * nx + dy * nx + dx, dz, dy, dx) for dz, dy, dx in stencil(connectivity)]
    cost, done, heap, out = c.ravel().tolist(), bytearray(c.size), [], {}
    row, layer = dims[0], dims[0] * dims[1]
    for i, chain in sources:
        z, rest = divmod(i, level.shape[1] * level.shape[2])
        y, x = divmod(rest, level.shape[2])
        at = ((z + 1) * ny + y + 1) * nx + x + 1
        cost[at] = -1  # nothing is handed to a source
        heap.append((chain, at))
    heapq.heapify(heap)
    while heap:
        chain, at = heapq.heappop(heap)
        if done[at]:
            continue
        done[at] = 1
        z, rest = divmod(at, ny * nx)
        y, x = divmod(rest, nx)
        out[((z - 1) * level.shape[1] + y - 1) * level.shape[2] + x - 1] = chain
        z, y, x = z + lz - 1, y + ly - 1, x + lx - 1
        label, source = chain[-3], chain[-2]
        sz, rest = divmod(source, layer)
        sy, sx = divmod(rest, row)
        for s, dz, dy, dx in step:
            j = at + s
            if cost[j] < 0 or done[j]:
                continue
            jz, jy, jx = z + dz, y + dy, x + dx
            offer = (cost[j] / LEVELS + scale * sqrt((jz - sz) ** 2 + (jy - sy) ** 2 + (jx - sx) ** 2), label, source, jx + jy * row + jz * layer)
            n = len(chain)
            while n and chain[n - 4 : n] < offer:
                n -= 4
            if n and chain[n - 4 : n] == offer:
                continue  # the way has been here: what is told comes from this block's own old chains
            heapq.heappush(heap, (chain[:n] + offer, j))
    return out


def _side(d: int) -> slice:
    return {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[d]


class Front:
    """What a block knows, and what it tells its neighbours."""

    def __init__(self, block: pa.Table, edges: tuple[int, int, int], dims: tuple[int, int, int], connectivity: int, rule: str, scale: float = 0.0):
        row = {k: block.column(k)[0].as_py() for k in block.column_names}
        self.b = tuple(row[k] for k in _BLOCK)
        self.low = [k * e for k, e in zip(self.b, edges, strict=True)]
        shape = tuple(min(e, n - lo) for e, n, lo in zip(reversed(edges), reversed(dims), reversed(self.low), strict=True))
        # the ring around stays out of the domain: keys there are given
        self.level = np.full(tuple(n + 2 for n in shape), -1, np.int64)
        self.level[1:-1, 1:-1, 1:-1] = np.frombuffer(row["levels"], np.int32).reshape(shape)
        at = np.array(np.unravel_index(np.frombuffer(row["places"], np.int32), shape)) + 1
        flat = np.ravel_multi_index(tuple(at), self.level.shape)
        self.markers = [(int(i), 0, 0, int(v)) for i, v in zip(flat, np.frombuffer(row["labels"], np.int64), strict=True)]
        self.given = [np.frombuffer(row[k], t).tolist() for k, t in (("heights", float), ("sources", np.int64))] if rule == "compact" else []
        self.connectivity, self.rule, self.dims, self.scale = connectivity, rule, dims, scale

    def settled(self, told: pa.Table, only_levels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the block's own voxels; ``told``: x, y, z, level, steps, label around it."""
        x, y, z = (np.asarray(told.column(a)).astype(np.int64) - lo + 1 for a, lo in zip(AXES, self.low, strict=True))
        around = np.ravel_multi_index((z, y, x), self.level.shape) if len(x) else np.zeros(0, np.int64)
        if self.rule == "compact":
            return self.chained(around.tolist(), told.column("chain").to_pylist())
        sources = [*self.markers, *zip(around.tolist(), *(told.column(k).to_pylist() for k in ("level", "steps", "label")), strict=True)]
        inner = (slice(1, -1),) * 3
        high, steps, label = (a[inner] for a in settle(self.level, sources, self.connectivity, self.rule, only_levels))
        return (high, *(np.full(high.shape, k) for k in UNKNOWN)) if only_levels else (high, steps, label)

    def chained(self, around: list[int], told: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(0 where reached, else -1; chains; labels)."""
        (dx, dy, _), low, shape = self.dims, [lo - 1 for lo in self.low], self.level.shape
        at = np.unravel_index([m[0] for m in self.markers], shape) if self.markers else ((), (), ())
        scan = [int(x + low[0] + (y + low[1]) * dx + (z + low[2]) * dx * dy) for z, y, x in zip(*at, strict=True)]
        sources = [(m[0], (high, m[3], source, i)) for m, high, source, i in zip(self.markers, *self.given, scan, strict=True)]
        sources += [(i, struct.unpack("<" + "dqqq" * (len(t) // 32), t)) for i, t in zip(around, told, strict=True)]
        found = settle_chains(self.level, sources, low, self.dims, self.scale, self.connectivity)
        reached, chains, labels = np.full(shape, -1, np.int64), np.full(shape, None, object), np.zeros(shape, np.int64)
        flat = chains.ravel()
        for i, chain in found.items():
            flat[i] = chain
        if found:
            at = np.fromiter(found.keys(), np.int64, len(found))
            reached.ravel()[at], labels.ravel()[at] = 0, [chain[-3] for chain in found.values()]
        inner = (slice(1, -1),) * 3
        return reached[inner], chains[inner], labels[inner]

    def rows(self, where: np.ndarray, keys: tuple[np.ndarray, ...], start: tuple[int, int, int] = (0, 0, 0)) -> dict[str, np.ndarray]:
        z, y, x = np.nonzero(where)
        out = {a: (c + s + lo).astype(np.int32) for a, c, s, lo in zip(AXES, (x, y, z), reversed(start), self.low, strict=True)}
        if self.rule == "compact":
            packed = np.empty(len(z), object)
            packed[:] = [c if c is None else struct.pack("<" + "dqqq" * (len(c) // 4), *c) for c in keys[1][z, y, x]]
            return out | {"chain": packed, "label": keys[2][z, y, x]}
        return out | {"level": keys[0][z, y, x].astype(np.int32), "steps": keys[1][z, y, x], "label": keys[2][z, y, x]}

    def tells(self, keys: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        """Rows (receiver rx, ry, rz; x, y, z; key) of reached voxels at the faces."""
        parts = []
        for d in stencil(self.connectivity):
            cut = tuple(_side(k) for k in d)
            start = tuple(n - 1 if k == 1 else 0 for k, n in zip(d, keys[0].shape, strict=True))
            some = tuple(a[cut] for a in keys)
            rows = self.rows(some[0] >= 0, some, start)
            n = len(rows["x"])
            parts.append({f"r{a}": np.full(n, b + k, np.int32) for a, b, k in zip(AXES, self.b, reversed(d), strict=True)} | rows)
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _blocks(vox: DataFrame, grid: Grid, edges: tuple[int, int, int]) -> DataFrame:
    """One row a block: bx, by, bz, levels (int32, z y x order, -1: no voxel), places and labels of markers.

    Where ``vox`` has them (of compact floods), also ``height`` and ``source`` of the markers' keys.
    """
    dims = grid.dims
    more = [(k, t) for k, t in (("height", "double"), ("source", "long")) if k in vox.columns]

    def run(table: pa.Table) -> pa.Table:
        b = [table.column(k)[0].as_py() for k in _BLOCK]
        low = [k * e for k, e in zip(b, edges, strict=True)]
        shape = tuple(min(e, n - lo) for e, n, lo in zip(reversed(edges), reversed(dims), reversed(low), strict=True))
        at = np.ravel_multi_index(tuple(np.asarray(table.column(a)).astype(np.int64) - lo for a, lo in zip("zyx", reversed(low), strict=True)), shape)
        levels = np.full(int(np.prod(shape)), -1, np.int32)
        levels[at] = np.asarray(table.column("level"))
        marks = np.asarray(table.column("marker"))
        some = np.flatnonzero(marks)
        columns = [pa.array([levels.tobytes()], pa.binary()), pa.array([at[some].astype(np.int32).tobytes()], pa.binary()), pa.array([marks[some].astype(np.int64).tobytes()], pa.binary())]
        columns += [pa.array([np.asarray(table.column(k))[some].tobytes()], pa.binary()) for k, _ in more]
        return pa.table([*(pa.array([k], pa.int32()) for k in b), *columns], names=[*_BLOCK, "levels", "places", "labels", *(f"{k}s" for k, _ in more)])

    cut = vox.select(*AXES, F.col("level").cast("int").alias("level"), F.col("marker").cast("long").alias("marker"), *(F.col(k).cast(t).alias(k) for k, t in more), *(F.floor(F.col(a) / e).cast("int").alias(f"b{a}") for a, e in zip(AXES, edges, strict=True)))
    return cut.groupBy(*_BLOCK).applyInArrow(run, "bx int, by int, bz int, levels binary, places binary, labels binary" + "".join(f", {k}s binary" for k, _ in more))


def flood(vox: DataFrame, grid: Grid, rule: str = "geodesic", connectivity: int = 6, edge: int | None = None, scale: float = 0.0) -> DataFrame:
    """x, y, z, level, steps, label of all voxels of (x, y, z, level, marker); 0 and null where nothing came.

    Voxels that are not in the table are no way.  A marker is a label other than 0.  By the rule
    ``compact`` (``scale``: what a unit of distance costs) there are no level and steps.
    ``edge``: of a block; where that makes very many blocks they are joined (the keys do not
    depend on the blocks, the rounds and their fixed costs do).
    """
    if rule not in (*RULES, "compact"):
        raise ValueError(f"unknown rule {rule}")
    dims = grid.dims
    edges = joined_blocks(dims, extents(dims, edge or block_edge(dims)))
    if rule != "compact":
        return _rounds(vox, grid, edges, rule, connectivity, scale)
    cut = vox.select(*AXES, F.col("level").cast("int").alias("level"), F.col("marker").cast("long").alias("marker"))
    settled, left = certain.phases(cut, grid, edges, LEVELS, scale, connectivity)
    if left is None:
        return settled
    # known voxels are sources and nothing else
    rest = left.select(*AXES, F.when(F.col("known"), -1).otherwise(F.col("level")).alias("level"), F.when(F.col("known"), F.col("label")).otherwise(0).alias("marker"), "height", "source")
    return settled.unionByName(_rounds(rest, grid, edges, rule, connectivity, scale))


def _rounds(vox: DataFrame, grid: Grid, edges: tuple[int, int, int], rule: str, connectivity: int, scale: float) -> DataFrame:
    """``flood`` by blocks that tell each other keys."""
    dims, tells = grid.dims, [f"r{a}" for a in AXES]
    blocks = written(_blocks(vox, grid, edges), "blocks")
    kind = _CHAIN if rule == "compact" else _KEY
    key = [k.split()[0] for k in kind.split(", ")]
    fields = [(k, {"level": pa.int32(), "chain": pa.binary()}.get(k, pa.int64())) for k in key]
    columns = [*tells, *AXES, *key]

    def work(block: pa.Table, said: pa.Table, only_levels: bool) -> pa.Table:
        schema = pa.schema([*((k, pa.int32()) for k in (*_BLOCK, *tells, *AXES)), *fields, ("changed", pa.bool_())])
        if not block.num_rows:
            return schema.empty_table()
        front = Front(block, edges, dims, connectivity, rule, scale)
        told, before = said.filter(said.column("told")), said.filter(pc.invert(said.column("told")))
        new = front.tells(front.settled(told, only_levels))
        old = dict(zip(zip(*(before.column(k).to_pylist() for k in (*tells, *AXES)), strict=True), zip(*(before.column(k).to_pylist() for k in key), strict=True), strict=True)) if before.num_rows else {}
        at, keys = zip(*(new[k].tolist() for k in (*tells, *AXES)), strict=True), zip(*(new[k].tolist() for k in key), strict=True)
        changed = [old.get(a) != k for a, k in zip(at, keys, strict=True)]
        n = len(changed)
        return pa.table([*(pa.array([k] * n, pa.int32()) for k in front.b), *(pa.array(new[k], schema.field(k).type) for k in columns), pa.array(changed, pa.bool_())], schema=schema)

    def last(block: pa.Table, said: pa.Table) -> pa.Table:
        schema = pa.schema([*((k, pa.int32()) for k in AXES), *(f for f in fields if f[0] != "chain")])
        if not block.num_rows:
            return schema.empty_table()
        front = Front(block, edges, dims, connectivity, rule, scale)
        keys = front.settled(said)
        inside = front.level[1:-1, 1:-1, 1:-1] >= 0
        if rule == "compact":
            z, y, x = np.nonzero(inside)
            return pa.table([*(pa.array((c + lo).astype(np.int32)) for c, lo in zip((x, y, z), front.low, strict=True)), pa.array(keys[2][z, y, x])], schema=schema)
        rows = front.rows(inside, keys)
        none = rows["level"] < 0
        return pa.table([*(pa.array(rows[a]) for a in AXES), pa.array(rows["level"], mask=none), pa.array(rows["steps"], mask=none), pa.array(np.where(none, 0, rows["label"]))], schema=schema)

    spark = vox.sparkSession
    kinds = "bx int, by int, bz int, rx int, ry int, rz int, x int, y int, z int, " + kind
    said = written(spark.createDataFrame([], kinds), "said")

    def heard(said: DataFrame) -> DataFrame:
        """Rows by the block that hears them."""
        return said.select(*(F.col(f"r{a}").alias(f"b{a}") for a in AXES), *AXES, *key)

    for only_levels in (False,) if rule == "compact" else (True, False):
        turn = blocks.select(*_BLOCK)
        while True:
            none = (F.lit(None).cast("int").alias(t) for t in tells)
            both = heard(said).select(*_BLOCK, *none, *AXES, *key, F.lit(True).alias("told")).unionByName(said.withColumn("told", F.lit(False)))
            now = blocks.join(turn, _BLOCK, "left_semi").groupBy(*_BLOCK).cogroup(both.join(turn, _BLOCK, "left_semi").groupBy(*_BLOCK))
            new = written(now.applyInArrow(_two(work, only_levels), kinds + ", changed boolean"), "told")
            dirty = written(new.filter("changed").select(*(F.col(f"r{a}").alias(f"b{a}") for a in AXES)).distinct().join(blocks.select(*_BLOCK), _BLOCK, "left_semi"), "turn")
            old, said = said, written(said.join(turn, _BLOCK, "left_anti").unionByName(new.drop("changed")), "said")
            discard(old)
            discard(new)
            turn = dirty
            if turn.isEmpty():
                break
    return blocks.groupBy(*_BLOCK).cogroup(heard(said).join(blocks.select(*_BLOCK), _BLOCK, "left_semi").groupBy(*_BLOCK)).applyInArrow(_two(last), "x int, y int, z int, " + kind.removeprefix("chain binary, "))


def _two(run, *options):
    def apply(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a, b, *options)

    return apply
