"""Distance maps, seeds and marker watersheds."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, TWENTY_SIX, Block, Grid, by_block, grid_of, shifted, stencil, with_blocks
from ..lineage import discard, written
from . import fronts
from .components import components
from .neighbours import boundary_background, local_maxima, with_rim

FAR = 1e20
LEVELS = fronts.LEVELS


def lower_envelopes(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over j of f[l, j] + (at[i] - at[j])^2 for every line l, by envelopes of parabolas.

    All lines advance together: a step looks at one place of each.
    """
    lines, n = f.shape
    own = np.arange(lines)
    v, z, top = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf), np.full(lines, -1)
    for q in range(n):
        known = np.flatnonzero(f[:, q] < FAR)
        cross = np.full(len(known), -np.inf)
        open_ = np.flatnonzero(top[known] >= 0)
        while len(open_):
            r = known[open_]
            p = v[r, top[r]]
            s = ((f[r, q] + at[q] ** 2) - (f[r, p] + at[p] ** 2)) / (2 * (at[q] - at[p]))
            cross[open_] = s
            covered = s <= z[r, top[r]]
            top[r[covered]] -= 1
            open_ = open_[covered]
        top[known] += 1
        v[known, top[known]], z[known, top[known]] = q, cross
    z[np.arange(n + 1)[None, :] > top[:, None]] = np.inf
    out, k = np.full((lines, n), FAR), np.zeros(lines, np.int64)
    some = top >= 0
    for i in range(n):
        while (step := z[own, k + 1] <= at[i]).any():
            k += step
        best = v[own, k]
        out[some, i] = (f[own, best] + (at[i] - at[best]) ** 2)[some]
    return out


#: Lines of a bundle along each of the two other axes, as a power of two, at most.
BUNDLE = 4
#: Places of a bundle at most (a line at least), at about 100 bytes each.
PLACES = 1 << 21


def bundle(length: int) -> int:
    """Lines of a bundle, as a power of two, along an axis of so many voxels."""
    return next((k for k in range(BUNDLE, 0, -1) if length << 2 * k <= PLACES), 0)


def squared_distance(vox: DataFrame, sites: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z, d2: exact squared distance to the nearest site (x, y, z), spacing-aware.

    Three passes over the lines of an axis each; a bundle of 16 x 16 lines (fewer where lines
    are long) is the unit of work, so no task needs a volume.  Without sites d2 is null.
    """
    marked = vox.select(*AXES).join(sites.select(*AXES).distinct().withColumn("_s", F.lit(0.0)), list(AXES), "left")
    return _nearest(marked.select(*AXES, F.coalesce("_s", F.lit(FAR)).alias("d2")), grid)


def _nearest(d: DataFrame, grid: Grid, kept: str | None = None) -> DataFrame:
    """The passes of ``squared_distance`` over d2 (0 at sites, else FAR); a boolean column ``kept`` is carried along."""
    more = [kept] if kept else []
    kinds = "x int, y int, z int, " + "".join(f"{c} boolean, " for c in more) + "d2 double"
    for a, s, k in zip(AXES, (grid.sx, grid.sy, grid.sz), map(bundle, grid.dims), strict=True):
        b, c = (o for o in AXES if o != a)

        def run(table: pa.Table, a=a, b=b, c=c, s=s) -> pa.Table:
            at, i = np.unique(np.asarray(table.column(a)), return_inverse=True)
            across = np.asarray(table.column(b)).astype(np.int64) << 32 | np.asarray(table.column(c)).astype(np.int64) & 0xFFFFFFFF
            names, line = np.unique(across, return_inverse=True)
            f = np.full((len(names), len(at)), FAR)
            f[line, i] = np.asarray(table.column("d2"))
            out = lower_envelopes(f, at.astype(np.float64) * s)[line, i]
            return pa.table({**{o: table.column(o) for o in (*AXES, *more)}, "d2": pa.array(np.minimum(out, FAR))})

        d = d.groupBy(F.shiftright(b, k).alias("_b"), F.shiftright(c, k).alias("_c")).applyInArrow(_typed(run), kinds)
    return d.select(*AXES, *more, F.when(F.col("d2") < FAR / 2, F.col("d2")).alias("d2"))


def _typed(run):
    def apply(table: pa.Table) -> pa.Table:
        return run(table)

    return apply


def signed_distance(vox: DataFrame, grid: Grid, mask: str = "mask") -> DataFrame:
    """x, y, z, dist: positive where the mask is 0, negative inside; distance to the rim of background.

    Blocks mark the rim on their voxels, and lines carry the side along, so nothing is joined.
    """
    rows = with_rim(vox, grid, mask).select(*AXES, "open", F.when(F.col("rim"), 0.0).otherwise(FAR).alias("d2"))
    root = F.sqrt(F.coalesce("d2", F.lit(0.0)))
    return _nearest(rows, grid, "open").select(*AXES, F.when(F.col("open"), root).otherwise(-root).alias("dist"))


def maurer_distance(vox: DataFrame, mask: str = "mask") -> DataFrame:
    """x, y, z, dist: negative inside the mask, positive outside; distance to the centres of the mask's own rim.

    The rim are masked voxels with an unmasked one among their 26 neighbours (what lies outside
    the volume is none), so it has distance 0.  In voxels, whatever the spacing; without a rim
    the distance is null.
    """
    grid = grid_of(vox)
    sites = boundary_background(vox.select(*AXES, F.when(F.col(mask) == 0, 1).otherwise(0).alias("_out")), grid, "_out")
    m = vox.select(*AXES, (F.col(mask) == 0).alias("_open"))
    return squared_distance(vox, sites, grid).join(m, list(AXES)).select(*AXES, F.when(F.col("_open"), F.sqrt("d2")).otherwise(-F.sqrt("d2")).alias("dist"))


def seeds_from_maxima(dist: DataFrame, grid: Grid, value: str = "dist") -> DataFrame:
    """x, y, z, seed: face components of local maxima, numbered from 1 by first voxel."""
    peaks = local_maxima(dist, grid, value).withColumn("label", F.lit(1))
    return _numbered(components(peaks, grid))


def _numbered(parts: DataFrame) -> DataFrame:
    from .neighbours import ranked

    ids = ranked(parts.select("component").distinct(), "component").select("component", F.col("edge_id").alias("seed"))
    return parts.join(ids, "component").select(*AXES, "seed")


def h_convex_seeds(dist: DataFrame, grid: Grid, height: float = 1.0, least: float = 0.1, value: str = "dist", edge: int = 64, halo: int = 16) -> DataFrame:
    """Seeds where the map rises ``height`` over its reconstruction from map - height.

    The reconstruction (26 neighbours) runs in blocks that exchange values through written
    tables until none changes, so it equals that of the whole volume.
    """
    if halo < 1:
        raise ValueError("blocks need a halo")

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {"_v": 0.0, "_low": 0.0})
        v, low = (np.where(b.present, b[c], -np.inf) for c in ("_v", "_low"))
        while True:
            grown = low.copy()
            for d in TWENTY_SIX:
                np.maximum(grown, shifted(low, *d, -np.inf), out=grown)
            grown = np.minimum(grown, v)
            if (grown == low).all():
                break
            low = grown
        # a block that sees no other one is done in its first round
        alone = not (b.present & ~b.own).any()
        return b.rows(b.own, _v=v, _low=low, risen=(low > b["_low"]) & (not alone))

    state = dist.select(*AXES, F.col(value).cast("double").alias("_v"), (F.col(value).cast("double") - height).alias("_low"))
    old = None
    while True:
        state = written(by_block(state, grid, kernel, "x int, y int, z int, _v double, _low double, risen boolean", edge, halo), "reconstruction")
        if old is not None:
            discard(old)
        old = state
        if state.filter("risen").isEmpty():
            break
        state = state.drop("risen")
    peaks = state.filter((F.col("_v") - F.col("_low") > least) & (F.col("_v") > 0)).select(*AXES)
    return _numbered(components(peaks.withColumn("label", F.lit(1)), grid))


def extract_seeds(dist: DataFrame, grid: Grid, method: str = "maxima") -> DataFrame:
    if method == "maxima":
        return seeds_from_maxima(dist, grid)
    if method == "h_convex":
        return h_convex_seeds(dist, grid)
    raise ValueError(f"no single seed method {method}")


def quantized(cost: np.ndarray, low: float, high: float) -> np.ndarray:
    if high <= low:
        return np.zeros(cost.shape, np.int64)
    return np.clip(np.floor((cost - low) / (high - low) * LEVELS + 0.5), 0, LEVELS).astype(np.int64)


def levels(cost: Column, low: float | None, high: float | None) -> Column:
    """``quantized`` as a column."""
    if low is None or high is None or high <= low:
        return F.lit(0)
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor((cost - low) / (high - low) * LEVELS + 0.5))).cast("int")


def inverted_levels(cost: np.ndarray, domain: np.ndarray) -> np.ndarray:
    """Levels of a cost array over its domain."""
    inside = cost[domain]
    return quantized(cost, float(inside.min()), float(inside.max())) if len(inside) else np.zeros(cost.shape, np.int64)


def flood(cost: np.ndarray, markers: np.ndarray, domain: np.ndarray, connectivity: int = 6, mode: str = "arrival", compactness: float = 0.05) -> np.ndarray:
    """Marker watershed without lines on dense arrays (z, y, x); cost holds levels.

    ``arrival``: by level, then first come first served; ``geodesic``: by (level, steps,
    label, place); ``compact``: level plus distance to the source seed, ties by label, then
    source.  Markers keep their labels; places outside ``domain`` stay 0.
    """
    if (markers[~domain] != 0).any():
        raise ValueError("a marker lies outside the mask")
    shape = tuple(n + 2 for n in cost.shape)
    inner = (slice(1, -1),) * 3
    c, label, free = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    c[inner], label[inner], free[inner] = cost, markers, domain
    free &= label == 0
    step = [dz * shape[1] * shape[2] + dy * shape[2] + dx for dz, dy, dx in stencil(connectivity)]
    c, label, free = c.ravel(), label.ravel(), free.ravel()
    start = np.flatnonzero(label)
    if mode == "arrival":
        buckets: dict[int, deque] = {}
        heap: list[int] = []

        def push(i: int, level: int) -> None:
            if level not in buckets:
                buckets[level] = deque()
                heapq.heappush(heap, level)
            buckets[level].append(i)

        for i in start.tolist():
            push(i, 0)
        while heap:
            level = heap[0]
            queue = buckets[level]
            if not queue:
                heapq.heappop(heap)
                del buckets[level]
                continue
            i = queue.popleft()
            for s in step:
                j = i + s
                if free[j]:
                    free[j] = False
                    label[j] = label[i]
                    push(j, max(level, int(c[j])))
    else:
        scale = compactness / max(1.0, float(np.sqrt(sum(n * n for n in cost.shape))))
        at = np.stack(np.unravel_index(np.arange(len(c)), shape), axis=1) if mode == "compact" else None
        todo = [(0, 0, int(label[i]), int(i), int(i)) if mode == "geodesic" else (0.0, int(label[i]), int(i), int(i)) for i in start]
        heapq.heapify(todo)
        done = np.zeros(len(c), bool)
        while todo:
            if mode == "geodesic":
                level, hops, own, i, source = heapq.heappop(todo)
            else:
                level, own, source, i = heapq.heappop(todo)
            if done[i]:
                continue
            done[i], label[i] = True, own
            for s in step:
                j = i + s
                if free[j] and not done[j]:
                    if mode == "geodesic":
                        heapq.heappush(todo, (max(level, int(c[j])), hops + 1, own, j, source))
                    else:
                        heapq.heappush(todo, (c[j] / LEVELS + scale * float(np.linalg.norm(at[j] - at[source])), own, source, j))
    return label.reshape(shape)[inner]


def watershed(vox: DataFrame, grid: Grid, cost: str = "cost", markers: str = "seed", connectivity: int = 6, mode: str = "arrival", compactness: float = 0.05, edge: int | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """x, y, z, label: exact flood of a volume of any size; where no marker comes the label is 0.

    It runs in blocks that come to the flood of the whole (see ``fronts``).  What arrives at one
    level after as many steps on it goes to the lower label; a queue would decide that by its
    own order of voxels.  ``compact`` measures distances in the diagonal of ``shape`` (x, y, z;
    by default that of the bounding box); chains cost more than keys, so its blocks are smaller.
    """
    edge = edge or (32 if mode == "compact" else None)
    c = F.col(cost).cast("double")
    box = [f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)]
    r = vox.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), *box).first()
    shape = shape or tuple((r[f"max{a}"] or 0) - (r[f"min{a}"] or 0) + 1 for a in AXES)
    scale = compactness / max(1.0, float(np.sqrt(sum(n * n for n in shape))))
    flooded = fronts.flood(vox.select(*AXES, levels(c, r["lo"], r["hi"]).alias("level"), F.col(markers).cast("long").alias("marker")), grid, mode, connectivity, edge, scale)
    return flooded.select(*AXES, "label")


def automatic_edge(voxels: int, threads: int) -> int:
    """Cube root of voxels / (2 threads), down to a multiple of 32, from 128 to 256."""
    edge = round((voxels / (2 * max(threads, 1))) ** (1 / 3), 9)
    return int(min(256, max(128, edge // 32 * 32)))


def blockwise_watershed(vox: DataFrame, grid: Grid, cost: str = "cost", markers: str = "seed", edge: int = 128, halo: int = 16, connectivity: int = 6) -> DataFrame:
    """x, y, z, label: flood in blocks with a halo, in two colours of a checkerboard.

    Red blocks flood from their markers, black ones also from what red ones found in their
    halo.  Blocks without any marker wait for the next round.  By design this is close to,
    not equal to, the global flood.  Rounds go on while they reach open voxels; as blocks
    see their neighbours' faces, what is open after a round without change has no way to a
    marker and stays 0, as in the global flood.
    """
    if halo < 1:
        raise ValueError("blocks need a halo")
    r = vox.agg(F.min(cost).alias("lo"), F.max(cost).alias("hi")).first()
    low, high = float(r["lo"]), float(r["hi"])
    start = written(vox.select(*AXES, F.col(cost).cast("double").alias("_c"), F.col(markers).cast("long").alias("_m")), "flood")
    own = F.pmod(sum((F.floor(F.col(a) / edge) for a in AXES), F.lit(0)), F.lit(2))
    colour = F.pmod(F.col("bx") + F.col("by") + F.col("bz"), F.lit(2))
    # a table for the blocks of each colour: a half round shuffles and writes those of its own
    halves, left = [start.filter(own == 0), start.filter(own == 1)], None

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {"_c": 0.0, "_m": 0})
        out = b["_m"]
        if (out != 0).any() and (out[b.own] == 0).any():
            out = flood(quantized(b["_c"], low, high), out, b.present, connectivity)
        return b.rows(b.own, _c=b["_c"], _m=out)

    while True:
        for now in (0, 1):
            seen = with_blocks(halves[0].unionByName(halves[1]), grid, edge, halo).filter(colour == now)
            old, halves[now] = halves[now], written(seen.groupBy("bx", "by", "bz").applyInArrow(_typed(kernel), "x int, y int, z int, _c double, _m long"), "flood")
            if left is not None:
                discard(old)
            elif now == 1:
                discard(start)
        state = halves[0].unionByName(halves[1])
        open_ = state.filter("_m = 0").count()
        if open_ == 0 or open_ == left:
            break
        left = open_
    return state.select(*AXES, F.col("_m").alias("label"))


def run_watershed(vox: DataFrame, grid: Grid, algorithm: str = "exact", **options) -> DataFrame:
    if algorithm == "exact":
        return watershed(vox, grid, **options)
    if algorithm == "blockwise":
        if "compactness" in options:
            raise ValueError("compactness needs the exact flood")
        return blockwise_watershed(vox, grid, **options)
    raise ValueError(f"unknown algorithm {algorithm}")
