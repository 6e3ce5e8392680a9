"""Splitting of one object: by seeds, by a projected stroke, by geodesic distance."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, SIX, Block, Grid, grid_of
from ..lineage import written
from . import fronts
from .components import boundary_consistent, components
from .distance import _typed, flood, inverted_levels, squared_distance, watershed
from .neighbours import smoothed
from .projections import inverted


def object_crop(vox: DataFrame, label: int, pad: int, grid: Grid) -> DataFrame:
    """x, y, z, mask of the padded bounding box of a label (mask 1 inside the object)."""
    own = vox.filter(F.col("label") == label)
    box = own.agg(*(f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)))  # one row
    c = F.lit(True)
    for a in AXES:
        c = c & F.col(a).between(F.col(f"min{a}") - pad, F.col(f"max{a}") + pad)
    return vox.crossJoin(F.broadcast(box)).filter(c).select(*AXES, (F.col("label") == label).cast("int").alias("mask"))


def landscape(crop: DataFrame, grid: Grid, variance: float = 1.0) -> DataFrame:
    """x, y, z, mask, cost: smoothed negative distance to the outside of the object."""
    outside = crop.filter("mask = 0")
    d = squared_distance(crop, outside, grid).join(crop, list(AXES)).withColumn("dist", F.when(F.col("mask") != 0, F.sqrt(F.coalesce("d2", F.lit(0.0)))).otherwise(0.0))
    soft = smoothed(d, grid, "dist", variance, masked=True)
    return soft.join(crop, list(AXES)).select(*AXES, "mask", (-F.col("smooth")).alias("cost"))


class Beyond(Exception):
    """A search reached a place beside others that are not in its arrays."""


def barrier_tree(cost: np.ndarray, domain: np.ndarray, start: tuple[int, ...], ends: set[tuple[int, ...]], spacing: tuple[float, ...] = (1.0, 1.0, 1.0), rim: np.ndarray | None = None) -> dict[tuple[int, ...], tuple[int, ...]] | None:
    """Predecessors on face-connected paths from ``start`` to all ``ends``: least highest cost,
    then least physical length (indices and spacing z, y, x); None if one is out of reach.

    ``rim``: places beside others that the arrays do not hold; a search that has to go on from
    one raises ``Beyond``, any other is that of the whole.
    """
    best = {start: (float(cost[start]), 0.0)}
    back: dict[tuple[int, ...], tuple[int, ...]] = {}
    todo, left = [(float(cost[start]), 0.0, start)], set(ends) - {start}
    while todo and left:
        high, length, at = heapq.heappop(todo)
        if (high, length) > best[at]:
            continue
        left.discard(at)
        if not left:
            break
        if rim is not None and rim[at]:
            raise Beyond
        for d in SIX:
            to = tuple(a + b for a, b in zip(at, d, strict=True))
            if all(0 <= t < n for t, n in zip(to, cost.shape, strict=True)) and domain[to]:
                step = sum(abs(k) * s for k, s in zip(d, spacing, strict=True))
                key = (max(high, float(cost[to])), length + step)
                if key < best.get(to, (np.inf, 0.0)):
                    best[to], back[to] = key, at
                    heapq.heappush(todo, (*key, to))
    return None if left else back


def connect_seeds(cost: np.ndarray, domain: np.ndarray, seeds: list[tuple[int, ...]], spacing: tuple[float, ...] = (1.0, 1.0, 1.0), rim: np.ndarray | None = None) -> set[tuple[int, ...]]:
    """Seeds of a class and the paths that join each to the first."""
    out = {tuple(s) for s in seeds}
    if len(out) > 1:
        first = tuple(seeds[0])
        back = barrier_tree(cost, domain, first, out, spacing, rim)
        if back is None:
            raise ValueError("seeds of a class lie in parts that do not meet")
        for at in set(out):
            while at != first:
                at = back[at]
                out.add(at)
    return out


def split_markers(cost: np.ndarray, domain: np.ndarray, first: list, second: list, connect: bool = True, spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Marker array of two classes; a seed outside, an empty class or a shared voxel is an error."""
    if not first or not second:
        raise ValueError("each class needs a seed")
    for s in [*first, *second]:
        if not (all(0 <= t < n for t, n in zip(s, cost.shape, strict=True)) and domain[tuple(s)]):
            raise ValueError("a seed lies outside the object")
    a, b = (connect_seeds(cost, domain, c, spacing) if connect else {tuple(s) for s in c} for c in (first, second))
    if a & b:
        raise ValueError("the classes share a voxel")
    out = np.zeros(cost.shape, np.int64)
    for k, c in ((1, a), (2, b)):
        for at in c:
            out[at] = k
    return out


def _connected(crop: DataFrame, seeds: DataFrame, spacing: tuple[float, float, float], reach: int = 8) -> DataFrame:
    """x, y, z, part: seeds of each class and the paths that join them to its first.

    ``crop``: a written table.  A class is searched within ``reach`` voxels around its seeds, and
    within four times as many as long as the search wants to leave the box; what ends inside is
    the search of the whole.  So a task holds the object only where a search has to go all over it.
    """
    ends = [f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)]
    whole = crop.agg(*ends).first()
    placed = crop.join(seeds.select(*AXES, "seq", F.col("part").alias("_class")), list(AXES))
    boxes = {r["_class"]: r for r in placed.groupBy("_class").agg(*ends, F.count("*").alias("n")).collect()}  # two rows
    done = []
    while boxes:
        limits = {k: {a: (r[f"min{a}"] - reach, r[f"max{a}"] + reach) for a in AXES} for k, r in boxes.items()}
        rows = None
        for k, box in limits.items():
            inside = F.lit(True)
            for a in AXES:
                inside = inside & F.col(a).between(*box[a])
            own = seeds.filter(F.col("part") == k).select(*AXES, F.lit(True).alias("_seed"), F.col("seq").cast("long").alias("seq"))
            near = crop.filter(inside & (F.col("mask") != 0)).select(*AXES, "cost").join(F.broadcast(own), list(AXES), "left")
            near = near.select(F.lit(k).cast("long").alias("part"), *AXES, "cost", F.lit(True).alias("own"), F.coalesce("_seed", F.lit(False)).alias("seed"), F.coalesce("seq", F.lit(0)).alias("seq"))
            rows = near if rows is None else rows.unionByName(near)

        def run(table: pa.Table, limits=limits) -> pa.Table:
            k = table.column("part")[0].as_py()
            b = Block(table, {"cost": 0.0, "seed": False, "seq": 0})
            rim = np.zeros(b.present.shape, bool)
            for axis, a in enumerate(reversed(AXES)):
                at = np.arange(rim.shape[axis]) + b.low[2 - axis]
                cut = ((at == limits[k][a][0]) & (at > whole[f"min{a}"])) | ((at == limits[k][a][1]) & (at < whole[f"max{a}"]))
                rim |= cut.reshape([-1 if d == axis else 1 for d in range(3)])
            first = [p for _, p in sorted((int(b["seq"][p]), p) for p in map(tuple, np.argwhere(b["seed"])))]
            out = np.zeros(rim.shape, bool)
            try:
                for p in connect_seeds(b["cost"], b.present, first, spacing[::-1], rim):
                    out[p] = True
                found = b.rows(out)
            except Beyond:
                found = b.rows(out | b["seed"])
            n = found.num_rows
            return found.append_column("part", pa.array([k] * n, pa.int64())).append_column("complete", pa.array([bool(out.any())] * n))

        found = written(rows.groupBy("part").applyInArrow(_typed(run), "x int, y int, z int, part long, complete boolean"), "paths")
        done.append(found.filter("complete").drop("complete"))
        again = {r["part"] for r in found.filter("not complete").select("part").distinct().collect()}
        boxes, reach = {k: r for k, r in boxes.items() if k in again}, 4 * reach
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if not out.groupBy(*AXES).agg(F.count_distinct("part").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("the classes share a voxel")
    return out


def seeded_split(crop: DataFrame, seeds: DataFrame, compactness: float = 0.0, connect: bool = True, allow_parts: bool = False, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """x, y, z, part (1 or 2) of the object's voxels.

    ``crop``: x, y, z, mask, cost; ``seeds``: x, y, z, part in the order of ``seq``; ``spacing``
    (x, y, z) is that of connecting paths.  Both parts must be there, together be the object,
    and hang together unless ``allow_parts``.

    Without compactness the flood is geodesic and runs in blocks, and seeds of a class are
    connected in boxes around them.  Compact floods run with the object as one group.
    """
    crop = written(crop.select(*AXES, "mask", "cost"), "crop")
    s = seeds.select(*AXES, F.struct("seq", "part").alias("_s"))
    rows = crop.select(*AXES, F.col("mask").cast("int").alias("mask"), F.col("cost").cast("double").alias("cost"), F.lit(True).alias("own")).join(s, list(AXES), "left").select("*", F.coalesce("_s.part", F.lit(0)).alias("part"), F.coalesce("_s.seq", F.lit(0)).cast("long").alias("seq"))

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, {"mask": 0, "cost": 0.0, "part": 0, "seq": 0})
        domain = b.present & (b["mask"] != 0)
        if ((b["part"] != 0) & ~domain).any():
            raise ValueError("a seed lies outside the object")
        order = sorted((int(b["seq"][p]), int(b["part"][p]), p) for p in map(tuple, np.argwhere(b["part"] != 0)))
        marks = split_markers(b["cost"], domain, *([p for _, k, p in order if k == c] for c in (1, 2)), connect, spacing[::-1])
        return b.rows(domain, part=flood(inverted_levels(b["cost"], domain), marks, domain, 6, "compact", compactness))

    inside = rows.filter("mask <> 0")
    if compactness:
        marked = rows.select(*AXES, "mask", "cost", "part", "seq", "own").groupBy(F.lit(0).alias("object")).applyInArrow(_typed(run), "x int, y int, z int, part long")
    else:
        # an error where a marker lies outside, or a class has none
        found = rows.filter("part <> 0").agg(F.count_if(F.col("mask") == 0), F.count_if(F.col("part") == 1), F.count_if(F.col("part") == 2)).first()
        if found[0] or not found[1] or not found[2]:
            raise ValueError("a seed lies outside the object" if found[0] else "each class needs a seed")
        marked = inside.filter("part <> 0").select(*AXES, F.col("part").cast("long").alias("part"))
        if connect:
            marked = _connected(crop, seeds, spacing)
    if not compactness:
        marked = watershed(inside.select(*AXES, "cost").join(marked.withColumnRenamed("part", "seed"), list(AXES), "left").withColumn("seed", F.coalesce("seed", F.lit(0))), grid_of(crop), mode="geodesic").withColumnRenamed("label", "part")
    out = written(marked, "parts")
    parts = {r["part"] for r in out.select("part").distinct().limit(4).collect()}
    if not parts >= {1, 2}:
        raise ValueError("a part is empty or does not hang together")
    if 0 in parts or out.count() != inside.count():
        raise ValueError("the parts do not cover the object")
    if not allow_parts:
        pieces = components(out.withColumnRenamed("part", "label"), grid_of(crop)).agg(F.count_distinct("component")).first()[0]
        if pieces != 2:
            raise ValueError("a part is empty or does not hang together")
    return out


def ray_pick(dist: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], length: float, samples: int = 4) -> DataFrame:
    """x, y, z of the voxel of greatest distance along a ray's first crossing of the object.

    ``dist``: x, y, z, dist of the object's voxels; the ray is sampled ``samples`` times a unit.
    """
    norm = float(np.linalg.norm(direction))
    unit = [d / norm for d in direction]
    steps = dist.sparkSession.range(int(length * samples) + 1).select(F.col("id").alias("step"), *(F.floor(o + F.col("id") / samples * u + 0.5).cast("int").alias(a) for a, o, u in zip(AXES, origin, unit, strict=True)))
    hit = F.broadcast(steps).join(dist.select(*AXES, "dist"), list(AXES))
    # samples of one crossing follow each other without a gap
    run = F.col("step") - F.row_number().over(Window.orderBy("step"))
    first = hit.withColumn("run", run).withColumn("least", F.min("run").over(Window.partitionBy()))
    return first.filter("run = least").agg(F.max_by(F.struct(*AXES), F.struct("dist", -F.col("step"))).alias("v")).select("v.*")


def distance_to_polyline(u: Column, v: Column, points: list[tuple[float, float]]) -> Column:
    """Distance of a pixel to a stroke."""
    best = None
    pairs = list(zip(points, points[1:], strict=False)) or [(points[0], points[0])]
    for (ax, ay), (bx, by) in pairs:
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = F.lit(0.0) if n == 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((u - ax) * dx + (v - ay) * dy) / n))
        d = F.sqrt((u - ax - t * dx) * (u - ax - t * dx) + (v - ay - t * dy) * (v - ay - t * dy))
        best = d if best is None else F.least(best, d)
    return best


def projected(vox: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Adds u, v: voxel centres under a 4 x 4 matrix, divided by the last row; null behind the eye."""
    row = [sum((F.lit(float(m)) * F.col(a) for m, a in zip(r, AXES, strict=False)), F.lit(float(r[3]))) for r in matrix]
    return vox.withColumns({"u": F.when(row[3] > 0, row[0] / row[3]), "v": F.when(row[3] > 0, row[1] / row[3])})


def projected_cut(vox: DataFrame, grid: Grid, label: int, matrix: list[list[float]], stroke: list[tuple[float, float]], width: float) -> DataFrame:
    """x, y, z, part of an object that a stroke on the screen cuts.

    Voxels under the stroke are taken out, the rest falls into face components (parts are
    numbered from 1 by first voxel), and the cut voxels join the part that reaches them
    first (ties: lower part).  Fewer than two parts: no rows.
    """
    own = projected(vox.filter(F.col("label") == label).select(*AXES), matrix)
    near = F.coalesce(distance_to_polyline(F.col("u"), F.col("v"), stroke) <= width, F.lit(False))
    marked = written(own.select(*AXES, near.alias("cut")), "cut")
    parts = components(marked.filter("not cut").withColumn("label", F.lit(1)), grid)
    from .neighbours import ranked

    ids = ranked(parts.select("component").distinct(), "component").select("component", F.col("edge_id").alias("part"))
    if ids.count() < 2:
        return vox.sparkSession.createDataFrame([], "x int, y int, z int, part long")
    return spread(marked.select(*AXES), parts.join(ids, "component").select(*AXES, "part"))


def _steps(domain: DataFrame, sources: DataFrame) -> DataFrame:
    """x, y, z, steps, label: breadth-first over faces inside the domain, in blocks; ties go to the lower part."""
    marks = sources.groupBy(*AXES).agg(F.min(F.col("part").cast("long")).alias("marker"))
    rows = domain.select(*AXES).join(marks, list(AXES), "left").select(*AXES, F.lit(0).alias("level"), F.coalesce("marker", F.lit(0)).alias("marker"))
    return fronts.flood(rows, grid_of(domain), "geodesic")


def spread(domain: DataFrame, sources: DataFrame) -> DataFrame:
    """x, y, z, part: multi-source breadth-first spread over faces; ties go to the lower part."""
    return _steps(domain, sources).filter("label <> 0").select(*AXES, F.col("label").alias("part"))


def geodesic_levels(domain: DataFrame, sources: DataFrame) -> DataFrame:
    """x, y, z, dist: steps over faces inside the domain from the sources (null if unreachable)."""
    return _steps(domain, sources.select(*AXES, F.lit(1).alias("part"))).select(*AXES, F.col("steps").alias("dist"))


def geodesic_sides(vox: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """label, upper: whether a label's voxels lie nearer, on average, to the upper source.

    ``vox``: x, y, z, label of one group; a label goes to the upper side only if its mean
    distance from the lower source is strictly greater.
    """
    domain = vox.select(*AXES)
    a = geodesic_levels(domain, low).withColumnRenamed("dist", "da")
    b = geodesic_levels(domain, high).withColumnRenamed("dist", "db")
    j = vox.select(*AXES, "label").join(a, list(AXES)).join(b, list(AXES))
    return j.groupBy("label").agg((F.avg("da") > F.avg("db")).alias("upper"))


def repair_split(vox: DataFrame, grid: Grid, dist: DataFrame) -> DataFrame:
    """x, y, z, label: labels that the boundary cuts apart become seeds of a new flood.

    Seeds are the pieces (whole labels keep their id); the flood runs on the inverted
    distance map over everything that is not masked.
    """
    seeds, _ = boundary_consistent(vox, grid)
    cost = inverted(dist.select(*AXES, "dist"), "dist").select(*AXES, "cost")
    j = seeds.withColumnRenamed("label", "seed").join(cost, list(AXES)).join(vox.select(*AXES, "mask"), list(AXES)).filter("mask = 0")
    # read several times, here and by what follows
    j = written(j.select(*AXES, "cost", "seed"), "seeded")
    return written(vox.select(*AXES).join(watershed(j, grid), list(AXES), "left").select(*AXES, F.coalesce("label", F.lit(0)).cast("long").alias("label")), "repaired")
