"""Face neighbours, edges between labels and region adjacency."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, SIX, TWENTY_SIX, Block, Grid, by_block, shifted, with_blocks
from ..lineage import written


def faces(vox: DataFrame, grid: Grid, columns: Iterable[str] = ("label",), edge: int = 64) -> DataFrame:
    """Each pair of face neighbours once: x, y, z of the lower voxel, axis, and per column c: c, c_2.

    One shuffle by block serves all three axes: the windows of an axis lie within a block,
    so they need no exchange of their own.
    """
    columns = list(columns)
    seen = with_blocks(vox.select(*AXES, *columns), grid, edge, 1, lower_only=True)
    seen = seen.repartition("bx", "by", "bz")
    pairs = seen
    found = []
    for k, a in enumerate(AXES):
        rest = [b for b in AXES if b != a]
        w = Window.partitionBy("bx", "by", "bz", *rest).orderBy(a)
        step = F.lead(F.struct(F.col(a).alias("at"), *(F.col(c).alias(c) for c in columns))).over(w)
        pairs = pairs.withColumn(f"_{a}", step)
        hit = F.col("own") & (F.col(f"_{a}.at") == F.col(a) + 1)
        found.append(F.when(hit, F.struct(F.lit(k).alias("axis"), *(F.col(f"_{a}.{c}").alias(f"{c}_2") for c in columns))))
    each = F.filter(F.array(*found), lambda f: f.isNotNull())
    return pairs.select(*AXES, *columns, F.explode(each).alias("f")).select(*AXES, *columns, "f.*")


def step_column(axis: Column, name: str) -> Column:
    """Coordinate of the upper voxel of a face."""
    return (F.col(name) + F.when(axis == AXES.index(name), 1).otherwise(0)).cast("int")


def one_sided(vox: DataFrame, grid: Grid, ignored: Iterable[int] = (0,)) -> DataFrame:
    """label, neighbour, x, y, z: voxels of a label that touch another one; once per neighbour."""
    ignored = list(ignored)
    f = faces(vox, grid)
    f = f.filter((F.col("label") != F.col("label_2")) & ~F.col("label").isin(ignored) & ~F.col("label_2").isin(ignored))
    lower = F.struct(F.col("label").alias("label"), F.col("label_2").alias("neighbour"), *(F.col(a).alias(a) for a in AXES))
    upper = F.struct(F.col("label_2").alias("label"), F.col("label").alias("neighbour"), *(step_column(F.col("axis"), a).alias(a) for a in AXES))
    return f.select(F.explode(F.array(lower, upper)).alias("s")).select("s.*").distinct()


def two_sided(sides: DataFrame) -> DataFrame:
    """edge_id, lo, hi, voxels and bounding box; ids are ranks of the ordered pairs, from 1."""
    e = sides.groupBy(F.least("label", "neighbour").alias("lo"), F.greatest("label", "neighbour").alias("hi")).agg(
        F.count("*").alias("voxels"), *(f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max))
    )
    return ranked(e, "lo", "hi")


def touching(vox: DataFrame, grid: Grid, ignored: Iterable[int] = (0,), edge: int = 64) -> DataFrame:
    """edge_id, lo, hi, voxels: the edges of ``two_sided``, counted inside blocks.

    What is shuffled is a row a pair of labels and block, not one a side and voxel.
    """

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {"label": 0})
        own = b["label"][b.own]
        near = np.stack([np.where(shifted(b.present, *d, False), shifted(b["label"], *d, 0), b["label"])[b.own] for d in SIX], axis=1)
        near.sort(axis=1)
        other = near != own[:, None]
        other[:, 1:] &= near[:, 1:] != near[:, :-1]  # a voxel counts once for each neighbour
        i, j = np.nonzero(other)
        names, at = np.unique(np.stack([own[i], near[i, j]]), return_inverse=True)
        at = at.reshape(2, -1)
        pair, n = np.unique(at.min(axis=0) * len(names) + at.max(axis=0), return_counts=True)
        k = max(1, len(names))
        return pa.table({"lo": pa.array(names[pair // k]), "hi": pa.array(names[pair % k]), "n": pa.array(n)})

    rows = vox.select(*AXES, F.col("label").cast("long").alias("label")).filter(F.col("label").isNotNull() & ~F.col("label").isin(list(ignored)))
    each = by_block(rows, grid, kernel, "lo long, hi long, n long", edge)
    return ranked(each.groupBy("lo", "hi").agg(F.sum("n").alias("voxels")), "lo", "hi")


def ranked(edges: DataFrame, *by: str) -> DataFrame:
    """Dense ids in the order of ``by`` by range partitions, without gathering the rows in one task.

    The dealt rows are written: bounds of ranges come from a sample, and a second reading with
    other bounds would count other rows than it numbers.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = written(edges.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranked")
    local = at.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    skip = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return local.join(F.broadcast(skip), "_part").select((F.col("_r") + F.col("_skip")).cast("long").alias("edge_id"), *edges.columns)


def edge_volume(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """x, y, z, edge_id: a voxel on several edges keeps the largest id."""
    at = sides.withColumns({"lo": F.least("label", "neighbour"), "hi": F.greatest("label", "neighbour")})
    return at.join(edges.select("lo", "hi", "edge_id"), ["lo", "hi"]).groupBy(*AXES).agg(F.max("edge_id").alias("edge_id"))


def isolated(vox: DataFrame, grid: Grid) -> DataFrame:
    """label, isolated: whether it touches no other label (0 does not count)."""
    f = faces(vox, grid).filter("label <> label_2 and label <> 0 and label_2 <> 0")
    touching = f.select(F.explode(F.array("label", "label_2")).alias("_t")).distinct()
    labels = vox.filter("label <> 0").select("label").distinct()
    return labels.join(touching, F.col("label") == F.col("_t"), "left").select("label", F.col("_t").isNull().alias("isolated"))


def region_adjacency(vox: DataFrame, grid: Grid, apply_mask: bool = True) -> DataFrame:
    """lo, hi with boundary sum and contact area, in total and over open faces.

    A face adds 0.5 * (b1 + b2) * area; it is open if both masks are 0.  ``apply_mask``
    leaves out masked voxels altogether (then open and total agree).
    """
    f = faces(vox.filter("mask = 0") if apply_mask else vox, grid, ("label", "boundary", "mask"))
    f = f.filter("label <> label_2 and label <> 0 and label_2 <> 0")
    area = F.when(F.col("axis") == 0, grid.sy * grid.sz).when(F.col("axis") == 1, grid.sx * grid.sz).otherwise(grid.sx * grid.sy)
    b = 0.5 * (F.col("boundary") + F.col("boundary_2")) * area
    open_ = (F.col("mask") == 0) & (F.col("mask_2") == 0)
    return f.groupBy(F.least("label", "label_2").alias("lo"), F.greatest("label", "label_2").alias("hi")).agg(
        F.sum(b).alias("total_b"), F.sum(area).alias("total_a"), F.coalesce(F.sum(F.when(open_, b)), F.lit(0.0)).alias("open_b"), F.coalesce(F.sum(F.when(open_, area)), F.lit(0.0)).alias("open_a")
    )


def region_index(vox: DataFrame, grid: Grid) -> DataFrame:
    """region_id (from 0, in the order of first voxels), label, n of active labels."""
    r = vox.filter("label <> 0 and mask = 0").groupBy("label").agg(F.min(grid.scan_index()).alias("first"), F.count("*").alias("n"))
    return ranked(r, "first").select((F.col("edge_id") - 1).alias("region_id"), "label", "n")


def merge_plan(counts: DataFrame, pairs: DataFrame, selected: DataFrame, largest: bool = False) -> DataFrame:
    """label, neighbour: for each selected label its smallest (or largest) neighbour; ties: smaller label.

    ``counts``: label, n; ``pairs``: lo, hi; a label without neighbours is left out.
    """
    both = pairs.select(F.col("lo").alias("label"), F.col("hi").alias("neighbour")).unionByName(pairs.select(F.col("hi").alias("label"), F.col("lo").alias("neighbour")))
    sized = both.join(selected.select("label").distinct(), "label").join(counts.select(F.col("label").alias("neighbour"), "n"), "neighbour")
    order = F.struct((-F.col("n") if largest else F.col("n")).alias("n"), "neighbour")
    return sized.groupBy("label").agg(F.min(order)["neighbour"].alias("neighbour"))


def stroke_edges(stroke: DataFrame, edge_vox: DataFrame) -> DataFrame:
    """Distinct edges under painted pixels: stroke has x, y, z and red (unmerge) or green (merge)."""
    return stroke.join(edge_vox.filter("edge_id <> 0"), list(AXES)).select("edge_id", F.when(F.col("red"), "unmerge").otherwise("merge").alias("action")).distinct()


# ------------------------------------------------ neighbourhoods of 26


def local_maxima(vox: DataFrame, grid: Grid, value: str = "dist", edge: int = 32) -> DataFrame:
    """x, y, z of voxels over 0 without a strictly greater neighbour among 26 (plateaus stay)."""

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {value: -np.inf})
        v = np.where(b.present, b[value], -np.inf)
        peak = b.own & (v > 0)
        for d in TWENTY_SIX:
            peak &= shifted(v, *d, -np.inf) <= v
        return b.rows(peak)

    return by_block(vox.select(*AXES, F.col(value).cast("double").alias(value)), grid, kernel, "x int, y int, z int", edge)


def _rim(mask: str, all_: bool):
    """Kernel: own voxels with mask 0 beside another mask, or all own ones with ``rim`` and ``open``."""

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {mask: 0} | ({"open": False} if all_ else {}))
        near = np.zeros_like(b.own)
        for d in TWENTY_SIX:
            near |= shifted(b[mask], *d, 0) != 0
        rim = (b[mask] == 0) & near
        return b.rows(b.own, rim=rim, open=b["open"]) if all_ else b.rows(b.own & rim)

    return kernel


def boundary_background(vox: DataFrame, grid: Grid, mask: str = "mask", edge: int = 32) -> DataFrame:
    """x, y, z of voxels with mask 0 that have a neighbour among 26 with another mask."""
    return by_block(vox.select(*AXES, F.col(mask).cast("int").alias(mask)), grid, _rim(mask, False), "x int, y int, z int", edge)


def with_rim(vox: DataFrame, grid: Grid, mask: str = "mask", edge: int = 32) -> DataFrame:
    """x, y, z, rim, open of all voxels: whether ``boundary_background`` lists it, whether its mask is 0."""
    rows = vox.select(*AXES, F.col(mask).cast("int").alias(mask), F.coalesce(F.col(mask) == 0, F.lit(False)).alias("open"))
    return by_block(rows, grid, _rim(mask, True), "x int, y int, z int, rim boolean, open boolean", edge)


def ball(radius: int) -> list[tuple[int, int, int]]:
    """Offsets (dx, dy, dz) within ``radius``."""
    r = range(-radius, radius + 1)
    return [(i, j, k) for i in r for j in r for k in r if i * i + j * j + k * k <= radius * radius]


def _morph(vox: DataFrame, grid: Grid, label: int, radius: int, steps: str, over_others: bool, background: int, edge: int) -> DataFrame:
    """Dilate (d) and erode (e) one label; outside the volume counts as not the label when
    dilating and as the label when eroding.  Changed voxels only replace background unless
    ``over_others``."""
    reach = radius * len(steps)

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {"label": -1})
        own = b["label"] == label
        for s in steps:
            out = np.zeros_like(own) if s == "d" else np.ones_like(own)
            for i, j, k in ball(radius):
                if s == "d":
                    out |= shifted(own & b.present, k, j, i, False)
                else:
                    out &= shifted(own | ~b.present, k, j, i, True)
            own = out
        now = b["label"].copy()
        gain = own & (b["label"] != label)
        now[gain & ((b["label"] == background) | over_others)] = label
        now[(b["label"] == label) & ~own] = background
        return b.rows(b.own, label=now)

    return by_block(vox.select(*AXES, F.col("label").cast("long").alias("label")), grid, kernel, "x int, y int, z int, label long", max(edge, reach), reach)


def dilate(vox: DataFrame, grid: Grid, label: int, radius: int, background: int = 0, edge: int = 32) -> DataFrame:
    return _morph(vox, grid, label, radius, "d", False, background, edge)


def erode(vox: DataFrame, grid: Grid, label: int, radius: int, background: int = 0, edge: int = 32) -> DataFrame:
    return _morph(vox, grid, label, radius, "e", False, background, edge)


def opened(vox: DataFrame, grid: Grid, label: int, radius: int, background: int = 0, edge: int = 32) -> DataFrame:
    return _morph(vox, grid, label, radius, "ed", False, background, edge)


def closed(vox: DataFrame, grid: Grid, label: int, radius: int, background: int = 0, edge: int = 32) -> DataFrame:
    return _morph(vox, grid, label, radius, "de", True, background, edge)


def smoothed(vox: DataFrame, grid: Grid, value: str, variance: float, masked: bool = False, out: str = "smooth", edge: int = 32) -> DataFrame:
    """Gaussian smoothing, separable, cut at three deviations; ``masked`` divides G(w d) by G(w), w = mask <> 0."""
    reach = max(1, int(np.ceil(3 * np.sqrt(variance))))
    at = np.arange(-reach, reach + 1)
    weight = np.exp(-at * at / (2 * variance))

    def blur(a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            total = np.zeros_like(a)
            for d, w in zip(at.tolist(), weight.tolist(), strict=True):
                total += w * shifted(a, *(d if k == axis else 0 for k in range(3)), 0.0)
            a = total
        return a

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {value: 0.0, "_w": 0.0})
        w = np.where(b.present, b["_w"], 0.0)
        norm = blur(w)
        v = np.where(norm > 0, blur(w * b[value]) / np.where(norm > 0, norm, 1), 0.0)
        return b.rows(b.own, **{out: v})

    w = (F.col("mask") != 0).cast("double") if masked else F.lit(1.0)
    return by_block(vox.select(*AXES, F.col(value).cast("double").alias(value), w.alias("_w")), grid, kernel, f"x int, y int, z int, {out} double", max(edge, reach), reach)
