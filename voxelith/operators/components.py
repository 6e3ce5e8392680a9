"""Connected components of equal labels, and what is built on them.

Two phases: components inside blocks (one pass over the voxels), then components of the
small graph of block components that meet at a block's face.  A component's id is the
least scan index in it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, Block, Grid, by_block, shifted, stencil
from ..lineage import written
from .graph import connected


def dense_components(value: np.ndarray, where: np.ndarray, connectivity: int) -> np.ndarray:
    """For each place the least flat index of its component (equal values, within ``where``), else -1."""
    n = value.size
    parent = np.where(where.ravel(), np.arange(n), -1)
    index = np.arange(n).reshape(value.shape)
    pairs = []
    for d in stencil(connectivity):
        if d > (0, 0, 0):
            other = shifted(index, *d, -1)
            same = where & (other >= 0) & (shifted(value, *d, 0) == value) & shifted(where, *d, False)
            pairs.append(np.stack([index[same], other[same]]))
    pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    while pairs.shape[1]:
        a, b = parent[pairs[0]], parent[pairs[1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        pairs = pairs[:, open_]
        while True:
            up = np.where(parent >= 0, parent[np.maximum(parent, 0)], -1)
            if (up == parent).all():
                break
            parent = up
    return parent.reshape(value.shape)


def components(vox: DataFrame, grid: Grid, connectivity: int = 6, background: Iterable[int] = (0,), key: tuple[str, ...] = ("label",), edge: int = 32) -> DataFrame:
    """x, y, z, key columns, component (its least scan index); ``background`` labels have none."""
    background, (dx, dy, _) = list(background), grid.dims
    offsets = stencil(connectivity)
    names = list(key)

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, dict.fromkeys(names, 0) | {"_k": 0})
        inside = b.present
        parent = dense_components(b["_k"], b.own, connectivity)
        z, y, x = np.indices(b.own.shape)
        scan = (x + b.low[0]) + (y + b.low[1]) * dx + (z + b.low[2]) * dx * dy
        local = np.where(parent >= 0, scan.ravel()[np.maximum(parent, 0)], -1)
        # voxels of other blocks with an equal key: joined in the second phase by their scan index
        links = np.full((*b.own.shape, len(offsets)), -1, np.int64)
        for k, d in enumerate(offsets):
            same = b.own & shifted(inside & ~b.own, *d, False) & (shifted(b["_k"], *d, 0) == b["_k"])
            links[..., k] = np.where(same, shifted(scan, *d, -1), -1)
        out = b.rows(b.own, **{n: b[n] for n in names}, scan=scan, local=local)
        at = np.nonzero(b.own)
        found = links[at]
        ends = np.concatenate([[0], np.cumsum((found >= 0).sum(axis=1))])
        none = np.append(ends[1:] == ends[:-1], False)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=none), pa.array(found[found >= 0]))
        return out.append_column("links", lists)

    rows = vox.filter(~F.col(names[0]).isin(background))
    rows = rows.select(*AXES, *(F.col(c).cast("long").alias(c) for c in names), F.xxhash64(*(F.col(c).cast("long") for c in names)).alias("_k"))
    kinds = ", ".join(f"{c} long" for c in names)
    local = written(by_block(rows, grid, kernel, f"x int, y int, z int, {kinds}, scan long, local long, links array<long>", edge), "local")
    # a voxel that another block's voxel meets also meets that one: only faces are joined
    faces = local.filter("links is not null")
    across = faces.select(F.col("local").alias("a"), F.explode("links").alias("other"))
    met = across.join(faces.select(F.col("scan").alias("other"), F.col("local").alias("b")), "other").select("a", "b").distinct()
    roots = connected(met)
    return local.join(roots, F.col("local") == F.col("node"), "left").select(*AXES, *names, F.coalesce("root", "local").alias("component"))


def component_counts(parts: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """label, components; requested labels that are absent have 0."""
    n = parts.groupBy("label").agg(F.count_distinct("component").alias("components"))
    if requested is None:
        return n
    return requested.select(F.col("label").cast("long").alias("label")).distinct().join(n, "label", "left").select("label", F.coalesce("components", F.lit(0)).alias("components"))


def component_order(parts: DataFrame) -> DataFrame:
    """label, component, n, r: a label's components, largest first (ties: least scan index), from 1."""
    sizes = parts.groupBy("label", "component").agg(F.count("*").alias("n"))
    return sizes.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "component")))


def split_disconnected(vox: DataFrame, grid: Grid, next_free: int, connectivity: int = 6, ignored: Iterable[int] = (0,)) -> DataFrame:
    """x, y, z, label: the largest component keeps its label (ties: least scan index).

    The others get fresh ids from max(next_free, largest label + 1) in the order of their
    label, then their size (largest first), then scan index; ignored ids are skipped.
    """
    ignored = sorted(set(ignored))
    parts = components(vox, grid, connectivity, ignored)
    order = component_order(parts).filter("r > 1")
    first = vox.agg(F.greatest(F.lit(next_free), F.max("label") + 1).cast("long").alias("first"))
    from .neighbours import ranked

    fresh = ranked(order.select("label", "component", "r"), "label", "r").crossJoin(F.broadcast(first)).select("component", (F.col("edge_id") - 1 + F.col("first")).alias("fresh"))
    for i in ignored:  # each skipped id moves those from it on by one
        fresh = fresh.withColumn("fresh", F.when((F.col("fresh") >= i) & (F.lit(i) >= F.lit(next_free)), F.col("fresh") + 1).otherwise(F.col("fresh")))
    named = parts.join(fresh, "component", "left").select(*AXES, F.coalesce("fresh", "label").alias("_new"))
    return vox.select(*AXES, "label").join(named, list(AXES), "left").select(*AXES, F.coalesce("_new", F.col("label").cast("long")).alias("label"))


def boundary_consistent(vox: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(x, y, z, label; split map old -> array of new).

    Masked voxels become 0; labels that fall into several face components get new ids for
    all of them, from the largest label + 1 in the order (label, least scan index).
    """
    from .neighbours import ranked

    cut = vox.withColumn("label", F.when(F.col("mask") >= 1, 0).otherwise(F.col("label")))
    parts = components(cut, grid)
    each = parts.select("label", "component").distinct()
    many = each.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("n")).filter("n > 1")
    first = vox.agg((F.max("label") + 1).cast("long").alias("first"))
    fresh = ranked(each.join(many, F.col("label") == F.col("_l"), "left_semi"), "label", "component").crossJoin(F.broadcast(first)).select(F.col("label").alias("old"), "component", (F.col("edge_id") - 1 + F.col("first")).alias("new"))
    fresh = written(fresh, "fresh")
    named = parts.join(fresh.select("component", "new"), "component", "left").select(*AXES, F.coalesce("new", "label").alias("_new"))
    out = vox.select(*AXES).join(named, list(AXES), "left").select(*AXES, F.coalesce("_new", F.lit(0)).cast("long").alias("label"))
    return out, fresh.groupBy("old").agg(F.array_sort(F.collect_list("new")).alias("new"))


def group_components(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, root): components of each working group over initial edges inside it.

    ``members``: label, working; ``edges``: lo, hi.  The root is the least label.
    """
    m = members.select("label", "working")
    inner = edges.select("lo", "hi").join(m.select(F.col("label").alias("lo"), F.col("working").alias("wl")), "lo").join(m.select(F.col("label").alias("hi"), F.col("working").alias("wh")), "hi").filter("wl = wh")
    roots = connected(inner.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    return m.join(roots, F.col("label") == F.col("node"), "left").select("label", "working", F.coalesce("root", "label").alias("root"))


def flood(vox: DataFrame, grid: Grid, seed: tuple[int, int, int], connectivity: int = 6) -> DataFrame:
    """x, y, z of the component of equal label that holds the seed (a label 0 floods as well)."""
    x, y, z = seed
    here = (F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)
    own = vox.filter(here).select(F.col("label").alias("_seed"))
    same = vox.join(F.broadcast(own), F.col("label") == F.col("_seed"), "left_semi")
    parts = components(same, grid, connectivity, background=())
    return parts.join(F.broadcast(parts.filter(here).select(F.col("component").alias("_c"))), F.col("component") == F.col("_c"), "left_semi").select(*AXES)


def same_voxels(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two voxel sets are equal; counts decide first."""
    na, nb = a.agg(F.count("*").alias("na")), b.agg(F.count("*").alias("nb"))
    missing = a.join(b, list(AXES), "left_anti").agg(F.count("*").alias("missing"))
    return na.crossJoin(nb).crossJoin(missing).select(((F.col("na") == F.col("nb")) & (F.col("missing") == 0)).alias("equal"))
