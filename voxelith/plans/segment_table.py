"""The per-segment feature table: flags choose what is computed."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Block, Grid, by_block, shifted
from ..operators import neighbours, statistics

FLAGS = ("size", "physical", "centroid", "box", "border", "isolated", "elongation", "flatness", "principal", "ellipsoid", "radius", "faces", "roundness", "oriented")
PI = 3.141592653589793


def segment_table(vox: DataFrame, grid: Grid, flags: Iterable[str] = FLAGS, border: int = 0) -> DataFrame:
    """One row per non-zero label.  Only the aggregates that the flags need are planned.

    Shape attributes follow the public definitions over physical coordinates, with
    spacing^2 / 12 added to each second moment.  The surface is the exposed face area.
    A volume of one layer is described in two dimensions (no z columns).
    """
    flags = set(flags)
    if flags - set(FLAGS):
        raise ValueError(f"unknown flags {flags - set(FLAGS)}")
    flat = grid.dimz == 1
    axes = AXES[:2] if flat else AXES
    spacing = dict(zip(AXES, (grid.sx, grid.sy, grid.sz), strict=True))
    unit = 1.0
    for a in axes:
        unit *= spacing[a]
    own = vox.filter("label <> 0")
    shape = flags & {"elongation", "flatness", "principal", "ellipsoid", "oriented"}
    aggs = [F.count("*").alias("n")]
    if "centroid" in flags:
        aggs += [F.floor(F.avg(a) + 0.5).cast("int").alias(f"c{a}") for a in axes]
    if "box" in flags:
        aggs += [(F.max(a) - F.min(a) + 1).alias(f"size{a}") for a in axes]
    if "border" in flags:
        aggs.append(F.count_if(statistics.near_border(grid, border)).alias("border"))
    if shape:
        for k, a in enumerate(AXES):
            for b in AXES[k:]:
                m = F.covar_pop(F.col(a) * F.lit(spacing[a]), F.col(b) * F.lit(spacing[b]))
                aggs.append((m + (spacing[a] ** 2 / 12 if a == b and a in axes else 0.0)).alias(a + b))
    t = own.groupBy("label").agg(*aggs)
    volume = F.col("n") * unit
    columns: dict = {}
    if flags & {"physical", "radius", "roundness"}:
        columns["physical"] = volume
    if "radius" in flags:
        columns["radius"] = F.sqrt(volume / PI) if flat else F.pow(volume * 3 / (4 * PI), F.lit(1 / 3))
    t = t.withColumns(columns) if columns else t
    if shape:
        t = statistics.eigenvalues(t)
        big, mid, small = ("l1", "l2", "l2") if flat else ("l1", "l2", "l3")
        more = {}
        if "elongation" in flags:
            more["elongation"] = F.when(F.col(mid) > 1e-12, F.sqrt(F.col(big) / F.col(mid))).otherwise(0.0)
        if "flatness" in flags:
            more["flatness"] = F.when(F.col(small) > 1e-12, F.sqrt(F.col(mid) / F.col(small))).otherwise(0.0)
        if "ellipsoid" in flags:
            scale = F.pow(volume * (4 / PI if flat else 6 / PI) / F.sqrt(F.greatest(F.col("l1") * F.col("l2") * (1.0 if flat else F.col("l3")), F.lit(1e-30))), F.lit(1 / 2 if flat else 1 / 3))
            more |= {f"diameter{k}": F.sqrt(F.greatest(F.col(f"l{k}"), F.lit(0.0))) * scale for k in ((1, 2) if flat else (1, 2, 3))}
        t = t.withColumns(more) if more else t
        drop = [a + b for k, a in enumerate(AXES) for b in AXES[k:]] + ([] if "principal" in flags else ["l1", "l2", "l3"])
        t = t.drop(*drop)
    if "isolated" in flags:
        t = t.join(neighbours.isolated(vox, grid), "label", "left")
    if flags & {"faces", "roundness"}:
        t = t.join(exposed_faces(vox, grid), "label", "left")
        if "roundness" in flags:
            ideal = 2 * F.sqrt(PI * volume) if flat else F.pow(F.lit(PI), F.lit(1 / 3)) * F.pow(6 * volume, F.lit(2 / 3))
            t = t.withColumn("roundness", F.when(F.col("surface") > 0, ideal / F.col("surface")))
    if "oriented" in flags:
        t = t.join(oriented_boxes(own, grid), "label", "left")
    return t


def exposed_faces(vox: DataFrame, grid: Grid) -> DataFrame:
    """label, surface (area of faces to other labels or the outside), on_border (outside only)."""
    areas = (grid.sy * grid.sz, grid.sx * grid.sz, grid.sx * grid.sy)
    axes = range(2 if grid.dimz == 1 else 3)
    area = F.when(F.col("axis") == 0, areas[0]).when(F.col("axis") == 1, areas[1]).otherwise(areas[2])
    f = neighbours.faces(vox.select(*AXES, "label"), grid).filter("label = label_2 and label <> 0")
    inner = f.groupBy("label").agg(F.sum(2 * area).alias("inner"))
    outside = sum(((F.col(a) == 0).cast("int") + (F.col(a) == n - 1).cast("int")) * F.lit(areas[k]) for k, (a, n) in enumerate(zip(AXES, grid.dims, strict=True)) if k in axes)
    total = 2.0 * sum(areas[k] for k in axes)
    own = vox.filter("label <> 0").groupBy("label").agg((F.count("*") * total).alias("all"), F.sum(outside).alias("on_border"))
    return own.join(inner, "label", "left").select("label", (F.col("all") - F.coalesce("inner", F.lit(0.0))).alias("surface"), "on_border")


def oriented_boxes(own: DataFrame, grid: Grid) -> DataFrame:
    """label, obb1..3, obb_volume: extents along the principal axes of each label.

    Axes come from the covariance of all voxels (one aggregate), one small row a label;
    the extents are an ordinary aggregate over projections.
    """
    import numpy as np
    import pyarrow as pa

    s = (grid.sx, grid.sy, grid.sz)
    at = {a: F.col(a) * F.lit(float(k)) for a, k in zip(AXES, s, strict=True)}
    cov = own.groupBy("label").agg(*(F.covar_pop(at[a], at[b]).alias(a + b) for k, a in enumerate(AXES) for b in AXES[k:]))

    def axes(batches):
        for batch in batches:
            c = {n: np.asarray(batch.column(n)) for n in ("xx", "yy", "zz", "xy", "xz", "yz")}
            m = np.stack([np.stack([c["xx"], c["xy"], c["xz"]], -1), np.stack([c["xy"], c["yy"], c["yz"]], -1), np.stack([c["xz"], c["yz"], c["zz"]], -1)], 1)
            v = np.linalg.eigh(m)[1][:, :, ::-1] if len(m) else np.zeros((0, 3, 3))
            cols = [pa.array(v[:, i, k]) for k in range(3) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *cols], ["_l", *(f"v{k}{i}" for k in range(3) for i in range(3))])

    kind = own.schema["label"].dataType.simpleString()
    frames = cov.mapInArrow(axes, f"_l {kind}, " + ", ".join(f"v{k}{i} double" for k in range(3) for i in range(3)))
    j = own.select("label", *AXES).join(frames, F.col("label") == F.col("_l"))
    along = [sum(at[a] * F.col(f"v{k}{i}") for i, a in enumerate(AXES)) for k in range(3)]
    wide = [sum(F.abs(F.col(f"v{k}{i}")) * s[i] for i in range(3)) for k in range(3)]
    e = j.groupBy("label").agg(*((F.max(p) - F.min(p) + F.max(w)).alias(f"obb{k + 1}") for k, (p, w) in enumerate(zip(along, wide, strict=True))))
    return e.withColumn("obb_volume", F.col("obb1") * F.col("obb2") * F.col("obb3"))


#: Thirteen directions (x, y, z), each for itself and its opposite.
DIRECTIONS = tuple((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (k, j, i) > (0, 0, 0))
#: Share of the sphere of directions that an axis, a diagonal of a face and one of a
#: cube stand for, with their opposites.
SHARES = {1: 0.09155578240952, 2: 0.07396125575216, 3: 0.07039127956464}


def line_exits(vox: DataFrame, grid: Grid, edge: int = 32) -> DataFrame:
    """label, e0 .. e12: voxels after which a line in each direction leaves the label (0 has none)."""
    names = [f"e{k}" for k in range(len(DIRECTIONS))]

    def kernel(table: pa.Table) -> pa.Table:
        b = Block(table, {"label": 0})
        own = b.own & (b["label"] != 0)
        labels, at = np.unique(b["label"][own], return_inverse=True)
        left = [np.bincount(at, (shifted(b["label"], k, j, i, 0) != b["label"])[own], len(labels)) for i, j, k in DIRECTIONS]
        return pa.table({"label": pa.array(labels.astype(np.int64)), **{n: pa.array(v.astype(np.int64)) for n, v in zip(names, left, strict=True)}})

    counted = by_block(vox.select(*AXES, F.col("label").cast("long").alias("label")), grid, kernel, "label long, " + ", ".join(f"{n} long" for n in names), edge)
    return counted.groupBy("label").agg(*(F.sum(n).alias(n) for n in names))


def crofton_surface(vox: DataFrame, grid: Grid) -> DataFrame:
    """label, surface, roundness: surface area by how often lines of thirteen directions leave a label.

    A line of direction d stands for an area of voxel volume / |d|; four times the mean over
    the sphere of directions of the areas of its exits is the surface.  Roundness is the
    surface of a ball of the same volume over it.  What lies outside the volume is no label.
    """
    voxel = grid.sx * grid.sy * grid.sz
    terms = [4 * SHARES[abs(i) + abs(j) + abs(k)] * voxel / float(np.sqrt((i * grid.sx) ** 2 + (j * grid.sy) ** 2 + (k * grid.sz) ** 2)) * F.col(f"e{n}") for n, (i, j, k) in enumerate(DIRECTIONS)]
    surface = sum(terms[1:], terms[0])
    n = vox.filter("label <> 0").groupBy(F.col("label").cast("long").alias("_l")).agg((F.count("*") * voxel).alias("_v"))
    rows = line_exits(vox, grid).select("label", surface.alias("surface")).join(n, F.col("label") == F.col("_l"))
    return rows.select("label", "surface", (F.pow(F.lit(np.pi), F.lit(1 / 3)) * F.pow(6 * F.col("_v"), F.lit(2 / 3)) / F.col("surface")).alias("roundness"))
