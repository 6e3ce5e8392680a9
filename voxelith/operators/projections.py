"""Per-voxel maps, predicates, crops and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Grid

MAX_16 = 65535


def threshold(c: Column, t: float) -> Column:
    """1 where the value is ``t`` or more (a null or NaN value gives 0)."""
    return F.when(F.isnan(c.cast("double")) | c.isNull(), 0).when(c >= t, 1).otherwise(0)


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def value_range(vox: DataFrame, column: str) -> DataFrame:
    """One row (lo, hi) over finite values; both 0 if there are none."""
    c = F.when(finite(F.col(column)), F.col(column).cast("double"))
    return vox.agg(F.coalesce(F.min(c), F.lit(0.0)).alias("lo"), F.coalesce(F.max(c), F.lit(0.0)).alias("hi"))


def to_16_bit(vox: DataFrame, column: str, mode: str, out: str = "value16") -> DataFrame:
    """Boundary conversion: ``cast`` (clamp), ``minmax`` (stretch) or ``unit`` (0..1 to 0..65535).

    Not finite: 0.  Rounds half away from zero.  A constant volume stretches to 0.
    """
    v = F.col(column).cast("double")
    if mode == "minmax":
        vox = vox.crossJoin(F.broadcast(value_range(vox, column)))  # one row
        scaled = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo")) * MAX_16).otherwise(0.0)
    elif mode == "unit":
        scaled = v * MAX_16
    elif mode == "cast":
        scaled = v
    else:
        raise ValueError(f"unknown mode {mode}")
    rounded = F.floor(F.greatest(F.least(scaled, F.lit(float(MAX_16))), F.lit(0.0)) + 0.5).cast("int")
    return vox.withColumn(out, F.when(finite(F.col(column)), rounded).otherwise(0)).drop("lo", "hi")


def normalized_boundary(vox: DataFrame, column: str, mode: str = "auto", out: str = "unit") -> DataFrame:
    """Boundary in [0, 1].  ``auto`` takes the first range that holds the maximum: 1, 2, 255, else 65535."""
    factors = {"unit": 1.0, "two": 0.5, "byte": 1 / 255.0, "word": 1 / 65535.0}
    v = F.col(column).cast("double")
    if mode == "auto":
        r = F.broadcast(value_range(vox, column))  # one row
        vox = vox.crossJoin(r)
        low = F.col("lo") >= 0
        f = F.when(low & (F.col("hi") <= 1), 1.0).when(low & (F.col("hi") <= 2), 0.5).when(low & (F.col("hi") <= 255), 1 / 255.0).otherwise(1 / 65535.0)
    else:
        f = F.lit(factors[mode])
    unit = F.greatest(F.least(v * f, F.lit(1.0)), F.lit(0.0))
    return vox.withColumn(out, F.when(finite(F.col(column)), unit).otherwise(0.0)).drop("lo", "hi")


def plane(vox: DataFrame, axis: int, at: int) -> DataFrame:
    """The slice with ``axis`` (0 x, 1 y, 2 z) at ``at``: u, v and the other columns."""
    if axis not in (0, 1, 2):
        raise ValueError("axis is 0, 1 or 2")
    u, v = [a for k, a in enumerate(AXES) if k != axis]
    rest = [c for c in vox.columns if c not in AXES]
    return vox.filter(F.col(AXES[axis]) == at).select(F.col(u).alias("u"), F.col(v).alias("v"), *rest)


def inside(low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    c = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        c = c & F.col(a).between(lo, hi)
    return c


def crop(vox: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The box low..high (inclusive), moved to the origin."""
    moved = {a: (F.col(a) - lo).cast("int") for a, lo in zip(AXES, low, strict=True)}
    return vox.filter(inside(low, high)).withColumns(moved)


def paste(vox: DataFrame, roi: DataFrame, low: tuple[int, int, int], column: str = "label") -> DataFrame:
    """(x, y, z, column): ``roi`` at offset ``low`` in a volume of zeros as large as ``vox``."""
    at = roi.select(*((F.col(a) + lo).cast("int").alias(a) for a, lo in zip(AXES, low, strict=True)), F.col(column).alias("_v"))
    return vox.select(*AXES).join(at, list(AXES), "left").select(*AXES, F.coalesce("_v", F.lit(0)).alias(column))


def padded_bounds(vox: DataFrame, label: int, pad: int, grid: Grid) -> DataFrame:
    """Bounding box of a label with ``pad`` on each side, inside the volume."""
    own = vox.filter(F.col("label") == label)
    cols = []
    for a, n in zip(AXES, grid.dims, strict=True):
        cols += [F.greatest(F.min(a) - pad, F.lit(0)).cast("int").alias(f"min{a}"), F.least(F.max(a) + pad, F.lit(n - 1)).cast("int").alias(f"max{a}")]
    return own.agg(*cols)


def on_outer_face(grid: Grid) -> Column:
    c = F.lit(False)
    for a, n in zip(AXES, grid.dims, strict=True):
        c = c | (F.col(a) == 0) | (F.col(a) == n - 1)
    return c


def set_outer_faces(vox: DataFrame, grid: Grid, column: str, value) -> DataFrame:
    return vox.withColumn(column, F.when(on_outer_face(grid), F.lit(value)).otherwise(F.col(column)))


def inject_boundaries(vox: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Label 0 where the mask (a column, or a co-registered volume) is 1 or more."""
    if mask is None:
        return vox.withColumn("label", F.when(F.col("mask") >= 1, 0).otherwise(F.col("label")))
    m = mask.select(*AXES, F.col("mask").alias("_m"))
    return vox.join(m, list(AXES), "left").withColumn("label", F.when(F.col("_m") >= 1, 0).otherwise(F.col("label"))).drop("_m")


def inverted(vox: DataFrame, column: str, out: str = "cost") -> DataFrame:
    """(ceil(max) + 1) - value."""
    top = F.broadcast(vox.agg((F.ceil(F.max(column)) + 1).cast("double").alias("_top")))  # one row
    return vox.crossJoin(top).withColumn(out, F.col("_top") - F.col(column)).drop("_top")


def active() -> Column:
    """A voxel that agglomeration looks at."""
    return (F.col("label") != 0) & (F.col("mask") == 0)


def on_planes(grid: Grid, at: tuple[int, int, int]) -> Column:
    """On one of three slices; positions outside are moved to the nearest slice."""
    c = F.lit(False)
    for a, n, k in zip(AXES, grid.dims, at, strict=True):
        c = c | (F.col(a) == min(max(k, 0), n - 1))
    return c


def delete_labels(vox: DataFrame, labels: DataFrame, background: int) -> tuple[DataFrame, DataFrame]:
    """(volume with the labels set to background, one row with the number of changed voxels).

    ``labels`` has a column label; the background itself is ignored.
    """
    gone = labels.filter(F.col("label") != background).select(F.col("label").alias("_gone")).distinct()
    joined = vox.join(gone, F.col("label") == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    out = joined.withColumn("label", F.when(hit, background).otherwise(F.col("label"))).drop("_gone")
    return out, joined.agg(F.count_if(hit).alias("changed"))


def relabel(vox: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change map (old, new); labels without an entry stay."""
    c = changes.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return vox.join(c, F.col("label") == F.col("_old"), "left").withColumn("label", F.coalesce("_new", "label")).drop("_old", "_new")


def paint(vox: DataFrame, stroke: DataFrame, label: int, background: int, erase: bool = False) -> DataFrame:
    """Write ``label`` on the stroke's voxels (background if erasing); painting background does nothing."""
    if label == background and not erase:
        return vox
    s = stroke.select(*AXES).distinct().withColumn("_s", F.lit(True))
    value = background if erase else label
    return vox.join(s, list(AXES), "left").withColumn("label", F.when(F.col("_s"), value).otherwise(F.col("label"))).drop("_s")


def axis_scale(grid: Grid, axis: int) -> list[tuple[str, float]]:
    """The two axes of a plane and their spacing over the x spacing (1 where that is not valid)."""

    def ratio(s: float) -> float:
        ok = 0 < s < float("inf") and 0 < grid.sx < float("inf")
        return s / grid.sx if ok else 1.0

    spacing = dict(zip(AXES, (grid.sx, grid.sy, grid.sz), strict=True))
    return [(a, ratio(spacing[a])) for k, a in enumerate(AXES) if k != axis]
