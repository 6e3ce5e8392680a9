"""Aggregates per label and over volumes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from ..lineage import discard, written


def label_counts(vox: DataFrame) -> DataFrame:
    return vox.groupBy("label").agg(F.count("*").alias("n"))


def histogram_split(vox: DataFrame, background: int, ignored: Iterable[int] = ()) -> DataFrame:
    """One row: ignored, background and foreground voxels, foreground labels, largest foreground label's size."""
    ignored = [i for i in ignored if i != background]
    n, is_background = F.col("n"), F.col("label") == background
    is_ignored = F.col("label").isin(ignored) if ignored else F.lit(False)
    front = ~(is_background | is_ignored)

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")

    return label_counts(vox).agg(
        total(is_ignored).alias("ignored"),
        total(is_background).alias("background"),
        total(front).alias("foreground"),
        F.count_if(front).alias("labels"),
        F.coalesce(F.max(F.when(front, n)), F.lit(0)).cast("long").alias("largest"),
    )


def bounds() -> list[Column]:
    return [f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)]


def initial_nodes(vox: DataFrame, ignored: Iterable[int]) -> DataFrame:
    """label, n and bounding box of every label that is not ignored."""
    return vox.filter(~F.col("label").isin(list(ignored))).groupBy("label").agg(F.count("*").alias("n"), *bounds())


def extreme_voxels(vox: DataFrame, grid: Grid) -> DataFrame:
    """Per label and axis the extremes and, as scan index, the first voxel that attains each."""
    i = grid.scan_index()
    cols = []
    for a in AXES:
        cols += [F.min(a).alias(f"min{a}"), F.max(a).alias(f"max{a}")]
        cols += [F.min(F.struct(F.col(a), i.alias("i")))["i"].alias(f"at_min{a}"), F.min(F.struct(-F.col(a), i.alias("i")))["i"].alias(f"at_max{a}")]
    return vox.groupBy("label").agg(*cols)


def merged_bounds(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Bounding boxes of groups of nodes: ``groups`` maps label to group."""
    return nodes.join(groups, "label").groupBy("group").agg(F.sum("n").alias("n"), *(f(f"{f.__name__}{a}").alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)))


def id_range(vox: DataFrame) -> DataFrame:
    return vox.agg(F.min("label").alias("smallest"), F.max("label").alias("largest"), (F.max("label") + 1).alias("next_free"))


def background_id(vox: DataFrame, strategy: str) -> DataFrame:
    if strategy not in ("lowest", "highest"):
        raise ValueError(f"unknown strategy {strategy}")
    return vox.agg((F.min if strategy == "lowest" else F.max)("label").alias("background"))


def labels_below(vox: DataFrame, least: int, ignored: Iterable[int] = ()) -> DataFrame:
    """label, n of labels with fewer than ``least`` voxels; least 0 gives none."""
    return label_counts(vox.filter(~F.col("label").isin(list(ignored)))).filter(F.col("n") < least)


def drop_small(vox: DataFrame, least: int, background: int = 0) -> DataFrame:
    """Labels with fewer than ``least`` voxels become background."""
    small = labels_below(vox, least, [background]).select(F.col("label").alias("_small"))
    return vox.join(small, F.col("label") == F.col("_small"), "left").withColumn("label", F.when(F.col("_small").isNotNull(), background).otherwise(F.col("label"))).drop("_small")


def label_bounds(vox: DataFrame) -> DataFrame:
    return vox.groupBy("label").agg(*bounds())


def representative_voxels(vox: DataFrame, grid: Grid) -> DataFrame:
    """Per label the voxel nearest its centroid; the first in scan order on ties."""
    c = vox.groupBy(F.col("label").alias("_label")).agg(*(F.avg(a).alias(f"c{a}") for a in AXES))
    d = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES)
    d = F.round(d, 9)  # equal distances must tie whatever the order of a float sum
    near = vox.join(c, F.col("label") == F.col("_label")).groupBy("label").agg(F.min(F.struct(d.alias("d"), grid.scan_index().alias("i"), *AXES)).alias("p"))
    return near.select("label", *(F.col(f"p.{a}").alias(a) for a in AXES))


def centroids(vox: DataFrame, key: str = "label") -> DataFrame:
    return vox.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in AXES))


def moments(vox: DataFrame, value: str, key: str = "label", legacy: bool = True) -> DataFrame:
    """mean, sum, min, max, sample variance, skewness, kurtosis of a signal.

    ``legacy`` divides the third moment by variance^(2/3), the observable output of
    existing data sets; otherwise by variance^(3/2).  Zero deviation gives zeros.
    """
    v = F.col(value).cast("double")
    s = vox.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.avg(v * v).alias("p2"), F.avg(v * v * v).alias("p3"), F.avg(v * v * v * v).alias("p4"),
    )
    m, var = F.col("mean"), F.col("variance")
    m3 = F.col("p3") - 3 * m * F.col("p2") + 2 * m * m * m
    m4 = F.col("p4") - 4 * m * F.col("p3") + 6 * m * m * F.col("p2") - 3 * m * m * m * m
    flat = var <= 1e-18
    return s.select(
        key, "n", "mean", "sum", "min", "max", "variance",
        F.when(flat, 0.0).otherwise(m3 / F.pow(var, F.lit(2 / 3 if legacy else 1.5))).alias("skewness"),
        F.when(flat, 0.0).otherwise(m4 / (var * var) - 3).alias("kurtosis"),
    )


def unit_histogram(vox: DataFrame, value: str, key: str = "label", bins: int = 20) -> DataFrame:
    """Counts h0 .. h19 of floor(v / 0.05); what lies above counts in the last bin."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    return vox.groupBy(key).agg(*(F.count_if(b == k).alias(f"h{k}") for k in range(bins)))


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def quantiles(vox: DataFrame, value: str, key: str = "label", bins: int = 1024) -> DataFrame:
    """sorted[int(n * q)] for each q, without interpolation; null and non-finite values take no part.

    A label's values are never sorted: they are counted in ``bins`` equal parts of their range,
    the parts that hold the wanted ranks become the next ranges (from their least to their
    largest value), and so on until a range is one value.  The ends of a range fall into
    different parts, so a range gets narrower each time: by ``bins``, or by single values where
    doubles lie no closer.
    """
    rows = vox.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null and v - v = 0")
    wanted = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.explode(F.array(*(F.struct(F.lit(f"q{int(q * 100)}").alias("name"), F.floor(F.col("n") * F.lit(q)).alias("rank")) for q in QUANTILES))).alias("q")
    wanted = written(wanted.select("k", "lo", "hi", names).select("k", "lo", "hi", "q.name", "q.rank"), "wanted")
    while not wanted.filter("lo < hi").isEmpty():
        ranges = wanted.filter("lo < hi").select(F.col("k").alias("_k"), "lo", "hi").distinct()
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counted = rows.join(ranges, (F.col("k") == F.col("_k")) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("_k", "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        upto = F.sum("c").over(Window.partitionBy("_k", "lo", "hi").orderBy("part"))  # as many rows as bins
        parts = counted.select("_k", F.col("lo").alias("_l"), F.col("hi").alias("_h"), "_lo", "_hi", (upto - F.col("c")).alias("_before"), upto.alias("_upto"))
        met = (F.col("k") == F.col("_k")) & (F.col("lo") == F.col("_l")) & (F.col("hi") == F.col("_h")) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto"))
        narrower = wanted.filter("lo < hi").join(parts, met).select("k", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "name", (F.col("rank") - F.col("_before")).alias("rank"))
        old, wanted = wanted, written(wanted.filter("lo = hi").unionByName(narrower), "wanted")
        discard(old)
    return wanted.groupBy(F.col("k").alias(key)).agg(*(F.max(F.when(F.col("name") == f"q{int(q * 100)}", F.col("lo"))).alias(f"q{int(q * 100)}") for q in QUANTILES))


def majority_label(vox: DataFrame, other: str, key: str = "label") -> DataFrame:
    """The most frequent other label in each label and its share; ties go to the smaller one."""
    n = vox.groupBy(key, other).agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.max(F.struct("n", (-F.col(other)).alias("o"))).alias("b"), F.sum("n").alias("total"))
    return best.select(key, (-F.col("b.o")).alias("majority"), (F.col("b.n") / F.col("total")).alias("fraction"))


def covariance(vox: DataFrame, key: str = "label") -> DataFrame:
    """Population covariance of voxel coordinates: xx, yy, zz, xy, xz, yz."""
    pairs = [(a, b) for k, a in enumerate(AXES) for b in AXES[k:]]
    return vox.groupBy(key).agg(F.count("*").alias("n"), *(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(a + b) for a, b in pairs))


def eigenvalues(cov: DataFrame) -> DataFrame:
    """l1 >= l2 >= l3 of the symmetric matrix in xx, yy, zz, xy, xz, yz (trigonometric solution)."""
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz"))
    p1 = xy * xy + xz * xz + yz * yz
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * p1) / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))) / 3
    l1, l3 = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3)
    flat = p < 1e-12
    return cov.withColumns({"l1": F.when(flat, q).otherwise(l1), "l2": F.when(flat, q).otherwise(3 * q - l1 - l3), "l3": F.when(flat, q).otherwise(l3)})


def eigenvalue_ratios(eigen: DataFrame) -> DataFrame:
    """l1/l2, l1/l3, l2/l3 with denominators under 1e-12 taken as 1e-3."""

    def safe(c: str) -> Column:
        return F.when(F.col(c) < 1e-12, 1e-3).otherwise(F.col(c))

    return eigen.withColumns({"r12": F.col("l1") / safe("l2"), "r13": F.col("l1") / safe("l3"), "r23": F.col("l2") / safe("l3")})


def near_border(grid: Grid, d: int) -> Column:
    c = F.lit(False)
    for a, n in zip(AXES, grid.dims, strict=True):
        if n > 1:
            c = c | (F.col(a) <= d) | (n - 1 - F.col(a) <= d)
    return c


def quantile_range(vox: DataFrame, value: str, low: float, high: float, bins: int = 4096, ignore_zero: bool = False) -> DataFrame:
    """One row (lo, hi): binned quantiles of rank floor(q * (n - 1)), as lower bin edges."""
    v = vox.select(F.col(value).cast("double").alias("v"))
    if ignore_zero:
        v = v.filter("v <> 0")
    r = F.broadcast(v.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n")))  # one row
    b = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * bins), F.lit(bins - 1))).otherwise(0)
    h = v.crossJoin(r).groupBy(b.alias("bin"), "least", "most", "n").agg(F.count("*").alias("c"))
    # at most ``bins`` rows are left for the running sum
    h = h.withColumn("upto", F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))

    def edge(q: float) -> Column:
        first = F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("bin")))
        return F.max("least") + first * (F.max("most") - F.max("least")) / bins

    return h.agg(edge(low).alias("lo"), edge(high).alias("hi"))


def fingerprint(vox: DataFrame, column: str = "label") -> DataFrame:
    """Order-free hash of a volume: equal volumes have equal rows."""
    return vox.agg(F.count("*").alias("voxels"), F.expr(f"bit_xor(xxhash64(x, y, z, {column}))").alias("hash"))


def volume_errors(vox: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a).cast("double") - F.col(b).cast("double")
    return vox.agg(F.max(F.abs(d)).alias("max_error"), F.avg(F.abs(d)).alias("mean_error"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count_if(d != 0).alias("mismatches"))


def overlap_scores(vox: DataFrame, a: str, b: str) -> DataFrame:
    """Per non-zero label of ``a``: best partner in ``b`` by intersection over union (ties: smaller)."""
    both = vox.filter((F.col(a) != 0) & (F.col(b) != 0)).groupBy(a, b).agg(F.count("*").alias("i"))
    na = vox.filter(F.col(a) != 0).groupBy(F.col(a).alias("_a")).agg(F.count("*").alias("na"))
    nb = vox.filter(F.col(b) != 0).groupBy(F.col(b).alias("_b")).agg(F.count("*").alias("nb"))
    j = both.join(na, F.col(a) == F.col("_a")).join(nb, F.col(b) == F.col("_b"))
    iou = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    best = j.groupBy(a).agg(F.max(F.struct(iou.alias("iou"), (-F.col(b)).alias("o"))).alias("m"))
    return best.select(a, (-F.col("m.o")).alias("partner"), F.col("m.iou").alias("iou"))


def mean_extreme_distance(extremes: DataFrame, grid: Grid, at: tuple[float, float, float]) -> DataFrame:
    """Mean distance of the six extreme voxels of each label to a point."""
    dx, dxy = grid.dimx, grid.dimx * grid.dimy
    out = F.lit(0.0)
    for a in AXES:
        for end in ("min", "max"):
            i = F.col(f"at_{end}{a}")
            x, y, z = i % dx, F.floor(i % dxy / dx), F.floor(i / dxy)
            out = out + F.sqrt((x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1]) + (z - at[2]) * (z - at[2]))
    return extremes.select("label", (out / 6).alias("distance"))
