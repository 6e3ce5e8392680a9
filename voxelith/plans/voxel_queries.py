"""Queries: sources, projections and per-voxel maps (S, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..grid import AXES, grid_of, voxels
from ..operators import ordering, projections, statistics
from ..query import query
from ..sources import volumes

XYZ = "x y z"


@query("s03_typed_scan", "x y z label; boundary signal", "SELECT x, y, z, label, CAST(boundary AS FLOAT) AS boundary, signal FROM vox")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).withColumn("boundary", F.col("boundary").cast("float"))


for _mode, _expr in (("cast", "signal"), ("minmax", "CASE WHEN hi > lo THEN (signal - lo) / (hi - lo) * 65535 ELSE 0 END"), ("unit", "boundary * 65535")):

    @query(f"s05_to_16_bit_{_mode}", "x y z value16", f"r AS (SELECT min(signal) AS lo, max(signal) AS hi FROM vox) || SELECT x, y, z, floor(greatest(least({_expr}, 65535.0), 0.0) + 0.5) AS value16 FROM vox, r")
    def s05(spark: SparkSession, d: str, mode=_mode) -> DataFrame:
        return projections.to_16_bit(voxels(spark, d), "boundary" if mode == "unit" else "signal", mode)


@query("s06_rescaled_16_bit", "x y z value16", "w AS (SELECT x, y, z, CAST(floor(signal) AS INT) AS v FROM vox), r AS (SELECT min(v) AS lo, max(v) AS hi FROM w) || SELECT x, y, z, floor(CASE WHEN hi > lo THEN (CAST(v AS DOUBLE) - lo) / (hi - lo) * 65535 ELSE 0 END + 0.5) AS value16 FROM w, r")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return projections.to_16_bit(voxels(spark, d).withColumn("v", F.floor("signal").cast("int")), "v", "minmax")


@query("s07_command_line_casts", "seed flag; scalar", "SELECT CAST(label AS BIGINT) AS seed, CASE WHEN signal <> 0 THEN 1 ELSE 0 END AS flag, CAST(signal AS FLOAT) AS scalar FROM vox")
def s07(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select(F.col("label").cast("long").alias("seed"), (F.col("signal") != 0).cast("int").alias("flag"), F.col("signal").cast("float").alias("scalar"))


@query("s08_image_summary", "dimx dimy dimz voxels; lo hi", "SELECT max(x) + 1 AS dimx, max(y) + 1 AS dimy, max(z) + 1 AS dimz, count(*) AS voxels, min(signal) AS lo, max(signal) AS hi FROM vox")
def s08(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).agg(*((F.max(a) + 1).alias(f"dim{a}") for a in AXES), F.count("*").alias("voxels"), F.min("signal").alias("lo"), F.max("signal").alias("hi"))


@query("s16_empty_volume", "x y z label", "SELECT x, y, z, 0 AS label FROM vox")
def s16(spark: SparkSession, d: str) -> DataFrame:
    return volumes.empty_like(voxels(spark, d))


@query("s17_spacing_override", "dimx dimy dimz; sx sy sz volume", "SELECT max(x) + 1 AS dimx, max(y) + 1 AS dimy, max(z) + 1 AS dimz, 0.5 AS sx, 0.5 AS sy, 2.0 AS sz, count(*) * 0.5 AS volume FROM vox")
def s17(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = volumes.with_spacing(grid_of(vox), 0.5, 0.5, 2.0)
    return vox.agg(*((F.max(a) + 1).alias(f"dim{a}") for a in AXES), F.lit(g.sx).alias("sx"), F.lit(g.sy).alias("sy"), F.lit(g.sz).alias("sz"), (F.count("*") * (g.sx * g.sy * g.sz)).alias("volume"))


@query(
    "s18_layer_names", "p_partkey;; stem clean numbered",
    "p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part) || "
    "SELECT p_partkey, p_name AS stem, regexp_replace(trim(p_name), '[^A-Za-z0-9_.-]+', '_', 'g') AS clean, CASE WHEN k > 0 THEN concat(p_name, ' (', k, ')') ELSE p_name END AS numbered FROM p",
)
def s18(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.concat(F.lit("out/"), "p_name", F.lit(".nii.gz")).alias("path"))
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return p.select("p_partkey", names.stem(F.col("path")).alias("stem"), names.sanitized(names.first_filled(F.lit(" "), F.col("p_name"))).alias("clean"), names.numbered(F.col("p_name"), k).alias("numbered"))


#: Numbers i of the voxels of the least cube, n on an edge, that holds as many as the volume.
CUBE = "e AS (SELECT CAST(ceil(round(cbrt(count(*)), 9)) AS BIGINT) AS n FROM vox), c AS (SELECT n, unnest(range(n * n * n)) AS i FROM e), g AS (SELECT n, i, i % n AS x, (i // n) % n AS y, i // (n * n) AS z FROM c)"


def _cube(spark: SparkSession, d: str) -> int:
    voxels_ = voxels(spark, d).count()
    n = max(round(voxels_ ** (1 / 3)) - 1, 0)
    while n**3 < voxels_:
        n += 1
    return n


@query("s20_checkerboard", "x y z label mask; boundary", CUBE + " || SELECT x, y, z, i + 1 AS label, CASE WHEN (z // 4) % 4 = 3 THEN 1 ELSE 0 END AS mask, CAST((x + y + z) % 2 AS DOUBLE) AS boundary FROM g")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return volumes.checkerboard(spark, _cube(spark, d))


@query("s20_shells", "mask n", CUBE + ", r AS (SELECT x - (n - 1) / 2.0::DOUBLE AS x, y - (n - 1) / 2.0::DOUBLE AS y, z - (n - 1) / 2.0::DOUBLE AS z FROM g) || SELECT CASE WHEN floor(sqrt(x * x + y * y + z * z)) % 8 = 0 THEN 1 ELSE 0 END AS mask, count(*) AS n FROM r GROUP BY 1")
def s20_shells(spark: SparkSession, d: str) -> DataFrame:
    return volumes.shells(spark, _cube(spark, d)).groupBy("mask").agg(F.count("*").alias("n"))


@query("s20_spheres", "mask n", CUBE + ", r AS (SELECT x % 16 - 7.5 AS x, y % 16 - 7.5 AS y, z % 16 - 7.5 AS z FROM g) || SELECT CASE WHEN x * x + y * y + z * z >= 64 THEN 1 ELSE 0 END AS mask, count(*) AS n FROM r GROUP BY 1")
def s20_spheres(spark: SparkSession, d: str) -> DataFrame:
    return volumes.spheres(spark, _cube(spark, d)).groupBy("mask").agg(F.count("*").alias("n"))


@query("s20_sparse_sites", "mask n")
def s20_sites(spark: SparkSession, d: str) -> DataFrame:
    return volumes.sparse_sites(spark, _cube(spark, d)).groupBy("mask").agg(F.count("*").alias("n"))


@query("p01_threshold", "x y z above", "SELECT x, y, z, CASE WHEN boundary >= 0.25 THEN 1 ELSE 0 END AS above FROM vox")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select(*AXES, projections.threshold(F.col("boundary"), 0.25).alias("above"))


@query("p02_slice_threshold", "u v above", "SELECT x AS u, y AS v, CASE WHEN boundary >= 0.25 THEN 1 ELSE 0 END AS above FROM vox WHERE z = 1")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return projections.plane(voxels(spark, d), 2, 1).select("u", "v", projections.threshold(F.col("boundary"), 0.25).alias("above"))


@query("p03_cast_to_byte", "x y z v", "SELECT x, y, z, CAST(trunc(least(signal, 255.0)) AS INT) AS v FROM vox")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select(*AXES, F.least(F.col("signal"), F.lit(255.0)).cast("int").alias("v"))


for _axis, _u, _v in ((0, "y", "z"), (1, "x", "z"), (2, "x", "y")):

    @query(f"p04_slice_axis{_axis}", "u v label; boundary", f"SELECT {_u} AS u, {_v} AS v, label, boundary FROM vox WHERE {'xyz'[_axis]} = 1")
    def p04(spark: SparkSession, d: str, axis=_axis) -> DataFrame:
        return projections.plane(voxels(spark, d), axis, 1)


@query("p05_crop", "x y z label", "SELECT x - 3 AS x, y - 4 AS y, z AS z, label FROM vox WHERE x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 9 AND z BETWEEN 0 AND 5")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return projections.crop(voxels(spark, d), (3, 4, 0), (12, 9, 5))


@query("p05_paste", "x y z label", "SELECT x, y, z, CASE WHEN x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 9 AND z BETWEEN 0 AND 5 THEN label ELSE 0 END AS label FROM vox")
def p05b(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.paste(vox, projections.crop(vox, (3, 4, 0), (12, 9, 5)), (3, 4, 0))


@query("p06_padded_bounds", "minx maxx miny maxy minz maxz", "g AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM vox) || SELECT greatest(min(x) - 2, 0) AS minx, least(max(x) + 2, max(mx)) AS maxx, greatest(min(y) - 2, 0) AS miny, least(max(y) + 2, max(my)) AS maxy, greatest(min(z) - 2, 0) AS minz, least(max(z) + 2, max(mz)) AS maxz FROM vox, g WHERE label = 7")
def p06(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.padded_bounds(vox, 7, 2, grid_of(vox))


@query("p07_outer_faces", "x y z label", "g AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM vox) || SELECT x, y, z, CASE WHEN x IN (0, mx) OR y IN (0, my) OR z IN (0, mz) THEN 99 ELSE label END AS label FROM vox, g")
def p07(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.set_outer_faces(vox, grid_of(vox), "label", 99)


@query("p08_inject_boundaries", "x y z label", "SELECT x, y, z, CASE WHEN mask >= 1 THEN 0 ELSE label END AS label FROM vox")
def p08(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.inject_boundaries(vox.drop("mask"), vox)


@query("p09_invert", "x y z; cost", "r AS (SELECT ceil(max(signal)) + 1 AS top FROM vox) || SELECT x, y, z, top - signal AS cost FROM vox, r")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return projections.inverted(voxels(spark, d), "signal")


@query("p10_normalize_auto", "x y z; unit", "r AS (SELECT CASE WHEN max(signal) <= 1 THEN 1.0 WHEN max(signal) <= 2 THEN 0.5 WHEN max(signal) <= 255 AND min(signal) >= 0 THEN 1 / 255.0::DOUBLE ELSE 1 / 65535.0::DOUBLE END AS f FROM vox) || SELECT x, y, z, greatest(least(signal * f, 1.0), 0.0) AS unit FROM vox, r")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return projections.normalized_boundary(voxels(spark, d), "signal")


@query("p10_normalize_byte", "x y z; unit", "SELECT x, y, z, greatest(least(signal / 255.0::DOUBLE, 1.0), 0.0) AS unit FROM vox")
def p10b(spark: SparkSession, d: str) -> DataFrame:
    return projections.normalized_boundary(voxels(spark, d), "signal", "byte")


@query("p11_active_voxels", "x y z label", "SELECT x, y, z, label FROM vox WHERE label <> 0 AND mask = 0")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).filter(projections.active())


@query("p12_preview_planes", "x y z label", "g AS (SELECT max(z) AS mz FROM vox) || SELECT x, y, z, label FROM vox, g WHERE x = 12 OR y = 10 OR z = mz")
def p12(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return vox.filter(projections.on_planes(grid_of(vox), (12, 10, 100_000)))


@query("p13_delete_labels", "x y z label", "SELECT x, y, z, CASE WHEN label IN (3, 5, 8) THEN 0 ELSE label END AS label FROM vox")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return projections.delete_labels(voxels(spark, d), spark.range(0, 9).filter("id in (0, 3, 5, 8)").select(F.col("id").alias("label")), 0)[0]


@query("p13_deleted_count", "changed", "SELECT count(*) AS changed FROM vox WHERE label IN (3, 5, 8)")
def p13b(spark: SparkSession, d: str) -> DataFrame:
    return projections.delete_labels(voxels(spark, d), spark.range(0, 9).filter("id in (0, 3, 5, 8)").select(F.col("id").alias("label")), 0)[1]


@query("p14_relabel", "x y z label", "SELECT x, y, z, CASE WHEN label % 4 = 1 AND label <> 0 THEN 1000 + label ELSE label END AS label FROM vox")
def p14(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.relabel(vox, vox.filter("label % 4 = 1").select("label").distinct().select(F.col("label").alias("old"), (F.col("label") + 1000).alias("new")))


@query("p15_paint", "x y z label", "SELECT x, y, z, CASE WHEN x + y = z + 10 THEN 555 ELSE label END AS label FROM vox")
def p15(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.paint(vox, vox.filter("x + y = z + 10"), 555, 0)


@query("p15_erase", "x y z label", "SELECT x, y, z, CASE WHEN x + y = z + 10 THEN 0 ELSE label END AS label FROM vox")
def p15b(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return projections.paint(vox, vox.filter("x + y = z + 10"), 555, 0, erase=True)


@query("p16_text_filter", "label n", "SELECT label, count(*) AS n FROM vox WHERE contains(CAST(label AS VARCHAR), '1') GROUP BY label")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return ordering.text_filter(statistics.label_counts(voxels(spark, d)), "1")


@query("p18_column_ramp", "label; t", "c AS (SELECT label, count(*) AS n FROM vox GROUP BY label), r AS (SELECT min(n) AS lo, max(n) AS hi FROM c WHERE n >= 0) || SELECT label, (n - lo)::DOUBLE / (hi - lo) AS t FROM c, r")
def p18(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.label_counts(voxels(spark, d))
    r = F.broadcast(c.filter("n >= 0").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))  # one row
    return c.crossJoin(r).select("label", ((F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))


@query("p19_point_lookup", "label", "SELECT label FROM vox WHERE x = 12 AND y = 7 AND z = 1")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).filter("x = 12 and y = 7 and z = 1").select("label")


@query("p20_axis_scale", "axis; scale", "SELECT 1 AS axis, 1.0 AS scale UNION ALL SELECT 2, 4.0")
def p20(spark: SparkSession, d: str) -> DataFrame:
    g = volumes.with_spacing(grid_of(voxels(spark, d)), 0.5, 0.5, 2.0)
    return spark.createDataFrame([(AXES.index(a), s) for a, s in projections.axis_scale(g, 0)], "axis long, scale double")
