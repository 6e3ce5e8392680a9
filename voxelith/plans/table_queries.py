"""Queries: aggregates, ordering and set operations (A, W, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import AXES, grid_of, voxels
from ..operators import neighbours, ordering, projections, statistics
from ..query import query
from . import segment_table

BOX = "min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz"
BOXES = "minx maxx miny maxy minz maxz"
SCAN = "x + 25 * y + 500 * z"


@query(
    "a01_histogram", "ignored background foreground labels largest",
    "c AS (SELECT label, count(*) AS n FROM vox GROUP BY label) || SELECT coalesce(sum(n) FILTER (label IN (2, 3)), 0) AS ignored, coalesce(sum(n) FILTER (label = 0), 0) AS background, "
    "coalesce(sum(n) FILTER (label NOT IN (0, 2, 3)), 0) AS foreground, count(*) FILTER (label NOT IN (0, 2, 3)) AS labels, coalesce(max(n) FILTER (label NOT IN (0, 2, 3)), 0) AS largest FROM c",
)
def a01(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram_split(voxels(spark, d), 0, (2, 3))


@query("a02_initial_nodes", f"label n {BOXES}", f"SELECT label, count(*) AS n, {BOX} FROM vox WHERE label <> 0 GROUP BY label")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return statistics.initial_nodes(voxels(spark, d), [0])


@query(
    "a03_extreme_voxels", "label minx maxx at_minx at_maxx at_miny at_maxy at_minz at_maxz",
    f"s AS (SELECT *, {SCAN} AS i FROM vox), m AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1, min(z) OVER w AS z0, max(z) OVER w AS z1 FROM s WINDOW w AS (PARTITION BY label)) || "
    "SELECT label, min(x0) AS minx, max(x1) AS maxx, min(i) FILTER (x = x0) AS at_minx, min(i) FILTER (x = x1) AS at_maxx, min(i) FILTER (y = y0) AS at_miny, min(i) FILTER (y = y1) AS at_maxy, min(i) FILTER (z = z0) AS at_minz, min(i) FILTER (z = z1) AS at_maxz FROM m GROUP BY label",
)
def a03(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return statistics.extreme_voxels(vox, grid_of(vox))


@query("a04_merged_bounds", f"group n {BOXES}".replace("group", "g"), f"SELECT label % 5 AS g, count(*) AS n, {BOX} FROM vox WHERE label <> 0 GROUP BY 1")
def a04(spark: SparkSession, d: str) -> DataFrame:
    nodes = statistics.initial_nodes(voxels(spark, d), [0])
    return statistics.merged_bounds(nodes, nodes.select("label", (F.col("label") % 5).alias("group"))).withColumnRenamed("group", "g")


@query("a05_id_range", "smallest largest next_free", "SELECT min(label) AS smallest, max(label) AS largest, max(label) + 1 AS next_free FROM vox")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return statistics.id_range(voxels(spark, d))


for _s, _f in (("lowest", "min"), ("highest", "max")):

    @query(f"a06_background_{_s}", "background", f"SELECT {_f}(label) AS background FROM vox")
    def a06(spark: SparkSession, d: str, s=_s) -> DataFrame:
        return statistics.background_id(voxels(spark, d), s)


@query("a07_labels_below", "label n", "SELECT label, count(*) AS n FROM vox WHERE label NOT IN (0, 2) GROUP BY label HAVING count(*) < 100")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return statistics.labels_below(voxels(spark, d), 100, (0, 2))


@query("a08_drop_small", "x y z label", "small AS (SELECT label FROM vox WHERE label <> 0 GROUP BY label HAVING count(*) < 100) || SELECT x, y, z, CASE WHEN label IN (SELECT label FROM small) THEN 0 ELSE label END AS label FROM vox")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return statistics.drop_small(voxels(spark, d), 100)


@query(
    "a09_small_summary", "labels small smallest largest_small touching",
    "c AS (SELECT label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY label), t AS (SELECT lo AS label FROM edges UNION SELECT hi FROM edges) || "
    "SELECT count(*) AS labels, count(*) FILTER (n < 100) AS small, min(n) AS smallest, max(n) FILTER (n < 100) AS largest_small, count(*) FILTER (n < 100 AND label IN (SELECT label FROM t)) AS touching FROM c",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    c = statistics.label_counts(vox.filter("label <> 0")).join(neighbours.isolated(vox, grid_of(vox)), "label")
    small = F.col("n") < 100
    return c.agg(F.count("*").alias("labels"), F.count_if(small).alias("small"), F.min("n").alias("smallest"), F.max(F.when(small, F.col("n"))).alias("largest_small"), F.count_if(small & ~F.col("isolated")).alias("touching"))


@query("a10_label_box", BOXES, f"SELECT {BOX} FROM vox WHERE label = 7")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).filter("label = 7").agg(*statistics.bounds())


@query("a11_label_bounds", f"label {BOXES}", f"SELECT label, {BOX} FROM vox GROUP BY label")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return statistics.label_bounds(voxels(spark, d))


@query("a11_labels_in_extent", "label", "SELECT DISTINCT label FROM vox WHERE x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 9 AND z BETWEEN 0 AND 5")
def a11b(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).filter(projections.inside((3, 4, 0), (12, 9, 5))).select("label").distinct()


@query(
    "a12_representative_voxels", "label x y z",
    f"c AS (SELECT label AS l, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox GROUP BY label), o AS (SELECT label, x, y, z, row_number() OVER (PARTITION BY label ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), 9), {SCAN}) AS r FROM vox JOIN c ON label = l) || SELECT label, x, y, z FROM o WHERE r = 1",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return statistics.representative_voxels(vox, grid_of(vox))


@query("a13_centroids", "label n; cx cy cz", "SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox GROUP BY label")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return statistics.centroids(voxels(spark, d))


@query("a14_mean_signal", "label; mean", "SELECT label, avg(signal) AS mean FROM vox GROUP BY label")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).groupBy("label").agg(F.avg("signal").alias("mean"))


@query("a15_voxel_counts", "label n", "SELECT label, count(*) AS n FROM vox GROUP BY label")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return statistics.label_counts(voxels(spark, d))


for _legacy, _power in ((True, "2.0::DOUBLE / 3"), (False, "1.5::DOUBLE")):

    @query(
        "a16_moments" + ("_legacy" if _legacy else ""), "label n; mean sum min max variance skewness kurtosis",
        "s AS (SELECT label, count(*) AS n, avg(boundary) AS m, sum(boundary) AS s, min(boundary) AS lo, max(boundary) AS hi, coalesce(var_samp(boundary), 0) AS v FROM vox GROUP BY label), "
        "c AS (SELECT vox.label, avg(pow(boundary - m, 3)) AS m3, avg(pow(boundary - m, 4)) AS m4 FROM vox JOIN s USING (label) GROUP BY vox.label) || "
        f"SELECT label, n, m AS mean, s AS sum, lo AS min, hi AS max, v AS variance, CASE WHEN v <= 1e-18 THEN 0 ELSE m3 / pow(v, {_power}) END AS skewness, CASE WHEN v <= 1e-18 THEN 0 ELSE m4 / (v * v) - 3 END AS kurtosis FROM s JOIN c USING (label)",
    )
    def a16(spark: SparkSession, d: str, legacy=_legacy) -> DataFrame:
        return statistics.moments(voxels(spark, d), "boundary", legacy=legacy)


@query("a17_unit_histogram", "label " + " ".join(f"h{k}" for k in range(20)), "b AS (SELECT label, least(floor(boundary * 20), 19) AS b FROM vox) || SELECT label, " + ", ".join(f"count(*) FILTER (b = {k}) AS h{k}" for k in range(20)) + " FROM b GROUP BY label")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return statistics.unit_histogram(voxels(spark, d), "boundary")


@query("a18_quantiles", "label; q10 q25 q50 q75 q90", "s AS (SELECT label, list_sort(list(boundary)) AS v, count(*) AS n FROM vox GROUP BY label) || SELECT label, " + ", ".join(f"v[CAST(floor(n * {q}::DOUBLE) AS BIGINT) + 1] AS q{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM s")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return statistics.quantiles(voxels(spark, d), "boundary")


@query("a19_merged_moments", "g n; mean sum min max variance", "SELECT label % 5 AS g, count(*) AS n, avg(boundary) AS mean, sum(boundary) AS sum, min(boundary) AS min, max(boundary) AS max, var_samp(boundary) AS variance FROM vox GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return statistics.moments(voxels(spark, d).withColumn("g", F.col("label") % 5), "boundary", "g")


@query(
    "a20_majority_label", "label majority; fraction",
    "c AS (SELECT label, other, count(*) AS n FROM vox GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, other) AS r, sum(n) OVER (PARTITION BY label) AS t FROM c) || SELECT label, other AS majority, n::DOUBLE / t AS fraction FROM r WHERE r = 1",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    return statistics.majority_label(voxels(spark, d), "other")


COV = ", ".join(f"covar_pop({a}::DOUBLE, {b}::DOUBLE) AS {a}{b}" for k, a in enumerate(AXES) for b in AXES[k:])


@query("a21_covariance", "label n; xx xy xz yy yz zz", f"SELECT label, count(*) AS n, {COV} FROM vox GROUP BY label")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return statistics.covariance(voxels(spark, d))


EIGEN = (
    f"c AS (SELECT label, {COV} FROM vox WHERE label <> 0 GROUP BY label), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), "
    "p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), "
    "b AS (SELECT *, (xx - q) / p AS ba, (yy - q) / p AS bb, (zz - q) / p AS bc, xy / p AS bd, xz / p AS be, yz / p AS bf FROM p), "
    "f AS (SELECT *, acos(greatest(least((ba * (bb * bc - bf * bf) - bd * (bd * bc - bf * be) + be * (bd * bf - bb * be)) / 2, 1.0), -1.0)) / 3 AS phi FROM b), "
    "e AS (SELECT label, CASE WHEN p < 1e-12 THEN q ELSE q + 2 * p * cos(phi) END AS l1, CASE WHEN p < 1e-12 THEN q ELSE q + 2 * p * cos(phi + 2 * pi() / 3) END AS l3, xx + yy + zz AS t FROM f)"
)


@query("a22_eigenvalue_ratios", "label; l1 l2 l3 r12 r13 r23", EIGEN + " || SELECT label, l1, t - l1 - l3 AS l2, l3, l1 / CASE WHEN t - l1 - l3 < 1e-12 THEN 1e-3 ELSE t - l1 - l3 END AS r12, l1 / CASE WHEN l3 < 1e-12 THEN 1e-3 ELSE l3 END AS r13, (t - l1 - l3) / CASE WHEN l3 < 1e-12 THEN 1e-3 ELSE l3 END AS r23 FROM e")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return statistics.eigenvalue_ratios(statistics.eigenvalues(statistics.covariance(voxels(spark, d).filter("label <> 0"))))


@query("a23_segment_core", "label n cx cy cz sizex sizey sizez; physical", "SELECT label, count(*) AS n, floor(avg(x) + 0.5) AS cx, floor(avg(y) + 0.5) AS cy, floor(avg(z) + 0.5) AS cz, max(x) - min(x) + 1 AS sizex, max(y) - min(y) + 1 AS sizey, max(z) - min(z) + 1 AS sizez, count(*)::DOUBLE AS physical FROM vox WHERE label <> 0 GROUP BY label")
def a23(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.segment_table(vox, grid_of(vox), ("size", "physical", "centroid", "box"))


@query("a24_near_border", "label border", "g AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM vox) || SELECT label, count(*) FILTER (x <= 1 OR mx - x <= 1 OR y <= 1 OR my - y <= 1 OR (mz > 0 AND (z <= 1 OR mz - z <= 1))) AS border FROM vox, g WHERE label <> 0 GROUP BY label")
def a24(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.segment_table(vox, grid_of(vox), ("border",), border=1)


@query("a25_shape", "label; elongation flatness radius diameter1 diameter2 diameter3")
def a25(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.segment_table(vox, grid_of(vox), ("elongation", "flatness", "ellipsoid", "radius"))


@query(
    "a26_exposed_surface", "label; surface on_border",
    "g AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM vox), i AS (SELECT la AS label, 2.0 * count(*) AS inner_ FROM faces WHERE la = lb AND la <> 0 GROUP BY la), "
    "a AS (SELECT label, 6.0 * count(*) AS all_, sum((x = 0)::INT + (x = mx)::INT + (y = 0)::INT + (y = my)::INT + (z = 0)::INT + (z = mz)::INT) AS on_border FROM vox, g WHERE label <> 0 GROUP BY label) || SELECT a.label, all_ - coalesce(inner_, 0) AS surface, on_border FROM a LEFT JOIN i ON a.label = i.label",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.exposed_faces(vox, grid_of(vox))


#: Exits of lines, by direction, from pairs of voxels that lie so to each other.
EXITS = "d AS (SELECT n, dx, dy, dz FROM (VALUES " + ", ".join(f"({n}, {i}, {j}, {k})" for n, (i, j, k) in enumerate(segment_table.DIRECTIONS)) + """) t(n, dx, dy, dz)),
  c AS (SELECT label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY label), st AS (SELECT v.label, d.n, count(*) AS k FROM vox v, d, vox w WHERE w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz AND v.label = w.label AND v.label <> 0 GROUP BY 1, 2),
  ex AS (SELECT c.label, c.n AS size, d.n, abs(dx) + abs(dy) + abs(dz) AS l, sqrt(dx * dx + dy * dy + 4.0 * dz * dz) AS long, c.n - coalesce(k, 0) AS exits FROM c CROSS JOIN d LEFT JOIN st ON st.label = c.label AND st.n = d.n)"""


@query("a26_crofton_surface", "label; surface roundness", EXITS + f" || SELECT label, surface, pi() ** (1 / 3.0::DOUBLE) * (12.0::DOUBLE * size) ** (2 / 3.0::DOUBLE) / surface AS roundness FROM (SELECT label, max(size) AS size, sum(4 * 2.0::DOUBLE * exits / long * CASE l WHEN 1 THEN {segment_table.SHARES[1]}::DOUBLE WHEN 2 THEN {segment_table.SHARES[2]}::DOUBLE ELSE {segment_table.SHARES[3]}::DOUBLE END) AS surface FROM ex GROUP BY label) q")
def a26_crofton(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.crofton_surface(vox, grid_of(vox, (1.0, 1.0, 2.0)))


@query("a26_line_exits", "label " + " ".join(f"e{n}" for n in range(13)), EXITS + " || SELECT label, " + ", ".join(f"max(exits) FILTER (n = {n}) AS e{n}" for n in range(13)) + " FROM ex GROUP BY label")
def a26_exits(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.line_exits(vox, grid_of(vox))


@query("a27_oriented_boxes", "label; obb1 obb2 obb3 obb_volume")
def a27(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table.oriented_boxes(vox.filter("label <> 0"), grid_of(vox))


@query("a28_flat_table", "label n cx cy sizex sizey; physical radius", "SELECT label, count(*) AS n, floor(avg(x) + 0.5) AS cx, floor(avg(y) + 0.5) AS cy, max(x) - min(x) + 1 AS sizex, max(y) - min(y) + 1 AS sizey, count(*)::DOUBLE AS physical, sqrt(count(*) / pi()) AS radius FROM vox WHERE label <> 0 AND z = 0 GROUP BY label")
def a28(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d).filter("z = 0")
    return segment_table.segment_table(vox, grid_of(vox), ("size", "physical", "centroid", "box", "radius"))


@query("a29_extrema", ";lo hi", "SELECT min(signal) AS lo, max(signal) AS hi FROM vox")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).agg(F.min("signal").alias("lo"), F.max("signal").alias("hi"))


@query(
    "a30_quantile_range", ";lo hi",
    "r AS (SELECT min(signal) AS lo, max(signal) AS hi, count(*) AS n FROM vox WHERE signal <> 0), b AS (SELECT least(floor((signal - lo) / (hi - lo) * 4096), 4095) AS b, count(*) AS c FROM vox, r WHERE signal <> 0 GROUP BY 1), u AS (SELECT b, sum(c) OVER (ORDER BY b) AS upto FROM b) || "
    "SELECT max(lo) + min(b) FILTER (upto > floor(0.02::DOUBLE * (n - 1))) * (max(hi) - max(lo)) / 4096 AS lo, max(lo) + min(b) FILTER (upto > floor(0.98::DOUBLE * (n - 1))) * (max(hi) - max(lo)) / 4096 AS hi FROM u, r",
)
def a30(spark: SparkSession, d: str) -> DataFrame:
    return statistics.quantile_range(voxels(spark, d), "signal", 0.02, 0.98, ignore_zero=True)


@query("a31_finite_range", ";lo hi", "SELECT min(b) AS lo, max(b) AS hi FROM (SELECT boundary AS b FROM vox WHERE label % 9 <> 4) t")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return projections.value_range(voxels(spark, d).withColumn("b", F.when(F.col("label") % 9 == 4, F.lit(float("nan"))).otherwise(F.col("boundary"))), "b")


@query("a32_fingerprint", "voxels hash")
def a32(spark: SparkSession, d: str) -> DataFrame:
    return statistics.fingerprint(voxels(spark, d))


TRUTH = "c AS (SELECT label, other, count(*) AS n FROM vox GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, other) AS r, sum(n) OVER (PARTITION BY label) AS t FROM c), gt AS (SELECT label AS l, other AS g, n::DOUBLE / t AS f FROM r WHERE r = 1)"


@query("a33_truth_flag", "edge_id should_merge", TRUTH + " || SELECT edge_id, CASE WHEN a.g = b.g AND a.g <> 0 THEN 1 ELSE -1 END AS should_merge FROM edges JOIN gt a ON lo = a.l JOIN gt b ON hi = b.l")
def a33(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    e = neighbours.two_sided(neighbours.one_sided(vox, grid_of(vox)))
    m = statistics.majority_label(vox, "other")
    j = e.join(m.select(F.col("label").alias("lo"), F.col("majority").alias("a")), "lo").join(m.select(F.col("label").alias("hi"), F.col("majority").alias("b")), "hi")
    return j.select("edge_id", F.when((F.col("a") == F.col("b")) & (F.col("a") != 0), 1).otherwise(-1).alias("should_merge"))


@query("a34_volume_errors", "mismatches; max_error mean_error rmse", "SELECT count(*) FILTER (boundary <> mask) AS mismatches, max(abs(boundary - mask)) AS max_error, avg(abs(boundary - mask)) AS mean_error, sqrt(avg((boundary - mask) * (boundary - mask))) AS rmse FROM vox")
def a34(spark: SparkSession, d: str) -> DataFrame:
    return statistics.volume_errors(voxels(spark, d), "boundary", "mask")


@query(
    "a34_overlap_scores", "label partner; iou",
    "b AS (SELECT label, other, count(*) AS i FROM vox WHERE label <> 0 AND other <> 0 GROUP BY 1, 2), na AS (SELECT label AS l, count(*) AS na FROM vox WHERE label <> 0 GROUP BY 1), nb AS (SELECT other AS o, count(*) AS nb FROM vox WHERE other <> 0 GROUP BY 1), "
    "s AS (SELECT label, other, i::DOUBLE / (na + nb - i) AS iou FROM b JOIN na ON label = l JOIN nb ON other = o), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY iou DESC, other) AS r FROM s) || SELECT label, other AS partner, iou FROM k WHERE r = 1",
)
def a34b(spark: SparkSession, d: str) -> DataFrame:
    return statistics.overlap_scores(voxels(spark, d), "label", "other")


@query(
    "a35_extreme_distance", "label; distance",
    f"s AS (SELECT *, {SCAN} AS i FROM vox), m AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1, min(z) OVER w AS z0, max(z) OVER w AS z1 FROM s WINDOW w AS (PARTITION BY label)), "
    "e AS (SELECT label, unnest([min(i) FILTER (x = x0), min(i) FILTER (x = x1), min(i) FILTER (y = y0), min(i) FILTER (y = y1), min(i) FILTER (z = z0), min(i) FILTER (z = z1)]) AS i FROM m GROUP BY label) || "
    "SELECT label, avg(sqrt(pow(i % 25 - 1, 2) + pow((i // 25) % 20 - 2, 2) + pow(i // 500 - 1, 2))) AS distance FROM e GROUP BY label",
)
def a35(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    return statistics.mean_extreme_distance(statistics.extreme_voxels(vox, g), g, (1.0, 2.0, 1.0))


@query("a36_feature_vector", "label; f1 f2 f3", "SELECT label, avg(signal) AS f1, count(*)::DOUBLE AS f2, max(boundary) AS f3 FROM vox GROUP BY label")
def a36(spark: SparkSession, d: str) -> DataFrame:
    f = voxels(spark, d).groupBy("label").agg(F.array(F.avg("signal"), F.count("*").cast("double"), F.max("boundary")).alias("features"))
    return f.select("label", *(F.col("features")[k].alias(f"f{k + 1}") for k in range(3)))


@query("a37_seed_summary", "other n; cx cy cz", "SELECT other, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox GROUP BY other")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return statistics.centroids(voxels(spark, d), "other")


@query("w01_argmax", "label x y z", f"o AS (SELECT label, x, y, z, row_number() OVER (PARTITION BY label ORDER BY boundary DESC, {SCAN}) AS r FROM vox) || SELECT label, x, y, z FROM o WHERE r = 1")
def w01(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return ordering.top_per_key(vox.withColumn("scan", grid_of(vox).scan_index()), "label", F.desc("boundary"), "scan")


@query("w02_dense_ids", "label id", f"f AS (SELECT label, min({SCAN}) AS first FROM vox GROUP BY label) || SELECT label, row_number() OVER (ORDER BY first) AS id FROM f")
def w02(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.ranked(vox.groupBy("label").agg(F.min(grid_of(vox).scan_index()).alias("first")), "first").select("label", F.col("edge_id").alias("id"))


@query("w03_running_sum", "bin c upto", "b AS (SELECT floor(boundary * 20) AS bin, count(*) AS c FROM vox GROUP BY 1) || SELECT bin, c, sum(c) OVER (ORDER BY bin) AS upto FROM b")
def w03(spark: SparkSession, d: str) -> DataFrame:
    b = voxels(spark, d).groupBy(F.floor(F.col("boundary") * 20).alias("bin")).agg(F.count("*").alias("c"))  # 21 rows at most
    return b.withColumn("upto", F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


@query("w04_table_sort", "label n", "SELECT label, count(*) AS n FROM vox GROUP BY label ORDER BY n DESC, label")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return ordering.table_sort(statistics.label_counts(voxels(spark, d)), "n", descending=True)


@query("w07_navigation", "label before after", "c AS (SELECT label, count(*) AS n FROM vox GROUP BY label) || SELECT label, lag(label) OVER (ORDER BY n, label) AS before, lead(label) OVER (ORDER BY n, label) AS after FROM c")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return ordering.neighbours_in_order(statistics.label_counts(voxels(spark, d)), "n")


@query(
    "w08_after_merge", "label n",
    "c AS (SELECT label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY label), m AS (SELECT label AS o, 1000 + label % 3 AS k FROM c WHERE label <= 12), j AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label DESC) AS r FROM c LEFT JOIN m ON label = o) || SELECT coalesce(k, label) AS label, n FROM j WHERE k IS NULL OR r = 1",
)
def w08(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.label_counts(voxels(spark, d).filter("label <> 0"))
    return ordering.after_merge(c, c.filter("label <= 12").select(F.col("label").alias("old"), (1000 + F.col("label") % 3).alias("new")))


@query("w09_removed_rows", "label n", "SELECT label, count(*) AS n FROM vox WHERE label <> 0 AND label % 3 <> 0 GROUP BY label")
def w09(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.label_counts(voxels(spark, d).filter("label <> 0"))
    return ordering.without(c, c.filter("label % 3 = 0"))


@query("u01_union_of_axes", "axis n", "SELECT axis, count(*) AS n FROM faces GROUP BY axis")
def u01(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.faces(vox, grid_of(vox)).groupBy("axis").agg(F.count("*").alias("n"))


@query("u02_replaced_labels", "label", "SELECT DISTINCT label FROM vox EXCEPT SELECT DISTINCT CASE WHEN x < 10 THEN 0 ELSE label END FROM vox")
def u02(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    after = vox.withColumn("label", F.when(F.col("x") < 10, 0).otherwise(F.col("label")))
    return vox.select("label").distinct().subtract(after.select("label").distinct())
