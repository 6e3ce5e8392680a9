"""Queries: distance maps, seeds, watersheds, splits and files (M, X, and parts of S, C, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import AXES, Grid, grid_of, voxels
from ..lineage import written
from ..operators import components, distance, fronts, neighbours, projections, refresh, splits, statistics, working
from ..query import query
from . import workflow

@query("m01_squared_distance", "x y z; d2", "s AS (SELECT x, y, z FROM vox WHERE mask = 1) || SELECT v.x, v.y, v.z, min((v.x - s.x) ** 2 + (v.y - s.y) ** 2 + 4.0 * (v.z - s.z) ** 2) AS d2 FROM vox v, s GROUP BY v.x, v.y, v.z")
def m01(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return distance.squared_distance(vox, vox.filter("mask = 1"), grid_of(vox, (1.0, 1.0, 2.0)))


RIM = "o AS (SELECT i - 1 AS dx, j - 1 AS dy, k - 1 AS dz FROM range(3) a(i), range(3) b(j), range(3) c(k)), s AS (SELECT DISTINCT v.x, v.y, v.z FROM vox w, o, vox v WHERE w.mask <> 0 AND v.x = w.x - dx AND v.y = w.y - dy AND v.z = w.z - dz AND v.mask = 0)"


@query("m02_signed_distance", "x y z; dist", RIM + " || SELECT v.x, v.y, v.z, CASE WHEN max(v.mask) = 0 THEN 1 ELSE -1 END * sqrt(min((v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2)) AS dist FROM vox v, s GROUP BY v.x, v.y, v.z")
def m02(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return distance.signed_distance(vox, grid_of(vox))


@query("m02_maurer_distance", "x y z; dist", RIM.replace("w.mask <> 0", "w.mask = 0").replace("v.mask = 0", "v.mask <> 0") + " || SELECT v.x, v.y, v.z, CASE WHEN max(v.mask) = 0 THEN 1 ELSE -1 END * sqrt(min((v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2)) AS dist FROM vox v, s GROUP BY v.x, v.y, v.z")
def m02_maurer(spark: SparkSession, d: str) -> DataFrame:
    return distance.maurer_distance(voxels(spark, d))


def _distance(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Grid]:
    from ..lineage import written

    vox = voxels(spark, d)
    g = grid_of(vox)
    return vox, written(distance.signed_distance(vox, g), "distance"), g


#: Local maxima (26 neighbours) of the signed distance, and their face components.
PEAKS = RIM + """, dd AS (SELECT v.x, v.y, v.z, CASE WHEN max(v.mask) = 0 THEN 1 ELSE -1 END * sqrt(min((v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2)) AS dist FROM vox v, s GROUP BY v.x, v.y, v.z),
  lo AS (SELECT DISTINCT v.x, v.y, v.z FROM dd v, o, dd w WHERE w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz AND w.dist > v.dist),
  pk AS (SELECT x, y, z, x + 25 * y + 500 * z AS i FROM dd ANTI JOIN lo USING (x, y, z) WHERE dist > 0),
  ad AS (SELECT a.i AS a, b.i AS b FROM pk a JOIN pk b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
  wk(root, i) AS (SELECT i, i FROM pk UNION SELECT w.root, ad.b FROM wk w JOIN ad ON ad.a = w.i), cp AS (SELECT i, min(root) AS root FROM wk GROUP BY i)"""


@query("m03_seeds_from_maxima", "x y z seed", PEAKS + " || SELECT x, y, z, dense_rank() OVER (ORDER BY root) AS seed FROM pk JOIN cp USING (i)")
def m03(spark: SparkSession, d: str) -> DataFrame:
    _, dist, g = _distance(spark, d)
    return distance.extract_seeds(dist, g, "maxima")


@query("m05_seed_methods", "valid voxels;;method", PEAKS + " || SELECT 'maxima' AS method, 1 AS valid, (SELECT count(*) FROM pk) AS voxels UNION ALL SELECT 'all', 0, 0")
def m05(spark: SparkSession, d: str) -> DataFrame:
    """One of the methods by its name; "all" names none."""
    _, dist, g = _distance(spark, d)
    out = []
    for method in ("maxima", "all"):
        try:
            seeds = distance.extract_seeds(dist, g, method).agg(F.lit(1).alias("valid"), F.count("*").alias("voxels"))
        except ValueError:
            seeds = dist.limit(1).select(F.lit(0).alias("valid"), F.lit(0).cast("long").alias("voxels"))
        out.append(seeds.withColumn("method", F.lit(method)))
    return out[0].unionByName(out[1])


@query("m04_h_convex_seeds", "x y z seed")
def m04(spark: SparkSession, d: str) -> DataFrame:
    _, dist, g = _distance(spark, d)
    return distance.extract_seeds(dist, g, "h_convex")


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, Grid]:
    vox = voxels(spark, d)
    seed = F.when((F.col("x") % 5 == 2) & (F.col("y") % 5 == 2) & (F.col("z") % 5 == 1), 1 + F.floor(F.col("x") / 5) + 5 * F.floor(F.col("y") / 5) + 20 * F.floor(F.col("z") / 5)).otherwise(0)
    return vox.select(*AXES, F.col("signal").alias("cost"), seed.alias("seed")), grid_of(vox)


for _mode in ("arrival", "geodesic", "compact"):

    @query({"arrival": "m06", "geodesic": "m07", "compact": "m08"}[_mode] + f"_watershed_{_mode}", "label n")
    def m06(spark: SparkSession, d: str, mode=_mode) -> DataFrame:
        return statistics.label_counts(distance.run_watershed(*_marked(spark, d), "exact", mode=mode))


_MARKS = "(x % 5 = 2 AND y % 5 = 2 AND z % 5 = 1)"


def _kept(flooded: DataFrame, marked: DataFrame) -> DataFrame:
    """One row: voxels flooded, labels, markers, and markers that kept their label."""
    m = marked.filter("seed <> 0").select(*AXES, "seed")
    kept = m.join(flooded, list(AXES)).agg(F.count("*").alias("markers"), F.sum((F.col("label") == F.col("seed")).cast("long")).alias("kept"))
    return flooded.agg(F.count(F.when(F.col("label") != 0, 1)).alias("flooded"), F.count_distinct("label").alias("labels")).crossJoin(kept)


for _mode in ("arrival", "geodesic", "compact", "blockwise"):

    @query(f"{dict(arrival='m06', geodesic='m07', compact='m08', blockwise='m09')[_mode]}_{_mode}_covers", "flooded labels markers kept", f"SELECT count(*) AS flooded, count(*) FILTER {_MARKS.replace('(', '(WHERE ', 1)} AS labels, count(*) FILTER {_MARKS.replace('(', '(WHERE ', 1)} AS markers, count(*) FILTER {_MARKS.replace('(', '(WHERE ', 1)} AS kept FROM vox")
    def covers(spark: SparkSession, d: str, mode=_mode) -> DataFrame:
        marked, g = _marked(spark, d)
        how = {"edge": 16, "halo": 4} if mode == "blockwise" else {"mode": mode}
        return _kept(distance.run_watershed(marked, g, "blockwise" if mode == "blockwise" else "exact", **how), marked)


for _mode in ("arrival", "geodesic"):

    @query(f"{dict(arrival='m06', geodesic='m07')[_mode]}_{_mode}_keys", "voxels unequal", "SELECT count(*) AS voxels, 0 AS unequal FROM vox")
    def keys(spark: SparkSession, d: str, mode=_mode) -> DataFrame:
        """Each voxel's key is the least that its neighbours hand on: the equations have one solution (see ``fronts``)."""
        marked, g = _marked(spark, d)
        r = marked.agg(F.min("cost").alias("lo"), F.max("cost").alias("hi")).first()
        vox = marked.select(*AXES, distance.levels(F.col("cost"), r["lo"], r["hi"]).alias("own"), F.col("seed").cast("long").alias("marker"))
        out = written(fronts.flood(vox.select(*AXES, F.col("own").alias("level"), "marker"), g, mode, edge=8).join(vox, list(AXES)), "keys")
        near = out.select(F.explode(F.array(*(F.struct(*((F.col(a) + (k if a == b else 0)).alias(a) for a in AXES)) for b in AXES for k in (-1, 1)))).alias("p"), F.struct("level", "steps", "label").alias("k")).select("p.*", "k")
        rises = F.col("own") > F.col("k.level")
        steps = F.when(rises & F.lit(mode == "arrival"), 0).otherwise(F.col("k.steps") + 1)
        least = out.select(*AXES, "own").join(near, list(AXES)).groupBy(*AXES).agg(F.min(F.struct(F.greatest("own", "k.level").alias("level"), steps.cast("long").alias("steps"), F.col("k.label").alias("label"))).alias("least"))
        right = F.when(F.col("marker") != 0, F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("steps"), F.col("marker").alias("label"))).otherwise(F.col("least"))
        return out.join(least, list(AXES), "left").agg(F.count("*").alias("voxels"), F.count_if(~F.struct("level", "steps", "label").eqNullSafe(right)).alias("unequal"))


@query("m09_watershed_blockwise", "label n")
def m09(spark: SparkSession, d: str) -> DataFrame:
    return statistics.label_counts(distance.run_watershed(*_marked(spark, d), "blockwise", edge=16, halo=4))


@query("m11_watershed_algorithms", "valid voxels;;algorithm", "SELECT unnest(['exact', 'blockwise', 'compact blockwise', 'other']) AS algorithm, unnest([1, 1, 0, 0]) AS valid, unnest([count(*), count(*), 0, 0]) AS voxels FROM vox")
def m11(spark: SparkSession, d: str) -> DataFrame:
    """Watersheds by name; compactness needs the exact one."""
    marked, g = _marked(spark, d)
    out = []
    for name, algorithm, options in (("exact", "exact", {}), ("blockwise", "blockwise", {"edge": 16, "halo": 4}), ("compact blockwise", "blockwise", {"compactness": 0.1}), ("other", "other", {})):
        try:
            row = distance.run_watershed(marked, g, algorithm, **options).filter("label <> 0").agg(F.lit(1).alias("valid"), F.count("*").alias("voxels"))
        except ValueError:
            row = marked.limit(1).select(F.lit(0).alias("valid"), F.lit(0).cast("long").alias("voxels"))
        out.append(row.withColumn("algorithm", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("m10_automatic_edge", "voxels edge", "n AS (SELECT count(*) * f * f * f AS voxels FROM vox, (SELECT unnest([1, 16, 64, 128]) AS f) q GROUP BY f) || SELECT voxels, least(256, greatest(128, 32 * floor(round(cbrt(voxels / 32.0), 9) / 32))) AS edge FROM n")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """Block edges for the volume as it is and at finer resolutions."""
    n = voxels(spark, d).count()
    return spark.createDataFrame([(n * f**3, distance.automatic_edge(n * f**3, 16)) for f in (1, 16, 64, 128)], "voxels long, edge long")


@query("m12_workflow", "label n")
def m12(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return statistics.label_counts(workflow.segments(vox, grid_of(vox), workflow.Steps(threshold=0.4, least_seed=2))[0])


@query("m12_workflow_agglomerated", "label n")
def m12b(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.agglomeration import Options

    vox = voxels(spark, d)
    g, steps = grid_of(vox), workflow.Steps(threshold=0.4, options=Options(tau=0.25))
    return statistics.label_counts(workflow.agglomerated(vox, workflow.segments(vox, g, steps)[0], g, steps))


@query("c07_repair_split", "label n")
def c07(spark: SparkSession, d: str) -> DataFrame:
    vox, dist, g = _distance(spark, d)
    return statistics.label_counts(splits.repair_split(vox, g, dist))


@query("c08_consistent_partition", "label n")
def c08(spark: SparkSession, d: str) -> DataFrame:
    vox, dist, g = _distance(spark, d)
    repaired = splits.repair_split(vox, g, dist)
    return statistics.label_counts(components.boundary_consistent(repaired.join(vox.select(*AXES, "mask"), list(AXES)), g)[0])


@query("c05_split_and_rebuild", "labels edges")
def c05(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    w = working.build(components.split_disconnected(vox, g, 1), g)
    return w.members.agg(F.count("*").alias("labels")).crossJoin(w.edges.agg(F.count("*").alias("edges")))


@query("g09_geodesic_sides", "label;;upper")
def g09(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    own = vox.filter("label <> 0")
    return splits.geodesic_sides(own, own.filter("x = 0"), own.filter(F.col("x") == grid_of(vox).dimx - 1))


#: Voxels of ``other`` 3 below x = 6 become label 500; s2 are the sides after it.
REPAINTED = (
    "v2 AS (SELECT x, y, z, CASE WHEN other = 3 AND x < 6 THEN 500 ELSE label END AS label FROM vox), f2 AS (" + " UNION ALL ".join(f"SELECT a.x, a.y, a.z, a.label AS la, b.label AS lb, b.x AS x2, b.y AS y2, b.z AS z2 FROM v2 a JOIN v2 b ON b.x = a.x + {i} AND b.y = a.y + {j} AND b.z = a.z + {k}" for i, j, k in ((1, 0, 0), (0, 1, 0), (0, 0, 1))) + "), s2 AS (SELECT la AS label, lb AS neighbour, x, y, z FROM f2 WHERE la <> lb AND la <> 0 AND lb <> 0 UNION SELECT lb, la, x2, y2, z2 FROM f2 WHERE la <> lb AND la <> 0 AND lb <> 0)"
)


@query("g13_refreshed_neighbours", "label neighbour n", REPAINTED + " || SELECT label, neighbour, count(*) AS n FROM s2 GROUP BY 1, 2")
def g13(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    new = projections.paint(vox, vox.filter("other = 3 and x < 6"), 500, 0)
    return neighbours.one_sided(new, grid_of(vox)).groupBy("label", "neighbour").agg(F.count("*").alias("n"))


def _repainted(spark: SparkSession, d: str) -> tuple[refresh.Blocks, working.Working]:
    vox = voxels(spark, d)
    store = refresh.create(vox, grid_of(vox), 16)
    changes = vox.filter("other = 3 and x < 6").select(*AXES, F.lit(500).cast("long").alias("label"))
    return store, refresh.refresh(store, changes, refresh.graph(store))


@query("g13_stored_sides", "label neighbour n", REPAINTED + " || SELECT label, neighbour, count(*) AS n FROM s2 GROUP BY 1, 2")
def g13_stored(spark: SparkSession, d: str) -> DataFrame:
    """Sides of a volume kept by block, after an edit that reads and writes the blocks it reaches."""
    return refresh.sides(_repainted(spark, d)[0])


@query("g13_stored_edges", "lo hi voxels", REPAINTED + " || SELECT least(label, neighbour) AS lo, greatest(label, neighbour) AS hi, count(*) AS voxels FROM s2 GROUP BY 1, 2")
def g13_edges(spark: SparkSession, d: str) -> DataFrame:
    return _repainted(spark, d)[1].edges


def _object(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Grid]:
    vox = voxels(spark, d)
    g, solid = grid_of(vox), vox.select(*AXES, F.lit(1).alias("label"))
    return solid, splits.landscape(splits.object_crop(solid, 1, 1, g), g), g


@query("x01_split_session", "voxels components; low high")
def x01(spark: SparkSession, d: str) -> DataFrame:
    solid, land, g = _object(spark, d)
    n = components.components(solid, g).agg(F.count_distinct("component").alias("components"))
    return land.agg(F.count("*").alias("voxels"), F.min("cost").alias("low"), F.max("cost").alias("high")).crossJoin(n)


@query("x05_seeded_split", "part n")
def x05(spark: SparkSession, d: str) -> DataFrame:
    _, land, g = _object(spark, d)
    last = g.dimz - 1
    seeds = spark.createDataFrame([(1, 1, 0, 1, 0), (10, 10, last, 2, 1), (1, 2, 0, 1, 2)], "x int, y int, z int, part int, seq int")
    return splits.seeded_split(land, seeds, allow_parts=True).groupBy("part").agg(F.count("*").alias("n"))


@query("x05_parts_cover", "voxels parts", "SELECT count(*) AS voxels, 2 AS parts FROM vox")
def x05_cover(spark: SparkSession, d: str) -> DataFrame:
    return x05(spark, d).agg(F.sum("n").alias("voxels"), F.count("*").alias("parts"))


@query("x07_cut_sizes", "n", "SELECT count(*) AS n FROM vox GROUP BY x <= 5")
def x07_sizes(spark: SparkSession, d: str) -> DataFrame:
    return x07(spark, d).select("n")


@query("x04_ray_pick", "x y z")
def x04(spark: SparkSession, d: str) -> DataFrame:
    _, dist, _ = _distance(spark, d)
    return splits.ray_pick(dist.filter("dist > 0"), (0.0, 7.0, 1.0), (1.0, 0.0, 0.0), 24.0)


@query("x06_projected_cut", "part n", "SELECT CASE WHEN x <= 5 THEN 1 ELSE 2 END AS part, count(*) AS n FROM vox GROUP BY 1")
def x06(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    solid, g = vox.select(*AXES, F.lit(1).alias("label")), grid_of(vox)
    flat = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]]
    return splits.projected_cut(solid, g, 1, flat, [(5.4, -1.0), (5.4, 20.0)], 0.9).groupBy("part").agg(F.count("*").alias("n"))


@query("x07_apply_cut", "working n")
def x07(spark: SparkSession, d: str) -> DataFrame:
    solid, _, g = _object(spark, d)
    flat = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]]
    parts = splits.projected_cut(solid, g, 1, flat, [(5.4, -1.0), (5.4, 20.0)], 0.9)
    out, w = working.apply_partition(solid, g, working.build(solid, g), 1, parts)
    return working.label_volume(out, w).groupBy(F.col("label").alias("working")).agg(F.count("*").alias("n"))
