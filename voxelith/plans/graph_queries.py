"""Queries: neighbours, components, working graph and agglomeration (N, C, G, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import AXES, Grid, grid_of, voxels
from ..operators import agglomeration, components, neighbours, refresh, statistics, working
from ..lineage import written
from ..operators.graph import connected
from ..query import query
from .table_queries import SCAN, TRUTH

SIDES = (
    "sides AS (SELECT DISTINCT * FROM (SELECT la AS label, lb AS neighbour, x, y, z FROM faces WHERE la <> lb AND la <> 0 AND lb <> 0 "
    "UNION ALL SELECT lb, la, x2, y2, z2 FROM faces WHERE la <> lb AND la <> 0 AND lb <> 0) s)"
)
RAG = (
    "rag AS (SELECT least(la, lb) AS lo, greatest(la, lb) AS hi, sum(0.5::DOUBLE * (ba + bb)) AS total_b, count(*)::DOUBLE AS total_a, "
    "coalesce(sum(0.5::DOUBLE * (ba + bb)) FILTER (ma = 0 AND mb = 0), 0) AS open_b, (count(*) FILTER (ma = 0 AND mb = 0))::DOUBLE AS open_a "
    "FROM faces WHERE la <> lb AND la <> 0 AND lb <> 0 {where} GROUP BY 1, 2)"
)
OPEN = RAG.format(where="AND ma = 0 AND mb = 0")
#: Face components of equal labels: reach lists (least candidate, voxel) pairs.
COMPONENTS = (
    f"s AS (SELECT {SCAN} AS i, label FROM vox WHERE {{where}}), adj AS (SELECT x + 25 * y + 500 * z AS a, x2 + 25 * y2 + 500 * z2 AS b FROM faces WHERE la = lb AND {{faces}}), "
    "both_ AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj), reach(root, i) AS (SELECT i, i FROM s UNION SELECT r.root, b.b FROM reach r JOIN both_ b ON b.a = r.i), "
    "comp AS (SELECT i, min(root) AS component FROM reach GROUP BY i)"
)
FACE_COMPONENTS = COMPONENTS.format(where="label <> 0", faces="la <> 0")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Grid]:
    vox = voxels(spark, d)
    g = grid_of(vox)
    return vox, neighbours.one_sided(vox, g), g


@query("n01_one_sided_edges", "label neighbour x y z", SIDES + " || SELECT * FROM sides")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d)[1]


@query("n02_opposite_side", "label neighbour n", SIDES + " || SELECT neighbour AS label, label AS neighbour, count(*) AS n FROM sides GROUP BY 1, 2")
def n02(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d)[1].groupBy(F.col("neighbour").alias("label"), F.col("label").alias("neighbour")).agg(F.count("*").alias("n"))


@query(
    "n03_two_sided_edges", "edge_id lo hi voxels minx maxx miny maxy minz maxz",
    SIDES + ", t AS (SELECT least(label, neighbour) AS lo, greatest(label, neighbour) AS hi, count(*) AS voxels, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz FROM sides GROUP BY 1, 2) || SELECT row_number() OVER (ORDER BY lo, hi) AS edge_id, * FROM t",
)
def n03(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.two_sided(_sides(spark, d)[1])


@query("n04_isolated", "label;;isolated", "t AS (SELECT lo AS label FROM edges UNION SELECT hi FROM edges) || SELECT DISTINCT label, label NOT IN (SELECT label FROM t) AS isolated FROM vox WHERE label <> 0")
def n04(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.isolated(vox, grid_of(vox))


@query("n05_rag_edges", "lo hi; total_b total_a open_b open_a", OPEN + " || SELECT * FROM rag")
def n05(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.region_adjacency(vox, grid_of(vox))


@query("n06_region_index", "region_id label n", f"f AS (SELECT label, min({SCAN}) AS first, count(*) AS n FROM vox WHERE label <> 0 AND mask = 0 GROUP BY label) || SELECT row_number() OVER (ORDER BY first) - 1 AS region_id, label, n FROM f")
def n06(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.region_index(vox, grid_of(vox))


@query("n07_open_and_total", "lo hi; total_b total_a open_b open_a", RAG.format(where="") + " || SELECT * FROM rag")
def n07(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.region_adjacency(vox, grid_of(vox), apply_mask=False)


PLAN = "c AS (SELECT label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY label), b AS (SELECT lo AS label, hi AS neighbour FROM edges UNION ALL SELECT hi, lo FROM edges), p AS (SELECT b.label, b.neighbour, row_number() OVER (PARTITION BY b.label ORDER BY c.n {order}, b.neighbour) AS r FROM b JOIN c ON c.label = b.neighbour WHERE b.label % 3 = 0)"

for _name, _order in (("smallest", "ASC"), ("largest", "DESC")):

    @query(f"n08_merge_plan_{_name}", "label neighbour", PLAN.format(order=_order) + " || SELECT label, neighbour FROM p WHERE r = 1")
    def n08(spark: SparkSession, d: str, largest=_name == "largest") -> DataFrame:
        vox, sides, _ = _sides(spark, d)
        counts = statistics.label_counts(vox.filter("label <> 0"))
        return neighbours.merge_plan(counts, neighbours.two_sided(sides), counts.filter("label % 3 = 0"), largest)


OFFSETS = "o AS (SELECT i - 1 AS dx, j - 1 AS dy, k - 1 AS dz FROM range(3) a(i), range(3) b(j), range(3) c(k) WHERE NOT (i = 1 AND j = 1 AND k = 1))"


@query("n09_local_maxima", "x y z", OFFSETS + " || SELECT x, y, z FROM vox v WHERE signal > 0 AND NOT EXISTS (SELECT 1 FROM o, vox w WHERE w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz AND w.signal > v.signal)")
def n09(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.local_maxima(vox, grid_of(vox), "signal")


@query("n10_boundary_background", "x y z", OFFSETS + " || SELECT DISTINCT w.x - dx AS x, w.y - dy AS y, w.z - dz AS z FROM vox w, o, vox v WHERE w.mask <> 0 AND v.x = w.x - dx AND v.y = w.y - dy AND v.z = w.z - dz AND v.mask = 0")
def n10(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.boundary_background(vox, grid_of(vox))


VOLUME = SIDES + ", ev AS (SELECT x, y, z, max(edge_id) AS edge_id FROM sides JOIN edges ON lo = least(label, neighbour) AND hi = greatest(label, neighbour) GROUP BY x, y, z)"


@query("n11_edge_volume", "x y z edge_id", VOLUME + " || SELECT * FROM ev")
def n11(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)[1]
    return neighbours.edge_volume(sides, neighbours.two_sided(sides))


@query("n12_stroke_edges", "edge_id;;action", VOLUME + " || SELECT DISTINCT edge_id, CASE WHEN x < 12 THEN 'unmerge' ELSE 'merge' END AS action FROM ev WHERE x = y AND z = 1")
def n12(spark: SparkSession, d: str) -> DataFrame:
    vox, sides, _ = _sides(spark, d)
    stroke = vox.filter("x = y and z = 1").select(*AXES, (F.col("x") < 12).alias("red"))
    return neighbours.stroke_edges(stroke, neighbours.edge_volume(sides, neighbours.two_sided(sides)))


BALL = "ball AS (SELECT i - 1 AS dx, j - 1 AS dy, k - 1 AS dz FROM range(3) a(i), range(3) b(j), range(3) c(k) WHERE abs(i - 1) + abs(j - 1) + abs(k - 1) <= 1), own AS (SELECT x, y, z FROM vox WHERE label = 7)"


@query("n13_dilate", "x y z label", BALL + ", d AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM own, ball) || SELECT v.x, v.y, v.z, CASE WHEN label = 0 AND d.x IS NOT NULL THEN 7 ELSE label END AS label FROM vox v LEFT JOIN d ON v.x = d.x AND v.y = d.y AND v.z = d.z")
def n13(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.dilate(vox, grid_of(vox), 7, 1)


@query(
    "n13_erode", "x y z label",
    BALL + ", out_ AS (SELECT DISTINCT v.x - dx AS x, v.y - dy AS y, v.z - dz AS z FROM vox v, ball WHERE label <> 7) || SELECT v.x, v.y, v.z, CASE WHEN label = 7 AND o.x IS NOT NULL THEN 0 ELSE label END AS label FROM vox v LEFT JOIN out_ o ON v.x = o.x AND v.y = o.y AND v.z = o.z",
)
def n13b(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.erode(vox, grid_of(vox), 7, 1)


@query("n13_open_close", "opened closed")
def n13c(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    a = neighbours.opened(vox, g, 7, 1).agg(F.count_if(F.col("label") == 7).alias("opened"))
    return a.crossJoin(neighbours.closed(vox, g, 7, 1).agg(F.count_if(F.col("label") == 7).alias("closed")))


@query("n14_smooth", "x y z; smooth")
def n14(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return neighbours.smoothed(vox, grid_of(vox), "signal", 1.0)


@query("c01_components", "x y z label component", FACE_COMPONENTS + f" || SELECT x, y, z, label, component FROM vox JOIN comp ON i = {SCAN}")
def c01(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.components(vox, grid_of(vox), edge=16)


@query("w05_component_order", "label component n r", FACE_COMPONENTS + f" || SELECT label, component, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, component) AS r FROM vox JOIN comp ON i = {SCAN} GROUP BY label, component")
def w05(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.component_order(components.components(vox, grid_of(vox)))


@query("c01_component_counts", "label components", FACE_COMPONENTS + f", n AS (SELECT label, count(DISTINCT component) AS k FROM vox JOIN comp ON i = {SCAN} GROUP BY label) || SELECT r.label, coalesce(k, 0) AS components FROM range(1, 200) r(label) LEFT JOIN n ON n.label = r.label")
def c01b(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.component_counts(components.components(vox, grid_of(vox)), spark.range(1, 200).select(F.col("id").alias("label")))


@query("c01_components_26", "components")
def c01c(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.components(vox, grid_of(vox), 26, edge=16).agg(F.count_distinct("component").alias("components"))


CROPPED = COMPONENTS.format(where="label <> 0 AND x BETWEEN 3 AND 16 AND y BETWEEN 2 AND 13", faces="la <> 0 AND x BETWEEN 3 AND 16 AND y BETWEEN 2 AND 13 AND x2 BETWEEN 3 AND 16 AND y2 BETWEEN 2 AND 13")


@query("c02_components_in_crop", "label components", CROPPED + f" || SELECT label, count(DISTINCT component) AS components FROM vox JOIN comp ON i = {SCAN} GROUP BY label")
def c02(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.component_counts(components.components(vox.filter("x between 3 and 16 and y between 2 and 13"), grid_of(vox)))


@query(
    "c03_split_disconnected", "x y z label",
    FACE_COMPONENTS + f", k AS (SELECT label, component, count(*) AS n FROM vox JOIN comp ON i = {SCAN} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS r FROM k), "
    "m AS (SELECT max(label) + 1 AS top FROM vox), f AS (SELECT component, row_number() OVER (ORDER BY label, r) - 1 + top AS fresh FROM r, m WHERE r > 1) || "
    f"SELECT x, y, z, coalesce(fresh, label) AS label FROM vox LEFT JOIN comp ON comp.i = {SCAN} LEFT JOIN f ON f.component = comp.component",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.split_disconnected(vox, grid_of(vox), 1)


GROUPED = (
    "members AS (SELECT DISTINCT label, 1 + label % 4 AS working FROM vox WHERE label <> 0), e2 AS (SELECT lo, hi FROM edges JOIN members a ON a.label = lo JOIN members b ON b.label = hi WHERE a.working = b.working), "
    "eb AS (SELECT lo AS a, hi AS b FROM e2 UNION ALL SELECT hi, lo FROM e2), walk(root, label) AS (SELECT label, label FROM members UNION SELECT w.root, b FROM walk w JOIN eb ON a = w.label), gc AS (SELECT label, min(root) AS root FROM walk GROUP BY label)"
)


def _members(vox: DataFrame) -> DataFrame:
    return vox.filter("label <> 0").select("label", (1 + F.col("label") % 4).alias("working")).distinct()


@query("c04_group_components", "label working root", GROUPED + " || SELECT gc.label, working, root FROM gc JOIN members USING (label)")
def c04(spark: SparkSession, d: str) -> DataFrame:
    vox, sides, _ = _sides(spark, d)
    return components.group_components(_members(vox), neighbours.two_sided(sides))


MASKED = COMPONENTS.format(where="label <> 0 AND mask = 0", faces="la <> 0 AND ma = 0 AND mb = 0")
FRESH = f", k AS (SELECT DISTINCT label, component FROM vox JOIN comp ON i = {SCAN}), many AS (SELECT label FROM k GROUP BY label HAVING count(*) > 1), m AS (SELECT max(label) + 1 AS top FROM vox), f AS (SELECT label AS old, component, row_number() OVER (ORDER BY label, component) - 1 + top AS new FROM k, m WHERE label IN (SELECT label FROM many))"


@query("c06_boundary_consistent", "x y z label", MASKED + FRESH + f" || SELECT x, y, z, CASE WHEN comp.i IS NULL THEN 0 ELSE coalesce(new, label) END AS label FROM vox LEFT JOIN comp ON comp.i = {SCAN} LEFT JOIN f ON f.component = comp.component")
def c06(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.boundary_consistent(vox, grid_of(vox))[0]


@query("c06_split_map", "old new", MASKED + FRESH + " || SELECT old, new FROM f")
def c06b(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.boundary_consistent(vox, grid_of(vox))[1].select("old", F.explode("new").alias("new"))


BINARY = f"s AS (SELECT {SCAN} AS i FROM vox WHERE mask = 1), adj AS (SELECT x + 25 * y + 500 * z AS a, x2 + 25 * y2 + 500 * z2 AS b FROM faces WHERE ma = 1 AND mb = 1), both_ AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj), reach(root, i) AS (SELECT i, i FROM s UNION SELECT r.root, b.b FROM reach r JOIN both_ b ON b.a = r.i), comp AS (SELECT i, min(root) AS component FROM reach GROUP BY i)"


@query("c09_mask_components", "x y z component", BINARY + f" || SELECT x, y, z, component FROM vox JOIN comp ON i = {SCAN}")
def c09(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return components.components(vox.filter("mask = 1").withColumn("label", F.lit(1)), grid_of(vox))


@query("c10_flood_fill", "x y z", FACE_COMPONENTS + f", seed AS (SELECT component AS c FROM comp WHERE i = (SELECT min({SCAN}) FROM vox WHERE label = 7)) || SELECT x, y, z FROM vox JOIN comp ON i = {SCAN} JOIN seed ON component = c")
def c10(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    s = vox.filter("label = 7").orderBy(g.scan_index()).first()
    return components.flood(vox, g, (s["x"], s["y"], s["z"])) if s else vox.limit(0).select(*AXES)


@query("c11_same_voxels", ";;equal", "SELECT (SELECT count(*) FROM vox WHERE label = 7 AND mask = 0) = (SELECT count(*) FROM vox WHERE label = 7) AS equal")
def c11(spark: SparkSession, d: str) -> DataFrame:
    own = voxels(spark, d).filter("label = 7")
    return components.same_voxels(own.filter("mask = 0").select(*AXES), own.select(*AXES))


# ------------------------------------------------------------ working graph


@query("g01_build_graph", "labels edges next_free", "SELECT (SELECT count(DISTINCT label) FROM vox WHERE label <> 0) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT max(label) + 1 FROM vox) AS next_free")
def g01(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    w = working.build(vox, grid_of(vox))
    return w.members.agg(F.count("*").alias("labels")).crossJoin(w.edges.agg(F.count("*").alias("edges"))).withColumn("next_free", F.lit(w.next_free))


@query("g02_identity_groups", "label working", "SELECT DISTINCT label, label AS working FROM vox WHERE label <> 0")
def g02(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return working.build(vox, grid_of(vox)).members


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, working.Working]:
    from dataclasses import replace

    vox = voxels(spark, d)
    w = working.build(vox, grid_of(vox))
    return vox, replace(w, members=w.members.select("label", (1 + F.col("label") % 4).alias("working")))


@query("g03_working_edges", "w_lo w_hi edge_id", GROUPED + " || SELECT least(a.working, b.working) AS w_lo, greatest(a.working, b.working) AS w_hi, edge_id FROM edges JOIN members a ON a.label = lo JOIN members b ON b.label = hi WHERE a.working <> b.working")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return working.working_edges(_grouped(spark, d)[1]).select("w_lo", "w_hi", F.explode("edge_ids").alias("edge_id"))


MERGED = (
    "ids AS (SELECT DISTINCT label FROM vox WHERE label <> 0), el AS (SELECT lo AS a, hi AS b FROM edges WHERE edge_id % {k} = 0), eb AS (SELECT a, b FROM el UNION ALL SELECT b, a FROM el), "
    "walk(root, label) AS (SELECT label, label FROM ids UNION SELECT w.root, b FROM walk w JOIN eb ON a = w.label), gc AS (SELECT label, min(root) AS root FROM walk GROUP BY label), "
    "big AS (SELECT root FROM gc GROUP BY root HAVING count(*) > 1), m AS (SELECT max(label) + 1 AS top FROM vox), fresh AS (SELECT root, row_number() OVER (ORDER BY root) - 1 + top AS id FROM big, m), mem AS (SELECT label, coalesce(id, label) AS working FROM gc LEFT JOIN fresh USING (root))"
)


def _merged(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, working.Working]:
    vox = voxels(spark, d)
    w = working.build(vox, grid_of(vox))
    return vox, working.merge(w, w.edges.filter(F.col("edge_id") % k == 0))


@query("g04_merge_one_edge", "label working", "e AS (SELECT lo, hi FROM edges WHERE edge_id = 7), m AS (SELECT max(label) + 1 AS top FROM vox) || SELECT DISTINCT label, CASE WHEN label = lo OR label = hi THEN top ELSE label END AS working FROM vox, e, m WHERE label <> 0")
def g04(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    w = working.build(vox, grid_of(vox))
    return working.merge(w, w.edges.filter("edge_id = 7")).members


@query("g05_merge_edge_set", "label working", MERGED.format(k=7) + " || SELECT label, working FROM mem")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, 7)[1].members


@query("g05_edge_status", "edge_id status", "SELECT edge_id, CASE WHEN edge_id % 7 = 0 THEN 2 ELSE 0 END AS status FROM edges")
def g05b(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, 7)[1].status


#: Lengths of paths inside the merged group of edge 3, without that edge, from both of its ends.
LENGTHS = MERGED.format(k=3) + f""", cen AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox WHERE label <> 0 GROUP BY label), {SIDES},
  cut AS (SELECT lo, hi FROM edges WHERE edge_id = 3), mid AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM sides JOIN cut ON least(label, neighbour) = lo AND greatest(label, neighbour) = hi),
  grp AS (SELECT label FROM mem WHERE working = (SELECT working FROM mem JOIN cut ON label = lo)),
  way AS (SELECT a.label AS a, b.label AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) AS weight
          FROM (SELECT lo, hi FROM edges WHERE edge_id <> 3 UNION ALL SELECT hi, lo FROM edges WHERE edge_id <> 3) e JOIN cen a ON a.label = lo JOIN cen b ON b.label = hi WHERE lo IN (SELECT label FROM grp) AND hi IN (SELECT label FROM grp)),
  d AS (SELECT c.label, c.label = lo AS source, c.cx, c.cy, c.cz, m.cx AS mx, m.cy AS my, m.cz AS mz, sqrt((c.cx - m.cx) ** 2 + (c.cy - m.cy) ** 2 + (c.cz - m.cz) ** 2) AS d FROM cen c, cut, mid m WHERE c.label IN (lo, hi)),
  len(label, source, dist) USING KEY (label, source) AS (
    SELECT label, source, CASE WHEN d = 0 THEN 0.0 ELSE abs(d - 1.0) END::DOUBLE FROM d UNION
    SELECT b, l.source, min(l.dist + weight) FROM len l JOIN way ON a = l.label LEFT JOIN recurring.len k ON k.label = b AND k.source = l.source WHERE k.dist IS NULL OR l.dist + weight < k.dist GROUP BY 1, 2),
  lengths AS (SELECT g.label, min(dist) FILTER (source) AS lower, min(dist) FILTER (NOT source) AS upper FROM grp g LEFT JOIN len USING (label) GROUP BY 1),
  halves AS (SELECT label, CASE WHEN label = lo OR (label <> hi AND coalesce(lower < upper, lower IS NOT NULL)) THEN 0 ELSE 1 END AS side FROM lengths, cut)"""
#: Least label of each part of the groups: ``part`` (label, k), edges inside parts but for edge {cut}.
PARTS = ", ways AS (SELECT lo AS a, hi AS b FROM edges JOIN part p ON p.label = lo JOIN part q ON q.label = hi WHERE p.k = q.k AND edge_id <> {cut} UNION SELECT hi, lo FROM edges JOIN part p ON p.label = lo JOIN part q ON q.label = hi WHERE p.k = q.k AND edge_id <> {cut}), far(root, label) AS (SELECT label, label FROM part UNION SELECT f.root, b FROM far f JOIN ways ON a = f.label) || SELECT label, min(root) AS least FROM far GROUP BY label"


def _cut_centres(spark: SparkSession, d: str) -> tuple[working.Working, DataFrame, DataFrame]:
    """Groups after every third edge merged; centres of labels and of edges."""
    vox, w = _merged(spark, d, 3)
    sides = neighbours.one_sided(vox, grid_of(vox))
    e = sides.select(F.least("label", "neighbour").alias("lo"), F.greatest("label", "neighbour").alias("hi"), *AXES).join(w.edges.select("edge_id", "lo", "hi"), ["lo", "hi"]).groupBy("edge_id").agg(*(F.avg(a).alias(f"c{a}") for a in AXES))
    return w, statistics.centroids(vox), e


def _least(members: DataFrame) -> DataFrame:
    """label, least label of its group: what does not depend on how groups are named."""
    least = members.groupBy("working").agg(F.min("label").alias("least"))
    return members.join(least, "working").select("label", "least")


#: Face components of the groups' voxels (gcp) and of the initial labels (comp), after every fifth edge merged.
SPLIT = MERGED.format(k=5) + ", " + FACE_COMPONENTS.replace("reach", "lreach").replace("s AS (", "ls AS (").replace("FROM s ", "FROM ls ") + f""", gv AS (SELECT {SCAN} AS i, working FROM vox JOIN mem USING (label)),
  ga AS (SELECT x + 25 * y + 500 * z AS a, x2 + 25 * y2 + 500 * z2 AS b FROM faces JOIN mem p ON p.label = la JOIN mem q ON q.label = lb WHERE p.working = q.working),
  gb AS (SELECT a, b FROM ga UNION ALL SELECT b, a FROM ga), greach(root, i) AS (SELECT i, i FROM gv UNION SELECT r.root, gb.b FROM greach r JOIN gb ON gb.a = r.i), gcp AS (SELECT i, min(root) AS part FROM greach GROUP BY i)"""


def _rebuilt(spark: SparkSession, d: str) -> tuple[DataFrame, working.Working, Grid]:
    vox, w = _merged(spark, d, 5)
    g = grid_of(vox)
    return *working.split_and_rebuild(vox, g, w), g


@query("c05_groups_after_split", "x y z part", SPLIT + f" || SELECT x, y, z, part FROM vox JOIN gcp ON i = {SCAN}")
def c05_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group by its least scan index."""
    vox, w, g = _rebuilt(spark, d)
    groups = working.label_volume(vox, w).filter("label <> 0").withColumn("i", g.scan_index())
    return groups.join(groups.groupBy("label").agg(F.min("i").alias("part")), "label").select(*AXES, "part")


@query("c05_status_after_split", "edges inside labels", SPLIT + """, pe AS (SELECT DISTINCT least(a.component, b.component) AS lo, greatest(a.component, b.component) AS hi, ga.part = gb2.part AS inside FROM faces JOIN comp a ON a.i = x + 25 * y + 500 * z JOIN comp b ON b.i = x2 + 25 * y2 + 500 * z2
  JOIN gcp ga ON ga.i = a.i JOIN gcp gb2 ON gb2.i = b.i WHERE a.component <> b.component) || SELECT (SELECT count(*) FROM pe) AS edges, (SELECT count(*) FROM pe WHERE inside) AS inside, (SELECT count(DISTINCT component) FROM comp) AS labels""")
def c05_status(spark: SparkSession, d: str) -> DataFrame:
    _, w, _ = _rebuilt(spark, d)
    return w.status.agg(F.count("*").alias("edges"), F.count_if(F.col("status") == 2).alias("inside")).crossJoin(w.members.agg(F.count_distinct("label").alias("labels")))


@query("g06_unmerge", "label least", LENGTHS + ", part AS (SELECT label, 1000000 + side AS k FROM halves UNION ALL SELECT label, working FROM mem WHERE label NOT IN (SELECT label FROM grp))" + PARTS.format(cut=3))
def g06(spark: SparkSession, d: str) -> DataFrame:
    w, c, e = _cut_centres(spark, d)
    return _least(working.unmerge(w, 3, c, e).members)


@query("g07_path_lengths", "label; lower upper", LENGTHS + " || SELECT * FROM lengths")
def g07(spark: SparkSession, d: str) -> DataFrame:
    w, c, e = _cut_centres(spark, d)
    return working.cut_lengths(w, 3, c, e)


@query("g08_split_group", "label least", MERGED.format(k=3) + ", part AS (SELECT label, CASE WHEN working = (SELECT working FROM mem WHERE label = 7) THEN 1000000 + label % 2 ELSE working END AS k FROM mem)" + PARTS.format(cut=0))
def g08(spark: SparkSession, d: str) -> DataFrame:
    _, w = _merged(spark, d, 3)
    group = w.members.filter("label = 7").select("working")
    sides = w.members.join(group, "working", "left_semi").select("label", (F.col("label") % 2).alias("side"))
    return _least(working.split_group(w, sides).members)


@query("g10_explode_groups", "label working", MERGED.format(k=7) + ", hit AS (SELECT DISTINCT working AS w FROM mem WHERE label IN (7, 12)) || SELECT label, CASE WHEN working IN (SELECT w FROM hit) THEN label ELSE working END AS working FROM mem")
def g10(spark: SparkSession, d: str) -> DataFrame:
    _, w = _merged(spark, d, 7)
    return working.explode_groups(w, w.members.filter("label in (7, 12)")).members


@query("g11_cut_out", "label least", MERGED.format(k=3) + ", part AS (SELECT label, CASE WHEN label = 7 THEN 1000000 ELSE working END AS k FROM mem)" + PARTS.format(cut=0))
def g11(spark: SparkSession, d: str) -> DataFrame:
    _, w = _merged(spark, d, 3)
    return _least(working.cut_out(w, 7).members)


@query("g12_remove_node", "edge_id lo hi", "SELECT edge_id, lo, hi FROM edges WHERE lo <> 7 AND hi <> 7")
def g12(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return working.remove_node(working.build(vox, grid_of(vox)), 7).edges


@query("g14_label_volume", "x y z label", MERGED.format(k=7) + " || SELECT x, y, z, coalesce(working, 0) AS label FROM vox LEFT JOIN mem USING (label)")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return working.label_volume(*_merged(spark, d, 7))


@query("g15_refine_at_point", "label n")
def g15(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    out, w = working.refine_at(vox, vox.select(*AXES, F.col("other").alias("label")), g, (3, 3, 0), working.build(vox, g))
    return statistics.label_counts(out)


@query("g15_groups_near_refinement", "label least", MERGED.format(k=7) + f""", oa AS (SELECT a.x + 25 * a.y + 500 * a.z AS a, b.x + 25 * b.y + 500 * b.z AS b FROM faces f JOIN vox a ON a.x = f.x AND a.y = f.y AND a.z = f.z JOIN vox b ON b.x = x2 AND b.y = y2 AND b.z = z2 WHERE a.other = b.other),
  ob AS (SELECT a, b FROM oa UNION ALL SELECT b, a FROM oa), fl(i) AS (SELECT 12 + 25 * 10 + 500 * 1 UNION SELECT b FROM fl JOIN ob ON a = fl.i), fv AS (SELECT x, y, z FROM vox JOIN fl ON fl.i = {SCAN}),
  bx AS (SELECT min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1, min(z) - 2 AS z0, max(z) + 2 AS z1 FROM fv),
  nr AS (SELECT DISTINCT working FROM vox JOIN mem USING (label), bx WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1),
  we AS (SELECT p.working AS a, q.working AS b FROM edges JOIN mem p ON p.label = lo JOIN mem q ON q.label = hi WHERE p.working <> q.working),
  nb AS (SELECT working FROM nr UNION SELECT b FROM we JOIN nr ON a = working UNION SELECT a FROM we JOIN nr ON b = working),
  st AS (SELECT DISTINCT label FROM vox ANTI JOIN fv USING (x, y, z) WHERE label <> 0) || SELECT label, CASE WHEN working IN (SELECT working FROM nb) THEN label ELSE min(label) OVER (PARTITION BY working) END AS least FROM st JOIN mem USING (label)""")
def g15_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups around a refinement fall apart, others stay; the new label is left out."""
    vox, w = _merged(spark, d, 7)
    g = grid_of(vox)
    refinement = voxels(spark, d).select(*AXES, F.col("other").alias("label"))
    _, after = working.refine_at(vox, refinement, g, (12, 10, 1), w)
    return _least(after.members.filter(F.col("label") < w.next_free))


@query("g13_groups_after_insertion", "label least", MERGED.format(k=7) + """, lost AS (SELECT DISTINCT label FROM vox WHERE other = 3 AND x < 6 AND label <> 0),
  hit AS (SELECT label FROM lost UNION SELECT hi FROM edges JOIN lost ON lo = label UNION SELECT lo FROM edges JOIN lost ON hi = label), fg AS (SELECT DISTINCT working FROM mem JOIN hit USING (label)),
  st AS (SELECT DISTINCT label FROM vox WHERE label <> 0 AND NOT (other = 3 AND x < 6)) || SELECT label, CASE WHEN working IN (SELECT working FROM fg) THEN label ELSE min(label) OVER (PARTITION BY working) END AS least FROM st JOIN mem USING (label)""")
def g13_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of labels that lost voxels, and of their neighbours, fall apart; the new label is left out."""
    vox = voxels(spark, d)
    store = refresh.create(vox, grid_of(vox), 16)
    w = refresh.graph(store)
    w = working.merge(w, w.edges.filter("edge_id % 7 = 0"))
    return _least(refresh.insert(store, vox.filter("other = 3 and x < 6"), w).members.filter(F.col("label") < w.next_free))


@query("g16_insert_label", "label n", "t AS (SELECT max(label) + 1 AS top FROM vox) || SELECT CASE WHEN other = 3 AND x < 6 THEN top ELSE label END AS label, count(*) AS n FROM vox, t GROUP BY 1")
def g16(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    g = grid_of(vox)
    return statistics.label_counts(working.insert_label(vox, g, vox.filter("other = 3 and x < 6"), working.build(vox, g))[0])


@query("g17_agreeing_edges", "edge_id lo hi", TRUTH.replace("other", "(z // 3)").replace("(z // 3) AS g", "o AS g").replace("SELECT label, (z // 3), count", "SELECT label, z // 3 AS o, count").replace("n DESC, (z // 3)", "n DESC, o") + " || SELECT edge_id, lo, hi FROM edges JOIN gt a ON lo = a.l JOIN gt b ON hi = b.l WHERE a.g = b.g AND a.f > 0.55 AND b.f > 0.55")
def g17(spark: SparkSession, d: str) -> DataFrame:
    vox, sides, _ = _sides(spark, d)
    m = statistics.majority_label(vox.withColumn("third", F.floor(F.col("z") / 3)), "third")
    return working.agreeing_edges(neighbours.two_sided(sides), m, 0.55)


@query("g18_large_groups", "working n", MERGED.format(k=7) + " || SELECT working, count(*) AS n FROM vox JOIN mem USING (label) GROUP BY working HAVING count(*) > 150")
def g18(spark: SparkSession, d: str) -> DataFrame:
    vox, w = _merged(spark, d, 7)
    return working.groups_over(vox, w, 150)


@query("g19_groups_by_overlap", "label majority; fraction", TRUTH + " || SELECT l AS label, g AS majority, f AS fraction FROM gt WHERE f > 0.2 AND g <> 1")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return working.groups_by_overlap(statistics.majority_label(voxels(spark, d), "other"), 1, 0.2)


@query("g20_transfer", "x y z label", "SELECT x, y, z, CASE label WHEN 9 THEN 8 WHEN 4 THEN 9 WHEN 12 THEN 10 ELSE other END AS label FROM vox")
def g20(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return working.transfer(vox.select(*AXES, F.col("other").alias("label")), vox.select(*AXES, "label"), [9, 4, 12])


SMALL = (
    PLAN.format(order="ASC") + ", pl AS (SELECT label AS a, neighbour AS b FROM p WHERE r = 1), pb AS (SELECT a, b FROM pl UNION ALL SELECT b, a FROM pl), nodes AS (SELECT DISTINCT a AS label FROM pb), "
    "walk(root, label) AS (SELECT label, label FROM nodes UNION SELECT w.root, b FROM walk w JOIN pb ON a = w.label), gc AS (SELECT label AS old, min(root) AS root FROM walk GROUP BY label), m AS (SELECT max(label) + 1 AS top FROM vox), f AS (SELECT root, row_number() OVER (ORDER BY root) - 1 + top AS new FROM (SELECT DISTINCT root FROM gc) q, m)"
)


@query("g21_merge_with_neighbours", "x y z label", SMALL + " || SELECT x, y, z, coalesce(new, label) AS label FROM vox LEFT JOIN gc ON label = old LEFT JOIN f USING (root)")
def g21(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return working.merge_small(vox, grid_of(vox), vox.filter("label % 3 = 0").select("label").distinct())[0]


#: Requests for every third label over 40, on a segmentation that differs from the initial volume where ``other`` is 3.
REQUESTS = """sg AS (SELECT x, y, z, CASE WHEN label <> 0 AND other = 3 AND label % 6 = 0 THEN label + 1000 ELSE label END AS label FROM vox),
  fs AS (""" + " UNION ALL ".join(f"SELECT a.label AS la, b.label AS lb, a.x AS x, a.y AS y, a.z AS z, b.x AS x2, b.y AS y2, b.z AS z2 FROM sg a JOIN sg b ON b.x = a.x + {i} AND b.y = a.y + {j} AND b.z = a.z + {k}" for i, j, k in ((1, 0, 0), (0, 1, 0), (0, 0, 1))) + """),
  c AS (SELECT label, count(*) AS n FROM sg WHERE label <> 0 GROUP BY label), rq AS (SELECT label FROM c WHERE label % {k} = 1 AND label < 1000),
  tb AS (SELECT DISTINCT la AS label, lb AS neighbour FROM (SELECT la, lb FROM fs UNION ALL SELECT lb, la FROM fs) q WHERE la <> lb AND la <> 0 AND lb <> 0),
  pn AS (SELECT label, neighbour FROM (SELECT tb.label, neighbour, row_number() OVER (PARTITION BY tb.label ORDER BY c.n, neighbour) AS r FROM tb JOIN c ON c.label = neighbour JOIN rq ON rq.label = tb.label) q WHERE r = 1),
  us AS (SELECT label FROM pn UNION SELECT neighbour FROM pn),
  vx AS (SELECT x + 25 * y + 500 * z AS i, label FROM sg JOIN us USING (label)), ad AS (SELECT x + 25 * y + 500 * z AS a, x2 + 25 * y2 + 500 * z2 AS b FROM fs WHERE la = lb AND la IN (SELECT label FROM us)),
  ab AS (SELECT a, b FROM ad UNION ALL SELECT b, a FROM ad), wk(root, i) AS (SELECT i, i FROM vx UNION SELECT w.root, ab.b FROM wk w JOIN ab ON ab.a = w.i), cp AS (SELECT i, min(root) AS root FROM wk GROUP BY i),
  dc AS (SELECT label, count(DISTINCT root) AS k FROM cp JOIN vx USING (i) GROUP BY label HAVING count(DISTINCT root) > 1),
  ex AS (SELECT us.label FROM us WHERE (SELECT count(*) FROM sg WHERE sg.label = us.label) = (SELECT count(*) FROM sg JOIN vox v USING (x, y, z) WHERE sg.label = us.label AND v.label = us.label) AND (SELECT count(*) FROM sg WHERE sg.label = us.label) = (SELECT count(*) FROM vox v WHERE v.label = us.label)),
  nums AS (SELECT (SELECT count(*) FROM rq) AS selected, (SELECT count(*) FROM pn) AS mergeable, (SELECT count(*) FROM us) AS consumed, (SELECT count(*) FROM dc) AS disconnected, coalesce((SELECT sum(k) FROM dc), 0) AS regions, (SELECT count(*) FROM us) - (SELECT count(*) FROM ex) AS missing)"""


def _requests(spark: SparkSession, d: str, k: int, **options):
    from ..operators.requests import merge_with_neighbours

    vox = voxels(spark, d)
    g = grid_of(vox)
    seg = written(vox.select(*AXES, F.when((F.col("label") != 0) & (F.col("other") == 3) & (F.col("label") % 6 == 0), F.col("label") + 1000).otherwise(F.col("label")).alias("label")), "segmentation")
    asked = seg.filter((F.col("label") % k == 1) & (F.col("label") < 1000)).select("label")
    return merge_with_neighbours(seg, vox.select(*AXES, "label"), g, working.build(vox, g), asked, **options)


_STATUS = "CASE WHEN mergeable = 0 THEN 'nothing to merge' WHEN disconnected > 0 THEN 'needs split' WHEN missing > 0 THEN 'needs insertion' ELSE 'merged' END"


@query("g21_outcome", "selected mergeable skipped consumed disconnected regions insertions;; status", REQUESTS.format(k=5) + f" || SELECT {_STATUS} AS status, selected, mergeable, selected - mergeable AS skipped, consumed, disconnected, regions, CASE WHEN disconnected > 0 THEN 0 ELSE missing END AS insertions FROM nums")
def g21_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d, 5).row()


@query("g21_plan", "label neighbour", REQUESTS.format(k=5) + " || SELECT label, neighbour FROM pn")
def g21_plan(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d, 5).plan


@query("g21_merged_groups", "voxels differ", "SELECT count(*) AS voxels, 0 AS differ FROM vox WHERE label <> 0")
def g21_groups(spark: SparkSession, d: str) -> DataFrame:
    """With splitting and insertion allowed each merged label is exactly one working group."""
    from ..operators.requests import exact_groups

    done = _requests(spark, d, 5, allow_insertion=True, allow_split=True)
    exact = exact_groups(done.segmentation, working.label_volume(done.initial, done.working), done.sets.select(F.col("new").alias("label")))
    return done.segmentation.filter("label <> 0").agg(F.count("*").alias("voxels")).crossJoin(exact.agg((F.lit(done.merged_groups) - F.count("*")).alias("differ")))


@query("u03_merge_sets", "old new", SMALL + " || SELECT old, new FROM gc JOIN f USING (root)")
def u03(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return working.merge_small(vox, grid_of(vox), vox.filter("label % 3 = 0").select("label").distinct())[1]


@query("g22_merge_until", "label n")
def g22(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return statistics.label_counts(working.merge_until(vox, grid_of(vox), 100))


@query("g23_apply_partition", "label working", MERGED.format(k=3) + f""", grp AS (SELECT working AS w FROM mem GROUP BY working ORDER BY count(*) DESC, working LIMIT 1),
  pv AS (SELECT {SCAN} AS i, label, CASE WHEN x >= 12 THEN 1 ELSE 0 END AS part FROM vox JOIN mem USING (label) WHERE working = (SELECT w FROM grp)),
  pa AS (SELECT x + 25 * y + 500 * z AS a, x2 + 25 * y2 + 500 * z2 AS b FROM faces WHERE la = lb AND la <> 0 AND (x >= 12) = (x2 >= 12)), pb AS (SELECT a, b FROM pa UNION ALL SELECT b, a FROM pa),
  pr(root, i) AS (SELECT i, i FROM pv UNION SELECT pr.root, pb.b FROM pr JOIN pb ON pb.a = pr.i), pc AS (SELECT i, min(root) AS c FROM pr GROUP BY i),
  pe AS (SELECT label, part, c, count(*) AS n FROM pv JOIN pc USING (i) GROUP BY label, part, c), po AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, c) AS r FROM pe),
  nf AS (SELECT top + (SELECT count(*) FROM big) AS free FROM m), pf AS (SELECT label, c, row_number() OVER (ORDER BY label, c) - 1 + free AS nw FROM po, nf WHERE r > 1),
  ps AS (SELECT part, sum(n) AS n FROM po GROUP BY part), kp AS (SELECT part FROM ps ORDER BY n DESC, part LIMIT 1),
  ot AS (SELECT part, row_number() OVER (ORDER BY part) - 1 + free + (SELECT count(*) FROM pf) AS g FROM ps, nf WHERE part <> (SELECT part FROM kp))
  || SELECT coalesce(nw, po.label) AS label, coalesce(g, (SELECT w FROM grp)) AS working FROM po LEFT JOIN pf ON pf.label = po.label AND pf.c = po.c LEFT JOIN ot ON ot.part = po.part UNION ALL SELECT label, working FROM mem WHERE working <> (SELECT w FROM grp)""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    vox, w = _merged(spark, d, 3)
    group = w.members.groupBy("working").count().orderBy(F.desc("count"), "working").first()["working"]
    return working.apply_partition(vox, grid_of(vox), w, group, vox.select(*AXES, (F.col("x") >= 12).cast("long").alias("part")))[1].members


# ------------------------------------------------------------ agglomeration


def _rag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions and edges; sums of boundary values to nine places, as sums differ by the order of their terms."""
    vox = voxels(spark, d)
    regions, edges = agglomeration.rag_of(vox, grid_of(vox))
    return regions, edges.withColumns({c: F.round(c, 9) for c in ("total_b", "open_b")})


def _rounded(scored: DataFrame) -> DataFrame:
    """Scores to twelve places: six would meet ties, as boundary values have few."""
    return scored.withColumn("score", F.round("score", 12))


INDEXED = OPEN + f", f AS (SELECT label, min({SCAN}) AS first, count(*) AS n FROM vox WHERE label <> 0 AND mask = 0 GROUP BY label), reg AS (SELECT row_number() OVER (ORDER BY first) - 1 AS id, label, n FROM f), re AS (SELECT least(a.id, b.id) AS r1, greatest(a.id, b.id) AS r2, round(total_b, 9) AS total_b, total_a, round(open_b, 9) AS open_b, open_a, CASE WHEN a.id < b.id THEN a.n ELSE b.n END AS n1, CASE WHEN a.id < b.id THEN b.n ELSE a.n END AS n2 FROM rag JOIN reg a ON a.label = lo JOIN reg b ON b.label = hi)"


@query("r01_pair_keys", "lo hi key", "SELECT lo, hi, lo * 4294967296 + hi AS key FROM (SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM edges) e")
def r01(spark: SparkSession, d: str) -> DataFrame:
    e = neighbours.two_sided(_sides(spark, d)[1]).withColumn("key", agglomeration.pair_key(F.col("hi"), F.col("lo")))
    lo, hi = agglomeration.unpacked(F.col("key"))
    return e.select(lo.alias("lo"), hi.alias("hi"), "key")


for _name, _o, _sql in (
    ("mean", agglomeration.Options(tau=0.3), "(0.3::DOUBLE * total_a - total_b) / total_a"),
    ("open_mean", agglomeration.Options(tau=0.3, strategy="open_mean"), "(0.3::DOUBLE * open_a - open_b) / open_a"),
    ("open_fraction", agglomeration.Options(tau=0.3, strategy="open_fraction"), "(0.3::DOUBLE * open_a - open_b) / total_a"),
):

    @query(f"r02_score_{_name}", "r1 r2;; score", INDEXED + f" || SELECT r1, r2, round({_sql}, 12) AS score FROM re")
    def r02(spark: SparkSession, d: str, o=_o) -> DataFrame:
        regions, edges = _rag(spark, d)
        return _rounded(agglomeration.scored_edges(edges, regions, o))


@query("r03_sum_linkage", "r1 r2;; score", INDEXED + " || SELECT r1, r2, round(0.3::DOUBLE * total_a - total_b, 12) AS score FROM re")
def r03(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return _rounded(agglomeration.scored_edges(edges, regions, agglomeration.Options(tau=0.3, linkage="sum")))


@query("r04_size_bias", "r1 r2;; score", INDEXED + " || SELECT r1, r2, round((0.3::DOUBLE * total_a - total_b) / total_a + 0.4::DOUBLE * greatest(CASE WHEN n1 < 80 THEN (80 - n1) / 80.0::DOUBLE ELSE 0 END, CASE WHEN n2 < 80 THEN (80 - n2) / 80.0::DOUBLE ELSE 0 END), 12) AS score FROM re")
def r04(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return _rounded(agglomeration.scored_edges(edges, regions, agglomeration.Options(tau=0.3, bias_size=80, bias_strength=0.4)))


@query("r05_initial_queue", "r1 r2;; score", INDEXED + " || SELECT r1, r2, round((0.3::DOUBLE * total_a - total_b) / total_a, 12) AS score FROM re WHERE (0.3::DOUBLE * total_a - total_b) / total_a > 0")
def r05(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return _rounded(agglomeration.initial_queue(agglomeration.scored_edges(edges, regions, agglomeration.Options(tau=0.3))))


@query("w06_queue_order", "turn edge_id;; score", INDEXED + ", sc AS (SELECT row_number() OVER (ORDER BY r1, r2) AS edge_id, round((0.3::DOUBLE * total_a - total_b) / total_a, 12) AS score FROM re) || SELECT row_number() OVER (ORDER BY score DESC, edge_id) AS turn, edge_id, score FROM sc WHERE score > 0")
def w06(spark: SparkSession, d: str) -> DataFrame:
    """The order in which a queue gives its edges away: score, then lower number; by range partitions, not one task."""
    regions, edges = _rag(spark, d)
    offers = agglomeration.initial_queue(_rounded(agglomeration.scored_edges(agglomeration.numbered_edges(edges), regions, agglomeration.Options(tau=0.3))))
    order = offers.select((-F.col("score")).alias("down"), F.col("edge_id").alias("number"), "score")
    return neighbours.ranked(order, "down", "number").select(F.col("edge_id").alias("turn"), F.col("number").alias("edge_id"), "score")


@query("r06_merge_direction", "r1 r2 kept", INDEXED + ", dg AS (SELECT r, count(*) AS d FROM (SELECT r1 AS r FROM re UNION ALL SELECT r2 FROM re) q GROUP BY r) || SELECT r1, r2, CASE WHEN a.d > b.d THEN r1 WHEN b.d > a.d THEN r2 ELSE least(r1, r2) END AS kept FROM re JOIN dg a ON a.r = r1 JOIN dg b ON b.r = r2")
def r06(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return agglomeration.merge_direction(edges, regions)


@query("r07_contract", "r1 r2; total_b total_a open_b open_a", INDEXED + " || SELECT least(r1 // 3, r2 // 3) AS r1, greatest(r1 // 3, r2 // 3) AS r2, sum(total_b) AS total_b, sum(total_a) AS total_a, sum(open_b) AS open_b, sum(open_a) AS open_a FROM re WHERE r1 // 3 <> r2 // 3 GROUP BY 1, 2")
def r07(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return agglomeration.contract(edges, regions.select("region_id", F.floor(F.col("region_id") / 3).alias("root")))


@query("r08_greedy_merge", "region_id root")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return agglomeration.agglomerate_graph(*_rag(spark, d), agglomeration.Options(tau=0.25))


@query("r09_batched_merge", "region_id root")
def r09(spark: SparkSession, d: str) -> DataFrame:
    return agglomeration.batched_roots(*_rag(spark, d), agglomeration.Options(tau=0.25))


_SETTLED = INDEXED + " || SELECT sum(n) AS voxels, count(*) AS regions, 0 AS positive FROM reg"


def _settled(regions: DataFrame, edges: DataFrame, roots: DataFrame, o: agglomeration.Options) -> DataFrame:
    """One row: voxels and regions covered, and contracted edges whose score is still positive."""
    roots = written(roots.select("region_id", "root"), "roots")
    sizes = regions.join(roots, "region_id").groupBy(F.col("root").alias("region_id")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    left = agglomeration.scored_edges(agglomeration.contract(edges, roots), sizes.select("region_id", "n"), o)
    return sizes.agg(F.sum("n").alias("voxels"), F.sum("k").alias("regions")).crossJoin(left.agg(F.count(F.when(F.col("score") > 1e-9, 1)).alias("positive")))


@query("r08_greedy_settles", "voxels regions positive", _SETTLED)
def r08_settles(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    o = agglomeration.Options(tau=0.25)
    return _settled(regions, edges, agglomeration.agglomerate_graph(regions, edges, o), o)


@query("r09_batches_settle", "voxels regions positive", _SETTLED)
def r09_settles(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    o = agglomeration.Options(tau=0.25)
    return _settled(regions, edges, agglomeration.batched_roots(regions, edges, o), o)


@query("r09_first_batch", "edge_id r1 r2;; score", INDEXED + """, sc AS (SELECT row_number() OVER (ORDER BY r1, r2) AS edge_id, r1, r2, round((0.25::DOUBLE * total_a - total_b) / total_a, 12) AS score FROM re),
  q AS (SELECT row_number() OVER (ORDER BY score DESC, edge_id) AS i, * FROM sc WHERE score > 0),
  pass(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT q.i, CASE WHEN list_contains(taken, r1) OR list_contains(taken, r2) THEN taken ELSE list_concat(taken, [r1, r2]) END FROM pass JOIN q ON q.i = pass.i + 1)
  || SELECT edge_id, r1, r2, score FROM q JOIN pass ON pass.i = q.i - 1 WHERE NOT list_contains(taken, r1) AND NOT list_contains(taken, r2)""")
def r09_first(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    scored = _rounded(agglomeration.scored_edges(agglomeration.numbered_edges(edges), regions, agglomeration.Options(tau=0.25)))
    return agglomeration.non_overlapping(agglomeration.initial_queue(scored), at_once=0)


@query("r10_policy", "bias cleanup preview edges batched", INDEXED + ", o AS (SELECT unnest([0, 80]) AS bias), c AS (SELECT unnest([0, 50]) AS cleanup), p AS (SELECT unnest([0, 1]) AS preview), l AS (SELECT unnest([1, 200000]) AS most) || SELECT bias, cleanup, preview, most AS edges, CASE WHEN bias = 0 AND cleanup = 0 AND preview = 0 AND (SELECT count(*) FROM re) >= most THEN 1 ELSE 0 END AS batched FROM o, c, p, l")
def r10(spark: SparkSession, d: str) -> DataFrame:
    _, edges = _rag(spark, d)
    n, sizes = edges.count(), {(b, c): agglomeration.Options(bias_size=b, bias_strength=0.4 if b else 0.0, cleanup_size=c) for b in (0, 80) for c in (0, 50)}
    rows = [(b, c, int(preview), least, int(agglomeration.goes_in_batches(n, o, preview, least))) for (b, c), o in sizes.items() for preview in (False, True) for least in (1, 200_000)]
    return spark.createDataFrame(rows, "bias int, cleanup int, preview int, edges long, batched int")


@query("r11_cleanup", "region_id root merges cleanups")
def r11(spark: SparkSession, d: str) -> DataFrame:
    return agglomeration.agglomerate_graph(*_rag(spark, d), agglomeration.Options(tau=0.05, cleanup_size=90, protection=1.0))


@query("r12_small_regions", "small eligible", INDEXED + ", t AS (SELECT r1 AS r FROM re UNION SELECT r2 FROM re) || SELECT count(*) AS small, count(r) AS eligible FROM reg LEFT JOIN t ON id = r WHERE n < 90")
def r12(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _rag(spark, d)
    return agglomeration.small_regions(regions, edges, regions.select("region_id", F.col("region_id").alias("root")), 90)


@query("r13_agglomerated_volume", "label n")
def r13(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return statistics.label_counts(agglomeration.agglomerate(vox, grid_of(vox), agglomeration.Options(tau=0.25))[0])


@query(
    "r14_project_clusters", "label cluster",
    f"p AS (SELECT label, CASE WHEN label % 5 = 0 OR mask = 1 THEN 0 ELSE 1 + label % 3 END AS cluster, {SCAN} AS i FROM vox WHERE label <> 0), o AS (SELECT label, max(cluster) FILTER (cluster <> 0) AS c, min(i) AS first FROM p GROUP BY label), t AS (SELECT max(cluster) AS top FROM p), fr AS (SELECT label AS l, row_number() OVER (ORDER BY first) + top AS k FROM o, t WHERE c IS NULL) || SELECT label, coalesce(c, k) AS cluster FROM o LEFT JOIN fr ON label = l",
)
def r14(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    c = F.when((F.col("label") == 0) | (F.col("label") % 5 == 0) | (F.col("mask") == 1), 0).otherwise(1 + F.col("label") % 3)
    return agglomeration.project_clusters(vox.withColumn("cluster", c), "label", "cluster", grid_of(vox))


@query("r15_agglomeration_statistics", "regions edges clusters joined merges cleanups batched batches most small_before small_after eligible")
def r15(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return agglomeration.agglomerate(vox, grid_of(vox), agglomeration.Options(tau=0.25, cleanup_size=90, protection=0.5))[1]


@query("graph_components", "node root", MERGED.format(k=5) + " || SELECT label AS node, root FROM gc WHERE root IN (SELECT root FROM big)")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    e = neighbours.two_sided(_sides(spark, d)[1]).filter("edge_id % 5 = 0")
    return connected(e.select(F.col("lo").cast("long").alias("a"), F.col("hi").cast("long").alias("b")))
