"""The working graph: groups of initial labels, and edits on them.

State is a handful of DataFrames: ``members`` (label, working), ``edges`` (edge_id, lo,
hi) and ``status`` (edge_id, status).  Edits fold into ``members``; the voxel table is
joined only when a label volume is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from ..lineage import written
from .components import components, group_components, split_disconnected
from .graph import connected
from .neighbours import ranked, touching
from .paths import shortest


@dataclass(frozen=True)
class Working:
    members: DataFrame
    edges: DataFrame
    status: DataFrame
    next_free: int

    def written(self) -> Working:
        return replace(self, members=written(self.members, "members"), status=written(self.status, "status"))


def build(vox: DataFrame, grid: Grid, background: int = 0) -> Working:
    """Nodes, edges and the identity grouping of a label volume."""
    labels = vox.filter(F.col("label") != background).select(F.col("label").cast("long").alias("label")).distinct()
    edges = written(touching(vox, grid, [background]), "edges")
    free = (vox.agg(F.max("label").alias("m")).first()["m"] or 0) + 1
    return Working(written(labels.withColumn("working", F.col("label")), "members"), edges, edges.select("edge_id", F.lit(0).alias("status")), free)


def working_edges(w: Working) -> DataFrame:
    """w_lo, w_hi and the ordered initial edges between two groups."""
    m = w.members
    e = w.edges.join(m.select(F.col("label").alias("lo"), F.col("working").alias("a")), "lo").join(m.select(F.col("label").alias("hi"), F.col("working").alias("b")), "hi")
    return e.filter("a <> b").groupBy(F.least("a", "b").alias("w_lo"), F.greatest("a", "b").alias("w_hi")).agg(F.array_sort(F.collect_list("edge_id")).alias("edge_ids"))


def _with_status(w: Working, marked: DataFrame, value: int) -> DataFrame:
    m = marked.select(F.col("edge_id").alias("_e")).distinct()
    return w.status.join(m, F.col("edge_id") == F.col("_e"), "left").select("edge_id", F.when(F.col("_e").isNotNull(), value).otherwise(F.col("status")).alias("status"))


def merge(w: Working, edge_ids: DataFrame) -> Working:
    """Merge the groups at the ends of all given edges at once.

    A group that changes gets a fresh id, in the order of the least old id in it; groups
    that no edge joins to another keep theirs.  All given edges get status 2.
    """
    m = w.members
    e = w.edges.join(edge_ids.select("edge_id").distinct(), "edge_id")
    links = e.join(m.select(F.col("label").alias("lo"), F.col("working").alias("a")), "lo").join(m.select(F.col("label").alias("hi"), F.col("working").alias("b")), "hi").select("a", "b")
    roots = connected(links)
    fresh = ranked(roots.select(F.col("root").alias("r")).distinct(), "r").select("r", (F.col("edge_id") - 1 + w.next_free).alias("fresh"))
    names = written(roots.join(fresh, F.col("root") == F.col("r")).select(F.col("node").alias("_w"), "fresh"), "names")
    members = m.join(names, F.col("working") == F.col("_w"), "left").select("label", F.coalesce("fresh", "working").alias("working"))
    used = names.agg(F.count_distinct("fresh").alias("n")).first()["n"]
    return replace(w, members=members, status=_with_status(w, edge_ids, 2), next_free=w.next_free + used).written()


def resplit(w: Working, edges: DataFrame, where: DataFrame) -> Working:
    """Components of the groups in ``where`` (working) over ``edges``; each gets a fresh id."""
    touched = w.members.join(where.select("working").distinct(), "working", "left_semi")
    rest = w.members.join(where.select("working").distinct(), "working", "left_anti")
    parts = group_components(touched.select("label", "working"), edges)
    fresh = ranked(parts.select("root").distinct(), "root").select("root", (F.col("edge_id") - 1 + w.next_free).alias("fresh"))
    fresh = written(fresh, "fresh")
    named = parts.join(fresh, "root").select("label", F.col("fresh").alias("working"))
    return replace(w, members=rest.select("label", "working").unionByName(named), next_free=w.next_free + fresh.count())


def explode_groups(w: Working, labels: DataFrame) -> Working:
    """Groups that hold one of the labels fall back to their initial labels; their edges' status is 0."""
    hit = w.members.join(labels.select("label").distinct(), "label", "left_semi").select(F.col("working").alias("_w")).distinct()
    m = w.members.join(hit, F.col("working") == F.col("_w"), "left")
    inside = m.filter("_w is not null").select("label")
    near = w.edges.join(inside, F.col("lo") == F.col("label"), "left_semi").select("edge_id").unionByName(w.edges.join(inside, F.col("hi") == F.col("label"), "left_semi").select("edge_id"))
    members = m.select("label", F.when(F.col("_w").isNotNull(), F.col("label")).otherwise(F.col("working")).alias("working"))
    return replace(w, members=members, status=_with_status(w, near, 0))


def cut_out(w: Working, label: int) -> Working:
    """One initial label leaves its group; what remains is split where it hangs together no more."""
    group = w.members.filter(F.col("label") == label).select("working")
    alone = w.next_free
    members = w.members.withColumn("working", F.when(F.col("label") == label, F.lit(alone).cast("long")).otherwise(F.col("working")))
    return resplit(replace(w, members=members, next_free=alone + 1).written(), w.edges, group)


def remove_node(w: Working, label: int) -> Working:
    gone = w.edges.filter((F.col("lo") == label) | (F.col("hi") == label)).select("edge_id")
    return replace(w, members=w.members.filter(F.col("label") != label), edges=w.edges.join(gone, "edge_id", "left_anti"), status=w.status.join(gone, "edge_id", "left_anti"))


def label_volume(vox: DataFrame, w: Working) -> DataFrame:
    """x, y, z, label: the working label of each voxel (background where there is none)."""
    m = w.members.select(F.col("label").alias("_l"), "working")
    return vox.select(*AXES, "label").join(m, F.col("label") == F.col("_l"), "left").select(*AXES, F.coalesce("working", F.lit(0).cast("long")).alias("label"))


def _apart(a: str, b: str) -> Column:
    """Distance of two centres (structs x, y, z)."""
    return F.sqrt(sum((F.pow(F.col(f"{a}.{k}") - F.col(f"{b}.{k}"), F.lit(2)) for k in AXES), F.lit(0.0)))


def cut_lengths(w: Working, edge_id: int, centres: DataFrame, edge_centres: DataFrame) -> DataFrame:
    """label, lower, upper of the members of a group: lengths of the shortest paths from the ends of an edge inside it.

    Paths run over edges inside the group, without the cut one, and are as long as centres of
    mass lie apart; a path starts one unit from the edge's centre toward its end.  Null where
    none leads; no rows if the ends are in different groups.
    """
    cut = w.edges.filter(F.col("edge_id") == edge_id).select("lo", "hi")  # one row
    m = w.members.select("label", "working")
    ends = cut.join(m.select(F.col("label").alias("lo"), F.col("working").alias("wl")), "lo").join(m.select(F.col("label").alias("hi"), F.col("working").alias("wh")), "hi").filter("wl = wh")
    group = written(m.join(F.broadcast(ends.select("lo", "hi", "wl")), F.col("working") == F.col("wl")).select("label", "lo", "hi"), "group")
    at = centres.select("label", F.struct(*(F.col(f"c{k}").cast("double").alias(k) for k in AXES)).alias("at"))
    inner = w.edges.filter(F.col("edge_id") != edge_id).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    for k in "ab":
        inner = inner.join(group.select(F.col("label").alias(k)), k, "left_semi").join(at.select(F.col("label").alias(k), F.col("at").alias(f"at_{k}")), k)
    ways = inner.select("a", "b", _apart("at_a", "at_b").alias("weight"))
    middle = edge_centres.filter(F.col("edge_id") == edge_id).select(F.struct(*(F.col(f"c{k}").cast("double").alias(k) for k in AXES)).alias("middle"))
    both = group.filter("label = lo or label = hi").select("label", (F.col("label") == F.col("lo")).alias("source")).join(at, "label").crossJoin(F.broadcast(middle))
    far = both.withColumn("d", _apart("middle", "at"))
    begin = far.withColumn("start", F.when(F.col("d") == 0, F.col("middle")).otherwise(F.struct(*((F.col(f"middle.{k}") + (F.col(f"at.{k}") - F.col(f"middle.{k}")) / F.col("d")).alias(k) for k in AXES))))
    found = shortest(ways, begin.select(F.col("label").alias("node"), "source", _apart("start", "at").alias("dist")))
    lengths = found.groupBy("node").agg(F.min(F.when(F.col("source"), F.col("dist"))).alias("lower"), F.min(F.when(~F.col("source"), F.col("dist"))).alias("upper"))
    return group.join(lengths, F.col("label") == F.col("node"), "left").select("label", "lower", "upper", "lo", "hi")


def split_group(w: Working, sides: DataFrame, cut: DataFrame | None = None) -> Working:
    """Members are parted by ``sides`` (label, side: 0 or 1), then split where parts do not hang together.

    ``cut``: edges (edge_id) that join nothing.
    """
    a = w.next_free
    moved = sides.select(F.col("label").alias("_l"), (F.col("side") + a).cast("long").alias("_s"))
    members = w.members.join(moved, F.col("label") == F.col("_l"), "left").select("label", F.coalesce("_s", "working").alias("working"))
    both = w.members.sparkSession.range(a, a + 2).select(F.col("id").alias("working"))
    edges = w.edges if cut is None else w.edges.join(cut.select("edge_id"), "edge_id", "left_anti")
    return resplit(replace(w, members=members, next_free=a + 2).written(), edges, both)


def unmerge(w: Working, edge_id: int, centres: DataFrame, edge_centres: DataFrame) -> Working:
    """Cut a group in two at an edge (status -2).

    Every member goes to the end of the edge to which its path is shorter (see
    ``cut_lengths``), ties and what no path reaches to the upper end; then both halves are
    split where they do not hang together.  ``centres``: label, cx, cy, cz; ``edge_centres``:
    edge_id, cx, cy, cz.
    """
    cut = w.edges.filter(F.col("edge_id") == edge_id).select("edge_id")
    marked = replace(w, status=_with_status(w, cut, -2))
    lengths = written(cut_lengths(w, edge_id, centres, edge_centres), "sides")
    if lengths.isEmpty():
        return marked
    nearer = F.coalesce(F.col("lower") < F.col("upper"), F.col("lower").isNotNull())
    lower = (F.col("label") == F.col("lo")) | ((F.col("label") != F.col("hi")) & nearer)
    return split_group(marked, lengths.select("label", F.when(lower, 0).otherwise(1).alias("side")), cut)


def split_and_rebuild(vox: DataFrame, grid: Grid, w: Working, connectivity: int = 6, ignored: Iterable[int] = (0,)) -> tuple[DataFrame, Working]:
    """(initial volume, working graph) after labels that fall apart are split; groups are kept.

    The largest piece of a label keeps it, others get fresh labels, and all stay in the
    label's group.  Groups that do not hang together then fall into parts: the one with most
    voxels keeps the group's id (ties: least label), others get fresh ids in the order of
    (group, size, label).  Edges inside groups have status 2, others 0.  Where nothing falls
    apart the graph stays as it is.
    """
    old = vox.select(*AXES, F.col("label").cast("long").alias("label"))
    out = written(split_disconnected(old, grid, w.next_free, connectivity, ignored), "volume")
    names = written(old.withColumnRenamed("label", "_old").join(out, list(AXES)).filter("_old <> 0").select("_old", "label").distinct(), "names")
    if names.filter("_old <> label").isEmpty():
        return out, w
    free = max(w.next_free, (out.agg(F.max("label")).first()[0] or 0) + 1)
    kept = names.join(w.members.select(F.col("label").alias("_old"), "working"), "_old", "left").select("label", F.coalesce("working", "label").alias("working"))
    grouped = replace(build(out, grid), members=written(kept, "members"), next_free=free)
    # a label hangs together, so it lies in one part of its group
    parts = components(out.join(kept.withColumnRenamed("label", "_l"), F.col("label") == F.col("_l")).select(*AXES, "label", F.col("working").alias("group")), grid, connectivity, (), ("group",))
    at = written(parts.join(out, list(AXES)).groupBy("group", "component", "label").agg(F.count("*").alias("n")), "parts")
    sizes = at.groupBy("group", "component").agg(F.sum("n").alias("n"), F.min("label").alias("least"))
    order = sizes.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "least")))
    fresh = ranked(order.filter("r > 1").select("group", "r", "component"), "group", "r").select(F.col("component").alias("_c"), (F.col("edge_id") - 1 + free).alias("fresh"))
    fresh = written(fresh, "fresh")
    members = written(at.join(fresh, F.col("component") == F.col("_c"), "left").select("label", F.coalesce("fresh", "group").alias("working")), "members")
    m = members.select(F.col("label").alias("lo"), F.col("working").alias("a"))
    inside = grouped.edges.join(m, "lo").join(m.select(F.col("lo").alias("hi"), F.col("a").alias("b")), "hi").filter("a = b").select("edge_id")
    return out, replace(grouped, members=members, next_free=free + fresh.count(), status=written(_with_status(grouped, inside, 2), "status"))


def agreeing_edges(edges: DataFrame, majority: DataFrame, least: float = 0.75) -> DataFrame:
    """Edges whose ends have the same majority label, each by more than ``least``."""
    m = majority.filter(F.col("fraction") > least)
    lo = m.select(F.col("label").alias("lo"), F.col("majority").alias("ml"))
    hi = m.select(F.col("label").alias("hi"), F.col("majority").alias("mh"))
    return edges.join(lo, "lo").join(hi, "hi").filter("ml = mh").select("edge_id", "lo", "hi")


def groups_over(vox: DataFrame, w: Working, more_than: int = 50_000) -> DataFrame:
    """working, n of groups with more than that many voxels."""
    return label_volume(vox, w).filter("label <> 0").groupBy(F.col("label").alias("working")).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def groups_by_overlap(majority: DataFrame, background: int, least: float = 0.7, legacy: bool = False) -> DataFrame:
    """Groups that mostly lie in one other label; ``legacy`` compares the label instead of the share."""
    test = F.col("majority") >= 1 if legacy else F.col("fraction") > least
    return majority.filter(test & (F.col("majority") != background))


def transfer(segmentation: DataFrame, groups: DataFrame, requested: list[int], ignored: Iterable[int] = (0,)) -> DataFrame:
    """x, y, z, label: the requested groups copied into a segmentation under fresh ids.

    ``groups``: x, y, z, label (working).  Ids start at the largest label + 1 in the order
    of request.  Nothing is copied if a request repeats, is ignored or does not exist.
    """
    spark, out = segmentation.sparkSession, segmentation.select(*AXES, F.col("label").cast("long").alias("label"))
    bad = len(set(requested)) != len(requested) or set(requested) & set(ignored)
    if bad or not requested:
        return out
    there = groups.filter(F.col("label").isin(requested)).select("label").distinct().count()
    if there != len(requested):
        return out
    order = spark.createDataFrame([(int(r), k) for k, r in enumerate(requested)], "_g long, _k long")
    first = segmentation.agg((F.max("label") + 1).cast("long").alias("_first"))
    moved = groups.join(F.broadcast(order), F.col("label") == F.col("_g")).crossJoin(F.broadcast(first)).select(*AXES, (F.col("_first") + F.col("_k")).alias("_new"))
    return out.join(moved, list(AXES), "left").select(*AXES, F.coalesce("_new", "label").alias("label"))


def merge_small(vox: DataFrame, grid: Grid, selected: DataFrame, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(x, y, z, label; merged sets old -> new): each selected label joins its chosen neighbour.

    Chains and mutual picks become one set; a set gets a fresh id from the largest label
    + 1, in the order of its least label.  Isolated labels stay.
    """
    from .neighbours import faces, merge_plan
    from .statistics import label_counts

    counts = label_counts(vox.filter("label <> 0"))
    touching = faces(vox, grid).filter("label <> label_2 and label <> 0 and label_2 <> 0")
    pairs = touching.select(F.least("label", "label_2").alias("lo"), F.greatest("label", "label_2").alias("hi")).distinct()
    plan = merge_plan(counts, pairs, selected.filter("label <> 0"), largest)
    roots = connected(plan.select(F.col("label").cast("long").alias("a"), F.col("neighbour").cast("long").alias("b")))
    first = vox.agg((F.max("label") + 1).cast("long").alias("first"))
    fresh = ranked(roots.select(F.col("root").alias("r")).distinct(), "r").crossJoin(F.broadcast(first)).select("r", (F.col("edge_id") - 1 + F.col("first")).alias("new"))
    sets = written(roots.join(fresh, F.col("root") == F.col("r")).select(F.col("node").alias("old"), "new"), "sets")
    out = vox.select(*AXES, "label").join(sets, F.col("label") == F.col("old"), "left").select(*AXES, F.coalesce("new", F.col("label").cast("long")).alias("label"))
    return out, sets


def merge_until(vox: DataFrame, grid: Grid, least: int) -> DataFrame:
    """Repeat ``merge_small`` until no label with a neighbour has fewer than ``least`` voxels.

    Every round that merges leaves fewer small labels, so it ends by itself.
    """
    from .statistics import labels_below

    vox, before = vox.select(*AXES, "label"), None
    while True:
        small = written(labels_below(vox, least, [0]), "small")
        n = small.count()
        if not n or n == before:
            return vox
        before = n
        vox = written(merge_small(vox, grid, small)[0], "merged")


def apply_partition(vox: DataFrame, grid: Grid, w: Working, group: int, parts: DataFrame) -> tuple[DataFrame, Working]:
    """Split the initial labels of a group by a voxel partition (x, y, z, part) and regroup.

    Pieces are face components of (label, part).  The largest piece of a label keeps it
    (ties: least scan index); others get fresh labels.  The part with most voxels keeps
    the group's id (ties: lower part), others get fresh ids.
    """
    inside = vox.select(*AXES, F.col("label").cast("long").alias("label")).join(w.members.filter(F.col("working") == group).select("label"), "label", "left_semi")
    keyed = inside.join(parts.select(*AXES, "part"), list(AXES))
    pieces = written(components(keyed, grid, key=("label", "part")), "pieces")
    each = pieces.groupBy("label", "part", "component").agg(F.count("*").alias("n"))
    order = each.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "component")))
    start = w.next_free
    fresh = ranked(order.filter("r > 1").select("label", "component"), "label", "component").select("component", (F.col("edge_id") - 1 + start).alias("fresh"))
    names = written(order.join(fresh, "component", "left").select("component", "part", "n", F.coalesce("fresh", "label").alias("new")), "names")
    used = names.filter(F.col("new") >= start).count()
    sizes = names.groupBy("part").agg(F.sum("n").alias("n"))
    kept = sizes.agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).first()["m"]
    keep = -kept["p"]
    other = ranked(sizes.filter(F.col("part") != keep).select("part"), "part").select("part", (F.col("edge_id") - 1 + start + used).alias("g"))
    grouped = names.join(other, "part", "left").select(F.col("new").alias("label"), F.coalesce("g", F.lit(group).cast("long")).alias("working"))
    members = w.members.filter(F.col("working") != group).unionByName(grouped)
    moved = pieces.join(names.select("component", "new"), "component").select(*AXES, "new")
    out = written(vox.select(*AXES, F.col("label").cast("long").alias("label")).join(moved, list(AXES), "left").select(*AXES, F.coalesce("new", "label").alias("label")), "volume")
    rebuilt = build(out, grid)
    return out, replace(rebuilt, members=written(members, "members"), next_free=start + used + other.count())


def insert_label(vox: DataFrame, grid: Grid, voxels: DataFrame, w: Working, also: DataFrame | None = None) -> tuple[DataFrame, Working]:
    """Write a set of voxels (x, y, z) into the initial volume as a new label.

    Groups that lose voxels, and those of the labels in ``also``, fall back to their initial
    labels; nodes that vanish are removed, edges rebuilt, and the new label is a group of its own.
    """
    new = w.next_free
    at = voxels.select(*AXES).distinct().withColumn("_in", F.lit(True))
    marked = vox.select(*AXES, F.col("label").cast("long").alias("label")).join(at, list(AXES), "left")
    touched = marked.filter("_in and label <> 0").select("label").distinct()
    if also is not None:
        touched = touched.unionByName(also.select("label")).distinct()
    out = written(marked.select(*AXES, F.when(F.col("_in"), F.lit(new).cast("long")).otherwise(F.col("label")).alias("label")), "volume")
    exploded = explode_groups(w, touched).members
    rebuilt = build(out, grid)
    members = rebuilt.members.select("label").join(exploded, "label", "left").select("label", F.coalesce("working", "label").alias("working"))
    return out, replace(rebuilt, members=written(members, "members"), next_free=new + 1)


def groups_near(vox: DataFrame, w: Working, voxels: DataFrame, reach: int = 2) -> DataFrame:
    """label: members of the groups in the bounding box of ``voxels``, ``reach`` wider, and of their neighbours."""
    box = voxels.agg(*(f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)))  # one row
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"min{a}") - reach, F.col(f"max{a}") + reach)
    near = written(label_volume(vox.join(F.broadcast(box), inside).select(*AXES, "label"), w).filter("label <> 0").select(F.col("label").alias("working")).distinct(), "near")
    e = working_edges(w).select("w_lo", "w_hi")
    beside = e.join(near, F.col("w_lo") == F.col("working")).select(F.col("w_hi").alias("working")).unionByName(e.join(near, F.col("w_hi") == F.col("working")).select(F.col("w_lo").alias("working")))
    return w.members.join(near.unionByName(beside).distinct(), "working", "left_semi").select("label")


def refine_at(vox: DataFrame, refinement: DataFrame, grid: Grid, at: tuple[int, int, int], w: Working, roi: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None) -> tuple[DataFrame, Working]:
    """Insert the refinement's component at a point; background there, or a point out of ``roi``, changes nothing.

    The groups in its bounding box, two voxels wider, and their neighbours fall back to their
    initial labels.  ``roi``: first and last voxel of the region that the refinement covers.
    """
    from .components import flood

    x, y, z = at
    if roi is not None and not all(lo <= c <= hi for lo, c, hi in zip(roi[0], at, roi[1], strict=True)):
        return vox, w
    hit = refinement.filter((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).first()
    if hit is None or hit["label"] == 0:
        return vox, w
    part = written(flood(refinement, grid, at), "refinement")
    return insert_label(vox, grid, part, w, groups_near(vox, w, part))
