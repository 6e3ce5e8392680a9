"""Requests to merge labels of a segmentation with a neighbour, carried into the working graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from ..lineage import written
from .components import components, split_disconnected
from .graph import connected
from .neighbours import faces, merge_plan, ranked
from .statistics import label_counts
from .working import Working, build, explode_groups, label_volume, merge, working_edges

#: Outcomes of a request.
FAILED, NOTHING, SPLIT_FIRST, INSERT_FIRST, MERGED = "failed", "nothing to merge", "needs split", "needs insertion", "merged"


@dataclass(frozen=True)
class Outcome:
    """``plan``: label, neighbour, exact (both are working groups as they are); ``sets``: old, new of merged labels."""

    status: str
    reason: str
    segmentation: DataFrame
    initial: DataFrame
    working: Working
    plan: DataFrame
    selected: int = 0
    mergeable: int = 0
    skipped: int = 0
    consumed: int = 0
    disconnected: int = 0
    regions: int = 0
    insertions: int = 0
    merged_groups: int = 0
    sets: DataFrame | None = None

    def row(self) -> DataFrame:
        """The outcome as one row."""
        counts = {k: getattr(self, k) for k in ("selected", "mergeable", "skipped", "consumed", "disconnected", "regions", "insertions", "merged_groups")}
        spark = self.segmentation.sparkSession
        return spark.range(1).select(F.lit(self.status).alias("status"), *(F.lit(v).cast("long").alias(k) for k, v in counts.items()))


def exact_groups(segmentation: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """label, working of the labels whose voxels are exactly those of a working group."""
    own = segmentation.join(labels.select("label").distinct(), "label", "left_semi").join(groups.select(*AXES, F.col("label").alias("working")), list(AXES))
    met = own.groupBy("label", "working").agg(F.count("*").alias("both"))
    of_label, of_group = label_counts(segmentation), groups.groupBy(F.col("label").alias("working")).agg(F.count("*").alias("m"))
    return met.filter("working <> 0").join(of_label, "label").join(of_group, "working").filter("both = n and both = m").select("label", "working")


def insert_labels(initial: DataFrame, grid: Grid, voxels: DataFrame, w: Working) -> tuple[DataFrame, Working, DataFrame]:
    """(initial volume, working graph; label -> working): sets of voxels (x, y, z, label) become initial labels.

    New ids follow the order of ``label``.  Groups that lose voxels fall back to their initial
    labels; what vanishes is removed, edges are rebuilt, and each new label is its own group.
    """
    fresh = written(ranked(voxels.select("label").distinct(), "label").select(F.col("label").alias("_l"), (F.col("edge_id") - 1 + w.next_free).alias("working")), "fresh")
    new = voxels.join(fresh, F.col("label") == F.col("_l")).select(*AXES, F.col("working").alias("_new"))
    marked = initial.select(*AXES, F.col("label").cast("long").alias("label")).join(new, list(AXES), "left")
    touched = marked.filter("_new is not null and label <> 0").select("label").distinct()
    out = written(marked.select(*AXES, F.coalesce("_new", "label").alias("label")), "volume")
    exploded = explode_groups(w, touched).members
    rebuilt = build(out, grid)
    members = rebuilt.members.select("label").join(exploded, "label", "left").select("label", F.coalesce("working", "label").alias("working"))
    return out, replace(rebuilt, members=written(members, "members"), next_free=w.next_free + fresh.count()), fresh.select(F.col("_l").alias("label"), "working")


def merge_with_neighbours(segmentation: DataFrame, initial: DataFrame, grid: Grid, w: Working, requested: DataFrame, allow_insertion: bool = False, allow_split: bool = False, largest: bool = False, ignored: Iterable[int] = ()) -> Outcome:
    """Each requested label (label) joins its smallest (or largest) neighbour, if everything allows it.

    In turn: a request for the background, for an ignored or an absent label, and splitting
    without insertion are ``failed``; without requests or neighbours there is ``nothing to
    merge``; a label involved that does not hang together ``needs split`` unless splitting is
    allowed (then its pieces are requested in its place); one that is not exactly a working
    group ``needs insertion`` unless that is allowed (then it becomes one).  Then chains and
    mutual picks become one label each, under fresh ids from the largest label + 1 in the
    order of their least label, and their working groups merge.  Null labels count as none;
    repeated requests as one.
    """
    seg = segmentation.select(*AXES, F.col("label").cast("long").alias("label"))
    base = Outcome(FAILED, "", seg, initial, w, requested.sparkSession.createDataFrame([], "label long, neighbour long, exact boolean"))
    ignored = sorted({0, *ignored})
    active = written(requested.select(F.col("label").cast("long").alias("label")).filter("label is not null").distinct(), "requested")
    selected = active.count()
    base = replace(base, selected=selected)
    if allow_split and not allow_insertion:
        return replace(base, reason="splitting needs insertion")
    if not selected:
        return replace(base, status=NOTHING, reason="no labels are requested")
    if not active.filter(F.col("label").isin(ignored)).isEmpty():
        return replace(base, reason="the background or an ignored label is requested")
    disconnected = regions = 0
    while True:
        counts = written(label_counts(seg.filter(~F.col("label").isin(ignored))), "counts")
        if not active.join(counts, "label", "left_anti").isEmpty():
            return replace(base, reason="a label is not there")
        touching = faces(seg, grid).filter((F.col("label") != F.col("label_2")) & ~F.col("label").isin(ignored) & ~F.col("label_2").isin(ignored))
        pairs = touching.select(F.least("label", "label_2").alias("lo"), F.greatest("label", "label_2").alias("hi")).distinct()
        plan = written(merge_plan(counts, pairs, active, largest).select(F.col("label").cast("long").alias("label"), F.col("neighbour").cast("long").alias("neighbour")), "plan")
        consumed = written(plan.select(F.explode(F.array("label", "neighbour")).alias("label")).distinct(), "consumed")
        selected, mergeable = active.count(), plan.count()
        known = replace(base, selected=selected, mergeable=mergeable, skipped=selected - mergeable, consumed=consumed.count(), disconnected=disconnected, regions=regions, segmentation=seg, plan=plan.withColumn("exact", F.lit(None).cast("boolean")))
        if not mergeable:
            return replace(known, status=NOTHING, reason="no label has a neighbour")
        parts = components(seg.join(consumed, "label", "left_semi"), grid, background=())
        apart = written(parts.groupBy("label").agg(F.count_distinct("component").alias("k")).filter("k > 1"), "apart")
        n, k = (v or 0 for v in apart.agg(F.count("*"), F.sum("k")).first())
        if not n:
            break
        disconnected, regions = disconnected + n, regions + k
        if not allow_split:
            return replace(known, status=SPLIT_FIRST, reason="a label does not hang together", disconnected=disconnected, regions=regions)
        # only the labels that fall apart are split; their pieces take the place of a request
        broken = seg.join(apart.select("label"), "label", "left_semi")
        top = seg.agg(F.max("label")).first()[0]
        pieces = written(split_disconnected(broken, grid, top + 1), "pieces").withColumnRenamed("label", "_new")
        names = seg.join(pieces, list(AXES), "left").select(*AXES, "label", "_new")
        more = names.filter("_new is not null").select("label", "_new").distinct()
        active = written(active.join(more, "label", "left").select(F.coalesce("_new", "label").alias("label")).distinct(), "requested")
        seg = written(names.select(*AXES, F.coalesce("_new", "label").alias("label")), "split")
    groups = written(label_volume(initial, w), "groups")
    exact = written(exact_groups(seg, groups, consumed), "exact")
    missing = written(consumed.join(exact, "label", "left_anti"), "missing")
    insertions = missing.count()
    fit = exact.select(F.col("label").alias("_e"))
    flags = plan.join(fit, F.col("label") == F.col("_e"), "left").join(fit.withColumnRenamed("_e", "_f"), F.col("neighbour") == F.col("_f"), "left").select("label", "neighbour", (F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("exact"))
    known = replace(known, insertions=insertions, plan=written(flags, "flags"))
    if insertions and not allow_insertion:
        return replace(known, status=INSERT_FIRST, reason="a label is no working group")
    of = exact
    if insertions:
        initial, w, inserted = insert_labels(initial, grid, seg.join(missing, "label", "left_semi"), w)
        of = written(exact.unionByName(inserted), "of")
    # the segmentation: sets of labels under fresh ids
    roots = written(connected(plan.select(F.col("label").alias("a"), F.col("neighbour").alias("b"))), "roots")
    first = seg.agg((F.max("label") + 1).cast("long").alias("first"))  # one row
    fresh = ranked(roots.select(F.col("root").alias("r")).distinct(), "r").crossJoin(F.broadcast(first)).select("r", (F.col("edge_id") - 1 + F.col("first")).alias("new"))
    sets = written(roots.join(fresh, F.col("root") == F.col("r")).select(F.col("node").alias("old"), "new"), "sets")
    out = written(seg.join(sets, F.col("label") == F.col("old"), "left").select(*AXES, F.coalesce("new", "label").alias("label")), "merged")
    # the working graph: edges between the groups of each pair
    a, b = of.select("label", F.col("working").alias("wa")), of.select(F.col("label").alias("neighbour"), F.col("working").alias("wb"))
    wanted = plan.join(a, "label").join(b, "neighbour").select(F.least("wa", "wb").alias("w_lo"), F.greatest("wa", "wb").alias("w_hi")).distinct()
    edges = working_edges(w).join(wanted, ["w_lo", "w_hi"]).select(F.explode("edge_ids").alias("edge_id"))
    return replace(known, status=MERGED, segmentation=out, initial=initial, working=merge(w, written(edges, "edges")), merged_groups=sets.select("new").distinct().count(), sets=sets)
