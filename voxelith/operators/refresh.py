"""A label volume and its region graph kept by block, so that an edit reads and writes only the blocks it reaches.

Two tables, both partitioned by ``block``: the voxels (x, y, z, label) and the parts, which
say what a block adds to the graph: (label, null, n) for its voxels of a label and (label,
neighbour, n, box) for those of them that touch a neighbour, in this block or beside it.  A
voxel is in one block, so the graph is the sum of the parts.

A block is a folder in each table.  Blocks have ``edge`` voxels a side; where there would be
more than FOLDERS of them, they are joined until they hold FOLDER_VOXELS (see ``joined_blocks``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import AXES, Grid, joined_blocks, with_blocks
from ..lineage import discard, shared_path, written
from .neighbours import ranked
from .working import Working, explode_groups, groups_near

_BOX = [f"{f}{a}" for a in AXES for f in ("min", "max")]
_VOXELS = "x int, y int, z int, label long, block long"
_PARTS = "label long, neighbour long, n long, " + ", ".join(f"{c} int" for c in _BOX) + ", block long"
#: Up to so many blocks (8 bytes each) are broadcast, which prunes the folders that a scan opens.
BROADCAST_BLOCKS = 100_000
FOLDERS, FOLDER_VOXELS = 64, 1 << 20


@dataclass(frozen=True)
class Blocks:
    """Where the two tables lie.  ``ignored`` labels have no edges (their voxels are counted)."""

    spark: SparkSession
    path: str
    grid: Grid
    edge: int
    ignored: tuple[int, ...] = (0,)

    def voxels(self) -> DataFrame:
        return self.spark.read.schema(_VOXELS).parquet(f"{self.path}/voxels")

    def parts(self) -> DataFrame:
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/parts")

    @property
    def sizes(self) -> tuple[int, int, int]:
        return joined_blocks(self.grid.dims, (self.edge,) * 3, FOLDERS, FOLDER_VOXELS)

    def number(self, bx: Column, by: Column, bz: Column) -> Column:
        nx, ny = (-(-d // s) for d, s in zip(self.grid.dims[:2], self.sizes[:2], strict=True))
        return bx.cast("long") + by.cast("long") * nx + bz.cast("long") * (nx * ny)


def create(vox: DataFrame, grid: Grid, edge: int = 256, ignored: Iterable[int] = (0,), path: str | None = None) -> Blocks:
    """Write both tables of a volume (x, y, z, label; places without a row belong to no label)."""
    spark = vox.sparkSession
    store = Blocks(spark, path or shared_path(spark, "blocks"), grid, edge, tuple(ignored))
    own = store.number(*(F.floor(F.col(a) / s) for a, s in zip(AXES, store.sizes, strict=True)))
    _replace(vox.select(*(F.col(a).cast("int").alias(a) for a in AXES), F.col("label").cast("long").alias("label"), own.alias("block")), f"{store.path}/voxels")
    _replace(_parts(store, store.voxels()), f"{store.path}/parts")
    return store


def _replace(df: DataFrame, path: str) -> None:
    """Replace the blocks that have rows in ``df``; others stay."""
    df.repartition("block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)


def _within(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of these blocks (a written table, each block once)."""
    listed = blocks.filter("block >= 0")  # a predicate, without which Spark does not prune folders by a join
    return df.join(F.broadcast(listed) if blocks.count() <= BROADCAST_BLOCKS else listed, "block", "left_semi")


def _parts(store: Blocks, vox: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Parts of all blocks, or of those in ``only``, whose voxels and neighbours ``vox`` holds."""
    seen = with_blocks(vox.select(*AXES, "label"), store.grid, store.sizes, 1).withColumn("block", store.number(*(F.col(f"b{a}") for a in AXES)))
    seen = (seen if only is None else _within(seen, only)).select(*AXES, "label", "own", "block").repartition("block")
    beside = []
    for a in AXES:
        w = Window.partitionBy("block", *(b for b in AXES if b != a)).orderBy(a)
        for step, f in ((1, F.lead), (-1, F.lag)):
            name = f"_{a}{step}"
            seen = seen.withColumn(name, f(F.struct(F.col(a).alias("at"), "label")).over(w))
            beside.append(F.when(F.col(f"{name}.at") == F.col(a) + step, F.col(f"{name}.label")))
    skipped = F.col("label").isin(*store.ignored)
    others = F.filter(F.array(*beside), lambda n: n.isNotNull() & (n != F.col("label")) & ~n.isin(*store.ignored) & ~skipped)
    each = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(others))  # null: the voxel itself
    own = seen.filter("own").select("block", "label", *AXES, F.explode(each).alias("neighbour"))
    box = [f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)]
    return own.groupBy("block", "label", "neighbour").agg(F.count("*").alias("n"), *box).select("label", "neighbour", "n", *_BOX, "block")


def _edges(parts: DataFrame) -> DataFrame:
    sides = parts.filter("neighbour is not null")
    box = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _BOX]
    return sides.groupBy(F.least("label", "neighbour").alias("lo"), F.greatest("label", "neighbour").alias("hi")).agg(F.sum("n").alias("voxels"), *box)


def sides(store: Blocks) -> DataFrame:
    """label, neighbour, n: voxels of a label that touch the neighbour."""
    return store.parts().filter("neighbour is not null").groupBy("label", "neighbour").agg(F.sum("n").alias("n"))


def nodes(store: Blocks) -> DataFrame:
    """label, n."""
    return store.parts().filter(F.col("neighbour").isNull() & ~F.col("label").isin(*store.ignored)).groupBy("label").agg(F.sum("n").alias("n"))


def graph(store: Blocks) -> Working:
    """The identity grouping over the stored graph; edges are numbered in the order of (lo, hi), from 1."""
    edges = written(ranked(_edges(store.parts()), "lo", "hi"), "edges")
    members = written(nodes(store).select("label", F.col("label").alias("working")), "members")
    free = (members.agg(F.max("label").alias("m")).first()["m"] or 0) + 1
    return Working(members, edges, edges.select("edge_id", F.lit(0).alias("status")), free)


def _near(store: Blocks, blocks: DataFrame) -> DataFrame:
    """The blocks with the six beside each."""
    n = [-(-d // s) for d, s in zip(store.grid.dims, store.sizes, strict=True)]
    at = {"x": F.col("block") % n[0], "y": F.floor(F.col("block") / n[0]) % n[1], "z": F.floor(F.col("block") / (n[0] * n[1]))}
    seen = [F.col("block")]
    for k, a in enumerate(AXES):
        for step in (-1, 1):
            moved = {b: at[b] + step if b == a else at[b] for b in AXES}
            seen.append(F.when(moved[a].between(0, n[k] - 1), store.number(*moved.values())))
    return blocks.select(F.explode(F.array_compact(F.array(*seen))).alias("block")).distinct()


def refresh(store: Blocks, changes: DataFrame, w: Working, also: DataFrame | None = None) -> Working:
    """Write ``changes`` (x, y, z, label) into the stored volume and carry them into its graph.

    Read are the blocks of the changed voxels and the ones beside them, written those with
    a change (parts also where a changed voxel touches).  Edges of labels that gained or
    lost voxels are summed anew from parts; other edges and their status stay as they are.
    A pair keeps its number, new pairs are numbered on in the order of (lo, hi).  Groups of
    labels that lost voxels, of their neighbours and of the labels in ``also`` fall back to
    their initial labels; labels without voxels vanish, new ones are groups of their own
    (a new label that is the id of a group is an error: use ``next_free`` and above).

    Of several changes of a voxel the greatest label counts; changes with a null, or of a
    voxel that the volume has no row for, do nothing.  New rows and the new graph are whole
    in the shared folder before blocks are replaced, and a block is replaced when all its
    rows are there, so lost executors cost repeated tasks only.  A driver lost between the
    two replacements leaves voxels ahead of parts; ``create`` over ``voxels()`` mends that.
    """
    kept = changes.select(*(F.col(a).cast("int").alias(a) for a in AXES), F.col("label").cast("long").alias("_new")).dropna()
    inside = F.lit(True)
    for a, d in zip(AXES, store.grid.dims, strict=True):
        inside = inside & F.col(a).between(0, d - 1)
    change = written(kept.filter(inside).groupBy(*AXES).agg(F.max("_new").alias("_new")), "changes")
    if change.isEmpty():
        return w if also is None else explode_groups(w, also).written()
    reached = with_blocks(change, store.grid, store.sizes, 1)
    reached = reached.select(store.number(*(F.col(f"b{a}") for a in AXES)).alias("block"), "own")
    reached = written(reached.groupBy("block").agg(F.max("own").alias("own")), "reached")
    affected = reached.select("block")
    around = written(_near(store, affected), "around")
    old = _within(store.voxels(), around).join(change, list(AXES), "left")
    new = written(old.select(*AXES, F.coalesce("_new", "label").alias("label"), F.col("label").alias("_old"), "block"), "new")
    parts = written(_parts(store, new, affected), "parts")
    moved = new.filter("label <> _old")
    lost = written(moved.filter(~F.col("_old").isin(*store.ignored)).select(F.col("_old").alias("label")).distinct(), "lost")
    touched = written(moved.select(F.explode(F.array("_old", "label")).alias("label")).distinct(), "touched")

    replaced = affected.select(F.col("block").alias("_b"))
    rest = store.parts().join(F.broadcast(replaced) if replaced.count() <= BROADCAST_BLOCKS else replaced, F.col("block") == F.col("_b"), "left_anti")
    done = _carried(store, rest.unionByName(parts), w, lost, touched, also)

    _replace(_within(new.select(*AXES, "label", "block"), written(reached.filter("own").select("block"), "own")), f"{store.path}/voxels")
    _replace(parts, f"{store.path}/parts")
    for t in (new, parts, around, reached, change, lost, touched):
        discard(t)
    return done


def _carried(store: Blocks, parts: DataFrame, w: Working, lost: DataFrame, touched: DataFrame, also: DataFrame | None) -> Working:
    """The working graph over the new parts."""
    ends = w.edges.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("label")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("label")))).alias("s")).select("s.*")
    beside = ends.join(lost.select(F.col("label").alias("a")), "a", "left_semi").select("label")
    fallen = lost.unionByName(beside)
    if also is not None:
        fallen = fallen.unionByName(also.select("label"))
    w = explode_groups(w, fallen.distinct()).written()

    hit = touched.select(F.col("label").alias("_t"))

    def at(df: DataFrame, a: str, b: str) -> DataFrame:
        """Whether an end is touched."""
        marks = [hit.select(F.col("_t").alias(f"_{c}")) for c in (a, b)]
        both = df.join(marks[0], F.col(a) == F.col(f"_{a}"), "left").join(marks[1], F.col(b) == F.col(f"_{b}"), "left")
        return both.withColumn("_hit", F.col(f"_{a}").isNotNull() | F.col(f"_{b}").isNotNull()).drop(f"_{a}", f"_{b}")

    known = w.edges.columns
    box = [c for c in _BOX if c in known]
    marked = written(at(w.edges, "lo", "hi"), "marked")
    again = _edges(at(parts.filter("neighbour is not null"), "label", "neighbour").filter("_hit"))
    again = again.join(marked.filter("_hit").select("lo", "hi", "edge_id"), ["lo", "hi"], "left")
    again = written(again.select("edge_id", "lo", "hi", "voxels", *box), "again")
    top = w.edges.agg(F.max("edge_id").alias("m")).first()["m"] or 0
    fresh = ranked(again.filter("edge_id is null").drop("edge_id"), "lo", "hi").withColumn("edge_id", F.col("edge_id") + top)
    edges = marked.filter("not _hit").select(*known).unionByName(again.filter("edge_id is not null").select(*known)).unionByName(fresh.select(*known))
    edges = written(edges, "edges")
    # edges summed anew have status 0
    still = w.status.join(marked.filter("not _hit").select("edge_id"), "edge_id", "left_semi")
    status = edges.select("edge_id").join(still, "edge_id", "left").select("edge_id", F.coalesce("status", F.lit(0)).alias("status"))

    sizes = parts.filter(F.col("neighbour").isNull() & ~F.col("label").isin(*store.ignored)).join(touched, "label", "left_semi").select("label").distinct()
    fresh_labels = sizes.join(w.members, "label", "left_anti")
    if not fresh_labels.join(w.members.select(F.col("working").alias("label")), "label", "left_semi").isEmpty():
        raise ValueError("a new label is the id of a group")
    rest = w.members.join(touched, "label", "left_anti")
    members = rest.select("label", "working").unionByName(sizes.join(w.members, "label", "left").select("label", F.coalesce("working", "label").alias("working")))
    free = max(w.next_free, (sizes.agg(F.max("label").alias("m")).first()["m"] or 0) + 1)
    done = replace(w, members=members, edges=edges, status=status, next_free=free).written()
    for t in (marked, again):
        discard(t)
    return done


def within_box(store: Blocks, voxels: DataFrame, reach: int = 2) -> DataFrame:
    """Stored voxels of the blocks that the bounding box of ``voxels``, ``reach`` wider, meets."""
    box = voxels.agg(*(f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)))
    blocks = box
    for a, d, s in zip(AXES, store.grid.dims, store.sizes, strict=True):
        first = F.greatest(F.floor((F.col(f"min{a}") - reach) / s), F.lit(0))
        last = F.least(F.floor((F.col(f"max{a}") + reach) / s), F.lit((d - 1) // s))
        blocks = blocks.withColumn(f"b{a}", F.explode(F.sequence(first, last)))
    return _within(store.voxels(), written(blocks.select(store.number(*(F.col(f"b{a}") for a in AXES)).alias("block")), "box"))


def insert(store: Blocks, voxels: DataFrame, w: Working, also: DataFrame | None = None) -> Working:
    """The voxels (x, y, z) become a new label (the next free one), a group of its own."""
    new = replace(w, next_free=w.next_free + 1)
    return refresh(store, voxels.select(*AXES, F.lit(w.next_free).cast("long").alias("label")), new, also)


def refine_at(store: Blocks, refinement: DataFrame, at: tuple[int, int, int], w: Working) -> Working:
    """Insert the refinement's component at a point; background there changes nothing.

    The groups in its bounding box, two voxels wider, and their neighbours fall back to
    their initial labels.
    """
    from .components import flood

    x, y, z = at
    hit = refinement.filter((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).first()
    if hit is None or hit["label"] == 0:
        return w
    part = written(flood(refinement, store.grid, at), "refinement")
    near = written(groups_near(within_box(store, part), w, part), "near")
    return insert(store, part, w, near)
