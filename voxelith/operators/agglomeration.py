"""Merging of adjacent regions by boundary evidence.

The region graph is small next to the voxels: voxels are aggregated in Spark, and the
strictly ordered greedy merge runs once per connected component of the whole graph, as
components never influence each other.
"""

from __future__ import annotations

import heapq
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from ..lineage import discard, written
from .graph import connected
from .neighbours import ranked, region_adjacency, region_index

STRATEGIES = ("mean", "open_mean", "open_fraction")
#: Edges of a graph from which the strict order begins with rounds: what one task may hold.
GREEDY_EDGES = 500_000
#: Edges of a graph from which merging goes in batches; fewer go through them in one task.
BATCH_EDGES = 200_000


@dataclass(frozen=True)
class Options:
    """How edges are scored and small regions are treated.

    strategy: evidence (``mean`` over all faces, ``open_mean`` over open ones,
    ``open_fraction``: open signed sum over the total area); linkage: ``average`` or
    ``sum``; bias: up to ``bias_strength`` is added for regions under ``bias_size``;
    cleanup: afterwards regions under ``cleanup_size`` join their best neighbour whose
    score is over -``protection``.
    """

    tau: float = 0.5
    strategy: str = "mean"
    linkage: str = "average"
    bias_size: int = 0
    bias_strength: float = 0.0
    cleanup_size: int = 0
    protection: float = 0.0

    def __post_init__(self):
        if self.strategy not in STRATEGIES or self.linkage not in ("average", "sum"):
            raise ValueError("unknown strategy or linkage")


def pair_key(a: Column, b: Column) -> Column:
    """Both ids of an edge in one long: the smaller one in the upper half."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long"))


def unpacked(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def score_columns(o: Options, n1: Column, n2: Column) -> Column:
    """Score of an edge with total_b, total_a, open_b, open_a."""
    tb, ta, ob, oa = (F.col(c) for c in ("total_b", "total_a", "open_b", "open_a"))
    signed, area = (o.tau * ta - tb, ta) if o.strategy == "mean" else (o.tau * oa - ob, oa)
    per = ta if o.strategy == "open_fraction" else area
    base = F.when((per <= 0) | (area <= 0), 0.0).otherwise(signed / per if o.linkage == "average" else signed)
    if o.bias_size <= 0 or o.bias_strength == 0:
        return base

    def small(n: Column) -> Column:
        return F.when(n < o.bias_size, (o.bias_size - n) / F.lit(float(o.bias_size))).otherwise(0.0)

    bias = o.bias_strength * F.greatest(small(n1), small(n2))
    return F.when((per <= 0) | (area <= 0), 0.0).otherwise(base + (bias * area if o.linkage == "sum" else bias))


def scored_edges(edges: DataFrame, regions: DataFrame, o: Options) -> DataFrame:
    """edges (r1, r2, statistics) with their score; regions: region_id, n."""
    a = regions.select(F.col("region_id").alias("r1"), F.col("n").alias("n1"))
    b = regions.select(F.col("region_id").alias("r2"), F.col("n").alias("n2"))
    return edges.join(a, "r1").join(b, "r2").withColumn("score", score_columns(o, F.col("n1"), F.col("n2")))


def initial_queue(scored: DataFrame) -> DataFrame:
    return scored.filter("score > 0")


def merge_direction(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """r1, r2, kept: the region with more neighbours stays; ties: smaller id (equal ranks)."""
    degree = edges.select(F.explode(F.array("r1", "r2")).alias("region_id")).groupBy("region_id").agg(F.count("*").alias("d"))
    d1, d2 = degree.select(F.col("region_id").alias("r1"), F.col("d").alias("d1")), degree.select(F.col("region_id").alias("r2"), F.col("d").alias("d2"))
    kept = F.when(F.col("d1") > F.col("d2"), F.col("r1")).when(F.col("d2") > F.col("d1"), F.col("r2")).otherwise(F.least("r1", "r2"))
    return edges.join(d1, "r1").join(d2, "r2").select("r1", "r2", kept.alias("kept"))


def contract(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between merged regions: ``roots`` maps region_id to root; statistics add up."""
    a = roots.select(F.col("region_id").alias("r1"), F.col("root").alias("a"))
    b = roots.select(F.col("region_id").alias("r2"), F.col("root").alias("b"))
    m = edges.join(a, "r1", "left").join(b, "r2", "left").select(F.coalesce("a", "r1").alias("a"), F.coalesce("b", "r2").alias("b"), "total_b", "total_a", "open_b", "open_a")
    return m.filter("a <> b").groupBy(F.least("a", "b").alias("r1"), F.greatest("a", "b").alias("r2")).agg(*(F.sum(c).alias(c) for c in ("total_b", "total_a", "open_b", "open_a")))


class Graph:
    """Regions and edges of one component, merged in place."""

    def __init__(self, sizes: dict[int, int], edges: list[tuple], o: Options, numbers: list[int] | None = None, ranks: dict[int, int] | None = None):
        """``edges``: (a, b, statistics); they are numbered in ascending order unless ``numbers`` are given."""
        self.o, self.n, self.parent = o, dict(sizes), {r: r for r in sizes}
        self.rank = dict.fromkeys(sizes, 0) | (ranks or {})
        self.near: dict[int, dict[int, list]] = {r: {} for r in sizes}
        self.version: dict[int, int] = {}
        for k, (a, b, *stats) in enumerate(sorted(edges)) if numbers is None else zip(numbers, edges, strict=True):
            self.near[a][b] = self.near[b][a] = [k, *stats]
        self.merges = self.cleanups = self.batches = self.most = 0

    def score(self, a: int, b: int, biased: bool = True) -> float:
        o, (_, tb, ta, ob, oa) = self.o, self.near[a][b]
        signed, area = (o.tau * ta - tb, ta) if o.strategy == "mean" else (o.tau * oa - ob, oa)
        per = ta if o.strategy == "open_fraction" else area
        if per <= 0 or area <= 0:
            return 0.0
        base = signed / per if o.linkage == "average" else signed
        if biased and o.bias_size > 0 and o.bias_strength:
            small = max(0.0, *((o.bias_size - n) / o.bias_size for n in (self.n[a], self.n[b])))
            base += o.bias_strength * small * (area if o.linkage == "sum" else 1)
        return base

    def evidence(self, a: int, b: int) -> float:
        return self.near[a][b][2 if self.o.strategy == "mean" else 4]

    def stays(self, a: int, b: int) -> int:
        """Of two neighbours the one with more neighbours, then higher rank, then smaller id."""
        return max((a, b), key=lambda r: (len(self.near[r]), self.rank[r], -r))

    def join(self, a: int, b: int, best: int | None = None) -> int:
        """Merge two neighbours; ``best`` or the one that ``stays`` is kept."""
        best = self.stays(a, b) if best is None else best
        gone = b if best == a else a
        self.rank[best] += self.rank[best] == self.rank[gone]
        self.parent[gone] = best
        self.n[best] += self.n[gone]
        for other, edge in self.near.pop(gone).items():
            del self.near[other][gone]
            if other == best:
                continue
            if other in self.near[best]:
                kept = self.near[best][other]
                kept[1:] = [x + y for x, y in zip(kept[1:], edge[1:], strict=True)]
            else:
                self.near[best][other] = self.near[other][best] = edge
        return best

    def greedy(self) -> None:
        """Merge the best edge (score, then lower edge number) until none is over 0."""
        queue: list[tuple] = []

        def offer(a: int, b: int) -> None:
            k = self.near[a][b][0]
            self.version[k] = self.version.get(k, 0) + 1
            if (s := self.score(a, b)) > 0:
                heapq.heappush(queue, (-s, k, self.version[k], min(a, b), max(a, b)))

        for a in self.near:
            for b in self.near[a]:
                if a < b:
                    offer(a, b)
        while queue:
            _, k, version, a, b = heapq.heappop(queue)
            if a not in self.near or b not in self.near[a] or self.version[k] != version or self.near[a][b][0] != k:
                continue
            kept = self.join(a, b)
            self.merges += 1
            for other in list(self.near[kept]):
                offer(kept, other)

    def batched(self) -> None:
        """Batches of merges that share no region, each chosen in the order of scores before any is done.

        Where a batch is a single merge, the strict order does the rest.
        """
        while True:
            offers = sorted((-s, self.near[a][b][0], a, b) for a in self.near for b in self.near[a] if a < b and (s := self.score(a, b)) > 0)
            taken: set[int] = set()
            chosen = []
            for _, _, a, b in offers:
                if a not in taken and b not in taken:
                    taken |= {a, b}
                    chosen.append((a, b, self.stays(a, b)))
            self.most = max(self.most, len(chosen))
            if len(chosen) < 2:
                return self.greedy()
            for merge in chosen:
                self.join(*merge)
            self.merges += len(chosen)
            self.batches += 1

    def cleanup(self) -> None:
        """The smallest region that may merge joins its best neighbour, again and again.

        Of equally small ones the one with the better score goes first, then the lower id.
        A region's entry in the queue is renewed whenever it or a neighbour has changed.
        """
        o, queue, turn = self.o, [], {}
        if o.cleanup_size <= 0:
            return

        def offer(r: int) -> None:
            turn[r] = turn.get(r, 0) + 1
            if self.n[r] >= o.cleanup_size:
                return
            allowed = [(self.score(r, b, False), self.n[b], -b) for b in self.near[r] if self.evidence(r, b) > 0]
            allowed = [k for k in allowed if k[0] > -o.protection]
            if allowed:
                best = max(allowed)
                heapq.heappush(queue, (self.n[r], -best[0], r, turn[r], -best[2]))

        for r in self.near:
            offer(r)
        while queue:
            _, _, r, at, to = heapq.heappop(queue)
            if r not in self.near or turn[r] != at:
                continue
            kept = self.join(r, to)
            self.cleanups += 1
            for changed in (kept, *self.near[kept]):
                offer(changed)

    def root(self, r: int) -> int:
        while self.parent[r] != r:
            r = self.parent[r]
        return r


#: Statistics of an edge.
STATS = ("total_b", "total_a", "open_b", "open_a")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """edge_id (in the order of r1, r2), r1, r2 and the statistics."""
    if "edge_id" in edges.columns:
        return edges.select("edge_id", "r1", "r2", *STATS)
    return ranked(edges.select(F.col("r1").cast("long").alias("r1"), F.col("r2").cast("long").alias("r2"), *(F.col(c).cast("double").alias(c) for c in STATS)), "r1", "r2").select("edge_id", "r1", "r2", *STATS)


def with_ranks(regions: DataFrame) -> DataFrame:
    rank = F.col("rank") if "rank" in regions.columns else F.lit(0)
    return regions.select(F.col("region_id").cast("long").alias("region_id"), F.col("n").cast("long").alias("n"), rank.cast("long").alias("rank"))


def _kernels(regions: DataFrame, edges: DataFrame, component: DataFrame | None, o: Options, loop: str) -> DataFrame:
    """``loop`` of ``Graph`` and the cleanup for each component (node, root), or for all edges at once."""
    if component is None:
        ends = edges.select(F.explode(F.array("r1", "r2")).alias("_r")).distinct()
        met = regions.join(ends, F.col("region_id") == F.col("_r"), "left")
        of = met.select("region_id", "n", "rank", F.when(F.col("_r").isNull(), F.col("region_id")).otherwise(-1).alias("component"))
    else:
        of = regions.join(component, F.col("region_id") == F.col("node"), "left").select("region_id", "n", "rank", F.coalesce("root", "region_id").alias("component"))
    e = edges.join(of.select(F.col("region_id").alias("r1"), "component"), "r1").select("component", F.col("r1").alias("a"), F.col("r2").alias("b"), "edge_id", *STATS, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("rank"))
    nodes = of.select("component", F.col("region_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("edge_id"), *(F.lit(None).cast("double").alias(c) for c in STATS), "n", "rank")
    options = asdict(o)

    def run(table: pa.Table) -> pa.Table:
        node = table.column("b").is_null()
        a, n, rank = (table.filter(node).column(c).to_pylist() for c in ("a", "n", "rank"))
        links = table.filter(pc.invert(node)).sort_by("edge_id")
        rows = list(zip(*(links.column(c).to_pylist() for c in ("a", "b", *STATS)), strict=True))
        g = Graph(dict(zip(a, n, strict=True)), rows, Options(**options), links.column("edge_id").to_pylist(), dict(zip(a, rank, strict=True)))
        getattr(g, loop)()
        g.cleanup()
        ids = sorted(a)
        return pa.table({"region_id": pa.array(ids, pa.int64()), "root": pa.array([g.root(r) for r in ids], pa.int64()), **{c: pa.array([v] * len(ids), pa.int64()) for c, v in (("merges", g.merges), ("cleanups", g.cleanups), ("batches", g.batches), ("most", g.most))}})

    return nodes.unionByName(e).groupBy("component").applyInArrow(run, "region_id long, root long, merges long, cleanups long, batches long, most long")


def reducible(o: Options) -> bool:
    """Whether a merged region never scores better with a third one than the better of its parts did.

    An average is a weighted mean of the parts' averages (weights: contact areas, all or open
    ones), so it lies between them.  Sums and size biases may grow.
    """
    return o.linkage == "average" and not (o.bias_size > 0 and o.bias_strength)


def _best_pairs(offers: DataFrame) -> DataFrame:
    """Edges (edge_id, r1, r2, score) that are the best of both their ends (score, then lower number)."""
    order = offers.withColumn("k", F.struct("score", (-F.col("edge_id")).alias("number")))
    best = order.select(F.explode(F.array("r1", "r2")).alias("r"), "k").groupBy("r").agg(F.max("k").alias("best"))
    return order.join(best.select(F.col("r").alias("r1"), F.col("best").alias("b1")), "r1").join(best.select(F.col("r").alias("r2"), F.col("best").alias("b2")), "r2").filter("k = b1 and k = b2").select("edge_id", "r1", "r2", "score")


def non_overlapping(offers: DataFrame, at_once: int = BATCH_EDGES) -> DataFrame:
    """The edges that a pass in descending order of (score, lower number) takes, if it skips those with a taken end.

    An edge that is the best of both its ends is taken by that pass whatever else it takes, and
    then none of the edges at these ends is; so such edges are taken in rounds.  ``at_once``
    edges that are left at most go through the pass itself, in one task.
    """
    left, chosen = written(offers.select("edge_id", "r1", "r2", "score"), "offers"), []
    while (n := left.count()) > at_once:
        pairs = written(_best_pairs(left), "pairs")
        chosen.append(pairs)
        ends = pairs.select(F.explode(F.array("r1", "r2")).alias("_r"))
        left, old = written(left.join(ends, F.col("r1") == F.col("_r"), "left_anti").join(ends, F.col("r2") == F.col("_r"), "left_anti"), "offers"), left
        discard(old)
    if n:

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("score", "descending"), ("edge_id", "ascending")])
            taken: set[int] = set()
            keep = []
            for a, b in zip(table.column("r1").to_pylist(), table.column("r2").to_pylist(), strict=True):
                keep.append(a not in taken and b not in taken)
                if keep[-1]:
                    taken |= {a, b}
            return table.filter(pa.array(keep, pa.bool_())).select(["edge_id", "r1", "r2", "score"])

        chosen.append(left.groupBy(F.lit(0).alias("all")).applyInArrow(run, left.schema))
    out = chosen[0] if chosen else left
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


@dataclass(frozen=True)
class State:
    """Regions (region_id, n, rank), numbered edges and where the first regions went (region_id, root)."""

    regions: DataFrame
    edges: DataFrame
    roots: DataFrame


def merged(state: State, pairs: DataFrame) -> State:
    """All given merges (edge_id, r1, r2, score: no region twice) at once, as if done in the order of scores.

    Directions follow from the graph before.  Of edges that become one the number of that
    between the regions that stay is kept; else the earlier merge decides first.
    """
    degree = state.edges.select(F.explode(F.array("r1", "r2")).alias("region_id")).groupBy("region_id").agg(F.count("*").alias("d"))
    facts = state.regions.join(degree, "region_id").select("region_id", F.struct("d", "rank", (-F.col("region_id")).alias("least")).alias("f"))
    sided = pairs.join(facts.select(F.col("region_id").alias("r1"), F.col("f").alias("f1")), "r1").join(facts.select(F.col("region_id").alias("r2"), F.col("f").alias("f2")), "r2")
    first = F.col("f1") > F.col("f2")
    turn = F.struct((-F.col("score")).alias("score"), "edge_id").alias("turn")
    moves = sided.select(F.when(first, F.col("r2")).otherwise(F.col("r1")).alias("gone"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("kept"), (F.col("f1.rank") == F.col("f2.rank")).cast("long").alias("grows"), turn)
    moves = written(moves, "moves")
    ends = moves.select(F.explode(F.array(F.struct(F.col("gone").alias("r"), "kept", F.lit(1).alias("moved"), "turn"), F.struct(F.col("kept").alias("r"), "kept", F.lit(0).alias("moved"), "turn"))).alias("e")).select("e.*")
    a, b = (ends.select(F.col("r").alias(f"r{k}"), F.col("kept").alias(f"to{k}"), F.col("moved").alias(f"moved{k}"), F.col("turn").alias(f"turn{k}")) for k in (1, 2))
    m = state.edges.join(a, "r1", "left").join(b, "r2", "left")
    m1, m2 = (F.coalesce(f"moved{k}", F.lit(0)) for k in (1, 2))
    later_1 = F.coalesce(F.col("turn1") > F.col("turn2"), F.lit(False))
    order = F.struct(F.when(later_1, m1).otherwise(m2).alias("later"), F.when(later_1, m2).otherwise(m1).alias("earlier"))
    m = m.select(F.coalesce("to1", "r1").alias("a"), F.coalesce("to2", "r2").alias("b"), "edge_id", order.alias("o"), *STATS).filter("a <> b")
    edges = m.groupBy(F.least("a", "b").alias("r1"), F.greatest("a", "b").alias("r2")).agg(F.min_by("edge_id", "o").alias("edge_id"), *(F.sum(c).alias(c) for c in STATS))
    to = moves.select(F.col("gone").alias("_f"), F.col("kept").alias("_t"))
    sizes = state.regions.join(to, F.col("region_id") == F.col("_f"), "left").groupBy(F.coalesce("_t", "region_id").alias("region_id")).agg(F.sum("n").alias("n"), F.max(F.when(F.col("_t").isNull(), F.col("rank"))).alias("rank"))
    grown = moves.select(F.col("kept").alias("_k"), "grows")
    regions = sizes.join(grown, F.col("region_id") == F.col("_k"), "left").select("region_id", "n", (F.col("rank") + F.coalesce("grows", F.lit(0))).alias("rank"))
    roots = state.roots.join(to, F.col("root") == F.col("_f"), "left").select("region_id", F.coalesce("_t", "root").alias("root"))
    return State(written(regions, "regions"), written(edges.select("edge_id", "r1", "r2", *STATS), "rag"), written(roots, "roots"))


def _forget(state: State) -> None:
    for df in (state.regions, state.edges, state.roots):
        discard(df)


def _start(regions: DataFrame, edges: DataFrame) -> State:
    regions = written(with_ranks(regions), "regions")
    return State(regions, written(numbered_edges(edges), "rag"), written(regions.select("region_id", F.col("region_id").alias("root")), "roots"))


def _through(roots: DataFrame, last: DataFrame) -> DataFrame:
    """region_id, root and counts after a last step (region_id, root, counts) on the roots so far."""
    to = last.select(F.col("region_id").alias("_f"), F.col("root").alias("_t"), *COUNTS)
    return roots.join(to, F.col("root") == F.col("_f")).select("region_id", F.col("_t").alias("root"), *COUNTS)


#: What a component's merging counts.
COUNTS = ("merges", "cleanups", "batches", "most")


def _offers(state: State, o: Options) -> DataFrame:
    return initial_queue(scored_edges(state.edges, state.regions.select("region_id", "n"), o)).select("edge_id", "r1", "r2", "score")


def _strict(state: State, o: Options, at_once: int) -> tuple[State, DataFrame]:
    """(state after rounds, what the strict order makes of its regions)."""
    while reducible(o) and state.edges.count() > at_once:
        pairs = written(_best_pairs(_offers(state, o)), "pairs")
        if pairs.isEmpty():
            break
        state, old = merged(state, pairs), state
        _forget(old)
        discard(pairs)
    return state, _by_component(state.regions, state.edges, o)


def _by_component(regions: DataFrame, edges: DataFrame, o: Options) -> DataFrame:
    return _kernels(regions, edges, connected(edges.select(F.col("r1").alias("a"), F.col("r2").alias("b"))), o, "greedy")


def agglomerate_graph(regions: DataFrame, edges: DataFrame, o: Options, at_once: int = GREEDY_EDGES) -> DataFrame:
    """region_id, root, and merges, cleanups, batches, most of its component, in strict order.

    Strictly, the best edge of all merges (score, then lower number), again and again until
    none is over 0.  Components do not influence each other, so each is a group of its own.

    A graph of more than ``at_once`` edges first merges, in rounds, all edges that are the best
    of both their ends, where that comes to the same: let (a, b) be such an edge, with score
    s.  Whatever else merges, into C say, from parts that scored less than s with a: as scores
    are ``reducible``, C scores no better with a than the better part did, so (a, b) stays the
    best edge of both ends until the strict order comes to it, and what a and b have in common
    with others does not depend on when.  By induction both ways lead to the same partition;
    a region's root may be another of its members, and equal scores may go another way where
    an edge without open faces hides a lower number.  Scores that are not reducible (sums,
    size bias) have no such rounds: there a component is one group whatever its size.
    """
    edges = written(numbered_edges(edges), "rag")
    if not reducible(o) or edges.count() <= at_once:
        return _by_component(with_ranks(regions), edges, o)
    rounds, last = _strict(_start(regions, edges), o, at_once)
    return _through(rounds.roots, last)


def goes_in_batches(edges: int, o: Options, preview: bool = False, least: int = BATCH_EDGES) -> bool:
    """Large graphs merge in batches, unless sizes count in scores or afterwards, or it is a preview."""
    return edges >= least and not preview and o.cleanup_size <= 0 and not (o.bias_size > 0 and o.bias_strength)


def batched_roots(regions: DataFrame, edges: DataFrame, o: Options, at_once: int = BATCH_EDGES) -> DataFrame:
    """region_id, root and counts, in batches of merges that share no region.

    A batch takes edges in the order of (score, lower number), skipping those that meet a
    taken region; then all its merges are done and scores taken anew.  Where a batch is one
    merge, the strict order does the rest.  A graph of ``at_once`` edges at most goes through
    the same loop in one task.
    """
    if o.cleanup_size > 0 or (o.bias_size > 0 and o.bias_strength):
        raise ValueError("sizes count only in strict order")
    state, batches, most = _start(regions, edges), 0, 0
    while state.edges.count() > at_once:
        pairs = written(non_overlapping(_offers(state, o), at_once), "batch")
        n = pairs.count()
        most = max(most, n)
        if n < 2:
            state, last = _strict(state, o, at_once)
            break
        state, old = merged(state, pairs), state
        _forget(old)
        discard(pairs)
        batches += 1
    else:
        last = _kernels(state.regions, state.edges, None, o, "batched")
    out = _through(state.roots, last)
    return out.withColumns({"batches": F.col("batches") + batches, "most": F.greatest(F.col("most"), F.lit(most))})


def small_regions(regions: DataFrame, edges: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """One row: final regions under ``least`` voxels, and how many of them have a neighbour."""
    sizes = regions.join(roots.select("region_id", "root"), "region_id").groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") < least)
    left = contract(edges, roots.select("region_id", "root")).select(F.explode(F.array("r1", "r2")).alias("_r")).distinct()
    return sizes.join(left, F.col("root") == F.col("_r"), "left").agg(F.count("*").alias("small"), F.count("_r").alias("eligible"))


def rag_of(vox: DataFrame, grid: Grid, apply_mask: bool = True) -> tuple[DataFrame, DataFrame]:
    """(regions: region_id, label, n; edges: r1, r2, statistics) of a volume."""
    regions = written(region_index(vox, grid), "regions")
    a, b = regions.select(F.col("label").alias("lo"), F.col("region_id").alias("a")), regions.select(F.col("label").alias("hi"), F.col("region_id").alias("b"))
    e = region_adjacency(vox, grid, apply_mask).join(a, "lo").join(b, "hi")
    return regions, written(e.select(F.least("a", "b").alias("r1"), F.greatest("a", "b").alias("r2"), "total_b", "total_a", "open_b", "open_a"), "rag")


def agglomerate(vox: DataFrame, grid: Grid, o: Options | None = None, batched: bool | None = None, preview: bool = False, least: int = BATCH_EDGES) -> tuple[DataFrame, DataFrame]:
    """(x, y, z, label: 1.. in ascending surviving region, inactive 0; one row of statistics).

    Unless ``batched`` says how, the number of edges decides (see ``goes_in_batches``).
    Statistics: regions, edges, clusters, joined (regions that went), merges and cleanups,
    batched (0 or 1), batches, most (merges of a batch), small regions under ``cleanup_size``
    (or else ``bias_size``) before and after, and how many of these could still be cleaned up.
    """
    o = o or Options()
    regions, edges = rag_of(vox, grid)
    many = edges.count()
    batched = goes_in_batches(many, o, preview, least) if batched is None else batched
    roots = written(batched_roots(regions, edges, o) if batched else agglomerate_graph(regions, edges, o), "roots")
    names = ranked(roots.select(F.col("root").alias("r")).distinct(), "r").select("r", F.col("edge_id").alias("cluster"))
    of = regions.join(roots, "region_id").join(names, F.col("root") == F.col("r")).select(F.col("label").alias("_l"), "cluster")
    on = (F.col("label") != 0) & (F.col("mask") == 0)
    out = vox.select(*AXES, F.when(on, F.col("label")).alias("_a")).join(of, F.col("_a") == F.col("_l"), "left").select(*AXES, F.coalesce("cluster", F.lit(0)).cast("long").alias("label"))
    return out, statistics_of(regions, edges, roots, o, batched)


def statistics_of(regions: DataFrame, edges: DataFrame, roots: DataFrame, o: Options, batched: bool) -> DataFrame:
    """One row of counts of a run (see ``agglomerate``)."""
    size = o.cleanup_size or o.bias_size
    sizes = regions.select("region_id", "n").join(roots.select("region_id", "root"), "region_id").groupBy(F.col("root").alias("region_id")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    left = contract(edges, roots.select("region_id", "root"))
    evidence = "total_a" if o.strategy == "mean" else "open_a"
    plain = replace(o, bias_size=0, bias_strength=0.0)
    could = scored_edges(left, sizes.select("region_id", "n"), plain).filter((F.col(evidence) > 0) & (F.col("score") > -o.protection))
    could = could.select(F.explode(F.array(F.struct(F.col("r1").alias("r"), F.col("n1").alias("n")), F.struct(F.col("r2").alias("r"), F.col("n2").alias("n")))).alias("e")).filter(F.col("e.n") < size).agg(F.count_distinct("e.r").alias("eligible"))
    after = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("joined"), F.count_if(F.col("n") < size).alias("small_after"))
    before = regions.agg(F.count("*").alias("regions"), F.count_if(F.col("n") < size).alias("small_before"))
    # a root's component counted its own steps; rounds before it show in what was joined
    cleanups = roots.select("root", "cleanups", "batches", "most").agg(F.coalesce(F.max("batches"), F.lit(0)).alias("batches"), F.coalesce(F.max("most"), F.lit(0)).alias("most"))
    each = connected(edges.select(F.col("r1").cast("long").alias("a"), F.col("r2").cast("long").alias("b")))
    cleaned = each.filter("node = root").select(F.col("node").alias("_n")).join(roots, F.col("region_id") == F.col("_n")).agg(F.coalesce(F.sum("cleanups"), F.lit(0)).alias("cleanups"))
    row = before.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(after).crossJoin(cleanups).crossJoin(cleaned).crossJoin(could)
    return row.select("regions", "edges", "clusters", "joined", (F.col("joined") - F.col("cleanups")).alias("merges"), "cleanups", F.lit(int(batched)).alias("batched"), "batches", "most", "small_before", "small_after", "eligible")


def project_clusters(vox: DataFrame, reference: str, cluster: str, grid: Grid) -> DataFrame:
    """reference label -> cluster; labels without one get fresh ids in the order of their first voxels.

    A label in several clusters is an error.
    """
    of = vox.filter(F.col(reference) != 0).groupBy(reference).agg(F.max(F.when(F.col(cluster) != 0, F.col(cluster))).alias("cluster"), F.count_distinct(F.when(F.col(cluster) != 0, F.col(cluster))).alias("k"), F.min(grid.scan_index()).alias("first"))
    checked = of.withColumn("cluster", F.when(F.col("k") > 1, F.raise_error(F.lit("a reference label lies in several clusters")).cast("long")).otherwise(F.col("cluster")))
    top = vox.agg(F.coalesce(F.max(cluster), F.lit(0)).alias("top"))
    free = ranked(checked.filter("cluster is null").select(reference, "first"), "first").crossJoin(F.broadcast(top)).select(F.col(reference).alias("_r"), (F.col("edge_id") + F.col("top")).alias("fresh"))
    return checked.join(free, F.col(reference) == F.col("_r"), "left").select(F.col(reference).alias("label"), F.coalesce("cluster", "fresh").cast("long").alias("cluster"))
