"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a sequence of turns (role, text) with which at least one conversation begins.  Its
key is its depth and two sums of 64-bit hashes of (turn, position), so a conversation's keys
are running sums and no sequence is ever gathered; different sequences meet only if 126 bits
of hashes agree.

The largest child (most members; ties: least conv_id) of a node goes on with its path, the
others are light and begin paths of their own.  A light child has half its parent's members
at most, so the way from the root to any node has at most log2(members) light edges.  Paths
are arrays (in pieces of ``PIECE`` nodes) along which values are summed from the end; from
the paths with most light edges above them to the root's, each round attaches the sums of
light paths to their parents.

Null role or text: empty.  Turns are in the order of turn (null first), role, hash of the text;
repeated rows are turns of their own.  Rows without conv_id take no part.  Other columns are not
read.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed
from .ordered import before, numbered

#: Nodes of a path that are summed as one array.
PIECE = 1024
#: Conversations whose ids are joined as one string before they are hashed.
ENDS = 4096
KEY = ["depth", "k1", "k2"]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), h1, h2 (hashes of role and text), n_bytes (UTF-8 bytes of the text)."""
    role, text = (F.coalesce(rows[c], F.lit("")) for c in ("role", "text"))
    hashed = rows.filter(rows["conv_id"].isNotNull()).select(
        rows["conv_id"].cast("long").alias("conv_id"), rows["turn"], role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")
    )
    return numbered(hashed, ["conv_id"], ["turn", "role", "h1", "row"], "place").select("conv_id", "place", "h1", "h2", "n_bytes")


def grafted(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length; conv_id, depth from 1, h1, h2, n_bytes, last) of rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % group (all if it has
    fewer), then follow its own turns after its first h; h = CRC-32 of c's decimal % most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    # the beginning is no longer than ``most`` turns, and a base has few conversations
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    facts = convs.select("conv_id", "base", "h", "taken", "length")
    start = turns.filter(F.col("place") < most).withColumnRenamed("conv_id", "base").join(facts, "base").filter("place < h")
    start = start.select("conv_id", (F.col("place") + 1).alias("depth"), "h1", "h2", "n_bytes", "length")
    own = turns.join(facts, "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "h1", "h2", "n_bytes", "length")
    rows = start.unionByName(own).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return convs.select("conv_id", "length"), rows


def _folded(total: Column) -> Column:
    return F.pmod(total, F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def steps(rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, p1, p2 (the parent's), n_bytes, last: the nodes on each conversation's way."""
    tagged = materialize(rows.select("conv_id", "depth", "n_bytes", "last", *(F.xxhash64(f"h{k}", "depth").cast("decimal(38,0)").alias(f"s{k}") for k in (1, 2))), "turns")
    run = before(tagged, ["conv_id"], "depth", {"b1": ("s1", "sum"), "b2": ("s2", "sum")})
    zero = F.lit(0).cast("decimal(38,0)")
    own = [_folded(F.coalesce(f"b{k}", zero) + F.col(f"s{k}")).alias(f"k{k}") for k in (1, 2)]
    above = [F.coalesce(_folded(F.col(f"b{k}")), F.lit(0).cast("long")).alias(f"p{k}") for k in (1, 2)]
    return materialize(run.select("conv_id", "depth", *own, *above, "n_bytes", "last"), "steps")


def _ends(steps_: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, k1, k2, ends: SHA-256 of the ids of the conversations that end at a node.

    A digest of a list is taken from its beginning to its end, so the strings of a node meet
    in one task; they stream through it, 4096 conversations' ids a row, and are never held
    together.
    """
    zero = F.lit(0).cast("long")
    done = steps_.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    strings = done.groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            *keys, _, ids = (batch.column(k).to_pylist() for k in range(5))
            for at, text in zip(zip(*keys, strict=True), ids, strict=True):
                if at != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = at, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
        if out:
            yield _rows(out)

    dealt = strings.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.mapInArrow(trimmed(run), "depth long, k1 long, k2 long, ends string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], [*KEY, "ends"])


def suffix_sums(lists: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums from each place to the end of its list; ``ends``: where lists end in ``lists``."""
    through = np.cumsum(lists)
    lengths = np.diff(ends, prepend=0)
    upto = np.append(0, through)[ends]
    return np.repeat(upto, lengths) - through + lists


def _summed(nodes: DataFrame, values: list[str], deep: bool) -> DataFrame:
    """Nodes with each value replaced by its sum from the node to the end of its path (head, away)."""
    head = ["head_depth", "head_k1", "head_k2"]
    rest = [c for c in nodes.columns if c not in values and c not in head and c != "away"]
    entry = F.struct("away", *rest, *values)
    pieces = nodes.groupBy(*head, F.floor(F.col("away") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(entry)).alias("path"))
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(4)
            ends = np.asarray(paths.offsets)[1:] - paths.offsets[0].as_py()
            flat = paths.flatten()
            parts = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            for v in values:
                parts[v] = pa.array(suffix_sums(np.asarray(parts[v]), ends))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(parts.values()), list(parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], batch.schema.names)

    out = pieces.mapInArrow(trimmed(run), schema)
    if deep:  # sums of the pieces behind
        out = materialize(out.withColumn("before", -F.col("piece")), "pieces")
        whole = out.select(*head, "piece", "before", *(F.element_at("path", 1)[v].alias(f"all_{v}") for v in values))
        behind = before(materialize(whole, "wholes"), head, "before", {f"add_{v}": (f"all_{v}", "sum") for v in values}).select(*head, "piece", *(f"add_{v}" for v in values))
        out = out.join(behind, [*head, "piece"])
    plus = [F.col(f"n.{v}") + F.coalesce(f"add_{v}", F.lit(0)) if deep else F.col(f"n.{v}") for v in values]
    return out.select("*", F.explode("path").alias("n")).select(*head, *(f"n.{c}" for c in ["away", *rest]), *(p.alias(v) for p, v in zip(plus, values, strict=True)))


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: conv_id, length; ``rows``: conv_id, depth, h1, h2, n_bytes, last.  Members of a
    node are the conversations that begin with it; ``saved_tokens`` sums (n_convs - 1) *
    bytes of the last text over the node's subtree; ``ends_sha256`` is that of the members
    without further turns, their ids in ascending order with commas between.
    """
    zero = F.lit(0).cast("long")
    way = steps(rows)
    made = way.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")  # one row
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("n_bytes"), zero.alias("p1"), zero.alias("p2"))
    nodes = materialize(made.unionByName(root), "nodes")
    best = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least")))["least"]
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), (-best).alias("heir"))
    nodes = materialize(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "families")
    # one conversation a node is enough to tell the light edges above it
    members = nodes.select("conv_id").distinct()
    facts = nodes.select(*KEY, F.col("conv_id").alias("least"), "n_convs", "n_children", F.col("heir").alias("heir_below"))
    seen = way.select("conv_id", *KEY, "p1", "p2", "n_bytes").join(members, "conv_id").join(facts, KEY)
    # what the node above chose lies one step up the same conversation
    up = seen.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("heir_below").alias("heir"), F.col("least").alias("parent_conv_id"))
    top = nodes.filter("depth = 0").select(F.col("heir").alias("root_heir"), F.col("conv_id").alias("root_conv"))  # one row
    seen = materialize(seen, "seen").join(up, ["conv_id", "depth"], "left").crossJoin(F.broadcast(top))
    first = F.col("depth") == 1
    heir, parent = F.when(first, F.col("root_heir")).otherwise(F.col("heir")), F.when(first, F.col("root_conv")).otherwise(F.col("parent_conv_id"))
    light = F.col("least") != heir
    seen = seen.select("conv_id", *KEY, "p1", "p2", "n_bytes", "least", "n_convs", "n_children", parent.alias("parent_conv_id"), F.when(light, 1).otherwise(0).cast("long").alias("light"), F.when(light, F.struct(*KEY)).alias("head"))
    run = before(materialize(seen, "edges"), ["conv_id"], "depth", {"above": ("light", "sum"), "head_above": ("head", "max")}).filter("conv_id = least")
    start = F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    run = run.withColumns({"level": F.coalesce("above", F.lit(0)) + F.col("light"), "head": F.coalesce("head", "head_above", start)})
    columns = [*KEY, "p1", "p2", "conv_id", "parent_conv_id", "n_bytes", "n_convs", "n_children"]
    none = F.lit(None).cast("long")
    tops = nodes.filter("depth = 0").select(*KEY, "p1", "p2", "conv_id", none.alias("parent_conv_id"), "n_bytes", "n_convs", "n_children", zero.alias("level"), start.alias("head"))
    every = run.select(*columns, "level", "head").unionByName(tops)
    every = every.select(*columns, "level", *(F.col(f"head.{k}").alias(f"head_{k}") for k in KEY), (F.col("depth") - F.col("head.depth")).alias("away"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    every = materialize(every, "paths")
    most = every.agg(F.max("level").alias("level"), F.max("away").alias("away")).first()
    done: list[DataFrame] = []
    values = ["n_leaves", "saved_tokens"]
    for level in range(most["level"] if most["level"] is not None else -1, -1, -1):
        now = every.filter(F.col("level") == level).drop("level")
        if done:  # sums of light paths at their parents
            ends = done[-1].filter("away = 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
            now = now.join(ends, KEY, "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}).drop(*(f"more_{v}" for v in values))
        done.append(materialize(_summed(now, values, most["away"] >= PIECE), "level"))
    if not done:
        return way.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = [p for d in done for p in {f.rsplit("/", 1)[0] for f in d.inputFiles()}]
    out = way.sparkSession.read.schema(done[0].schema).parquet(*paths)
    out = out.join(_ends(way, convs), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
