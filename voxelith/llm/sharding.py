"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` equal positions; each shard owns the arcs that end at its
virtual nodes.  A row's key (its doc_id) hashes to a position.  Every shard may hold
exactly its share of rows (counts differ by one at most); keys that meet a full shard
continue clockwise to the next shard with room.  Rows are counted by ring position
(at most ``SLOTS`` counters, whatever the input), the walk is planned on these
counters, and the plan (row ranges of ring positions) is joined back to the rows.

Nulls: a null doc_id hashes by its text, a null text has size 1 and crc32 0.
Repeated rows are rows of their own; which of two equal rows gets which slot is open.
Empty table: no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SLOTS = 4096
VNODES = 96


def ring(shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[int]:
    """Owner of each ring position; a shard's virtual nodes do not depend on the others."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            p = zlib.crc32(f"shard {shard} node {v}".encode()) * 2654435761 % (1 << 32) * slots >> 32
            while p in at:
                p = (p + 1) % slots
            at[p] = shard
    nodes = sorted(at)
    owner, k = [0] * slots, 0
    for p in range(slots):
        while k < len(nodes) and nodes[k] < p:
            k += 1
        owner[p] = at[nodes[k % len(nodes)]]
    return owner


def plan(counts: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int, int]]:
    """(position, from rank, to rank, shard, first place in the shard) ranges.

    ``counts`` has at most ``slots`` entries; the plan has few more.
    """
    total, owner = sum(counts.values()), ring(shards, slots=slots)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, carry = [0] * shards, [], []

    def put(p: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard] - used[shard])
        if take > 0:
            out.append((p, lo, lo + take, shard, used[shard]))
            used[shard] += take
        return lo + max(take, 0)

    for turn in range(2):
        for p in range(slots):
            shard, queue = owner[p], []
            if turn == 0 and counts.get(p):
                lo = put(p, 0, counts[p], shard)
                if lo < counts[p]:
                    queue.append((p, lo, counts[p]))
            if carry and used[shard] < room[shard]:
                left = []
                for i, (q, lo, hi) in enumerate(carry):
                    lo = put(q, lo, hi, shard)
                    if lo < hi:
                        left = [(q, lo, hi), *carry[i + 1 :]]
                        break
                carry = left
            carry += queue
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    doc_id, text = docs["doc_id"], docs["text"]
    key = F.xxhash64(doc_id, F.when(doc_id.isNull(), text))
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - (SLOTS.bit_length() - 1)).cast("int").alias("position"),
    )
    rows = materialize(rows, "shard-rows")
    # at most SLOTS counters come to the driver, whatever the input
    counts = {r["position"]: r["n"] for r in rows.groupBy("position").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    # ring positions with many rows are numbered in parts, so no window group grows with the input
    parts = max(1, max(counts.values()) // 50_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(parts)).cast("int"))
    w = Window.partitionBy("position", "part").orderBy("key", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    if parts > 1:
        before = Window.partitionBy("position").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy("position", "part").agg(F.count("*").alias("n"))
        cells = cells.select("position", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
        rows = rows.join(cells, ["position", "part"]).withColumn("rank", F.col("rank") + F.col("skip"))
    ranges = json.dumps([dict(zip(("position", "lo", "hi", "shard", "base"), r, strict=True)) for r in plan(counts, shards)])
    schema = "array<struct<position:int,lo:long,hi:long,shard:int,base:long>>"
    moves = spark.range(1).select(F.inline(F.from_json(F.lit(ranges), schema)))
    # the plan has SLOTS ranges and a few more: a fixed bound, so it may be broadcast
    return (
        rows.join(F.broadcast(moves.withColumnRenamed("position", "at")), (F.col("position") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
