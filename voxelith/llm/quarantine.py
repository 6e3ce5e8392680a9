"""Quarantine and cascading release: turns wait for their parents, faulty ones are tried again.

A turn is tried when it has arrived and its parent is delivered.  Attempt a of a faulty turn
fails before its repair, or if ``failing[a - 1]`` says so; a failed attempt is retried after
base * 2^(a-1) seconds; after ``most`` failures the turn is dead.  Dead and blocked parents
block their children.

Level by level: the turns without a parent are resolved first, then the resolved turns of a
depth are joined to their children by (conversation, parent's place), until no turn is left.
Each depth is one written table, split into what it resolved and what still waits, so the
work of all rounds together is a small multiple of the turns, and an executor that is lost
costs one round at most.  Nothing of a conversation is gathered: places come from range
partitions, ranks and sums from windows over ranges of seconds (see ``ordered``), and the
joins are on (conversation, place), which no two turns share.

Turns of a conversation are in the order of turn (null first), role, hash of the text; repeated
rows are turns of their own.  A null conv_id is a conversation of its own; in hashes null is an empty
string.  Null text: empty.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches
from .ordered import before, numbered

MOST, BASE = 5, 10
DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"
_RESULT = "status string, attempts int, first_at long, last_at long"


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place (from 0 within the conversation), crc (CRC-32 of the text).

    Texts stay where they are; what is put in order is their hashes.
    """
    text = F.coalesce(rows["text"], F.lit(""))
    turns = rows.select(rows["conv_id"], rows["turn"], F.coalesce(rows["role"], F.lit("")).alias("role"), F.xxhash64(text).alias("hash"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("row"))
    return numbered(turns, ["conv_id"], ["turn", "role", "hash", "row"], "place").select("conv_id", "turn", "place", "crc")


def scheduled(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The turns of ``replay`` for conversations: arrivals, parents and faults from CRC-32 of ``k:conv_id:turn``.

    Turn p arrives at second 7 p; its parent lies h(0) % 3 turns before it; it is faulty if
    h(1) % 101 < 35, repaired h(2) % 101 seconds after its arrival, and h(a + 2) % 3 = 0
    makes attempt a fail.
    """

    def h(k: int) -> Column:
        text = F.concat(F.lit(f"{k}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
        return F.crc32(text.cast("binary"))

    back = h(0) % 3
    return placed(rows).select(
        "conv_id", "turn", "place",
        F.when((back > 0) & (F.col("place") >= back), F.col("place") - back).alias("parent"),
        (F.col("place") * 7).alias("arrives"),
        F.when(h(1) % 101 < 35, F.col("place") * 7 + h(2) % 101).alias("repaired"),
        F.array(*(h(a + 2) % 3 == 0 for a in range(1, most + 1))).alias("failing"),
        F.col("crc").alias("value"),
    )


def outcome(parent_status: Column, parent_at: Column, most: int = MOST, base: int = BASE) -> Column:
    """struct<status, attempts, first_at, last_at> of a turn whose parent is resolved (null: none)."""
    first = F.greatest(F.col("arrives"), parent_at)
    at = [first + base * (2**a - 1) for a in range(most)]
    fails = [F.col("repaired").isNotNull() & ((at[a] < F.col("repaired")) | F.get("failing", F.lit(a))) for a in range(most)]
    tries = F.coalesce(*(F.when(~f, a + 1) for a, f in enumerate(fails)))
    free = parent_status.isNull() | (parent_status == DELIVERED)
    return F.struct(
        F.when(~free, BLOCKED).when(tries.isNull(), DEAD).otherwise(DELIVERED).alias("status"),
        F.when(free, F.coalesce(tries, F.lit(most))).otherwise(0).alias("attempts"),
        F.when(free, first).alias("first_at"),
        F.when(free, F.coalesce(*(F.when(~f, t) for f, t in zip(fails, at, strict=True)), at[-1])).alias("last_at"),
    ).cast(f"struct<{_RESULT}>")


def resolve(turns: DataFrame, most: int = MOST, base: int = BASE) -> DataFrame:
    """conv_id, turn, place, value, status, attempts, first_at, last_at of all turns.

    A turn whose parent does not exist, or that is its own ancestor, waits for ever: status
    null, no attempts.
    """
    spark = turns.sparkSession
    small_batches(spark)
    waiting = ["conv_id", "turn", "place", "parent", "arrives", "repaired", "failing", "value"]
    root = f"{shared_dir(spark)}/voxelith/levels-{uuid.uuid4().hex}"
    paths: list[str] = []

    def level(df: DataFrame, done: Column, parent_status: Column, parent_at: Column) -> int:
        """Write a round: turns it resolves, and turns that wait on."""
        paths.append(f"{root}/level={len(paths)}")
        seen = Observation()
        out = df.select(*waiting, F.when(done, outcome(parent_status, parent_at, most, base)).alias("r"), done.cast("int").alias("done"))
        out.observe(seen, F.count_if(F.col("done") == 1).alias("resolved"), F.count_if(F.col("done") == 0).alias("waiting")).select(*waiting, "r.*", "done").write.partitionBy("done").parquet(paths[-1])
        return seen.get["resolved"], seen.get["waiting"]

    def read(done: int) -> DataFrame:
        return spark.read.schema(schema).parquet(paths[-1]).filter(F.col("done") == done)

    none = F.lit(None)
    resolved, left = level(turns, F.col("parent").isNull(), none.cast("string"), none.cast("long"))
    if not resolved and not left:
        return spark.createDataFrame([], f"conv_id long, turn long, place long, value long, {_RESULT}")
    schema = spark.read.parquet(paths[-1]).schema
    while resolved and left:
        above = read(1).select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), F.col("status").alias("_status"), F.col("last_at").alias("_at"))
        met = read(0).select(*waiting).hint("shuffle_merge").join(above, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_place")), "left")
        resolved, left = level(met, F.col("_place").isNotNull(), F.col("_status"), F.col("_at"))
    columns = ["conv_id", "turn", "place", "value", "status", "attempts", "first_at", "last_at"]
    there = paths if resolved else paths[:-1]
    every = spark.createDataFrame([], schema)
    if there:
        every = spark.read.schema(schema).option("basePath", root).parquet(*(f"{p}/done=1" for p in there))
    every = every.select(*columns)
    return every.unionByName(read(0).select(*columns)) if left else every


def replay(turns: DataFrame, most: int = MOST, base: int = BASE) -> DataFrame:
    """conv_id, turn, place, status, attempts, first_at, last_at, release_no, state.

    ``turns``: conv_id, turn, place, parent (a place, or null), arrives, repaired (null: not
    faulty), failing (array<boolean>), value.  Delivered turns are numbered from 1 within a
    conversation by (last_at, turn); ``state`` is the sum of release_no * value up to a
    release, in 64 bits (it wraps round, from some 65,000 turns of one conversation on).
    """
    done = resolve(turns, most, base)
    out = materialize(done.filter(F.col("status") == DELIVERED).withColumn("one", F.lit(1).cast("long")), "delivered")
    number = before(out, ["conv_id"], "last_at", {"earlier": ("one", "sum")}, ["turn", "place"])
    number = number.withColumn("release_no", F.coalesce("earlier", F.lit(0)) + 1).withColumn("weight", F.col("release_no").cast("decimal(20,0)") * F.col("value").cast("decimal(18,0)"))
    released = materialize(number.drop("one", "earlier"), "released")
    summed = before(released, ["conv_id"], "last_at", {"earlier": ("weight", "sum")}, ["turn", "place"])
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    total = (F.coalesce("earlier", F.lit(0)) + F.col("weight")) % whole
    state = F.when(total >= F.lit(str(1 << 63)).cast("decimal(20,0)"), total - whole).otherwise(total).cast("long")
    columns = ["conv_id", "turn", "place", "status", "attempts", "first_at", "last_at"]
    never = done.filter(F.col("status").isNull() | (F.col("status") != DELIVERED)).select(*columns, F.lit(None).cast("long").alias("release_no"), F.lit(None).cast("long").alias("state"))
    return summed.select(*columns, "release_no", state.alias("state")).unionByName(never)
