"""Quarantine, prefix trie and running totals against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from voxelith.llm import ordered, quarantine, queries, trie

ROWS = "conv_id long, turn long, role string, text string"
RESULT = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def ordered_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: sorted(v) for c, v in by.items()}


def replayed(rows):
    """Multiset of result rows, turn by turn."""
    out = []
    for c, turns in ordered_turns(rows).items():
        own, state = [], {}

        def h(k, p, c=c, turns=turns):
            there, turn, *_ = turns[p]
            return zlib.crc32(f"{k}:{'' if c is None else c}:{turn if there else ''}".encode())

        for p, (there, turn, _, text) in enumerate(turns):
            back, start = h(0, p) % 3, 7 * p
            above = state[p - back] if back and p - back >= 0 else ("delivered", 0, 0, 0)
            if above[0] != "delivered":
                state[p] = ("blocked", 0, None, None)
            else:
                faulty, repaired = h(1, p) % 101 < 35, start + h(2, p) % 101
                at = first = max(start, above[3])
                for a in range(1, 6):
                    if not faulty or (at >= repaired and h(a + 2, p) % 3):
                        state[p] = ("delivered", a, first, at)
                        break
                    if a == 5:
                        state[p] = ("dead", 5, first, at)
                    else:
                        at += 10 * 2 ** (a - 1)
            own.append([c, turn if there else None, *state[p], None, None, there, p, text])
        total = 0
        for k, r in enumerate(sorted((r for r in own if r[2] == "delivered"), key=lambda r: (r[5], r[8], r[1] or 0, r[9])), 1):
            total += k * zlib.crc32(r[10].encode())
            r[6], r[7] = k, total
        out += [tuple(r[:8]) for r in own]
    return out


def trie_rows(rows):
    turns = {c: [(r, t) for *_, r, t in v] for c, v in ordered_turns([r for r in rows if r[0] is not None]).items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = []
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def under(node):
        leaves, saved = (0 if kids[node] else 1), ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        for k in kids[node]:
            a, b = under(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(kids[node]), *under(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_rows(seed, convs=60, most=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), convs):
        same = rng.random() < 0.4
        for t in range(rng.randrange(1, most)):
            turn = None if t == 2 and rng.random() < 0.5 else 3 * t
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if not same else "user", None if rng.random() < 0.1 else f"text {t}" if same else rng.choice(["a", "é" * 9, "", "longer text"])))
    rows += rows[:5]
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_replay_turn_by_turn(spark):
    rows = [*some_rows(1), (None, 1, "user", "x"), (None, None, None, None), *((7777, t, "user", f"{t}") for t in range(300))]
    got = quarantine.replay(quarantine.scheduled(spark.createDataFrame(rows, ROWS).withColumn("status", F.lit("clash")).repartition(3)))
    assert as_rows(got.select(*RESULT)) == sorted(replayed(rows), key=key)


def test_replay_of_nothing_and_of_orphans(spark):
    assert quarantine.replay(quarantine.scheduled(spark.createDataFrame([], ROWS))).count() == 0
    turns = spark.createDataFrame([(1, 0, 0, 5, 0, None, [False], 3), (1, 1, 1, None, 7, None, [False], 3)], "conv_id long, turn long, place long, parent long, arrives long, repaired long, failing array<boolean>, value long")
    got = {r["place"]: (r["status"], r["attempts"], r["release_no"]) for r in quarantine.replay(turns, most=1).collect()}
    assert got == {0: (None, None, None), 1: ("delivered", 1, 1)}


def test_trie_node_by_node(spark):
    for seed in (1, 2):
        rows = [*some_rows(seed), (None, 1, "user", "x"), *((7777, t, "user", f"{t}") for t in range(40))]
        got = trie.prefix_trie(*trie.grafted(trie.turns_of(spark.createDataFrame(rows, ROWS).withColumn("depth", F.lit(1)))))
        assert as_rows(got) == sorted(trie_rows(rows), key=key)
    assert trie.prefix_trie(*trie.grafted(trie.turns_of(spark.createDataFrame([], ROWS)))).count() == 0


def test_trie_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "ENDS", 2)
    monkeypatch.setattr(ordered, "RANGE", 4)
    rows = some_rows(5, 40, 30)
    got = trie.prefix_trie(*trie.grafted(trie.turns_of(spark.createDataFrame(rows, ROWS))))
    assert as_rows(got) == sorted(trie_rows(rows), key=key)
    got = quarantine.replay(quarantine.scheduled(spark.createDataFrame(rows, ROWS)))
    assert as_rows(got.select(*RESULT)) == sorted(replayed(rows), key=key)


def test_hot_conversation_is_dealt_out(spark):
    """No task of ``numbered`` or ``before`` holds a conversation of most of the rows."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(1).cast("long")).otherwise(F.col("id")).alias("k"), "id")
    got = ordered.numbered(rows, ["k"], ["id"], "place")
    assert got.filter("k = 1").agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, 17_999, 18_000)
    parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert parts < 9_000
    summed = ordered.before(ordered.materialize(got, "numbered"), ["k"], "place", {"sum": ("place", "sum"), "most": ("place", "max")})
    assert summed.filter("k = 1 and not (sum <=> nullif(place * (place - 1) div 2, 0) or place <= 1)").count() == 0
    assert summed.filter("place > 0 and most <> place - 1").count() == 0


def test_queries_on_given_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op12_quarantine_release(spark, sf_dir)) == sorted(replayed(rows), key=key)
    assert as_rows(queries.op13_prefix_trie(spark, sf_dir)) == sorted(trie_rows(rows), key=key)


def test_sql_twins(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rows = c.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(c.execute(queries.SQL["op12_quarantine_release"]).fetchall(), key=key) == sorted(replayed(rows), key=key)
    assert sorted(c.execute(queries.SQL["op13_prefix_trie"]).fetchall(), key=key) == sorted(trie_rows(rows), key=key)
