"""Sharding against a walk key by key, entropy spans against plain Python."""

import math
import random
import re
from collections import Counter, deque

import numpy as np
import pytest

from voxelith.llm import secrets, sharding


@pytest.mark.parametrize("seed, keys, slots, shards", [(0, 500, 64, 3), (1, 37, 256, 8), (2, 2000, 128, 5), (3, 5, 64, 8)])
def test_plan_is_a_walk_key_by_key(seed, keys, slots, shards):
    rng = np.random.default_rng(seed)
    # a third of all keys meet one position
    at = np.where(rng.random(keys) < 1 / 3, 7, rng.integers(0, slots, keys)).tolist()
    counts, owner = dict(Counter(at)), sharding.ring(shards, vnodes=6, slots=slots)
    original, sharding.ring = sharding.ring, lambda *a, **k: owner
    try:
        ranges = sharding.plan(counts, shards, slots)
    finally:
        sharding.ring = original
    got = {(p, r): (s, base + r - lo) for p, lo, hi, s, base in ranges for r in range(lo, hi)}
    room, used, waiting, want = [keys // shards + (s < keys % shards) for s in range(shards)], [0] * shards, deque(), {}
    for turn in range(2):
        for p in range(slots):
            s = owner[p]
            own = [(p, r) for r in range(counts.get(p, 0))] if turn == 0 else []
            late = []
            for key in own:
                if used[s] < room[s]:
                    want[key] = (s, used[s])
                    used[s] += 1
                else:
                    late.append(key)
            while waiting and used[s] < room[s]:
                want[waiting.popleft()] = (s, used[s])
                used[s] += 1
            waiting.extend(late)
    assert got == want and len(got) == keys


def test_one_place_in_parts(spark, monkeypatch):
    """More than 50,000 rows of one key: slots stay gapless."""
    rows = spark.range(60_000).selectExpr("cast(5 as long) as doc_id", "concat('t', id) as text")
    out = sharding.shard_documents(rows, 3).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sorted(r["count(1)"] for r in out) == [20_000] * 3
    assert all(r["max(slot)"] == 19_999 for r in out)


def entropy_spans(text):
    out = set()
    for c in secrets.CLASSES:
        for m in re.finditer(c.pattern, text):
            if re.search(secrets.ALLOW, m.group()):
                continue
            hits = []
            for i in range(len(m.group()) - c.window + 1):
                n = Counter(m.group()[i : i + c.window]).values()
                if -sum(k / c.window * math.log2(k / c.window) for k in n) >= c.bits - 1e-12:
                    hits.append(i)
            if hits:
                out.add((m.start() + hits[0], m.start() + hits[-1] + c.window))
    return sorted(out)


def test_entropy_spans_of_whole_texts(spark):
    rnd = random.Random(4)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab1"]
    texts = []
    for k in range(80):
        parts = []
        for _ in range(rnd.randrange(1, 12)):
            parts.append("".join(rnd.choice(alphabets[rnd.randrange(4)]) for _ in range(rnd.choice([5, 19, 20, 24, 27, 31, 40, 90]))))
            parts.append(rnd.choice([" ", "\n", " é the sample key ", "//", ": ", "-", "\U0001f600"]))
        texts.append("".join(parts))
    texts += ["", "x" * 50_000, texts[0], " ".join(texts) * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(rows).collect():
        assert sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "entropy") == entropy_spans(texts[r["doc_id"]])
