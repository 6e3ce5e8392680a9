"""Large groups of near copies, and sets with too few blocks."""

import numpy as np
import pyarrow as pa

from voxelith.llm import ngram_join


def test_ten_thousand_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_CELL", 500)
    monkeypatch.setattr(ngram_join, "_MEMBERS", 1000)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 10_000):
        words = list(base)
        words[i % 100] = f"only{i}"
        rows.append((i, " ".join(words)))
    # far from the base and from each other, though they share blocks with all
    for i in range(10_000, 10_200):
        words = list(base)
        for k in range(i % 7, 100, 8):
            words[k] = f"far{i}x{k}"
        rows.append((i, " ".join(words)))
    # two that are near each other only
    words = rows[10_050][1].split()
    words[3] = "again"
    rows.append((10_200, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: 0 if i < 10_000 else 10_050 if i == 10_200 else i for i in range(10_201)}
    assert got == want


def test_random_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_CELL", 20)
    monkeypatch.setattr(ngram_join, "_MEMBERS", 10)
    rng = np.random.default_rng(5)
    texts = []
    for size in (40, 130, 500):
        base = [f"{size}w{i}" for i in range(size)]
        for i in range(120):
            words = list(base)
            for k in rng.choice(size, rng.integers(0, size // 14 + 1), replace=False):
                words[k] = f"e{i}{k}"
            texts.append(" ".join(words[rng.integers(0, 6) :]))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = ngram_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in range(len(sets))}


def test_crowded_sets_share_a_least_hash(monkeypatch):
    monkeypatch.setattr(ngram_join, "blocks_of", lambda band: np.full(len(band), 8))
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = [f"w{rng.integers(10**9)}" for _ in range(90)]
        b = list(a)
        for k in rng.choice(90, 2, replace=False):
            b[k] = "new"
        row, h = ngram_join.shingles(pa.array([" ".join(a), " ".join(b)]))
        r, part, content, spare = ngram_join.parts_of(row, h, 2)
        assert (spare[:, 0] > 0).all()
        assert set(content[(r == 0) & (part == 0)].tolist()) & set(content[r == 1].tolist())


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    big = np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))
    small = big[:60]
    a, b = ngram_join.sketch(big)[None, :], ngram_join.sketch(small)[None, :]
    width = min(a.shape[1], b.shape[1])
    assert a.shape[1] != b.shape[1]
    far = np.bitwise_count(ngram_join.folded(a, width) ^ ngram_join.folded(b, width)).sum()
    assert 0 < far <= 30 and far % 2 == 0
