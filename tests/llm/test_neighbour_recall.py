"""Recall against brute force over several shards and query blocks."""

import numpy as np
import pytest

from voxelith.llm import neighbours
from voxelith.llm.common import table


def vectors(case, spark, sf_dir):
    rng = np.random.default_rng(11)
    if case == "embeddings":
        rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
        return np.array([r["embedding"] for r in rows], np.float64)
    x = rng.normal(size=(1500, 16))
    if case == "offset":
        return 1000 + 0.01 * x
    if case == "large":
        return x * 1e21
    if case == "one far":
        x[3] = 1e150
        return x
    return rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] + 1e-3 * x


@pytest.mark.parametrize("case", ["embeddings", "offset", "large", "one far", "clusters"])
def test_recall(spark, sf_dir, monkeypatch, case):
    v = vectors(case, spark, sf_dir)
    monkeypatch.setattr(neighbours, "SHARD", len(v) // 4)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = neighbours.build_index(df)
    assert index.count() >= 3
    got = {}
    for r in neighbours.search(index, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = 0
    for q in range(0, len(v), 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(v)), d)).tolist() if i != q][:10]
        assert len(got[q]) == 10
        hit += len(set(want) & set(got[q]))
    assert hit >= 0.95 * 10 * len(range(0, len(v), 100))


def test_an_id_with_two_vectors_comes_once(spark):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(20)] + [(5, [0.5, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build_index(df), df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert got[0]["score"] == 0.5
