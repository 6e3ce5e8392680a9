"""Vectors whose squares leave single or double precision are searched like others."""

import numpy as np
import pytest

from voxelith.llm import neighbours


@pytest.mark.parametrize("size", [1.0, 1e25, 1e200])
def test_huge_components(spark, size):
    v = np.random.default_rng(2).normal(size=(40, 6))
    df = spark.createDataFrame([(i, (x * size).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(neighbours.build_index(df), df.filter("vec_id < 3")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(3):
        d = ((v - v[q]) ** 2).sum(1)
        assert got[q] == [i for i in np.argsort(d).tolist() if i != q][:10]
