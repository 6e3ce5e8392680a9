"""Rounds of merges go on until no positive score is left."""

from voxelith.operators import agglomeration as ag
from voxelith.operators.agglomeration import Options


def roots(spark, n, edges):
    regions = spark.createDataFrame([(i, 1) for i in range(n)], "region_id long, n long")
    e = spark.createDataFrame([(a, b, t, 1.0, t, 1.0) for a, b, t in edges], "r1 long, r2 long, total_b double, total_a double, open_b double, open_a double")
    return {r["region_id"]: r["root"] for r in ag.batched_roots(regions, e, Options()).collect()}


def test_hubs_take_in_all_their_neighbours(spark):
    a = [(0, i, 0.1 + i / 1000) for i in range(1, 151)]
    b = [(151, i, 0.1 + i / 1000) for i in range(152, 302)]
    assert roots(spark, 302, a + b) == {i: 0 if i < 151 else 151 for i in range(302)}


def test_a_chain_of_rising_scores_merges(spark):
    assert len(set(roots(spark, 130, [(i, i + 1, 0.45 - i / 1000) for i in range(129)]).values())) == 1


def test_edges_at_or_under_zero_stay(spark):
    got = roots(spark, 4, [(0, 1, 0.1), (1, 2, 0.9), (2, 3, 0.2)])
    assert got[0] == got[1] != got[2] == got[3]
