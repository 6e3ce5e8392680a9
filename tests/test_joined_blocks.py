"""Blocks are joined where there would be very many of them; what comes out is the same."""

from voxelith.grid import Grid, joined_blocks
from voxelith.operators import fronts


def test_many_blocks_are_joined():
    assert joined_blocks((25, 20, 4), (8, 8, 8)) == (8, 8, 8)
    for layers in (2_400, 12_000, 72_000):
        x, y, z = joined_blocks((25, 20, layers), (8, 8, 8))
        assert x >= 25 and y >= 20 and z % 8 == 0
        n = -(-layers // z)
        assert n <= 64 or 1 << 18 <= 500 * z < 1 << 19
    assert joined_blocks((4000, 4000, 4000), (64, 64, 64)) == (64, 64, 64)
    assert joined_blocks((0, 0, 0), (8, 8, 8)) == (8, 8, 8)


def test_a_flood_joins_its_blocks(spark, monkeypatch):
    n = 1000  # 125 blocks of 8 voxels
    vox = spark.range(n).selectExpr("cast(id as int) as x", "0 as y", "0 as z", "5 as level", "if(id % 10 = 0, id + 1, 0L) as marker")
    blocks, real = [], fronts.written

    def kept(df, name="step"):
        out = real(df, name)
        if name == "blocks":
            blocks.append(out.count())
        return out

    monkeypatch.setattr(fronts, "written", kept)
    out = fronts.flood(vox, Grid(n, 1, 1), edge=2).collect()
    want = {x: min((abs(x - m), m + 1) for m in range(0, n, 10)) for x in range(n)}
    assert {r["x"]: (r["steps"], r["label"]) for r in out} == want
    assert 8 < blocks[0] <= 64
