"""Collections that are dealt by longer contexts give what one construction gives."""

import numpy as np
import pyarrow as pa
import pytest

from test_operators import removal, rows_of
from voxelith.llm import suffix_dedup


def hot_texts():
    """Many texts around one passage, cut and changed at different places."""
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 260).astype(np.uint8)).decode()
    out = []
    for i in range(120):
        lo, hi = int(rng.integers(0, 40)), int(rng.integers(200, 261))
        body = list(passage[lo:hi])
        if i % 3 == 0:
            body[int(rng.integers(len(body)))] = "#"
        out.append((i, str(i) * (i % 4) + "".join(body) + str(i) * (i % 5)))
    return out


@pytest.mark.parametrize("hot", [1, 3, 10, 40])
def test_hot_collections(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    df = spark.createDataFrame(hot_texts(), "doc_id long, text string").repartition(3)
    assert rows_of(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removal(hot_texts(), 200)


@pytest.mark.parametrize("span", [1, 3, 10, 38, 151])
def test_narrowed_parts_hold_every_start_once(span):
    width = 200
    body = bytes(np.random.default_rng(2).integers(0, 256, 340).astype(np.uint8))
    rows = [(7, 1, 1, 1, 140, 141, body), (7, 2, 1, 1, 140, 30, body), (7, 3, 1, 2, 20, 21, body[120:340]), (7, 4, 1, 1, 140, 41, body[:240]), (7, 5, 1, 1, 0, 1, body[140:])]
    names = [c.split()[0] for c in suffix_dedup.SEGMENTS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    seen, keys = {r[1]: [] for r in rows}, {}
    for out in suffix_dedup.narrowed(width, span)(iter([batch])):
        for r in out.to_pylist():
            parent = rows[r["p_x1"] - 1]
            assert r["n"] == parent[3] and r["before"] < span
            for k in range(r["judged"]):
                start = parent[4] - r["low"] - r["before"] + k
                window = r["body"][k : k + width]
                assert window == parent[6][start : start + width] and len(window) == width
                seen[r["p_x1"]].append(start)
                # equal windows meet under one key, at one distance from the tail
                assert keys.setdefault(window, (r["h"], r["before"] - k)) == (r["h"], r["before"] - k)
    assert {k: sorted(v) for k, v in seen.items()} == {r[1]: list(range(r[5])) for r in rows}
