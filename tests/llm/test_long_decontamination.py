"""Texts full of repeats, texts over several blocks, benchmarks in parts, repeated rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from voxelith.llm import decontamination as d


def one(text, items):
    raw, offsets = d.normalized(pa.array([text]))
    out = {}
    for group in d.prepare(items):
        out |= {i: e for (_, i), e in d.matches(raw, offsets, group).items()}
    return out


def test_a_megabyte_of_dashes_stays_small():
    item = "begin " + "-" * 80 + " end"
    tracemalloc.start()
    got = one("-" * 1_000_000 + " begin " + "-" * 79 + " end", [item, "-" * 80])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {0: 1, 1: 0}
    assert peak < 500 << 20


@pytest.mark.parametrize("block, hits", [(1 << 20, 1 << 20), (64, 1 << 20), (1 << 20, 5), (37, 1)])
def test_slices_change_nothing(monkeypatch, block, hits):
    rng = np.random.default_rng(3)
    words = ["aa", "ab", "ba", "abab", "b"]
    items = [" ".join(rng.choice(words, 12)) for _ in range(6)]
    texts = [" ".join(rng.choice(words, 60)) + " " + items[k % 6].replace("abab", "abbb", 1) for k in range(12)]

    def all_():
        raw, offsets = d.normalized(pa.array(texts))
        return [d.matches(raw, offsets, group) for group in d.prepare(items)]

    want = all_()
    monkeypatch.setattr(d, "_BLOCK", block)
    monkeypatch.setattr(d, "_HITS", hits)
    assert all_() == want and any(want)


def test_parts_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [" ".join(f"w{k}" for k in rng.integers(0, 1000, 20)) for _ in range(40)]
    rows = [(i, f"before {items[i]} after") for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    monkeypatch.setattr(d, "ITEM_BYTES", 500)
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in d.find_items(docs, bench).collect())
    assert got == sorted((i, i, 0) for i in range(40) for _ in range(2))
