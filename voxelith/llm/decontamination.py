"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with every run of white space as one space; characters
are UTF-8 bytes.  An item of m characters is found in a document if some substring of
the document is within k = m // 10 edits of the whole item.  Such a substring shares at
least m + 1 - q (k + 1) q-grams with the item, on diagonals at most k apart.  Shared
q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, so one band
holds all of them; bands that reach the bound are verified by an alignment that stays
within k diagonals of the band.  q is 8, less for items too short for that bound.

The benchmark is read in parts of about ``ITEM_BYTES``; each part is broadcast, and indexed
once a worker (about 40 bytes a character).  Shared q-grams are counted in slices of at most
``_HITS``, and bands that no later place can reach are verified and forgotten, so memory does
not grow with the repeats in a text or an item.

Null or empty text: no match; an empty item matches nothing.  Null doc_id or item_id stay
null in the result.  Repeated documents give repeated results, repeated rows of the
benchmark count once.  Very long texts are searched whole.  Columns other than doc_id and
text (item_id and text of the benchmark) are not read.  Empty tables: no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, ranges, string_buffer, trimmed

Q, ERROR = 8, 10
ITEM_BYTES = 8 << 20
_BLOCK = 1 << 20
_HITS = 1 << 20
_BITS = 22
_INDEX: dict[str, list] = {}


def normalized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, and offsets."""
    raw, offsets = string_buffer(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    keep[edge] = ~space[edge]
    out = raw[keep]
    out[space[keep]] = 32
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as one integer (q <= 8)."""
    n = len(text) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(q if n > 0 else 0):
        out |= text[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


class Items:
    """The items that use one q: their q-grams with places, and bounds."""

    def __init__(self, q: int, texts: list[np.ndarray], numbers: list[int]):
        self.q, self.texts, self.numbers = q, texts, np.array(numbers)
        size = np.array([len(t) for t in texts])
        self.size, self.k = size, size // ERROR
        self.least = size + 1 - q * (self.k + 1)
        code = np.concatenate([grams(t, q) for t in texts])
        order = np.argsort(code, kind="stable").astype(np.int32)
        self.item = np.repeat(np.arange(len(texts), dtype=np.int32), size - q + 1)[order]
        self.place = np.concatenate([np.arange(n - q + 1, dtype=np.int32) for n in size])[order]
        code = code[order]
        self.first = np.flatnonzero(np.append(True, code[1:] != code[:-1])).astype(np.int32)
        self.codes = code[self.first]
        self.count = np.diff(np.append(self.first, np.int32(len(code))))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self._cell(self.codes)] = True

    @staticmethod
    def _cell(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def hits(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Slices of (item, place in the text, place in the item) of shared q-grams, by place
        in the text, each with the place from which the next slice goes on."""
        for s in range(0, len(text), _BLOCK):
            code = grams(text[s : s + _BLOCK + self.q - 1], self.q)
            where = np.flatnonzero(self.bits[self._cell(code)])
            code = code[where]
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            same = self.codes[k] == code
            where, k = where[same] + s, k[same]
            total = np.cumsum(self.count[k], dtype=np.int64)
            at = 0
            while at < len(k):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _HITS, "right")))
                post = ranges(self.first[k[at:to]], self.count[k[at:to]])
                yield self.item[post], np.repeat(where[at:to], self.count[k[at:to]]), self.place[post].astype(np.int64), int(where[to - 1]) + 1
                at = to


def prepare(texts: list[str]) -> list[Items]:
    groups: dict[int, tuple[list, list]] = {}
    raw, offsets = normalized(pa.array(texts, pa.large_string()))
    for i in range(len(texts)):
        t = raw[offsets[i] : offsets[i + 1]]
        t = t[: len(t) - 1] if len(t) and t[-1] == 32 else t
        if len(t):
            q = min(Q, max(1, len(t) // (len(t) // ERROR + 1)))
            groups.setdefault(q, ([], []))
            groups[q][0].append(t)
            groups[q][1].append(i)
    return [Items(q, t, n) for q, (t, n) in groups.items()]


def align(text: np.ndarray, item: np.ndarray, low: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edits of the item against text[begin:end] on diagonals low .. low + width - 1.

    Row i of the table holds, per diagonal, the edits of item[:i] against what ends at
    diagonal + i.  Start and end in the text are free.
    """
    diagonal = low[:, None] + np.arange(width)[None, :]
    far = 1 << 20
    cost = np.where((diagonal >= begin[:, None]) & (diagonal <= end[:, None]), 0, far).astype(np.int32)
    steps = np.arange(width, dtype=np.int32)[None, :]
    padded = np.append(text, np.uint8(0))
    for i, c in enumerate(item):
        at = diagonal + i
        inside = (at >= begin[:, None]) & (at < end[:, None])
        other = (padded[np.where(inside, at, len(text))] != c) | ~inside
        best = np.where(inside, cost + other, far)
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        valid = (at + 1 >= begin[:, None]) & (at + 1 <= end[:, None])
        best = np.where(valid, best, far)
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
        cost = np.where(valid, cost, far).astype(np.int32)
    return cost.min(axis=1)


def matches(text: np.ndarray, offsets: np.ndarray, items: Items) -> dict[tuple[int, int], int]:
    """{(row, item number): least edits} of the documents in the buffer."""
    found: dict[tuple[int, int], int] = {}
    w = items.k + 1
    low, span = -int(items.size.max()) - 2, len(text) + int(items.size.max()) + 4

    def verify(key: np.ndarray, n: np.ndarray) -> None:
        pair, band = key // span, key % span + low
        row, item = pair // len(items.texts), pair % len(items.texts)
        enough = n >= items.least[item]
        row, item, band = row[enough], item[enough], band[enough]
        for t in np.unique(item).tolist():
            number, k = int(items.numbers[t]), int(items.k[t])
            width = 2 * (k + 1) + 2 * k
            mine = np.flatnonzero(item == t)
            step = max(1, min(256, (1 << 19) // width))
            for c in range(0, len(mine), step):
                some = mine[c : c + step]
                # fewer than no edits are not to be found
                some = some[[found.get((r, number), 1) > 0 for r in row[some].tolist()]]
                if not len(some):
                    continue
                r = row[some]
                edits = align(text, items.texts[t], band[some] * w[t] - k, width, offsets[r], offsets[r + 1])
                for x, e in zip(r[edits <= k].tolist(), edits[edits <= k].tolist(), strict=True):
                    found[x, number] = min(e, found.get((x, number), e))

    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for item, p, ip, to in items.hits(text):
        row = np.searchsorted(offsets, p, "right") - 1
        within = p + items.q <= offsets[row + 1]
        item, row, diagonal = item[within].astype(np.int64), row[within], (p - ip)[within]
        # (row, item, band); every q-gram counts in two bands that overlap by half
        key = (row * len(items.texts) + item) * span + diagonal // w[item] - low
        key, which = np.unique(np.concatenate([held[0], key, key - 1]), return_inverse=True)
        n = np.bincount(which, np.concatenate([held[1], np.ones(2 * len(item), np.int64)]), len(key)).astype(np.int64)
        pair, band = key // span, key % span + low
        row, item = pair // len(items.texts), pair % len(items.texts)
        closed = ((band + 2) * w[item] + items.size[item] <= to) | (offsets[row + 1] <= to)
        verify(key[closed], n[closed])
        held = key[~closed], n[~closed]
    verify(*held)
    return found


def indexed(shared) -> list[Items]:
    """The index of a broadcast part of the benchmark; a worker keeps one."""
    name, _, texts = shared.value
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = prepare(texts)
    return _INDEX[name]


def search(shared):
    """mapInArrow: (doc_id, text) to (doc_id, item_id, edits, item_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, ids = indexed(shared), shared.value[1]
        sizes = [dict(zip(items.numbers.tolist(), items.size.tolist(), strict=True)) for items in groups]
        for batch in batches_by_bytes(batches, "text"):
            text, offsets = normalized(batch.column(1))
            out = []
            for items, size in zip(groups, sizes, strict=True):
                out += [(batch.column(0)[r].as_py(), ids[i], e, size[i]) for (r, i), e in sorted(matches(text, offsets, items).items())]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edits", "item_chars"])

    return trimmed(run)


MATCHES = "doc_id long, item_id long, edits int, item_chars int"


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, edits, item_chars."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).filter(F.octet_length("text") > 0)
    # the size is checked: a larger benchmark is searched in parts
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    result = None
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        got = sorted({(r["item_id"], r["text"]) for r in own.collect()}, key=str)
        if not got:
            continue
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [i for i, _ in got], [t for _, t in got]))
        found = rows.mapInArrow(search(shared), MATCHES)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], MATCHES) if result is None else result
