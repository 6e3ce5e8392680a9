"""Jaccard self-join of word n-grams by parity sketches.

A document's set is its distinct n-word shingles (as 64-bit hashes).  Documents are
joined per size band.  In a band the hash space is dealt into blocks; a block's part of
the sketch is the XOR of the hashes in it, so every element of a symmetric difference
changes one block at most: the number of blocks that differ is a lower bound of the
symmetric difference.  Two sets of Jaccard 3/4 or more differ in at most
d = (|A| + |B|) / 7 elements, hence (pigeonhole) of any d + 1 non-empty blocks of A one
is equal in B.  That holds for the first d + 1 blocks in any common order, so blocks are
taken by rarity: by the number of different sets that hold them.  A set whose first d + 1
blocks all occur once has no partner and is out at once.  A set with d or fewer non-empty
blocks is crowded; a pair can lose all common blocks only if both are crowded, so such
sets also send their d + 1 least hashes, of which two linked sets share one.

All blocks of different sets are dealt into buckets by their content, twelve bytes each,
and counted there, so nothing is broadcast and no bitmap fills up; what one set alone
holds goes no further.  Sets that meet in a block are candidates, and components are
built from representatives:

1. A block's leader is its most central set, the one that shares most with others for its
   size; every other set of the block is verified against it: one pair a row at most.
2. Blocks that without their leaders still hold several components are looked at by bit sketches (4 to 8 bits
   an element, one flipped a hash; the Hamming distance is again a lower bound).  Of what
   may link across components, a block sends a forest only (least distance first), so
   again one pair a row at most.  Blocks of the same sets are looked at once.
3. The same again, now with all pairs that the bound lets through: by then these are the
   few that lie within the sketch's error of the threshold.  This makes the result exact.

Pairs of one component need no look, so a group of copies costs no square of its size.  In
a block, the sets of its largest component are dealt into parts, and only the others go to
every part.  A leader with very many members is verified in several tasks.

Equality of sets and blocks is that of hashes (128 and 63 bits for sets).

Null or empty text: no shingles, linked with nothing.  Fewer than n words: the whole
sequence is the one shingle.  Repeated rows and equal sets are linked (if not empty).
doc_id may be null; a component's id is its least doc_id that is not null.  Empty table:
no rows.  Very long texts are one set like others.  Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PrefixHash, batches_by_bytes, discard, lower_ascii, materialize, mix, string_buffer, trimmed
from .components import components

#: Bytes of text whose blocks make one bucket (about a million blocks, 12 MB).
_BUCKET_BYTES = 10 << 20
#: Sets of one component of a block that one task compares, and the sketch bytes it holds.
_CELL, _CELL_BYTES = 4_000, 32 << 20
#: Low bits of the hashes of texts by which texts are told apart before they are shuffled.
_LOW_BITS = 20
#: Members of one leader that are verified in one task.
_MEMBERS = 20_000
#: Bits of a block's content that tell it from others: 32 beside those of its bucket.
_CONTENT_BITS = 54
_PACKED = np.dtype([("content", "<u4"), ("set", "<u8")])


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each document's distinct shingles, by row, then hash."""
    raw, offsets = string_buffer(texts)
    raw = lower_ascii(raw)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(word & ~after) + 1
    # every run of white space becomes one space
    keep = word | (before & ~word)
    place = np.concatenate([[0], np.cumsum(keep)])
    text = raw[keep]
    text[~word[keep]] = 32
    # words that touch at a document's edge stay apart by their places, not by a space
    s, e = place[starts], place[ends]
    of = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(of, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    full = np.arange(max(len(starts) - n + 1, 0))
    full = full[of[full] == of[full + n - 1]]
    short = np.flatnonzero((count > 0) & (count < n))
    hashed = PrefixHash(text)
    h = np.concatenate([hashed(s[full], e[full + n - 1]), hashed(s[first[short]], e[first[short] + count[short] - 1])])
    row = np.concatenate([of[full], short])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[once], h[once]


def band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1) + 0.5)).astype(np.int64)


def blocks_of(band: np.ndarray) -> np.ndarray:
    """Blocks of a band: under 32 elements each has its own, else at most about two share one."""
    return np.where(band < 5, 1 << 20, np.maximum(64, 1 << np.maximum(band, 0)))


def elements(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, block content) of each document's non-empty blocks, and d of each.

    A document takes part in its own band, and in the one below if a partner may be there.
    """
    size = np.bincount(row, minlength=rows)
    own = band(size)
    parts = []
    for lower in (0, 1):
        g = own - lower
        takes = (size > 0) & ((lower == 0) | ((g >= 0) & (3 * size <= 4 * ((1 << own) - 1))))
        use = takes[row]
        r, x = row[use], h[use]
        block = (x >> np.uint64(20)) % blocks_of(g[r]).astype(np.uint64)
        order = np.lexsort((block, r))
        r, x, block = r[order], x[order], block[order]
        if not len(r):
            continue
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        r, block = r[first], block[first]
        content = mix(np.bitwise_xor.reduceat(x, first) + block * np.uint64(0x9E3779B97F4A7C15) + g[r].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        partner = np.minimum(4 * size // 3, np.iinfo(np.int64).max) if lower == 0 else (1 << own) - 1
        parts.append((r, g[r], content, ((size + partner) // 7)[r]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def parts_of(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, content) of all that a document sends, and its spare[row, part].

    Part 0 is its own band, part 1 the one below.  Spare is d + 1 less the number of
    non-empty blocks: where it is positive the set is crowded and its least hashes follow.
    """
    size = np.bincount(row, minlength=rows)
    r, g, content, d = elements(row, h, rows)
    part = (g != band(size)[r]).astype(np.int64)
    spare = np.zeros(2 * rows, np.int64)
    spare[2 * r + part] = d + 1
    spare -= np.bincount(2 * r + part, minlength=2 * rows)
    ends = np.cumsum(size)
    parts = [(r, part, content.astype(np.uint64))]
    for at in np.flatnonzero(spare > 0).tolist():
        i, p = divmod(at, 2)
        least = h[ends[i] - size[i] : ends[i]][: int(d[(r == i) & (part == p)][0]) + 1]
        salt = mix(band(size[i : i + 1]).astype(np.uint64) - np.uint64(p))
        parts.append((np.full(len(least), i), np.full(len(least), p), mix(mix(least) + salt)))
    r, part, content = (np.concatenate(c) for c in zip(*parts, strict=True))
    return r, part, content, spare.reshape(rows, 2)


def keys_of(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's set, as two columns, and the sizes."""
    size = np.bincount(row, minlength=rows)
    first = np.cumsum(size) - size
    keys = np.zeros((rows, 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        keys[full, 0] = mix(np.add.reduceat(h, first[full]))
        keys[full, 1] = mix(np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[full]) + size[full].astype(np.uint64))
    return keys, size


_ROW = "set long, doc_id long, n_shingles long, k binary, t long, spare0 int, spare1 int"
DEALT = "bucket long, packed binary, " + _ROW
COUNTED = "rank long, " + _ROW
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]


def dealt(n: int, buckets: int):
    """mapInArrow over (doc_id, text, t): one row a document, and packed blocks by bucket.

    The blocks of a set leave a task once.  Rows of documents travel in buckets below zero.
    """
    top = np.uint64(buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches_by_bytes(batches, "text"):
            rows = batch.num_rows
            row, h = shingles(batch.column(1), n)
            keys, size = keys_of(row, h, rows)
            r, part, content, spare = parts_of(row, h, rows)
            ks = [keys[i].tobytes() if size[i] else None for i in range(rows)]
            fresh = np.zeros(rows, bool)
            for i, k in enumerate(ks):
                if k is not None and k not in sent:
                    sent.add(k)
                    fresh[i] = True
            turn += 1
            low = keys[:, 0] & ~np.uint64(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, -1 - turn % buckets)), pa.nulls(rows, pa.binary()), pa.array(low.view(np.int64)), batch.column(0), pa.array(size, pa.int64()),
                 pa.array(ks, pa.binary()), batch.column(2), pa.array(spare[:, 0], pa.int32()), pa.array(spare[:, 1], pa.int32())],
                names=_names(DEALT),
            )
            use = fresh[r]
            r, part, content = r[use], part[use], content[use]
            bucket = (content >> (np.uint64(64) - top)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32) if top else np.zeros(len(content), np.uint16)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty(len(order), _PACKED)
            packed["content"] = ((content << top) >> np.uint64(32))[order]
            packed["set"] = (low[r] | part.astype(np.uint64))[order]
            full, first = np.unique(bucket[order], return_index=True)
            cuts = np.append(first, len(order))
            of = [packed[s:e].tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            none = [pa.nulls(len(full), t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(of, pa.binary()), *none], names=_names(DEALT))

    return trimmed(run)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """applyInArrow: the blocks of a bucket that several sets hold.

    Their rank is the number of these sets (255 or more count alike), then the content.
    """
    bucket = key[0].as_py()
    if bucket < 0:
        return pa.table([pa.nulls(table.num_rows, pa.int64()), *table.select(_names(_ROW)).columns], names=_names(COUNTED))
    packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), _PACKED)
    content = np.ascontiguousarray(packed["content"])
    order = np.argsort(content)
    content = content[order]
    again = np.zeros(len(content), bool)
    again[1:] = content[1:] == content[:-1]
    again[:-1] |= again[1:]
    content, of = content[again], packed["set"][order[again]]
    order = np.lexsort((of, content))
    content, of = content[order], of[order]
    once = np.ones(len(of), bool)
    once[1:] = (content[1:] != content[:-1]) | (of[1:] != of[:-1])
    content, of = content[once], of[once]
    first = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(content) else np.zeros(0, np.int64)
    f = np.diff(np.append(first, len(content)))
    f = np.repeat(f, f)
    several = f > 1
    rank = np.minimum(f[several], 255) << _CONTENT_BITS | bucket << 32 | content[several].astype(np.int64)
    return pa.table([pa.array(rank), pa.array(of[several].view(np.int64)), *(pa.nulls(len(rank), t) for t in _TYPES[1:])], names=_names(COUNTED))


def sketch(h: np.ndarray) -> np.ndarray:
    """Words of a set's bit sketch: 4 to 8 bits an element, one flipped by each."""
    bits = max(64, 8 << int(band(np.array([len(h)]))[0]))
    flips = np.bincount(((h >> np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches of rows, folded to ``width`` words: as if made with fewer bits."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def tokens(n: int):
    """mapInArrow over (text, id, k): (id, size, tokens, sketch) of each text whose set is k, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches_by_bytes(batches, "text"):
            row, h = shingles(batch.column(0), n)
            keys, size = keys_of(row, h, batch.num_rows)
            ends = np.cumsum(size)
            ids, ks, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for i in np.flatnonzero(size).tolist():
                if ids[i] not in sent and keys[i].tobytes() == ks[i]:
                    sent.add(ids[i])
                    own = h[ends[i] - size[i] : ends[i]]
                    out.append((ids[i], len(own), own.tobytes(), sketch(own).tobytes()))
            columns = zip(*out, strict=True) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "size", "tokens", "sketch"])

    return trimmed(run)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the pairs whose sketches do not show that they differ in too much."""
    for batch in batches:
        keep = []
        for na, nb, x, y in zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist(), batch.column("of_a"), batch.column("of_b"), strict=True):
            a, b = (np.frombuffer(z.as_buffer(), np.uint64)[None, :] for z in (x, y))
            width = min(a.shape[1], b.shape[1])
            keep.append(7 * int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum()) <= na + nb)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(percent: int):
    """mapInArrow: (a, b, their tokens) to the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("of_a"), batch.column("of_b")
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(ta, tb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return trimmed(run)


def _near(one: np.ndarray, two: np.ndarray, size: np.ndarray, root: np.ndarray, bits: list[np.ndarray], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, distance) of pairs from ``one`` x ``two`` across components that all bounds let through."""
    for low in np.unique(own[one]).tolist():
        for high in (low - 1, low, low + 1):
            left, right = one[own[one] == low], two[own[two] == high]
            if not len(right):
                continue
            width = min(len(bits[left[0]]), len(bits[right[0]]))
            wa, wb = (folded(np.stack([bits[k] for k in side]), width) for side in (left, right))
            step = max(1, (1 << 20) // len(right))
            for s in range(0, len(left), step):
                i = left[s : s + step]
                si, sj = size[i][:, None], size[right][None, :]
                p, q = np.nonzero((root[i][:, None] != root[right][None, :]) & (4 * np.minimum(si, sj) >= 3 * np.maximum(si, sj)))
                for t in range(0, len(p), chunk := max(1, (1 << 21) // width)):
                    u, v = p[t : t + chunk], q[t : t + chunk]
                    far = np.bitwise_count(wa[u + s] ^ wb[v]).sum(axis=1, dtype=np.int64)
                    x, y = i[u], right[v]
                    near = 7 * far <= size[x] + size[y]
                    yield x[near], y[near], far[near]


def _forest(x: np.ndarray, y: np.ndarray, far: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which of the pairs join components of a cell, nearest first (Kruskal)."""
    parent = list(range(int(root.max()) + 1)) if len(root) else []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keep = []
    for at in np.argsort(far, kind="stable").tolist():
        i, j = find(int(root[x[at]])), find(int(root[y[at]]))
        if i != j:
            parent[i] = j
            keep.append(at)
    return np.array(keep, np.int64)


def across(forest: bool):
    """mapInArrow over rows sorted by cell: pairs (a, b) of sets across components that may link.

    Of a forest only the pairs that join components; a row without pair then names a block
    that has more of them.
    """

    def cell_pairs(table: pa.Table) -> pa.RecordBatch:
        size = np.asarray(table.column("size")).astype(np.int64)
        root = np.unique(np.asarray(table.column("root")), return_inverse=True)[1]
        bits = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("sketch")]
        part, left, right = (np.asarray(table.column(c)) for c in ("part", "left", "right"))
        one, two, own = np.flatnonzero(part == left), np.flatnonzero(part == right), band(size)
        found, more = [np.zeros(0, np.int64)] * 3, False
        for near in _near(one, two, size, root, bits, own):
            found = [np.concatenate(c) for c in zip(found, near, strict=True)]
            if forest:
                keep = _forest(*found, root)
                more |= len(keep) < len(np.unique(np.minimum(found[0], found[1]) * len(size) + np.maximum(found[0], found[1])))
                found = [c[keep] for c in found]
        ids = np.asarray(table.column("id"))
        a, b = ids[found[0]], ids[found[1]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        block = pa.nulls(len(pairs), pa.int64())
        batch = pa.RecordBatch.from_arrays([block, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["content", "a", "b"])
        if not more:
            return batch
        rest = pa.RecordBatch.from_arrays([table.column("content").combine_chunks()[:1], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["content", "a", "b"])
        return pa.Table.from_batches([batch, rest]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cell = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("content", "left", "right")], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and cell[s].tolist() != last:
                    yield cell_pairs(pa.concat_tables(held))
                    held = []
                held.append(table.slice(s, e - s))
                last = cell[s].tolist()
        if held:
            yield cell_pairs(pa.concat_tables(held))

    return trimmed(run)


def open_cells(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (content, left, right, part, id, size, root) of blocks that hold sets of several components.

    Of blocks with the same sets one is taken.  The sets of a block's largest component are
    dealt into parts that need not meet each other; the other sets go to every part.
    """
    named = materialize(
        shared.select("content", "id", "size").join(roots, F.col("id") == F.col("node"), "left").select("content", "id", "size", F.coalesce("root", "id").alias("root")), "named"
    )
    held = named.groupBy("content", "root").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 7))").alias("y"))
    whole = F.struct("n", "sizes", "root")
    blocks = held.groupBy("content").agg(F.count("*").alias("roots"), F.max(whole).alias("main"), F.sum("n").alias("n"), F.sum("sizes").alias("sizes"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    blocks = blocks.filter("roots > 1").groupBy("n", "sizes", "x", "y").agg(F.min("content").alias("content"), F.min("main").alias("main"))

    def parts(n: Column, sizes: Column) -> Column:
        return F.ceil(F.greatest(n / _CELL, sizes / _CELL_BYTES)).cast("int")

    blocks = blocks.select("content", F.col("main.root").alias("main"), parts(F.col("main.n"), F.col("main.sizes")).alias("g"), parts(F.col("n") - F.col("main.n"), F.col("sizes") - F.col("main.sizes")).alias("o"))
    rows = named.join(blocks, "content")
    inside = F.col("root") == F.col("main")
    rows = rows.withColumn("part", F.when(inside, F.col("o") + F.pmod(F.xxhash64("id"), F.col("g"))).otherwise(F.pmod(F.xxhash64("id"), F.col("o"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("o") - 1).otherwise(F.col("o") + F.col("g") - 1))))
    out = materialize(rows.select("content", "id", "size", "root", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right")), "cells")
    discard(named)
    return out


def candidates(counted_: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (content, id, size, score): of each set the blocks among its first d + 1 that others hold too.

    The score is how often the set meets others in them, for its size.
    """
    low = F.expr("set & -2")
    held = counted_.filter("rank is not null").select("set", F.col("rank").alias("content"))
    held = held.join(sets.withColumnRenamed("set", "own"), low == F.col("own"))
    # both parts of a set are where the join left them
    own = Window.partitionBy("own", "set")
    # blocks that occur once come first, and were not sent here
    many = F.count("*").over(own) + F.when(F.expr("set & 1 = 0"), F.col("spare0")).otherwise(F.col("spare1"))
    held = held.select("own", "set", "id", "size", "content", F.row_number().over(own.orderBy("content")).alias("place"), many.alias("many")).filter("place <= many")
    score = F.sum(F.shiftright("content", _CONTENT_BITS) - 1).over(own) / F.col("size")
    return held.select("id", "size", score.cast("float").alias("score"), "content")


def similar_sets(met: DataFrame, known: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) of the linked sets (by id) among the candidates ``met``.

    ``known`` has (id, k, t) of all sets, ``texts`` (t, text).
    """
    spark = met.sparkSession
    leaders = met.groupBy("content").agg(F.max(F.struct("score", "id", "size")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = leaders.select("content", F.col("leader.id").alias("leader"), F.col("leader.size").alias("leader_size"))
    shared = met_ = materialize(met.drop("score").join(leaders, "content"), "shared")
    # only sets that share a block with another one send their tokens; the low bits of their
    # texts' hashes, 2^20 at most, keep most other texts from being shuffled
    wanted = materialize(known.join(shared.select("id").distinct(), "id", "left_semi"), "wanted")
    low = (F.col("t").bitwiseAND((1 << _LOW_BITS) - 1)).alias("low")
    some = texts.withColumn("low", low).join(F.broadcast(wanted.select(low).distinct()), "low", "left_semi").select("t", "text")
    sets = materialize(some.join(wanted, "t").select("text", "id", "k").mapInArrow(tokens(n), "id long, size long, tokens binary, sketch binary"), "sets")
    if sets.count() > wanted.count():
        # equal texts were read by several tasks
        sets = materialize(sets.groupBy("id").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "sets")

    def met_by(pairs: DataFrame, column: str) -> DataFrame:
        """The pairs (a, b) with a column of both; a set that meets very many others is sent several times."""
        heat = pairs.groupBy("a").agg(F.ceil(F.count("*") / _MEMBERS).cast("int").alias("salts"))
        first = sets.join(heat, F.col("id") == F.col("a")).select("a", F.col("size").alias("size_a"), F.col(column).alias("of_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        salted = pairs.join(heat, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
        second = sets.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col(column).alias("of_b"))
        return salted.join(second, "b").join(first, ["a", "salt"]).select("a", "b", "size_a", "size_b", "of_a", "of_b")

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: by sketches first, what they leave by the sets themselves."""
        may = materialize(met_by(pairs, "sketch").mapInArrow(trimmed(bounded), "a long, b long"), "may")
        return materialize(met_by(may, "tokens").mapInArrow(verify(percent), "a long, b long"), "links")

    fits = (F.col("id") != F.col("leader")) & (4 * F.least("size", "leader_size") >= 3 * F.greatest("size", "leader_size"))
    tried = materialize(shared.filter(fits).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    roots = components(check(tried))
    # a leader has met all others of its block
    shared = shared.filter("id != leader").select("content", "id", "size")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = ("content", "left", "right")
    left = shared
    for forest in (True, False):
        cells = open_cells(left, roots)
        dealt_ = cells.join(sets.select("id", "sketch"), "id").repartition(parts, *cell).sortWithinPartitions(*cell)
        found = materialize(dealt_.mapInArrow(across(forest), "content long, a long, b long"), "found")
        discard(cells)
        both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = materialize(found.filter("a is not null").select("a", "b").distinct().join(both, ["a", "b"], "left_anti"), "pairs")
        links = check(pairs)
        if not links.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        tried = tried.unionByName(pairs)
        # what a block did not send is looked at again
        more = found.filter("a is null").select("content").distinct()
        if more.isEmpty():
            break
        left = shared.join(more, "content", "left_semi")
    for done in (met_, wanted, sets):
        discard(done)
    return roots


def join_documents(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of each row (percent: 75 or more)."""
    if percent < 75:
        raise ValueError("blocks are dealt for a similarity of 75 percent or more")
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("t"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _BUCKET_BYTES, 16)
    buckets = min(1 << (wanted - 1).bit_length(), 1 << (_CONTENT_BITS - 32))
    counted_ = materialize(texts.mapInArrow(dealt(n, buckets), DEALT).groupBy("bucket").applyInArrow(counted, COUNTED), "counted")
    rows = counted_.filter("rank is null").select("doc_id", "n_shingles", "k")
    # one row a set: a group of equal sets meets its component once
    sets = counted_.filter("rank is null and k is not null").groupBy("set", "k")
    sets = sets.agg(F.first("n_shingles").cast("int").alias("size"), F.min("t").alias("t"), F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1"), F.min("doc_id").alias("least"))
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "known")
    met = materialize(candidates(counted_, sets), "met")
    roots = similar_sets(met, sets.select("id", "k", "t"), texts.select("t", "text"), n, percent)
    discard(met)
    named = sets.join(roots, F.col("id") == F.col("node"), "left").select("k", "least", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    full = rows.filter("k is not null").join(named.join(least, "root").select("k", "component_id"), "k").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.filter("k is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
