"""Removal of repeated byte strings by a multi-document suffix structure.

A byte goes if some ``width``-byte string that covers it also starts anywhere else in
the collection (same document included; matches never cross documents).

Construction.  Every start of a ``width``-byte window belongs to an anchor: the window's
``ANCHOR``-gram of least hash.  Equal windows have equal anchors at equal places, so only
windows under one anchor hash need comparing, and anchors that occur once need nothing.
The starts under an anchor occurrence form one segment.  Equal segments are kept once,
with a count.  Over the segments of an anchor the collection's Burrows-Wheeler transform
and common prefixes are built column by column: round 0 holds the sorted tails, and each
round inserts one symbol per segment, in front of what was inserted before.  The lists
live in external files that every round reads and writes from front to back.  A start
repeats if its suffix shares ``width`` symbols with a neighbour in the list, or if its
segment has a count over one.

A collection of more than ``HOT_SEGMENTS`` different segments is not gathered in one task.
It is dealt by longer contexts: equal windows hold the anchor at equal places, so the starts
that lie ``low`` to ``low + span - 1`` bytes before it are a collection of their own for each
text of the ``width - span + 1`` bytes that all their windows share.  These narrower segments
go through the same construction; ``span`` falls to a quarter until every collection fits, and
at span 1 a collection is one window, kept once with its count.  A collection's lists hold at
most HOT_SEGMENTS * (width - ANCHOR + 1) rows of 8 bytes, whatever the corpus.  The folder of
its lists is local to the task that builds it; a task run again builds them again.

Null text: no bytes.  Texts shorter than ``width`` lose nothing.  Repeated rows are
documents of their own (so they remove each other).  doc_id may be null.  Empty table: no
rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, PrefixHash, batches_by_bytes, discard, materialize, mix, ranges, string_buffer, trimmed

ANCHOR = 50
HOT_SEGMENTS = 20_000
COLLECTION = 6_000
_POSITION_BITS = 24
#: Bytes of text whose arrays are worked on at once: few enough to stay in a core's cache.
_AT_ONCE = 128 << 10
_LONGEST = 8 << 20


# ---------------------------------------------------------------- anchors


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(hash, anchor place, first start, end of starts) of every segment in the buffer.

    The buffer is shorter than 2^24 bytes; of equal hashes in a window the first counts.
    """
    n, span = len(raw), width - ANCHOR + 1
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(n - ANCHOR + 1)
    hashes = PrefixHash(raw)(at, at + ANCHOR)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    starts = ranges(offsets[:-1], np.maximum(np.diff(offsets) - width + 1, 0))
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    place = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # least hashes crowd the low end of their range; mixed again, they fill it evenly
    return mix(hashes[place[first]]).view(np.int64), place[first], starts[first], starts[last] + 1


def buffers(batch: pa.RecordBatch, width: int):
    """(raw, offsets, row of each part, start of each part in its text) under 2^24 bytes.

    A longer text comes in parts that overlap by width - 1 bytes: no window is lost and
    none comes twice.
    """
    raw, offsets = string_buffer(batch.column(batch.schema.get_field_index("text")))
    if len(raw) <= 2 * _LONGEST:
        yield raw, offsets, np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        return
    for row in range(batch.num_rows):
        for s in range(int(offsets[row]), int(offsets[row + 1]), _LONGEST):
            e = min(s + _LONGEST + width - 1, int(offsets[row + 1]))
            yield raw[s:e], np.array([0, e - s]), np.array([row]), np.array([s - offsets[row]])


def anchor_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", _AT_ONCE):
            for raw, offsets, _, _ in buffers(batch, width):
                h, n = np.unique(anchors(raw, offsets, width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return trimmed(run)


OCCURRENCES = "t1 long, t2 long, h long, x1 long, x2 long, at long, before int, judged int"


def occurrences(width: int, bitmap):
    """Segments under anchors that may occur twice.

    ``at``: the anchor's place in its text, ``before``: bytes from the first start to it,
    ``judged``: how many starts the segment has; x1, x2: hash of the segment's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bitmap(bitmap.value)
        for batch in batches_by_bytes(batches, "text", _AT_ONCE):
            t1, t2 = (np.asarray(batch.column(c)) for c in ("t1", "t2"))
            for raw, offsets, rows, base in buffers(batch, width):
                h, at, lo, hi = anchors(raw, offsets, width)
                keep = may(h)
                h, at, lo, hi = h[keep], at[keep], lo[keep], hi[keep]
                part = np.searchsorted(offsets, lo, "right") - 1
                row = rows[part]
                end = np.minimum(at + width, offsets[part + 1])
                x = [PrefixHash(raw, k)(lo, end).view(np.int64) for k in (0, 1)]
                cols = [t1[row], t2[row], h, *x, at - offsets[part] + base[part], (at - lo).astype(np.int32), (hi - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "h", "x1", "x2", "at", "before", "judged"])

    return trimmed(run)


# ---------------------------------------------------------------- construction


class External:
    """A list in a file; each round writes its successor front to back, then drops it.

    The successor is a new file: writing over one, or renaming onto it, would wait for the disk.
    """

    def __init__(self, folder: str, name: str, kind):
        self.path, self.kind, self.turn = os.path.join(folder, name), np.dtype(kind), 0

    def write(self, values: np.ndarray) -> None:
        values.astype(self.kind, copy=False).tofile(f"{self.path}.{self.turn + 1}")
        if self.turn:
            os.unlink(f"{self.path}.{self.turn}")
        self.turn += 1

    def read(self) -> np.ndarray:
        return np.fromfile(f"{self.path}.{self.turn}", self.kind)


def repeated_starts(data: np.ndarray, begin: np.ndarray, before: np.ndarray, size: np.ndarray, width: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) pairs whose ``width`` bytes occur under another start.

    Segment i is data[begin[i] : begin[i] + size[i]]; its tail starts ``before[i]`` bytes
    in.  A list row is a suffix of a segment; per row the lists hold the segment, the
    symbol in front of it (-1: not yet inserted) and the symbols it shares with the row
    above.  A suffix that shares too little with both neighbours to reach ``width`` in the
    rounds its segment has left, has no partner from there on: its segment is finished,
    and the rows of finished segments leave the lists.
    """
    m = len(begin)
    tail_size = size - before
    tails = np.zeros((m, -(-width // 8) * 8), np.uint8)
    columns = np.arange(width)
    inside = columns[None, :] < tail_size[:, None]
    source = (begin + before)[:, None] + columns[None, :]
    tails[:, :width][inside] = data[source[inside]]
    words = tails.view(">u8")
    order = np.lexsort((tail_size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    sorted_tails = tails[order]
    differ = sorted_tails[1:, :width] != sorted_tails[:-1, :width]
    shared = np.zeros(m + 1, np.int64)
    if m > 1:
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[1:-1] = np.minimum(first, np.minimum(tail_size[order[1:]], tail_size[order[:-1]]))
    best = np.zeros(m, np.int64)
    best[order] = np.maximum(shared[:-1], shared[1:])
    found = [(np.flatnonzero(best >= width), 0)]
    going = (best + before >= width) & (before > 0)
    segment, front, common = (External(folder, n, k) for n, k in (("segment", "i4"), ("front", "i2"), ("common", "u2")))
    place = np.full(m, -1, np.int64)

    def write(s: np.ndarray, f: np.ndarray, c: np.ndarray) -> None:
        """Write the lists, without rows of finished segments once those are many."""
        stay = going[s]
        if 10 * stay.sum() < 7 * len(s):
            rows = np.flatnonzero(stay)
            if len(rows):
                c = np.minimum.reduceat(c[: rows[-1] + 1], np.concatenate([[0], rows[:-1] + 1]))
            else:
                c = c[:0]
            moved = np.cumsum(stay) - 1
            live = np.flatnonzero(going)
            place[live] = moved[place[live]]
            s, f = s[rows], f[rows]
        segment.write(s)
        front.write(f)
        common.write(c)

    place[order] = np.arange(m)
    write(order, np.full(m, -1, np.int16), shared[:-1].astype(np.uint16))
    for r in range(1, int(before.max(initial=0)) + 1):
        live = np.flatnonzero(going & (before >= r))
        if not len(live):
            break
        s, f, c = segment.read(), front.read(), common.read()
        rows = place[live]
        f[rows] = data[begin[live] + before[live] - r]
        # all rows with a symbol, by symbol, then by row: the order of the suffixes after insertion
        held = np.flatnonzero(f >= 0)
        by = held[np.argsort(f[held].astype(np.uint8), kind="stable")]
        rank = np.empty(len(f), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        k = rank[rows].astype(np.int64)
        c = np.append(c, np.uint16(0))

        def least(upper: np.ndarray, lower: np.ndarray, c=c) -> np.ndarray:
            """Symbols shared by list rows upper < lower."""
            turn = np.argsort(upper, kind="stable")
            pairs = np.empty(2 * len(turn), np.int64)
            pairs[0::2], pairs[1::2] = upper[turn] + 1, lower[turn] + 1
            out = np.empty(len(turn), np.int64)
            out[turn] = np.minimum.reduceat(c, pairs)[0::2] if len(turn) else []
            return out

        def with_above(k: np.ndarray, by=by, f=f) -> np.ndarray:
            """What the suffix of rank k shares with the one above it."""
            out = np.zeros(len(k), np.int64)
            has = np.flatnonzero(k > 0)
            same = has[f[by[k[has] - 1]] == f[by[k[has]]]]
            out[same] = 1 + least(by[k[same] - 1], by[k[same]])
            return out

        # rows of tails come first; the others are extensions of the rows in ``by``
        ends = len(f) - (len(held) - len(live))
        new_place = ends + k
        total = ends + len(by)
        old = np.ones(total, bool)
        old[new_place] = False
        fresh = ~old[ends:]
        out = np.zeros(total, np.uint16)
        out[old] = c[:-1]
        out[new_place] = with_above(k)
        below = k[k + 1 < len(by)] + 1
        below = below[~fresh[below]]
        out[ends + below] = with_above(below)
        new_s, new_f = np.empty(total, np.int32), np.full(total, -1, np.int16)
        new_s[old], new_s[new_place] = s, live
        new_f[old] = f
        place[live] = new_place
        best = np.maximum(out[new_place], np.append(out, np.uint16(0))[new_place + 1]).astype(np.int64)
        found.append((live[best >= width], r))
        going[live] = (best + before[live] >= width + r) & (before[live] > r)
        write(new_s, new_f, out)
    which = np.concatenate([x for x, _ in found])
    return which, before[which] - np.concatenate([np.full(len(x), r) for x, r in found])


SEGMENTS = "h long, x1 long, x2 long, n long, before int, judged int, body binary"
VERDICTS = "h long, x1 long, x2 long, spans array<struct<lo:int,hi:int>>"


def runs(which: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lo, hi) of maximal runs of starts."""
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1
    return which[first], start[first], (start[last] + 1 if len(first) else start[:0])


def construct(width: int):
    """mapInArrow over SEGMENTS sorted by h: builds each collection, yields VERDICTS.

    Spans are starts relative to the anchor.
    """

    def judge(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[:3]: r for r in rows}.values())  # a text that several tasks sent comes once
        body = b"".join(r[6] for r in rows)
        data = np.frombuffer(body, np.uint8)
        size = np.array([len(r[6]) for r in rows], np.int64)
        n, before, judged = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        with tempfile.TemporaryDirectory() as folder:
            which, start = repeated_starts(data, np.cumsum(size) - size, before, size, width, folder)
        keep = (start < judged[which]) & (n[which] < 2)
        many = np.flatnonzero(n >= 2)
        which = np.concatenate([which[keep], np.repeat(many, judged[many])])
        start = np.concatenate([start[keep], ranges(np.zeros(len(many), np.int64), judged[many])])
        which, lo, hi = runs(which, start)
        return verdicts(rows, which, lo - before[which], hi - before[which])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= COLLECTION and row[0] != rows[-1][0]:
                    if out := judge(rows):
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := judge(rows)):
            yield out

    return trimmed(run)


def verdicts(rows: list[tuple], which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch | None:
    if not len(which):
        return None
    new = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    spans = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["lo", "hi"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(which)).astype(np.int32)), spans)
    keys = [pa.array([rows[i][k] for i in which[new]], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*keys, lists], ["h", "x1", "x2", "spans"])


# ---------------------------------------------------------------- assembly


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit hash of the text: equal texts have equal verdicts."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))


def listed_texts(bitmap):
    """Texts whose key the bitmap may hold, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, sent = Bitmap(bitmap.value), set()
        for batch in batches:
            t1, t2 = np.asarray(batch.column("t1")), np.asarray(batch.column("t2"))
            rows = []
            for i in np.flatnonzero(may(t1)):
                key = (t1[i], t2[i])
                if key not in sent:
                    sent.add(key)
                    rows.append(i)
            if rows:
                yield batch.take(pa.array(rows))

    return trimmed(run)


def split_texts(bitmap, listed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bitmap(bitmap.value)
        for batch in batches:
            keep = may(np.asarray(batch.column("t1")))
            yield batch.filter(pa.array(keep if listed else ~keep))

    return trimmed(run)


def cut_segments(width: int):
    """(text, wanted segments) to SEGMENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer()
                body = memoryview(raw)
                for w in wanted:
                    lo, hi = w["at"] - w["before"], w["at"] + width
                    for k, v in enumerate((w["h"], w["x1"], w["x2"], w["n"], w["before"], w["judged"], bytes(body[lo:hi]))):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "x1", "x2", "n", "before", "judged", "body"])

    return trimmed(run)


NARROWED = "p_h long, p_x1 long, p_x2 long, low int, " + SEGMENTS


def narrowed(width: int, span: int):
    """SEGMENTS to their parts by distance from the tail, each under the bytes its windows share.

    A part's tail starts ``low`` bytes before that of its parent (p_h, p_x1, p_x2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bodies = batch.column("body").to_pylist()
            size = np.array([len(b) for b in bodies], np.int64)
            data = b"".join(bodies)
            raw, begin = np.frombuffer(data, np.uint8), np.cumsum(size) - size
            before, judged = (np.asarray(batch.column(c)).astype(np.int64) for c in ("before", "judged"))
            nearest = before - judged + 1
            first = nearest // span
            pieces = before // span - first + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            low = ranges(first, pieces) * span
            far = np.minimum(low + span - 1, before[row])
            near = np.maximum(low, nearest[row])
            tail = begin[row] + before[row] - low
            lo, hi = begin[row] + before[row] - far, np.minimum(tail + width, (begin + size)[row])
            hashes = [PrefixHash(raw, k) for k in (0, 1)]
            parent = np.asarray(batch.column("h")).view(np.uint64)[row]
            h = mix(hashes[0](tail, tail + width - span + 1) ^ mix(parent + low.astype(np.uint64)))
            shape = ((far - low) * width + far - near).astype(np.uint64)
            x1, x2 = mix(hashes[0](lo, hi) ^ mix(shape)), hashes[1](lo, hi)
            own = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            cols = [
                *(batch.column(c).take(pa.array(row)) for c in ("h", "x1", "x2")), pa.array(low.astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (h, x1, x2)),
                batch.column("n").take(pa.array(row)), pa.array((far - low).astype(np.int32)), pa.array((far - near + 1).astype(np.int32)), pa.array(own, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in NARROWED.split(", ")])

    return trimmed(run)


def finish(width: int):
    """(doc_id, text, spans of starts or null) to the result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            raw, offsets = string_buffer(batch.column(1))
            spans = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            out = []
            for i, own in enumerate(spans):
                text = memoryview(raw[offsets[i] : offsets[i + 1]])
                digest, removed, n, at = hashlib.sha256(), 0, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"] + width - 1) for s in own or ()):
                    if lo > end:
                        digest.update(text[at:lo])
                        n += 1
                        removed += hi - lo
                    elif hi > end:
                        removed += hi - end
                    end = max(end, hi)
                    at = end
                digest.update(text[at:])
                out.append((len(text), removed, n, digest.hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return trimmed(run)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


KEY = ["h", "x1", "x2"]


def with_kinds(segments: DataFrame) -> DataFrame:
    """Segments of collections with more than one member, with the count of different ones."""
    kinds = segments.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("different")).filter("total > 1")
    return segments.join(kinds, "h")


def alone(segments: DataFrame) -> DataFrame:
    """VERDICTS of segments without another in their collection: repeated as a whole."""
    whole = F.struct((-F.col("before")).alias("lo"), (F.col("judged") - F.col("before")).alias("hi"))
    return segments.filter("different = 1").select(*KEY, F.array(whole).alias("spans"))


def built(bodies: DataFrame, width: int) -> DataFrame:
    """VERDICTS of SEGMENTS whose collections fit a task."""
    parts = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bodies.repartition(parts, "h").sortWithinPartitions(*KEY).mapInArrow(construct(width), VERDICTS)


def built_narrower(hot: DataFrame, width: int, span: int) -> DataFrame:
    """VERDICTS of SEGMENTS in larger collections, from collections of ``span`` distances."""
    cut = materialize(hot.mapInArrow(narrowed(width, span), NARROWED), "narrowed")
    kids = cut.groupBy(*KEY, "before", "judged").agg(F.sum("n").alias("n"), F.first("body").alias("body"))
    kids = materialize(with_kinds(kids), "parts")
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    # at span 1 the segments of a collection are equal, so there is nothing left to deal
    large = (F.col("different") > HOT_SEGMENTS) & F.lit(span > 1)
    verdict = alone(kids).unionByName(built(kids.filter((F.col("different") > 1) & ~large).select(*columns), width))
    more = kids.filter((F.col("different") > 1) & large).select(*columns)
    if not more.isEmpty():
        verdict = verdict.unionByName(built_narrower(more, width, -(-span // 4)))
    back = cut.select("p_h", "p_x1", "p_x2", "low", *KEY).join(verdict, KEY).select(
        F.col("p_h").alias("h"), F.col("p_x1").alias("x1"), F.col("p_x2").alias("x2"),
        F.explode(F.transform("spans", lambda s: F.struct((s["lo"] - F.col("low")).alias("lo"), (s["hi"] - F.col("low")).alias("hi")))).alias("s"),
    )
    verdict = materialize(back.groupBy(*KEY).agg(F.collect_list("s").alias("spans")), "verdicts")
    discard(cut)
    discard(kids)
    return verdict


def repeated_spans(docs: DataFrame, width: int = 200) -> DataFrame:
    """(t1, t2, spans of repeated starts) of every text that has any."""
    spark = docs.sparkSession
    texts, share = keyed(docs), spark.sparkContext.broadcast
    counts = texts.select("text").mapInArrow(anchor_counts(width), "h long, n long")
    twice = materialize(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "anchors")
    found = texts.select("text", "t1", "t2").mapInArrow(occurrences(width, share(Bitmap.of(twice, "h"))), OCCURRENCES)
    found = materialize(found, "occurrences")
    discard(twice)
    # equal segments once, with a count and one place where their bytes can be read
    segments = found.groupBy("h", "x1", "x2", "before", "judged").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "at")).alias("place"))
    listed = materialize(segments, "segments")
    segments = with_kinds(listed)
    asked = segments.filter("different > 1").select(
        F.col("place.t1").alias("t1"), F.col("place.t2").alias("t2"), F.struct(*KEY, "n", F.col("place.at").alias("at"), "before", "judged").alias("w"), (F.col("different") > HOT_SEGMENTS).alias("hot")
    )
    asked = materialize(asked.groupBy("t1", "t2", "hot").agg(F.collect_list("w").alias("wanted")), "asked")
    sources = texts.select("t1", "t2", "text").mapInArrow(listed_texts(share(Bitmap.of(asked, "t1"))), "t1 long, t2 long, text string")

    def bodies(hot: bool) -> DataFrame:
        return sources.join(asked.filter(F.col("hot") == hot), ["t1", "t2"]).select("text", "wanted").mapInArrow(cut_segments(width), SEGMENTS)

    verdict = materialize(alone(segments).unionByName(built(bodies(False), width)), "verdicts")
    if not asked.filter("hot").isEmpty():
        distances = width - ANCHOR + 1
        verdict = verdict.unionByName(built_narrower(bodies(True).dropDuplicates(KEY), width, -(-distances // 4)))
    discard(asked)
    discard(listed)
    marks = found.select("t1", "t2", *KEY, "at").join(verdict, KEY).select("t1", "t2", F.explode(F.transform("spans", lambda s: F.struct((s["lo"] + F.col("at")).alias("lo"), (s["hi"] + F.col("at")).alias("hi")))).alias("s"))
    marks = materialize(marks.groupBy("t1", "t2").agg(F.collect_set("s").alias("spans")), "marks")
    discard(found)
    return marks


def remove_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    marks, texts = repeated_spans(docs, width), keyed(docs)
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap.of(marks, "t1"))
    kind = "doc_id long, text string, t1 long, t2 long"
    # only texts that may have marks are shuffled
    marked = texts.mapInArrow(split_texts(bitmap, True), kind).join(marks, ["t1", "t2"], "left").select("doc_id", "text", "spans").mapInArrow(finish(width), RESULT)
    clean = texts.mapInArrow(split_texts(bitmap, False), kind).select("doc_id", "text").mapInArrow(finish(width), RESULT)
    return marked.unionByName(clean)
