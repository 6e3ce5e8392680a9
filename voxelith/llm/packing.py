"""Best-fit packing after Martello-Toth dominance reduction.

A document is its token ids and then id 1.  Documents longer than the capacity are cut
into full pieces and a rest.  What has to be packed is the number of pieces of each
length: at most ``capacity`` counters whatever the input, so the packing itself is
planned on the driver, in bulk, and its plan (rank ranges of each length) is sent back.

1. Reduction: for the longest remaining length j, find the set that dominates all others
   which could share a sequence with j (no other piece, one, or two more) and fix it.
2. Best fit of the remainder, longest first, into the fullest sequence that has room.

Null text is empty (one piece: id 1).  Repeated rows are packed as rows of their own.
Empty table: no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, materialize, ranges, string_buffer, trimmed

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_CACHE: dict[str, dict] = {}
_CACHE_WORDS = 500_000
_RANK_BITS = 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of texts by way of the distinct parts of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in order.  It lower-cases, and takes letters and digits apart from other
    marks: a word that ends in ASCII marks behind an ASCII letter or digit has the ids of
    both parts.  (Apostrophes belong to contractions, and special strings hold bars and
    are told apart by case, so words with either are parts of their own.)  Each distinct
    part is tokenized once while it is remembered, new ones in one go with a mark between
    them that has one id.
    """

    MARK = "|"
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def learn(self, new: pa.Array) -> None:
        marked = pc.match_substring(new, self.MARK)
        plain, odd = new.filter(pc.invert(marked)), new.filter(marked)
        parts, sizes = [], []
        for k in range(0, len(plain), 20_000):
            some = plain.slice(k, 20_000)
            text = f" {self.MARK} ".join(some.to_pylist())
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(ids == self.mark[0])
            sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            parts.append(ids[ids != self.mark[0]])
        for e in self.tokenizer.encode_batch(odd.to_pylist(), add_special_tokens=False):
            parts.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        self.known = pa.concat_arrays([self.known, plain, odd])
        self.flat = np.concatenate([self.flat, *parts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The two parts of each word; the second may be empty."""
        whole = pc.match_substring_regex(words, "['|]")
        low = pc.if_else(whole, words, pc.ascii_lower(words))
        base = pc.ascii_rtrim(low, characters=self.TAIL)
        base = pc.if_else(pc.and_(pc.invert(whole), pc.match_substring_regex(base, "[a-z0-9]$")), base, low)
        raw, offsets = string_buffer(low)
        size = np.asarray(pc.binary_length(base), dtype=np.int64)
        rest = np.diff(offsets) - size
        ends = np.concatenate([[0], np.cumsum(rest)])
        tail = pa.LargeStringArray.from_buffers(len(rest), pa.py_buffer(ends), pa.py_buffer(raw[ranges(offsets[:-1] + size, rest)]))
        return base, tail

    def codes(self, parts: pa.Array) -> np.ndarray:
        """The number of each part; those not known are learnt."""
        parts = parts.dictionary_encode()
        found = pc.index_in(parts.dictionary, value_set=self.known)
        if found.null_count:
            self.learn(parts.dictionary.filter(pc.is_null(found)))
            found = pc.index_in(parts.dictionary, value_set=self.known)
        return np.asarray(found, dtype=np.int64)[np.asarray(parts.indices)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        if len(self.known) > _CACHE_WORDS:
            self.forget()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        code = self.codes(pa.concat_arrays(self.parts(words.dictionary))).reshape(2, -1).T.ravel()
        # the ids of each distinct word of these texts, then of all words
        sizes = (self.ends[1:] - self.ends[:-1])[code]
        flat = self.flat[ranges(self.ends[code], sizes)]
        sizes = sizes[::2] + sizes[1::2]
        first = np.cumsum(sizes) - sizes
        word = np.asarray(words.indices)
        before = np.concatenate([[0], np.cumsum(sizes[word])])
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        return flat[ranges(first[word], sizes[word])], before[offsets[1:]] - before[offsets[:-1]]


def words_of(path: str) -> Words:
    if path not in _CACHE:
        _CACHE[path] = Words(path)
    return _CACHE[path]


def cut(path: str, capacity: int):
    """mapInArrow function: (doc_id, text) to rows of PIECES.

    ``local`` numbers the pieces of a length within the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches_by_bytes(batches, "text", 4 << 20):
            ids, sizes = words(batch.column(1))
            ends = np.cumsum(sizes + 1)
            own = np.full(len(ids) + len(sizes), END_ID, "<u4")
            own[ranges(ends - sizes - 1, sizes)] = ids
            rows, raw = [], memoryview(own).cast("B")
            for doc_id, n, end in zip(batch.column(0).to_pylist(), (sizes + 1).tolist(), ends.tolist(), strict=True):
                for k, s in enumerate(range(0, n, capacity)):
                    length, at = min(capacity, n - s), 4 * (end - n + s)
                    rows.append((doc_id, k, s, length, zlib.crc32(raw[at : at + 4 * length]), part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return trimmed(run)


def reduce(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix dominating sets; ``counts`` keeps the remainder.

    Returns (number of sequences, [(length, pieces of it in each)]).  Every step fixes as
    many equal sets at once as there are pieces for; the conditions stay true meanwhile,
    as taking pieces away only leaves fewer alternatives.
    """
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    sizes = sorted(s for s, n in counts.items() if n > 0)

    def left(s: int, but: int) -> int:
        return counts[s] - (s == but)

    def take(q: int, parts: list[int]) -> None:
        need: dict[int, int] = {}
        for s in parts:
            need[s] = need.get(s, 0) + 1
        q = min([q, *(counts[s] // n for s, n in need.items())])
        for s, n in need.items():
            counts[s] -= q * n
            if not counts[s]:
                del sizes[bisect_left(sizes, s)]
        fixed.append((q, sorted(need.items(), reverse=True)))

    def smallest(j: int, above: int, want: int) -> list[int]:
        """The ``want`` smallest pieces longer than ``above``, one j left aside."""
        out: list[int] = []
        for s in sizes[bisect_left(sizes, above + 1) :]:
            out += [s] * min(left(s, j), want - len(out))
            if len(out) == want:
                break
        return out

    def largest(j: int, room: int) -> int | None:
        k = bisect_left(sizes, room + 1) - 1
        while k >= 0 and left(sizes[k], j) < 1:
            k -= 1
        return sizes[k] if k >= 0 else None

    def best_pair(j: int, room: int) -> tuple[int, int] | None:
        free = [s for s in sizes[: bisect_left(sizes, room + 1)] if left(s, j) >= 1]
        lo, hi, best = 0, len(free) - 1, None
        while lo < hi or (lo == hi and left(free[lo], j) >= 2):
            a, b = free[hi], free[lo]
            if a + b > room:
                hi -= 1
                continue
            if best is None or a + b > sum(best):
                best = (a, b)
            lo += 1
        return best

    j = sizes[-1] if sizes else 0
    while j:
        room, few = capacity - j, smallest(j, 0, 3)
        top = largest(j, room)
        if top is None:
            take(counts[j], [j])
        elif top == room or len(few) < 2 or few[0] + few[1] > room:
            take(counts[j], [j, top])
        elif len(few) < 3 or sum(few) > room:
            pair = best_pair(j, room)
            if pair is None or top >= sum(pair):
                take(counts[j], [j, top])
            else:
                above = smallest(j, pair[1], 2)
                if top == pair[0] and (len(above) < 2 or sum(above) > room):
                    take(counts[j], [j, *pair])
                else:
                    j = next((s for s in reversed(sizes[: bisect_left(sizes, j)])), 0)
                    continue
        else:
            j = next((s for s in reversed(sizes[: bisect_left(sizes, j)])), 0)
            continue
        if j not in counts or counts[j] == 0:
            j = next((s for s in reversed(sizes[: bisect_left(sizes, j)])), 0)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, in bulk: sequences with equal contents are one entry."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    done = []

    def put(room: int, n: int, parts: list[tuple[int, int]]) -> None:
        if not room:
            done.append((n, parts))
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((n, parts))

    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n = counts[s]
        while n:
            k = bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms[k]
                have, parts = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, have, parts = capacity, n, []
            each = min(room // s, n)
            full = min(have, n // each)
            put(room - each * s, full, [*parts, (s, each)])
            n -= full * each
            if parts and have > full:
                put(room, have - full, parts)
    return done + [x for group in open_.values() for x in group]


def assign(groups: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Rank ranges of each length: key (length and first rank), sequence, pieces in each, offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for n, parts in groups:
        offset = 0
        for s, each in parts:
            lo = next_rank.get(s, 0)
            next_rank[s] = lo + n * each
            rows.append(((s << _RANK_BITS) + lo, sequence, each, offset))
            offset += s * each
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))


def place(plan) -> object:
    """mapInArrow function: PIECES with a rank to PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, each, offset = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            k = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            i = (length << _RANK_BITS) + rank - keys[k]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(sequence[k] + i // each[k]), pa.array(offset[k] + i % each[k] * length)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    pieces = materialize(pieces.mapInArrow(cut(tokenizer or tokenizer_path(), capacity), PIECES), "pieces")
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most ``capacity`` counters come to the driver
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], PACKED)
    plan = assign(reduce(counts, capacity) + best_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = pieces.join(cells, ["length", "part"]).withColumn("rank", F.col("local") + F.col("skip"))
    # bounded by the lengths there can be, not by the input
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place(spark.sparkContext.broadcast(plan)), PACKED)
