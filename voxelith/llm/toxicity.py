"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and unlabelled
texts (U) under the risk  pi*E_P[l(+)] + max(0, E_U[l(-)] - pi*E_P[l(-)])  with the
logistic loss; pi is the class prior.  When the bracket falls below zero its gradient is
climbed instead, so the classifier cannot fit the unlabelled positives as negatives.

Features are words and the beginnings and ends of words (lower case), as 64-bit hashes;
a text has each once.  Whole texts are read, in training and in scoring.

Training reads a bounded sample: at most ``SAMPLE_P`` and ``SAMPLE_U`` texts, those of least
hash, and ``FEATURES`` features come to the driver.  Everything else covers all rows.

Null or empty text: the score of a text without features.  Null doc_id: held out.
Repeated rows: equal scores.  Very long
texts are read whole, like others.  A label row without document, or with null label, is left
out; if labels of a doc_id differ, it counts as toxic.  Empty table: no rows.  Without
any usable toxic label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, batches_by_bytes, materialize, string_buffer, trimmed

SAMPLE_P = 3000
SAMPLE_U = 9000
FEATURES = 3000
LEAST_P = 5
FOLDS = 5
BEGINNINGS, ENDS = (3, 4, 5, 6, 8), (4, 6)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) pairs of lower-cased texts; a pair may occur repeatedly."""
    raw, offsets = string_buffer(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    letter = np.zeros(len(raw) + 1, bool)
    letter[:-1] = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins[offsets[:-1]] = letter[offsets[:-1]]
    starts = np.flatnonzero(begins)
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    inner = inner[inner > 0]
    stops[inner - 1] = letter[inner - 1]
    ends = np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    hashed = PrefixHash(raw)
    n = ends - starts
    out, of = [hashed(starts, ends)], [rows]
    for k, (size, begin) in enumerate([*((b, True) for b in BEGINNINGS), *((e, False) for e in ENDS)]):
        long = n >= size
        s = starts[long] if begin else ends[long] - size
        out.append(hashed(s, s + size) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        of.append(rows[long])
    return np.concatenate(of), np.concatenate(out)


class Chosen:
    """Which features count: membership by a bitmap first, then by search."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.sort(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.order >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of a chosen feature), each pair once."""
        rows, hashes = features(texts)
        may = self.bits[(hashes >> np.uint64(42)).astype(np.int64)]
        rows, hashes = rows[may], hashes[may]
        k = np.minimum(np.searchsorted(self.order, hashes), max(len(self.order) - 1, 0))
        same = self.order[k] == hashes if len(self.order) else np.zeros(len(hashes), bool)
        pairs = np.unique(rows[same] * len(self.order) + k[same])
        return (pairs // max(len(self.order), 1), pairs % max(len(self.order), 1))


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, texts of P, texts of U) of each batch."""
    for batch in batches_by_bytes(batches, "text"):
        rows, hashes = features(batch.column(0))
        order = np.lexsort((rows, hashes))
        rows, hashes = rows[order], hashes[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[once], hashes[once]
        positive = np.asarray(batch.column(1), dtype=np.int64)[rows]
        which, first = np.unique(hashes, return_index=True)
        if not len(which):
            continue
        p = np.add.reduceat(positive, first)
        n = np.diff(np.append(first, len(hashes)))
        yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(p), pa.array(n - p)], ["feature", "p", "u"])


def extract(hashes: np.ndarray):
    chosen = Chosen(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            rows, k = chosen(batch.column(0))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(k.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["toxic", "found"])

    return trimmed(run)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, steps: int = 250, rate: float = 0.05, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk, by Adam over the whole sample."""

    def layout(rows):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) and sizes.sum() else np.zeros(0, np.int64)
        return flat.astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)

    sets = [layout(positive), layout(unlabelled)]
    w, b = np.zeros(n), -np.log((1 - prior) / prior)
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for t in range(1, steps + 1):
        z = [np.bincount(rows, w[flat], minlength=k) + b for flat, rows, k in sets]
        bracket = np.mean(np.logaddexp(0, z[1])) - prior * np.mean(np.logaddexp(0, z[0]))
        up, un = sigmoid(z[0]), sigmoid(z[1])
        if bracket >= 0:
            dp, du = prior * (up - 1) - prior * up, un
        else:
            dp, du = prior * up, -un
        g = np.full(n + 1, 0.0)
        for d, (flat, rows, k) in zip((dp, du), sets, strict=True):
            g[:n] += np.bincount(flat, d[rows] / k, minlength=n)
            g[n] += d.sum() / k
        g[:n] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes in order, weights, bias)."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["toxic"].alias("toxic"))
        .filter(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    none = np.zeros(0, np.uint64), np.zeros(0), -40.0
    if not sizes["p"]:
        return none
    prior = min(max(sizes["p"] / sizes["n"], 0.01), 0.9)
    place = F.pmod(F.xxhash64(F.lit(7), F.col("label_id")), F.lit(1 << 30)) / float(1 << 30)
    ids = known.filter((F.col("toxic") == 1) & (place < SAMPLE_P / sizes["p"])).orderBy(place, "label_id").limit(SAMPLE_P).select("label_id")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")).filter(~held_out(F.col("id")))
    # at most SAMPLE_P ids: a fixed bound, so they may be broadcast
    p = texts.join(F.broadcast(ids), F.col("id") == F.col("label_id")).select("text", F.lit(1).cast("long").alias("toxic"))
    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit(11), F.col("id"), F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    u = texts.filter(share < SAMPLE_U / max(n, 1)).orderBy(share, "id", "text").limit(SAMPLE_U).select("text", F.lit(0).cast("long").alias("toxic"))
    sample = materialize(p.unionByName(u).repartition(12), "toxicity-sample")
    counts = sample.mapInArrow(trimmed(count), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not got.get(1) or not got.get(0):
        return none
    lift = F.log2((F.col("p") + 0.5) / (got[1] + 1.0)) - F.log2((F.col("u") + 0.5) / (got[0] + 1.0))
    best = counts.filter(F.col("p") + F.col("u") >= LEAST_P).orderBy(F.desc(F.abs(lift) * F.sqrt(F.col("p") + prior * F.col("u"))), "feature").limit(FEATURES)
    hashes = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))
    rows = sample.mapInArrow(extract(hashes), "toxic long, found array<int>").collect()
    sets = [[np.array(r["found"], np.int64) for r in rows if r["toxic"] == y] for y in (1, 0)]
    return hashes, *train(*sets, len(hashes), prior)


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = model.value
        chosen = Chosen(hashes)
        for batch in batches_by_bytes(batches, "text"):
            rows, k = chosen(batch.column(batch.schema.get_field_index("text")))
            z = np.bincount(rows, weights[k], minlength=batch.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "toxicity"])

    return trimmed(run)


def score_documents(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs (text among them) with ``toxicity``, a score from 0 to 1."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))  # FEATURES hashes and weights at most
    rows = docs.select(*(docs[c] for c in columns))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", toxicity double"
    return rows.mapInArrow(scorer(model), schema)
