"""Shared helpers: table access, cut lineage, string buffers and byte hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most 1000 rows and 16 MB: they bound the memory of a worker and its JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process (tests) a local folder is made;
    on a cluster its files would stay on single machines.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    got = spark.conf.get("voxelith.local.checkpoint", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="voxelith-")
        spark.conf.set("voxelith.local.checkpoint", got)
    return got


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files do not live on an executor, so losing one costs nothing that was written.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/voxelith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a materialized frame's files once nothing reads them any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/voxelith/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(run):
    """A mapInArrow function that gives freed memory back to the system when it ends.

    Workers are used again; what one stage's arrays took must not sit beside the next stage.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library keeps its own ways

    return wrapped


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one buffer, and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches_by_bytes(batches, column: str, limit: int = 2 << 20):
    """Re-cut Arrow batches so that each holds about ``limit`` bytes of ``column``.

    A longer single text is a batch of its own; texts are never cut.
    """
    for batch in batches:
        t = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if not len(t):
            continue
        offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        at = 0
        while at < len(t):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


_TABLE = np.random.default_rng(20240601).integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


_KEPT: dict[int, np.ndarray] = {}
_KEPT_LENGTH = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1); short lists are views of one that is kept."""
    if n <= _KEPT_LENGTH:
        if int(base) not in _KEPT:
            _KEPT[int(base)] = np.cumprod(np.append(np.uint64(1), np.full(_KEPT_LENGTH - 1, base)), dtype=np.uint64)
        return _KEPT[int(base)][:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PrefixHash:
    """Hashes of any substring of a byte buffer in O(1), vectorised.

    hash(s, e) = sum of table[byte] * base^k over the substring, modulo 2^64, then mixed.
    """

    def __init__(self, raw: np.ndarray, which: int = 0):
        n = len(raw)
        base = _BASE[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[which][raw] * _powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.down = _powers(inverse, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i], starts[i]+1, ... (lengths[i] of them)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


class Bitmap:
    """A set of 64-bit hashes by their top bits: no member is missed, others may pass.

    Its size is fixed, so it may be broadcast; over very large inputs it passes more.
    """

    BITS = 25

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        k = h.view(np.uint64) >> np.uint64(64 - self.BITS)
        return (self.words[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) == 1

    @classmethod
    def of(cls, df: DataFrame, column: str) -> np.ndarray:
        """Words of the bitmap of a long column; as many rows at most come to the driver."""
        k = F.shiftrightunsigned(F.col(column), 64 - cls.BITS)
        bits = df.select(F.shiftright(k, 6).cast("int").alias("word"), (F.pmod(k, F.lit(64))).cast("int").alias("bit"))
        words = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
        out = np.zeros(1 << (cls.BITS - 6), np.uint64)
        out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
        return out
