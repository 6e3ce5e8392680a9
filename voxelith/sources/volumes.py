"""Volume files and synthetic volumes."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from .layouts import TYPES, Layout, layout, nrrd_fields, nrrd_layout, opened

#: Bytes of a file that a task reads at once.
SEGMENT = 16 << 20
#: Voxels of a batch.
BATCH = 1 << 18


def parse_header(raw: bytes) -> tuple[dict[str, str], int]:
    """Fields of an NRRD header (lower-case keys) and where the data start."""
    return nrrd_fields(raw)


def describe(fields: dict[str, str]) -> Layout:
    """Layout by the fields of an NRRD header; what is not scalar or colour, 2-D or 3-D is an error."""
    return nrrd_layout(fields, 0)


_ROW = pa.schema([("path", pa.string()), ("dimension", pa.int32()), ("type", pa.string()), ("components", pa.int32()), *((f"dim{a}", pa.int32()) for a in AXES), *((f"s{a}", pa.float64()) for a in AXES), *((f"o{a}", pa.int32()) for a in AXES)])
_PIECE = pa.schema([("path", pa.string()), ("type", pa.string()), ("components", pa.int32()), *((k, pa.int32()) for k in ("nx", "ny", "ox", "oy", "oz")), ("big", pa.bool_()), ("packed", pa.bool_()), ("at", pa.int64()), ("first", pa.int64()), ("voxels", pa.int64())])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path of each file: Spark lists them and does not read them here."""
    return spark.read.format("binaryFile").load(path).select("path")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, dimension, type, components, dims, spacing and origin (in voxels).

    NRRD, TIFF and NIfTI-1; only headers are read, by the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    d = layout(name, file)
                rows.append({"path": name, "dimension": d.dimension, "type": d.type, "components": d.components, **{f"dim{a}": s for a, s in zip(AXES, d.sizes, strict=True)}, **{f"s{a}": s for a, s in zip(AXES, d.spacing, strict=True)}, **{f"o{a}": s for a, s in zip(AXES, d.origin, strict=True)}})
            yield pa.RecordBatch.from_pylist(rows, _ROW)

    return _files(spark, path).mapInArrow(run, "path string, dimension int, type string, components int, dimx int, dimy int, dimz int, sx double, sy double, sz double, ox int, oy int, oz int")


def pieces(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """Rows (path, type, ..., at, first, voxels): byte ranges of at most ``segment`` bytes.

    A compressed file can only be read from its beginning, so it is one range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    d = layout(name, file)
                voxel = np.dtype(TYPES[d.type][0]).itemsize * d.components
                same = {"path": name, "type": d.type, "components": d.components, "nx": d.sizes[0], "ny": d.sizes[1], **{f"o{a}": s for a, s in zip(AXES, d.origin, strict=True)}, "big": d.big, "packed": d.packed}
                yield pa.RecordBatch.from_pylist([same | {"at": at, "first": first, "voxels": n} for at, first, n in d.cut(voxel, segment)], _PIECE)

    return _files(spark, path).mapInArrow(run, "path string, type string, components int, nx int, ny int, ox int, oy int, oz int, big boolean, packed boolean, at long, first long, voxels long")


def read_volume(spark: SparkSession, path: str, kind: str | None = None, column: str = "value", component: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """x, y, z, value of a volume, in one file or a folder of slabs.

    NRRD (raw or gzip, attached data), TIFF (uncompressed, pages as layers), NIfTI-1 (plain or
    gzip).  Byte ranges are dealt to tasks, whatever a file's size; compressed files are one
    task each.  ``kind`` forces a Spark type (labels: long).  Colour volumes give value0,
    value1, value2 unless ``component`` picks one.
    """
    head = probe(spark, path).agg(F.min("type").alias("type"), F.max("type").alias("last"), F.min("components").alias("components"), F.max("components").alias("most")).first()
    if head["type"] != head["last"] or head["components"] != head["most"]:
        raise ValueError("files of different kinds")
    if head["type"] is None:
        raise ValueError(f"no files in {path}")
    own = kind or TYPES[head["type"]][1]
    many = head["components"] == 3 and component is None
    names = [f"{column}{k}" for k in range(3)] if many else [column]
    read_as = "double" if own in ("float", "double") else "long" if not own.startswith("decimal") else own
    layers = range(3) if many else [component or 0]

    def column_of(v: np.ndarray) -> pa.Array:
        if read_as.startswith("decimal"):
            return pa.array([int(i) for i in v], pa.decimal128(20, 0))
        return pa.array(v.astype(np.float64 if read_as == "double" else np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dtype = np.dtype(TYPES[r["type"]][0]).newbyteorder(">" if r["big"] else "<")
                voxel, left, first = dtype.itemsize * r["components"], r["voxels"], r["first"]
                with opened(r["path"]) as file:
                    # in NIfTI files the header is packed too, in NRRD files it is not
                    whole = r["packed"] and file.read(2) == b"\x1f\x8b"
                    file.seek(0 if whole else r["at"])
                    data = gzip.GzipFile(fileobj=file) if r["packed"] else file
                    if whole:
                        data.read(r["at"])
                    while left:
                        n = min(left, BATCH)
                        raw = data.read(n * voxel)
                        if len(raw) < n * voxel:
                            raise ValueError(f"{r['path']} ends too early")
                        v = np.frombuffer(raw, dtype).reshape(n, r["components"])
                        row, x = np.divmod(np.arange(first, first + n), r["nx"])
                        z, y = np.divmod(row, r["ny"])
                        yield pa.RecordBatch.from_arrays([*(pa.array((c + r[f"o{a}"]).astype(np.int32)) for a, c in zip(AXES, (x, y, z), strict=True)), *(column_of(v[:, k]) for k in layers)], ["x", "y", "z", *names])
                        left, first = left - n, first + n

    parts = pieces(spark, path, segment)
    # a range a task, as far as there are slots; ranges are rows of 100 bytes
    dealt = parts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "at")
    rows = dealt.mapInArrow(run, "x int, y int, z int, " + ", ".join(f"{n} {read_as}" for n in names))
    return rows.select(*AXES, *(F.col(n).cast(own).alias(n) for n in names))


def write_slabs(vox: DataFrame, grid: Grid, path: str, columns: list[str], kind: str = "float", planes: int = 8, packed: bool = False) -> DataFrame:
    """NRRD files of ``planes`` layers each in a folder; one row (path, voxels) a file.

    One column is a scalar volume, three are colours.  Voxels that are not in the table are 0.
    A slab is one group: nx * ny * planes voxels.  A file appears whole or not at all, so a
    task that runs again does no harm.
    """
    dims, steps, dtype = grid.dims, (grid.sx, grid.sy, grid.sz), np.dtype(TYPES[kind][0])

    def run(table: pa.Table) -> pa.Table:
        k = table.column("slab")[0].as_py()
        low, high = k * planes, min((k + 1) * planes, dims[2])
        v = np.zeros((high - low, dims[1], dims[0], len(columns)), dtype)
        at = tuple(np.asarray(table.column(a)) for a in "zyx")
        for i, c in enumerate(columns):
            v[at[0] - low, at[1], at[2], i] = np.asarray(table.column(c)).astype(dtype)
        colour = len(columns) == 3
        sizes, spacing, mins = ([*(["3"] if colour else []), dims[0], dims[1], high - low], [*(["nan"] if colour else []), *steps], [*(["nan"] if colour else []), 0, 0, low])
        head = ["NRRD0004", f"type: {kind}", f"dimension: {len(sizes)}", *([] if not colour else ["kinds: RGB-color space space space"])]
        head += [f"{name}: {' '.join(map(str, values))}" for name, values in (("sizes", sizes), ("spacings", spacing), ("axis mins", mins))]
        head += ["endian: little", f"encoding: {'gzip' if packed else 'raw'}"]
        body = v.astype(dtype.newbyteorder("<")).tobytes()
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder)
        name, draft = f"{folder}/slab-{k:06d}.nrrd", f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(("\n".join(head) + "\n\n").encode())
            out.write(gzip.compress(body) if packed else body)
        store.move(draft, name)
        return pa.table({"path": [name], "voxels": [int(v[..., 0].size)]})

    return vox.select(*AXES, *columns, F.floor(F.col("z") / planes).cast("long").alias("slab")).groupBy("slab").applyInArrow(run, "path string, voxels long")


def write_volume(vox: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd, ranged by z, then sorted by scan order, so that a crop reads few row groups."""
    vox.repartitionByRange("z", "y").sortWithinPartitions("z", "y", "x").write.mode(mode).option("compression", "zstd").parquet(path)


def empty_like(vox: DataFrame, column: str = "label") -> DataFrame:
    return vox.select(*AXES, F.lit(0).alias(column))


def with_spacing(grid: Grid, sx: float, sy: float, sz: float) -> Grid:
    for s in (sx, sy, sz):
        if not (np.isfinite(s) and s > 0):
            raise ValueError("spacing is finite and positive")
    return Grid(grid.dimx, grid.dimy, grid.dimz, sx, sy, sz)


# ------------------------------------------------------------ synthetic volumes


def lattice(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z"), i.alias("scan"))


def unique_labels(spark: SparkSession, n: int) -> DataFrame:
    """A cube of single-voxel labels, boundary 0, all open."""
    return lattice(spark, n, n, n).select(*AXES, (F.col("scan") + 1).alias("label"), F.lit(0.0).alias("boundary"), F.lit(0).alias("mask"))


def checkerboard(spark: SparkSession, n: int) -> DataFrame:
    return lattice(spark, n, n, n).select(*AXES, (F.col("scan") + 1).alias("label"), ((F.col("x") + F.col("y") + F.col("z")) % 2).cast("double").alias("boundary"), (F.floor(F.col("z") / 4) % 4 == 3).cast("int").alias("mask"))


def shells(spark: SparkSession, n: int, thickness: int = 8) -> DataFrame:
    """Concentric shells: every ``thickness``-th layer of distance from the centre is boundary."""
    c = (n - 1) / 2
    r = F.sqrt(sum((F.col(a) - c) * (F.col(a) - c) for a in AXES))
    return lattice(spark, n, n, n).select(*AXES, (F.floor(r) % thickness == 0).cast("int").alias("mask"))


def spheres(spark: SparkSession, n: int, radius: int = 8) -> DataFrame:
    """Packed spheres on a cubic lattice; what lies between them is boundary."""
    d = sum(F.pow(F.col(a) % (2 * radius) - (radius - 0.5), F.lit(2.0)) for a in AXES)
    return lattice(spark, n, n, n).select(*AXES, (d >= float(radius * radius)).cast("int").alias("mask"))


def sparse_sites(spark: SparkSession, n: int, share: float = 0.001, seed: int = 1337) -> DataFrame:
    return lattice(spark, n, n, n).select(*AXES, (F.pmod(F.xxhash64(F.lit(seed), "scan"), F.lit(1_000_000)) < int(share * 1_000_000)).cast("int").alias("mask"))
