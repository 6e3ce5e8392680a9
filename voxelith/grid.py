"""The voxel table, its metadata and block partitioning.

Volumes are rows (x, y, z, ...).  The scan index is x + y * dimx + z * dimx * dimy.
Operators that look at neighbours work on blocks with a halo: one shuffle by block
brings each voxel to its block and, if it lies at a block's face, to the blocks that
need to see it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .query import VOXELS


@dataclass(frozen=True)
class Grid:
    """Extent, spacing and origin; a spacing that is not finite and positive counts as 1."""

    dimx: int
    dimy: int
    dimz: int
    sx: float = 1.0
    sy: float = 1.0
    sz: float = 1.0

    def scan_index(self) -> Column:
        return F.col("x").cast("long") + F.col("y") * F.lit(self.dimx) + F.col("z") * F.lit(self.dimx * self.dimy).cast("long")

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.dimx, self.dimy, self.dimz


AXES = ("x", "y", "z")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, label, boundary, mask, other, signal of the voxel view of ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", "user_id")
    i = F.col("event_id")
    c = events.select(
        (i % 25).cast("int").alias("x"),
        (F.floor(i / 25).cast("int") % 20).alias("y"),
        F.floor(i / 500).cast("int").alias("z"),
        "event_type", "value", "user_id",
    )
    label = 1 + F.floor(F.col("x") / 5).cast("int") + 5 * F.floor(F.col("y") / 5).cast("int") + 20 * F.floor(F.col("z") / 5).cast("int")
    return c.select(
        "x", "y", "z",
        F.when(F.col("event_type") == "error", 0).otherwise(label).alias("label"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("boundary"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 40), 1).otherwise(0).alias("mask"),
        (1 + F.col("user_id") % 7).cast("int").alias("other"),
        F.col("value").alias("signal"),
    )


def grid_of(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Grid:
    """Extent of a volume that starts at (0, 0, 0): one aggregate row comes to the driver."""
    r = vox.agg(*(F.max(a).alias(a) for a in AXES)).first()
    return Grid(*((r[a] if r[a] is not None else -1) + 1 for a in AXES), *spacing)


def spaced(s: float) -> float:
    return s if np.isfinite(s) and s > 0 else 1.0


def joined_blocks(dims: tuple[int, int, int], sizes: tuple[int, int, int], most: int = 64, voxels: int = 1 << 18) -> tuple[int, int, int]:
    """Sizes of blocks, of ``sizes`` or a multiple.

    More than ``most`` blocks are joined, along their shortest sides first, until there are no
    more than that or a block holds so many ``voxels``.  So what each block costs, whatever is
    in it, does not grow with the volume before its voxels do.
    """
    out = list(sizes)
    while prod(-(-n // s) for n, s in zip(dims, out, strict=True)) > most and prod(min(n, s) for n, s in zip(dims, out, strict=True)) < voxels:
        out[min((k for k in range(3) if out[k] < dims[k]), key=lambda k: out[k])] *= 2
    return tuple(out)


def with_blocks(vox: DataFrame, grid: Grid, edge: int | tuple[int, int, int], halo: int, lower_only: bool = False, offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """One row for each block that sees the voxel: adds bx, by, bz and ``own``.

    ``edge``: of a cube, or the sizes along x, y and z.
    ``lower_only``: only blocks below see their upper neighbours' first layers, one axis
    at a time (what pairs of face neighbours need).
    ``offset``: by which the first block of an axis is shorter than the others.
    """
    size = dict(zip(AXES, edge if isinstance(edge, tuple) else (edge,) * 3, strict=True))
    at = {a: F.col(a) + o if o else F.col(a) for a, o in zip(AXES, offset, strict=True)}
    blocks = {a: F.floor(at[a] / size[a]).cast("int") for a in AXES}
    most = {a: (d - 1 + o) // size[a] for a, d, o in zip(AXES, grid.dims, offset, strict=True)}
    own = F.struct(*(blocks[a].alias(f"b{a}") for a in AXES))
    if lower_only:
        seen = [own]
        for a in AXES:
            moved = F.struct(*((blocks[b] - 1 if a == b else blocks[b]).alias(f"b{b}") for b in AXES))
            seen.append(F.when((at[a] % size[a] < halo) & (blocks[a] > 0), moved))
        seen = F.filter(F.array(*seen), lambda s: s.isNotNull())
    else:
        steps = {
            a: F.filter(
                F.array(
                    blocks[a],
                    F.when((at[a] % size[a] < halo) & (blocks[a] > 0), blocks[a] - 1),
                    F.when((at[a] % size[a] >= size[a] - halo) & (blocks[a] < most[a]), blocks[a] + 1),
                ),
                lambda s: s.isNotNull(),
            )
            for a in AXES
        }
        seen = F.flatten(F.transform(steps["x"], lambda i: F.flatten(F.transform(steps["y"], lambda j: F.transform(steps["z"], lambda k: F.struct(i.alias("bx"), j.alias("by"), k.alias("bz")))))))
    return vox.select("*", F.explode(seen).alias("b")).select(*vox.columns, "b.*", (F.col("b") == own).alias("own"))


class Block:
    """A block of a volume as dense arrays (indexed z, y, x), with its halo."""

    def __init__(self, table: pa.Table, fill: dict[str, object], margin: int = 0):
        xyz = [np.asarray(table.column(a)).astype(np.int64) for a in AXES]
        self.low = np.array([c.min() for c in xyz]) - margin
        shape = tuple(int(c.max()) + margin - int(lo) + 1 for c, lo in zip(reversed(xyz), reversed(self.low), strict=True))
        self.at = tuple(c - lo for c, lo in zip(reversed(xyz), reversed(self.low), strict=True))
        self.present = np.zeros(shape, bool)
        self.present[self.at] = True
        self.own = np.zeros(shape, bool)
        self.own[self.at] = np.asarray(table.column("own"))
        self.arrays = {}
        for name, empty in fill.items():
            column = np.asarray(table.column(name))
            a = np.full(shape, empty, column.dtype)
            a[self.at] = column
            self.arrays[name] = a

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def rows(self, where: np.ndarray, **columns: np.ndarray) -> pa.Table:
        z, y, x = np.nonzero(where)
        out = {a: pa.array((c + lo).astype(np.int32)) for a, c, lo in zip(AXES, (x, y, z), self.low, strict=True)}
        return pa.table(out | {k: pa.array(v[z, y, x]) for k, v in columns.items()})


def by_block(vox: DataFrame, grid: Grid, kernel: Callable[[pa.Table], pa.Table], schema: str, edge: int = 32, halo: int = 1) -> DataFrame:
    """Apply a kernel to each block with its halo; the kernel gives rows of owned voxels only."""

    def run(table: pa.Table) -> pa.Table:
        return kernel(table)

    return with_blocks(vox, grid, edge, halo).groupBy("bx", "by", "bz").applyInArrow(run, schema)


def shifted(a: np.ndarray, dz: int, dy: int, dx: int, empty) -> np.ndarray:
    """Value at (z + dz, y + dy, x + dx), ``empty`` outside."""
    out = np.full_like(a, empty)
    src, dst = [], []
    for d, n in zip((dz, dy, dx), a.shape, strict=True):
        src.append(slice(max(d, 0), n + min(d, 0)))
        dst.append(slice(max(-d, 0), n + min(-d, 0)))
    if all(abs(d) < n for d, n in zip((dz, dy, dx), a.shape, strict=True)):
        out[tuple(dst)] = a[tuple(src)]
    return out


SIX = tuple((dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if abs(dz) + abs(dy) + abs(dx) == 1)
TWENTY_SIX = tuple((dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) != (0, 0, 0))


def stencil(n: int) -> tuple[tuple[int, int, int], ...]:
    if n not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    return SIX if n == 6 else TWENTY_SIX
