"""Where the voxels of a volume file lie: headers of NRRD, TIFF and NIfTI-1 files."""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass, field

import pyarrow.fs as pafs

#: Component types of headers and what they become in Spark (unsigned widen one step).
TYPES = {
    "uchar": ("u1", "short"), "uint8": ("u1", "short"), "unsigned char": ("u1", "short"), "signed char": ("i1", "byte"), "int8": ("i1", "byte"),
    "short": ("i2", "short"), "int16": ("i2", "short"), "ushort": ("u2", "int"), "uint16": ("u2", "int"), "unsigned short": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "long"), "uint32": ("u4", "long"), "unsigned int": ("u4", "long"),
    "longlong": ("i8", "long"), "int64": ("i8", "long"), "ulonglong": ("u8", "decimal(20,0)"), "uint64": ("u8", "decimal(20,0)"),
    "float": ("f4", "float"), "double": ("f8", "double"),
}
#: Fixed values of the formats: NIfTI data types, TIFF sample formats by bits.
NIFTI_TYPES = {2: "uint8", 4: "int16", 8: "int32", 16: "float", 64: "double", 128: "uint8", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}
TIFF_TYPES = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (1, 64): "uint64", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (2, 64): "int64", (3, 32): "float", (3, 64): "double"}
TIFF_FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
#: Bytes read at first for a text header.
HEAD = 65536


@dataclass(frozen=True)
class Layout:
    """``pieces``: (offset in the file, first voxel, voxels) in the order of the scan index."""

    dimension: int
    type: str
    components: int
    sizes: list[int]
    spacing: list[float]
    pieces: list[tuple[int, int, int]]
    big: bool = False
    packed: bool = False
    origin: list[int] = field(default_factory=lambda: [0, 0, 0])

    def __post_init__(self):
        if self.dimension not in (2, 3):
            raise ValueError(f"{self.dimension} dimensions")
        if self.components not in (1, 3):
            raise ValueError(f"{self.components} components")
        if self.type not in TYPES:
            raise ValueError(f"component type {self.type}")
        if self.components == 3 and TYPES[self.type][0] not in ("u1", "i1", "u2", "i2"):
            raise ValueError("colours have 8 or 16 bits")

    def cut(self, voxel_bytes: int, most: int) -> list[tuple[int, int, int]]:
        """Pieces of at most ``most`` bytes; what is packed is one piece."""
        if self.packed:
            return self.pieces
        n = max(1, most // voxel_bytes)
        return [(at + k * voxel_bytes, first + k, min(n, count - k)) for at, first, count in self.pieces for k in range(0, count, n)]


def opened(path: str):
    """A file in any store that Arrow reads (local, HDFS, S3, GCS, ABFS)."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:") :]
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _steps(n: int, steps: list[float]) -> list[float]:
    """Spacing of three axes; what is not finite and positive counts as 1."""
    return [s if 0 < s < float("inf") else 1.0 for s in steps][:3] + [1.0] * (3 - n)


def nrrd_fields(raw: bytes) -> tuple[dict[str, str], int]:
    """Fields of an NRRD header (lower-case keys) and where the data start."""
    end = raw.find(b"\n\n")
    if not raw.startswith(b"NRRD") or end < 0:
        raise ValueError("not an NRRD file with attached data")
    lines = raw[:end].decode("ascii", "replace").splitlines()[1:]
    fields = dict(part.split(":", 1) for part in lines if ":" in part and not part.startswith("#"))
    return {k.strip().lower(): v.strip().removeprefix("=").strip() for k, v in fields.items()}, end + 2


def nrrd_layout(fields: dict[str, str], start: int) -> Layout:
    if "data file" in fields or "datafile" in fields:
        raise ValueError("the data lie in another file")
    n, sizes = int(fields["dimension"]), [int(s) for s in fields["sizes"].split()]
    kinds = fields.get("kinds", "").lower().split()
    components = 1
    if kinds and kinds[0] in ("vector", "rgb-color", "3-color", "list") and len(sizes) == n:
        components, sizes, n = sizes[0], sizes[1:], n - 1
    steps = [float(s) for s in fields.get("spacings", "").split()][-n:] if "spacings" in fields else [1.0] * n
    mins = [int(float(s)) for s in fields["axis mins"].split()[-n:]] if "axis mins" in fields else [0] * n
    sizes = sizes + [1] * (3 - n)
    encoding = fields.get("encoding", "raw").lower()
    if encoding not in ("raw", "gz", "gzip"):
        raise ValueError(f"encoding {encoding}")
    kind = fields["type"].lower()
    return Layout(n, kind, components, sizes, _steps(n, steps), [(start, 0, sizes[0] * sizes[1] * sizes[2])], fields.get("endian", "little").lower() == "big", encoding != "raw", mins + [0] * (3 - n))


def nifti_layout(raw: bytes, packed: bool) -> Layout:
    big = struct.unpack("<i", raw[:4])[0] != 348
    e = ">" if big else "<"
    if struct.unpack(e + "i", raw[:4])[0] != 348 or raw[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 file with attached data")
    dim = struct.unpack(e + "8h", raw[40:56])
    kind = struct.unpack(e + "h", raw[70:72])[0]
    steps = struct.unpack(e + "8f", raw[76:108])
    start = int(struct.unpack(e + "f", raw[108:112])[0])
    n = dim[0]
    while n > 3 and dim[n] == 1:
        n -= 1
    sizes = list(dim[1 : n + 1]) + [1] * (3 - n)
    count = 1
    for s in sizes:
        count *= s
    return Layout(n, NIFTI_TYPES.get(kind, str(kind)), 3 if kind == 128 else 1, sizes, _steps(n, list(steps[1 : n + 1])), [(start, 0, count)], big, packed)


def tiff_layout(file) -> Layout:
    """Pages are layers; where sizes or kinds of pages differ, only the first one counts."""
    head = file.read(8)
    e = {b"II": "<", b"MM": ">"}.get(head[:2])
    if e is None or struct.unpack(e + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack(e + "I", head[4:8])[0], []
    while at:
        file.seek(at)
        n = struct.unpack(e + "H", file.read(2))[0]
        raw = file.read(12 * n + 4)
        tags = {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack(e + "HHI4s", raw[12 * k : 12 * k + 12])
            if kind not in TIFF_FIELDS:
                continue
            size = struct.calcsize(TIFF_FIELDS[kind]) * count
            if size <= 4:
                value = raw[12 * k + 8 : 12 * k + 8 + size]
            else:
                file.seek(struct.unpack(e + "I", raw[12 * k + 8 : 12 * k + 12])[0])
                value = file.read(size)
            tags[tag] = struct.unpack(e + f"{count}{TIFF_FIELDS[kind]}", value)
        pages.append(tags)
        at = struct.unpack(e + "I", raw[12 * n :])[0]

    def kind(tags: dict) -> tuple:
        return tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(339, (1,))[0], tags.get(277, (1,))[0]

    nx, ny, bits, sample, components = kind(pages[0])
    pages = pages if all(kind(p) == kind(pages[0]) for p in pages) else pages[:1]
    if any(p.get(259, (1,))[0] != 1 for p in pages):
        raise ValueError("compressed pages")
    if any(p.get(284, (1,))[0] != 1 for p in pages) and components > 1:
        raise ValueError("colours in separate planes")
    voxel, pieces = bits // 8 * components, []
    for z, p in enumerate(pages):
        first, rows = z * nx * ny, p.get(278, (ny,))[0]
        for k, start in enumerate(p[273]):
            count = nx * min(rows, ny - k * rows)
            if pieces and pieces[-1][0] + pieces[-1][2] * voxel == start:  # goes on where the one before ends
                pieces[-1] = (pieces[-1][0], pieces[-1][1], pieces[-1][2] + count)
            else:
                pieces.append((start, first, count))
            first += count
    return Layout(2 if len(pages) == 1 else 3, TIFF_TYPES.get((sample, bits), f"{sample}/{bits}"), components, [nx, ny, len(pages)], [1.0, 1.0, 1.0], pieces, e == ">")


def layout(path: str, file) -> Layout:
    """By the file's first bytes."""
    raw = file.read(HEAD)
    if raw[:2] == b"\x1f\x8b":
        file.seek(0)
        return nifti_layout(gzip.GzipFile(fileobj=file).read(352), True)
    if raw.startswith(b"NRRD"):
        return nrrd_layout(*nrrd_fields(raw))
    if raw[:2] in (b"II", b"MM"):
        file.seek(0)
        return tiff_layout(file)
    return nifti_layout(raw, False)
