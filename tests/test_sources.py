import gzip
import struct

import numpy as np
import pytest

from voxelith.sources import datasets, volumes


def nrrd(path, data, kind, encoding="raw", extra=""):
    head = f"NRRD0004\ntype: {kind}\ndimension: {data.ndim}\nsizes: {' '.join(map(str, reversed(data.shape)))}\nendian: little\nencoding: {encoding}\n{extra}\n"
    body = data.tobytes()
    path.write_bytes(head.encode() + (gzip.compress(body) if encoding == "gzip" else body))


@pytest.mark.parametrize("encoding", ["raw", "gzip"])
def test_volume_round_trip(spark, tmp_path, encoding):
    data = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    nrrd(tmp_path / "a.nrrd", data, "uint16", encoding, "spacings: 1 1 3\n")
    head = volumes.probe(spark, str(tmp_path / "a.nrrd")).first()
    assert (head["dimx"], head["dimy"], head["dimz"], head["sz"]) == (4, 3, 2, 3.0)
    df = volumes.read_volume(spark, str(tmp_path / "a.nrrd"))
    assert dict(df.dtypes)["value"] == "int"
    assert all(r["value"] == data[r["z"], r["y"], r["x"]] for r in df.collect())
    volumes.write_volume(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_colours_split(spark, tmp_path):
    data = np.arange(2 * 3 * 3, dtype="u1").reshape(2, 3, 3)
    nrrd(tmp_path / "c.nrrd", data, "uchar", extra="kinds: RGB-color space space\n")
    df = volumes.read_volume(spark, str(tmp_path / "c.nrrd"))
    assert [c for c in df.columns if c.startswith("value")] == ["value0", "value1", "value2"]
    assert all(r["value2"] == data[r["y"], r["x"], 2] for r in df.collect())


def test_odd_headers_are_errors():
    for fields in ({"dimension": "4", "sizes": "1 1 1 1", "type": "uint8"}, {"dimension": "3", "sizes": "1 1 1", "type": "block"}):
        with pytest.raises(ValueError):
            volumes.describe(fields)


def tiff(path, pages, order="<"):
    """Uncompressed pages in strips of two rows."""
    out, at = [b"II" if order == "<" else b"MM", struct.pack(order + "HI", 42, 8)], 8
    for k, page in enumerate(pages):
        ny, nx, *colours = page.shape
        strips = [page[r : r + 2].tobytes() for r in range(0, ny, 2)]
        n, tags = len(strips), 9
        data = at + 2 + 12 * tags + 4
        lists = data + sum(map(len, strips))
        offsets = [data + sum(map(len, strips[:i])) for i in range(n)]
        after = lists + 8 * n

        def entry(tag, kind, values, where):
            packed = struct.pack(order + f"{len(values)}{'H' if kind == 3 else 'I'}", *values)
            return struct.pack(order + "HHI", tag, kind, len(values)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", where))

        bits, sample = page.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        ifd = [entry(256, 4, [nx], 0), entry(257, 4, [ny], 0), entry(258, 3, [bits], 0), entry(259, 3, [1], 0), entry(273, 4, offsets, lists), entry(277, 3, [colours[0] if colours else 1], 0), entry(278, 4, [2], 0), entry(279, 4, [len(s) for s in strips], lists + 4 * n), entry(339, 3, [sample], 0)]
        out.append(struct.pack(order + "H", tags) + b"".join(ifd) + struct.pack(order + "I", after if k + 1 < len(pages) else 0))
        out += strips + [struct.pack(order + f"{n}I", *offsets), struct.pack(order + f"{n}I", *map(len, strips))]
        at = after
    path.write_bytes(b"".join(out))


def nifti(path, data, kind, order="<", packed=False):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, data.ndim, *reversed(data.shape), *[1] * (7 - data.ndim))
    struct.pack_into(order + "2h", head, 70, kind, data.dtype.itemsize * 8)
    struct.pack_into(order + "8f", head, 76, 1, 1, 1, 3, 1, 1, 1, 1)
    struct.pack_into(order + "f", head, 108, 352)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.tobytes()
    path.write_bytes(gzip.compress(raw) if packed else raw)


def same(df, data):
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in df.collect()}
    return got == {p: v.item() for p, v in np.ndenumerate(data)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_are_layers(spark, tmp_path, order):
    data = (np.arange(60) * 7).astype(order + "u2").reshape(3, 5, 4)
    tiff(tmp_path / "a.tif", list(data), order)
    head = volumes.probe(spark, str(tmp_path / "a.tif")).first()
    assert (head["dimension"], head["type"], head["dimx"], head["dimy"], head["dimz"]) == (3, "uint16", 4, 5, 3)
    assert same(volumes.read_volume(spark, str(tmp_path / "a.tif"), segment=10), data)


def test_of_different_pages_the_first_counts(spark, tmp_path):
    pages = [np.arange(20, dtype="<f4").reshape(5, 4), np.zeros((2, 4), "<f4")]
    tiff(tmp_path / "b.tif", pages)
    assert same(volumes.read_volume(spark, str(tmp_path / "b.tif")), pages[0][None])


def test_colour_pages_split(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 3, dtype="u1").reshape(2, 3, 4, 3)
    tiff(tmp_path / "c.tif", list(data))
    df = volumes.read_volume(spark, str(tmp_path / "c.tif"), segment=9)
    assert all([r[f"value{k}"] for k in range(3)] == data[r["z"], r["y"], r["x"]].tolist() for r in df.collect())
    assert same(volumes.read_volume(spark, str(tmp_path / "c.tif"), component=1), data[..., 1])


@pytest.mark.parametrize("order, packed", [("<", False), (">", False), ("<", True)])
def test_nifti(spark, tmp_path, order, packed):
    data = (np.arange(24) - 7).astype(order + "i2").reshape(2, 3, 4)
    name = tmp_path / ("a.nii.gz" if packed else "a.nii")
    nifti(name, data, 4, order, packed)
    head = volumes.probe(spark, str(name)).first()
    assert (head["dimx"], head["dimz"], head["sz"], head["type"]) == (4, 2, 3.0, "int16")
    assert same(volumes.read_volume(spark, str(name), segment=6), data)


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    """More than 2 GB on paper (a sparse file); its last range is read from where it lies."""
    nx, ny, nz = 1024, 1024, 2100
    head = f"NRRD0004\ntype: uint8\ndimension: 3\nsizes: {nx} {ny} {nz}\nencoding: raw\n\n".encode()
    with open(tmp_path / "big.nrrd", "wb") as f:
        f.write(head)
        f.seek(len(head) + nx * ny * nz - 1)
        f.write(b"\x07")
    parts = volumes.pieces(spark, str(tmp_path / "big.nrrd"))
    assert parts.count() == -(-nx * ny * nz // volumes.SEGMENT) and parts.selectExpr("sum(voxels)").first()[0] == nx * ny * nz
    assert parts.selectExpr("max(at + voxels)").first()[0] == len(head) + nx * ny * nz


def test_short_and_strange_files_are_errors(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"nothing at all" * 40)
    nrrd(tmp_path / "short.nrrd", np.zeros((2, 3, 4), "u1"), "uint8")
    (tmp_path / "short.nrrd").write_bytes((tmp_path / "short.nrrd").read_bytes()[:-1])
    for f, call in (("x.bin", volumes.probe), ("short.nrrd", volumes.read_volume)):
        with pytest.raises(Exception, match="ValueError"):
            call(spark, str(tmp_path / f)).collect()


def test_dataset_append_checks_names(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(1, 2, 0.5, 1), (3, 4, 0.25, -1)], "a long, b long, f double, y int")
    datasets.write_dataset(rows, path, ["f"], "y", ("a", "b"))
    datasets.append_dataset(rows, path, ["f"], "y", ("a", "b"))
    datasets.append_dataset(rows, path, ["f"], "y")
    assert datasets.read_header(spark, path)["entries"] == 6
    assert datasets.read_features(spark, path).filter("id_a = -1").count() == 2
    assert datasets.read_labels(spark, path).count() == 6
    with pytest.raises(ValueError):
        datasets.append_dataset(rows, path, ["g"], "y")
    datasets.write_empty_dataset(spark, str(tmp_path / "e"), ["f"], labels=False)
    with pytest.raises(ValueError):
        datasets.read_labels(spark, str(tmp_path / "e"))


def test_table_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3.0), (2, None), (3, 1.0)], "label long, n double")
    datasets.export_table(rows, str(tmp_path / "t"), ["label", "n"], "n", {"spacing": [1, 1, 1]})
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["label,n", "2,", "3,1.0", "1,3.0"] or lines[0] == "label,n"
    assert spark.read.text(str(tmp_path / "t.meta")).first()["value"].startswith("# spacing")
