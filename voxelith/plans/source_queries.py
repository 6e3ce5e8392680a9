"""Queries: files written to the shared folder and read back (S09 to S15), chosen columns (P17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import AXES, Grid, grid_of, voxels
from ..lineage import shared_path
from ..operators import statistics
from ..query import query
from ..sources import datasets, volumes
from .segment_table import segment_table

_PAIRS = "p AS (SELECT lo AS id_a, hi AS id_b, (hi - lo) * 0.5::DOUBLE AS gap, (lo + hi) % 7 AS rest, CASE WHEN lo % 3 = 0 THEN 1 ELSE -1 END AS should_merge FROM edges)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.neighbours import one_sided, two_sided

    vox = voxels(spark, d)
    e = two_sided(one_sided(vox, grid_of(vox)))
    return e.select(F.col("lo").alias("id_a"), F.col("hi").alias("id_b"), ((F.col("hi") - F.col("lo")) * 0.5).alias("gap"), ((F.col("lo") + F.col("hi")) % 7).alias("rest"), F.when(F.col("lo") % 3 == 0, 1).otherwise(-1).alias("should_merge"))


def _dataset(spark: SparkSession, d: str, twice: bool) -> str:
    rows, path = _pairs(spark, d), shared_path(spark, "dataset")
    datasets.write_dataset(rows, path, ["gap", "rest"], "should_merge", ("id_a", "id_b"))
    if twice:
        datasets.append_dataset(rows.filter("id_a % 2 = 0"), path, ["gap", "rest"], "should_merge", ("id_a", "id_b"))
    return path


def _slabs(spark: SparkSession, d: str, columns: list[str], kind: str, packed: bool = False) -> str:
    """The voxel table as NRRD slabs of 3 layers in the shared folder."""
    vox, path = voxels(spark, d), shared_path(spark, "slabs")
    volumes.write_slabs(vox, with_steps(grid_of(vox)), path, columns, kind, 3, packed).count()
    return path


def with_steps(grid: Grid) -> Grid:
    return volumes.with_spacing(grid, 1.0, 1.0, 2.5)


@query("s01_probed_headers", "dimension components dimx dimy dimz oz; sx sz; type", "SELECT 3 AS dimension, 1 AS components, (SELECT max(x) + 1 FROM vox) AS dimx, (SELECT max(y) + 1 FROM vox) AS dimy, count(DISTINCT z) AS dimz, 3 * (z // 3) AS oz, 1.0 AS sx, 2.5 AS sz, 'double' AS type FROM vox GROUP BY z // 3")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return volumes.probe(spark, _slabs(spark, d, ["signal"], "double"))


@query("s02_scanned_volume", "x y z; value", "SELECT x, y, z, signal AS value FROM vox")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return volumes.read_volume(spark, _slabs(spark, d, ["signal"], "double"), segment=4096)


@query("s02_scanned_labels", "x y z value", "SELECT x, y, z, label AS value FROM vox")
def s02_packed(spark: SparkSession, d: str) -> DataFrame:
    return volumes.read_volume(spark, _slabs(spark, d, ["label"], "uint32", True), kind="long")


@query("s04_split_colours", "x y z value0 value1 value2", "SELECT x, y, z, label % 256 AS value0, mask AS value1, other AS value2 FROM vox")
def s04(spark: SparkSession, d: str) -> DataFrame:
    vox, path = voxels(spark, d), shared_path(spark, "colours")
    volumes.write_slabs(vox.withColumn("label", F.col("label") % 256), grid_of(vox), path, ["label", "mask", "other"], "uint8", 5).count()
    return volumes.read_volume(spark, path, segment=1000)


@query("s09_volume_round_trip", "x y z label; signal", "SELECT x, y, z, label, signal FROM vox")
def s09(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "volume")
    volumes.write_volume(voxels(spark, d).select(*AXES, "label", "signal"), path)
    return spark.read.parquet(path)


@query("s10_dataset_features", "id_a id_b; gap rest", _PAIRS + " || SELECT id_a, id_b, gap, rest FROM p")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return datasets.read_features(spark, _dataset(spark, d, False))


@query("s11_empty_dataset", "entries features labels", "SELECT 0 AS entries, count(DISTINCT event_type) AS features, 1 AS labels FROM events")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """A data set whose features are the types of events, before it has rows."""
    kinds = [r[0] for r in spark.read.parquet(f"{d}/events.parquet").filter("event_type is not null").select("event_type").distinct().sort("event_type").collect()]
    path = shared_path(spark, "empty")
    datasets.write_empty_dataset(spark, path, kinds)
    head = datasets.read_header(spark, path)
    return spark.createDataFrame([(head["entries"] + datasets.read_features(spark, path).count(), head["features"], int(head["labels"]))], "entries long, features int, labels int")


@query("s12_appended_dataset", "entries rows", _PAIRS + " || SELECT count(*) + count(*) FILTER (id_a % 2 = 0) AS entries, count(*) + count(*) FILTER (id_a % 2 = 0) AS rows FROM p")
def s12(spark: SparkSession, d: str) -> DataFrame:
    path = _dataset(spark, d, True)
    return datasets.read_features(spark, path).agg(F.lit(datasets.read_header(spark, path)["entries"]).alias("entries"), F.count("*").alias("rows"))


@query("s13_dataset_labels", "id_a id_b should_merge", _PAIRS + " || SELECT id_a, id_b, should_merge FROM p")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return datasets.read_labels(spark, _dataset(spark, d, False))


@query("s14_exported_table", "label n", "SELECT label, count(*) AS n FROM vox GROUP BY label")
def s14(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "table")
    counts = statistics.label_counts(voxels(spark, d)).withColumn("hidden", F.lit(1))
    datasets.export_table(counts, path, ["label", "n"], "n", {"spacing": [1, 1, 1]})
    return spark.read.option("header", True).schema("label long, n long").csv(path)


@query("s15_dumped_edges", "id_a id_b rest", _PAIRS + " || SELECT id_a, id_b, rest FROM p")
def s15(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "dump")
    datasets.dump(_pairs(spark, d), path)
    return spark.read.schema("id_a long, id_b long, rest long").json(path)


@query("p17_chosen_columns", "label n cx", "SELECT label, count(*) AS n, floor(avg(x) + 0.5) AS cx FROM vox WHERE label <> 0 GROUP BY label")
def p17(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return segment_table(vox, grid_of(vox), ("size", "centroid")).select("label", "n", "cx")
