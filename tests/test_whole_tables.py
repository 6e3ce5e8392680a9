"""Queries that once read a corner of the voxel table read all of it."""

from pyspark.sql import functions as F

from voxelith.grid import voxels
from voxelith.registry import QUERIES


def test_splits_cover_the_whole_table(spark, sf_dir):
    whole = voxels(spark, sf_dir).count()
    assert QUERIES["x01_split_session"](spark, sf_dir).first()["voxels"] == whole
    for name in ("x05_seeded_split", "x07_apply_cut"):
        assert QUERIES[name](spark, sf_dir).agg(F.sum("n").alias("n")).first()["n"] == whole


def test_geodesic_sides_cover_all_labels(spark, sf_dir):
    labels = {r["label"] for r in voxels(spark, sf_dir).filter("label <> 0").select("label").distinct().collect()}
    assert {r["label"] for r in QUERIES["g09_geodesic_sides"](spark, sf_dir).collect()} == labels
