"""Boundary volume to segments: threshold, distance, seeds, watershed, agglomeration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, Grid
from ..lineage import written
from ..operators import agglomeration, distance, projections, statistics
from ..operators.components import boundary_consistent


@dataclass(frozen=True)
class Steps:
    threshold: float = 0.5
    seeds: str = "maxima"
    algorithm: str = "exact"
    least_seed: int = 0
    options: agglomeration.Options = field(default_factory=agglomeration.Options)


def segments(vox: DataFrame, grid: Grid, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """(x, y, z, label; split map) from x, y, z, boundary.

    Labels are consistent with the boundary: masked voxels are 0 and each label hangs
    together.
    """
    steps = steps or Steps()
    mask = written(vox.select(*AXES, "boundary", projections.threshold(F.col("boundary"), steps.threshold).alias("mask")), "mask")
    dist = written(distance.signed_distance(mask, grid), "distance")
    seeds = distance.extract_seeds(dist, grid, steps.seeds)
    if steps.least_seed:
        seeds = statistics.drop_small(seeds.withColumnRenamed("seed", "label"), steps.least_seed).withColumnRenamed("label", "seed")
    cost = projections.inverted(dist, "dist")
    j = cost.join(seeds, list(AXES), "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
    flooded = written(distance.run_watershed(j, grid, steps.algorithm), "flooded")
    labelled = flooded.join(mask, list(AXES))
    return boundary_consistent(labelled, grid)


def agglomerated(vox: DataFrame, labels: DataFrame, grid: Grid, steps: Steps | None = None) -> DataFrame:
    """x, y, z, label after merging by boundary evidence."""
    steps = steps or Steps()
    j = vox.select(*AXES, "boundary", projections.threshold(F.col("boundary"), steps.threshold).alias("mask")).join(labels.select(*AXES, "label"), list(AXES))
    return agglomeration.agglomerate(written(j, "fragments"), grid, steps.options)[0]
