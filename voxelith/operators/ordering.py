"""Ordering, navigation and maintenance of the segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from .neighbours import ranked


def table_sort(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By a numeric column; values not computed count as -1, booleans as 0 and 1; ties by label."""
    c = F.coalesce(F.col(column).cast("double"), F.lit(-1.0))
    return rows.orderBy(c.desc() if descending else c.asc(), "label")


def neighbours_in_order(rows: DataFrame, by: str) -> DataFrame:
    """label, before, after: navigation through the table in the order of ``by`` (ties by label).

    Places come from range partitions, so no task sees the whole table.
    """
    place = ranked(rows.select("label", F.col(by).alias("_by")), "_by", "label").select("label", F.col("edge_id").alias("at"))
    place = written(place, "places")
    lower = place.select(F.col("label").alias("before"), (F.col("at") + 1).alias("at"))
    upper = place.select(F.col("label").alias("after"), (F.col("at") - 1).alias("at"))
    return place.join(lower, "at", "left").join(upper, "at", "left").select("label", "before", "after")


def after_merge(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of the table after labels ``old`` became ``new``: per new label the row of the
    largest old one (ties: larger id) under its new id; other rows stay."""
    m = rows.join(merged.select(F.col("old").alias("_o"), F.col("new").alias("_n")), F.col("label") == F.col("_o"), "left")
    best = m.filter("_n is not null").groupBy("_n").agg(F.max(F.struct("n", "label", F.struct(*rows.columns).alias("row")))["row"].alias("row"))
    moved = best.select(*(F.col("_n").cast(rows.schema["label"].dataType).alias("label") if c == "label" else F.col(f"row.{c}").alias(c) for c in rows.columns))
    return m.filter("_n is null").select(*rows.columns).unionByName(moved)


def without(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("label").distinct(), "label", "left_anti")


def top_per_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def text_filter(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose label contains ``text`` (letter case does not count)."""
    return rows.filter(F.lower(F.col("label").cast("string")).contains(text.lower()))
