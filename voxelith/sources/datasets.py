"""Learning data sets as three text folders (header, features, labels), and table exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _header(n: int, names: list[str], labels: bool) -> str:
    return f"NumberEntries: {n} NumberFeatures: {len(names)} LabelsProvided: {int(labels)}\nIdentifier " + " ".join(names)


def _write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_dataset(rows: DataFrame, path: str, features: list[str], label: str | None = None, ids: tuple[str, str] | None = None) -> None:
    """``path``.header, .features (idA idB f1 ..) and .labels (idA idB +-1); without ids: -1 -1."""
    spark = rows.sparkSession
    if not features:
        raise ValueError("a data set has features")
    key = [F.col(c).cast("string") for c in ids] if ids else [F.lit("-1"), F.lit("-1")]
    rows.select(F.concat_ws(" ", *key, *(F.col(c).cast("string") for c in features)).alias("value")).write.mode("append").text(f"{path}.features")
    if label:
        rows.select(F.concat_ws(" ", *key, F.col(label).cast("string")).alias("value")).write.mode("append").text(f"{path}.labels")
    _write_text(spark, _header(rows.count(), features, bool(label)).split("\n"), f"{path}.header")


def write_empty_dataset(spark: SparkSession, path: str, features: list[str], labels: bool = True) -> None:
    empty = spark.createDataFrame([], "value string")
    empty.write.mode("overwrite").text(f"{path}.features")
    if labels:
        empty.write.mode("overwrite").text(f"{path}.labels")
    _write_text(spark, _header(0, features, labels).split("\n"), f"{path}.header")


def read_header(spark: SparkSession, path: str) -> dict:
    lines = [r["value"] for r in spark.read.text(f"{path}.header").collect()]  # two lines
    counts = next(x for x in lines if x.startswith("NumberEntries"))
    words = counts.split()
    names = next((x.split()[1:] for x in lines if x.startswith("Identifier")), [])
    return {"entries": int(words[1]), "features": int(words[3]), "labels": words[5] == "1", "names": names}


def append_dataset(rows: DataFrame, path: str, features: list[str], label: str | None = None, ids: tuple[str, str] | None = None) -> None:
    """Append after checking that names and label flag agree; the header's count is the sum."""
    spark = rows.sparkSession
    head = read_header(spark, path)
    if head["names"] != features or head["labels"] != bool(label):
        raise ValueError("the data set has other features or labels")
    n = rows.count()
    write_dataset(rows, path, features, label, ids)
    _write_text(spark, _header(head["entries"] + n, features, bool(label)).split("\n"), f"{path}.header")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    head = read_header(spark, path)
    if not head["labels"]:
        raise ValueError("the data set has no labels")
    s = F.split("value", " ")
    return spark.read.text(f"{path}.features").select(s[0].cast("long").alias("id_a"), s[1].cast("long").alias("id_b"), *(s[k + 2].cast("double").alias(n) for k, n in enumerate(head["names"])))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    if not read_header(spark, path)["labels"]:
        raise ValueError("the data set has no labels")
    s = F.split("value", " ")
    return spark.read.text(f"{path}.labels").select(s[0].cast("long").alias("id_a"), s[1].cast("long").alias("id_b"), s[2].cast("int").alias("should_merge"))


def export_table(rows: DataFrame, path: str, visible: list[str], order: str, metadata: dict) -> None:
    """Visible columns in the given order as one CSV file, with metadata lines beside it."""
    rows.orderBy(F.coalesce(F.col(order).cast("double"), F.lit(-1.0))).select(*visible).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    _write_text(rows.sparkSession, [f"# {k}: {json.dumps(v)}" for k, v in metadata.items()], f"{path}.meta")


def dump(rows: DataFrame, path: str) -> None:
    """Text dump of nodes or edges: one JSON object a line."""
    rows.write.mode("overwrite").json(path)
