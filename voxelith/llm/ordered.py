"""Numbers and running totals within a key, however many rows the key holds.

No window here holds a whole key: rows are dealt by ranges of the order, or of a coordinate,
and only one row a range goes on to the next level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Coordinates of a range; rows a range holds at most, where coordinates do not repeat.
RANGE = 4096
#: Levels of ranges above the rows: enough for 4096^3 coordinates.
LEVELS = 2


def same(keys: list[str], other: DataFrame, extra: list[str]) -> tuple[DataFrame, Column]:
    """``other`` with its keys renamed, and the condition to meet it; null keys are equal."""
    renamed = other.withColumnsRenamed({k: f"_{k}_" for k in [*keys, *extra]})
    on = F.lit(True)
    for k in [*keys, *extra]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return renamed, on


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds dense numbers from 0 within ``keys``, in ascending order (null first).

    Range partitions over (keys, order) are balanced unless rows are equal in all of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    skip = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = at.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", skip.alias("_skip"))
    counts, on = same(keys, counts, ["_part"])
    return at.withColumn("_r", local).join(counts.hint("shuffle_merge"), on).select(*rows.columns, (F.col("_r") + F.col("_skip")).cast("long").alias(name))


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: How totals are taken and joined; null has no part in either.
HOW: dict[str, tuple[Callable[..., Column], Callable[[Column, Column], Column]]] = {"sum": (F.sum, _added), "max": (F.max, lambda a, b: F.greatest(a, b))}


def before(rows: DataFrame, keys: list[str], at: str, values: dict[str, tuple[str, str]], order: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """Adds columns name: total of (column, "sum" or "max") over the earlier rows of a key; null where there is none.

    ``at`` is a long coordinate; rows are in its order, then in that of ``order``.  ``rows`` is
    read twice for each level, so let it be a written table.
    """
    order, chunk = [at, *(order or [])], f"_chunk{levels}"
    if not levels:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *(HOW[how][0](column).over(w).alias(name) for name, (column, how) in values.items()))
    cut = rows.withColumn(chunk, F.floor(F.col(at) / RANGE).cast("long"))
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *(HOW[how][0](column).over(w).alias(f"_l_{name}") for name, (column, how) in values.items()))
    totals = cut.groupBy(*keys, chunk).agg(*(HOW[how][0](column).alias(f"_t_{name}") for name, (column, how) in values.items()))
    above = before(totals, keys, chunk, {f"_b_{name}": (f"_t_{name}", how) for name, (_, how) in values.items()}, None, levels - 1)
    above, on = same(keys, above.select(*keys, chunk, *(f"_b_{name}" for name in values)), [chunk])
    out = [HOW[how][1](F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name) for name, (_, how) in values.items()]
    return local.join(above.hint("shuffle_merge"), on).select(*rows.columns, *out)
