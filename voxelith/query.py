"""Registry of queries and their SQL twins over the voxel view of ``events``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The voxel view; the same text runs in Spark and DuckDB.
VOXELS = """SELECT x, y, z,
  CASE WHEN event_type = 'error' THEN 0
       ELSE 1 + CAST(floor(x / 5) AS INT) + 5 * CAST(floor(y / 5) AS INT) + 20 * CAST(floor(z / 5) AS INT) END AS label,
  least(value / 200.0, 1.0) AS boundary,
  CASE WHEN event_type = 'purchase' AND value > 40 THEN 1 ELSE 0 END AS mask,
  CAST(1 + user_id % 7 AS INT) AS other,
  value AS signal
FROM (SELECT CAST(event_id % 25 AS INT) AS x, CAST(floor(event_id / 25) AS INT) % 20 AS y,
             CAST(floor(event_id / 500) AS INT) AS z, event_type, value, user_id FROM events) c"""

_FACE = "SELECT a.x, a.y, a.z, a.label AS la, b.label AS lb, a.boundary AS ba, b.boundary AS bb, a.mask AS ma, b.mask AS mb, {k} AS axis, b.x AS x2, b.y AS y2, b.z AS z2 FROM vox a JOIN vox b ON b.x = a.x + {i} AND b.y = a.y + {j} AND b.z = a.z + {l}"
#: Pairs of face neighbours, each once.
FACES = " UNION ALL ".join(_FACE.format(k=k, i=int(k == 0), j=int(k == 1), l=int(k == 2)) for k in range(3))
#: Edge table: ids are ranks of the ordered pairs of labels that touch.
EDGES = "SELECT CAST(row_number() OVER (ORDER BY lo, hi) AS BIGINT) AS edge_id, lo, hi FROM (SELECT DISTINCT least(la, lb) AS lo, greatest(la, lb) AS hi FROM faces WHERE la <> lb AND la <> 0 AND lb <> 0) q"
PRELUDE = f"WITH RECURSIVE vox AS ({VOXELS}), faces AS ({FACES}), edges AS ({EDGES})"


def query(name: str, columns: str, sql: str | None = None):
    """Register a query.

    ``columns``: "integers; doubles; others", each separated by spaces: both sides are cast
    alike (bigint; double rounded to six places; as they are).  ``sql``: a SELECT, or
    "further CTEs || SELECT", over vox, faces and edges.
    """
    whole, real, other = ([*c.split()] for c in (columns + ";;").split(";")[:3])

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("bigint").alias(c) for c in whole), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in real), *other)

        QUERIES[name] = run
        if sql:
            ctes, _, final = sql.rpartition("||")
            out = [*(f"CAST({c} AS BIGINT) AS {c}" for c in whole), *(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in real), *other]
            SQL[name] = f"{PRELUDE}{',' if ctes.strip() else ''} {ctes} SELECT {', '.join(out)} FROM ({final}) q"
        return run

    return add
