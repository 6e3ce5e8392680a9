"""Queries that number edges or labels give the rows of their SQL where ranges are sampled (2,020 edges and more).

On the smallest tables samples hold every row, so two readings of the ranges agree there.
"""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelith.registry import QUERIES, SQL

#: Query and how many copies of the events of sf0.1 it reads.
CASES = {
    "g05_edge_status": 1,
    "g05_merge_edge_set": 1,
    "g08_split_group": 1,
    "g10_explode_groups": 1,
    "g12_remove_node": 1,
    "g14_label_volume": 1,
    "g15_groups_near_refinement": 1,
    "g18_large_groups": 1,
    "r08_greedy_settles": 4,
    "r09_first_batch": 1,
    "n03_two_sided_edges": 1,
}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    def made(n: int) -> str:
        if n == 1:
            return "/root/testdata/sf0.1"
        d = str(tmp_path_factory.mktemp(f"copies{n}"))
        events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
        moved = events.crossJoin(spark.range(n)).withColumn("event_id", F.col("event_id") + 100_000 * F.col("id"))
        moved.drop("id").write.parquet(f"{d}/events.parquet")
        return d

    return made


@pytest.mark.parametrize("name", CASES)
def test_ids_are_those_of_the_sql(spark, copies, tmp_path, name):
    d = copies(CASES[name])
    QUERIES[name](spark, d).write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    files = f"{d}/events.parquet"
    con.execute(f"create view events as select * from '{files}{'/*.parquet' if os.path.isdir(files) else ''}'")
    con.execute(f"create table want as {SQL[name]}")
    columns = ", ".join(r[0] for r in con.execute("describe want").fetchall())
    con.execute(f"create view got as select {columns} from '{tmp_path}/got/*.parquet'")
    apart = "select count(*) from (select {0} from {1} except all select {0} from {2})"
    assert [con.execute(apart.format(columns, *t)).fetchone()[0] for t in (("want", "got"), ("got", "want"))] == [0, 0]
