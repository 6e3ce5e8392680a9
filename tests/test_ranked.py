"""Dense ids over more rows than a sample of range bounds takes whole."""

from pyspark.sql import functions as F

from voxelith.operators.neighbours import ranked


def test_ids_follow_the_order_of_many_rows(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("other"))
    # as after a shuffle of groups; the counts alone need no "other"
    e = rows.groupBy("k").agg(F.max("other").alias("other"), F.count("*").alias("voxels"))
    got = ranked(e, "k").agg(F.count("*"), F.count_if(F.col("edge_id") != F.col("k") + 1), F.max("other"), F.max("voxels")).first()
    assert tuple(got) == (n, 0, 2, 1)
