"""Cutting lineage in loops."""
from pyspark.sql import functions as F

from bermline.operators.graphs import list_order
from bermline.session import cut_lineage


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimates_do_not_grow_with_the_rounds(spark):
    cur = cut_lineage(spark.range(4).select("id", ((F.col("id") + 1) % 4).alias("ptr")))
    for _ in range(8):
        hop = cur.select(F.col("id").alias("_i"), F.col("ptr").alias("_p"))
        cur = cut_lineage(cur.join(hop, F.col("ptr") == F.col("_i")).select("id", F.col("_p").alias("ptr")))
        assert estimate(cur) < 2 ** 64
    assert sorted(map(tuple, cur.collect())) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_list_order_is_right_behind_a_large_estimate(spark):
    a = spark.range(40)
    for _ in range(6):  # a plan whose estimate is beyond any size
        a = a.join(a.withColumnRenamed("id", "o"), F.col("id") == F.col("o")).select("id")
    ids = F.struct("id", F.lit(0).alias("port"))
    links = a.select(ids.alias("id"), F.when(F.col("id") < 39, F.struct((F.col("id") + 1).alias("id"), F.lit(0).alias("port"))).alias("nxt"))
    got = list_order(links)
    assert estimate(got) < 2 ** 64
    assert {(r["id"]["id"], r["last"]["id"], r["hops"]) for r in got.collect()} == {(i, 39, 39 - i) for i in range(40)}
