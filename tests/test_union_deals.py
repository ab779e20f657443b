"""Folds over unions whose sides are dealt by the same key already, but coalesced to different numbers of tasks."""

import pytest
from pyspark.sql import Window as W, functions as F

from arborlake.operators import folds


@pytest.fixture
def coalesced(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_short_ids_meet_their_document(spark, coalesced):
    rows = spark.range(100_000).select((F.col("id") % 5000).alias("doc_id"), F.col("id").alias("node_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("node_id", "x")))
    incoming = rows.select("doc_id", "seq", "node_id", F.lit(None).cast("long").alias("candidate"))
    taken = rows.select("doc_id").distinct().select("doc_id", F.array(F.lit(1)).cast("array<bigint>").alias("used"), F.lit(100).cast("long").alias("next_short_id"))
    got = folds.merge_short_ids(incoming, taken).groupBy("doc_id").agg(F.min("short_id").alias("lo"), F.max("short_id").alias("hi"))
    assert got.where("lo <> 100 or hi <> 119").count() == 0 and got.count() == 5000
