"""Versions after a transaction, without the nodes."""

from pyspark.sql import functions as F

from arborlake.operators import edits as E


def test_versions_read_no_texts(spark, monkeypatch):
    """Whoever asks for versions alone gets them though the nodes after the transaction could not be made."""
    nodes = spark.createDataFrame([(1, "r", None, 0, [], ""), (1, "a", "r", 0, ["r"], "")], "doc_id long, node_id string, parent_id string, child_index int, anc_ids array<string>, content string")
    nodes = nodes.withColumn("content", F.raise_error(F.lit("content was read")).cast("string"))
    edits = [(b, 0, 1, b, "insert", f"n{b}", "last_child", "a", "N") for b in (1, 2)]
    _, versions = E.transaction(nodes, spark.createDataFrame(edits, "batch_id long, seq long, doc_id long, expected_version int, op string, node_id string, position string, anchor_id string, name string"), spark.createDataFrame([(1, 1)], "doc_id long, version int"))
    assert [tuple(r) for r in versions.collect()] == [(1, 3)]
