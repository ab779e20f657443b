"""Joins of large JSON node tables are never broadcast, however well their files compress."""

import contextlib
import io

from pyspark.sql import functions as F

from arborlake.functions.settle import settle
from arborlake.operators import jsonedits as E
from arborlake.sources.jsontree import json_nodes, lookup


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def docs(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit('{"a": [1, {"b": "x"}], "status": "F"}').alias("json"))


def test_lookup_shuffles(spark):
    nodes = json_nodes(docs(spark))
    asked = docs(spark).select("doc_id", F.explode(F.array(F.lit("/status"), F.lit("/nothing"))).alias("pointer"))
    found = lookup(nodes, asked)
    assert "Broadcast" not in plan(found)
    assert found.where("found").count() == 2000 and found.where("not found").count() == 2000


def test_edit_steps_shuffle(spark):
    nodes = settle(json_nodes(docs(spark)))
    edits = docs(spark).select("doc_id", F.lit("set").alias("op"), F.lit("/status").alias("pointer"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("side"), F.lit(True).alias("_valued"), F.col("doc_id").cast("string").alias("_edit"))
    judged = settle(E._judged(edits, nodes))
    assert "Broadcast" not in plan(E._judged(edits, nodes))
    values = nodes.where("pointer = '/a'").select(F.col("doc_id").cast("string").alias("_edit"), *[F.col(c).alias(f"v_{c}") for c in E._NODE[1:]])
    assert "Broadcast" not in plan(E._step(nodes, judged, values))
