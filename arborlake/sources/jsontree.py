"""JSON texts as node rows with pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.settle import settle, settled_columns
from ..functions.text import as_uuid, escape_token

BOXES = ("object", "array")


def json_nodes(docs: DataFrame, text: str = "json") -> DataFrame:
    """(doc_id, pointer, depth, kind, scalar, pos): one row a value, objects and arrays included; pos is its place in an array, and among an object's members by name.

    Level by level, as deep as texts go; each level is written out. Texts that are no JSON give no rows: see rejected().
    Only objects and arrays are written with their values, and the rows are read without them: by a variant's assumed
    size Spark would take all other columns for a thirtieth of what they are, and broadcast whole tables.
    """
    level = docs.select("doc_id", F.lit("").alias("pointer"), F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.try_parse_json(text).alias("v"))
    levels = []
    while True:
        written = settle(_typed(level))
        rows = settled_columns(written, "doc_id", "pointer", "depth", "kind", "scalar", "pos")
        levels.append(rows if levels else rows.where("kind is not null"))
        boxes = written.where(F.col("kind").isin(*BOXES))
        if boxes.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        down = docs.sparkSession.sql("select l.doc_id, l.pointer, l.depth, e.key, e.pos, e.value as v from {l} l, lateral variant_explode(l.v) e", l=boxes)
        token = F.coalesce(escape_token(F.col("key")), F.col("pos").cast("string"))
        level = down.select("doc_id", F.concat("pointer", F.lit("/"), token).alias("pointer"), (F.col("depth") + 1).alias("depth"), F.col("pos").cast("int").alias("pos"), "v")


def _typed(level: DataFrame) -> DataFrame:
    """level with kind (null: no value), the scalar, and v where it holds others."""
    level = level.withColumn("_s", F.schema_of_variant("v"))
    object_, array = F.col("_s").startswith("OBJECT"), F.col("_s").startswith("ARRAY")
    kind = F.when(object_, "object").when(array, "array").when(F.col("_s") == "STRING", "string").when(F.col("_s") == "BOOLEAN", "boolean").when(F.col("_s") == "VOID", "null").when(F.col("_s").isNotNull(), "number")
    box = object_ | array
    return level.select("doc_id", "pointer", "depth", kind.alias("kind"), F.when(~box, F.expr("try_variant_get(v, '$', 'string')")).alias("scalar"), "pos", F.when(box, F.col("v")).alias("v"))


def rejected(docs: DataFrame, text: str = "json") -> DataFrame:
    return docs.where(F.try_parse_json(text).isNull()).select("doc_id", F.lit("FORMAT_CONTENT_PARSE_FAILED").alias("code"))


def with_stable_ids(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("node_id", as_uuid(F.col("doc_id").cast("string"), F.col("pointer")))


def ambiguous_pointers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by pointers of their own, and pointers that more than one node claims."""
    each = nodes.groupBy("doc_id", "pointer").agg(F.count("*").alias("n"))
    return nodes.join(each.where("n = 1"), ["doc_id", "pointer"], "left_semi"), each.where("n > 1").select("doc_id", "pointer", "n")


def lookup(nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    """Of each (doc_id, pointer) whether it is there, its kind and its scalar."""
    j = pointers.join(nodes.hint("merge"), ["doc_id", "pointer"], "left")
    return j.select("doc_id", "pointer", F.col("kind").isNotNull().alias("found"), "kind", "scalar")


def set_values(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes with the scalars of edits(doc_id, pointer, value) at their pointers; objects and arrays stay as they are."""
    j = nodes.join(edits.select("doc_id", "pointer", F.col("value").alias("_v"), F.lit(True).alias("_e")), ["doc_id", "pointer"], "left")
    one = F.col("_e") & ~F.col("kind").isin("object", "array")
    return j.withColumn("scalar", F.when(one, F.col("_v")).otherwise(F.col("scalar"))).select(nodes.columns)


def scalars_with_children(nodes: DataFrame) -> DataFrame:
    """(doc_id, pointer) of scalars that another node's pointer goes through."""
    up = nodes.where("depth > 0").select("doc_id", F.regexp_replace("pointer", "/[^/]*$", "").alias("pointer")).distinct()
    return nodes.where(~F.col("kind").isin("object", "array")).join(up, ["doc_id", "pointer"], "left_semi").select("doc_id", "pointer")
