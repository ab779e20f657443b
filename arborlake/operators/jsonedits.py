"""Edits of JSON documents as node tables: values set, members and elements deleted and inserted, and the text made again.

nodes(doc_id, pointer, depth, kind, scalar, pos): one row a value, pos its place among its siblings. Elements are
named by their place, so an edit of an array re-bases the pointers of all elements behind it and of all that
lies below them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.settle import settle, unsettle
from ..functions.text import unescape_token
from ..sources.jsontree import BOXES, json_nodes

#: Why an edit was refused.
ROOT, BAD_OP, BAD_JSON, NOT_FOUND, NO_PARENT, NOT_A_CONTAINER, BAD_INDEX, KEY_EXISTS, NO_ANCHOR = "ROOT", "BAD_OP", "BAD_JSON", "NOT_FOUND", "NO_PARENT", "NOT_A_CONTAINER", "BAD_INDEX", "KEY_EXISTS", "NO_ANCHOR"
#: Fewer edits are known to every task.
FEW = 100_000
_NODE = ["doc_id", "pointer", "depth", "kind", "scalar", "pos"]
_INDEX = "^(0|[1-9][0-9]{0,8})$"


def _parent(pointer: Column) -> Column:
    return F.regexp_replace(pointer, "/[^/]*$", "")


def _last(pointer: Column) -> Column:
    return F.element_at(F.split(pointer, "/"), -1)


def _judged(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """edits with `code` (null: it may be applied), parent, token, the parent's kind and size, and the place that the value takes."""
    at = nodes.select("doc_id", F.col("pointer").alias("_up"), F.col("kind").alias("_kind"))
    sizes = nodes.where("depth > 0").groupBy("doc_id", _parent(F.col("pointer")).alias("_up")).agg(F.count("*").alias("_size"), (F.max("pos") + 1).alias("_next"))
    e = edits.withColumn("_up", F.when(F.col("pointer") != "", _parent(F.col("pointer")))).withColumn("_token", _last(F.col("pointer")))
    e = e.join(at.hint("merge"), ["doc_id", "_up"], "left").join(sizes.hint("merge"), ["doc_id", "_up"], "left").withColumn("_size", F.coalesce("_size", F.lit(0))).withColumn("_next", F.coalesce("_next", F.lit(0)))
    e = e.join(nodes.select("doc_id", "pointer", F.col("pos").alias("_here")).hint("merge"), ["doc_id", "pointer"], "left")
    beside = nodes.select("doc_id", F.col("pointer").alias("_beside"), F.col("pos").alias("_anchor"))
    e = e.withColumn("_beside", F.when(F.col("anchor").isNotNull(), F.concat("_up", F.lit("/"), F.col("anchor")))).join(beside.hint("merge"), ["doc_id", "_beside"], "left")
    array, index = F.col("_kind") == "array", F.col("_token").rlike(_INDEX)
    insert, delete, set_ = (F.col("op") == x for x in ("insert", "delete", "set"))
    found = F.col("_here").isNotNull()
    code = (
        F.when(~F.coalesce(insert | delete | set_, F.lit(False)), BAD_OP)
        .when((F.col("pointer") == "") & (insert | delete), ROOT)
        .when((insert | set_) & ~F.coalesce("_valued", F.lit(False)), BAD_JSON)
        .when((F.col("pointer") == "") & found, None)
        .when(F.col("_kind").isNull(), NO_PARENT)
        .when(~F.col("_kind").isin("object", "array"), NOT_A_CONTAINER)
        .when(array & ~index & ~(insert & (F.col("_token") == "-")), BAD_INDEX)
        .when(delete & ~found | set_ & array & ~found, NOT_FOUND)
        .when(insert & ~array & found, KEY_EXISTS)
        .when(insert & ~array & F.col("anchor").isNotNull() & F.col("_anchor").isNull(), NO_ANCHOR)
    )
    place = F.when(array, F.when(index, F.least(F.col("_token").cast("int"), F.col("_size").cast("int"))).otherwise(F.col("_size").cast("int")))
    place = place.when(F.col("_anchor").isNotNull(), F.col("_anchor") + F.when(F.col("side") == "before", 0).otherwise(1)).otherwise(F.col("_next"))
    place = F.when(insert, place).otherwise(F.coalesce("_here", "_next"))
    token = F.when(insert & array, place.cast("string")).otherwise(F.col("_token"))
    return e.withColumn("code", code).withColumn("_place", place.cast("int")).withColumn("_token", token)


def _step(nodes: DataFrame, e: DataFrame, values: DataFrame) -> DataFrame:
    """nodes after edits that may be applied, one a document at most."""
    e = e.select("doc_id", "op", "pointer", "_up", "_token", "_place", "_edit", (F.col("_kind") == "array").alias("_array")).withColumnRenamed("pointer", "_at")
    target = F.when(F.col("_at") == "", "").otherwise(F.concat("_up", F.lit("/"), F.col("_token")))
    e = e.withColumn("_target", target)
    j = nodes.join(e.hint("merge"), "doc_id", "left")
    p = F.col("pointer")
    within = (p == F.col("_target")) | p.startswith(F.concat("_target", F.lit("/"))) | (F.col("_target") == "")
    goes = F.coalesce(F.col("op").isin("delete", "set") & within, F.lit(False))
    below = p.startswith(F.concat("_up", F.lit("/")))
    rest = F.substring(p, F.length("_up") + 2, F.length(p))
    first = F.split_part(rest, F.lit("/"), F.lit(1))
    # Elements of the array from the place on move by one, with all below them; of an object only the places of its members do.
    shift = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    behind = F.coalesce(F.col("_array") & below & (first.try_cast("int") >= F.col("_place")) & (shift != 0), F.lit(False))
    moved = F.concat("_up", F.lit("/"), (first.try_cast("int") + shift).cast("string"), F.substring(rest, F.length(first) + 1, F.length(rest)))
    sibling = F.coalesce(below & ~rest.contains("/") & (F.col("pos") >= F.col("_place")) & (shift != 0), F.lit(False))
    kept = j.where(~goes).select("doc_id", F.when(behind, moved).otherwise(p).alias("pointer"), "depth", "kind", "scalar", F.when(sibling, F.col("pos") + shift).otherwise(F.col("pos")).cast("int").alias("pos"))
    put = e.where("op <> 'delete'").join(values.hint("merge"), "_edit")
    new = put.select("doc_id", F.concat("_target", "v_pointer").alias("pointer"), (F.col("v_depth") + F.size(F.split("_target", "/")) - 1).alias("depth"), F.col("v_kind").alias("kind"), F.col("v_scalar").alias("scalar"), F.when(F.col("v_pointer") == "", F.col("_place")).otherwise(F.col("v_pos")).cast("int").alias("pos"))
    return kept.unionByName(new)


def edit_json(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes after edits, and (doc_id, seq, code) of every edit: code is null where it was applied.

    edits(doc_id, seq, op, pointer, value, anchor, side), one document's in the order of seq:
    `set` puts value (a JSON text) at pointer in place of what is there, or as a new last member of an object;
    `delete` takes away what is at pointer; `insert` puts value where pointer says: into an array at that index
    (beyond its end, or `-`: last), or into an object as a new member, last or, with anchor (a member's token) and
    side, before or after it. The root can be set but neither deleted nor inserted. A refused edit changes nothing,
    and those after it see what the ones before made.
    """
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    e = edits.withColumn("_edit", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string"))).withColumn("_k", rank)
    values = settle(json_nodes(e.select(F.col("_edit").alias("doc_id"), F.col("value").alias("json"))))
    values = values.select(F.col("doc_id").alias("_edit"), *[F.col(c).alias(f"v_{c}") for c in _NODE[1:]])
    valued = values.where("v_pointer = ''").select("_edit", F.lit(True).alias("_valued"))
    e = settle(e.join(valued.hint("merge"), "_edit", "left"))
    waves, n = e.agg(F.max("_k"), F.count("*")).first()
    # Only documents that edits name take part. Many edits are no larger on disk than few, so their number says how to find them.
    touched = e.select("doc_id").distinct()
    touched = F.broadcast(touched) if n < FEW else touched.hint("merge")
    now, reports = settle(nodes.select(_NODE).join(touched, "doc_id", "left_semi")), []
    for k in range(1, (waves or 0) + 1):
        judged = settle(_judged(e.where(F.col("_k") == k), now))
        reports.append(judged.select("doc_id", "seq", "code"))
        new = settle(_step(now, judged.where("code is null"), values))
        unsettle(now)
        now = new
    rest = nodes.select(_NODE).join(touched, "doc_id", "left_anti")
    report = reduce(DataFrame.unionByName, reports) if reports else edits.select("doc_id", "seq", F.lit(None).cast("string").alias("code"))
    return rest.unionByName(now), report


def json_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, json) of node tables, members in the order of pos; level by level from below, as deep as they go."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    scalar = F.when(F.col("kind") == "string", quoted(F.coalesce("scalar", F.lit("")))).when(F.col("kind") == "null", "null").when(~F.col("kind").isin("object", "array"), F.col("scalar"))
    rows = nodes.withColumn("_t", scalar)
    box = F.col("kind").isin(*BOXES)
    part = "struct<pos: int, name: string, text: string>"
    name = quoted(unescape_token(_last(F.col("pointer"))))
    # A node goes up as a part of its parent: scalars as they are, objects and arrays when their own parts have come.
    up = lambda df, text: df.select("doc_id", _parent(F.col("pointer")).alias("pointer"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("pos"), F.struct("pos", name.alias("name"), text.alias("text")).cast(part).alias("part"))
    made, depth = None, rows.agg(F.max("depth")).first()[0]
    for d in range(depth if depth is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == d)
        own = level.where(box).select("doc_id", "pointer", "kind", "pos", F.lit(None).cast(part).alias("part"))
        parts = own.unionByName(up(rows.where((F.col("depth") == d + 1) & ~box), F.col("_t")))
        parts = parts if made is None else parts.unionByName(up(made, F.col("text")))
        each = parts.groupBy("doc_id", "pointer").agg(F.max("kind").alias("kind"), F.max("pos").alias("pos"), F.array_sort(F.collect_list("part")).alias("_parts")).where("kind is not null")
        members = F.array_join(F.transform("_parts", lambda m: F.concat(m["name"], F.lit(":"), m["text"])), ",")
        items = F.array_join(F.transform("_parts", lambda m: m["text"]), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), members, F.lit("}"))).otherwise(F.concat(F.lit("["), items, F.lit("]")))
        made = each.select("doc_id", "pointer", "pos", text.alias("text"))
        if d == 0:
            return made.select("doc_id", F.col("text").alias("json")).unionByName(level.where(~box).select("doc_id", F.col("_t").alias("json")))
        made = settle(made)
    return nodes.select("doc_id", F.lit(None).cast("string").alias("json")).where("false")
