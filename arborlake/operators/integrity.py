"""Checks of node and reference tables: each gives violation rows (check, doc_id, node_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.settle import settle
from ..functions.text import is_uuid4


def _rows(df: DataFrame, check: str, node: str = "node_id") -> DataFrame:
    return df.select(F.lit(check).alias("check"), "doc_id", F.col(node).alias("node_id"))


def duplicate_ids(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes whose key, which is not null, another node of the document has too: one sort, in which equal keys meet."""
    rows = nodes.where(F.col("doc_id").isNotNull() & F.col(key).isNotNull()).select("doc_id", "node_id", F.col(key).alias("_key"))
    return _rows(rows.withColumn("_n", F.count("*").over(W.partitionBy("doc_id", "_key"))).where("_n > 1"), f"DUPLICATE_{key.upper()}")


def missing_parents(nodes: DataFrame) -> DataFrame:
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"))
    return _rows(nodes.where("parent_id is not null").join(up, ["doc_id", "parent_id"], "left_anti"), "MISSING_PARENT")


def asymmetric_edges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges (doc_id, parent_id, node_id) that only the child lists or only the parent pointers have."""
    a, b = children.select("doc_id", "parent_id", "node_id", F.lit(1).alias("a")), parents.select("doc_id", "parent_id", "node_id", F.lit(1).alias("b"))
    j = a.join(b, ["doc_id", "parent_id", "node_id"], "full")
    return j.where("a is null or b is null").select(F.when(F.col("a").isNull(), "NOT_LISTED_BY_PARENT").otherwise("NO_PARENT_POINTER").alias("check"), "doc_id", "node_id")


def unresolved_references(refs: DataFrame, nodes: DataFrame, loaded: DataFrame) -> DataFrame:
    """refs with status resolved, not_loaded (its document isn't here) or missing (it is, the node is not)."""
    n = nodes.select(F.col("doc").alias("target_doc"), F.col("node").alias("target_node"), F.lit(True).alias("_n"))
    j = refs.join(n, ["target_doc", "target_node"], "left").join(loaded.select(F.col("doc").alias("target_doc"), F.lit(True).alias("_d")), "target_doc", "left")
    return j.withColumn("status", F.when(F.col("_n"), "resolved").when(F.col("_d").isNull(), "not_loaded").otherwise("missing")).drop("_n", "_d")


def nodes_in_cycles(edges: DataFrame) -> DataFrame:
    """Of (doc_id, node_id, parent_id) the nodes of cycles and, if nodes have several parents, those between cycles.

    With one parent a node, by pointer doubling: what every node comes to after enough steps up is a root or
    the cycle. Else nodes without a parent or without a child here are taken off until none is left to take.
    Each round is written out, so that plans stay short. Nodes that are no one's parent are in no cycle, and in none of the rounds.
    """
    up = edges.where("parent_id is not null").select("doc_id", "node_id", "parent_id")
    up = settle(up.join(up.select("doc_id", F.col("parent_id").alias("node_id")).distinct(), ["doc_id", "node_id"], "left_semi").distinct())
    one = up.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return _rows(_cycles_of_one_parent(up) if one else _peeled(up), "CYCLE")


def _cycles_of_one_parent(up: DataFrame) -> DataFrame:
    n = None
    while True:
        ends = up.select("doc_id", F.col("parent_id").alias("node_id")).distinct()
        before, n = n, ends.count()
        if n in (before, 0):  # what is come to gets less until it is the cycles alone
            return ends
        next_ = up.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_next"))
        up = settle(up.join(next_, ["doc_id", "parent_id"]).select("doc_id", "node_id", F.col("_next").alias("parent_id")))


def _peeled(left: DataFrame) -> DataFrame:
    n = left.count()
    while n:
        ids, ups = left.select("doc_id", F.col("node_id").alias("parent_id")), left.select("doc_id", F.col("parent_id").alias("node_id"))
        left = settle(left.join(ids, ["doc_id", "parent_id"], "left_semi").join(ups, ["doc_id", "node_id"], "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def stale_generations(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    j = refs.join(nodes.select("doc_id", "node_id", "generation"), ["doc_id", "node_id"])
    return _rows(j.where("cached_generation <> generation"), "STALE_GENERATION")


def report(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations).groupBy("check").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def scope(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed nodes, their parents and children: what an edit can have broken."""
    c = nodes.join(changed, ["doc_id", "node_id"], "left_semi")
    up = c.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id is not null")
    down = nodes.join(c.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi").select("doc_id", "node_id")
    ids = c.select("doc_id", "node_id").union(up).union(down).distinct()
    return nodes.join(ids, ["doc_id", "node_id"], "left_semi")


def address_errors(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, node, target_doc, target_node, code) of references that cannot be right.

    refs(doc, node, target_doc null for local, target_node), nodes(doc, node). A local reference must name a node of
    its document: LOCAL_UNRESOLVED. An external one must be two ids in the form of UUID4: BAD_DOCUMENT, BAD_NODE; whether
    the other document is there, and has the node, is no question here (see unresolved_references).
    """
    here = nodes.select(F.col("doc"), F.col("node").alias("target_node"), F.lit(True).alias("_known")).distinct()
    local = refs.where("target_doc is null").join(here, ["doc", "target_node"], "left").where("_known is null").withColumn("code", F.lit("LOCAL_UNRESOLVED"))
    code = F.when(~is_uuid4(F.col("target_doc")), "BAD_DOCUMENT").when(~is_uuid4(F.col("target_node")), "BAD_NODE")
    external = refs.where("target_doc is not null").withColumn("code", code).where("code is not null")
    columns = ["doc", "node", "target_doc", "target_node", "code"]
    return local.select(columns).unionByName(external.select(columns))


def backlinks(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links (source, target) that one side counts and the other does not, or not as often: (source, target, what, n)."""
    a, b = outgoing.groupBy("source", "target").agg(F.count("*").alias("_a")), incoming.groupBy("source", "target").agg(F.count("*").alias("_b"))
    j = a.join(b, ["source", "target"], "full").withColumn("_a", F.coalesce("_a", F.lit(0))).withColumn("_b", F.coalesce("_b", F.lit(0))).where("_a <> _b")
    return j.select("source", "target", F.when(F.col("_a") > F.col("_b"), "missing_incoming").otherwise("missing_outgoing").alias("what"), F.abs(F.col("_a") - F.col("_b")).alias("n"))


def envelope_errors(envelopes: DataFrame, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """(doc_id, code) of rows whose fields are not as they should be: BAD_<FIELD>.

    fields: of each column its kind: ("uuid4", None), ("int", least), ("bool", None), ("sha256", None), ("one_of", values), ("text", most characters).
    """
    tests = []
    for name, (kind, x) in fields.items():
        c = F.col(name)
        ok = {
            "uuid4": lambda: is_uuid4(c), "int": lambda: c.cast("string").rlike("^-?[0-9]+$") & (c.cast("long") >= x), "bool": lambda: c.cast("string").isin("true", "false"),
            "sha256": lambda: c.rlike("^[0-9a-f]{64}$"), "one_of": lambda: c.isin(*x), "text": lambda: F.length(c) <= x,
        }[kind]()
        tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"BAD_{name.upper()}")))
    return envelopes.select("doc_id", F.explode(F.array_compact(F.array(*tests))).alias("code"))
