"""Transactions, block moves, bodies and subtree copies; deep trees and cycles."""

from pyspark.sql import functions as F

from arborlake.operators import edits as E, integrity as I, tree as T
from arborlake.sources import jsontree as J

NODES = [("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "r", 2), ("a1", "a", 0), ("b1", "b", 0)]
SCHEMA = "batch_id long, seq long, doc_id long, expected_version int, op string, node_id string, position string, anchor_id string, name string"


def trees(spark, *docs):
    rows = [(d, n, p, i, "k", "node", n.upper(), {"x": n}, f"text of {n}") for d in docs for n, p, i in NODES]
    return T.with_paths(spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, child_index int, kind string, role string, name string, fields map<string, string>, content string"))


def apply(spark, edits, docs=(1,)):
    now, versions, errors = E.transaction_report(trees(spark, *docs), spark.createDataFrame(edits, SCHEMA), spark.createDataFrame([(d, 1) for d in docs], "doc_id long, version int"))
    out = {}
    for r in now.orderBy("doc_id", "ord_path").collect():
        out.setdefault(r.doc_id, []).append((r.node_id, "/".join(r.anc_ids), r.content, (r.fields or {}).get("status")))
    return out, {r.doc_id: r.version for r in versions.collect()}, sorted(map(tuple, errors.collect()))


def shape(tree):
    return [f"{up}/{n}" for n, up, *_ in tree]


WHOLE = ["/r", "r/a", "r/a/a1", "r/b", "r/b/b1", "r/c"]


def test_later_edits_see_earlier_ones(spark):
    got, versions, errors = apply(spark, [(1, 0, 1, 1, "insert", "n", "last_child", "r", "N"), (1, 1, 1, 1, "insert", "m", "first_child", "n", "M"), (1, 2, 1, 1, "set_attribute", "m", None, None, "new"), (1, 3, 1, 1, "move", "a", "after", "m", None)])
    assert shape(got[1]) == ["/r", "r/b", "r/b/b1", "r/c", "r/n", "r/n/m", "r/n/a", "r/n/a/a1"] and not errors and versions == {1: 2}
    at = {n: (c, s) for n, _, c, s in got[1]}
    assert at["m"] == (None, "new") and at["a1"] == ("text of a1", None)


def test_a_batch_with_an_error_leaves_no_trace(spark):
    moves = [(1, 0, 1, 1, "move", "a", "first_child", "b", None), (1, 1, 1, 1, "move", "b", "first_child", "a", None)]
    got, versions, errors = apply(spark, moves)
    assert shape(got[1]) == WHOLE and errors == [(1, 1, "CYCLE")] and versions == {1: 1}
    got, versions, errors = apply(spark, [(1, 0, 1, 1, "delete", "a", None, None, None), (1, 1, 1, 1, "set_attribute", "a1", None, None, "x")])
    assert shape(got[1]) == WHOLE and errors == [(1, 1, "UNKNOWN_NODE")]
    # over two documents: neither is changed
    got, versions, errors = apply(spark, [(1, 0, 1, 1, "delete", "a", None, None, None), (1, 1, 2, 1, "delete", "none", None, None, None)], (1, 2))
    assert shape(got[1]) == shape(got[2]) == WHOLE and versions == {1: 1, 2: 1}


def test_versions_are_those_at_the_start_of_a_batch(spark):
    one = (1, 0, 1, 1, "delete", "a", None, None, None)
    got, versions, errors = apply(spark, [one, (2, 0, 1, 1, "delete", "b", None, None, None), (3, 0, 1, 2, "delete", "c", None, None, None), (3, 1, 2, 1, "set_attribute", "r", None, None, "s")], (1, 2))
    assert shape(got[1]) == ["/r", "r/b", "r/b/b1"] and errors == [(2, 0, "STALE_VERSION")] and versions == {1: 3, 2: 2}
    assert [s for *_, s in got[2]][:2] == ["s", None]
    got, versions, errors = apply(spark, [], (1,))
    assert shape(got[1]) == WHOLE and versions == {1: 1}


def test_block_move(spark):
    n = trees(spark, 1, 2, 3)
    rows = [(d, i, d, x, "after", y) for d, xs, y in ((1, "ab", "c"), (2, "ac", "b"), (3, "ab", "b1")) for i, x in enumerate(xs)]
    rows = [(b, i, d, x, p, y) for b, i, d, x, p, y in rows]
    now, bad = E.move_block(n, spark.createDataFrame(rows, "batch_id long, seq long, doc_id long, node_id string, position string, anchor_id string"))
    got = {d: [r.node_id for r in now.where(f"doc_id = {d} and parent_id = 'r'").orderBy("child_index").collect()] for d in (1, 2, 3)}
    assert got == {1: ["c", "a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"]} and sorted(map(tuple, bad.collect())) == [(2, "NOT_A_RUN"), (3, "CYCLE")]


def test_body_and_subtree_copies(spark):
    n = trees(spark, 1, 2)
    kids = spark.createDataFrame([(1, "n", "a", 0)], "doc_id long, node_id string, parent_id string, child_index int")
    now = E.set_body(n, spark.createDataFrame([(1, "a", "new")], "doc_id long, node_id string, content string"), kids)
    assert {(r.node_id, r.content) for r in now.where("doc_id = 1").collect()} == {("r", "text of r"), ("a", "new"), ("n", None), ("b", "text of b"), ("b1", "text of b1"), ("c", "text of c")}
    copies = [(1, "a", "a", None, 5), (1, "a", "n1", "a", 0), (1, "a", "n2", "n1", 0), (2, "a", "a", None, 0), (2, "a", "b1", "a", 0), (2, "c", "x", "c", 0)]
    now, bad = E.apply_subtrees(n, spark.createDataFrame(copies, "doc_id long, root_id string, node_id string, parent_id string, child_index int"))
    assert sorted(map(tuple, bad.collect())) == [(2, "a", "NODE_ID_CONFLICT"), (2, "c", "UNKNOWN_NODE")]
    got = {d: [f"{'/'.join(r.anc_ids)}/{r.node_id}" for r in T.with_paths(now).where(f"doc_id = {d}").orderBy("ord_path").collect()] for d in (1, 2)}
    assert got == {1: ["/r", "r/a", "r/a/n1", "r/a/n1/n2", "r/b", "r/b/b1", "r/c"], 2: WHOLE}


def test_deep_trees_and_cycles(spark):
    chain = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"), F.lit(0).alias("child_index"))
    rows = T.with_paths(chain).orderBy("depth").collect()
    assert [r.node_id for r in rows] == [f"n{i}" for i in range(500)] and rows[-1].anc_ids == [f"n{i}" for i in range(499)] and len(rows[-1].ord_path) == 500
    assert I.nodes_in_cycles(chain).count() == 0
    ring = [(1, "x", "y", 0), (1, "y", "x", 0), (1, "t", "x", 0), (1, "u", "t", 0), (1, "lost", "none", 0), (2, "s", "s", 0)]
    both = chain.unionByName(spark.createDataFrame(ring, "doc_id long, node_id string, parent_id string, child_index int"))
    assert T.with_paths(both).count() == 500
    assert sorted((r.doc_id, r.node_id) for r in I.nodes_in_cycles(both).collect()) == [(1, "x"), (1, "y"), (2, "s")]
    more = both.unionByName(spark.createDataFrame([(1, "y", "n3", 0)], "doc_id long, node_id string, parent_id string, child_index int"))
    assert sorted((r.doc_id, r.node_id) for r in I.nodes_in_cycles(more.where("node_id not like 'n%' or node_id in ('n1', 'n2', 'n3')")).collect()) == [(1, "x"), (1, "y"), (2, "s")]


def test_deep_json(spark):
    deep = "[" * 40 + "7" + "]" * 40
    got = J.json_nodes(spark.createDataFrame([(1, deep)], "doc_id long, json string")).collect()
    assert len(got) == 41 and max((r.depth, r.scalar) for r in got) == (40, "7")


def test_nodes_below_go_with_the_nearest_named_one(spark):
    """A node that left a deleted subtree takes what is below it, and what was left of the subtree goes; places beside nodes that move themselves."""
    edits = [(1, 0, 1, 1, "move", "b", "first_child", "a", None), (1, 1, 1, 1, "insert", "n", "after", "a1", "N"), (1, 2, 1, 1, "insert", "m", "before", "n", "M"), (1, 3, 1, 1, "move", "n", "last_child", "r", None), (1, 4, 1, 1, "move", "a1", "before", "n", None), (1, 5, 1, 1, "insert", "o", "after", "a1", "O"), (1, 6, 1, 1, "move", "b", "after", "c", None), (1, 7, 1, 1, "delete", "a", None, None, None), (1, 8, 1, 1, "insert", "a", "last_child", "b", "again")]
    got, versions, errors = apply(spark, [*edits, (2, 0, 2, 1, "delete", "b", None, None, None), (2, 1, 2, 1, "delete", "b1", None, None, None)], (1, 2))
    assert errors == [(2, 1, "UNKNOWN_NODE")] and versions == {1: 2, 2: 1} and shape(got[2]) == WHOLE
    assert shape(got[1]) == ["/r", "r/c", "r/b", "r/b/b1", "r/b/a", "r/a1", "r/o", "r/n"]
    bare = trees(spark, 1).drop("ord_path", "depth")
    n, _ = E.transaction(bare, spark.createDataFrame(edits, SCHEMA), spark.createDataFrame([(1, 1)], "doc_id long, version int"))
    assert {f"{'/'.join(r.anc_ids)}/{r.node_id}" for r in n.collect()} == set(shape(got[1])) and all(r.parent_id == (r.anc_ids or [None])[-1] for r in n.collect())


def test_a_transaction_settles_named_nodes_only(spark, monkeypatch):
    settled = []
    keep = E.settle
    monkeypatch.setattr(E, "settle", lambda df: settled.append(keep(df)) or settled[-1])
    nodes = trees(spark, 1).drop("ord_path", "depth")
    _, versions = E.transaction(nodes, spark.createDataFrame([(1, 0, 1, 1, "delete", "a", None, None, None)], SCHEMA), spark.createDataFrame([(1, 1)], "doc_id long, version int"))
    assert [r.version for r in versions.collect()] == [2]
    assert not any("content" in t.columns for t in settled)
