"""Copies of subtrees and their references."""

from pyspark.sql import functions as F

from arborlake.operators import edits as E, tree as T

NODES = [("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("a1", "a", 0), ("a2", "a", 1), ("a11", "a1", 0)]


def trees(spark):
    return T.with_paths(spark.createDataFrame([(1, n, p, i) for n, p, i in NODES], "doc_id long, node_id string, parent_id string, child_index int"))


def test_copies_know_their_origins(spark):
    """Nested roots: a node below both is in both copies, each with a parent, a root and a place of its own."""
    c = E.copy_subtrees(trees(spark), spark.createDataFrame([(1, "a"), (1, "a1"), (1, "b")], "doc_id long, node_id string"), "x").collect()
    fresh = {(r.root_id, r.origin_id): r.node_id for r in c}
    assert len(set(fresh.values())) == len(c) == 7
    for r in c:
        assert r.parent_id == (fresh[r.root_id, r.origin_parent] if r.origin_parent else None) and r.root_index == {"a": 0, "a1": 0, "b": 1}[r.root_id]
    assert {(r.root_id, r.origin_id, r.origin_parent, r.short_id) for r in c} == {("a", "a", None, 1), ("a", "a1", "a", 2), ("a", "a11", "a1", 3), ("a", "a2", "a", 4), ("a1", "a1", None, 1), ("a1", "a11", "a1", 2), ("b", "b", None, 1)}


def test_references_of_copies_know_their_origins(spark):
    c = E.copy_subtrees(trees(spark), spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, node_id string"), "x")
    refs = spark.createDataFrame([(1, "a2", None, "a1"), (1, "a2", None, "b"), (1, "a2", 2, "a1"), (1, "r", None, "a")], "doc long, node string, target_doc long, target_node string")
    fresh = {(r.root_id, r.origin_id): r.node_id for r in c.collect()}
    got = {(r.root_id, r.node, r.target_doc, r.target_node, r.origin_node, r.origin_target) for r in E.copied_references(refs, c).collect()}
    assert got == {("a", fresh["a", "a2"], None, fresh["a", "a1"], "a2", "a1"), ("a", fresh["a", "a2"], 1, "b", "a2", "b"), ("a", fresh["a", "a2"], 2, "a1", "a2", "a1")}


def test_copies_move_each_node_once(spark, monkeypatch):
    """nodes meet the roots of their document, and are not dealt once for each node above; many roots give the same copies."""
    roots = spark.createDataFrame([(1, "a"), (1, "a1"), (1, "b"), (2, "a"), (3, "none"), (None, "a")], "doc_id long, node_id string")
    nodes = trees(spark).unionByName(trees(spark).withColumn("doc_id", F.lit(2).cast("long"))).unionByName(trees(spark).withColumn("doc_id", F.lit(4).cast("long")))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(E.copy_subtrees(nodes, roots, "x"))
    assert len(want) == 11
    for name, value in (("FEW", 0), ("ROOTS", 2), ("ROOTS", 0)):
        monkeypatch.setattr(E, name, value)
        assert rows(E.copy_subtrees(nodes, roots, "x")) == want
    monkeypatch.setattr(E, "ROOTS", 2)
    one = E.copy_subtrees(nodes, roots.where("doc_id = 2"), "x")
    assert rows(one) == [r for r in want if "doc_id=2" in r]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not any("hashpartitioning(doc_id" in x and "root_id" in x.split("hashpartitioning")[1] for x in plan.splitlines())


def test_applied_subtrees_move_each_node_once(spark, monkeypatch):
    """the same with many roots; a copy is refused for an id elsewhere, an unknown root or a copy without its root."""
    nodes = trees(spark).withColumn("name", F.col("node_id"))
    copies = [("a1", "a1", "a", 0, "A1"), ("a1", "new", "a1", 0, "N"), ("b", "b", "r", 1, "B"), ("b", "a2", "b", 0, "clash"), ("none", "none", "r", 0, "x"), ("a2", "other", "a2", 0, "x")]
    copies = spark.createDataFrame([(1, *c) for c in copies], "doc_id long, root_id string, node_id string, parent_id string, child_index int, name string")
    for roots, few in ((64, 100_000), (64, 0), (0, 0)):
        monkeypatch.setattr(E, "ROOTS", roots)
        monkeypatch.setattr(E, "FEW", few)
        now, bad = E.apply_subtrees(nodes, copies)
        assert sorted((r.node_id, r.parent_id, r.child_index, r.name) for r in now.collect()) == [("a", "r", 0, "a"), ("a1", "a", 0, "A1"), ("a2", "a", 1, "a2"), ("b", "r", 1, "b"), ("new", "a1", 0, "N"), ("r", None, 0, "r")]
        assert sorted((r.root_id, r.code) for r in bad.collect()) == [("a2", "UNKNOWN_NODE"), ("b", "NODE_ID_CONFLICT"), ("none", "UNKNOWN_NODE")]
        plan = now._jdf.queryExecution().optimizedPlan().toString()
        assert ("explode" in plan) == (roots == 0)
