"""Cycles are sought without the leaves."""

from arborlake.operators import integrity as I


def test_leaves_are_in_no_round(spark, monkeypatch):
    rounds = []
    keep = I.settle
    monkeypatch.setattr(I, "settle", lambda df: rounds.append(keep(df)) or rounds[-1])
    edges = [(1, "x", "y"), (1, "y", "x"), (1, "t", "x"), *[(1, f"leaf{i}", "t") for i in range(50)], (1, "lost", "none")]
    got = I.nodes_in_cycles(spark.createDataFrame(edges, "doc_id long, node_id string, parent_id string"))
    assert sorted(r.node_id for r in got.collect()) == ["x", "y"]
    assert max(r.count() for r in rounds) == 3
