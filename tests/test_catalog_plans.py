"""What queries over the catalog tree read, sort and join, beside their results."""

from pyspark.sql import functions as F

from arborlake.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def only_settled(df):
    return all("/settled-" in f for f in df.inputFiles())


def test_addresses_number_the_nodes_once(spark):
    """short ids are made once, and ids that are no UUID4 stay out of the join by ids."""
    from arborlake.operators import tree as T

    assert only_settled(QUERIES["b9_address_normalization"](spark, DIR))
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    nodes = spark.createDataFrame([(1, 1, "c:1"), (1, 2, u), (2, 1, u)], "doc_id long, short_id long, node_id string")
    asked = spark.createDataFrame([(1, u), (1, "0x1"), (1, "c:1"), (2, u), (3, u)], "doc_id long, address string")
    got = T.resolve_addresses(asked, nodes)
    assert {(r.doc_id, r.address): (r.node_id, r.error) for r in got.collect()} == {(1, u): (u, None), (1, "0x1"): ("c:1", None), (1, "c:1"): (None, "BAD_ADDRESS"), (2, u): (u, None), (3, u): (None, "UNKNOWN_NODE")}


def test_duplicate_ids_are_found_in_one_sort(spark):
    """F16: no join of all nodes with themselves; null keys are no duplicates."""
    from arborlake.operators import integrity as I

    rows = [(1, "a", 5), (1, "b", 5), (1, "c", 6), (2, "a", 5), (2, "b", None), (2, "c", None), (3, "a", 7), (3, "b", 7), (3, "c", 7)]
    got = I.duplicate_ids(spark.createDataFrame(rows, "doc_id long, node_id string, short_id long"), "short_id")
    assert sorted((r.check, r.doc_id, r.node_id) for r in got.collect()) == [("DUPLICATE_SHORT_ID", d, n) for d, n in ((1, "a"), (1, "b"), (3, "a"), (3, "b"), (3, "c"))]
    assert "Join" not in plan(got) and only_settled(QUERIES["j9_uniqueness"](spark, DIR))


def test_an_outline_from_a_node_sorts_its_subtree_alone(spark):
    """nodes outside of the start are left out first; depth counts from it, and its parent gets no row."""
    from arborlake.operators import tree as T

    rows = [("r", None, [0], []), ("a", "r", [0, 0], ["r"]), ("b", "r", [0, 1], ["r"]), ("c", "b", [0, 1, 0], ["r", "b"]), ("d", "c", [0, 1, 0, 0], ["r", "b", "c"])]
    nodes = spark.createDataFrame([(1, *r, "name", "xy") for r in rows] + [(2, *rows[0], "name", "xy")], "doc_id long, node_id string, parent_id string, ord_path array<int>, anc_ids array<string>, name string, content string").withColumn("depth", F.size("anc_ids"))
    start = spark.createDataFrame([(1, "b"), (1, "b"), (2, "none")], "doc_id long, node_id string")
    got = T.drill_down(nodes, 1, 0, 4096, start)
    assert only_settled(got)
    assert [(r.doc_id, r.node_id, r.record_type, r.n_nodes, r.n_children) for r in got.orderBy("used").collect()] == [(1, "b", "node", 3, 1), (1, "c", "node", 2, 1), (1, "d", "stub", 1, 0)]


def test_applied_subtrees_read_the_tree_once(spark):
    """seven reads of the nodes are not seven times the making of them."""
    assert only_settled(QUERIES["i8_apply_subtree"](spark, DIR))


def test_pointers_sort_by_their_tokens(spark):
    """the short key sorts as the array of tokens does, with the lowest characters too."""
    from arborlake.functions.text import pointer_order

    tokens = ["", "a", "b", "a!", "a\x00", "a\x01", "a\x02", "\x00", "\x01", "\x01\x01", "a~1b", "10", "9", "\u00e9"]
    rows = [(x,) for x in [""] + ["/" + a for a in tokens] + [f"/{a}/{b}" for a in tokens for b in tokens]]
    df = spark.createDataFrame(rows, "p string")
    by = lambda c: [r.p for r in df.orderBy(c).collect()]
    assert by(pointer_order(F.col("p"))) == by(F.split("p", "/")) and df.select(pointer_order(F.col("p"))).distinct().count() == len(rows)


def test_a_capped_result_is_sorted_once(spark):
    """counting all and capping share a sort."""
    df = QUERIES["g6_result_cap"](spark, DIR)
    sorts = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [doc_id" in x]
    assert len(sorts) == 1 and "ord_path" in sorts[0]


def test_inserts_with_hooks_read_the_tree_once(spark):
    """the numbered nodes are written once; an anchor's kind and parent come by one join."""
    from arborlake.operators import edits as E
    from arborlake.queries.edit_queries import HOOKS, hooked
    from arborlake.sources.catalog import catalog_nodes

    assert only_settled(QUERIES["u4_insert_with_hooks"](spark, DIR))
    n = catalog_nodes(spark, DIR)
    assert plan(E._kinds(hooked(n), n)).count("Join LeftOuter") == 2
