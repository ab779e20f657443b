"""Edits, integrity and references over the catalog tree."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.settle import settle
from ..functions.text import as_uuid, is_uuid4
from ..operators import edits as E, integrity as I
from ..operators.tree import allocate_short_ids
from ..plans.hooks import Hooks, admits_pairs
from ..sources.catalog import SQL, catalog_nodes, table
from .registry import query

WITH = f"WITH {SQL}"
CHILDREN = "SELECT doc_id, node_id, parent_id, child_index"


def edits(spark, d):
    """One edit a customer with orders, its kind by the key mod 4; stale where mod 97 is 0, in a wrong place where mod 89 is 0."""
    c = table(spark, d, "customer").join(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("z")), "c_custkey")
    k = F.col("c_custkey")
    o = lambda x: F.concat(F.lit("o:"), F.col(x).cast("string"))
    op = F.when(k % 4 == 0, "insert").when(k % 4 == 1, "delete").when(k % 4 == 2, "move").otherwise("set_attribute")
    return c.select(
        k.alias("batch_id"), F.lit(0).cast("long").alias("seq"), k.alias("doc_id"), F.when(k % 97 == 0, 7).otherwise(1).alias("expected_version"), op.alias("op"),
        F.when(op == "insert", F.concat(F.lit("new:"), k.cast("string"))).otherwise(o("a")).alias("node_id"), F.when(k % 89 == 0, "inside").when(op == "insert", "first_child").otherwise("after").alias("position"),
        F.when(op == "insert", F.concat(F.lit("c:"), k.cast("string"))).otherwise(o("z")).alias("anchor_id"), F.lit("edited").alias("name"),
    )


def versions(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("version"))


def clean(spark, d):
    e = edits(spark, d)
    return e.join(E.preflight(e, catalog_nodes(spark, d), versions(spark, d)).select("batch_id").distinct(), "batch_id", "left_anti")


EDITS = """e_ AS (SELECT c_custkey AS k, min(o_orderkey) AS a, max(o_orderkey) AS z FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
bad AS (SELECT k, CASE WHEN k % 97 = 0 THEN 'STALE_VERSION' END AS b1, CASE WHEN k % 89 = 0 AND k % 4 IN (0, 2) THEN 'BAD_POSITION' END AS b2, CASE WHEN k % 4 = 2 AND a = z THEN 'CYCLE' END AS b3 FROM e_),
good AS (SELECT e_.* FROM e_ JOIN bad USING (k) WHERE b1 IS NULL AND b2 IS NULL AND b3 IS NULL)"""
LEFT = "child_index + 0.0 AS s"
#: Nodes after all good edits, with a sort key s among siblings.
CHILDREN_OF = """g AS (SELECT k AS doc_id, 'o:' || a AS x FROM good WHERE k % 4 = 1), mv AS (SELECT k AS doc_id, 'o:' || a AS node_id FROM good WHERE k % 4 = 2),
n AS (SELECT n.doc_id, n.node_id, n.parent_id, CASE WHEN mv.node_id IS NOT NULL THEN 1000000 ELSE child_index END + 0.0 AS s FROM nodes n LEFT JOIN mv USING (doc_id, node_id)
  LEFT JOIN g ON g.doc_id = n.doc_id AND (n.node_id = x OR n.parent_id = x) WHERE x IS NULL UNION ALL SELECT k, 'new:' || k, 'c:' || k, -1 FROM good WHERE k % 4 = 0)"""


@query(f"{WITH}, {EDITS} SELECT k AS batch_id, 0 AS seq, code FROM bad, unnest([b1, b2, b3]) u(code) WHERE code IS NOT NULL")
def i12_preflight(spark, d):
    return E.preflight(edits(spark, d), catalog_nodes(spark, d), versions(spark, d))


@query(f"""{WITH}, {EDITS}, n AS (SELECT doc_id, node_id, parent_id, {LEFT} FROM nodes UNION ALL SELECT k, 'new:' || k, 'c:' || k, -1 FROM good WHERE k % 4 = 0)
SELECT doc_id, node_id, parent_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY s, node_id) - 1 AS child_index FROM n""")
def i1_insert(spark, d):
    return E.insert(catalog_nodes(spark, d), clean(spark, d)).select("doc_id", "node_id", "parent_id", "child_index")


@query(f"""{WITH}, {EDITS}, g AS (SELECT k AS doc_id, 'o:' || a AS x FROM good WHERE k % 4 = 1)
SELECT n.doc_id, node_id, parent_id, row_number() OVER (PARTITION BY n.doc_id, parent_id ORDER BY child_index) - 1 AS child_index FROM nodes n LEFT JOIN g ON g.doc_id = n.doc_id AND (node_id = x OR parent_id = x) WHERE x IS NULL""")
def i2_delete(spark, d):
    return E.delete(catalog_nodes(spark, d), clean(spark, d)).select("doc_id", "node_id", "parent_id", "child_index")


@query(f"""{WITH}, {EDITS}, m AS (SELECT k AS doc_id, 'o:' || a AS node_id FROM good WHERE k % 4 = 2)
SELECT n.doc_id, n.node_id, parent_id, row_number() OVER (PARTITION BY n.doc_id, parent_id ORDER BY CASE WHEN m.node_id IS NOT NULL THEN 1000000 ELSE child_index END) - 1 AS child_index FROM nodes n LEFT JOIN m USING (doc_id, node_id)""")
def i4_move(spark, d):
    return E.move(catalog_nodes(spark, d), clean(spark, d)).select("doc_id", "node_id", "parent_id", "child_index")


@query(f"""{WITH}, {EDITS}, s AS (SELECT k AS doc_id, 'o:' || a AS node_id FROM good WHERE k % 4 = 3)
SELECT n.doc_id, n.node_id, CASE WHEN s.node_id IS NOT NULL THEN 'edited' ELSE fields['status'] END AS status, fields['priority'] AS priority FROM nodes n LEFT JOIN s USING (doc_id, node_id)""")
def i9_set_attribute(spark, d):
    n = E.set_attribute(catalog_nodes(spark, d), clean(spark, d), "status")
    return n.select("doc_id", "node_id", F.element_at("fields", "status").alias("status"), F.element_at("fields", "priority").alias("priority"))


def batches(spark, d):
    """Three edits a customer: that of edits(), then a node put last below the root, then an attribute of this new node."""
    e = edits(spark, d)
    own = F.concat(F.lit("last:"), F.col("doc_id").cast("string"))
    second = e.withColumn("seq", F.lit(1).cast("long")).withColumn("op", F.lit("insert")).withColumn("node_id", own).withColumn("position", F.lit("last_child")).withColumn("anchor_id", F.concat(F.lit("c:"), F.col("doc_id").cast("string")))
    third = second.withColumn("seq", F.lit(2).cast("long")).withColumn("op", F.lit("set_attribute"))
    return e.unionByName(second).unionByName(third)


@query(f"""{WITH}, {EDITS}, g AS (SELECT k AS doc_id, 'o:' || a AS x FROM good WHERE k % 4 = 1), m AS (SELECT k AS doc_id, 'o:' || a AS node_id FROM good WHERE k % 4 = 2), t AS (SELECT k AS doc_id, 'o:' || a AS node_id FROM good WHERE k % 4 = 3),
n AS (SELECT n.doc_id, n.node_id, n.parent_id, CASE WHEN m.node_id IS NOT NULL THEN 1000000 ELSE child_index END + 0.0 AS s, CASE WHEN t.node_id IS NOT NULL THEN 'edited' ELSE fields['status'] END AS status, content FROM nodes n LEFT JOIN m USING (doc_id, node_id) LEFT JOIN t USING (doc_id, node_id)
  LEFT JOIN g ON g.doc_id = n.doc_id AND (n.node_id = x OR n.parent_id = x) WHERE x IS NULL UNION ALL SELECT k, 'new:' || k, 'c:' || k, -1, NULL, NULL FROM good WHERE k % 4 = 0 UNION ALL SELECT k, 'last:' || k, 'c:' || k, 2000000, 'edited', NULL FROM good)
SELECT doc_id, node_id, parent_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY s, node_id) - 1 AS child_index, status, content FROM n""")
def i13_batch_transaction(spark, d):
    now, _ = E.transaction(catalog_nodes(spark, d).drop("ord_path", "depth"), batches(spark, d), versions(spark, d))
    return now.select("doc_id", "node_id", "parent_id", "child_index", F.element_at("fields", "status").alias("status"), "content")


@query(f"{WITH}, {EDITS} SELECT c_custkey AS doc_id, CASE WHEN k IS NULL THEN 1 ELSE 2 END AS version FROM customer LEFT JOIN good ON k = c_custkey")
def i13_versions(spark, d):
    return E.transaction(catalog_nodes(spark, d).drop("ord_path", "depth"), batches(spark, d), versions(spark, d))[1]


@query(f"""{WITH}, m AS (SELECT doc_id, node_id, child_index FROM nodes WHERE depth = 1 AND child_index < 2), z AS (SELECT doc_id, max(child_index) AS z FROM nodes WHERE depth = 1 GROUP BY doc_id HAVING max(child_index) >= 2)
SELECT n.doc_id, n.node_id, n.parent_id, row_number() OVER (PARTITION BY n.doc_id, n.parent_id ORDER BY CASE WHEN depth = 1 AND n.child_index < 2 AND z IS NOT NULL THEN 1000000 + n.child_index ELSE n.child_index END) - 1 AS child_index FROM nodes n LEFT JOIN z USING (doc_id)""")
def i5_block_move(spark, d):
    n = catalog_nodes(spark, d)
    last = n.where("depth = 1").groupBy("doc_id").agg(F.max_by("node_id", "child_index").alias("anchor_id"))
    e = n.where("depth = 1 and child_index < 2").join(last, "doc_id").select(F.col("doc_id").alias("batch_id"), F.col("child_index").cast("long").alias("seq"), "doc_id", "node_id", F.lit("after").alias("position"), "anchor_id")
    return E.move_block(n, e)[0].select("doc_id", "node_id", "parent_id", "child_index")


@query(f"""{WITH} SELECT doc_id, node_id, parent_id, child_index, CASE WHEN depth = 1 AND child_index = 0 THEN 'body of ' || name ELSE content END AS content FROM nodes n
WHERE NOT (depth = 2 AND ord_path[2] = 0) UNION ALL SELECT doc_id, 'part:' || node_id, node_id, 0, 'a part' FROM nodes WHERE depth = 1 AND child_index = 0""")
def i10_set_body(spark, d):
    n = catalog_nodes(spark, d)
    first = n.where("depth = 1 and child_index = 0")
    bodies = first.select("doc_id", "node_id", F.concat(F.lit("body of "), "name").alias("content"))
    parts = first.select("doc_id", F.concat(F.lit("part:"), "node_id").alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(0).alias("child_index"), F.lit("a part").alias("content"))
    return E.set_body(n, bodies, parts).select("doc_id", "node_id", "parent_id", "child_index", "content")


@query(f"""{WITH}, x AS (SELECT DISTINCT doc_id AS x FROM nodes WHERE depth = 2 AND ord_path[2] = 0 AND doc_id % 7 = 0)
SELECT doc_id, CASE WHEN depth = 2 AND ord_path[2] = 0 AND x IS NULL THEN 'e:' || node_id ELSE node_id END AS node_id, parent_id, child_index, CASE WHEN ord_path[2] = 0 AND depth > 0 AND x IS NULL THEN upper(name) ELSE name END AS name FROM nodes LEFT JOIN x ON x = doc_id""")
def i8_apply_subtree(spark, d):
    n = settle(catalog_nodes(spark, d).select("doc_id", "node_id", "parent_id", "child_index", "depth", "name", "ord_path", "anc_ids"))  # read seven times
    sub = n.where("depth > 0 and ord_path[1] = 0")
    root = F.when(F.col("depth") == 1, F.col("node_id")).otherwise(F.col("parent_id"))
    # Where the key mod 7 is 0 a leaf, if there is one, takes the id of the document's root: refused whole.
    own = F.when(F.col("depth") == 1, F.col("node_id")).when((F.col("doc_id") % 7 == 0) & (F.col("child_index") == 0), F.concat(F.lit("c:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("e:"), "node_id"))
    copies = sub.select("doc_id", root.alias("root_id"), own.alias("node_id"), "parent_id", "child_index", F.upper("name").alias("name"))
    return E.apply_subtrees(n, copies)[0].select("doc_id", "node_id", "parent_id", "child_index", "name")


@query(f"""{WITH} SELECT doc_id, node_id AS origin_id, CASE WHEN depth = 1 THEN NULL ELSE parent_id END AS origin_parent, ord_path[2] AS copy, row_number() OVER (PARTITION BY doc_id, ord_path[2] ORDER BY ord_path) AS short_id, child_index, kind, role, name, content, fields['flag'] AS flag, false AS kept
FROM nodes WHERE depth > 0 AND ord_path[2] < 2""")
def i7_copy_subtree(spark, d):
    """Copies of each customer's first two orders."""
    n = catalog_nodes(spark, d).withColumn("flag", F.element_at("fields", "flag")).drop("fields")
    c = E.copy_subtrees(n, n.where("depth = 1 and child_index < 2").select("doc_id", "node_id"), "copy-1")
    return c.select("doc_id", "origin_id", "origin_parent", F.col("root_index").alias("copy"), "short_id", "child_index", "kind", "role", "name", "content", "flag", (F.col("node_id") == F.col("origin_id")).alias("kept"))


@query(f"""{WITH}, r AS (SELECT doc_id, node_id, parent_id, child_index FROM nodes WHERE depth = 2 AND ord_path[2] = 0)
SELECT doc_id, node_id AS origin, CAST(NULL AS BIGINT) AS target_doc, parent_id AS target FROM r UNION ALL SELECT doc_id, node_id, doc_id, 'c:' || doc_id FROM r UNION ALL SELECT doc_id, node_id, -1, 'p:' || child_index FROM r""")
def i7_copied_references(spark, d):
    """Leaves of each first order refer to their order, to the root, which is not copied, and to a node of another document."""
    n = catalog_nodes(spark, d)
    leaves = n.where("depth = 2 and ord_path[1] = 0")
    none, root = F.lit(None).cast("long"), F.concat(F.lit("c:"), F.col("doc_id").cast("string"))
    targets = [F.struct(to.alias("target_doc"), t.alias("target_node")) for to, t in ((none, F.col("parent_id")), (none, root), (F.lit(-1).cast("long"), F.concat(F.lit("p:"), F.col("child_index").cast("string"))))]
    refs = leaves.select(F.col("doc_id").alias("doc"), F.col("node_id").alias("node"), F.inline(F.array(*targets)))
    c = E.copy_subtrees(n, n.where("depth = 1 and child_index = 0").select("doc_id", "node_id"), "copy-1")
    c = settle(c.select("doc_id", "root_id", "origin_id", "node_id"))  # read twice
    return E.copied_references(refs, c).select(F.col("doc").alias("doc_id"), F.col("origin_node").alias("origin"), "target_doc", F.col("origin_target").alias("target"))


#: Of each first order a new line, which belongs there, and a new order, which does not; both come without an id.
HOOKS = Hooks(identity=lambda batch, doc_id, seq: F.concat_ws(":", F.lit("u"), doc_id.cast("string"), seq.cast("string")), admits=admits_pairs(("customer", "order"), ("order", "lineitem")))


def hooked(n):
    first = n.where("depth = 1 and child_index = 0")
    kinds = F.posexplode(F.array(F.lit("lineitem"), F.lit("order"))).alias("_s", "kind")
    e = first.select("doc_id", F.col("node_id").alias("anchor_id"), kinds).select((F.col("doc_id") * 2 + F.col("_s")).alias("batch_id"), F.col("_s").cast("long").alias("seq"), "doc_id", F.lit("insert").alias("op"), F.lit(None).cast("string").alias("node_id"), F.lit("last_child").alias("position"), "anchor_id", "kind", F.concat(F.lit("new "), "kind").alias("name"))
    return e


@query(f"{WITH} SELECT doc_id * 2 + 1 AS batch_id, 1 AS seq, 'TYPE_REFUSED' AS code FROM nodes WHERE depth = 1 AND child_index = 0")
def u4_type_rule(spark, d):
    n = catalog_nodes(spark, d)
    return E.preflight(hooked(n), n, hooks=HOOKS)


@query(f"""{WITH}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS sid, count(*) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (WHERE depth = 2 AND ord_path[2] = 0) OVER (PARTITION BY doc_id) AS m FROM nodes)
SELECT doc_id, node_id, parent_id, child_index, kind, sid AS short_id FROM b UNION ALL SELECT doc_id, 'u:' || doc_id || ':0', node_id, m, 'lineitem', n + 1 FROM b WHERE depth = 1 AND child_index = 0""")
def u4_insert_with_hooks(spark, d):
    n = allocate_short_ids(catalog_nodes(spark, d))
    n = settle(n.select("doc_id", "node_id", "parent_id", "child_index", "depth", "kind", "anc_ids", "short_id"))  # read seven times
    e = hooked(n)
    good = e.join(E.preflight(e, n, hooks=HOOKS).select("batch_id"), "batch_id", "left_anti")
    return E.insert(n, good, HOOKS).select("doc_id", "node_id", "parent_id", "child_index", "kind", "short_id")


@query(f"{WITH} SELECT DISTINCT n.doc_id, n.node_id FROM nodes n JOIN nodes c ON c.doc_id = n.doc_id AND c.depth = 1 AND c.child_index = 0 AND (n.node_id = c.node_id OR n.node_id = c.parent_id OR n.parent_id = c.node_id)")
def i14_recheck_scope(spark, d):
    n = catalog_nodes(spark, d)
    return I.scope(n, n.where("depth = 1 and child_index = 0").select("doc_id", "node_id")).select("doc_id", "node_id")


def faulty(spark, d):
    """The tree with faults: short ids, which count from 0 in preorder, used twice, and parents that aren't there."""
    n = allocate_short_ids(catalog_nodes(spark, d))
    key = F.regexp_extract("node_id", r"(\d+)$", 1).cast("long")
    return n.withColumn("short_id", F.when((F.col("depth") == 1) & (key % 97 == 0), 0).otherwise(F.col("short_id") - 1)).withColumn("parent_id", F.when((F.col("depth") == 1) & (key % 89 == 0), "c:none").otherwise(F.col("parent_id"))).withColumn("generation", F.lit(1))


FAULTY = f"""{WITH}, f AS (SELECT doc_id, node_id, CASE WHEN depth = 1 AND CAST(regexp_extract(node_id, '(\\d+)$', 1) AS BIGINT) % 97 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) - 1 END AS short_id,
CASE WHEN depth = 1 AND CAST(regexp_extract(node_id, '(\\d+)$', 1) AS BIGINT) % 89 = 0 THEN 'c:none' ELSE parent_id END AS parent_id, parent_id AS listed, depth FROM nodes)"""


@query(f"{FAULTY} SELECT 'DUPLICATE_SHORT_ID' AS \"check\", doc_id, node_id FROM f WHERE (doc_id, short_id) IN (SELECT (doc_id, short_id) FROM f GROUP BY doc_id, short_id HAVING count(*) > 1)")
def j9_uniqueness(spark, d):
    # Written, so that no task holds the sort by paths and that by keys at once.
    return I.duplicate_ids(settle(faulty(spark, d).select("doc_id", "node_id", "short_id")), "short_id")


@query(f"""{FAULTY} SELECT 'NOT_LISTED_BY_PARENT' AS "check", doc_id, node_id FROM f WHERE parent_id <> listed UNION ALL SELECT 'NO_PARENT_POINTER', doc_id, node_id FROM f WHERE parent_id <> listed""")
def j10_parent_child_symmetry(spark, d):
    right = catalog_nodes(spark, d).where("depth > 0").select("doc_id", "parent_id", "node_id")
    return I.asymmetric_edges(right, faulty(spark, d).where("depth > 0").select("doc_id", "parent_id", "node_id"))


@query(f"""{FAULTY}, v AS (SELECT 'DUPLICATE_SHORT_ID' AS c, doc_id FROM f WHERE (doc_id, short_id) IN (SELECT (doc_id, short_id) FROM f GROUP BY doc_id, short_id HAVING count(*) > 1) UNION ALL SELECT 'MISSING_PARENT', doc_id FROM f WHERE parent_id = 'c:none')
SELECT c AS "check", count(*) AS n, count(DISTINCT doc_id) AS docs FROM v GROUP BY c""")
def e16_integrity_report(spark, d):
    n = faulty(spark, d)
    return I.report(I.duplicate_ids(n, "node_id"), I.duplicate_ids(n, "short_id"), I.missing_parents(n))


@query(f"""{WITH}, f AS (SELECT doc_id, min(node_id) AS a, max(node_id) AS b FROM nodes WHERE depth = 1 AND child_index < 2 GROUP BY doc_id HAVING count(*) = 2)
SELECT 'CYCLE' AS "check", doc_id, unnest([a, b]) AS node_id FROM f""")
def j13_cycles(spark, d):
    o = catalog_nodes(spark, d).where("depth = 1")
    swapped = o.where("child_index < 2").groupBy("doc_id").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b")).where("a <> b")
    ring = swapped.select("doc_id", F.inline(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("parent_id")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("parent_id")))))
    rest = catalog_nodes(spark, d).select("doc_id", "node_id", "parent_id").join(ring, ["doc_id", "node_id"], "left_anti")
    return I.nodes_in_cycles(rest.unionByName(ring))


@query(f"""{WITH} SELECT 'STALE_GENERATION' AS "check", doc_id, node_id FROM nodes WHERE doc_id % 13 = 0""")
def j14_stale_generations(spark, d):
    n = catalog_nodes(spark, d).withColumn("generation", F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1))
    return I.stale_generations(n.select("doc_id", "node_id", F.lit(1).alias("cached_generation")), n)


def refs(spark, d):
    i = table(spark, d, "lineitem")
    node = F.concat_ws(":", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    part = i.select(F.col("l_orderkey").cast("string").alias("doc"), node.alias("node"), F.lit("part").alias("target_doc"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target_node"))
    supplier = i.select(F.col("l_orderkey").cast("string").alias("doc"), node.alias("node"), F.when(F.col("l_suppkey") % 2 == 0, "supplier").otherwise("warehouse").alias("target_doc"), F.concat(F.lit("s:"), (F.col("l_suppkey") + F.when(F.col("l_suppkey") % 14 == 0, 100_000).otherwise(0)).cast("string")).alias("target_node"))
    return part.unionByName(supplier)


@query("SELECT target_doc, status, count(*) AS n FROM (SELECT 'part' AS target_doc, 'resolved' AS status FROM lineitem UNION ALL SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'supplier' ELSE 'warehouse' END, CASE WHEN l_suppkey % 2 <> 0 THEN 'not_loaded' WHEN l_suppkey % 14 = 0 THEN 'missing' ELSE 'resolved' END FROM lineitem) GROUP BY ALL")
def d8_reference_resolution(spark, d):
    n = table(spark, d, "part").select(F.lit("part").alias("doc"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("node")).unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("doc"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node")))
    got = I.unresolved_references(refs(spark, d), n, n.select("doc").distinct())
    return got.groupBy("target_doc", "status").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 7 AS m FROM lineitem)
SELECT m AS kind, CASE m WHEN 0 THEN 'LOCAL_UNRESOLVED' WHEN 1 THEN 'BAD_DOCUMENT' WHEN 2 THEN 'BAD_NODE' WHEN 3 THEN 'BAD_NODE' END AS code, count(*) AS n FROM r WHERE m < 4 GROUP BY ALL""")
def j12_address_errors(spark, d):
    """Lines refer, by their part mod 7, to a node that isn't there, to a document without a UUID, to one in capitals, to no node, to their order, or to good addresses."""
    i = table(spark, d, "lineitem")
    m, order = F.col("l_partkey") % 7, F.concat(F.lit("o:"), F.col("l_orderkey").cast("string"))
    id_ = lambda name: as_uuid(F.lit(name), F.col("l_partkey").cast("string"))
    doc = F.when(m == 1, "part").when(m.isin(2, 3, 5, 6), id_("doc"))
    node = F.when(m == 0, F.concat(order, F.lit("?"))).when(m == 2, F.upper(id_("node"))).when(m == 4, order).when(m != 3, id_("node"))
    refs = i.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("l"), m.cast("string")).alias("node"), doc.alias("target_doc"), node.alias("target_node"))
    nodes = i.select(F.col("l_orderkey").alias("doc"), order.alias("node")).distinct()
    return I.address_errors(refs, nodes).groupBy(F.substring("node", 2, 1).cast("long").alias("kind"), "code").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents), v AS (SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM u)
SELECT doc_id, doc_id % 5 = 0 AS is_uuid4 FROM v""")
def y3_uuid4(spark, d):
    """Each document's id in that form, and with a capital, of another version, without a hyphen, or with another variant."""
    id_ = as_uuid(F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 5
    bad = F.when(k == 1, F.concat(F.lit("A"), F.substring(id_, 2, 40))).when(k == 2, F.concat(F.substring(id_, 1, 14), F.lit("1"), F.substring(id_, 16, 40))).when(k == 3, F.replace(id_, F.lit("-"), F.lit(""))).when(k == 4, F.concat(F.substring(id_, 1, 19), F.lit("c"), F.substring(id_, 21, 40)))
    return table(spark, d, "documents").select("doc_id", is_uuid4(F.coalesce(bad, id_)).alias("is_uuid4"))


@query("SELECT 'p:' || l_partkey AS node, count(*) AS incoming, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY l_partkey")
def d9_incoming_references(spark, d):
    return refs(spark, d).where("target_doc = 'part'").groupBy(F.col("target_node").alias("node")).agg(F.count("*").alias("incoming"), F.count_distinct("doc").alias("docs"))


@query("""WITH r AS (SELECT 'orders' AS doc, 'o:' || o_orderkey AS node, 'o:' || lead(o_orderkey) OVER (ORDER BY o_orderkey) AS t FROM orders), x AS (SELECT node, t, CAST(substr(node, 3) AS BIGINT) % 5 = 0 AS s, CAST(substr(t, 3) AS BIGINT) % 5 = 0 AS m FROM r WHERE t IS NOT NULL)
SELECT CASE WHEN s THEN 'archive' ELSE 'orders' END AS doc, node, CASE WHEN s AND NOT m THEN 'orders' WHEN m AND NOT s THEN 'archive' END AS target_doc, t AS target_node FROM x""")
def i6_reference_rewrite(spark, d):
    # lead() inside ranges of keys, and from range to range by the ranges' first keys, so that no task has all orders.
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 4096).alias("r"))
    first = o.groupBy("r").agg(F.min("o_orderkey").alias("f")).withColumn("t", F.lead("f").over(W.orderBy("r"))).select("r", "t")
    o = o.withColumn("t", F.lead("o_orderkey").over(W.partitionBy("r").orderBy("o_orderkey"))).join(first.withColumnRenamed("t", "n"), "r").withColumn("t", F.coalesce("t", "n")).where("t is not null")
    r = o.select(F.lit("orders").alias("doc"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("target_doc"), F.concat(F.lit("o:"), F.col("t").cast("string")).alias("target_node"))
    moved = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return E.rewrite_references(r, moved, "orders", "archive")
