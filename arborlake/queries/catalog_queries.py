"""Trees, selectors and outlines over the catalog tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, tree as T
from ..plans import selector as S
from ..plans.hooks import Hooks, admits_pairs, inadmissible
from ..sources.catalog import LEAF_ORDER, SQL, catalog_nodes
from .registry import query

WITH = f"WITH {SQL}"
#: The levels below the root straight from the tables, by their integer keys.
LEVELS = f"""top AS (SELECT o_custkey AS doc_id, c_name, c_mktsegment, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
low AS (SELECT top.*, l_orderkey, l_partkey, j FROM (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LEAF_ORDER)}) - 1 AS INT) AS j FROM lineitem) JOIN top ON l_orderkey = o_orderkey)"""
LEAF = "'l:' || l_orderkey || ':' || j"


@query(f"{WITH} SELECT doc_id, node_id, depth, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) - 1 AS preorder, array_to_string(anc_ids, '/') AS ancestors FROM nodes")
def b1_preorder_depth_ancestors(spark, d):
    edges = catalog_nodes(spark, d).select("doc_id", "node_id", "parent_id", "child_index")
    return T.preorder(T.with_paths(edges)).select("doc_id", "node_id", "depth", "preorder", F.array_join("anc_ids", "/").alias("ancestors"))


@query(f"{WITH} SELECT n.doc_id, n.node_id, a AS of_id, len(anc_ids) - list_position(anc_ids, a) + 1 AS relative FROM nodes n, unnest(anc_ids) u(a) WHERE a LIKE 'c:%' AND len(anc_ids) - list_position(anc_ids, a) + 1 <= 1")
def b2_descendants_to_depth(spark, d):
    n = catalog_nodes(spark, d)
    hit = n.withColumn("of_id", F.explode("anc_ids")).where("of_id like 'c:%'").withColumn("relative", F.size("anc_ids") - F.array_position("anc_ids", F.col("of_id")) + 1)
    return hit.where("relative <= 1").select("doc_id", "node_id", "of_id", "relative")


@query(f"WITH {LEVELS} SELECT doc_id, 'o:' || o_orderkey AS node_id, c_name AS parent_name FROM top UNION ALL SELECT doc_id, {LEAF}, 'order#' || l_orderkey FROM low")
def b2_parent(spark, d):
    return T.parent_of(catalog_nodes(spark, d)).select("doc_id", "node_id", "parent_name")


@query(f"{WITH} SELECT doc_id, node_id, CASE kind WHEN 'customer' THEN 'module' WHEN 'order' THEN 'class' ELSE 'method' END AS role FROM nodes")
def b3_semantic_role(spark, d):
    n = T.with_ancestors(catalog_nodes(spark, d).drop("role"), "kind")
    return T.semantic_roles(n, {"customer": "module", "order": "class", "lineitem": "function"}).select("doc_id", "node_id", "role")


@query(f"""WITH {LEVELS} SELECT c_custkey AS doc_id, 'c:' || c_custkey AS node_id, CAST(NULL AS VARCHAR) AS qualname FROM customer UNION ALL SELECT doc_id, 'o:' || o_orderkey, 'order#' || o_orderkey FROM top
UNION ALL SELECT doc_id, {LEAF}, 'order#' || l_orderkey || '.part#' || l_partkey FROM low""")
def b4_qualified_name(spark, d):
    return T.qualified_names(catalog_nodes(spark, d)).select("doc_id", "node_id", "qualname")


@query(f"{WITH} SELECT doc_id, node_id, doc_id % 7 + row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS short_id FROM nodes")
def b5_allocate_short_ids(spark, d):
    n = catalog_nodes(spark, d)
    start = n.where("depth = 0").select("doc_id", (F.col("doc_id") % 7 + 1).alias("next_short_id"))
    return T.allocate_short_ids(n, start).select("doc_id", "node_id", "short_id")


@query(f"""{WITH} SELECT doc_id, greatest(doc_id % 7 + 1, doc_id % 7 + count(*) + 1) AS next_short_id FROM nodes GROUP BY doc_id""")
def b5_next_short_id(spark, d):
    n = catalog_nodes(spark, d)
    start = n.where("depth = 0").select("doc_id", (F.col("doc_id") % 7 + 1).alias("next_short_id"))
    return T.next_short_ids(start, T.allocate_short_ids(n, start))


@query(f"""WITH RECURSIVE {SQL}, i AS MATERIALIZED (SELECT doc_id, child_index AS p, node_id, CAST(CASE WHEN child_index % 3 <> 1 THEN child_index * 2 % 11 + 1 END AS BIGINT) AS c FROM nodes WHERE depth = 1),
f(doc_id, p, used, nxt, node_id, sid) AS (SELECT DISTINCT doc_id, -1, CAST([1, 5] AS BIGINT[]), CAST(6 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM i UNION ALL
SELECT doc_id, p, list_append(used, g), greatest(nxt, g + 1), node_id, g FROM (SELECT f.doc_id, i.p, f.used, f.nxt, i.node_id, CASE WHEN c IS NOT NULL AND NOT list_contains(f.used, c) THEN c ELSE f.nxt END AS g FROM f JOIN i ON i.doc_id = f.doc_id AND i.p = f.p + 1))
SELECT doc_id, node_id, sid AS short_id FROM f WHERE p >= 0""")
def b6_merge_short_ids(spark, d):
    n = T.preorder(catalog_nodes(spark, d).where("depth = 1"))
    incoming = n.select("doc_id", F.col("preorder").alias("seq"), "node_id", F.when(F.col("preorder") % 3 != 1, F.col("preorder") * 2 % 11 + 1).alias("candidate"))
    taken = n.select("doc_id").distinct().select("doc_id", F.array(F.lit(1), F.lit(5)).cast("array<bigint>").alias("used"), F.lit(6).cast("long").alias("next_short_id"))
    return folds.merge_short_ids(incoming, taken)


@query(f"{WITH} SELECT doc_id, CASE WHEN depth = 1 AND doc_id % 5 = 0 THEN 'new-' || node_id ELSE node_id END AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS short_id FROM nodes")
def b7_rekey(spark, d):
    n = T.allocate_short_ids(catalog_nodes(spark, d))
    remap = n.where("depth = 1 and doc_id % 5 = 0").select("doc_id", F.col("node_id").alias("old_id"), F.concat(F.lit("new-"), "node_id").alias("new_id"))
    return T.rekey(n, remap).select("doc_id", "node_id", "short_id")


@query(f"""{WITH} SELECT doc_id, node_id, count(*) AS n_nodes, CAST(sum(b) AS BIGINT) AS n_bytes, CAST(sum(c) AS BIGINT) AS n_children FROM (
SELECT doc_id, unnest(list_append(anc_ids, node_id)) AS node_id, strlen(content) AS b, CASE WHEN parent_id = unnest(list_append(anc_ids, node_id)) THEN 1 ELSE 0 END AS c FROM nodes) GROUP BY ALL""")
def b15_subtree_aggregates(spark, d):
    return T.subtree_sizes(catalog_nodes(spark, d))


@query("""SELECT p_partkey, p_brand = 'Brand#13' AS eq, p_brand <> 'Brand#13' AS ne, contains(p_type, 'STEEL') AS has, starts_with(p_type, 'PROMO') AS pre, ends_with(p_type, 'BRASS') AS suf,
p_brand = 'Brand#13' AND p_size > 10 AS both_, NULL = 'x' IS NOT NULL AND false AS of_null FROM part""")
def c1_string_predicates(spark, d):
    from ..sources.catalog import table

    p = table(spark, d, "part").withColumn("none", F.lit(None).cast("string"))
    w = S.where
    return p.select(
        "p_partkey", w("p_brand", "=", "Brand#13").alias("eq"), w("p_brand", "!=", "Brand#13").alias("ne"), w("p_type", "~=", "STEEL").alias("has"), w("p_type", "^=", "PROMO").alias("pre"), w("p_type", "$=", "BRASS").alias("suf"),
        S.all_of(w("p_brand", "=", "Brand#13"), w("p_size", ">", 10)).alias("both_"), w("none", "!=", "x").alias("of_null"),
    )


@query(f"{WITH} SELECT doc_id, node_id FROM nodes WHERE coalesce(TRY_CAST(fields['line'] AS BIGINT) >= 3, false) AND NOT coalesce(TRY_CAST(fields['flag'] AS BIGINT) > 0, false)")
def c2_numeric_predicates(spark, d):
    n = catalog_nodes(spark, d)
    return n.where(S.where("fields.line", ">=", 3) & ~S.where("fields.flag", ">", 0)).select("doc_id", "node_id")


@query(f"{WITH} SELECT count(*) AS n, count(*) FILTER (WHERE role = 'class') AS classes FROM nodes")
def c3_empty_conjunction(spark, d):
    n = catalog_nodes(spark, d).where(S.all_of())
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "class").alias("classes"))


@query(f"{WITH} SELECT doc_id, node_id, 'UNKNOWN_ATTRIBUTE' AS code, 'status' AS attribute FROM nodes WHERE NOT list_contains(map_keys(fields), 'status')")
def c4_unknown_attribute(spark, d):
    return S.missing_attributes(catalog_nodes(spark, d), "fields.status")


@query(f"""{WITH} SELECT 'CLASS' AS t, count(*) AS n FROM nodes WHERE role = 'class' UNION ALL SELECT 'order', count(*) FROM nodes WHERE kind = 'order' UNION ALL SELECT 'Order', 0
UNION ALL SELECT 'Line:*', count(*) FROM nodes WHERE kind LIKE 'line%' OR kind LIKE '%line' UNION ALL SELECT 'Item:*', count(*) FROM nodes WHERE kind LIKE 'item%' OR kind LIKE '%item' UNION ALL SELECT '*', count(*) FROM nodes""")
def c5_type_match(spark, d):
    n = catalog_nodes(spark, d)
    types = ("CLASS", "order", "Order", "Line:*", "Item:*", "*")
    one = n.agg(*[F.count_if(S.of_type(t)).alias(f"c{i}") for i, t in enumerate(types)])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, types)), F.array(*[f"c{i}" for i in range(len(types))]))).alias("t", "n"))


@query(f"{WITH} SELECT doc_id, node_id, name FROM nodes WHERE role = 'method' AND name = 'part#7'")
def c6_field_search(spark, d):
    return catalog_nodes(spark, d).where(S.all_of(S.of_type("method"), S.where("name", "=", "part#7"))).select("doc_id", "node_id", "name")


@query(f"""{WITH} , m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS k FROM nodes WHERE role = 'class' AND fields['status'] = 'F')
SELECT r.doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_MATCH' WHEN n = 1 THEN 'UNIQUE' ELSE 'NON_UNIQUE' END AS status, coalesce(n, 0) AS n, coalesce(c, '') AS candidates
FROM (SELECT DISTINCT doc_id FROM nodes) r LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(node_id, ',' ORDER BY k) FILTER (WHERE k <= 10) AS c FROM m GROUP BY doc_id) g USING (doc_id)""")
def c8_require_one(spark, d):
    n = catalog_nodes(spark, d)
    return S.require_one(S.select("class", S.where("fields.status", "=", "F")).run(n), n)


@query(f"{WITH} SELECT doc_id, node_id, kind, role, name, array_to_string(anc_ids, '/') AS parent_path, content FROM nodes WHERE role = 'method' AND content = 'RF'")
def c9_match_projection(spark, d):
    return S.matches(S.select("method", S.where("content", "=", "RF")).run(catalog_nodes(spark, d)), source=True)


@query(f"{WITH} SELECT doc_id, node_id, coalesce(name, content, '') AS name_or_value, fields['status'] AS status FROM nodes WHERE list_contains(map_keys(fields), 'status')")
def c10_scalar_projection(spark, d):
    n = catalog_nodes(spark, d).withColumn("fields", F.map_filter("fields", lambda k, v: k == "status")).where(F.size("fields") > 0)
    return n.select("doc_id", "node_id", F.coalesce("name", "content", F.lit("")).alias("name_or_value"), F.element_at("fields", "status").alias("status"))


@query(f"{WITH} SELECT doc_id, node_id, n, CASE WHEN n < 5 THEN 'inline' ELSE 'drilldown' END AS mode FROM (SELECT doc_id, node_id, (SELECT count(*) FROM nodes c WHERE c.doc_id = p.doc_id AND c.parent_id = p.node_id) AS n FROM nodes p WHERE role = 'class')")
def c11_render_mode(spark, d):
    n = catalog_nodes(spark, d)
    kids = n.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    rows = n.where("role = 'class'").join(kids, ["doc_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("doc_id", "node_id", "n", F.when(F.col("n") < 5, "inline").otherwise("drilldown").alias("mode"))


@query(f"WITH {LEVELS} SELECT doc_id, {LEAF} AS node_id, 'order' AS parent_kind, 'lineitem' AS child_kind FROM low")
def c12_inadmissible_children(spark, d):
    return inadmissible(catalog_nodes(spark, d), Hooks(admits=admits_pairs(("customer", "order"))))


@query(f"WITH {LEVELS} SELECT doc_id, {LEAF} AS node_id FROM low WHERE o_orderstatus = 'O'")
def d1_child(spark, d):
    return S.select("class", S.where("fields.status", "=", "O")).child("method").run(catalog_nodes(spark, d)).select("doc_id", "node_id")


@query(f"WITH {LEVELS} SELECT doc_id, {LEAF} AS node_id FROM low WHERE c_mktsegment = 'BUILDING'")
def d2_descendant(spark, d):
    return S.select("module", S.where("fields.segment", "=", "BUILDING")).descendant("method").run(catalog_nodes(spark, d)).select("doc_id", "node_id")


@query(f"{WITH} SELECT doc_id, node_id FROM nodes WHERE role = 'class' AND NOT fields['status'] = 'F'")
def d3_negation(spark, d):
    n = catalog_nodes(spark, d)
    single = S.select("class", S.where("fields.status", "=", "F"))
    several = S.select("module").child("class")  # excludes nothing
    return S.select("class", single, several).run(n).select("doc_id", "node_id")


D4 = f"""{WITH} , f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS k FROM nodes WHERE role = 'method')
SELECT doc_id, node_id, kind, role, name, array_to_string(anc_ids, '/') AS parent_path FROM f
WHERE k = 1 AND (doc_id, parent_id) IN (SELECT doc_id, node_id FROM nodes WHERE role = 'class' AND fields['status'] = 'F')"""


@query(D4)
def d4_selector_chain(spark, d):
    chain = S.select("class", S.where("fields.status", "=", "F")).child("method", S.first())
    return S.matches(chain.run(catalog_nodes(spark, d)))


@query(f"{WITH} SELECT doc_id, node_id, CASE WHEN depth = 2 THEN parent_id WHEN depth = 1 THEN node_id ELSE node_id END AS statement_id, depth = 0 AS fallback FROM nodes")
def d7_statement_ancestor(spark, d):
    return T.statement_ancestor(catalog_nodes(spark, d), ["order"])


@query(f"""{WITH} , f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path DESC) AS z FROM nodes WHERE role = 'class')
SELECT doc_id, node_id, 'first' AS which FROM f WHERE a = 1 UNION ALL SELECT doc_id, node_id, 'last' FROM f WHERE z = 1 UNION ALL SELECT doc_id, node_id, 'third' FROM f WHERE a = 3""")
def f1_pseudos(spark, d):
    n = catalog_nodes(spark, d)
    got = [S.select("class", p).run(n).select("doc_id", "node_id", F.lit(w).alias("which")) for w, p in (("first", S.first()), ("last", S.last()), ("third", S.nth(2)))]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query(f"""{WITH} , r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS seq FROM nodes WHERE depth = 1 AND child_index % 4 <> 3)
SELECT doc_id AS request_id, count(DISTINCT child_index - seq) = 1 AS contiguous FROM r GROUP BY doc_id""")
def f2_sibling_runs(spark, d):
    n = catalog_nodes(spark, d)
    r = T.preorder(n.where("depth = 1 and child_index % 4 <> 3")).select(F.col("doc_id").alias("request_id"), "doc_id", "node_id", F.col("preorder").alias("seq"))
    return T.sibling_runs(n, r)


@query(f"{WITH} SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY -child_index, node_id) - 1 AS child_index FROM nodes WHERE child_index % 3 <> 1")
def f3_renumber(spark, d):
    n = catalog_nodes(spark, d).where("child_index % 3 <> 1").withColumn("sort_key", -F.col("child_index"))
    return T.renumber(n).select("doc_id", "node_id", "child_index")


@query(f"{WITH} SELECT doc_id, node_id, sum(length(name)) OVER (PARTITION BY doc_id ORDER BY ord_path) <= 200 AS shown FROM nodes")
def f8_running_budget(spark, d):
    from pyspark.sql import Window as W

    run = F.sum(F.length("name")).over(T.doc_order().rowsBetween(W.unboundedPreceding, 0))
    return catalog_nodes(spark, d).select("doc_id", "node_id", (run <= 200).alias("shown"))


@query(f"""{WITH} , k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes WHERE role = 'class')
SELECT doc_id, node_id, '1:-1' AS slice FROM k WHERE i >= 1 AND i < n - 1 UNION ALL SELECT doc_id, node_id, '-2:' FROM k WHERE i >= greatest(n - 2, 0)""")
def g1_slices(spark, d):
    from ..operators.lines import take_slice

    n = catalog_nodes(spark, d).where("role = 'class'")
    return take_slice(n, "doc_id", "ord_path", 1, -1).select("doc_id", "node_id", F.lit("1:-1").alias("slice")).unionByName(take_slice(n, "doc_id", "ord_path", -2, None).select("doc_id", "node_id", F.lit("-2:").alias("slice")))


G4 = f"""{WITH} , s AS (SELECT doc_id, a AS node_id, count(*) AS n_nodes, CAST(sum(b) AS BIGINT) AS n_bytes, CAST(sum(c) AS BIGINT) AS n_children FROM (
SELECT doc_id, a, strlen(content) AS b, CASE WHEN parent_id = a THEN 1 ELSE 0 END AS c FROM nodes, unnest(list_append(anc_ids, node_id)) u(a)) GROUP BY ALL),
r AS (SELECT n.*, n_nodes, n_bytes, n_children, depth > 0 AND NOT n_bytes <= 6 AS stub FROM nodes n JOIN s USING (doc_id, node_id)),
v AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r a WHERE a.doc_id = r.doc_id AND a.stub AND list_contains(r.anc_ids, a.node_id))),
u AS (SELECT *, CAST(sum(length(name) + CASE WHEN stub THEN 16 ELSE length(content) + 8 END) OVER (PARTITION BY doc_id ORDER BY ord_path) AS BIGINT) AS used FROM v)
SELECT doc_id, node_id, CASE WHEN stub THEN 'stub' ELSE 'node' END AS record_type, name, n_nodes, n_bytes, n_children, used, used <= 512 AS shown FROM u"""


@query(G4)
def g4_drill_down(spark, d):
    return T.drill_down(catalog_nodes(spark, d), depth=0, expand_below_bytes=6, max_output_bytes=512)


@query(f"SELECT doc_id, count(*) FILTER (WHERE shown) AS n_shown, count(*) FILTER (WHERE NOT shown) AS n_omitted, max(used) FILTER (WHERE shown) AS bytes_shown, min_by(node_id, used) FILTER (WHERE NOT shown) AS next_node_id FROM ({G4}) GROUP BY doc_id")
def g4_truncation(spark, d):
    return T.truncation(g4_drill_down(spark, d))


@query(f"""{WITH} , r AS (SELECT *, CASE WHEN depth = 1 THEN 1 ELSE 0 END AS top FROM nodes WHERE depth > 0 AND ord_path[2] = 1), k AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
u AS (SELECT r.*, k.n, CAST(sum(length(name) + length(content) + 8) OVER (PARTITION BY doc_id ORDER BY ord_path) AS BIGINT) AS used FROM r JOIN k USING (doc_id) WHERE depth = 2 AND child_index >= 1)
SELECT doc_id, node_id, 'node' AS record_type, name, 1 AS n_nodes, strlen(content) AS n_bytes, 0 AS n_children, used, used <= 40 AS shown, content[:1] AS preview FROM u""")
def g4_drill_down_from_address(spark, d):
    """From each customer's second order, going on at its second leaf."""
    n = catalog_nodes(spark, d)
    start = n.where("depth = 1 and child_index = 1").select("doc_id", "node_id")
    resume = n.where("depth = 2 and ord_path[1] = 1 and child_index = 1").select("doc_id", "node_id")
    return T.drill_down(n, 1, 0, 40, start, resume, 1)


@query(f"""{WITH} , f AS (SELECT doc_id, node_id, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS k FROM nodes WHERE role = 'method')
SELECT doc_id, node_id, total FROM f WHERE k <= 5""")
def g6_result_cap(spark, d):
    from pyspark.sql import Window as W

    # The count comes second, as it then needs no sort of its own.
    n = catalog_nodes(spark, d).where("role = 'method'").withColumn("k", F.row_number().over(T.doc_order()))
    return n.withColumn("total", F.count("*").over(W.partitionBy("doc_id"))).where("k <= 5").select("doc_id", "node_id", "total")


@query(f"""{WITH} SELECT c.doc_id, c.node_id, c.name, coalesce(string_agg(m.name, ',' ORDER BY m.child_index), '') AS methods, count(m.name) AS n_methods
FROM nodes c LEFT JOIN nodes m ON m.doc_id = c.doc_id AND m.parent_id = c.node_id WHERE c.role = 'class' GROUP BY ALL""")
def g7_structure_overview(spark, d):
    return T.structure_overview(catalog_nodes(spark, d))


@query(f"{WITH} SELECT doc_id, count(*) AS n_nodes, max(depth) AS max_depth, count(*) FILTER (WHERE role = 'class') AS classes, count(*) FILTER (WHERE role = 'method') AS methods FROM nodes GROUP BY doc_id")
def k11_tree_statistics(spark, d):
    n = catalog_nodes(spark, d)
    return n.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.count_if(F.col("role") == "class").alias("classes"), F.count_if(F.col("role") == "method").alias("methods"))


@query(f"""{WITH} SELECT a AS node_id, doc_id, 1 + count(*) FILTER (WHERE content IN ('RF', 'AF')) AS complexity FROM nodes, unnest(list_append(anc_ids, node_id)) u(a) WHERE a LIKE 'o:%' GROUP BY ALL HAVING complexity > 3""")
def k12_complexity(spark, d):
    n = catalog_nodes(spark, d).select("doc_id", "content", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("node_id")).where("node_id like 'o:%'")
    return n.groupBy("doc_id", "node_id").agg((1 + F.count_if(F.col("content").isin("RF", "AF"))).alias("complexity")).where("complexity > 3")


@query(f"{WITH} SELECT doc_id, node_id, name, kind FROM nodes WHERE role = 'class' AND name LIKE 'order#1%'")
def k9_find_classes(spark, d):
    return catalog_nodes(spark, d).where("role = 'class'").where(F.col("name").like("order#1%")).select("doc_id", "node_id", "name", "kind")


@query(f"WITH {LEVELS} SELECT doc_id, 'order#' || l_orderkey AS class_name, 'part#' || l_partkey AS method_name, j AS child_index FROM low WHERE CAST(l_orderkey AS VARCHAR) LIKE '1%'")
def k9_class_methods(spark, d):
    n = catalog_nodes(spark, d)
    c = n.where("role = 'class'").where(F.col("name").like("order#1%")).select("doc_id", F.col("node_id").alias("parent_id"), F.col("name").alias("class_name"))
    return n.where("role = 'method'").join(c, ["doc_id", "parent_id"]).select("doc_id", "class_name", F.col("name").alias("method_name"), "child_index")


@query(f"{WITH} SELECT kind, role, count(*) AS n, count(DISTINCT name) AS names FROM nodes GROUP BY ALL")
def k9_entities(spark, d):
    return catalog_nodes(spark, d).groupBy("kind", "role").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))
