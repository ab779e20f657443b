"""Further rows: JSON Lines, exports, addresses, backfill, folds, constraints, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.settle import settle
from ..operators import corpus as K, edits as E, folds, integrity as I, jsonedits as JE, measures as M, tree as T
from ..sources import jsontree as J
from ..sources.catalog import SQL, catalog_nodes, table
from .corpus_queries import order_json
from .registry import query

WITH = f"WITH {SQL}"


@query("SELECT event_id, event_id % 3 = 0 AS drilled, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def a8_json_lines(spark, d):
    rows = table(spark, d, "events").withColumn("drilled", F.col("event_id") % 3 == 0)
    v = F.when(F.col("drilled"), F.try_parse_json("props"))  # only lines that are drilled into are parsed
    return rows.withColumn("_v", v).select("event_id", "drilled", F.expr("try_variant_get(_v, '$.k', 'bigint')").alias("k"))


@query("""SELECT o_orderkey, '{"custkey":' || o_custkey || ',"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS canonical FROM orders""")
def a14_canonical_json(spark, d):
    o = table(spark, d, "orders")
    cols = {"key": "o_orderkey", "custkey": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority"}
    return o.select("o_orderkey", F.to_json(F.struct(*[F.col(cols[k]).alias(k) for k in sorted(cols)])).alias("canonical"))


@query(f"""{WITH}, s AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path) AS sid FROM nodes), a AS (
SELECT doc_id, CAST(sid AS VARCHAR) AS address, sid, doc_id AS doc FROM s WHERE sid = 2 UNION ALL SELECT doc_id, '0x' || lower(to_hex(sid)), sid, doc_id FROM s WHERE sid = 3 UNION ALL SELECT doc_id, '99999', 99999, doc_id FROM s WHERE sid = 1 UNION ALL SELECT doc_id, '0xzz', NULL, doc_id FROM s WHERE sid = 1)
SELECT a.doc_id, a.address, s.node_id, CASE WHEN a.sid IS NULL THEN 'BAD_ADDRESS' WHEN s.node_id IS NULL THEN 'UNKNOWN_NODE' END AS error FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.sid = a.sid""")
def b9_address_normalization(spark, d):
    n = settle(T.allocate_short_ids(catalog_nodes(spark, d)).select("doc_id", "node_id", "short_id"))  # read five times
    sid = F.col("short_id")
    asked = n.where("short_id = 2").select("doc_id", sid.cast("string").alias("address"))
    asked = asked.union(n.where("short_id = 3").select("doc_id", X.to_hex(sid))).union(n.where("short_id = 1").select("doc_id", F.explode(F.array(F.lit("99999"), F.lit("0xzz")))))
    return T.resolve_addresses(asked, n)


@query("SELECT 'part:p:' || l_partkey AS address, 'part' AS document, 'p:' || l_partkey AS node, false AS is_local FROM lineitem UNION ALL SELECT 'o:' || l_orderkey, NULL, 'o:' || l_orderkey, true FROM lineitem")
def b10_address_strings(spark, d):
    i = table(spark, d, "lineitem")
    refs = i.select(F.lit("part").alias("document"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("node")).unionByName(i.select(F.lit(None).cast("string").alias("document"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node")))
    return refs.select(F.concat_ws(":", "document", "node").alias("address"), "document", "node", F.col("document").isNull().alias("is_local"))


@query("SELECT o_orderkey AS doc_id, 4 + 3 * (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS last_short_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def b11_identifier_table(spark, d):
    n = J.with_stable_ids(J.json_nodes(order_json(spark, d))).withColumn("ord_path", X.pointer_order(F.col("pointer")))
    ids = T.allocate_short_ids(n).select("doc_id", "short_id", "node_id", "pointer")
    return ids.groupBy("doc_id").agg(F.max("short_id").alias("last_short_id"))


@query("SELECT l_orderkey AS doc_id, '/' || l_linenumber AS pointer, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def b13_ambiguous_pointers(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("/"), F.col("l_linenumber").cast("string")).alias("pointer"))
    return J.ambiguous_pointers(n)[1]


@query(f"""{WITH}, e AS (SELECT doc_id, name, CASE WHEN child_index % 2 = 0 THEN node_id END AS node_id, node_id AS right_id, child_index FROM nodes WHERE depth = 1)
SELECT doc_id, name, CASE WHEN child_index % 3 = 0 AND child_index % 2 = 1 THEN 'generated' WHEN node_id IS NULL THEN right_id ELSE node_id END AS node_id FROM e""")
def d14_entity_backfill(spark, d):
    n = catalog_nodes(spark, d).where("depth = 1")
    entities = n.select("doc_id", F.lit("order").alias("kind"), "name", F.when(F.col("child_index") % 2 == 0, F.col("node_id")).alias("node_id"))
    return T.backfill_entities(entities, n.where("child_index % 3 <> 0")).select("doc_id", "name", "node_id")


def _replayed(edits: list[tuple[str, str, int]]) -> str:
    """The span (100, 20) after edits (start, end, new length) of SQL expressions, one select around the other."""
    sql = "SELECT doc_id, 100 AS s, 20 AS l, true AS x FROM documents"
    for a, b, n in edits:
        before, after, inside, delta = f"{b} <= s", f"{a} >= s + l", f"({a} >= s AND {b} <= s + l)", f"{n} - ({b} - {a})"
        sql = f"""SELECT doc_id, CASE WHEN {before} THEN s + {delta} WHEN {after} OR {inside} THEN s ELSE least(s, {a}) END AS s,
CASE WHEN {before} OR {after} THEN l WHEN {inside} THEN l + {delta} ELSE greatest(l + {delta}, 0) END AS l, CASE WHEN {before} OR {after} OR {inside} THEN x ELSE false END AS x FROM ({sql})"""
    return f"SELECT doc_id, 'a' AS anchor_id, s AS start, l AS length, x AS is_exact FROM ({sql})"


@query(_replayed([("0", "doc_id % 30", 5), ("90", "(92 + doc_id % 40)", 1)]))
def f5_offset_replay(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    anchors = t.select("doc_id", F.lit("a").alias("anchor_id"), F.lit(100).alias("start"), F.lit(20).alias("length"))
    edits = t.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("seq"), F.lit(0).alias("start"), (F.col("doc_id") % 30).cast("int").alias("end"), F.lit(5).alias("new_length")), F.struct(F.lit(2).alias("seq"), F.lit(90).alias("start"), (F.lit(92) + F.col("doc_id") % 40).cast("int").alias("end"), F.lit(1).alias("new_length")))))
    return folds.replay_offsets(anchors, edits)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'error' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'record' END AS c FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS size, 0 AS tip FROM events UNION ALL SELECT f.user_id, e.k, CASE c WHEN 'record' THEN tip + 1 ELSE size END, CASE c WHEN 'record' THEN tip + 1 WHEN 'undo' THEN greatest(tip - 1, 0) ELSE least(tip + 1, size) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id AS session_id, size AS length, tip AS "at", tip > 0 AS can_undo, tip < size AS can_redo FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def f6_undo_cursor(spark, d):
    e = table(spark, d, "events")
    command = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "click", "redo").otherwise("record")
    return folds.undo_cursor(e.select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"), command.alias("command")))


@query(f"{WITH} SELECT CASE WHEN depth = 1 AND doc_id % 5 = 0 THEN 'r-' || node_id ELSE node_id END AS node_id, CASE WHEN depth = 2 AND doc_id % 5 = 0 THEN 'r-' || parent_id ELSE parent_id END AS parent_id, doc_id FROM nodes")
def i11_replace_node_ids(spark, d):
    n = catalog_nodes(spark, d).select("doc_id", "node_id", "parent_id")
    remap = n.where("doc_id % 5 = 0 and node_id like 'o:%'").select("doc_id", F.col("node_id").alias("old_id"), F.concat(F.lit("r-"), "node_id").alias("new_id"))
    return T.replace_ids(n, remap)


#: Nodes of the JSON texts of orders with items (see order_json): members are in the order of their names.
ORDER_NODES = """o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
i AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS j FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
n AS (SELECT k AS doc_id, '' AS pointer, NULL AS scalar, 0 AS pos FROM o UNION ALL SELECT k, '/items', NULL, 0 FROM o UNION ALL SELECT k, '/key', CAST(k AS VARCHAR), 1 FROM o UNION ALL SELECT k, '/status', s, 2 FROM o
  UNION ALL SELECT k, '/items/' || j, NULL, j FROM i UNION ALL SELECT k, '/items/' || j || '/line', CAST(line AS VARCHAR), 0 FROM i UNION ALL SELECT k, '/items/' || j || '/part', CAST(part AS VARCHAR), 1 FROM i)"""


@query(f"""WITH {ORDER_NODES}, m AS (SELECT *, CASE WHEN pointer LIKE '/items/%' THEN CAST(split_part(pointer, '/', 3) AS INT) END AS j, regexp_replace(pointer, '^/items/[0-9]+', '') AS rest FROM n)
SELECT doc_id, CASE WHEN j IS NULL OR doc_id % 5 > 1 THEN pointer WHEN doc_id % 5 = 0 THEN '/items/' || (j - 1) || rest WHEN j >= 1 THEN '/items/' || (j + 1) || rest ELSE pointer END AS pointer, CASE WHEN doc_id % 5 = 4 AND pointer = '/status' THEN 'X' ELSE scalar END AS scalar,
  CASE WHEN j IS NOT NULL AND rest = '' AND doc_id % 5 = 0 THEN j - 1 WHEN j >= 1 AND rest = '' AND doc_id % 5 = 1 THEN j + 1 WHEN doc_id % 5 = 2 AND pointer = '/status' THEN 3 ELSE pos END AS pos FROM m WHERE NOT (doc_id % 5 = 0 AND j IS NOT DISTINCT FROM 0)
UNION ALL SELECT k, '/items/1' || x, CASE x WHEN '/new' THEN 'true' END, CASE x WHEN '/new' THEN 0 ELSE 1 END FROM o, unnest(['', '/new']) u(x) WHERE k % 5 = 1
UNION ALL SELECT k, '/note', 'n', 2 FROM o WHERE k % 5 = 2""")
def i17_json_edits(spark, d):
    """By the key mod 5: the first item goes, an item comes second, a member comes after `key`, the root's deletion is refused, the status is set."""
    docs = order_json(spark, d)
    k = F.col("doc_id") % 5
    by = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    edits = docs.select("doc_id", F.lit(0).alias("seq"), by("delete", "insert", "insert", "delete", "set").alias("op"), by("/items/0", "/items/1", "/note", "", "/status").alias("pointer"), by(None, '{"new":true}', '"n"', None, '"X"').alias("value"), F.when(k == 2, "key").alias("anchor"), F.when(k == 2, "after").alias("side"))
    return JE.edit_json(J.json_nodes(docs), edits)[0].select("doc_id", "pointer", "scalar", "pos")


@query("""WITH i AS (SELECT l_orderkey AS k, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, '{"items":' || items || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS json FROM orders JOIN i ON k = o_orderkey""")
def i17_json_text(spark, d):
    return JE.json_text(J.json_nodes(order_json(spark, d)))


@query(f"WITH {ORDER_NODES} SELECT doc_id, pointer, CASE WHEN doc_id % 2 = 0 AND pointer = '/status' THEN 'X' ELSE scalar END AS scalar FROM n")
def i17_json_value_edit(spark, d):
    n = J.json_nodes(order_json(spark, d))
    to = n.where("pointer = '/status' and doc_id % 2 = 0").select("doc_id", "pointer", F.lit("X").alias("value"))
    return J.set_values(n, to).select("doc_id", "pointer", "scalar")


@query(f"{WITH} SELECT doc_id, node_id, CASE WHEN depth < 2 AND k IS NOT NULL THEN 'NOT_A_LEAF' END AS error, CASE WHEN depth = 2 OR k IS NULL THEN 'new' ELSE content END AS content FROM nodes n LEFT JOIN (SELECT DISTINCT doc_id AS d, parent_id AS k FROM nodes) ON d = doc_id AND k = node_id")
def i21_leaf_content_edit(spark, d):
    n = catalog_nodes(spark, d)
    return E.set_leaf_content(n, n.select("doc_id", "node_id", F.lit("new").alias("new_content"))).select("doc_id", "node_id", "error", "content")


@query("""SELECT doc_id, code FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'BAD_VERSION' END AS a, CASE WHEN doc_id % 6 = 0 THEN 'BAD_DIGEST' END AS b, CASE WHEN doc_id % 5 = 0 THEN 'BAD_ID' END AS c, CASE WHEN doc_id % 7 = 0 THEN 'BAD_OPEN' END AS d, CASE WHEN lang NOT IN ('en', 'fr') THEN 'BAD_LANG' END AS e, CASE WHEN length(text) > 500 THEN 'BAD_TEXT' END AS f FROM documents), unnest([a, b, c, d, e, f]) u(code) WHERE code IS NOT NULL""")
def j8_envelope_validation(spark, d):
    id_ = X.as_uuid(F.col("doc_id").cast("string"))
    e = table(spark, d, "documents").select(
        "doc_id", "lang", "text", F.when(F.col("doc_id") % 4 == 0, -1).otherwise(1).alias("version"), F.when(F.col("doc_id") % 6 == 0, "short").otherwise(F.sha2("text", 256)).alias("digest"),
        F.when(F.col("doc_id") % 5 == 0, F.upper(F.concat(F.lit("a"), F.substring(id_, 2, 40)))).otherwise(id_).alias("id"), F.when(F.col("doc_id") % 7 == 0, "yes").otherwise("true").alias("open"),
    )
    return I.envelope_errors(e, {"version": ("int", 0), "digest": ("sha256", None), "id": ("uuid4", None), "open": ("bool", None), "lang": ("one_of", ["en", "fr"]), "text": ("text", 500)})


@query("SELECT 'p:' || l_partkey AS target, 'missing_incoming' AS what, count(*) AS n FROM lineitem WHERE l_orderkey % 11 = 0 GROUP BY ALL")
def j11_backlink_symmetry(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_linenumber").alias("line"))
    found = I.backlinks(i.select("source", "target"), i.where("source % 11 <> 0").select("source", "target"))
    return found.groupBy("target", "what").agg(F.sum("n").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS scalars_with_children, count(*) AS containers FROM (SELECT l_orderkey FROM lineitem UNION ALL SELECT DISTINCT l_orderkey FROM lineitem UNION ALL SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def j15_node_constraints(spark, d):
    n = J.json_nodes(order_json(spark, d)).withColumn("up", F.regexp_replace("pointer", "/[^/]*$", ""))
    kids = n.where("depth > 0").groupBy("doc_id", F.col("up").alias("pointer")).agg(F.count("*").alias("k"))
    j = n.join(kids, ["doc_id", "pointer"], "left")
    box = F.col("kind").isin("object", "array")
    return j.agg(F.count_if(~box & F.col("k").isNotNull()).alias("scalars_with_children"), F.count_if(box).alias("containers"))


@query("SELECT doc_id AS file, source AS module, lang AS name, 'from' AS type FROM documents WHERE source LIKE 'src1%' AND doc_id % 5 > 1")
def k8_imports_listing(spark, d):
    """Documents import their sources: whole where the id mod 5 is 0, all names where it is 1, else their language; asked for names of src1*."""
    k = F.col("doc_id") % 5
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("module"), F.when(k == 1, "*").when(k > 1, F.col("lang")).alias("name"))
    return K.imports(rows, "src1%", "from")


@query("SELECT count(*) AS events, count(*) FILTER (WHERE ts > m - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (WHERE event_type = 'error' AND ts > m - INTERVAL 24 HOUR) AS errors FROM events, (SELECT max(ts) AS m FROM events)")
def k17_database_status(spark, d):
    return M.recent_activity(table(spark, d, "events"))


@query(f"{WITH} SELECT doc_id, node_id, parent_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY CASE WHEN depth = 1 AND child_index = 0 THEN -1 ELSE child_index END, node_id) - 1 AS child_index FROM (SELECT doc_id, CASE WHEN depth = 1 AND child_index = 0 THEN 'rep:' || doc_id ELSE node_id END AS node_id, parent_id, child_index, depth FROM nodes WHERE NOT (depth = 2 AND ord_path[2] = 0))")
def i3_replace_range(spark, d):
    n = catalog_nodes(spark, d)
    first = n.where("depth = 1 and child_index = 0").select("doc_id", "node_id", F.col("parent_id").alias("anchor_id"))
    new = first.select(F.lit(0).cast("long").alias("seq"), "doc_id", F.lit("insert").alias("op"), F.concat(F.lit("rep:"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("first_child").alias("position"), "anchor_id", F.lit("replaced").alias("name"))
    left = E.delete(n, first.withColumn("op", F.lit("delete")))
    return E.insert(left, new).select("doc_id", "node_id", "parent_id", "child_index")
