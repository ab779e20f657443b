"""Search, similarity, dependencies, JSON and streams (as batches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as K, duplicates as U, lines as L
from ..plans.registry import Format, Registry
from ..sources import jsontree as J, snapshot as S
from ..sources.catalog import table
from ..streaming import jobs
from .registry import query
from .text_queries import docs

WORDS = ["anan", "thin", "tion"]
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}, (SELECT count(*) FROM d WHERE list_contains(t, '{w}')) AS df{i}" for i, w in enumerate(WORDS))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(WORDS)))


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
x AS (SELECT doc_id, len(t) AS dl, {_TF} FROM d) SELECT doc_id, round({_SCORE}, 6) AS score FROM x, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def k1_full_text_search(spark, d):
    return K.bm25(table(spark, d, "documents"), WORDS)


@query(f"""WITH d AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
x AS (SELECT doc_id, source, len(t) AS dl, {_TF} FROM d) SELECT doc_id, round({_SCORE}, 6) AS score FROM x, s WHERE tf0 + tf1 + tf2 > 0 AND source IN ('src3', 'src5') ORDER BY score DESC, doc_id LIMIT 20""")
def k1_search_among_entities(spark, d):
    return K.bm25(table(spark, d, "documents"), WORDS, among=F.col("source").isin("src3", "src5"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, 1 / (1 + sqrt(list_sum(list_transform(list_zip(v.e, q.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10""")
def k2_semantic_search(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return K.semantic_search(v.select("vec_id", "embedding"), q).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings)
SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id < b.vec_id) WHERE cosine >= 0.4""")
def k4_semantic_duplicates(spark, d):
    # At the usual 0.85 these tables have no pair. The bound holds for the rounded cosine.
    found = K.semantic_duplicates(table(spark, d, "embeddings"), 0.4 - 1e-6)
    return K.pairs_of_copies(*found).select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.4D")


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, length(rtrim(text, chr(10))) - length(replace(rtrim(text, chr(10)), chr(10), '')) + 1 AS line_end, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE length(rtrim(text, chr(10))) - length(replace(rtrim(text, chr(10)), chr(10), '')) >= 4),
s AS MATERIALIZED (SELECT DISTINCT sha256(t) AS h, t FROM b),
g AS MATERIALIZED (SELECT h, list_distinct(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM (SELECT h, t, string_split(t, ' ') AS w FROM s)),
e AS MATERIALIZED (SELECT h, len(x) AS n, unnest(x) AS x FROM g),
l AS MATERIALIZED (SELECT p.h AS a, q.h AS b FROM e p JOIN e q ON p.x = q.x GROUP BY p.h, q.h HAVING count(*) >= 0.8 * (min(p.n) + min(q.n) - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS MATERIALIZED (SELECT a AS h, min(b) AS grp FROM r GROUP BY a),
k AS (SELECT grp, count(*) AS shapes, min(len(list_intersect(x.x, y.x)) / (len(x.x) + len(y.x) - len(list_intersect(x.x, y.x)))) AS similarity FROM c JOIN g x ON x.h = c.h JOIN g y ON y.h = c.grp GROUP BY grp),
o AS (SELECT grp, doc_id, 1 AS line_start, line_end, count(*) OVER (PARTITION BY grp) AS occurrences FROM b JOIN c ON sha256(t) = h)
SELECT o.grp AS "group", doc_id, line_start, line_end, shapes, occurrences, round(similarity, 6) AS similarity FROM o JOIN k USING (grp) WHERE occurrences > 1""")
def k3_structural_duplicates(spark, d):
    found = U.structural_duplicates(L.text_paragraphs(docs(spark, d)))  # texts have no blank lines: each is a block
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = 7 ORDER BY l_orderkey, l_linenumber, l_suppkey LIMIT 10 OFFSET 2")
def k5_usages(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey"]
    return K.usages(table(spark, d, "lineitem"), {"l_partkey": 7, "l_returnflag": None}, keys, 10, 2).select(keys)


def part_edges(spark, d):
    """Orders use the parts of their lines, and import them where the line was returned."""
    i = table(spark, d, "lineitem")
    return i.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.when(F.col("l_returnflag") == "R", "import").otherwise("usage").alias("kind"))


@query("""SELECT 'o' || l_orderkey AS name, count(DISTINCT l_partkey) AS depends_on, 0 AS dependents, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_usages, count(*) FILTER (WHERE l_returnflag = 'R') AS n_imports FROM lineitem GROUP BY 1
UNION ALL SELECT 'p' || l_partkey, 0, count(DISTINCT l_orderkey), 0, 0 FROM lineitem GROUP BY 1""")
def k6_dependencies(spark, d):
    return K.dependencies(part_edges(spark, d))


@query("""SELECT DISTINCT 'c' || o_custkey AS start, 'o' || l_orderkey AS name, 1 AS depth FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'p' || l_partkey, 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def k6_reachable(spark, d):
    """What each customer depends on: its orders with lines, and their parts."""
    parts = part_edges(spark, d).select("source", "target")
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"))
    o = o.join(parts.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    return K.reachable(parts.unionByName(o), o.select(F.col("source").alias("name")))


@query("""SELECT r_name AS name, 0 AS n_bases, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_children, 0 AS n_above, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_below FROM region
UNION ALL SELECT n_name, 1, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 1, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
UNION ALL SELECT 's' || s_suppkey, 1, 0, 2, 0 FROM supplier""")
def k7_hierarchy_report(spark, d):
    """Regions, nations and suppliers as classes of three levels."""
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    none = F.array().cast("array<string>")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    made = r.select(F.col("r_name").alias("name"), none.alias("bases")).unionByName(nations.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("world."), "r_name")).alias("bases")))
    return K.hierarchy_report(made.unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.array("n_name", F.lit("unknown.Base")).alias("bases"))))


@query("SELECT n_name AS name, r_name AS base, true AS known FROM nation JOIN region ON n_regionkey = r_regionkey")
def k7_class_hierarchy(spark, d):
    r = table(spark, d, "region")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("world."), "r_name")).alias("bases"))
    return K.hierarchy(n.unionByName(r.select(F.col("r_name").alias("name"), F.array().cast("array<string>").alias("bases"))))


@query("""SELECT '  "' || s || '" -> "' || t || '";' AS line FROM (SELECT DISTINCT 'o' || l_orderkey AS s, 'p' || l_partkey AS t FROM lineitem ORDER BY s, t LIMIT 100)""")
def k10_graph_export(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    return K.graph_edges(e, limit=100)


@query("""SELECT '{"source":"' || n_name || '","target":"' || r_name || '"}' AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def k10_hierarchy_export(spark, d):
    """Nations below their regions as lines of JSON."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = n.select(F.col("n_name").alias("name"), F.array("r_name").alias("bases"))
    return K.graph_edges(K.hierarchy(made).select(F.col("name").alias("source"), F.col("base").alias("target")), "json")


@query("""SELECT '  "' || s || '" -> "' || t || '";' AS line FROM (SELECT DISTINCT 's' || l_suppkey AS s, 'c' || o_custkey AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY s, t LIMIT 5000)""")
def k10_call_graph_export(spark, d):
    """Suppliers that serve customers."""
    i = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return K.graph_edges(i.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target")))


@query("SELECT event_id AS doc_id, '' AS pointer, 0 AS depth, 'object' AS kind, CAST(NULL AS VARCHAR) AS scalar FROM events UNION ALL SELECT event_id, '/' || unnest(json_keys(props)), 1, 'number', json_extract_string(props, '$.' || unnest(json_keys(props))) FROM events")
def a6_json_flatten(spark, d):
    return J.json_nodes(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))).drop("pos")


def order_json(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("items"))
    o = table(spark, d, "orders").join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "items")).alias("json"))


@query("""SELECT l_orderkey AS doc_id, 5 * count(*) - 2 * count(*) + 4 AS n_nodes, count(*) AS n_items FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def a7_json_index(spark, d):
    n = J.with_stable_ids(J.json_nodes(order_json(spark, d)))
    return n.groupBy("doc_id").agg(F.count_distinct("node_id").alias("n_nodes"), F.count_if(F.col("pointer").rlike("^/items/[0-9]+$")).alias("n_items"))


@query("SELECT o_orderkey AS doc_id, '/status' AS pointer, true AS found, 'string' AS kind, o_orderstatus AS scalar FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, '/nothing', false, NULL, NULL FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def b14_pointer_lookup(spark, d):
    n = J.json_nodes(order_json(spark, d))
    asked = order_json(spark, d).select("doc_id", F.explode(F.array(X.key_path_pointer(F.lit("status")), F.lit("/nothing"))).alias("pointer"))
    return J.lookup(n, asked)


@query("SELECT p_partkey, replace(replace(p_name || '/~' || p_brand, '~', '~0'), '/', '~1') AS escaped, true AS back, CASE WHEN p_partkey > 0 THEN '0x' || lower(to_hex(p_partkey)) END AS hex, CASE WHEN p_partkey > 0 THEN true END AS hex_back FROM part")
def b12_pointer_and_hex_forms(spark, d):
    raw = F.concat("p_name", F.lit("/~"), "p_brand")
    hx = X.to_hex(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", X.escape_token(raw).alias("escaped"), (X.unescape_token(X.escape_token(raw)) == raw).alias("back"), hx.alias("hex"), (X.from_hex(hx) == F.col("p_partkey")).alias("hex_back"))


@query("SELECT doc_id, 'accepted' AS gate FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'unsupported' ELSE 'invalid' END FROM documents WHERE doc_id % 4 <> 0")
def j7_schema_gate(spark, d):
    k = F.col("doc_id") % 4
    v = F.when(k == 0, "1.7").when(k == 1, "2.0").when(k == 2, "a.b")
    return table(spark, d, "documents").select("doc_id", S.version_gate(v).alias("gate"))


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def s2_metric_windows(spark, d):
    return jobs.metric_windows(table(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1800 SECOND AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def s3_session_expiry(spark, d):
    return jobs.sessions(table(spark, d, "events"))


@query("SELECT doc_id, text AS back FROM documents WHERE text <> ''")
def u3_convert_formats(spark, d):
    r = Registry()
    r.register(Format("text", (".txt",), L.line_nodes, L.render))
    r.register(Format("log", (".log",), L.line_nodes))
    return r.convert(table(spark, d, "documents").select("doc_id", "text"), "log", "text").select("doc_id", F.col("text").alias("back"))
