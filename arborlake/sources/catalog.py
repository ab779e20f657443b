"""Node tables: trees as rows.

nodes(doc_id, node_id, parent_id, child_index, depth, kind, role, name, fields,
content, ord_path, anc_ids): ord_path holds the places of a node and of its
ancestors, so that its array order is preorder; anc_ids goes from root to parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

LEAF_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> orders -> lineitem as one tree a customer."""
    c, o, i = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    nth = lambda by, *order: (F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1).cast("int")
    at = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    fields = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.col(v).cast("string"))])
    roots = c.select(
        F.col("c_custkey").alias("doc_id"), at("c", "c_custkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("child_index"), F.lit(0).alias("depth"),
        F.lit("customer").alias("kind"), F.lit("module").alias("role"), F.col("c_name").alias("name"), fields(segment="c_mktsegment", nation="c_nationkey").alias("fields"), F.lit("").alias("content"),
        F.array(F.lit(0)).alias("ord_path"), F.array().cast("array<string>").alias("anc_ids"),
    )
    o = o.join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").withColumn("k", nth("o_custkey", "o_orderkey"))
    orders = o.select(
        F.col("o_custkey").alias("doc_id"), at("o", "o_orderkey").alias("node_id"), at("c", "o_custkey").alias("parent_id"), F.col("k").alias("child_index"), F.lit(1).alias("depth"),
        F.lit("order").alias("kind"), F.lit("class").alias("role"), F.concat(F.lit("order#"), F.col("o_orderkey").cast("string")).alias("name"), fields(status="o_orderstatus", priority="o_orderpriority").alias("fields"), F.lit("").alias("content"),
        F.array(F.lit(0), "k").alias("ord_path"), F.array(at("c", "o_custkey")).alias("anc_ids"),
    )
    i = i.withColumn("j", nth("l_orderkey", *LEAF_ORDER)).join(o.select("o_orderkey", "o_custkey", "k"), F.col("l_orderkey") == F.col("o_orderkey"))
    leaves = i.select(
        F.col("o_custkey").alias("doc_id"), F.concat(at("l", "l_orderkey"), F.lit(":"), F.col("j").cast("string")).alias("node_id"), at("o", "l_orderkey").alias("parent_id"), F.col("j").alias("child_index"), F.lit(2).alias("depth"),
        F.lit("lineitem").alias("kind"), F.lit("method").alias("role"), F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("name"), fields(part="l_partkey", supplier="l_suppkey", line="l_linenumber", flag="l_returnflag").alias("fields"), F.concat("l_returnflag", "l_linestatus").alias("content"),
        F.array(F.lit(0), "k", "j").alias("ord_path"), F.array(at("c", "o_custkey"), at("o", "l_orderkey")).alias("anc_ids"),
    )
    return roots.unionByName(orders).unionByName(leaves)


#: The same as common table expressions.
SQL = f"""
o_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
l_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LEAF_ORDER)}) - 1 AS INT) AS j FROM lineitem),
nodes AS MATERIALIZED (
  SELECT c_custkey AS doc_id, 'c:' || c_custkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS child_index, 0 AS depth, 'customer' AS kind, 'module' AS role, c_name AS name,
         MAP {{'segment': c_mktsegment, 'nation': CAST(c_nationkey AS VARCHAR)}} AS fields, '' AS content, [0] AS ord_path, CAST([] AS VARCHAR[]) AS anc_ids FROM customer
  UNION ALL
  SELECT o_custkey, 'o:' || o_orderkey, 'c:' || o_custkey, k, 1, 'order', 'class', 'order#' || o_orderkey, MAP {{'status': o_orderstatus, 'priority': o_orderpriority}}, '', [0, k], ['c:' || o_custkey] FROM o_
  UNION ALL
  SELECT o_custkey, 'l:' || l_orderkey || ':' || j, 'o:' || l_orderkey, j, 2, 'lineitem', 'method', 'part#' || l_partkey,
         MAP {{'part': CAST(l_partkey AS VARCHAR), 'supplier': CAST(l_suppkey AS VARCHAR), 'line': CAST(l_linenumber AS VARCHAR), 'flag': l_returnflag}}, l_returnflag || l_linestatus, [0, k, j], ['c:' || o_custkey, 'o:' || l_orderkey]
  FROM l_ JOIN o_ ON l_orderkey = o_orderkey)
"""
