"""Structural blocks by format (A10) over orders as JSON and documents as Markdown and as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..sources.catalog import table
from .registry import query


def formatted(spark, d):
    """Orders as JSON over several lines, and documents as Markdown (heading, fence with the text, list, quote) or, where the id is odd, as they are."""
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("items"))
    o = table(spark, d, "orders").join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    json = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "items"), {"pretty": "true"})
    orders = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("json").alias("format"), json.alias("text"))
    even = F.col("doc_id") % 2 == 0
    note = F.concat(F.lit("# "), "source", F.lit("\n\n```"), "lang", F.lit("\n"), "text", F.lit("\n```\n- one\n  two\n- three\n\n> said\n***\nend"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.when(even, "markdown").otherwise("text").alias("format"), F.when(even, note).otherwise(F.col("text")).alias("text"))
    return orders.unionByName(docs)


@query("""WITH i AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS j, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT DISTINCT 'o' || k AS doc_id, n FROM i), m AS (SELECT 'd' || doc_id AS doc_id, source, lang, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 2 = 0),
p AS (SELECT 'd' || doc_id AS doc_id, string_split(text, chr(10)) AS x FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, '' AS block_id, 'object' AS kind, NULL AS name, 1 AS start_line, 5 + 3 * n AS end_line FROM o UNION ALL SELECT doc_id, '/key', 'number', 'key', 2, 2 FROM o UNION ALL SELECT doc_id, '/status', 'string', 'status', 3, 3 FROM o UNION ALL SELECT doc_id, '/items', 'array', 'items', 4, 4 + 3 * n FROM o
UNION ALL SELECT 'o' || k, '/items/' || j, 'object', CAST(j AS VARCHAR), 4 + 3 * j, 7 + 3 * j FROM i UNION ALL SELECT 'o' || k, '/items/' || j || '/line', 'number', 'line', 5 + 3 * j, 5 + 3 * j FROM i UNION ALL SELECT 'o' || k, '/items/' || j || '/part', 'number', 'part', 6 + 3 * j, 6 + 3 * j FROM i
UNION ALL SELECT doc_id, 'heading:1', 'heading', source, 1, 1 FROM m UNION ALL SELECT doc_id, 'fence:3', 'fence', lang, 3, 4 + n FROM m UNION ALL SELECT doc_id, 'list:' || (5 + n), 'list', NULL, 5 + n, 7 + n FROM m
UNION ALL SELECT doc_id, 'quote:' || (9 + n), 'quote', NULL, 9 + n, 9 + n FROM m UNION ALL SELECT doc_id, 'rule:' || (10 + n), 'rule', NULL, 10 + n, 10 + n FROM m UNION ALL SELECT doc_id, 'paragraph:' || (11 + n), 'paragraph', NULL, 11 + n, 11 + n FROM m
UNION ALL SELECT doc_id, CAST(k - 1 AS VARCHAR), 'line', NULL, k, k FROM (SELECT doc_id, unnest(range(1, len(x) + 1 - CASE WHEN x[-1] = '' THEN 1 ELSE 0 END)) AS k FROM p)""")
def a10_structural_blocks(spark, d):
    return B.structural_blocks(formatted(spark, d))[0].select("doc_id", "block_id", "kind", "name", "start_line", "end_line")


@query("""WITH j AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS j FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'o' || k AS doc_id, '/items/' || (j - 1) || '/part' AS block_id, '    "part" : ' || l_partkey AS text FROM j UNION ALL SELECT 'd' || doc_id, 'fence:3', '```' || lang || chr(10) || text || chr(10) || '```' FROM documents WHERE doc_id % 2 = 0""")
def a10_block_texts(spark, d):
    rows = B.structural_blocks(formatted(spark, d))[0]
    return rows.where("block_id like '%/part' or kind = 'fence'").select("doc_id", "block_id", "text")
