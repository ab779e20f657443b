"""Users' parsers over whole texts (U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..sources import parsers as P
from ..sources.catalog import SQL, catalog_nodes, table
from .registry import query


def ini_docs(spark, d):
    """Every document as an INI text of its language, source and lines; where the id is divisible by 10 a section is left open."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("line = "), x))
    head = F.concat(F.lit("["), "lang", F.lit("]\nsource = "), "source", F.when(F.col("doc_id") % 10 == 0, "\n[text\n").otherwise("\n[text]\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.array_join(lines, "\n")).alias("text"))


@query("""WITH d AS (SELECT *, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id % 10 <> 0),
l AS (SELECT doc_id, unnest(parts) AS c, unnest(range(0, len(parts))) AS i FROM d)
SELECT doc_id, 'file' AS kind, '' AS name, '' AS content, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 0 AS child_index, 1 AS line_start, 3 + len(parts) AS line_end FROM d
UNION ALL SELECT doc_id, 'section', lang, '', 'file', 1, 0, 1, 1 FROM d UNION ALL SELECT doc_id, 'section', 'text', '', 'file', 1, 1, 3, 3 FROM d
UNION ALL SELECT doc_id, 'setting', 'source', source, 'section', 2, 0, 2, 2 FROM d UNION ALL SELECT doc_id, 'setting', 'line', trim(c, ' ' || chr(9)), 'section', 2, i, 4 + i, 4 + i FROM l""")
def u2_user_parser(spark, d):
    nodes = P.parse_documents(ini_docs(spark, d), P.ini)[0]
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent"))
    return nodes.join(up, ["doc_id", "parent_id"], "left").select("doc_id", "kind", "name", "content", "parent", "depth", "child_index", "line_start", "line_end")


@query("SELECT doc_id, 'PARSE_FAILED' AS code, 'ParseError: line 3: section is not closed' AS message FROM documents WHERE doc_id % 10 = 0")
def u2_parse_errors(spark, d):
    return P.parse_documents(ini_docs(spark, d), P.ini)[1]


def fragments(spark, d):
    """A text for each customer's first order; a section is left open where the key is divisible by 10."""
    first = catalog_nodes(spark, d).where("depth = 1 and child_index = 0")
    return first.select("doc_id", "node_id", F.concat(F.lit("a = 1\n[s"), F.when(F.col("doc_id") % 10 == 0, "").otherwise("]"), F.lit("\nb: "), "name").alias("text"))


@query(f"""WITH {SQL}, f AS (SELECT * FROM nodes WHERE depth = 1 AND child_index = 0 AND doc_id % 10 <> 0), p AS (SELECT 'a = 1' || chr(10) || '[s]' || chr(10) || 'b: ' || name AS content, doc_id, name FROM f)
SELECT doc_id, node_id, kind, name, CASE WHEN depth = 1 AND child_index = 0 AND doc_id % 10 <> 0 THEN 'a = 1' || chr(10) || '[s]' || chr(10) || 'b: ' || name ELSE content END AS content, CASE depth WHEN 1 THEN 'customer' WHEN 2 THEN 'order' END AS parent_kind, child_index FROM nodes WHERE NOT (depth = 2 AND ord_path[2] = 0 AND doc_id % 10 <> 0)
UNION ALL SELECT doc_id, 'new', 'file', '', '', 'order', 0 FROM p UNION ALL SELECT doc_id, 'new', 'setting', 'a', '1', 'file', 0 FROM p UNION ALL SELECT doc_id, 'new', 'section', 's', '', 'file', 1 FROM p UNION ALL SELECT doc_id, 'new', 'setting', 'b', name, 'section', 0 FROM p""")
def i10_source_fragment(spark, d):
    n = E.set_source_fragment(catalog_nodes(spark, d), fragments(spark, d), P.ini)[0]
    up = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    made = F.col("kind").isin("file", "setting", "section")
    return n.join(up, ["doc_id", "parent_id"], "left").select("doc_id", F.when(made, "new").otherwise(F.col("node_id")).alias("node_id"), "kind", "name", "content", "parent_kind", "child_index")


@query(f"WITH {SQL} SELECT doc_id, node_id, 'PARSE_FAILED' AS code FROM nodes WHERE depth = 1 AND child_index = 0 AND doc_id % 10 = 0")
def i10_fragment_errors(spark, d):
    return E.set_source_fragment(catalog_nodes(spark, d), fragments(spark, d), P.ini)[1].select("doc_id", "node_id", "code")
