"""Lines, paragraphs, ranges and previews over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as L
from ..sources.catalog import table
from .registry import query

#: Lines of documents, whose texts end lines with LF alone; the last part of a text that ends with LF is no line.
LINES = """l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS c, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
lines AS (SELECT doc_id, CAST(line AS INT) AS line, c, CASE WHEN line < (length(text) - length(replace(text, chr(10), '')) + 1) THEN c || chr(10) ELSE c END AS content FROM l0
  WHERE NOT (c = '' AND line = length(text) - length(replace(text, chr(10), '')) + 1))"""
BLOCKS = """blocks AS (SELECT doc_id, 'b' || CAST((line - 1) // 4 AS BIGINT) AS block_id, min(line) AS start_line, max(line) AS end_line FROM lines GROUP BY doc_id, (line - 1) // 4
UNION ALL SELECT doc_id, 'h' || CAST((line - 1) // 2 AS BIGINT), min(line), max(line) FROM lines GROUP BY doc_id, (line - 1) // 2)"""
SMALL = "min(struct_pack(a := end_line - start_line, b := start_line, c := block_id)).c"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def lines(spark, d):
    return L.line_nodes(docs(spark, d))


def blocks(spark, d):
    return L.fixed_blocks(lines(spark, d), 4)


@query(f"WITH {LINES} SELECT doc_id, line, content FROM lines")
def a4_line_tokenizer(spark, d):
    return lines(spark, d)


@query(f"""WITH {LINES}, m AS (SELECT *, c = '' OR line % 5 = 0 AS blank FROM lines), s AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line), true) THEN 1 ELSE 0 END AS st FROM m),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS i FROM s)
SELECT doc_id, CAST(i AS BIGINT) AS "index", min(line) AS line_start, max(line) AS line_end, string_agg(content, '' ORDER BY line) AS text FROM g WHERE NOT blank GROUP BY doc_id, i""")
def a5_paragraphs(spark, d):
    blank = F.when(F.col("line") % 5 == 0, "\n").otherwise(F.col("content"))
    return L.paragraphs(lines(spark, d).withColumn("content", blank))


@query(f"WITH {LINES}, {BLOCKS} SELECT doc_id, block_id, start_line, end_line FROM blocks")
def a10_structural_blocks(spark, d):
    return blocks(spark, d)


@query("SELECT doc_id, text, true AS same FROM documents")
def a11_round_trip(spark, d):
    out = L.render(lines(spark, d)).select("doc_id", F.col("text").alias("t"))  # an empty text has no lines
    both = docs(spark, d).select("doc_id", "text").join(out, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit("")))
    return both.select("doc_id", F.col("t").alias("text"), (F.col("text") == F.col("t")).alias("same"))


@query(f"""WITH {LINES}, {BLOCKS}, f AS (SELECT DISTINCT b.* FROM blocks b JOIN lines l ON l.doc_id = b.doc_id AND l.line BETWEEN b.start_line AND b.end_line WHERE contains(l.content, 'tion'))
SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND b.start_line >= a.start_line AND b.end_line <= a.end_line AND b.end_line - b.start_line < a.end_line - a.start_line)""")
def c7_text_search(spark, d):
    return L.text_search(blocks(spark, d), lines(spark, d), "tion")


@query(f"""WITH {LINES}, {BLOCKS}, p AS (SELECT doc_id, CAST(doc_id % 9 + 1 AS INT) AS line FROM documents)
SELECT p.doc_id, p.line, {SMALL} AS block_id, CASE WHEN count(b.block_id) = 0 THEN 'LINE_NOT_FOUND' ELSE 'ok' END AS status
FROM p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND p.line BETWEEN start_line AND end_line GROUP BY p.doc_id, p.line""")
def d5_smallest_enclosing_block(spark, d):
    points = docs(spark, d).select("doc_id", (F.col("doc_id") % 9 + 1).cast("int").alias("line"))
    return L.smallest_enclosing(points, blocks(spark, d))


@query(f"""WITH {LINES}, {BLOCKS}, m AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lines WHERE contains(content, 'er'))
SELECT m.doc_id, m.line, CASE WHEN k <= 3 THEN {SMALL} END AS block_id, CASE WHEN k <= 3 THEN 'enriched' ELSE 'skipped_budget' END AS status
FROM m JOIN blocks b ON b.doc_id = m.doc_id AND m.line BETWEEN start_line AND end_line GROUP BY m.doc_id, m.line, k""")
def d6_enrich_matches(spark, d):
    return L.enrich_matches(lines(spark, d).where(F.col("content").contains("er")).select("doc_id", "line"), blocks(spark, d), 3)


@query(f"""WITH {LINES}, {BLOCKS}, r AS (SELECT doc_id AS request_id, doc_id, CAST(doc_id % 4 + 1 AS INT) AS lo, CAST(doc_id % 4 + 2 AS INT) AS hi FROM documents),
j AS (SELECT request_id, min(struct_pack(m := NOT (start_line = lo AND end_line = hi), a := end_line - start_line, b := start_line, c := block_id)) AS x FROM r JOIN blocks b USING (doc_id) WHERE start_line <= lo AND end_line >= hi GROUP BY 1)
SELECT r.request_id, x.c AS block_id, NOT x.m AS is_exact FROM r LEFT JOIN j USING (request_id)""")
def d13_blocks_by_range(spark, d):
    r = docs(spark, d).select(F.col("doc_id").alias("request_id"), "doc_id", (F.col("doc_id") % 4 + 1).cast("int").alias("lo"), (F.col("doc_id") % 4 + 2).cast("int").alias("hi"))
    return L.blocks_in_range(r, blocks(spark, d))


@query("""WITH r AS (SELECT user_id, event_id % 50 AS lo, event_id % 50 + event_id % 3 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM r)
SELECT user_id, lo, hi FROM m WHERE mx >= lo""")
def d12_overlapping_ranges(spark, d):
    r = table(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("lo"), (F.col("event_id") % 50 + F.col("event_id") % 3).alias("hi"))
    return L.overlaps(r, "user_id")


@query("""WITH r AS (SELECT user_id, event_id % 50 AS lo, event_id % 50 + event_id % 3 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM r),
g AS (SELECT *, sum(CASE WHEN mx IS NULL OR lo > mx + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi) AS g FROM m) SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, g""")
def f4_merge_ranges(spark, d):
    r = table(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("lo"), (F.col("event_id") % 50 + F.col("event_id") % 3).alias("hi"))
    return L.merge_ranges(r, "user_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CRLF' WHEN contains(text, chr(10)) THEN 'LF' ELSE 'LF' END AS terminator FROM documents WHERE text <> ''")
def e7_dominant_terminator(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"))).otherwise(F.col("text"))
    return L.dominant_terminator(L.line_nodes(docs(spark, d).withColumn("text", text)))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, count(*) AS total FROM lines GROUP BY 1), s AS (SELECT doc_id, count(*) AS returned, string_agg(c, chr(10) ORDER BY line) AS x FROM lines WHERE line > 2 AND line <= 5 GROUP BY 1)
SELECT doc_id, CASE WHEN length(coalesce(x, '')) > 200 THEN x[:200] || '…' ELSE coalesce(x, '') END AS text, total, coalesce(returned, 0) AS returned, 2 + coalesce(returned, 0) < total AS has_more,
CASE WHEN 2 + coalesce(returned, 0) < total THEN 2 + coalesce(returned, 0) END AS next_offset FROM t LEFT JOIN s USING (doc_id)""")
def g2_line_window(spark, d):
    return L.line_window(lines(spark, d), 2, 3, 200)


@query("""SELECT doc_id, substr(text, least(700, length(text)) + 1, 300) AS chunk, length(text) AS total, least(700, length(text)) + 300 < length(text) AS has_more,
CASE WHEN least(700, length(text)) + 300 < length(text) THEN least(700, length(text)) + 300 END AS next_offset FROM documents""")
def g3_char_page(spark, d):
    return docs(spark, d).select("doc_id", *L.char_page(F.col("text"), 700, 300))


@query("SELECT doc_id, (SELECT max_by(left(text, k), k) FROM range(102) r(k) WHERE strlen(left(text, k)) <= 101) AS preview, strlen(text) AS n_bytes FROM documents")
def g5_utf8_preview(spark, d):
    return docs(spark, d).select("doc_id", L.utf8_prefix(F.col("text"), 101).alias("preview"), F.length(F.encode("text", "utf-8")).alias("n_bytes"))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, CAST(2 AS INT) AS lo, CAST(3 AS INT) AS hi, CASE WHEN doc_id % 2 = 0 THEN 'new ' || doc_id || chr(10) END AS r FROM documents),
k AS (SELECT l.doc_id, line, 0 AS k, content FROM lines l WHERE line NOT IN (2, 3) UNION ALL SELECT doc_id, lo, 0, r FROM e WHERE r IS NOT NULL)
SELECT doc_id, string_agg(content, '' ORDER BY line, k) AS text FROM k GROUP BY doc_id""")
def i15_line_range_edit(spark, d):
    e = docs(spark, d).select("doc_id", F.lit(2).alias("lo"), F.lit(3).alias("hi"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new "), F.col("doc_id").cast("string"), F.lit("\n"))).alias("replacement"))
    return L.render(L.edit_ranges(lines(spark, d), e), "sort")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, count(*) AS total, CASE doc_id % 5 WHEN 0 THEN '[2]' WHEN 1 THEN '[2, 4]' WHEN 2 THEN '[:3]' WHEN 3 THEN '[2:]' ELSE '[4,2]' END AS spec FROM lines GROUP BY 1),
v AS (SELECT *, CASE doc_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 4 ELSE 2 END AS s, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN total ELSE 2 END AS e FROM s),
x AS (SELECT *, CASE WHEN e < s THEN 'REVERSED' WHEN e > total THEN 'BEYOND_END' END AS error FROM v)
SELECT doc_id, CASE WHEN error IS NULL THEN s END AS start, CASE WHEN error IS NULL THEN e END AS "end", error FROM x""")
def i16_bracket_ranges(spark, d):
    n = lines(spark, d).groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    k = F.col("doc_id") % 5
    spec = F.when(k == 0, "[2]").when(k == 1, "[2, 4]").when(k == 2, "[:3]").when(k == 3, "[2:]").otherwise("[4,2]")
    return n.select("doc_id", *L.bracket_range(spec, F.col("total")))


@query(f"""WITH {LINES}, f AS (SELECT doc_id, regexp_replace(c, '\\s', '', 'g') AS c, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS z FROM lines)
SELECT doc_id, max(c[:5]) FILTER (WHERE a = 1) AS first_anchor, max(right(c, 5)) FILTER (WHERE z = 1) AS last_anchor FROM f GROUP BY doc_id""")
def i19_text_anchors(spark, d):
    n = lines(spark, d).groupBy("doc_id").agg(F.min_by("content", "line").alias("a"), F.max_by("content", "line").alias("z"))
    return n.select("doc_id", L.text_anchor(F.col("a")).alias("first_anchor"), L.text_anchor(F.col("z"), last=True).alias("last_anchor"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id HAVING count(*) > 20")
def k14_long_files(spark, d):
    return docs(spark, d).select("doc_id", F.size(L.line_array(F.col("text"))).cast("long").alias("n_lines")).where("n_lines > 20")


@query(r"""SELECT doc_id, sha256(text) AS digest, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN ends_with(text, chr(10)) THEN length(text) ELSE length(text) + 1 END AS n_with_newline FROM documents""")
def y_text_functions(spark, d):
    from ..functions.text import slug

    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"), slug(F.col("text")).alias("slug"), F.length(L.with_trailing_newline(F.col("text"))).alias("n_with_newline"))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line, regexp_extract(c, '(?:^|[ .,])(anan|thin|eau)(?:[ .,]|$)', 1) AS term FROM lines) SELECT term AS category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE term <> '' GROUP BY term""")
def k13_term_audit(spark, d):
    term = F.regexp_extract("content", r"(?:^|[ .,])(anan|thin|eau)(?:[ .,]|$)", 1)
    return lines(spark, d).withColumn("category", term).where("category <> ''").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
