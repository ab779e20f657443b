"""Catalogues of files, versions of texts, measurements and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C, diff as D, measures as M
from ..sources.catalog import table
from .registry import query
from .text_queries import LINES

PATHS = """paths AS (SELECT doc_id, source AS project_id, source || '/' || lang || '/' || CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END || doc_id || '.' ||
['py', 'json', 'yaml', 'md', 'txt', 'log', 'pyc', 'unknown'][doc_id % 8 + 1] AS path FROM documents)"""
V2 = """v2 AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'UP ' || split_part(text, chr(10), 1) || substr(text, length(split_part(text, chr(10), 1)) + 1) WHEN 1 THEN text || chr(10) || 'ADDED ' || doc_id ELSE text END AS text FROM documents)"""
FORMATS = [("py", "python"), ("json", "json"), ("YAML", "yaml"), ("md", "markdown"), ("txt", "text"), ("log", "text"), ("txt", "plain")]


def docs(spark, d):
    return table(spark, d, "documents")


def paths(spark, d):
    return C.derived_paths(docs(spark, d))


def v2(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("UP "), first, F.substring("text", F.length(first) + 1, F.length("text")))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\nADDED "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", text.alias("text"))


@query(f"""WITH {PATHS}, t AS (SELECT * FROM (VALUES ('py', 'python'), ('json', 'json'), ('yaml', 'yaml'), ('md', 'markdown')) x(e, f))
SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'forced' END, f) AS resolved, CASE WHEN doc_id % 10 <> 0 AND f IS NULL THEN 'FORMAT_UNKNOWN_EXTENSION' END AS error
FROM paths LEFT JOIN t ON lower(regexp_extract(path, '\\.([^./]+)$', 1)) = e""")
def a1_format_resolution(spark, d):
    t = spark.createDataFrame([(f".{e.lower()}", f) for e, f in FORMATS[:4]], "extension string, format_id string")
    files = paths(spark, d).withColumn("format_id", F.when(F.col("doc_id") % 10 == 0, "forced"))
    return C.resolve_format(files, t).select("doc_id", "resolved", "error")


@query(f"WITH {PATHS}, f AS (SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS extension, project_id FROM paths) SELECT extension, 'FORMAT_EXTENSION_CONFLICT' AS code FROM f GROUP BY extension HAVING count(DISTINCT project_id) > 1")
def a1_extension_conflicts(spark, d):
    t = paths(spark, d).select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"), F.col("project_id").alias("format_id"))
    return C.extension_conflicts(t)


@query(f"WITH {PATHS} SELECT doc_id, NOT (contains(path, '/node_modules/') OR path LIKE '%.log' OR path LIKE '%.pyc') AS by_default, NOT (path LIKE '%.log' OR path LIKE '%.pyc') AS scan_all, NOT path LIKE '%.pyc' AS with_logs FROM paths")
def a2_path_eligibility(spark, d):
    p = F.col("path")
    return paths(spark, d).select("doc_id", C.eligible(p).alias("by_default"), C.eligible(p, True).alias("scan_all"), C.eligible(p, True, True).alias("with_logs"))


@query(f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE NOT contains(path, '/node_modules/') AND path NOT LIKE '%.pyc'")
def a3_listing_filter(spark, d):
    return paths(spark, d).where(C.listed(F.col("path"))).select("doc_id", "path")


@query(f"WITH {PATHS} SELECT project_id, count(*) AS n FROM paths WHERE NOT (contains(path, '/node_modules/') OR path LIKE '%.log' OR path LIKE '%.pyc') GROUP BY project_id")
def e6_eligible_aggregate(spark, d):
    return paths(spark, d).where(C.eligible(F.col("path"))).groupBy("project_id").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS deleted, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent,
count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS low, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '5%') AS other FROM orders""")
def e1_catalogue_breakdown(spark, d):
    p = F.col("o_orderpriority")
    return C.breakdown(table(spark, d, "orders"), F.col("o_orderstatus") == "F", {"urgent": p.like("1%"), "low": p.like("5%")})


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def e2_top_projects(spark, d):
    return C.top_parents(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus <> 'F'"), "o_custkey", "c_custkey")


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows_in_groups, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS removable FROM g")
def e3_duplicate_groups(spark, d):
    return C.duplicate_groups(docs(spark, d).select(F.sha2("text", 256).alias("h")), "h")


@query("""SELECT t AS total, i AS indexed, t - i AS needing, CASE WHEN t = 0 THEN 0.0 ELSE round(100.0 * i / t, 2) END AS indexed_pct, c AS chunks, v AS vectors, CASE WHEN c = 0 THEN 0.0 ELSE round(100.0 * v / c, 2) END AS vector_pct
FROM (SELECT count(*) AS t, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS i FROM documents), (SELECT count(*) AS c, count(*) FILTER (WHERE quality = 1) AS v FROM labels)""")
def e4_coverage(spark, d):
    return C.coverage(docs(spark, d), table(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS pending, count(*) FILTER (WHERE event_type <> 'error') AS done, max_by(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'purchase') AS last_done, max_by(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click') AS active FROM events")
def e5_progress(spark, d):
    last = lambda t: F.max_by(F.when(F.col("event_type") == t, F.col("event_id")), F.when(F.col("event_type") == t, F.struct("ts", "event_id")))
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("pending"), F.count_if(F.col("event_type") != "error").alias("done"), last("purchase").alias("last_done"), last("click").alias("active"))


@query(f"""WITH {PATHS}, f AS (SELECT doc_id AS id, project_id, path AS rel, project_id || '/' || path AS ab FROM paths), g AS (SELECT doc_id + 1000000 AS id, CASE WHEN doc_id % 2 = 0 THEN project_id ELSE 'copy' END AS project_id, rel, CASE WHEN doc_id % 3 = 0 THEN 'x/' || rel ELSE ab END AS ab FROM (SELECT *, id AS doc_id FROM f))
SELECT f.id AS a_id, g.id AS b_id, CASE WHEN f.ab = g.ab AND f.project_id = g.project_id THEN 'same_file' WHEN f.ab = g.ab THEN 'other_project_same_path' ELSE 'same_relative' END AS "case"
FROM f JOIN g ON f.ab = g.ab OR (f.rel = g.rel AND f.project_id <> g.project_id)""")
def d10_file_identity(spark, d):
    f = paths(spark, d).select(F.col("doc_id").alias("id"), "project_id", F.concat("project_id", F.lit("/"), "path").alias("abs_path"), F.col("path").alias("rel_path"))
    g = f.select((F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") % 2 == 0, F.col("project_id")).otherwise("copy").alias("project_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x/"), "rel_path")).otherwise(F.col("abs_path")).alias("abs_path"), "rel_path")
    return C.identity_classes(f, g)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d11_orphans(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {PATHS} SELECT path, path AS normalized, split_part(path, '/', 1) AS root, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS is_correct, CASE WHEN doc_id % 7 = 0 THEN 'MISSING_FILE' WHEN doc_id % 5 = 0 THEN 'OUTSIDE_PROJECT' END AS error FROM paths""")
def d15_path_report(spark, d):
    p = paths(spark, d)
    files = p.select("path", F.when(F.col("doc_id") % 5 == 0, "elsewhere").otherwise(F.col("project_id")).alias("project_root"))
    return C.path_report(files, p.where("doc_id % 7 <> 0").select("path"), p.select(F.col("project_id").alias("root")).distinct())


@query("SELECT id, min(list) AS list, min_by(seq, list) AS seq FROM (SELECT c_custkey AS id, 0 AS list, c_custkey AS seq FROM customer UNION ALL SELECT DISTINCT o_custkey * 2, 1, o_custkey * 2 FROM orders) GROUP BY id")
def h1_ordered_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    b = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id"), (F.col("o_custkey") * 2).alias("seq"))
    return C.ordered_union(a, b)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def h2_missing(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")))


@query(f"WITH {PATHS}, r AS (SELECT DISTINCT project_id AS root FROM paths UNION SELECT DISTINCT project_id || '/en' FROM paths) SELECT root AS inner, regexp_replace(root, '/en$', '') AS outer FROM r WHERE root LIKE '%/en'")
def h3_nested_roots(spark, d):
    p = paths(spark, d)
    roots = p.select(F.col("project_id").alias("root")).union(p.select(F.concat("project_id", F.lit("/en")).alias("root"))).distinct()
    return C.nested_roots(roots)


@query("SELECT DISTINCT url AS path, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS root FROM pages")
def h4_nearest_root(spark, d):
    u = table(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    roots = u.select(F.regexp_extract("path", "^[a-z]+://[^/?#]+", 0).alias("root")).distinct()
    return C.nearest_root(u, roots)


@query("""WITH b AS (SELECT o_orderkey AS id, regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9._-]+', '_', 'g') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || 'Z' AS b FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS k FROM b)
SELECT id, CASE WHEN k = 1 THEN b ELSE b || '_' || k END AS folder FROM k""")
def h5_trash_names(spark, d):
    return C.trash_names(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("deleted_at")))


@query("SELECT doc_id, sha256(text) AS source_sha256 FROM documents")
def j1_digests(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("source_sha256"))


@query(f"""WITH {V2} SELECT v2.doc_id, CASE WHEN v2.doc_id % 7 = 0 THEN 'create' WHEN sha256(v2.text) = sha256(d.text) THEN 'none' WHEN v2.doc_id % 5 = 0 THEN 'keep_tree' ELSE 'replace' END AS branch,
v2.doc_id % 7 = 0 OR (sha256(v2.text) <> sha256(d.text) AND v2.doc_id % 5 <> 0) AS tokenize FROM v2 JOIN documents d USING (doc_id)""")
def j2_sync_decision(spark, d):
    stored = docs(spark, d).where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    return D.sync_decisions(v2(spark, d), stored, docs(spark, d).where("doc_id % 5 = 0").select("doc_id"))


@query(f"""WITH {V2} SELECT doc_id, d.text <> v2.text AS source_changed, doc_id % 4 = 0 AS tree_changed, CASE WHEN d.text <> v2.text THEN 'SOURCE_CHANGED' WHEN doc_id % 4 = 0 THEN 'TREE_CHANGED' END AS code, NOT doc_id % 4 = 0 AS allowed FROM documents d JOIN v2 USING (doc_id)""")
def j3_conflicts(spark, d):
    digest = lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"))
    tree = digest(docs(spark, d)).withColumn("digest", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("digest")))
    return D.conflicts(digest(docs(spark, d)), digest(v2(spark, d)), tree, "overwrite_source")


#: Lines of both versions as arrays: where the id mod 3 is 0 the first one differs, where it is 1 some follow.
A_B = f"""{V2}, ab AS (SELECT doc_id, doc_id % 3 AS m, x[:len(x) - CASE WHEN x[-1] = '' THEN 1 ELSE 0 END] AS a, y[:len(y) - CASE WHEN y[-1] = '' THEN 1 ELSE 0 END] AS b
  FROM (SELECT doc_id, string_split(d.text, chr(10)) AS x, string_split(v2.text, chr(10)) AS y FROM documents d JOIN v2 USING (doc_id)) WHERE doc_id % 3 < 2),
diff AS (SELECT doc_id, 'removed' AS change, 1 AS line, a[1] AS content FROM ab WHERE m = 0 AND len(a) > 0 UNION ALL SELECT doc_id, 'added', 1, b[1] FROM ab WHERE m = 0
  UNION ALL SELECT doc_id, 'added', len(a) + i, b[len(a) + i] FROM ab, unnest([1, 2]) u(i) WHERE m = 1 AND len(a) + i <= len(b))"""


@query(f"WITH {A_B} SELECT doc_id, change, CAST(line AS INT) AS line, content FROM diff")
def j4_line_diff(spark, d):
    return D.line_diff(docs(spark, d).select("doc_id", "text"), v2(spark, d))


@query(f"WITH {A_B} SELECT doc_id, CAST(min(line) AS INT) AS lo, CAST(max(line) AS INT) AS hi FROM diff WHERE change = 'added' GROUP BY doc_id")
def j4_changed_ranges(spark, d):
    return D.changed_ranges(j4_line_diff(spark, d))


@query("""WITH l AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS x FROM documents)
SELECT doc_id, 1 AS added, 1 AS removed FROM l WHERE len(list_distinct(x)) > 1""")
def j4_moved_lines(spark, d):
    """Each document against itself with its first line moved to the end: one line goes and one comes, unless all are alike."""
    x = F.split(F.regexp_replace("text", "\n+$", ""), "\n")
    both = docs(spark, d).select("doc_id", x.alias("x"))
    moved = F.array_join(F.concat(F.slice("x", 2, F.size("x")), F.slice("x", 1, 1)), "\n")
    rows = D.line_diff(both.select("doc_id", F.array_join("x", "\n").alias("text")), both.select("doc_id", moved.alias("text")))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


@query(f"""WITH {A_B}, h AS (SELECT doc_id, m, len(a) AS n, len(b) AS k, a, b, CASE WHEN m = 0 THEN 0 ELSE greatest(len(a) - 3, 0) END AS s, CASE WHEN m = 0 THEN a[2:4] ELSE a[greatest(len(a) - 2, 1):] END AS near FROM ab),
t AS (SELECT doc_id, CASE WHEN m = 0 THEN least(n, 4) ELSE n - s END AS al, CASE WHEN m = 0 THEN least(k, 4) ELSE k - s END AS bl, s,
  CASE WHEN m = 0 THEN list_concat(list_transform(a[1:1], lambda x: '-' || x), list_transform(b[1:1], lambda x: '+' || x), list_transform(near, lambda x: ' ' || x)) ELSE list_concat(list_transform(near, lambda x: ' ' || x), list_transform(b[n + 1:], lambda x: '+' || x)) END AS body FROM h)
SELECT doc_id, '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -' || CASE WHEN al = 0 THEN s ELSE s + 1 END || CASE WHEN al = 1 THEN '' ELSE ',' || al END || ' +' || (s + 1) || CASE WHEN bl = 1 THEN '' ELSE ',' || bl END || ' @@' || chr(10) || array_to_string(body, chr(10)) || chr(10) AS diff FROM t""")
def j5_unified_diff(spark, d):
    return D.unified(docs(spark, d).select("doc_id", "text"), v2(spark, d))


@query(f"""WITH {V2} SELECT doc_id, CASE WHEN d.text = v2.text AND doc_id % 9 <> 0 THEN 'agreement' ELSE 'divergence' END AS verdict, CASE WHEN doc_id % 9 = 0 THEN 'left_only' WHEN d.text <> v2.text THEN 'text' ELSE '' END AS what FROM documents d JOIN v2 USING (doc_id)""")
def e14_comparison(spark, d):
    return D.compare(docs(spark, d), v2(spark, d).where("doc_id % 9 <> 0"), ["doc_id"], ["text"])


@query(f"WITH {V2} SELECT doc_id, CASE WHEN d.text = v2.text THEN 'no_op' ELSE 'changed' END AS status, d.text <> v2.text AS content_changed FROM documents d JOIN v2 USING (doc_id)")
def i20_write_decision(spark, d):
    return D.write_decisions(docs(spark, d), v2(spark, d))


@query(f"""WITH {V2} SELECT doc_id, doc_id AS short_id, d.text = v2.text AS carried FROM documents d JOIN v2 USING (doc_id)""")
def b16_identity_carry_over(spark, d):
    node = lambda df: df.select("doc_id", F.col("doc_id").alias("short_id"), F.sha2("text", 256).alias("fingerprint"))
    old = node(docs(spark, d)).withColumn("node_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    return D.carry_identity(old, node(v2(spark, d))).select("doc_id", "short_id", "carried")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE text <> '') AS ok, count(*) FILTER (WHERE text = '') AS refused FROM documents GROUP BY lang""")
def e13_round_trip_scorecard(spark, d):
    from ..operators.lines import line_nodes, render

    back = render(line_nodes(docs(spark, d).select("doc_id", "text"))).withColumnRenamed("text", "back")
    j = docs(spark, d).join(back, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("back")).alias("ok"), F.count_if(F.col("text") == "").alias("refused"))


@query("SELECT source, coalesce(count(*) FILTER (WHERE lang = 'en'), 0) AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es, count(DISTINCT lang) < 4 AS gap FROM documents GROUP BY source")
def e15_coverage_matrix(spark, d):
    langs = ["en", "fr", "de", "es"]
    m = docs(spark, d).groupBy("source").pivot("lang", langs).agg(F.count("doc_id"))
    m = m.select("source", *[F.coalesce(x, F.lit(0)).alias(x) for x in langs])
    return m.withColumn("gap", F.array_contains(F.array(*langs), F.lit(0).cast("long")))


def measurements(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("scenario"), (F.col("user_id") % 6).alias("corpus"), "value", (F.dayofmonth("ts") <= 15).alias("early"), F.col("event_id").alias("id"))


STATS = "count(value) AS n, min(value) AS least, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most, avg(value) AS mean, stddev_pop(value) AS stdev"


@query(f"SELECT event_type, n, least, median, p95, most, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round((most - least) / median, 6) AS spread FROM (SELECT event_type, {STATS} FROM events GROUP BY event_type)")
def e8_distribution(spark, d):
    s = M.distribution(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", "least", "median", "p95", "most", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "spread")])


@query(f"SELECT event_type, round(median / n, 9) AS per_row FROM (SELECT event_type, {STATS} FROM events GROUP BY event_type)")
def e9_normalised_cost(spark, d):
    return M.distribution(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round(M.ratio(F.col("median"), F.col("n")), 9).alias("per_row"))


def counters(spark, d, early):
    e = table(spark, d, "events").where((F.dayofmonth("ts") <= 15) == early)
    return M.phase_counters(e.select(F.col("event_type").alias("phase"), F.floor("value").cast("long").alias("ns"), (F.col("user_id") % 10).alias("nodes"), (F.col("event_id") % 50 == 0).alias("marker")))


@query("""WITH e AS (SELECT event_type AS phase, day(ts) <= 15 AS early, CAST(floor(value) AS BIGINT) AS v, user_id % 10 AS u, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS m FROM events)
SELECT phase, CAST(sum(CASE WHEN early THEN -v ELSE v END) AS BIGINT) AS ns, CAST(sum(CASE WHEN early THEN -u ELSE u END) AS BIGINT) AS nodes, CAST(sum(CASE WHEN early THEN -1 ELSE 1 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN early THEN -m ELSE m END) AS BIGINT) AS markers FROM e GROUP BY phase""")
def e10_counter_delta(spark, d):
    return M.counter_delta(counters(spark, d, True), counters(spark, d, False))


@query(f"""WITH s AS (SELECT event_type AS scenario, user_id % 6 AS corpus, day(ts) <= 15 AS early, quantile_cont(value, 0.5) AS m, quantile_disc(value, 0.95) AS p, stddev_pop(value) AS s FROM events GROUP BY ALL),
j AS (SELECT a.scenario, least(b.m / a.m, b.p / a.p) > 1.2 AS grew, least(b.m / a.m, b.p / a.p) > 1.2 AND (b.m - a.m) / a.s > 2 AS slow FROM s a JOIN s b ON a.scenario = b.scenario AND a.corpus = b.corpus AND a.early AND NOT b.early),
g AS (SELECT scenario, count(*) AS corpora, count(*) FILTER (WHERE grew) AS grew, count(*) FILTER (WHERE slow) AS slow FROM j GROUP BY scenario)
SELECT *, CASE WHEN slow >= 2 AND slow >= 0.8 * corpora THEN 'blocks' WHEN grew > 0 THEN 'advisory' ELSE 'pass' END AS verdict FROM g""")
def e11_timing_gate(spark, d):
    m = measurements(spark, d)
    stats = lambda early: M.distribution(m.where(F.col("early") == early), ["scenario", "corpus"], "value")
    return M.timing_gate(stats(True), stats(False))


@query("""WITH c AS (SELECT event_type AS scenario, user_id % 6 AS corpus, day(ts) <= 15 AS early, count(*) AS n FROM events GROUP BY ALL)
SELECT a.scenario, a.corpus, a.n AS n0, b.n AS n1, CASE WHEN b.n - a.n >= 2 AND b.n * 1.0 / a.n > 1.25 THEN 'COUNTER_GROWTH' ELSE 'ok' END AS finding FROM c a JOIN c b ON a.scenario = b.scenario AND a.corpus = b.corpus AND a.early AND NOT b.early""")
def e12_structural_gate(spark, d):
    m = measurements(spark, d)
    count = lambda early: m.where(F.col("early") == early).groupBy("scenario", "corpus").agg(F.count("*").alias("nodes"))
    return M.structural_gate(count(True), count(False))


@query("WITH c AS (SELECT event_type AS scenario, user_id % 6 AS corpus, count(*) AS n FROM events GROUP BY ALL) SELECT scenario, max(n) AS most, min(n) AS least, CASE WHEN max(n) * 1.0 / min(n) > 1.5 THEN 'NOT_FLAT' ELSE 'ok' END AS finding FROM c GROUP BY scenario")
def e12_scaling_gate(spark, d):
    return M.scaling_gate(measurements(spark, d).groupBy("scenario", "corpus").agg(F.count("*").alias("nodes")))


VERSIONS = "v AS (SELECT user_id, event_type, event_id AS version, ts FROM events)"


def versions(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("version"), "ts")


@query(f"WITH {VERSIONS} SELECT user_id, event_type, version, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, version DESC) AS ordinal, lag(version) OVER (PARTITION BY user_id, event_type ORDER BY ts, version) AS previous FROM v")
def f7_version_listing(spark, d):
    return D.list_versions(versions(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "version", "ordinal", "previous")


@query(f"WITH {VERSIONS}, m AS (SELECT max(ts) - INTERVAL 10 DAY AS t FROM v) SELECT user_id, event_type, max_by(version, struct_pack(a := ts, b := version)) AS version FROM v, m WHERE ts <= t GROUP BY ALL")
def j6_restore_as_of(spark, d):
    v = versions(spark, d)
    at = v.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("as_of"))
    return D.restore(v.join(F.broadcast(at)), ["user_id", "event_type"], F.col("as_of"))  # a single row


@query(f"WITH {VERSIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, version DESC) AS k FROM v) SELECT user_id, event_type, version FROM k WHERE k > 1")
def k18_collapse_versions(spark, d):
    return D.collapse_versions(versions(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "version")


@query("""WITH t AS (SELECT event_type AS op, floor(value * 1000) / 1000 AS s FROM events), g AS (SELECT op, count(*) AS calls, sum(s) AS total, avg(s) AS average, min(s) AS least, max(s) AS most FROM t GROUP BY op)
SELECT op, calls, round(total, 3) AS total, round(average, 6) AS average, round(least, 3) AS least, round(most, 3) AS most, row_number() OVER (ORDER BY total DESC, op) AS by_total, row_number() OVER (ORDER BY average DESC, op) AS by_average FROM g""")
def k15_timing_bottlenecks(spark, d):
    b = M.bottlenecks(M.parse_log(M.log_lines(table(spark, d, "events"))))
    return b.select("op", "calls", F.round("total", 3).alias("total"), F.round("average", 6).alias("average"), F.round("least", 3).alias("least"), F.round("most", 3).alias("most"), "by_total", "by_average")


@query("SELECT event_id, 'ERROR' AS level, event_type AS op FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def k16_log_view(spark, d):
    e = M.parse_log(M.log_lines(table(spark, d, "events"))).where("importance >= 8 and op rlike '^err'")
    return e.join(table(spark, d, "events").select("event_id", "ts"), "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "level", "op")


@query("SELECT event_type AS category, count(*) AS n, min(event_id) AS sample FROM events GROUP BY event_type")
def k14_errors_by_category(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))
