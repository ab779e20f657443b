"""Markdown sections, snapshots, line ends and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.settle import shared_dir
from ..operators import lines as L
from ..sources import markdown, snapshot
from ..sources.catalog import table
from ..streaming import jobs
from .edit_queries import CHILDREN_OF, EDITS, WITH, edits, versions
from .registry import query


def scratch(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Of each document's lines the first is a heading of level 1, and every fifth after it one of level 2 or 3 in turn.
MARKED = """m AS (SELECT doc_id, line, c, CASE WHEN line = 1 THEN 1 WHEN line % 5 <> 1 THEN NULL WHEN line % 10 = 1 THEN 3 ELSE 2 END AS level FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))"""


@query(f"""WITH {MARKED}, h AS (SELECT doc_id, line, level FROM m WHERE level IS NOT NULL)
SELECT doc_id, line, level, CASE level WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE CASE WHEN line >= 11 THEN line - 5 ELSE 1 END END AS parent_line FROM h""")
def a9_markdown_sections(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "c"))
    n = F.col("i") + 1
    level = F.when(n == 1, "# ").when(n % 5 != 1, "").when(n % 10 == 1, "### ").otherwise("## ")
    line = F.struct("i", F.when(level != "", F.concat(level, F.lit("title of "), n.cast("string"))).otherwise("text"))
    docs = t.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)).getField("col2"), "\n").alias("text"))
    return markdown.sections(docs).select("doc_id", "line", "level", "parent_line")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text || '!' END AS text, CASE WHEN doc_id % 5 = 0 THEN 'CHECKSUM' END AS reason FROM documents WHERE text IS NOT NULL")
def a12_snapshots(spark, d):
    docs, path = table(spark, d, "documents").select("doc_id", "text").where("text is not null"), scratch(spark, "snapshot")
    snapshot.publish(docs, path, 1)
    snapshot.publish(docs.withColumn("text", F.concat("text", F.lit("!"))), path, 2)
    # What was written is changed behind the manifest's back where the id is a multiple of five.
    data = spark.read.parquet(f"{path}/data/version=2").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("text")))
    data.write.parquet(f"{path}/data/version=3")
    spark.createDataFrame([(3, snapshot.SCHEMA)], "version int, schema_version string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    good, bad = snapshot.read(spark, path)
    return good.select("doc_id", "text", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("text"), "reason"))


@query("SELECT doc_id, replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE chr(13) END) AS text FROM documents")
def i18_line_end_restore(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 3
    return L.restore_terminators(docs, docs.select("doc_id", F.when(k == 0, "CRLF").when(k == 2, "CR").alias("terminator")))


@query("""SELECT doc_id, i AS line, lpad('[' || i || '] ', CAST(len(CAST(len(a) AS VARCHAR)) + 3 AS INTEGER), ' ') || a[i] AS prefixed FROM
(SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS a FROM documents WHERE text <> ''), unnest(range(1, len(a) + 1)) u(i)""")
def y9_line_prefixes(spark, d):
    return L.prefixed(L.line_nodes(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "line", "prefixed")


@query(f"""{WITH}, {EDITS}, {CHILDREN_OF} SELECT doc_id, node_id, parent_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY s, node_id) - 1 AS child_index, CASE WHEN doc_id IN (SELECT k FROM good) THEN 2 ELSE 1 END AS version FROM n""")
def s1_edit_stream(spark, d):
    from ..sources.catalog import catalog_nodes

    path = scratch(spark, "edits")
    e = edits(spark, d)
    e.write.parquet(f"{path}/in/first")
    jobs.begin(catalog_nodes(spark, d).drop("ord_path", "depth"), versions(spark, d), path)
    run = lambda: jobs.edit_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in/*"), path, f"{path}/checkpoint").awaitTermination()
    run()
    e.where("expected_version = 1 and op in ('insert', 'delete')").write.parquet(f"{path}/in/late")  # their versions are stale by now, or they failed before
    run()
    nodes, now = spark.read.parquet(f"{path}/nodes/state=2"), spark.read.parquet(f"{path}/versions/state=2")
    return nodes.join(now, "doc_id").select("doc_id", "node_id", "parent_id", "child_index", "version")


@query("SELECT 0 AS batch, doc_id, 1 + length(text) - length(replace(text, chr(10), '')) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n FROM documents WHERE text <> '' UNION ALL SELECT 1, doc_id, 1 FROM documents WHERE doc_id % 3 = 0 AND text <> ''")
def s4_incremental_ingest(spark, d):
    path = scratch(spark, "ingest")
    docs = table(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    docs.write.parquet(f"{path}/in/first")
    run = lambda: jobs.ingest(spark.readStream.schema(docs.schema).parquet(f"{path}/in/*"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    run()
    docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), "doc_id")).otherwise(F.col("text"))).write.parquet(f"{path}/in/again")
    run()
    return spark.read.parquet(f"{path}/out/lines").groupBy("batch", "doc_id").agg(F.count("*").alias("n"))


#: Events up to the 20th arrive first, but for every 7th; then these, late, with all others. w1 and w2: last events of the two arrivals.
ARRIVALS = """e AS (SELECT *, ts < TIMESTAMP '2024-01-20' AND event_id % 7 <> 0 AS early FROM events), w AS (SELECT max(ts) FILTER (WHERE early) AS w1, max(ts) AS w2 FROM e)"""


def streamed(spark, d, job):
    """What a stream job appends in two runs, each of what has arrived by then; the second goes on from the first one's checkpoint."""
    path, e = scratch(spark, "stream"), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_id") % 7 != 0)
    for name, part in (("first", e.where(early)), ("second", e.where(~early))):
        part.write.parquet(f"{path}/in/{name}")
        jobs.append(job(spark.readStream.schema(e.schema).parquet(f"{path}/in/*")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in out.dtypes])


@query(f"""WITH {ARRIVALS}, k AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS start FROM e, w)
SELECT start, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM k
WHERE (early OR start + INTERVAL 10 MINUTE > w1 - INTERVAL 30 MINUTE) AND start + INTERVAL 10 MINUTE <= w2 - INTERVAL 30 MINUTE GROUP BY start""")
def s2_metric_stream(spark, d):
    return streamed(spark, d, jobs.metric_windows)


#: Rows of one user whose time is before the last one's end are of one session; those that ended before the watermark are closed.
@query(f"""WITH {ARRIVALS}, f AS (SELECT e.*, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM e WHERE early),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f), s AS (SELECT *, max(ts) OVER (PARTITION BY user_id, k) + INTERVAL 1800 SECOND <= w1 - INTERVAL 1 HOUR AS closed FROM g, w),
r AS (SELECT user_id, event_id, ts FROM s WHERE NOT closed UNION ALL SELECT user_id, event_id, ts FROM e, w WHERE NOT early AND ts + INTERVAL 1800 SECOND > w1 - INTERVAL 1 HOUR),
h AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM r), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM h)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1800 SECOND AS "end", count(*) AS n FROM s WHERE closed GROUP BY user_id, k
UNION ALL SELECT user_id, min(ts), max(ts) + INTERVAL 1800 SECOND, count(*) FROM i, w GROUP BY user_id, k, w2 HAVING max(ts) + INTERVAL 1800 SECOND <= w2 - INTERVAL 1 HOUR""")
def s3_session_stream(spark, d):
    return streamed(spark, d, jobs.sessions)
