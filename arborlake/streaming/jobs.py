"""Streams of events and documents: tumbling metrics, sessions, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.diff import sync_decisions
from ..operators.edits import transaction_report
from ..operators.lines import line_nodes


def metric_windows(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Rows, different users and errors by tumbling 10 minutes, exact; works on a table and on a stream.

    On a stream, rows of windows that ended `late` or longer before the last event of earlier batches are dropped, and a window
    is appended once, when it has ended by as much. A window's users are counted one by one first, so that it is in no one task.
    """
    g = events.withWatermark("ts", late) if events.isStreaming else events
    each = g.groupBy(F.window("ts", "10 minutes").alias("w"), "user_id").agg(F.count("*").alias("_n"), F.count_if(F.col("event_type") == "error").alias("_e"))
    out = each.groupBy(F.window(F.window_time("w"), "10 minutes").alias("v")).agg(F.sum("_n").alias("n"), F.count("user_id").alias("users"), F.sum("_e").alias("errors"))
    return out.select(F.col("v.start").alias("start"), "n", "users", "errors")


def sessions(events: DataFrame, ttl: int = 1800, late: str = "1 hour") -> DataFrame:
    """Sessions of a user: they end after `ttl` seconds (60 to 604800) without an event."""
    if not 60 <= ttl <= 604_800:
        raise ValueError("ttl from 60 to 604800 seconds")
    g = events.withWatermark("ts", late) if events.isStreaming else events
    g = g.groupBy("user_id", F.session_window("ts", f"{ttl} seconds").alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Starts a stream whose finished rows are appended to Parquet under `path`; it takes what has arrived and stops, and goes on from its checkpoint when started again."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Starts a stream of (doc_id, text) into line nodes under `path`: of each batch only documents whose digest is new are tokenised.

    Batches are written by their number, so that a batch that is run again replaces itself.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        # Of a document's versions in a batch the last: by `seq` if there is one, else the greatest digest, so that it is no chance.
        last_ = F.struct("seq", F.sha2("text", 256), "text") if "seq" in df.columns else F.struct(F.sha2("text", 256), "text")
        docs = df.groupBy("doc_id").agg(F.max(last_).getField("text").alias("text"))
        digests = spark.read.schema("doc_id long, digest string, batch long").parquet(f"{path}/digests").where(F.col("batch") < n) if n else spark.createDataFrame([], "doc_id long, digest string, batch long")
        last = digests.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"))
        none = spark.createDataFrame([], "doc_id long")
        take = docs.join(sync_decisions(docs, last, none).where("tokenize").select("doc_id"), "doc_id", "left_semi")
        line_nodes(take).write.mode("overwrite").parquet(f"{path}/lines/batch={n}")
        take.select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/digests/n={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edit_stream(stream: DataFrame, path: str, checkpoint: str):
    """Starts a stream of edits (see operators.edits) over the node table under `path`, which begin() made.

    Each batch of the stream is a transaction: state=n+1 has the nodes and versions after batch n, and its errors.
    Batches with stale versions are refused and leave no trace. A batch that is run again replaces itself.
    """

    def batch(df: DataFrame, n: int) -> None:
        nodes, versions = (df.sparkSession.read.parquet(f"{path}/{x}/state={n}") for x in ("nodes", "versions"))
        for x, rows in zip(("nodes", "versions", "errors"), transaction_report(nodes, df, versions), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{x}/state={n + 1}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def begin(nodes: DataFrame, versions: DataFrame, path: str) -> None:
    """The node table that a stream of edits starts from."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/state=0")
    versions.write.mode("overwrite").parquet(f"{path}/versions/state=0")
