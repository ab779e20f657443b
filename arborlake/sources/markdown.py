"""Markdown texts as trees of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import slug
from ..operators.lines import bare, line_nodes


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, slug, parent_line, body): ATX headings outside of fences.

    A section's parent is the nearest heading before it of a lower level; its body goes to the next heading.
    """
    w = W.partitionBy("doc_id").orderBy("line")
    rows = line_nodes(docs).withColumn("content", bare(F.col("content")))
    fence = F.sum(F.col("content").rlike("^(```|~~~)").cast("int")).over(w)
    rows = rows.withColumn("_open", fence % 2 == 1)
    mark = F.regexp_extract("content", r"^(#{1,6}) +\S", 1)
    rows = rows.withColumn("level", F.when(~F.col("_open") & (mark != ""), F.length(mark)))
    rows = rows.withColumn("_head", F.last(F.when(F.col("level").isNotNull(), F.col("line")), True).over(w))
    for k in range(1, 7):  # the last heading of each level, if none of a lower level came since
        rows = rows.withColumn(f"_l{k}", F.last(F.when(F.col("level") <= k, F.struct("line", "level")), True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    parent = F.coalesce(*[F.when(F.col("level") == k + 1, F.col(f"_l{k}.line")) for k in range(1, 6)])
    heads = rows.where("level is not null").select("doc_id", "line", "level", F.trim(F.regexp_replace("content", r"^#+ +|( +#+)? *$", "")).alias("title"), parent.alias("parent_line"))
    body = rows.where("level is null and _head is not null").groupBy("doc_id", F.col("_head").alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "content"))).getField("content"), "\n").alias("body"))
    return heads.join(body, ["doc_id", "line"], "left").withColumn("slug", slug(F.col("title"))).withColumn("body", F.coalesce("body", F.lit("")))
