"""Versions of texts: digests, decisions, line differences, history."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.settle import settle, unsettle
from .lines import bare, line_nodes, merge_ranges


def sync_decisions(docs: DataFrame, stored: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per document what opening it does: create (no digest), none (equal), replace (changed), keep_tree (changed in an open session)."""
    rows = docs.select("doc_id", F.sha2("text", 256).alias("now")).join(stored.select("doc_id", F.col("digest").alias("was")), "doc_id", "left").join(sessions.select("doc_id", F.lit(True).alias("open")), "doc_id", "left")
    branch = F.when(F.col("was").isNull(), "create").when(F.col("was") == F.col("now"), "none").when(F.col("open"), "keep_tree").otherwise("replace")
    return rows.select("doc_id", branch.alias("branch"), branch.isin("create", "replace").alias("tokenize"))


def conflicts(base: DataFrame, source: DataFrame, tree: DataFrame, policy: str = "refuse") -> DataFrame:
    """Before a write: what changed since the session began, and whether the policy lets it pass."""
    j = base.select("doc_id", F.col("digest").alias("b")).join(source.select("doc_id", F.col("digest").alias("s")), "doc_id").join(tree.select("doc_id", F.col("digest").alias("t")), "doc_id")
    j = j.withColumn("source_changed", F.col("s") != F.col("b")).withColumn("tree_changed", F.col("t") != F.col("b"))
    code = F.when(F.col("source_changed"), "SOURCE_CHANGED").when(F.col("tree_changed"), "TREE_CHANGED")
    allow = {"refuse": code.isNull(), "overwrite_source": ~F.col("tree_changed"), "overwrite_tree": ~F.col("source_changed"), "overwrite_both": F.lit(True)}[policy]
    return j.select("doc_id", "source_changed", "tree_changed", code.alias("code"), allow.alias("allowed"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rising(places: pd.Series) -> pd.Series:
    """Where the longest strictly rising subsequence of each array goes through: places in the array, from 0."""

    def one(xs: np.ndarray) -> list[int]:
        ends, last, before = [], [], [-1] * len(xs)  # by length the least end, and where it stands
        for i, x in enumerate(xs):
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
                last.append(i)
            else:
                ends[k], last[k] = x, i
            before[i] = last[k - 1] if k else -1
        out, i = [], last[-1] if last else -1
        while i >= 0:
            out.append(i)
            i = before[i]
        return out[::-1]

    return places.map(one)


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of both versions of documents whose texts differ: (doc_id, side 0 or 1, line, content)."""
    differ = before.select("doc_id", F.col("text").alias("_a")).join(after.select("doc_id", F.col("text").alias("_b")), "doc_id", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    lines = [line_nodes(differ.select("doc_id", F.coalesce(c, F.lit("")).alias("text"))).withColumn("side", F.lit(i)) for i, c in enumerate(("_a", "_b"))]
    return lines[0].unionByName(lines[1]).select("doc_id", "side", "line", bare(F.col("content")).alias("content"))


def _ends(lines: DataFrame) -> DataFrame:
    """Adds `met`: the line of the other side that a line equals in the common beginning or, behind that, the common end; else null."""
    size = F.count_if(F.col("side") == 0).over(W.partitionBy("doc_id")), F.count_if(F.col("side") == 1).over(W.partitionBy("doc_id"))
    lines = lines.withColumn("_n", F.when(F.col("side") == 0, size[0]).otherwise(size[1])).withColumn("_m", size[0] + size[1] - F.col("_n"))
    short = F.least("_n", "_m")

    def first_odd(at: Column) -> Column:
        """The first place, counted by `at`, where the sides differ or one of them has ended."""
        pair = W.partitionBy("doc_id", at)
        odd = (F.min("content").over(pair) != F.max("content").over(pair)) | (F.count("*").over(pair) < 2)
        return F.when(odd, at)

    back = F.col("_n") - F.col("line") + 1
    lines = lines.withColumn("_f", first_odd(F.col("line"))).withColumn("_k", first_odd(back))
    whole = W.partitionBy("doc_id")
    lines = lines.withColumn("_head", F.least(F.coalesce(F.min("_f").over(whole) - 1, short), short))
    lines = lines.withColumn("_tail", F.least(F.coalesce(F.min("_k").over(whole) - 1, short), short - F.col("_head")))
    met = F.when(F.col("line") <= F.col("_head"), F.col("line")).when(back <= F.col("_tail"), F.col("_m") - back + 1)
    return lines.select("doc_id", "side", "line", "content", met.cast("int").alias("met"))


def align(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which lines of two versions are the same, in order: (doc_id, side, line, content, met).

    side is 0 before and 1 after; met is the line's partner on the other side,
    or null. Partners never cross. Only documents whose texts differ have rows.

    Common beginnings and ends are met first. Then, round by round, between each
    two neighbouring partners: lines that occur once on both sides are paired,
    or where there are none the n-th ones of equal lines, and of these pairs the
    longest run that rises on both sides stays (patience sorting). It ends where
    no stretch has a line in common; a document's rounds are few, as each splits
    its stretches. Partners are joined by sorting: as tables they are written in
    so few bytes that Spark would broadcast millions of them.
    """
    now = settle(_ends(_sides(before, after)))
    # A stretch is named by the earlier line of the last partners before it, which is the same on both sides; a line is known by its digest.
    order = W.partitionBy("doc_id", "side").orderBy("line")
    mine = F.when(F.col("side") == 0, F.when(F.col("met").isNotNull(), F.col("line"))).otherwise(F.col("met"))
    rest = now.select("doc_id", "side", "line", "met", F.unhex(F.md5("content")).alias("h"), F.coalesce(F.last(mine, True).over(order), F.lit(0)).alias("gap")).where("met is null")
    rest, found = settle(_shared(rest.drop("met"))), []
    while True:
        same = W.partitionBy("doc_id", "gap", "side", "h")
        dealt = rest.repartition("doc_id", "gap")
        nth = dealt.withColumn("_nth", F.row_number().over(same.orderBy("line"))).withColumn("_of", F.count("*").over(same))
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        pairs = nth.groupBy("doc_id", "gap", "h", "_nth").agg(of(0, "line").alias("a"), of(1, "line").alias("b"), F.max("_of").alias("_of")).where("a is not null and b is not null")
        pairs = pairs.withColumn("_once", F.col("_of") == 1)
        pairs = pairs.withColumn("_some", F.max("_once").over(W.partitionBy("doc_id", "gap"))).where("_once or not _some")
        stretch = pairs.groupBy("doc_id", "gap").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_p"))
        kept = stretch.select("doc_id", "gap", "_p", F.explode(_rising(F.col("_p.b"))).alias("_i")).select("doc_id", "gap", F.col("_p")[F.col("_i")].alias("_p")).select("doc_id", "gap", "_p.*")
        kept = settle(kept)
        if kept.isEmpty():
            unsettle(kept, rest)
            break
        found.append(kept)
        # Later rounds go over the lines without a partner of which the stretch has an equal one on the other side.
        new = kept.select("doc_id", "gap", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("line")), F.struct(F.lit(1).alias("side"), F.col("b").alias("line")))).alias("_l"), "a").select("doc_id", "gap", "_l.*", "a")
        split = rest.join(new.hint("merge"), ["doc_id", "gap", "side", "line"], "left").withColumn("_last", F.last("a", True).over(W.partitionBy("doc_id", "gap", "side").orderBy("line")))
        after_ = settle(_shared(split.where("a is null").select("doc_id", "side", "line", "h", F.coalesce("_last", "gap").alias("gap"))))
        unsettle(rest)
        rest = after_
    if not found:
        return now
    pairs = reduce(DataFrame.unionByName, found)
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("line"), F.col("b").alias("_met")), F.struct(F.lit(1).alias("side"), F.col("b").alias("line"), F.col("a").alias("_met")))
    new = pairs.select("doc_id", F.explode(both).alias("_l")).select("doc_id", "_l.*")
    later = now.where("met is null").drop("met").join(new.hint("merge"), ["doc_id", "side", "line"], "left").withColumnRenamed("_met", "met")
    return now.where("met is not null").unionByName(later)


def _shared(rest: DataFrame) -> DataFrame:
    """Lines (doc_id, side, line, h, gap) of which the stretch has an equal one on both sides."""
    both = W.partitionBy("doc_id", "gap", "h")
    return rest.withColumn("_0", F.min("side").over(both)).withColumn("_1", F.max("side").over(both)).where("_0 < _1").drop("_0", "_1")


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of one version only: (doc_id, change added or removed, line, content), in the order-keeping alignment of align().

    A moved line is removed in one place and added in another. A document in one version only has all its lines.
    """
    rows = align(before, after).where("met is null")
    return rows.select("doc_id", F.when(F.col("side") == 1, "added").otherwise("removed").alias("change"), "line", "content")


def changed_ranges(diff: DataFrame) -> DataFrame:
    """Runs of added lines in the later text."""
    return merge_ranges(diff.where("change = 'added'").select("doc_id", F.col("line").alias("lo"), F.col("line").alias("hi")))


def hunks(before: DataFrame, after: DataFrame, context: int = 3) -> DataFrame:
    """(doc_id, hunk, a_start, a_lines, b_start, b_lines, text): changes with up to `context` equal lines around them.

    Changes whose contexts touch are one hunk. text has a line each: `-`, `+` or
    a space, then the line; removed lines come before added ones. A side without
    lines starts at the line before it.
    """
    aligned = align(before, after)
    gap = F.count("met").over(W.partitionBy("doc_id", "side").orderBy("line"))
    rows = aligned.withColumn("_g", gap).where("side = 0 or met is null")
    kind = F.when(F.col("met").isNotNull(), 0).when(F.col("side") == 0, 1).otherwise(2)
    rows = rows.withColumn("_k", kind)
    order = W.partitionBy("doc_id").orderBy("_g", "_k", "line")
    rows = rows.withColumn("_at", F.row_number().over(order))
    # Lines of each side up to this row.
    rows = rows.withColumn("_a", F.count_if(F.col("_k") < 2).over(order)).withColumn("_b", F.count_if(F.col("_k") != 1).over(order))
    change = F.when(F.col("_k") > 0, F.col("_at"))
    rows = rows.withColumn("_last", F.max(change).over(order)).withColumn("_next", F.min(change).over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.where((F.col("_at") - F.col("_last") <= context) | (F.col("_next") - F.col("_at") <= context))
    rows = rows.withColumn("hunk", F.sum(F.coalesce(F.col("_at") - F.lag("_at").over(order) > 1, F.lit(True)).cast("int")).over(order))
    line = F.concat(F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), F.col("_k") + 1), "content")
    out = rows.groupBy("doc_id", "hunk").agg(
        F.count_if(F.col("_k") < 2).alias("a_lines"), F.count_if(F.col("_k") != 1).alias("b_lines"), F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.array_sort(F.collect_list(F.struct("_at", line.alias("t")))).alias("_t")
    )
    start = lambda last, n: F.when(n > 0, last - n + 1).otherwise(last)
    return out.select("doc_id", "hunk", start(F.col("_a"), F.col("a_lines")).alias("a_start"), "a_lines", start(F.col("_b"), F.col("b_lines")).alias("b_start"), "b_lines", F.array_join(F.col("_t.t"), "\n").alias("text"))


def unified(before: DataFrame, after: DataFrame, context: int = 3, before_label: str = "before", after_label: str = "after") -> DataFrame:
    """(doc_id, diff): the hunks of each changed document under `---` and `+++`, each behind its `@@` line; every line ends with LF."""
    size = lambda a, n: F.concat(a.cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))
    h = hunks(before, after, context)
    head = F.concat(F.lit("@@ -"), size(F.col("a_start"), F.col("a_lines")), F.lit(" +"), size(F.col("b_start"), F.col("b_lines")), F.lit(" @@\n"))
    each = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("hunk", F.concat(head, "text", F.lit("\n")).alias("t")))).alias("_t"))
    return each.select("doc_id", F.concat(F.lit(f"--- {before_label}\n+++ {after_label}\n"), F.array_join(F.col("_t.t"), "")).alias("diff"))


def compare(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per key agreement, divergence (also if only one side has it), with the fields that differ."""
    l = left.select(*key, F.lit(True).alias("_l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    r = right.select(*key, F.lit(True).alias("_r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    j = l.join(r, key, "full")
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields])), ",")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only")
    return j.select(*key, F.when(side.isNull() & (differ == ""), "agreement").otherwise("divergence").alias("verdict"), F.coalesce(side, differ).alias("what"))


def write_decisions(origin: DataFrame, session: DataFrame) -> DataFrame:
    j = origin.select("doc_id", F.sha2("text", 256).alias("a")).join(session.select("doc_id", F.sha2("text", 256).alias("b")), "doc_id")
    return j.select("doc_id", F.when(F.col("a") == F.col("b"), "no_op").otherwise("changed").alias("status"), (F.col("a") != F.col("b")).alias("content_changed"))


def carry_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of a new parse keep the id of the old node of the same (doc_id, short_id, fingerprint); others get one made of these."""
    from ..functions.text import as_uuid

    j = new.join(old.select("doc_id", "short_id", "fingerprint", F.col("node_id").alias("_old")), ["doc_id", "short_id", "fingerprint"], "left")
    made = as_uuid(F.col("doc_id").cast("string"), F.col("short_id").cast("string"), F.col("fingerprint"))
    return j.select("doc_id", "short_id", F.coalesce("_old", made).alias("node_id"), F.col("_old").isNotNull().alias("carried"))


def list_versions(versions: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """Newest first: ordinal, size and the version before."""
    w = W.partitionBy(*by)
    return versions.withColumn("ordinal", F.row_number().over(w.orderBy(F.desc(at), F.desc("version")))).withColumn("previous", F.lag("version").over(w.orderBy(at, "version")))


def restore(versions: DataFrame, by: list[str], as_of: Column, at: str = "ts") -> DataFrame:
    """The last version of each file up to a time."""
    return versions.where(F.col(at) <= as_of).groupBy(*by).agg(F.max_by("version", F.struct(at, "version")).alias("version"))


def collapse_versions(versions: DataFrame, by: list[str], at: str = "ts", keep_latest: bool = True) -> DataFrame:
    """What a collapse removes: all but the latest (or oldest) of each file."""
    order = [F.desc(at), F.desc("version")] if keep_latest else [F.col(at), F.col("version")]
    return versions.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k > 1").drop("_k")
