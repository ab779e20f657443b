"""Exact dedup by deterministic block naming; DataFrame functions only.

Karp, Miller and Rosenberg (STOC 1972): texts are cut into blocks of a fixed
size, the sorted distinct blocks become integer names, then adjacent pairs of
names are named again until one name is left for each text. Names of one level
differ exactly if what they name differs, so with its number of blocks a text's
last name is an identity without collisions.

A name is (bucket of the key, rank of the key among the bucket's sorted keys).
Keys that recur very often are sorted apart, once each, and meet their rows by a
join of few rows, so that a large group of copies never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import drop, keep
from .skew import HOT_ROWS, attach

BLOCK = 1024
#: Buckets in which keys are sorted; names are bucket * 2^39 + rank.
BUCKETS = 1 << 24
SPACE = r"[\x20\x09-\x0D]+"


def name_keys(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """Replaces the key columns by `name`: equal for equal keys (null equals null), different for different ones."""
    hashed = rows.withColumn("_h", F.xxhash64(*key))
    limit = max(1000, total // HOT_ROWS)
    hot = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select("_h", F.lit(True).alias("_hot"))
    marked = hashed.join(F.broadcast(hot), "_h", "left")  # at most HOT_ROWS rows
    bucket = F.pmod("_h", F.lit(BUCKETS))
    rank = F.dense_rank().over(W.partitionBy("_b").orderBy("_h", *key))
    name = (F.col("_b") * (1 << 39) + rank).alias("name")
    rest = [c for c in rows.columns if c not in key]
    cold = marked.where("_hot is null").withColumn("_b", bucket).select(*rest, name)
    # Hot keys: each once, named below zero, so that they share no name with the others.
    few = marked.where("_hot").select("_h", *key).distinct().withColumn("_b", bucket).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], (-F.col("_b") * (1 << 39) - rank).alias("name"))
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    warm = marked.where("_hot").join(F.broadcast(few), same).select(*rest, "name")
    return cold.unionByName(warm)


def identities(docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """One row per row of docs: doc_id, points, text_sha256, tkey and the identity (blocks, name); and their number."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(raw).alias("points"), F.xxhash64(raw).alias("tkey"), F.regexp_replace(raw, SPACE, "").alias("text"))
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block), F.lit(0))
    cut = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(cut)
    src = src.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("text", 256))
    # The row's own columns travel with its first block; the rest of them carry nulls.
    own = F.struct("doc_id", "points", "tkey", "text_sha256")
    rows = src.select("rid", own.alias("own"), F.posexplode(cut).alias("pos", "block"), F.size(cut).alias("blocks"))
    rows = rows.withColumn("own", F.when(F.col("pos") == 0, F.col("own")))
    total = docs.select(F.sum(F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) / block)))).first()[0] or 0
    level = keep(name_keys(rows, ["block"], total), "names")
    owners = level.where("pos = 0").select("rid", "own.*", "blocks", "name")
    done, open_, most = owners.where("blocks = 1"), level.where("blocks > 1").select("rid", "pos", "name"), level.agg(F.max("blocks")).first()[0] or 0
    n, old = total, None
    while most > 1:
        pair = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name"))).alias(f"p{side}")
        pairs = open_.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(pair(0), pair(1))
        named = keep(name_keys(pairs, ["p0", "p1"], n), "names")
        if old is not None:
            drop(old)
        old, most = named, (most + 1) // 2
        open_ = named
    if old is not None:
        last = old.where("pos = 0").select("rid", F.col("name").alias("last"))
        long = owners.where("blocks > 1").drop("name").join(last, "rid").withColumnRenamed("last", "name")
        done = done.unionByName(long.select(done.columns))
    return done, total


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, tkey (xxhash64 of the text).

    Texts are equal if they are after deleting [\\x20\\x09-\\x0D]; null is empty,
    and all empty texts are one group. Of a group the row with most code points
    stays, then the smallest id (null last); of repeated rows alike in both, one
    stays. An empty table gives an empty result; other columns are ignored.
    """
    rows, _ = identities(docs, id_col, text_col, block)
    rows = keep(rows.withColumnRenamed("rid", "_rid"), "identities")
    n = rows.count()
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_rid").alias("r"))
    groups = rows.groupBy("blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    out = attach(rows, groups, ["blocks", "name"], "group_size", n)
    return out.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("best.r") == F.col("_rid")).alias("kept"), "text_sha256", "tkey")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS x FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY points DESC, doc_id NULLS LAST) AS k,
             first_value(doc_id) OVER (PARTITION BY x ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY x) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(x) AS text_sha256 FROM r
"""
