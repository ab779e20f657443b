"""Joins and ranks whose cost per task does not follow the size of a key's group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Most rows that a broadcast of hot keys holds: a key is hot only if it has over 1/HOT_ROWS of all rows.
HOT_ROWS = 4096
#: Chunks of a key whose sums one task adds up.
BLOCK = 4096
#: Bits of the bitmap that sift() broadcasts: 262,144 rows of 64.
SIFT_BITS = 1 << 24


def attach(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of left with right, which has one row a key and in `weight` the key's rows in left.

    Keys with at least total / HOT_ROWS rows number HOT_ROWS at most, so their
    rows of right are broadcast; all others meet by a shuffle of the keys.
    `total` counts the rows of left.
    """
    limit = max(1000, total // HOT_ROWS)
    hot = right.where(F.col(weight) >= limit)
    cold = right.where(F.col(weight) < limit)
    mark = F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True)))
    marked = left.join(mark, on, "left")
    a = marked.where("_hot").drop("_hot").join(F.broadcast(hot), on)
    b = marked.where("_hot is null").drop("_hot").join(cold, on, how)
    return a.unionByName(b)


def sift(rows: DataFrame, wanted: DataFrame, key: str, bits: int = SIFT_BITS) -> DataFrame:
    """Rows of which the key may be one of `wanted`, before they are shuffled to meet it.

    A bitmap of the wanted keys' hashes, of a fixed size, is broadcast: bits / 64
    rows at most. No row whose key is wanted is lost; where the bitmap fills up,
    more of the others stay, and the join that follows drops them.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")
    bit = F.expr("shiftleft(1L, _p & 63)")
    words = wanted.select(place.alias("_p")).groupBy(F.expr("shiftright(_p, 6)").alias("_w")).agg(F.bit_or(bit).alias("_b"))
    met = rows.withColumn("_p", place).withColumn("_w", F.expr("shiftright(_p, 6)")).join(F.broadcast(words), "_w")
    return met.where("shiftrightunsigned(_b, _p & 63) & 1 = 1").select(rows.columns)


def chunked_sums(df: DataFrame, by: list[str], order: list[Column], value: Column, total: int, rows: int = 500) -> DataFrame:
    """Adds `before`: the sum of `value` over the rows of the same key that come earlier.

    Rows of a key are dealt by the hash of `order` into chunks of about `rows`
    rows, so that no task holds a whole group; the order is by (chunk, order).
    `order` must tell rows apart up to rows that are alike. Chunks are summed in
    blocks of BLOCK chunks, and the blocks by themselves, so that their sums are
    in no one task either.
    """
    chunks = 1
    while chunks * rows < total:
        chunks *= 2
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks))).withColumn("_value", value.cast("long"))
    each = df.groupBy(*by, "_chunk").agg(F.sum("_value").alias("_sum")).withColumn("_block", F.floor(F.col("_chunk") / BLOCK))
    blocks = each.groupBy(*by, "_block").agg(F.sum("_sum").alias("_sum"))

    def earlier(rows_: DataFrame, part: list[str], at: str, name: str) -> DataFrame:
        run = W.partitionBy(*part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return rows_.withColumn(name, F.coalesce(F.sum("_sum").over(run), F.lit(0))).drop("_sum")

    each, blocks = earlier(each, [*by, "_block"], "_chunk", "_inner"), earlier(blocks, by, "_block", "_outer")
    each = _meet(each, blocks, [*by, "_block"]).withColumn("_base", F.col("_inner") + F.col("_outer")).drop("_inner", "_outer", "_block")
    inside = W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _meet(df, each, [*by, "_chunk"])
    return out.withColumn("before", F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_chunk", "_value", "_base")


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join where null meets null."""
    right = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(right, same).drop(*[f"_on_{c}" for c in on])
