"""Approximate nearest neighbours by learned partitions.

Dong, Indyk, Razenshteyn and Wagner, "Learning space partitions for nearest
neighbor search" (ICLR 2020): the neighbour graph of a bounded sample is cut
into balanced parts with few cut edges; a small classifier learns the parts and
then deals every vector to its most probable part and every query to several,
whose vectors are ranked again by the exact inner product. As many parts are
searched as give the wanted recall on rows that nothing was learned from. Parts
grow in number with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import keep
from .skew import attach

#: Most vectors that the partition is learned from: those with the smallest hashes.
FIT_ROWS = 8192
#: Rows of a part, up to the most parts that the sample can teach.
PART_ROWS, MOST_PARTS = 64, 512
GRAPH = 10
#: Share of true neighbours wanted, on HELD rows of the sample.
RECALL, HELD = 0.94, 512
#: Parts that meet queries together; vectors and queries that meet in one block.
TOGETHER, BLOCK_ROWS, BLOCK_QUERIES = 32, 20_000, 4_000


def neighbours(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Exact k nearest rows of x to each q, in blocks; own[i] is left out of q[i]'s."""
    out = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 256]] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k].copy())  # else the whole block stays in memory
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part per row: spherical k-means to begin with, then moves to the part of most neighbours while it has room."""
    r = np.random.default_rng(11)
    centre = x[r.choice(len(x), parts, replace=False)]
    for _ in range(10):
        label = (x @ centre.T).argmax(1)
        for j in range(parts):
            if (label == j).any():
                centre[j] = x[label == j].mean(0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    room = int(np.ceil(slack * len(x) / parts))
    liked = x @ centre.T
    label, size = np.full(len(x), -1), np.zeros(parts, int)
    for i in np.argsort(-liked.max(1), kind="stable"):
        for j in np.argsort(-liked[i], kind="stable"):
            if size[j] < room:
                label[i] = j
                size[j] += 1
                break
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        for c in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[near[:, c]]), 1)
            np.add.at(votes, (near[:, c], label), 1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            j = int(votes[i].argmax())
            if gain[i] <= 0:
                break
            if j != label[i] and size[j] < room:
                size[label[i]] -= 1
                size[j] += 1
                label[i] = j
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A linear classifier of parts; search: how many of its most probable parts a query goes to; share: of the rows that these held, on the sample."""

    weights: np.ndarray
    bias: np.ndarray
    search: int = 1
    share: float = 1.0

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")[:, :k]


def learn(x: np.ndarray, parts: int = MOST_PARTS, wanted: float = RECALL, top: int = 20) -> Router:
    """From the sample x (rows of floats); small samples get fewer parts."""
    x = np.asarray(x, np.float32)
    x = x / (np.sqrt((x * x).sum(1).mean()) + 1e-12)
    r = np.random.default_rng(5)
    held = np.zeros(len(x), bool)
    held[r.permutation(len(x))[: min(HELD, len(x) // 8)]] = True
    tests, x = x[held], x[~held]
    parts, dim = max(1, min(parts, len(x) // 14)), x.shape[1]
    if parts == 1 or not len(tests):
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))
    rows = np.arange(len(x))
    near = neighbours(x, x, GRAPH, rows)
    label = balanced_parts(x, near, parts)
    soft = np.zeros((len(x), parts), np.float32)
    for c in range(near.shape[1]):
        np.add.at(soft, (rows, label[near[:, c]]), 0.5 / near.shape[1])
    soft[rows, label] += 0.5
    # Logistic regression from the parts' directions, by Adam.
    centre = np.zeros((parts, dim), np.float32)
    np.add.at(centre, label, x)
    centre /= np.sqrt((centre * centre).sum(1, keepdims=True)) + 1e-9
    w = [12 * centre.T.copy(), np.zeros(parts, np.float32)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(4):
        order = r.permutation(len(x))
        for i in range(0, len(x), 256):
            b = order[i : i + 256]
            z = x[b] @ w[0] + w[1]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - soft[b]) / len(b)
            t += 1
            for k, g in enumerate((x[b].T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w)
    true = neighbours(x, tests, min(top, len(x) - 1))
    homes = router.best(x, 1)[:, 0]
    order = router.best(tests, parts)
    needed = np.take_along_axis(np.argsort(order, axis=1), homes[true], axis=1)  # place of a neighbour's part in a query's order
    found = [(needed < k).mean() for k in range(1, parts + 1)]
    router.search = int(np.argmax(np.array(found) >= wanted)) + 1
    router.share = float(np.bincount(homes, minlength=parts)[order[:, : router.search]].sum(1).mean() / len(x))
    return router


def _valid(c: Column) -> Column:
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda v: v != 0), F.lit(False))


def _meet(top: int):
    """Within a block: each query's nearest ids in the parts that it asks for, more than needed by one for the query itself."""

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(c) and len(q):
            c = c.sort_values("part", kind="stable")
            x, y = np.stack(c["vector"].to_numpy()).astype(np.float64), np.stack(q["asked"].to_numpy()).astype(np.float64)
            ids, first = c["ids"].to_numpy(), np.array([i[0] for i in c["ids"]])
            part, starts = np.unique(c["part"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(x))
            k = min(top + 1, len(x))
            for i in range(0, len(y), 128):
                wants = [np.isin(part, p) for p in q["parts"].iloc[i : i + 128]]
                asks = np.stack(wants)
                s = np.full((len(asks), len(x)), -np.inf)
                for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    mine = np.flatnonzero(asks[:, n])
                    s[mine, a:b] = y[i + mine] @ x[a:b].T
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                for j in range(len(s)):
                    # Products of a matrix may round each time differently; the measure itself does not.
                    at = np.flatnonzero(s[j] >= least[j] - 1e-9 * (1 + abs(least[j]))) if least[j] > -np.inf else np.flatnonzero(s[j] > -np.inf)
                    exact = (x[at] * y[i + j]).sum(1)
                    order = np.lexsort((first[at], -exact))[:k]
                    some = [(-exact[o], int(d)) for o in order for d in ids[at[o]]]
                    some.sort()
                    out += [(q["h1"].iat[i + j], q["h2"].iat[i + j], d, -e) for e, d in some[: top + 1]]
        return pd.DataFrame(out, columns=["h1", "h2", "vec_id", "score"])

    return run


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, fit_rows: int = FIT_ROWS, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `top` nearest rows found, by inner product in double precision.

    A query is a row for which is_query holds; it never finds its own id. Ties go
    to the smaller id. Rows whose id or vector is null, and vectors that are
    zero, empty, not of the table's commonest length, or hold null or non-finite
    components take no part. Rows alike in both count once. Equal vectors are
    searched once and share what is found. Other columns are ignored; an empty
    table gives an empty result. `parts`: by default one for PART_ROWS distinct
    vectors, at most MOST_PARTS.
    """
    spark = table.sparkSession
    raw = F.col(vector_col).cast("array<double>")
    rows = table.where(_valid(raw)).select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("vector"), is_query.alias("is_query")).where("vec_id is not null")
    rows = keep(rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector")), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == lengths[0].d)

    # Distinct vectors, each with the smallest ids that have it: no query needs more.
    ids = rows.select("h1", "h2", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["h1", "h2", "salt"], ["h1", "h2"]):
        ids = ids.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).where(F.col("k") <= top + 1)
    ids = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    each = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.max("is_query").alias("is_query"))
    each = keep(each.join(ids, ["h1", "h2"]), "distinct-vectors")
    n = each.count()
    sample = each.where(F.pmod("h1", F.lit(1 << 40)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 40))).orderBy("h1", "h2").select("vector").limit(2 * fit_rows).toPandas()
    parts = parts or max(1, min(MOST_PARTS, n // PART_ROWS))
    router = learn(np.stack(sample["vector"].to_numpy()), parts, top=top) if len(sample) else learn(np.zeros((1, lengths[0].d)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best = router.best(np.stack(b["vector"].to_numpy()).astype(np.float32), router.search)
                yield b.assign(parts=list(best.astype(np.int32)))

    routed = keep(each.mapInPandas(route, "h1 long, h2 long, vector array<double>, is_query boolean, ids array<long>, parts array<int>"), "routed")
    # Queries go to groups of parts with the list of those that they ask for, so that their vectors are not sent once for each part.
    index = routed.select("h1", "vector", "ids", F.col("parts")[0].alias("part")).withColumn("group", F.floor(F.col("part") / TOGETHER))
    asked = routed.where("is_query").select("h1", "h2", "vector", "parts", F.explode(F.array_distinct(F.transform("parts", lambda p: F.floor(p / TOGETHER)))).alias("group"))
    asked = asked.withColumn("parts", F.filter("parts", lambda p: F.floor(p / TOGETHER) == F.col("group")))
    blocks = index.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("c")).join(asked.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("q")), "group")
    blocks = F.broadcast(blocks)  # a row for each group
    chunk = lambda c: F.pmod(F.col("h1"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.join(blocks, "group").withColumn("i", chunk("c")).withColumn("j", every("q")).select("group", "i", "j", "part", "vector", "ids")
    right = asked.join(blocks, "group").withColumn("j", chunk("q")).withColumn("i", every("c")).select("group", "i", "j", "h1", "h2", "parts", F.col("vector").alias("asked"))
    met = left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInPandas(_meet(top), "h1 long, h2 long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    best = met.withColumn("k", nth).where(F.col("k") <= top + 1)
    best = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    queries = rows.where("is_query").select("vec_id", "h1", "h2").distinct().withColumnRenamed("vec_id", "query_id")
    many = queries.groupBy("h1", "h2").agg(F.count("*").alias("_n"))
    answers = attach(queries, best.join(many, ["h1", "h2"]), ["h1", "h2"], "_n", rows.count())
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top)
    out = answers.select("query_id", F.posexplode(own).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
