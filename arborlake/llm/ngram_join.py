"""N-gram Jaccard join with adaptive multi-match prefixes.

Wang, Li and Feng, "Can we beat the prefix filtering?" (SIGMOD 2012): in one
global token order, sets whose overlap is at least t share at least m tokens of
their prefixes of |s| - t + m tokens. A document whose prefix has costly posting
lists takes a longer prefix and must share that many more tokens of it before it
is verified.

The join is exact for any token order; the order puts tokens that repeat within
some slice of the corpus last, most frequent latest.

Work is bounded on large groups of near copies: equal sets are one class; in
each posting list the class whose prefix is commonest is the hub, and all others
meet it first; linked classes become one component; only then are pairs made,
and only between different components. So no link between different components'
texts is lost, while a group that its hub holds together makes no pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import textops
from .components import components
from .scratch import drop, keep
from .skew import attach, sift

#: Most tokens whose place in the order follows their frequency; the rest are ordered by hash.
FREQUENT = 200_000
#: Tokens that a task holds while it looks for repeats.
HELD = 2_500_000
#: Tokens by which prefixes are kept longer than the least overlap asks for.
MATCHES = 1
#: Up to so many promised candidates a short prefix is taken; beyond, what costs less by the posting lists, if a verification costs VERIFY of their entries.
CHEAP, VERIFY = 8, 20


def overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap that a set of n tokens has with any partner."""
    return (percent * n + 99) // 100


def _repeats(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["token", "n"])

        for batch in batches:
            for part in textops.slices(batch.column(0)):
                found = textops.shingle_sets(part, k)
                held += found
                size += sum(map(len, found))
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _prefixes(percent: int, k: int, common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in textops.slices(batch.column("text")):
                sizes, prints, prefixes = [], [], []
                for s in textops.shingle_sets(part, k):
                    n = len(s)
                    sizes.append(n)
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    want = min(n, n - overlap(n, percent) + MATCHES)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        often = common[at] == s
                        rare, late = s[~often], s[often]
                        if len(rare) < want:
                            rare = np.concatenate([rare, late[np.lexsort((late, counts[at[often]]))]])
                        s = rare
                    prefixes.append(s[:want].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(part)), batch.column("tkey").slice(done, len(part)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "tkey", "n", "fp", "prefix"],
                )
                done += len(part)

    return run


def _verify(percent: int, k: int):
    """Rows sorted by (x, part, y), where y is null in x's own row; yields the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            done, xs, ys = 0, [], []
            x_all, y_all = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            for part in textops.slices(batch.column("text")):
                for i, s in enumerate(textops.shingle_sets(part, k), done):
                    if y_all[i] is None:
                        hub, own = x_all[i], s
                    elif x_all[i] == hub:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            xs.append(hub)
                            ys.append(y_all[i])
                done += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return run


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, k: int, fan: int = 256) -> DataFrame:
    """Of pairs (x, y) of class ids those that reach the threshold, found on whole texts; written out.

    A class x with many partners has them dealt out by `fan`, each part with its own copy of x's text.
    """
    rank = F.row_number().over(W.partitionBy("x", "_salt").orderBy("y"))
    pairs = pairs.withColumn("_salt", F.pmod(F.xxhash64("y"), F.lit(64))).withColumn("part", F.struct("_salt", (rank / fan).cast("long").alias("i"))).drop("_salt")
    pairs = keep(pairs, "pairs")
    need = pairs.select("x", "part", F.col("x").alias("uid"), F.lit(None).cast("long").alias("y")).distinct().unionByName(pairs.select("x", "part", F.col("y").alias("uid"), "y"))
    need = keep(need.join(classes.select("uid", "id", "tkey"), "uid").drop("uid"), "need")
    # Of copies of a text only the wanted row is found, by its id, so that many copies are in no task; other texts stay
    # where they are (a semi-join would be moved before the sifting).
    wanted = need.select("id", "tkey").distinct()
    texts = sift(docs, wanted, "tkey").join(wanted, ["id", "tkey"]).groupBy("tkey").agg(F.first("text").alias("text"))
    rows = need.drop("id").join(texts, "tkey").select("x", "part", "y", "text")
    rows = rows.repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    out = keep(rows.select("x", "y", "text").mapInArrow(_verify(percent, k), "x long, y long"), "linked")
    drop(pairs)
    drop(need)
    return out


def _bounds(percent: int) -> tuple[Column, Column]:
    """Of columns nx and ny the least overlap of a pair, and the most shared tokens that the kept prefixes can be asked for."""
    t = F.floor((percent * (F.col("nx") + F.col("ny")) + 99 + percent) / (100 + percent))
    most = F.least(t, t - F.floor((percent * F.greatest("nx", "ny") + 99) / 100) + MATCHES)
    return t, most


def _enough(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Of rows (by, nx, ny, px, py, share), a shared token each, the pairs that share enough tokens of long enough prefixes."""
    t, most = _bounds(percent)
    m = F.greatest(F.lit(1), F.floor(most * F.col("share")))
    fits = rows.where(f"nx * 100 >= ny * {percent} and ny * 100 >= nx * {percent}").withColumn("m", m)
    fits = fits.where((F.col("px") < F.col("nx") - t + F.col("m")) & (F.col("py") < F.col("ny") - t + F.col("m")))
    return fits.groupBy(*by).agg(F.count("*").alias("shared"), F.max("m").alias("m")).where("shared >= m").select(*by)


def _with_df(index: DataFrame) -> DataFrame:
    """index with `df`, the rows of each token, without tokens of one row. Tokens are counted by partial sums, so that no task holds one's rows."""
    counts = keep(index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    met = keep(sift(index, counts, "token"), "met")
    out = keep(attach(met, counts, ["token"], "df", met.count()), "counted")
    drop(met)
    drop(counts)
    return out


def _common(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens, FREQUENT at most, sorted, with their counts."""
    levels = sorted(((r.n, r.k) for r in seen.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for n, k in levels:
        if total + k > FREQUENT:
            break
        total, least = total + k, n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = seen.where(F.col("n") >= least).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], top["n"].to_numpy(np.int64)[by]


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row per row of docs: id_col, tkey, n_shingles, component_id, n_verified_links.

    tkey is xxhash64 of the text. component_id is the smallest id reachable by
    links of 100 * intersection >= percent * union between sets of distinct
    k-word shingles; n_verified_links counts the links of the row's class that were
    verified to find its component, not all that it has. Null or blank text has no shingle and links
    with nothing, not even another blank text. Null ids are never the smallest;
    where all are null the component is null. Repeated rows stay. An empty table
    gives an empty result. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    seen = src.select("text").mapInArrow(_repeats(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = keep(seen, "repeats")
    common, counts = _common(seen)
    drop(seen)

    rows = src.mapInArrow(_prefixes(percent, k, common, counts), "doc_id long, tkey long, n long, fp binary, prefix array<long>")
    long = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "prefixes")
    rows = keep(long.drop("prefix"), "rows")
    total = rows.count()
    classes = rows.where("n > 0").groupBy("fp").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = keep(classes, "classes")
    reps = keep(long.select("uid", "n", "prefix").join(classes.select("uid"), "uid", "left_semi"), "sets")
    drop(long)

    # The inverted index, without the tokens that one class alone has; weight: how common the tokens of a class's prefix are, in the mean.
    index = reps.select("uid", F.posexplode("prefix").alias("pos", "token"), F.col("n").cast("int").alias("n"))
    counted = _with_df(index)
    drop(reps)
    index = counted
    short = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1  # prefix for a partner of equal size
    base = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + MATCHES
    own = W.partitionBy("uid")
    cost = F.coalesce(F.sum(F.when(F.col("pos") < short, F.col("df") - 1)).over(own), F.lit(0))
    whole = F.sum("df").over(own)
    asked = F.greatest(F.lit(1), base - short + 1)  # shared tokens of the kept prefix, for a partner of equal size
    index = index.withColumn("share", F.when((cost > CHEAP) & (whole + VERIFY * whole / asked < cost * (1 + VERIFY)), 1.0).otherwise(0.0))
    index = index.withColumn("weight", whole / base)
    index = keep(index, "index")
    drop(counted)
    key = F.coalesce("doc_id", F.lit(-1 << 63)).alias("id")
    meta, texts = rows.select("uid", key, "tkey"), src.select(key, "tkey", "text")

    # First links: each class with the hub of its posting lists.
    hubs = index.groupBy("token").agg(F.max(F.struct("weight", "uid", "n", "pos")).alias("h"), F.count("*").alias("df"))
    met = attach(index.select("token", "uid", "n", "pos"), hubs, ["token"], "df", index.count()).where("uid <> h.uid")
    met = met.select(F.col("h.uid").alias("x"), F.col("uid").alias("y"), F.col("h.n").alias("nx"), F.col("n").alias("ny"), F.col("h.pos").alias("px"), F.col("pos").alias("py"), F.lit(1.0).alias("share"))
    linked = links(_enough(met, ["x", "y"], percent), meta, texts, percent, k)
    comp = keep(components(linked, "x", "y"), "parts")

    # Then all other pairs whose components differ.
    part = index.join(comp, index.uid == comp.node, "left").select(index["*"], F.coalesce("component", "uid").alias("comp"))
    spread = part.groupBy("token", "comp").agg(F.count("*").alias("c"))
    spread = spread.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
    # Partners' sizes differ by less than a band, so each meets its own band and the two beside it.
    width = max(math.log(100 / percent), 1e-9) * 1.001
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    open_ = keep(part.join(spread.select("token", F.col("major.comp").alias("major")), "token").withColumn("band", band), "open")
    a = open_.where("comp <> major").withColumn("near", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).alias("a")
    b = open_.alias("b")
    fits = F.expr(f"a.token = b.token and a.near = b.band and a.comp <> b.comp and (b.comp = b.major or a.uid < b.uid) and a.n * 100L >= b.n * {percent}L and b.n * 100L >= a.n * {percent}L")
    pairs = a.join(b, fits)
    # One side with a cheap prefix is enough for a pair.
    probe = F.expr("a.n > b.n or (a.n = b.n and a.uid > b.uid)")
    pick = lambda c: F.when(probe, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    rest = lambda c: F.when(probe, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    pairs = pairs.select(pick("uid").alias("x"), rest("uid").alias("y"), pick("n").alias("nx"), rest("n").alias("ny"), pick("pos").alias("px"), rest("pos").alias("py"), F.least("a.share", "b.share").alias("share"))
    pairs = _enough(pairs, ["x", "y"], percent)
    more = links(pairs, meta, texts, percent, k)
    if more.isEmpty():
        whole = comp
    else:
        all_links = linked.unionByName(more)
        whole = keep(components(all_links, "x", "y"), "parts")
    degree = linked.unionByName(more).select(F.explode(F.array("x", "y")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_verified_links"))

    named = classes.join(whole, classes.uid == whole.node, "left").select(classes["*"], F.coalesce("component", "uid").alias("comp"))
    named = named.join(degree, "uid", "left").withColumn("n_verified_links", F.coalesce("n_verified_links", F.lit(0)))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = attach(named, least, ["comp"], "_n", total).select("fp", "component_id", "copies", "n_verified_links")
    full = attach(rows.where("n > 0").select("doc_id", "tkey", "n", "fp"), named, ["fp"], "copies", total)
    full = full.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id", "n_verified_links")
    empty = rows.where("n = 0").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_verified_links"))
    out = full.unionByName(empty)
    for t in (open_, index):
        drop(t)
    return out
