"""Blocks that are alike: exact Jaccard over word shingles, candidates by prefixes.

Chaudhuri, Ganti and Kaushik, "A primitive operator for similarity joins in data
cleaning" (2006), with places as in Xiao et al., "Efficient similarity joins for
near duplicate detection" (2008): in one order of all shingles, the rarest
first, the first n - ceil(t * n) + 1 of the n shingles of a block hold one of
each block that is alike by t. No link is missed. Equal blocks are one shape
first, so that copies make no candidates; of the shapes that share a shingle all
meet one hub first, and only those that are not held together then meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.settle import settle, unsettle

#: Words of a shingle; most shingles whose place in the order follows their frequency (the rest are ordered by hash, and any order is exact).
WORDS, FREQUENT = 5, 200_000
#: Shingles among which a task looks for repeats at a time, and words that it makes shingles of at a time.
HELD, SLICE = 2_500_000, 1 << 20
#: What products of sizes and similarities may be off.
EPS = 1e-9


def normal(text: Column) -> Column:
    """Lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_hashes(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Of each row's hashed words the sorted distinct shingles of k, as hashes; fewer words are one shingle."""
    ends = words.offsets.to_numpy()
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        h = words.values.slice(ends[i], ends[j] - ends[i]).to_numpy(zero_copy_only=False).view(np.uint64)
        full = np.zeros(len(h), np.uint64)
        for n in range(min(k, len(h))):
            full[: len(h) - n] = full[: len(h) - n] * np.uint64(0xC2B2AE3D27D4EB4F) + h[n:]
        full = _mix(full).view(np.int64)
        for a, b in zip(ends[i:j] - ends[i], ends[i + 1 : j + 1] - ends[i], strict=True):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
                continue
            one = np.array([b - a], np.uint64)
            for w in h[a:b]:
                one = _mix(one * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            yield one.view(np.int64)
        i = j


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that repeat among HELD of them, and how often."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(tokens[counts > 1]), pa.array(counts[counts > 1])], ["token", "n"])

    for b in batches:
        for s in shingles(b.column("words")):
            held.append(s)
            size += len(s)
            if size > HELD:
                yield flush()
                size = 0
    if held:
        yield flush()


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of counts(token, n), FREQUENT at most, sorted, and their numbers."""
    levels = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(FREQUENT).collect()
    total, least = 0, None
    for r in levels:
        total += r.k
        if total > FREQUENT:
            break
        least = r.n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(F.col("n") >= least).toPandas().sort_values("token")
    return top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _prefixes(similarity: float, common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = [], []
            for s in shingles(b.column("words")):
                sizes.append(len(s))
                want = len(s) - int(np.ceil(similarity * len(s) - EPS)) + 1
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = common[at] == s
                    late = s[often]
                    s = np.concatenate([s[~often], late[np.lexsort((late, counts[at[often]]))]])
                out.append(s[:want])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["id", "n", "prefix"])

    return run


def _jaccards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with the words of both the likeness; a shape is shingled once for all its pairs that follow each other."""
    last, own = None, None
    for b in batches:
        out = []
        x = b.column("x")
        ids = b.column("a").to_pylist()
        for i, y in enumerate(shingles(b.column("y"))):
            if own is None or ids[i] != last:
                last, own = ids[i], next(shingles(x.slice(i, 1)))
            both = len(np.intersect1d(own, y, assume_unique=True))
            out.append(both / (len(own) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "s"])


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of ids of texts (id, t) with `s`, the Jaccard of their sets of shingles. Texts of no pair are left out first."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = settle(texts.join(ids, "id", "left_semi"))
    unsettle(ids)
    x, y = some.select(F.col("id").alias("a"), F.col("t").alias("_x")), some.select(F.col("id").alias("b"), F.col("t").alias("_y"))
    rows = pairs.join(y, "b").join(x, "a").select("a", "b", word_hashes(F.col("_x")).alias("x"), word_hashes(F.col("_y")).alias("y"))
    out = settle(rows.mapInArrow(_jaccards, "a long, b long, s double"))
    unsettle(some)
    return out


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of candidates (a, na, pa, b, nb, pb), a shared shingle each, the pairs that are alike; written out."""
    na, nb = F.col("na"), F.col("nb")
    least = F.ceil(similarity / (1 + similarity) * (na + nb) - EPS)
    fit = pairs.where((F.least(na, nb) >= similarity * F.greatest(na, nb) - EPS) & (F.least(na - F.col("pa"), nb - F.col("pb")) >= least))
    fit = settle(fit.select("a", "b").distinct())
    out = alike(fit, texts).where(F.col("s") >= similarity).select("a", "b")
    unsettle(fit)
    return out


def similar_shapes(rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """From (id, shape, t) links (a, b) of alike shapes, by the least id of each: all that hold groups together, though not all within a group."""
    texts = rows.select("id", "t")
    words = rows.select("id", word_hashes(F.col("t")).alias("words"))
    counts = settle(words.select("words").mapInArrow(_repeats, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    prefixes = settle(words.mapInArrow(_prefixes(similarity, *_common(counts)), "id long, n int, prefix array<long>"))
    first = rows.groupBy("shape").agg(F.min("id").alias("id"))  # of equal texts one row
    index = prefixes.join(first.select("id"), "id", "left_semi").select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    index = settle(index)
    shared = index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = settle(index.join(shared, "token"))
    unsettle(counts, prefixes, index)
    # The hub is the shape whose prefix is commonest, so that few shapes are hubs of many shingles.
    weight = met.groupBy("id").agg(F.sum("df").alias("w"))
    hubs = met.join(weight, "id").groupBy("token").agg(F.max(F.struct("w", "id", "n", "pos")).alias("h"))
    pairs = met.join(hubs, "token").where("id <> h.id").select(F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("h.pos").alias("pa"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    first = _linked(pairs, texts, similarity)
    held = linked_groups(first)
    part = settle(met.join(held, met.id == held.node, "left").select(met["*"], F.coalesce("group", "id").alias("group")))
    unsettle(met)
    spread = part.groupBy("token", "group").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "group")).alias("m"), F.count("*").alias("k"))
    open_ = part.join(spread.where("k > 1").select("token", F.col("m.group").alias("major")), "token")
    x, y = open_.where("group <> major").alias("x"), open_.alias("y")
    pairs = x.join(y, F.expr("x.token = y.token and x.group <> y.group and (y.group = y.major or x.id < y.id)"))
    pairs = pairs.select(*[F.col(f"{side}.{c}").alias(f"{to}{name}") for side, name in (("x", "a"), ("y", "b")) for c, to in (("id", ""), ("n", "n"), ("pos", "p"))])
    more = _linked(pairs, texts, similarity)
    unsettle(part)
    return first.unionByName(more)


def linked_groups(links: DataFrame) -> DataFrame:
    """From links (a, b) of either order: (node, group) of all nodes with a link; the group is its least node.

    Each round takes the least group of the neighbours and then that node's own group, so that paths shorten by half.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("group")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("_g"))
        step = now.join(near, "node").select("node", F.least("group", "_g").alias("_g"), F.col("group").alias("_was"))
        up = step.select(F.col("node").alias("_g"), F.col("_g").alias("_top"))
        new = settle(step.join(up, "_g").select("node", F.least("_g", "_top").alias("group"), "_was"))
        moved = not new.where("group <> _was").isEmpty()
        unsettle(now)
        now = new
        if not moved:
            unsettle(both)
            return now.select("node", "group")


def structural_duplicates(blocks: DataFrame, min_lines: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of blocks (doc_id, line_start, line_end, text) of at least min_lines lines, with every occurrence.

    (group, doc_id, line_start, line_end, shapes, occurrences, similarity): group
    is the digest of the group's representative, its least shape by digest;
    shapes counts different texts, similarity is the least Jaccard of a shape
    with the representative. Shapes are alike from `similarity` on, and a group
    is what links of alike shapes hold together.
    """
    rows = blocks.where(F.col("line_end") - F.col("line_start") + 1 >= min_lines).withColumn("t", normal(F.col("text"))).where("t is not null")
    rows = settle(rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", "line_start", "line_end", F.sha2("t", 256).alias("shape"), "t"))
    groups = linked_groups(similar_shapes(rows.select("id", "shape", "t"), similarity))
    shapes = rows.groupBy("shape").agg(F.min("id").alias("id"))
    placed = settle(shapes.join(groups, F.col("id") == F.col("node"), "left").select("shape", "id", F.coalesce("group", "id").alias("_g")))
    heads = settle(placed.groupBy("_g").agg(F.min(F.struct("shape", "id")).alias("h"), F.count("*").alias("shapes")).select("_g", F.col("h.shape").alias("group"), F.col("h.id").alias("head"), "shapes"))
    pairs = settle(placed.join(heads.where("shapes > 1"), "_g").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    least = alike(pairs, rows.select("id", "t")).groupBy(F.col("a").alias("head")).agg(F.min("s").alias("similarity"))
    stats = heads.join(least, "head", "left").select("_g", "group", "shapes", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    found = settle(rows.select("doc_id", "line_start", "line_end", "shape").join(placed.select("shape", "_g"), "shape"))
    many = found.groupBy("_g").agg(F.count("*").alias("occurrences")).where("occurrences > 1").join(stats, "_g")
    unsettle(pairs)
    return found.join(many, "_g").select("group", "doc_id", "line_start", "line_end", "shapes", "occurrences", "similarity")
