"""Best-fit packing of token sequences by the linear grouping scheme.

Fernandez de la Vega and Lueker, "Bin packing can be solved within 1 + epsilon
in linear time" (1981): large lengths are rounded up within groups of equal
cardinality, configurations over these few sizes are optimised by a linear
program (columns by a knapsack), the documents themselves take the places of
their rounded sizes, and small ones go best-fit into what is left.

The plan needs nothing but how many pieces have each length: at most `capacity`
numbers, whatever the size of the corpus. Documents meet their places by rank
within their length, in joins.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import keep
from .skew import chunked_sums

CAPACITY = 1024
#: Ends each document; of "<|endoftext|>" where a text spells it out.
END, SPELLED, SPELLED_ID = 2, "<|endoftext|>", 50256
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 512
#: Columns that the linear program takes in at most; it ends before at a gap of GAP.
COLUMNS, GAP = 300, 1e-4
#: Lengths of at most capacity / SMALL are small; a sequence with over capacity / REOPEN of room is loose.
SMALL, REOPEN = 4, 16


def tokenizer(path: str, pattern: str | None = None):
    """The byte-level BPE whose ranks are at `path`; gives the ids of the tokenizers file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPELLED: SPELLED_ID})


_LOADED: dict[str, object] = {}


def _encoder(path: str):
    if path not in _LOADED:
        _LOADED[path] = tokenizer(path)
    return _LOADED[path]


def _pieces(path: str, capacity: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            cols: list[list] = [[] for _ in range(5 + ids)]
            for doc, text in zip(docs, texts, strict=True):
                text = text.as_py()
                got = enc.encode(text, allowed_special="all") if text and SPELLED in text else enc.encode_ordinary(text or "")
                got.append(END)
                raw = np.array(got, "<u4")
                start, piece = 0, 0
                size = len(got) % capacity or capacity
                while start < len(got):
                    part = raw[start : start + size].tobytes()
                    for c, v in zip(cols, (doc, piece, start, size, zlib.crc32(part), part), strict=False):
                        c.append(v)
                    start, piece, size = start + size, piece + 1, capacity
                if len(cols[0]) >= 5000:
                    yield _batch(cols, ids)
                    cols = [[] for _ in range(5 + ids)]
            if cols[0]:
                yield _batch(cols, ids)

    return run


def _batch(cols: list[list], ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: 5 + ids])


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Token pieces of each row: doc_id, piece, start, length, ids_crc32 (and, if asked for, the little-endian ids).

    A row's ids are its text's (null: none), then END. Only rows of more than
    `capacity` ids are cut, into pieces of `capacity`; the first may be shorter.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(path, capacity, ids), schema)


# -- the plan, over counts by length ------------------------------------------------------------------


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """Of configurations with one of `first`, the index of the largest size left, one that fills capacity best."""
    left = capacity - sizes[first]
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i in range(first, len(sizes)):
        n = counts[i] - (i == first)
        for _ in range(min(n, left // sizes[i])):
            new = (reach << sizes[i]) & mask & ~reach
            if not new:
                break
            steps.append((i, reach))
            reach |= new
        if reach >> left & 1:
            break
    fill, used = reach.bit_length() - 1, [first]
    for i, before in reversed(steps):
        if not before >> fill & 1:
            used.append(i)
            fill -= sizes[i]
    return used


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(indices of sizes, times) until all counts are used; sizes go down."""
    counts, out, first = list(counts), [], 0
    while True:
        while first < len(sizes) and not counts[first]:
            first += 1
        if first == len(sizes):
            return out
        used = _fullest(sizes, counts, first, capacity)
        need: dict[int, int] = defaultdict(int)
        for i in used:
            need[i] += 1
        times = min(counts[i] // n for i, n in need.items())
        for i, n in need.items():
            counts[i] -= n * times
        out.append((used, times))


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of (length, count), lengths going down, of the least cardinality that makes `groups` equal ones; a group's size is its first length."""
    each, out, taken = -(-sum(counts.values()) // groups), [], 0
    for n in sorted(counts, reverse=True):
        if not out or taken >= each:
            out.append([])
            taken = 0
        out[-1].append((n, counts[n]))
        taken += counts[n]
    return out


def _best_column(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth, as a count of each size: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (n, v) in enumerate(zip(sizes, worth.tolist(), strict=True)):
        for _ in range(capacity // n if v > 1e-9 else 0):  # each round one more of it
            more = best[:-n] + v
            up = more > best[n:] + 1e-12
            if not up.any():
                break
            best[n:][up], last[n:][up] = more[up], i
    column, room = np.zeros(len(sizes)), int(best.argmax())
    while last[room] >= 0:
        column[last[room]] += 1
        room -= sizes[last[room]]
    return column


class _Basis:
    """k configurations, as columns, with the inverse of their matrix, and how often each is taken. It begins with single sizes.

    Products are summed plainly: threaded linear algebra is no safe guest in the driver's process.
    """

    def __init__(self, counts: list[int]):
        self.columns, self.inverse, self.times = np.eye(len(counts)), np.eye(len(counts)), np.array(counts, float)

    def change(self, column: np.ndarray) -> np.ndarray:
        return (self.inverse * column).sum(1)

    def enter(self, column: np.ndarray) -> None:
        """Takes the column in for the one that is used up first as it is taken more."""
        d = self.change(column)
        ratio = np.full(len(d), np.inf)
        np.divide(self.times, d, out=ratio, where=d > 1e-9)
        out = int(ratio.argmin())
        self.times = np.maximum(self.times - ratio[out] * d, 0)
        self.times[out] = ratio[out]
        self.columns[:, out] = column
        self.inverse[out] /= d[out]
        d[out] = 0
        some = np.flatnonzero(d)
        self.inverse[some] -= d[some, None] * self.inverse[out]


def optimised(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(indices of sizes, times) that use all counts, with few sequences; sizes go down.

    A linear program over configurations, those of a greedy plan first, by column
    generation; what its solution has in whole numbers is taken, and the greedy
    configurations serve the rest.
    """
    greedy, k = _configurations(sizes, counts, capacity), len(sizes)
    if not k:
        return []
    basis = _Basis(counts)
    for used, _ in greedy:
        column = np.bincount(used, minlength=k).astype(float)
        if (column * basis.inverse.sum(0)).sum() > 1 + GAP:
            basis.enter(column)
    for _ in range(COLUMNS):
        worth = basis.inverse.sum(0)
        column = _best_column(sizes, worth, capacity)
        if (column * worth).sum() <= 1 + GAP:
            break
        basis.enter(column)
    columns = basis.columns.round().astype(int)
    whole, rest, taken = np.floor(basis.times + 1e-6).astype(int), np.array(counts), []
    for j in np.argsort(-whole, kind="stable"):  # no more than there is, whatever rounding errors say
        some = columns[:, j] > 0
        times = min(int(whole[j]), int((rest[some] // columns[some, j]).min()))
        if times:
            rest -= columns[:, j] * times
            taken.append(([i for i in np.flatnonzero(some).tolist() for _ in range(columns[i, j])], times))
    both = taken + _configurations(sizes, rest.tolist(), capacity)
    return min(both, greedy, key=lambda runs: sum(times for _, times in runs))


def _substituted(runs: list[tuple[list[int], int]], members: list[list[tuple[int, int]]]) -> list[tuple[list[int], int]]:
    """(lengths, times): the members of each group, largest first, in the places of their size."""
    queue, out = [[list(m) for m in group[::-1]] for group in members], []
    for used, times in runs:
        need: dict[int, int] = defaultdict(int)
        for i in used:
            need[i] += 1
        while times:  # as long as every place takes a document of one length, sequences are alike
            alike = min(times, *(queue[i][-1][1] // n for i, n in need.items()))
            lengths = []
            for i in used:  # if a place spans two lengths, one sequence by itself
                lengths.append(queue[i][-1][0])
                queue[i][-1][1] -= max(1, alike)
                if not queue[i][-1][1]:
                    queue[i].pop()
            out.append((lengths, max(1, alike)))
            times -= max(1, alike)
    return out


def _best_fit(kept: list[tuple[list[int], int]], small: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The kept runs with the small lengths in the fullest sequences that have room, longest first."""
    free: dict[int, list] = defaultdict(list)
    for lengths, times in kept:
        free[capacity - sum(lengths)].append([lengths, times])
    rooms = sorted(free)

    def put(room: int, run: list) -> None:
        if room not in free:
            bisect.insort(rooms, room)
        free[room].append(run)

    for n in sorted(small, reverse=True):
        rest = small[n]
        while rest:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):  # nowhere: new sequences filled with this length
                each = min(capacity // n, rest)
                x = rest // each
                put(capacity - each * n, [[n] * each, x])
                rest -= each * x
                continue
            room = rooms[at]
            run = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = min(room // n, rest)
            x = min(run[1], rest // each)
            if run[1] > x:
                put(room, [run[0], run[1] - x])
            put(room - each * n, [run[0] + [n] * each, x])
            rest -= each * x
    return [(r[0], r[1]) for rs in free.values() for r in rs]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Runs (lengths in a sequence, number of such sequences) that use each length as often as counts says."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    full = [([capacity], counts[capacity])] if capacity in counts else []
    members = grouped({n: c for n, c in counts.items() if capacity // SMALL < n < capacity}, groups)
    runs = _substituted(optimised([g[0][0] for g in members], [sum(c for _, c in g) for g in members], capacity), members)
    small = Counter({n: c for n, c in counts.items() if n <= min(capacity // SMALL, capacity - 1)})
    loose = lambda lengths: capacity - sum(lengths) > capacity // REOPEN
    tried = []
    # What is not kept goes best-fit: loose sequences; and those without a document of over half, whose pieces may fit beside such.
    for reopened in (loose, lambda lengths: loose(lengths) or 2 * max(lengths) <= capacity):
        rest = small.copy()
        for lengths, times in runs:
            if reopened(lengths):
                rest.update({n: k * times for n, k in Counter(lengths).items()})
        tried.append(_best_fit([r for r in runs if not reopened(r[0])], rest, capacity))
    return full + min(tried, key=lambda p: sum(times for _, times in p))


def _places(runs: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, ranks a sequence, offset of the first): ranks go to sequences in order."""
    out, sequence, used = [], 0, defaultdict(int)
    for lengths, times in runs:
        offset, each = 0, defaultdict(int)
        for n in lengths:
            each[n] += 1
        for n, m in each.items():
            out.append((n, used[n], m * times, sequence, m, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    Every row, repeated ones too, has one place; sequences have no gap. Which of
    equally long rows takes which place follows a hash of (doc_id, piece), then
    doc_id, piece and start; rows alike in all take places in any order. Null ids
    are ids like others. An empty table gives an empty result. Other columns are kept.
    """
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    places = _places(plan(counts, capacity))
    spans = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], "length long, lo long, ranks long, seq long, each long, base long")
    order = [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece"), F.col("start")]
    ranked = chunked_sums(parts.withColumn("length", F.col("length").cast("long")), ["length"], order, F.lit(1), max(total, 1)).withColumnRenamed("before", "_rank")
    # Of a length's places, that which holds the rank: the rows in spans are bounded by the lengths and configurations.
    table = spans.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "ranks", "seq", "each", "base"))).alias("_spans"))
    got = ranked.join(F.broadcast(table), "length").withColumn("_at", F.expr("filter(_spans, s -> _rank >= s.lo and _rank < s.lo + s.ranks)[0]"))
    k = F.col("_rank") - F.col("_at.lo")
    return (
        got.withColumn("sequence_id", F.col("_at.seq") + F.floor(k / F.col("_at.each")).cast("long"))
        .withColumn("offset", F.col("_at.base") + F.pmod(k, F.col("_at.each")) * F.col("length"))
        .drop("_spans", "_at", "_rank")
    )


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row.

    Null and empty texts are the END token alone; null ids stay null; repeated
    rows are packed as often as they come; other columns are ignored.
    `path`: the ranks of the tokenizer's vocabulary.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    parts = keep(pieces(docs, path, id_col, text_col, capacity, ids), "pieces")
    return pack(parts, capacity)
