"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are windows of K words of which the middle one does not count (spaced
seeds; Ma, Tromp and Li, "PatternHunter", 2002), picked by winnowing, so that
any common run of GUARANTEED words holds one, and words that differ singly leave
seeds around them. Each seed meets the seed's first occurrence in the
corpus, which makes one match for an occurrence however often a passage recurs.
A passage whose seeds occur apart in earlier texts is so missed; hence tuples of
seeds that recur, whose first occurrences are not in order in one text, then
meet the tuple's first occurrence. A tuple has up to MOST_TUPLE neighbours, or
two seeds with up to MOST_SKIPPED between, as one text may hold a seed there
that differs in the other. Windows of
LEAST_WORDS + 1 words, which no passage found so far covers and whose seeds all
recur, meet theirs. So every common run of over LEAST_WORDS words is found.
Between a document and an earlier one matches are chained in both orders, with
gap costs, by a Fenwick tree over the earlier one's places; chains are then
aligned word by word on the texts, anew from each of their matches, and every
longest part of an alignment that agrees enough is a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import textops
from .scratch import drop, keep
from .skew import attach, sift

#: Words from a seed's first to its last, and those that count; k-mers in a winnowing window.
K, COUNTED, WINDOW = 9, (0, 1, 2, 3, 5, 6, 7, 8), 16
GUARANTEED = K + WINDOW - 1
#: Equal words on a run's diagonal from which its alignment begins anew.
STRETCH = 4
#: Words of a passage that is reported; the share of it that must agree.
LEAST_WORDS, LEAST_SAME = 50, 0.8
#: Cost of each word of a gap, on either side; words between neighbours of one chain.
GAP_COST, MOST_GAP = 0.1, 40
#: Neighbouring seeds that meet their first occurrence together, at most; seeds that two such may have between them.
MOST_TUPLE, MOST_SKIPPED = 5, 3
#: Chains of a text that meet one copy of it for their alignment.
FAN = 128
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each w neighbours, by doubling."""
    size = 1
    while size < w:
        step = min(size, w - size)
        a = pick(a[:-step], a[step:])
        size += step
    return a


def winnow(h: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places whose hash is the least of some window of w hashes (of fewer: the least one)."""
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, int)
    least = np.zeros(len(h) + w - 1, h.dtype)
    least[w - 1 : len(h)] = _sliding(h, w, np.minimum)
    return np.flatnonzero(_sliding(least, w, np.maximum) == h)


def _hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the hashes of its lower-cased words."""
    data, offsets = textops.buffers(texts)
    s, e, first = textops.words(data, offsets)
    h = textops.word_hashes(data, s, e)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield h[a:b]


def _kmers(h: np.ndarray, counted: tuple[int, ...] = COUNTED) -> np.ndarray:
    """Hashes of the words at the counted places from each place on."""
    n = len(h) - counted[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in counted:
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    return textops.mix(out)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`at`: 31 bits of the text's hash, then 32 of the place; texts of one id so stay apart."""
    for batch in batches:
        done = 0
        texts = batch.column("t").to_numpy()
        for part in textops.slices(batch.column("text")):
            rows, at, seeds = [], [], []
            for i, h in enumerate(_hashes(part), done):
                if len(h) > LEAST_WORDS:
                    km = _kmers(h)
                    p = winnow(km)
                    rows.append(np.full(len(p), i))
                    at.append((texts[i] << 32) + p)
                    seeds.append(km[p])
            done += len(part)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(np.concatenate(rows), pa.int64())), pa.array(np.concatenate(at)), pa.array(np.concatenate(seeds).view(np.int64))], ["doc", "at", "seed"])


def _runs(path: list[int], xs: list[int], ys: list[int], k: int) -> list[int]:
    """Of matches in order the runs on one diagonal, flat: x and y of the first match, words to the end of the last."""
    out: list[int] = []
    for i in path:
        if out and xs[i] - ys[i] == out[-3] - out[-2]:
            out[-1] = xs[i] + k - out[-3]
        else:
            out += xs[i], ys[i], k
    return out


def _open(h: np.ndarray, seeds: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows of LEAST_WORDS + 1 words that may recur and that no span of equal words covers.

    `seeds` are the places of seeds that recur. A window can recur only if the
    least k-mer of each winnowing window in it does.
    """
    km, size = _kmers(h), LEAST_WORDS + 1
    n, inner = len(h) - size + 1, size - K + 1 - WINDOW + 1
    known = np.concatenate([[0], np.cumsum(np.isin(_sliding(km, WINDOW, np.minimum), km[seeds]))])
    ok = known[inner : inner + n] - known[:n] == inner
    for a, b in spans:
        ok[a : max(a, b - size + 1)] = False
    at = np.flatnonzero(ok)
    every = _kmers(h, tuple(range(K)))
    out = np.zeros(len(at), np.uint64)
    for o in (*range(0, size - K, K), size - K):
        out = out * np.uint64(0x9FB21C651E98DF25) + every[at + o]
    return at, textops.mix(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, t, text, seeds, spans) the open windows, as _seeds gives them.

    `own`: each seed of the window that recurs occurs here first, so that no other such window equals it.
    """
    for batch in batches:
        done = 0
        texts, (seeds, sa), (spans, sb) = batch.column("t").to_numpy(), *((c.values, c.offsets.to_numpy()) for c in map(batch.column, ("seeds", "spans")))
        seeds, here, lo, hi = seeds.field(0).to_numpy(), seeds.field(1).to_numpy(zero_copy_only=False), spans.field(0).to_numpy(), spans.field(1).to_numpy()
        for part in textops.slices(batch.column("text")):
            rows, at, keys, own = [], [], [], []
            for i, h in enumerate(_hashes(part), done):
                p, k = _open(h, seeds[sa[i] : sa[i + 1]], list(zip(lo[sb[i] : sb[i + 1]].tolist(), hi[sb[i] : sb[i + 1]].tolist(), strict=True)))
                rows.append(np.full(len(p), i))
                at.append((texts[i] << 32) + p)
                keys.append(k)
                met = np.zeros(len(h) + 1, np.int64)
                met[seeds[sa[i] : sa[i + 1]] + 1] = ~here[sa[i] : sa[i + 1]]
                met = np.cumsum(met)
                own.append(met[p + LEAST_WORDS + 1 - K + 1] == met[p])
            done += len(part)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(np.concatenate(rows), pa.int64())), pa.array(np.concatenate(at)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own))], ["doc", "at", "seed", "own"])


#: Which of a run of seeds a tuple takes: two that may have up to MOST_SKIPPED between them, or up to MOST_TUPLE neighbours.
_PICKS = [(0, w) for w in range(1, MOST_SKIPPED + 2)] + [tuple(range(n)) for n in range(3, MOST_TUPLE + 1)]


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, t, seeds, spans) the tuples of seeds (pos, src, sat) whose first occurrences are not in order in one text.

    A seed is known by its first occurrence, so what a tuple's seeds meet is the
    same in every text that has it, and where that is one text in order they are
    chained there. `open` is false where a span, a passage found, has it all.
    """
    for batch in batches:
        docs, ts = (batch.column(c).to_numpy() for c in ("doc", "t"))
        (seeds, sa), (spans, sb) = ((c.values, c.offsets.to_numpy()) for c in map(batch.column, ("seeds", "spans")))
        a, z = sa[0], sa[-1]
        row = np.repeat(np.arange(batch.num_rows), np.diff(sa))
        pos, src, sat = (seeds.field(i).to_numpy()[a:z] for i in range(3))
        order = np.lexsort((pos, row))
        row, pos, src, sat = (c[order] for c in (row, pos, src, sat))
        # The farthest end of spans that begin no later than a seed, by text.
        lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy()
        reach = np.zeros(len(pos), np.int64)
        for i in np.flatnonzero(np.diff(sb)).tolist():
            s, e = sa[i] - a, sa[i + 1] - a
            by = np.argsort(lo[sb[i] : sb[i + 1]], kind="stable") + sb[i]
            k = np.searchsorted(lo[by], pos[s:e], "right")
            reach[s:e] = np.concatenate([[0], np.maximum.accumulate(hi[by])])[k]
        text = (row << 32) + pos  # texts lie farther apart than MOST_GAP
        word = textops.mix(textops.mix(src.view(np.uint64)) + sat.view(np.uint64))
        for picks in _PICKS:
            n, wide = len(picks), picks[-1]
            starts = np.arange(max(0, len(pos) - wide))
            # Longer ones hold a tuple of a passage's length.
            starts = starts[(text[starts + wide] - text[starts] <= MOST_GAP * wide) & (text[starts + wide - 1] - text[starts] < LEAST_WORDS)]
            chained, ordered = np.ones(len(starts), bool), np.ones(len(starts), bool)
            for i, j in zip(picks, picks[1:], strict=False):
                i, j = starts + i, starts + j
                chained &= text[j] - text[i] <= MOST_GAP
                ordered &= (src[j] == src[i]) & (sat[j] > sat[i]) & (sat[j] - sat[i] <= MOST_GAP)
            at = starts[chained & ~ordered]
            if len(at):
                key = np.zeros(len(at), np.uint64)
                for i in picks:
                    key = textops.mix(key * np.uint64(0x9FB21C651E98DF25) + word[at + i])
                places = pos[at[:, None] + np.array(picks)].astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(places) + 1, n, dtype=np.int32)), pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(docs[row[at]]), pa.array(ts[row[at]]), pa.array(key.view(np.int64)), pa.array(pos[at + wide] + K > reach[at]), lists], ["doc", "t", "key", "open", "places"])


def chain(x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, list[int]]]:
    """Spans (x0, x1, y0, y1) and runs of chains of matches (x, y) that rise in both, best first; ends are exclusive.

    A match adds k words, or fewer where it overlaps the one before; a gap costs
    GAP_COST for each of its words. So the best predecessor of a match is a
    prefix maximum, over smaller y, of score + GAP_COST * (x + y), which a
    Fenwick tree gives in logarithmic time. Chains are cut at gaps over MOST_GAP.
    """
    if not len(x):
        return []
    if len(x) == 1:
        return [(int(x[0]), int(x[0]) + k, int(y[0]), int(y[0]) + k, [int(x[0]), int(y[0]), k])]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y = x[fresh], y[fresh]
    n = len(x)
    if (x - y == x[0] - y[0]).all() and (n == 1 or np.diff(x).max() <= MOST_GAP):
        return [(int(x[0]), int(x[-1]) + k, int(y[0]), int(y[-1]) + k, [int(x[0]), int(y[0]), int(x[-1] - x[0]) + k])]
    ys = np.unique(y)
    rank = (np.searchsorted(ys, y) + 1).tolist()
    m, xs, yl = len(ys), x.tolist(), y.tolist()
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (m + 1)
    score, back, added = [0.0] * n, [-1] * n, 0
    for i in range(n):
        while xs[added] < xs[i]:  # matches at one x don't follow each other
            v, r = (score[added] + GAP_COST * (xs[added] + yl[added]), added), rank[added]
            while r <= m:
                if v > tree[r]:
                    tree[r] = v
                r += r & -r
            added += 1
        r, best = rank[i] - 1, (-1e18, -1)
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        j = best[1]
        gain = best[0] - GAP_COST * (xs[i] + yl[i]) if j >= 0 else -1.0
        if gain > 0:
            score[i], back[i] = gain + min(k, xs[i] - xs[j], yl[i] - yl[j]), j
        else:
            score[i] = k
    used, out = [False] * n, []
    of = lambda path: (xs[path[0]], xs[path[-1]] + k, yl[path[0]], yl[path[-1]] + k, _runs(path, xs, yl, k))
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        used[i], path, j = True, [i], back[i]
        while j >= 0 and not used[j]:
            used[j] = True
            if max(xs[path[-1]] - xs[j], yl[path[-1]] - yl[j]) > MOST_GAP:
                out.append(of(path[::-1]))
                path = []
            path.append(j)
            j = back[j]
        out.append(of(path[::-1]))
    return out


def _chains(batches: Iterator[pa.RecordBatch], k: int = K) -> Iterator[pa.RecordBatch]:
    """Matches of k words sorted by (doc, t, src, u, pos) to chains; a pair's matches are no more than its text's seeds.

    Pairs whose matches all lie on one diagonal without a gap over MOST_GAP are
    one chain; all of a batch are made at once.
    """
    held: list[tuple[np.ndarray, ...]] = []
    key = None

    def flush(out: list[list]) -> None:
        if held:
            px, py = (held[0][i] if len(held) == 1 else np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            for x0, x1, y0, y1, runs in chain(px, py, k):
                if x1 - x0 + 2 * (GUARANTEED - 1) > LEAST_WORDS:  # else no passage of that length
                    for c, v in zip(out, (*key, x0, x1, y0, y1, runs), strict=True):
                        c.append(v)

    names = ["doc", "t", "src", "u", "x0", "x1", "y0", "y1", "runs"]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)
    for batch in batches:
        out: list[list] = [[] for _ in names]
        ids = [batch.column(c).to_numpy() for c in names[:4]]
        p, q = (batch.column(c).to_numpy() for c in ("pos", "spos"))
        new = np.zeros(max(0, len(p) - 1), bool)
        for c in ids:
            new |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(p)]])
        bent = np.ones(len(first), bool)
        if len(first) > 2:  # the first and the last pair may go on in other batches
            gap = np.zeros(len(p), np.int64)
            gap[1:] = np.where(new, 0, p[1:] - p[:-1])
            off = p - q
            bent[1:-1] = ((np.minimum.reduceat(off, first) != np.maximum.reduceat(off, first)) | (np.maximum.reduceat(gap, first) > MOST_GAP))[1:-1]
            a, z = first[~bent], last[~bent] - 1
            long = p[z] + k - p[a] + 2 * (GUARANTEED - 1) > LEAST_WORDS
            a, z = a[long], z[long]
            ends = [p[a], p[z] + k, q[a], q[z] + k]
            flat = np.stack([p[a], q[a], p[z] + k - p[a]], axis=1).astype(np.int32).ravel()
            runs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[pa.array(c[a], pa.int64()) for c in ids], *[pa.array(c, pa.int64()) for c in ends], runs], names)
        for a, b in zip(first[bent].tolist(), last[bent].tolist(), strict=True):
            if b > a:
                now = tuple(c[a] for c in ids)
                if key != now:
                    flush(out)
                    key = now
                held.append((p[a:b], q[a:b]))
        yield batch_of(out)
    out = [[] for _ in names]
    flush(out)
    yield batch_of(out)


def _resync(a: list[int], b: list[int], i: int, j: int, slack: int) -> tuple[int, int]:
    """The least step from a difference at (i, j) to where two words agree again (or one, at an end)."""
    la, lb = len(a), len(b)
    if set(a[i : i + slack + 1]).isdisjoint(b[j : j + slack + 1]):
        return 1, 1
    for s in range(1, 2 * slack + 1):
        for p in range(max(0, s - slack), min(s, slack) + 1):
            x, y = i + p, j + s - p
            if x < la and y < lb and a[x] == b[y] and (x + 1 >= la or y + 1 >= lb or a[x + 1] == b[y + 1]):
                return p, s - p
    return 1, 1


def extend(a: np.ndarray, b: np.ndarray, slack: int = 3) -> list[tuple[int, int, int]]:
    """Blocks (place in a, in b, words) of equal words by which a passage goes on from their starts: up to the best count of equal words less twice the different ones."""
    a, b = a.tolist(), b.tolist()
    la, lb = len(a), len(b)
    i = j = score = best = found = 0
    out: list[tuple[int, int, int]] = []
    while i < la and j < lb:
        if a[i] == b[j]:
            i0 = i
            while i < la and j < lb and a[i] == b[j]:
                i, j = i + 1, j + 1
            out.append((i0, j - i + i0, i - i0))
            score += i - i0
            if score > best:
                best, found = score, len(out)
        elif score - 2 < best - 6:
            break
        else:
            p, q = _resync(a, b, i, j, slack)
            i, j, score = i + p, j + q, score - 2 * max(p, q)
            if score < best - 6:
                break
    return out[:found]


def _between(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Blocks of a longest common subsequence of two short stretches, which begin at i and j."""
    same = a[:, None] == b
    if not same.any():
        return []
    # most[p, q]: of a[p:] and b[q:]
    most = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for p in range(len(a) - 1, -1, -1):
        row = np.maximum(most[p + 1, :-1], (most[p + 1, 1:] + 1) * same[p])
        most[p, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out: list[tuple[int, int, int]] = []
    p = q = 0
    while p < len(a) and q < len(b) and most[p, q]:
        if same[p, q]:  # of equal words the first may always be taken
            out.append((i + p, j + q, 1))
            p, q = p + 1, q + 1
        elif most[p + 1, q] >= most[p, q + 1]:
            p += 1
        else:
            q += 1
    return out


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], k: int = STRETCH) -> list[tuple[int, int, int]]:
    """Blocks (place in a, in b, words) of equal words from the first run's start to the last one's end.

    The alignment begins anew at each stretch of k equal words on the diagonal
    of a run, so that no insertion or deletion puts it out. What lies between,
    less than MOST_GAP words of a side, is aligned by a longest common subsequence.
    """
    out: list[tuple[int, int, int]] = []
    i, j = runs[0][:2]
    if len(runs) == 1 and np.array_equal(a[i : i + runs[0][2]], b[j : j + runs[0][2]]):
        return [runs[0]]
    for x, y, n in runs:
        equal = np.zeros(n + 2, bool)
        np.equal(a[x : x + n], b[y : y + n], out=equal[1:-1])
        edges = np.flatnonzero(equal[1:] != equal[:-1]).tolist()
        for p, q in zip(edges[::2], edges[1::2], strict=True):
            skip = max(0, i - x - p, j - y - p)  # what earlier matches have taken
            if q - p >= k and skip < q - p:
                p += skip
                if x + p > i and y + p > j:
                    out += _between(a[i : x + p], b[j : y + p], i, j)
                out.append((x + p, y + p, q - p))
                i, j = x + q, y + q
    return out


def longest(blocks: list[tuple[int, int, int]], least: int = LEAST_WORDS, share: float = LEAST_SAME) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, same) of blocks in order: each longest part of more than `least` words on both sides of which at least `share` of the longer side agrees."""
    if not blocks:
        return []
    (x0, y0, _), (x1, y1, n), same = blocks[0], blocks[-1], sum(b[2] for b in blocks)
    if same >= share * max(x1 + n - x0, y1 + n - y0) - 1e-6:  # the whole
        return [(x0, x1 + n, y0, y1 + n, same)] if min(x1 + n - x0, y1 + n - y0) > least else []
    x, y, n = np.array(blocks, np.int64).T
    xe, ye, total = x + n, y + n, np.concatenate([[0], np.cumsum(n)])
    # same >= share * length, of a part from s to e: what e has less what s has, on either side.
    gx, gy, fx, fy = total[:-1] - share * x, total[:-1] - share * y, total[1:] - share * xe, total[1:] - share * ye
    out, last = [], -1
    for s in range(len(n)):
        ok = np.flatnonzero((fx[last + 1 :] >= gx[s] - 1e-6) & (fy[last + 1 :] >= gy[s] - 1e-6))
        if len(ok) and (e := last + 1 + int(ok[-1])) >= s:
            last = e
            if min(xe[e] - x[s], ye[e] - y[s]) > least:
                out.append((int(x[s]), int(xe[e]), int(y[s]), int(ye[e]), int(total[e + 1] - total[s])))
        if last == len(n) - 1:
            break
    return out


def exact_runs(blocks: list[tuple[int, int, int]], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Of blocks in order those of over `least` words; blocks that touch on both sides are one."""
    out: list[tuple[int, int, int]] = []
    for x, y, n in blocks:
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((x, y, n))
    return [b for b in out if b[2] > least]


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, spans) to the words of each span, with as many on either side as a seed may leave out."""
    room = GUARANTEED * 2
    for batch in batches:
        done = 0
        spans = batch.column("spans")
        ends, fields = spans.offsets.to_numpy(), spans.values
        cid, side, x, y = (fields.field(i).to_numpy() for i in range(4))
        for part in textops.slices(batch.column("text")):
            at, lefts, rows = [], [], []
            for i, h in enumerate(_hashes(part), done):
                w = h.astype(np.uint32).view(np.int32)
                for k in range(ends[i], ends[i + 1]):
                    lo = max(0, x[k] - room)
                    at.append(k)
                    lefts.append(x[k] - lo)
                    rows.append(w[lo : y[k] + room])
            done += len(part)
            if at:
                sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(side[at]), pa.array(np.array(lefts, np.int32)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rows)))], ["cid", "side", "left", "words"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages, and with same = 0 the exact runs in them."""
    names = ["cid", "x0", "x1", "y0", "y1"]
    for batch in batches:
        cid, x0s, x1s, y0s, y1s = (batch.column(c).to_numpy() for c in names)
        lxs, lys = (batch.column(c).to_numpy() for c in ("lx", "ly"))
        (wx, ox), (wy, oy), (rs, at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in map(batch.column, ("wx", "wy", "runs")))
        out: list[tuple] = []
        for i in range(batch.num_rows):
            a, b = wx[ox[i] : ox[i + 1]], wy[oy[i] : oy[i + 1]]
            lx, ly = int(lxs[i]), int(lys[i])
            ex, ey = lx + int(x1s[i] - x0s[i]), ly + int(y1s[i] - y0s[i])
            u, v = int(x0s[i]) - lx, int(y0s[i]) - ly
            runs = [(x - u, y - v, n) for x, y, n in rs[at[i] : at[i + 1]].reshape(-1, 3).tolist()]
            before = [(lx - x - n, ly - y - n, n) for x, y, n in extend(a[:lx][::-1], b[:ly][::-1])]
            after = [(ex + x, ey + y, n) for x, y, n in extend(a[ex:], b[ey:])]
            blocks = before[::-1] + align(a, b, runs) + after
            found = longest(blocks)
            for p0, p1, q0, q1, same in found:
                out.append((int(cid[i]), p0 + u, p1 + u, q0 + v, q1 + v, same))
            if any(same < max(p1 - p0, q1 - q0) for p0, p1, q0, q1, same in found):
                out += [(int(cid[i]), x + u, x + n + u, y + v, y + n + v, 0) for x, y, n in exact_runs(blocks)]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*names, "same"])


#: Of what _met gives: not the first occurrence itself.
ELSEWHERE = "doc <> src or at <> sat"


def _met(seeds: DataFrame, name: str) -> DataFrame:
    """Of seeds (doc, at, seed) that recur each occurrence with the first: (doc, at, src, sat)."""
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = keep(first.select("seed", F.col("f.doc").alias("src"), F.col("f.at").alias("sat")), f"first-{name}")
    # A plain join of what was written and what is read: adaptive execution splits a seed that very many texts have.
    met = keep(seeds.join(first, "seed").drop("seed"), f"met-{name}")
    drop(first)
    return met


def _found(src: DataFrame, met: DataFrame, name: str, k: int = K) -> DataFrame:
    """Passages (doc, t, src, u, x0, x1, y0, y1, same), and with same = 0 exact runs in them, by the chains of matches (doc, at, src, sat) of k words of texts (doc, t, text)."""
    half, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    met = met.select("doc", half("at").alias("t"), "src", half("sat").alias("u"), low("at").alias("pos"), low("sat").alias("spos"))
    pair = ["doc", "t", "src", "u"]
    met = met.repartition(*pair).sortWithinPartitions(*pair, "pos")
    chains = met.mapInArrow(partial(_chains, k=k), "doc long, t long, src long, u long, x0 long, x1 long, y0 long, y1 long, runs array<int>")
    chains = keep(chains.withColumn("cid", F.monotonically_increasing_id()), f"{name}chains")

    # The words of both sides of each chain, from the texts; a text with very many chains is dealt out in copies.
    span = lambda side, a, b: F.struct("cid", F.lit(side).alias("side"), F.col(a).alias("a"), F.col(b).alias("b")).alias("s")
    spans = chains.select("doc", "t", span(0, "x0", "x1")).unionByName(chains.select(F.col("src").alias("doc"), F.col("u").alias("t"), span(1, "y0", "y1")))
    sizes = spans.groupBy("doc", "t").agg(F.count("*").alias("k"))
    spans = attach(spans, sizes, ["doc", "t"], "k", 2 * chains.count())
    spans = spans.withColumn("deal", F.pmod(F.xxhash64("s.cid"), F.ceil(F.col("k") / FAN)))
    lists = spans.groupBy("doc", "t", "deal").agg(F.collect_list("s").alias("spans"))  # about FAN
    cut = src.join(lists, ["doc", "t"]).select("text", "spans").mapInArrow(_cuts, "cid long, side int, left int, words array<int>")
    cut = keep(cut, f"{name}passages")
    side = lambda n, w, a: cut.where(f"side = {n}").select("cid", F.col("words").alias(w), F.col("left").alias(a))
    both = chains.select("cid", "x0", "x1", "y0", "y1", "runs").join(side(0, "wx", "lx"), "cid").join(side(1, "wy", "ly"), "cid")
    good = both.mapInArrow(_aligned, "cid long, x0 long, x1 long, y0 long, y1 long, same long")
    good = good.join(chains.select("cid", *pair), "cid").drop("cid").where("not (doc = src and t = u and y1 > x0)")  # a text doesn't repeat what it overlaps
    good = keep(good, f"{name}found")
    drop(cut)
    drop(chains)
    return good


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of over LEAST_WORDS words that an earlier text has too, nearly: one row each.

    doc_id, start, end (words, end exclusive) of the later text; src_id,
    src_start, src_end of the earlier one; same: words that agree, at least
    LEAST_SAME of the longer side. Of an alignment each longest such part is a
    row; parts may overlap. Words are [^\\x20\\x09-\\x0D]+ with A-Z
    lower-cased. Earlier is by id (null last), then by the text's hash, then by
    place: a text may repeat itself. Rows alike in id and text count as one.
    Null and short texts have no passages. An empty table gives an empty result;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).alias("t"), text.alias("text"))
    # Of rows alike one; without such, texts are not shuffled for it.
    twice = keep(src.groupBy("doc", "t").agg(F.count("*").alias("n")).where("n > 1").select("doc", "t"), "repeated-rows")
    if not twice.isEmpty():
        src = src.join(twice, ["doc", "t"], "left_anti").unionByName(src.join(twice, ["doc", "t"], "left_semi").dropDuplicates(["doc", "t"]))
    seeds = keep(src.mapInArrow(_seeds, "doc long, at long, seed long"), "seeds")
    met = _met(seeds, "seeds")
    drop(seeds)
    good = _found(src, met.where(ELSEWHERE), "")

    # Tuples of seeds whose first occurrences lie apart: each that no passage covers meets the tuple's first occurrence.
    held = met.groupBy("doc", F.shiftright("at", 32).alias("t")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "src", "sat")).alias("seeds"))  # no more than its text's words
    over = good.where("same > 0").groupBy("doc", "t").agg(F.collect_set(F.struct("x0", "x1")).alias("spans"))  # starts and ends are places of its text
    none = F.array().cast("array<struct<x0: bigint, x1: bigint>>")
    tuples = held.where(F.size("seeds") > 1).join(over, ["doc", "t"], "left").select("doc", "t", "seeds", F.coalesce("spans", none).alias("spans"))
    tuples = keep(tuples.mapInArrow(_tuples, "doc long, t long, key long, open boolean, places array<int>"), "tuples")
    first = tuples.groupBy("key").agg(F.min(F.struct("doc", "t", "places")).alias("f"), F.count("*").alias("n"), F.max("open").alias("o")).where("n > 1 and o")
    first = keep(first.select("key", F.col("f.doc").alias("src"), F.col("f.t").alias("u"), F.col("f.places").alias("splaces")), "first-tuples")
    tied = tuples.where("open").join(first, "key").where("doc <> src or t <> u or places <> splaces")
    place = lambda t, c: F.shiftleft(F.col(t), 32) + F.col(c)
    tied = tied.select("doc", "t", "src", "u", F.explode(F.arrays_zip("places", "splaces")).alias("p")).select("doc", "t", "src", "u", "p.*").distinct()
    tied = keep(tied.select("doc", place("t", "places").alias("at"), "src", place("u", "splaces").alias("sat")), "met-tuples")
    drop(tuples)
    drop(first)
    good = good.unionByName(_found(src, tied, "tuple-"))
    drop(tied)

    # Windows that may recur and that no exact run covers: the first occurrence of a window is always one.
    half, low = F.shiftright("at", 32).alias("t"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    here = F.expr(f"not ({ELSEWHERE})").alias("here")
    recur = met.select("doc", half, F.struct(low.alias("pos"), here).alias("s")).groupBy("doc", "t").agg(F.collect_list("s").alias("seeds"))  # no more than its text's words
    equal = good.where("same = 0 or (same = x1 - x0 and same = y1 - y0)").select("doc", "t", "x0", "x1").distinct()
    equal = equal.groupBy("doc", "t").agg(F.collect_list(F.struct("x0", "x1")).alias("spans"))  # starts and ends are places of its text
    left = src.join(recur, ["doc", "t"]).join(equal, ["doc", "t"], "left").select("doc", "t", "text", "seeds", F.coalesce("spans", none).alias("spans"))
    windows = keep(left.mapInArrow(_windows, "doc long, at long, seed long, own boolean"), "open-windows")
    drop(met)
    others = windows.where("not own").drop("own")
    met = _met(others.unionByName(sift(windows.where("own").drop("own"), others, "seed")), "windows")
    drop(windows)
    good = good.unionByName(_found(src, met.where(ELSEWHERE), "window-", LEAST_WORDS + 1)).where("same > 0")
    drop(met)
    id_of = lambda c, name: F.when(F.col(c) < LAST, F.col(c)).alias(name)
    out = good.select(id_of("doc", "doc_id"), F.col("x0").alias("start"), F.col("x1").alias("end"), id_of("src", "src_id"), F.col("y0").alias("src_start"), F.col("y1").alias("src_end"), "same")
    return out.distinct()
