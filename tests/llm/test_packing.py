import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arborlake.llm import packing
from arborlake.llm.packing import CAPACITY, grouped, optimised, pack, pack_documents, plan

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(counts, capacity=CAPACITY):
    import bisect

    rooms, n = [], 0
    for size in sorted(Counter(counts).elements(), reverse=True):
        i = bisect.bisect_left(rooms, size)
        if i == len(rooms):
            n += 1
            bisect.insort(rooms, capacity - size)
        else:
            bisect.insort(rooms, rooms.pop(i) - size)
    return n


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 1024), lambda r: r.randint(300, 700), lambda r: 341, lambda r: r.choice([1, 1024, 700])])
def test_plan_is_whole_and_near_best_fit(draw):
    r = random.Random(3)
    counts = Counter(draw(r) for _ in range(3000))
    runs, used = plan(counts), Counter()
    for lengths, times in runs:
        assert sum(lengths) <= CAPACITY
        for n in lengths:
            used[n] += times
    assert used == counts
    assert sum(x for _, x in runs) <= 1.002 * best_fit(counts)  # rounding up may cost a sequence in a thousand
    assert plan({}) == [] and plan({1024: 3}) == [([1024], 3)] and sum(x for _, x in plan({7: 1})) == 1


def test_groups_have_equal_cardinality_and_round_up():
    r = random.Random(9)
    counts = Counter(int(r.triangular(65, 1023, 200)) for _ in range(20_000))
    groups, each = grouped(counts, 64), -(-20_000 // 64)
    assert [m for g in groups for m in g] == sorted(counts.items(), reverse=True)
    sizes = [sum(c for _, c in g) for g in groups]
    assert len(groups) <= 64 and all(n >= each and n - g[-1][1] < each for n, g in zip(sizes[:-1], groups[:-1], strict=True))
    assert sum(len(g) > 1 for g in groups) > 32  # several lengths take the place of the largest
    few = sum(x for _, x in plan(counts, groups=64))
    many = sum(x for _, x in plan(counts, groups=512))
    bound = sum(n * c for n, c in counts.items()) / CAPACITY
    assert bound <= many <= few <= bound * 1.02 and many <= bound * 1.005


def test_configurations_against_brute_force():
    r = random.Random(10)
    for _ in range(40):
        sizes = sorted(r.sample(range(20, 100), 4), reverse=True)
        counts = [r.randint(1, 3) for _ in sizes]

        def least(left, seen={}):  # noqa: B006
            key = (tuple(sizes), left)
            if not any(left):
                return 0
            if key not in seen:
                first, best = next(i for i, n in enumerate(left) if n), 99
                stack = [(tuple(n - (i == first) for i, n in enumerate(left)), 100 - sizes[first])]
                done = set()
                while stack:
                    now, room = stack.pop()
                    if now in done:
                        continue
                    done.add(now)
                    grown = [(tuple(n - (i == j) for i, n in enumerate(now)), room - sizes[j]) for j in range(4) if now[j] and sizes[j] <= room]
                    stack += grown
                    if not grown:
                        best = min(best, 1 + least(now))
                seen[key] = best
            return seen[key]

        runs, used = optimised(sizes, counts, 100), Counter()
        for indices, times in runs:
            assert sum(sizes[i] for i in indices) <= 100
            for i in indices:
                used[i] += times
        assert [used[i] for i in range(4)] == counts
        assert least(tuple(counts)) <= sum(x for _, x in runs) <= least(tuple(counts)) + 1


def test_the_linear_program_finds_better_configurations(monkeypatch):
    sizes, counts = [501, 499, 334, 333, 251, 250, 249], [40, 70, 90, 35, 66, 20, 41]
    better = sum(x for _, x in optimised(sizes, counts, 1000))
    monkeypatch.setattr(packing, "COLUMNS", 0)
    assert better <= sum(x for _, x in optimised(sizes, counts, 1000)) and better >= sum(s * c for s, c in zip(sizes, counts, strict=True)) / 1000


def test_ids_are_those_of_the_tokenizers_file(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = Counter(map(tuple, packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "piece", "length", "ids_crc32").collect()))
    want = Counter()
    for d, t in docs.collect():
        a = np.array(HF.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        size, start, piece = len(a) % CAPACITY or CAPACITY, 0, 0
        while start < len(a):
            want[d, piece, size, zlib.crc32(a[start : start + size].tobytes())] += 1
            start, piece, size = start + size, piece + 1, CAPACITY
    assert got == want


def check(rows, found):
    ids = [np.array(HF.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows]
    expect = Counter()
    for (d, _), a in zip(rows, ids, strict=True):
        size, start, piece = len(a) % CAPACITY or CAPACITY, 0, 0
        while start < len(a):
            expect[d, piece, start, size, zlib.crc32(a[start : start + size].tobytes())] += 1
            start, piece, size = start + size, piece + 1, CAPACITY
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expect
    seqs = defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= CAPACITY
    assert len(seqs) <= best_fit(Counter(r.length for r in found))


def test_real_rows_and_odd_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = [(None, "x"), (1, None), (2, ""), (2, ""), (3, "a<|endoftext|>b <|endoftext|>"), (4, " \n\n\t  é  '²٠ I'll\x00"), (5, "zz" * 3000), (6, "\U0001f600 ok " * 2000)]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as length", "2 as offset")
    check(rows + odd, pack_documents(df).collect())


def test_empty_and_hot_length(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    parts = spark.range(50_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 700, id % 1000 + 1) as length")
    rows = pack(parts).collect()
    assert len(rows) == 50_000
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for s in at.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= CAPACITY
