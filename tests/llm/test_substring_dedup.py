import random

import numpy as np

from arborlake.llm import substring_dedup as S


def test_winnowing_guarantee():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 60, (2, 300)).astype(np.uint64)
    b[100 : 100 + S.WINDOW] = a[40 : 40 + S.WINDOW]
    assert {int(a[i]) for i in S.winnow(a)} & {int(b[i]) for i in S.winnow(b)}
    assert list(S.winnow(np.array([3, 1, 2], np.uint64))) == [1] and not len(S.winnow(np.zeros(0, np.uint64)))


def brute_chain(x, y, k):
    """The best score of any chain, by all predecessors."""
    p = sorted(set(zip(x, y, strict=True)))
    best = []
    for i, (a, b) in enumerate(p):
        # As by the tree: the predecessor of the best score after its gap.
        gain, lap = 0, k
        for j in range(i):
            if p[j][0] < a and p[j][1] < b:
                g = best[j] - S.GAP_COST * (a - p[j][0] + b - p[j][1])
                if g > gain:
                    gain, lap = g, min(k, a - p[j][0], b - p[j][1])
        best.append(gain + lap)
    return p[int(np.argmax(best))]


def test_chains_by_brute_force():
    r = random.Random(1)
    for _ in range(50):
        n = r.randint(2, 40)
        x, y = [r.randint(0, 60) for _ in range(n)], [r.randint(0, 60) for _ in range(n)]
        spans = S.chain(np.array(x), np.array(y))
        a, b = brute_chain(x, y, S.K)
        assert (a + S.K, b + S.K) in {(s[1], s[3]) for s in spans}
        assert all(s[0] < s[1] and s[2] < s[3] for s in spans)


def text(r, n):
    return [f"{r.choice('abcdefgh')}{r.randint(0, 10**6)}" for _ in range(n)]


def test_planted_passages(spark):
    r = random.Random(2)
    passage, other = text(r, 60), text(r, 80)
    fuzzy = passage[:25] + ["CHANGED"] + passage[26:40] + ["added"] + passage[40:]
    rows = [(i, " ".join(text(r, 200))) for i in range(30)]
    put = lambda p: " ".join(text(r, 90) + p + text(r, 70))
    rows += [(40, put(passage)), (41, put(passage)), (42, put([w.upper() for w in passage])), (43, put(fuzzy)), (44, put(other[:49])), (45, put(other[:49]))]
    whole = " ".join(text(r, 120))
    rows += [(50, whole), (51, whole), (52, whole), (52, whole), (53, None), (54, ""), (None, put(passage)), (60, " ".join(other + text(r, 60) + other)), (55, "w " * 5000), (56, " ".join(text(r, 30_000))), (57, "short text")]
    rows += [(70, put(passage)), (70, put(other + passage))]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, t int, src int")
    got = S.passages(df).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert {41, 42, 43, 51, 52, 60, 70, None} <= set(by) and not set(by) & {*range(30), 40, 44, 45, 50, 53, 54, 56, 57}
    for i in (41, 42):
        assert any((x.start, x.end, x.src_id, x.src_start, x.src_end, x.same) == (90, 150, 40, 90, 150, 60) for x in by[i])
    assert any(x.src_id == 40 and x.start == 90 and x.end == 151 and x.same == 59 for x in by[43])
    assert any(x.src_id == 50 and (x.start, x.end, x.same) == (0, 120, 120) for x in by[52])
    assert any(x.src_id == 60 and x.src_start == 0 and x.start == 140 and x.same == 80 for x in by[60])
    assert S.passages(df.limit(0)).count() == 0


def test_real_rows_hold_all_common_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    got, covered = S.passages(docs).collect(), {}
    for x in got:
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
        a, b = texts[x.doc_id][x.start : x.end], texts[x.src_id][x.src_start : x.src_end]
        assert min(len(a), len(b)) > 50 and x.same <= min(len(a), len(b)) and (x.src_id, x.src_start) < (x.doc_id, x.start)
    first = {}
    for d in sorted(texts):
        w = texts[d]
        runs = [tuple(w[i : i + 51]) for i in range(len(w) - 50)]
        hit = [i for i, t in enumerate(runs) if t in first]
        assert not hit or d in covered, d
        for t in runs:
            first.setdefault(t, d)


def test_insertions_between_shared_runs(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i, n in enumerate(range(9, 31)):
        a, b = text(r, 60), text(r, 60)
        x, y = a + b, a + text(r, n) + b
        if i % 2:
            x, y = y, x
        rows += [(2 * i, " ".join(text(r, 30) + x + text(r, 30))), (2 * i + 1, " ".join(text(r, 30) + y + text(r, 30)))]
        second = 30 + len(y) - 60
        want[2 * i + 1] = {*range(30, 90), *range(second, second + 60)}
    got = S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {}
    for x in got:
        assert x.src_id == x.doc_id - 1 and x.same in (60, 120)  # one row of both runs, or one of each
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    assert set(covered) == set(want) and all(want[d] <= covered[d] for d in want)


def test_longest_parts_by_brute_force():
    r = random.Random(6)
    for _ in range(200):
        blocks, x, y = [], 0, 0
        for _ in range(r.randint(1, 12)):
            n = r.randint(1, 30)
            blocks.append((x, y, n))
            x, y = x + n + r.randint(0, 12), y + n + r.randint(0, 12)
        ok = []
        for s in range(len(blocks)):
            for e in range(s, len(blocks)):
                (x0, y0, _), (x1, y1, n) = blocks[s], blocks[e]
                same, u, v = sum(b[2] for b in blocks[s : e + 1]), x1 + n - x0, y1 + n - y0
                if 10 * same >= 8 * max(u, v):
                    ok.append((s, e, (x0, x0 + u, y0, y0 + v, same), min(u, v)))
        want = [w for s, e, w, least in ok if least > 50 and not any(t <= s and e <= f and (s, e) != (t, f) for t, f, *_ in ok)]
        assert S.longest(blocks) == want


def test_passages_whose_parts_occur_alone_before(spark):
    r = random.Random(7)
    rows, want = [], set()
    for i in range(40):
        # Pieces of one passage, each of at most 50 words, alone in earlier texts; all that overlap, in half of the cases.
        whole = text(r, 80)
        pieces = [whole[:40], whole[40:]] if i % 2 else [whole[a : a + 45] for a in range(0, 40, 5)]
        n = 100 * i
        rows += [(n + k, " ".join(text(r, 30) + p + text(r, 30))) for k, p in enumerate(pieces)]
        rows += [(n + 50, " ".join(text(r, 20) + whole + text(r, 25))), (n + 60, " ".join(text(r, 35) + whole + text(r, 10)))]
        want.add((n + 60, 35, 115, n + 50, 20, 100, 80))
    rows += [(None, "all the same " * 400), (9000, "all the same " * 500)]
    got = {tuple(x) for x in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and {x[0] for x in got} == {x[0] for x in want} | {None, 9000}


def test_exact_runs_join_blocks_that_touch():
    assert S.exact_runs([(0, 5, 30), (30, 35, 25), (60, 65, 10), (80, 75, 51), (131, 127, 60)]) == [(0, 5, 55), (80, 75, 51), (131, 127, 60)]
    assert S.exact_runs([]) == [] and S.exact_runs([(0, 0, 50)]) == []


def test_every_word_of_common_runs_is_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    covered = {}
    for x in S.passages(docs).collect():
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    first, n = {}, 0
    for d in sorted(texts):
        w = texts[d]
        runs = [tuple(w[i : i + 51]) for i in range(len(w) - 50)]
        for i, t in enumerate(runs):
            if t in first:
                assert set(range(i, i + 51)) <= covered[d], (d, i)
                n += 1
        for t in runs:
            first.setdefault(t, d)
    assert n > 1000


def test_fuzzy_recall(spark):
    """Passages of which every n-th word differs, and ones whose halves occur alone before: the share that is found."""
    r = random.Random(3)
    rows, pairs = [], {}
    for size, least in ((120, 0.5), (300, 0.9)):
        for n in range(5, 13):
            for _ in range(20):
                p, i = text(r, size), len(rows)
                q = [f"other{r.random()}" if k % n == n - 1 else w for k, w in enumerate(p)]
                rows += [(i, " ".join(text(r, 40) + p + text(r, 40))), (i + 1, " ".join(text(r, 30) + q + text(r, 50)))]
                pairs[i + 1] = (size, n, least, i)
    for _ in range(20):
        p, i = text(r, 100), len(rows)
        q = list(p)
        for k in r.sample(range(100), 3):
            q[k] = f"other{r.random()}"
        rows += [(i, " ".join(text(r, 30) + p[:48])), (i + 1, " ".join(text(r, 20) + p[52:] + text(r, 9))), (i + 2, " ".join(text(r, 20) + p + text(r, 30))), (i + 3, " ".join(text(r, 20) + q + text(r, 30)))]
        pairs[i + 3] = ("halves", 0, 0.8, i + 2)
    got = S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.src_id) for x in got}
    kinds = {}
    for d, (size, n, least, src) in pairs.items():
        kinds.setdefault((size, n, least), []).append((d, src) in found)
    for (size, n, least), hits in kinds.items():
        assert sum(hits) >= least * len(hits), (size, n, sum(hits))
    assert all(10 * x.same >= 8 * max(x.end - x.start, x.src_end - x.src_start) for x in got)


def test_fuzzy_passages_whose_parts_occur_apart_before(spark):
    """Parts of a passage with changed words all occur alone in earlier texts, so that no seed's first occurrence has the passage."""
    r, rows, pairs = random.Random(8), [], []
    for i in range(0, 400, 10):
        p = text(r, 120)
        q = list(p)
        for k in (30, 60, 90):
            q[k] = f"other{r.random()}"
        for j in range(5):  # parts of 40 words that overlap by 20
            rows.append((i + j, " ".join(text(r, 30) + p[20 * j : 20 * j + 40] + text(r, 9))))
        rows += [(i + 6, " ".join(text(r, 20) + p + text(r, 30))), (i + 7, " ".join(text(r, 20) + q + text(r, 30)))]
        pairs.append((i + 7, i + 6))
    got = S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.src_id) for x in got}
    assert [p for p in pairs if p not in found] == []
    assert all(10 * x.same >= 8 * max(x.end - x.start, x.src_end - x.src_start) for x in got)


def test_tuples_of_seeds_by_brute_force():
    import pyarrow as pa

    r = random.Random(9)
    rows = []
    for d in range(40):
        pos = sorted(r.sample(range(300), r.randrange(2, 30)))
        rows.append({"doc": d, "t": 1, "seeds": r.sample(s := [{"pos": p, "src": r.randrange(3), "sat": (1 << 32) + r.randrange(300)} for p in pos], len(s)), "spans": [{"x0": (x := r.randrange(300)), "x1": x + 80} for _ in range(r.randrange(3))]})
    kind = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("seeds", pa.list_(pa.struct([(c, pa.int64()) for c in ("pos", "src", "sat")]))), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("x0", "x1")])))])
    batch = pa.RecordBatch.from_pylist(rows, kind)
    got = [x for cut in (batch[:15], batch[15:]) for b in S._tuples([cut]) for x in b.to_pylist()]
    want = []
    for row in rows:
        seeds = sorted(row["seeds"], key=lambda s: s["pos"])
        runs = [seeds[i : i + n] for n in range(2, S.MOST_TUPLE + 1) for i in range(len(seeds) - n + 1)]
        runs += [[seeds[i], seeds[i + n]] for n in range(2, S.MOST_SKIPPED + 2) for i in range(len(seeds) - n)]
        for part in runs:
            last = seeds[seeds.index(part[-1]) - 1]["pos"]
            near = all(b["pos"] - a["pos"] <= S.MOST_GAP for a, b in zip(part, part[1:], strict=False))
            ordered = all(a["src"] == b["src"] and 0 < b["sat"] - a["sat"] <= S.MOST_GAP for a, b in zip(part, part[1:], strict=False))
            if near and not ordered and last - part[0]["pos"] < S.LEAST_WORDS:
                held = any(s["x0"] <= part[0]["pos"] and part[-1]["pos"] + S.K <= s["x1"] for s in row["spans"])
                want.append((row["doc"], not held, [s["pos"] for s in part]))
    assert sorted((x["doc"], x["open"], x["places"]) for x in got) == sorted(want)
