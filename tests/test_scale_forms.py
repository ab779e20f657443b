"""Operators in forms whose cost follows their input: subtree sums by a tour, selection by rank, sweeps over lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import lines as L
from arborlake.operators import measures as M
from arborlake.operators import tree as T


def random_trees(seed, docs=5, most=60):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        paths, ids, kids = [[0]], [[]], [0]
        rows.append((d, "n0", None, 0, 0, "r", "root", [0], []))
        for i in range(1, rng.randint(1, most)):
            up = rng.randrange(len(paths)) if rng.random() < 0.6 else len(paths) - 1
            path = [*paths[up], kids[up]]
            kids[up] += 1
            paths.append(path)
            ids.append([*ids[up], f"n{up}"])
            kids.append(0)
            content = rng.choice([None, "", "é", "abc"])
            rows.append((d, f"n{i}", f"n{up}", path[-1], len(path) - 1, content, f"name{i}", path, ids[-1]))
    return rows


KIND = "doc_id long, node_id string, parent_id string, child_index int, depth int, content string, name string, ord_path array<int>, anc_ids array<string>"


def test_subtree_sums(spark):
    rows = random_trees(1)
    got = {(r.doc_id, r.node_id): (r.n_nodes, r.n_bytes, r.n_children) for r in T.subtree_sizes(spark.createDataFrame(rows, KIND)).collect()}
    for d, n, *_ in rows:
        below = [r for r in rows if r[0] == d and (r[1] == n or n in r[8])]
        assert got[d, n] == (len(below), sum(len((r[5] or "").encode()) for r in below), sum(r[2] == n for r in below))
    assert len(got) == len(rows)


def test_a_chain_of_five_thousand(spark):
    n = 5000
    chain = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), (F.col("id") - 1).cast("string"))).alias("parent_id"), F.lit("ab").alias("content"),
        F.array_repeat(F.lit(0), (F.col("id") + 1).cast("int")).alias("ord_path"), F.array().cast("array<string>").alias("anc_ids"),
    )
    sizes = T.subtree_sizes(chain)
    assert "anc_ids" not in sizes._jdf.queryExecution().optimizedPlan().toString()
    got = {r.node_id: (r.n_nodes, r.n_bytes, r.n_children) for r in sizes.collect()}
    assert got == {f"n{i}": (n - i, 2 * (n - i), int(i < n - 1)) for i in range(n)}


def outline(rows, depth, below, budget, start=None, resume=None):
    """drill_down by recursion over one document's rows in preorder."""
    rows = sorted(rows, key=lambda r: r[7])
    size = {r[1]: sum(len((x[5] or "").encode()) for x in rows if x[1] == r[1] or r[1] in x[8]) for r in rows}
    if start:
        base = next(r[4] for r in rows if r[1] == start)
        rows = [r for r in rows if r[1] == start or start in r[8]]
    else:
        base = 0
    out, stubs, used, on = [], set(), 0, resume is None
    for r in rows:
        if any(a in stubs for a in r[8]):
            continue
        stub = r[4] - base > depth and not (below and size[r[1]] <= below)
        if stub:
            stubs.add(r[1])
        on = on or r[1] == resume
        if on:
            used += len(r[6]) + (16 if stub else len(r[5] or "") + 8)
            out.append((r[1], "stub" if stub else "node", used, used <= budget))
    return out


def test_outlines_go_on_where_they_stopped(spark):
    rows = [(*r[:5], r[5] or "", *r[6:]) for r in random_trees(3)]
    nodes = spark.createDataFrame(rows, KIND)
    docs = sorted({r[0] for r in rows})
    for depth, below, budget in ((1, 4, 60), (0, 0, 200), (2, 64, 45)):
        start = {d: random.Random(d).choice([r[1] for r in rows if r[0] == d]) for d in docs}
        first = T.drill_down(nodes, depth, below, budget, spark.createDataFrame(list(start.items()), "doc_id long, node_id string"), preview_bytes=2)
        got = {d: [(r.node_id, r.record_type, r.used, r.shown) for r in sorted((r for r in first.collect() if r.doc_id == d), key=lambda r: r.used)] for d in docs}
        assert got == {d: outline([r for r in rows if r[0] == d], depth, below, budget, start[d]) for d in docs}
        assert {r.preview for r in first.collect() if r.record_type == "node"} <= {"", "é", "ab", "r"}
        left = {r.doc_id: r.next_node_id for r in T.truncation(first).collect() if r.next_node_id}
        if left:
            then = T.drill_down(nodes, depth, below, budget, spark.createDataFrame(list(start.items()), "doc_id long, node_id string"), spark.createDataFrame(list(left.items()), "doc_id long, node_id string")).collect()
            assert {d: [(r.node_id, r.record_type, r.used, r.shown) for r in sorted((r for r in then if r.doc_id == d), key=lambda r: r.used)] for d in left} == {d: outline([r for r in rows if r[0] == d], depth, below, budget, start[d], left[d]) for d in left}


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), float(rng.randint(-3, 3)), None])) for g in ["a", "b", None] for _ in range(rng.choice([1, 2, 20, 333]))] + [("one", 5.0), ("none", None)] + [("same", 7.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": ("disc", 0.0001), "p50": ("disc", 0.5), "p95": ("disc", 0.95), "p100": ("disc", 1.0), "median": ("cont", 0.5), "q1": ("cont", 0.25), "top": ("cont", 1.0)}
    got = {r.g: r for r in M.selected(df, ["g"], "v", shares).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        vs = sorted(v for x, v in rows if x == g and v is not None)
        for name, (kind, q) in shares.items():
            at = q * (len(vs) - 1)
            want = vs[max(0, math.ceil(q * len(vs) - 1e-12) - 1)] if kind == "disc" else vs[math.floor(at)] + (vs[math.ceil(at)] - vs[math.floor(at)]) * (at - math.floor(at))
            assert got[g][name] == pytest.approx(want)
    assert "none" not in got


def test_one_group_of_two_million(spark):
    df = spark.range(2_000_000).selectExpr("1 g", "pmod(xxhash64(id), 1500000) / 7 v")
    shares = {"median": ("cont", 0.5), "p95": ("disc", 0.95)}
    got = M.selected(df, ["g"], "v", shares)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    want = df.selectExpr("percentile(v, 0.5) m", "percentile_disc(0.95) within group (order by v) p").first()
    row = got.first()
    assert (row.median, row.p95) == (pytest.approx(want.m), want.p)


def random_blocks(seed, nested):
    rng = random.Random(seed)
    blocks, points, requests, hits = [], [], [], []
    for d in range(6):
        for i in range(rng.randint(0, 200)):
            a = rng.randint(1, 80)
            n = rng.choice([1, 2, 4, 16])
            a = (a - 1) // n * n + 1 if nested else a
            blocks.append((d, f"b{i}", a, a + n - 1))
        points += [(d, line) for line in rng.choices(range(1, 100), k=40)]
        for k in range(40):
            lo = rng.randint(1, 90)
            requests.append((100 * d + k, d, lo, lo + rng.choice([0, 1, 3, 15])))
        hits += [(d, line, rng.choice(["x", "needle", "y"])) for line in range(1, 100)]
    return blocks, points, requests, hits


@pytest.mark.parametrize("seed, nested", [(1, True), (2, False)])
def test_sweeps(spark, seed, nested):
    blocks, points, requests, hits = random_blocks(seed, nested)
    b = spark.createDataFrame(blocks, "doc_id long, block_id string, start_line int, end_line int")
    found = L.smallest_enclosing(spark.createDataFrame(points, "doc_id long, line int"), b)
    assert "between" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r.doc_id, r.line, r.block_id or "", r.status) for r in found.collect())

    def best(d, lo, hi, exact=False):
        inside = [(exact and not (a == lo and e == hi), e - a, a, n) for x, n, a, e in blocks if x == d and a <= lo and e >= hi]
        return min(inside, default=None)

    want = [(d, line, (best(d, line, line) or [""])[-1], "ok" if best(d, line, line) else "LINE_NOT_FOUND") for d, line in points]
    assert got == sorted(want)
    asked = spark.createDataFrame(requests, "request_id long, doc_id long, lo int, hi int")
    for exact in (True, False):
        rows = {r.request_id: (r.block_id, r.is_exact) for r in L.blocks_in_range(asked, b, exact).collect()}
        assert rows == {q: ((x[3], not x[0]) if (x := best(d, lo, hi, exact)) else (None, None)) for q, d, lo, hi in requests}
    lines = spark.createDataFrame(hits, "doc_id long, line int, content string")
    holds = [x for x in blocks if any(h[0] == x[0] and x[2] <= h[1] <= x[3] and h[2] == "needle" for h in hits)]
    want = {x for x in holds if not any(y[0] == x[0] and y[2] >= x[2] and y[3] <= x[3] and y[3] - y[2] < x[3] - x[2] for y in holds)}
    assert {tuple(r) for r in L.text_search(b, lines, "needle").collect()} == want
