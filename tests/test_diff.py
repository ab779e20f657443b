"""Ordered line differences."""

import difflib
import random

from arborlake.functions.settle import settle
from arborlake.operators import diff as D


def tables(spark, pairs):
    a = spark.createDataFrame([(i, "\n".join(x)) for i, (x, _) in enumerate(pairs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, "\n".join(y)) for i, (_, y) in enumerate(pairs)], "doc_id long, text string")
    return a, b


def edited(rng, lines, fresh):
    """Some lines replaced, removed, added and moved."""
    out = list(lines)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out) + 1)
        what = rng.choice("radm")
        if what == "a":
            out[at:at] = [fresh() for _ in range(rng.randint(1, 3))]
        elif out and what == "d":
            del out[at : at + rng.randint(1, 3)]
        elif out and what == "r":
            out[min(at, len(out) - 1)] = fresh()
        elif out:
            out.insert(rng.randrange(len(out)), out.pop(min(at, len(out) - 1)))
    return out or ["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_a_moved_line_is_a_change(spark):
    got = {tuple(r) for r in D.line_diff(*tables(spark, [(["a", "b", "c"], ["c", "a", "b"])])).collect()}
    assert got == {(0, "added", 1, "c"), (0, "removed", 3, "c")}


def test_random_edits(spark):
    rng = random.Random(4)
    pairs = []
    for k in range(150):
        names = iter(range(10_000))
        fresh = (lambda: f"n{next(names)}") if k % 3 else (lambda: rng.choice("pqrst"))
        a = [fresh() for _ in range(rng.randint(1, 30))]
        if k % 3 == 2:  # blank lines between
            a = [x for y in a for x in (y, "")]
        pairs.append(tuple("\n".join(x).rstrip("\n").split("\n") for x in (a, edited(rng, a, fresh))))  # a last empty one is no line
    rows = {}
    for r in D.align(*tables(spark, pairs)).collect():
        rows.setdefault(r.doc_id, {})[r.side, r.line] = (r.content, r.met)
    short = 0
    for i, (a, b) in enumerate(pairs):
        if a == b:
            assert i not in rows
            continue
        mine = rows[i]
        assert {k[1]: v[0] for k, v in mine.items() if k[0] == 0} == dict(enumerate(a, 1)) and {k[1]: v[0] for k, v in mine.items() if k[0] == 1} == dict(enumerate(b, 1))
        met = sorted((k[1], v[1]) for k, v in mine.items() if k[0] == 0 and v[1])
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(met, met[1:])), "partners cross"
        assert all(a[x - 1] == b[y - 1] and mine[1, y][1] == x for x, y in met)
        best = lcs(a, b)
        assert len(met) <= best
        short += best - len(met)
        if i % 3 == 1:  # lines of their own: the longest that there is
            ours = {(a[x - 1],) for x, _ in met}
            assert len(met) == best and len(ours) == best
        # Nothing more could be met: no stretch between partners has a line in common.
        ends = [(0, 0), *met, (len(a) + 1, len(b) + 1)]
        for (x, y), (u, v) in zip(ends, ends[1:]):
            assert not set(a[x : u - 1]) & set(b[y : v - 1])
    assert short <= 0.05 * sum(len(a) for a, _ in pairs)


def test_unified_is_the_common_form(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(60):
        a = [f"line {i}" for i in range(rng.randint(1, 40))]
        names = iter(range(10_000))
        b = list(a)
        for _ in range(rng.randint(1, 4)):  # replaced, removed and added lines, none moved: alignments are unique
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1, 2])] = [f"new {next(names)}" for _ in range(rng.choice([0, 1, 2]))]
            b = b or ["z"]
        pairs.append((a, b))
    pairs += [([""], ["a", "b"]), (["a"], ["b"])]
    for context in (3, 0, 1):
        got = {r.doc_id: r.diff for r in D.unified(*tables(spark, pairs), context=context).collect()}
        for i, (a, b) in enumerate(pairs):
            a = [] if a == [""] else a  # an empty text has no line
            want = "".join(difflib.unified_diff([x + "\n" for x in a], [x + "\n" for x in b], "before", "after", n=context))
            assert got.get(i, "") == want


def test_documents_of_one_version_and_line_ends(spark):
    a = spark.createDataFrame([(1, "x\r\ny"), (2, None), (3, "same"), (5, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x\ny\n"), (2, "new"), (4, "only"), (5, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in D.line_diff(a, b).collect())
    assert got == [(2, "added", 1, "new"), (3, "removed", 1, "same"), (4, "added", 1, "only")]
    assert D.line_diff(a.where("false"), b.where("false")).collect() == []


def test_rounds_hold_no_texts_and_fewer_lines(spark, monkeypatch):
    """The lines themselves are written once; rounds go over digests of lines that may still find a partner."""
    tables = []

    def settle(df, real=D.settle):
        tables.append((df.columns, (out := real(df)).count()))
        return out

    monkeypatch.setattr(D, "settle", settle)
    a = [f"line {i}" for i in range(40)] + ["same", "x", "same", "y"] * 5
    b = a[1:] + a[:1]
    of = lambda x: spark.createDataFrame([(1, "\n".join(x))], "doc_id int, text string")
    got = {(r.side, r.line, r.met) for r in D.align(of(a), of(b)).collect()}
    assert got == {(0, 1, None), (1, len(a), None)} | {(0, i + 1, i) for i in range(1, len(a))} | {(1, i, i + 1) for i in range(1, len(a))}
    assert sum("content" in c for c, _ in tables) == 1
    left = [n for c, n in tables if "h" in c]
    assert left[0] > 40 and max(left[1:]) <= 40


def test_partners_are_not_broadcast(spark, monkeypatch):
    """partners fill few bytes of a file and many of the driver's memory."""
    plans = []
    monkeypatch.setattr(D, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    a, b = "a\nb\nc\nd\ne\nf", "b\nc\na\ne\nd\nf\na"
    df = spark.createDataFrame([(1, a, b), (2, "x", "x"), (3, "x\ny", "y")], "doc_id long, a string, b string")
    rows = D.align(df.selectExpr("doc_id", "a text"), df.selectExpr("doc_id", "b text"))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 5 and not [p for p in plans if "Broadcast" in p]
    got = {(r.doc_id, r.side, r.line): (r.content, r.met) for r in rows.collect()}
    assert len(got) == 16 and all(m is None or got[d, 1 - s, m] == (c, n) for (d, s, n), (c, m) in got.items())
    assert [n for (d, s, n), (_, m) in sorted(got.items()) if d == 1 and s == 0 and m is None] and got[3, 0, 2] == ("y", 1)
