import random

import pytest

from arborlake.operators import folds
from arborlake.sources.markdown import sections


def test_offsets(spark):
    anchors = spark.createDataFrame([(1, "a", 10, 5), (2, "b", 10, 5), (3, "c", 10, 5), (4, "d", 10, 5), (5, "e", 10, 5)], "doc_id long, anchor_id string, start long, length long")
    edits = spark.createDataFrame([(1, 1, 0, 10, 12), (2, 1, 15, 20, 0), (3, 1, 11, 13, 5), (4, 1, 8, 12, 0)], "doc_id long, seq int, start long, end long, new_length long")
    got = {r.anchor_id: (r.start, r.length, r.is_exact) for r in folds.replay_offsets(anchors, edits).collect()}
    assert got == {"a": (12, 5, True), "b": (10, 5, True), "c": (10, 8, True), "d": (8, 1, False), "e": (10, 5, True)}


def test_undo(spark):
    rows = [(1, i, c) for i, c in enumerate(["record", "record", "undo", "redo", "redo", "undo", "undo", "undo", "record"])]
    got = folds.undo_cursor(spark.createDataFrame(rows, "session_id long, seq int, command string")).first()
    assert (got.length, got.at, got.can_undo, got.can_redo) == (1, 1, True, False)


def cursor(commands):
    length = at = 0
    for c in commands:
        length, at = {"record": (at + 1, at + 1), "undo": (length, max(at - 1, 0)), "redo": (length, min(at + 1, length))}.get(c, (length, at))
    return length, at


def test_summaries_hold_for_any_beginning():
    rng = random.Random(6)
    for _ in range(300):
        weights = rng.choice([(1, 5, 5, 1), (0, 1, 1, 0), (3, 1, 1, 0), (0, 5, 1, 0), (1, 30, 30, 0)])
        codes = rng.choices(range(4), weights, k=rng.randint(1, 60))
        s = folds._summary(codes)
        for length in (0, 1, 2, 3, 7, 20, 61, 62, 63, 500):
            for at in {0, length // 2, length}:
                want = length, at
                for c in codes:
                    want = tuple(int(x) for x in folds._moved(want[1], want[0], c))
                assert folds._applied(s, length, at) == want


@pytest.mark.parametrize("chunk", [3, 4096])
def test_sessions_over_many_tasks(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    monkeypatch.setattr(folds, "CHUNK", chunk)
    rows = [(s, i, rng.choice(["record", "undo", "undo", "redo", "other", None])) for s in [None, *range(40)] for i in range(rng.choice([1, 5, 300]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id long, seq int, command string")
    want = {}
    for s, i, c in sorted(rows, key=lambda r: r[1]):
        want.setdefault(s, []).append(c)
    got = {r.session_id: (r.length, r.at) for r in folds.undo_cursor(df).collect()}
    assert got == {s: cursor(c) for s, c in want.items()}


def test_one_session_of_a_million_commands(spark):
    df = spark.range(1_000_000).selectExpr("7L session_id", "id seq", "case pmod(xxhash64(id), 5) when 0 then 'record' when 1 then 'undo' when 2 then 'undo' when 3 then 'redo' else 'record' end command")
    commands = [r.command for r in df.orderBy("seq").select("command").toLocalIterator(True)]
    got = folds.undo_cursor(df).collect()
    assert [(r.length, r.at) for r in got] == [cursor(commands)]


def test_anchors_over_many_tasks(spark, monkeypatch):
    rng = random.Random(3)
    anchors = [(d, f"a{i}", rng.randint(0, 200), rng.randint(0, 30)) for d in (1, 2, None) for i in range(200)]
    edits = [(d, k, a, a + rng.randint(0, 20), rng.randint(0, 20)) for d in (1, None, 9) for k, a in enumerate(rng.choices(range(200), k=40))]
    kinds = "doc_id long, anchor_id string, start long, length long", "doc_id long, seq int, start long, end long, new_length long"
    a, e = spark.createDataFrame(anchors, kinds[0]), spark.createDataFrame(edits, kinds[1])
    monkeypatch.setattr(folds, "CHUNK", 16)
    got = {(r.doc_id, r.anchor_id): (r.start, r.length, r.is_exact) for r in folds.replay_offsets(a.where("doc_id is not null"), e).collect()}
    for d, name, s, n in anchors:
        exact = True
        for _, _, start, end, size in sorted(x for x in edits if x[0] == d and d is not None):
            delta = size - (end - start)
            if end <= s:
                s += delta
            elif start >= s + n:
                pass
            elif start >= s and end <= s + n:
                n += delta
            else:
                s, n, exact = min(s, start), max(n + delta, 0), False
        if d is not None:
            assert got[d, name] == (s, n, exact)
    assert len(got) == 400


def test_short_ids_of_a_large_document(spark):
    n = 100_000
    incoming = spark.range(n).selectExpr("1L doc_id", "id seq", "concat('n', id) node_id", "case when id % 3 = 0 then null when id % 3 = 1 then pmod(xxhash64(id), 150000) else id end candidate")
    taken = spark.createDataFrame([(1, [5, 9], 10)], "doc_id long, used array<bigint>, next_short_id long")
    used, next_, want = {5, 9}, 10, {}
    for r in incoming.orderBy("seq").collect():
        got = r.candidate if r.candidate and r.candidate > 0 and r.candidate not in used else next_
        used.add(got)
        next_ = max(next_, got + 1)
        want[r.node_id] = got
    assert {r.node_id: r.short_id for r in folds.merge_short_ids(incoming, taken).collect()} == want
    assert len(set(want.values())) == n


def test_markdown(spark):
    text = "# Notes\none\n### Deep\ntwo\n```\n# not a heading\n```\n## Mid #\nthree\n# Next"
    got = sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [(r.title, r.level, r.parent_line) for r in got] == [("Notes", 1, None), ("Deep", 3, 1), ("Mid", 2, 1), ("Next", 1, None)]
    assert got[1].body == "two\n```\n# not a heading\n```" and got[2].slug == "mid"
