import random
import re

from pyspark.sql import functions as F

from arborlake.llm.line_dedup import dedup_lines, without_lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    firsts, out = {}, {}
    lines = {i: re.split(r"\r\n|\n|\r", rows[i][1] or "") for i in order}
    for i in order:
        for s in lines[i]:
            firsts.setdefault(s, len(firsts))
    names = list(firsts)
    near = {s for s in names if s.strip(" \t\x0b\x0c") and any(max(len(s), len(t)) >= 5 and t.strip(" \t\x0b\x0c") and abs(len(s) - len(t)) < 2 and within_one(s, t) for t in names[: firsts[s]])}
    seen = set()
    for i in order:
        exact = [k for k, s in enumerate(lines[i]) if s.strip(" \t\x0b\x0c") and (s in seen or s in lines[i][:k])]
        more = [k for k, s in enumerate(lines[i]) if s in near and k not in exact]
        seen |= set(lines[i])
        out[i] = (rows[i][0], len(lines[i]), len(exact), len(more), sorted(exact + more))
    return sorted(out.values(), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_exact, r.n_near, r.dropped) for r in df.collect()), key=str)


def test_random_edits(spark):
    r = random.Random(4)
    base = ["".join(r.choice("ab ") for _ in range(r.choice([19, 20, 22, 24, 63, 64, 65, 129, 150]))) for _ in range(16)] + ["a" * 20, "a" * 21, "a" * 22, "é" * 30]

    def edit(s):
        i = r.randrange(len(s) + 1)
        return [s, s[:i] + r.choice("abc") + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice("abc") + s[i + 1 :]][r.randrange(4)]

    rows = [(i, "\n".join(edit(edit(r.choice(base))) if r.random() < 0.5 else edit(r.choice(base)) for _ in range(6))) for i in range(60)]
    rows += [(None, rows[3][1]), (500, None), (501, ""), (502, "\n \n\t\n"), (503, "short\nshort\r\nshorT\rshort"), (7, rows[7][1]), (504, "xyz" * 20_000 + "\n" + "xyz" * 9_000 + "q" + "xyz" * 11_000)]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, no int, key string")
    got, want = found(dedup_lines(df)), brute(rows)
    assert got == want and sum(x[3] for x in want) > 20


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert found(dedup_lines(docs)) == brute(rows)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_text_without_lines(spark):
    df = spark.createDataFrame([("a\nb\r\nc\rd", [1, 3]), ("x", []), ("x", [0])], "t string, d array<int>")
    assert [r[0] for r in df.select(without_lines(F.col("t"), F.col("d"))).collect()] == ["a\nc\r", "x", ""]


def test_short_lines(spark):
    r = random.Random(12)
    rows = [(i, "\n".join("".join(r.choices("abc", k=r.randint(1, 8))) for _ in range(6))) for i in range(150)]
    assert found(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    rows = [(1, "abcd\nabcf"), (2, "abcde"), (3, "abce"), (4, "Home page\nHome pages\nHome Page")]
    got = {r.doc_id: r.dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [1, 2]}
