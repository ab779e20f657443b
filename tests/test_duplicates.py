"""Blocks that are alike, against all pairs."""

import random
import time

from pyspark.sql import functions as F

from arborlake.operators import duplicates as U
from arborlake.operators import lines as L
from arborlake.sources.catalog import table

DIR = "/root/testdata/sf0.001"


def sets_of(text):
    words = " ".join(text.lower().split()).split(" ")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(blocks, min_lines=5, similarity=0.8):
    """(doc, first line) -> the occurrences of its group, by all pairs of different texts."""
    kept = [b for b in blocks if b[2] - b[1] + 1 >= min_lines]
    shapes = sorted({" ".join(b[3].lower().split()) for b in kept})
    sets = [sets_of(s) for s in shapes]
    top = list(range(len(shapes)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = 0
    for i in range(len(shapes)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                links += 1
                top[find(i)] = find(j)
    groups = {}
    for b in kept:
        groups.setdefault(find(shapes.index(" ".join(b[3].lower().split()))), []).append(b[:3])
    return {frozenset(g) for g in groups.values() if len(g) > 1}, links


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.group, []).append(r)
    for g in groups.values():
        assert {r.occurrences for r in g} == {len(g)}
    return {frozenset((r.doc_id, r.line_start, r.line_end) for r in g) for g in groups.values()}, groups


def block(rng, lines=10):
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota"]) for _ in range(8)) for _ in range(lines)]


def test_one_word_in_ten_lines(spark):
    rng = random.Random(1)
    a = block(rng)
    b = [*a[:4], a[4].replace(a[4].split()[3], "OTHER", 1), *a[5:]]
    rows = [(1, 1, 10, "\n".join(a)), (2, 11, 20, "\n".join(b)), (3, 1, 10, "\n".join(block(rng))), (4, 5, 14, "  ".join(x.upper() for x in a)), (5, 1, 4, "\n".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string")
    groups, rows_of = found(U.structural_duplicates(df))
    assert groups == {frozenset({(1, 1, 10), (2, 11, 20), (4, 5, 14)})} == brute(rows)[0]
    (g,) = rows_of.values()
    assert g[0].shapes == 2 and 0.8 <= g[0].similarity < 1
    assert found(U.structural_duplicates(df, similarity=0.99))[0] == {frozenset({(1, 1, 10), (4, 5, 14)})}


def test_large_buckets_of_unlike_shapes(spark):
    """A template whose copies share 4 lines of 10 fills buckets that no leader empties; groups inside are found all the same."""
    rng = random.Random(2)
    head, rows = block(rng, 5), []
    for k in range(120):
        tail = block(rng, 3)
        for j in range(3):
            body = [*head, *tail]
            body[5] = body[5].rsplit(" ", 1)[0] + f" v{j}"
            rows.append((3 * k + j, 1, 8, "\n".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string")
    got, (want, links) = found(U.structural_duplicates(df))[0], brute(rows)
    assert links >= 360
    pairs = lambda groups: {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a < b}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.95 * len(pairs(want))


def test_whole_table(spark):
    lines = L.line_nodes(table(spark, DIR, "documents"))
    blocks = L.paragraphs(lines).unionByName(L.paragraphs(lines.withColumn("content", F.when(F.col("line") % 7 == 0, "\n").otherwise(F.col("content")))))
    rows = [(r.doc_id, r.line_start, r.line_end, r.text) for r in blocks.collect()]
    df = spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string")
    assert found(U.structural_duplicates(df))[0] == brute(rows)[0]


def test_odd_tables(spark):
    kind = "doc_id long, line_start int, line_end int, text string"
    assert U.structural_duplicates(spark.createDataFrame([], kind)).collect() == []
    one = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 5, "a"), (2, 1, 5, None), (3, 1, 5, "")], kind)
    assert found(U.structural_duplicates(one))[0] == {frozenset({(1, 1, 5)})}


def test_groups_along_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(0, 100)] + [("x", "y")], "a string, b string")
    got = {r.node: r.group for r in U.linked_groups(links).collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 103


def test_paragraphs_of_texts_are_those_of_lines(spark):
    """blocks are read off the texts, with the lines that rows of lines would give."""
    texts = ["a\nb\n\nc", "", None, "\n\n", " \n  a\r\n b\r\r\n\nc d\n   ", "a", "\ta\n\t\n x \n", "   ", "a\n \nb\n ", "é f\r\n\r\n\xa0\n", "x\x00\n\n\ny\n" * 3, "\ra\r\rb\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = L.text_paragraphs(df), L.paragraphs(L.line_nodes(df))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_a_long_block_is_split_once(spark):
    """shingles of a block of 120,000 words do not split it 120,000 times."""
    rng = random.Random(3)
    words = [str(rng.randrange(50_000)) for _ in range(120_000)]
    other = [w if i % 500 else "x" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, 1, 9, " ".join(words)), (2, 1, 9, " ".join(other)), (3, 1, 9, " ".join(words[::-1]))], "doc_id long, line_start int, line_end int, text string")
    began = time.monotonic()
    groups, rows = found(U.structural_duplicates(df))
    assert groups == {frozenset({(1, 1, 9), (2, 1, 9)})} and time.monotonic() - began < 150
    a, b = sets_of(" ".join(words)), sets_of(" ".join(other))
    assert next(iter(rows.values()))[0].similarity == len(a & b) / len(a | b)
