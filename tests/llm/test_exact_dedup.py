import hashlib
import re

import duckdb

from arborlake.llm.exact_dedup import ORACLE, exact_duplicates


def brute(rows):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for i, x in enumerate(norm):
        groups.setdefault(x, []).append(i)
    out = []
    for x, g in groups.items():
        best = min(g, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        out += [(rows[i][0], rows[best][0], len(g), i == best, hashlib.sha256(x.encode()).hexdigest()) for i in g]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(spark):
    long = "abc def\n" * 700
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a\x0bb "), (None, "ab"), (7, "a b"), (8, long), (9, long.replace(" ", "")), (10, long + "x"), (11, "x" + long), (12, "\U0001f600" * 40), (13, "\U0001f600 " * 40), (None, "zz"), (None, "zz")]
    rows += [(100 + i, long[: 8 * i]) for i in range(0, 700, 97)] + [(200 + i, long[: 8 * i] + " ") for i in range(0, 700, 97)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, name long, blocks string")
    for block in (1, 16, 1024):
        assert found(exact_duplicates(df, block=block)) == brute(rows)


def test_real_rows_against_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as from '{path}'")
    assert found(exact_duplicates(df, block=64)) == sorted(con.sql(ORACLE).fetchall(), key=str)


def test_hot_group_and_empty_table(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same text ', 300), concat('t', id)) as text")
    got = {r.group_size: r["count"] for r in exact_duplicates(rows).groupBy("group_size").count().collect()}
    assert got == {2000: 2000, 1: 4000}
    assert exact_duplicates(rows.limit(0)).count() == 0
