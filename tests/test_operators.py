"""Cases that the given tables do not hold."""

from pyspark.sql import functions as F

from arborlake.functions import text as X
from arborlake.operators import folds, lines as L, tree as T
from arborlake.plans import selector as S
from arborlake.sources import jsontree as J, snapshot
from arborlake.streaming import jobs


def lines(spark, *texts, terminators="strict"):
    return L.line_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), terminators)


def test_line_ends(spark):
    texts = ["a\r\nb\rc\nd", "", "x\x0cy z\n", "\n\n", "a\r\nb\n"]
    got = L.render(lines(spark, *texts)).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in enumerate(texts) if t}
    assert lines(spark, "x\x0cy\u2028z w\n").count() == 1 and lines(spark, "x\x0cy\u2028z w\n", terminators="unicode").count() == 3
    ends = {r.doc_id: r.terminator for r in L.dominant_terminator(lines(spark, *texts)).collect()}
    assert ends == {0: "CRLF", 2: "LF", 3: "LF", 4: "CRLF"}


def test_paragraphs(spark):
    got = L.paragraphs(lines(spark, "\n\na\nb\n\n\nc")).orderBy("index").collect()
    assert [(r["index"], r.line_start, r.text) for r in got] == [(0, 3, "a\nb\n"), (1, 7, "c")]


def test_bracket_ranges(spark):
    specs = [("[12]", None, 12, 12), (" [ 7 ] ", None, 7, 7), ("[12,15]", None, 12, 15), ("[:12]", None, 1, 12), ("[11:]", 20, 11, 20), ("[1:]", 1, 1, 1)]
    bad = ["[5:]", "[9,3]", "[0]", "[-1]", "12", "[a]"]
    df = spark.createDataFrame([(s, t) for s, t, _, _ in specs] + [(b, None) for b in bad], "s string, t int")
    got = df.select("s", *L.bracket_range(F.col("s"), F.col("t"))).collect()
    assert [(r.start, r.end) for r in got[:6]] == [(a, b) for _, _, a, b in specs] and all(r.error for r in got[6:])


def test_utf8_prefix(spark):
    df = spark.createDataFrame([("aé",), ("a€b",), ("\U0001f600x",), ("",)], "t string")
    for n in range(6):
        for r in df.select("t", L.utf8_prefix(F.col("t"), n).alias("p")).collect():
            assert r.p == r.t.encode()[:n].decode(errors="ignore")


def test_pointers_and_hex(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a~b",), ("~1",)], "t string")
    assert [r[0] for r in df.select(X.escape_token(F.col("t"))).collect()] == ["a", "a~1b", "a~0b", "~01"]
    assert all(r[0] for r in df.select(X.unescape_token(X.escape_token(F.col("t"))) == F.col("t")).collect())
    p = spark.createDataFrame([("",), ("/a~1b/c",), ("a",), (None,)], "p string")
    assert [r[0] for r in p.select(X.parse_pointer(F.col("p"))).collect()] == [[], ["a/b", "c"], None, None]
    h = spark.createDataFrame([("0x1",), ("0xff",), ("0x",), ("0X1",), ("0x0",), ("-0x1",)], "h string")
    assert [r[0] for r in h.select(X.from_hex(F.col("h"))).collect()] == [1, 255, None, None, None, None]


SMALL = [("m", None, 0, "module", "M"), ("A", "m", 0, "class", "A"), ("m1", "A", 0, "method", "m1"), ("m2", "A", 1, "method", "m2"), ("B", "m", 1, "class", "B"), ("m3", "B", 0, "method", "m3"), ("f", "m3", 0, "function", "f"), ("g", "m", 2, "function", "g")]


def small(spark):
    rows = [(1, n, p, i, r, r, name) for n, p, i, r, name in SMALL]
    df = spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, child_index int, kind string, role string, name string")
    return T.with_paths(df).withColumn("fields", F.create_map(F.lit("k"), F.col("name"))).withColumn("content", F.col("name"))


def ids(df):
    return [r.node_id for r in df.orderBy("ord_path").collect()]


def test_selectors(spark):
    n = small(spark)
    assert ids(n) == ["m", "A", "m1", "m2", "B", "m3", "f", "g"]
    assert ids(S.select("class").child("method", S.first()).run(n)) == ["m1"]
    assert ids(S.select("class", S.where("name", "=", "B")).child("method", S.first()).run(n)) == []  # the document's first is not B's
    assert ids(S.select("class").descendant("function").run(n)) == ["f"]
    assert ids(S.select("method", S.nth(1)).run(n)) == ["m2"] and ids(S.select("method", S.nth(9)).run(n)) == []
    assert ids(S.select("METHOD", S.select("*", S.where("name", "^=", "m3"))).run(n)) == ["m1", "m2"]
    assert ids(S.select("Method").run(n)) == ["m1", "m2", "m3"]


def test_roles_and_names(spark):
    n = small(spark).drop("role")
    kinds = {"module": "module", "class": "class", "method": "function", "function": "function"}
    roles = lambda nearest: {r.node_id: r.role for r in T.semantic_roles(T.with_ancestors(n, "kind"), kinds, nearest).collect()}
    assert roles(True)["f"] == "function" and roles(False)["f"] == "method" and roles(True)["m1"] == "method" and roles(True)["g"] == "function"
    assert {r.node_id: r.qualname for r in T.qualified_names(small(spark)).collect()}["f"] == "B.m3.f"


def test_short_id_merge(spark):
    inc = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", None), (1, 2, "c", 6), (1, 3, "d", 2), (2, 0, "e", 1)], "doc_id long, seq long, node_id string, candidate long")
    taken = spark.createDataFrame([(1, [2], 3)], "doc_id long, used array<long>, next_short_id long")
    assert {r.node_id: r.short_id for r in folds.merge_short_ids(inc, taken).collect()} == {"a": 5, "b": 6, "c": 7, "d": 8, "e": 1}


def test_json(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b/c": [1, null, true]}, "d": "x"}'), (2, "{bad"), (3, "[]")], "doc_id long, json string")
    got = {(r.doc_id, r.pointer): (r.kind, r.scalar) for r in J.json_nodes(docs).collect()}
    assert got[1, "/a/b~1c/0"] == ("number", "1") and got[1, "/a/b~1c/1"][0] == "null" and got[1, "/d"] == ("string", "x") and got[3, ""] == ("array", None)
    assert [r.doc_id for r in J.rejected(docs).collect()] == [2]


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    snapshot.publish(df, str(tmp_path), 1)
    snapshot.publish(df.withColumn("text", F.upper("text")), str(tmp_path), 2)
    good, bad = snapshot.read(spark, str(tmp_path))
    assert {r.text for r in good.collect()} == {"A", "B"} and bad.count() == 0


def test_incremental_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a\nb"), (2, "c")], schema).write.parquet(f"{tmp_path}/in/x")
    run = lambda: jobs.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(1, "a\nb"), (2, "changed")], schema).write.parquet(f"{tmp_path}/in/y")
    run()
    got = spark.read.parquet(f"{tmp_path}/out/lines")
    assert sorted((r.batch, r.doc_id, r.content) for r in got.collect()) == [(0, 1, "a\n"), (0, 1, "b"), (0, 2, "c"), (1, 2, "changed")]
