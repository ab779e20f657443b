from collections import Counter

import corpus_pipeline as P
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_ngram_join import brute as near_brute


def test_stages_follow_their_operators(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    steps, df = [docs], docs
    for name, stage in P.STAGES:
        df = stage(spark, df, d)
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(df)
    assert all(x.columns == docs.columns for x in steps[:-1])
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in steps[:-1]]
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert sum(labels.get(i) == 1 for i in gone) == 0 and all(i in gone for i, q in labels.items() if q == 0)
    assert Counter(i for i, _ in rows[2]) == Counter(x[0] for x in exact_brute(rows[1]) if x[3])
    assert Counter(i for i, _ in rows[3]) == Counter(i for i, _, c in near_brute(rows[2]) if i == c)
    assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 2
    assert Counter(r.doc_id for r in steps[5].where("piece = 0").collect()) == Counter(i for i, _ in rows[4])


def test_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    t = "some words that are long enough to be a shingle of five"
    more = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, None, None, None), (None, t, "en", "a", 1), (None, t + " x", "en", "a", 1), (2, t, "en", "b", 1), (2, t, "en", "b", 1), (3, "", "", "", 0), (4, "w " * 30_000, "en", "a", 9), (5, more, "en", "a", 1), (6, more + " x", "en", None, 1), (6, more + " x", "en", None, 1), (7, t.replace(" ", "\n"), "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    alone = {name: Counter(r.doc_id for r in stage(spark, docs, d).collect()) for name, stage in P.STAGES}
    assert alone["quality_classifier"][2] in (0, 2) and alone["quality_classifier"][6] in (0, 2)
    # Equal without white space: 2, 2, 7 and a null id; nothing and nothing; the two of 6.
    assert alone["exact_dedup"] == {2: 1, None: 1, 1: 1, 4: 1, 5: 1, 6: 1}
    # Nothing is a copy of nothing; t's copies and, within 80 %, t + " x"; 5 and 6.
    assert alone["ngram_jaccard_join"] == {1: 1, 3: 1, 2: 1, 4: 1, 5: 1}
    assert alone["source_mixing"][1] == alone["source_mixing"][3] == 1 and max(alone["source_mixing"].values()) <= 4
    assert alone["best_fit_packing"][4] > 1 and alone["best_fit_packing"][6] == 2
    for _, stage in P.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() > 0
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, d)
    assert empty.count() == 0


def test_extra_columns_with_names_of_the_operators_own(spark):
    """Columns named like those that operators make are carried along and change nothing."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 120")
    names = ["_t", "_d", "_c0", "_n", "_r", "_h", "_x", "_sum", "_chunk", "tkey", "kept", "n", "p", "h", "y", "at", "uid", "fp", "size", "prefix", "token", "comp", "copies", "evidence", "host", "path", "slot", "before", "piece", "length", "taken", "target", "row", "id", "x", "part"]
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in P.STAGES:
        plain, more = stage(spark, docs, d), stage(spark, wide, d)
        key = ["doc_id", "piece", "start", "length", "ids_crc32"] if name == "best_fit_packing" else docs.columns
        assert Counter(tuple(r) for r in plain.select(key).collect()) == Counter(tuple(r) for r in more.select(key).collect()), name
        if name != "best_fit_packing":
            assert more.columns == wide.columns, name
            assert all(r[c] == f"{c}:{r.doc_id}" for r in more.select("doc_id", *names).collect() for c in names), name
