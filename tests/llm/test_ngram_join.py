import random
import re

import pyarrow as pa

from arborlake.llm import textops
from arborlake.llm.components import components
from arborlake.llm.ngram_join import ngram_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_real_rows_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(ngram_components(docs)) == brute(rows)


def test_chains_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(900 + i, " ".join(base[:-1] + [f"x{i}"]) if i % 2 else " ".join([f"y{i}"] + base[1:])) for i in range(12)]
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE\x0btwo"), (10, "one"), (None, "One  two"), (5, None), (901, rows[1][1]), (11, "a b c d e " * 3000), (12, "A b c d e " * 2999)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n long, token string")
    assert found(ngram_components(docs)) == brute(rows)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (None, 7), (8, 8), (4, 5), (9, 3), (1, 10)], "a long, b long")
    got = {(r.node, r.component) for r in components(e, "a", "b").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (4, 4), (5, 4)}
    path = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(path, "a", "b").collect()} == {0}


def test_long_words_without_anything_in_common(spark):
    rows = [(i, " ".join("".join(random.Random(100 * i + j).choices("abcdefgh", k=1024)) for j in range(n))) for i, n in ((1, 1), (2, 1), (3, 6), (4, 6))]
    rows += [(5, "z" * 1024), (6, "y" * 1024), (7, "Z" * 1024), (8, "é" * 512), (9, "è" * 512)]
    assert found(ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_word_hashes_tell_words_apart():
    r = random.Random(4)
    words = sorted({"".join(r.choices("ab", k=r.randint(1, 90))) for _ in range(20_000)} | {c * n for c in "abcdefgh" for n in (1, 7, 8, 9, 63, 64, 65, 1024, 5000)})
    data, offsets = textops.buffers(pa.array([" ".join(words), " ".join(w.upper() for w in words)]))
    s, e, first = textops.words(data, offsets)
    h = textops.word_hashes(data, s, e)
    assert len(set(h[: first[1]].tolist())) == len(words) and (h[: first[1]] == h[first[1] :]).all()
    assert not (textops.word_hashes(data, s, e, fold=False)[first[1] :] == h[first[1] :]).any()
