import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from arborlake.llm.langid import LENGTHS, Words, identify, language_id, sample, train

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word, n):
    """Character n-grams of the word between marks of its ends."""
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Brute:
    """The same model by dictionaries of strings."""

    def __init__(self, rows):
        seen = {n: {} for n in (0, *LENGTHS)}
        self.langs = sorted({x for t, x in rows if x is not None and t is not None and WORD.search(t.lower())})
        for t, x in rows:
            for w in WORD.findall((t or "").lower()) if x is not None else ():
                for n in seen:
                    for g in grams(w, n) if n else [w]:
                        seen[n].setdefault(g, Counter())[x] += 1
        seen[0] = {w: c for w, c in seen[0].items() if c.total() >= 3}
        self.logs = {}
        for n, table in seen.items():
            sums = {x: sum(c[x] for c in table.values()) + 0.5 * (len(table) + 1) for x in self.langs}
            self.logs[n] = {g: [math.log((c[x] + 0.5) / sums[x]) for x in self.langs] for g, c in table.items()}
            self.floor = [math.log(0.5 / sums[x]) for x in self.langs]

    def word(self, w):
        if w in self.logs[0]:
            return self.logs[0][w]
        for n in LENGTHS:
            hits = [self.logs[n][g] for g in grams(w, n) if g in self.logs[n]]
            if hits:
                return [sum(c) / len(hits) for c in zip(*hits, strict=True)]
        return self.floor

    def predict(self, text):
        words = WORD.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        total = [sum(c) for c in zip(*map(self.word, words), strict=True)]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        return self.langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def predict(model, *texts):
    return list(zip(*model.predict(pa.array(texts, pa.string())), strict=True))


def knows(model, kind, *texts):
    words = Words(pa.array(texts))
    if kind == 0:
        return model.find(0, words.hashes)[0].tolist()
    return next(model.find(n, h)[0].tolist() for n, h, _ in words.grams(range(len(words.hashes)), (kind,)))


def test_held_out_accuracy_and_flags(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) > 0.98


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    rows = [(t, x) for t, x in docs]
    rows += [("Éa\u0301b \u0301x12y ÀÇ-ü", "fr"), ("日本語 テキスト", "ja"), ("日本語", "ja"), ("a" * 3000 + " " + "b" * 65 + " c", "x"), ("", "e"), ("12", "n")]
    brute = Brute(rows)
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == brute.langs
    assert {n: len(h) for n, h in model.hashes.items()} == {n: len(t) for n, t in brute.logs.items()}
    r = random.Random(3)
    asked = [t for t, _ in rows] + [None, "", "zzzq xxqz", "b" * 65, "b" * 66 + "qqq", "本 x", "\u0301", "Σςσ Ωmega"]
    asked += [" ".join("".join(r.choices("abcdeéèüß日", k=r.randint(1, 12))) for _ in range(8)) for _ in range(300)]
    for text, (name, score) in zip(asked, predict(model, *asked), strict=True):
        want = brute.predict(text)
        assert name == want[0] and abs(score - want[1]) < 1e-3, text


def test_backoff_by_hand(spark):
    rows = [("aa bb aa aa bb bb", "x"), ("cc cc cc dd dd dd", "y"), ("zz", None), (None, "x")]
    m = train(spark.createDataFrame(rows, "text string, lang string"))
    assert m.langs == ["x", "y"] and knows(m, 0, "aa bb cc dd") == [True] * 4 and len(m.hashes[0]) == 4
    ask = lambda t: predict(m, t)[0]
    assert ask("aa")[0] == "x" and ask("cc aa dd")[0] == "y"
    assert not knows(m, 0, "aab")[0] and ask("aab")[0] == "x"  # by its trigram <aa
    assert ask("qqd")[0] == "y"  # by d
    assert ask("qqq")[0] == "x"  # nothing known: the first
    assert ask("12 ½ !!") == ("und", 0.0) and ask(None) == ("und", 0.0) and ask("") == ("und", 0.0)


def test_odd_rows(spark):
    rows = [(1, "the and of " * 5, "en", "a"), (2, None, "en", "b"), (3, "²½ 123", None, "c"), (4, "le la les des " * 5, "fr", "d"), (None, "the of", None, "e"), (5, "x" * 300_000, None, "f"), (5, "x" * 300_000, None, "f"), (6, "word " * 200_000, "en", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    got = language_id(df).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (2, 3)} == {"und"}
    assert next(r for r in got if r.doc_id is None).held_out is False
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    assert language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(df.where("lang is null")).collect()} == {"und"}


def test_a_language_learned_from_no_letters(spark):
    df = spark.createDataFrame([(1, "12", "n"), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(df, train(df)).collect()} == {"und"}


def test_all_words_and_grams_are_kept(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    common, rare = sorted({word() for _ in range(60_000)}), sorted({word() for _ in range(300)})
    rows = [(" ".join(common[i : i + 500] * 4), "x") for i in range(0, len(common), 500)] + [(" ".join(rare * 3), "y")]
    m = train(spark.createDataFrame(rows, "text string, lang string"))
    assert all(knows(m, 0, *common, *rare)) and len(m.hashes[0]) == len({*common, *rare})
    assert all(knows(m, 4, *common, *rare)) and len(m.hashes[4]) == len({g for w in common + rare for g in grams(w, 4)})
    assert {n: x.shape for n, x in m.logs.items()} == {n: (len(h), 2) for n, h in m.hashes.items()}


def test_repeated_runs_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = train(docs)
    one, two = (sorted((r.doc_id, r.lang_pred, r.score) for r in identify(d, m).collect()) for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert one == two


def test_a_table_of_repeats_is_learned_from(spark):
    one = spark.range(60_000).selectExpr("id doc_id", "'en' lang", "'the quick brown fox jumps over the lazy dog' text")
    assert {r.lang_pred for r in language_id(one).select("lang_pred").distinct().collect()} == {"en"}
    same = spark.range(300).selectExpr("1L doc_id", "'en' lang", "'one and the same row' text")
    rare = spark.range(50).selectExpr("id doc_id", "'fr' lang", "concat('bonjour le monde ', id) text")
    assert sample(same, "lang", "text", "doc_id", 100).count() == 100
    got = sample(same.unionByName(rare), "lang", "text", "doc_id", 120)
    assert got.count() == 120
    hot = spark.range(20_000).selectExpr("id doc_id", "'en' lang", "'one common text' text").unionByName(spark.range(10_000).selectExpr("id + 50000 doc_id", "'fr' lang", "concat('mot', id) text"))
    parts = {r.lang: r["count"] for r in sample(hot, "lang", "text", "doc_id", 3000).groupBy("lang").count().collect()}
    assert sum(parts.values()) == 3000 and abs(parts["en"] - 2000) < 150
