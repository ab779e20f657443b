import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from arborlake.llm import collocations as C


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, top=C.TOP):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, 6):
                for i in range(len(p) - k + 1):
                    f[lang][tuple(p[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        inside = {(p[i:j], c) for p, c in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}
        found = []
        for p, a in often.items():
            if len(p) > 1 and (p, a) not in inside:
                score, _, le, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, r))
        for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def run(spark, rows, least, top=C.TOP):
    df = spark.createDataFrame([(i, t, x, 1) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase int")
    return sorted(tuple(r) for r in C.collocations(df, least=least, top=top).collect())


@pytest.fixture(params=[2, 5, 32])
def trigger(request, monkeypatch):
    # Workers import the module anew: the smallest texts need short chunks, so the constant goes along in the closure's module.
    monkeypatch.setattr(C, "TRIGGER", request.param)
    return request.param


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "the", "of", "x\x00y", "日本", "end"]
    shared = " ".join(rng.choice(words) for _ in range(90))
    gaps = [" ", " ", " ", "\t", "  ", ", ", "\n", ". ", ";"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "fr", None, "und"]), rng.choice([t, t + shared, shared + t, shared])))
    return out


def test_brute_force(spark):
    rows = some_texts(3) + [("en", None), (None, ""), ("de", " ,. "), ("en", "One word")]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 5, 7) == brute(rows, 5, 7)


def test_chunks_count_each_occurrence_once(trigger):
    import pyarrow as pa

    rows = some_texts(trigger, 200)
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    chunks = [pa.RecordBatch.from_arrays([b.column(c) for c in range(4)], ["lang", "chunk", "last", "n"]) for b in C._chunks(iter([batch]))]
    for size in range(1, 6):
        got = Counter()
        for b in C._counter(size, None)(iter(chunks)):
            for lang, p, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                got[lang, p] += n
        want = Counter((x or "und", " ".join(p[i : i + size])) for x, t in rows for p in pieces(t) for i in range(len(p) - size + 1))
        assert got == want


def test_whole_table(spark):
    con = duckdb.connect()
    con.sql("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    rows = con.sql("select lang, text from documents").fetchall()
    want = brute(rows, 100)
    got = C.collocations(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and want
    assert sorted(tuple(r) for r in got.collect()) == want
    rel = con.sql(C.ORACLE)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(tuple(r[i] for i in at) for r in rel.fetchall()) == want


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    rows = some_texts(9)
    monkeypatch.setattr(C, "BITS", 64)
    import pyarrow as pa

    full = type("B", (), {"value": b"\xff" * 8})()
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t for _, t in rows]), pa.array([True] * len(rows)), pa.array([1] * len(rows))], ["lang", "chunk", "last", "n"])
    for size in (2, 4):
        a, b = (Counter({(r["lang"], r["phrase"]): r["n"] for x in C._counter(size, bits)(iter([batch])) for r in x.to_pylist()}) for bits in (None, full))
        assert a == b


def test_scores_beyond_64_bits(spark):
    df = spark.sql("select 4000000000000001 a, 9000000000000007 n, 4100000000000009 l, 4500000000000003 r")
    e = "(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert df.selectExpr(f"{e} x").first().x == 1000 * 4000000000000001 * 9000000000000007 // (4100000000000009 * 4500000000000003)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(empty).collect() == []
    assert run(spark, [("en", None)] * 3, 1) == []
    long = " ".join(["tick tock"] * 20_000)
    assert run(spark, [("en", long)], 100) == brute([("en", long)], 100)
    same = [("en", "Same words here again")] * 150
    assert run(spark, same, 100) == brute(same, 100) == [("en", 1, "same words here again", 150, 150, 150, 600, 4000)]
