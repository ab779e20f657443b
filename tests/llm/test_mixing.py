import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arborlake.llm.mixing import PHI_64, block_words, fair_shares, mix, mix_documents, schedule


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slots(sources, block):
    """The schedule, one slot after the other."""
    total, ranks, out = sum(s["target"] for s in sources), Counter(), []
    for t in range(max(1, round(total / block)) if total else 0):
        point, below, no = ((t * PHI_64 + PHI_64 // 2) % 2**64) / 2.0**64, 0.0, 0
        for no, s in enumerate(sources):
            below += s["target"]
            if point < below / total:
                break
        out.append((t, no, ranks[no]))
        ranks[no] += 1
    return out


def check(rows, found, order, block=None):
    """Against a brute-force version: `order` gives each source's rows as they were shuffled."""
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, words(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    parts = fair_shares([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    sources = [{"target": t} for t in parts]
    block = block or block_words(sources)
    stream = {n: [d for d in order[s] for _ in range(d[1])] * 2 for n, s in enumerate(names)}
    took, first = Counter(), {}
    for slot, no, k in slots(sources, block):
        for d in stream[no][k * block : (k + 1) * block]:
            took[d] += 1
            first.setdefault(d, slot)
    by_doc = {d: s for d, _, s in rows}
    mine = Counter()
    for r in found:
        s = by_doc[r.doc_id]
        no = names.index(s)
        assert (r.source_size, round(r.target, 6)) == (sizes[s], round(parts[no], 6))
        assert (r.taken, r.first_slot) == (took[(r.doc_id, r.size)], first.get((r.doc_id, r.size)))
        assert 0 <= r.taken <= 2 * r.size
        mine[no] += r.taken
    assert all(abs(mine[no] - t) <= 4 * block for no, t in enumerate(parts))


def order_of(df, seed=7):
    """(doc_id, words) by source in the order of the shuffle: chunk, then hash."""
    h = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    chunks = 1
    while chunks * 500 < df.count():
        chunks *= 2
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = df.select("doc_id", "text", "source", h.alias("h"), F.pmod(F.xxhash64(h, "doc_id", text), F.lit(chunks)).alias("c"), text.alias("t")).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.c, r.h)):
        out[r.source].append((r.doc_id, words(r.text)))
    return out


def test_shares():
    assert fair_shares([100, 100, 100], [5, 2, 1], 1.5, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert fair_shares([10, 1000], [5, 2], 1.5, 2) == [20, 1495]
    assert fair_shares([0, 0], [5, 2], 1.5, 2) == [0, 0]
    assert fair_shares([], [], 1.5, 2) == []


def test_real_rows_and_rerun(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = mix(docs).collect()
    check(rows, found, order_of(docs))
    assert Counter(found) == Counter(mix(docs.repartition(7)).collect())


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y z", None), (4, "w " * 9000, "b"), (5, "w", "c"), (None, "q r", "d"), (6, "same same", "b"), (7, "k " * 50, ""), (8, "Zeile " * 70, "Z")]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, source string, size long, target long")
    check(rows, mix(df).collect(), order_of(df))
    check(rows, mix(df, block=7).collect(), order_of(df), 7)
    twice = df.unionByName(df.where("doc_id = 6")).unionByName(df.where("doc_id = 1"))
    got = mix(twice).collect()
    assert len(got) == 11 and sum(r.taken for r in got if r.doc_id == 6) <= 8
    assert mix(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0
    assert mix(df.where("doc_id < 3")).count() == 2 and {r.taken for r in mix(df.where("doc_id < 3")).collect()} == {0}
    with pytest.raises(ValueError):
        mix(df, most=1.5)


def test_the_schedule_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = lambda s, sources, block: schedule(s, sources, block).withColumn("slot", -F.col("slot"))
    half = lambda s, sources, block: schedule(s, sources, block).where("slot % 2 = 0")
    plain, turned, less = (sorted(map(tuple, mix(docs, plan=p).collect())) for p in (schedule, back, half))
    assert [r[:5] for r in plain] == [r[:5] for r in turned] and plain != turned  # the same blocks in another order
    assert sum(r[4] for r in less) < 0.6 * sum(r[4] for r in plain)
    one, two = (Counter(r.doc_id for r in mix_documents(docs, plan=p).collect()) for p in (schedule, half))
    assert two.total() < 0.8 * one.total() and all(two[d] <= n for d, n in one.items())


def test_rows_of_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "_size")
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id < 2"))
    out = mix_documents(docs)
    assert out.columns == docs.columns
    sizes, longest = defaultdict(int), defaultdict(int)
    took = Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    rows = out.collect()
    for r in rows:
        took[r.source] += words(r.text)
    names = sorted(sizes)
    parts = fair_shares([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    slack = 4 * block_words([{"target": t} for t in parts])
    for s, t in zip(names, parts, strict=True):
        assert t - slack <= took[s] <= t + slack + longest[s]
    assert max(Counter(r.doc_id for r in rows if r.doc_id > 2).values()) <= 2 and max(Counter(r.doc_id for r in rows).values()) <= 6
    # By words, a row comes as often as its first word is taken.
    first = {r.doc_id: r for r in mix(docs).collect()}
    assert all(r.doc_id in first and first[r.doc_id].taken > 0 or first[r.doc_id].size == 0 for r in rows)


def test_schedule_is_even(spark):
    sources = [{"no": i, "target": float(w)} for i, w in enumerate([7000, 2000, 1000])]
    rows = schedule(spark, sources, 10).orderBy("slot").collect()
    assert [(r.slot, r.no, r.block_no) for r in rows] == slots(sources, 10)
    each = Counter(r.no for r in rows)
    assert all(abs(each[i] - n) <= 3 for i, n in enumerate((700, 200, 100)))
    for n in range(100, 1000, 100):
        assert abs(sum(r.no == 0 for r in rows[:n]) - 0.7 * n) < 5
