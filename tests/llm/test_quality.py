import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from arborlake.llm import quality as Q


def brute(rows):
    """host_rate, path_rate and score by key, of (key, host, path, evidence), by plain loops."""
    p = {k: 1 / (1 + math.exp(-e)) for k, _, _, e in rows}
    rate = (sum(p.values()) + 0.5) / (len(rows) + 1)
    hosts, parts = defaultdict(list), defaultdict(list)
    for k, h, x, _ in rows:
        hosts[h].append(p[k])
        parts[h, x].append(p[k])

    def strength(groups, free):
        n = sum(len(g) for g, _ in groups)
        within = sum(len(g) * r * (1 - r) for g, r in groups) / n
        spread = sum(len(g) * (sum(g) / len(g) - r) ** 2 for g, r in groups)
        room = n - sum(len(g) ** 2 for g, _ in groups) / n
        between = (spread - (len(groups) - free) * within) / room if room > 0 else 0
        return min(1000.0, max(1.0, within / between - 1)) if len(groups) > free and within > 0 and between > 0 else 1000.0

    a = strength([(g, rate) for g in hosts.values()], 1)
    b = strength([(g, sum(hosts[h]) / len(hosts[h])) for (h, _), g in parts.items()], len(hosts))
    out = {}
    for k, h, x, e in rows:
        host = (sum(hosts[h]) - p[k] + a * rate) / (len(hosts[h]) - 1 + a)
        part = (sum(parts[h, x]) - p[k] + b * host) / (len(parts[h, x]) - 1 + b)
        out[k] = host, part, 1 / (1 + math.exp(-(e + math.log(part / (1 - part)) - math.log(rate / (1 - rate)))))
    return out


def test_features():
    x = Q.features(pa.array(["aa BB! cc|", None, "", "go go go stop go", "É" * 3 + " ABC\tABC abc"]))
    assert np.isfinite(x).all() and x.shape == (5, Q.N_FEATURES)
    assert x[0, 0] == 2 / 3 and x[0, 1] == 1 / 3 and not x[1].any() and not x[2].any()
    assert x[3, 2] == 3 / 5 and x[4, 1] == 2 / 4 and x[4, 2] == 1 / 4


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    got = Q.judge(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n, right, lost = got.count(), got.where("kept = (quality = 1)").count(), got.where("not kept and quality = 1").count()
    assert n > 1000 and right / n > 0.995 and lost / n < 0.003


def test_shrinking_by_hand(spark):
    model = Q.Model(np.zeros(Q.N_FEATURES), np.ones(Q.N_FEATURES), np.array([-20.0] + [0.0] * (Q.N_FEATURES - 1) + [1.0]))
    rows = [(i, "fine words here", "good", "a") for i in range(40)] + [(100 + i, "x| y| z|", "bad", "a") for i in range(40)] + [(200, "fine words here", "bad", "b"), (201, "fine words here", "rare", None), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, n long, p long")
    got = {r.doc_id: r for r in Q.classify(df, model).collect()}
    assert len(got) == len(rows)
    want = brute([(r[0], r[2], r[3], e) for r, e in zip(rows, model.logits(Q.features(pa.array([r[1] for r in rows], pa.string()))), strict=True)])
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip((got[i].host_rate, got[i].path_rate, got[i].score), w, strict=True)), i
    assert got[200].score < got[201].score < got[0].score and not got[100].kept
    assert math.isclose(got[201].score, 1 / (1 + math.exp(-1)), rel_tol=1e-6)  # alone on its site: its own evidence, once


def test_real_rows_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5"))
    model = Q.train(docs, labels)
    rows = docs.collect()
    logits = model.logits(Q.features(pa.array([r.text for r in rows], pa.string())))
    want = brute([(i, r.source, r.lang, e) for i, (r, e) in enumerate(zip(rows, logits, strict=True))])
    want = sorted((rows[i].doc_id, *w) for i, w in want.items())
    got = sorted((r.doc_id, r.host_rate, r.path_rate, r.score) for r in Q.classify(docs, model).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and all(math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-9) for x, y in zip(g[1:], w[1:], strict=True))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "w| " * 50_000, None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in Q.judge(docs, none).collect()] == [True] * 3
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert Q.judge(docs, one).count() == 3
    assert Q.judge(docs.limit(0), one).count() == 0
