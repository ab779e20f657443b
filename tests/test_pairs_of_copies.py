"""Pairs of alike vectors with all copies, as SQL has them."""

import random

import numpy as np

from arborlake.operators import corpus as K
from arborlake.queries import QUERIES


def test_copies_make_pairs(spark):
    rng = random.Random(7)
    base = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(80)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.a, r.b): r.cosine for r in K.pairs_of_copies(*K.semantic_duplicates(df, 0.85), share=3).collect()}
    want = {}
    for i, v in rows:
        for j, w in rows:
            c = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)
            if i < j and c >= 0.85 - 1e-12:
                want[i, j] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_bound_holds_for_the_rounded_cosine(spark, tmp_path):
    angle = np.arccos(0.3999996)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle)), float(np.sin(angle))]), (3, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["k4_semantic_duplicates"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.4), (1, 3, 1.0), (2, 3, 0.4)]
