"""No link of alike blocks is missed, at any bound."""

import random

from arborlake.operators import duplicates as U


def test_all_pairs_are_found(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        other = list(words)
        for at in (8, 18, 28):  # 21 of 51 shingles stay
            other[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, 1, 5, " ".join(words)), (2 * i + 1, 1, 5, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string")
    got = {}
    for r in U.structural_duplicates(df, similarity=0.4).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == [[2 * i, 2 * i + 1] for i in range(40)]
