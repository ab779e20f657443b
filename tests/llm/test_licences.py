import random
import re

import pytest

from arborlake.llm import licences
from arborlake.llm.licences import BASE, DUTIES, DUTY, NOTICES, evaluate, scan_licences, shunting_yard

DIR = "/root/testdata/sf0.001"


def rows(spark, texts, extra=""):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in scan_licences(df).collect()}


def brute(text):
    """Base columns and phrase labels by comparing words at each place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at, base, labels, doubt = [], set(), set(), 1.0
    for phrase, label, weight in [(p, x, None) for p, x in BASE.items()] + [(p, *x) for p, x in NOTICES.items()]:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        if hits:
            labels.add(label)
            doubt *= 1 - (weight or licences.BASE_WEIGHT)
            if weight is None:
                base.add(label)
                at += hits
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), labels, 1 - doubt


def same(got, text):
    n, n_base, first, last, base, labels, score = brute(text)
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (n, n_base, first, last, base)
    assert labels <= set(got.labels.split(",") if got.labels else []) and 0 <= got.score <= 1
    if got.expressions == "":
        assert got.labels == ",".join(sorted(labels)) and got.score == pytest.approx(score)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licences(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        same(r, texts[r.doc_id])
    assert {"mit", "gpl", "apache"} <= {x for r in got for x in r.base_labels.split(",")} or sf == "sf0.001"


def test_random_phrases(spark):
    rng = random.Random(5)
    parts = [w for p in [*BASE, *NOTICES] for w in p.split()] + ["licenses", "Émit", "x9", "the"]
    gaps = [" ", "\n", "-", ", ", "_", "\x00", "/ "]
    texts = ["".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(gaps) for w in (rng.choice(parts + 4 * ["mit", "license", "general", "public", "apache"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        same(got[i], t)


def random_expression(rng, depth=3):
    """An expression's text and its duty, by recursion instead of a stack."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(sorted(DUTY))
        if rng.random() < 0.2:
            return f"{name} WITH Classpath-exception-2.0", max(0, DUTY[name] - 1)
        return name, DUTY[name]
    op = rng.choice(["AND", "or"])
    (a, da), (b, db) = random_expression(rng, depth - 1), random_expression(rng, depth - 1)
    return f"({a}) {op} ({b})", max(da, db) if op == "AND" else min(da, db)


def test_expressions(spark):
    rng = random.Random(7)
    made = [random_expression(rng) for _ in range(200)]
    got = rows(spark, [f"# SPDX-License-Identifier: {t} */\nmore words" for t, _ in made])
    for i, (_, duty) in enumerate(made):
        assert got[i].duty == DUTIES[duty], made[i]


def test_precedence():
    assert shunting_yard("a or b and c with d".split()) == "a b c d with and or".split()
    assert shunting_yard("( a or b ) and c".split()) == "a b or c and".split()
    for bad in ("a b", "and", "a or", "( a", "a )", ")", "( )", "a ( b )"):
        assert shunting_yard(bad.split()) is None
    assert evaluate(["mit", "apache-2.0", "with"]) is None


def test_tags(spark):
    got = rows(
        spark,
        [
            '"license": "(MIT OR GPL-3.0-only)",',
            "license: see below",
            "SPDX-License-Identifier: LicenseRef-Mine",
            "SPDX-License-Identifier: MIT AND (GPL-2.0+",
            "SPDX-License-Identifier:\nMIT",
            "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note",
            "license = mit license: apache-2.0",
            "SPDX-License-Identifier: AGPL-3.0-only\nSPDX-License-Identifier: MIT",
        ],
    )
    assert [(got[i].labels, got[i].duty) for i in range(8)] == [
        ("gpl-3.0-only,mit", "notice"),
        ("", None),
        ("licenseref-mine", "limits"),
        ("mit", "notice"),
        ("", None),
        ("gpl-2.0-only", "weak"),
        ("apache-2.0,mit", "notice"),  # `mit license` is also a phrase of its own
        ("agpl-3.0-only,mit", "limits"),
    ]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "MIT License", 7), (3, "mit license", 7), (3, "mit license", 7), (4, "license: " * 200_000 + "mit", 7)], "doc_id long, text string, labels int")
    got = sorted(scan_licences(df).collect(), key=str)
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0.0) == (by[2].n_words, by[2].n_base, by[2].first_word, by[2].labels, by[2].score)
    assert by[None].base_labels == "mit" and by[3].first_word == 0
    assert by[4].n_words == 200_001 and by[4].labels == "mit"
    assert scan_licences(df.where("false")).collect() == []
