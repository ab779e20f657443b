"""Structural blocks by format."""

import json
import random

import pytest

from arborlake.operators import blocks as B
from arborlake.sources.parsers import ParseError


def made(rng, depth=3):
    kind = rng.choice("oasnbz" if depth else "snbz")
    if kind == "o":
        return {k: made(rng, depth - 1) for k in rng.sample(["a", "b/c", "d~", "é\n", "0", "q\"\\"], rng.randint(0, 5))}
    if kind == "a":
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {"s": rng.choice(["", 'q"\\/', "é\t😀"]), "n": rng.choice([0, -1.5e3, 7]), "b": rng.choice([True, False]), "z": None}[kind]


def pointers(x, at="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    yield at, kind, x
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from pointers(v, at + "/" + str(k).replace("~", "~0").replace("/", "~1"))


def test_json_values_are_those_of_the_text():
    rng = random.Random(2)
    for _ in range(400):
        x = made(rng)
        text = json.dumps(x, indent=rng.choice([None, 0, 2]), ensure_ascii=rng.random() < 0.5)
        nodes = list(B.json_values(text))
        assert [(n.key, n.kind) for n in nodes] == [(k, kind) for k, kind, _ in pointers(x)]
        for n, (_, kind, v) in zip(nodes, pointers(x)):
            if kind == "string":
                assert n.content == v
            elif kind in ("number", "boolean", "null"):
                assert json.loads(n.content) == v
            part = "\n".join(text.split("\n")[n.line_start - 1 : n.line_end])
            assert n.line_start <= n.line_end and (kind not in ("object", "array") or "]" in part or "}" in part)
        assert nodes[0].line_end == text.count("\n") + 1


@pytest.mark.parametrize("bad", ["", "{", "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', '{"a":1 "b":2}', "1 2", "tru", '{"a":1,"a":2}', '"\n"', "01", "[1", "{]", "{1:2}", '"\\x"'])
def test_what_is_no_json(bad):
    with pytest.raises(ParseError):
        list(B.json_values(bad))


def test_lines_of_values(spark):
    docs = spark.createDataFrame([(1, '{"a":\n  [1,\n   {"b": 2}\n  ], "c": "x"\n}'), (2, "{oops"), (3, None)], "doc_id long, text string")
    blocks, errors = B.json_blocks(docs)
    assert {r.block_id: (r.kind, r.start_line, r.end_line) for r in blocks.collect()} == {
        "": ("object", 1, 5), "/a": ("array", 1, 4), "/a/0": ("number", 2, 2), "/a/1": ("object", 3, 3), "/a/1/b": ("number", 3, 3), "/c": ("string", 4, 4),
    }
    assert {r.doc_id: r.code for r in errors.collect()} == {2: "PARSE_FAILED", 3: "NO_TEXT"}


def test_markdown(spark):
    text = "# One #\npara\nmore\n- a\n  b\n\n- c\n> q\nlazy\n```py\n# no\n\n```\n~~~\nopen\n***\n"
    got = B.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, "----\n1. x\n10) y\n#nohead")], "doc_id long, text string")).orderBy("doc_id", "start_line").collect()
    assert [(r.doc_id, r.kind, r.name, r.start_line, r.end_line) for r in got] == [
        (1, "heading", "One", 1, 1), (1, "paragraph", None, 2, 3), (1, "list", None, 4, 5), (1, "list", None, 7, 7), (1, "quote", None, 8, 9), (1, "fence", "py", 10, 13), (1, "fence", None, 14, 16),
        (3, "rule", None, 1, 1), (3, "list", None, 2, 4),
    ]
    assert got[1].text == "para\nmore" and got[5].text == "```py\n# no\n\n```"


def test_texts_of_blocks_need_no_join_and_no_second_read(spark):
    text = '{"a":\r\n  [1,\n   {"b": "\\ud800x"}\n  ]\n}'
    docs = spark.createDataFrame([(1, "json", text), (2, "markdown", "# t\r\n```\n\nx\r\n```\nend"), (3, "json", "[" * 9 + "]" * 9)], "doc_id long, format string, text string")
    blocks, _ = B.structural_blocks(docs)
    assert "Join" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.block_id): r.text for r in blocks.collect()}
    assert got[1, ""] == text.replace("\r", "") and got[1, "/a"] == text.replace("\r", "")[:-2] and got[1, "/a/1/b"] == '   {"b": "\\ud800x"}'
    assert got[2, "fence:2"] == "```\n\nx\n```" and got[2, "paragraph:6"] == "end" and len([k for k in got if k[0] == 3]) == 9
