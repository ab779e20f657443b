"""Parsers that users bring."""

import pytest

from arborlake.sources import parsers as P
from arborlake.sources.parsers import Node


def run(spark, parse, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, errors = P.parse_documents(df, parse)
    return nodes.collect(), {r.doc_id: (r.code, r.message) for r in errors.collect()}


def outline(text):
    """Lines indented by two spaces a level; `!` raises, `?key` names an unknown parent."""
    above = []
    for i, line in enumerate(text.split("\n"), 1):
        if line == "!":
            raise ValueError("no")
        body = line.lstrip(" ")
        depth = (len(line) - len(body)) // 2
        del above[depth:]
        yield Node(f"{i}", body[1:] if body[:1] == "?" else above[-1] if above else None, "item", body, "", i, i)
        above.append(f"{i}")


def test_trees_are_those_of_the_parser(spark):
    nodes, errors = run(spark, outline, "a\n  b\n    c\n  d\ne")
    assert not errors
    by = {r.name: r for r in nodes}
    assert [by[n].depth for n in "abcde"] == [0, 1, 2, 1, 0]
    assert by["c"].anc_ids == [by["a"].node_id, by["b"].node_id] and by["c"].parent_id == by["b"].node_id
    assert [by[n].ord_path for n in "abcde"] == [[0], [0, 0], [0, 0, 0], [0, 1], [1]]
    assert by["d"].child_index == 1 and by["e"].line_start == 5


def test_a_document_fails_whole_and_others_go_on(spark):
    nodes, errors = run(spark, outline, "a\n  b\n!", "x\n?9", None, "good")
    assert {r.name for r in nodes} == {"good"}
    assert errors == {0: ("PARSE_FAILED", "ValueError: no"), 1: ("UNKNOWN_PARENT", "9 of 2"), 2: ("NO_TEXT", "the text is null")}


@pytest.mark.parametrize(
    "made, code",
    [
        ([("no", "node")], "BAD_NODE"),
        ([Node("", None, "k")], "BAD_NODE"),
        ([Node("a", None, 5)], "BAD_NODE"),
        ([Node("a", None, "k", None)], "BAD_NODE"),
        ([Node("a", None, "k"), Node("a", None, "k")], "DUPLICATE_KEY"),
        ([Node("a", "a", "k")], "UNKNOWN_PARENT"),
        ([Node("a", None, "k", line_start=2, line_end=1)], "BAD_LINES"),
        ([Node("a", None, "k", line_start=2)], "BAD_LINES"),
        ([Node("a", None, "k", line_start=1, line_end=1.5)], "BAD_LINES"),
    ],
)
def test_schema_check(made, code):
    places = {}
    for node in made:
        found = P.check_node(node, places)
        if found:
            assert found[0] == code
            return
        places[node.key] = ([], [])
    raise AssertionError("nothing found")


def test_ini(spark):
    text = "top = 1\r\n; note\n\n[s]\na: x = y\n\tmore\n[s]\na = 2\n\n"
    nodes, errors = run(spark, P.ini, text, "[open", "= 3", "", "[]")
    assert errors == {1: ("PARSE_FAILED", "ParseError: line 1: section is not closed"), 2: ("PARSE_FAILED", "ParseError: line 1: neither section nor setting"), 4: ("PARSE_FAILED", "ParseError: line 1: section is not closed")}
    got = sorted((r.ord_path, r.kind, r.name, r.content, r.line_start, r.line_end) for r in nodes if r.doc_id == 0)
    assert got == [
        ([0], "file", "", "", 1, 8),
        ([0, 0], "setting", "top", "1", 1, 1),
        ([0, 1], "section", "s", "", 4, 4),
        ([0, 1, 0], "setting", "a", "x = y\nmore", 5, 6),
        ([0, 2], "section", "s", "", 7, 7),
        ([0, 2, 0], "setting", "a", "2", 8, 8),
    ]
    assert [(r.kind, r.line_end) for r in nodes if r.doc_id == 3] == [("file", 1)]
    ids = [r.node_id for r in nodes if r.doc_id == 0]
    assert len(set(ids)) == len(ids)
