"""Parsers that users bring: a function from one text to its nodes, run over batches of documents.

A parser gets a document's text and yields Node after Node, parents before their
children. It sees one document at a time and keeps nothing between documents;
Spark deals documents to tasks; their nodes go back as Arrow columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.text import as_uuid


class Node(NamedTuple):
    """key: the parser's own name of the node, unique in the text; parent: the key of a node yielded before, or null."""

    key: str
    parent: str | None
    kind: str
    name: str = ""
    content: str = ""
    line_start: int | None = None
    line_end: int | None = None


class ParseError(Exception):
    """What a parser raises where a text has not its form; any other exception counts as the same."""


Parser = Callable[[str], Iterable[Node]]
#: Why a document gave an error row instead of nodes.
NO_TEXT, FAILED, BAD_NODE, UNKNOWN_PARENT, DUPLICATE_KEY, BAD_LINES = "NO_TEXT", "PARSE_FAILED", "BAD_NODE", "UNKNOWN_PARENT", "DUPLICATE_KEY", "BAD_LINES"
SCHEMA = "seq int, key string, parent string, kind string, name string, content string, line_start int, line_end int, child_index int, ord_path array<int>, anc_keys array<string>, code string, message string"
#: Rows and characters of texts after which a task hands on what it has.
ROWS, CHARS = 20_000, 1 << 24
_LONE = re.compile("[\ud800-\udfff]")


def check_node(node: object, places: dict) -> tuple[str, str] | None:
    """The code and the message of what is wrong with a node after those at `places`, if anything is."""
    if not isinstance(node, Node):
        return BAD_NODE, f"{type(node).__name__} is no Node"
    for name, value in (("key", node.key), ("kind", node.kind)):
        if not isinstance(value, str) or not value:
            return BAD_NODE, f"{name} must be a string that is not empty"
    for name, value in (("name", node.name), ("content", node.content)):
        if not isinstance(value, str):
            return BAD_NODE, f"{name} of {node.key} must be a string"
    if node.key in places:
        return DUPLICATE_KEY, node.key
    if node.parent is not None and node.parent not in places:
        return UNKNOWN_PARENT, f"{node.parent} of {node.key}"
    a, b = node.line_start, node.line_end
    if (a is None) != (b is None) or a is not None and not (type(a) is int and type(b) is int and 1 <= a <= b):
        return BAD_LINES, f"{a} to {b} of {node.key}"
    return None


def _column(values: tuple, type_: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, type_)
    except UnicodeEncodeError:  # halves of surrogate pairs, which no text of Spark can hold
        return pa.array([_LONE.sub("\ufffd", v) if isinstance(v, str) else [_LONE.sub("\ufffd", x) for x in v] if v is not None else None for v in values], type_)


def _parsed(text: str | None, parse: Parser, paths: bool, lines: bool) -> list[tuple]:
    """The rows of a text, without its doc_id: all its nodes, or one error row and none of them."""
    error = (NO_TEXT, "the text is null") if text is None else None
    rows, places, children = [], {}, {}
    if error is None:
        cut = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if lines else []
        try:
            for node in parse(text):
                error = check_node(node, places)
                if error:
                    break
                key, parent, kind, name, content, start, end = node
                index = children.get(parent, 0)
                children[parent] = index + 1
                more = ()
                if paths:
                    path, above = places[parent] if parent is not None else ([], [])
                    places[key] = [*path, index], [*above, key]
                    more = [*path, index], above
                else:
                    places[key] = True
                if lines:
                    more = (*more, None if start is None else cut[start - 1] if start == end <= len(cut) else "\n".join(cut[start - 1 : end]))
                rows.append((len(rows), key, parent, kind, name, content, start, end, index, None, None, *more))
        except Exception as e:  # noqa: BLE001  a parser's failure is a row of the result
            error = FAILED, f"{type(e).__name__}: {e}"
    if not error:
        return rows
    return [(None,) * 9 + error + (None,) * (2 * paths + lines)]


def parse_documents(docs: DataFrame, parse: Parser, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The nodes of all documents that parse, and one row (doc_id, code, message) for each that does not.

    Nodes have the columns of node tables (doc_id, node_id, parent_id,
    child_index, depth, kind, name, content, ord_path, anc_ids) and line_start,
    line_end; a node's id follows from its document and key. A document fails
    whole: none of its nodes is kept. A text without nodes gives neither.
    """
    rows = parsed_rows(docs, parse, text, paths=True)
    own = lambda c: as_uuid(F.col("doc_id").cast("string"), c)
    nodes = rows.where("code is null").select(
        "doc_id", own(F.col("key")).alias("node_id"), F.when(F.col("parent").isNotNull(), own(F.col("parent"))).alias("parent_id"), "child_index", F.size("anc_keys").alias("depth"),
        "kind", "name", "content", "ord_path", F.transform("anc_keys", own).alias("anc_ids"), "line_start", "line_end",
    )
    return nodes, rows.where("code is not null").select("doc_id", "code", "message")


def parsed_rows(docs: DataFrame, parse: Parser, text: str = "text", paths: bool = False, lines: bool = False) -> DataFrame:
    """doc_id with rows of nodes and errors in one table, so that a caller who needs both can write it once.

    Of SCHEMA, ord_path and anc_keys only with paths. With lines, `lines` has those from line_start to line_end, joined by \\n.
    """
    base = StructType.fromDDL(SCHEMA)
    names = [n for n in base.names if n not in ("ord_path", "anc_keys")] + ["ord_path", "anc_keys"] * paths
    fields = [base[n] for n in names] + ([StructField("lines", base["content"].dataType)] if lines else [])
    types = [to_arrow_type(f.dataType) for f in fields]
    own = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [_column(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], ["doc_id", *own])

        for batch in batches:
            of, rows, chars = [], [], 0
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                got = _parsed(value, parse, paths, lines)
                rows += got
                of += [i] * len(got)
                chars += sum(len(r[-1] or "") for r in got) if lines else len(value or "")
                if len(rows) >= ROWS or chars >= CHARS:
                    yield made(batch, of, rows)
                    of, rows, chars = [], [], 0
            if rows:
                yield made(batch, of, rows)

    src = docs.select("doc_id", F.col(text).alias("_text"))
    return src.mapInArrow(run, StructType([StructField("doc_id", src.schema["doc_id"].dataType), *fields]))


def ini(text: str) -> Iterable[Node]:
    """Texts of `[section]`, `key = value` (or `key: value`), blank lines and comments that begin with ; or #.

    Lines that begin with white space continue the value before. Keys before the first section belong to the root.
    """
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    yield Node("ini", None, "file", line_start=1, line_end=max(1, len(lines)))
    section, held, names = "ini", None, {}

    def own(key: str) -> str:
        names[key] = names.get(key, 0) + 1
        return key if names[key] == 1 else f"{key}#{names[key]}"

    def setting() -> Iterable[Node]:
        if held:
            yield Node(held[0], section, "setting", held[1], "\n".join(held[2]), held[3], held[3] + len(held[2]) - 1)

    for i, line in enumerate(lines, 1):
        body = line.strip(" \t")
        if held and line[:1] in (" ", "\t") and body:
            held[2].append(body)
            continue
        yield from setting()
        held = None
        if not body or body[0] in ";#":
            continue
        if body[0] == "[":
            if body[-1] != "]" or len(body) < 3:
                raise ParseError(f"line {i}: section is not closed")
            section = own(f"[{body[1:-1]}]")
            yield Node(section, "ini", "section", body[1:-1], "", i, i)
            continue
        at = min((p for p in (body.find("="), body.find(":")) if p >= 0), default=-1)
        if at < 1:
            raise ParseError(f"line {i}: neither section nor setting")
        name = body[:at].strip(" \t")
        held = (own(f"{section}/{name}"), name, [body[at + 1 :].strip(" \t")], i)
    yield from setting()
