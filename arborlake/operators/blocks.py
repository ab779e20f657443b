r"""Structural blocks of documents by their format: JSON values by pointer, Markdown blocks, lines of plain text.

blocks(doc_id, block_id, node_ref, kind, name, start_line, end_line, text): lines count from 1, both ends inclusive;
text is these lines without the last one's end, other ends as \n.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from operator import methodcaller

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.parsers import Node, ParseError, parsed_rows
from .lines import bare, line_nodes

#: White space and a token; any other character is a token that fits nowhere, and the end an empty one.
_TOKEN = re.compile(r'([ \t\r\n]*)("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|[^ \t\r\n]|\Z)')
_GROUPS = methodcaller("groups")
#: The kind of a value by its first character, but for single characters that begin one only.
_KINDS = {'"': "string", "t": "boolean", "f": "boolean", "n": "null", "{": "object", "[": "array"} | dict.fromkeys("-0123456789", "number")
_HALF = frozenset('"-tfn')
_ESCAPE = re.compile(r'\\(u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)')
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _unescaped(s: str) -> str:
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] != "u":
            return _PLAIN.get(e, e)
        if len(e) == 5:
            return chr(int(e[1:], 16))
        return chr(0x10000 + ((int(e[1:5], 16) & 0x3FF) << 10) + (int(e[7:], 16) & 0x3FF))

    return _ESCAPE.sub(one, s)


def json_values(text: str) -> Iterable[Node]:
    """Each value of a JSON text with its pointer and the lines it stands on, members in the text's order.

    A parser for parse_documents: keys are pointers behind a `$`, so that the root's is not empty; kinds are those of
    json_nodes; the content of a scalar is its text. A member's lines begin with its name. A name that an object has
    twice is an error, as its pointer would be too.
    """
    tokens = map(_GROUPS, _TOKEN.finditer(text))
    line, done, names = 1, [], set()
    around: list[tuple] = []  # what holds the container that the current value is in
    up, is_object, slot, n = None, False, -1, 0  # that container's key, kind, place in done and values so far
    key, name, start = "$", "", 0

    def wrong(t: str):
        return ParseError(f"line {line}: unexpected {t or 'end'!r}")

    space, t = next(tokens)
    start = line = line + space.count("\n")
    while True:
        # t begins the value at `key`.
        kind = _KINDS.get(t[:1])
        if kind is None or t in _HALF:
            raise wrong(t)
        if kind == "object" or kind == "array":
            done.append(Node(key, up, kind, name, "", start, start))
            around.append((up, is_object, slot, n))
            up, is_object, slot, n = key, kind == "object", len(done) - 1, 0
        else:
            done.append(Node(key, up, kind, name, _unescaped(t[1:-1]) if kind == "string" else t, start, line))
        while True:
            space, t = next(tokens)
            if space:
                line += space.count("\n")
            if up is None or t != ("}" if is_object else "]"):
                break
            done[slot] = Node(*done[slot][:6], line)
            up, is_object, slot, n = around.pop()
        if up is None:
            if t:
                raise ParseError(f"line {line}: text behind the value")
            break
        if n:
            if t != ",":
                raise wrong(t)
            space, t = next(tokens)
            if space:
                line += space.count("\n")
        start = line
        if is_object:
            if t[:1] != '"' or t == '"':
                raise wrong(t)
            name = _unescaped(t[1:-1])
            space, t = next(tokens)
            line += space.count("\n")
            if t != ":":
                raise wrong(t)
            space, t = next(tokens)
            if space:
                line += space.count("\n")
            key = f"{up}/{name.replace('~', '~0').replace('/', '~1')}"
            if key in names:
                raise ParseError(f"line {line}: {name} stands twice")
            names.add(key)
        else:
            name = str(n)
            key = f"{up}/{name}"
        n += 1
    yield from done


def json_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of JSON texts (doc_id, text): a block a value, named by its pointer; errors(doc_id, code, message) of texts that are none."""
    rows = parsed_rows(docs, json_values, lines=True)
    pointer = F.substring("key", 2, 1 << 30)
    good = rows.where("code is null").select("doc_id", pointer.alias("block_id"), pointer.alias("node_ref"), "kind", F.nullif("name", F.lit("")).alias("name"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), F.col("lines").alias("text"))
    return good, rows.where("code is not null").select("doc_id", "code", "message")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown texts (doc_id, text): heading, fence, list, quote, rule and paragraph.

    Blocks end at blank lines; a fence goes to its closing mark, or to the end of the text; a heading and a rule are
    one line; a line behind a list item or a quote belongs to it. The name of a heading is its title, of a fence its
    language. block_id is the kind and the first line, which is also the reference of the block's node.
    """
    w = W.partitionBy("doc_id").orderBy("line")
    rows = line_nodes(docs).withColumn("_c", bare(F.col("content")))
    mark = F.col("_c").rlike("^ {0,3}(```|~~~)")
    rows = rows.withColumn("_m", mark.cast("int")).withColumn("_f", F.sum("_m").over(w))
    fenced = (F.col("_f") % 2 == 1) | mark  # the closing mark belongs to its fence
    fence = F.when(fenced, F.floor((F.col("_f") + 1) / 2))
    c = F.col("_c")
    kind = (
        F.when(fence.isNotNull(), "fence").when(F.trim(c) == "", "blank").when(c.rlike(r"^ {0,3}#{1,6}( |$)"), "heading").when(c.rlike(r"^ {0,3}([-*_])( *\1){2,} *$"), "rule")
        .when(c.rlike(r"^ {0,3}([-*+]|[0-9]{1,9}[.)])( |$)"), "list").when(c.rlike("^ {0,3}>"), "quote").otherwise("text")
    )
    rows = rows.withColumn("_fence", fence).withColumn("_k", kind)
    before = F.lag("_k").over(w)
    # A run of lines of one kind; text behind a list or a quote goes on with it.
    head = F.col("_k").isin("blank", "heading", "rule") | before.isNull() | before.isin("blank", "heading", "rule")
    head = head | (F.col("_k") != before) & ~(F.col("_k") == "text") | (before == "fence") & (F.col("_k") != "fence")
    head = head | (F.col("_k") == "fence") & ~F.coalesce(F.lag("_fence").over(w).eqNullSafe(F.col("_fence")), F.lit(False))
    rows = rows.withColumn("_b", F.sum(F.coalesce(head, F.lit(True)).cast("int")).over(w)).where("_k <> 'blank'")
    out = rows.groupBy("doc_id", "_b").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min_by("_k", "line").alias("_k"), F.min_by("_c", "line").alias("_c"), F.array_sort(F.collect_list(F.struct("line", "_c"))).alias("_lines"))
    kind = F.when(F.col("_k") == "text", "paragraph").otherwise(F.col("_k"))
    title = F.when(kind == "heading", F.trim(F.regexp_replace("_c", r"^ *#+ *|( +#+)? *$", ""))).when(kind == "fence", F.trim(F.regexp_replace("_c", "^ *(`+|~+)", "")))
    own = F.concat(kind, F.lit(":"), F.col("start_line").cast("string"))
    return out.select("doc_id", own.alias("block_id"), own.alias("node_ref"), kind.alias("kind"), F.nullif(title, F.lit("")).alias("name"), "start_line", "end_line", F.array_join(F.col("_lines")["_c"], "\n").alias("text"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block a line of plain texts (doc_id, text), named by its place from 0."""
    own = (F.col("line") - 1).cast("string")
    return line_nodes(docs).select("doc_id", own.alias("block_id"), own.alias("node_ref"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), bare(F.col("content")).alias("text"))


def structural_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of documents (doc_id, format, text) by format: json, markdown, and any other as plain text."""
    of = lambda c: docs.where(c).select("doc_id", "text")
    json, errors = json_blocks(of("format = 'json'"))
    plain = line_blocks(of("coalesce(format, '') not in ('json', 'markdown')"))
    return json.unionByName(markdown_blocks(of("format = 'markdown'"))).unionByName(plain), errors
