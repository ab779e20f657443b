"""Lines and paragraphs of texts as rows, line ranges, and texts made of them again."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.settle import dealt

#: A line with its end; `unicode` also ends lines at the other breaks of Unicode.
STRICT = r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"
#: A run of lines that are not blank, or of blank ones, or blanks at the end of a text.
RUNS = re.compile(rb"((?: *+[^ \r\n][^\r\n]*+(?:\r\n|\n|\r|\Z))++)|(?: *+(?:\r\n|\n|\r))++| ++\Z")
UNICODE = "[^\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|[^\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+$"


def line_array(text: Column, terminators: str = "strict") -> Column:
    return F.regexp_extract_all(text, F.lit(STRICT if terminators == "strict" else UNICODE), F.lit(0))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, "(?:\r\n|\n|\r)$", "")


def line_nodes(docs: DataFrame, terminators: str = "strict") -> DataFrame:
    """(doc_id, line, content): lines from 1 with their ends; together they are the text."""
    return docs.select("doc_id", F.posexplode(line_array(F.col("text"), terminators)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def render(lines: DataFrame, order: str = "line") -> DataFrame:
    """The text of each document from its rows in order."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, "content"))).alias("_r"))
    return rows.select("doc_id", F.array_join(F.transform("_r", lambda r: r["content"]), "").alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Runs of lines that are not blank: (doc_id, index, line_start, line_end, text)."""
    w = W.partitionBy("doc_id").orderBy("line")
    blank = F.trim(bare(F.col("content"))) == ""
    rows = lines.withColumn("_b", blank).withColumn("_s", (~F.col("_b") & F.coalesce(F.lag("_b").over(w), F.lit(True))).cast("int"))
    rows = rows.withColumn("index", F.sum("_s").over(w) - 1).where("not _b")
    got = rows.groupBy("doc_id", "index").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.array_sort(F.collect_list(F.struct("line", "content"))).alias("_r"))
    return got.select("doc_id", "index", "line_start", "line_end", F.array_join(F.transform("_r", lambda r: r["content"]), "").alias("text"))


def text_paragraphs(docs: DataFrame) -> DataFrame:
    """paragraphs(line_nodes(docs)) read off each text (doc_id, text), with no line as a row and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, start, end, texts, size = [], [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(index, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(texts, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "index", "line_start", "line_end", "text"])

            for i, text in enumerate(batch.column("text")):
                line, k = 0, 0
                for found in RUNS.finditer(text.as_py() or b""):
                    part = found[0]
                    ends = part.count(b"\n") + part.count(b"\r") - part.count(b"\r\n")
                    if found[1]:
                        at.append(i)
                        index.append(k)
                        start.append(line + 1)
                        end.append(line + ends + (part[-1] not in b"\r\n"))
                        texts.append(part)
                        size, k = size + len(part), k + 1
                    line += ends
                if size > 1 << 24:
                    yield rows()
                    at, index, start, end, texts, size = [], [], [], [], [], 0
            yield rows()

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, index long, line_start int, line_end int, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def fixed_blocks(lines: DataFrame, size: int) -> DataFrame:
    """Blocks of `size` lines, and half as large ones nested in them: (doc_id, block_id, start_line, end_line)."""
    out = []
    for name, n in (("b", size), ("h", max(1, size // 2))):
        k = F.floor((F.col("line") - 1) / n)
        out.append(lines.groupBy("doc_id", k.alias("k")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).select("doc_id", F.concat(F.lit(name), F.col("k").cast("string")).alias("block_id"), "start_line", "end_line"))
    return out[0].unionByName(out[1])


def _sweep(points: DataFrame, blocks: DataFrame, exact: bool) -> DataFrame:
    """points(doc_id, point, lo, hi) with block_id, start_line and end_line of the block around each, or nulls.

    A document's blocks and points pass by in the order of their first lines, with
    the blocks that are open at that line held by their span, so that no block
    meets all points and none is spread over its lines.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    b = blocks.select("doc_id", F.col("start_line").cast("long").alias("lo"), F.lit(0).alias("side"), F.col("end_line").cast("long").alias("hi"), F.lit(None).cast(kind(points, "point")).alias("point"), "block_id")
    p = points.select("doc_id", F.col("lo").cast("long").alias("lo"), F.lit(1).alias("side"), F.col("hi").cast("long").alias("hi"), "point", F.lit(None).cast(kind(blocks, "block_id")).alias("block_id"))
    rows = dealt(b.unionByName(p), "doc_id").sortWithinPartitions("doc_id", "lo", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, open_ = None, False, []  # (span, first line, block, last line) in order
        for batch in batches:
            out: list[tuple] = []
            for doc, lo, side, hi, point, block in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lo", "side", "hi", "point", "block_id")), strict=True):
                if not begun or doc != now:
                    now, begun, open_, most = doc, True, [], 64
                if side == 0:
                    insort(open_, (hi - lo, lo, block, hi))
                    if len(open_) > most:  # those that have ended go when there may be many
                        open_ = [x for x in open_ if x[3] >= lo]
                        most = max(64, 2 * len(open_))
                    continue
                best = None
                for x in open_:
                    if x[3] >= hi and (best is None or x[1] == lo and x[3] == hi):
                        best = x
                        if not exact or x[1] == lo and x[3] == hi:
                            break
                    if exact and best is not None and x[0] > hi - lo:
                        break
                out.append((doc, point, *((best[2], best[1], best[3]) if best else (None, None, None))))
            types = [batch.column("doc_id").type, batch.column("point").type, batch.column("block_id").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "point", "block_id", "start_line", "end_line"])

    return rows.mapInArrow(run, f"doc_id {kind(points, 'doc_id')}, point {kind(points, 'point')}, block_id {kind(blocks, 'block_id')}, start_line long, end_line long")


def smallest_enclosing(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of each point (doc_id, line) the block of least span that holds it, then of least start; else status LINE_NOT_FOUND."""
    once = points.select("doc_id", F.col("line").alias("point"), F.col("line").alias("lo"), F.col("line").alias("hi")).distinct()
    best = _sweep(once, blocks, False).select("doc_id", F.col("point").alias("line"), "block_id").where("block_id is not null")
    return points.join(best, ["doc_id", "line"], "left").withColumn("status", F.when(F.col("block_id").isNull(), "LINE_NOT_FOUND").otherwise("ok"))


def blocks_in_range(requests: DataFrame, blocks: DataFrame, exact: bool = True) -> DataFrame:
    """Per request (request_id, doc_id, lo, hi) the block of exactly these lines, else the smallest that holds them."""
    found = _sweep(requests.select("doc_id", F.struct("request_id", "lo", "hi").alias("point"), "lo", "hi"), blocks, exact)
    hit = (F.col("start_line") == F.col("point.lo")) & (F.col("end_line") == F.col("point.hi")) if exact else F.when(F.col("block_id").isNotNull(), True)
    return found.select("point.request_id", "block_id", hit.alias("is_exact"))


def text_search(blocks: DataFrame, lines: DataFrame, needle: str) -> DataFrame:
    """Blocks with a line that holds the needle, without those that lie around another such block.

    A block has as many hits as were counted up to its last line less those before its first.
    """
    ends = blocks.withColumn("_e", F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(side).alias("side")) for c, side in (("start_line", 0), ("end_line", 2))])))
    hits = lines.where(F.col("content").contains(needle)).select("doc_id", F.struct(F.col("line").cast("long").alias("at"), F.lit(1).alias("side")).alias("_e"))
    both = ends.unionByName(hits, allowMissingColumns=True)
    seen = F.sum((F.col("_e.side") == 1).cast("int")).over(W.partitionBy("doc_id").orderBy("_e.at", "_e.side").rowsBetween(W.unboundedPreceding, 0))
    counted = both.withColumn("_n", seen).where("_e.side <> 1")
    found = counted.groupBy(*blocks.columns).agg((F.max("_n") - F.min("_n")).alias("_hits")).where("_hits > 0").drop("_hits")
    later = W.partitionBy("doc_id").orderBy(F.desc("start_line")).rangeBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("doc_id", "start_line")
    found = found.withColumn("_later", F.min("end_line").over(later)).withColumn("_same", F.min("end_line").over(same))
    return found.where("(_later is null or _later > end_line) and _same = end_line").drop("_later", "_same")


def enrich_matches(matches: DataFrame, blocks: DataFrame, max_rows: int) -> DataFrame:
    """Of matches (doc_id, line) the first max_rows of a document get their block; the others the status skipped_budget."""
    w = W.partitionBy("doc_id").orderBy("line")
    rows = matches.withColumn("_k", F.row_number().over(w))
    inside = smallest_enclosing(rows.where(F.col("_k") <= max_rows), blocks)
    inside = inside.withColumn("status", F.when(F.col("status") == "ok", "enriched").otherwise("skipped_extractor_error"))
    rest = rows.where(F.col("_k") > max_rows).withColumn("block_id", F.lit(None).cast("string")).withColumn("status", F.lit("skipped_budget"))
    return inside.unionByName(rest, allowMissingColumns=True).select("doc_id", "line", "block_id", "status")


def take_slice(df: DataFrame, by: str, order: str, start: int | None, stop: int | None) -> DataFrame:
    """Rows start:stop of each group in order; either side open, negative ones from the end."""
    w = W.partitionBy(by)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda v, default: default if v is None else F.greatest(F.lit(0), F.col("_n") + v) if v < 0 else F.lit(v)
    return df.where((F.col("_i") >= at(start, F.lit(0))) & (F.col("_i") < at(stop, F.col("_n")))).drop("_i", "_n")


def line_window(lines: DataFrame, offset: int, max_lines: int, max_chars: int) -> DataFrame:
    """Per document lines offset.. (from 0), cut to max_chars with `…`; total, returned, has_more, next_offset."""
    some = lines.where((F.col("line") > offset) & (F.col("line") <= offset + max_lines)).withColumn("content", bare(F.col("content")))
    text = some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda r: r["content"]), "\n").alias("t"), F.count("*").alias("returned"))
    total = lines.groupBy("doc_id").agg(F.count("*").alias("total"))
    out = total.join(text, "doc_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0))).withColumn("t", F.coalesce("t", F.lit("")))
    more = F.lit(offset) + F.col("returned") < F.col("total")
    cut = F.when(F.length("t") > max_chars, F.concat(F.substring("t", 1, max_chars), F.lit("…"))).otherwise(F.col("t"))
    return out.select("doc_id", cut.alias("text"), "total", "returned", more.alias("has_more"), F.when(more, F.lit(offset) + F.col("returned")).alias("next_offset"))


def char_page(text: Column, offset: int, max_chars: int) -> list[Column]:
    total = F.length(text)
    at = F.least(F.lit(offset), total)
    more = at + max_chars < total
    return [F.substring(text, at + 1, F.lit(max_chars)).alias("chunk"), total.alias("total"), more.alias("has_more"), F.when(more, at + max_chars).alias("next_offset")]


def utf8_prefix(text: Column, n: int) -> Column:
    """As many whole characters as fit in n bytes."""
    raw = F.encode(text, "utf-8")
    return F.when(F.length(raw) <= n, text).otherwise(F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(min(4, n + 1))]))


def dominant_terminator(lines: DataFrame) -> DataFrame:
    """Per document the commonest line end, on a tie the one seen first; LF where there is none."""
    end = F.regexp_extract("content", "(\r\n|\n|\r)$", 1)
    each = lines.withColumn("_t", end).groupBy("doc_id", "_t").agg(F.count("*").alias("n"), F.min("line").alias("at"))
    name = F.create_map(*[F.lit(x) for kv in {"\r\n": "CRLF", "\n": "LF", "\r": "CR"}.items() for x in kv])
    best = each.where("_t <> ''").groupBy("doc_id").agg(F.max_by(F.element_at(name, F.col("_t")), F.struct("n", -F.col("at"))).alias("terminator"))
    return lines.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("terminator", F.lit("LF")).alias("terminator"))


def bracket_range(spec: Column, total: Column) -> list[Column]:
    """Of `[n]`, `[a,b]`, `[:b]`, `[a:]` first and last line, or an error."""
    s = F.regexp_replace(spec, r"\s", "")
    num = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("int")
    start = F.coalesce(num(r"^\[(\d+)\]$"), num(r"^\[(\d+),\d+\]$"), num(r"^\[(\d+):\]$"), F.when(s.rlike(r"^\[:\d+\]$"), 1))
    end = F.coalesce(num(r"^\[(\d+)\]$"), num(r"^\[\d+,(\d+)\]$"), num(r"^\[:(\d+)\]$"), F.when(s.rlike(r"^\[\d+:\]$"), total))
    bad = F.when(start.isNull() | end.isNull(), "BAD_SYNTAX").when(start < 1, "BELOW_ONE").when(end < start, "REVERSED").when(end > F.coalesce(total, end), "BEYOND_END")
    return [F.when(bad.isNull(), start).alias("start"), F.when(bad.isNull(), end).alias("end"), bad.alias("error")]


def edit_ranges(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Line ranges (doc_id, lo, hi, replacement or null) of the lines before any edit, replaced or deleted at once.

    Ranges must not overlap (see overlaps()). Returns (doc_id, sort, content) with
    sort = (line, 0) for lines that stay and (lo, k) for the new ones.
    """
    covered = edits.select("doc_id", F.explode(F.sequence("lo", "hi")).alias("line"))
    stay = lines.join(covered, ["doc_id", "line"], "left_anti").select("doc_id", F.struct(F.col("line"), F.lit(0).alias("k")).alias("sort"), "content")
    new = edits.where("replacement is not null").select("doc_id", "lo", F.posexplode(line_array(F.col("replacement"))).alias("k", "content"))
    return stay.unionByName(new.select("doc_id", F.struct(F.col("lo").alias("line"), F.col("k")).alias("sort"), "content"))


def overlaps(ranges: DataFrame, by: str = "doc_id") -> DataFrame:
    """Ranges (by, lo, hi) that share a line with an earlier one of their group."""
    w = W.partitionBy(by).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("_m", F.max("hi").over(w)).where("_m >= lo").drop("_m")


def merge_ranges(ranges: DataFrame, by: str = "doc_id") -> DataFrame:
    """Ranges that overlap or touch, as one."""
    w = W.partitionBy(by).orderBy("lo", "hi")
    rows = ranges.withColumn("_m", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_g", F.sum((F.col("_m").isNull() | (F.col("lo") > F.col("_m") + 1)).cast("int")).over(w))
    return rows.groupBy(by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def text_anchor(line: Column, last: bool = False) -> Column:
    """The first (or last) 5 characters of a line that are not white space."""
    s = F.regexp_replace(line, r"\s", "")
    return F.right(s, F.lit(5)) if last else F.left(s, F.lit(5))


def with_trailing_newline(text: Column) -> Column:
    return F.when(text == "", "\n").when(text.endswith("\n"), text).otherwise(F.concat(F.regexp_replace(text, "[\r\n]+$", ""), F.lit("\n")))


def restore_terminators(texts: DataFrame, terminators: DataFrame) -> DataFrame:
    """texts(doc_id, text) with all line ends as terminators(doc_id, terminator: LF, CRLF or CR) says; LF where it says nothing."""
    ends = F.create_map(*[F.lit(x) for kv in {"CRLF": "\r\n", "LF": "\n", "CR": "\r"}.items() for x in kv])
    j = texts.join(terminators, "doc_id", "left").withColumn("_e", F.coalesce(F.element_at(ends, F.col("terminator")), F.lit("\n")))
    return j.withColumn("text", F.replace(F.regexp_replace("text", "\r\n|\r", "\n"), F.lit("\n"), F.col("_e"))).select(texts.columns)


def prefixed(lines: DataFrame) -> DataFrame:
    """lines with `prefixed`: `[n] ` filled on the left to the width that the document's last number needs, then the line without its end."""
    last = lines.groupBy("doc_id").agg(F.length(F.max("line").cast("string")).alias("_w"))
    mark = F.lpad(F.concat(F.lit("["), F.col("line").cast("string"), F.lit("] ")), F.col("_w") + 3, " ")
    return lines.join(last, "doc_id").withColumn("prefixed", F.concat(mark, bare(F.col("content")))).drop("_w")
