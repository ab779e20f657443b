"""Answers that depend on order: folds over sorted rows that pass through a task one by one.

No group is gathered. Where a group's state is small and its steps compose, a
long group is dealt to many tasks: rows are sorted over all of them, and a
stretch whose beginning lies in an earlier task gives, in place of a state, what
it makes of any state it may begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.settle import dealt, settle

#: Rows of a stretch that is summed up for any beginning; anchors that one task moves.
CHUNK = 4096
RECORD, UNDO, REDO, OTHER = range(4)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def replay_offsets(anchors: DataFrame, edits: DataFrame) -> DataFrame:
    """Spans (doc_id, anchor_id, start, length) after edits (doc_id, seq, start, end, new_length) in order.

    An edit that ends at or before the span shifts it; one at or after its end does nothing; one inside it
    changes its length; any other cuts it at the edit's start and makes it inexact. A document's edits pass by
    its anchors, CHUNK of them at a time; more anchors go to more tasks, each with its own copy of the edits. Anchors without a document are left out.
    """
    parts = anchors.groupBy("doc_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts"))
    a = anchors.join(parts, "doc_id").select("doc_id", F.pmod(F.xxhash64("anchor_id", "start", "length"), F.col("_parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(0).cast(_kind(edits, "seq")).alias("seq"), "anchor_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("end"), F.lit(0).cast("long").alias("new_length"))
    e = edits.join(parts, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(1).alias("kind"), "seq", F.lit(None).cast(_kind(anchors, "anchor_id")).alias("anchor_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new_length").cast("long").alias("new_length"))
    rows = dealt(a.unionByName(e), "doc_id", "part").sortWithinPartitions("doc_id", "part", "kind", "seq", "start", "end", "new_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, spans, types = None, [], None, None

        def moved() -> pa.RecordBatch:
            start, length, exact = arrays() if spans is None else spans
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(held), types[0]), pa.array([h[0] for h in held], types[1]), pa.array(start), pa.array(length), pa.array(exact)], ["doc_id", "anchor_id", "start", "length", "is_exact"])

        def arrays():
            return np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), np.ones(len(held), bool)

        for batch in batches:
            types = batch.column("doc_id").type, batch.column("anchor_id").type
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "part", "kind", "anchor_id", "start", "end", "new_length")]
            for doc, part, kind, anchor, start, end, size in zip(*cols, strict=True):
                if now != (doc, part):
                    if held:
                        yield moved()
                    now, held, spans = (doc, part), [], None
                if kind == 0:
                    held.append((anchor, start, end))
                    continue
                at, length, exact = spans or arrays()
                delta, stop = size - (end - start), at + length
                before, after = end <= at, start >= stop
                inside = ~before & ~after & (start >= at) & (end <= stop)
                cut = ~before & ~after & ~inside
                spans = (
                    np.where(before, at + delta, np.where(cut, np.minimum(at, start), at)),
                    np.where(before | after, length, np.where(inside, length + delta, np.maximum(length + delta, 0))),
                    exact & ~cut,
                )
        if held:
            yield moved()

    return rows.mapInArrow(run, f"doc_id {_kind(anchors, 'doc_id')}, anchor_id {_kind(anchors, 'anchor_id')}, start long, length long, is_exact boolean")


def _bends(values: np.ndarray, slope: int) -> tuple[list[int], list[int]]:
    """The function that has these values at 0, 1, ... and then goes on with `slope`: the places where its slope changes, and its values there."""
    steps = np.diff(values)
    at = np.flatnonzero(np.append(steps, slope) != np.append(1 - steps[:1] if len(steps) else 1 - slope, steps))
    at = np.union1d([0], at)
    return at.tolist(), values[at].tolist()


def _value(bends: tuple[list[int], list[int]], x: int, slope: int) -> int:
    """The value at x of a function as _bends gives it; slopes are 0 or 1."""
    places, values = bends
    i = int(np.searchsorted(places, x, "right")) - 1
    rises = values[i + 1] > values[i] if i + 1 < len(places) else slope
    return values[i] + (x - places[i] if rises else 0)


def _moved(at, length, code: int):
    return (length, np.maximum(at - 1, 0)) if code == UNDO else (length, np.minimum(at + 1, length)) if code == REDO else (at + 1, at + 1) if code == RECORD else (length, at)


def _summary(codes: list[int]) -> dict:
    """What a stretch of commands makes of any timeline of `length` with its cursor `at`.

    Before the first record a cursor of x ends at x + shift, but not below what
    0 and not above what `length` would end at (low, high, by length). The first
    record makes a tip of t = cursor + 1, and from there length and cursor follow
    from t alone (size, tip). Beyond as many steps as the stretch has commands,
    nothing can come to an end of the timeline any more, so the functions are
    known everywhere by their values up to there.
    """
    n = len(codes)
    first = codes.index(RECORD) if RECORD in codes else n
    grid = np.arange(n + 2, dtype=np.int64)
    low, high = np.zeros_like(grid), grid.copy()
    for c in codes[:first]:
        low, high = _moved(low, grid, c)[1], _moved(high, grid, c)[1]
    out = {"shift": codes[:first].count(REDO) - codes[:first].count(UNDO), "records": first < n, "low": _bends(low, 0), "high": _bends(high, 1)}
    length, at = grid, grid
    for c in codes[first + 1 :]:
        length, at = _moved(at, length, c)
    return out | {"size": _bends(length, 1), "tip": _bends(at, 1)}


def _applied(s: dict, length: int, at: int) -> tuple[int, int]:
    at = min(max(at + s["shift"], _value(s["low"], length, 0)), _value(s["high"], length, 1))
    return (_value(s["size"], at + 1, 1), _value(s["tip"], at + 1, 1)) if s["records"] else (length, at)


_FUNCTIONS = ("low", "high", "size", "tip")


def undo_cursor(commands: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session the timeline after commands (seq, command: record, undo or redo): its length and the cursor.

    Recording behind the tip drops the redo branch; undo at the start and redo at the tip do nothing. Commands
    are sorted over all tasks, so that a session of any length is dealt to many; each stretch that begins in
    another task is a function of the timeline (see _summary), and these are applied one after the other.
    """
    code = F.when(F.col("command") == "record", RECORD).when(F.col("command") == "undo", UNDO).when(F.col("command") == "redo", REDO).otherwise(OTHER)
    rows = commands.select(by, "seq", code.alias("code"), F.col("command").isNull().alias("_null"), "command")
    order = [by, "seq", "command"]
    rows = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(by, "code")
    kind = _kind(commands, by)
    fields = [f"{f}_{x}" for f in _FUNCTIONS for x in "xy"]
    schema = f"{by} {kind}, part long, number long, known boolean, length long, at long, shift long, records boolean, " + ", ".join(f"{f} array<long>" for f in fields)
    names = [by, "part", "number", "known", "length", "at", "shift", "records", *fields]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        session, known, length, at, codes, number, begun = None, part == 0, 0, 0, [], 0, False
        done, type_ = [], None

        def put() -> None:
            nonlocal number
            if known:
                done.append((session, part, number, True, length, at, None, None, *[None] * 8))
            elif codes:
                s = _summary(codes)
                done.append((session, part, number, False, None, None, s["shift"], s["records"], *[x for f in _FUNCTIONS for x in s[f]]))
            number += 1

        def out() -> pa.RecordBatch:
            types = [type_, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 8]
            b = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return b

        for batch in batches:
            type_ = batch.column(0).type
            for name, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or name != session:
                    if begun:
                        put()
                        known = True  # only a task's first session may have begun elsewhere
                    session, length, at, codes, begun = name, 0, 0, [], True
                if known:
                    length, at = (at + 1, at + 1) if c == RECORD else (length, max(at - 1, 0)) if c == UNDO else (length, min(at + 1, length)) if c == REDO else (length, at)
                else:
                    codes.append(c)
                    if len(codes) == CHUNK:
                        put()
                        codes = []
            if len(done) >= 1000:
                yield out()
        if begun:
            put()
        if done:
            yield out()

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, begun = None, (0, 0), False
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if not begun or r[by] != session:
                    if begun:
                        done.append((session, *state))
                    session, state, begun = r[by], (0, 0), True
                state = (r["length"], r["at"]) if r["known"] else _applied({f: (r[f"{f}_x"], r[f"{f}_y"]) for f in _FUNCTIONS} | {"shift": r["shift"], "records": r["records"]}, *state)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.column(0).type), *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]], [by, "length", "at"])
            last = batch.column(0).type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([session], last), *[pa.array([x], pa.int64()) for x in state]], [by, "length", "at"])

    pieces = settle(rows.mapInArrow(stretches, schema))
    ends = pieces.repartition(by).sortWithinPartitions(by, "part", "number").mapInArrow(applied, f"{by} {kind}, length long, at long")
    return ends.select(by, F.col("length").cast("int").alias("length"), F.col("at").cast("int").alias("at"), (F.col("at") > 0).alias("can_undo"), (F.col("at") < F.col("length")).alias("can_redo"))


def merge_short_ids(incoming: DataFrame, taken: DataFrame) -> DataFrame:
    """In order of seq each node keeps its candidate if it is free, else gets the next number.

    incoming: (doc_id, seq, node_id, candidate); taken: (doc_id, used array, next_short_id). An earlier
    allocation can take what a later node wanted, so that a document's nodes pass by in order; what is held of
    them is the set of its numbers.
    """
    head = taken.select("doc_id", F.lit(0).alias("kind"), F.lit(0).cast(_kind(incoming, "seq")).alias("seq"), F.lit(None).cast(_kind(incoming, "node_id")).alias("node_id"), F.col("next_short_id").cast("long").alias("candidate"), F.col("used").cast("array<bigint>").alias("used"))
    body = incoming.select("doc_id", F.lit(1).alias("kind"), "seq", "node_id", F.col("candidate").cast("long").alias("candidate"), F.lit(None).cast("array<bigint>").alias("used"))
    rows = dealt(head.unionByName(body), "doc_id").sortWithinPartitions("doc_id", "kind", "seq", "node_id", "candidate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, next_, begun = None, set(), 1, False
        for batch in batches:
            out: list[tuple] = []
            for doc, kind, node, candidate, had in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "node_id", "candidate", "used")), strict=True):
                if not begun or doc != now:
                    now, used, next_, begun = doc, set(), 1, True
                if kind == 0:
                    used, next_ = set(had or ()), 1 if candidate is None else candidate
                    continue
                got = candidate if candidate is not None and candidate > 0 and candidate not in used else next_
                used.add(got)
                next_ = max(next_, got + 1)
                out.append((doc, node, got))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column("doc_id").type), pa.array([r[1] for r in out], batch.column("node_id").type), pa.array([r[2] for r in out], pa.int64())], ["doc_id", "node_id", "short_id"])

    return rows.mapInArrow(run, f"doc_id {_kind(incoming, 'doc_id')}, node_id {_kind(incoming, 'node_id')}, short_id long")
