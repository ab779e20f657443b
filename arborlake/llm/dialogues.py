"""Conversation structure repair by dynamic programming over grammar-compressed sequences.

A conversation is a word over the letters of its rows: the role's initial and
the fault. Larsson and Moffat, "Off-line dictionary-based compression" (Re-Pair,
Proc. IEEE 2000): the commonest pair of neighbouring symbols over all distinct
sequences becomes a rule, again and again. Each symbol has one transfer matrix
over the states of `(s?(ua)+)?` whose entries are the least cost and, as a rope,
the ASCII-least audit among equals; the product of two matrices adds costs and
joins ropes, so a rule's matrix is made once from those of its two parts, and
all conversations share it.

No two audits of the same rows and cost are one the beginning of the other, as
each has one letter a row and the inserts cost something; so the least of two
joined ropes is made of the least parts, and one rope an entry is enough.

Rows are sorted over all tasks by conversation and turn; a task makes sequences
of at most SEGMENT rows, so that a conversation of any length is dealt to many.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, keep
from .skew import attach

#: States: nothing yet, after s, after u, after a. Nothing or a may end.
START, S, U, A = range(4)
FINAL = (START, A)
#: What a role may be in each state, and the state after it.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: Fixed values of the contract: what edits cost.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
SPEAKERS = {"u": "user", "a": "assistant"}
#: Letters of a row: initial s, u, a or another; as it is, truncated (upper case) or to be deleted (digits).
FINE, CUT, GONE = "suao", "SUAO", "0123"
#: Rows of a sequence, rules of the grammar, and rules that one pass over all sequences adds.
SEGMENT, MOST_RULES, PER_PASS = 4096, 192, 16
_RULE = 0x4E00  # rules are the characters from here on

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def letters(rope: Rope) -> str:
    """The rope written out."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += [x[1], x[0]]
    return "".join(out)


def _less(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    if b is None or a[0] != b[0]:
        return b is None or a[0] < b[0]
    return a[1] is not b[1] and letters(a[1]) < letters(b[1])


def product(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: the cheapest way through x and then y, by start and end."""
    out: Matrix = {}
    for (i, k), (c, r) in x.items():
        for j in range(4):
            then = y.get((k, j))
            if then is not None:
                way = c + then[0], (r, then[1]) if r and then[1] else r or then[1]
                if _less(way, out.get((i, j))):
                    out[i, j] = way
    return out


def _inserts() -> Matrix:
    """No insert, or those that are the shortest way to another state."""
    out: Matrix = {(i, i): (0, "") for i in range(4)}
    for i in range(4):
        at, n = i, 0
        for _ in range(3):
            at, n = NEXT[at, "a" if at == U else "u"], n + 1
            if (i, at) not in out:
                out[i, at] = n * INSERT, "I" * n
    return out


INSERTS = _inserts()


def row_matrix(letter: str) -> Matrix:
    """Of one row: inserts before it, then Keep, Rerole or Delete."""
    kind = next(k for k, s in enumerate((FINE, CUT, GONE)) if letter in s)
    initial = "suao"[(FINE, CUT, GONE)[kind].index(letter)]
    extra = TRUNCATED if kind == 1 else 0
    ways: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if kind < 2:
        for i in range(4):
            turn = "a" if i == U else "u"
            ways[i, NEXT[i, turn]] = REROLE + extra, "R"
        for i in range(4):
            if (i, initial) in NEXT:
                ways[i, NEXT[i, initial]] = KEEP + extra, "K"
    return product(INSERTS, ways)


class Grammar:
    """Rules in the order they were made, and the matrix of every symbol."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrix: dict[str, Matrix] = {x: row_matrix(x) for x in FINE + CUT + GONE}

    def add(self, pair: str) -> None:
        new = chr(_RULE + len(self.rules))
        self.rules.append((pair, new))
        self.matrix[new] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def encode(self, seq: str) -> str:
        for pair, new in self.rules:
            if len(seq) < 2:
                break
            seq = seq.replace(pair, new)
        return seq

    def evaluate(self, seq: str) -> Matrix:
        """The matrix of a sequence, by halves of its symbols."""
        parts = [self.matrix[x] for x in self.encode(seq)]
        while len(parts) > 1:
            parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else {(i, i): (0, "") for i in range(4)}


def learn(sequences: DataFrame, most: int = MOST_RULES, per_pass: int = PER_PASS) -> Grammar:
    """Re-Pair over all rows (seq, n) of distinct sequences with their numbers.

    A pass counts the pairs of all sequences as the rules so far write them and
    makes rules of the commonest, of which none shares a symbol with a commoner
    one. Pairs number at most (symbols)^2. `most` bounds the grammar; symbols
    beyond it stay unpaired, which changes no result.
    """
    grammar = Grammar()
    while len(grammar.rules) < most:
        rules = grammar

        def pairs(batches: Iterator[pa.RecordBatch], g: Grammar = rules) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for seq, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    code = g.encode(seq)
                    i = 0
                    while i + 1 < len(code):
                        found[code[i : i + 2]] += n
                        i += 2 if code[i : i + 3] == code[i] * 3 else 1  # places that overlap count once
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

        counts = sequences.select("seq", "n").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        used: set[str] = set()
        before = len(grammar.rules)
        for row in counts.orderBy(F.desc("n"), "pair").limit(4 * per_pass).collect():
            if not used & set(row.pair) and len(grammar.rules) < min(most, before + per_pass):
                used |= set(row.pair)
                grammar.add(row.pair)
        if len(grammar.rules) == before:
            break
    return grammar


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the contract's damage, as (conv, turn, role, text); conv is the id as text, behind `=`, or empty."""
    conv, turn = (F.col(c).cast("string") for c in ("conv_id", "turn"))
    src = rows.select(
        F.coalesce(F.concat(F.lit("="), conv), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(F.concat(F.coalesce(conv, F.lit(" ")), F.lit(":"), F.coalesce(turn, F.lit(" ")))) % 20).alias("_harm"),
    )
    text = F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_harm") == 3, 2).otherwise(1)
    return src.where("_harm > 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


#: Order of a conversation's rows: equal turns by role and text, so that copies are neighbours.
ORDER = ("conv", "turn", "role", "mark")


def _marked(rows: DataFrame) -> DataFrame:
    """Adds mark, a digest of the text in place of it."""
    return rows.withColumn("mark", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows by ORDER with their number n, blank, truncated, and again: whether an earlier turn has role and text.

    Equal rows are counted before anything else; keys of (conversation, role,
    text) with many turns are met by broadcast.
    """
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    each = _marked(rows).select(*ORDER, blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    each = keep(each.groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turns")
    key = ["conv", "role", "mark"]
    turn = F.struct("turn")  # a null comes first
    firsts = each.groupBy(*key).agg(F.min(turn).alias("_first"), F.count("*").alias("_turns")).where("_turns > 1")
    repeated = attach(each, firsts, key, "_turns", each.count(), how="left")
    return repeated.select(*each.columns, F.coalesce(F.col("_first") < turn, F.lit(False)).alias("again"))


_SEGMENT = "conv string, seg long, seq string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, from_turn long, to_turn long, turns long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to sequences of at most SEGMENT rows of one conversation, with their sums and their ends."""
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _SEGMENT.split(", ")]
    task = TaskContext.get().partitionId() << 40
    now: dict | None = None
    done: list[dict] = []
    number = 0

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in zip(names, types, strict=True)], names)
        done.clear()
        return b

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "n", "blank", "truncated", "again")]
        for conv, turn, role, n, blank, truncated, again in zip(*cols, strict=True):
            initial = role[:1]
            i = "sua".find(initial) if initial else -1
            while n:
                if now is None or now["conv"] != conv or len(now["seq"]) >= SEGMENT:
                    if now is not None:
                        now["seq"] = "".join(now["seq"])
                        done.append(now)
                    now = {"conv": conv, "seg": task + number, "seq": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": None, "low": turn, "high": turn, "from_turn": turn, "to_turn": turn, "turns": 0}
                    number += 1
                take = min(n, SEGMENT - len(now["seq"]))
                # Of equal rows the first is what it is, the others are duplicates.
                kinds = [GONE if blank or again else CUT if truncated else FINE] + [GONE] * (take - 1)
                now["seq"] += [k[i] for k in kinds]
                now["blank"] += take if blank else 0
                now["duplicate"] += 0 if blank else take if again else take - 1
                now["truncated"] += 0 if blank or again else int(truncated)
                now["illegal"] += int(now["last"] is not None and now["last"] + initial not in ("su", "ua", "au")) + (take - 1)
                if turn is not None:
                    now["turns"] += 1 if now["to_turn"] != turn or not now["turns"] else 0
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = now["to_turn"] = turn
                now["last"] = initial
                again, n = True, n - take
        if len(done) >= 1000:
            yield out()
    if now is not None:
        now["seq"] = "".join(now["seq"])
        done.append(now)
    yield out()


_TABLE = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, with their matrices, to conversations. Only the cheapest ways from the start are carried on."""
    names = [c.split()[0] for c in _TABLE.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _TABLE.split(", ")]
    done: list[tuple] = []
    now: dict | None = None

    def close() -> None:
        ways = product(now["ways"], INSERTS)
        best = min((ways[START, j][0], letters(ways[START, j][1])) for j in FINAL if (START, j) in ways)
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        done.append((now["conv"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], *best))

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv"] != r["conv"]:
                if now is not None:
                    close()
                now = {"conv": r["conv"], "ways": {(START, START): (0, "")}, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "turns": 0, "last": None}
            if r["seq"] is None:  # of an id that lost all rows, or that has segments besides
                continue
            now["ways"] = product(now["ways"], {(w["i"], w["j"]): (w["cost"], w["audit"]) for w in r["ways"]})
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            if now["last"] is not None and now["last"] + r["first"] not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = r["last"]
            if r["high"] is not None:
                now["turns"] += r["turns"] - (now["high"] == r["low"])
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = r["high"]
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
    if now is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)


def _evaluated(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds to (seq, n) the ways through each distinct sequence."""
    shared = sequences.sparkSession.sparkContext.broadcast(grammar)  # bounded: MOST_RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            ways = [[{"i": i, "j": j, "cost": c, "audit": letters(r)} for (i, j), (c, r) in sorted(g.evaluate(s).items())] for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ways, kind)], ["seq", "n", "ways"])

    return sequences.select("seq", "n").mapInArrow(run, "seq string, n long, ways array<struct<i: int, j: int, cost: long, audit: string>>")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation first its audit and then its rows in order: (conv, repaired_sha256). Texts pass by one at a time."""
    done: list[tuple[str, str]] = []
    now: list | None = None  # conversation, audit, place in it, state, digest, whether a line was written

    def step(row: tuple[str, str] | None) -> None:
        """Performs the edits up to and including that of `row`; without one, the inserts at the end."""
        while now[2] < len(now[1]):
            edit = now[1][now[2]]
            if edit != "I" and row is None:
                raise RuntimeError("more edits than rows")
            now[2] += 1
            if edit != "D":
                turn = row[0][:1] if edit == "K" else "a" if now[3] == U else "u"
                role, text = (row[0] if edit == "K" else SPEAKERS[turn]), ("" if edit == "I" else row[1])
                now[3] = NEXT[now[3], turn]
                now[4].update((("\n" if now[5] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                now[5] = True
            if edit != "I":
                return

    def close() -> None:
        step(None)
        done.append((now[0], now[4].hexdigest()))

    for batch in batches:
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
            if audit is not None:
                if now is not None:
                    close()
                now = [conv, audit, 0, START, hashlib.sha256(), False]
            else:
                step((role, text))
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])
            done.clear()
    if now is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation: one row per distinct conv of `ids`.

    rows(conv, turn, role, text) have no nulls but in turn. conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256, as the contract
    has them; rows with equal turns stand by role and by a digest of the text.
    Conversations without rows have zeros, an empty audit and the hash of the
    empty string.

    A text's SHA-256 is made in the order of the text, so one task reads a
    conversation's rows at the end, sorted, one at a time, and its audit is one
    string; all else of a long conversation is dealt to many tasks.
    """
    segments = keep(faults(rows).repartitionByRange(*[F.col(c) for c in ORDER]).sortWithinPartitions(*ORDER).mapInArrow(_segments, _SEGMENT), "segments")
    sequences = keep(segments.groupBy("seq").agg(F.count("*").alias("n")), "sequences")
    ways = _evaluated(sequences, learn(sequences))
    met = attach(segments, ways, ["seq"], "n", segments.count()).drop("n", "from_turn", "to_turn")
    none = ids.distinct().select("conv", *[F.lit(None).cast(t).alias(c) for c, t in met.dtypes if c != "conv"])
    met = met.unionByName(none.select(met.columns))
    table = keep(met.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_fold, _TABLE), "audits")
    head = table.select("conv", "audit", F.lit(0).alias("_row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("text"))
    body = _marked(rows).select("conv", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("_row"), "turn", "role", "mark", "text")
    lined = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "_row", "turn", "role", "mark").select("conv", "audit", "role", "text")
    hashes = lined.mapInArrow(_hash, "conv string, repaired_sha256 string")
    out = keep(table.join(hashes, "conv"), "repaired")
    for t in (segments, sequences, table):
        drop(t)
    return out


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The contract: conversations(conv_id, turn, role, text) are damaged and repaired; one row per distinct conv_id.

    conv_id (in its own type), gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. A null id is a conversation of its own; nulls of role
    and text are one space, null turns come first; a role that begins with none
    of s, u, a can only be changed or deleted. Texts of any length are read
    whole. Repeated rows are duplicates. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    kind = conversations.schema["conv_id"].dataType
    ids = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"))
    out = repair(damage(conversations), ids)
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)
    return out.select(conv_id.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
