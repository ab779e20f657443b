"""Licence scans: identifier tags and notice phrases by one Aho-Corasick automaton, licence expressions by shunting yard.

Aho and Corasick, "Efficient string matching" (CACM 1975); operator precedence
parsing by Dijkstra's shunting yard. A text is folded once to its words with one
space between them; all phrases and tags are patterns of whole words, so that
one pass over the folded text finds every place of every pattern. Where a tag
ends, the expression behind it is read from the original text up to the end of
its line and evaluated: `or` takes the lesser duty, `and` the greater one, and a
known exception after `with` lowers the duty by one.

A map over rows without any shuffle: no group exists that could be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the query's contract: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices: phrase, label and how much a place of it says.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "bsd license": ("bsd", 0.6),
    "isc license": ("isc", 0.6),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.6),
    "cc by": ("cc-by", 0.5),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0": ("cc0", 0.6),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT = 0.7
#: Tags behind which an expression stands, as words, and whether one is strict, that is, a tag whatever follows.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}
TAG_WEIGHT = 0.95
#: Identifiers of licences by duty, as the SPDX list names them: 0 none, 1 notice, 2 weak copyleft, 3 strong, 4 network or use limits.
IDS = {
    0: "0bsd cc0-1.0 mit-0 unlicense wtfpl".split(),
    1: "afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 isc mit ncsa openssl postgresql psf-2.0 python-2.0 zlib".split(),
    2: "cddl-1.0 cddl-1.1 epl-1.0 epl-2.0 lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 ofl-1.1".split(),
    3: "cc-by-sa-3.0 cc-by-sa-4.0 eupl-1.2 gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later".split(),
    4: "agpl-3.0 agpl-3.0-only agpl-3.0-or-later busl-1.1 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 sspl-1.0".split(),
}
DUTY = {name: duty for duty, names in IDS.items() for name in names}
EXCEPTIONS = {"autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0"}
DUTIES = ("none", "notice", "weak", "strong", "limits")
#: How tightly an operator binds.
BINDS = {"or": 1, "and": 2, "with": 3}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Between a tag and its expression: quotes of JSON and TOML, then a colon or an equals sign.
_MARK = re.compile(rb"[\"']?[ \t]*[:=][ \t]*")
_QUOTES = re.compile(rb"[\"']*")
_LINE = re.compile(rb"[\r\n]|\Z")
#: What an expression's line may have on besides, without ending it in words: the ends of comments, quotes, commas.
_REST = re.compile(rb"[\s\"',;.]*(\*/|-->|#\}|\})?[\s\"',;.]*$")


@dataclass
class Expression:
    """A licence expression in reverse Polish order, the identifiers it names, and the least duty that satisfies it."""

    rpn: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    duty: int = 0


def shunting_yard(tokens: list[str]) -> list[str] | None:
    """Operands and and/or/with in reverse Polish order, left to right among equals; null where the form is wrong."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether one must come next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(rpn: list[str]) -> Expression | None:
    """The duty and the identifiers; null where `with` joins what is no licence with an exception.

    An unknown licence has the greatest duty, as nothing else is safe; `+` after
    a name means that version or a later one.
    """
    held: list[tuple[int, str | None]] = []  # duty, and the name while it is one operand
    ids: list[str] = []
    for t in rpn:
        if t in BINDS:
            (db, b), (da, a) = held.pop(), held.pop()
            if t == "with":
                if a is None or b is None or "exception" not in b and b not in EXCEPTIONS:
                    return None
                ids.remove(b)
                held.append((max(0, da - 1) if b in EXCEPTIONS else da, None))
            else:
                held.append((min(da, db) if t == "or" else max(da, db), None))
        else:
            ids.append(t)
            held.append((DUTY.get(t.rstrip("+"), len(DUTIES) - 1), t))
    return Expression(rpn, ids, held[0][0])


def parse(text: bytes, at: int, end: int, strict: bool) -> Expression | None:
    """The expression that stands at `at`, before `end`, if one does.

    Under a strict tag the longest well-formed beginning counts, whatever names
    it has; behind a mere `license:` all names must be known and nothing but
    closing marks may follow, as prose stands there too.
    """
    tokens: list[str] = []
    best, stop, depth, operand, past = 0, at, 0, True, at
    # A beginning is well formed where operands and operators take turns and all brackets are closed.
    for m in _TOKEN.finditer(text, at, end):
        if text[past : m.start()].strip(b" \t"):
            break
        t, past = m.group().decode().lower(), m.end()
        t = t if t in "()" else t.rstrip(".:")
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t in BINDS and not operand:
            operand = True
        elif t and t not in BINDS and t not in "()" and operand:
            operand = False
        else:
            break
        tokens.append(t)
        if not operand and not depth:
            best, stop = len(tokens), past
    rpn = shunting_yard(tokens[:best]) if best else None
    found = evaluate(rpn) if rpn else None
    if found is None or not strict and (any(t.rstrip("+") not in DUTY for t in found.ids) or not _REST.match(text, stop, end)):
        return None
    return found


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase in phrases:
            out.add_word(f" {phrase} ", (kind, phrase, phrase.count(" ") + 1))
    out.make_automaton()
    return out


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, duty of one text."""
    words = text.translate(_FOLD).split()
    folded = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    doubt = 1.0
    tags: list[tuple[int, str]] = []
    seen: set[str] = set()
    before, upto = 0, 0  # spaces in the folded text up to a place: words that end there
    for end, (kind, phrase, n) in machine.iter(folded.decode("latin-1")):
        before, upto = before + folded.count(b" ", upto, end), end
        start = before - n
        if kind == "tag":
            tags.append((start + n, phrase))
            continue
        label, weight = (BASE[phrase], BASE_WEIGHT) if kind == "base" else NOTICES[phrase]
        if kind == "base":
            starts.append(start)
            base.add(label)
        labels.add(label)
        if phrase not in seen:  # a phrase's evidence counts once
            seen.add(phrase)
            doubt *= 1 - weight
    expressions: set[str] = set()
    duty: int | None = None
    if tags:
        at = {}
        wanted = {w for w, _ in tags}
        last = max(wanted)
        for i, m in enumerate(_WORD.finditer(text), 1):
            if i in wanted:
                at[i] = m.end()
            if i == last:
                break
        end = 0
        for after, phrase in tags:
            mark = _MARK.match(text, at[after])
            if not mark:
                continue
            if mark.end() > end:
                end = _LINE.search(text, mark.end()).start()
            found = parse(text, _QUOTES.match(text, mark.end(), end).end(), end, TAGS[phrase])
            if found:
                labels.update(found.ids)
                expressions.add(" ".join(found.rpn))
                duty = found.duty if duty is None else max(duty, found.duty)
                if "#" not in seen:
                    seen.add("#")
                    doubt *= 1 - TAG_WEIGHT
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1 - doubt,
        ";".join(sorted(expressions)),
        None if duty is None else DUTIES[duty],
    )


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, duty string"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the places of the base phrases, all labels, and what licence expressions ask for.

    doc_id, n_words, n_base (all places), first_word and last_word (their least
    and greatest first word, from 0; else null), base_labels and labels (distinct,
    sorted, comma-joined; empty without any), score (1 less the product of the
    doubts of all distinct phrases and of tags; 0 without any), expressions
    (distinct, in reverse Polish order, joined by `;`), duty (the greatest that an
    expression of the text leaves: one of DUTIES; null without expression).

    A null text counts as empty: 0 words, no label. Whole texts are read, of any
    length. Repeated rows stay and get the same; null ids stay null; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    Malformed expressions give no label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in batches:
            rows = [scan((t or "").encode("utf-8", "surrogatepass"), machine) for t in batch.column(1).to_pylist()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [c.split()[0] for c in _OUT.split(", ")])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, _OUT)
