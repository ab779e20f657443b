"""Language identification by words first, with backoff to shorter and shorter character n-grams.

A word seen in training scores by the log frequency that it has in each
language. An unseen word scores by its character n-grams of the greatest length
of which any was seen, down to single characters; the mean of their log
frequencies stands for the word. The language with the greatest sum over all
words of the whole text is predicted.

Words are a letter and the letters and marks that follow it, lower-cased. Words
and n-grams are known by 64-bit hashes, and all of a batch are scored together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textops
from .scratch import drop, keep

UNKNOWN = "und"
#: Most training rows (those of which id and text have the smallest hashes); all their words and n-grams are kept.
FIT_ROWS = 20_000
LENGTHS = (4, 3, 2, 1)
#: Words in training as often as this are known.
LEAST_WORDS = 3
OPEN, CLOSE = ord("<"), ord(">")


class Words:
    """The words of some texts: hashes, the text each is of, and the bytes of each."""

    def __init__(self, texts: pa.Array):
        plain = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}]+", " ")
        self.data, offsets = textops.buffers(pc.replace_substring_regex(plain, r"(^| )\p{M}+", " "))  # no word begins with a mark
        self.starts, self.ends, first = textops.words(self.data, offsets)
        self.hashes = textops.word_hashes(self.data, self.starts, self.ends, fold=False)
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def grams(self, some: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of the words at `some` by length the hashes of their n-grams and the word (its place in `some`) of each; words are marked at both ends, but for single characters."""
        raw = self.data.tobytes()
        marked = b"".join(b"<%b>" % raw[a:b] for a, b in zip(self.starts[some].tolist(), self.ends[some].tolist(), strict=True))
        points = np.frombuffer(marked.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        word = np.cumsum(points == OPEN) - 1
        for n in lengths:
            here = np.full(max(0, len(points) - n + 1), n, np.uint64)
            for j in range(n):
                here = textops.mix(here ^ points[j : j + len(here)])
            w = word[: len(here)]
            ok = w == word[n - 1 :] if n > 1 else (points != OPEN) & (points != CLOSE)
            yield n, here[ok], w[ok]


@dataclass
class Model:
    """By kind (0: words; else n-grams by their length) the hashes in order and per language their log frequencies."""

    langs: list[str]
    hashes: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    floor: np.ndarray

    def find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the places of those."""
        table = self.hashes[kind]
        if not len(table):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(table.searchsorted(h), len(table) - 1)
        known = table[at] == h
        return known, at[known]

    def score(self, words: Words) -> np.ndarray:
        """Per language the log frequency of each distinct word, and each word's place among these."""
        distinct, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        known, at = self.find(0, distinct)
        out = np.tile(self.floor, (len(distinct), 1))
        out[known] = self.logs[0][at]
        rest = np.flatnonzero(~known)
        if len(rest):
            open_ = np.ones(len(rest), bool)
            for n, h, w in words.grams(first[rest]):
                h, w = h[open_[w]], w[open_[w]]
                hit, at = self.find(n, h)
                w = w[hit]
                hits = np.bincount(w, minlength=len(rest))
                some = hits > 0
                for i in range(len(self.langs)):
                    out[rest[some], i] = np.bincount(w, self.logs[n][at, i], len(rest))[some] / hits[some]
                open_ &= ~some
        return out, place

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Of each text the language and its probability; UNKNOWN and 0 without text, letters or languages."""
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if self.langs and len(texts):
            words = Words(texts)
            each, place = self.score(words)
            total = np.stack([np.bincount(words.text, each[place, i], len(texts)) for i in range(len(self.langs))], axis=1)
            some = np.bincount(words.text, minlength=len(texts)) > 0
            best = total.argmax(1)  # ties: the first by code point
            names[some] = np.array(self.langs, object)[best[some]]
            scores[some] = (1 / np.exp(total - total.max(1, keepdims=True)).sum(1))[some]
        return names.tolist(), scores


def held_out(id_col: str = "doc_id"):
    """True of rows that no model learns from: crc32 of the id as text, modulo 4, is 2 (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of words (kind 0) and n-grams, summed over a slice of a batch."""
    for batch in batches:
        done = 0
        for part in textops.slices(batch.column("text")):
            langs = pc.dictionary_encode(batch.column("lang").slice(done, len(part)))
            done += len(part)
            words = Words(part)
            of = langs.indices.to_numpy()[words.text]
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(of == code)
                h, first, n = np.unique(words.hashes[mine], return_index=True, return_counts=True)
                found = [(0, h, n)]
                for k, g, w in words.grams(mine[first]):
                    g, back = np.unique(g, return_inverse=True)
                    found.append((k, g, np.bincount(back, n[w], len(g)).astype(np.int64)))
                for k, g, n in found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "kind", "key", "n"])


def sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, fit_rows: int) -> DataFrame:
    """(lang, text) of the `fit_rows` rows with the smallest hashes of id and text, so that copies of a text are no more likely in it, or out of it, than other rows (without an id column the text alone)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(*[F.col(c).cast("string") for c in (id_col, text_col) if c in docs.columns]).alias("_h")).dropna()
    top = rows.select("_h").orderBy("_h").limit(fit_rows)  # bounded, and hashes alone
    last = top.agg(F.max("_h").alias("h"), F.count("*").alias("n")).first()
    if last.n < fit_rows:
        return rows.select("lang", "text")
    under = rows.where(F.col("_h") < last.h)
    alike = rows.where(F.col("_h") == last.h).limit(fit_rows - under.count())  # rows alike: any of them
    return under.unionByName(alike).select("lang", "text")


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> Model:
    """Learns from rows whose text and language are not null.

    At most `fit_rows` rows, by the hash of id and text, which bounds what the
    driver and each task hold; of these all words of LEAST_WORDS or more and all n-grams.
    """
    kinds = (0, *LENGTHS)
    rows = sample(docs, lang_col, text_col, id_col, fit_rows)
    counts = keep(rows.mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "counts")
    known = counts.groupBy("kind", "key").agg(F.sum("n").alias("total")).where(f"kind > 0 or total >= {LEAST_WORDS}")
    got = counts.join(known.select("kind", "key"), ["kind", "key"]).toArrow()  # as many as the sample has
    drop(counts)
    langs = sorted(set(got["lang"].unique().to_pylist()))
    model = Model(langs, {}, {}, np.zeros(len(langs)))
    of = np.array([langs.index(x.as_py()) for x in got["lang"].unique()], np.int64)[pc.dictionary_encode(got["lang"].combine_chunks()).indices.to_numpy()] if langs else np.zeros(0, np.int64)
    kind, key, n = (got[c].to_numpy() for c in ("kind", "key", "n"))
    for k in kinds:
        mine = kind == k
        hashes, place = np.unique(key[mine].view(np.uint64), return_inverse=True)
        seen = np.zeros((len(hashes), len(langs)))
        np.add.at(seen, (place, of[mine]), n[mine])
        sums = seen.sum(0) + 0.5 * (len(hashes) + 1)
        model.hashes[k], model.logs[k] = hashes, np.log((seen + 0.5) / sums).astype(np.float32)
        model.floor = np.log(0.5 / sums)  # in the end of single characters
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1).

    UNKNOWN with score 0 where the text is null or has no letter, or the model
    knows no language. Of languages with equal sums the first by code point is
    predicted. Whole texts are read. Repeated rows stay and get the same; null
    ids stay null; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FIT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            done = 0
            for part in textops.slices(batch.column(1)):
                names, scores = m.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])
                done += len(part)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(id_col)), lang_col, text_col, id_col=id_col)
    return identify(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
