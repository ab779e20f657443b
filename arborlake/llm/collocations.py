"""Phrase collocations over a dictionary of chunks by prefix-free parsing.

Boucher et al., "Prefix-free parsing for building big BWTs" (Algorithms for
Molecular Biology 2019). A window of OVERLAP words whose hash is divisible by
TRIGGER ends one chunk and begins the next, so that texts with the same passage
have the same chunks there, and neighbours share OVERLAP words. The dictionary
holds each distinct chunk of a language once with the number of its places. A
phrase of up to OVERLAP + 1 words belongs to the chunk where it begins before
the shared words (in a text's last chunk: anywhere), so each occurrence counts
once, and phrases are counted inside distinct chunks with these numbers.

Phrases are counted by length: of a longer one only where all its parts of one
word less may be frequent enough, which bitmaps of a fixed size tell, without
ever denying a frequent one. Where they fill up, more phrases are counted than
needed; results are exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from . import textops
from .scratch import drop, keep
from .skew import attach

#: Longest phrase, fewest occurrences and rows of a language.
MOST_WORDS, LEAST, TOP = 5, 100, 2000
#: Words that neighbouring chunks share; one window in TRIGGER ends a chunk.
OVERLAP, TRIGGER = MOST_WORDS - 1, 32
#: Bits of the bitmap of each phrase length; it is broadcast (2 MB).
BITS = 1 << 24
NO_LANG = "und"
#: Bytes by class: 0 of words, 1 white space, 2 ends of pieces; A-Z fall to a-z.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class Text:
    """The words of some texts, written with one byte behind each: a space, or a line feed where the piece ends."""

    def __init__(self, texts: pa.Array):
        raw, offsets = textops.buffers(texts)
        raw = textops.LOWER[raw]
        kind = _KIND[raw]
        # Words as runs outside white space and ends: both look like a space to the splitter.
        s, e, self.first = textops.words(np.where(kind > 0, np.uint8(32), np.uint8(97)), offsets)
        self.of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        ends = np.concatenate([[0], np.cumsum(kind == 2)])
        piece = ends[s] if len(s) else np.zeros(0, np.int64)
        self.size = e - s
        self.hash = textops.word_hashes(raw, s, e, fold=False)
        last = np.ones(len(s), bool)  # whether a word is its piece's last
        if len(s):
            last[:-1] = (piece[1:] != piece[:-1]) | (self.of[1:] != self.of[:-1])
        self.last = last
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])
        step = np.repeat(s - self.at[:-1], self.size + 1)
        from_ = np.minimum(np.arange(self.at[-1]) + step, max(0, len(raw) - 1))
        self.data = raw[from_] if len(raw) else raw
        self.data[self.at[1:] - 1] = np.where(last, 10, 32)

    def strings(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The words from a up to b, as strings."""
        starts, sizes = self.at[a], self.at[b] - 1 - self.at[a]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[take]))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * _STEP + h[j : j + len(out)]
    return textops.mix(out + np.uint64(n))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, last, n): distinct chunks of each slice of texts with their number."""
    for batch in batches:
        done = 0
        for part in textops.slices(batch.column("text"), 1 << 22):
            langs = batch.column("lang").slice(done, len(part))
            done += len(part)
            t = Text(part)
            if not len(t.size):
                continue
            key = _grams(t.hash, OVERLAP)
            cut = np.zeros(len(t.size), bool)
            cut[: len(key)] = (key % np.uint64(TRIGGER) == 0) & (t.of[: len(key)] == t.of[OVERLAP - 1 :])
            begins = np.zeros(len(t.size), bool)
            begins[t.first[:-1][np.diff(t.first) > 0]] = True
            a = np.flatnonzero(cut | begins)
            last = np.ones(len(a), bool)
            last[:-1] = t.of[a[1:]] != t.of[a[:-1]]
            b = np.where(last, t.first[t.of[a] + 1], np.append(a[1:], 0) + OVERLAP)
            table = pa.table({"lang": langs.take(pa.array(t.of[a])), "chunk": t.strings(a, b).cast(pa.string()), "last": pa.array(last)})
            # The trailing byte of a chunk does not show whether its last piece goes on, and need not.
            found = table.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "last", "n"])
            yield from found.to_batches()


def _bit(lang: pa.Array, h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each phrase's bit."""
    codes = pc.dictionary_encode(lang)
    data, offsets = textops.buffers(codes.dictionary.cast(pa.string()))
    base = textops.mix(textops.word_hashes(data, offsets[:-1], offsets[1:], fold=False) + np.uint64(1))
    each = base[codes.indices.to_numpy()] if len(base) else np.zeros(0, np.uint64)
    return (textops.mix(h ^ each[of]) % np.uint64(BITS)).astype(np.int64)


def _counter(length: int, bits):
    """A function from chunks to (lang, phrase, n) of all phrases of that length whose parts may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            done = 0
            for part in textops.slices(batch.column("chunk"), 1 << 22):
                lang, last, n = (batch.column(c).slice(done, len(part)) for c in ("lang", "last", "n"))
                done += len(part)
                t = Text(part)
                m = len(t.size) - length + 1
                if m <= 0:
                    continue
                mine = np.arange(len(t.size)) < np.where(last.to_numpy(False), t.first[1:], t.first[1:] - OVERLAP)[t.of]
                ok = mine[:m].copy()
                for j in range(length - 1):
                    ok &= ~t.last[j : j + m]
                if may is not None:
                    bit = _bit(lang, _grams(t.hash, length - 1), t.of[: m + 1])
                    known = (may[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    ok &= known[:-1] & known[1:]
                a = np.flatnonzero(ok)
                if not len(a):
                    continue
                of = pa.array(t.of[a])
                table = pa.table({"lang": lang.take(of), "phrase": t.strings(a, a + length).cast(pa.string()), "n": n.take(of)})
                yield from table.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"]).to_batches()

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, bits): the bitmap of the phrases, 64 bits a row."""
    for batch in batches:
        t = Text(batch.column("phrase"))
        if not len(t.size):
            continue
        n = int(t.first[1])
        bit = np.unique(_bit(batch.column("lang"), _grams(t.hash, n)[t.first[:-1]], np.arange(batch.num_rows)))
        place, at = np.unique(bit >> 6, return_index=True)
        words = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words.view(np.int64))], ["place", "bits"])


def _bitmap(found: DataFrame):
    """A broadcast bitmap of BITS bits with all phrases of `found`."""
    rows = found.select("lang", "phrase").mapInArrow(_marks, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return found.sparkSession.sparkContext.broadcast(out.tobytes())


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Distinct chunks: (lang, chunk, last, n); last tells the chunks that end their texts, n the number of places."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_chunks, "lang string, chunk string, last boolean, n long").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def count_phrases(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """From a dictionary all phrases of 1 to MOST_WORDS words that occur `least` times or more, (lang, phrase, size, f), and all words of each language, (lang, n)."""
    every, total, bits = None, None, None
    for size in range(1, MOST_WORDS + 1):
        f = chunks.mapInArrow(_counter(size, bits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            words = keep(f, "words")
            total = keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            f = words
        f = keep(f.where(F.col("f") >= least).select("lang", "phrase", F.lit(size).alias("size"), "f"), "phrases")
        if size == 1:
            drop(words)
        bits = _bitmap(f) if size < MOST_WORDS else None
        every = f if every is None else every.unionByName(f)
    return every, total


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases of 2 to 5 words whose words keep together.

    lang, rank (from 1), phrase, a, l, r, n, score: a occurrences of the phrase,
    l and r of the parts that its loosest cut leaves (of cuts with equal scores
    after flooring, the earliest), n words of the language, and the score
    floor(1000 a n / (l r)), in exact decimals of 38 digits. A phrase inside a longer one of
    as many occurrences is left out. Order: score and a descending, then phrase
    by its bytes.

    A null language is `und`, a null text is empty and has no word; texts of any
    length are read whole; repeated rows count as often as they stand there; an
    empty table, or one without frequent phrases, gives no row; other columns are
    ignored, whatever their names.
    """
    chunks = keep(dictionary(docs, lang_col, text_col), "chunks")
    f, total = count_phrases(chunks, least)
    drop(chunks)
    longer = f.where("size > 2")
    inside = [longer.select("lang", F.expr(cut).alias("phrase"), "f") for cut in ("substring_index(phrase, ' ', size - 1)", "substring_index(phrase, ' ', 1 - size)")]
    # A longer phrase of as many occurrences has one of just one word more between; f never grows with a word.
    closed = inside[0].unionByName(inside[1]).distinct()
    phrases = f.where("size > 1").join(closed, ["lang", "phrase", "f"], "left_anti")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = keep(cuts, "cuts")
    total_cuts = cuts.count()
    for part, name in (("head", "l"), ("tail", "r")):
        uses = cuts.groupBy("lang", part).agg(F.count("*").alias("_uses"))
        known = f.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(uses, ["lang", part])
        met = keep(attach(cuts, keep(known, "parts"), ["lang", part], "_uses", total_cuts).drop("_uses"), "cuts")
        drop(cuts)
        cuts = met
    cuts = cuts.join(F.broadcast(total) if _few(total) else total, "lang")
    exact = [F.col(c).cast("decimal(19,0)") for c in "anlr"]
    score = F.expr("(cast(1000 as decimal(4,0)) * _a * _n) div (_l * _r)")
    cuts = cuts.select("*", *[c.alias(f"_{x}") for c, x in zip(exact, "anlr", strict=True)]).withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within shares of a language, so that no task sorts all its phrases.
    best = best.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _few(rows: DataFrame, most: int = 4096) -> bool:
    return len(rows.take(most + 1)) <= most


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1 AND (lang, phrase, f) NOT IN (SELECT lang, array_to_string(string_split(phrase, ' ')[:k - 1], ' '), f FROM f WHERE k > 2 UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' '), f FROM f WHERE k > 2)),
cut AS (SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') AS h, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS t FROM c, (SELECT unnest(range(1, 5)) AS j) WHERE j < c.k),
s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = h JOIN f y ON y.lang = cut.lang AND y.phrase = t JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b QUALIFY rank <= 2000
"""
