"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix stands at the golden-ratio point frac((t + 1/2) * phi); the
cumulative targets map it to a source, and the slot's rank among that source's
slots is the block of the source that it takes. Any run of slots so holds each
source nearly in proportion. A source's blocks are equal numbers of words of its
shuffled documents, read over and over; what no slot takes is not in the mix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import keep
from .skew import chunked_sums

WEIGHTS = (5, 2, 1)
#: Most words of a block; blocks that the smallest target should have, so that the slots' discrepancy of a few blocks is little of it; most slots.
BLOCK_WORDS, LEAST_BLOCKS, MOST_SLOTS = 4096, 512, 1 << 32
#: Most sources that a mix may have; the table of sources passes through the driver and to all executors.
MOST_SOURCES = 100_000
PHI = (math.sqrt(5) - 1) / 2
#: Fixed point for the golden-ratio points: exact at any slot number.
PHI_64 = 11400714819323198485
#: Slots that are ranked together.
SLOTS_A_CHUNK = 1 << 12


def fair_shares(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Of share * sum(sizes) each source's part by weight, at most `most` times its size.

    The excess of capped sources goes to the others by weight until none is above; if all are capped, less is shared.
    """
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> list[dict]:
    """Per source, by code point with null last: its size and target. Raises over MOST_SOURCES sources."""
    found = rows.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r.n for r in found]
    parts = fair_shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    return [{"no": i, "source": r[0], "source_size": r.n, "rows": r.rows, "target": t} for i, (r, t) in enumerate(zip(found, parts, strict=True))]


def block_words(sources: list[dict]) -> int:
    """Words of a block: BLOCK_WORDS, or less where a source has a small target, but no more than MOST_SLOTS slots in all."""
    some = [s["target"] for s in sources if s["target"] > 0]
    return max(1, min([BLOCK_WORDS, *(int(t / LEAST_BLOCKS) for t in some)]), -(-int(sum(some)) // MOST_SLOTS))


def schedule(spark, sources: list[dict], block: int) -> DataFrame:
    """Rows (slot, no, block_no): in slot order, which block of which source the mix takes.

    There are as many slots as blocks have room in the targets; a source has
    nearly its share of them in any run of slots.
    """
    total = sum(s["target"] for s in sources)
    if not total:
        return spark.createDataFrame([], "slot long, no int, block_no long")
    edges = np.cumsum([s["target"] for s in sources]) / total

    def draw(batches):
        for batch in batches:
            t = batch.column(0).to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                point = (t * np.uint64(PHI_64) + np.uint64(PHI_64 // 2)) / 2.0**64
            no = np.minimum(np.searchsorted(edges, point, "right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(no.astype(np.int32))], ["slot", "no"])

    drawn = spark.range(max(1, round(total / block))).mapInArrow(draw, "slot long, no int").withColumn("chunk", F.floor(F.col("slot") / SLOTS_A_CHUNK))
    each = drawn.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("base", before)
    rank = F.row_number().over(W.partitionBy("no", "chunk").orderBy("slot")) - 1
    return drawn.join(each.select("no", "chunk", "base"), ["no", "chunk"]).select("slot", "no", (F.col("base") + rank).alias("block_no"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most, seed) -> tuple[DataFrame, list[dict]]:
    """Per row doc_id, source, _text (a hash), _size and its place `before` in its source's shuffled stream; and the sources."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("_size"), F.xxhash64(text).alias("_text")), "sizes")
    if most != int(most):
        raise ValueError("most: a whole number of passes")
    sources = targets(rows, weights, share, most)
    names = docs.sparkSession.createDataFrame([(s["no"], s["source"], s["source_size"], s["target"]) for s in sources], "_no int, _source string, _source_size long, _target double")
    rows = rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.xxhash64(F.lit(seed), "doc_id", "_text"), F.col("doc_id"), F.col("_text")]
    return chunked_sums(rows, ["_no"], order, F.col("_size"), sum(s["rows"] for s in sources)), sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int | None = None, seed: int = 7, plan=schedule) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words that the mix takes of it) and first_slot (that takes some of it; null if none).

    Size is the number of [^\\x20\\x09-\\x0D]+ in the text (null: 0). Sources by
    code point, null last, weigh `weights` in turn and share `share` of all
    words; none takes over `most` times (a whole number) its size. A source takes
    the blocks of `block` words (default: block_words) that `plan` gives its slots,
    so that it is off its target by the slots' discrepancy, some blocks. Reruns
    take the same. Rows without words take none; repeated rows each count; other
    columns are ignored; an empty table gives an empty result.
    """
    rows, sources = _placed(docs, id_col, text_col, source_col, weights, share, most, seed)
    block = block or block_words(sources)
    base = ["doc_id", "_no", "_size", "_source_size", "_target", "before"]
    rows = keep(rows.select(*base), "places")
    # Each pass over the source reads on where the last one ended; a document's part of each block that it lies in.
    passes = rows.where("_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))))
    passes = passes.withColumn("lo", F.col("before") + F.col("pass") * F.col("_source_size")).withColumn("hi", F.col("lo") + F.col("_size"))
    parts = passes.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    words = F.least("hi", (F.col("block_no") + 1) * block) - F.greatest("lo", F.col("block_no") * block)
    slots = plan(docs.sparkSession, sources, block).select(F.col("no").alias("_no"), "block_no", "slot")
    took = parts.select(*base, "block_no", words.alias("words")).join(slots, ["_no", "block_no"]).select(*base, "words", "slot")
    # Rows with words differ in their places.
    none = [F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot")]
    filled = took.unionByName(rows.where("_size > 0").select(*base, *none)).groupBy(*base).agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    out = filled.unionByName(rows.where("_size = 0").select(*base, *none))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("words").alias("taken"), F.col("slot").alias("first_slot"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int | None = None, seed: int = 7, plan=schedule) -> DataFrame:
    """The mixed rows themselves, whole: a row comes once for each pass of which a slot takes the block where its first word lies.

    A source so is off its target by the slots' discrepancy and the row at the
    end of its last block. Rows without words come once. Null ids, sources and
    texts are values of their own (null text: no words); rows alike in id, source
    and text share what they come to; all columns are kept, whatever their names;
    an empty table gives an empty result.
    """
    plain = docs.select([F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    whole = plain.withColumn("_key", F.xxhash64(F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))))
    rows, sources = _placed(docs, id_col, text_col, source_col, weights, share, most, seed)
    block = block or block_words(sources)
    rows = keep(rows.select("doc_id", "source", "_text", "_no", "_size", "_source_size", "before"), "places")
    passes = rows.where("_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))))
    passes = passes.withColumn("block_no", F.floor((F.col("before") + F.col("pass") * F.col("_source_size")) / block))
    slots = plan(docs.sparkSession, sources, block).select(F.col("no").alias("_no"), "block_no")
    key = ["doc_id", "source", "_text"]
    # Repeated rows are alike, so that they may share what they come to.
    took = passes.join(slots, ["_no", "block_no"]).select(*key, F.lit(1).alias("n"), F.lit(0).alias("rows"))
    alike = rows.select(*key, F.when(F.col("_size") == 0, 1).otherwise(0).alias("n"), F.lit(1).alias("rows"))
    times = keep(took.unionByName(alike).groupBy(*key).agg(F.sum("n").alias("_times"), F.sum("rows").alias("_rows")), "times")
    same = F.col(at[id_col]).cast("long").eqNullSafe(F.col("doc_id")) & F.col(at[source_col]).cast("string").eqNullSafe(F.col("source")) & (F.col("_key") == F.col("_text"))
    each = F.floor(F.col("_times") / F.col("_rows"))
    cols = list(at.values())
    out = whole.join(times.where("_times % _rows = 0"), same).select(*cols, each.alias("_times"))
    odd = times.where("_times % _rows > 0")
    if not odd.isEmpty():  # the remainder goes to the first of them
        spread = keep(whole.join(odd, same).withColumn("_nth", F.monotonically_increasing_id()), "alike")
        nth = chunked_sums(spread.select(*key, "_nth"), key, [F.col("_nth")], F.lit(1), spread.count()).select("_nth", "before")
        more = each + F.when(F.col("before") < F.pmod("_times", "_rows"), 1).otherwise(0)
        out = out.unionByName(spread.join(nth, "_nth").select(*cols, more.alias("_times")))
    out = out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return out.select([F.col(at[c]).alias(c) for c in docs.columns])
