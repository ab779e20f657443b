"""Line dedup within one edit by a deletion-neighbourhood join; DataFrame functions only.

Two different lines are within one insertion, deletion or substitution of each
other exactly if one is the other without some character, or both are alike
without the character at the same place. So lines emit their variants with no or
one character deleted as hashed keys, equal keys are grouped, and pairs with the
group's earliest line are verified by edit distance.

Not all variants are needed: with one edit, a line keeps its first or its last
half, and all that lies outside one window of some characters. Lines whose
halves no other line has emit nothing; the others emit the variants of those
windows only outside of which another line is alike. This loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import keep
from .skew import attach

#: One edit is allowed where the longer line has as many characters: lines are then alike by 0.8 or more.
LEAST_CHARS = 5
BREAKS = r"\r\n|\n|\r"
#: Characters of a window; most windows of a line.
WINDOW, MOST_WINDOWS = 64, 256


def _halves(line: Column) -> Column:
    """For partners at most as long and for those shorter by one: the first and the last half, hashed with the shorter length."""
    n = F.length(line)
    out = []
    for shorter in (0, 1):
        least = n - shorter
        p = F.floor(least / 2).cast("int")
        for kind, part in ((0, line.substr(F.lit(1), p)), (1, line.substr(n - (least - p) + 1, least - p))):
            out.append(F.xxhash64(part, least, F.lit(kind)))
    return F.array(*out)


def _windows(line: Column) -> Column:
    """Places where the only edit may be: (shorter, at, chars) and a hash of all that lies outside.

    Numbered by the shorter partner, whose windows have WINDOW characters, or
    more in very long lines: then what is hashed grows by the length, not its square.
    """
    n = F.length(line)

    def of(shorter: int) -> Column:
        least = n - shorter
        size = F.greatest(F.lit(WINDOW), F.ceil(least / MOST_WINDOWS)).cast("int")

        def one(w: Column) -> Column:
            at = (w * size).cast("int")
            chars = F.least(size, least - at) + shorter
            outside = F.xxhash64(F.substring(line, F.lit(1), at), F.substring(line, at + chars + 1, n), least, at)
            return F.struct(F.lit(shorter).alias("shorter"), at.alias("at"), chars.alias("chars"), outside.alias("outside"))

        return F.transform(F.sequence(F.lit(0), F.floor((least - 1) / size).cast("int")), one)

    return F.concat(of(0), of(1))


def _variants(part: Column, shorter: Column, outside: Column) -> Column:
    """The part itself (at 0, unless the partner is the shorter one) and without each of its characters, hashed with what is outside."""
    cut = lambda i: F.struct(i.alias("at"), F.xxhash64(outside, F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.length(part)))).alias("v"))
    cuts = F.transform(F.sequence(F.lit(1), F.length(part)), cut)
    return F.when(shorter == 0, F.concat(F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(outside, part).alias("v"))), cuts)).otherwise(cuts)


def near_lines(classes: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """(cid, near): of each class of lines (cid, key, chars, halves) the earliest class within one edit that comes before it.

    cids follow the order of first occurrence; lines has key and line.
    """
    halves = keep(classes.where("halves is not null").select("cid", "key", F.explode("halves").alias("half")), "halves")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    open_ = keep(attach(halves, shared, ["half"], "n", halves.count()).select("key", "cid").distinct(), "open-halves")
    texts = lines.where(F.length("line") >= LEAST_CHARS - 1).groupBy("key").agg(F.first("line").alias("line"))
    cand = keep(texts.join(open_, "key").select("cid", "line"), "line-candidates")
    wins = keep(cand.select("cid", F.inline(_windows(F.col("line")))), "windows")
    same_outside = wins.groupBy("outside").agg(F.count("*").alias("n")).where("n > 1")
    wins = attach(wins, same_outside, ["outside"], "n", wins.count()).select("cid", "shorter", "at", "chars", "outside")
    part = F.substring("line", F.col("at") + 1, F.col("chars"))
    rows = wins.join(cand, "cid").select("cid", F.length("line").alias("n"), F.inline(_variants(part, F.col("shorter"), F.col("outside"))))
    rows = rows.where(f"at = 0 or n >= {LEAST_CHARS}").drop("n")  # shorter lines only meet longer ones
    # Lines are different, so that those with one variant are as few as its length and the characters allow.
    v, at = W.partitionBy("v"), W.partitionBy("v", "at")
    rows = rows.withColumn("whole", F.max(F.when(F.col("at") == 0, F.col("cid"))).over(v)).withColumn("cut", F.min(F.when(F.col("at") > 0, F.col("cid"))).over(v)).withColumn("same", F.min("cid").over(at))
    near = F.when(F.col("at") == 0, F.col("cut")).otherwise(F.least("whole", "same"))
    pairs = rows.select("cid", near.alias("near")).where("near < cid").distinct()
    a, b = cand.select("cid", F.col("line").alias("x")), cand.select(F.col("cid").alias("near"), F.col("line").alias("y"))
    met = pairs.join(a, "cid").join(b, "near").where(F.levenshtein("x", "y", 1) == 1)
    return met.groupBy("cid").agg(F.min("near").alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tkey, n_lines, n_exact, n_near, dropped (numbers of dropped lines, from 0).

    Lines end at \\r\\n, \\n or \\r. A line is dropped if it occurs earlier, or if some
    occurrence of a line within one edit, the longer of which has LEAST_CHARS characters, comes before its own first. Earlier: by id (null last), then
    row, then place. Blank lines are never dropped. Null text is one blank line. Repeated rows are
    copies like others. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    line = F.col("line")
    real = F.trim(F.translate(line, "\t\x0b\x0c", "   ")) != ""
    key = F.when(real, F.unhex(F.sha2(line, 256)))
    rows = src.select("rid", "doc_id", F.xxhash64("text").alias("tkey"), F.posexplode(F.split("text", BREAKS)).alias("no", "line"))
    occ = rows.select("rid", "doc_id", "tkey", "no", key.alias("key"), F.when(real & (F.length(line) >= LEAST_CHARS - 1), _halves(line)).alias("halves"))
    occ = keep(occ, "lines")
    pos = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid", "no")
    classes = occ.where("key is not null").groupBy("key").agg(F.min(pos).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    classes = keep(classes.orderBy("first").withColumn("cid", F.monotonically_increasing_id()), "line-classes")
    total = occ.count()
    lines = docs.select(F.explode(F.split(text, BREAKS)).alias("line")).select(F.unhex(F.sha2("line", 256)).alias("key"), "line")
    near = keep(near_lines(classes, lines, total), "near-lines")
    says = classes.join(near, "cid", "left").select("key", "n", "first", F.col("near").isNotNull().alias("near"))
    says = keep(says, "line-decisions")
    marked = attach(occ.where("key is not null").select("rid", "no", pos.alias("pos"), "key"), says, ["key"], "n", total)
    marked = marked.select("rid", "no", (F.col("pos") > F.col("first")).alias("exact"), "near").where("exact or near")
    gone = marked.groupBy("rid").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.array_sort(F.collect_list("no")).alias("dropped"))
    each = occ.groupBy("rid", "doc_id", "tkey").agg(F.count("*").alias("n_lines"))
    out = each.join(gone, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "tkey", "n_lines", zero("n_exact"), zero("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the numbered lines and their ends."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"), F.lit(0))
    return F.array_join(F.filter(parts, lambda p, i: ~F.array_contains(dropped, i)), "")
