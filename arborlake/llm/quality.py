"""Quality classifier: document evidence with hierarchical empirical-Bayes site priors.

A logistic regression over features of the whole text gives each document's
evidence. Sums of its probabilities by site and by part of a site, in grouped
aggregations, give posterior rates; sparse parts shrink toward their site and
sparse sites toward the corpus, as strongly as the spread between sites, and
between the parts of a site, says (method of moments). A document's score is its own log odds, moved by the log
odds of its part against those of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textops
from .scratch import keep
from .skew import attach

#: Most labelled rows that the classifier is fitted on: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Bounds on the strength of a prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"|*&%$#@!<>{}=+~^_\\/")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[97:123] = True
N_FEATURES = 7


def features(texts: pa.Array) -> np.ndarray:
    """Per text: shares of words with symbols, in capitals, and equal to one of the two before; mean length, spread, share of symbols; log of words."""
    data, offsets = textops.buffers(texts)
    s, e, first = textops.words(data, offsets)
    h = textops.word_hashes(data, s, e, fold=False)
    total = lambda flag: np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
    symbols, upper, lower = total(_SYMBOL), total(_UPPER), total(_LOWERS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    size = (e - s).astype(float)
    per_word = [symbols[e] > symbols[s], (upper[e] - upper[s] > 1) & (lower[e] == lower[s]), again, size, size**2]
    n = np.diff(first)
    sums = [np.concatenate([[0.0], np.cumsum(x, dtype=float)]) for x in per_word]
    a, b, c, d, d2 = ((x[first[1:]] - x[first[:-1]]) / np.maximum(n, 1) for x in sums)
    share = (symbols[offsets[1:]] - symbols[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    return np.stack([a, b, c, d / 10, np.sqrt(np.maximum(d2 - d * d, 0)) / 10, share, np.log1p(n) / 10], axis=1)


@dataclass
class Model:
    """Weights over standardised features; None: nothing to learn from, all evidence is 0."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Newton's method on the ridge-penalised likelihood; needs both classes."""
    if not len(y) or y.min() == y.max():
        return Model()
    m = Model(x.mean(0), x.std(0) + 1e-6)
    z = np.c_[np.clip((x - m.mean) / m.scale, -8, 8), np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    m.weights = w
    return m


def _by_batch(names: list[str], kinds: dict[str, pa.DataType], give):
    """Runs give(features) over the column text of the last place; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in textops.slices(batch.column("text")):
                found = give(features(part))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(part)) for c in names), *(pa.array(v, k) for v, k in zip(found, kinds.values(), strict=True))], [*names, *kinds])
                done += len(part)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most `fit_rows` labelled rows, whole texts; null ids and labels are ignored."""
    wanted = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("y")).dropna()
    wanted = wanted.orderBy(F.xxhash64("_id"), "_id", "y").limit(fit_rows)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(F.broadcast(wanted), "_id").select("_id", F.xxhash64("text").alias("h"), "y", "text")
    got = rows.mapInArrow(_by_batch(["_id", "h", "y"], {"x": pa.list_(pa.float64())}, lambda x: [list(x)]), "_id long, h long, y double, x array<double>")
    got = got.orderBy(F.xxhash64("_id"), "_id", "h", "y").limit(2 * fit_rows).toPandas()  # ids may repeat
    if not len(got):
        return Model()
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy(float))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, free: int) -> float:
    """Of a beta prior over groups' rates (p of n rows) about `rate`, a column, from the spread beyond that within them; `free`: rates that were estimated."""
    n, p, rate = F.col("n"), F.col("p"), F.col("rate")
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("n2"), F.sum(n * (p / n - rate) ** 2).alias("s"), (F.sum(n * rate * (1 - rate)) / F.sum("n")).alias("within")).first()
    if r.k <= free or not r.within or r.within <= 0:
        return MOST_STRENGTH
    between = (r.s - (r.k - free) * r.within) / (r.n - r.n2 / r.n) if r.n > r.n2 / r.n else 0.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, r.within / between - 1)) if between > 0 else MOST_STRENGTH


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, tkey (xxhash64 of the text), evidence, host_rate, path_rate, score, kept.

    Columns `host` and `path` name a row's site and its part of it; nulls are a
    site or part of their own. Rates are posterior shares of good documents among
    the others of a row's site and part.
    score is the probability that the row is good; kept: score >= threshold.
    Null and empty texts are judged as texts of no words. Repeated rows each
    count; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tkey"), text.alias("text"))
    give = _by_batch(["doc_id", "host", "path", "tkey"], {"evidence": pa.float64()}, lambda x: [model.logits(x)])
    rows = src.mapInArrow(give, "doc_id long, host string, path string, tkey long, evidence double")
    rows = keep(rows.withColumn("at", F.xxhash64("host", "path", F.col("host").isNull(), F.col("path").isNull())), "evidence")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    parts = keep(rows.groupBy("host", "path", "at").agg(F.count("*").alias("n"), F.sum(p).alias("p")), "sites")
    whole = parts.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    if not whole.n:
        return rows.select("doc_id", "tkey", "evidence", F.lit(0.0).alias("host_rate"), F.lit(0.0).alias("path_rate"), F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    rate = (whole.p + 0.5) / (whole.n + 1)
    hosts = parts.groupBy("host").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    hosts = keep(hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("p").alias("host_p")), "hosts")
    both = parts.join(hosts, parts.host.eqNullSafe(hosts._h))
    a = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_p").alias("p"), F.lit(rate).alias("rate")), 1)
    b = _strength(both.withColumn("rate", F.col("host_p") / F.col("host_n")), hosts.count())
    out = attach(rows, both.select("at", "n", F.col("p").alias("part_p"), "host_n", "host_p"), ["at"], "n", whole.n)
    # Without the row itself, whose evidence counts by itself.
    out = out.withColumn("_p", p).withColumn("host_rate", (F.col("host_p") - F.col("_p") + a * rate) / (F.col("host_n") - 1 + a))
    out = out.withColumn("path_rate", (F.col("part_p") - F.col("_p") + b * F.col("host_rate")) / (F.col("n") - 1 + b))
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))  # noqa: E731  sums round
    out = out.withColumn("host_rate", inside("host_rate")).withColumn("path_rate", inside("path_rate"))
    moved = F.col("evidence") + logit(F.col("path_rate")) - math.log(rate / (1 - rate))
    out = out.withColumn("score", 1 / (1 + F.exp(-moved)))
    return out.select("doc_id", "tkey", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """train() on labels (id_col, label_col: 1 good, 0 bad), then classify() all rows. Without labels of both classes all rows are kept."""
    return classify(docs, train(docs, labels, id_col, text_col, label_col, fit_rows), id_col, text_col, host, path)
