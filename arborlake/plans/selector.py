"""Selectors over node tables, built step by step.

    select("class", where("fields.status", "=", "F")).child("method", first())

A step's candidates are looked for in whole documents: type, predicates,
negations, then pseudos over them in preorder; only then does the combinator keep
those that stand below a candidate of the step before. So `first()` means the
document's first match, kept if its parent qualifies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROLES = ("module", "class", "function", "method", "import", "statement", "node")

def attribute(name: str) -> Column:
    return F.element_at("fields", name.removeprefix("fields.")) if name.startswith("fields.") else F.col(name)


def where(name: str, op: str, value: str | int) -> Column:
    """A predicate; a null attribute never matches, not even `!=`. `> < >= <=` hold where both sides are whole numbers."""
    a = attribute(name).cast("string")
    if op in (">", "<", ">=", "<="):
        n, v = a.try_cast("bigint"), F.lit(str(value)).try_cast("bigint")
        found = {">": n > v, "<": n < v, ">=": n >= v, "<=": n <= v}[op]
    else:
        v = F.lit(str(value))
        found = {"=": a == v, "!=": a != v, "~=": a.contains(v), "^=": a.startswith(v), "$=": a.endswith(v)}[op]
    return F.coalesce(found, F.lit(False))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def of_type(name: str) -> Column:
    """`*`, a role in any case, `Stem:*` (a role, or how a kind begins or ends, in any case), else exactly a kind."""
    if name == "*":
        return F.lit(True)
    if name.endswith(":*"):
        stem = name[:-2].lower()
        return (F.col("role") == stem) if stem in ROLES else F.lower("kind").startswith(stem) | F.lower("kind").endswith(stem)
    if name.lower() in ROLES:
        return F.col("role") == name.lower()
    return F.col("kind") == name


def missing_attributes(nodes: DataFrame, name: str) -> DataFrame:
    """In strict use a field that a node lacks is an error: those nodes."""
    key = name.removeprefix("fields.")
    return nodes.where(~F.map_contains_key("fields", key)).select("doc_id", "node_id", F.lit("UNKNOWN_ATTRIBUTE").alias("code"), F.lit(key).alias("attribute"))


Pseudo = Callable[[DataFrame], DataFrame]


def _place(df: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    df = df.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("ord_path")) - 1)
    return df.where(keep(F.col("_k"), F.lit(None))).drop("_k")


def first() -> Pseudo:
    # The least path of a document by a grouped aggregate and a join: no task holds a whole document.
    return lambda df: _extreme(df, F.min)


def last() -> Pseudo:
    return lambda df: _extreme(df, F.max)


def _extreme(df: DataFrame, pick) -> DataFrame:
    best = df.groupBy("doc_id").agg(pick("ord_path").alias("ord_path"))
    return df.join(best, ["doc_id", "ord_path"], "left_semi").select(df.columns)


def nth(n: int) -> Pseudo:
    """The n-th of the document, from 0; none if there are fewer."""
    return lambda df: _place(df, lambda k, _: k == n)


@dataclass(frozen=True)
class Step:
    type: str
    predicates: tuple[Column, ...] = ()
    pseudos: tuple[Pseudo, ...] = ()
    negations: tuple[Selector, ...] = ()
    combinator: str | None = None

    def candidates(self, nodes: DataFrame) -> DataFrame:
        keep = of_type(self.type) & all_of(*self.predicates)
        for n in self.negations:  # judged on the node alone: a selector of several steps excludes nothing
            if len(n.steps) == 1 and not n.steps[0].pseudos:
                keep &= ~(of_type(n.steps[0].type) & all_of(*n.steps[0].predicates))
        return reduce(lambda df, p: p(df), self.pseudos, nodes.where(keep))


@dataclass(frozen=True)
class Selector:
    steps: tuple[Step, ...] = field(default_factory=tuple)

    def _then(self, combinator: str, type_: str, args) -> Selector:
        step = Step(type_, tuple(a for a in args if isinstance(a, Column)), tuple(a for a in args if callable(a) and not isinstance(a, Column | Selector)), tuple(a for a in args if isinstance(a, Selector)), combinator)
        return replace(self, steps=(*self.steps, step))

    def child(self, type_: str, *args) -> Selector:
        return self._then("child", type_, args)

    def descendant(self, type_: str, *args) -> Selector:
        return self._then("descendant", type_, args)

    def run(self, nodes: DataFrame) -> DataFrame:
        found = self.steps[0].candidates(nodes)
        for step in self.steps[1:]:
            found = COMBINATORS[step.combinator](step.candidates(nodes), found)
        return found


def select(type_: str, *args) -> Selector:
    s = Selector()._then(None, type_, args)
    return s


def child_of(below: DataFrame, above: DataFrame) -> DataFrame:
    keys = above.select("doc_id", F.col("node_id").alias("parent_id"))
    return below.join(keys, ["doc_id", "parent_id"], "left_semi").select(below.columns)


def descendant_of(below: DataFrame, above: DataFrame) -> DataFrame:
    keys = above.select("doc_id", F.col("node_id").alias("_anc"))
    hits = below.select("doc_id", "node_id", F.explode("anc_ids").alias("_anc")).join(keys, ["doc_id", "_anc"], "left_semi").select("doc_id", "node_id").distinct()
    return below.join(hits, ["doc_id", "node_id"], "left_semi").select(below.columns)


COMBINATORS = {"child": child_of, "descendant": descendant_of}


def matches(found: DataFrame, source: bool = False) -> DataFrame:
    """What a query returns of each match: id, kind, role, name, path from the root, and its content if asked for."""
    cols = ["doc_id", "node_id", "kind", "role", "name", F.array_join("anc_ids", "/").alias("parent_path")]
    return found.select(*cols, *(["content"] if source else []))


def require_one(found: DataFrame, requests: DataFrame, by: str = "doc_id", show: int = 10) -> DataFrame:
    """Per request NO_MATCH, UNIQUE or NON_UNIQUE, the number of matches and the first `show` of them."""
    w = W.partitionBy(by).orderBy("ord_path")
    few = found.withColumn("_k", F.row_number().over(w))
    got = few.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= show, F.struct("_k", "node_id")))), lambda s: s["node_id"]), ",").alias("candidates"))
    out = requests.select(by).distinct().join(got, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "NO_MATCH").when(F.col("n") == 1, "UNIQUE").otherwise("NON_UNIQUE")
    return out.select(by, status.alias("status"), "n", F.coalesce("candidates", F.lit("")).alias("candidates"))
