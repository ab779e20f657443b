"""What users decide about nodes: their ids, which kinds go below which, and how short ids are dealt out.

Each hook makes columns or tables of what it is given, so that a user's rule is part of the plan and runs where the
rows are. Operators that put nodes into documents take a Hooks; what is left out keeps its default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import as_uuid

Identity = Callable[[Column, Column, Column], Column]
Admits = Callable[[Column, Column, Column], Column]
Allocate = Callable[[DataFrame, DataFrame], DataFrame]


def hashed_identity(batch: Column, doc_id: Column, seq: Column) -> Column:
    """An id in the form of a UUID4 that is the same whenever the edit is applied."""
    return as_uuid(batch.cast("string"), doc_id.cast("string"), seq.cast("string"))


def admits_all(parent_kind: Column, position: Column, kind: Column) -> Column:
    return F.lit(True)


def admits_pairs(*pairs: tuple[str, str]) -> Admits:
    """A rule from the pairs (kind of the parent, kind of the child) that may be."""
    return lambda parent_kind, position, kind: F.coalesce(F.concat_ws("\0", parent_kind, kind).isin([f"{p}\0{k}" for p, k in pairs]), F.lit(False))


def next_numbers(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """new(doc_id, node_id, seq, ...) with short_id: a document's next numbers in the order of seq."""
    top = nodes.groupBy("doc_id").agg(F.max("short_id").alias("_top"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "node_id"))
    return new.join(top, "doc_id", "left").withColumn("short_id", (F.coalesce("_top", F.lit(0)) + n).cast("long")).drop("_top")


@dataclass(frozen=True)
class Hooks:
    """identity(batch_id, doc_id, seq): the id of a node inserted without one; admits(parent_kind, position, kind): whether
    a node of that kind may come there; allocate(new, nodes): new nodes with their short ids."""

    identity: Identity = hashed_identity
    admits: Admits = admits_all
    allocate: Allocate = next_numbers


def inadmissible(nodes: DataFrame, hooks: Hooks) -> DataFrame:
    """(doc_id, node_id, parent_kind, child_kind) of the nodes that do not belong where they are."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    pairs = nodes.where("parent_id is not null").join(up, ["doc_id", "parent_id"])
    return pairs.where(~hooks.admits(F.col("parent_kind"), F.lit("last_child"), F.col("kind"))).select("doc_id", "node_id", "parent_kind", F.col("kind").alias("child_kind"))
