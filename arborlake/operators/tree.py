"""Building and reading trees of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.settle import settle
from ..functions.text import from_hex, is_uuid4
from .lines import utf8_prefix


def doc_order():
    return W.partitionBy("doc_id").orderBy("ord_path")


def with_paths(edges: DataFrame) -> DataFrame:
    """From (doc_id, node_id, parent_id, child_index): adds ord_path, anc_ids and depth; other columns are kept.

    By pointer doubling: each round joins the paths of nodes with those of the
    nodes that they begin at, so that a tree of depth d takes log(d) rounds, of
    which each is written out. Nodes that no root is above, in or below cycles
    or below a missing parent, are not placed.
    """
    columns, state = edges.columns, ["_up", "ord_path", "anc_ids"]
    root = F.col("parent_id").isNull()
    none = F.array().cast("array<string>")
    now = edges.withColumn("_up", F.col("parent_id")).withColumn("ord_path", F.array("child_index")).withColumn("anc_ids", F.when(root, none).otherwise(F.array("parent_id")))
    now = settle(now.select(*columns, *state))
    done, open_ = now.where("_up is null"), now.where("_up is not null")
    left = open_.count()
    while left:
        above = done.unionByName(open_).select("doc_id", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.col("ord_path").alias("_p"), F.col("anc_ids").alias("_a"))
        longer = open_.join(above, ["doc_id", "_up"])
        now = settle(longer.select(*columns, F.col("_next").alias("_up"), F.concat("_p", "ord_path").alias("ord_path"), F.concat("_a", "anc_ids").alias("anc_ids")))
        done, open_ = done.unionByName(now.where("_up is null")), now.where("_up is not null")
        before, left = left, open_.count()
        if left == before:  # trees have nodes at each depth: none has come to an end, so none will
            break
    return done.withColumn("depth", F.size("anc_ids")).drop("_up")


def preorder(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("preorder", F.row_number().over(doc_order()) - 1)


def descendants(nodes: DataFrame, node_ids: list[str], max_depth: int = 0) -> DataFrame:
    """Nodes below the given ones with their relative depth; max_depth 0: all."""
    hit = nodes.withColumn("of", F.explode("anc_ids")).where(F.col("of").isin(node_ids))
    hit = hit.withColumn("relative", (F.size("anc_ids") - F.array_position("anc_ids", F.col("of")) + 1).cast("int"))
    return hit.where((F.col("relative") <= max_depth) if max_depth else F.lit(True))


def parent_of(nodes: DataFrame) -> DataFrame:
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return nodes.where("parent_id is not null").join(up, ["doc_id", "parent_id"], "left")


def semantic_roles(nodes: DataFrame, kinds: dict[str, str], nearest: bool = True) -> DataFrame:
    """`role` from a table of kinds; a function whose nearest class or function above is a class is a method.

    nearest=False: the outermost one decides. Needs anc_kinds, root first.
    """
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    roles = F.filter(F.transform("anc_kinds", lambda k: F.element_at(table, k)), lambda r: r.isin("class", "function", "method"))
    one = F.try_element_at(roles, F.lit(-1 if nearest else 1))
    base = F.coalesce(F.element_at(table, F.col("kind")), F.lit("node"))
    return nodes.withColumn("role", F.when((base == "function") & (one == "class"), "method").otherwise(base))


def with_ancestors(nodes: DataFrame, *columns: str) -> DataFrame:
    """Adds anc_<column>: the values of the ancestors, root first."""
    up = nodes.select("doc_id", F.col("node_id").alias("_a"), *[F.col(c).alias(f"_{c}") for c in columns])
    at = nodes.select("doc_id", "node_id", F.posexplode("anc_ids").alias("_i", "_a")).join(up, ["doc_id", "_a"])
    got = at.groupBy("doc_id", "node_id").agg(*[F.array_sort(F.collect_list(F.struct("_i", f"_{c}"))).getField(f"_{c}").alias(f"anc_{c}s") for c in columns])
    out = nodes.join(got, ["doc_id", "node_id"], "left")
    for c in columns:
        out = out.withColumn(f"anc_{c}s", F.coalesce(f"anc_{c}s", F.array().cast("array<string>")))
    return out


def qualified_names(nodes: DataFrame) -> DataFrame:
    """`qualname`: the names of the classes and functions around a node and its own; of other nodes null."""
    return with_ancestors(nodes, "name", "role").withColumn("qualname", F.when(_named("role"), F.array_join(F.concat(_enclosing(), F.array("name")), "."))).drop("anc_names", "anc_roles")


def _named(c: str) -> Column:
    return F.col(c).isin("class", "function", "method")


def _enclosing() -> Column:
    pairs = F.filter(F.arrays_zip("anc_names", "anc_roles"), lambda p: p["anc_roles"].isin("class", "function", "method"))
    return F.transform(pairs, lambda p: p["anc_names"])


def allocate_short_ids(nodes: DataFrame, next_ids: DataFrame | None = None) -> DataFrame:
    """`short_id` per document in preorder from next_short_id (1 where unknown)."""
    start = F.lit(1)
    if next_ids is not None:
        nodes = nodes.join(next_ids, "doc_id", "left")
        start = F.coalesce("next_short_id", F.lit(1))
    return nodes.withColumn("short_id", (start + F.row_number().over(doc_order()) - 1).cast("long")).drop("next_short_id")


def next_short_ids(old: DataFrame, nodes: DataFrame) -> DataFrame:
    """The counter after an allocation: it never falls, so that ids are not used again."""
    top = nodes.groupBy("doc_id").agg((F.max("short_id") + 1).alias("_n"))
    return old.join(top, "doc_id", "full").select("doc_id", F.greatest(F.coalesce("next_short_id", F.lit(1)), F.coalesce("_n", F.lit(1))).alias("next_short_id"))


def rekey(nodes: DataFrame, remap: DataFrame) -> DataFrame:
    """Node ids replaced by (doc_id, old_id, new_id); all else stays."""
    return nodes.join(remap.withColumnRenamed("old_id", "node_id"), ["doc_id", "node_id"], "left").withColumn("node_id", F.coalesce("new_id", "node_id")).drop("new_id")


def replace_ids(nodes: DataFrame, remap: DataFrame) -> DataFrame:
    """Node ids replaced by (doc_id, old_id, new_id), also where they are a parent's; all else stays."""
    up = remap.select("doc_id", F.col("old_id").alias("parent_id"), F.col("new_id").alias("_p"))
    return rekey(nodes, remap).join(up, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("_p", "parent_id")).select(nodes.columns)


def resolve_addresses(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(doc_id, address) with node_id: an address is a short id in decimal or as 0x hex, or a node id of UUID4 form; error BAD_ADDRESS or UNKNOWN_NODE."""
    a = F.col("address")
    number = F.when(a.rlike("^[0-9]+$"), a.cast("long")).otherwise(from_hex(a))
    rows = asked.withColumn("_n", number).withColumn("_u", F.when(is_uuid4(a), a))
    j = rows.join(nodes.select("doc_id", F.col("short_id").alias("_n"), F.col("node_id").alias("_a")), ["doc_id", "_n"], "left")
    named = nodes.where(is_uuid4(F.col("node_id")))  # no other is asked for by its id
    j = j.join(named.select("doc_id", F.col("node_id").alias("_u"), F.col("node_id").alias("_b")), ["doc_id", "_u"], "left").withColumn("node_id", F.coalesce("_a", "_b"))
    error = F.when(F.col("_n").isNull() & F.col("_u").isNull(), "BAD_ADDRESS").when(F.col("node_id").isNull(), "UNKNOWN_NODE")
    return j.select(*asked.columns, "node_id", error.alias("error"))


def backfill_entities(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """entities(doc_id, kind, name, node_id or null): a missing node_id is that of the node of the same document, kind and name, else `generated`."""
    found = nodes.select("doc_id", "kind", "name", F.col("node_id").alias("_found"))
    return entities.join(found, ["doc_id", "kind", "name"], "left").withColumn("node_id", F.coalesce("node_id", "_found", F.lit("generated"))).select(entities.columns)


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Per node: nodes, bytes and children of its subtree, itself included in the first two.

    By an Euler tour: each node is entered at its place and left behind all that lie below it; its subtree is
    what was entered between, the difference of two running sums of its document.
    """
    step = lambda node, at, enter, child: F.struct(F.col(node).alias("node_id"), at.alias("at"), F.lit(enter).alias("enter"), F.lit(child).alias("child"))
    at, behind = F.col("ord_path"), F.concat("ord_path", F.array(F.lit(2147483647)))
    tour = F.array(step("node_id", at, 1, 0), step("node_id", behind, 0, 0), step("parent_id", at, 0, 1))
    steps = nodes.select("doc_id", F.length(F.col("content").cast("binary")).alias("_b"), F.explode(tour).alias("s")).select("doc_id", "_b", "s.*").where("node_id is not null")
    run = W.partitionBy("doc_id").orderBy("at", F.desc("enter")).rowsBetween(W.unboundedPreceding, 0)
    entered, bytes_ = F.col("enter"), F.when(F.col("enter") == 1, F.coalesce("_b", F.lit(0))).otherwise(0)
    steps = steps.select("doc_id", "node_id", "enter", "child", F.sum(entered).over(run).alias("_n"), F.sum(bytes_).over(run).alias("_s"), bytes_.alias("_own"))
    mine = F.col("child") == 0
    inside = lambda c: F.max(F.when(mine & (F.col("enter") == 0), F.col(c))) - F.max(F.when(F.col("enter") == 1, F.col(c)))  # noqa: E731  both rise along the tour
    return steps.groupBy("doc_id", "node_id").agg((inside("_n") + 1).alias("n_nodes"), (inside("_s") + F.sum("_own")).alias("n_bytes"), F.sum("child").alias("n_children"))


def statement_ancestor(nodes: DataFrame, statement_kinds: list[str]) -> DataFrame:
    """From a node upward the first of a statement kind; else the nearest named one, else itself, as a fallback."""
    rows = with_ancestors(nodes, "kind", "name")
    chain = F.concat(F.arrays_zip(F.col("anc_ids").alias("id"), F.col("anc_kinds").alias("kind"), F.col("anc_names").alias("name")), F.array(F.struct(F.col("node_id").alias("id"), F.col("kind").alias("kind"), F.col("name").alias("name"))))
    rows = rows.withColumn("_c", chain)
    hit = F.try_element_at(F.filter("_c", lambda s: s["kind"].isin(statement_kinds)), F.lit(-1))["id"]
    named = F.try_element_at(F.filter("_c", lambda s: s["name"] != ""), F.lit(-1))["id"]
    return rows.select("doc_id", "node_id", F.coalesce(hit, named, F.col("node_id")).alias("statement_id"), hit.isNull().alias("fallback"))


def sibling_runs(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (request_id, doc_id, node_id, seq) whether its nodes are adjacent siblings in order."""
    r = requests.join(nodes.select("doc_id", "node_id", "parent_id", "child_index"), ["doc_id", "node_id"], "left")
    k = F.row_number().over(W.partitionBy("request_id").orderBy("seq"))
    r = r.withColumn("_d", F.col("child_index") - k)
    return r.groupBy("request_id").agg((F.count_if(F.col("child_index").isNull()) == 0).alias("_known"), F.count_distinct("parent_id").alias("_p"), F.count_distinct("_d").alias("_r")).select("request_id", (F.col("_known") & (F.col("_p") == 1) & (F.col("_r") == 1)).alias("contiguous"))


def renumber(nodes: DataFrame, order: str = "sort_key") -> DataFrame:
    """child_index anew from the order among siblings."""
    w = W.partitionBy("doc_id", "parent_id").orderBy(order, "node_id")
    return nodes.withColumn("child_index", (F.row_number().over(w) - 1).cast("int"))


def drill_down(nodes: DataFrame, depth: int = 1, expand_below_bytes: int = 64, max_output_bytes: int = 4096, start: DataFrame | None = None, resume: DataFrame | None = None, preview_bytes: int = 0) -> DataFrame:
    """An outline of each document as records of `node` or `stub`, cut at a budget.

    It begins at the root, or at the node of start(doc_id, node_id), one a document, whose depth counts as 0; other
    documents are then left out. A node below `depth` is shown if all above it are and its subtree has at most
    expand_below_bytes (0: never); the topmost others are stubs with what they hide. Records in preorder whose
    bytes add up to over max_output_bytes are not shown; truncation() gives the first of these, and a call with it as
    resume(doc_id, node_id) goes on from there with a new budget. With preview_bytes a node's content is added,
    as many whole characters as fit.
    """
    if start is not None:  # what is outside of these subtrees is left out before anything is sorted
        top, at = start.select("doc_id", F.col("node_id").alias("_top")).distinct(), F.array_position("anc_ids", F.col("_top"))
        below = F.when(F.col("node_id") == F.col("_top"), 0).when(at > 0, (F.size("anc_ids") - at + 1).cast("int"))
        nodes = nodes.join(top, "doc_id").withColumn("depth", below).where("depth is not null")
        nodes = settle(nodes.select("doc_id", "node_id", "parent_id", "ord_path", "depth", "name", "content"))  # read twice
    rows = preorder(nodes).join(subtree_sizes(nodes), ["doc_id", "node_id"]).withColumn("_end", F.col("preorder") + F.col("n_nodes"))
    small = F.col("n_bytes") <= (expand_below_bytes if expand_below_bytes else -1)
    rows = rows.withColumn("stub", (F.col("depth") > depth) & ~small)
    # Subtrees lie within each other or apart, so a node is in a stub if one before it ends behind it.
    before = W.partitionBy("doc_id").orderBy("preorder").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_until", F.max(F.when(F.col("stub"), F.col("_end"))).over(before)).where("_until is null or _until <= preorder")
    if resume is not None:
        first = rows.join(resume.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select("doc_id", F.col("preorder").alias("_r"))
        rows = rows.join(first, "doc_id").where("preorder >= _r")
    size = F.length("name") + F.when(F.col("stub"), 16).otherwise(F.length("content") + 8)
    run = F.sum("_size").over(W.partitionBy("doc_id").orderBy("preorder").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_size", size).withColumn("used", run)
    preview = [F.when(~F.col("stub"), utf8_prefix(F.col("content"), preview_bytes)).alias("preview")] if preview_bytes else []
    return rows.withColumn("shown", F.col("used") <= max_output_bytes).select("doc_id", "node_id", F.when(F.col("stub"), "stub").otherwise("node").alias("record_type"), "name", "n_nodes", "n_bytes", "n_children", "used", "shown", *preview)


def truncation(outline: DataFrame) -> DataFrame:
    """Per document: records shown and left out, their bytes, and the node from which to go on (null if nothing is left)."""
    left = F.when(~F.col("shown"), F.col("used"))
    return outline.groupBy("doc_id").agg(F.count_if("shown").alias("n_shown"), F.count_if(~F.col("shown")).alias("n_omitted"), F.max(F.when(F.col("shown"), F.col("used"))).alias("bytes_shown"), F.min_by("node_id", left).alias("next_node_id"))


def structure_overview(nodes: DataFrame, roles: tuple[str, str] = ("class", "method")) -> DataFrame:
    """Per document its classes with their direct methods in order."""
    a, b = nodes.where(F.col("role") == roles[0]), nodes.where(F.col("role") == roles[1])
    below = b.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_index", "name"))), lambda s: s["name"]), ",").alias("methods"), F.count("*").alias("n_methods"))
    return a.join(below, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "name", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))
