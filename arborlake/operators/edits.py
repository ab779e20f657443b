"""Structural edits: node tables to node tables, whole batches or nothing.

edits(batch_id, seq, doc_id, expected_version, op, node_id, position, anchor_id, name):
op insert, delete, move or set_attribute; position first_child, last_child, before or after (of anchor_id).
A set_attribute puts `name` at `key` (a column of the edits, if they have it). Node tables may have further
columns: what an edit does not name stays, and is null in inserted nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.settle import settle, unsettle
from ..functions.text import as_uuid
from ..plans.hooks import Hooks
from ..sources.parsers import Parser, parsed_rows
from .tree import sibling_runs, with_paths

POSITIONS = ("first_child", "last_child", "before", "after")
#: The kind of inserted nodes whose edits name none.
INSERTED = "inserted"
#: Columns that follow from the others: edits leave them out, tree.with_paths makes them.
PATHS = ("ord_path", "anc_ids", "depth")
#: Roots of a document that are held in one array, and roots that are broadcast, at most.
ROOTS, FEW = 64, 100_000


def plain(nodes: DataFrame) -> DataFrame:
    return nodes.drop(*PATHS)


def _kinds(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """edits with the kind that a node has or gets, and that of its parent-to-be."""
    kind = lambda to, name: nodes.select("doc_id", F.col("node_id").alias(to), F.col("kind").alias(name))
    given = F.coalesce("kind", F.lit(INSERTED)) if "kind" in edits.columns else F.lit(INSERTED)
    e = edits.withColumn("_given", given).join(kind("node_id", "_own"), ["doc_id", "node_id"], "left")
    at = nodes.select("doc_id", F.col("node_id").alias("anchor_id"), F.col("kind").alias("_at"), F.col("parent_id").alias("_up"))
    e = e.join(at, ["doc_id", "anchor_id"], "left").join(kind("_up", "_over"), ["doc_id", "_up"], "left")
    parent = F.when(F.col("position").isin("first_child", "last_child"), F.col("_at")).otherwise(F.col("_over"))
    return e.select("batch_id", "seq", "op", "position", parent.alias("parent_kind"), F.when(F.col("op") == "insert", F.col("_given")).otherwise(F.col("_own")).alias("kind"))


def preflight(edits: DataFrame, nodes: DataFrame, versions: DataFrame | None = None, hooks: Hooks | None = None) -> DataFrame:
    """All errors of all edits: (batch_id, seq, code). A batch without any may be applied.

    With hooks, TYPE_REFUSED where a node may not come where an insert or a move puts it, by the kinds that are
    there before any edit; edits may then have a `kind` for the nodes that they insert, and need no id for them.
    """
    if hooks is not None:
        kinds = _kinds(edits, nodes).where(F.col("op").isin("insert", "move") & F.col("parent_kind").isNotNull())
        refused = kinds.where(~F.coalesce(hooks.admits(F.col("parent_kind"), F.col("position"), F.col("kind")), F.lit(False))).select("batch_id", "seq", F.lit("TYPE_REFUSED").alias("code"))
        return preflight(identified(edits, hooks), nodes, versions).unionByName(refused)
    ids = nodes.select("doc_id", "node_id", F.lit(True).alias("known"), "anc_ids", "parent_id")
    target = edits.join(ids.select("doc_id", "node_id", F.col("known").alias("has_node")), ["doc_id", "node_id"], "left")
    target = target.join(ids.select("doc_id", F.col("node_id").alias("anchor_id"), F.col("known").alias("has_anchor"), F.col("anc_ids").alias("up"), F.col("parent_id").alias("anchor_parent")), ["doc_id", "anchor_id"], "left")
    places = F.col("op").isin("insert", "move")
    tests = {
        "NODE_ID_CONFLICT": (F.col("op") == "insert") & F.col("has_node").isNotNull(),
        "UNKNOWN_NODE": (F.col("op") != "insert") & F.col("has_node").isNull(),
        "UNKNOWN_ANCHOR": places & F.col("has_anchor").isNull(),
        "BAD_POSITION": places & ~F.coalesce(F.col("position").isin(*POSITIONS), F.lit(False)),
        "NO_SIBLINGS_OF_ROOT": places & F.col("position").isin("before", "after") & F.col("has_anchor").isNotNull() & F.col("anchor_parent").isNull(),
        "CYCLE": (F.col("op") == "move") & (F.array_contains("up", F.col("node_id")) | (F.col("anchor_id") == F.col("node_id"))),
    }
    if versions is not None:
        target = target.join(versions, "doc_id", "left")
        tests = {"STALE_VERSION": ~F.col("expected_version").eqNullSafe(F.col("version")), **tests}
    codes = F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, t in tests.items()]))
    return target.select("batch_id", "seq", F.explode(codes).alias("code"))


def _placed(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edits with their new parent and a sort key among its children: (index, before or after it, seq)."""
    a = nodes.select("doc_id", F.col("node_id").alias("anchor_id"), F.col("parent_id").alias("_p"), F.col("child_index").alias("_i"))
    e = edits.join(a, ["doc_id", "anchor_id"])
    inside = F.col("position").isin("first_child", "last_child")
    index = F.when(F.col("position") == "first_child", -1).when(F.col("position") == "last_child", 1 << 30).otherwise(F.col("_i"))
    side = F.when(F.col("position") == "before", -1).otherwise(1)
    return e.withColumn("new_parent", F.when(inside, F.col("anchor_id")).otherwise(F.col("_p"))).withColumn("sort_key", F.struct(index.alias("i"), side.alias("s"), F.col("seq").alias("q"))).drop("_p", "_i")


def _key(index: Column) -> Column:
    return F.struct(index.alias("i"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("q"))


def _renumber(nodes: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id", "parent_id").orderBy("sort_key", "node_id")
    return nodes.withColumn("child_index", (F.row_number().over(w) - 1).cast("int")).drop("sort_key")


def identified(edits: DataFrame, hooks: Hooks) -> DataFrame:
    """edits with the hook's id for each insert that has none."""
    own = hooks.identity(F.col("batch_id"), F.col("doc_id"), F.col("seq"))
    return edits.withColumn("node_id", F.when((F.col("op") == "insert") & F.col("node_id").isNull(), own).otherwise(F.col("node_id")))


def insert(nodes: DataFrame, edits: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """nodes with those that edits insert, of their `kind` if the edits have one.

    With hooks, inserts without an id get the hook's, and in node tables with short ids the hook deals these out.
    """
    new = (identified(edits, hooks) if hooks else edits).where("op = 'insert'")
    kind = F.coalesce("kind", F.lit(INSERTED)) if "kind" in edits.columns else F.lit(INSERTED)
    new = _placed(new, nodes).select("doc_id", "node_id", "seq", F.col("new_parent").alias("parent_id"), kind.alias("kind"), F.lit("node").alias("role"), "name", "sort_key")
    new = (hooks.allocate(new, nodes) if hooks and "short_id" in nodes.columns else new).drop("seq")
    old = plain(nodes).withColumn("sort_key", _key(F.col("child_index")).cast(new.schema["sort_key"].dataType))
    return _renumber(old.unionByName(new, allowMissingColumns=True)).select(plain(nodes).columns)


def below(nodes: DataFrame, tops: DataFrame, itself: bool = True) -> DataFrame:
    """(doc_id, node_id) of the nodes below those of tops(doc_id, node_id), once for each that is above; nodes needs anc_ids."""
    up = F.concat("anc_ids", F.array("node_id")) if itself else F.col("anc_ids")
    tops = tops.select("doc_id", F.col("node_id").alias("_a"))
    return nodes.select("doc_id", "node_id", F.explode(up).alias("_a")).join(tops, ["doc_id", "_a"], "left_semi").select("doc_id", "node_id")


def _roots(tops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """tops(doc_id, node_id) as (doc_id, _roots), an array a document; and as (doc_id, root_id) where a document has more than ROOTS, or None.

    Nodes meet the arrays by their document, one row a node, in place of one row for each node above.
    """
    each = settle(tops.select("doc_id", F.col("node_id").alias("root_id")).withColumn("_n", F.count("*").over(W.partitionBy("doc_id"))))
    few = each.where(F.col("_n") <= ROOTS).groupBy("doc_id").agg(F.collect_list("root_id").alias("_roots"))
    many = each.where(F.col("_n") > ROOTS).select("doc_id", "root_id")
    return F.broadcast(few) if each.count() < FEW else few.hint("shuffle_hash"), None if many.isEmpty() else many


def delete(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Without the nodes and all below them; nodes needs anc_ids."""
    left = plain(nodes).join(below(nodes, edits.where("op = 'delete'")), ["doc_id", "node_id"], "left_anti")
    return _renumber(left.withColumn("sort_key", F.col("child_index"))).select(plain(nodes).columns)


def move(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Ids stay; what is below a node goes with it, as only its own parent changes. Several nodes moved to one place keep the order of seq."""
    to = _placed(edits.where("op = 'move'"), nodes).select("doc_id", "node_id", "new_parent", "sort_key")
    kind = to.schema["sort_key"].dataType
    j = plain(nodes).join(to, ["doc_id", "node_id"], "left")
    j = j.withColumn("parent_id", F.coalesce("new_parent", "parent_id")).withColumn("sort_key", F.coalesce("sort_key", _key(F.col("child_index")).cast(kind)))
    return _renumber(j).select(plain(nodes).columns)


def move_block(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (batch_id, seq, doc_id, node_id, position, anchor_id) of whole runs of siblings; the nodes after it, and the batches that are refused.

    A batch is one run: adjacent siblings in the order of seq, all with one anchor that is none of them nor below them.
    """
    e = edits.withColumn("request_id", F.col("batch_id"))
    bad = sibling_runs(nodes, e).where("not contiguous").select(F.col("request_id").alias("batch_id"), F.lit("NOT_A_RUN").alias("code"))
    up = nodes.select("doc_id", F.col("node_id").alias("anchor_id"), F.concat("anc_ids", F.array("node_id")).alias("_up"))
    inside = e.join(up, ["doc_id", "anchor_id"], "left").where(F.col("_up").isNull() | F.array_contains("_up", F.col("node_id")))
    bad = bad.unionByName(inside.select("batch_id", F.when(F.col("_up").isNull(), "UNKNOWN_ANCHOR").otherwise("CYCLE").alias("code"))).distinct()
    good = edits.join(bad.select("batch_id"), "batch_id", "left_anti")
    return move(nodes, good.withColumn("op", F.lit("move"))), bad


def set_attribute(nodes: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """fields[key] = the edit's name; primitive values only. An edit's own `key` goes before."""
    own = F.coalesce("key", F.lit(key)) if "key" in edits.columns else F.lit(key)
    e = edits.where("op = 'set_attribute'").select("doc_id", "node_id", own.alias("_k"), F.col("name").alias("_v"))
    old = F.coalesce("fields", F.create_map().cast("map<string, string>"))
    new = F.map_concat(F.map_filter(old, lambda k, v: k != F.col("_k")), F.create_map("_k", "_v"))
    return nodes.join(e, ["doc_id", "node_id"], "left").withColumn("fields", F.when(F.col("_k").isNotNull(), new).otherwise(F.col("fields"))).select(nodes.columns)


def set_body(nodes: DataFrame, bodies: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """bodies(doc_id, node_id, content): the nodes keep their ids, get the content and lose all below them.

    children(doc_id, node_id, parent_id, child_index, ...) are then put below them. nodes needs anc_ids.
    """
    gone = below(nodes, bodies, itself=False)
    left = plain(nodes).join(gone, ["doc_id", "node_id"], "left_anti")
    new = bodies.select("doc_id", "node_id", F.col("content").alias("_c"), F.lit(True).alias("_t"))
    left = left.join(new, ["doc_id", "node_id"], "left").withColumn("content", F.when(F.col("_t"), F.col("_c")).otherwise(F.col("content"))).select(plain(nodes).columns)
    return left if children is None else left.unionByName(children, allowMissingColumns=True).select(plain(nodes).columns)


def set_source_fragment(nodes: DataFrame, fragments: DataFrame, parse: Parser) -> tuple[DataFrame, DataFrame]:
    """fragments(doc_id, node_id, text): the nodes keep their ids, get the text as content, and what a user's parser makes of it below them.

    The nodes after it, and (doc_id, node_id, code, message) of texts that do not parse, whose nodes stay as they
    were. Ids of new nodes follow from document, node and the parser's keys. nodes needs anc_ids.
    """
    named = fragments.select(F.to_json(F.struct("doc_id", "node_id")).alias("doc_id"), "text", F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"))
    rows = settle(parsed_rows(named.select("doc_id", "text"), parse).join(named.drop("text"), "doc_id"))
    errors = rows.where("code is not null").select(F.col("_d").alias("doc_id"), F.col("_n").alias("node_id"), "code", "message")
    own = lambda c: as_uuid(F.col("doc_id"), F.col(c))
    children = rows.where("code is null").select(F.col("_d").alias("doc_id"), own("key").alias("node_id"), F.when(F.col("parent").isNull(), F.col("_n")).otherwise(own("parent")).alias("parent_id"), "child_index", "kind", F.lit("node").alias("role"), "name", "content")
    good = fragments.join(errors, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id", F.col("text").alias("content"))
    return set_body(nodes, good, children.select([c for c in children.columns if c in nodes.columns])), errors


def set_leaf_content(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes with the content of edits(doc_id, node_id, new_content); a node with children stays and has the error NOT_A_LEAF."""
    inner = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("_c")).distinct()
    j = nodes.join(edits.select("doc_id", "node_id", F.col("new_content").alias("_n"), F.lit(True).alias("_e")), ["doc_id", "node_id"], "left").join(inner, ["doc_id", "node_id"], "left")
    leaf = F.col("_c").isNull()
    j = j.withColumn("content", F.when(F.col("_e") & leaf, F.col("_n")).otherwise(F.col("content"))).withColumn("error", F.when(F.col("_e") & ~leaf, "NOT_A_LEAF"))
    return j.select(*nodes.columns, "error")


def apply_subtrees(nodes: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts edited copies of subtrees back over their origins; the nodes after it, and (doc_id, root_id, code) of the copies that are refused.

    copies: rows of nodes with `root_id`, the origin's root, which is in the copy and keeps its place. A copy is
    refused if its root isn't in the document or in the copy, or if one of its ids is a node's outside of the origin.
    """
    up = F.concat("anc_ids", F.array("node_id"))
    top = F.col("node_id") == F.col("root_id")
    here = nodes.select("doc_id", "node_id", F.col("parent_id").alias("_p"), F.col("child_index").alias("_i"), up.alias("_up"))
    met = copies.select("doc_id", "node_id", "root_id").join(here, ["doc_id", "node_id"]).where(top | ~F.array_contains("_up", F.col("root_id")))
    met = settle(met.select("doc_id", "root_id", "_p", "_i", top.alias("_top")))
    known = met.where("_top").drop("_top")
    lost = copies.select("doc_id", "root_id").distinct().join(known, ["doc_id", "root_id"], "left_anti").withColumn("code", F.lit("UNKNOWN_NODE"))
    clash = met.where("not _top").select("doc_id", "root_id", F.lit("NODE_ID_CONFLICT").alias("code"))
    bad = lost.unionByName(clash).distinct()
    good = settle(known.join(bad, ["doc_id", "root_id"], "left_anti"))
    few, many = _roots(good.select("doc_id", F.col("root_id").alias("node_id")))
    left = nodes.join(few, "doc_id", "left").where(~F.coalesce(F.arrays_overlap(up, "_roots"), F.lit(False)))
    if many is not None:
        left = left.join(below(nodes, many.withColumnRenamed("root_id", "node_id")), ["doc_id", "node_id"], "left_anti")
    new = copies.join(good, ["doc_id", "root_id"])
    new = new.withColumn("parent_id", F.when(top, F.col("_p")).otherwise(F.col("parent_id"))).withColumn("child_index", F.when(top, F.col("_i")).otherwise(F.col("child_index")))
    columns = plain(nodes).columns
    return left.select(columns).unionByName(new.select([c for c in columns if c in new.columns]), allowMissingColumns=True).select(columns), bad


def transaction(nodes: DataFrame, edits: DataFrame, versions: DataFrame, key: str = "status") -> tuple[DataFrame, DataFrame]:
    """Applies batches of edits; the nodes after it, and versions: one more for each batch that changed a document.

    Batches of a document follow each other by batch_id, and each finds the version that the last one left: a
    batch whose expected_version is another is refused. Within a batch edits go in the order of seq, each checked
    against what the ones before have made; a batch with any error leaves no trace. See transaction_report.
    """
    now, versions, _ = transaction_report(nodes, edits, versions, key)
    return now, versions


def _wave(named: DataFrame, edits: DataFrame, key: str, turn: int) -> DataFrame:
    """The table of transaction_report() after at most one edit a document, all kinds of edits in one pass."""
    at = named.select("doc_id", F.col("node_id").alias("anchor_id"), F.col("parent_id").alias("_p"), F.col("anc_ids").alias("_up"), F.col("_s").alias("_as"), F.col("_i").alias("_ai"), F.col("_rel").alias("_ar"))
    e = edits.join(at, ["doc_id", "anchor_id"], "left")
    inside = F.col("position").isin("first_child", "last_child")
    side = F.when(F.col("position").isin("first_child", "before"), -1).otherwise(1)
    # First children come before all that were first before them, last ones behind all; beside a node the latest is the nearest.
    rel = F.concat(F.slice("_ar", 1, F.size("_ar") - 1), F.array(side, -side * turn, F.lit(0)))
    own = F.coalesce("key", F.lit(key)) if "key" in edits.columns else F.lit(key)
    e = e.select(
        "doc_id", F.col("op").alias("_op"), F.col("node_id").alias("_n"), F.col("name").alias("_value"), own.alias("_key"), F.when(inside, F.col("anchor_id")).otherwise(F.col("_p")).alias("_to"),
        F.when(inside, F.concat("_up", F.array("anchor_id"))).otherwise(F.col("_up")).alias("_above"), F.when(inside, side).otherwise(F.col("_as")).alias("_es"), F.when(inside, side * turn).otherwise(F.col("_ai")).alias("_ei"), F.when(inside, F.array(F.lit(0))).otherwise(rel).alias("_er"),
    )
    j = named.join(e, "doc_id", "left")
    is_it, below_it = F.col("node_id") == F.col("_n"), F.array_contains("anc_ids", F.col("_n"))
    op = lambda x: F.coalesce(F.col("_op") == x, F.lit(False))
    kept = j.where(~(op("delete") & (is_it | below_it)))
    goes = op("move") & is_it
    anc = F.when(goes, F.col("_above")).when(op("move") & below_it, F.concat("_above", F.slice("anc_ids", F.array_position("anc_ids", F.col("_n")).cast("int"), F.size("anc_ids")))).otherwise(F.col("anc_ids"))
    old = F.coalesce("_set", F.create_map().cast("map<string, string>"))
    set_ = F.when(op("set_attribute") & is_it, F.map_concat(F.map_filter(old, lambda k, v: k != F.col("_key")), F.create_map("_key", "_value"))).otherwise(F.col("_set"))
    either = lambda a, b: F.when(goes, F.col(a)).otherwise(F.col(b)).alias(b)
    kept = kept.select("doc_id", "node_id", either("_to", "parent_id"), anc.alias("anc_ids"), either("_es", "_s"), either("_ei", "_i"), either("_er", "_rel"), (F.col("_moved") | goes).alias("_moved"), "_new", "_name", set_.alias("_set"))
    no, yes = F.lit(False), F.lit(True)
    put = e.where("_op = 'insert'").select("doc_id", F.col("_n").alias("node_id"), F.col("_to").alias("parent_id"), F.col("_above").alias("anc_ids"), F.col("_es").alias("_s"), F.col("_ei").alias("_i"), F.col("_er").alias("_rel"), no.alias("_moved"), yes.alias("_new"), F.col("_value").alias("_name"), F.lit(None).cast("map<string, string>").alias("_set"))
    return kept.unionByName(put)


def transaction_report(nodes: DataFrame, edits: DataFrame, versions: DataFrame, key: str = "status") -> tuple[DataFrame, DataFrame, DataFrame]:
    """transaction() and the errors (batch_id, seq, code), for each refused batch those of the first edits that fail.

    There are as many rounds as the most batches that wait for each other, and in a round as many waves as its
    longest batch has edits. Waves run over the nodes that edits name, and no others: what becomes of any other node
    follows from the nearest named one above it. All nodes are read twice, for the named ones and for the nodes after
    it, which are not made before they are asked for, unless nodes has ord_path or depth. nodes needs anc_ids.
    """
    spark = nodes.sparkSession
    step = F.row_number().over(W.partitionBy("batch_id").orderBy("seq"))
    open_ = settle(edits.withColumn("_step", step))
    touched = settle(open_.select("doc_id").distinct())
    asked = open_.select("doc_id", F.explode(F.array("node_id", "anchor_id")).alias("node_id")).where("node_id is not null")
    known = nodes.select("doc_id", "node_id", "parent_id", "anc_ids", F.lit(0).alias("_s"), F.col("child_index").cast("int").alias("_i"), F.array(F.lit(0)).alias("_rel"), F.lit(False).alias("_moved"), F.lit(False).alias("_new"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("map<string, string>").alias("_set"))
    first = work = settle(known.join(asked.distinct(), ["doc_id", "node_id"], "left_semi"))
    versions = settle(versions.select("doc_id", "version"))
    errors = spark.createDataFrame([], edits.select("batch_id", "seq").schema.add("code", "string"))
    turn = 0
    while not open_.isEmpty():
        # Ready: the first batch of all its documents.
        ahead = open_.groupBy("doc_id").agg(F.min("batch_id").alias("_first"))
        each = open_.select("batch_id", "doc_id").distinct().join(ahead, "doc_id")
        ready = each.groupBy("batch_id").agg(F.bool_and(F.col("batch_id") == F.col("_first")).alias("_ready")).where("_ready").select("batch_id")
        now = settle(open_.join(ready, "batch_id", "left_semi"))
        rest = settle(open_.join(ready, "batch_id", "left_anti"))
        unsettle(open_)
        open_ = rest
        bad = settle(now.join(versions, "doc_id", "left").where(~F.col("expected_version").eqNullSafe(F.col("version"))).select("batch_id", "seq", F.lit("STALE_VERSION").alias("code")))
        docs = now.select("batch_id", "doc_id").distinct()
        trees = work
        for wave in range(1, (now.agg(F.max("_step").alias("n")).first().n or 0) + 1):
            turn += 1
            live = now.where(F.col("_step") == wave).join(bad.select("batch_id"), "batch_id", "left_anti").drop("_step")
            worse = settle(bad.unionByName(preflight(live, trees)))
            live = live.join(worse.select("batch_id"), "batch_id", "left_anti")
            new = settle(_wave(trees, live, key, turn))
            if trees is not work:
                unsettle(trees)
            unsettle(bad)
            bad, trees = worse, new
        # Documents of refused batches are as before the round.
        back = docs.join(bad.select("batch_id"), "batch_id", "left_semi").select("doc_id").distinct()
        good = docs.join(back, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("_t"))
        after = settle(trees.join(back, "doc_id", "left_anti").unionByName(work.join(back, "doc_id", "left_semi")))
        if trees is not work:
            unsettle(trees)
        if work is not first:
            unsettle(work)
        work = after
        versions = settle(versions.join(good, "doc_id", "left").select("doc_id", (F.col("version") + F.coalesce("_t", F.lit(0))).alias("version")))
        errors = errors.unionByName(bad)
    if not {"ord_path", "depth"} & set(nodes.columns):
        return _after(nodes, first, work), versions, errors
    done = with_paths(_after(nodes.join(touched, "doc_id", "left_semi"), first, work).drop("anc_ids"))
    return nodes.join(touched, "doc_id", "left_anti").unionByName(done.select(nodes.columns)), versions, errors


def _after(nodes: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """nodes after a transaction, from the nodes named in it as they were first and are at last; without ord_path and depth.

    Where nodes of a document came, went or moved, all its children are numbered anew. A node that is not named goes where the nearest node above it goes that was moved or deleted. All rows are dealt once,
    by document; along the order of paths of ids the nearest such node is the last one entered and not left again.
    """
    mine = last.where("not _new").select("doc_id", "node_id", F.lit(True).alias("_here"), F.col("parent_id").alias("_to"), F.col("anc_ids").alias("_above"), *[F.col(c).alias(f"_l{c}") for c in ("_s", "_i", "_rel", "_moved", "_set")])
    ends = first.select("doc_id", "node_id", "anc_ids").join(mine, ["doc_id", "node_id"], "left").withColumn("_gone", F.col("_here").isNull())
    ends = ends.where("_gone or _l_moved or _l_set is not null").withColumn("_cut", F.col("_gone") | F.col("_l_moved"))
    fate = F.struct(F.col("_gone").alias("gone"), F.col("node_id").alias("id"), F.col("_above").alias("above"))
    cuts = ends.where("_cut").select("doc_id", F.col("node_id").alias("_a"), fate.alias("_fate"))
    inner = ends.where("_cut").select("doc_id", "node_id", F.posexplode("anc_ids").alias("_d", "_a")).join(cuts, ["doc_id", "_a"]).groupBy("doc_id", "node_id").agg(F.max_by("_fate", "_d").alias("_outer"))
    ends = ends.join(inner, ["doc_id", "node_id"], "left")
    path = F.concat("anc_ids", F.array("node_id"))
    own = F.struct(F.col("node_id").alias("id"), F.col("_l_moved").alias("moved"), F.col("_to").alias("to"), F.col("_l_s").alias("s"), F.col("_l_i").alias("i"), F.col("_l_rel").alias("rel"), F.col("_l_set").alias("set"))
    none = F.struct(F.lit(False).alias("gone"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("above"))
    mark = lambda at, fate, own, changed: F.struct(at.alias("_path"), fate.alias("_fate"), own.alias("_own"), changed.alias("_changed"))
    nothing = lambda c: F.when(F.lit(False), c)
    yes = F.lit(True)
    behind = F.concat(path, F.array(F.expr("cast(X'FF' as string)")))  # no id has this byte
    steps = F.array(mark(path, F.when(F.col("_cut"), fate), own, nothing(yes)))
    cut = F.array(mark(F.array().cast("array<string>"), nothing(fate), nothing(own), yes), mark(behind, F.coalesce("_outer", none), nothing(own), nothing(yes)))
    marks = ends.select("doc_id", F.lit(0).alias("_tag"), F.inline(F.when(F.col("_cut"), F.concat(steps, cut)).otherwise(steps)))
    columns = [c for c in nodes.columns if c not in PATHS or c == "anc_ids"]
    new = last.where("_new").select("doc_id", "node_id", "parent_id", "anc_ids", F.lit(INSERTED).alias("kind"), F.lit("node").alias("role"), F.col("_name").alias("name"), F.col("_set").alias("fields"), F.lit(2).alias("_tag"), F.array().cast("array<string>").alias("_path"), "_s", "_i", "_rel")
    new = new.drop(*[c for c in ("kind", "role", "name", "fields") if c not in columns])
    came = last.where("_new").select("doc_id", F.lit(0).alias("_tag"), F.array().cast("array<string>").alias("_path"), yes.alias("_changed"))
    all_ = nodes.select(columns).withColumn("_tag", F.lit(1))
    for part in (marks, came, new):
        all_ = all_.unionByName(part, allowMissingColumns=True)
    # By a column of its own: see settle.dealt.
    all_ = all_.withColumn("_by", F.xxhash64("doc_id")).repartition("_by").withColumn("_path", F.coalesce("_path", path))
    run = W.partitionBy("_by", "doc_id").orderBy("_path", "_tag").rowsBetween(W.unboundedPreceding, 0)
    for c in ("_fate", "_own", "_changed"):
        all_ = all_.withColumn(c, F.last(c, ignorenulls=True).over(run))
    base, is_own = F.col("_tag") == 1, F.coalesce((F.col("_tag") == 1) & (F.col("_own.id") == F.col("node_id")), F.lit(False))
    kept = all_.where((F.col("_tag") == 2) | (base & ~F.coalesce(F.col("_fate.gone"), F.lit(False))))
    moved = is_own & F.coalesce("_own.moved", F.lit(False))
    at = lambda c, else_: F.when(moved, F.col(f"_own.{c}")).when(base, else_).otherwise(F.col(f"_{c}"))
    top = F.col("_fate.id")
    anc = F.when(base & (F.col("node_id") == top), F.col("_fate.above")).when(base & top.isNotNull(), F.concat("_fate.above", F.slice("anc_ids", F.array_position("anc_ids", top).cast("int"), F.size("anc_ids")))).otherwise(F.col("anc_ids"))
    kept = kept.withColumns({"_s": at("s", F.lit(0)), "_i": at("i", F.col("child_index")), "_rel": at("rel", F.array(F.lit(0))), "parent_id": F.when(moved, F.col("_own.to")).otherwise(F.col("parent_id")), "anc_ids": anc})
    if "fields" in columns:
        set_ = F.col("_own.set")
        old = F.coalesce("fields", F.create_map().cast("map<string, string>"))
        put = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(set_), k)), set_)
        kept = kept.withColumn("fields", F.when(is_own & set_.isNotNull(), put).otherwise(F.col("fields")))
    place = (F.row_number().over(W.partitionBy("_by", "doc_id", "parent_id").orderBy("_s", "_i", "_rel", "node_id")) - 1).cast("int")
    return kept.withColumn("child_index", F.when(F.col("_changed"), place).otherwise(F.col("child_index"))).select(columns)


def copy_subtrees(nodes: DataFrame, roots: DataFrame, copy_id: str, keep_ids: bool = False) -> DataFrame:
    """The subtrees at (doc_id, node_id), each a tree of its own, with all columns of nodes but their paths.

    Ids are fresh, and the same for the same copy_id; with keep_ids they stay. origin_id maps back, root_id names the
    copied subtree and root_index its place among its siblings; origin_parent is the parent's origin_id, null for the
    root, and short_id counts the nodes of a copy from 1 in preorder. A node below two roots is in both copies.
    """
    up = F.concat("anc_ids", F.array("node_id"))
    few, many = _roots(roots)
    sub = nodes.join(few, "doc_id").withColumn("root_id", F.explode(F.array_intersect(up, "_roots"))).drop("_roots")
    if many is not None:
        sub = sub.unionByName(nodes.withColumn("root_id", F.explode(up)).join(many, ["doc_id", "root_id"], "left_semi"))
    fresh = lambda c: F.col(c) if keep_ids else as_uuid(F.lit(copy_id), F.col("doc_id").cast("string"), F.col("root_id"), F.col(c))
    copy = W.partitionBy("doc_id", "root_id").orderBy("ord_path")
    short = F.row_number().over(copy).cast("long")
    is_root = F.col("node_id") == F.col("root_id")
    at = F.first(F.when(is_root, F.col("child_index")), ignorenulls=True).over(copy.rowsBetween(W.unboundedPreceding, 0))  # a root comes first
    rest = [c for c in plain(nodes).columns if c not in ("doc_id", "node_id", "parent_id", "short_id")]
    return sub.select("doc_id", fresh("node_id").alias("node_id"), F.when(~is_root, fresh("parent_id")).alias("parent_id"), F.col("node_id").alias("origin_id"), F.when(~is_root, F.col("parent_id")).alias("origin_parent"), "root_id", at.alias("root_index"), short.alias("short_id"), *rest)


def copied_references(refs: DataFrame, copies: DataFrame) -> DataFrame:
    """Of refs(doc, node, target_doc null for local, target_node) those that the copies of copy_subtrees have.

    A target in the same copied subtree becomes the copy's own node, a local reference; any other stays as it is and
    is named with its document, as the copy may go elsewhere. origin_node and origin_target are what node and target_node
    are called in the original.
    """
    ids = copies.select("doc_id", "root_id", "origin_id", F.col("node_id").alias("_new"))
    mine = refs.join(ids, (F.col("doc") == F.col("doc_id")) & (F.col("node") == F.col("origin_id"))).select("doc", "root_id", F.col("_new").alias("node"), F.col("node").alias("origin_node"), F.coalesce("target_doc", F.col("doc")).alias("_to"), "target_node")
    there = ids.select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_r"), F.col("origin_id").alias("_o"), F.col("_new").alias("_t"))
    j = mine.join(there, (F.col("_to") == F.col("_d")) & (F.col("doc") == F.col("_d")) & (F.col("root_id") == F.col("_r")) & (F.col("target_node") == F.col("_o")), "left")
    return j.select("doc", "root_id", "node", F.when(F.col("_t").isNull(), F.col("_to")).alias("target_doc"), F.coalesce("_t", "target_node").alias("target_node"), "origin_node", F.col("target_node").alias("origin_target"))


def rewrite_references(refs: DataFrame, moved: DataFrame, source: str, target: str) -> DataFrame:
    """refs(doc, node, target_doc null for local, target_node) after nodes moved from one document to another.

    References inside the move and those from anywhere to it follow; those from it to what stays become external.
    """
    m = moved.select(F.col("node_id").alias("_m"))
    r = refs.join(m.withColumn("_s", F.lit(True)), F.col("node") == F.col("_m"), "left").drop("_m")
    r = r.join(m.withColumn("_t", F.lit(True)), F.col("target_node") == F.col("_m"), "left").drop("_m")
    from_, to = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    doc = F.when(from_, F.lit(target)).otherwise(F.col("doc"))
    goes = F.when(to, F.lit(target)).otherwise(F.coalesce("target_doc", F.when(F.col("_s"), F.lit(source)).otherwise(F.col("doc"))))
    return r.select(doc.alias("doc"), "node", F.when(goes != doc, goes).alias("target_doc"), "target_node")
