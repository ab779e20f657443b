"""JSON edits against Python's own lists and dictionaries."""

import copy
import json
import random

from arborlake.operators import jsonedits as E
from arborlake.sources.jsontree import json_nodes


def value(rng, depth=3):
    kind = rng.choice("oaasnbz" if depth else "snbz")
    if kind == "o":
        return {k: value(rng, depth - 1) for k in sorted(rng.sample(["a", "b/c", "d~", "e é", "0"], rng.randint(0, 4)))}
    if kind == "a":
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {"s": rng.choice(["", 'q"\\', "é\n"]), "n": rng.randint(-5, 5), "b": True, "z": None}[kind]


def token(k):
    return str(k).replace("~", "~0").replace("/", "~1")


def pointers(x, at=""):
    yield at
    for k, v in (x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()):
        yield from pointers(v, f"{at}/{token(k)}")


def walk(x, tokens):
    for t in tokens:
        t = t.replace("~1", "/").replace("~0", "~")
        if isinstance(x, list):
            x = x[int(t)]
        elif isinstance(x, dict):
            x = x[t]
        else:
            raise KeyError(t)
    return x


def applied(root, op, pointer, text, anchor, side):
    """The document after the edit, and the code."""
    if op not in ("set", "delete", "insert"):
        return root, "BAD_OP"
    if pointer == "" and op != "set":
        return root, "ROOT"
    try:
        new = json.loads(text) if op != "delete" else None
    except (TypeError, ValueError):
        return root, "BAD_JSON"
    if pointer == "":
        return new, None
    root = copy.deepcopy(root)
    *up, last = pointer.split("/")[1:]
    try:
        parent = walk(root, up)
    except (KeyError, IndexError, ValueError):
        return root, "NO_PARENT"
    if isinstance(parent, list):
        if not (last.isdigit() and str(int(last)) == last or last == "-" and op == "insert"):
            return root, "BAD_INDEX"
        i = len(parent) if last == "-" else int(last)
        if op == "insert":
            parent.insert(i, new)
        elif i >= len(parent):
            return root, "NOT_FOUND"
        elif op == "set":
            parent[i] = new
        else:
            del parent[i]
        return root, None
    if not isinstance(parent, dict):
        return root, "NOT_A_CONTAINER"
    key = last.replace("~1", "/").replace("~0", "~")
    if op == "set":
        parent[key] = new
    elif op == "delete":
        if key not in parent:
            return root, "NOT_FOUND"
        del parent[key]
    elif key in parent:
        return root, "KEY_EXISTS"
    elif anchor is not None:
        names = list(parent)
        beside = anchor.replace("~1", "/").replace("~0", "~")
        if beside not in parent:
            return root, "NO_ANCHOR"
        at = names.index(beside) + (side != "before")
        items = list(parent.items())
        items.insert(at, (key, new))
        parent.clear()
        parent.update(items)
    else:
        parent[key] = new
    return root, None


KIND = "doc_id long, seq int, op string, pointer string, value string, anchor string, side string"


def test_random_edits(spark):
    rng = random.Random(11)
    docs, edits, want, codes = [], [], {}, {}
    for d in range(120):
        x = {"a": [value(rng) for _ in range(rng.randint(0, 4))], "b/c": value(rng), "z": {"k": 1, "m": [[1, 2], [3]]}}
        docs.append((d, json.dumps(x)))
        for s in range(rng.randint(0, 4)):
            at = rng.choice(list(pointers(x)))
            if rng.random() < 0.5:
                at += "/" + rng.choice(["0", "1", "7", "-", "a", "new", "01", "b~1c", "gone/x"])
            op = rng.choice(["set", "delete", "insert", "insert", "delete", "swap"])
            text = rng.choice([json.dumps(value(rng)), json.dumps(value(rng)), "{bad", None])
            anchor, side = rng.choice([(None, None), ("a", "before"), ("k", "after"), ("0", "after")])
            edits.append((d, s, op, at, text, anchor, side))
            x, codes[d, s] = applied(x, op, at, text, anchor, side)
        want[d] = x
    assert {"ROOT", "BAD_INDEX", "KEY_EXISTS", "NO_PARENT", "NOT_FOUND", "NO_ANCHOR", "BAD_JSON", "NOT_A_CONTAINER", None} <= set(codes.values())
    nodes = json_nodes(spark.createDataFrame(docs, "doc_id long, json string"))
    now, report = E.edit_json(nodes, spark.createDataFrame(edits, KIND))
    assert {(r.doc_id, r.seq): r.code for r in report.collect()} == codes
    got = {r.doc_id: r.json for r in E.json_text(now).collect()}
    assert {d: json.loads(t) for d, t in got.items()} == want
    rows = {}
    for r in now.collect():
        rows.setdefault(r.doc_id, set()).add(r.pointer)
    assert rows == {d: set(pointers(x)) for d, x in want.items()}


def test_members_keep_their_order(spark):
    nodes = json_nodes(spark.createDataFrame([(1, '{"a":1,"b":2,"c":3}')], "doc_id long, json string"))
    edits = [(1, 0, "insert", "/n", "[1]", "b", "before"), (1, 1, "insert", "/m", "0", "b", "after"), (1, 2, "delete", "/a", None, None, None), (1, 3, "insert", "/n/0", "{}", None, None)]
    now, _ = E.edit_json(nodes, spark.createDataFrame(edits, KIND))
    assert E.json_text(now).first().json == '{"n":[{},1],"b":2,"m":0,"c":3}'


def test_nothing_to_do(spark):
    nodes = json_nodes(spark.createDataFrame([(1, "[1]")], "doc_id long, json string"))
    now, report = E.edit_json(nodes, spark.createDataFrame([], KIND))
    assert E.json_text(now).first().json == "[1]" and report.collect() == []
    assert E.json_text(nodes.where("false")).collect() == []
