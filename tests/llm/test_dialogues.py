import hashlib
import random
import re
import zlib

import pytest

from arborlake.llm import dialogues as D


def damaged(rows):
    """conv -> rows (turn, role, text) in order after the damage; every id has an entry."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        mine += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def brute(rows):
    """The contract for one conversation's rows, by a table over (row, last letters) with whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def after(state, x):  # letters so far that matter: "", "s", "u" or "a"
        return x if (state, x) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    to = after(state, x)
                    if to:
                        way = cost + 3, audit + "I", out + [role + ":"]
                        if to not in table or way[:2] < table[to][:2]:
                            table[to] = way
        return table

    table = insert({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(to, way):
            if to is not None and (to not in new or way[:2] < new[to][:2]):
                new[to] = way

        for state, (cost, audit, out) in table.items():
            put(state, (cost + 4, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                put(after(state, role[:1]), (cost + extra, audit + "K", out + [role + ":" + text]))
                for x, name in (("u", "user"), ("a", "assistant")):
                    put(after(state, x), (cost + 3 + extra, audit + "R", out + [name + ":" + text]))
        table = insert(new)
    cost, audit, out = min((table[s] for s in ("", "a") if s in table), key=lambda w: w[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def held(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"conv_id {kind}, turn long, role string, text string, audit string, seq int")
    got = {r[0]: tuple(r[1:]) for r in D.repair_conversations(df).collect()}
    assert got == {c: brute(r) for c, r in damaged(rows).items()}
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in D.repair_conversations(df).collect()}
    assert got == {c: brute(r) for c, r in damaged(rows).items()}
    assert {"K", "D"} <= set("".join(v[6] for v in got.values()))


def random_rows(seed, convs=150, most=14):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "u2"])
            text = rng.choice(["Yes.", "No!", "why", " ", "", None, f"turn {t}.", f"turn {t}", "end? \n"])
            rows.append((rng.choice([c, c, c, None]), rng.choice([t, 2 * t, None, t]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    held(spark, random_rows(seed))


def test_short_segments_and_small_grammars_change_nothing(spark, monkeypatch):
    rows = random_rows(5, 6, 60) + [(99, t, r, f"{t}.") for t in range(400) for r in (["user", "assistant"][t % 2],)]
    want = held(spark, rows)
    seqs = {}
    for size in (1, 3, 50):
        for most in (0, 5, 192):
            g = D.Grammar()
            text = "".join(random.Random(4).choice(D.FINE + D.CUT + D.GONE) for _ in range(200))
            for pair in ("us", "ua", "au", "sa")[: most and 4]:
                if len(g.rules) < most:
                    g.add(pair)
            m = {(i, i): (0, "") for i in range(4)}
            for i in range(0, 200, size):
                m = D.product(m, g.evaluate(text[i : i + size]))
            seqs[size, most] = {k: (c, D.letters(r)) for k, (c, r) in m.items()}
    assert len({str(sorted(v.items())) for v in seqs.values()}) == 1
    assert want[99][5] >= 0


def test_long_conversation_over_segments(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], f"{t % 5000}.") for t in range(9500)] + [(8, 0, "user", "Hi.")]
    got = held(spark, rows)
    assert got[7][2] > 3000


def test_rules_are_shared(spark):
    df = spark.createDataFrame([("uaua" * 8, 50), ("suaua", 20), ("uUao", 3)], "seq string, n long")
    g = D.learn(df)
    assert 2 < len(g.rules) <= D.MOST_RULES
    assert all(len(p) == 2 for p, _ in g.rules) and len(g.encode("uaua" * 8)) < 5


def test_odd_rows(spark):
    assert held(spark, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = held(spark, [(lost, 0, "user", "Gone."), (None, None, None, None), (5, 1, "user", "Hi." * 100_000)] + [(6, 3, "assistant", "Same.")] * 50)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    held(spark, [("a", 1, "user", "Hi."), ("", 1, "user", "Hi."), (None, 1, "user", "Hi.")], "string")
