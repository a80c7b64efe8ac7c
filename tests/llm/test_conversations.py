"""Conversation repair against an exhaustive search and a plain re-computation of the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlark.llm import conversations, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def replay(edits, rows):
    """Repaired rows and cost of an edit string, or None where it does not fit the rows."""
    out, cost, used = [], 0, 0
    for edit in edits:
        state = "".join(r[:1] for r, _ in out)
        role = {"u": "user", "a": "assistant"}["a" if state.endswith("u") else "u"]
        if edit == "I":
            out.append((role, ""))
            cost += 5
            continue
        own, text, fault = rows[used]
        used += 1
        if edit == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        out.append((own if edit == "K" else role, text))
        cost += (edit == "R") + 5 * (fault == "truncated")
    return (cost, out) if used == len(rows) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) else None


def cheapest(rows):
    """Cost and ASCII-least of the cheapest edit strings, compared as plain strings."""
    states = {"": {(0, "")}}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    wish = {"": "u", "s": "u", "u": "a", "a": "u"}
    for role, _, fault in rows:
        for _ in range(2):
            for state, strings in list(states.items()):
                states.setdefault(wish[state], set()).update({(c + 5, e + "I") for c, e in strings if not e.endswith("II")})
        after = defaultdict(set)
        for state, strings in states.items():
            for cost, edits in strings:
                after[state].add((cost + 2, edits + "D"))
                if fault not in ("blank", "duplicate"):
                    stay = cost + 5 * (fault == "truncated")
                    after[wish[state]].add((stay + 1, edits + "R"))
                    if role[:1] in step[state]:
                        after[step[state][role[:1]]].add((stay, edits + "K"))
        states = {s: {min(v)} for s, v in after.items()}
    ends = set()
    for state, strings in states.items():
        for cost, edits in strings:
            s = state
            while s not in ("", "a"):
                s, cost, edits = wish[s], cost + 5, edits + "I"
            ends.add((cost, edits))
    return min(ends)


def expected(table):
    found = {}
    grouped = defaultdict(list)
    for conv, turn, role, text in table:
        grouped[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, lines in grouped.items():
        rows = []
        for turn, role, text in lines:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, counts = set(), [], defaultdict(int)
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "ok"
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, edits = cheapest(marked)
        again, out = replay(edits, marked)
        assert again == cost
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                       cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out)
    return found


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice(["ok"] * 3 + ["blank", "duplicate", "truncated"])) for i in range(n)]


FAULTS = {"ok": conversations.OK, "blank": conversations.BLANK, "duplicate": conversations.DUPLICATE, "truncated": conversations.TRUNCATED}


def mended(rows):
    out = []
    repair = conversations.Repair(lambda role, text: out.append((role, text)))
    for role, text, fault in rows:
        repair.add(role, text, FAULTS[fault])
    return (*repair.finish(), out, repair)


def test_repair_is_the_least_of_all_edit_strings():
    rng = random.Random(3)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        every, layer = [], [""]
        for _ in range(len(rows) + 3):
            layer = [e + x for e in layer for x in "DIKR"]
            every += layer
        fits = [(found[0], e) for e in every + [""] if sum(x != "I" for x in e) == len(rows) and (found := replay(e, rows))]
        cost, edits, out, _ = mended(rows)
        assert (cost, edits) == min(fits) and out == replay(edits, rows)[1]


def test_repair_of_long_conversations():
    rng = random.Random(4)
    for n in (7, 40, 300):
        for _ in range(5):
            rows = random_rows(rng, n)
            cost, edits, out, _ = mended(rows)
            assert (cost, edits) == cheapest(rows) and out == replay(edits, rows)[1]


def test_rows_that_are_settled_leave_memory():
    rng = random.Random(5)
    held = 0
    repair = conversations.Repair(lambda role, text: None)
    for i in range(20_000):
        repair.add(("user", "assistant")[i % 2], "x", rng.choice([0] * 9 + [1, 2, 3]))
        held = max(held, len(repair.rows), len(repair.tree.edit) // 8)
    assert held < 2000


def test_strings_compare_by_longest_common_prefix():
    rng = random.Random(6)
    tree = conversations.Audits()
    nodes = [0]
    for _ in range(400):
        nodes.append(tree.add(rng.choice(nodes[-8:]), rng.choice("DIKR")))
    nodes += [tree.add(0, tree.text(n)) for n in nodes[::20]]  # equal strings on nodes of their own
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(conversations, "_MOD", 3)
    tree = conversations.Audits()
    rng = random.Random(7)
    strings = ["".join(rng.choices("DIKR", k=rng.randint(0, 12))) for _ in range(80)]
    nodes = [tree.add(0, s) for s in strings]
    for a, x in zip(nodes, strings):
        for b, y in zip(nodes, strings):
            assert tree.less(a, b) == (x < y)
    rows = random_rows(rng, 60)
    assert mended(rows)[:2] == cheapest(rows)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in rng.sample(range(12), rng.randint(1, 9)) + [None] * rng.choice([0, 0, 1, 2]):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Hi.", "Yes!", "What?", "cut off", "", " \n\t", " ", None, "same.", "end. \r\n", "\U0001f600"])))
    rows += rows[:40]  # repeated rows
    rows += [(900, t, ("user", "assistant")[t % 2], f"Line {t}." if t % 7 else "Again.") for t in range(1500)]
    rows += [(901, 0, "user", "long " * 100_000 + "."), (901, 1, "assistant", "ok."), (902, None, "user", "No turn."), (902, None, "assistant", "No.")]
    rows += [(c, 0, "user", "Alone.") for c in range(1000, 1100)]
    return rows


def check(found, want):
    got = {r["conv_id"]: tuple(r)[1:9] for r in found.collect()}
    assert got == {c: v[:8] for c, v in want.items()}


def test_audit_of_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("fault", "gone", "mark", "kind", "first", "audit"):
        df = df.withColumn(name, F.lit("clash"))
    want = expected(odd_rows)
    assert any(not v[6] for v in want.values())  # some lose all rows
    check(conversations.audit(conversations.damage(df)), want)
    out = defaultdict(list)
    for r in conversations.repaired(conversations.damage(df)).orderBy("place").collect():
        out[r["conv_id"]].append((r["role"], r["text"]))
    assert out == {c: v[8] for c, v in want.items() if v[8]}


def test_audit_of_an_empty_table(spark):
    rows = conversations.damage(spark.createDataFrame([], SCHEMA))
    assert conversations.audit(rows).count() == 0 and conversations.repaired(rows).count() == 0


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.QUERIES["op11_conversation_repair"](spark, SMALL), expected(table))
