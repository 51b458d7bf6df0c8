"""Conversation repair against a brute-force version."""

import functools
import hashlib
import re
import sys
import zlib

import numpy as np
import pytest

from caselog.llm import conversations as C

sys.setrecursionlimit(20_000)

KEEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
TO = {0: 2, 1: 2, 2: 3, 3: 2}


def brute_repair(rows):
    """(cost, audit, repaired rows) by plain recursion over strings; rows are (role, text, fault)."""

    @functools.cache
    def best(i, s, inserted):
        found = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        if inserted < 3:
            c, a, out = best(i, TO[s], inserted + 1)
            found.append((c + 2, "I" + a, (("user" if TO[s] == 2 else "assistant", ""),) + out))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, out = best(i + 1, s, 0)
            found.append((c + 3, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] in KEEPS[s]:
                    c, a, out = best(i + 1, KEEPS[s][role[:1]], 0)
                    found.append((c + cut, "K" + a, ((role, text),) + out))
                c, a, out = best(i + 1, TO[s], 0)
                found.append((c + 2 + cut, "R" + a, (("user" if TO[s] == 2 else "assistant", text),) + out))
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 0)


def brute_report(rows):
    """The report of (conv_id, turn, role, text) rows by the contract."""
    blank = lambda v: " " if v is None else str(v)
    held = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text, fate = blank(role), blank(text), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, found in held.items():
        sig = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], sig(*x[1:])))
        seen, faulty = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, *_ in found if t is not None}
        count = lambda k: sum(f == k for *_, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, left = brute_repair(tuple(faulty))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def report(spark, rows):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r[0]: tuple(r[1:]) for r in C.repair_report(df, C.damage(df)).collect()}


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = report(spark, df)
    assert got and got == brute_report(rows)


def random_rows(rng, n, convs):
    roles, texts = ["system", "user", "assistant", None, "", "tool"], ["Yes.", "no", "", None, " \t", "ok!", "fine. ", "Why?"]
    pick = lambda xs, p: xs[rng.choice(len(xs), p=p)]
    return [(None if rng.random() < 0.05 else int(rng.integers(convs)), None if rng.random() < 0.05 else int(rng.integers(n // convs + 2)),
             pick(roles, [0.15, 0.35, 0.35, 0.05, 0.05, 0.05]), pick(texts, [0.2, 0.2, 0.05, 0.05, 0.05, 0.15, 0.15, 0.15]) if rng.random() < 0.5 else f"line {rng.integers(900)}.")
            for _ in range(n)]


@pytest.mark.parametrize("convs", [60, 2])
def test_awkward_rows(spark, convs):
    """Nulls, ties, repeated rows, unknown roles; with two conversations each spans several slices."""
    rows = random_rows(np.random.default_rng(convs), 400, convs)
    assert report(spark, rows) == brute_report(rows)


def test_a_conversation_of_one_repeated_row(spark):
    rows = [(1, 2, "user", "again and again.")] * 300 + [(2, None, None, None), (2, 3, "assistant", "x" * 100_000 + ".")]
    assert report(spark, rows) == brute_report(rows)


def test_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert report(spark, [(7, gone, "user", "x")]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(spark, empty) == {} and C.repair_conversations(empty).edits.count() == 0


def test_other_columns_are_free(spark):
    rows = [(1, 0, "user", "a.", "x", 1, "s"), (1, 1, "user", "b", "x", 1, "s"), (2, 0, "system", "c.", "x", 1, "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, edit string, slice int, sig string")
    assert report(spark, df) == brute_report([r[:4] for r in rows])


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (1, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.repair_conversations(df)
    got = [(r["edit"], r["role"], r["text"]) for r in found.edits.orderBy("slice", "step").collect()]
    assert got == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("R", "assistant", "Well?"), ("D", None, None)]
    assert found.summary.select("blank", "illegal", "cost").first()[:] == (1, 1, 5)


def test_ranks_order_audits():
    """Ranks by doubled lengths equal the order of the audits themselves."""
    rng = np.random.default_rng(3)
    initials, faults = [str(x) for x in rng.choice(list("sua"), 60)], [int(x) for x in rng.integers(0, 4, 60)]
    costs = C.costs_to_end(initials, faults, C.END)
    arcs = np.array(C.optimal_arcs(initials, faults, costs, True, 0))
    texts = {}

    def audit(v):
        if v not in texts:
            texts[v] = next((C.LETTERS[k] + audit(t) for k, t in enumerate(arcs[v]) if t >= 0), "")
        return texts[v]

    for v in range(len(arcs) - 1, -1, -1):
        audit(v)
    ranks = C.ranked(arcs)
    order = sorted(range(len(arcs)), key=lambda v: texts[v])
    assert all((ranks[a] < ranks[b]) == (texts[a] < texts[b]) for a, b in zip(order, order[1:]))
    path, node, letter = C.least_paths(arcs, np.array([0, 4]))
    assert ["".join(C.LETTERS[x] for x in letter[path == p]) for p in (0, 1)] == [texts[0], texts[4]]
