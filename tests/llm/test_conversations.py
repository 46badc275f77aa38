"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from conftest import SF001
from lexiscope.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
START = re.compile(r"s?(ua)*u?")


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by a search over
    edits in order of cost, then audit."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, list(kept)
        # what can follow depends on the last two initials alone
        key = (at, roles[-2:] if len(roles) > 1 else roles, bool(roles))
        if key in seen:
            continue
        seen.add(key)
        options = [(2, "I", at, role, "") for role in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            late = fault == "truncated"
            options.append((3, "D", at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                options.append((late, "K", at + 1, role, text))
                options += [(2 + late, "R", at + 1, r, text) for r in ("user", "assistant")]
        for price, move, after, role, text in options:
            grown = roles if role is None else roles + (role[:1] or "?")
            if START.fullmatch(grown):
                heapq.heappush(heap, (cost + price, audit + move, after, grown, kept if role is None else (*kept, (role, text))))
    raise AssertionError


def faults(rows):
    """(role, text, fault) of rows (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def summary(turns, rows):
    rows = faults(rows)
    known = [t for t in turns if t is not None]
    kinds = [f for _, _, f in rows]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, kept = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def damaged(rows):
    """conv_id -> (turns, rows) of plain rows (conv_id, turn, role, text)."""
    said = lambda x: " " if x is None else str(x)
    out = defaultdict(lambda: ([], []))
    for conv, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0)):
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns, own = out[conv]
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            turns.append(turn)
            own.append((role, text))
    return out


def words_of(rows):
    """The reversed word of rows with their faults."""
    out = ""
    for role, _, fault in rows:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out += "X" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    return out[::-1]


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b", " ", "c!"])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=6))
def test_stack_finds_the_cheapest_edits(many):
    words = {words_of(faults(rows)): faults(rows) for rows in many}
    stack = conversations.SuffixStack()
    for word in sorted(words):
        assert stack.read(word) == cheapest(words[word])[:2]


def test_nodes_are_made_once():
    words = sorted({a + b + c + d for a in "suXA" for b in "uaX" for c in "uaSo" for d in "uaU"})
    stack = conversations.SuffixStack()
    for word in words:
        stack.read(word)
    assert stack.made == len({w[:k] for w in words for k in range(1, 5)})


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {(conv, *summary(turns, own)) for conv, (turns, own) in damaged(rows).items()}
    df = entry.queries()["op13_conversation_repair"](spark, SF001)
    got = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len({r[0] for r in rows})


def test_odd_rows(spark):
    long = "word " * 100_000 + "."
    rows = [(conv, turn, role, text) for conv in (None, 1, 2, 3, 40, 41) for turn, role, text in [
        (None, "system", "Be brief."), (3, "user", None), (3, "user", None), (4, None, "hm."), (5, "assistant", long), (7, "user", "cut"),
        (7, "user", "cut"), (9, "assistant", "\t\n"), (10, "", "x."), (-2, "User", "y.")]]
    rows += [(c, 0, "user", "only.") for c in range(100, 140)] + [(500, t, "u" if t % 2 == 0 else "a", f"{t}.") for t in range(700)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit int, `a.b` string, copies string")
    got = conversations.repair_conversations(conversations.damage(df.repartition(5)), copies="copies").collect()
    want = {conv: summary(turns, own) for conv, (turns, own) in damaged(rows).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert {v[6] for c, v in want.items() if c and c >= 100} >= {"", "KI"}  # a conversation without rows
    empty = df.where("conv_id > 1000")
    assert conversations.repair_conversations(empty).collect() == []


def test_undamaged_rows_and_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "system", "S."), (2, 1, "assistant", "A"), (2, 2, "user", " "),
            (3, 5, "user", "q?"), (3, 6, "user", "q?"), (3, 8, "assistant", "r.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = {r["conv_id"]: (r["cost"], r["audit"], r["gaps"]) for r in conversations.repair_conversations(df).collect()}
    assert plans[1] == (0, "KK", 0) and plans[3] == (3, "KDK", 1)
    assert plans[2] == cheapest(faults([r[2:] for r in rows if r[0] == 2]))[:2] + (0,)
    got = defaultdict(list)
    for r in sorted(conversations.repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    for conv in (1, 2, 3):
        assert got[conv] == cheapest(faults([r[2:] for r in rows if r[0] == conv]))[2]


@pytest.mark.parametrize("word, audit", [("", ""), ("s", "D"), ("su", "KKI"), ("a", "IK"), ("au", "KK"), ("X", "D")])
def test_audits(word, audit):
    found = conversations.SuffixStack().read(word[::-1] if word != "au" else "au")[1]
    assert found == audit
