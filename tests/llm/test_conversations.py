"""Conversation repair against exhaustive search, a plain program over whole conversations, and its own grammar."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import types as T

from marginalia.llm import conversations
from marginalia.llm.conversations import Grammar, damaged, grammar_rules, repair, replay, symbol, transcript_hashes

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("ord", T.StringType()), T.StructField("piece", T.LongType())])
GOOD = re.compile(r"(s?(ua)+)?")
NEVER = {conversations.BLANK, conversations.DUPLICATE}


def exhaustive(turns):
    """(cost, audit) over all choices of edits with up to two inserts in a gap; turns: (initial, fault)."""
    gaps = [(3 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")]
    best = None

    def choices(initial, fault):
        yield 4, "D", ""
        if fault not in NEVER:
            more = 3 if fault == conversations.TRUNCATED else 0
            yield more, "K", initial or "?"
            yield 3 + more, "R", "u"
            yield 3 + more, "R", "a"

    for edits in itertools.product(*(list(choices(*t)) for t in turns)):
        for inserted in itertools.product(gaps, repeat=len(turns) + 1):
            parts = [inserted[0]] + [p for pair in zip(edits, inserted[1:], strict=True) for p in pair]
            if GOOD.fullmatch("".join(p[2] for p in parts)):
                found = (sum(p[0] for p in parts), "".join(p[1] for p in parts))
                best = found if best is None else min(best, found)
    return best


def test_every_short_sequence_equals_exhaustive_search():
    grammar = Grammar([])
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in (0, 1, 2)]
    for n in (0, 1, 2):
        for turns in itertools.product(kinds, repeat=n):
            assert grammar.repaired("".join(symbol(*t) for t in turns)) == exhaustive(turns), turns
    r = random.Random(3)
    for _ in range(40):
        turns = [r.choice(kinds) for _ in range(3)]
        assert grammar.repaired("".join(symbol(*t) for t in turns)) == exhaustive(turns), turns


def step_by_step(turns):
    """The same by a walk over the turns with the best (cost, audit) of each state."""
    moves = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    states = {0: (0, "")}

    def put(to, s, found):
        if s not in to or found < to[s]:
            to[s] = found

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                for x in "ua":
                    if (x, s) in moves:
                        put(out, moves[x, s], (c + 3, a + "I"))
        return out

    for initial, fault in turns:
        to = {}
        for s, (c, a) in inserted(states).items():
            put(to, s, (c + 4, a + "D"))
            if fault not in NEVER:
                c += 3 if fault == conversations.TRUNCATED else 0
                if (initial, s) in moves:
                    put(to, moves[initial, s], (c, a + "K"))
                for x in "ua":
                    if (x, s) in moves:
                        put(to, moves[x, s], (c + 3, a + "R"))
        states = to
    return min(v for s, v in inserted(states).items() if s in (0, 3))


@pytest.mark.parametrize("rules", [[], ["EI", "IE"], [chr(69) + chr(73), chr(256) + chr(256), chr(257) + chr(257), chr(258) + chr(69), chr(66) + chr(66)]])
def test_rules_do_not_change_results(rules):
    grammar, r = Grammar(rules), random.Random(len(rules))
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in (0, 0, 0, 1, 2, 3)]
    for n in (5, 8, 30, 200):
        for _ in range(12):
            turns = [r.choice(kinds) for _ in range(n)] if r.random() < 0.5 else [("ua"[i % 2], int(r.random() < 0.1)) for i in range(n)]
            assert grammar.repaired("".join(symbol(*t) for t in turns)) == step_by_step(turns)


def test_a_long_conversation():
    r = random.Random(9)
    turns = [("ua"[i % 2] if r.random() < 0.9 else r.choice(["u", "a", "s", ""]), int(r.random() < 0.05)) for i in range(20000)]
    cost, audit = Grammar(["EI"]).repaired("".join(symbol(*t) for t in turns))
    assert (cost, audit) == step_by_step(turns)


def plain_version(rows):
    """Per conv_id: everything that the query returns, from whole conversations."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 2 if not end else 3 if (role, text) in seen else 1 if end not in ".!?" else 0
            seen.add((role, text))
            marks.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        cost, audit = step_by_step(marks)
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        lines, state, i = [], "", 0
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = "user" if state in ("", "s", "a") else "assistant"
            if e == "K":
                role = turns[i][1]
            lines.append(f"{role}:{'' if e == 'I' else turns[i][2]}")
            i += e != "I"
            state = role[0]
        assert GOOD.fullmatch("".join(x[0] for x in lines))
        faults = [m[1] for m in marks]
        out[conv] = (gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_rows(seed=2, count=60):
    r = random.Random(seed)
    rows = []
    for conv in [*range(count), None]:
        roles = ["system"] * (r.random() < 0.3) + ["user", "assistant"] * r.randint(0, 5)
        for turn, role in enumerate(roles):
            if r.random() < 0.1:
                continue
            text = r.choice(["Yes. ", "no", "", " \n", "What?\n\t", "é!", None, "a. b", "long " * 50 + ".", "ok.\x85"])
            rows.append((conv, None if r.random() < 0.07 else turn, r.choice([role] * 8 + [None, "user", "", "tool", "agent"]), text, "d", "o", 1))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows += [(1000, i % 400 if i % 9 else None, ("user", "assistant")[i % 2], f"turn {i % 90}.", "d", "o", 1) for i in range(3000)]  # one conversation with most rows
    rows += [(1001, 5, "user", "the same", "d", "o", 1)] * 700  # one row, repeated
    return rows


def test_conversations_equal_the_plain_version(spark):
    rows = made_rows()
    turns, found = repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    joined = found.join(transcript_hashes(turns), "conv", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["sha256"] or empty) for r in joined}
    want = plain_version(rows)
    assert len(joined) == len(got) == len(want)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_repaired_turns_are_whole_and_in_order(spark):
    rows = [(7, 1, "user", "Hello.", "d", "o", 1), (7, 2, "user", "Are you there?", "d", "o", 1), (7, 3, "assistant", "Yes.", "d", "o", 1), (8, 1, "assistant", "Alone", "d", "o", 1)]
    turns, _ = repair(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r)[1:] for r in turns.orderBy("conv", "ord", "part").select("conv", "conv_id", "edit", "role", "text").collect()]
    assert got == [(7, "K", "user", "Hello."), (7, "I", "assistant", ""), (7, "K", "user", "Are you there?"), (7, "K", "assistant", "Yes.")]


def test_frequent_pairs_become_rules(spark):
    sequences = spark.createDataFrame([("EIEIEIEI",), ("EIEI",), ("AEI",), ("",), ("F",)], "sequence string")
    rules = grammar_rules(sequences)
    assert rules[0] == "EI"
    assert len(Grammar(rules).compressed("EIEIEIEI")) < 4


def test_replay_names_every_role():
    user = symbol("u", 0)
    assert list(replay(user * 3, "KIKDI")) == [("", "K", ""), ("a", "K", ""), ("", "D", ""), ("a", "", "")]
    assert list(replay(user * 2, "KR")) == [("", "K", ""), ("", "R", "a"), ("", "", "")]
    sequence = symbol("", 0) + symbol("u", 0)
    cost, audit = Grammar([]).repaired(sequence)
    assert (cost, audit) == step_by_step([("", 0), ("u", 0)])
    assert sum(bool(e) for _, e, _ in replay(sequence, audit)) == 2


def test_an_empty_table(spark):
    turns, found = repair(damaged(spark.createDataFrame([], SCHEMA)))
    assert turns.collect() == [] and found.collect() == [] and transcript_hashes(turns).collect() == []


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?", "d", "o", 1) for c in (1, 2, None) for t in (*range(30), None)]
    want = []
    for c, t, role, text, *_ in rows:
        place = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if place == 1 else re.sub("[.!?]", "", text) if place == 2 else text
        want += [(c, t, "user" if place == 4 else role, text)] * (0 if place == 0 else 2 if place == 3 else 1)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
