"""Conversation repair against a search over all edit scripts."""

import random
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from linkgraph.llm import alignment, conversation_repair
from linkgraph.llm.alignment import ACCEPTED, FAR

SPACES = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(codes, state=0):
    """(cost, audit, edits) of the least repair: every edit at every turn, in every state of the grammar."""

    @lru_cache(None)
    def best(i, state, added):
        ways = []
        if i == len(codes):
            if state in (0, 3):
                ways.append((0, "", ()))
        else:
            code, extra = codes[i], 3 if codes[i].isupper() else 0
            c, a, e = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, ("D", *e)))
            if code != "x":
                for letter, to in NEXT[state].items():
                    if code.lower() == letter:
                        c, a, e = best(i + 1, to, 0)
                        ways.append((c + extra, "K" + a, ("K", *e)))
                    elif letter != "s":
                        c, a, e = best(i + 1, to, 0)
                        ways.append((c + extra + 3, "R" + a, (letter.upper(), *e)))
        if added < 3:
            for letter, to in NEXT[state].items():
                if letter != "s":
                    c, a, e = best(i, to, added + 1)
                    ways.append((c + 3, "I" + a, (letter, *e)))
        return min(ways, default=(FAR, "", ()))

    return best(0, state, 0)


def flat(edits):
    return tuple(x for e in edits for x in e)


def test_alignment_finds_the_least_audit():
    draw = random.Random(5)
    for _ in range(3000):
        codes = "".join(draw.choice("suaoxSUAO" if draw.random() < 0.5 else "ua") for _ in range(draw.randrange(11)))
        found = alignment.Segment(codes, True).walk(0, ACCEPTED)
        cost, audit, edits = cheapest(codes)
        assert (found.cost, alignment.audit_of(found.edits), flat(found.edits)) == (cost, audit, edits), codes


def test_long_alignment_is_banded():
    codes = "s" + "ua" * 1500
    cut = codes[:700] + codes[703:1900] + "aa" + codes[1900:]
    found = alignment.Segment(cut, True)
    assert found.table(3).shape == (found.n + 1, found.n + found.band + 2)
    assert found.walk(0, ACCEPTED).cost == cheapest_cost(cut)


def cheapest_cost(codes):
    """Costs alone, from the end, without recursion."""
    after = [0, FAR, FAR, 0]
    for code in reversed(codes + "$"):
        own = list(after)
        if code != "$":
            extra = 3 if code.isupper() else 0
            own = []
            for state in range(4):
                ways = [after[state] + 4]
                if code != "x":
                    for letter, to in NEXT[state].items():
                        if code.lower() == letter or letter != "s":
                            ways.append(after[to] + extra + (3 if code.lower() != letter else 0))
                own.append(min(ways))
        for _ in range(4):
            own = [min([own[s], *(own[to] + 3 for letter, to in NEXT[s].items() if letter != "s")]) for s in range(4)]
        after = own
    return after[0]


def expected(rows):
    """What the contract says, conversation by conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        key = " " if conv is None else str(conv)
        turns = groups.setdefault((conv, key), [])
        kind = crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    from hashlib import md5

    found = []
    for (conv, _), turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), md5(t[2].encode()).hexdigest()))
        seen, codes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            inked = text.strip(SPACES)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, edits = cheapest(codes)
        lines, rest = [], iter(turns)
        for edit in edits:
            if edit in "ua":
                lines.append({"u": "user:", "a": "assistant:"}[edit])
                continue
            _, role, text = next(rest)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else {'U': 'user', 'A': 'assistant'}[edit]}:{text}")
        digest = sha256("\n".join(lines).encode()).hexdigest()
        found.append((conv, gaps, *count.values(), illegal, cost, audit, digest))
    return found


def key(row):
    return tuple((v is not None, v) for v in row)


def run(spark, rows, segment):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "start", "edits", "_row", "kind", "copy"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return sorted((tuple(r) for r in conversation_repair.repair_digests(df, segment).collect()), key=key)


def talk(conv, n, draw):
    roles = ["system"] * (draw.random() < 0.4) + ["user", "assistant"] * n
    roles = [draw.choice(["user", "assistant", "system", "tool"]) if draw.random() < 0.15 else r for r in roles[:n]]
    texts = ["Good day.", "Again!", "cut off", " ", "What?", "One. two"]
    return [(conv, t, r, f"{draw.choice(texts[:5])}{draw.choice(['', ' ' + str(t) + '.'])}") for t, r in enumerate(roles)]


@pytest.mark.parametrize("segment", [3, 1024])
def test_conversations(spark, segment):
    draw = random.Random(segment)
    rows = [r for conv in range(150) for r in talk(conv, draw.randrange(1, 12), draw)] + talk(1000, 150, draw)
    draw.shuffle(rows)
    assert run(spark, rows, segment) == sorted(expected(rows), key=key)


def test_odd_conversations(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Early."), (1, None, None, "Who?"), (1, 7, "", "x."),
        (2, 0, "user", None), (3, 5, "user", "x" * 300_000 + "."), (3, 6, "assistant", "Well.\n\t "), (4, 1, "assistant", "\x00."),
        (5, 2, "user", "Same."), (5, 2, "user", "Same."), (5, 2, "assistant", "Same."), (-6, -9, "ünd", "Ä."),
    ] + [(7, 1, "user", "Copy.")] * 60
    for segment in (2, 1024):
        assert run(spark, rows, segment) == sorted(expected(rows), key=key)


def test_no_conversations(spark):
    assert run(spark, [], 3) == []


def test_rows_of_a_repair(spark):
    turns = spark.createDataFrame(
        [("c", 1, "assistant", "A."), ("c", 2, "tool", "B."), ("c", 3, "assistant", "C.")], "conv string, turn long, role string, text string"
    )
    found = [tuple(r) for r in conversation_repair.repair(turns).turns.collect()]
    assert found == [("c", "user", "", "Insert"), ("c", "assistant", "A.", "Keep"), ("c", "user", "B.", "Rerole"), ("c", "assistant", "C.", "Keep")]
