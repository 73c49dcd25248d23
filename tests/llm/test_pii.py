"""Patterns against plain expressions, messages against enumeration, and what the field adds."""

import itertools
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from linkgraph.llm import pii, skip_chain
from linkgraph.llm.pii_patterns import KINDS, base_spans
from linkgraph.llm.skip_chain import LABELS, OTHER, infer, train, words_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((kind, *m.span()))
    return found


def test_patterns():
    draw = random.Random(3)
    pieces = ["a", "B.", "@", "x@y.z", "1", "25", "256", "0255", ".", "-", " ", "+", "(", ")", "\n", "ä", "4111111111111111", "555-77", "4111 1111", "%"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(14)))
        assert [tuple(s) for s in base_spans(text)] == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "+1" + " " * 400_000, "a@b.c" * 60_000, "1.2.3." * 60_000, "x1" * 200_000):
        words_of(text, base_spans(text))


def enumerated(model, words):
    """Exact probabilities, over all labellings."""
    n = len(words.starts)
    theta = model.local([words])
    total = np.zeros((n, len(LABELS)))
    for labels in itertools.product(range(len(LABELS)), repeat=n):
        score = sum(theta[i, y] + (skip_chain.CERTAIN if y == words.observed[i] != OTHER else 0) for i, y in enumerate(labels))
        for i, y in enumerate(labels):
            score += model.chain[labels[i - 1] if words.linked[i] else OTHER, y]
            if i + 1 == n or not words.linked[i + 1]:
                score += model.chain[y, OTHER]
            if (b := words.before[i]) >= 0 and labels[b] == y:
                score += model.skip[y]
        total[np.arange(n), labels] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def some_model(seed):
    draw = np.random.default_rng(seed)
    n = len(LABELS)
    names = {"digits 4": 3, "digits 7": 4, "numbers 1": 5}
    return skip_chain.Model(names, draw.normal(size=(6, n)), draw.normal(size=(n, n)), draw.uniform(0, 2, size=n))


@pytest.mark.parametrize("text", ["1234 56 789 x 9 12", "1234567 x 88 y 1234567 z 1234567", "5555 12 text 4444 7 text 4444", "4111 a@b 9", "7"])
def test_messages_are_exact_without_loops(text):
    words = words_of(text, base_spans(text))
    for seed in range(3):
        model = some_model(seed)
        np.testing.assert_allclose(infer(model, [words])[0], enumerated(model, words), atol=1e-3)


def test_messages_in_loops_come_close():
    text = "1234 5678 x 1234 5678 y"
    words = words_of(text, [])
    assert words.linked == [False, True, False, True] and words.before == [-1, -1, 0, 1]
    model = some_model(1)
    np.testing.assert_allclose(infer(model, [words])[0], enumerated(model, words), atol=0.05)


def test_documents_do_not_touch():
    texts = ["1234 x 1234", "", "1234 56", "9"]
    words = [words_of(t, []) for t in texts]
    model = some_model(2)
    for together, doc in zip(infer(model, words), words):
        np.testing.assert_allclose(together, infer(model, [doc])[0], atol=1e-3)


def corpus(n, seed):
    draw = random.Random(seed)

    def digits(k):
        return "".join(draw.choice("0123456789") for _ in range(k))

    def phone():
        return f"+1 ({digits(3)}) 555-{digits(4)}"

    def ip():
        return ".".join(str(draw.randrange(1, 255)) for _ in range(4))

    def mail():
        return f"{draw.choice('abcdef')}{digits(2)}@mail{digits(1)}.example.com"

    def junk():
        return draw.choice([digits(16), digits(4), f"{digits(2)}.", f"v{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f'"{digits(8)}ab"'])

    texts = []
    for _ in range(n):
        parts = [draw.choice([phone, ip, mail, junk, junk])() for _ in range(draw.randrange(1, 6))]
        texts.append(" some words ".join(p for p in parts for _ in range(draw.choice([1, 1, 2]))))
    return texts


def test_held_out_words_and_repetitions():
    model = train([words_of(t, base_spans(t)) for t in corpus(600, 1)])
    held = corpus(200, 2)
    right = whole = 0
    for text in held:
        words = words_of(text, base_spans(text))
        hidden = words._replace(observed=[OTHER] * len(words.observed))
        for chance, truth in zip(infer(model, [hidden])[0], words.observed):
            right, whole = right + (chance.argmax() == truth), whole + 1
    assert right / whole > 0.97
    text = "Call +1 (017) 555-7713 now. Many words on, it is (017) 555-7713 again; 16 of 2024, 12:30."
    base = base_spans(text)
    words = words_of(text, base)
    added = pii.added_spans(words, infer(model, [words])[0], base)
    assert [(s.kind, text[s.start : s.end]) for s in added] == [("phone", "(017) 555-7713")]
    clean = "On 12 May 2024 at 16:30 we sold 1,234 of v1.2.3 for $5.00 and 3rd place, 192.168.1.300 or 1234567890123456."
    words = words_of(clean, [])
    assert pii.added_spans(words, infer(model, [words])[0], []) == []


def test_training_repeats():
    sample = [words_of(t, base_spans(t)) for t in corpus(50, 4)]
    a, b = train(sample), train(sample)
    assert a.names == b.names and all((x == y).all() for x, y in zip(a[1:], b[1:]))


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("base", "added", "hash", "spans", "starts"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def test_query(spark):
    texts = [*corpus(300, 7), None, "", "\x00 1.2.3.4 \U0001f600 a@b.co", "word " * 50_000 + "8.8.8.8", "Number 12"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "1.2.3.4 and 1.2.3.4")]
    found = {}
    for r in pii.digests(docs_of(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows) and len(found[0]) == 2 and found[0][0] == found[0][1]
    for doc, text in rows:
        base, row = plain_spans(text or ""), found[doc][0]
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == sha256(line.encode()).hexdigest()
        assert {s for s in line.split(",") if s} <= set(row.spans.split(","))


def test_no_rows(spark):
    assert pii.digests(docs_of(spark, [])).collect() == []


def test_sample_is_bounded(spark):
    rows = [(i % 7, t) for i, t in enumerate(corpus(40, 9) * 3)]
    assert pii.fit(docs_of(spark, rows), 5).names == pii.fit(docs_of(spark, rows[::-1]), 5).names
