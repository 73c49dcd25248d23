"""A skip-chain conditional random field over the words of documents.

Words with a digit or an ``@`` are variables (any other word cannot be personal data
of a known kind: its label is ``other``).  Factors: a word's features; the labels of
two neighbouring words; and skip edges, which let a word share its
label with an earlier word of the same document that is written alike (same digits, or
same letters), however far away: the last one whose label a pattern shows, or else the last one.
So there is at most one skip edge a word, not one a pair.

``infer`` passes messages along both kinds of edges, all at once in every round,
until they rest; words inside a pattern's span are observed and keep their kind.
``train`` maximises the pseudo-likelihood on labelled words; part of them hide their own
features, and half of these their neighbours too, so that neighbours and repetitions get
weights of their own.  A word's form rules some kinds out, and one of a form
that the sample did not have is held to be ``other`` unless its repetitions say more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple
from zlib import crc32

import numpy as np

from linkgraph.llm.pii_patterns import KINDS, Span, is_ip, luhn

LABELS = ("other", *KINDS)
OTHER = 0
WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_OUTER = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$")
_DIGITS, _LETTERS, _NUMBER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
_ADDRESS = re.compile(r"[^@]+@[^@]+\.[^@.]+")
KEY_DIGITS, PART_DIGITS, LONG_WORD = 4, 9, 64
MIN_SEEN = 3
HIDDEN, ALONE = 40, 20  # hundredths of the training words: features hidden, neighbours hidden as well
BIAS, WITHOUT_FEATURES, WITHOUT_NEIGHBOURS = range(3)  # rows of the weights; the last two are for training alone
UNSEEN = 4.0  # log odds of ``other`` for a form that the sample did not have
STEPS, RATE, DECAY = 400, 0.2, 0.02
ROUNDS, AT_REST = 500, 1e-4
CERTAIN = 30.0  # log odds of an observed label


class Words(NamedTuple):
    """The variables of one document, in order.  ``linked[i]``: word ``i`` directly follows ``i - 1``; ``before[i]``: the earlier word
    that ``i`` is tied to, or -1; ``possible``: labels its form allows; ``parts[i]``: whether it may be
    part of a longer number; ``observed``: the label of the pattern's span it lies in, or ``OTHER``."""

    starts: list[int]
    ends: list[int]
    features: list[list[str]]
    possible: list[list[int]]
    parts: list[bool]
    linked: list[bool]
    before: list[int]
    observed: list[int]


def shape(word: str) -> str:
    """The word with 9 for digits and x for runs of letters."""
    return _DIGITS.sub("9", _LETTERS.sub("x", word)) if len(word) <= LONG_WORD else "long"


def key_of(word: str) -> str | None:
    """What alike words share: the digits of a number, or an address in lower case."""
    if "@" in word:
        return word.lower()
    digits = "".join(_NUMBER.findall(word))
    return digits if len(digits) >= KEY_DIGITS else None


def _own_features(word: str) -> list[str]:
    numbers = _NUMBER.findall(word)
    count = sum(map(len, numbers))
    found = [f"shape {shape(word)}", f"digits {min(count, 20)}", f"numbers {min(len(numbers), 6)}"]
    if "@" in word:
        found.append("address" if _ADDRESS.fullmatch(word) else "at")
    if len(numbers) == 4 and "." in word and is_ip(tuple(numbers)):
        found.append("four parts")
    if 13 <= count <= 19 and len(numbers) == 1:
        found.append("checked" if luhn(numbers[0]) else "unchecked")
    return found


def _possible(word: str) -> list[int]:
    """Labels by form: an address has an ``@``, four parts up to 255 are an IP, a card's check digit is right, a phone has no letters."""
    numbers = _NUMBER.findall(word)
    digits = "".join(numbers)
    allowed = {
        "email": "@" in word,
        "ip": len(numbers) == 4 and "." in word and is_ip(tuple(numbers)),
        "card": len(digits) < 13 or len(digits) <= 19 and luhn(digits),
        "phone": 0 < len(digits) <= 15 and "@" not in word and not _LETTERS.search(word),
    }
    return [OTHER, *(LABELS.index(k) for k in KINDS if allowed[k])]


def words_of(text: str, spans: Iterable[Span]) -> Words:
    found = Words([], [], [], [], [], [], [], [])
    owner = sorted((s.start, s.end, LABELS.index(s.kind)) for s in spans)
    last: dict[str, int] = {}
    at, i, end = 0, 0, -1
    for m in WORD.finditer(text):
        word = _OUTER.sub("", m.group()) or m.group()
        linked = bool(found.ends) and not text[end : m.start()].strip(" \t\n\x0b\x0c\r")
        end = m.end()
        while at < len(owner) and owner[at][1] <= m.start():
            at += 1
        inside = [kind for start, stop, kind in owner[at : at + 8] if start < m.end() and stop > m.start()]
        offset = m.start() + m.group().find(word)
        key = key_of(word)
        found.starts.append(offset)
        found.ends.append(offset + len(word))
        found.parts.append(0 < len("".join(_NUMBER.findall(word))) < PART_DIGITS and "@" not in word)
        found.linked.append(linked)
        found.before.append(last.get(key, -1) if key else -1)
        found.observed.append(min(inside, default=OTHER))
        found.features.append(_own_features(word))
        found.possible.append(sorted({*_possible(word), min(inside, default=OTHER)}))
        if key and (found.observed[i] != OTHER or key not in last or found.observed[last[key]] == OTHER):
            last[key] = i
        i += 1
    return found


class Model(NamedTuple):
    """``names``: rows of ``weights`` by feature; ``chain[a, b]``: label a before b; ``skip``: for sharing a label."""

    names: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def local(self, documents: list[Words]) -> np.ndarray:
        """Log potentials of each word by its own features and form."""
        features = [own for d in documents for own in d.features]
        if not features:
            return np.zeros((0, len(LABELS)))
        rows = [[BIAS, *(self.names[f] for f in own if f in self.names)] for own in features]
        flat = np.fromiter((r for row in rows for r in row), dtype=np.int64)
        scores = np.add.reduceat(self.weights[flat], np.cumsum([0, *map(len, rows[:-1])]), axis=0)
        scores[[own[0] not in self.names for own in features], OTHER] += UNSEEN
        allowed = np.zeros(scores.shape, dtype=bool)
        for row, labels in zip(allowed, (p for d in documents for p in d.possible)):
            row[labels] = True
        return np.where(allowed, scores, scores - CERTAIN)


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def untrained() -> Model:
    n = len(LABELS)
    return Model({}, np.zeros((3, n)), np.zeros((n, n)), np.zeros(n))


def train(documents: list[Words]) -> Model:
    """A model of ``documents``, whose observed labels are the truth.  The same documents give the same model."""
    n = len(LABELS)
    features = [own for d in documents for own in d.features]
    if not features:
        return untrained()
    labels = np.array([y for d in documents for y in d.observed])
    previous, following, left, right = (np.full(len(labels), n) for _ in range(4))  # n: none there
    start = 0
    for d in documents:
        for i, (linked, before) in enumerate(zip(d.linked, d.before)):
            here = start + i
            previous[here] = labels[here - 1] if linked else OTHER
            following[here] = labels[here + 1] if i + 1 < len(d.linked) and d.linked[i + 1] else OTHER
            if before >= 0:
                left[here], right[start + before] = labels[start + before], labels[here]
        start += len(d.linked)
    seen = Counter(f for own in features for f in own)
    names = {f: k + 3 for k, f in enumerate(sorted(f for f, c in seen.items() if c >= MIN_SEEN))}
    rows, cols, alone = [], [], np.zeros(len(labels), dtype=bool)
    for i, own in enumerate(features):
        drawn = crc32(f"{i} {own[0]}".encode()) % 100
        alone[i] = drawn < ALONE
        hidden = WITHOUT_NEIGHBOURS if alone[i] else WITHOUT_FEATURES
        active = [hidden] if drawn < HIDDEN else [BIAS, *(names[f] for f in own if f in names)]
        rows += [i] * len(active)
        cols += active
    rows, cols = np.array(rows), np.array(cols)
    truth = np.eye(n)[labels]
    one = np.vstack([np.eye(n), np.zeros(n)])
    before, after, near = one[np.where(alone, n, previous)], one[np.where(alone, n, following)], one[left] + one[right]
    values = [np.zeros((len(names) + 3, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, STEPS + 1):
        weights, chain, skip = values
        scores = np.zeros((len(labels), n))
        np.add.at(scores, rows, weights[cols])
        scores += before @ chain + after @ chain.T + near * skip
        error = truth - _softmax(scores)
        by_feature = np.zeros_like(weights)
        np.add.at(by_feature, cols, error[rows])
        slopes = [by_feature, before.T @ error + (after.T @ error).T, (near * error).sum(axis=0)]
        for k, slope in enumerate(slopes):
            slope = slope - DECAY * values[k]
            first, second = moments[k]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            values[k] = values[k] + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(names, *values)


def infer(model: Model, documents: list[Words]) -> list[np.ndarray]:
    """Probabilities of the labels of each word, by loopy message passing over all ``documents`` at once."""
    n = len(LABELS)
    sizes = [len(d.starts) for d in documents]
    total = sum(sizes)
    if not total:
        return [np.zeros((0, n)) for _ in documents]
    theta = model.local(documents)
    observed = np.array([y for d in documents for y in d.observed])
    sources, targets, skips = [], [], []
    start = 0
    for d in documents:
        for i, (linked, before) in enumerate(zip(d.linked, d.before)):
            here = start + i
            if linked:
                sources.append(here - 1)
                targets.append(here)
                skips.append(False)
            else:  # the words around are not variables: their label is known
                theta[here] += model.chain[OTHER]
                if i:
                    theta[here - 1] += model.chain[:, OTHER]
            if before >= 0:
                sources.append(start + before)
                targets.append(here)
                skips.append(True)
        start += len(d.linked)
        if d.linked:
            theta[start - 1] += model.chain[:, OTHER]
    known = observed != OTHER
    theta[known] += CERTAIN * np.eye(n)[observed[known]]
    m = len(sources)
    if not m:
        return np.split(_softmax(theta), np.cumsum(sizes)[:-1])
    forward = np.where(np.array(skips)[:, None, None], np.diag(model.skip), model.chain)
    psi = np.concatenate([forward, forward.transpose(0, 2, 1)])
    origin, goal = np.array(sources + targets), np.array(targets + sources)
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    messages = np.zeros((2 * m, n))
    for _ in range(ROUNDS):
        belief = theta.copy()
        np.add.at(belief, goal, messages)
        out = (belief[origin] - messages[back])[:, :, None] + psi
        top = out.max(axis=1)
        sent = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        sent -= sent.max(axis=1, keepdims=True)
        change = np.abs(sent - messages).max()
        messages = sent
        if change < AT_REST:
            break
    belief = theta.copy()
    np.add.at(belief, goal, messages)
    return np.split(_softmax(belief), np.cumsum(sizes)[:-1])
