"""Word-piece counts by a longest-match automaton that runs in linear time.

A word is cut greedily: the longest piece at its start, then the longest at
the rest, and so on.  The pieces are a trie; a failure link says where the
automaton stands after popping the pieces that are certain once the next
character does not fit, and each node keeps how many those are.  So one pass
over a word counts its pieces, and no piece is ever built.

Pieces at the start of a word carry a mark; the others continue it.  A word
that cannot be cut counts as one unknown piece.  Counts of short words are kept
in a bounded table of the Python worker.

Defined cases: a null or empty text has no words and no tokens; repeated rows
count each; an empty table gives none; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "Ġ"  # of pieces that start a word, in the vocabulary file
CACHED_WORDS, CACHED_BYTES = 500_000, 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """(starting, continuing) pieces of a byte-level vocabulary file, as bytes."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    starting, continuing = [], []
    for name in names:
        rest = name.removeprefix(MARK)
        if all(x in letters for x in rest) and MARK not in rest:
            (starting if rest != name else continuing).append(bytes(letters[x] for x in rest))
    return starting, continuing


class Automaton:
    """Nodes are numbers: 0 before the word, 1 between pieces; ``next``, ``fail`` and ``popped`` by node.

    ``starting`` may hold the empty piece (the mark alone).
    """

    def __init__(self, starting: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.fail: list[int | None] = [None, None]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.fail.append(None)
                        self.popped.append(0)
                    node = self.next[node][byte]
                if node != 1:
                    ends.add(node)
        if 0 in ends:
            self.fail[0], self.popped[0] = 1, 1
        waiting = deque([0, 1])
        while waiting:
            parent = waiting.popleft()
            for byte, node in self.next[parent].items():
                waiting.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at is not None and byte not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.next[at][byte], count

    def count(self, word: bytes) -> int:
        node, count = 0, 0
        for byte in word:
            while byte not in self.next[node]:
                count += self.popped[node]
                node = self.fail[node]
                if node is None:
                    return 1
            node = self.next[node][byte]
        while node != 1:
            count += self.popped[node]
            node = self.fail[node]
            if node is None:
                return 1
        return count


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


_workers: dict[str, _Counts] = {}


def _counter(pieces, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _workers:
            _workers[name] = _Counts(Automaton(*pieces.value))
        counts = _workers[name]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["_text"].to_pylist():
                words = (text or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[*names, "n_words", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words`` and ``n_tokens``.

    ``vocabulary_path`` names a file of the driver; its pieces, of a size that
    no data changes, go to the executors whole.
    """
    found = pieces_of(vocabulary_path)
    name = hashlib.md5(repr(found).encode()).hexdigest()
    pieces = docs.sparkSession.sparkContext.broadcast(found)
    carried = [c for c in docs.columns if c not in (text, "n_words", "n_tokens", "_text")]
    narrow = docs.select(*carried, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in carried)
    return narrow.mapInArrow(_counter(pieces, name), f"{schema}, n_words long, n_tokens long")
