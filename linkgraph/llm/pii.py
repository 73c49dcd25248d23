"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

Patterns (``pii_patterns``) find base spans in whole texts.  The field (``skip_chain``) is
trained on a bounded sample, with the base spans as labels: the ``SAMPLE_DOCUMENTS`` texts of
smallest hash among those with a digit or an ``@``, and the first ``SAMPLE_WORDS`` such words of each.
Then every word of every text is labelled.  Distant words that are written alike share
evidence, so a number that was once written as a pattern wants it is found again where
it is not.  Words that get one kind with at least ``SURE`` become spans; spans that touch a base span are
left out.  Each document is worked on by itself, so nothing is shuffled but the
sample's hashes.

Defined cases: a null or empty text has no spans; repeated rows are searched each, and alike; a null
``doc_id`` is carried along; an empty table trains nothing and gives no rows; other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.pii_patterns import KINDS, Span, base_spans
from linkgraph.llm.skip_chain import LABELS, OTHER, Model, Words, infer, train, untrained, words_of

SAMPLE_DOCUMENTS, SAMPLE_WORDS = 3000, 60
SURE = 0.9
_FIELDS = "starts array<long>, ends array<long>, features array<array<string>>, possible array<array<long>>, parts array<boolean>, linked array<boolean>, before array<long>, observed array<long>"
Rows = Iterator[pa.RecordBatch]


def _sampled_words(batches: Rows) -> Rows:
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(pa.int64())), *[pa.list_(pa.bool_())] * 2, *[pa.list_(pa.int64())] * 2]
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            words = words_of(text, base_spans(text))
            found.append(Words(*(part[:SAMPLE_WORDS] for part in words)))
        columns = [batch.column("hash"), *(pa.array([d[k] for d in found], kinds[k + 1]) for k in range(len(Words._fields)))]
        yield pa.RecordBatch.from_arrays(columns, ["hash", *Words._fields])


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Model:
    """The field trained on at most ``documents`` texts of ``docs`` (doc_id, text)."""
    hashed = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("hash"), "text")
    chosen = hashed.select("hash").distinct().orderBy("hash").limit(documents).agg(F.max("hash")).first()[0]
    if chosen is None:
        return untrained()
    sample = hashed.where(F.col("hash") <= chosen).mapInArrow(_sampled_words, f"hash long, {_FIELDS}")
    rows = sample.dropDuplicates(["hash"]).orderBy("hash").collect()
    return train([Words(*row[1:]) for row in rows])


def added_spans(words: Words, chances: np.ndarray, base: list[Span], sure: float = SURE) -> list[Span]:
    """Words of one kind that touch no base span; neighbouring parts of numbers make one span."""
    taken = sorted((s.start, s.end) for s in base)
    found: list[Span] = []
    open_kind, k = OTHER, 0
    for i, (start, end) in enumerate(zip(words.starts, words.ends)):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        label = int(chances[i].argmax())
        free = label != OTHER and chances[i, label] >= sure and not any(a < end and b > start for a, b in taken[k : k + 8])
        if not free:
            open_kind = OTHER
        elif label == open_kind and words.linked[i] and words.parts[i]:
            found[-1] = found[-1]._replace(end=end)
        else:
            open_kind = label
            found.append(Span(LABELS[label], start, end))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end)))


def find(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """(doc_id, base, added) for each row of ``docs`` (doc_id, text): spans as structs (kind, start, end)."""
    doc = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches: Rows) -> Rows:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            words = [words_of(t, b) for t, b in zip(texts, base)]
            added = [added_spans(w, c, b, sure) for w, c, b in zip(words, infer(model, words), base)]
            columns = [pa.array([[s._asdict() for s in x] for x in part], span) for part in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {doc}, base {kind}, added {kind}")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``docs``, by a field trained on them."""
    docs = docs.select("doc_id", "text")
    found = find(docs, fit(docs))
    order = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair))

    def text(spans):
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans")
    )
