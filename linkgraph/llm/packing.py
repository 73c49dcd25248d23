"""Pack documents into token sequences that keep the mixture of their sources.

Sources are queues, in an order given by hashes.  Deficit round-robin serves
them: in every round (one window of ``WINDOW`` tokens) a source's credit grows by its quantum,
the window times its target proportion, and it sends segments while its credit
covers them; what is left of the credit is carried on.  A segment that ends at
token c of its queue is therefore sent in round ``ceil(c / quantum)``, whatever
the other queues do: the carried deficit is a formula, and rounds need no loop
and no order of partitions.  Tokens before a segment of its queue, and before
its place in the whole order, are prefix sums in two steps (inside a range, and
over the ranges' totals), so no queue is ever in one task.

The order is cut every ``WINDOW`` tokens.  The last window is cut into powers
of two, so nothing is padded.  Texts are tokenized once; their ids are kept in a
table, two bytes each where the vocabulary allows it, and meet their pieces there.

Defined cases: a null text is empty and has the end token alone; a null source
is a queue; rows alike in id, source and text are packed each; an empty table
gives none; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch, text_key
from linkgraph.llm.token_counts import byte_letters

WINDOW = 4096
GRAIN = 512  # tokens of a segment
END = 2
SEED = 2
COPIES_AT_ONCE = 64
CACHED_CHUNKS, CACHED_PARTS, CACHED_LENGTH = 100_000, 400_000, 48


def _class(*kinds: str) -> str:
    """The characters below U+0250 of the general categories ``kinds``, as the inside of a bracket."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in kinds)


#: The tokenizer's own split, for lower-cased text of PLAIN characters: Latin letters without combining marks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile(SPLIT.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))
PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f]*")


class _Bounded(dict):
    """A table that forgets what was not asked for lately: it holds at most two generations of ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _PartIds(_Bounded):
    """Ids of one part of plain text, straight from the model: there is nothing to normalise or split."""

    def __init__(self, tokenizer, code: str):
        super().__init__(CACHED_PARTS)
        self.model, self.code = tokenizer.model, code
        self.letters = {byte: letter for letter, byte in byte_letters().items()}

    def made(self, key: str) -> bytes:
        spelled = key if key.isascii() else "".join(map(self.letters.__getitem__, key.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()


class _ChunkIds(_Bounded):
    """Ids of a chunk between ASCII white space.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its chunks.
    """

    def __init__(self, tokenizer, code: str):
        super().__init__(CACHED_CHUNKS)
        self.tokenizer, self.code = tokenizer, code

    def made(self, key: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(key.decode(), add_special_tokens=False).ids).tobytes()


class _Encoder:
    """Ids of texts as bytes of ``width`` each, from tables of what was met before.

    Plain texts without special tokens are lower-cased and split here, for their
    parts repeat more than their chunks do; others go to the tokenizer by chunks.
    """

    def __init__(self, described: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(described)
        self.width = 2 if tokenizer.get_vocab_size() <= 2**16 else 4
        code = {2: "H", 4: "I"}[self.width]
        self.chunks, self.parts = _ChunkIds(tokenizer, code), _PartIds(tokenizer, code)
        self.plain = splits_plainly(described)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.plain and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


def splits_plainly(described: str) -> bool:
    """Whether the tokenizer normalises and splits as ``PARTS`` does; if not, it gets every chunk."""
    rules = json.loads(described)
    steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex") if splits else None
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and pattern == SPLIT
        and [x.get("type") for x in splits[1:]] == ["ByteLevel"]
        and not splits[1].get("add_prefix_space")
    )


_workers: dict[str, _Encoder] = {}


def _encoder(described: str) -> _Encoder:
    name = hashlib.md5(described.encode()).hexdigest()
    if name not in _workers:
        _workers[name] = _Encoder(described)
    return _workers[name]


def _tokenized(described, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(described.value)
        last = end.to_bytes(encode.width, "little")
        for batch in batches:
            ids = [encode(t) + last for t in batch["text"].to_pylist()]
            n = pa.array([len(x) // encode.width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], batch["_key"], n, pa.array(ids, pa.binary())],
                names=["doc_id", "source", "_key", "n", "ids"],
            )

    return run


class _Windows:
    """Where a place in the whole order lies: (sequence, its first place, its end)."""

    def __init__(self, total: int, window: int):
        self.window, self.full = window, total // window
        starts, at, rest = [], self.full * window, total % window
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                starts.append(at)
                at += 1 << bit
        self.starts, self.end = starts, at

    def at(self, place: int) -> tuple[int, int, int]:
        if place < self.full * self.window:
            k = place // self.window
            return k, k * self.window, (k + 1) * self.window
        i = bisect_right(self.starts, place) - 1
        return self.full + i, self.starts[i], self.starts[i + 1] if i + 1 < len(self.starts) else self.end


def _pieces(sent: list[dict], windows: _Windows) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of one document's segments, joined where they touch and cut at windows."""
    runs: list[list[int]] = []
    for copy, start, length, place in sorted((x["copy"], x["start"], x["length"], x["place"]) for x in sent):
        last = runs[-1] if runs else None
        if last and last[0] == copy and last[1] + last[2] == start and last[3] + last[2] == place:
            last[2] += length
        else:
            runs.append([copy, start, length, place])
    for _, start, length, place in runs:
        while length:
            sequence, first, end = windows.at(place)
            n = min(length, end - place)
            yield start, n, sequence, place - first
            start, length, place = start + n, length - n, place + n


PIECE = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _cutter(total: int, window: int, with_ids: bool):
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(total, window)
        for batch in batches:
            rows: list[tuple] = []
            for doc, source, n, packed, sent in zip(*(batch[c].to_pylist() for c in ("doc_id", "source", "n", "ids", "sent"))):
                ids = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
                for start, length, sequence, offset in _pieces(sent, windows):
                    cut = ids[start : start + length]
                    row = (doc, source, start, length, zlib.crc32(cut.tobytes()), n, sequence, offset)
                    rows.append((*row, cut.astype("i4")) if with_ids else row)
                if len(rows) >= 20_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _placed(segments: DataFrame, group: list[str], ranges: str, order: list[str], length: str, out: str) -> DataFrame:
    """``segments`` with ``out``: the sum of ``length`` up to and with each row, in order of (``ranges``, ``order``).

    A window ranks the rows of a range; another, over one row for each range,
    gives what lies before the range.
    """
    inside = Window.partitionBy(*group, ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy(*group, ranges).agg(F.sum(length).alias("_n"))
    starts = totals.select(
        *(F.col(g).alias(f"_s_{g}") for g in group), F.col(ranges).alias("_s_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col(ranges) == F.col("_s_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    ranked = segments.withColumn("_inside", F.sum(length).over(inside))
    return ranked.join(starts, same).withColumn(out, F.col("_before") + F.col("_inside")).drop(*starts.columns, "_inside")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    weights: dict[str | None, float] | None = None,
    window: int = WINDOW,
    grain: int = GRAIN,
    end: int = END,
    seed: int = SEED,
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of ``docs`` (doc_id, source, text): ``PIECE``, and their ``ids`` if asked for.

    ``weights``: the target proportions by source; by default each source's
    share of the tokens, so that all queues end together.  Sources without a weight get 1.
    A queue that has ended leaves its share to the others.  ``tokenizer_path`` names a file of the driver; it goes to the
    executors whole, a few MB whatever the data.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    with open(tokenizer_path, encoding="utf-8") as file:
        described = spark.sparkContext.broadcast(file.read())
    keyed = docs.select("doc_id", "source", text_key(F.col("text")).alias("_key"), "text")
    encoded = scratch.write(
        keyed.mapInArrow(_tokenized(described, end), "doc_id long, source string, _key long, n long, ids binary"),
        "encoded",
        compression="zstd",
    )
    alike = encoded.groupBy("doc_id", "source", "_key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    alike = scratch.write(alike, "alike")
    whole = alike.agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies")).first()
    total = int(whole["tokens"] or 0)

    # Queues: ranges of a hash, then the hash.
    ranges = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.xxhash64(F.lit(seed), "doc_id", "_key", "copy")
    segments = (
        alike.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("_h", order)
        .withColumn("_range", F.pmod("_h", F.lit(ranges)).cast("int"))
        .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(grain).cast("long"))))
        .select(
            "doc_id", "source", "_key", "copy", "start", "_h", "_range",
            F.least(F.lit(grain).cast("long"), F.col("n") - F.col("start")).alias("length"),
        )
    )
    queued = _placed(segments, ["source"], "_range", ["_h", "doc_id", "_key", "copy", "start"], "length", "_upto")
    # A source's quantum, in tokens a round.
    if weights is None:
        share = F.col("_tokens") / float(max(1, total))
    else:
        known = F.create_map(*(F.lit(x) for k, w in weights.items() if k is not None for x in (k, float(w))))
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 1.0)))).otherwise(
            F.coalesce(known[F.col("source")], F.lit(1.0)) if len(weights) > (None in weights) else F.lit(1.0)
        )
        share = weight / F.sum(weight).over(Window.partitionBy())
    sources = alike.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("_tokens"))
    quanta = sources.select(F.col("source").alias("_q_source"), (share * window).alias("_quantum"))
    served = scratch.write(
        queued.join(quanta, F.col("source").eqNullSafe(F.col("_q_source")))
        .withColumn("round", F.ceil(F.col("_upto") / F.col("_quantum")).cast("long"))
        .drop("_q_source", "_quantum", "_h", "_range"),
        "served",
    )
    rounds = int(served.agg(F.max("round")).first()[0] or 1)
    # The whole order: rounds, in each the sources, in each the queue.
    # A few source-sized steps more than there are rounds keep the ranges even.
    ranged = served.withColumn("_range", F.floor((F.col("round") - 1) * float(ranges) / rounds).cast("int"))
    order_in = ["round", "source", "_upto", "doc_id", "_key", "copy"]
    ordered = _placed(ranged, [], "_range", order_in, "length", "_end")
    sent = ordered.groupBy("doc_id", "source", "_key", F.floor(F.col("copy") / COPIES_AT_ONCE).alias("_some")).agg(
        F.collect_list(
            F.struct("copy", "start", "length", (F.col("_end") - F.col("length")).alias("place"))
        ).alias("sent")
    )
    sent = sent.select(*(F.col(c).alias(f"_p{c}") for c in ("doc_id", "source", "_key")), "sent")
    once = encoded if (whole["copies"] or 1) == 1 else encoded.dropDuplicates(["doc_id", "source", "_key"])
    joined = once.join(
        sent,
        F.col("doc_id").eqNullSafe(F.col("_pdoc_id"))
        & F.col("source").eqNullSafe(F.col("_psource"))
        & (F.col("_key") == F.col("_p_key")),
    ).select("doc_id", "source", "n", "ids", "sent")
    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(
        _cutter(total, window, with_ids), schema + (", ids array<int>" if with_ids else "")
    )
