"""Conversations brought back to ``(s?(ua)+)?`` by the cheapest edits, by target alignment.

Turns are ordered within their conversation, their faults found (no text, the same
role and text as an earlier turn, a text that is cut off), and each becomes one
letter.  Runs of ``SEGMENT`` letters are segments; ``alignment`` aligns a segment
with every feasible length of the grammar's strings.  Conversations of one segment are
done with that.  For longer ones the costs of segments, sixteen numbers each, are
carried from the end to the start and the chosen phases from the start to the end,
so that no task needs to hold a conversation.  Texts move once, to be
put in order and edited as they stream by; sha256 of a whole conversation
is sequential, so that one step reads a conversation in one task, in constant memory.

Defined cases: a null role or text is one space (so the turn is blank, or of another role); a null
turn comes first; a null ``conv_id`` is a conversation; turns of one number are ordered by
role and md5 of the text; repeated rows are duplicates; a conversation without
turns needs no edits; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm import alignment
from linkgraph.llm.alignment import ACCEPTED, FAR, audit_of
from linkgraph.llm.common import Scratch
from linkgraph.llm.positions import RUN_BITS, in_order

SEGMENT = 1024
INK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
EMPTY_SHA256 = sha256(b"").hexdigest()


class Repair(NamedTuple):
    """``audits``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); ``turns``: (conv, role, text, edit),
    a conversation's rows one after the other in one partition."""

    audits: DataFrame
    turns: DataFrame


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the rows with faults of five kinds, by crc32 of conversation and turn."""
    conv, turn = conversation_key(F.col("conv_id")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _letter(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _faulty(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Narrow rows in order, with their faults; and the runs they lie in."""
    narrow = turns.select(
        "conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), _letter(F.col("role")).alias("letter"),
        (~F.col("text").rlike(INK)).alias("blank"), F.col("text").rlike(ENDED).alias("ended"),
    )
    ordered = in_order(narrow, "conv", ["turn", "role", "digest"], scratch, "turns")
    first = ordered.rows.groupBy("conv", "role", "digest").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("first"))
    duplicate = ~F.col("blank") & F.col("first").isNull()
    rows = ordered.rows.join(scratch.write(first, "first"), "_row", "left").withColumn("duplicate", duplicate)
    cut_off = ~F.col("blank") & ~F.col("duplicate") & ~F.col("ended")
    return rows.withColumn("truncated", cut_off), ordered.runs


def _segments(rows: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """(conv, start, codes, counts of faults, key of the first turn, whether it is the first or the last)."""
    code = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper("letter")).otherwise(F.col("letter"))
    start = F.col("_first") + F.floor((F.col("_row") - F.col("_first")) / size) * size
    told = F.array_sort(F.collect_list(F.struct("_row", code.alias("code"), "letter")))
    within = rows.withColumn("_run", F.shiftright("_row", RUN_BITS)).join(runs.select("conv", "_run", "_first"), ["conv", "_run"])
    cut = within.groupBy("conv", start.alias("start")).agg(
        told.alias("told"),
        *(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.min_by(F.struct("turn", "role", "digest"), "_row").alias("key"),
    )
    letters = F.array_join(F.transform("told", lambda x: x["letter"]), "")
    ahead = Window.partitionBy("conv").orderBy("start")
    joined = cut.select(
        "conv", "start", "blank", "duplicate", "truncated", "key", letters.alias("letters"),
        F.array_join(F.transform("told", lambda x: x["code"]), "").alias("codes"),
        F.lag(F.right(letters, F.lit(1)), 1, "").over(ahead).alias("left"),
        F.lag("start").over(ahead).isNull().alias("opens"), F.lead("start").over(ahead).isNull().alias("last"),
    )
    pairs = F.concat("left", "letters")
    at = F.sequence(F.lit(1), F.length(pairs) - 1)
    wrong = F.filter(at, lambda i: ~F.substr(pairs, i, F.lit(2)).isin("su", "ua", "au"))
    return joined.withColumn("illegal", F.when(F.length(pairs) < 2, 0).otherwise(F.size(wrong)).cast("long")).drop("left", "letters")


Rows = Iterator[pa.RecordBatch]


def _mapped(df: DataFrame, column: str, kind: str, value: Callable[[dict], object]) -> DataFrame:
    """``df`` with a column that ``value`` makes of each row, in the rows' order."""
    schema = df.withColumn(column, F.lit(None).cast(kind)).schema
    arrow = {"array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}[kind]

    def run(batches: Rows) -> Rows:
        for batch in batches:
            made = pa.array([value(row) for row in batch.to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, column])

    return df.mapInArrow(run, schema)


def _costs_beyond() -> Callable[[dict], list[int]]:
    """For segments from the last to the first: what each phase at their end costs up to the end of the conversation."""
    beyond: list[int] = list(ACCEPTED)

    def value(row: dict) -> list[int]:
        nonlocal beyond
        if row["last"]:
            beyond = list(ACCEPTED)
        here = beyond
        if not row["opens"]:
            costs = row["costs"]
            beyond = [min(min(costs[4 * p + q] + here[q], FAR) for q in range(4)) for p in range(4)]
        return here

    return value


def _entries() -> Callable[[dict], int]:
    """For segments from the first to the last: the phase in which each starts."""
    phase = 0

    def value(row: dict) -> int:
        nonlocal phase
        here = 0 if row["opens"] else phase
        if not row["last"]:
            phase = row["exits"][here]
        return here

    return value


def _exits(row: dict) -> list[int] | None:
    if row["last"]:
        return None
    beyond = tuple(row["beyond"])
    reachable = [min(row["costs"][4 * p + q] + beyond[q] for q in range(4)) < FAR for p in range(4)]
    return [alignment.walk(row["codes"], False, p, beyond).exit if reachable[p] else -1 for p in range(4)]


def _chained(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """``segments`` with ``beyond`` and ``entry``: what lies after each, and how it is entered."""
    alone = F.col("opens") & F.col("last")
    one = segments.where(alone).withColumn("beyond", F.lit(list(ACCEPTED)).cast("array<bigint>")).withColumn("entry", F.lit(0))
    several = segments.where(~alone)
    costed = _mapped(several, "costs", "array<bigint>", lambda r: alignment.costs(r["codes"], r["last"]))
    back = costed.repartition("conv").sortWithinPartitions("conv", F.desc("start"))
    known = scratch.write(_mapped(back, "beyond", "array<bigint>", _costs_beyond()), "beyond")
    left = _mapped(known, "exits", "array<int>", _exits)
    forth = left.repartition("conv").sortWithinPartitions("conv", "start")
    entered = _mapped(forth, "entry", "int", _entries()).drop("costs", "exits")
    return one.unionByName(entered)


def _edited(segments: DataFrame) -> DataFrame:
    """``segments`` with ``cost``, ``edits`` and ``audit``."""
    schema = segments.selectExpr("*", "0L AS cost", "array('') AS edits", "'' AS audit").schema

    def run(batches: Rows) -> Rows:
        for batch in batches:
            rows = batch.to_pylist()
            walks = [alignment.walk(r["codes"], r["last"], r["entry"], tuple(r["beyond"])) for r in rows]
            made = [
                pa.array([w.cost for w in walks], pa.int64()),
                pa.array([w.edits for w in walks], pa.list_(pa.string())),
                pa.array([audit_of(w.edits) for w in walks], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cost", "edits", "audit"])

    return segments.mapInArrow(run, schema)


ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def _apply(batches: Rows) -> Rows:
    """Edits and turns stream by in order; each turn takes the next edit of its conversation."""
    waiting: deque[str] = deque()
    for batch in batches:
        out: list[tuple[str, str, str, str]] = []
        for conv, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "edits"))):
            if edits is not None:  # a segment's edits come before its turns; what follows the last turn waits for the end
                waiting.extend(edits)
                continue
            *added, own = waiting.popleft()
            out += [(conv, ROLES[x], "", "Insert") for x in added]
            if own == "K":
                out.append((conv, role, text, "Keep"))
            elif own != "D":
                out.append((conv, ROLES[own], text, "Rerole"))
            while waiting and waiting[0].islower():
                out += [(conv, ROLES[x], "", "Insert") for x in waiting.popleft()]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["conv", "role", "text", "edit"])


def _hashed(batches: Rows) -> Rows:
    """(conv, repaired_sha256) of conversations whose rows come one after the other."""
    name, state = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.string()) for x in ([name], [state.hexdigest()])], ["conv", "repaired_sha256"]
        )

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if conv != name:
                if state:
                    yield row()
                name, state = conv, sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state:
        yield row()


def repair(turns: DataFrame, segment: int = SEGMENT) -> Repair:
    """The cheapest repair of every conversation in ``turns`` (conv, turn, role, text), none of them null but ``turn``."""
    scratch = Scratch(turns.sparkSession, "conversations")
    turns = turns.select("conv", "turn", "role", "text")
    faulty, runs = _faulty(turns, scratch)
    rows = scratch.write(faulty, "faulty")
    segments = scratch.write(_segments(rows, runs, segment), "segments")
    edited = scratch.write(_edited(_chained(segments, scratch)), "edited")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "audit")))
    told = edited.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"),
    )
    order = ["conv", "turn", "role", "digest"]
    texts = turns.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("start", F.lit(None).cast("long"))
    edits = edited.select("conv", "key.*", "start", F.lit(None).cast("string").alias("text"), "edits")
    stream = texts.withColumn("edits", F.lit(None).cast("array<string>")).unionByName(edits)
    # edits of a turn before it, those of equal turns in their order
    lined_up = stream.repartition("conv").sortWithinPartitions(*order, F.col("start").asc_nulls_last())
    repaired = lined_up.select("conv", "role", "text", "edits").mapInArrow(_apply, "conv string, role string, text string, edit string")
    return Repair(gaps.join(told, "conv"), repaired)


def repair_digests(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What repairing the damaged ``conversations`` (conv_id, turn, role, text) took, and a digest of the result."""
    found = repair(damaged(conversations), segment)
    hashes = found.turns.mapInArrow(_hashed, "conv string, repaired_sha256 string")
    whole = conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("conv")).distinct()
    joined = whole.join(found.audits, "conv", "left").join(hashes, "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
