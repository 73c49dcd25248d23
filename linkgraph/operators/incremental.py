"""Idempotent inserts, keyed updates, caches and rates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column
from linkgraph.functions.text import fold_name
from linkgraph.operators.projection import canonical_pair
from linkgraph.session import materialize

# Cache lifetime and request window.
CACHE_DAYS = 7
RATE_SECONDS = 30
RATE_LIMIT = 20


def upsert_first(stored: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: ColumnLike) -> DataFrame:
    """Stored rows plus the batch rows with new keys; the first writer wins."""
    keys = list(keys)
    rest = [c for c in stored.columns if c not in keys]
    first = batch.groupBy(*keys).agg(
        F.min(F.struct(as_column(arrival).alias("arrival"), *[F.col(c) for c in rest])).alias("row")
    )
    fresh = first.join(stored, keys, "left_anti").select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])
    return stored.unionByName(fresh.select(*stored.columns))


def upsert_aliases(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add trimmed, non-blank aliases once per entity, with their folded form.

    ``(entity_id, alias, alias_norm)`` and ``(entity_id, alias)``.
    """
    cleaned = (
        batch.select("entity_id", F.trim("alias").alias("alias"))
        .filter("alias <> ''")
        .distinct()
        .join(stored, ["entity_id", "alias"], "left_anti")
    )
    return stored.unionByName(cleaned.withColumn("alias_norm", fold_name("alias")))


def upsert_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add edge titles that are new; the edge itself exists once it has one.

    ``stored(src, dst, title)``; ``batch(a, b, title)`` in any direction.
    """
    incoming = batch.select(*canonical_pair("a", "b"), "title").distinct()
    fresh = incoming.join(stored, ["src", "dst", "title"], "left_anti")
    return stored.unionByName(fresh)


def apply_updates(stored: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` where an update exists; unknown keys are ignored."""
    renamed = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("updated"))
    joined = stored.join(renamed, key, "left")
    return joined.select(
        *[
            (F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
            for c in stored.columns
        ]
    )


def fresh_entries(entries: DataFrame, key: str, stamp: str, as_of: ColumnLike, days: int = CACHE_DAYS) -> DataFrame:
    """The latest entry per key, unless it has outlived the cache."""
    columns = [c for c in entries.columns if c not in (key, stamp)]
    latest = entries.groupBy(key).agg(F.max(F.struct(stamp, *columns)).alias("entry"))
    kept = latest.select(key, "entry.*")
    return kept.filter(F.col(stamp) + F.expr(f"INTERVAL {days} DAYS") >= as_column(as_of))


def numbered_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Assign consecutive rows in order of the unique ``key`` to batches.

    Rows are range partitioned and numbered within their partition; only the
    partition sizes, a few rows, are summed up in one place.
    """
    numbered = materialize(
        rows.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .withColumn("row_id", F.monotonically_increasing_id()),
        "numbered",
    ).select(
        "*",
        F.shiftright("row_id", 33).alias("part"),
        F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"),
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    return (
        numbered.join(offsets, "part")
        .withColumn("batch", F.floor((F.col("offset") + F.col("within")) / size))
        .drop("part", "row_id", "within", "offset")
    )


def trailing_rate(
    events: DataFrame, key: str, stamp: str, seconds: int = RATE_SECONDS, limit: int = RATE_LIMIT
) -> DataFrame:
    """Events of the same key in the trailing window, and whether that is more
    than ``limit``.

    Time is cut into slots as long as the window.  An event counts in its own
    slot and, as history, in the next one, so a trailing window always lies
    within one (key, slot) and a key with most of the rows spreads over as
    many tasks as it has slots.
    """
    length = seconds * 1_000_000
    timed = events.withColumn("_at", F.unix_micros(F.col(stamp).cast("timestamp")))
    slot = F.floor(F.col("_at") / length)
    copies = timed.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_slot") == slot)
    window = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(-length, 0)
    counted = copies.withColumn("recent", F.count(F.lit(1)).over(window))
    return (
        counted.filter("_own")
        .withColumn("exceeds", F.col("recent") > limit)
        .drop("_at", "_slot", "_own")
    )
