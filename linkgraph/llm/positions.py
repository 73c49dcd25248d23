"""Places of rows within their group, without a group ever lying in one task.

Rows are range partitioned and sorted by group and order, and written with an
increasing row number.  A run is what one partition holds of one group; only
the sizes of runs, a row each, are summed up by group.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch

RUN_BITS = 33  # below them, monotonically_increasing_id counts within a partition


class Ordered(NamedTuple):
    """The written rows with ``_row``; and (group, _run, _first, _rows, _before, _total) of every run."""

    rows: DataFrame
    runs: DataFrame


def in_order(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> Ordered:
    """``rows`` sorted by ``order`` within ``group`` (not null).  Rows that agree in all of it come in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may be many: a number of their own lets a range end among them
    keys = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    numbered = dealt.sortWithinPartitions(*keys).drop("_tie").withColumn("_row", F.monotonically_increasing_id())
    written = scratch.write(numbered, name)
    whole = Window.partitionBy(group)
    runs = (
        written.groupBy(group, F.shiftright("_row", RUN_BITS).alias("_run"))
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_total", F.sum("_rows").over(whole))
        .withColumn("_before", F.sum("_rows").over(whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"))
    )
    return Ordered(written, scratch.write(runs, f"{name}-runs"))


def placed(ordered: Ordered, group: str) -> DataFrame:
    """The rows with ``_at``, counted from 0 in each group, and the group's ``_total``."""
    with_run = ordered.rows.withColumn("_run", F.shiftright("_row", RUN_BITS))
    return with_run.join(ordered.runs.drop("_rows"), [group, "_run"]).withColumn(
        "_at", F.col("_row") - F.col("_first") + F.col("_before")
    ).drop("_run", "_first", "_before")
