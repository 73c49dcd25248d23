"""Mix sources to target weights by pivotal dependent rounding.

A source's target divided by its size is how often each of its documents should
be taken.  The whole part is taken; of the fractional parts a rounding makes
whole copies: two documents at a time, words are moved from the one's
probability to the other's until one of them is 0 or 1, with a coin whose odds
keep every document's expectation.  What a source takes in words never changes
by a move, so only its last document is off.  Long documents go first: the
short ones after them settle them, and the last one is short.

Documents are dealt by hash into groups of a source; a group rounds all but
one document, the residuals of ``FAN_IN`` groups form a group of the next
level, and so on up a tree until each source has one residual, which is rounded
by a coin of its own.

Coins are hashes of ``seed`` and the document, so reruns agree.

Defined cases: null is a source of its own and the last; a null or empty text
has size 0 and is taken as often as the whole part says; rows with one doc_id are documents of their own,
in any order where they are alike; an empty table gives none; other columns are
carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch, text_key, words_of

WEIGHTS = (5, 2, 1)  # by source in code point order, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # copies of any document
GROUP_ROWS = 20_000
FAN_IN = 512
SEED = 9


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, no target above ``most`` times its source.

    What a full source leaves over goes to the others by weight.  The level at
    which that ends is found on the sources in order of ``size / weight``: the
    first one that is not full at the level which the rest, itself included,
    would get.  ``sizes``: (source, source_size), a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_i") % len(weights) + 1)
    weighed = sizes.withColumn("_i", (F.row_number().over(order) - 1)).withColumn("_w", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    leveled = weighed.select(
        "*",
        (share * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_left"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_rest"),
    ).withColumn("_level", F.col("_left") / F.col("_rest"))
    open_at = F.when(F.col("_level") * F.col("_w") <= most * F.col("source_size"), F.col("_level"))
    found = leveled.withColumn("_level", F.max(open_at).over(whole))
    full = F.col("source_size") * F.lit(most)
    target = F.when(F.col("_level").isNull(), full).otherwise(F.least(F.col("_level") * F.col("_w"), full))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def _coin(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)).cast("double") / float(2**53)


def _round_group(size: np.ndarray, p: np.ndarray, coin: np.ndarray) -> int:
    """Make ``p`` whole in place for all but one document, whose index is returned (-1: none left)."""
    at = -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if at < 0:
            at = i
            continue
        a, b = size[at], size[i]
        up = min(a * (1 - p[at]), b * p[i])  # words that may move from i to at
        down = min(a * p[at], b * (1 - p[i]))
        moved = up if coin[i] * (up + down) < down else -down
        pa_, pi = p[at] + moved / a, p[i] - moved / b
        # The one that reached its end is set to it exactly.
        ends = [abs(pa_ - round(pa_)), abs(pi - round(pi))]
        if ends[0] <= ends[1]:
            p[at], p[i] = round(pa_), min(max(pi, 0.0), 1.0)
            at = i if 1e-12 < p[i] < 1 - 1e-12 else -1
            if at < 0:
                p[i] = round(p[i])
        else:
            p[i], p[at] = round(pi), min(max(pa_, 0.0), 1.0)
            if not 1e-12 < p[at] < 1 - 1e-12:
                p[at] = round(p[at])
                at = -1
    return at


def _round_rows(groups: pa.Table) -> pa.Table:
    groups = groups.combine_chunks().sort_by([("size", "descending"), ("_order", "ascending"), ("_row", "ascending")])
    p = groups["_p"].to_numpy().copy()
    at = _round_group(groups["size"].to_numpy().astype(float), p, groups["_coin"].to_numpy())
    open_ = np.zeros(len(p), bool)
    if at >= 0:
        open_[at] = True
    i = groups.schema.get_field_index("_p")
    groups = groups.set_column(i, "_p", pa.array(p))
    return groups.set_column(groups.schema.get_field_index("_open"), "_open", pa.array(open_))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, _text_key, size, source_size, target, copies): one row per row of ``docs``.

    ``docs`` needs doc_id, source and text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = text_key(F.col("text"))
    sized = scratch.write(
        docs.select("doc_id", "source", key.alias("_text_key"), F.size(words_of(F.col("text"))).cast("long").alias("size")),
        "sized",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    # One row per source from here on; the joins below leave it to Spark whether it is small enough to send around.
    sums = scratch.write(sums, "sums")
    goals = targets(sums.select("source", "source_size"), weights, share, most)
    goals = scratch.write(
        goals.join(sums.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"),
        "goals",
    )
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text_key"), F.ceil(F.col("_rows") / GROUP_ROWS))
    named = goals.withColumnRenamed("source", "_s")
    rows = (
        sized.join(named, F.col("source").eqNullSafe(F.col("_s")))
        .select(
            "doc_id", "source", "_text_key", "size", "source_size", "target",
            F.floor(often).cast("long").alias("_whole"),
            F.when(F.col("size") > 0, often - F.floor(often)).otherwise(F.lit(0.0)).alias("_p"),
            _coin(F.lit(seed), F.lit("move"), "doc_id", "_text_key").alias("_coin"),
            F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "_text_key").alias("_order"),
            F.monotonically_increasing_id().alias("_row"), F.lit(False).alias("_open"), group.cast("long").alias("_group"),
        )
    )
    done, level = [], 0
    while True:
        rounded = scratch.write(
            rows.groupBy("source", "_group").applyInArrow(_round_rows, rows.schema), f"level{level}"
        )
        done.append(rounded.where(~F.col("_open")))
        residual = rounded.where("_open")
        if residual.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            last = _coin(F.lit(seed), F.lit("last"), "doc_id", "_text_key") < F.col("_p")
            done.append(residual.withColumn("_p", last.cast("double")))
            break
        rows, level = residual.withColumn("_group", F.floor(F.col("_group") / FAN_IN)), level + 1
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    return everything.select(
        "doc_id", "source", "_text_key", "size", "source_size", "target",
        (F.col("_whole") + F.round("_p").cast("long")).alias("copies"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows alike in id, source and text share their copies out among them: the
    copies of all of them are added up and made from one.
    """
    taken = mix(docs, **settings).groupBy("doc_id", "source", "_text_key").agg(F.sum("copies").alias("_copies"))
    taken = taken.where("_copies > 0").select(*(F.col(c).alias(f"_t_{c.strip('_')}") for c in taken.columns))
    named = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", text_key(F.col("text")).alias("_k"))
    return (
        named.dropDuplicates(["doc_id", "source", "_k"])
        .join(
            taken,
            F.col("doc_id").eqNullSafe(F.col("_t_doc_id"))
            & F.col("source").eqNullSafe(F.col("_t_source"))
            & (F.col("_k") == F.col("_t_text_key")),
        )
        .select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t_copies"))))
        .select("whole.*")
    )
