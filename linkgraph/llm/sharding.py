"""A uniform shuffle into shards of exact size, by a hypergeometric matrix.

Rows are dealt by hash into ``2^depth`` partitions.  How many rows go from
each partition to each shard is drawn exactly: a binary tree over the
partitions splits the shards' capacities between its halves by multivariate
hypergeometric draws, one level a step, so the draws run as ordinary rows and
the leaves are the communication matrix.  Each partition is permuted locally
and cut at its row of the matrix, rows are exchanged, and a second permutation
inside each shard (again in hash ranges, with a prefix sum over range sizes)
gives gapless slots.  Shard sizes differ by one at most.

All randomness is a hash of ``seed`` and the row's key, so a lost task repeats
the same draws.

Defined cases: rows with equal keys take different slots, in any order between
them (they are the same row); a null key value is a value; fewer rows than
shards leave shards empty; an empty table gives none; other columns are
carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch, let

SHARDS = 16
SEED = 20
SPREAD_LEVEL = 5  # of the tree, from which its nodes are dealt to tasks


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of ``parts``."""
    return (F.call_function("shiftrightunsigned", F.xxhash64(*parts), F.lit(11)).cast("double") + 0.5) / float(2**53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a sample of ``drawn``: the inverse of the distribution at ``u``.

    The weights come from the ratio of neighbouring probabilities, outwards
    from the mode, up first.  Ten standard deviations on both sides leave out
    less than a double can hold.
    """
    total, good, drawn = (c.cast("double") for c in (total, good, drawn))
    lowest, highest = F.greatest(F.lit(0.0), drawn + good - total), F.least(good, drawn)
    mode = F.greatest(lowest, F.least(highest, F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("double")))
    share = good / total
    reach = F.ceil(10 * F.sqrt(drawn * share * (1 - share)) + 20).cast("double")

    def drawn_from(x: Column) -> Column:
        above = F.least(x["highest"], x["mode"] + x["reach"]) - x["mode"]
        below = x["mode"] - F.greatest(x["lowest"], x["mode"] - x["reach"])

        def steps(n: Column) -> Column:
            return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n.cast("int")))

        def ratio(i: Column, up: bool) -> Column:
            """The weight at the i-th step from the mode, over the one before."""
            k = x["mode"] + i if up else x["mode"] - i + 1  # the larger of the two
            rise = (x["good"] - k + 1) * (x["drawn"] - k + 1), k * (x["total"] - x["good"] - x["drawn"] + k)
            return rise[0] / rise[1] if up else rise[1] / rise[0]

        def mass(n: Column, up: bool) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(
                steps(n), start,
                lambda acc, i: let(acc["w"] * ratio(i, up), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s"))),
            )["s"]

        def walk(n: Column, up: bool, goal: Column) -> Column:
            """The first step at which the weights add up to ``goal``, or the last."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).alias("at"))
            return F.aggregate(
                steps(n), start,
                lambda acc, i: let(
                    acc["w"] * ratio(i, up),
                    lambda w: F.struct(
                        w.alias("w"), (acc["s"] + w).alias("s"), F.when(acc["s"] < goal, i).otherwise(acc["at"]).alias("at")
                    ),
                ),
            )["at"]

        def picked(m: Column) -> Column:
            goal = x["u"] * (1 + m["up"] + m["down"])
            return (
                F.when(goal <= 1, x["mode"])
                .when(goal <= 1 + m["up"], x["mode"] + walk(above, True, goal - 1))
                .otherwise(x["mode"] - walk(below, False, goal - 1 - m["up"]))
                .cast("long")
            )

        return let(F.struct(mass(above, True).alias("up"), mass(below, False).alias("down")), picked)

    drawn_or_none = let(
        F.struct(
            total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"),
            lowest.alias("lowest"), highest.alias("highest"), mode.alias("mode"), reach.alias("reach"),
        ),
        drawn_from,
    )
    return F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).otherwise(drawn_or_none)


def _taken(node: Column, caps: Column, drawn: Column, seed: int) -> Column:
    """How many of ``drawn`` rows go to each shard with ``caps`` places left: one shard after the other."""
    start = F.struct(
        F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c).alias("left"), drawn.alias("drawn"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(acc: Column, cap: Column) -> Column:
        u = _uniform(F.lit(seed), node, F.size(acc["out"]))
        return let(
            hypergeometric(acc["left"], cap, acc["drawn"], u),
            lambda k: F.struct(
                (acc["left"] - cap).alias("left"), (acc["drawn"] - k).alias("drawn"),
                F.concat(acc["out"], F.array(k)).alias("out"),
            ),
        )

    return F.aggregate(caps, start, step)["out"]


def communication_matrix(sizes: DataFrame, shards: int, depth: int, seed: int) -> DataFrame:
    """(part, shard, below, upto): which local ranks of a partition go to a shard; ``sizes``: (part, n)."""
    spark = sizes.sparkSession
    every = spark.range(2**depth).select(F.col("id").cast("int").alias("part"))
    root = (
        every.join(sizes, "part", "left")
        .agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("p"))
        .select(F.transform("p", lambda x: x["n"]).alias("n"))
    )
    rows = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(rows / shards) + F.when(s < rows % shards, 1).otherwise(0)
    )
    nodes = root.select(F.lit(1).alias("node"), "n", caps.alias("caps"))
    for level in range(depth, 0, -1):
        if depth - level == SPREAD_LEVEL:
            nodes = nodes.repartition("node")
        half = 2 ** (level - 1)
        left, right = F.slice("n", 1, half), F.slice("n", half + 1, half)
        split = nodes.select(
            "node", "caps", left.alias("left"), right.alias("right"),
            _taken(F.col("node"), F.col("caps"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x), seed).alias("got"),
        )
        nodes = split.select(
            F.inline(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n"), F.col("got").alias("caps")),
                    F.struct(
                        (F.col("node") * 2 + 1).alias("node"), F.col("right").alias("n"),
                        F.zip_with("caps", "got", lambda a, b: a - b).alias("caps"),
                    ),
                )
            )
        )
    ends = nodes.select((F.col("node") - 2**depth).alias("part"), F.posexplode("caps").alias("shard", "count"))
    upto = F.sum("count").over(Window.partitionBy("part").orderBy("shard"))
    return ends.select("part", "shard", (upto - F.col("count")).alias("below"), upto.alias("upto"), "count")


def shard(
    df: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED, depth: int | None = None
) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; ``key`` are the columns that tell its rows apart.

    ``depth``: the rows are dealt into 2^depth partitions, by default as many
    as the session shuffles into, rounded up.
    """
    spark = df.sparkSession
    if depth is None:
        depth = max(4, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    keys = [F.col(f"whole.`{c}`") for c in key]
    carried = df.select(F.struct(*(c for c in df.columns if c not in ("shard", "slot"))).alias("whole"))
    dealt = carried.withColumns({"_h1": F.xxhash64(F.lit(seed), *keys), "_h2": F.xxhash64(F.lit(-seed - 1), *keys)})
    dealt = dealt.withColumn("_part", F.pmod("_h1", F.lit(2**depth)).cast("int"))
    scratch = Scratch(spark, "shard")
    local = Window.partitionBy("_part").orderBy("_h2", *keys)
    permuted = scratch.write(dealt.withColumn("_rank", F.row_number().over(local).cast("long")), "permuted")
    sizes = permuted.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    matrix = scratch.write(communication_matrix(sizes, shards, depth, seed), "matrix")
    cuts = matrix.groupBy(F.col("part").alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("_cuts")
    )
    # The shard is the number of cuts at or below the rank: as many as there are shards, a parameter.
    at = F.size(F.filter("_cuts", lambda c: c["upto"] < F.col("_rank")))
    sent = scratch.write(
        permuted.join(cuts, "_part").withColumn("shard", at).drop("_cuts", "_rank", "_part"), "sent"
    )
    scratch.drop("permuted", "matrix")
    # The second permutation orders a shard by a new hash; ranges of that hash are ranked apart and then offset.
    ranges = 2**depth
    sent = sent.withColumn("_h3", F.xxhash64(F.lit(seed), F.col("_h2"), F.col("_h1"))).withColumn(
        "_range", F.pmod("_h3", F.lit(ranges)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_range").orderBy("_h3", *keys)
    ranked = sent.withColumn("_slot", F.row_number().over(inside) - 1)
    placed = ranked.join(starts, ["shard", "_range"])
    return placed.select("whole.*", "shard", (F.col("_start") + F.col("_slot")).cast("long").alias("slot"))
