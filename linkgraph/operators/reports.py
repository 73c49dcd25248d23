"""Coverage and quality reports over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.containment import substring_pairs

# Warning levels of the reports.
EXPLOSION_FACTOR = 15.0
OUTER_RING_PERCENT = 70.0


def hop_histogram(reached: DataFrame) -> DataFrame:
    """Nodes per distance and their share of all reached nodes."""
    counts = reached.groupBy("dist").agg(F.count(F.lit(1)).alias("nodes"))
    total = reached.agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", total.scalar()).select(
        "dist", "nodes", (F.lit(100.0) * F.col("nodes") / F.col("total")).alias("percent")
    )


def reach_summary(reached: DataFrame) -> DataFrame:
    """Reachable nodes, hop statistics and the weight of the outer ring.

    Median and mean leave out the seed; the outer ring's share includes it in
    the denominator.  Works from the histogram, whose size is the number of
    distances, so the median needs no sort of all nodes.
    """
    bars = reached.groupBy("dist").agg(F.count(F.lit(1)).alias("nodes"))
    away = F.col("dist") > 0
    median = bars.filter(away).agg(F.expr("percentile(dist, 0.5, nodes)").alias("median_hops"))
    top = bars.agg(F.max("dist").alias("d"))
    summary = bars.withColumn("top", top.scalar()).agg(
        F.sum(F.when(away, F.col("nodes")).otherwise(0)).cast("bigint").alias("reachable"),
        F.try_divide(
            F.sum(F.when(away, F.col("dist") * F.col("nodes"))).cast("double"),
            F.sum(F.when(away, F.col("nodes"))),
        ).alias("mean_hops"),
        F.max("dist").alias("max_hops"),
        (
            F.lit(100.0) * F.sum(F.when(F.col("dist") == F.col("top"), F.col("nodes")).otherwise(0)) / F.sum("nodes")
        ).alias("outer_percent"),
    )
    return summary.select(
        "reachable",
        median.scalar().alias("median_hops"),
        "mean_hops",
        "max_hops",
        "outer_percent",
        (F.col("outer_percent") > OUTER_RING_PERCENT).alias("outer_warning"),
    )


def growth(stats: DataFrame, baseline: DataFrame, factor: float = EXPLOSION_FACTOR) -> DataFrame:
    """Growth of a one-row node count over a one-row baseline."""
    return stats.select(
        "nodes", baseline.select("nodes").scalar().alias("baseline_nodes")
    ).select(
        "nodes",
        "baseline_nodes",
        F.try_divide(F.col("nodes").cast("double"), F.col("baseline_nodes")).alias("growth"),
        F.coalesce(
            F.try_divide(F.col("nodes").cast("double"), F.col("baseline_nodes")) > factor, F.lit(False)
        ).alias("explosion"),
    )


def no_connection_rate(outcomes: DataFrame) -> DataFrame:
    """Connected and unconnected targets; the hub itself counts as connected."""
    connected = F.coalesce(F.col("status").isin("connected", "self"), F.lit(False))
    return outcomes.agg(
        F.count_if(connected).alias("connected"),
        F.count_if(~connected).alias("not_connected"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(~connected), F.count(F.lit(1))), F.lit(0.0)).alias(
            "no_connection_percent"
        ),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, titles: DataFrame) -> DataFrame:
    """Nodes, edges and titles in one row."""
    def rows(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    return rows(nodes).select(
        F.col("n").alias("nodes"), rows(edges).scalar().alias("edges"), rows(titles).scalar().alias("titles")
    )


def graph_invariants(edges: DataFrame, titles: DataFrame, hops: DataFrame) -> DataFrame:
    """Violations per rule: edges in stored order, edges without a title,
    repeated titles of an edge, path hops without a title."""
    def rule(name: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    titled = titles.select("src", "dst").distinct()
    return (
        rule("edge_order", edges.filter(~(F.col("src") < F.col("dst"))))
        .unionByName(rule("edge_without_title", edges.join(titled, ["src", "dst"], "left_anti")))
        .unionByName(rule("repeated_title", _repeated_titles(titles)))
        .unionByName(rule("hop_without_title", hops.join(titled, ["src", "dst"], "left_anti")))
    )


def _repeated_titles(titles: DataFrame) -> DataFrame:
    """``(src, dst, title)`` rows that come more than once; texts move only where their hash does, too."""
    hashed = titles.select("src", "dst", "title", F.xxhash64("title").alias("mark"))
    often = hashed.groupBy("src", "dst", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    a, b = hashed.alias("a"), often.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("src", "dst", "mark")]
    again = a.join(b, same, "left_semi").groupBy("src", "dst", "title").agg(F.count(F.lit(1)).alias("n"))
    return again.filter("n > 1")


def duplicate_names(entities: DataFrame) -> DataFrame:
    """Case-insensitive names that several entities share."""
    return (
        entities.groupBy(F.lower("name").alias("name_key"))
        .agg(F.count(F.lit(1)).alias("entities"))
        .filter("entities > 1")
    )


def watchlist_hits(texts: DataFrame, text: str, hints: DataFrame, hint: str) -> DataFrame:
    """``(text, hint)`` for texts that contain a hint, ignoring case.

    ``texts`` may repeat; the containment join sees each distinct text once.
    """
    lowered = texts.select(F.col(text).alias("original"), F.lower(text).alias("text")).distinct()
    wanted = hints.select(F.lower(hint).alias("hint")).distinct()
    pairs = substring_pairs(wanted, "hint", lowered, "text")
    return lowered.join(pairs, "text").select(F.col("original").alias("text"), F.col("needle").alias("hint"))


def flag_paths(
    named_nodes: DataFrame, titles: DataFrame, keys: list[str], node_hints: DataFrame, title_hints: DataFrame
) -> DataFrame:
    """Watchlist hits of each path, for human review.

    ``named_nodes(*keys, name)`` and ``titles(*keys, title)``.
    """
    def hits(rows: DataFrame, column: str, hints: DataFrame, kind: str) -> DataFrame:
        found = watchlist_hits(rows, column, hints, "hint")
        return rows.join(found, F.col(column) == F.col("text")).select(
            *keys, F.lit(kind).alias("kind"), "text", "hint"
        ).distinct()

    return hits(named_nodes, "name", node_hints, "node").unionByName(hits(titles, "title", title_hints, "title"))


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per category."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
