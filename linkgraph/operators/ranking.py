"""Prominence, lookups by exact name, labels and head override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column

# Fixed values of the ranking rules.
COVERAGE_THRESHOLD = 0.9
OVERRIDE_FACTOR = 50


def coverage_fraction(rows: DataFrame, flag: str) -> DataFrame:
    """Share of rows whose flag is set; an empty table has 0."""
    return rows.agg(
        F.coalesce(F.avg(F.coalesce(F.col(flag).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("coverage")
    )


def with_prominence(entities: DataFrame) -> DataFrame:
    """Add ``primary`` and ``secondary`` prominence keys.

    Popularity leads once enough entities carry one, degree leads before.
    ``entities(id, name, popularity, degree, enriched)``.
    """
    ready = coverage_fraction(entities, "enriched").select(
        (F.col("coverage") >= COVERAGE_THRESHOLD).alias("ready")
    )
    flagged = entities.withColumn("by_popularity", ready.scalar())
    popularity, degree = F.col("popularity").cast("bigint"), F.col("degree").cast("bigint")
    return flagged.withColumn("primary", F.when(F.col("by_popularity"), popularity).otherwise(degree)).withColumn(
        "secondary", F.when(F.col("by_popularity"), degree).otherwise(popularity)
    ).drop("by_popularity")


def best_by_name(entities: DataFrame, name: ColumnLike) -> DataFrame:
    """The most popular entity per case-insensitive name (id breaks ties)."""
    order = F.struct(
        (-F.col("popularity")).alias("p"), (-F.col("degree")).alias("d"), F.col("id"), F.col("name")
    )
    return entities.groupBy(F.lower(as_column(name)).alias("key")).agg(F.min(order).alias("best")).select(
        "key", F.col("best.id").alias("id"), F.col("best.name").alias("name")
    )


def exact_lookup(queries: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact name of each query, or, without one, its exact alias.

    Each lookup table holds one row per name before it is joined, so neither
    a common name nor a repeated query multiplies rows.
    """
    by_name = best_by_name(entities, "name")
    called = aliases.join(entities, F.col("entity_id") == F.col("id"))
    by_alias = best_by_name(called, "alias").select(
        "key", F.col("id").alias("alias_id"), F.col("name").alias("alias_name")
    )
    asked = queries.select("query").distinct().withColumn("key", F.lower("query"))
    return (
        asked.join(by_name, "key", "left")
        .join(by_alias, "key", "left")
        .select(
            "query",
            F.coalesce("id", "alias_id").alias("id"),
            F.coalesce("name", "alias_name").alias("name"),
            F.when(F.col("id").isNotNull(), "name").when(F.col("alias_id").isNotNull(), "alias").alias("matched_by"),
        )
    )


def promote_prominent(ranked: DataFrame, factor: int = OVERRIDE_FACTOR) -> DataFrame:
    """Let a far more prominent looser match take the head of a result list.

    Applies when the head is an exact/prefix match (tier 0): the most
    prominent row of a higher tier moves to rank 1 if it has at least
    ``factor`` times the head's prominence; the rest keep their order.
    ``ranked(query, rank, tier, primary, ...)`` holds short lists.
    """
    whole = Window.partitionBy("query")
    head = F.max(F.when(F.col("rank") == 1, F.struct("tier", "primary"))).over(whole)
    rival = F.min(
        F.when(F.col("tier") > 0, F.struct((-F.col("primary")).alias("minus"), F.col("rank")))
    ).over(whole)
    judged = ranked.withColumn("head", head).withColumn("rival", rival)
    wins = (
        (F.col("head.tier") == 0)
        & F.col("rival").isNotNull()
        & (-F.col("rival.minus") >= factor * F.greatest(F.col("head.primary"), F.lit(1)))
    )
    moved = (
        F.when(~F.coalesce(wins, F.lit(False)), F.col("rank"))
        .when(F.col("rank") == F.col("rival.rank"), F.lit(1))
        .when(F.col("rank") < F.col("rival.rank"), F.col("rank") + 1)
        .otherwise(F.col("rank"))
    )
    return judged.withColumn("rank", moved.cast("int")).drop("head", "rival")


def label_candidates(candidates: DataFrame) -> DataFrame:
    """Distinct display labels within each query's short candidate list.

    A repeated name gets its number of collaborations; labels that still tie
    are numbered from 2 in id order.
    """
    same = Window.partitionBy("query", F.lower("name"))
    unit = F.when(F.col("degree") == 1, " collab").otherwise(" collabs")
    qualified = F.when(F.count(F.lit(1)).over(same) == 1, F.col("name")).otherwise(
        F.concat("name", F.lit(" · "), F.col("degree").cast("string"), unit)
    )
    labelled = candidates.withColumn("label", qualified)
    tied = Window.partitionBy("query", F.lower("label")).orderBy("id")
    numbered = labelled.withColumn("seq", F.row_number().over(tied))
    return numbered.withColumn(
        "label",
        F.when(F.col("seq") > 1, F.concat("label", F.lit(" ("), F.col("seq").cast("string"), F.lit(")"))).otherwise(
            F.col("label")
        ),
    ).drop("seq")


def rank_by(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Number rows per key; with ``limit`` Spark prunes before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit) if limit is not None else ranked
