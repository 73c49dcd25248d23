"""Which recordings, groups and members take part in the graph."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column

# Defaults of the eligibility rules.
ACCEPTED_STATUSES = ("1",)
EXCLUDED_TYPES = ("3", "4", "5", "8")
ALIAS_TYPES = ("1", "2")


def excluded_groups(types: DataFrame, group: str, kind: str, excluded: Iterable = EXCLUDED_TYPES) -> DataFrame:
    """Release groups that carry an excluded secondary type."""
    return types.filter(F.col(kind).isin(*excluded)).select(group).distinct()


def eligible_releases(
    releases: DataFrame,
    excluded: DataFrame,
    group: str,
    status: str,
    accepted: Iterable = ACCEPTED_STATUSES,
) -> DataFrame:
    """Releases of an accepted status outside the excluded groups."""
    return releases.filter(F.col(status).isin(*accepted)).join(excluded, group, "left_anti")


def keep_referenced(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; the filtering side is never expanded."""
    return rows.join(keys, on, "left_semi")


def multi_member(members: DataFrame) -> DataFrame:
    """Distinct memberships of groups that have at least two members.

    ``members`` is scanned twice, so a plan with joins of its own is better written first.
    """
    distinct = members.select("group_id", "entity_id").distinct()
    # min <> max tells two members apart without counting distinct values.
    shared = (
        members.groupBy("group_id")
        .agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
        .filter("lo <> hi")
        .select("group_id")
    )
    return distinct.join(shared, "group_id", "left_semi")


def alias_table(
    aliases: DataFrame, nodes: DataFrame, arrival: ColumnLike, types: Iterable = ALIAS_TYPES
) -> DataFrame:
    """Usable aliases of the graph's nodes.

    ``aliases(entity_id, alias, type)``; ``nodes(id, name)``.  Empty aliases,
    other types and repetitions of the display name are dropped; of several
    spellings that differ only in case the first to arrive stays.
    """
    usable = aliases.filter(
        F.col("type").isin(*types) & F.col("alias").isNotNull() & (F.col("alias") != "")
    )
    first = usable.groupBy("entity_id", F.lower("alias").alias("folded")).agg(
        F.min(F.struct(as_column(arrival).alias("arrival"), F.col("alias")))["alias"].alias("alias")
    )
    named = first.join(nodes.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return named.filter(F.col("folded") != F.lower("name")).select("entity_id", "alias")


def min_degree(rows: DataFrame, degrees: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose node has at least ``least`` edges; unknown nodes have none."""
    return (
        rows.join(degrees.select(F.col("id").alias(key), "degree"), key, "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
        .filter(F.col("degree") >= least)
    )


def min_endpoint_degree(titles: DataFrame, degrees: DataFrame, least: int) -> DataFrame:
    """Edge titles with a prominent endpoint: the larger degree counts."""
    a = degrees.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    b = degrees.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    return (
        titles.join(a, "src")
        .join(b, "dst")
        .withColumn("best_degree", F.greatest("src_degree", "dst_degree"))
        .filter(F.col("best_degree") >= least)
        .drop("src_degree", "dst_degree")
    )


def pending(rows: DataFrame, state: str) -> DataFrame:
    """Rows not looked at yet; a stored "no match" marker is not pending."""
    return rows.filter(F.col(state).isNull())
