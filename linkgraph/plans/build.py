"""The end-to-end graph build as one plan around the traversal loop."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike
from linkgraph.functions.text import fold_name
from linkgraph.operators.eligibility import alias_table, keep_referenced, multi_member
from linkgraph.operators.paths import with_name
from linkgraph.operators.projection import edge_degrees, edge_nodes, refresh_degrees
from linkgraph.operators.titles import (
    best_forms, bounded_titles, edge_references, ranked_titles, referenced_titles, title_forms,
)
from linkgraph.operators.traversal import ball_groups, distances
from linkgraph.session import materialize
from linkgraph.sources.graph_store import Graph

# Fixed value: hops stored around the hub.
DEFAULT_DEPTH = 3


def credited_titles(items: DataFrame, order: Sequence[ColumnLike], cap: int | None = None) -> DataFrame:
    """Kept titles per group; groups without an eligible item are absent.

    All items of a group are looked at, or with ``cap`` the first ones in ``order``.
    """
    raw = items if cap is None else bounded_titles(items, "group_id", order, cap)
    # Written between the two sorts, so that no task holds both.
    best = materialize(best_forms(title_forms(raw, ["group_id"]), ["group_id"]), "best-forms")
    return ranked_titles(best, ["group_id"])


def credited_members(members: DataFrame, group_titles: DataFrame, entities: DataFrame) -> DataFrame:
    """Members of titled groups that exist as entities, in groups of two or more."""
    titled = keep_referenced(members, group_titles.select("group_id"), "group_id")
    known = keep_referenced(titled, entities.select(F.col("id").alias("entity_id")), "entity_id")
    # Written, so that no task holds the sorts of these joins and the tables of the next step together.
    return multi_member(materialize(known.select("group_id", "entity_id"), "known-members"))


def build_graph(
    members: DataFrame,
    items: DataFrame,
    item_order: Sequence[ColumnLike],
    entities: DataFrame,
    aliases: DataFrame,
    alias_order: ColumnLike,
    seed: DataFrame,
    depth: int = DEFAULT_DEPTH,
    alias_types: Sequence = ("1", "2"),
) -> Graph:
    """Everything within ``depth`` hops of the seed.

    ``members(group_id, entity_id)``; eligible ``items(group_id, title, ...)``;
    ``entities(id, name)``; ``aliases(entity_id, alias, type)``;
    ``seed(id)``, one row.  Tables read several times are written once.
    """
    group_titles = materialize(credited_titles(items, item_order), "titles")
    credited = materialize(credited_members(members, group_titles, entities), "credited")
    seeds = seed.select(F.col("id").alias("root"), F.col("id").alias("node"))
    reached = distances(credited, seeds, max_depth=depth).table

    expanded = reached.filter(F.col("dist") < depth).select(F.col("node").alias("entity_id"))
    pairs = materialize(ball_groups(credited, expanded), "edge-groups")
    referenced = materialize(edge_references(pairs, group_titles), "references")
    titles = materialize(referenced_titles(referenced), "edge-titles")
    # every edge has a title: its groups were kept for having one
    edges = titles.filter("rank = 1").select("src", "dst")
    references = referenced.drop("rank")
    behind = keep_referenced(credited, pairs.select("group_id"), "group_id")
    credits = with_name(behind, entities, "entity_id", "name").select("group_id", "entity_id", "name")

    named = with_name(edge_nodes(edges), entities, "id", "name")
    nodes = refresh_degrees(named, edge_degrees(edges))
    usable = alias_table(
        keep_referenced(aliases, nodes.select(F.col("id").alias("entity_id")), "entity_id"),
        nodes,
        alias_order,
        alias_types,
    ).withColumn("alias_norm", fold_name("alias"))
    return Graph(nodes, usable, edges, titles, references, credits)
