"""Breadth-first traversal over group membership.

A hop goes node -> its groups -> their members, so a group of n members costs
n rows per hop instead of n squared edges.  Each round is one job that writes
one level table below the checkpoint folder; the loop on the driver sees row
counts only.  Small levels are broadcast because their written size says so,
large ones are shuffled and AQE splits hot nodes or groups.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions._columns import union_all
from linkgraph.operators.projection import canonical_pair, faced_once
from linkgraph.session import Written, materialize, write_counted

LEVEL_COLUMNS = ("root", "node", "dist", "parent")

# Joins chained before a long walk writes an intermediate table.
HOPS_PER_PLAN = 8


class Reached(NamedTuple):
    """Nodes with distance and parent, and the largest distance found."""

    table: DataFrame
    hops: int


def seeds_of(nodes: DataFrame, column: str) -> DataFrame:
    """One traversal per node of ``column``, each named after its own start."""
    return nodes.select(F.col(column).alias("root"), F.col(column).alias("node")).distinct()


def _expand(frontier: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes that share a group with the frontier, and their smallest link.

    All frontier nodes of a group are equally far from the root, so the
    smallest one is the best parent the group can offer.
    """
    groups = (
        frontier.join(members.withColumnRenamed("entity_id", "node"), "node")
        .groupBy("root", "group_id")
        .agg(F.min("node").alias("via"))
    )
    return (
        groups.join(members, "group_id")
        .groupBy("root", F.col("entity_id").alias("node"))
        .agg(F.min("via").alias("parent"))
    )


def _next_level(last_two: list[DataFrame], members: DataFrame, depth: int) -> Written:
    """Write the nodes at ``depth``, given the two levels before it.

    Sharing a group is symmetric, so a neighbour of a node at distance d is at
    distance d - 1, d or d + 1: only the last two levels can come up again.
    """
    recent = union_all([level.select("root", "node") for level in last_two])
    fresh = _expand(last_two[-1].select("root", "node"), members).join(recent, ["root", "node"], "left_anti")
    return write_counted(
        fresh.select("root", "node", F.lit(depth).cast("bigint").alias("dist"), "parent"), "level"
    )


def distances(
    members: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    targets: DataFrame | None = None,
) -> Reached:
    """Hop distances from each seed, with the smallest parent one hop closer.

    ``members`` is scanned in every round, so pass a written table.
    ``seeds(root, node)``.  Stops at ``max_depth``, at an empty level, or once
    every ``targets(root, node)`` row has been reached.
    """
    node_type = members.schema["entity_id"].dataType
    start = seeds.select(
        "root",
        "node",
        F.lit(0).cast("bigint").alias("dist"),
        F.lit(None).cast(node_type).alias("parent"),
    )
    levels = [materialize(start, "level")]
    waiting = targets.select("root", "node").distinct() if targets is not None else None
    depth = 0
    while max_depth is None or depth < max_depth:
        frontier = levels[-1]
        if waiting is not None:
            left = write_counted(waiting.join(levels[-1], ["root", "node"], "left_anti"), "waiting")
            if left.rows == 0:
                break
            waiting = left.table
            # A root all of whose targets were found goes no further.
            frontier = frontier.join(waiting.select("root").distinct(), "root", "left_semi")
        level = _next_level([*levels[-2:-1], frontier], members, depth + 1)
        if level.rows == 0:
            break
        levels.append(level.table)
        depth += 1
    return Reached(union_all(levels), depth)


def resume(
    members: DataFrame, stored: DataFrame, max_depth: int | None = None
) -> Reached:
    """Continue traversals whose ``stored`` levels were saved earlier.

    Each root goes on from its own outer ring; everything closer has been
    expanded before.  An empty store stays empty.
    """
    stored = materialize(stored.select(*LEVEL_COLUMNS), "stored")
    outer = stored.groupBy("root").agg(F.max("dist").alias("outer"))
    ringed = materialize(stored.join(outer, "root").filter(F.col("dist") >= F.col("outer") - 1), "rings")
    before = ringed.filter(F.col("dist") < F.col("outer")).select("root", "node")
    frontier = ringed.filter(F.col("dist") == F.col("outer")).select("root", "node", "dist")
    levels, hops = [stored], 0
    while True:
        if max_depth is not None:
            frontier = frontier.filter(F.col("dist") < max_depth)
        recent = before.unionByName(frontier.select("root", "node"))
        reach = frontier.groupBy("root").agg((F.max("dist") + 1).alias("dist"))
        fresh = _expand(frontier.select("root", "node"), members).join(recent, ["root", "node"], "left_anti")
        level = write_counted(fresh.join(reach, "root").select(*LEVEL_COLUMNS), "level")
        if level.rows == 0:
            break
        levels.append(level.table)
        before, frontier = frontier.select("root", "node"), level.table.select("root", "node", "dist")
        hops += 1
    everything = union_all(levels)
    farthest = everything.agg(F.coalesce(F.max("dist"), F.lit(0)).alias("far")).first()["far"]
    return Reached(everything, int(farthest))


class Meeting(NamedTuple):
    """What ``walk_back`` needs for the paths of pairs (``root`` is the pair), and how far either side went."""

    reached: Reached
    ahead: int
    behind: int


def _met(level: Written, other: Written, ahead: int, behind: int) -> Written:
    both = level.table.select("root", "node").join(other.table.select("root", "node"), ["root", "node"])
    return write_counted(both.select("root", "node", F.lit(ahead).alias("ahead"), F.lit(behind).alias("behind")), "met")


def meet_in_the_middle(members: DataFrame, pairs: DataFrame) -> Meeting:
    """Shortest paths between two nodes each, searched from both ends.

    ``pairs(pair, root, node)`` with a name for each pair.  The side that is behind goes
    next, and of two that are even the one with the smaller frontier, so no side
    passes half the distance (rounded up).  A pair whose sides meet, or one of whose sides
    is exhausted, goes no further.  Nodes of the far half that lie on a
    shortest path are then found from the meeting points back to the end, with their smallest
    link, so the path is the same one that a search from the root finds.
    """
    node_type = members.schema["entity_id"].dataType
    asked = materialize(pairs.select("pair", "root", "node").distinct(), "pairs")

    def first_level(column: str) -> Written:
        seeds = asked.select(F.col("pair").alias("root"), F.col(column).cast(node_type).alias("node"))
        start = seeds.select("*", F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast(node_type).alias("parent"))
        return write_counted(start, "level")

    ahead, behind = [first_level("root")], [first_level("node")]
    met = [_met(ahead[0], behind[0], 0, 0)]
    waiting = write_counted(ahead[0].table.select("root").join(met[0].table, "root", "left_anti"), "waiting")
    while waiting.rows:
        even = len(ahead) == len(behind)
        forward = ahead[-1].rows <= behind[-1].rows if even else len(ahead) < len(behind)
        side, other = (ahead, behind) if forward else (behind, ahead)
        frontier = side[-1].table.join(waiting.table, "root", "left_semi")
        level = _next_level([*[x.table for x in side[-2:-1]], frontier], members, len(side))
        side.append(level)
        met.append(_met(level, other[-1], len(ahead) - 1, len(behind) - 1))
        still = level.table.select("root").distinct().join(met[-1].table, "root", "left_anti")
        waiting = write_counted(still, "waiting")

    points = materialize(union_all([m.table for m in met]), "meetings")
    totals = points.groupBy("root").agg(F.max(F.col("ahead") + F.col("behind")).cast("bigint").alias("total"))
    levels = [x.table.select(*LEVEL_COLUMNS) for x in ahead]
    known = None
    for back in range(len(behind) - 1, 0, -1):
        tips = points.filter(F.col("behind") == back).select("root", "node")
        tips = tips if known is None else tips.unionByName(known.select("root", "node"))
        near = _expand(tips, members).join(behind[back - 1].table.select("root", "node"), ["root", "node"], "left_semi")
        known = materialize(
            near.join(totals, "root").select("root", "node", (F.col("total") - (back - 1)).alias("dist"), "parent"), "way-back"
        )
        levels.append(known)
    hops = points.agg(F.coalesce(F.max(F.col("ahead") + F.col("behind")), F.lit(0)).alias("n")).first()["n"]
    return Meeting(Reached(union_all(levels), int(hops)), len(ahead) - 1, len(behind) - 1)


def beam(
    members: DataFrame, seeds: DataFrame, depth: int, width: int, capped: tuple[int, ...] = (1,)
) -> DataFrame:
    """``(root, node, dist)`` of a traversal that looks up few nodes of its wide levels.

    Looking a node up shows all groups it is in.  Of a ``capped`` level each
    root looks up the ``width`` nodes with the most neighbours in the groups
    it has seen (smallest id on ties), of other levels all; the last level is
    not looked up.  Distances are those in the seen groups.
    """
    entity = members.withColumnRenamed("entity_id", "node")
    known = materialize(seeds.select("root", "node").distinct(), "beam-known")
    chosen = known
    seen = materialize(chosen.join(entity, "node").select("root", "group_id").distinct(), "beam-seen")
    for level in range(1, depth):
        shown = seen.join(entity, "group_id")
        near = _rooted_neighbours(chosen, shown).join(known, ["root", "node"], "left_anti")
        found = materialize(near, "beam-found")
        known = materialize(known.unionByName(found), "beam-known")
        if level in capped:
            pairs = found.join(shown, ["root", "node"]).select("root", "node", "group_id").join(
                shown.withColumnRenamed("node", "other"), ["root", "group_id"]
            )
            counted = pairs.filter("other <> node").groupBy("root", "node").agg(F.count_distinct("other").alias("degree"))
            best = Window.partitionBy("root").orderBy(F.desc("degree"), "node")
            found = counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= width)
        chosen = materialize(found.select("root", "node"), "beam-chosen")
        more = chosen.join(entity, "node").select("root", "group_id")
        seen = materialize(seen.unionByName(more).distinct(), "beam-seen")
    shown = materialize(seen.join(entity, "group_id"), "beam-shown")
    levels = [materialize(seeds.select("root", "node").distinct(), "beam")]
    for _ in range(depth):
        visited = union_all(levels)
        levels.append(materialize(_rooted_neighbours(levels[-1], shown).join(visited, ["root", "node"], "left_anti"), "beam"))
    return union_all([t.select("root", "node", F.lit(i).cast("bigint").alias("dist")) for i, t in enumerate(levels)])


def _rooted_neighbours(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """Nodes that share one of their root's ``shown(root, group_id, node)`` groups."""
    groups = nodes.join(shown, ["root", "node"]).select("root", "group_id").distinct()
    return groups.join(shown, ["root", "group_id"]).select("root", "node").distinct()


def ball_edges(members: DataFrame, reached: DataFrame, depth: int, groups: DataFrame | None = None) -> DataFrame:
    """Edges a depth-bounded build stores: one endpoint was expanded.

    Two nodes on the outer ring may share a group, but neither was expanded,
    so their edge is not part of the ball.  ``groups`` are the ball's ``ball_groups``, if they were written.
    """
    if groups is None:
        expanded = reached.filter(F.col("dist") < depth).select(F.col("node").alias("entity_id"))
        groups = ball_groups(members, expanded)
    return groups.select("src", "dst").distinct()


def ball_groups(members: DataFrame, expanded: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Canonical (src, dst, group) rows with at least one expanded endpoint ``expanded(entity_id)``, once each."""
    return faced_once(members, expanded, carry).select(*canonical_pair("x", "y"), "group_id", *carry)


def induced_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges whose two endpoints were both reached."""
    nodes = reached.select("node").distinct()
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi"
    ).select("src", "dst")


def walk_back(requests: DataFrame, reached: Reached, keep: tuple[str, ...] = ()) -> DataFrame:
    """The path from each requested node to its root, as an id array.

    ``requests(root, node, *keep)``.  Requests that were not reached are
    absent.  Paths grow level by level, the outermost first: at distance d the
    requested nodes of d join the paths that came from d + 1, and their parents
    are looked up among the nodes of d alone.  A finished path is not touched again.
    """
    carried = [*keep, "root", "node"]
    asked = materialize(
        requests.select(*carried).join(reached.table.select("root", "node", "dist"), ["root", "node"]), "asked-paths"
    )
    begun = asked.select("*", F.array("node").alias("path"), F.col("node").alias("tip"))
    columns = [*carried, "path", "tip"]
    open_paths = None
    for hop, dist in enumerate(range(reached.hops, 0, -1)):
        here = begun.filter(F.col("dist") == dist).select(*columns)
        open_paths = here if open_paths is None else open_paths.unionByName(here)
        if hop and hop % HOPS_PER_PLAN == 0:
            open_paths = materialize(open_paths, "paths")
        level = reached.table.filter(F.col("dist") == dist).select("root", F.col("node").alias("tip"), "parent")
        open_paths = open_paths.join(level, ["root", "tip"]).select(
            *carried, F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("tip")
        )
    roots = begun.filter("dist = 0").select(*columns)
    finished = roots if open_paths is None else open_paths.unionByName(roots)
    return finished.drop("tip")
