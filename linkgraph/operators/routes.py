"""Whole connections of typed names: the names, titles and line-ups of every hop.

Everything is keyed by node or edge, however many names resolve to the node and
however many routes use the edge; names meet their routes in the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.paths import path_hops, with_name
from linkgraph.operators.titles import GroupTitles, dedup_titles, pair_titles, title_lineup
from linkgraph.operators.traversal import Reached, walk_back
from linkgraph.session import materialize

# Fixed value: titles shown per hop.
SHOWN_TITLES = 3
_TITLE = ["src", "dst", "title"]


def route_hops(asked: DataFrame, reached: Reached, entities: DataFrame) -> DataFrame:
    """The hops from each node to its root, with both names.

    ``asked(root, id)``.  A node that is its root or is not reached has no hops.
    """
    requests = asked.select("root", F.col("id").alias("node")).filter("node IS NOT NULL").distinct()
    hops = path_hops(walk_back(requests, reached), ["root", "node"])
    return with_name(with_name(hops, entities, "from_id", "from_name"), entities, "to_id", "to_name")


def shown_songs(
    hops: DataFrame, members: DataFrame, group_titles: GroupTitles, shown: int = SHOWN_TITLES
) -> tuple[DataFrame, DataFrame]:
    """The first titles of the edges in ``hops``, and the groups behind them.

    ``(src, dst, title, rank, song_id)``, where the song is the smallest group
    that has the title, and ``(src, dst, title, group_id)``.
    """
    titled = materialize(pair_titles(hops.select("src", "dst").distinct(), members, group_titles), "route-titles")
    kept = dedup_titles(titled, ["src", "dst"]).filter(F.col("rank") <= shown)
    references = materialize(titled.join(kept, _TITLE).select(*_TITLE, "rank", "group_id").distinct(), "route-songs")
    songs = references.groupBy(*_TITLE, "rank").agg(F.min("group_id").alias("song_id"))
    return songs, references.drop("rank")


def lineup_or_ends(references: DataFrame, credits: DataFrame, entities: DataFrame) -> DataFrame:
    """Everyone credited on a title, one row each; the edge's two ends where nobody is.

    ``references(src, dst, title, group_id)``, ``credits(group_id, entity_id, name)``.
    """
    credited = references.join(credits.select("group_id").distinct(), "group_id", "left_semi")
    bare = references.select(*_TITLE).distinct().join(credited.select(*_TITLE).distinct(), _TITLE, "left_anti")
    ends = bare.select(*_TITLE, F.explode(F.array("src", "dst")).alias("entity_id"))
    return title_lineup(credited, credits).unionByName(with_name(ends, entities, "entity_id", "name"))


def named_routes(found: DataFrame, hops: DataFrame, songs: DataFrame, lineup: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per name, hop, shown title and credited name.

    ``found(query, root, id, ...)``; ``tracks(song_id, track_id)`` has the known
    ones.  A name without hops keeps one row, whose other columns are null.
    """
    told = songs.join(tracks.select("song_id", "track_id"), "song_id", "left").join(
        lineup.select(*_TITLE, "entity_id", "name"), _TITLE, "left"
    )
    whole = hops.join(told, ["src", "dst"], "left").withColumnRenamed("node", "id").drop("src", "dst")
    return found.join(whole, ["root", "id"], "left")


def distinct_lineups(lineup: DataFrame) -> DataFrame:
    """``(title_key, name)`` of each title and set of names once, letter case aside, with ``src`` and ``dst`` of one edge that has it.

    Sets are told apart by their size and two 64-bit sums of hashes, so no
    line-up is gathered in one row.
    """
    names = materialize(
        lineup.select(*_TITLE, F.lower("title").alias("title_key"), F.lower("name").alias("name")).distinct(), "line-ups"
    )
    sets = names.groupBy(*_TITLE, "title_key").agg(
        F.count(F.lit(1)).alias("_size"),
        F.bit_xor(F.xxhash64("name")).alias("_one"),
        F.bit_xor(F.xxhash64("name", F.lit(1))).alias("_two"),
    )
    first = sets.groupBy("title_key", "_size", "_one", "_two").agg(F.min(F.struct(*_TITLE)).alias("edge"))
    return first.select("edge.*").join(names, _TITLE).select("title_key", "src", "dst", "name")
