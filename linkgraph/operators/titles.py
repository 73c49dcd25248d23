"""Connecting titles of groups and edges."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column
from linkgraph.functions.text import base_title, is_variant_title
from linkgraph.operators.projection import pair_groups, shared_groups
from linkgraph.session import materialize

# ``(group_id, title)`` rows, or a function that makes those of the groups in a table ``(group_id)`` by ``dedup_titles``.
GroupTitles = DataFrame | Callable[[DataFrame], DataFrame]

# Fixed value: versions kept per key.
KEPT_TITLES = 5


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], k: int) -> DataFrame:
    """The first ``k`` rows per key with their ``rank``.

    Spark prunes each partition to ``k`` rows per key before the shuffle
    (window group limit), so a hot key costs no more than a cold one.
    """
    window = Window.partitionBy(*keys).orderBy(*[as_column(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def bounded_titles(items: DataFrame, key: str, order: Sequence[ColumnLike], cap: int) -> DataFrame:
    """The first ``cap`` raw titles of each key in item order."""
    return first_rows(items, [key], order, cap).select(key, "title", "rank")


def title_forms(rows: DataFrame, keys: Sequence[str], unicode_fallback: bool = False) -> DataFrame:
    """``(keys, base, form)``: the base title, and the title with what it is ranked by.

    Cleanest first: not a version, then shortest, then alphabetical.
    """
    return rows.filter(F.col("title") != "").select(
        *keys,
        base_title("title", unicode_fallback).alias("base"),
        F.struct(
            is_variant_title("title").alias("variant"),
            F.length("title").alias("chars"),
            F.col("title"),
        ).alias("form"),
    )


def best_titles(forms: DataFrame, keys: Sequence[str], cap: int = KEPT_TITLES) -> DataFrame:
    """One title per base title of ``forms``, cleanest form first, at most ``cap`` per key."""
    return ranked_titles(best_forms(forms, keys), keys, cap)


def best_forms(forms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, form)``: the cleanest form of each base title."""
    return forms.groupBy(*keys, "base").agg(F.min("form").alias("form")).select(*keys, "form")


def ranked_titles(best: DataFrame, keys: Sequence[str], cap: int = KEPT_TITLES) -> DataFrame:
    """The first ``cap`` titles per key of ``best_forms`` with their rank."""
    ranked = first_rows(best, keys, ["form"], cap)
    return ranked.select(*keys, F.col("form.title").alias("title"), "rank")


def dedup_titles(
    rows: DataFrame, keys: Sequence[str], cap: int = KEPT_TITLES, unicode_fallback: bool = False
) -> DataFrame:
    """One title per base title, cleanest form first, at most ``cap`` per key."""
    return best_titles(title_forms(rows, keys, unicode_fallback), keys, cap)


def with_forms(members: DataFrame, group_titles: DataFrame) -> DataFrame:
    """``members`` of titled groups with the forms of their group's kept titles, few a group, as ``forms``."""
    listed = title_forms(group_titles, ["group_id"]).groupBy("group_id").agg(
        F.collect_list(F.struct("base", "form")).alias("forms")
    )
    return members.join(listed, "group_id")


def group_title_pairs(members: DataFrame, group_titles: DataFrame) -> DataFrame:
    """``(src, dst, group_id, base, form)`` of all pairs: titles ride along with their group when it is paired."""
    return pair_groups(with_forms(members, group_titles), ("forms",)).select("src", "dst", "group_id", F.inline("forms"))


def shared_titles(pairs: DataFrame, members: DataFrame, group_titles: GroupTitles) -> tuple[DataFrame, DataFrame]:
    """``(src, dst, group_id)`` of the given pairs, and the titles of groups.

    A function as ``group_titles`` is asked for the titles of the shared groups alone.
    """
    shared = shared_groups(pairs, members)
    if not callable(group_titles):
        return shared, group_titles
    shared = materialize(shared, "shared-groups")
    return shared, group_titles(shared.select("group_id").distinct())


def pair_titles(pairs: DataFrame, members: DataFrame, group_titles: GroupTitles) -> DataFrame:
    """Titles of the given ``(src, dst)`` pairs with the groups they come from."""
    shared, titles = shared_titles(pairs, members, group_titles)
    return shared.join(titles.select("group_id", "title"), "group_id")


def title_references(titled: DataFrame, kept: DataFrame) -> DataFrame:
    """``(src, dst, title, group_id)``: each kept title of an edge and the groups behind it.

    This and the groups' members are the line-ups in factorised form; its size
    is that of the pairs, not of pairs times members.
    """
    return titled.select("src", "dst", F.col("form.title").alias("title"), "group_id").join(
        kept.select("src", "dst", "title"), ["src", "dst", "title"], "left_semi"
    )


def _by_shared_groups(pairs: DataFrame, group_titles: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Titles of pairs that share one group, ``(keys, title, rank, group_id)``, and forms of those that share several.

    A group's kept titles are told apart and ranked already, so a pair of one
    group has them as they are.  Pairs move as numbers; texts join by group.
    """
    counted = pairs.select(*keys, "group_id").withColumn(
        "groups", F.count(F.lit(1)).over(Window.partitionBy("src", "dst"))
    )
    alone = counted.filter("groups = 1").join(group_titles.select("group_id", "title", "rank"), "group_id")
    several = counted.filter("groups > 1").join(title_forms(group_titles, ["group_id"]), "group_id")
    return alone.select(*keys, "title", "rank", "group_id"), several.select(*keys, "group_id", "base", "form")


def edge_titles(
    pairs: DataFrame, group_titles: DataFrame, cap: int = KEPT_TITLES, along: Sequence[str] = ()
) -> DataFrame:
    """The titles kept for each pair of ``pairs(src, dst, group_id, along)``, where ``along`` is the same in a pair's rows.

    ``group_titles(group_id, title, rank)`` comes from ``dedup_titles``.
    """
    keys = ["src", "dst", *along]
    alone, several = _by_shared_groups(pairs, group_titles, keys)
    return alone.filter(F.col("rank") <= cap).drop("group_id").unionByName(best_titles(several, keys, cap))


class References(NamedTuple):
    """Titles of edges by the groups behind them, pairs and texts apart.

    A pair of ``alone(src, dst, group_id)`` shares that group only, and has its
    ``titles(group_id, title, rank)`` as they are; the titles of other pairs are
    ``several(src, dst, title, rank, group_id, groups)``, a row for each of the ``groups`` behind one.
    """

    alone: DataFrame
    titles: DataFrame
    several: DataFrame


def references_apart(pairs: DataFrame, group_titles: DataFrame) -> References:
    """The rows of ``edge_references``, but pairs of one group have not met its titles yet; pairs move by edge once."""
    keys = ["src", "dst"]
    counted = pairs.select(*keys, "group_id").withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    counted = materialize(counted, "counted-pairs")
    several = counted.filter("groups > 1").join(title_forms(group_titles, ["group_id"]), "group_id")
    alone = counted.filter("groups = 1").select(*keys, "group_id")
    return References(alone, group_titles.select("group_id", "title", "rank"), _references_of_several(several))


def _references_of_several(forms: DataFrame) -> DataFrame:
    """``(src, dst, title, rank, group_id, groups)`` of pairs whose ``forms`` come from several groups."""
    keys = ["src", "dst"]
    forms = materialize(forms, "shared-forms")
    kept = materialize(best_titles(forms, keys), "shared-titles")
    again = title_references(forms, kept).join(kept, [*keys, "title"])
    behind = F.count(F.lit(1)).over(Window.partitionBy(*keys, "title"))
    return again.withColumn("groups", behind).select(*keys, "title", "rank", "group_id", "groups")


def edge_references(pairs: DataFrame, group_titles: DataFrame) -> DataFrame:
    """``(src, dst, title, rank, group_id, groups)``: the titles of ``edge_titles``, and the ``groups`` behind each, a row for every one."""
    alone, several = _by_shared_groups(pairs, group_titles, ["src", "dst"])
    return alone.withColumn("groups", F.lit(1).cast("bigint")).unionByName(_references_of_several(several))


def reference_lists(apart: References) -> DataFrame:
    """``(src, dst, title, rank, group_id)``: the lists of titles that edges have, each once.

    All pairs that share one group alone have that group's list. It stands under the group's
    id as both ends, which no edge has; edges of several groups have lists of their own.
    """
    columns = ["src", "dst", "title", "rank", "group_id"]
    group = F.col("group_id")
    of_groups = apart.titles.withColumns({"src": group, "dst": group}).select(*columns)
    return of_groups.unionByName(apart.several.select(*columns))


def spread_lists(rows: DataFrame, apart: References) -> DataFrame:
    """What is known of ``reference_lists``, ``rows(src, dst, ...)``, by edge: pairs of one group take on its list's rows."""
    own = rows.filter("src <> dst")
    of_groups = rows.filter("src = dst").withColumnRenamed("src", "group_id").drop("dst")
    return apart.alone.join(of_groups, "group_id").select(*rows.columns).unionByName(own)


def referenced_titles(references: DataFrame) -> DataFrame:
    """``(src, dst, title, rank)`` of ``edge_references``, each title once."""
    columns = ["src", "dst", "title", "rank"]
    alone = references.filter("groups = 1").select(*columns)
    return alone.unionByName(references.filter("groups > 1").select(*columns).distinct())


def title_lineup(references: DataFrame | References, credits: DataFrame) -> DataFrame:
    """Everyone credited on any group behind an edge's title, one row each, for the edges in ``references``.

    ``references(src, dst, title, group_id)``, ``credits(group_id, entity_id, ...)``.
    The line-up stays in rows, because the size of a group has no bound.  A title
    from one group needs no de-duplication, so only the others are shuffled by member.
    References that know their ``groups`` are not counted again; of ``References``
    pairs of one group meet its titles and its credits at once.
    """
    titles = ["src", "dst", "title"]
    if isinstance(references, References):
        names = [c for c in credits.columns if c != "group_id"]
        shown = references.alone.join(references.titles, "group_id").join(credits, "group_id").select(*titles, *names)
        return shown.unionByName(title_lineup(references.several, credits))
    if "groups" in references.columns:
        alone, several = references.filter("groups = 1"), references.filter("groups > 1")
    else:
        counted = references.groupBy(*titles).agg(F.count(F.lit(1)).alias("groups"), F.min("group_id").alias("group_id"))
        alone = counted.filter("groups = 1")
        several = references.join(counted.filter("groups > 1").select(*titles), titles, "left_semi")
    names = [c for c in credits.columns if c != "group_id"]

    def expanded(refs: DataFrame) -> DataFrame:
        return refs.join(credits, "group_id").select(*titles, *names)

    return expanded(alone).unionByName(expanded(several).distinct())


def topk_with_overflow(rows: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], k: int) -> DataFrame:
    """The first ``k`` rows per key and how many more the key has."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return (
        first_rows(rows, keys, order, k)
        .join(totals, list(keys))
        .withColumn("more", F.greatest(F.col("total") - k, F.lit(0)))
        .drop("total")
    )


def overflow(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows per key beyond the first ``k``."""
    return rows.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("more"))


def other_members(lineup: DataFrame, keys: Sequence[str], endpoints: Sequence[str], shown: int = 6) -> DataFrame:
    """Credited names besides the hop's endpoints: the first few, and whether
    there are more.

    ``lineup`` holds one row per name.  Only ``shown + 1`` rows per key reach
    the list.
    """
    others = lineup.filter(~F.lower("name").isin(*[F.lower(F.col(c)) for c in endpoints]))
    return (
        first_rows(others, keys, ["name", "entity_id"], shown + 1)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("listed"))
        .select(
            *keys,
            F.slice("listed.name", 1, shown).alias("others"),
            (F.size("listed") > shown).alias("truncated"),
        )
    )
