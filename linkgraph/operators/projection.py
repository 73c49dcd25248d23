"""From group membership to an undirected graph.

``members(group_id, entity_id)`` *is* the graph in factorised form: a group of
n members stands for n(n-1)/2 edges.  Traversal, degrees, neighbours of given
nodes and edge titles are all computed on it directly.  The explicit edge
table is quadratic in the size of a group by definition, so only operators
whose result it is build it, in bounded blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column
from linkgraph.session import Written, materialize, write_counted

# Members of one block; a task compares at most this many squared per key.
BLOCK_MEMBERS = 512

# Groups beyond this size are counted by set arithmetic, not pair by pair.
HEAVY_GROUP = 4096


def canonical_pair(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    """The two ids in stored order: smaller first."""
    return (
        F.least(as_column(a), as_column(b)).alias("src"),
        F.greatest(as_column(a), as_column(b)).alias("dst"),
    )


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members of groups of two or more, with the hash block they fall into (``own``) of ``last + 1``."""
    sized = members.join(group_sizes(members).filter("members >= 2"), "group_id")
    last = (F.ceil(F.col("members") / block) - 1).cast("int")
    own = F.pmod(F.xxhash64("entity_id"), (last + 1).cast("bigint")).cast("int")
    return sized.withColumn("last", last).withColumn("own", own)


def pair_groups(members: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK_MEMBERS) -> DataFrame:
    """Every pair of members of each group: ``(src, dst, group_id)``, once a group, with the group's ``carry`` columns.

    A large group is cut into blocks by hash and each pair of blocks becomes
    its own join key, so no task ever holds a whole group.
    """
    placed = _in_blocks(members, block)
    left = placed.select(
        "group_id", *carry,
        F.col("entity_id").alias("x"),
        F.col("own").alias("lo"),
        F.explode(F.sequence(F.col("own"), F.col("last"))).alias("hi"),
    )
    right = placed.select(
        "group_id",
        F.col("entity_id").alias("y"),
        F.explode(F.sequence(F.lit(0), F.col("own"))).alias("lo"),
        F.col("own").alias("hi"),
    )
    pairs = left.join(right, ["group_id", "lo", "hi"]).filter(
        (F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y"))
    )
    return pairs.select(*canonical_pair("x", "y"), "group_id", *carry)


def co_members(members: DataFrame, block: int = BLOCK_MEMBERS) -> DataFrame:
    """The edge table: every pair of entities that share a group, once."""
    return pair_groups(members, block=block).select("src", "dst").distinct()


def faced_groups(
    members: DataFrame, chosen: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK_MEMBERS
) -> DataFrame:
    """Directed ``(x, y, group_id)`` rows of the given nodes ``chosen(entity_id)`` and all they share a group with.

    Costs the chosen members times the size of their groups, not all pairs of
    a group.  Both sides lie in blocks, so no task holds a whole group.
    """
    placed = _in_blocks(members, block)
    x = placed.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi")
    return _facing(x, placed, carry).select("x", "y", "group_id", *carry)


def faced_once(
    members: DataFrame, chosen: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK_MEMBERS
) -> DataFrame:
    """The rows of ``faced_groups``, but only ``x < y`` of two chosen nodes.

    Members know whether they are chosen before they are paired, so no pair is looked up.
    """
    flags = chosen.select("entity_id", F.lit(True).alias("chosen")).distinct()
    placed = _in_blocks(members, block).join(flags, "entity_id", "left")
    pairs = _facing(placed.filter("chosen"), placed, carry, along=("chosen",))
    return pairs.filter("chosen IS NULL OR x < y").select("x", "y", "group_id", *carry)


def _facing(x: DataFrame, y: DataFrame, carry: tuple[str, ...], along: tuple[str, ...] = ()) -> DataFrame:
    """Members ``x`` with all others ``y`` of their groups, which bring ``along`` columns of their own."""
    every = F.explode(F.sequence(F.lit(0), F.col("last")))
    left = x.select("group_id", *carry, F.col("entity_id").alias("x"), F.col("own").alias("lo"), every.alias("hi"))
    right = y.select("group_id", F.col("entity_id").alias("y"), *along, every.alias("lo"), F.col("own").alias("hi"))
    return left.join(right, ["group_id", "lo", "hi"]).filter("x <> y")


def star_edges(members: DataFrame, centers: DataFrame) -> DataFrame:
    """Directed (center, neighbor) pairs of the given nodes ``centers(entity_id)`` only."""
    return faced_groups(members, centers).select(F.col("x").alias("center"), F.col("y").alias("neighbor")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of an edge table, so lookups are plain equi-joins."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def edge_nodes(edges: DataFrame) -> DataFrame:
    """All ids that occur as an endpoint."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Edges per node, counted over both endpoint columns."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _pairs_of_light(members: DataFrame, heavy_ids: Written) -> DataFrame:
    """Each pair ``x < y`` that shares one of the other groups, once."""
    light = members.join(heavy_ids.table, "group_id", "left_anti") if heavy_ids.rows else members
    x = light.select("group_id", F.col("entity_id").alias("x"))
    y = light.select("group_id", F.col("entity_id").alias("y"))
    return x.join(y, "group_id").filter("x < y").select("x", "y").distinct()


def degrees(members: DataFrame, heavy: int = HEAVY_GROUP) -> DataFrame:
    """Distinct neighbours per entity, without the pairs of heavy groups.

    ``members`` is scanned several times, so pass a written table.  Groups up to
    ``heavy`` members are paired, a pair moves once for its two ends.  The members of larger groups
    are numbered, each such group is a set of bitmaps over ranges of numbers,
    and a member's neighbours are the union of its groups' bitmaps and of the
    bits of its light neighbours: work follows memberships times ranges, however
    the groups overlap.  Neighbours outside all heavy groups are counted plainly.
    """
    sizes = group_sizes(members).filter(F.col("members") > max(heavy, 1))
    heavy_ids = write_counted(sizes.select("group_id"), "heavy-groups")
    pairs = _pairs_of_light(members, heavy_ids)
    if not heavy_ids.rows:
        ends = pairs.select(F.explode(F.array("x", "y")).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    in_heavy = members.join(heavy_ids.table, "group_id", "left_semi")

    numbers = materialize(
        in_heavy.select("entity_id").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers"
    )
    numbered = numbers.select(
        "entity_id", F.bitmap_bucket_number("number").alias("range"), F.bitmap_bit_position("number").alias("bit")
    )
    group_bits = in_heavy.join(numbered, "entity_id").groupBy("group_id", "range").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    by_group = in_heavy.select("group_id", "entity_id").join(group_bits, "group_id").select("entity_id", "range", "bits")

    def place(end: str) -> DataFrame:
        return numbered.select(F.col("entity_id").alias(end), F.struct("range", "bit").alias(f"{end}_at"))

    placed = pairs.join(place("x"), "x", "left").join(place("y"), "y", "left")
    both_inside = F.col("x_at").isNotNull() & F.col("y_at").isNotNull()

    def seen(end: str, other: str) -> Column:
        return F.struct(F.col(end).alias("entity_id"), F.col(f"{other}_at.range"), F.col(f"{other}_at.bit"))

    faced = placed.filter(both_inside).select(F.inline(F.array(seen("x", "y"), seen("y", "x"))))
    by_pair = faced.groupBy("entity_id", "range").agg(F.bitmap_construct_agg("bit").alias("bits"))
    united = by_group.unionByName(by_pair).groupBy("entity_id", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    # The entity itself is in its groups' bitmaps.
    inside = united.groupBy("entity_id").agg((F.sum(F.bitmap_count("bits")) - 1).alias("n"))
    ends = placed.filter(~both_inside).select(F.explode(F.array("x", "y")).alias("entity_id"))
    outside = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(outside).groupBy(F.col("entity_id").alias("id")).agg(
        F.sum("n").cast("bigint").alias("degree")
    )


def refresh_degrees(nodes: DataFrame, counted: DataFrame) -> DataFrame:
    """Nodes with a fresh degree; those without edges get zero."""
    return nodes.drop("degree").join(counted, "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
    )


def adjacency(edges: DataFrame, chunk: ColumnLike) -> DataFrame:
    """Neighbour lists, split by ``chunk`` so that no row grows without bound.

    ``chunk`` is an expression over ``dst`` that maps few ids to each chunk,
    for example ``id >> 10`` for at most 1024 neighbours per row.
    """
    return (
        symmetric(edges)
        .groupBy("src", as_column(chunk).alias("chunk"))
        .agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    )


def shared_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The groups both nodes of each ``(src, dst)`` pair belong to.

    Each pair is looked up from the endpoint with fewer memberships, so the
    edges of a hub cost their other ends' memberships, not the hub's.
    """
    counts = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = (
        pairs.select("src", "dst")
        .distinct()
        .join(counts.select(F.col("entity_id").alias("src"), F.col("n").alias("src_n")), "src")
        .join(counts.select(F.col("entity_id").alias("dst"), F.col("n").alias("dst_n")), "dst")
    )
    rarer_first = F.col("src_n") <= F.col("dst_n")
    sided = wanted.select(
        "src",
        "dst",
        F.when(rarer_first, F.col("src")).otherwise(F.col("dst")).alias("rarer"),
        F.when(rarer_first, F.col("dst")).otherwise(F.col("src")).alias("other"),
    )
    of_rarer = members.select("group_id", F.col("entity_id").alias("rarer"))
    of_other = members.select("group_id", F.col("entity_id").alias("other"))
    return sided.join(of_rarer, "rarer").join(of_other, ["group_id", "other"]).select("src", "dst", "group_id")
