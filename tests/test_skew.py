"""One group, node or key that holds a large share of all rows."""

from pyspark.sql import functions as F

from linkgraph.operators import incremental as inc
from linkgraph.operators import projection as pr
from linkgraph.operators import titles as ti
from linkgraph.operators import traversal as tr
from linkgraph.session import materialize

HOT = 20_000


def hot_members(spark):
    """Group 0 has 20,000 members; 20,000 chains of two hang off them."""
    hot = spark.range(HOT).select(F.lit(0).cast("bigint").alias("group_id"), F.col("id").alias("entity_id"))
    tails = spark.range(2 * HOT).select(
        (F.floor(F.col("id") / 2) + 1).alias("group_id"),
        F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 2)).otherwise(F.floor(F.col("id") / 2) + HOT).alias("entity_id"),
    )
    return materialize(hot.unionByName(tails), "hot")


def test_hot_group_costs_its_members_not_its_pairs(spark):
    members = hot_members(spark)
    got = {r["degree"]: r["n"] for r in pr.degrees(members).groupBy("degree").agg(F.count("*").alias("n")).collect()}
    assert got == {HOT: HOT, 1: HOT}

    seed = spark.createDataFrame([(HOT, HOT)], "root long, node long")
    reached = tr.distances(members, seed)
    assert [tuple(r) for r in reached.table.groupBy("dist").count().orderBy("dist").collect()] == [
        (0, 1), (1, 1), (2, HOT - 1), (3, HOT - 1),
    ]
    requests = reached.table.select("root", "node")
    lengths = tr.walk_back(requests, reached).groupBy(F.size("path").alias("n")).count().orderBy("n").collect()
    assert [tuple(r) for r in lengths] == [(1, 1), (2, 1), (3, HOT - 1), (4, HOT - 1)]


def test_blocks_cover_every_pair_of_a_large_group_once(spark):
    members = spark.range(1500).select(F.lit(1).alias("group_id"), F.col("id").alias("entity_id"))
    pairs = pr.co_members(members, block=100)
    row = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("src") < F.col("dst")).alias("ordered")).first()
    assert tuple(row) == (1500 * 1499 // 2, 1500 * 1499 // 2)


def test_hub_edges_are_looked_up_from_the_other_end(spark):
    hub = spark.range(3000).select(F.col("id").alias("group_id"), F.lit(-1).cast("bigint").alias("entity_id"))
    others = spark.range(3000).select(F.col("id").alias("group_id"), F.col("id").alias("entity_id"))
    members = materialize(hub.unionByName(others), "hub")
    pairs = others.select(F.lit(-1).cast("bigint").alias("src"), F.col("entity_id").alias("dst"))
    found = pr.shared_groups(pairs, members)
    assert found.filter("group_id = dst AND src = -1").count() == found.count() == 3000


def test_rate_of_a_hot_key_in_slots(spark):
    events = spark.range(50_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") / 2).alias("at"))
    got = inc.trailing_rate(events, "k", "at", seconds=30, limit=60).groupBy("recent", "exceeds").count()
    counts = {r["recent"]: (r["exceeds"], r["count"]) for r in got.collect()}
    # Two events per second: 61 lie in a closed window of 30 seconds.
    assert counts[61] == (True, 50_000 - 60)
    assert all(counts[n] == (False, 1) for n in range(1, 61))


def test_degrees_of_many_overlapping_heavy_groups(spark):
    # 50 groups of 5,000 out of 12,000 entities, and light groups across them.
    heavy = spark.range(50 * 5000).selectExpr(
        "CAST(id DIV 5000 AS BIGINT) AS group_id", "((id DIV 5000) * 137 + (id % 5000)) % 12000 AS entity_id"
    )
    light = spark.range(3000).selectExpr("1000 + id AS group_id", "explode(array(id * 5 % 15000, id * 11 % 15000)) AS entity_id")
    members = materialize(heavy.unionByName(light).distinct(), "overlapping")
    got = {r["id"]: r["degree"] for r in pr.degrees(members).collect()}
    groups, of = {}, {}
    for r in members.collect():
        groups.setdefault(r["group_id"], set()).add(r["entity_id"])
        of.setdefault(r["entity_id"], []).append(r["group_id"])
    for entity in list(of)[::97]:
        near = set().union(*(groups[g] for g in of[entity])) - {entity}
        assert got.get(entity, 0) == len(near)


def test_lineups_of_a_large_group_stay_by_reference(spark):
    # one group of 2,000 and many small ones that overlap it
    big = spark.range(2000).select(F.lit(-1).cast("bigint").alias("group_id"), F.col("id").alias("entity_id"))
    small = spark.range(300).selectExpr("id AS group_id", "explode(array(id, id + 1)) AS entity_id")
    members = materialize(big.unionByName(small), "big")
    titles = members.select("group_id").distinct().select(
        "group_id", F.when(F.col("group_id") < 0, "Everyone").otherwise(F.concat(F.lit("Duo "), F.col("group_id").cast("string"))).alias("title")
    )
    titled = materialize(ti.group_title_pairs(members, titles), "forms")
    kept = ti.best_titles(titled, ["src", "dst"])
    references = materialize(ti.title_references(titled, kept), "references")
    assert references.count() == 2000 * 1999 // 2 + 300  # pairs, not pairs times members
    asked = references.filter("src = 7 AND dst = 8")
    lineup = ti.title_lineup(asked, members)
    assert {r["title"]: r["count"] for r in lineup.groupBy("title").count().collect()} == {"Everyone": 2000, "Duo 7": 2}


def test_pairs_of_one_group_keep_its_titles_and_others_rank_anew(spark):
    members = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (4, 8), (4, 9), (5, 8)], "group_id long, entity_id long"
    )
    raw = spark.createDataFrame(
        [(1, "Bee - Live"), (1, "Aa"), (1, "Aa (Remix)"), (2, "Bee"), (2, "Aa (Remix)"), (3, "Zed"), (3, "Aa"), (4, ""), (5, "Solo")],
        "group_id long, title string",
    )
    titles = materialize(ti.dedup_titles(raw, ["group_id"]), "titles")
    pairs = pr.pair_groups(members)

    def got(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    assert got(ti.edge_titles(pairs, titles), "src", "dst", "title", "rank") == [
        (1, 2, "Aa", 1), (1, 2, "Bee", 2), (1, 2, "Zed", 3), (1, 3, "Aa", 1), (1, 3, "Bee - Live", 2), (2, 3, "Aa", 1), (2, 3, "Bee - Live", 2),
    ]
    titled = ti.group_title_pairs(members, titles)
    for cap in (1, 2, 5):
        plain = ti.best_titles(titled, ["src", "dst"], cap)
        assert got(ti.edge_titles(pairs, titles, cap), *plain.columns) == got(plain, *plain.columns)
    kept = ti.best_titles(titled, ["src", "dst"])
    references = materialize(ti.edge_references(pairs, titles), "references")
    plain = ti.title_references(titled, kept)
    assert got(references, *plain.columns) == got(plain, *plain.columns)
    assert got(ti.referenced_titles(references), *kept.columns) == got(kept, *kept.columns)
    assert {r["title"]: r["groups"] for r in references.filter("dst = 2").collect()} == {"Aa": 2, "Bee": 1, "Zed": 1}
    assert got(ti.title_lineup(references, members), "src", "dst", "title", "entity_id") == got(
        ti.title_lineup(plain, members), "src", "dst", "title", "entity_id"
    )


def test_lineups_of_pairs_and_titles_apart_agree(spark):
    members = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (4, 8), (4, 9), (5, 8)], "group_id long, entity_id long"
    )
    raw = spark.createDataFrame(
        [(1, "Bee - Live"), (1, "Aa"), (1, "Aa (Remix)"), (2, "Bee"), (2, "Aa (Remix)"), (3, "Zed"), (3, "Aa"), (4, ""), (5, "Solo")],
        "group_id long, title string",
    )
    titles = materialize(ti.dedup_titles(raw, ["group_id"]), "titles")
    pairs = pr.pair_groups(members)

    def got(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    references = materialize(ti.edge_references(pairs, titles), "references")
    apart = ti.references_apart(pairs, titles)
    # A pair of one group is kept as its ids alone, without a row for each of the group's titles.
    assert got(apart.alone, "src", "dst", "group_id") == [(1, 3, 1), (2, 3, 1), (8, 9, 4)]
    assert got(apart.several, *references.columns) == got(references.filter("src = 1 AND dst = 2"), *references.columns)
    shown = ["src", "dst", "title", "entity_id"]
    assert got(ti.title_lineup(apart, members), *shown) == got(ti.title_lineup(references, members), *shown)


def test_texts_stay_out_of_the_shuffle_of_pairs(spark):
    members = materialize(spark.range(4000).selectExpr("id DIV 20 AS group_id", "id % 1000 AS entity_id"), "members")
    titles = materialize(spark.range(200).selectExpr("id AS group_id", "repeat('x', 500) AS title", "1 AS rank"), "titles")
    # Every pair shares one group: only its ids are brought together, and the texts join by group.
    alone, _ = ti._by_shared_groups(pr.pair_groups(members), titles, ["src", "dst"])
    plan = alone._jdf.queryExecution().executedPlan().toString()
    by_pair = [line for line in plan.splitlines() if "hashpartitioning(src" in line]
    assert len(by_pair) == 1 and "title" not in plan.split(by_pair[0])[1].split("FileScan")[0]


def test_ball_of_a_large_group_in_blocks(spark):
    members = spark.range(1300).select(F.lit(1).alias("group_id"), F.col("id").alias("entity_id"))
    chosen = spark.createDataFrame([(0,), (5,), (1299,)], "entity_id long")
    faced = pr.faced_groups(members, chosen, block=100)
    assert faced.count() == faced.distinct().count() == 3 * 1299
    ball = tr.ball_groups(members, chosen)
    assert ball.count() == ball.distinct().count() == 3 * 1299 - 3 and ball.filter("src >= dst").count() == 0
