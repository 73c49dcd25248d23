"""Whole connections of names: songs, line-ups and the line-up that is the edge's ends."""

from linkgraph.operators import routes as rt
from linkgraph.operators import traversal as tr

MEMBERS = [(1, 10), (1, 20), (1, 21), (2, 20), (2, 30), (3, 20), (3, 30), (3, 40), (4, 60), (4, 61)]


def routes(spark, recorded):
    members = spark.createDataFrame(MEMBERS, "group_id long, entity_id long")
    entities = spark.createDataFrame([(i, f"N{i}") for i in (10, 20, 21, 30, 40, 60)], "id long, name string")
    titles = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "beta (Live)"), (3, "Gamma"), (4, "x")], "group_id long, title string")
    reached = tr.distances(members, spark.createDataFrame([(10, 10)], "root long, node long"))
    found = spark.createDataFrame(
        [("a", 10, 30), ("b", 10, 30), ("c", 10, 10), ("d", 10, 60), ("e", 10, None)], "query string, root long, id long"
    )
    hops = rt.route_hops(found, reached, entities)
    songs, references = rt.shown_songs(hops, members, titles)
    names = entities.selectExpr("id AS entity_id", "name")
    credits = members.join(names, "entity_id").filter(members.group_id.isin(*recorded)).select("group_id", "entity_id", "name")
    lineup = rt.lineup_or_ends(references, credits, entities)
    tracks = spark.createDataFrame([(1, "t1")], "song_id long, track_id string")
    return rt.named_routes(found, hops, songs, lineup, tracks), lineup


def test_routes_are_whole(spark):
    whole, _ = routes(spark, (1, 2, 3))
    got = {(r["query"], r["hop"], r["from_name"], r["to_name"], r["title"], r["song_id"], r["track_id"], r["name"]) for r in whole.collect()}
    hops = {(0, "N30", "N20", "Beta", 2, None, n) for n in ("N20", "N30")}
    hops |= {(0, "N30", "N20", "Gamma", 3, None, n) for n in ("N20", "N30", "N40")}
    hops |= {(1, "N20", "N10", "Alpha", 1, "t1", n) for n in ("N10", "N20", "N21")}
    none = {(q, *[None] * 7) for q in "cde"}
    assert got == {(q, *h) for q in "ab" for h in hops} | none


def test_line_up_falls_back_to_the_ends(spark):
    _, lineup = routes(spark, (2,))
    got = {(r["src"], r["dst"], r["title"], r["name"]) for r in lineup.collect()}
    assert got == {
        (20, 30, "Beta", "N20"), (20, 30, "Beta", "N30"), (20, 30, "Gamma", "N20"), (20, 30, "Gamma", "N30"),
        (10, 20, "Alpha", "N10"), (10, 20, "Alpha", "N20"),
    }


def test_line_ups_are_shown_once(spark):
    rows = [(1, 2, "Song", 1, "A"), (1, 2, "Song", 2, "b"), (1, 2, "Song", 3, "B"), (3, 4, "song", 5, "a"), (3, 4, "song", 6, "B"),
            (3, 4, "Other", 5, "a"), (5, 6, "SONG", 7, "a")]
    lineup = spark.createDataFrame(rows, "src long, dst long, title string, entity_id long, name string")
    got = sorted(tuple(r) for r in rt.distinct_lineups(lineup).collect())
    assert got == [("other", 3, 4, "a"), ("song", 1, 2, "a"), ("song", 1, 2, "b"), ("song", 5, 6, "a")]
    assert rt.distinct_lineups(lineup.where("false")).count() == 0
