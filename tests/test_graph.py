"""Eligibility, projection, titles, traversal and the build on tiny graphs."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from linkgraph.operators import eligibility as el
from linkgraph.operators import paths as pa
from linkgraph.operators import projection as pr
from linkgraph.operators import titles as ti
from linkgraph.operators import traversal as tr
from linkgraph.plans.build import build_graph
from linkgraph.session import materialize
from linkgraph.sources import graph_store
from linkgraph.sources.tables import scan_ragged, scan_tsv


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_members(seed, groups=40, people=60, hot=25):
    """Small groups plus one that holds a third of all rows."""
    rng = random.Random(seed)
    out = {(0, p) for p in rng.sample(range(people), hot)}
    for g in range(1, groups):
        for p in rng.sample(range(people), rng.choice([1, 2, 2, 3])):
            out.add((g, p))
    return sorted(out)


def all_pairs(members):
    by_group = {}
    for g, p in members:
        by_group.setdefault(g, []).append(p)
    return {tuple(sorted(pair)) for ps in by_group.values() for pair in itertools.combinations(ps, 2)}


def bfs(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for other in near.get(at, ()):
            if other not in dist:
                dist[other] = dist[at] + 1
                queue.append(other)
    parents = {v: min(u for u in near[v] if dist.get(u) == d - 1) for v, d in dist.items() if d}
    return dist, parents


@pytest.fixture(scope="module", params=[1, 2])
def graph(request, spark):
    members = random_members(request.param)
    df = spark.createDataFrame(members, "group_id long, entity_id long")
    return members, all_pairs(members), materialize(df, "test-members")


@pytest.mark.parametrize("block", [3, 512])
def test_co_members_in_blocks(graph, block):
    _, edges, df = graph
    got = rows(pr.co_members(df, block=block))
    assert len(got) == len(set(got)) and set(got) == edges


@pytest.mark.parametrize("heavy", [1, 2, 10, 4096])
def test_degrees_with_and_without_heavy_groups(graph, heavy):
    _, edges, df = graph
    wanted = {}
    for a, b in edges:
        wanted[a] = wanted.get(a, 0) + 1
        wanted[b] = wanted.get(b, 0) + 1
    assert dict(rows(pr.degrees(df, heavy=heavy))) == wanted
    assert dict(rows(pr.edge_degrees(pr.co_members(df)))) == wanted


def test_star_edges_and_nodes(spark, graph):
    _, edges, df = graph
    centers = spark.createDataFrame([(1,), (5,), (999,)], "entity_id long")
    both = edges | {(b, a) for a, b in edges}
    assert set(rows(pr.star_edges(df, centers))) == {e for e in both if e[0] in (1, 5)}
    assert {r[0] for r in rows(pr.edge_nodes(pr.co_members(df)))} == {v for e in edges for v in e}


def test_distances_parents_and_paths(spark, graph):
    members, edges, df = graph
    hub = members[0][1]
    dist, parents = bfs(edges, hub)
    reached = tr.distances(df, spark.createDataFrame([(hub, hub)], "root long, node long"))
    got = {r["node"]: (r["dist"], r["parent"]) for r in reached.table.collect()}
    assert got == {v: (d, parents.get(v)) for v, d in dist.items()}
    assert reached.hops == max(dist.values())

    requests = spark.createDataFrame([(hub, v) for v in range(60)], "root long, node long")
    paths = {r["node"]: r["path"] for r in tr.walk_back(requests, reached).collect()}
    assert set(paths) == set(dist)
    for node, path in paths.items():
        assert path[0] == node and path[-1] == hub and len(path) - 1 == dist[node]
        assert all(tuple(sorted(hop)) in edges for hop in zip(path, path[1:]))


def test_distances_along_every_edge_differ_by_at_most_one(spark, graph):
    members, edges, df = graph
    hub = members[0][1]
    reached = tr.distances(df, spark.createDataFrame([(hub, hub)], "root long, node long")).table
    dist = {r["node"]: r["dist"] for r in reached.collect()}
    assert all((a in dist) == (b in dist) and abs(dist.get(a, 0) - dist.get(b, 0)) <= 1 for a, b in edges)


def test_ball_and_induced_edges(spark, graph):
    members, edges, df = graph
    hub = members[-1][1]
    dist, _ = bfs(edges, hub)
    for depth in (1, 2):
        reached = tr.distances(df, spark.createDataFrame([(hub, hub)], "root long, node long"), depth).table
        ball = {e for e in edges if min(dist.get(e[0], 99), dist.get(e[1], 99)) < depth}
        inside = {e for e in edges if max(dist.get(e[0], 99), dist.get(e[1], 99)) <= depth}
        assert set(rows(tr.ball_edges(df, reached, depth))) == ball
        assert set(rows(tr.induced_edges(pr.co_members(df), reached))) == inside


def test_many_roots_targets_and_resume(spark, graph):
    members, edges, df = graph
    pairs = [(a, b) for a, b in [(0, 7), (3, 9), (7, 0), (4, 4)]]
    wanted = spark.createDataFrame(pairs, "root long, node long")
    got = tr.distances(df, tr.seeds_of(wanted, "root"), targets=wanted).table
    found = {(r["root"], r["node"]): r["dist"] for r in got.collect()}
    for a, b in pairs:
        assert found.get((a, b)) == bfs(edges, a)[0].get(b)

    hub = members[0][1]
    seed = spark.createDataFrame([(hub, hub)], "root long, node long")
    whole = tr.distances(df, seed)
    stored = tr.distances(df, seed, max_depth=1)
    assert rows(tr.resume(df, stored.table).table) == rows(whole.table)


def test_long_chain_is_walked_in_several_plans(spark):
    df = spark.createDataFrame([(g, p) for g in range(20) for p in (g, g + 1)], "group_id long, entity_id long")
    reached = tr.distances(materialize(df, "chain"), spark.createDataFrame([(0, 0)], "root long, node long"))
    paths = tr.walk_back(spark.createDataFrame([(0, 20), (0, 3)], "root long, node long"), reached)
    assert {r["node"]: r["path"] for r in paths.collect()} == {20: list(range(20, -1, -1)), 3: [3, 2, 1, 0]}


def test_beam_expands_only_the_widest(spark):
    members = [(1, 0), (1, 1), (2, 0), (2, 2), (3, 1), (3, 3), (4, 1), (4, 4), (5, 2), (5, 5)]
    df = spark.createDataFrame(members, "group_id long, entity_id long")
    seed = spark.createDataFrame([(0, 0)], "root long, node long")
    got = tr.beam(df, seed, depth=2, width=1).select("node", "dist")
    assert rows(got) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_beam_gives_each_root_its_own_width(spark):
    # Two stars: 0 - {1, 2}, 10 - {11, 12}; behind 1, 2, 11 and 12 stands one more node each.
    members = [(g, n) for g, pair in enumerate([(0, 1), (0, 2), (1, 3), (2, 4), (10, 11), (10, 12), (11, 13), (12, 14)]) for n in pair]
    df = spark.createDataFrame(members, "group_id long, entity_id long")
    seed = spark.createDataFrame([(0, 0), (10, 10)], "root long, node long")
    got = tr.beam(df, seed, depth=2, width=1).select("root", "node", "dist")
    assert rows(got) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (0, 3, 2), (10, 10, 0), (10, 11, 1), (10, 12, 1), (10, 13, 2)]
    wide = tr.beam(df, seed, depth=2, width=1, capped=()).select("root", "node", "dist")
    assert {(0, 4, 2), (10, 14, 2)} <= set(rows(wide))


def test_resume_goes_on_from_each_roots_own_ring(spark):
    df = materialize(spark.createDataFrame([(g, p) for g in range(6) for p in (g, g + 1)], "group_id long, entity_id long"), "chain")
    seeds = spark.createDataFrame([(0, 0), (6, 6)], "root long, node long")
    whole = tr.distances(df, seeds)
    stored = whole.table.where("(root = 0 AND dist <= 1) OR (root = 6 AND dist <= 3)")
    assert rows(tr.resume(df, stored).table) == rows(whole.table)
    assert tr.resume(df, stored).hops == 6
    assert tr.resume(df, stored.where("false")).table.count() == 0


def test_finished_roots_stop(spark):
    df = materialize(spark.createDataFrame([(g, p) for g in range(6) for p in (g, g + 1)], "group_id long, entity_id long"), "chain")
    wanted = spark.createDataFrame([(0, 1), (6, 1)], "root long, node long")
    got = tr.distances(df, tr.seeds_of(wanted, "root"), targets=wanted).table
    assert max(r["dist"] for r in got.where("root = 0").collect()) == 1
    assert {r["node"]: r["path"] for r in tr.walk_back(wanted, tr.Reached(got, 5)).collect()}.keys() == {1}


def test_paths_next_to_a_hub_with_many_neighbours(spark):
    far = spark.range(1, 20_001).selectExpr("id AS group_id", "explode(array(0L, id)) AS entity_id")
    more = spark.range(20_001, 20_004).selectExpr("id AS group_id", "explode(array(1L, id)) AS entity_id")
    reached = tr.distances(materialize(far.unionByName(more), "hub"), spark.createDataFrame([(0, 0)], "root long, node long"))
    asked = spark.range(0, 20_004).selectExpr("0L AS root", "id AS node")
    lengths = tr.walk_back(asked, reached).selectExpr("size(path) AS n", "path[size(path) - 1] AS last").groupBy("n", "last").count()
    assert rows(lengths) == [(1, 0, 1), (2, 0, 20_000), (3, 0, 3)]


def test_titles_of_large_groups_are_all_seen(spark):
    titles = [(1, f"Song ({'x' * (80 - i)} remix)") for i in range(59)] + [(1, "Song")]
    got = ti.dedup_titles(spark.createDataFrame(titles, "group_id int, title string"), ["group_id"])
    assert rows(got.select("title")) == [("Song",)]


def test_multi_member_needs_two_distinct(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "group_id long, entity_id long")
    assert rows(el.multi_member(df)) == [(2, 1), (2, 2)]


def test_alias_rules(spark):
    aliases = spark.createDataFrame(
        [(1, 1, "Kay", "1"), (1, 2, "KAY", "1"), (1, 3, "Hint", "3"), (1, 4, "kim", "2"), (1, 5, "", "1"), (1, 6, None, "1"), (2, 7, "Zed", "2")],
        "entity_id int, pos int, alias string, type string",
    )
    nodes = spark.createDataFrame([(1, "Kim")], "id int, name string")
    assert rows(el.alias_table(aliases, nodes, "pos")) == [(1, "Kay")]


def test_dedup_prefers_clean_short_titles_and_caps(spark):
    data = [(1, t) for t in ["Go (Remix)", "Go", "Go - Live", "Stay (Live)", "A", "BB", "CCC", "DDDD", "EEEEE", ""]]
    got = ti.dedup_titles(spark.createDataFrame(data, "k int, title string"), ["k"])
    assert [r["title"] for r in got.orderBy("rank").collect()] == ["A", "BB", "Go", "CCC", "DDDD"]


def test_min_degree_and_pending(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "x"), ("c", "none")], "id string, state string")
    degrees = spark.createDataFrame([("a", 5), ("b", 1)], "id string, degree long")
    assert [r["id"] for r in el.min_degree(nodes, degrees, "id", 2).collect()] == ["a"]
    assert [r["id"] for r in el.pending(nodes, "state").collect()] == ["a"]
    titles = spark.createDataFrame([("a", "b", "t"), ("b", "b", "u")], "src string, dst string, title string")
    assert [r["title"] for r in el.min_endpoint_degree(titles, degrees, 5).collect()] == ["t"]


# --- a small dump, read as files and built into a stored graph ------------------

DUMP = {
    "artist": [(1, "g1", "Mira"), (2, "g2", "Tove"), (3, "g3", "Idris"), (4, "g4", "Paolo"), (5, "g5", "The Larks"), (6, "g6", "Loner"), (7, "g7", "Far Away"), (8, "g8", "Talker"), (10, "g10", "Mixer")],
    "credit": [
        (100, 0, 1), (100, 1, 2), (101, 0, 1), (101, 1, 3), (102, 0, 3), (102, 1, 4), (103, 0, 3), (103, 1, 5), (104, 0, 6),
        (105, 0, 4), (105, 1, 7), (106, 0, 1), (106, 1, 2), (107, 0, 3), (107, 1, 8), (109, 0, 1), (109, 1, 999), (110, 0, 1), (110, 1, 10),
        (111, 0, 1), (111, 1, 2), (111, 2, 3),
    ],
    "recording": [
        (1000, "x", "High Water", 100), (1001, "x", "Late Train", 101), (1002, "x", "All Week", 102), (1003, "x", "Stolen Song", 103), (1004, "x", "Alone", 104),
        (1005, "x", "Far Song", 105), (1006, "x", "High Water (Remix)", 106), (1007, "x", "A Chat", 107), (1009, "x", "Ghost", 109), (1010, "x", "One / Two", 110), (1011, "x", "Trio", 111),
    ],
    "track": [(1, "t", r, m) for r, m in [(1000, 600), (1001, 600), (1002, 600), (1003, 601), (1004, 600), (1005, 600), (1006, 600), (1007, 602), (1009, 600), (1010, 603), (1011, 600)]],
    "medium": [(600, 500), (601, 501), (602, 502), (603, 503)],
    "release": [(500, "r", "A", 0, 900, 1), (501, "r", "B", 0, 901, 3), (502, "r", "C", 0, 902, 1), (503, "r", "D", 0, 903, 1)],
    "types": [(902, 4, "d"), (903, 8, "d")],
    "alias": [(1, 3, "Idris the Great", "en", 0, "d", 1), (2, 3, "Izzy", "en", 0, "d", 1), (3, 1, "M-Star", "en", 0, "d", 1), (4, 2, "Tóve Lind", "en", 0, "d", 2), (5, 2, "T O V E", "en", 0, "d", 3), (6, 3, "idris", "en", 0, "d", 1), (7, 7, "Distant", "en", 0, "d", 1)],
}


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    for name, data in DUMP.items():
        lines = ["\t".join(map(str, row)) for row in data]
        (folder / name).write_text("\n".join([*lines, "broken"]) + "\n", encoding="utf-8")
    return folder


def build(spark, dump, depth, accepted=("1",)):
    def scan(name, layout, columns):
        return scan_ragged(spark, str(dump / name), layout, columns)

    types = scan("types", ["grp", "type", "created"], ["grp", "type"])
    releases = scan("release", ["release", "gid", "name", "credit", "grp", "status"], ["release", "grp", "status"])
    kept = el.eligible_releases(releases, el.excluded_groups(types, "grp", "type"), "grp", "status", accepted)
    media = el.keep_referenced(scan("medium", ["medium", "release"], ["medium", "release"]), kept, "release")
    tracks = el.keep_referenced(scan("track", ["id", "gid", "item", "medium"], ["item", "medium"]), media, "medium")
    items = el.keep_referenced(scan("recording", ["item", "gid", "title", "group_id"], ["item", "title", "group_id"]), tracks, "item")
    entities = scan("artist", ["id", "gid", "name"], ["id", "name"])
    members = scan("credit", ["group_id", "pos", "entity_id"], ["group_id", "entity_id"])
    aliases = scan("alias", ["pos", "entity_id", "alias", "loc", "edits", "upd", "type"], ["pos", "entity_id", "alias", "type"])
    seed = spark.createDataFrame([("1",)], "id string")
    return build_graph(members, items, ["item"], entities, aliases, "pos", seed, depth)


def names_of(graph):
    return {r["name"] for r in graph.nodes.collect()}


def test_build_depth_two(spark, dump, tmp_path):
    graph = build(spark, dump, 2)
    assert names_of(graph) == {"Mira", "Tove", "Idris", "Paolo"}
    titles = {(r["src"], r["dst"], r["title"]) for r in graph.titles.collect()}
    assert titles == {
        ("1", "2", "High Water"), ("1", "2", "Trio"), ("1", "3", "Late Train"), ("1", "3", "Trio"), ("2", "3", "Trio"), ("3", "4", "All Week"),
    }
    asked = graph.edges.filter("src = '1' AND dst = '2'")
    trio = graph.lineups(asked).filter("title = 'Trio'")
    assert graph.lineups(asked).select("src", "dst").distinct().count() == 1
    assert {r["name"] for r in trio.collect()} == {"Mira", "Tove", "Idris"}
    assert {(r["entity_id"], r["alias"], r["alias_norm"]) for r in graph.aliases.collect()} == {
        ("3", "Idris the Great", "idris the great"), ("3", "Izzy", "izzy"), ("1", "M-Star", "m star"), ("2", "Tóve Lind", "tove lind"),
    }
    assert {r["id"]: r["degree"] for r in graph.nodes.collect()} == {"1": 2, "2": 2, "3": 3, "4": 1}

    graph_store.save_graph(graph, str(tmp_path / "g"))
    graph_store.save_graph(graph, str(tmp_path / "g"))
    loaded = graph_store.load_graph(spark, ["", str(tmp_path / "missing"), str(tmp_path / "g")])
    for name in graph_store.TABLES:
        assert rows(getattr(loaded, name)) == rows(getattr(graph, name))
    with pytest.raises(graph_store.GraphNotFound):
        graph_store.load_graph(spark, [str(tmp_path / "missing")])
    # A build that died half way is neither loaded nor promoted.
    graph.nodes.write.parquet(str(tmp_path / "half" / "nodes"))
    with pytest.raises(graph_store.GraphNotFound):
        graph_store.load_graph(spark, [str(tmp_path / "half")])
    with pytest.raises(graph_store.GraphNotFound):
        graph_store.promote_graph(spark, str(tmp_path / "half"), str(tmp_path / "g"))
    graph_store.save_graph(graph, str(tmp_path / "new"))
    graph_store.promote_graph(spark, str(tmp_path / "new"), str(tmp_path / "g"))
    assert rows(graph_store.load_graph(spark, [str(tmp_path / "g")]).edges) == rows(graph.edges)
    assert graph_store.is_complete(spark, str(tmp_path / "g-previous")) and not graph_store.is_complete(spark, str(tmp_path / "new"))


def test_build_depth_three_and_other_statuses(spark, dump):
    deeper = build(spark, dump, 3)
    assert "Far Away" in names_of(deeper)
    assert "Distant" in {r["alias"] for r in deeper.aliases.collect()}
    assert "The Larks" in names_of(build(spark, dump, 2, accepted=("1", "3")))


def test_path_details_on_the_dump(spark, dump):
    members = materialize(
        spark.createDataFrame([(str(g), str(e)) for g, _, e in DUMP["credit"] if g in (100, 101, 102, 105, 111)], "group_id string, entity_id string"), "m")
    titles = spark.createDataFrame([(str(c), t) for _, _, t, c in DUMP["recording"]], "group_id string, title string")
    entities = spark.createDataFrame([(str(i), n) for i, _, n in DUMP["artist"]], "id string, name string")
    reached = tr.distances(members, spark.createDataFrame([("1", "1")], "root string, node string"))
    requests = spark.createDataFrame([("1", i) for i in ("1", "7", "6", "42")], "root string, node string")
    hops = pa.path_details(requests, reached, entities, members, titles).orderBy("node", "hop").collect()
    assert [(h["from_name"], h["to_name"], h["titles"]) for h in hops] == [
        ("Far Away", "Paolo", ["Far Song"]), ("Paolo", "Idris", ["All Week"]), ("Idris", "Mira", ["Trio", "Late Train"]),
    ]
    status = {r["node"]: (r["status"], r["degrees"]) for r in pa.connection_status(requests, entities, reached.table).collect()}
    assert status == {"1": ("self", 0), "7": ("connected", 3), "6": ("no_path", None), "42": ("unknown", None)}
    text = {r["node"]: (r["headline"], r["line"]) for r in pa.path_text(requests, reached, entities, members, titles).collect()}
    assert text["1"] == ("Mira IS Mira!", "Mira")
    assert text["7"] == ("Far Away → Mira: 3 degrees", "Far Away -[Far Song]-> Paolo -[All Week]-> Idris -[Trio]-> Mira")


def test_scan_tsv_keeps_quotes_and_nulls(spark, tmp_path):
    (tmp_path / "t").write_text('1\t"quoted\t\\N\n2\tshort\n', encoding="utf-8")
    got = scan_tsv(spark, str(tmp_path / "t"), ["a", "b", "c"], ["a", "b", "c"])
    assert rows(got.fillna("<null>")) == [("1", '"quoted', "<null>"), ("2", "short", "<null>")]


def test_paths_from_both_ends_are_those_from_the_root(spark):
    import random

    draw = random.Random(11)
    groups = [(g, e) for g in range(60) for e in draw.sample(range(70), draw.choice([2, 2, 2, 3, 4]))]
    groups += [(100 + i, 200 + i + k) for i in range(11) for k in (0, 1)]  # a chain of its own
    members = materialize(spark.createDataFrame(groups, "group_id long, entity_id long"), "m")
    ends = {(draw.randrange(75), draw.randrange(75)) for _ in range(60)} | {(200, 211), (211, 203), (5, 5), (3, 205), (999, 3), (999, 999)}
    asked = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in ends], "pair string, root long, node long")
    met = tr.meet_in_the_middle(members, asked)
    got = {r["root"]: r["path"] for r in tr.walk_back(asked.select(F.col("pair").alias("root"), "node"), met.reached).collect()}
    whole = tr.distances(members, tr.seeds_of(asked, "root"))
    want = {f"{r['root']}-{r['node']}": r["path"] for r in tr.walk_back(asked.select("root", "node"), whole).collect()}
    assert got == want and len(got["200-211"]) == 12 and got["5-5"] == [5] and "3-205" not in got
    near = tr.meet_in_the_middle(members, asked.filter("pair IN ('200-211', '211-203', '5-5')"))
    assert (near.ahead, near.behind) == (6, 5) or (near.ahead, near.behind) == (5, 6)  # of eleven hops
    assert tr.walk_back(asked.limit(0).select(F.col("pair").alias("root"), "node"), tr.meet_in_the_middle(members, asked.limit(0)).reached).count() == 0


def test_lineup_others_caps_and_flags(spark):
    lineup = spark.createDataFrame([(1, i, n, "Ana", "Bo") for i, n in enumerate(["ana", "Bo", "c", "d", "e"])], "k int, entity_id int, name string, a string, b string")
    row = ti.other_members(lineup, ["k"], ["a", "b"], shown=2).first()
    assert (row["others"], row["truncated"]) == (["c", "d"], True)


def test_only_titles_of_shared_groups_are_made(spark):
    members = materialize(spark.createDataFrame([(1, 10), (1, 20), (2, 20), (2, 30), (3, 10), (3, 20), (4, 30)], "group_id long, entity_id long"), "m")
    raw = spark.createDataFrame([(g, t) for g in (1, 2, 3, 4) for t in (f"Song {g}", f"Song {g} - Live", f"B {g}")], "group_id long, title string")
    hops = spark.createDataFrame([(10, 20)], "src long, dst long")
    asked = []

    def titles_of(groups):
        asked.append(sorted(r["group_id"] for r in groups.collect()))
        return ti.dedup_titles(el.keep_referenced(raw, groups, "group_id"), ["group_id"])

    made = rows(pa.hop_titles(hops, members, titles_of))
    assert asked == [[1, 3]]
    assert made == rows(pa.hop_titles(hops, members, ti.dedup_titles(raw, ["group_id"]))) and len(made) == 4


def test_pairs_of_a_ball_are_not_looked_up(spark):
    members = materialize(spark.range(400).selectExpr("id DIV 4 AS group_id", "id * 7 % 90 AS entity_id").distinct(), "m")
    chosen = materialize(spark.range(60).selectExpr("id AS entity_id"), "chosen")
    ball = tr.ball_groups(members, chosen)
    # Members know whether they are chosen before they are paired.
    assert "[y#" not in ball._jdf.queryExecution().executedPlan().toString()
    of = {}
    for r in members.collect():
        of.setdefault(r["group_id"], []).append(r["entity_id"])
    wanted = {(a, b, g) for g, m in of.items() for a in m for b in m if a < b and a < 60}
    got = [(r["src"], r["dst"], r["group_id"]) for r in ball.select("src", "dst", "group_id").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    reached = spark.createDataFrame([(i, 0) for i in range(60)], "node long, dist long")
    assert rows(tr.ball_edges(members, reached, 1, materialize(ball, "ball"))) == rows(tr.ball_edges(members, reached, 1))


def test_degrees_pair_light_groups_once(spark):
    members = materialize(spark.range(300).selectExpr("id DIV 3 AS group_id", "id * 11 % 70 AS entity_id").distinct(), "m")
    plan = pr.degrees(members)._jdf.queryExecution().executedPlan().toString()
    # One self-join, whose pairs are neither doubled before the shuffle nor looked up afterwards.
    assert plan.count("FileScan") == 2 and "bitmap" not in plan


def test_distinct_members_are_told_once(spark):
    raw = materialize(spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (3, None), (3, 4), (None, 1), (None, 2)], "group_id long, entity_id long"), "m")
    kept = el.multi_member(raw)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "HashAggregate(keys=[group_id" in x and "entity_id" in x.split("functions")[0]]) == 2
    assert sorted(tuple(r) for r in kept.collect()) == [(2, 1), (2, 2)]
