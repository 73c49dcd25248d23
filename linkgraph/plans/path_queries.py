"""Queries of traversal, paths and the reports drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkgraph.operators import paths as pa
from linkgraph.operators import projection as pr
from linkgraph.operators import reports as rp
from linkgraph.operators import routes as rt
from linkgraph.operators import titles as ti
from linkgraph.operators import traversal as tr
from linkgraph.operators.ranking import exact_lookup
from linkgraph.operators.resolution import identify
from linkgraph.plans import roles as ro
from linkgraph.plans.graph_queries import _group_titles, _titles_of
from linkgraph.plans.registry import query
from linkgraph.plans.roles import table
from linkgraph.plans.search_queries import search_hits, similar_hits
from linkgraph.session import materialize


def _from_hub(spark, sf, max_depth=None):
    credited = ro.written_members(spark, sf)
    return credited, tr.distances(credited, ro.hub_seed(credited), max_depth=max_depth)


def _requests(spark, sf, reached):
    """Ask for the path of every part."""
    root = reached.table.filter("dist = 0").select("root")
    return ro.entities(spark, sf).select(root.scalar().alias("root"), F.col("id").alias("node"))


@query("bfs_distances", f"""
WITH RECURSIVE {ro.sql_dist(4)}
SELECT v.node, v.dist, min(u.node) AS parent
FROM reached v LEFT JOIN adj a ON a.src = v.node LEFT JOIN reached u ON u.node = a.dst AND u.dist = v.dist - 1
GROUP BY v.node, v.dist""")
def bfs_distances(spark, sf):
    _, reached = _from_hub(spark, sf, max_depth=4)
    return reached.table.select("node", "dist", "parent")


@query("all_distances", f"WITH RECURSIVE {ro.sql_dist(ro.FAR)} SELECT node, dist FROM reached")
def all_distances(spark, sf):
    return _from_hub(spark, sf)[1].table.select("node", "dist")


@query("resume_bfs", f"WITH RECURSIVE {ro.sql_dist(ro.FAR)} SELECT node, dist FROM reached")
def resume_bfs(spark, sf):
    credited, stored = _from_hub(spark, sf, max_depth=2)
    return tr.resume(credited, stored.table).table.select("node", "dist")


@query("beam_bfs", f"""
WITH RECURSIVE {ro.SQL_HUB},
g0 AS (SELECT group_id FROM multi WHERE entity_id = (SELECT id FROM hub)),
m0 AS (SELECT group_id, entity_id FROM multi WHERE group_id IN (SELECT group_id FROM g0)),
e1 AS (SELECT a.entity_id AS node FROM m0 a JOIN m0 b ON a.group_id = b.group_id AND a.entity_id <> b.entity_id
       WHERE a.entity_id <> (SELECT id FROM hub) GROUP BY 1 ORDER BY count(DISTINCT b.entity_id) DESC, 1 LIMIT 4),
g1 AS (SELECT DISTINCT group_id FROM multi WHERE group_id IN (SELECT group_id FROM g0) OR entity_id IN (SELECT node FROM e1)),
m1 AS (SELECT group_id, entity_id FROM multi WHERE group_id IN (SELECT group_id FROM g1)),
l2 AS (SELECT DISTINCT b.entity_id AS node FROM m1 a JOIN m1 b ON a.group_id = b.group_id
       WHERE a.entity_id IN (SELECT node FROM e1) AND b.entity_id NOT IN (SELECT entity_id FROM m0)),
g2 AS (SELECT DISTINCT group_id FROM multi WHERE group_id IN (SELECT group_id FROM g1) OR entity_id IN (SELECT node FROM l2)),
m2 AS (SELECT group_id, entity_id FROM multi WHERE group_id IN (SELECT group_id FROM g2)),
near AS (SELECT DISTINCT a.entity_id AS x, b.entity_id AS y FROM m2 a JOIN m2 b ON a.group_id = b.group_id AND a.entity_id <> b.entity_id),
walked AS (SELECT id AS node, CAST(0 AS BIGINT) AS dist FROM hub
  UNION SELECT y, w.dist + 1 FROM walked w JOIN near ON x = w.node WHERE w.dist < 3)
SELECT node, min(dist) AS dist FROM walked GROUP BY node""")
def beam_bfs(spark, sf):
    credited = ro.written_members(spark, sf)
    return tr.beam(credited, ro.hub_seed(credited), depth=3, width=4).select("node", "dist")


@query("shortest_path", f"""
WITH RECURSIVE {ro.SQL_TREE}
SELECT node, count(*) - 1 AS degrees, string_agg(CAST(id AS VARCHAR), '>' ORDER BY pos) AS path FROM steps GROUP BY node""")
def shortest_path(spark, sf):
    _, reached = _from_hub(spark, sf)
    paths = tr.walk_back(_requests(spark, sf, reached), reached)
    return paths.select(
        "node",
        (F.size("path") - 1).cast("bigint").alias("degrees"),
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
    )


@query("path_pairs", f"""
WITH RECURSIVE {ro.SQL_EDGES},
ends AS (SELECT p_brand, min(p_partkey) AS root, max(p_partkey) AS node FROM part GROUP BY p_brand),
walk AS (
  SELECT DISTINCT root, root AS node, CAST(0 AS BIGINT) AS dist FROM ends
  UNION SELECT w.root, a.dst, w.dist + 1 FROM walk w JOIN adj a ON a.src = w.node WHERE w.dist < 6),
dist AS (SELECT root, node, min(dist) AS dist FROM walk GROUP BY root, node),
back AS (
  SELECT e.root, e.node, d.dist, e.node AS tip, CAST(e.node AS VARCHAR) AS path FROM ends e JOIN dist d ON d.root = e.root AND d.node = e.node
  UNION ALL
  SELECT root, node, dist - 1, parent, path || '>' || parent FROM (
    SELECT b.root, b.node, b.dist, b.path, min(u.node) AS parent
    FROM back b JOIN adj a ON a.src = b.tip JOIN dist u ON u.root = b.root AND u.node = a.dst AND u.dist = b.dist - 1
    GROUP BY b.root, b.node, b.dist, b.path)),
whole AS (SELECT root, node, path FROM back WHERE dist = 0)
SELECT p_brand, e.root, e.node, d.dist AS degrees, path FROM ends e LEFT JOIN dist d ON d.root = e.root AND d.node = e.node
LEFT JOIN whole w ON w.root = e.root AND w.node = e.node""")
def path_pairs(spark, sf):
    """The route between two ends of each brand, by ids."""
    ends = table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_partkey").alias("root"), F.max("p_partkey").alias("node")
    )
    met = tr.meet_in_the_middle(ro.written_members(spark, sf), ends.withColumnRenamed("p_brand", "pair"))
    asked = ends.select(F.col("p_brand").alias("root"), "node")
    routes = tr.walk_back(asked, met.reached).select(
        F.col("root").alias("p_brand"), (F.size("path") - 1).cast("bigint").alias("degrees"),
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
    )
    return ends.join(routes, "p_brand", "left").select("p_brand", "root", "node", "degrees", "path")


_HOPS = f"""
WITH RECURSIVE {ro.SQL_TREE},
hops AS (SELECT node, pos AS hop, id AS from_id, parent AS to_id FROM steps WHERE parent IS NOT NULL),
pairs AS (SELECT DISTINCT least(from_id, to_id) AS src, greatest(from_id, to_id) AS dst FROM hops),
{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP},{ro.SQL_PAIR_TITLES}"""


@query("path_details", _HOPS + """,
listed AS (SELECT src, dst, string_agg(title, '; ' ORDER BY rank) AS titles FROM pair_titles GROUP BY src, dst)
SELECT node, CAST(hop AS INTEGER) AS hop, from_id, f.p_name AS from_name, to_id, t.p_name AS to_name, titles
FROM hops JOIN part f ON f.p_partkey = from_id JOIN part t ON t.p_partkey = to_id
JOIN listed ON src = least(from_id, to_id) AND dst = greatest(from_id, to_id)""")
def path_details(spark, sf):
    credited, reached = _from_hub(spark, sf)
    details = pa.path_details(
        _requests(spark, sf, reached), reached, ro.entities(spark, sf), credited, _titles_of(spark, sf)
    )
    return details.withColumn("titles", F.array_join("titles", "; ")).drop("root")


@query("path_text", _HOPS + """,
names AS (
  SELECT node, count(*) - 1 AS n, string_agg(p_name, '|' ORDER BY pos) AS names,
         min_by(p_name, pos) AS first_name, max_by(p_name, pos) AS last_name
  FROM steps JOIN part ON p_partkey = id GROUP BY node),
lines AS (
  SELECT node, string_agg('-[' || title || ']-> ' || p_name, ' ' ORDER BY hop) AS line
  FROM hops JOIN pair_titles ON src = least(from_id, to_id) AND dst = greatest(from_id, to_id) AND rank = 1
  JOIN part ON p_partkey = to_id GROUP BY node)
SELECT n.node,
  CASE WHEN n = 0 THEN first_name || ' IS ' || last_name || '!'
       ELSE first_name || ' → ' || last_name || ': ' || n || CASE WHEN n = 1 THEN ' degree' ELSE ' degrees' END END AS headline,
  concat_ws(' ', first_name, line) AS line
FROM names n LEFT JOIN lines l ON l.node = n.node""")
def path_text(spark, sf):
    credited, reached = _from_hub(spark, sf)
    return pa.path_text(
        _requests(spark, sf, reached), reached, ro.entities(spark, sf), credited, _titles_of(spark, sf)
    ).drop("root")


@query("connection_status", f"""
WITH RECURSIVE {ro.sql_dist(ro.FAR)}
SELECT o_orderkey AS node,
  CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN o_orderkey = (SELECT id FROM hub) THEN 'self'
       WHEN dist IS NOT NULL THEN 'connected' ELSE 'no_path' END AS status,
  CASE WHEN p_partkey IS NOT NULL THEN dist END AS degrees
FROM orders LEFT JOIN part ON p_partkey = o_orderkey LEFT JOIN reached ON node = o_orderkey""")
def connection_status(spark, sf):
    # Order numbers serve as requested ids: most of them name no part.
    _, reached = _from_hub(spark, sf)
    root = reached.table.filter("dist = 0").select("root")
    requests = table(spark, sf, "orders").select(root.scalar().alias("root"), F.col("o_orderkey").alias("node"))
    return pa.connection_status(requests, ro.entities(spark, sf), reached.table).drop("root")


_NAMED = f"""
WITH RECURSIVE {ro.sql_dist(ro.FAR)},{ro.SQL_RANKED.split(ro.SQL_EDGES)[1].lstrip(',')},{ro.SQL_ALIASES},{ro.SQL_QUERIES},
by_name AS (
  SELECT query, arg_min(id, row(-popularity, -degree, id)) AS id FROM queries JOIN ranked ON lower(name) = lower(query) GROUP BY query),
by_alias AS (
  SELECT query, arg_min(id, row(-popularity, -degree, id)) AS id
  FROM queries JOIN aliases ON lower(alias) = lower(query) JOIN ranked ON id = entity_id GROUP BY query),
exact AS (
  SELECT q.query, coalesce(n.id, a.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'name' WHEN a.id IS NOT NULL THEN 'alias' END AS matched_by
  FROM queries q LEFT JOIN by_name n USING (query) LEFT JOIN by_alias a USING (query))"""


@query("exact_name_lookup", _NAMED + """
SELECT query, x.id, p_name AS name, matched_by FROM exact x LEFT JOIN part ON p_partkey = x.id""")
def exact_name_lookup(spark, sf):
    return exact_lookup(ro.search_queries(spark, sf), ro.ranked_entities(spark, sf), ro.aliases(spark, sf))


@query("no_connection_rate", _NAMED + """
SELECT count(dist) AS connected, count(*) - count(dist) AS not_connected,
  100.0 * CAST(count_if(dist IS NULL) AS DOUBLE) / count(*) AS no_connection_percent
FROM exact LEFT JOIN reached ON node = id""")
def no_connection_rate(spark, sf):
    _, reached = _from_hub(spark, sf)
    root = reached.table.filter("dist = 0").select("root")
    found = exact_lookup(ro.search_queries(spark, sf), ro.ranked_entities(spark, sf), ro.aliases(spark, sf))
    outcomes = found.withColumn("root", root.scalar()).join(
        reached.table.select("root", F.col("node").alias("id"), "dist"), ["root", "id"], "left"
    )
    status = F.when(F.col("id") == F.col("root"), "self").when(F.col("dist").isNotNull(), "connected").when(
        F.col("id").isNotNull(), "no_path"
    )
    return rp.no_connection_rate(outcomes.select("query", status.alias("status")))


@query("hop_histogram", f"""
WITH RECURSIVE {ro.sql_dist(ro.FAR)}
SELECT dist, count(*) AS nodes, 100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS percent FROM reached GROUP BY dist""")
def hop_histogram(spark, sf):
    return rp.hop_histogram(_from_hub(spark, sf)[1].table)


@query("reach_summary", f"""
WITH RECURSIVE {ro.sql_dist(ro.FAR)}, top AS (SELECT max(dist) AS d FROM reached)
SELECT count(*) FILTER (dist > 0) AS reachable, CAST(median(dist) FILTER (dist > 0) AS DOUBLE) AS median_hops,
  avg(dist) FILTER (dist > 0) AS mean_hops, max(dist) AS max_hops,
  100.0 * CAST(count_if(dist = (SELECT d FROM top)) AS DOUBLE) / count(*) AS outer_percent,
  100.0 * CAST(count_if(dist = (SELECT d FROM top)) AS DOUBLE) / count(*) > 70 AS outer_warning
FROM reached""")
def reach_summary(spark, sf):
    return rp.reach_summary(_from_hub(spark, sf)[1].table)


@query("growth_vs_baseline", f"""
WITH RECURSIVE {ro.sql_dist(4)}, n AS (SELECT count(*) AS nodes, count(*) FILTER (dist <= 2) AS baseline_nodes FROM reached)
SELECT nodes, baseline_nodes, CAST(nodes AS DOUBLE) / baseline_nodes AS growth, nodes > 15 * baseline_nodes AS explosion FROM n""")
def growth_vs_baseline(spark, sf):
    _, reached = _from_hub(spark, sf, max_depth=4)
    deep = reached.table.agg(F.count(F.lit(1)).alias("nodes"))
    shallow = reached.table.filter("dist <= 2").agg(F.count(F.lit(1)).alias("nodes"))
    return rp.growth(deep, shallow)


_EXACT = _NAMED.split(ro.SQL_QUERIES)[1]
_REACHED = ro.sql_dist(ro.FAR).split(ro.SQL_EDGES)[1]


_CHOSEN = search_hits(1) + similar_hits(1) + _REACHED + _EXACT + """,
chosen AS (
  SELECT x.query, coalesce(x.id, h.id, n.id) AS id,
         CASE WHEN x.id IS NOT NULL THEN matched_by ELSE 'search' END AS matched_by
  FROM exact x LEFT JOIN hits h ON h.query = x.query LEFT JOIN near n ON n.query = x.query
  WHERE coalesce(x.id, h.id, n.id) IS NOT NULL)"""


def _identified(spark, sf):
    """One part per query that finds any."""
    ranked = materialize(ro.ranked_entities(spark, sf), "entities")
    return identify(ro.search_queries(spark, sf), ranked, ro.aliases(spark, sf), scorer="edit")


@query("connect_by_name", _CHOSEN + """,
parents AS (
  SELECT v.node, v.dist, min(u.node) AS parent FROM reached v LEFT JOIN adj a ON a.src = v.node
  LEFT JOIN reached u ON u.node = a.dst AND u.dist = v.dist - 1 GROUP BY v.node, v.dist)
SELECT query, id, matched_by, dist AS degrees, parent AS first_step FROM chosen LEFT JOIN parents ON node = id""")
def connect_by_name(spark, sf):
    _, reached = _from_hub(spark, sf)
    tree = reached.table.select(
        F.col("node").alias("id"), F.col("dist").alias("degrees"), F.col("parent").alias("first_step")
    )
    return _identified(spark, sf).join(tree, "id", "left").select("query", "id", "matched_by", "degrees", "first_step")


# Line-ups were not recorded for open orders; tracks are known of finished ones.
_SONGS = _CHOSEN + ro.SQL_TREE.removeprefix(ro.sql_dist(ro.FAR)) + f""",
hops AS (
  SELECT node, pos AS hop, id AS from_id, parent AS to_id FROM steps
  WHERE parent IS NOT NULL AND node IN (SELECT id FROM chosen)),
pairs AS (SELECT DISTINCT least(from_id, to_id) AS src, greatest(from_id, to_id) AS dst FROM hops),
{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP},{ro.SQL_PAIR_TITLES},
sources AS (
  SELECT DISTINCT t.src, t.dst, t.title, t.rank, a.group_id
  FROM pair_titles t JOIN multi a ON a.entity_id = t.src JOIN multi b ON b.entity_id = t.dst AND b.group_id = a.group_id
  JOIN group_titles g ON g.group_id = a.group_id AND g.title = t.title WHERE t.rank <= 3),
songs AS (SELECT src, dst, title, rank, min(group_id) AS song_id FROM sources GROUP BY ALL),
recorded AS (
  SELECT DISTINCT src, dst, title, m.entity_id FROM sources s JOIN orders ON o_orderkey = s.group_id AND o_orderstatus <> 'O'
  JOIN multi m ON m.group_id = s.group_id),
lineup AS (
  SELECT src, dst, title, entity_id, p_name AS name FROM (
    SELECT * FROM recorded
    UNION ALL SELECT src, dst, title, unnest([src, dst]) FROM songs WHERE (src, dst, title) NOT IN (SELECT (src, dst, title) FROM recorded))
  JOIN part ON p_partkey = entity_id)"""


def _named_songs(spark, sf):
    """Names with what they resolve to, the hops from there to the hub, their songs and line-ups."""
    credited, reached = _from_hub(spark, sf)
    root = reached.table.filter("dist = 0").select("root")
    found = materialize(_identified(spark, sf).withColumn("root", root.scalar()), "found")
    entities = ro.entities(spark, sf)
    hops = materialize(rt.route_hops(found, reached, entities), "route-hops")
    songs, references = rt.shown_songs(hops, credited, _titles_of(spark, sf))
    recorded = table(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("group_id"))
    credits = pa.with_name(credited.join(recorded, "group_id", "left_semi"), entities, "entity_id", "name")
    lineup = rt.lineup_or_ends(references, credits.select("group_id", "entity_id", "name"), entities)
    return found, hops, songs, lineup


@query("named_routes", _SONGS + """
SELECT query, c.id, matched_by, CAST(hop AS INTEGER) AS hop, from_id, f.p_name AS from_name, to_id, t.p_name AS to_name, CAST(s.rank AS INTEGER) AS rank, s.title,
  song_id, CAST(o_custkey AS VARCHAR) AS track_id, entity_id, l.name
FROM chosen c LEFT JOIN hops h ON h.node = c.id LEFT JOIN part f ON f.p_partkey = from_id LEFT JOIN part t ON t.p_partkey = to_id
LEFT JOIN songs s ON s.src = least(from_id, to_id) AND s.dst = greatest(from_id, to_id)
LEFT JOIN lineup l ON l.src = s.src AND l.dst = s.dst AND l.title = s.title
LEFT JOIN orders ON o_orderkey = song_id AND o_orderstatus = 'F'""")
def named_routes(spark, sf):
    """Every hop of every name's connection, with its songs, track ids and line-ups."""
    found, hops, songs, lineup = _named_songs(spark, sf)
    tracks = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("song_id"), F.col("o_custkey").cast("string").alias("track_id")
    )
    return rt.named_routes(found.select("query", "root", "id", "matched_by"), hops, songs, lineup, tracks).drop("root")


@query("basket_titles", _SONGS + """,
sets AS (
  SELECT src, dst, title, list_sort(list(DISTINCT lower(name))) AS names FROM lineup GROUP BY src, dst, title),
firsts AS (SELECT lower(title) AS title_key, names, min(row(src, dst, title)) AS edge FROM sets GROUP BY lower(title), names)
SELECT title_key, edge[1] AS src, edge[2] AS dst, unnest(names) AS name FROM firsts""")
def basket_titles(spark, sf):
    """The songs that the connections of all names show, each with its line-up once."""
    *_, lineup = _named_songs(spark, sf)
    return rt.distinct_lineups(lineup)


@query("watchlist_flags", _HOPS + """,
node_hits AS (
  SELECT DISTINCT s.node, 'node' AS kind, p_name AS text, hint FROM steps s JOIN part ON p_partkey = s.id
  JOIN (SELECT DISTINCT lower(p_type) AS hint FROM part) ON contains(lower(p_name), hint)),
title_hits AS (
  SELECT DISTINCT node, 'title' AS kind, title AS text, hint
  FROM hops JOIN pair_titles ON src = least(from_id, to_id) AND dst = greatest(from_id, to_id)
  JOIN (SELECT DISTINCT lower(s_name) || ' - live' AS hint FROM supplier WHERE s_acctbal < 0) ON contains(lower(title), hint))
SELECT * FROM node_hits UNION ALL SELECT * FROM title_hits""")
def watchlist_flags(spark, sf):
    credited, reached = _from_hub(spark, sf)
    paths = materialize(tr.walk_back(_requests(spark, sf, reached), reached), "paths")
    nodes = pa.with_name(pa.path_nodes(paths, ["node"]), ro.entities(spark, sf), "id", "name")
    hops = pa.path_hops(paths, ["node"])
    kept = materialize(pa.hop_titles(hops, credited, _titles_of(spark, sf)), "hop-titles")
    titles = hops.join(kept, ["src", "dst"])
    node_hints = table(spark, sf, "part").select(F.col("p_type").alias("hint"))
    title_hints = table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        F.concat("s_name", F.lit(" - Live")).alias("hint")
    )
    return rp.flag_paths(nodes, titles, ["node"], node_hints, title_hints)


@query("displayed_titles", _HOPS + """,
shown AS (
  SELECT DISTINCT lower(title) AS title_key, src, dst, title, rank FROM hops
  JOIN pair_titles ON src = least(from_id, to_id) AND dst = greatest(from_id, to_id) WHERE rank <= 3),
credits AS (
  SELECT DISTINCT t.src, t.dst, t.title, p_name AS name
  FROM shown t JOIN multi a ON a.entity_id = t.src JOIN multi b ON b.entity_id = t.dst AND b.group_id = a.group_id
  JOIN group_titles g ON g.group_id = a.group_id AND g.title = t.title
  JOIN multi m ON m.group_id = a.group_id JOIN part ON p_partkey = m.entity_id),
lineups AS (SELECT src, dst, title, string_agg(DISTINCT lower(name), ', ' ORDER BY lower(name)) AS lineup FROM credits GROUP BY src, dst, title)
SELECT DISTINCT lower(title) AS title_key, lineup FROM lineups""")
def displayed_titles(spark, sf):
    credited, reached = _from_hub(spark, sf)
    paths = tr.walk_back(_requests(spark, sf, reached), reached)
    hops = pa.path_hops(paths, ["node"]).select("src", "dst").distinct()
    titled = materialize(ti.pair_titles(hops, credited, _titles_of(spark, sf)), "titled")
    shown = ti.dedup_titles(titled, ["src", "dst"]).filter("rank <= 3").drop("rank")
    lineup = ti.title_lineup(titled.join(shown, ["src", "dst", "title"], "left_semi").select("src", "dst", "title", "group_id"), credited)
    named = pa.with_name(lineup, ro.entities(spark, sf), "entity_id", "name")
    per_title = named.groupBy("src", "dst", "title").agg(
        F.array_join(F.sort_array(F.collect_set(F.lower("name"))), ", ").alias("lineup")
    )
    return per_title.select(F.lower("title").alias("title_key"), "lineup").distinct()


@query("graph_stats", f"""
WITH RECURSIVE {ro.sql_dist(3)},
pairs AS (SELECT src, dst FROM edges JOIN reached a ON a.node = src JOIN reached b ON b.node = dst WHERE least(a.dist, b.dist) < 3),
{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP},{ro.SQL_PAIR_TITLES}
SELECT (SELECT count(*) FROM reached) AS nodes, (SELECT count(*) FROM pairs) AS edges, (SELECT count(*) FROM pair_titles) AS titles""")
def graph_stats(spark, sf):
    credited, reached = _from_hub(spark, sf, max_depth=3)
    edges, titles = _ball(spark, sf, credited, reached)
    return rp.graph_stats(reached.table, edges, titles)


def _ball(spark, sf, credited, reached):
    """Edges within three hops, and their titles."""
    expanded = reached.table.filter("dist < 3").select(F.col("node").alias("entity_id"))
    group_titles = materialize(_group_titles(spark, sf), "group-titles")
    pairs = materialize(tr.ball_groups(credited, expanded), "edge-groups")
    titles = materialize(ti.edge_titles(pairs, group_titles), "titles")
    return materialize(tr.ball_edges(credited, reached.table, 3, pairs), "edges"), titles


@query("graph_invariants", f"""
WITH RECURSIVE {ro.sql_dist(3)},
pairs AS (SELECT src, dst FROM edges JOIN reached a ON a.node = src JOIN reached b ON b.node = dst WHERE least(a.dist, b.dist) < 3),
{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP},{ro.SQL_PAIR_TITLES},
hops AS (
  SELECT least(v.node, min(u.node)) AS src, greatest(v.node, min(u.node)) AS dst
  FROM reached v JOIN adj a ON a.src = v.node JOIN reached u ON u.node = a.dst AND u.dist = v.dist - 1 GROUP BY v.node)
SELECT 'edge_order' AS rule, count(*) AS violations FROM pairs WHERE src >= dst
UNION ALL SELECT 'edge_without_title', count(*) FROM pairs WHERE (src, dst) NOT IN (SELECT (src, dst) FROM pair_titles)
UNION ALL SELECT 'repeated_title', count(*) FROM (SELECT 1 FROM pair_titles GROUP BY src, dst, title HAVING count(*) > 1)
UNION ALL SELECT 'hop_without_title', count(*) FROM hops WHERE (src, dst) NOT IN (SELECT (src, dst) FROM pair_titles)""")
def graph_invariants(spark, sf):
    credited, reached = _from_hub(spark, sf, max_depth=3)
    edges, titles = _ball(spark, sf, credited, reached)
    hops = reached.table.filter("parent IS NOT NULL").select(*pr.canonical_pair("node", "parent"))
    return rp.graph_invariants(edges, titles, hops)
