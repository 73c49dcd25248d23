"""Queries of eligibility, projection, titles and the build."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkgraph.operators import eligibility as el
from linkgraph.operators import projection as pr
from linkgraph.operators import titles as ti
from linkgraph.operators import traversal as tr
from linkgraph.operators.paths import with_name
from linkgraph.plans import roles as ro
from linkgraph.plans.build import build_graph
from linkgraph.plans.registry import query
from linkgraph.plans.roles import table
from linkgraph.session import materialize

# --- eligibility -------------------------------------------------------------


@query("excluded_groups", "SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')")
def excluded_groups(spark, sf):
    return el.excluded_groups(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", ["MACHINERY", "FURNITURE"])


@query("eligible_releases", f"WITH {ro.SQL_ELIGIBLE} SELECT o_orderkey FROM eligible_orders")
def eligible_releases(spark, sf):
    return ro.eligible_orders(spark, sf).select("o_orderkey")


@query("eligible_items", f"""
WITH {ro.SQL_ELIGIBLE}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM eligible_orders)
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (
    SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'AFRICA')))""")
def eligible_items(spark, sf):
    regions = table(spark, sf, "region").filter("r_name <> 'AFRICA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = el.keep_referenced(table(spark, sf, "nation"), regions, "n_regionkey")
    suppliers = el.keep_referenced(
        table(spark, sf, "supplier"), nations.select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey"
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sold = el.keep_referenced(lines, suppliers.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    orders = ro.eligible_orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"))
    return el.keep_referenced(sold, orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("drop_dangling", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 45)""")
def drop_dangling(spark, sf):
    known = table(spark, sf, "part").filter("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    return el.keep_referenced(lines, known, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("multi_member_groups", """
WITH m AS (SELECT DISTINCT l_orderkey AS group_id, l_partkey AS entity_id FROM lineitem)
SELECT group_id, entity_id FROM m WHERE group_id IN (SELECT group_id FROM m GROUP BY group_id HAVING count(*) >= 2)""")
def multi_member_groups(spark, sf):
    lines = table(spark, sf, "lineitem")
    return el.multi_member(lines.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("entity_id")))


@query("alias_table", f"""
WITH {ro.SQL_ALIASES}
SELECT p_partkey AS entity_id, min_by(alias, type) AS alias FROM raw_aliases JOIN part ON p_partkey = entity_id
WHERE type IN ('1', '2', '3') AND lower(alias) <> lower(p_name) GROUP BY p_partkey, lower(alias)""")
def alias_table(spark, sf):
    nodes = ro.entities(spark, sf)
    return el.alias_table(ro.raw_aliases(spark, sf), nodes, "type", ["1", "2", "3"])


# --- projection --------------------------------------------------------------


@query("coedges", f"WITH {ro.SQL_EDGES} SELECT src, dst FROM edges")
def coedges(spark, sf):
    return pr.co_members(ro.members(spark, sf))


@query("canonical_pairs", """
SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem""")
def canonical_pairs(spark, sf):
    return table(spark, sf, "lineitem").select(*pr.canonical_pair("l_partkey", "l_suppkey")).distinct()


@query("member_groups", f"""
WITH {ro.SQL_MEMBERS} SELECT entity_id, count(*) AS n_groups, min(group_id) AS first_group, max(group_id) AS last_group
FROM multi GROUP BY entity_id""")
def member_groups(spark, sf):
    return ro.members(spark, sf).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("group_id").alias("first_group"),
        F.max("group_id").alias("last_group"),
    )


@query("neighbors", f"""
WITH RECURSIVE {ro.SQL_HUB}, near AS (SELECT dst AS id FROM adj WHERE src = (SELECT id FROM hub))
SELECT src AS center, dst AS neighbor FROM adj WHERE src IN (SELECT id FROM near)""")
def neighbors(spark, sf):
    credited = ro.written_members(spark, sf)
    centers = ro.hub(credited).withColumnRenamed("id", "entity_id")
    near = pr.star_edges(credited, centers).select(F.col("neighbor").alias("entity_id"))
    return pr.star_edges(credited, near)


@query("edge_nodes", f"WITH {ro.SQL_EDGES} SELECT DISTINCT src AS id FROM adj")
def edge_nodes(spark, sf):
    return pr.edge_nodes(pr.co_members(ro.members(spark, sf)))


@query("node_degree", f"WITH {ro.SQL_EDGES} SELECT id, degree FROM degrees")
def node_degree(spark, sf):
    return pr.degrees(ro.written_members(spark, sf))


@query("edge_degree", f"WITH {ro.SQL_EDGES} SELECT id, degree FROM degrees")
def edge_degree(spark, sf):
    return pr.edge_degrees(pr.co_members(ro.members(spark, sf)))


@query("refresh_degree", f"""
WITH {ro.SQL_EDGES} SELECT p_partkey AS id, p_name AS name, coalesce(degree, 0) AS degree
FROM part LEFT JOIN degrees ON id = p_partkey""")
def refresh_degree(spark, sf):
    nodes = ro.entities(spark, sf).select("id", "name", F.lit(-1).alias("degree"))
    return pr.refresh_degrees(nodes, pr.degrees(ro.written_members(spark, sf)))


@query("adjacency", f"""
WITH {ro.SQL_EDGES} SELECT src, dst >> 10 AS chunk, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors
FROM adj GROUP BY src, dst >> 10""")
def adjacency(spark, sf):
    chunked = pr.adjacency(pr.co_members(ro.members(spark, sf)), F.shiftright("dst", 10))
    return chunked.withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query("all_ids", "SELECT p_partkey AS id, p_name AS name FROM part")
def all_ids(spark, sf):
    return ro.entities(spark, sf).select("id", "name")


@query("min_degree_nodes", f"""
WITH {ro.SQL_EDGES} SELECT p_partkey AS id, coalesce(degree, 0) AS degree
FROM part LEFT JOIN degrees ON id = p_partkey WHERE coalesce(degree, 0) >= 6""")
def min_degree_nodes(spark, sf):
    counted = pr.degrees(ro.written_members(spark, sf))
    return el.min_degree(ro.entities(spark, sf).select("id"), counted, "id", 6)


# --- titles ------------------------------------------------------------------


@query("bounded_titles", """
SELECT l_suppkey AS key, p_name AS title, CAST(rank AS INTEGER) AS rank FROM (
  SELECT l_suppkey, p_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank
  FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE rank <= 40""")
def bounded_titles(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey")
    return ti.bounded_titles(lines.join(parts, "l_partkey"), "key", ["l_orderkey", "l_linenumber", "l_partkey"], cap=40)


@query("dedup_titles", f"""
WITH {ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP} SELECT group_id, title, CAST(rank AS INTEGER) AS rank FROM group_titles""")
def dedup_titles(spark, sf):
    return _group_titles(spark, sf)


def _group_titles(spark, sf):
    return ti.dedup_titles(ro.items(spark, sf), ["group_id"])


def _titles_of(spark, sf):
    """Makes the kept titles of given groups: no other group's items are put into forms."""
    return lambda groups: ti.dedup_titles(el.keep_referenced(ro.items(spark, sf), groups, "group_id"), ["group_id"])


_HUB_PAIRS = """
pairs AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM adj WHERE src = (SELECT id FROM hub))"""


@query("edge_titles", f"""
WITH RECURSIVE {ro.SQL_EDGES},{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP}, pairs AS (SELECT src, dst FROM edges),
{ro.SQL_PAIR_TITLES}
SELECT src, dst, title, CAST(rank AS INTEGER) AS rank FROM pair_titles""")
def edge_titles(spark, sf):
    return _edge_titles(spark, sf)


def _edge_titles(spark, sf, cap=ti.KEPT_TITLES):
    titles = materialize(_group_titles(spark, sf), "group-titles")
    return ti.edge_titles(pr.pair_groups(ro.members(spark, sf)), titles, cap)


_ALL_PAIR_TITLES = f"""{ro.SQL_EDGES},{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP}, pairs AS (SELECT src, dst FROM edges),
{ro.SQL_PAIR_TITLES}"""


@query("topk_titles", f"""
WITH {_ALL_PAIR_TITLES}
SELECT src, dst, title, CAST(rank AS INTEGER) AS rank FROM pair_titles WHERE rank <= 3""")
def topk_titles(spark, sf):
    return _edge_titles(spark, sf, cap=3)


@query("topk_overflow", f"""
WITH {ro.SQL_ITEMS}, kept AS (SELECT DISTINCT group_id, title FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY title) AS rank,
                  count(*) OVER (PARTITION BY group_id) AS total FROM kept)
SELECT group_id, title, CAST(rank AS INTEGER) AS rank, greatest(total - 3, 0) AS more FROM ranked WHERE rank <= 3""")
def topk_overflow(spark, sf):
    titles = ro.items(spark, sf).select("group_id", "title").distinct()
    return ti.topk_with_overflow(titles, ["group_id"], ["title"], 3).select("group_id", "title", "rank", "more")


@query("title_lineup", f"""
WITH {_ALL_PAIR_TITLES}
SELECT DISTINCT t.src, t.dst, t.title, m.entity_id, p_name AS name
FROM pair_titles t JOIN multi a ON a.entity_id = t.src JOIN multi b ON b.entity_id = t.dst AND b.group_id = a.group_id
JOIN group_titles g ON g.group_id = a.group_id AND g.title = t.title
JOIN multi m ON m.group_id = a.group_id JOIN part ON p_partkey = m.entity_id""")
def title_lineup(spark, sf):
    credited = ro.written_members(spark, sf)
    return ti.title_lineup(_references(spark, sf, credited), _credits(spark, sf, credited))


def _references(spark, sf, credited):
    """Line-ups of all edges by reference, with the ranks of the titles that were kept."""
    titles = materialize(_group_titles(spark, sf), "group-titles")
    return ti.references_apart(pr.pair_groups(credited), titles)


def _credits(spark, sf, credited):
    return with_name(credited, ro.entities(spark, sf), "entity_id", "name").select("group_id", "entity_id", "name")


@query("lineup_others", """
WITH credits AS (
  SELECT DISTINCT l_orderkey, l_partkey, p_name AS name, first_name, last_name FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN (SELECT l_orderkey AS k, min(p_name) AS first_name, max(p_name) AS last_name
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON k = l_orderkey),
others AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY name, l_partkey) AS rn FROM credits
  WHERE lower(name) <> lower(first_name) AND lower(name) <> lower(last_name))
SELECT l_orderkey AS group_id, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 3) AS others, count(*) > 3 AS truncated
FROM others GROUP BY l_orderkey""")
def lineup_others(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    lineup = (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("entity_id"))
        .distinct()
        .join(parts, "entity_id")
    )
    ends = lineup.groupBy("group_id").agg(F.min("name").alias("first_name"), F.max("name").alias("last_name"))
    shown = ti.other_members(lineup.join(ends, "group_id"), ["group_id"], ["first_name", "last_name"], shown=3)
    return shown.withColumn("others", F.array_join("others", ", "))


@query("collaborators", f"""
WITH RECURSIVE {ro.SQL_HUB},{ro.SQL_ITEMS},{ro.SQL_DEDUP_GROUP},{_HUB_PAIRS},{ro.SQL_PAIR_TITLES}
SELECT p_partkey AS id, p_name AS name, string_agg(title, '; ' ORDER BY rank) AS titles
FROM pair_titles JOIN part ON p_partkey = CASE WHEN src = (SELECT id FROM hub) THEN dst ELSE src END
GROUP BY p_partkey, p_name""")
def collaborators(spark, sf):
    credited = ro.written_members(spark, sf)
    spokes = pr.star_edges(credited, ro.hub(credited).withColumnRenamed("id", "entity_id")).select(
        F.col("neighbor").alias("id"), *pr.canonical_pair("center", "neighbor")
    )
    titles = ti.dedup_titles(ti.pair_titles(spokes, credited, _titles_of(spark, sf)), ["src", "dst"])
    listed = titles.groupBy("src", "dst").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "title")))["title"], "; ").alias("titles")
    )
    named = spokes.join(ro.entities(spark, sf).select("id", "name"), "id")
    return named.join(listed, ["src", "dst"]).select("id", "name", "titles")


_MIN_DEGREE_TITLES = f"""
WITH {_ALL_PAIR_TITLES}
SELECT t.src, t.dst, title, greatest(a.degree, b.degree) AS best_degree
FROM pair_titles t JOIN degrees a ON a.id = t.src JOIN degrees b ON b.id = t.dst
WHERE greatest(a.degree, b.degree) >= 100"""


@query("min_degree_titles", _MIN_DEGREE_TITLES)
def min_degree_titles(spark, sf):
    credited = ro.written_members(spark, sf)
    titles = materialize(_group_titles(spark, sf), "group-titles")
    # The degrees decide on pairs, before these take on their titles.
    prominent = el.min_endpoint_degree(pr.pair_groups(credited), pr.degrees(credited), 100)
    return ti.edge_titles(prominent, titles, along=["best_degree"]).select("src", "dst", "title", "best_degree")


@query("work_batch", _MIN_DEGREE_TITLES + " ORDER BY t.src, t.dst, title LIMIT 50")
def work_batch(spark, sf):
    """The next titles to look up: a batch of a stated size."""
    return min_degree_titles(spark, sf).orderBy("src", "dst", "title").limit(50)


# --- stored graph --------------------------------------------------------------


@query("ball_edges", f"""
WITH RECURSIVE {ro.sql_dist(3)}
SELECT src, dst FROM edges JOIN reached a ON a.node = src JOIN reached b ON b.node = dst WHERE least(a.dist, b.dist) < 3""")
def ball_edges(spark, sf):
    credited = ro.written_members(spark, sf)
    reached = tr.distances(credited, ro.hub_seed(credited), max_depth=3)
    return tr.ball_edges(credited, reached.table, 3)


@query("induced_edges", f"""
WITH RECURSIVE {ro.sql_dist(3)}
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM reached) AND dst IN (SELECT node FROM reached)""")
def induced_edges(spark, sf):
    credited = ro.written_members(spark, sf)
    reached = tr.distances(credited, ro.hub_seed(credited), max_depth=3).table
    return tr.induced_edges(pr.co_members(credited), reached)


_BUILD = f"""
WITH RECURSIVE {ro.SQL_ELIGIBLE},
items AS (
  SELECT l_orderkey AS group_id, l_linenumber, l_partkey, l_suppkey, {ro.SQL_TITLE} AS title
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM eligible_orders)),
{ro.SQL_DEDUP_GROUP},
members AS (
  SELECT DISTINCT l_orderkey AS group_id, l_partkey AS entity_id FROM lineitem
  WHERE l_orderkey IN (SELECT group_id FROM group_titles)
    AND l_partkey IN (SELECT p_partkey FROM part)),
multi AS (SELECT * FROM members WHERE group_id IN (SELECT group_id FROM members GROUP BY group_id HAVING count(*) >= 2)),
edges AS (
  SELECT DISTINCT a.entity_id AS src, b.entity_id AS dst
  FROM multi a JOIN multi b ON a.group_id = b.group_id AND a.entity_id < b.entity_id),
adj AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
hub AS (SELECT entity_id AS id FROM multi GROUP BY entity_id ORDER BY count(*) DESC, entity_id LIMIT 1),
walk AS (
  SELECT id AS node, 0 AS dist FROM hub
  UNION SELECT a.dst, w.dist + 1 FROM walk w JOIN adj a ON a.src = w.node WHERE w.dist < 3),
reached AS (SELECT node, min(dist) AS dist FROM walk GROUP BY node),
ball AS (
  SELECT src, dst FROM edges JOIN reached a ON a.node = src JOIN reached b ON b.node = dst WHERE least(a.dist, b.dist) < 3),
pairs AS (SELECT src, dst FROM ball),
{ro.SQL_PAIR_TITLES}"""


def _built(spark, sf):
    orders = ro.eligible_orders(spark, sf).select(F.col("o_orderkey").alias("group_id"))
    items = el.keep_referenced(ro.items(spark, sf), orders, "group_id")
    lines = table(spark, sf, "lineitem")
    members = lines.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("entity_id"))
    # Read for the seed and for the graph.
    members = materialize(el.keep_referenced(members, orders, "group_id"), "eligible-members")
    entities = ro.entities(spark, sf).select("id", "name")
    seed = ro.hub(el.multi_member(members))
    return build_graph(
        members, items, ro.ITEM_ORDER, entities, ro.raw_aliases(spark, sf), "type", seed, depth=3
    )


@query("build_graph", _BUILD + """
SELECT DISTINCT b.src, b.dst, t.title, CAST(t.rank AS INTEGER) AS rank, m.entity_id, p_name AS name
FROM ball b JOIN pair_titles t USING (src, dst)
JOIN multi a ON a.entity_id = b.src JOIN multi c ON c.entity_id = b.dst AND c.group_id = a.group_id
JOIN group_titles g ON g.group_id = a.group_id AND g.title = t.title
JOIN multi m ON m.group_id = a.group_id JOIN part ON p_partkey = m.entity_id""")
def build(spark, sf):
    graph = _built(spark, sf)
    return graph.titles.join(graph.lineups(), ["src", "dst", "title"]).select(
        "src", "dst", "title", "rank", "entity_id", "name"
    )


@query("build_nodes", _BUILD + """,
ends AS (SELECT src AS id FROM ball UNION ALL SELECT dst FROM ball),
raw_aliases AS (SELECT p_partkey AS entity_id, p_brand AS alias FROM part UNION ALL SELECT p_partkey, p_type FROM part)
SELECT id, p_name AS name, degree, n_aliases FROM (SELECT id, count(*) AS degree FROM ends GROUP BY id)
JOIN part ON p_partkey = id JOIN (SELECT entity_id, count(*) AS n_aliases FROM raw_aliases GROUP BY 1) ON entity_id = id""")
def build_nodes(spark, sf):
    graph = _built(spark, sf)
    per_node = graph.aliases.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_aliases"))
    return graph.nodes.join(per_node, "id").select("id", "name", "degree", "n_aliases")
