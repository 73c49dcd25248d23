"""How the star-schema tables play the engine's roles.

Parts are entities, orders are the groups that credit them, suppliers give the
items their titles, and every order line is a credit.
Each role exists twice, as a DataFrame and as the SQL its checks start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.eligibility import multi_member
from linkgraph.operators.projection import degrees
from linkgraph.functions.text import VARIANT_MARKERS
from linkgraph.session import materialize

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL twins of the text functions (ASCII inputs) -------------------------

def sql_fold(x: str) -> str:
    dropped = f"regexp_replace(lower(strip_accents({x})), '[.''’ʼ]', '', 'g')"
    key = f"trim(regexp_replace({dropped}, '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {key} <> '' THEN {key} ELSE trim(lower({x})) END"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def sql_base(x: str) -> str:
    plain = f"regexp_replace({x}, '[\\(\\[].*?[\\)\\]]', ' ', 'g')"
    plain = f"regexp_replace({plain}, '\\s-\\s.*$', ' ', 'g')"
    plain = f"regexp_replace({plain}, '\\b(feat|ft|featuring|with)\\b.*', ' ', 'gi')"
    return sql_squeeze(f"lower({plain})")


def sql_loose(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[\\(\\[].*?[\\)\\]]', ' ', 'g')"
    plain = f"regexp_replace({plain}, '\\b(feat|ft|featuring|with)\\b.*', ' ', 'g')"
    return sql_squeeze(plain)


def sql_variant(x: str) -> str:
    return f"regexp_matches({x}, '(?i)\\b({'|'.join(VARIANT_MARKERS)})\\b')"


# --- graph roles -----------------------------------------------------------

SQL_MEMBERS = """
members AS (
  SELECT DISTINCT l_orderkey AS group_id, l_partkey AS entity_id FROM lineitem),
multi AS (
  SELECT * FROM members
  WHERE group_id IN (SELECT group_id FROM members GROUP BY group_id HAVING count(*) >= 2))"""

SQL_EDGES = SQL_MEMBERS + """,
edges AS (
  SELECT DISTINCT a.entity_id AS src, b.entity_id AS dst
  FROM multi a JOIN multi b ON a.group_id = b.group_id AND a.entity_id < b.entity_id),
adj AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
degrees AS (SELECT src AS id, count(*) AS degree FROM adj GROUP BY src)"""

SQL_HUB = SQL_EDGES + """,
hub AS (SELECT entity_id AS id FROM multi GROUP BY entity_id ORDER BY count(*) DESC, entity_id LIMIT 1)"""


def sql_dist(depth: int) -> str:
    """Hop distances from the hub, at most ``depth``."""
    return SQL_HUB + f""",
walk AS (
  SELECT id AS node, CAST(0 AS BIGINT) AS dist FROM hub
  UNION
  SELECT a.dst, w.dist + 1 FROM walk w JOIN adj a ON a.src = w.node WHERE w.dist < {depth}),
reached AS (SELECT node, min(dist) AS dist FROM walk GROUP BY node)"""


FAR = 30  # more hops than the graph has at any tested scale

SQL_TREE = sql_dist(FAR) + """,
tree AS (
  SELECT v.node, v.dist, min(u.node) AS parent
  FROM reached v LEFT JOIN adj a ON a.src = v.node LEFT JOIN reached u ON u.node = a.dst AND u.dist = v.dist - 1
  GROUP BY v.node, v.dist),
steps AS (
  SELECT node, CAST(0 AS BIGINT) AS pos, node AS id, parent FROM tree
  UNION ALL
  SELECT s.node, s.pos + 1, t.node, t.parent FROM steps s JOIN tree t ON t.node = s.parent)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return multi_member(lines.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("entity_id")))


def written_members(spark: SparkSession, sf: str) -> DataFrame:
    """The membership as a written table, for plans that scan it repeatedly."""
    return materialize(members(spark, sf), "credited")


def hub(credited: DataFrame) -> DataFrame:
    """The entity credited by most groups, smallest id on ties."""
    counts = credited.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "entity_id").limit(1).select(F.col("entity_id").alias("id"))


def hub_seed(credited: DataFrame) -> DataFrame:
    return hub(credited).select(F.col("id").alias("root"), F.col("id").alias("node"))


SQL_ENTITIES = """
entities AS (
  SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) * p_size * p_size AS popularity,
         p_retailprice > 905 AS enriched
  FROM part)"""

SQL_RANKED = SQL_EDGES + "," + SQL_ENTITIES + """,
ranked AS (
  SELECT e.*, coalesce(d.degree, 0) AS degree,
         CASE WHEN c.coverage >= 0.9 THEN e.popularity ELSE coalesce(d.degree, 0) END AS prim,
         CASE WHEN c.coverage >= 0.9 THEN coalesce(d.degree, 0) ELSE e.popularity END AS sec
  FROM entities e LEFT JOIN degrees d USING (id)
  CROSS JOIN (SELECT avg(CASE WHEN enriched THEN 1.0 ELSE 0.0 END) AS coverage FROM entities) c)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("bigint")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        (size * size * size).alias("popularity"),
        (F.col("p_retailprice") > 905).alias("enriched"),
    )


def ranked_entities(spark: SparkSession, sf: str) -> DataFrame:
    counted = degrees(written_members(spark, sf))
    return entities(spark, sf).join(counted, "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
    )


SQL_ALIASES = """
raw_aliases AS (
  SELECT p_partkey AS entity_id, p_brand AS alias, '1' AS type FROM part
  UNION ALL SELECT p_partkey, p_type, '2' FROM part
  UNION ALL SELECT p_partkey, p_name, '3' FROM part),
aliases AS (SELECT entity_id, alias FROM raw_aliases WHERE type IN ('1', '2'))"""


def raw_aliases(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("entity_id"),
        F.inline(
            F.array(
                F.struct(F.col("p_brand").alias("alias"), F.lit("1").alias("type")),
                F.struct(F.col("p_type").alias("alias"), F.lit("2").alias("type")),
                F.struct(F.col("p_name").alias("alias"), F.lit("3").alias("type")),
            )
        ),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return raw_aliases(spark, sf).filter(F.col("type").isin("1", "2")).select("entity_id", "alias")


# --- item roles ------------------------------------------------------------

SQL_TITLE = "s_name || CASE l_returnflag WHEN 'R' THEN ' (Remix)' WHEN 'A' THEN ' - Live' ELSE '' END"

SQL_ITEMS = f"""
items AS (
  SELECT l_orderkey AS group_id, l_linenumber, l_partkey, l_suppkey, {SQL_TITLE} AS title
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "title"]


def line_title() -> F.Column:
    suffix = F.when(F.col("l_returnflag") == "R", " (Remix)").when(F.col("l_returnflag") == "A", " - Live").otherwise("")
    return F.concat("s_name", suffix)


def items(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("group_id"), "l_linenumber", "l_partkey", "l_suppkey", line_title().alias("title")
    )


SQL_DEDUP_GROUP = f"""
forms AS (
  SELECT group_id, {sql_base('title')} AS base, {sql_variant('title')} AS variant, length(title) AS chars, title
  FROM items WHERE title <> ''),
best_forms AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, base ORDER BY variant, chars, title) AS bn FROM forms)
  WHERE bn = 1),
group_titles AS (
  SELECT group_id, title, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY variant, chars, title) AS rank FROM best_forms)
  WHERE rank <= 5)"""

# Titles of the pairs in a relation pairs(src, dst), kept and ranked.
SQL_PAIR_TITLES = f"""
pair_forms AS (
  SELECT DISTINCT p.src, p.dst, g.title, {sql_base('g.title')} AS base, {sql_variant('g.title')} AS variant,
         length(g.title) AS chars
  FROM pairs p JOIN multi a ON a.entity_id = p.src JOIN multi b ON b.entity_id = p.dst AND b.group_id = a.group_id
  JOIN group_titles g ON g.group_id = a.group_id),
pair_best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst, base ORDER BY variant, chars, title) AS bn FROM pair_forms)
  WHERE bn = 1),
pair_titles AS (
  SELECT src, dst, title, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY variant, chars, title) AS rank FROM pair_best)
  WHERE rank <= 5)"""

SQL_ELIGIBLE = """
eligible_orders AS (
  SELECT o_orderkey FROM orders
  WHERE o_orderstatus IN ('F', 'O')
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))"""


def eligible_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of an accepted status whose customer is not in an excluded segment."""
    from linkgraph.operators.eligibility import eligible_releases, excluded_groups

    excluded = excluded_groups(
        table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_mktsegment", ["MACHINERY"]
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return eligible_releases(orders, excluded, "o_custkey", "o_orderstatus", ["F", "O"])


# --- search roles -----------------------------------------------------------

SQL_QUERIES = """
queries AS (
  SELECT DISTINCT query FROM (
    SELECT unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, lower(p_type),
                   substr(p_name, 1, 2) || substr(p_name, 4), split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1),
                   substr(p_name, 3, 4), substr(p_name, 1, 1)]) AS query FROM part
    UNION ALL SELECT s_name FROM supplier
    UNION ALL SELECT n_name FROM nation
    UNION ALL SELECT r_name FROM region
    UNION ALL SELECT o_orderpriority FROM orders))"""


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What people type: full names, words, misspellings, swapped words,
    brands, and text that names no part at all."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.col("p_name")
    from_parts = table(spark, sf, "part").select(
        F.explode(
            F.array(
                name,
                first,
                second,
                F.col("p_brand"),
                F.lower("p_type"),
                F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1000)),
                F.concat_ws(" ", second, first),
                F.substring(name, 3, 4),
                F.substring(name, 1, 1),
            )
        ).alias("query")
    )
    other = (
        table(spark, sf, "supplier").select("s_name")
        .unionAll(table(spark, sf, "nation").select("n_name"))
        .unionAll(table(spark, sf, "region").select("r_name"))
        .unionAll(table(spark, sf, "orders").select("o_orderpriority"))
    )
    return from_parts.unionAll(other).distinct()
