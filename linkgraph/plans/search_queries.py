"""Queries of name resolution and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkgraph.operators import ranking as rk
from linkgraph.operators import reports as rp
from linkgraph.operators import resolution as rs
from linkgraph.operators.containment import substring_pairs
from linkgraph.plans import roles as ro
from linkgraph.plans.registry import query
from linkgraph.plans.roles import sql_fold, table
from linkgraph.session import materialize


def _inputs(spark, sf):
    ranked = materialize(ro.ranked_entities(spark, sf), "entities")
    return ro.search_queries(spark, sf), ranked, ro.aliases(spark, sf)


_ORDER = "tier, prim DESC, sec DESC, name, id"


def search_hits(limit: int) -> str:
    """Ranked prefix/substring hits per query."""
    return f"""
WITH RECURSIVE {ro.SQL_RANKED},{ro.SQL_ALIASES},{ro.SQL_QUERIES},
asked AS (SELECT query, folded FROM (SELECT query, {sql_fold('query')} AS folded FROM queries) WHERE folded <> ''),
surfaces AS (
  SELECT id, {sql_fold('name')} AS text FROM entities
  UNION SELECT entity_id, {sql_fold('alias')} FROM aliases),
matches AS (
  SELECT query, text, CASE WHEN starts_with(text, folded) THEN 0 ELSE 1 END AS tier
  FROM asked JOIN (SELECT DISTINCT text FROM surfaces) ON contains(text, folded)),
best AS (SELECT query, id, min(tier) AS tier FROM matches JOIN surfaces USING (text) GROUP BY query, id),
hits AS (
  SELECT * FROM (
    SELECT b.query, b.tier, r.id, r.name, r.popularity, r.degree, r.prim, r.sec,
           row_number() OVER (PARTITION BY b.query ORDER BY {_ORDER}) AS rank
    FROM best b JOIN ranked r USING (id)) WHERE rank <= {limit})"""


def similar_hits(limit: int) -> str:
    """Similar names (edit score) of queries with fewer than three hits."""
    return f""",
thin AS (SELECT a.query, folded FROM asked a LEFT JOIN hits h ON h.query = a.query GROUP BY a.query, folded HAVING count(h.id) < 3),
scored AS (
  SELECT query, text, 100.0 * (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) AS score
  FROM (SELECT query, text, array_to_string(list_sort(string_split(folded, ' ')), ' ') AS a,
               array_to_string(list_sort(string_split(text, ' ')), ' ') AS b
        FROM thin, (SELECT DISTINCT {sql_fold('name')} AS text FROM entities))),
near AS (
  SELECT * FROM (
    SELECT query, r.id, r.name, r.popularity, r.degree, r.prim, r.sec, score,
           row_number() OVER (PARTITION BY query ORDER BY score DESC, r.id) AS rank
    FROM scored JOIN ranked r ON {sql_fold('r.name')} = text WHERE score >= 72) WHERE rank <= {limit})"""


def sql_lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of at most 62 characters.

    A bit of the row stands for a character of ``a``; each character of ``b`` updates it.
    """
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (
        f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0 END))"
    )
    masks = f"list_transform(string_split({b}, ''), lambda c: coalesce({mask}, 0)::BIGINT)"
    row = (
        f"list_reduce(list_concat([{full}::BIGINT], {masks}), "
        f"lambda r, m: (((r + (r & m)) | (r - (r & m))) & {full}::BIGINT)::BIGINT)"
    )
    return f"(length({a}) - bit_count({row}))"


def similar_by_tokens(asked: str, limit: int, out: str) -> str:
    """Similar names of the queries in ``asked`` (query, folded) by ``200 * LCS / (m + n)`` of sorted words."""
    return f""",
{out}_scored AS (
  SELECT folded, text, 200.0 * {sql_lcs("a", "b")} / (length(a) + length(b)) AS score
  FROM (SELECT folded, text, array_to_string(list_sort(string_split(folded, ' ')), ' ') AS a,
               array_to_string(list_sort(string_split(text, ' ')), ' ') AS b
        FROM (SELECT DISTINCT folded FROM {asked}), (SELECT DISTINCT {sql_fold('name')} AS text FROM entities))
  WHERE 16 * least(length(a), length(b)) >= 9 * greatest(length(a), length(b))),
{out} AS (
  SELECT * FROM (
    SELECT query, r.id, r.name, r.popularity, r.degree, r.prim, r.sec, score,
           row_number() OVER (PARTITION BY query ORDER BY score DESC, r.id) AS rank
    FROM {out}_scored JOIN {asked} USING (folded) JOIN ranked r ON {sql_fold('r.name')} = text WHERE score >= 72)
  WHERE rank <= {limit})"""


_OVERRIDE = """,
rivals AS (
  SELECT h.query, arg_min(o.rank, row(-o.prim, o.rank)) AS rank, max(o.prim) AS prim
  FROM hits h JOIN hits o ON o.query = h.query AND o.tier > 0 WHERE h.rank = 1 AND h.tier = 0
  GROUP BY h.query, h.prim HAVING max(o.prim) >= 50 * greatest(h.prim, 1)),
final AS (
  SELECT h.*, CASE WHEN v.rank IS NULL OR h.rank > v.rank THEN h.rank WHEN h.rank = v.rank THEN 1 ELSE h.rank + 1 END AS place
  FROM hits h LEFT JOIN rivals v ON v.query = h.query)"""

_LABELS = """,
qualified AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY query, lower(name)) = 1 THEN name
                 ELSE name || ' · ' || degree || CASE WHEN degree = 1 THEN ' collab' ELSE ' collabs' END END AS bare FROM final),
labelled AS (
  SELECT *, row_number() OVER (PARTITION BY query, lower(bare) ORDER BY id) AS seq FROM qualified),
results AS (
  SELECT query, CAST(place AS INTEGER) AS rank, id, name, popularity, degree, tier,
         CASE WHEN seq > 1 THEN bare || ' (' || seq || ')' ELSE bare END AS label,
         lower(trim(name)) = lower(trim(query)) AS matches_query FROM labelled)"""


@query("resolve_sql_tiers", search_hits(10) + """
SELECT query, CAST(rank AS INTEGER) AS rank, id, name, popularity, degree, tier FROM hits""")
def resolve_sql_tiers(spark, sf):
    asked, ranked, aliases = _inputs(spark, sf)
    hits = rs.tier_hits(rs.asked(asked), rk.with_prominence(ranked), aliases, 10)
    return hits.select("query", "rank", "id", "name", "popularity", "degree", "tier")


@query("cross_tier_override", search_hits(10) + _OVERRIDE + """
SELECT query, CAST(place AS INTEGER) AS rank, id, tier FROM final""")
def cross_tier_override(spark, sf):
    asked, ranked, aliases = _inputs(spark, sf)
    return rs.resolve(asked, ranked, aliases, 10, scorer=None).select("query", "rank", "id", "tier")


@query("resolve_entities", search_hits(10).replace("hits AS (", "tier_hits AS (")
       + similar_hits(10).replace("JOIN hits h", "JOIN tier_hits h") + f""",
hits AS (
  SELECT * FROM (
    SELECT query, tier, id, name, popularity, degree, prim, sec, row_number() OVER (PARTITION BY query ORDER BY arrival) AS rank
    FROM (SELECT query, tier, id, name, popularity, degree, prim, sec, rank AS arrival FROM tier_hits
          UNION ALL
          SELECT query, 2, id, name, popularity, degree, prim, sec, rank + 10 FROM near n
          WHERE NOT EXISTS (SELECT 1 FROM tier_hits h WHERE h.query = n.query AND h.id = n.id)))
  WHERE rank <= 10)""" + _OVERRIDE + """
SELECT query, CAST(place AS INTEGER) AS rank, id, name, popularity, degree, tier FROM final""")
def resolve_entities(spark, sf):
    return rs.resolve(*_inputs(spark, sf), limit=10, scorer="edit")


_THIN = """,
thin AS (SELECT a.query, folded FROM asked a LEFT JOIN tier_hits h ON h.query = a.query GROUP BY a.query, folded HAVING count(h.id) < 3)"""


def _merged(limit: int, base: str) -> str:
    """Tier hits, then similar names of thin queries, cut at ``limit``."""
    return base.replace("hits AS (", "tier_hits AS (") + _THIN + similar_by_tokens("thin", limit, "near") + f""",
hits AS (
  SELECT * FROM (
    SELECT query, tier, id, name, popularity, degree, prim, sec, row_number() OVER (PARTITION BY query ORDER BY arrival) AS rank
    FROM (SELECT query, tier, id, name, popularity, degree, prim, sec, rank AS arrival FROM tier_hits
          UNION ALL
          SELECT query, 2, id, name, popularity, degree, prim, sec, rank + {limit} FROM near n
          WHERE NOT EXISTS (SELECT 1 FROM tier_hits h WHERE h.query = n.query AND h.id = n.id)))
  WHERE rank <= {limit})"""


@query("resolve_token_sort", _merged(10, search_hits(10)) + _OVERRIDE + """
SELECT query, CAST(place AS INTEGER) AS rank, id, name, popularity, degree, tier FROM final""")
def resolve_token_sort(spark, sf):
    """The default scorer, a subsequence ratio."""
    return rs.resolve(*_inputs(spark, sf), limit=10)


@query("fuzzy_candidates", search_hits(10) + similar_hits(10) + """
SELECT query, id, name, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM near""")
def fuzzy_candidates(spark, sf):
    asked, ranked, aliases = _inputs(spark, sf)
    ranked, wanted = rk.with_prominence(ranked), rs.asked(asked)
    hits = rs.tier_hits(wanted, ranked, aliases, 10)
    counts = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    thin = wanted.join(counts, "query", "left").filter(F.coalesce("n", F.lit(0)) < 3).drop("n")
    return rs.fuzzy_candidates(thin, ranked, 10, scorer="edit").select("query", "id", "name", "score", "rank")


@query("fuzzy_token_sort", search_hits(10) + similar_by_tokens("asked", 10, "near") + """
SELECT query, id, name, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM near""")
def fuzzy_token_sort(spark, sf):
    """Every query against all names by token-sorted subsequence ratio."""
    asked, ranked, _ = _inputs(spark, sf)
    found = rs.fuzzy_candidates(rs.asked(asked), rk.with_prominence(ranked), 10)
    return found.select("query", "id", "name", "score", "rank")


@query("disambiguate_labels", _merged(10, search_hits(10)) + _OVERRIDE + _LABELS + " SELECT query, id, label FROM results")
def disambiguate_labels(spark, sf):
    return rk.label_candidates(rs.resolve(*_inputs(spark, sf), limit=10)).select("query", "id", "label")


_SERVED = search_hits(8).replace("FROM queries) WHERE folded <> ''", "FROM (SELECT DISTINCT trim(query) AS query FROM queries)) WHERE folded <> '' AND length(query) >= 2")


@query("search_result", _merged(8, _SERVED) + _OVERRIDE + _LABELS + """
SELECT query, rank, id, name, popularity, degree, tier, label, matches_query FROM results""")
def search_result(spark, sf):
    return rs.search(*_inputs(spark, sf))


@query("auto_top_match", _merged(8, _SERVED) + _OVERRIDE + _LABELS + """
SELECT query, id, name, NOT matches_query AS notice FROM results WHERE rank = 1""")
def auto_top_match(spark, sf):
    return rs.submit(rs.search(*_inputs(spark, sf)))


@query("coverage_fraction", f"WITH {ro.SQL_ENTITIES} SELECT avg(CASE WHEN enriched THEN 1.0 ELSE 0.0 END) AS coverage FROM entities")
def coverage_fraction(spark, sf):
    return rk.coverage_fraction(ro.entities(spark, sf), "enriched")


@query("duplicate_names", "SELECT lower(p_name) AS name_key, count(*) AS entities FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return rp.duplicate_names(ro.entities(spark, sf))


@query("substring_join", """
WITH needles AS (
  SELECT DISTINCT lower(w) AS needle FROM (
    SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> ''),
texts AS (SELECT DISTINCT lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS text FROM pages)
SELECT needle, text FROM needles JOIN texts ON contains(text, needle) WHERE text <> ''""")
def substring_join(spark, sf):
    """Which benchmark words occur in which page titles."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.split("text", "[^A-Za-z]+")).alias("w")
    ).select(F.lower("w").alias("needle"))
    titles = table(spark, sf, "pages").select(
        F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("text")
    )
    return substring_pairs(words, "needle", titles, "text")
