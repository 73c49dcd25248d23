"""Queries of the text functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkgraph.functions import text as tx
from linkgraph.plans.registry import query
from linkgraph.plans.roles import (
    SQL_ITEMS, items, sql_base, sql_fold, sql_loose, sql_variant, table,
)


@query("fold_names", f"""
SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents
UNION ALL SELECT -1 - s_suppkey, md5({sql_fold('s_name')}) FROM supplier
UNION ALL SELECT -1000000000 - p_partkey, md5({sql_fold('p_name')}) FROM part""")
def fold_names(spark, sf):
    def one(name, key, text):
        return table(spark, sf, name).select(key.alias("doc_id"), F.md5(tx.fold_name(text)).alias("folded"))

    return (
        one("documents", F.col("doc_id"), "text")
        .unionAll(one("supplier", -1 - F.col("s_suppkey"), "s_name"))
        .unionAll(one("part", -1000000000 - F.col("p_partkey"), "p_name"))
    )


@query("base_titles", f"""
WITH {SQL_ITEMS}
SELECT title, {sql_base('title')} AS base, count(*) AS items FROM items GROUP BY title
UNION ALL SELECT CAST(doc_id AS VARCHAR), md5({sql_base('text')}), 1 FROM documents""")
def base_titles(spark, sf):
    titles = items(spark, sf).groupBy("title").agg(F.count(F.lit(1)).alias("items"))
    docs = table(spark, sf, "documents")
    return titles.select("title", tx.base_title("title").alias("base"), "items").unionAll(
        docs.select(F.col("doc_id").cast("string"), F.md5(tx.base_title("text")), F.lit(1).cast("bigint"))
    )


@query("loose_titles", f"""
WITH {SQL_ITEMS}
SELECT title, {sql_loose('title')} AS loose, count(*) AS items FROM items GROUP BY title
UNION ALL SELECT CAST(doc_id AS VARCHAR), md5({sql_loose('text')}), 1 FROM documents""")
def loose_titles(spark, sf):
    titles = items(spark, sf).groupBy("title").agg(F.count(F.lit(1)).alias("items"))
    docs = table(spark, sf, "documents")
    return titles.select("title", tx.loose_text("title").alias("loose"), "items").unionAll(
        docs.select(F.col("doc_id").cast("string"), F.md5(tx.loose_text("text")), F.lit(1).cast("bigint"))
    )


@query("variant_flag", f"""
WITH {SQL_ITEMS}
SELECT title AS subject, {sql_variant('title')} AS variant, count(*) AS n FROM items GROUP BY title
UNION ALL SELECT 'conv ' || conv_id || ' ' || turn, {sql_variant('text')}, 1 FROM conversations""")
def variant_flag(spark, sf):
    titles = items(spark, sf).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    turns = table(spark, sf, "conversations")
    return titles.select(F.col("title").alias("subject"), tx.is_variant_title("title").alias("variant"), "n").unionAll(
        turns.select(
            F.concat_ws(" ", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")),
            tx.is_variant_title("text"),
            F.lit(1).cast("bigint"),
        )
    )


_FEATURES = """s_name || CASE l_linestatus WHEN 'O' THEN ' (feat. ' ELSE ' (with ' END || p_brand || ' & ' || p_name || ', '
  || p_type || ') (FT. ' || p_name || ' and Band)'"""


@query("parse_features", f"""
WITH tracks AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_FEATURES} AS title
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
clauses AS (
  SELECT *, list_concat(list_concat(regexp_extract_all(title, '(?i)\\(feat\\.\\s*([^)]+)\\)', 1),
    regexp_extract_all(title, '(?i)\\(ft\\.\\s*([^)]+)\\)', 1)),
    list_concat(regexp_extract_all(title, '(?i)\\(featuring\\s+([^)]+)\\)', 1),
    regexp_extract_all(title, '(?i)\\(with\\s+([^)]+)\\)', 1))) AS found
  FROM tracks)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string([trim(x) FOR x IN string_split_regex(array_to_string(found, ','), ',|&|and') IF trim(x) <> ''], ';') AS names
FROM clauses""")
def parse_features(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    joined = lines.join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey"
    ).join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"), "l_partkey"
    )
    opening = F.when(F.col("l_linestatus") == "O", " (feat. ").otherwise(" (with ")
    title = F.concat(
        "s_name", opening, "p_brand", F.lit(" & "), "p_name", F.lit(", "), "p_type", F.lit(") (FT. "), "p_name", F.lit(" and Band)")
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(tx.featured_names(title), ";").alias("names")
    )


@query("year_from", """
SELECT o_orderkey, CAST(substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 1, 4) AS INTEGER) AS year,
  CASE WHEN regexp_matches(o_orderpriority, '^[0-9]{4}') THEN 1 END AS odd
FROM orders""")
def year_from(spark, sf):
    orders = table(spark, sf, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return orders.select(
        "o_orderkey", tx.year_from(stamp).alias("year"), tx.year_from("o_orderpriority").alias("odd")
    )


_STORE = "https://music.apple.com/us/search?term="


@query("search_terms", """
SELECT p_partkey, trim(p_name || ' ' || array_to_string([x FOR x IN [p_brand, CASE WHEN p_size < 10 THEN '' ELSE p_type END] IF x <> ''], ' ')) AS term
FROM part""")
def search_terms(spark, sf):
    names = F.array("p_brand", F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", tx.search_term("p_name", names).alias("term"))


@query("search_urls", f"""
SELECT p_partkey, '{_STORE}' || replace(replace(p_name || ' ' || p_brand, '#', '%23'), ' ', '+') AS url FROM part
UNION ALL SELECT -1 - c_custkey, '{_STORE}' || replace(c_name, '#', '%23') FROM customer""")
def search_urls(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", tx.search_url(_STORE, F.concat_ws(" ", "p_name", "p_brand")).alias("url")
    )
    customers = table(spark, sf, "customer").select(-1 - F.col("c_custkey"), tx.search_url(_STORE, "c_name"))
    return parts.unionAll(customers)


@query("url_rewrite", """
SELECT page_id, replace(url || '/100x100bb.jpg', '100x100', '300x300') AS artwork,
  'https://open.spotify.com/track/' || page_id AS track_page FROM pages""")
def url_rewrite(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        tx.larger_artwork(F.concat("url", F.lit("/100x100bb.jpg"))).alias("artwork"),
        F.concat(F.lit("https://open.spotify.com/track/"), F.col("page_id").cast("string")).alias("track_page"),
    )


@query("html_extract", """
SELECT page_id,
  nullif(nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), ''), 'null') AS title,
  nullif(nullif(regexp_extract(html, 'html lang="([^"]+)"', 1), ''), 'null') AS lang,
  nullif(nullif(regexp_extract(html, 'track\\((\\d+)\\)', 1), ''), 'null') AS track,
  contains(html, '<article>') AS has_marker
FROM pages""")
def html_extract(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        tx.first_group("html", "<title>([^<]+)</title>").alias("title"),
        tx.first_group("html", 'html lang="([^"]+)"').alias("lang"),
        tx.first_group("html", r"track\((\d+)\)").alias("track"),
        F.contains("html", F.lit("<article>")).alias("has_marker"),
    )


@query("html_best_url", """
WITH found AS (SELECT page_id, regexp_extract_all(html, 'href="/[^"]*"') AS urls FROM pages)
SELECT page_id, coalesce([x FOR x IN urls IF contains(x, 'tion')][1], urls[1]) AS best FROM found""")
def html_best_url(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.preferred_of("html", 'href="/[^"]*"', "tion").alias("best")
    )


_EMBED = """CASE WHEN p_size < 5 THEN '<html>' ELSE '<script id="__NEXT_DATA__">' END
  || '{"audioPreview": {"url":"' || CASE WHEN p_size < 10 THEN 'null' WHEN p_size < 15 THEN '' ELSE 'https://audio.example/' || p_partkey END
  || '"},"releaseDate":{"isoString":"' || CASE WHEN p_type = 'PROMO' THEN 'soon' ELSE '2011-03-0' || p_partkey END
  || '"},"art":["https://i.scdn.co/image/ab67616d00004851' || p_partkey || '","https://image-cdn-ak.spotifycdn.com/image/ab67616d00001e02' || p_partkey || '"]}'"""


@query("embed_fields", f"""
WITH e AS (SELECT p_partkey, p_size, p_type, {_EMBED} AS html FROM part)
SELECT p_partkey, CASE WHEN p_size >= 15 THEN 'https://audio.example/' || p_partkey END AS audio_url,
  CASE WHEN p_size >= 15 THEN 'https://image-cdn-ak.spotifycdn.com/image/ab67616d00001e02' || p_partkey END AS artwork_url,
  CASE WHEN p_size >= 15 AND p_type <> 'PROMO' THEN 2011 END AS year,
  CASE WHEN p_size < 5 THEN 'no_marker' WHEN p_size < 15 THEN 'null' ELSE 'hit' END AS status
FROM e""")
def embed_fields(spark, sf):
    part = table(spark, sf, "part").withColumn("html", F.expr(_EMBED))
    fields = tx.embed_fields("html")
    return part.select("p_partkey", fields["audio_url"], fields["artwork_url"], fields["year"], fields["status"])


@query("json_lists", """
SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0 ELSE 2 END AS n,
  CASE WHEN event_type IN ('error', 'click') THEN '[]' ELSE '["' || event_type || '","' || user_id || '"]' END AS encoded
FROM events""")
def json_lists(spark, sf):
    events = table(spark, sf, "events")
    raw = (
        F.when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("[\""), F.col("event_type")))
        .otherwise(F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    )
    listed = tx.json_list(raw)
    return events.select("event_id", F.size(listed).alias("n"), F.to_json(listed).alias("encoded"))


@query("md5_key", "SELECT doc_id, md5('documents_' || doc_id || '_' || lang) AS key, md5(text) AS content_key FROM documents")
def md5_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.cache_key(F.concat_ws("_", F.lit("documents"), F.col("doc_id").cast("string"), "lang")).alias("key"),
        tx.cache_key("text").alias("content_key"),
    )


@query("meta_line", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat_ws(' · ', CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN NULL ELSE 'Album ' || l_suppkey END,
            CASE WHEN l_linestatus = 'O' THEN CAST(year(l_shipdate) AS VARCHAR) END) AS line
FROM lineitem""")
def meta_line(spark, sf):
    album = F.when(F.col("l_returnflag") == "N", None).when(F.col("l_returnflag") == "A", "").otherwise(
        F.concat(F.lit("Album "), F.col("l_suppkey").cast("string"))
    )
    year = F.when(F.col("l_linestatus") == "O", F.year("l_shipdate"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.meta_line(album, year).alias("line")
    )
