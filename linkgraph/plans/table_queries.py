"""Queries of sources, incremental tables, discographies and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgraph.operators import discography as di
from linkgraph.operators import incremental as inc
from linkgraph.operators import projection as pr
from linkgraph.operators import reports as rp
from linkgraph.plans import roles as ro
from linkgraph.plans.graph_queries import _BUILD, _built
from linkgraph.plans.registry import query
from linkgraph.plans.roles import sql_fold, table
from linkgraph.session import materialize, scratch_path
from linkgraph.sources import graph_store, records
from linkgraph.sources import tables as src
from linkgraph.streaming import incremental as st

# --- sources -------------------------------------------------------------------

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _dump(spark, sf, short_rows):
    """The customer table as a dump file; some rows end early."""
    full = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(src.NULL_MARKER)) for c in _CUSTOMER])
    no_segment = F.concat_ws("\t", *[F.col(c).cast("string") for c in _CUSTOMER[:4]])
    marked = F.concat_ws("\t", *[F.col(c).cast("string") for c in _CUSTOMER[:4]], F.lit(src.NULL_MARKER))
    line = F.when(F.col("c_acctbal") < 0, no_segment if short_rows else marked).otherwise(full)
    path = scratch_path(spark, "dump")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return path


@query("scan_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def scan_tsv(spark, sf):
    return src.scan_tsv(spark, _dump(spark, sf, False), _CUSTOMER, ["c_custkey", "c_mktsegment"])


@query("scan_ragged_guard", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0")
def scan_ragged_guard(spark, sf):
    return src.scan_ragged(spark, _dump(spark, sf, True), _CUSTOMER, ["c_custkey", "c_mktsegment"])


@query("optional_source", "SELECT p_partkey AS entity_id, p_brand AS alias FROM part")
def optional_source(spark, sf):
    schema = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("alias", T.StringType())])
    staged = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias"))
    return staged.unionByName(src.optional_table(spark, f"{sf}/artist_alias.parquet", schema))


@query("conform_schema", f"""
SELECT p_partkey AS id, p_name AS name, CAST(0 AS BIGINT) AS popularity, '[]' AS genres, p_size AS degree, {sql_fold('p_name')} AS name_norm FROM part""")
def conform_schema(spark, sf):
    from linkgraph.functions.text import fold_name

    old = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("degree"), "p_brand"
    )
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("popularity", T.LongType()),
            T.StructField("genres", T.StringType()),
            T.StructField("degree", T.IntegerType()),
        ]
    )
    return src.conform(old, schema, {"popularity": 0, "genres": "[]"}).withColumn("name_norm", fold_name("name"))


_PROFILED = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
_PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, "
    f"CAST(coalesce(sum(strlen(concat_ws(chr(9), {columns.replace(' ', ', ')})) + 1), 0) AS BIGINT) AS n_bytes, true AS present FROM {name}"
    for name, columns in _PROFILED.items()
)


@query("table_profile", _PROFILE + " UNION ALL SELECT 'artist_alias', NULL, NULL, false")
def table_profile(spark, sf):
    """All tables of plain columns, and one that is absent."""
    tables = {name: table(spark, sf, name).select(*columns.split()) for name, columns in _PROFILED.items()}
    return src.profile(tables | {"artist_alias": None})


@query("graph_roundtrip", _BUILD + """,
ends AS (SELECT src AS id FROM ball UNION ALL SELECT dst FROM ball),
counted AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
SELECT src, dst, p_name AS name, degree FROM ball JOIN part ON p_partkey = src JOIN counted ON id = src""")
def graph_roundtrip(spark, sf):
    """Build, store, load by precedence, and read the stored edges."""
    path = scratch_path(spark, "graph")
    graph_store.save_graph(_built(spark, sf), path)
    graph = graph_store.load_graph(spark, ["", f"{path}-missing", path])
    degrees = graph.nodes.select(F.col("id").alias("src"), "name", "degree")
    return graph.edges.join(degrees, "src").select("src", "dst", "name", "degree")


def _named_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")


_LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


@query("parse_nested_credits", f"""
WITH lines AS (SELECT DISTINCT {_LINE_ID} AS record, l_partkey, l_suppkey, p_name, s_name
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT record, 'Line ' || record AS title, 'P' || l_partkey AS entity_id, p_name AS name, 0 AS pos FROM lines WHERE p_name NOT LIKE 'cold%'
UNION ALL SELECT record, 'Line ' || record, 'S' || l_suppkey, s_name, 1 FROM lines""")
def parse_nested_credits(spark, sf):
    def credit(id_text, name):
        return F.struct(F.struct(id_text.alias("id"), name.alias("name")).alias("artist"), F.lit(" & ").alias("joinphrase"))

    record = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    part_id = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    part_name = F.when(~F.startswith("p_name", F.lit("cold")), F.col("p_name"))
    supplier = credit(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.col("s_name"))
    # The part is credited twice, parts without a name are skipped.
    entries = F.array(credit(part_id, part_name), supplier, credit(part_id, part_name))
    documents = _named_lines(spark, sf).select(
        record.alias("record"),
        F.to_json(F.struct(F.concat(F.lit("Line "), record).alias("title"), entries.alias("artist-credit"))).alias("document"),
    )
    return records.parse_credits(documents, "record", "document")


@query("first_names", f"""
WITH lines AS (SELECT DISTINCT {_LINE_ID} AS record, l_partkey, l_suppkey, p_name, s_name
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
credits AS (
  SELECT record, 'P' || l_partkey AS entity_id, p_name AS name, 0 AS pos FROM lines WHERE p_name NOT LIKE 'cold%'
  UNION ALL SELECT record, 'S' || l_suppkey, s_name, 1 FROM lines)
SELECT entity_id, arg_min(name, row(record, pos, name)) AS name FROM credits GROUP BY entity_id""")
def first_names(spark, sf):
    """The name under which an entity was first credited, records in the order of their ids."""
    return records.first_names(parse_nested_credits(spark, sf), "record")


@query("flatten_nested", """
SELECT CAST(l_orderkey AS VARCHAR) AS album_id, CAST(l_linenumber AS VARCHAR) || t AS track_id, p_name AS track_name, pos,
  CASE WHEN pos = 0 THEN s_name ELSE p_name END AS artist_name
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey,
  (SELECT unnest(['a', 'b']) AS t), (SELECT unnest([0, 1]) AS pos)
WHERE l_returnflag <> 'A' AND (t = 'a' OR pos = 0)""")
def flatten_nested(spark, sf):
    def artist(key, name):
        return F.struct(F.col(key).cast("string").alias("id"), F.col(name).alias("name"))

    def track(suffix, *artists):
        return F.struct(
            F.concat(F.col("l_linenumber").cast("string"), F.lit(suffix)).alias("id"),
            F.col("p_name").alias("name"),
            F.array(*artists).alias("artists"),
        )

    supplier, part = artist("l_suppkey", "s_name"), artist("l_partkey", "p_name")
    album = F.struct(
        F.col("l_orderkey").cast("string").alias("id"),
        F.lit("Album").alias("name"),
        F.array(track("a", supplier, part), track("b", supplier)).alias("tracks"),
    )
    # The service answers some albums with null.
    text = F.when(F.col("l_returnflag") == "A", "[null]").otherwise(F.to_json(F.array(album)))
    flat = records.flatten_albums(_named_lines(spark, sf).select(text.alias("document")), "document")
    return flat.select("album_id", "track_id", "track_name", "pos", "artist_name")


@query("lookup_by_id", "SELECT o_orderkey AS id, p_name AS name, p_partkey IS NOT NULL AS known FROM orders LEFT JOIN part ON p_partkey = o_orderkey")
def lookup_by_id(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    stored = ro.entities(spark, sf).select("id", "name", F.lit(True).alias("known"))
    return keys.join(stored, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def type_counts(spark, sf):
    return rp.type_counts(table(spark, sf, "events"), "event_type")


# --- incremental -----------------------------------------------------------------


@query("upsert_entities", """
SELECT c_custkey AS id, c_name AS name, 'stored' AS origin FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT id, name, 'batch' FROM (SELECT o_custkey AS id, min_by(o_orderpriority, row(o_orderdate, o_orderkey)) AS name FROM orders GROUP BY 1)
WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def upsert_entities(spark, sf):
    stored = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("stored").alias("origin")
    )
    batch = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("batch").alias("origin"), "o_orderdate", "o_orderkey"
    )
    return inc.upsert_first(stored, batch, ["id"], F.struct("o_orderdate", "o_orderkey"))


@query("upsert_aliases", f"""
SELECT p_partkey AS entity_id, p_brand AS alias, {sql_fold('p_brand')} AS alias_norm FROM part WHERE p_size < 20
UNION SELECT l_partkey, p_brand, {sql_fold('p_brand')} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'
UNION SELECT l_partkey, p_type, {sql_fold('p_type')} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND p_type <> 'PROMO'""")
def upsert_aliases(spark, sf):
    from linkgraph.functions.text import fold_name

    part = table(spark, sf, "part")
    stored = part.filter("p_size < 20").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias"), fold_name("p_brand").alias("alias_norm")
    )
    mentioned = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(part, "p_partkey")
    text = F.when(F.col("l_returnflag") != "A", F.concat(F.lit(" "), "p_brand", F.lit("  "))).when(
        F.col("p_type") == "PROMO", "   "
    ).otherwise(F.col("p_type"))
    return inc.upsert_aliases(stored, mentioned.select(F.col("p_partkey").alias("entity_id"), text.alias("alias")))


@query("upsert_edges", """
SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, l_returnflag AS title FROM lineitem WHERE l_linestatus = 'F'
UNION SELECT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), l_returnflag FROM lineitem WHERE l_linestatus = 'O'""")
def upsert_edges(spark, sf):
    lines = table(spark, sf, "lineitem")
    stored = lines.filter("l_linestatus = 'F'").select(*pr.canonical_pair("l_suppkey", "l_partkey"), F.col("l_returnflag").alias("title")).distinct()
    batch = lines.filter("l_linestatus = 'O'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("title"))
    return inc.upsert_edges(stored, batch)


@query("apply_updates", """
SELECT p_partkey AS id, p_name AS name, CASE WHEN n IS NOT NULL THEN n ELSE CAST(p_size AS BIGINT) END AS popularity, n IS NOT NULL AS enriched
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON l_partkey = p_partkey""")
def apply_updates(spark, sf):
    stored = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("popularity"), F.lit(False).alias("enriched")
    )
    updates = table(spark, sf, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count(F.lit(1)).alias("popularity"), F.lit(True).alias("enriched")
    )
    return inc.apply_updates(stored, updates, "id", ["popularity", "enriched"])


_AS_OF = "2024-01-20 00:00:00"


@query("ttl_fresh", f"""
SELECT user_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS rn FROM events
  WHERE ts <= TIMESTAMP '{_AS_OF}') WHERE rn = 1 AND ts + INTERVAL 7 DAYS >= TIMESTAMP '{_AS_OF}'""")
def ttl_fresh(spark, sf):
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    seen = table(spark, sf, "events").select("user_id", "ts", "event_type", "value").filter(F.col("ts") <= as_of)
    return inc.fresh_entries(seen, "user_id", "ts", as_of)


@query("cache_split_batches", """
WITH cached AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 20) AS BIGINT) AS batch
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM cached)""")
def cache_split_batches(spark, sf):
    cached = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 300000").select(
        F.col("o_custkey").alias("c_custkey")
    )
    missing = table(spark, sf, "customer").select("c_custkey").join(cached, "c_custkey", "left_anti")
    return inc.numbered_batches(missing, "c_custkey", 20)


@query("trailing_rate", """
SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 4 AS exceeds FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def trailing_rate(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return inc.trailing_rate(events, "user_id", "ts", seconds=86_400, limit=4).select("event_id", "recent", "exceeds")


# --- streams ---------------------------------------------------------------------


@query("stream_rate", """
WITH spans AS (
  SELECT user_id, time_bucket(INTERVAL 30 MINUTES, ts) - off AS window_start FROM events, (SELECT unnest([INTERVAL 0 MINUTES, INTERVAL 30 MINUTES]) AS off))
SELECT window_start, window_start + INTERVAL 60 MINUTES AS window_end, user_id, count(*) AS recent FROM spans
GROUP BY ALL HAVING window_start + INTERVAL 60 MINUTES <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def stream_rate(spark, sf):
    """Hourly windows sliding by half an hour, closed by the watermark."""
    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet")
    stream = source.parquet(sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_path(spark, "stream-rate")
    st.append_available(st.sliding_rate(stream, "user_id", "ts", seconds=3600, slide=1800), out).awaitTermination()
    result = spark.read.parquet(f"{out}/table")
    return result.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "user_id",
        "recent",
    )


@query("stream_upsert", f"WITH {ro.SQL_EDGES} SELECT src, dst FROM edges")
def stream_upsert(spark, sf):
    """Edges kept up to date from a stream of memberships in several files."""
    staged = scratch_path(spark, "memberships")
    ro.members(spark, sf).repartition(3, "entity_id").write.parquet(staged)
    stream = spark.readStream.schema("group_id bigint, entity_id bigint").option("maxFilesPerTrigger", 1).parquet(staged)
    out = scratch_path(spark, "stream-edges")
    st.maintain_edges(stream, out).awaitTermination()
    return spark.read.parquet(f"{out}/edges").select("src", "dst")


# --- discography -------------------------------------------------------------------

# Suppliers are artists, orders are albums; the lines of one return flag are a
# track.  The first supplier of an order is its primary artist.  Every supplier is a hub.
_DISCO = """
WITH lines AS (
  SELECT l_orderkey AS album_id, l_returnflag AS track_id, l_suppkey AS artist_id, s_name AS artist_name, l_linenumber, l_partkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
hubs AS (SELECT s_suppkey AS hub_id, s_name AS hub_name FROM supplier),
about AS (
  SELECT album_id, min_by(artist_id, row(l_linenumber, l_partkey, artist_id)) AS primary_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'album' WHEN '2-HIGH' THEN 'single' WHEN '3-MEDIUM' THEN 'compilation' ELSE 'other' END AS album_type,
    o_orderdate AS release_date
  FROM lines JOIN orders ON o_orderkey = album_id GROUP BY album_id, o_orderpriority, o_orderdate),
albums AS (
  SELECT hub_id, about.*, primary_id = hub_id AS is_primary
  FROM (SELECT DISTINCT artist_id AS hub_id, album_id FROM lines) JOIN about USING (album_id)),
credits AS (SELECT DISTINCT album_id, track_id, artist_id, artist_name FROM lines),
names AS (
  SELECT album_id, track_id, 'Flag ' || track_id || ' (feat. ' || min(artist_name) || ' & Guest ' || track_id || ')' AS track_name
  FROM credits GROUP BY album_id, track_id)"""


def _sql_kept(albums: str) -> str:
    return f"""
kept AS (
  SELECT hub_id, c.*, track_name FROM credits c JOIN names USING (album_id, track_id) JOIN {albums} USING (album_id)
  WHERE is_primary OR (hub_id, c.album_id, c.track_id) IN (SELECT (artist_id, album_id, track_id) FROM credits))"""


_PREFERRED = """
preferred AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY hub_id, is_primary ORDER BY CASE album_type WHEN 'album' THEN 0 WHEN 'single' THEN 1
      WHEN 'compilation' THEN 2 ELSE 3 END, release_date, album_id) AS rn FROM albums)
  WHERE NOT is_primary OR rn <= 20)"""


def _disco(spark, sf):
    """Flagged albums by hub, tracks, and the hubs."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("album_id"), F.col("l_returnflag").alias("track_id"), F.col("l_suppkey").alias("artist_id"), "l_linenumber", "l_partkey"
    ).join(suppliers, "artist_id")
    kinds = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "album")
        .when(F.col("o_orderpriority") == "2-HIGH", "single")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "compilation")
        .otherwise("other")
    )
    albums = (
        lines.groupBy("album_id")
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "artist_id"))["artist_id"].alias("primary_id"))
        .join(
            table(spark, sf, "orders").select(
                F.col("o_orderkey").alias("album_id"), kinds.alias("album_type"), F.col("o_orderdate").alias("release_date")
            ),
            "album_id",
        )
    )
    credits = materialize(lines.select("album_id", "track_id", "artist_id", "artist_name").distinct(), "track-credits")
    names = credits.groupBy("album_id", "track_id").agg(F.min("artist_name").alias("lead")).select(
        "album_id",
        "track_id",
        F.concat(F.lit("Flag "), "track_id", F.lit(" (feat. "), "lead", F.lit(" & Guest "), "track_id", F.lit(")")).alias("track_name"),
    )
    tracks = credits.join(names, ["album_id", "track_id"]).withColumn("pos", F.col("artist_id"))
    hubs = suppliers.withColumnsRenamed({"artist_id": "hub_id", "artist_name": "hub_name"})
    return di.hub_albums(credits, albums, hubs), tracks, hubs


@query("own_vs_guest", _DISCO + " SELECT hub_id, album_id, album_type, is_primary FROM albums")
def own_vs_guest(spark, sf):
    albums, _, _ = _disco(spark, sf)
    return di.own_vs_guest(albums).select("hub_id", "album_id", "album_type", "is_primary")


@query("own_albums_capped", _DISCO + """
SELECT hub_id, album_id, album_type FROM (
  SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY album_id) AS rn FROM albums WHERE is_primary) WHERE rn <= 100""")
def own_albums_capped(spark, sf):
    albums, _, _ = _disco(spark, sf)
    return di.own_vs_guest(albums, own_only=True, max_total=100).select("hub_id", "album_id", "album_type")


@query("guest_track_filter", _DISCO + "," + _sql_kept("albums") + " SELECT hub_id, album_id, track_id, artist_id, track_name FROM kept")
def guest_track_filter(spark, sf):
    albums, tracks, _ = _disco(spark, sf)
    return di.guest_tracks(tracks, di.own_vs_guest(albums)).select("hub_id", "album_id", "track_id", "artist_id", "track_name")


@query("priority_topn", f"{_DISCO},{_PREFERRED} SELECT hub_id, album_id, is_primary FROM preferred")
def priority_topn(spark, sf):
    albums, _, _ = _disco(spark, sf)
    return di.prioritised(di.own_vs_guest(albums), 20).select("hub_id", "album_id", "is_primary")


def _counts_sql(kept: str) -> str:
    return f"""{_DISCO},{kept},
mentions AS (
  SELECT hub_id, lower(artist_name) AS key, artist_name AS name, artist_id AS id, track_name, album_id, track_id FROM kept
  WHERE artist_id <> hub_id
  UNION ALL
  SELECT hub_id, lower(n), n, NULL, track_name, album_id, track_id FROM (
    SELECT DISTINCT hub_id, album_id, track_id, track_name, unnest(list_value(trim(split_part(split_part(track_name, '(feat. ', 2), ' & ', 1)), 'Guest ' || track_id)) AS n FROM kept)
  JOIN hubs USING (hub_id) WHERE lower(n) <> lower(hub_name)),
counts AS (
  SELECT hub_id, key, min(name) AS name, min(id) AS id, count(*) AS appearances, count(DISTINCT track_name) AS tracks FROM mentions GROUP BY hub_id, key)"""


_COUNTS = _counts_sql(f"{_PREFERRED},{_sql_kept('preferred')}")
_ALL_COUNTS = _counts_sql(_sql_kept("albums"))


def _counted(spark, sf, max_own=None):
    """Tracks of own albums, all or the preferred ones, and of guest albums."""
    albums, tracks, hubs = _disco(spark, sf)
    chosen = di.prioritised(di.own_vs_guest(albums), max_own)
    return materialize(di.guest_tracks(tracks, chosen), "tracks"), hubs


@query("collaborator_counts", _COUNTS + " SELECT hub_id, key, name, id, appearances, tracks FROM counts")
def collaborator_counts(spark, sf):
    return di.collaborator_counts(*_counted(spark, sf, 20))


@query("top_collaborators", _ALL_COUNTS + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY appearances DESC, key) AS place FROM counts) WHERE place <= 15),
named AS (SELECT DISTINCT hub_id, key, track_name FROM mentions),
sampled AS (SELECT hub_id, key, string_agg(track_name, '; ' ORDER BY track_name) AS sample_tracks FROM (
  SELECT *, row_number() OVER (PARTITION BY hub_id, key ORDER BY track_name) AS rn FROM named) WHERE rn <= 2 GROUP BY hub_id, key)
SELECT hub_id, key, name, appearances, sample_tracks FROM top JOIN sampled USING (hub_id, key)""")
def top_collaborators(spark, sf):
    kept, hubs = _counted(spark, sf)
    told = di.mentions(kept, hubs)
    told = told._replace(rows=materialize(told.rows, "mentions"))
    top = di.top_collaborators(
        di.collaborator_counts(kept, hubs, mentioned=told), di.collaborator_tracks(kept, hubs, mentioned=told)
    )
    return top.withColumn("sample_tracks", F.array_join("sample_tracks", "; "))
