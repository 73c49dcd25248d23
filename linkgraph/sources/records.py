"""Nested JSON records flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column

CREDIT_SCHEMA = (
    "struct<title:string,"
    "`artist-credit`:array<struct<artist:struct<id:string,name:string>,name:string,joinphrase:string>>>"
)

ALBUM_SCHEMA = (
    "array<struct<id:string,name:string,"
    "tracks:array<struct<id:string,name:string,artists:array<struct<id:string,name:string>>>>>>"
)


def parse_credits(records: DataFrame, key: str, document: ColumnLike) -> DataFrame:
    """Credited entities of each JSON record, once per entity, in credit order.

    Entries without an id or a name are skipped; an entity credited twice
    keeps its first position and the name given there.
    """
    parsed = records.select(
        F.col(key), F.from_json(as_column(document), CREDIT_SCHEMA).alias("doc")
    )
    entries = parsed.select(
        key,
        F.col("doc.title").alias("title"),
        F.posexplode("doc.artist-credit").alias("pos", "entry"),
    ).select(
        key,
        "title",
        "pos",
        F.col("entry.artist.id").alias("entity_id"),
        F.col("entry.artist.name").alias("name"),
    )
    named = entries.filter((F.col("entity_id") != "") & (F.col("name") != ""))
    return (
        named.groupBy(key, "entity_id")
        .agg(F.min(F.struct("pos", "name", "title")).alias("first"))
        .select(key, "first.title", "entity_id", "first.name", "first.pos")
    )


def first_names(credits: DataFrame, arrival: ColumnLike) -> DataFrame:
    """One display name per entity: the one that arrived first."""
    return credits.groupBy("entity_id").agg(
        F.min(F.struct(as_column(arrival).alias("arrival"), F.col("pos"), F.col("name")))["name"].alias("name")
    )


def flatten_albums(responses: DataFrame, document: ColumnLike) -> DataFrame:
    """(album, track, artist) rows of a batched album response.

    Albums the service answered with ``null`` are skipped.
    """
    albums = responses.select(
        F.explode(F.from_json(as_column(document), ALBUM_SCHEMA)).alias("album")
    ).filter(F.col("album").isNotNull())
    tracks = albums.select(F.col("album.id").alias("album_id"), F.explode("album.tracks").alias("track"))
    return tracks.select(
        "album_id",
        F.col("track.id").alias("track_id"),
        F.col("track.name").alias("track_name"),
        F.posexplode("track.artists").alias("pos", "artist"),
    ).select(
        "album_id",
        "track_id",
        "track_name",
        "pos",
        F.col("artist.id").alias("artist_id"),
        F.col("artist.name").alias("artist_name"),
    )
