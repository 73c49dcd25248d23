"""Songs matched to external catalogs by title and artist.

Catalogs arrive as DataFrames; nothing here calls a service.  A candidate is
accepted only if its title and its artist both match, where matching means
containment of loose keys in either direction.  Both containments are found by
substring joins over distinct keys, and both sides are reduced to distinct
(title, artist) keys before they meet, so repeated songs or candidates cost
nothing extra.  A catalog is keyed and written once, its keys numbered in their
order; songs and matches move as numbers, a song with lists of its artists
instead of a row for each, and the winner's row is fetched last.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions.text import MIN_ARTIST_KEY, larger_artwork, loose_text, search_term, search_url, year_from
from linkgraph.operators.containment import substring_pairs
from linkgraph.operators.titles import first_rows
from linkgraph.session import materialize, write_counted

# Artists in one list of a song; a song with more has several.
LISTED_ARTISTS = 512

# Titles that a catalog has with more artists are not compared artist by artist, but looked up with each.
LIGHT_TITLE = 512

# Fixed value: "looked, found nothing", as opposed to NULL, "not looked yet".
NO_MATCH = "none"

# Providers in the order in which they are tried; the first is looked up by track id.
PROVIDERS = ("spotify", "itunes", "deezer")

STORE_SEARCH = "https://music.apple.com/us/search?term="
TRACK_PAGE = "https://open.spotify.com/track/"


def _either_way(asked: DataFrame, a: str, stored: DataFrame, s: str) -> DataFrame:
    """Distinct ``(a, s)`` key pairs where one contains the other."""
    inside = substring_pairs(asked, a, stored, s).select(F.col("needle").alias(a), F.col("text").alias(s))
    around = substring_pairs(stored, s, asked, a).select(F.col("text").alias(a), F.col("needle").alias(s))
    return inside.union(around).distinct()


class Catalog(NamedTuple):
    """Candidates by (``by``, title key, artist key): the first of each, numbered in their order by ``key``.

    ``shown`` makes the columns of a candidate from those that are stored, where these are
    shorter: the columns ``o0``, ``o1``, ... it was ranked by, and those that were kept, as ``row``.
    """

    keys: DataFrame
    by: tuple[str, ...]
    shown: Callable[[Column], Sequence[Column]] | None = None

    def rows(self) -> DataFrame:
        """``(key, best)``: the candidates' columns as a struct."""
        best = F.struct(*self.shown(F.col("cand"))) if self.shown else F.col("cand")
        return self.keys.select("key", best.alias("best"))


class GroupCredits(NamedTuple):
    """Credits of songs by reference: all songs of a group have its names.

    ``songs(song_id, group_id, title)``, ``names(group_id, artist)``.
    """

    songs: DataFrame
    names: DataFrame


def prepare_catalog(
    candidates: DataFrame,
    order: list[Column],
    by: tuple[str, ...] = (),
    keep: Sequence[str] | None = None,
    shown: Callable[[Column], Sequence[Column]] | None = None,
) -> Catalog:
    """``candidates(cand_title, cand_artist, ...)``, ranked by ``order``, separately for each value of ``by``.

    A row keeps the columns ``keep``, or all; they also decide between candidates of one order.
    """
    names = tuple(f"o{i}" for i in range(len(order)))
    kept = [F.col(c) for c in (candidates.columns if keep is None else keep)]
    ranked = candidates.select(
        *by,
        "cand_title",
        "cand_artist",
        F.struct(
            *[o.alias(name) for o, name in zip(order, names)],
            *([F.struct(*kept).alias("row")] if kept else []),
        ).alias("cand"),
    )
    # As rows of a generator, keys are worked out once for the filter and the aggregation.
    loose = F.struct(loose_text("cand_title").alias("ck_title"), loose_text("cand_artist").alias("ck_artist"))
    keyed = ranked.select(*by, F.inline(F.array(loose)), "cand").filter("ck_title <> '' AND ck_artist <> ''")
    best = keyed.groupBy(*by, "ck_title", "ck_artist").agg(F.min("cand").alias("cand"))
    # Ids ascend along the sorted partitions, so the smallest key is the first candidate.
    placed = best.orderBy(*[f"cand.{name}" for name in names], "ck_title", "ck_artist", *by)
    numbered = placed.withColumn("key", F.monotonically_increasing_id())
    if shown is None:
        numbered = numbered.withColumn("cand", F.col("cand.row"))
    return Catalog(materialize(numbered, "catalog"), by, shown)


def text_ids(texts: DataFrame, columns: Sequence[str] = ("title", "artist")) -> Column:
    """A hash of ``columns`` that tells all distinct ``texts(columns)`` apart."""
    for salt in count():
        number = F.xxhash64(F.lit(salt), *columns)
        if texts.groupBy(number.alias("id")).count().filter("count > 1").isEmpty():
            return number


def _by_song(credits: DataFrame | GroupCredits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``titles(t, title)`` and ``artists(a, artist)``, distinct and numbered, and songs as ``(song_id, t, artists)`` with lists of ``a``."""
    if isinstance(credits, GroupCredits):
        songs, by = credits.songs.filter("title IS NOT NULL"), ["group_id"]
        names = materialize(credits.names.filter("artist IS NOT NULL"), "credited-names")
    else:
        by = ["song_id", "title"]
        songs = names = materialize(
            credits.select("song_id", "title", "artist").filter("title IS NOT NULL AND artist IS NOT NULL"), "song-credits"
        )
    titles = materialize(songs.select("title").distinct(), "titles")
    artists = materialize(names.select("artist").distinct(), "artists")
    t, a = text_ids(titles, ["title"]).alias("t"), text_ids(artists, ["artist"]).alias("a")
    # Lists are of bounded length, however many names a song has.
    place = F.row_number().over(Window.partitionBy(*by).orderBy("a"))
    lists = names.select(*by, a).withColumn("part", F.floor((place - 1) / LISTED_ARTISTS))
    lists = lists.groupBy(*by, "part").agg(F.collect_set("a").alias("artists"))
    if isinstance(credits, GroupCredits):
        lists = songs.select("song_id", "group_id", t).join(lists, "group_id")
    return titles.select(t, "title"), artists.select(a, "artist"), lists.select("song_id", t if "title" in by else "t", "artists")


def accepted_keys(credits: DataFrame | GroupCredits, catalog: Catalog) -> DataFrame:
    """``(song_id, by, key)``: the accepted candidates of each song, the first for each of its artists.

    ``credits(song_id, title, artist)``, one row per credited name, so a song
    may have any number of them; or by reference.
    """
    by, keys = catalog.by, catalog.keys
    titles, artists, songs = _by_song(credits)
    titles = materialize(titles.select("t", loose_text("title").alias("sk_title")).filter("sk_title <> ''"), "title-keys")
    artists = artists.select("a", loose_text("artist").alias("sk_artist")).filter(F.length("sk_artist") >= MIN_ARTIST_KEY)
    artists = materialize(artists, "artist-keys")
    title_pairs = _either_way(titles, "sk_title", keys, "ck_title").join(titles, "sk_title").select("t", "ck_title")
    artist_pairs = _either_way(artists, "sk_artist", keys, "ck_artist").join(artists, "sk_artist").select("a", "ck_artist")
    # Titles meet artists only where the catalog has both in one candidate.
    met = keys.select(*by, "ck_title", "ck_artist", "key").join(artist_pairs, "ck_artist").drop("ck_artist").join(title_pairs, "ck_title")
    accepted = materialize(met.groupBy("t", "a", *by).agg(F.min("key").alias("key")), "accepted")

    heavy = accepted.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LIGHT_TITLE)
    heavy = write_counted(heavy.select("t"), "heavy-titles")
    found = ["song_id", *by, "key"]
    if not heavy.rows:
        return songs.join(accepted, "t").filter(F.array_contains("artists", F.col("a"))).select(*found)
    light = songs.join(accepted.join(heavy.table, "t", "left_anti"), "t").filter(F.array_contains("artists", F.col("a")))
    each = songs.join(heavy.table, "t", "left_semi").select("song_id", "t", F.explode("artists").alias("a"))
    return light.select(*found).unionByName(each.join(accepted, ["t", "a"]).select(*found))


def best_keys(credits: DataFrame | GroupCredits, catalog: Catalog) -> DataFrame:
    """``(song_id, by, key)``: the first accepted candidate of each song that has one, per value of the catalog's ``by``."""
    return accepted_keys(credits, catalog).groupBy("song_id", *catalog.by).agg(F.min("key").alias("key"))


def with_candidates(winners: DataFrame, catalog: Catalog) -> DataFrame:
    """``winners(song_id, by, key)`` with the candidate's columns as the struct ``best`` instead of its key."""
    return winners.join(catalog.rows(), "key").select("song_id", *catalog.by, "best")


def best_of(credits: DataFrame | GroupCredits, catalog: Catalog) -> DataFrame:
    """The candidates of ``best_keys`` with their columns as the struct ``best``."""
    return with_candidates(best_keys(credits, catalog), catalog)


def _song_bests(songs: DataFrame, credits: DataFrame | GroupCredits, catalog: Catalog, how: str) -> DataFrame:
    """``songs`` with their ``best`` of all; rows of songs and candidates each move by song and by key alone."""
    return songs.join(best_keys(credits, catalog), "song_id", how).join(catalog.rows(), "key", how).drop("key")


def best_candidates(
    credits: DataFrame | GroupCredits,
    candidates: DataFrame,
    order: list[Column],
    by: tuple[str, ...] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``best_of`` a catalog that is used once."""
    return best_of(credits, prepare_catalog(candidates, order, by, keep))


def playable_catalog(
    candidates: DataFrame,
    order: list[Column],
    keep: Sequence[str] | None = None,
    shown: Callable[[Column], Sequence[Column]] | None = None,
) -> Catalog:
    """The catalog of each provider; candidates without an audio link never win."""
    playable = candidates.filter(F.col("audio_url").isNotNull() & (F.col("audio_url") != ""))
    return prepare_catalog(playable, order, by=("provider",), keep=keep, shown=shown)


def song_matches(songs: DataFrame, credits: DataFrame | GroupCredits, catalog: Catalog) -> DataFrame:
    """``songs`` that have an accepted candidate, with the columns of the first."""
    return _song_bests(songs, credits, catalog, "inner").select(*songs.columns, "best.*")


def resolve_first_accepted(
    songs: DataFrame,
    credits: DataFrame | GroupCredits,
    candidates: DataFrame,
    order: list[Column],
    id_column: str,
    shown: Callable[[Column], Sequence[Column]] | None = None,
    along: Sequence[str] = (),
) -> DataFrame:
    """Every song with the first accepted candidate's id, or the sentinel, and the columns ``along`` of ``songs``.

    An id that is ``shown`` by what candidates are ranked by is not stored.
    """
    usable = candidates.filter(F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != ""))
    catalog = prepare_catalog(usable, order, keep=[] if shown else [id_column], shown=shown)
    found = _song_bests(songs, credits, catalog, "left")
    return found.select(
        "song_id",
        F.coalesce(F.col("best")[id_column].cast("string"), F.lit(NO_MATCH)).alias("track_id"),
        *along,
    )


def provider_waterfall(
    songs: DataFrame, credits: DataFrame | GroupCredits, embeds: DataFrame, catalog: Catalog, along: Sequence[str] = ()
) -> DataFrame:
    """The first provider with a playable preview for each song, and the columns ``along`` of ``songs``.

    ``songs(song_id, title, lead, track_id)`` with the first credited name as
    ``lead``; ``credits(song_id, title, artist)`` or by reference; ``embeds(track_id,
    audio_url, artwork_url, embed_year)`` is looked up by track id;
    the ``catalog`` of ``(provider, cand_title, cand_artist, audio_url, store_url,
    artwork_url, album, release_date)`` is matched.  A winner by track id takes its album,
    and a missing year, from the second provider, whose thumbnails are asked for in a larger size.
    """
    return _previews(songs, _by_provider(accepted_keys(credits, catalog)), embeds, catalog, along)


def _by_provider(found: DataFrame) -> DataFrame:
    """``(song_id, itunes, deezer)``: the first key of each catalog."""
    keys = [F.min(F.when(F.col("provider") == p, F.col("key"))).alias(p) for p in PROVIDERS[1:]]
    return found.groupBy("song_id").agg(*keys)


def _previews(songs: DataFrame, per_song: DataFrame, embeds: DataFrame, catalog: Catalog, along: Sequence[str] = ()) -> DataFrame:
    """``provider_waterfall`` of songs whose catalog matches ``per_song(song_id, itunes, deezer)`` are known.

    A song takes from one candidate at most, so one row of the catalogs is fetched for it.
    """
    usable_embeds = _usable(embeds).select(
        "track_id", F.struct("audio_url", "artwork_url", "embed_year").alias("embed")
    )
    tagged = songs.withColumn("track_id", _known_track())
    # Songs without a track id are not dealt out by it.
    embedded = tagged.filter("track_id IS NOT NULL").join(usable_embeds, "track_id", "left")
    plain = tagged.filter("track_id IS NULL").withColumn("embed", F.lit(None).cast(usable_embeds.schema["embed"].dataType))
    known = embedded.unionByName(plain).join(per_song, "song_id", "left")
    joined = known.withColumn("key", F.coalesce("itunes", "deezer")).drop("deezer").join(catalog.rows(), "key", "left")
    # Of a song with an embed, only a candidate of the second provider has a say.
    itunes = F.when(F.col("itunes").isNotNull(), F.col("best"))
    deezer = F.when(F.col("itunes").isNull(), F.col("best"))

    def pick(embed: Column, catalog: str | None, deezer_value: Column | None = None) -> Column:
        second = itunes[catalog] if catalog else F.lit(None)
        third = deezer_value if deezer_value is not None else (deezer[catalog] if catalog else F.lit(None))
        return (
            F.when(F.col("embed").isNotNull(), embed)
            .when(itunes.isNotNull(), second)
            .when(deezer.isNotNull(), third)
        )

    return joined.select(
        "song_id",
        F.when(F.col("embed").isNotNull(), PROVIDERS[0])
        .when(itunes.isNotNull(), "itunes")
        .when(deezer.isNotNull(), "deezer")
        .alias("source"),
        pick(F.col("embed.audio_url"), "audio_url").alias("audio_url"),
        F.when(F.col("embed").isNotNull(), F.col("embed.artwork_url"))
        .when(itunes.isNotNull(), larger_artwork(itunes["artwork_url"]))
        .when(deezer.isNotNull(), deezer["artwork_url"])
        .alias("artwork_url"),
        pick(F.col("title"), "cand_title").alias("matched_title"),
        pick(F.col("lead"), "cand_artist").alias("matched_artist"),
        pick(F.concat(F.lit(TRACK_PAGE), F.col("track_id").cast("string")), "store_url").alias("store_url"),
        pick(itunes["album"], "album").alias("album"),
        F.when(F.col("embed").isNotNull(), F.coalesce(F.col("embed.embed_year"), year_from(itunes["release_date"])))
        .when(itunes.isNotNull(), year_from(itunes["release_date"]))
        .alias("year"),
        *along,
    )


def _usable(embeds: DataFrame) -> DataFrame:
    return embeds.filter(F.col("audio_url").isNotNull())


def embedded_songs(songs: DataFrame, embeds: DataFrame) -> DataFrame:
    """The ``songs(track_id, ...)`` that ``provider_waterfall`` finds at the first provider."""
    heard = _usable(embeds).select("track_id")
    return songs.filter(_known_track().isNotNull()).join(heard, "track_id", "left_semi").select(*songs.columns)


def _known_track() -> Column:
    return F.nullif("track_id", F.lit(NO_MATCH))


PREVIEW = ("source", "audio_url", "artwork_url", "matched_title", "matched_artist", "store_url", "album", "year")


def credited_names(references: DataFrame, names: DataFrame, songs: DataFrame) -> DataFrame:
    """``(song_id, artist)`` of ``songs``, expanded from ``references(song_id, group_id)`` and ``names(group_id, artist)``."""
    behind = references.join(songs.select("song_id"), "song_id", "left_semi")
    return behind.join(names, "group_id").select("song_id", "artist").distinct()


def walk_edges(
    requests: DataFrame, titles: DataFrame, references: DataFrame, names: DataFrame, embeds: DataFrame, catalog: Catalog
) -> DataFrame:
    """Try the titles of each requested edge by rank, until one has a preview.

    ``requests(src, dst)``; ``titles(src, dst, song_id, title, lead, track_id, rank, preview_source)``;
    line-ups by reference.  One row per title that was tried, with its preview
    (``source`` is null where there was none): an edge's titles up to its first
    hit.  Titles that are known to have none are passed over.  Names are matched
    once for each title of a group, however many edges show it; a song's
    candidate is the first of its groups', and only tried titles fetch its row.
    """
    wanted = titles.filter((F.col("rank") >= 1) & ~F.col("preview_source").eqNullSafe(NO_MATCH))
    asked = materialize(wanted.join(requests.select("src", "dst").distinct(), ["src", "dst"], "left_semi"), "asked-titles")
    behind = materialize(references.join(asked.select("song_id", "title").distinct(), "song_id"), "groups-behind")
    found = _group_keys(behind.select("group_id", "title").distinct(), names, catalog)
    winners = behind.join(found, ["group_id", "title"]).groupBy("song_id", "provider").agg(F.min("key").alias("key"))
    winners = materialize(winners, "winners")

    playable = winners.select("song_id").distinct().withColumn("matched", F.lit(True))
    heard = _usable(embeds).select("track_id").distinct().withColumn("heard", F.lit(True))
    placed = asked.select("song_id", "src", "dst", "rank", _known_track().alias("track_id"))
    hits = placed.join(heard, "track_id", "left").join(playable, "song_id", "left").filter("heard OR matched")
    first = hits.groupBy("src", "dst").agg(F.min("rank").alias("first"))
    songs = asked.join(first, ["src", "dst"], "left").filter("first IS NULL OR rank <= first").drop("first")
    songs = materialize(songs, "round")
    previews = _previews(songs.select("song_id", "title", "lead", "track_id"), _by_provider(winners), embeds, catalog)
    return materialize(songs.drop("track_id").join(previews, "song_id"), "tried")


def _group_keys(titles: DataFrame, names: DataFrame, catalog: Catalog) -> DataFrame:
    """``(group_id, title, provider, key)``: the providers' first candidates for each of ``titles(group_id, title)``."""
    looked_up = materialize(titles.withColumn("song_id", F.monotonically_increasing_id()), "looked-up")
    found = best_keys(GroupCredits(looked_up, names), catalog)
    return looked_up.join(found.filter(F.col("provider").isin(*PROVIDERS[1:])), "song_id").drop("song_id")


def edge_first_match(requests: DataFrame, titles: DataFrame, tried: DataFrame) -> DataFrame:
    """The first playable title of each requested edge, else a search link for its first title.

    ``tried`` comes from ``walk_edges``.  ``song_id`` tells whose line-up to show; a pair without titles yields NULLs.
    """
    asked = requests.select("src", "dst").distinct()
    first = titles.groupBy("src", "dst").agg(F.min_by(F.struct("song_id", "title", "lead"), "rank").alias("first"))
    values = [c for c in PREVIEW if not c.startswith("matched_")]
    hit = tried.filter("source IS NOT NULL").select("src", "dst", F.struct("song_id", "title", *values).alias("hit"))
    joined = asked.join(first, ["src", "dst"], "left").join(hit, ["src", "dst"], "left")
    term = F.trim(F.concat_ws(" ", "first.title", "first.lead"))
    return joined.select(
        "src",
        "dst",
        F.coalesce("hit.song_id", "first.song_id").alias("song_id"),
        F.coalesce("hit.title", "first.title").alias("song"),
        *[F.col(f"hit.{c}").alias(c) for c in values],
        F.when(F.col("hit").isNull() & F.col("first").isNotNull(), search_url(STORE_SEARCH, term)).alias("fallback_url"),
    )


def mark_checked(titles: DataFrame, tried: DataFrame) -> DataFrame:
    """Record the winning source, or "none", on titles that were looked up for the first time.

    ``tried`` has a row for each attempt; a title without one stays as it was.
    """
    won = tried.groupBy("song_id").agg(F.coalesce(F.min("source"), F.lit(NO_MATCH)).alias("won"))
    return titles.join(won, "song_id", "left").withColumn(
        "preview_source", F.coalesce("preview_source", "won")
    ).drop("won")


def any_hit_coverage(songs: DataFrame, credits: DataFrame, known: DataFrame, tried: int = 4) -> DataFrame:
    """Share of songs for which any of the first distinct credited names and
    the title are known to a catalog, with the decision band.

    ``songs(song_id)``; ``credits(song_id, title, artist, pos)`` in credit
    order; ``known(artist, title)``.  Songs of one group share its names:
    ``songs(song_id, group_id, title)``, of which a group has each title once,
    with ``credits(group_id, artist, pos)``.
    """
    shared = "group_id" in credits.columns
    by, song = (["group_id"], ["group_id", "title"]) if shared else (["song_id"], ["song_id"])
    named = credits.filter("artist <> ''").groupBy(*by, *([] if shared else ["title"]), "artist").agg(F.min("pos").alias("pos"))
    probes = first_rows(named, by, ["pos", "artist"], tried).drop("pos", "rank")
    if shared:
        probes = probes.join(songs.select(*song).distinct(), by)
    probes = materialize(probes, "probes")
    hits = probes.join(known.select("artist", "title").distinct(), ["artist", "title"], "left_semi").select(*song).distinct()
    sent = probes.agg(F.count(F.lit(1)).alias("rows_sent"))
    totals = hits.agg(F.count(F.lit(1)).alias("songs_hit")).withColumn("rows_sent", sent.scalar())
    # Songs without any credited name send no probe but still count.
    everything = songs.agg(F.count(F.lit(1)).alias("songs"))
    percent = F.coalesce(F.try_divide(F.lit(100.0) * F.col("songs_hit"), F.col("songs")), F.lit(0.0))
    return totals.withColumn("songs", everything.scalar()).select(
        "songs",
        "songs_hit",
        "rows_sent",
        percent.alias("percent"),
        F.when(percent >= 60, "offline").when(percent < 40, "lazy").otherwise("judgment").alias("band"),
    )


def outcome_tally(attempts: DataFrame, status: str) -> DataFrame:
    """Outcome counts of a preview trial and the verdict on it.

    ``attempts`` has one row per song; NULL status means it had no track id.
    """
    def count_of(value: str) -> Column:
        return F.count_if(F.col(status) == value)

    tallied = attempts.agg(
        F.count(F.lit(1)).alias("songs"),
        F.count(status).alias("tried"),
        *[count_of(v).alias(f"n_{v}") for v in ("hit", "null", "no_marker", "http_err", "error")],
    )
    rate = F.coalesce(F.try_divide(F.col("n_hit") * 100.0, F.col("tried")), F.lit(0.0))
    blocked = F.col("n_http_err") + F.col("n_error")
    allowed = F.greatest(F.lit(1.0), F.col("tried") * 0.1)
    return tallied.select(
        "*",
        rate.alias("hit_rate"),
        F.coalesce(F.try_divide(F.col("n_hit") * 100.0, F.col("songs")), F.lit(0.0)).alias("overall_rate"),
        F.when((rate >= 60) & (blocked <= allowed), "GO").when(rate >= 30, "PARTIAL").otherwise("NO-GO").alias("verdict"),
    )


def song_terms(songs: DataFrame) -> DataFrame:
    """The text a song would be searched by."""
    return songs.select("song_id", search_term("title", "artists").alias("term"))
