"""Matching, enrichment, incremental tables, reports and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgraph.functions import text as tx
from linkgraph.operators import discography as di
from linkgraph.operators import enrichment as en
from linkgraph.operators import incremental as inc
from linkgraph.operators import matching as ma
from linkgraph.plans import matching_queries as mq
from linkgraph.operators import reports as rp
from linkgraph.session import materialize
from linkgraph.plans.catalog import REGISTRY
from linkgraph.sources import records
from linkgraph.sources import tables as src
from linkgraph.streaming import incremental as stream

SONGS = "song_id string, title string, artists array<string>, track_id string, lead string"
CANDS = "provider string, cand_title string, cand_artist string, audio_url string, store_url string, artwork_url string, album string, release_date string, pos int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame(
        [
            ("s1", "Night Drive", ["Ana Bo", "Cee Dee"], "T1", "Ana Bo"),
            ("s2", "Really Now (Remix)", ["Ana Bo"], None, "Ana Bo"),
            ("s3", "No Match", ["Ana Bo"], "none", "Ana Bo"),
            ("s4", "Night Drive", ["Xy"], None, "Xy"),
            ("s5", "Deep Cut", ["Cee Dee"], "T5", "Cee Dee"),
        ],
        SONGS,
    )


@pytest.fixture(scope="module")
def credits(songs):
    return songs.select("song_id", "title", F.posexplode("artists").alias("pos", "artist"))


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(
        [
            ("itunes", "Night Drive", "Stranger", "u0", None, None, "X", "1999-01-01", 0),
            ("itunes", "Night Drive (Remastered)", "Ana Bo & Friends", "u1", "st1", "a100x100", "Album One", "2005-08-29", 1),
            ("itunes", "Really Now", "Ana Bo", None, None, None, "No Link", "2001-01-01", 2),
            ("deezer", "Really Now", "Ana Bo", "u3", "st3", None, "D Album", None, 3),
            ("deezer", "Really", "Ana Bo", "u4", None, None, None, None, 4),
            ("deezer", "Deep Cut", "Cee Dee", "u5", None, None, "DC", None, 5),
        ],
        CANDS,
    )


def test_best_candidates_agrees_with_the_predicate(songs, credits, candidates):
    best = ma.best_candidates(credits, candidates, [F.col("pos")])
    got = {r["song_id"]: r["best"]["pos"] for r in best.collect()}
    # Every pair against the plain predicate, on a fixture this small.
    pairs = songs.join(candidates, tx.accepts("title", "artists", "cand_title", "cand_artist"))
    assert got == {r["song_id"]: r["p"] for r in pairs.groupBy("song_id").agg(F.min("pos").alias("p")).collect()}
    assert got == {"s1": 1, "s2": 2, "s5": 5}


@pytest.mark.parametrize("light, listed", [(0, 512), (1, 1), (512, 1)])
def test_titles_of_many_artists_and_songs_of_many_names_are_matched_alike(songs, credits, candidates, monkeypatch, light, listed):
    monkeypatch.setattr(ma, "LIGHT_TITLE", light)
    monkeypatch.setattr(ma, "LISTED_ARTISTS", listed)
    best = ma.best_candidates(credits, candidates, [F.col("pos")], by=("provider",))
    assert {(r["song_id"], r["provider"]): r["best"]["pos"] for r in best.collect()} == {
        ("s1", "itunes"): 1, ("s2", "itunes"): 2, ("s2", "deezer"): 3, ("s5", "deezer"): 5,
    }


def test_songs_of_a_group_are_matched_without_a_row_for_each_name(spark, candidates, monkeypatch):
    written = {}
    monkeypatch.setattr(ma, "materialize", lambda df, label: written.setdefault(label, materialize(df, label)))
    songs = spark.range(40).selectExpr("id AS song_id", "1L AS group_id", "if(id = 7, 'Deep Cut', concat('Song ', id)) AS title")
    names = spark.range(30).selectExpr("1L AS group_id", "if(id = 9, 'Cee Dee', concat('Name ', id)) AS artist")
    best = ma.best_candidates(ma.GroupCredits(songs, names), candidates, [F.col("pos")])
    assert [(r["song_id"], r["best"]["pos"]) for r in best.collect()] == [(7, 5)]
    assert max(table.count() for table in written.values()) == 40


def test_catalog_is_numbered_in_its_order_and_keeps_the_columns_asked_for(spark, candidates):
    keys = ma.prepare_catalog(candidates.repartition(3), [F.col("pos")], keep=["audio_url"]).keys
    assert keys.schema["cand"].dataType.names == ["audio_url"]
    # one row a key; "Really Now" by Ana Bo is first without a link
    assert [r["cand"]["audio_url"] for r in keys.orderBy("key").collect()] == ["u0", "u1", None, "u4", "u5"]
    texts = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), ("c", "ab")], "title string, artist string")
    assert texts.select(ma.text_ids(texts).alias("n")).distinct().count() == 4


def test_matching_moves_songs_as_numbers(spark, star):
    best = ma.best_candidates(mq._numbered_credits(spark, star, mq._numbered(mq._songs(spark, star))), mq._candidates(spark, star, "false"), mq._order(), keep=["audio_url"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(song_id" in plan and "title#" not in plan.split("hashpartitioning(song_id")[1].split("\n")[0]
    assert best.schema["song_id"].dataType.typeName() == "long"


def test_repeated_orders_name_a_song_once(spark, star):
    again = spark.read.parquet(f"{star}/orders.parquet")
    again.union(again).coalesce(1).write.parquet(f"{star}/twice")
    orders = materialize(spark.read.parquet(f"{star}/twice"), "twice")
    orders.write.mode("overwrite").parquet(f"{star}/orders.parquet")
    assert rows(mq.catalog_match(spark, star)) == [("10|Acme", "https://audio.example/10-1-1")]
    assert len(rows(mq.resolve_first_accepted(spark, star))) == 4


def test_rows_of_repeated_orders_meet_by_their_song(spark, star):
    again = spark.read.parquet(f"{star}/orders.parquet")
    orders = materialize(again.union(again), "twice")
    orders.write.mode("overwrite").parquet(f"{star}/orders.parquet")
    # Two rows of a song, with two outcomes and two matches each.
    assert len(rows(mq.enrich_track_ids(spark, star))) == 2 * 8


def test_first_accepted_or_sentinel(songs, credits, candidates):
    got = ma.resolve_first_accepted(songs, credits, candidates, [F.col("pos")], "audio_url")
    assert rows(got) == [("s1", "u1"), ("s2", "u3"), ("s3", "none"), ("s4", "none"), ("s5", "u5")]


@pytest.fixture
def star(spark, tmp_path):
    """Two orders of one supplier in the red; the second order's part has no name on record."""
    made = {
        "part": [("p_partkey long, p_name string, p_brand string, p_type string"), [(1, "hot bolt", "B", "SMALL")]],
        "supplier": [("s_suppkey long, s_name string, s_acctbal double"), [(7, "Acme", -5.0)]],
        "orders": [("o_orderkey long, o_orderpriority string, o_orderstatus string"), [(10, "5-LOW", "O"), (11, "5-LOW", "O")]],
        "lineitem": [
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_tax double, l_shipdate timestamp_ntz",
            [(10, 1, 1, 7, "N", "F", 0.05, None), (11, 1, 2, 7, "N", "F", 0.05, None)],
        ],
    }
    for name, (schema, data) in made.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_audio_of_every_supplier_and_songs_without_names_take_part(spark, star):
    url = "https://audio.example/10-1-1"
    assert rows(mq.catalog_match(spark, star)) == [("10|Acme", url)]
    assert rows(mq.resolve_first_accepted(spark, star)) == [("10|Acme", url), ("11|Acme", "none")]
    assert rows(mq.enrich_track_ids(spark, star)) == [("10|Acme", url, "resolved"), ("11|Acme", "none", "sentinel")]


def test_waterfall_order_links_and_backfill(spark, songs, credits, candidates):
    embeds = spark.createDataFrame(
        [("T1", "e1", "art", None), ("T5", None, None, None), ("none", "never", None, None)],
        "track_id string, audio_url string, artwork_url string, embed_year int",
    )
    catalog = ma.playable_catalog(candidates, [F.col("pos")])
    got = {r["song_id"]: r for r in ma.provider_waterfall(songs, credits, embeds, catalog).collect()}
    first = got["s1"]
    assert (first["source"], first["audio_url"], first["album"], first["year"]) == ("spotify", "e1", "Album One", 2005)
    assert first["artwork_url"] == "art"
    assert (first["matched_title"], first["matched_artist"], first["store_url"]) == ("Night Drive", "Ana Bo", ma.TRACK_PAGE + "T1")
    assert (got["s2"]["source"], got["s2"]["album"], got["s2"]["year"]) == ("deezer", "D Album", None)
    assert (got["s5"]["source"], got["s3"]["source"], got["s4"]["source"]) == ("deezer", None, None)

    titles = songs.select("song_id", F.when(F.col("song_id") == "s2", "itunes").alias("preview_source"))
    marked = dict(rows(ma.mark_checked(titles, ma.provider_waterfall(songs, credits, embeds, catalog)).select("song_id", "preview_source")))
    assert marked == {"s1": "spotify", "s2": "itunes", "s3": "none", "s4": "none", "s5": "deezer"}


def test_songs_of_the_first_provider_are_told_by_their_embeds(spark):
    songs = spark.createDataFrame([(1, "T1"), (2, None), (3, "none"), (4, "T4"), (5, "T5")], "song_id long, track_id string")
    embeds = spark.createDataFrame([("T1", "e1"), ("T1", "e1"), ("T4", None), ("none", "never")], "track_id string, audio_url string")
    assert rows(ma.embedded_songs(songs, embeds)) == [(1, "T1")]


def test_titles_nobody_looked_up_stay_unmarked(spark):
    titles = spark.createDataFrame([("a", None), ("b", None), ("c", "itunes"), ("d", None)], "song_id string, preview_source string")
    previews = spark.createDataFrame([("a", None), ("c", None), ("d", "deezer")], "song_id string, source string")
    assert dict(rows(ma.mark_checked(titles, previews))) == {"a": "none", "b": None, "c": "itunes", "d": "deezer"}


def test_edges_are_walked_to_their_first_hit(spark):
    titles = spark.createDataFrame(
        [
            ("a", "b", "x1", "First", "Ana", "none", 1, None), ("a", "b", "x2", "Second", "Ana", None, 2, None), ("a", "b", "x5", "Third", "Ana", None, 3, None),
            ("a", "c", "x3", "Only & One", "Bo", None, 1, None), ("a", "d", "x4", "Checked", "Cy", None, 1, "none"),
            ("a", "e", "x6", "By Id", "Ana", "T6", 1, None), ("a", "e", "x7", "Second", "Ana", None, 2, "deezer"),
            ("x", "y", "x8", "Second", "Ana", None, 1, None), ("a", "f", "x9", "Second", "Ana", None, 1, "itunes"),
        ],
        "src string, dst string, song_id string, title string, lead string, track_id string, rank int, preview_source string",
    )
    references = spark.createDataFrame(
        [("x1", 1), ("x2", 1), ("x2", 2), ("x3", 3), ("x4", 1), ("x5", 1), ("x6", 1), ("x7", 1), ("x8", 1), ("x9", 1)], "song_id string, group_id long"
    )
    names = spark.createDataFrame([(1, "Ana"), (1, "Bo Dee"), (2, "Ana"), (2, "Cleo"), (3, "Bo Dee")], "group_id long, artist string")
    embeds = spark.createDataFrame([("T6", "e6", "art6", 1999)], "track_id string, audio_url string, artwork_url string, embed_year int")
    candidates = spark.createDataFrame(
        [
            ("itunes", "Second", "Cleo", "u2", "st2", "x/100x100.jpg", "Al", "2001-02-03", 0), ("deezer", "Third", "Ana", "u5", None, None, None, None, 1),
            ("deezer", "Checked", "Ana", "u4", None, None, None, None, 2), ("itunes", "Second", "Ana", "u9", None, "x/100x100.jpg", "Al", "soon", 3),
        ],
        CANDS,
    )
    requests = spark.createDataFrame([("a", x) for x in "bcdef"] + [("b", "c")], "src string, dst string")
    catalog = ma.playable_catalog(candidates, [F.col("pos")])
    tried = materialize(ma.walk_edges(requests, titles, references, names, embeds, catalog), "tried")
    assert sorted(r["song_id"] for r in tried.collect()) == ["x1", "x2", "x3", "x6", "x9"]  # not the third, the known and the unasked one
    got = {(r["src"], r["dst"]): tuple(r)[2:] for r in ma.edge_first_match(requests, titles, tried).collect()}
    assert got == {
        ("a", "b"): ("x2", "Second", "itunes", "u2", "x/300x300.jpg", "st2", "Al", 2001, None),
        ("a", "c"): ("x3", "Only & One", *[None] * 6, ma.STORE_SEARCH + "Only+%26+One+Bo"),
        ("a", "d"): ("x4", "Checked", *[None] * 6, ma.STORE_SEARCH + "Checked+Cy"),
        ("a", "e"): ("x6", "By Id", "spotify", "e6", "art6", ma.TRACK_PAGE + "T6", None, 1999, None),
        ("a", "f"): ("x9", "Second", "itunes", "u9", "x/300x300.jpg", None, "Al", None, None),
        ("b", "c"): (None,) * 9,
    }
    marks = dict(rows(ma.mark_checked(titles, tried).select("song_id", "preview_source")))
    assert marks == {"x1": "none", "x2": "itunes", "x3": "none", "x4": "none", "x5": None, "x6": "spotify", "x7": "deezer", "x8": None, "x9": "itunes"}
    assert ma.walk_edges(requests, titles.limit(0), references, names, embeds, catalog).count() == 0


def test_titles_of_a_group_are_walked_once_for_all_its_pairs(spark, tmp_path, monkeypatch):
    lines = [(10, n, n, 7, "N") for n in range(1, 6)] + [(11, 1, 1, 7, "R"), (11, 2, 2, 8, "N"), (12, 1, 9, 7, "N"), (12, 2, 1, 8, "A")]
    made = {
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(n, f"bolt {n}", "B", "SMALL", 1, 1.0) for n in range(1, 10)]),
        "supplier": ("s_suppkey long, s_name string, s_acctbal double", [(7, "Acme", 5.0), (8, "Bold", 5.0)]),
        "orders": ("o_orderkey long, o_orderpriority string, o_orderstatus string", [(k, "5-LOW", "O") for k in (10, 11, 12)]),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_tax double, l_shipdate timestamp_ntz",
            [(*line, "F", 0.05, None) for line in lines],
        ),
    }
    for name, (schema, data) in made.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    walked, walk = [], ma.walk_edges
    monkeypatch.setattr(ma, "walk_edges", lambda requests, titles, *rest: walked.append(titles) or walk(requests, titles, *rest))
    got = {(r["src"], r["dst"]): (r["song"], r["artists"], r["audio_url"]) for r in mq.edge_first_match(spark, str(tmp_path)).collect()}
    # Nine pairs of the first order share it alone, one shares two; the hub meets parts it has no order with too.
    assert walked[0].filter("src = 10").count() == 1 and walked[0].count() == 7
    url = "https://audio.example/10-{0}-{0}"
    assert got[(3, 4)] == ("Acme", "bolt 1, bolt 2, bolt 3, bolt 4, bolt 5", url.format(1))
    assert got[(1, 2)][0] == "Acme" and got[(1, 9)][:2] == ("Acme", "bolt 1, bolt 9") and got[(1, 6)] == (None, None, None)
    assert len(got) == 10 + 1 + 3
    marks = dict(rows(mq.mark_checked(spark, str(tmp_path))))
    assert marks["3|4|Acme"] == "deezer" and len(marks) == 9 + 2 + 2


def test_a_walk_writes_no_more_tables_for_more_ranks(spark, candidates, monkeypatch):
    def written(ranks):
        labels = []
        monkeypatch.setattr(ma, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
        titles = spark.createDataFrame(
            [("a", "b", f"x{r}", f"Unknown {r}", "Ana", None, r, None) for r in range(1, ranks + 1)],
            "src string, dst string, song_id string, title string, lead string, track_id string, rank int, preview_source string",
        )
        references = titles.select("song_id", F.lit(1).cast("bigint").alias("group_id"))
        names = spark.createDataFrame([(1, "Ana Bo")], "group_id long, artist string")
        embeds = spark.createDataFrame([], "track_id string, audio_url string, artwork_url string, embed_year int")
        catalog = ma.playable_catalog(candidates, [F.col("pos")])
        labels.clear()
        tried = ma.walk_edges(titles.select("src", "dst"), titles, references, names, embeds, catalog)
        assert tried.count() == ranks
        return labels

    assert written(1) == written(4)


def test_songs_of_a_group_share_its_names(spark):
    songs = spark.createDataFrame(
        [("1|A", 1, "A"), ("1|B", 1, "B"), ("2|A", 2, "A"), ("3|A", 3, "A"), ("3|A", 3, "A"), ("4", 4, None)], "song_id string, group_id long, title string"
    )
    credits = spark.createDataFrame(
        [(1, "Ana", 2), (1, "Bo", 1), (1, "Ana", 5), (1, "", 0), (2, "Cy", 1), (2, "Ana", 2), (3, "Bo", 1), (4, "Ana", 1)],
        "group_id long, artist string, pos int",
    )
    known = spark.createDataFrame([("Ana", "A"), ("Ana", "A"), ("Dee", "B"), ("Ana", None)], "artist string, title string")
    # Both titles of group 1 ask for two names; the song that is there twice is asked for once.
    assert tuple(ma.any_hit_coverage(songs, credits, known).first()) == (6, 2, 8, 200 / 6, "lazy")
    assert tuple(ma.any_hit_coverage(songs, credits, known, tried=1).first()) == (6, 0, 5, 0.0, "lazy")


def test_coverage_and_tally(spark, songs, credits):
    known = spark.createDataFrame([("Cee Dee", "Night Drive"), ("Cee Dee", "Deep Cut")], "artist string, title string")
    assert tuple(ma.any_hit_coverage(songs, credits, known).first()) == (5, 2, 6, 40.0, "judgment")
    attempts = spark.createDataFrame([("hit",), ("hit",), ("null",), (None,)], "status string")
    row = ma.outcome_tally(attempts, "status").first()
    assert (row["tried"], row["n_hit"], row["overall_rate"], row["verdict"]) == (3, 2, 50.0, "GO")
    assert ma.outcome_tally(attempts.limit(0), "status").first()["verdict"] == "NO-GO"


def test_prominence_falls_back_resumes_and_skips(spark):
    nodes = spark.createDataFrame(
        [("a", "A", 0, False), ("b", "B", 0, None), ("c", "C", 7, True), ("d", "D", 0, False), ("z", "Z", 0, False)],
        "id string, name string, popularity long, enriched boolean",
    )
    external = spark.createDataFrame([("a", 900), ("b", None), ("c", 1)], "id string, listeners long")
    degrees = spark.createDataFrame([("a", 3), ("b", 2), ("d", 1)], "id string, degree long")
    once = en.enrich_prominence(nodes, external, degrees, min_degree=1)
    assert rows(once.select("id", "popularity", "enriched", "status")) == [
        ("a", 900, True, "external"), ("b", 2, True, "degree"), ("c", 7, True, "done"), ("d", 1, True, "degree"), ("z", 0, False, "skipped"),
    ]
    assert tuple(en.enrich_summary(once).first()) == (3, 1, 2, 1)
    again = en.enrich_prominence(once.drop("status"), external, degrees)
    assert tuple(en.enrich_summary(again).first()) == (1, 0, 1, 0)


def test_listener_json(spark):
    texts = ['{"artist":{"stats":{"listeners":"12"}}}', '{"error":6}', '{"artist":{}}', '{"artist":{"stats":{"listeners":"x"}}}', "{", '{"artist":{"stats":{"listeners":5}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(en.listeners_from_json("t")).collect()]
    assert got == [12, None, None, None, None, 5]


def test_track_ids_resolve_once(spark):
    songs = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None), ("e", "none")], "song_id string, track_id string")
    outcomes = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "error"), ("d", "aborted"), ("e", "ok")], "song_id string, status string")
    matches = spark.createDataFrame([("a", "T1"), ("b", "none"), ("e", "T9")], "song_id string, track_id string")
    assert rows(en.enrich_track_ids(songs, outcomes, matches).fillna("<null>")) == [
        ("a", "T1", "resolved"), ("b", "none", "sentinel"), ("c", "<null>", "error"), ("d", "<null>", "pending"), ("e", "none", "kept"),
    ]


def test_inserts_are_idempotent(spark):
    stored = spark.createDataFrame([("a", "A")], "id string, name string")
    batch = spark.createDataFrame([("a", "other", 0), ("b", "late", 2), ("b", "early", 1)], "id string, name string, at int")
    once = inc.upsert_first(stored, batch, ["id"], "at")
    assert rows(once) == [("a", "A"), ("b", "early")]
    assert rows(inc.upsert_first(once, batch, ["id"], "at")) == rows(once)

    edges = spark.createDataFrame([("a", "b", "t")], "src string, dst string, title string")
    more = spark.createDataFrame([("b", "a", "t"), ("b", "a", "u"), ("a", "b", "u")], "a string, b string, title string")
    assert rows(inc.upsert_edges(edges, more)) == [("a", "b", "t"), ("a", "b", "u")]

    names = spark.createDataFrame([("a", "K-Dot", "k dot")], "entity_id string, alias string, alias_norm string")
    more = spark.createDataFrame([("a", " K-Dot "), ("a", "  "), ("a", None), ("a", "Kay.")], "entity_id string, alias string")
    assert rows(inc.upsert_aliases(names, more)) == [("a", "K-Dot", "k dot"), ("a", "Kay.", "kay")]

    updates = spark.createDataFrame([("b", None), ("x", "X")], "id string, name string")
    assert rows(inc.apply_updates(once, updates, "id", ["name"]).fillna("<null>")) == [("a", "A"), ("b", "<null>")]


def test_cache_lifetime_batches_and_rate(spark):
    day = dt.datetime(2024, 5, 10)
    entries = spark.createDataFrame(
        [("a", day - dt.timedelta(days=8), 1), ("a", day - dt.timedelta(days=7), 2), ("b", day - dt.timedelta(days=9), 3)], "k string, at timestamp, v int"
    )
    assert [r["v"] for r in inc.fresh_entries(entries, "k", "at", F.lit(day)).collect()] == [2]

    numbered = inc.numbered_batches(spark.range(1000).select((F.col("id") * 3).alias("key")).repartition(7), "key", 30)
    assert rows(numbered) == [(i * 3, i // 30) for i in range(1000)]

    events = spark.createDataFrame([("u", day + dt.timedelta(seconds=s)) for s in (0, 10, 30, 31, 100)], "k string, at timestamp")
    got = inc.trailing_rate(events, "k", "at", limit=2).orderBy("at").collect()
    assert [(r["recent"], r["exceeds"]) for r in got] == [(1, False), (2, False), (3, True), (3, True), (1, False)]


def test_reports(spark):
    reached = spark.createDataFrame([(n, d) for n, d in enumerate([0, 1, 2, 2, 2, 2, 2, 2, 2, 2])], "node int, dist long")
    assert rows(rp.hop_histogram(reached)) == [(0, 1, 10.0), (1, 1, 10.0), (2, 8, 80.0)]
    row = rp.reach_summary(reached).first()
    assert tuple(row) == (9, 2.0, pytest.approx(17 / 9), 2, 80.0, True)
    one = spark.createDataFrame([(31,)], "nodes long")
    two = spark.createDataFrame([(2,)], "nodes long")
    none = spark.createDataFrame([(0,)], "nodes long")
    assert rp.growth(one, two).first()["explosion"] is True
    assert tuple(rp.growth(one, none).first())[2:] == (None, False)
    edges = spark.createDataFrame([(1, 2), (3, 2)], "src int, dst int")
    titles = spark.createDataFrame([(1, 2, "t"), (1, 2, "t")], "src int, dst int, title string")
    hops = spark.createDataFrame([(1, 2), (5, 6)], "src int, dst int")
    assert dict(rows(rp.graph_invariants(edges, titles, hops))) == {
        "edge_order": 1, "edge_without_title": 1, "repeated_title": 1, "hop_without_title": 1,
    }
    nodes = spark.createDataFrame([(1, "Hanging Around"), (1, "Fine")], "k int, name string")
    songs = spark.createDataFrame([(1, "Monday part 3")], "k int, title string")
    hint = lambda t: spark.createDataFrame([(t,)], "hint string")
    got = rp.flag_paths(nodes, songs, ["k"], hint("HANGING"), hint("friday"))
    assert rows(got) == [(1, "node", "Hanging Around", "hanging")]


def test_collaborators_count_credits_and_guests_twice(spark):
    albums = spark.createDataFrame([(1, "single", "2001", "h"), (2, "album", "2003", "h"), (3, "album", "2000", "x")], "album_id int, album_type string, release_date string, primary_id string")
    tracks = spark.createDataFrame(
        [
            (1, "t1", "Go (feat. Ana)", 0, "h", "Hub"), (1, "t1", "Go (feat. Ana)", 1, "a", "Ana"),
            (3, "t2", "Guest spot", 0, "x", "Xen"), (3, "t2", "Guest spot", 1, "h", "Hub"), (3, "t3", "Unrelated", 0, "x", "Xen"),
            (2, "t4", "Solo (with hub and Bo)", 0, "h", "Hub"),
        ],
        "album_id int, track_id string, track_name string, pos int, artist_id string, artist_name string",
    )
    hubs = spark.createDataFrame([("h", "hub"), ("x", "Xen"), ("q", "Nobody")], "hub_id string, hub_name string")
    flagged = di.own_vs_guest(di.hub_albums(tracks, albums, hubs))
    assert rows(flagged.select("hub_id", "album_id", "is_primary")) == [("h", 1, True), ("h", 2, True), ("h", 3, False), ("x", 3, True)]
    kept = di.guest_tracks(tracks, flagged)
    assert {(r["hub_id"], r["track_id"]) for r in kept.collect()} == {("h", "t1"), ("h", "t2"), ("h", "t4"), ("x", "t2"), ("x", "t3")}
    counts = {tuple(r)[:2]: tuple(r)[2:] for r in di.collaborator_counts(kept, hubs).collect()}
    assert counts == {
        ("h", "ana"): ("Ana", "a", 2, 1), ("h", "xen"): ("Xen", "x", 1, 1), ("h", "bo"): ("Bo", None, 1, 1), ("x", "hub"): ("Hub", "h", 1, 1),
    }
    top = di.top_collaborators(di.collaborator_counts(kept, hubs), di.collaborator_tracks(kept, hubs), n=1)
    assert {(r["hub_id"], r["key"]) for r in top.collect()} == {("h", "ana"), ("x", "hub")}
    assert rows(di.prioritised(flagged, 1).select("hub_id", "album_id")) == [("h", 2), ("h", 3), ("x", 3)]
    assert rows(di.own_vs_guest(di.hub_albums(tracks, albums, hubs), own_only=True, max_total=1).select("hub_id", "album_id")) == [("h", 1), ("x", 3)]


def test_top_collaborators_count_every_own_album(spark, tmp_path):
    orders = list(range(1, 31))  # each of them an album of the first supplier
    made = {
        "supplier": ("s_suppkey long, s_name string", [(1, "Hub"), (2, "Ana"), (3, "Bo")]),
        "orders": ("o_orderkey long, o_orderpriority string, o_orderdate string", [(k, "1-URGENT" if k <= 20 else "5-LOW", "2001") for k in orders]),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string",
            [(k, 1, 1, 1, "N") for k in orders] + [(k, 2, 1, 2 if k <= 20 else 3, "N") for k in orders],
        ),
    }
    for name, (schema, data) in made.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    top = {(r["hub_id"], r["key"]): r["appearances"] for r in REGISTRY["top_collaborators"].plan(spark, str(tmp_path)).collect()}
    assert {key: n for (hub, key), n in top.items() if hub == 1} == {"ana": 40, "bo": 20, "guest n": 30}
    assert len([k for k in rows(REGISTRY["priority_topn"].plan(spark, str(tmp_path))) if k[0] == 1]) == 20


def test_shared_track_names_are_searched_for_guests_once(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(di, "materialize", lambda df, label: searched.append((label, df.count())) or materialize(df, label))
    tracks = spark.createDataFrame(
        [
            (h, a, "t", name, 0, artist, text)
            for h in ("h", "x") for a in (1, 2) for name in ("Go (feat. Ana)", None) for artist, text in (("h", "Hub"), ("x", "Xen"), ("y", "XEN"))
        ],
        "hub_id string, album_id int, track_id string, track_name string, pos int, artist_id string, artist_name string",
    )
    hubs = spark.createDataFrame([("h", "Hub"), ("x", "xen")], "hub_id string, hub_name string")
    counts = {tuple(r)[:2]: tuple(r)[2:] for r in di.collaborator_counts(tracks, hubs).collect()}
    # The track without a name counts as an appearance, not as a track.
    assert counts == {("h", "xen"): ("Xen", "x", 8, 1), ("h", "ana"): ("Ana", None, 2, 1), ("x", "hub"): ("Hub", "h", 4, 1), ("x", "ana"): ("Ana", None, 2, 1)}
    assert dict(searched)["guests"] == 1


def test_nested_records(spark):
    text = '{"title":"T","artist-credit":[{"artist":{"id":"1","name":"A"}},{"artist":{"id":"2"}},{"artist":{"id":"1","name":"B"}},{"artist":{"id":"3","name":"C"}},{}]}'
    df = spark.createDataFrame([("r", text), ("s", "{}")], "key string, document string")
    assert rows(records.parse_credits(df, "key", "document").select("entity_id", "name", "pos")) == [("1", "A", 0), ("3", "C", 3)]


def test_conform_optional_and_profile(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType())])
    old = spark.createDataFrame([("1", "x")], "id string, extra string")
    assert rows(src.conform(old, schema, {"n": 0})) == [(1, 0)]
    assert src.optional_table(spark, str(tmp_path / "none"), schema).collect() == []
    got = src.profile({"t": old, "gone": None})
    assert [tuple(r) for r in got.orderBy("table_name").collect()] == [("gone", None, None, False), ("t", 1, 4, True)]
    assert src.profile({"t": spark.createDataFrame([("é€",)], "x string")}).first()["n_bytes"] == 6


def test_edge_stream_equals_batch_and_survives_replay(spark, tmp_path):
    members = [(g, p) for g in range(6) for p in (g, g + 1, g + 2)]
    batch = lambda part: spark.createDataFrame(part, "group_id int, entity_id int")
    maintain = stream.edge_maintainer(str(tmp_path / "out"))
    maintain(batch(members[:7]), 0)
    maintain(batch(members[5:]), 1)
    maintain(batch(members[5:]), 1)
    got = rows(spark.read.parquet(str(tmp_path / "out" / "edges")).select("src", "dst"))
    wanted = sorted({tuple(sorted((a, b))) for g in range(6) for a in (g, g + 1, g + 2) for b in (g, g + 1, g + 2) if a != b})
    assert got == wanted


def test_enrich_stream_processes_each_entity_once(spark, tmp_path):
    schema = "id string, name string, popularity long, enriched boolean"
    external = spark.createDataFrame([("a", 5)], "id string, listeners long")
    degrees = spark.createDataFrame([("b", 2)], "id string, degree long")
    for names in (["a"], ["b"]):
        spark.createDataFrame([(n, n, 0, False) for n in names], schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.enrich_stream(source, external, degrees, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "table")).select("id", "popularity", "status")
    assert rows(got) == [("a", 5, "external"), ("b", 2, "degree")]


def test_registry_is_complete_and_named_columns_are_unique():
    assert len(REGISTRY) > 100
    assert sum(1 for item in REGISTRY.values() if item.check) >= len(REGISTRY) - 2


def test_repeated_titles_are_found_by_hash_first(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")
    titles = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, None), (1, 3, None), (1, 3, "a")], "src int, dst int, title string")
    report = rp.graph_invariants(edges, titles, edges)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") > 0
    assert dict(rows(report)) == {"edge_order": 0, "edge_without_title": 0, "repeated_title": 1, "hop_without_title": 0}
