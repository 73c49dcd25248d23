"""Name resolution: tiers, aliases, similar names, override, labels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.functions.similarity import lcs_length
from linkgraph.operators import ranking as rk
from linkgraph.operators import resolution as rs
from linkgraph.operators.containment import substring_pairs

ENTITIES = [
    ("rio", "Riohanna", 5_000_000),
    ("ame", "Amélie", 6_000_000),
    ("mts", "Marina the Botanist", 25_000),
    ("mc", "Marina Corey", 3_430_494),
    ("ma", "Marina Adebo", 2),
    ("m", "Marina", 1),
    ("ts", "Tayla Short", 8_000_000),
    ("kl", "Kendra Lowell", 7_000_000),
    ("big", "Bug", 10),
    ("bog", "The Glorious B.U.G.", 2_000_000),
    ("bb", "Buggie Bash", 50),
    ("tc", "Taylor, The Maker", 4_000_000),
    ("kz", "KAY‐Z", 5_500_000),
    ("g1", "The Gang", 500_000),
    ("g2", "The Gang", 30),
    ("g3", "The Gang", 20),
    ("yo", "Yo", 4_500_000),
]
ALIASES = [("yo", "Karim West"), ("bog", "Buggie Smalls")]

FIRST = [
    ("riohana", "Riohanna"),
    ("amelie", "Amélie"),
    ("Amelye", "Amélie"),
    ("Maria the botanist", "Marina the Botanist"),
    ("Tayler Short", "Tayla Short"),
    ("Kendr Lowell", "Kendra Lowell"),
    ("Marina the", "Marina the Botanist"),
    ("Kend", "Kendra Lowell"),
    ("Glorious BUG", "The Glorious B.U.G."),
    ("Taylor the Maker", "Taylor, The Maker"),
    ("KAY Z", "KAY‐Z"),
    ("Karim West", "Yo"),
    ("Buggie", "The Glorious B.U.G."),
    ("Marina", "Marina Corey"),
    ("The Gang", "The Gang"),
    ("Bug", "The Glorious B.U.G."),
    ("the botanist marina", "Marina the Botanist"),
]


def entities(spark, data=ENTITIES, enriched=True):
    rows = [(i, n, p, 0, enriched) for i, n, p in data]
    return spark.createDataFrame(rows, "id string, name string, popularity long, degree long, enriched boolean")


def aliases(spark, data=ALIASES):
    return spark.createDataFrame(data, "entity_id string, alias string")


def ask(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


@pytest.fixture(scope="module")
def resolved(spark):
    queries = [q for q, _ in FIRST] + ["xqzzv", "!!", "", "%", "a"]
    found = rs.resolve(ask(spark, *queries), entities(spark), aliases(spark), limit=8).collect()
    by_query = {}
    for row in sorted(found, key=lambda r: (r["query"], r["rank"])):
        by_query.setdefault(row["query"], []).append(row)
    return by_query


@pytest.mark.parametrize("query, name", FIRST)
def test_first_hit(resolved, query, name):
    assert resolved[query][0]["name"] == name
    assert [r["rank"] for r in resolved[query]] == list(range(1, len(resolved[query]) + 1))


def test_gibberish_and_wildcards_find_nothing(resolved):
    assert all(q not in resolved for q in ("xqzzv", "!!", "", "%"))


def test_limits_and_no_duplicates(resolved):
    for hits in resolved.values():
        assert len(hits) <= 8 and len({r["id"] for r in hits}) == len(hits)


def test_repeated_names_rank_by_prominence(resolved):
    assert [r["id"] for r in resolved["The Gang"]][:3] == ["g1", "g2", "g3"]


def test_override_needs_fifty_times_the_head(spark):
    def first(rival):
        data = [("x", "Sol", 10), ("y", "El Sol", rival)]
        return rs.resolve(ask(spark, "sol"), entities(spark, data), aliases(spark, []), scorer=None).filter("rank = 1").first()["id"]

    assert first(499) == "x"
    assert first(500) == "y"


def test_degree_leads_until_enough_are_enriched(spark):
    rows = [("a", "Nova One", 9000, 1, True), ("b", "Nova Two", 0, 40, False), ("c", "Other", 0, 0, False)]
    df = spark.createDataFrame(rows, "id string, name string, popularity long, degree long, enriched boolean")
    got = rs.resolve(ask(spark, "nova"), df, aliases(spark, []), scorer=None).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a"]


def test_similar_names_only_when_thin_and_not_for_aliases(spark):
    data = [(str(i), f"Orbit {i}", i) for i in range(5)] + [("z", "Orbir", 999)]
    got = rs.resolve(ask(spark, "Orbit", "Karim Wset"), entities(spark, data), aliases(spark, [("z", "Karim West")])).collect()
    assert {r["tier"] for r in got if r["query"] == "Orbit"} == {0}
    assert [r for r in got if r["query"] == "Karim Wset"] == []


def test_cutting_common_names_at_the_limit_is_exact(spark):
    same = [(f"s{i:03}", "Echo", i) for i in range(200)]
    df = entities(spark, same + [("t", "Echo Park", 5)])
    got = rs.resolve(ask(spark, "echo"), df, aliases(spark, [("s000", "Echo!"), ("s001", "zzz")]), limit=5, scorer=None)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["s199", "s198", "s197", "s196", "s195"]


NAMES = st.text(alphabet="abcde ", min_size=1, max_size=14).map(lambda s: " ".join(s.split())).filter(bool)


@settings(max_examples=6, deadline=None)
@given(st.lists(NAMES, min_size=15, max_size=30, unique=True), st.lists(NAMES, min_size=5, max_size=10, unique=True))
def test_similar_texts_misses_no_pair(spark, names, queries):
    def sort(s):
        return " ".join(sorted(s.split(" ")))

    left = spark.createDataFrame([(q,) for q in queries], "folded string")
    right = spark.createDataFrame([(n,) for n in names], "text string")
    got = {(r["folded"], r["text"]): r["score"] for r in rs.similar_texts(left, right).collect()}
    wanted = {}
    for q in queries:
        for n in names:
            score = 200.0 * lcs_length(sort(q), sort(n)) / (len(q) + len(n))
            if score >= 72:
                wanted[q, n] = score
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("long", [58, 62, 63, 80])
def test_scores_of_long_texts(spark, long):
    """One row of bits holds 62 characters; of longer pairs one side may still fit."""
    base = ("abcdefghij\U0001f600é" * 7)[:long]
    texts = [base, base[::-1], base[:50] + "x" * (long - 50), base[3:] + "zzz", "y" + base, base[:45], "\U0001f600" * long]
    left = spark.createDataFrame([(t,) for t in texts[:4]], "folded string")
    right = spark.createDataFrame([(t,) for t in texts] * 2, "text string")
    got = {(r["folded"], r["text"]): r["score"] for r in rs.similar_texts(left, right).collect()}
    wanted = {(a, b): 200.0 * lcs_length(a, b) / (len(a) + len(b)) for a in texts[:4] for b in texts}
    assert got == pytest.approx({k: v for k, v in wanted.items() if v >= 72})


def test_own_scorer(spark):
    left = spark.createDataFrame([("abcd",), ("wxyz",)], "folded string")
    right = spark.createDataFrame([("abcd",), ("abce",)], "text string")
    same = rs.similar_texts(left, right, lambda a, b: F.when(a == b, 100.0).otherwise(0.0))
    assert [tuple(r) for r in same.collect()] == [("abcd", "abcd", 100.0)]
    with pytest.raises(ValueError):
        rs.similar_texts(left, right, "none")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abé ", max_size=4), min_size=5, max_size=20), st.lists(st.text(alphabet="abé ", max_size=12), min_size=5, max_size=20))
def test_substring_pairs_misses_no_pair(spark, needles, texts):
    left = spark.createDataFrame([(n,) for n in needles], "n string")
    right = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in substring_pairs(left, "n", right, "t").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(n, t) for n in needles for t in texts if n and t and n in t}


def test_labels(spark):
    rows = [("q", "a", "Hana", 3), ("q", "b", "HANA", 3), ("q", "c", "Hana", 1), ("q", "d", "Solo", 9), ("r", "a", "Hana", 3)]
    got = rk.label_candidates(spark.createDataFrame(rows, "query string, id string, name string, degree int")).collect()
    assert {(r["query"], r["id"]): r["label"] for r in got} == {
        ("q", "a"): "Hana · 3 collabs", ("q", "b"): "HANA · 3 collabs (2)", ("q", "c"): "Hana · 1 collab", ("q", "d"): "Solo", ("r", "a"): "Hana",
    }


def test_exact_lookup_prefers_names_then_aliases(spark):
    got = rk.exact_lookup(ask(spark, "the gang", "KARIM WEST", "Gang"), entities(spark), aliases(spark)).collect()
    assert {r["query"]: (r["id"], r["matched_by"]) for r in got} == {
        "the gang": ("g1", "name"), "KARIM WEST": ("yo", "alias"), "Gang": (None, None),
    }


def test_search_and_submit(spark):
    found = rs.search(ask(spark, " marina corey ", "x", "Bug"), entities(spark), aliases(spark))
    assert "x" not in {r["query"] for r in found.collect()}
    taken = {r["query"]: (r["id"], r["notice"]) for r in rs.submit(found).collect()}
    assert taken == {"marina corey": ("mc", False), "Bug": ("bog", True)}


def test_coverage_of_an_empty_table(spark):
    assert rk.coverage_fraction(entities(spark).limit(0), "enriched").first()["coverage"] == 0.0


def test_identify_falls_back_to_search(spark):
    got = rs.identify(ask(spark, "the gang", "Karim West", "Kendr Lowel", "Tayla", "qqqq"), entities(spark), aliases(spark))
    assert {r["query"]: (r["id"], r["matched_by"]) for r in got.collect()} == {
        "the gang": ("g1", "name"), "Karim West": ("yo", "alias"), "Kendr Lowel": ("kl", "search"), "Tayla": ("ts", "search"),
    }
