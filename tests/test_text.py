"""Text functions against plain-Python restatements of their rules."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.functions import similarity as si
from linkgraph.functions import text as tx


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def fold_in_python(text):
    plain = [c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)]
    out, gap = "", False
    for char in "".join(plain).lower():
        if char in ".'’ʼ":
            continue
        if char.isascii() and char.isalnum():
            out += (" " if gap and out else "") + char
            gap = False
        else:
            gap = True
    return out or text.lower().strip()


NAMES = [
    "Zoë Ünal", "D.J. O’Neil", "Mika-Lou, The Third", "!!!", "№ 5", "ﬁve ½ ⑩ times", "Ａｂｃ", "𝐁𝐨𝐥𝐝", "ß", "Łódź",
    "a‐b", "…dots…", "K elvin", "İstanbul", "Ｎ°１", "été", "ŉ", "日本", "", "  x  ", "Æther ﬃ ㎏",
]


def test_fold_name_matches_the_rule(spark):
    assert apply(spark, tx.fold_name, NAMES) == [fold_in_python(n) for n in NAMES]


def test_fold_name_on_every_letter_block(spark):
    # NUL and the private newline variants are not text a name can carry.
    chars = [chr(c) for c in range(0x21, 0x3000) if not unicodedata.category(chr(c)).startswith("C")]
    values = [f"a{c}b" for c in chars]
    got = apply(spark, tx.fold_name, values)
    wrong = [(v, g, fold_in_python(v)) for v, g in zip(values, got) if g != fold_in_python(v)]
    assert wrong == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("C",)), max_size=12), min_size=20, max_size=40))
def test_fold_name_on_random_text(spark, values):
    got = apply(spark, tx.fold_name, values)
    # Trimming in SQL removes spaces only, so compare without other blanks.
    for value, key in zip(values, got):
        if value.strip() == value.strip(" "):
            assert key == fold_in_python(value)


@pytest.mark.parametrize(
    "title, base, variant",
    [
        ("Open Road (Remix)", "open road", True),
        ("Open Road - Radio Edit (feat. X)", "open road", True),
        ("Open Road [Live at Y]", "open road", True),
        ("Open Road ft. Somebody", "open road", False),
        ("Open Road with Friends", "open road", False),
        ("Alive", "alive", False),
        ("Remixed Feelings", "remixed feelings", False),
        ("A Cappella Song", "a cappella song", True),
        ("Ré-recorded", "r recorded", False),
        ("With Me", "", False),
        ("夜", "", False),
        (None, "", False),
        ("Two  Spaces!", "two spaces", False),
        ("Line - one\nline two", "line one line two", False),
    ],
)
def test_title_keys(spark, title, base, variant):
    assert apply(spark, tx.base_title, [title]) == [base]
    assert apply(spark, tx.is_variant_title, [title]) == [variant]


def test_base_title_can_fall_back_to_the_title(spark):
    assert apply(spark, lambda c: tx.base_title(c, unicode_fallback=True), ["夜 ", "Day"]) == ["夜", "day"]


def test_loose_text_keeps_a_suffix(spark):
    assert apply(spark, tx.loose_text, ["Song - Live (2009)", "SONG feat. A"]) == ["song live", "song"]


@pytest.mark.parametrize(
    "title, names, found_title, found_artist, accepted",
    [
        ("Night Drive", ["Ana Bo"], "Night Drive (Remastered)", "Ana Bo & Co", True),
        ("Night Drive", ["Ana Bo"], "Night Drive", "Someone Else", False),
        ("Night Drive", ["Ana Bo"], "Day Drive", "Ana Bo", False),
        ("Night Drive", ["Xy"], "Night Drive", "Xy", False),
        ("(Untitled)", ["Ana Bo"], "Night Drive", "Ana Bo", False),
        ("Night", ["Ana Bo", "Cee Dee"], "Night Drive", "Cee Dee", True),
        ("Night", [], "Night", "Cee Dee", False),
    ],
)
def test_accepts(spark, title, names, found_title, found_artist, accepted):
    row = spark.createDataFrame([(title, names, found_title, found_artist)], "t string, n array<string>, ft string, fa string")
    assert row.select(tx.accepts("t", "n", "ft", "fa")).first()[0] is accepted


def test_featured_names(spark):
    titles = ["Go (feat. Ana & Bo, Cee) (with Dee and Eff)", "Go (FT. Brandy)", "Go feat. Nobody", "Go (featuring Zed)"]
    assert apply(spark, tx.featured_names, titles) == [["Ana", "Bo", "Cee", "Dee", "Eff"], ["Br", "y"], [], ["Zed"]]
    assert apply(spark, lambda c: tx.featured_names(c, word_boundary=True), titles)[1] == ["Brandy"]


def test_small_helpers(spark):
    assert apply(spark, tx.year_from, ["2005-08-29T07", "199", "abcd-01", None]) == [2005, None, None, None]
    assert apply(spark, tx.json_list, ['["a","b"]', "[", None, "{}"]) == [["a", "b"], [], [], []]
    assert apply(spark, lambda c: tx.search_term("v", F.array(F.lit("A"), F.lit(""))), ["Song"]) == ["Song A"]
    row = spark.range(1).select(tx.meta_line(F.lit("Album"), F.lit(2001)), tx.meta_line(F.lit(None).cast("string"), F.lit(2001)), tx.meta_line(F.lit("Album"), F.lit(None)))
    assert list(row.first()) == ["Album · 2001", "2001", "Album"]


def test_embed_fields(spark):
    audio = '{"audioPreview": {"url": "https://a/x.mp3"}, "releaseDate": {"isoString": "2019-01-01"}}'
    covers = "https://i.scdn.co/image/ab00004851ff https://i.scdn.co/image/ab00001e02ff"
    pages = [f"__NEXT_DATA__ {audio} {covers}", audio, '__NEXT_DATA__ {"audioPreview":{"url":"null"}}', "__NEXT_DATA__ " + audio]
    fields = tx.embed_fields("html")
    got = spark.createDataFrame([(p,) for p in pages], "html string").select(*fields.values()).collect()
    assert [tuple(r) for r in got] == [
        ("https://a/x.mp3", "https://i.scdn.co/image/ab00001e02ff", 2019, "hit"),
        (None, None, None, "no_marker"),
        (None, None, None, "null"),
        ("https://a/x.mp3", None, 2019, "hit"),
    ]


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text(alphabet="abcd ", max_size=70), st.text(alphabet="abcd ", max_size=70))
def test_lcs_length(a, b):
    assert si.lcs_length(a, b) == lcs_by_table(a, b)
