"""Text functions on columns, all evaluated inside the JVM.

Python's ``re`` is Unicode aware by default while Java's is not, so patterns
carry ``(?U)``; ``(?d)`` keeps ``.`` and ``$`` tied to ``\\n`` alone.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column

# Markers that make a title a version of another title.
VARIANT_MARKERS = (
    "remix",
    "live",
    "instrumental",
    "acoustic",
    "remaster(?:ed)?",
    "edit",
    r"radio\s*edit",
    "extended",
    "version",
    "mix",
    "demo",
    "snippet",
    r"a\s*cappella",
    "acapella",
    "karaoke",
    "re-?recorded",
    "reprise",
    "mono",
    "stereo",
)

# Words that introduce a guest clause in a title.
GUEST_WORDS = ("feat", "ft", "featuring", "with")

# Characters a folded name drops without leaving a gap.
FOLD_DROPPED = ".'’ʼ"


class FoldTables:
    """Folding tables derived from the Unicode database, built once.

    Every code point is decomposed (NFKD) and reduced to what folding would
    leave of it.  Only results that contain an ASCII letter or digit, or that
    vanish, need an entry: anything else turns into a gap by the final rule.
    """

    def __init__(self) -> None:
        singles: dict[str, str] = {}
        expansions: dict[str, str] = {}
        vanishing: list[str] = []
        for code in range(0x80, 0x110000):
            if 0xD800 <= code <= 0xDFFF:
                continue
            char = chr(code)
            if char in FOLD_DROPPED or unicodedata.combining(char):
                vanishing.append(char)
                continue
            parts = unicodedata.normalize("NFKD", char)
            if parts == char:
                lowered = char.lower()
                parts = lowered if lowered.isascii() else parts
                if parts == char:
                    continue
            kept = "".join(
                p for p in parts if not unicodedata.combining(p) and p not in FOLD_DROPPED
            ).lower()
            if not kept:
                vanishing.append(char)
            elif any(k.isascii() and k.isalnum() for k in kept):
                if len(kept) == 1:
                    singles[char] = kept
                else:
                    expansions[char] = kept
        # ``translate`` deletes characters beyond the end of the replacement.
        self.from_chars = "".join(singles) + "".join(vanishing)
        self.to_chars = "".join(singles.values())
        self.expansions = expansions
        self.wide_chars = "".join(expansions)


@lru_cache(maxsize=1)
def fold_tables() -> FoldTables:
    return FoldTables()


def fold_name(text: ColumnLike) -> Column:
    """Matching key of a name: no accents, case or punctuation.

    Dots and apostrophes disappear, every other run of symbols becomes one
    space.  A name with nothing left keeps its trimmed lower-case form.
    ASCII input skips the accent tables; rare one-to-many compatibility
    characters are expanded only in the rows that contain them.
    """
    raw = as_column(text)
    tables = fold_tables()
    expansion = F.from_json(F.lit(json.dumps(tables.expansions)), "map<string,string>")
    spelled_out = F.array_join(
        F.transform(
            F.split(raw, ""),
            lambda c: F.coalesce(F.try_element_at(expansion, c), c),
        ),
        "",
    )
    # Hash lookups per character; a regex class of this many ranges is far slower.
    has_wide = F.length(F.translate(raw, tables.wide_chars, "")) < F.length(raw)
    narrow = F.when(has_wide, spelled_out).otherwise(raw)
    plain = F.translate(narrow, tables.from_chars, tables.to_chars)
    # Only ASCII text has as many bytes as characters.
    unaccented = F.when(F.octet_length(raw) > F.length(raw), plain).otherwise(raw)
    key = _squeeze(F.translate(F.lower(unaccented), ".'", ""))
    return F.when(key != "", key).otherwise(F.trim(F.lower(raw)))


def is_variant_title(title: ColumnLike) -> Column:
    """True when a title carries a version marker as a whole word."""
    pattern = r"(?iU)\b(" + "|".join(VARIANT_MARKERS) + r")\b"
    return F.coalesce(as_column(title).rlike(pattern), F.lit(False))


def _squeeze(text: Column) -> Column:
    """Keep lower-case ASCII letters and digits, separated by single spaces."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _drop_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)[\(\[].*?[\)\]]", " ")


def _drop_guests(text: Column) -> Column:
    return F.regexp_replace(text, r"(?diU)\b(" + "|".join(GUEST_WORDS) + r")\b.*", " ")


def _has_any(text: Column, *parts: str) -> Column:
    """Plain substring tests, far cheaper than the patterns they guard."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def base_title(title: ColumnLike, unicode_fallback: bool = False) -> Column:
    """Key shared by all versions of one title.

    Brackets, a trailing `` - suffix`` and guest clauses are removed before
    squeezing.  Titles without ASCII letters all share the empty key, unless
    ``unicode_fallback`` keys them on their trimmed lower-case form.
    """
    raw = F.coalesce(as_column(title), F.lit(""))
    lowered = F.lower(raw)
    no_suffix = F.regexp_replace(_drop_brackets(raw), r"(?dU)\s-\s.*$", " ")
    stripped = _squeeze(F.lower(_drop_guests(no_suffix)))
    marked = _has_any(lowered, "(", "[", "-", "feat", "ft", "with")
    key = F.when(marked, stripped).otherwise(_squeeze(lowered))
    if unicode_fallback:
        key = F.when(key != "", key).otherwise(F.trim(lowered))
    return key


def loose_text(text: ColumnLike) -> Column:
    """Comparison key for catalog matching; keeps a `` - suffix``."""
    lowered = F.lower(as_column(text))
    stripped = _squeeze(_drop_guests(_drop_brackets(lowered)))
    marked = _has_any(lowered, "(", "[", "feat", "ft", "with")
    return F.when(marked, stripped).otherwise(_squeeze(lowered))


def titles_match(wanted: ColumnLike, found: ColumnLike) -> Column:
    """Non-empty keys, one of which contains the other."""
    a, b = loose_text(wanted), loose_text(found)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


# Fixed value: shortest name that may vouch for a match.
MIN_ARTIST_KEY = 3


def artists_match(names: ColumnLike, found: ColumnLike) -> Column:
    """Some sufficiently long credited name contains, or is in, ``found``."""
    key = loose_text(found)
    keys = F.transform(as_column(names), loose_text)
    return (key != "") & F.coalesce(
        F.exists(
            keys,
            lambda n: (F.length(n) >= MIN_ARTIST_KEY) & (F.contains(key, n) | F.contains(n, key)),
        ),
        F.lit(False),
    )


def accepts(title: ColumnLike, names: ColumnLike, found_title: ColumnLike, found_artist: ColumnLike) -> Column:
    """Both the title and one of the artists have to match."""
    return titles_match(title, found_title) & artists_match(names, found_artist)


def year_from(date_text: ColumnLike) -> Column:
    """Leading four-digit year of a date string, else NULL."""
    text = as_column(date_text)
    return F.when(text.rlike("^[0-9]{4}"), F.substring(text, 1, 4).cast("int"))


def search_term(title: ColumnLike, names: ColumnLike) -> Column:
    """Title followed by the non-empty names, separated by spaces."""
    named = F.array_join(F.filter(as_column(names), lambda n: n != ""), " ")
    return F.trim(F.concat_ws(" ", as_column(title), F.coalesce(named, F.lit(""))))


def search_url(base: str, term: ColumnLike) -> Column:
    """A search link; spaces are encoded as ``+``."""
    return F.concat(F.lit(base), F.url_encode(as_column(term)))


def larger_artwork(url: ColumnLike) -> Column:
    """Ask for the 300 pixel thumbnail instead of the 100 pixel one."""
    return F.replace(as_column(url), F.lit("100x100"), F.lit("300x300"))


def first_group(text: ColumnLike, pattern: str) -> Column:
    """First capture of ``pattern``; NULL when absent, empty or ``null``."""
    found = F.regexp_extract(as_column(text), pattern, 1)
    return F.when((found != "") & (found != "null"), found)


def preferred_of(text: ColumnLike, pattern: str, marker: str) -> Column:
    """First match that contains ``marker``, else the first match, else NULL."""
    found = F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(0))
    marked = F.filter(found, lambda u: F.contains(u, F.lit(marker)))
    return F.coalesce(F.try_element_at(marked, F.lit(1)), F.try_element_at(found, F.lit(1)))


# The bracketed openings that announce guests, in order.
GUEST_PATTERNS = (
    r"\(feat\.\s*([^)]+)\)",
    r"\(ft\.\s*([^)]+)\)",
    r"\(featuring\s+([^)]+)\)",
    r"\(with\s+([^)]+)\)",
)


def featured_names(title: ColumnLike, word_boundary: bool = False) -> Column:
    """Guest names announced in brackets, in pattern order.

    By default ``and`` separates names even inside a word; with
    ``word_boundary`` it has to stand alone.
    """
    raw = as_column(title)
    separator = r",|&|\band\b" if word_boundary else ",|&|and"
    clauses = F.concat(
        *[F.regexp_extract_all(raw, F.lit("(?iU)" + p), F.lit(1)) for p in GUEST_PATTERNS]
    )
    pieces = F.flatten(F.transform(clauses, lambda c: F.split(c, separator)))
    return F.filter(F.transform(pieces, lambda n: F.trim(n)), lambda n: n != "")


def json_list(text: ColumnLike) -> Column:
    """A JSON array of strings; malformed or missing text is an empty list."""
    return F.coalesce(
        F.from_json(as_column(text), "array<string>"), F.array().cast("array<string>")
    )


def meta_line(album: ColumnLike, year: ColumnLike) -> Column:
    """Album and year, present parts only, separated by a middle dot."""
    return F.concat_ws(" · ", F.nullif(as_column(album), F.lit("")), as_column(year).cast("string"))


def cache_key(identifier: ColumnLike) -> Column:
    """MD5 of the identifier's text form."""
    return F.md5(as_column(identifier).cast("string").cast("binary"))


def same_name(left: ColumnLike, right: ColumnLike) -> Column:
    """Case-insensitive equality after trimming."""
    return F.lower(F.trim(as_column(left))) == F.lower(F.trim(as_column(right)))


# What an embed page carries, and the code of the 300 px cover.
EMBED_MARKER = "__NEXT_DATA__"
EMBED_AUDIO = r'"audioPreview"\s*:\s*\{\s*"url"\s*:\s*"([^"]+)"'
EMBED_YEAR = r'"releaseDate"\s*:\s*\{\s*"isoString"\s*:\s*"(\d{4})'
EMBED_ARTWORK = r"https://(?:i\.scdn\.co|[a-z0-9-]+\.spotifycdn\.com)/image/[a-z0-9]+"
EMBED_COVER_CODE = "00001e02"


def embed_fields(html: ColumnLike) -> dict[str, Column]:
    """Audio link, cover, year and outcome of one embed page.

    Without the page marker or a usable audio link all fields are NULL.
    """
    page = as_column(html)
    marked = F.contains(page, F.lit(EMBED_MARKER))
    audio = F.when(marked, first_group(page, EMBED_AUDIO))
    return {
        "audio_url": audio.alias("audio_url"),
        "artwork_url": F.when(
            audio.isNotNull(), preferred_of(page, EMBED_ARTWORK, EMBED_COVER_CODE)
        ).alias("artwork_url"),
        "year": F.when(audio.isNotNull(), first_group(page, EMBED_YEAR).cast("int")).alias("year"),
        "status": F.when(~marked, "no_marker").when(audio.isNull(), "null").otherwise("hit").alias("status"),
    }
