"""Token-sorted similarity and the exact signature that blocks it.

The score of two strings is ``200 * LCS / (m + n)`` on their space-separated
tokens in sorted order.  A score of at least 72 needs ``LCS >= 0.36 (m + n)``;
a common subsequence is a common bag of characters, so it also needs that many
common (character, occurrence) tokens.  Two strings that share at least ``o``
tokens share two of the first ``len - o + 2`` tokens of any common order
(prefix filtering), which turns the comparison into an equi-join on token
pairs without losing a single qualifying pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions._columns import ColumnLike, as_column

# Fixed value: lowest accepted score.
SCORE_CUTOFF = 72
# Characters whose places fit the bits of one long, with room for a carry.
MAX_BITS = 62

# Letters from rare to common; only the selectivity of the signature depends
# on it, never its completeness.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


def sorted_tokens(folded: ColumnLike) -> Column:
    """The folded text with its words in alphabetical order."""
    return F.array_join(F.sort_array(F.split(as_column(folded), " ")), " ")


def lcs_length(left: str, right: str) -> int:
    """Length of the longest common subsequence, one bit per character."""
    where: dict[str, int] = {}
    for position, char in enumerate(left):
        where[char] = where.get(char, 0) | (1 << position)
    full = (1 << len(left)) - 1
    row = full
    for char in right:
        matches = row & where.get(char, 0)
        row = ((row + matches) | (row - matches)) & full
    return len(left) - row.bit_count()


def _scores(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right):
        total = len(a) + len(b)
        out.append(200.0 * lcs_length(a, b) / total if total else 100.0)
    return pd.Series(out, dtype="float64")


def long_sequence_score(left: ColumnLike, right: ColumnLike) -> Column:
    """Arrow-batched ``200 * LCS / (m + n)`` of two token-sorted texts of any length."""
    return F.pandas_udf(_scores, "double")(as_column(left), as_column(right))


def char_bits(text: ColumnLike) -> Column:
    """For each character of ``text`` a long with a bit per place where it stands; null beyond ``MAX_BITS``."""
    t = as_column(text)
    chars = F.split(t, "")
    distinct = F.array_distinct(chars)

    def bits(char: Column) -> Column:
        at = F.transform(chars, lambda x, i: F.when(x == char, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2), i).cast("long"))
        return F.aggregate(at, F.expr("0L"), lambda a, x: a.bitwiseOR(x))

    return F.when(F.length(t) <= MAX_BITS, F.map_from_arrays(distinct, F.transform(distinct, bits)))


def _lcs(size: Column, bits: Column, other: Column) -> Column:
    """LCS of a text of ``size`` characters with ``char_bits`` and of ``other``: the row of the
    dynamic program is one long, and each character of ``other`` updates it."""
    full = F.pow(F.lit(2), size).cast("long") - F.expr("1L")
    masks = F.transform(F.split(other, ""), lambda c: F.coalesce(F.try_element_at(bits, c), F.expr("0L")))
    row = F.aggregate(
        masks, full, lambda r, m: (r + r.bitwiseAND(m)).bitwiseOR(r.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)
    )
    return size - F.bit_count(row)


def sequence_score(left: ColumnLike, right: ColumnLike, left_bits: ColumnLike, right_bits: ColumnLike) -> Column:
    """``200 * LCS / (m + n)`` of two token-sorted texts, one of which has ``char_bits``; in the JVM."""
    a, b, bits_a, bits_b = map(as_column, (left, right, left_bits, right_bits))
    m, n = F.length(a), F.length(b)
    lcs = F.when(bits_a.isNotNull(), _lcs(m, bits_a, b)).otherwise(_lcs(n, bits_b, a))
    return F.when(m + n == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / (m + n))


def edit_score(left: ColumnLike, right: ColumnLike) -> Column:
    """``100 * (1 - levenshtein / longer length)``, evaluated in the JVM."""
    a, b = as_column(left), as_column(right)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(
        100.0 * (longest - F.levenshtein(a, b)) / longest
    )


def with_char_tokens(df: DataFrame, text: str, tokens: str) -> DataFrame:
    """Add the bag of characters as distinct ``char#occurrence`` tokens.

    Tokens come in one global order: higher occurrences first, then rare
    letters.  The steps are separate columns because a lambda evaluates an
    expression it captures once per element.
    """
    ordered = F.sort_array(F.split(F.col(text), ""))

    def token(char: Column, index: Column) -> Column:
        occurrence = (index + 1 - F.array_position("_chars", char) + 1).cast("int")
        return F.struct(
            (-occurrence).alias("rarer"),
            F.instr(F.lit(_RARE_FIRST), char).alias("letter"),
            char.alias("char"),
        )

    return (
        df.withColumn("_chars", ordered)
        .withColumn("_tokens", F.sort_array(F.transform("_chars", token)))
        .withColumn(
            tokens,
            F.transform("_tokens", lambda t: F.concat(t["char"], F.lit("#"), (-t["rarer"]).cast("string"))),
        )
        .drop("_chars", "_tokens")
    )


def with_signature(df: DataFrame, bag: str, key: str) -> DataFrame:
    """One row per signature key of the bag of characters ``bag``; any two texts scoring at least the
    cutoff share a key.

    A partner of a text of length m shares at least ``9m/16`` tokens, so pairs
    of the first ``m - ceil(9m/16) + 2`` tokens suffice.  One-letter texts can
    only match themselves.
    """
    size = F.size(bag)
    needed = F.floor((size * 9 + 15) / 16).cast("int")
    pairs = F.flatten(
        F.transform(
            "_prefix",
            lambda t, i: F.transform(
                F.slice("_prefix", i + 2, F.size("_prefix")), lambda u: F.concat(t, F.lit("|"), u)
            ),
        )
    )
    return (
        df.withColumn("_prefix", F.slice(bag, F.lit(1), F.least(size, size - needed + 2)))
        .withColumn(key, F.explode(F.when(size <= 1, F.col(bag)).otherwise(pairs)))
        .drop("_prefix")
    )


def lengths_fit(m: ColumnLike, n: ColumnLike) -> Column:
    """Whether texts of these lengths can reach the cutoff: at most the shorter one is common."""
    a, b = as_column(m), as_column(n)
    return F.least(a, b) * 200 >= (a + b) * SCORE_CUTOFF


def enough_shared(left: ColumnLike, right: ColumnLike) -> Column:
    """Whether two bags of characters have enough in common for the cutoff."""
    a, b = as_column(left), as_column(right)
    return F.size(F.array_intersect(a, b)) * 100 >= (F.size(a) + F.size(b)) * (SCORE_CUTOFF // 2)
