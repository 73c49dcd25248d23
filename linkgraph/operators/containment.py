"""Substring joins without comparing every pair.

A needle occurs in a text only if each of its character trigrams does.  Each
needle is therefore looked up under its rarest trigram (the whole needle when
it is shorter), which is an equi-join; the containment test then runs on the
few texts that share it.  Both sides are reduced to distinct strings first.
Postings hold a hash for the text; the texts themselves join only the pairs
that are left, where the test also tells texts of one hash apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    return F.when(
        F.length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def substring_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """All ``(needle, text)`` pairs of distinct non-empty strings where the
    text contains the needle."""
    wanted = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    stored = texts.select(F.col(text).alias("text")).filter("text <> ''").distinct()

    anchors = wanted.select(
        "needle",
        F.explode(
            F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(
                F.array_distinct(_grams(F.col("needle"), GRAM))
            )
        ).alias("gram"),
    )
    # Only grams some needle asks about leave the map side of the texts.
    asked = anchors.select("gram").distinct()
    every = F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    hashed = stored.select(F.xxhash64("text").alias("text_id"), "text")
    postings = hashed.select("text_id", F.explode(F.array_distinct(every)).alias("gram")).join(
        asked, "gram", "left_semi"
    )
    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A gram no text has leaves its needle without a match at all.
    rarest = (
        anchors.join(frequency, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("gram")))["gram"].alias("gram"))
    )
    met = rarest.join(postings, "gram").select("needle", "text_id")
    return met.join(hashed, "text_id").filter(F.contains("text", "needle")).select("needle", "text")
