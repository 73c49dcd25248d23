"""Find licence notices: an exact set-similarity join of text blocks with templates.

A block is a run of words of the whole text, as long as the template; lines play
no part, for notices are wrapped anywhere.  It meets a template where it holds at
least the share ``THRESHOLD`` of the template's distinct words, so of a template of
up to four words it holds all.  The join finds every block that does:

* windows of twice a ``SPAN``, one every span, hold every block of up to a span;
  a longer template has a longer span (``span_of``);
* tokens are ordered by their document frequency in the whole corpus, rarest
  first (only template words are counted, for no others matter);
* prefix filter: of a template of n words that needs m, the first n - m + 1 in
  that order are indexed, and a window that meets it has one of them; the rarest
  one they share stands for the pair;
* length filter: a window has at least m template words;
* positional filter: where a shared word stands at place i of the template and
  j of the window, at most the shorter rest can follow;
* what is left is verified: the intersection with each of the window's blocks.

Templates (``license_texts``) are a parameter, so all that is made of them (the
order, the index) is of a size that no data changes.

Besides, phrases are looked up word by word (``PHRASES``).

Defined cases: a null text is empty and has no words; an id that several texts
have is told apart by the text; repeated rows get the same answer each; an
empty table gives none; other columns are left out.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import Scratch, ascii_lower, let, text_key
from linkgraph.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
SPAN, LONGER = 32, 8  # words of the shortest span; how many times as long the next one is
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of words, once A-Z are lower-cased
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def _split(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    return list(dict.fromkeys(_split(text)))


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """How many of ``n`` words make the share ``threshold``."""
    return math.ceil(round(threshold * n, 9))


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def frequency_order(lowered: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by how many rows of ``lowered`` (t) have the word, rarest first.

    One count for each template word comes to the driver.
    """
    found = lowered.select(F.explode(F.array_intersect(words(F.col("t")), _strings(vocabulary))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def span_of(length: int) -> int:
    """The span of windows for a template of ``length`` words."""
    span = SPAN
    while span < length:
        span *= LONGER
    return span


def _windows(ws: Column, span: int) -> Column:
    """Runs of ``2 * span`` words: a run of up to ``span`` words lies in one of them."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(ws) / span - 2).cast("int")))
    return F.transform(
        starts, lambda k: F.struct(F.lit(span).alias("span"), F.slice(ws, k * span + 1, 2 * span).alias("raw"))
    )


def notices(lowered: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _key, label, score): the templates that a block of the document meets; ``lowered``: (doc_id, _key, t)."""
    spark = lowered.sparkSession
    sets = [(label, template_words(text), len(_split(text))) for label, text in templates]
    sets = [(label, ws, needed(len(ws), threshold), length) for label, ws, length in sets if ws]
    order = frequency_order(lowered, sorted({w for _, ws, _, _ in sets for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    index, prefixes = [], {}
    for template, (label, ws, least, length) in enumerate(sets):
        ordered, span = sorted(ws, key=rank.__getitem__), span_of(length)
        for i, w in enumerate(ordered[: len(ws) - least + 1]):
            index.append((w, span, template, label, i, len(ws), least, length, ordered))
            prefixes.setdefault(span, set()).add(w)
    indexed = spark.createDataFrame(
        index,
        "word string, span int, template int, label string, at int, n int, least int, length int, whole array<string>",
    )
    # Texts, and in them windows, that have a prefix word.
    ws = lowered.select("doc_id", "_key", words(F.col("t")).alias("ws"))
    ws = ws.where(F.arrays_overlap("ws", _strings(sorted(set().union(*prefixes.values())))))

    def with_prefix(span: int) -> Column:
        rare = _strings(sorted(prefixes[span]))
        return F.filter(_windows(F.col("ws"), span), lambda b: F.arrays_overlap(b["raw"], rare))

    kept = F.concat(*(with_prefix(span) for span in prefixes)) if prefixes else _windows(F.col("ws"), SPAN)
    windows = ws.select("doc_id", "_key", F.explode(kept).alias("w")).select("doc_id", "_key", "w.*")
    windows = windows.withColumn("block", F.array_intersect(_strings(order), F.col("raw")))
    probes = windows.select("*", F.posexplode("block").alias("j", "word"))
    met = probes.join(indexed, ["span", "word"]).where(
        (F.size("block") >= F.col("least"))
        & (1 + F.least(F.col("n") - F.col("at") - 1, F.size("block") - F.col("j") - 1) >= F.col("least"))
    )
    shared = F.array_intersect("whole", "block")  # rarest first
    met = met.where((F.size(shared) >= F.col("least")) & (F.get(shared, F.lit(0)) == F.col("word")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("raw") - F.col("length") + 1))
    in_blocks = F.transform(starts, lambda i: F.size(F.array_intersect("whole", F.slice("raw", i, F.col("length")))))
    best = met.groupBy("doc_id", "_key", "label", "template", "n", "least").agg(F.max(F.array_max(in_blocks)).alias("shared"))
    verified = best.where(F.col("shared") >= F.col("least"))
    return verified.groupBy("doc_id", "_key", "label").agg(F.max(F.col("shared") / F.col("n")).alias("score"))


def _places(text: Column, ws: Column, phrase: str) -> Column:
    """The places in ``ws`` where the words of ``phrase`` stand one after the other."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(ws) - len(parts))
    fits = lambda i: reduce(lambda a, b: a & b, (F.get(ws, i + k) == w for k, w in enumerate(parts)))
    may = F.contains(text, F.lit(max(parts, key=len))) & text.rlike(SEPARATORS.join(map(re.escape, parts)))
    none = F.array().cast("array<int>")
    return F.when(may & (F.size(ws) >= len(parts)), F.filter(at, fits)).otherwise(none)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that a block holds, 1 where a
    phrase stands, and 0 where nothing is found.
    """
    lowered = docs.select(
        "doc_id", text_key(F.col("text")).alias("_key"), ascii_lower(F.coalesce("text", F.lit(""))).alias("t")
    )
    hits = (
        notices(lowered, templates, threshold)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"))
        .agg(F.collect_set("label").alias("_found"), F.max("score").alias("_score"))
    )

    def by_phrase(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            *(_places(F.col("t"), ws, phrase).alias(label) for label, phrase in phrases.items()),
        )

    counted = lowered.select("doc_id", "_key", let(words(F.col("t")), by_phrase).alias("b"))
    places = F.flatten(F.array(*(F.col("b")[label] for label in phrases)))
    labels = F.array_compact(
        F.array(*(F.when(F.size(F.col("b")[label]) > 0, F.lit(label)) for label in phrases))
    )
    base = Scratch(docs.sparkSession, "licences").write(
        counted.select(
            "doc_id", "_key", F.col("b.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
            F.array_sort(labels).alias("base_labels"),
        ),
        "base",
    )
    both = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
    everything = F.array_union("base_labels", F.coalesce("_found", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(everything), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
