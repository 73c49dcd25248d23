"""Quality rules with thresholds that follow each language and source.

Every document gets a few counts.  Their rates are put into mergeable quantile
sketches, one per (lang, source, rate): a histogram whose bins are exact up to
255 and keep eight leading bits above, so a quantile is off by at most 1/128 of its
value.  Sketches merge by adding counts, in any order, and so give the same
thresholds on each run.

A rate fails where it is further from the quartiles than ``spread`` quartile ranges and
the sketch's error.  The range is that of the group or of its language, whichever is wider, so a source
with masses of copies does not reject all else.  Groups of fewer than ``SMALL`` documents
are merged by language; what is still small then takes the sketch of all documents.
Only documents that pass the base rules are counted.  The thresholds are joined
back to the documents' rates.

The rates are such as any text has, so their quartiles are not 0: marks (ASCII
characters that are no letters) in the characters of words, the mean word length, points, capitals and
distinct words by words.

Defined cases: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own; a table of one document
never fails its own thresholds; repeated rows are judged one by one, and alike; an
empty table gives no rows; other columns are carried along untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch, let, text_key, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words
SPREAD = 6  # quartile ranges; three is the usual far fence
SMALL = 50  # documents, for a sketch of its own
BITS = 8
#: Rates as (part, whole, scale).
RATES = {
    "marks": ("n_marks", "word_chars", 1000), "length": ("word_chars", "n_words", 100), "points": ("n_points", "n_words", 1000),
    "capitals": ("n_capitals", "n_words", 1000), "distinct": ("n_distinct", "n_words", 1000),
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_points", "n_capitals", "n_distinct",
)


def _repeated(words: Column) -> Column:
    """How many words stand in a window of three that the text has twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.filter(
                s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
            ),
        )
        places = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            F.size(F.array_distinct(places))
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def _without(text: Column, pattern: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


def counted(text: Column) -> Column:
    """The counts of one text, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated"),
            F.size(F.array_distinct(w)).alias("distinct"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    marks = F.struct(
        _without(text, r"[#*$%&|<>]+").alias("symbols"),
        _without(text, r"[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]+").alias("marks"),
        _without(text, "[.,;:!?]+").alias("points"),
        _without(text, "[A-Z]+").alias("capitals"),
    )
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l"), marks.alias("m")),
        lambda x: F.struct(
            *(
                value.cast("long").alias(name)
                for name, value in zip(
                    COUNTS,
                    (x["w"]["n"], x["w"]["chars"], x["m"]["symbols"], x["l"]["dup"], x["w"]["repeated"],
                     x["m"]["marks"], x["m"]["points"], x["m"]["capitals"], x["w"]["distinct"]),
                )
            )
        ),
    )


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the bins of every group's histograms."""
    each = rates.select(
        "lang", "source",
        F.inline(F.array(*(F.struct(F.lit(name).alias("rate"), F.col(f"r_{name}").alias("v")) for name in RATES))),
    )
    shift = F.greatest(F.length(F.bin("v")) - BITS, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), shift), shift)
    return each.groupBy("lang", "source", "rate", kept.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(bins: DataFrame, *group: str) -> DataFrame:
    """(group, rate, low, high) of the merged ``bins``."""
    keys = [*group, "rate"]
    merged = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"upto": upto, "total": F.sum("n").over(whole)})
    quartile = {k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin"))) for k in (1, 3)}
    return ranked.groupBy(*keys).agg(quartile[1].alias("low"), quartile[3].alias("high"))


def _same(*columns: str) -> Column:
    """``column`` here equals ``_column`` there, null to null."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def thresholds(bins: DataFrame, spread: int = SPREAD, small: int = SMALL) -> DataFrame:
    """(lang, source, low_<rate>..., high_<rate>...): the least and largest value of each rate that passes."""
    one_rate = F.col("rate") == next(iter(RATES))
    sizes = bins.where(one_rate).groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    in_lang = F.sum(F.when(F.col("docs") < small, F.col("docs"))).over(Window.partitionBy("lang"))
    level = F.when(F.col("docs") >= small, 0).when(in_lang >= small, 1).otherwise(2)
    groups = sizes.select("lang", "source", level.alias("level"))
    placed = bins.join(_renamed(groups, "lang", "source"), _same("lang", "source")).select(
        "rate", "bin", "n", "level", "lang", F.when(F.col("level") == 0, F.col("source")).alias("source")
    )
    own = _quartiles(placed.where("level < 2"), "level", "lang", "source")
    every = _quartiles(bins).select(F.lit(2).alias("level"), "rate", "low", "high")
    language = _quartiles(bins, "lang").select("lang", "rate", (F.col("high") - F.col("low")).alias("width"))
    named = groups.withColumn("pool", F.when(F.col("level") == 0, F.col("source")))
    near = _renamed(own, "level", "lang", "rate").withColumnRenamed("source", "_pool")
    found = named.where("level < 2").join(near, _same("level", "lang", "pool"))
    far = named.where("level = 2").join(every.withColumnRenamed("rate", "_rate"), "level")
    columns = ["lang", "source", "_rate", "low", "high"]
    edges = found.select(*columns).unionByName(far.select(*columns)).withColumnRenamed("_rate", "rate")
    wide = edges.join(_renamed(language, "lang", "rate"), _same("lang", "rate"))
    reach = spread * F.greatest(F.col("high") - F.col("low"), F.col("width")) + F.greatest(F.lit(1), F.shiftright("high", BITS - 1))
    limits = wide.select("lang", "source", "rate", (F.col("low") - reach).alias("low"), (F.col("high") + reach).alias("high"))
    sides = [F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{side}_{name}") for name in RATES for side in ("low", "high")]
    return limits.groupBy("lang", "source").agg(*sides)


def rate_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts, the rates and the base verdict."""
    found = docs.select(*(c for c in docs.columns if c != text), counted(F.col(text)).alias("_counts"))
    wide = found.select(*(c for c in found.columns if c != "_counts" and c not in COUNTS), "_counts.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rates = {f"r_{name}": F.expr(f"{part} * {scale} div greatest({whole}, 1L)") for name, (part, whole, scale) in RATES.items()}
    return wide.withColumns(rates).withColumn("base_failed", failed)


def judge(rated: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``rated`` (a written table: it is read twice) with ``kept`` and ``failed_rates``."""
    limits = _renamed(thresholds(sketches(rated.where("not base_failed")), spread), "lang", "source")
    off = {name: ~F.col(f"r_{name}").between(F.col(f"low_{name}"), F.col(f"high_{name}")) for name in RATES}
    failed = F.array_compact(F.array(*(F.when(off[name], F.lit(name)) for name in RATES)))
    return (
        rated.join(limits, _same("lang", "source"), "left")
        .withColumn("failed_rates", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rates") == 0))
        .drop("_lang", "_source")
    )


def quality_verdicts(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): counts, ``base_failed``, ``kept``."""
    narrow = docs.select("doc_id", "text", "lang", "source")
    rated = Scratch(docs.sparkSession, "quality").write(rate_documents(narrow), "rated")
    return judge(rated, spread)


def keep_good(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Counts depend on text, language and source only, so rows that agree in
    these and in ``doc_id`` have one verdict: the rejected keys are anti-joined.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", "lang", "source", text_key(F.col("text")).alias("_text_key"))
    rated = Scratch(spark, "quality").write(rate_documents(keyed), "rated")
    bad = (
        judge(rated, spread)
        .where(~F.col("kept"))
        .select(*(F.col(c).alias(f"_bad_{c}") for c in ("doc_id", "_text_key", "lang", "source")))
        .distinct()
    )
    named = docs.select(
        F.struct(*docs.columns).alias("whole"), "doc_id", "lang", "source", text_key(F.col("text")).alias("_text_key")
    )
    return named.join(
        bad,
        F.col("doc_id").eqNullSafe(F.col("_bad_doc_id"))
        & (F.col("_text_key") == F.col("_bad__text_key"))
        & F.col("lang").eqNullSafe(F.col("_bad_lang"))
        & F.col("source").eqNullSafe(F.col("_bad_source")),
        "left_anti",
    ).select("whole.*")
