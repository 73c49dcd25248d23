"""Drop lines that stand in many documents.

A line's key is the line without ASCII white space at its ends, A-Z
lower-cased.  Lines are exploded as 128 bits of hash, never as text; per hash
the distinct documents are counted (partially before each of two shuffles, so
that a line of every document is no hot group), and lines over the threshold go
from every document but the one with the largest id.  A document gets the
positions of its dropped lines and puts the rest together in order.

Defined cases: a null or empty text is one empty line and becomes an empty
text; keys shorter than ``min_chars`` code points always stay; a null doc_id is
a document below all others, whose lines never outlast theirs; rows with one doc_id
count as one document, and each is cleaned by itself; an empty table gives
none; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import NO_ID, SPACES, Scratch, ascii_lower, let, text_key

MIN_CHARS = 20
MIN_DOCS = 3


def _key_hashes(text: Column, min_chars: int) -> Column:
    """(pos, h1, h2) of each line whose key is long enough."""
    trimmed = F.transform(
        F.split(ascii_lower(text), "\n"), lambda line, i: F.struct(F.trim(line, F.lit(SPACES)).alias("k"), i.alias("pos"))
    )
    return F.transform(
        F.filter(trimmed, lambda x: F.char_length(x["k"]) >= min_chars),
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("line"), x["k"]).alias("h2")
        ),
    )


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _key, dropped): positions of the lines that go, per document and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.write(
        docs.select(
            F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
            text_key(F.col("text")).alias("_key"),
            F.inline(_key_hashes(text, min_chars)),
        ),
        "hashed",
    )
    common = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("_id").alias("n_docs"), F.max("_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # Written, so that the join deals both sides itself and may split a line that most documents have.
    common = scratch.write(common, "common")
    gone = lines.join(common, ["h1", "h2"]).where(F.col("_id") != F.col("keeper"))
    return gone.groupBy("_id", "_key").agg(F.collect_set("pos").alias("dropped"))


def clean_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with cleaned ``text``, and ``n_lines`` (before) and ``n_dropped``."""
    gone = dropped_positions(docs.select("doc_id", "text"), min_docs, min_chars)
    # Other columns travel as one, so that none of their names meets one made here.
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    keyed = docs.select(
        F.struct(*others).alias("others"), "text",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), text_key(F.col("text")).alias("_key"),
    )
    joined = keyed.join(gone, ["_id", "_key"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))

    def rebuilt(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
        return F.struct(
            F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return joined.select(
        "others",
        let(F.split(text, "\n"), rebuilt).alias("new"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    ).select("others.*", "new.text", "new.n_lines", "n_dropped")
