"""Free-text names resolved to ranked entities, for a whole query table.

Ranking: match tier (0 prefix, 1 substring, 2 similar), prominence, name, id.
Work happens on distinct folded texts.  All entities behind one text share its
tier, so of each text only the ``limit`` most prominent entities can appear in
a result of ``limit`` rows; cutting there is exact and keeps a name shared by
a third of all entities small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions.similarity import (
    SCORE_CUTOFF,
    char_bits,
    edit_score,
    enough_shared,
    lengths_fit,
    long_sequence_score,
    sequence_score,
    sorted_tokens,
    with_char_tokens,
    with_signature,
)
from linkgraph.functions.text import fold_name, same_name
from linkgraph.operators.containment import substring_pairs
from linkgraph.operators.ranking import (
    exact_lookup,
    label_candidates,
    promote_prominent,
    rank_by,
    with_prominence,
)
from linkgraph.session import materialize

# Defaults of the search.
DEFAULT_LIMIT = 10
SERVICE_LIMIT = 8
FUZZY_MIN_RESULTS = 3
MIN_QUERY_CHARS = 2

# A scorer by name, or a function of two token-sorted text columns.
Scorer = str | Callable[[Column, Column], Column]

_ENTITY = ["id", "name", "popularity", "degree", "primary", "secondary"]


def _rank_order() -> list:
    return [F.asc("tier"), F.desc("primary"), F.desc("secondary"), F.asc("name"), F.asc("id")]


def asked(queries: DataFrame) -> DataFrame:
    """Distinct queries with their folded form; nothing to fold, no query."""
    folded = queries.select("query").distinct().withColumn("folded", fold_name("query"))
    return folded.filter("folded <> ''")


def tier_hits(queries: DataFrame, entities: DataFrame, aliases: DataFrame, limit: int) -> DataFrame:
    """Prefix and substring matches on names and aliases, best tier per entity.

    ``queries(query, folded)``; ``entities`` with prominence keys.
    """
    by_alias = (
        aliases.select(F.col("entity_id").alias("id"), fold_name("alias").alias("text"))
        .join(entities.select(*_ENTITY), "id")
        .select("text", *_ENTITY)
    )
    surfaces = entities.select(fold_name("name").alias("text"), *_ENTITY).unionByName(by_alias).distinct()
    order = [F.desc("primary"), F.desc("secondary"), F.asc("name"), F.asc("id")]
    best = rank_by(surfaces, ["text"], order, limit).drop("rank")
    matches = substring_pairs(queries, "folded", surfaces, "text").select(
        F.col("needle").alias("folded"),
        "text",
        F.when(F.startswith("text", "needle"), 0).otherwise(1).alias("tier"),
    )
    hits = (
        matches.join(best, "text")
        .groupBy("folded", *_ENTITY)
        .agg(F.min("tier").alias("tier"))
    )
    top = rank_by(hits, ["folded"], _rank_order(), limit)
    return queries.join(top, "folded").select("query", *_ENTITY, "tier", "rank")


def _compared(texts: DataFrame, label: str) -> DataFrame:
    """Distinct ``text`` values numbered, with what they are compared by, computed once each."""
    made = texts.select("text").distinct().withColumn("sorted", sorted_tokens("text"))
    made = with_char_tokens(made, "sorted", "bag").withColumn("bits", char_bits("sorted"))
    return materialize(made.withColumn("no", F.monotonically_increasing_id()), label)


def _by_tokens(pairs: DataFrame) -> DataFrame:
    """Score pairs in the JVM; only pairs of two texts too long for a row of bits need Python."""
    fits = F.col("left_bits").isNotNull() | F.col("right_bits").isNotNull()
    short = pairs.filter(fits).withColumn("score", sequence_score("left", "right", "left_bits", "right_bits"))
    return short.unionByName(pairs.filter(~fits).withColumn("score", long_sequence_score("left", "right")))


def similar_texts(needles: DataFrame, texts: DataFrame, scorer: Scorer = "token_sort") -> DataFrame:
    """``(folded, text, score)`` of all pairs that score at least the cutoff.

    An equi-join on the signature finds every qualifying pair by number; lengths are
    compared in the join and bags of characters before the score is computed.
    ``scorer`` is ``token_sort`` (subsequence ratio), ``edit``, or a function of two
    token-sorted columns that gives no pair more than ``200 * common characters / (m + n)``.
    """
    if isinstance(scorer, str) and scorer not in ("token_sort", "edit"):
        raise ValueError(f"unknown scorer {scorer!r}")
    asked_for = _compared(needles.select(F.col("folded").alias("text")), "asked-texts")
    stored = _compared(texts, "stored-texts")

    def keyed(side: DataFrame, name: str) -> DataFrame:
        sized = side.select(F.col("no").alias(name), F.size("bag").alias(f"{name}_size"), "bag")
        return with_signature(sized, "bag", "key").drop("bag")

    near = (
        keyed(asked_for, "asked")
        .join(keyed(stored, "stored"), "key")
        .filter(lengths_fit("asked_size", "stored_size"))
        .select("asked", "stored")
        .distinct()
    )

    def side(table: DataFrame, number: str, text: str, name: str) -> DataFrame:
        return table.select(
            F.col("no").alias(number), F.col("text").alias(text), F.col("sorted").alias(name),
            F.col("bag").alias(f"{name}_bag"), F.col("bits").alias(f"{name}_bits"),
        )

    pairs = near.join(side(asked_for, "asked", "folded", "left"), "asked").join(side(stored, "stored", "text", "right"), "stored")
    likely = pairs.filter(enough_shared("left_bag", "right_bag"))
    if scorer == "token_sort":
        # Read for short and for long texts.
        kept = ["folded", "text", "left", "right", "left_bits", "right_bits"]
        scored = _by_tokens(materialize(likely.select(*kept), "near-texts"))
    else:
        score = edit_score if scorer == "edit" else scorer
        scored = likely.withColumn("score", score(F.col("left"), F.col("right")))
    return scored.filter(F.col("score") >= SCORE_CUTOFF).select("folded", "text", "score")


def fuzzy_candidates(
    queries: DataFrame, entities: DataFrame, limit: int = DEFAULT_LIMIT, scorer: Scorer = "token_sort"
) -> DataFrame:
    """Similar canonical names per query, best score first, id on ties.

    ``queries(query, folded)``.  Aliases are not searched.
    """
    named = entities.withColumn("text", fold_name("name"))
    per_text = rank_by(named, ["text"], [F.asc("id")], limit).drop("rank")
    scored = similar_texts(queries.select("folded").distinct(), named.select("text").distinct(), scorer)
    hits = rank_by(
        scored.join(per_text, "text"), ["folded"], [F.desc("score"), F.asc("id")], limit
    ).drop("text")
    return queries.join(hits, "folded").drop("folded")


def resolve(
    queries: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    limit: int = DEFAULT_LIMIT,
    scorer: Scorer | None = "token_sort",
) -> DataFrame:
    """Ranked candidates per query: tiers, similar names when thin, override.

    ``queries(query)``; ``entities(id, name, popularity, degree, enriched)``;
    ``aliases(entity_id, alias)``.  ``scorer=None`` leaves out similar names.
    """
    ranked_entities = with_prominence(entities)
    wanted = materialize(asked(queries), "asked")
    hits = tier_hits(wanted, ranked_entities, aliases, limit)
    if scorer is not None:
        # Read three times below: to find thin queries, to merge, to exclude.
        hits = materialize(hits, "hits")
        counts = hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
        thin = (
            wanted.join(counts, "query", "left")
            .filter(F.coalesce("hits", F.lit(0)) < min(FUZZY_MIN_RESULTS, limit))
            .drop("hits")
        )
        extra = fuzzy_candidates(thin, ranked_entities, limit, scorer).select(
            "query", *_ENTITY, F.lit(2).alias("tier"), (F.col("rank") + limit).alias("rank")
        )
        fresh = extra.join(hits.select("query", "id"), ["query", "id"], "left_anti")
        both = hits.unionByName(fresh).withColumnRenamed("rank", "arrival")
        hits = rank_by(both, ["query"], [F.asc("arrival")], limit).drop("arrival")
    return promote_prominent(hits).select("query", "rank", "id", "name", "popularity", "degree", "tier")


def search(
    queries: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    limit: int = SERVICE_LIMIT,
    scorer: Scorer | None = "token_sort",
) -> DataFrame:
    """Search rows for display: labels and whether the name is the query.

    Queries are trimmed; fewer than two characters give no candidates.
    """
    usable = queries.select(F.trim("query").alias("query")).filter(F.length("query") >= MIN_QUERY_CHARS)
    found = label_candidates(resolve(usable, entities, aliases, limit, scorer))
    return found.withColumn("matches_query", same_name("name", "query"))


def identify(
    queries: DataFrame, entities: DataFrame, aliases: DataFrame, scorer: Scorer | None = "token_sort"
) -> DataFrame:
    """One entity per query: the exact name, else the exact alias, else the
    first search hit.  Queries that find nothing are absent."""
    exact = materialize(exact_lookup(queries, entities, aliases), "exact")
    rest = exact.filter("id IS NULL").select("query")
    searched = resolve(rest, entities, aliases, limit=1, scorer=scorer).select(
        "query", "id", "name", F.lit("search").alias("matched_by")
    )
    return exact.filter("id IS NOT NULL").unionByName(searched)


def submit(results: DataFrame) -> DataFrame:
    """What a submitted query resolves to, and a notice if the name differs."""
    return results.filter("rank = 1").select(
        "query", "id", "name", (~F.col("matches_query")).alias("notice")
    )
