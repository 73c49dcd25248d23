"""Exact top-k by inner product, with a uniform threshold in three phases.

A vector is cut into ``PARTS`` segments; a query's score of a candidate is the
sum of its scores in the segments.  Candidates lie in blocks of like vectors: a
vector belongs to the nearest of at most ``PIVOTS`` pivots (the vectors with the
smallest hashes), and a pivot's vectors are dealt into as many blocks as they
fill.  A block keeps one list of scores per segment.

1. A query's local lists are those of the block it lies in itself.  The best
   ``k`` of every list are gathered and added up exactly; the k-th best sum is
   a score that k candidates reach: the safe cutoff.
2. The cutoff is sent to all blocks with the query.  What reaches it must
   reach its share, a ``PARTS``-th, in at least one segment.  A block knows the
   centre and the radius of each of its segments, so a list whose bound is
   below the share is not computed at all; of the others the entries at the
   share or above are collected.
3. The remaining segments are resolved for the collected entries alone.  Sums at the
   cutoff or above are sent, at most ``k`` per block and query; the best ``k`` of
   all blocks are the result.

Pivots decide only how many lists are left out, never what is found.
Components are turned into ``floor(256 * x)``, and scores are whole numbers.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part, nor do rows with a null id; vectors of different length do not
meet; rows with the query's own id are not its candidates; repeated ids are
candidates each, and queries of one id share one result; an empty table gives none.  Scores are 64 bits;
where they might not fit a double, every list is computed, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import Scratch

K = 5
PARTS = 4
SCALE = 256
PIVOTS, PIVOT_ROWS = 64, 256  # at most so many pivots, and one for so many vectors
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 8192, 1024, 128
PAIRS_AT_ONCE = 1 << 16
EXACT = 2.0**53


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The quantised vectors, one a row."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * values).reshape(len(lists), len(values) // max(1, len(lists)))


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all scores exactly."""
    return (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1]) < EXACT


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if _fits(a, b):
        return (a @ b.T).astype(np.int64)
    return np.array(
        [[sum(int(x) * int(y) for x, y in zip(u, v)) & (2**64 - 1) for v in b] for u in a], dtype=np.uint64
    ).astype(np.int64)


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _segments(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(PARTS, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def open_lists(wanted: np.ndarray, rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(query, segment): whether the segment's list of ``rows`` may hold an entry at the query's share or above.

    No entry exceeds the score of the centre plus the radius times the query's length.
    """
    out = []
    for s in _segments(rows.shape[1]):
        centre = rows[:, s].mean(axis=0)
        radius = np.sqrt(((rows[:, s] - centre) ** 2).sum(axis=1).max())
        bound = wanted[:, s] @ centre + np.sqrt((wanted[:, s] ** 2).sum(axis=1)) * radius
        out.append(bound + 1e-9 * np.abs(bound) + 1 >= shares)  # more than what rounding can take away
    return np.array(out).T


def _collected(wanted: np.ndarray, rows: np.ndarray, cutoffs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores): phases 2 and 3 of a block, for queries that have a cutoff."""
    parts = _segments(rows.shape[1])
    shares = -((-cutoffs) // len(parts))  # a whole score below this is below the share
    opened = open_lists(wanted, rows, shares)
    places = []
    for s, part in enumerate(parts):
        js = np.flatnonzero(opened[:, s])
        if len(js):
            j, i = np.nonzero(_score(wanted[js][:, part], rows[:, part]) >= shares[js][:, None])
            places.append(js[j] * len(rows) + i)
    if not sum(map(len, places)):
        return
    places = np.unique(np.concatenate(places))
    kept, scores = [], []
    for first in range(0, len(places), PAIRS_AT_ONCE):
        some = places[first : first + PAIRS_AT_ONCE]
        j, i = np.divmod(some, len(rows))
        total = np.einsum("ij,ij->i", wanted[j], rows[i]).astype(np.int64)
        reach = total >= cutoffs[j]
        kept.append(some[reach])
        scores.append(total[reach])
    j, i = np.divmod(np.concatenate(kept), len(rows))
    total = np.concatenate(scores)
    edges = np.searchsorted(j, np.arange(len(wanted) + 1))
    for q, (a, b) in enumerate(zip(edges, edges[1:])):
        yield q, i[a:b], total[a:b]


def _gathered(wanted: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query, candidates, scores): the best of the block's lists, added up."""
    lists = [_score(wanted[:, s], rows[:, s]) for s in _segments(rows.shape[1])]
    for q in range(len(wanted)):
        other = np.flatnonzero(ids != own[q])
        at = np.unique(np.concatenate([other[_best(ids[other], x[q][other], k)] for x in lists]))
        yield q, at, sum(x[q][at] for x in lists)


def _all(wanted: np.ndarray, rows: np.ndarray):
    for q, scores in enumerate(_score(wanted, rows)):
        yield q, np.arange(len(rows)), scores


def _block(k: int, with_cutoff: bool):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(candidates) and len(queries):
            ids, rows = candidates["vec_id"].to_numpy(), _vectors(candidates["embedding"])
            asked, wanted = queries["q_id"].to_numpy(), _vectors(queries["q_vec"])
            exact = _fits(wanted, rows)
            if with_cutoff:
                known = ~np.asarray(queries["cutoff"].is_null())
                cutoffs = queries["cutoff"].fill_null(0).to_numpy()
            for first in range(0, len(asked), AT_ONCE):
                here = np.arange(first, min(first + AT_ONCE, len(asked)))
                if not with_cutoff:
                    # Without exact sums there is no bound to be had from a cutoff.
                    found = [(here, _gathered(wanted[here], rows, ids, asked[here], k))] if exact else []
                elif exact:
                    # A query without a cutoff has fewer than k candidates in its own block.
                    sure, open_ = here[known[here]], here[~known[here]]
                    found = [(sure, _collected(wanted[sure], rows, cutoffs[sure])), (open_, _all(wanted[open_], rows))]
                else:
                    found = [(here, _all(wanted[here], rows))]
                for which, results in found:
                    for q, at, total in results:
                        own = asked[which[q]]
                        other = ids[at] != own
                        at, total = at[other], total[other]
                        best = _best(ids[at], total, k)
                        out[0].append(np.full(len(best), own))
                        out[1].append(ids[at][best])
                        out[2].append(total[best])
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], schema=OUT)

    return run


def _nearest(pivots: list[list[float]]):
    """Adds ``_p``, the nearest pivot; vectors of another length than the pivots' have the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(pivots, float)
        for batch in batches:
            lists = batch["embedding"]
            found = np.zeros(len(lists), np.int32)
            same = np.flatnonzero(np.asarray(lists.value_lengths()) == points.shape[1])
            if len(same) and points.shape[1]:
                values = lists.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(float)
                far = (points**2).sum(axis=1) / 2 - values.reshape(len(same), -1) @ points.T
                found[same] = far.argmin(axis=1)
            yield batch.append_column("_p", pa.array(found))

    return run


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds; ``vectors``: (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    valid = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        is_query.alias("_query"),
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & _finite(F.col("embedding")))
    n = valid.count()
    # At most PIVOTS vectors come to the driver, and as many counts.
    drawn = valid.orderBy(F.xxhash64("embedding", "vec_id"), "vec_id").limit(max(1, min(PIVOTS, -(-n // PIVOT_ROWS))))
    points = [list(r["embedding"]) for r in drawn.select("embedding").collect()] or [[]]
    points = [p for p in points if len(p) == len(points[0])]
    near = scratch.write(
        valid.withColumn("_r", F.monotonically_increasing_id()).mapInArrow(
            _nearest(points), "vec_id long, embedding array<double>, _query boolean, _r long, _p int"
        ),
        "placed",
    )
    counts = {r["_p"]: r["count"] for r in near.groupBy("_p").count().collect()}
    blocks_of = [-(-counts.get(p, 0) // BLOCK_ROWS) for p in range(len(points))]
    starts = [sum(blocks_of[:p]) for p in range(len(points))]
    c_blocks = max(1, sum(blocks_of))

    def of_pivot(values: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("_p")]

    block = of_pivot(starts) + F.pmod(F.col("_r"), F.greatest(F.lit(1), of_pivot(blocks_of))).cast("int")
    placed = near.select("vec_id", "embedding", "_query", F.size("embedding").alias("_w"), block.alias("_c"))
    queries = scratch.write(
        placed.where("_query").groupBy(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
        .agg(F.min("_c").alias("_home")).withColumn("_qw", F.size("q_vec")),
        "queries",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    result = "query_id long, vec_id long, score long"
    local = placed.groupBy("_w", "_c").cogroup(queries.groupBy("_qw", "_home")).applyInArrow(_block(k, False), result)
    first = scratch.write(ranked(local).where(F.col("rank") == k), "cutoffs")
    cutoffs = first.select(F.col("query_id").alias("_id"), F.col("score").alias("cutoff"))

    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    left = placed.drop("_query").withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = (
        queries.join(cutoffs, F.col("q_id") == F.col("_id"), "left")
        .select("q_id", "q_vec", "cutoff", "_qw", F.pmod(F.xxhash64("q_id"), F.lit(q_blocks)).cast("int").alias("_qq"))
        .withColumn("_qc", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    )
    found = left.groupBy("_w", "_c", "_q").cogroup(right.groupBy("_qw", "_qc", "_qq")).applyInArrow(_block(k, True), result)
    return ranked(found).select("query_id", "rank", "vec_id", "score")
