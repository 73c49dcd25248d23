"""Streams that keep derived tables up to date.

Each micro-batch writes its own partition directory in overwrite mode, so a
batch replayed after a failure replaces its first attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkgraph.operators.enrichment import enrich_prominence
from linkgraph.operators.incremental import RATE_SECONDS
from linkgraph.operators.projection import canonical_pair
from linkgraph.session import materialize, path_exists

BATCH = "batch"


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows written by batches before ``batch_id``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    return table.filter(F.col(BATCH) < batch_id).drop(BATCH)


def edge_maintainer(path: str):
    """A ``foreachBatch`` function that turns arriving memberships
    ``(group_id, entity_id)`` into new edges below ``path``.

    Only pairs with at least one new member are formed; edges seen before are
    not written again.
    """

    def maintain(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        members_schema = batch.select("group_id", "entity_id").schema
        key = members_schema["entity_id"].dataType.simpleString()
        group = members_schema["group_id"].dataType.simpleString()
        known = _earlier(spark, f"{path}/members", f"group_id {group}, entity_id {key}", batch_id)
        fresh = materialize(
            batch.select("group_id", "entity_id")
            .distinct()
            .join(known, ["group_id", "entity_id"], "left_anti"),
            "fresh-members",
        )
        everyone = known.unionByName(fresh)
        pairs = (
            fresh.select("group_id", F.col("entity_id").alias("x"))
            .join(everyone.select("group_id", F.col("entity_id").alias("y")), "group_id")
            .filter("x <> y")
            .select(*canonical_pair("x", "y"))
            .distinct()
        )
        seen = _earlier(spark, f"{path}/edges", f"src {key}, dst {key}", batch_id)
        new_edges = pairs.join(seen, ["src", "dst"], "left_anti")
        new_edges.write.mode("overwrite").parquet(f"{path}/edges/{BATCH}={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{path}/members/{BATCH}={batch_id}")

    return maintain


def maintain_edges(memberships: DataFrame, path: str) -> StreamingQuery:
    """Run :func:`edge_maintainer` over everything the stream has now."""
    return (
        memberships.writeStream.foreachBatch(edge_maintainer(path))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )


def sliding_rate(events: DataFrame, key: str, stamp: str, seconds: int = RATE_SECONDS, slide: int = 10) -> DataFrame:
    """Events per key in sliding event-time windows, closed after one minute
    of lateness."""
    return (
        events.withWatermark(stamp, "1 minute")
        .groupBy(F.window(stamp, f"{seconds} seconds", f"{slide} seconds"), key)
        .agg(F.count(F.lit(1)).alias("recent"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "recent"
        )
    )


def append_available(stream: DataFrame, path: str) -> StreamingQuery:
    """Append all currently available results to a parquet table."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )


def enrich_stream(entities: DataFrame, external: DataFrame, degrees: DataFrame, path: str) -> StreamingQuery:
    """Enrich newly arriving entities once; the checkpoint marks those done."""

    def enrich(batch: DataFrame, batch_id: int) -> None:
        enrich_prominence(batch, external, degrees).write.mode("overwrite").parquet(
            f"{path}/table/{BATCH}={batch_id}"
        )

    return (
        entities.writeStream.foreachBatch(enrich)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
