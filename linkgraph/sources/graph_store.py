"""A stored graph: one parquet directory per table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from linkgraph.operators.titles import title_lineup
from linkgraph.session import path_exists

TABLES = ("nodes", "aliases", "edges", "titles", "references", "credits")


@dataclass(frozen=True)
class Graph:
    """The tables of a co-credit graph.

    nodes(id, name, degree) · aliases(entity_id, alias, alias_norm) ·
    edges(src, dst) with src < dst · titles(src, dst, title, rank) ·
    references(src, dst, title, group_id, groups), the groups behind a title and their number ·
    credits(group_id, entity_id, name), their members.

    Line-ups are kept by reference and expanded for the edges that are asked for.
    """

    nodes: DataFrame
    aliases: DataFrame
    edges: DataFrame
    titles: DataFrame
    references: DataFrame
    credits: DataFrame

    def lineups(self, edges: DataFrame | None = None) -> DataFrame:
        """``(src, dst, title, entity_id, name)``, one row per credited member, of ``edges(src, dst)`` or of all."""
        asked = self.references if edges is None else self.references.join(edges, ["src", "dst"], "left_semi")
        return title_lineup(asked, self.credits)


class GraphNotFound(FileNotFoundError):
    """No stored graph at any of the given locations."""


def save_graph(graph: Graph, path: str) -> None:
    """Write a full refresh to ``path``.

    Point ``path`` at a candidate location, verify it there, and only then
    make readers use it; a failed build never replaces a good graph.
    """
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether every table of a graph was written to its end."""
    return all(path_exists(spark, f"{path}/{name}/_SUCCESS") for name in TABLES)


def promote_graph(spark: SparkSession, candidate: str, path: str) -> None:
    """Put a complete graph in the place of the one at ``path``, which is kept as ``<path>-previous``."""
    if not is_complete(spark, candidate):
        raise GraphNotFound(f"no complete graph in {candidate}")
    location = spark._jvm.org.apache.hadoop.fs.Path
    files = location(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(location(path)):
        files.delete(location(f"{path}-previous"), True)
        files.rename(location(path), location(f"{path}-previous"))
    if not files.rename(location(candidate), location(path)):
        raise OSError(f"{candidate} could not be moved to {path}")


def load_graph(spark: SparkSession, paths: Sequence[str]) -> Graph:
    """The first location that holds a complete graph: explicit, primary, legacy."""
    for path in filter(None, paths):
        if is_complete(spark, path):
            return Graph(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})
    raise GraphNotFound(f"no graph in {[p for p in paths if p]}")
