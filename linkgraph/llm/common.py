"""Helpers shared by the operators: text expressions, row keys, scratch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.session import scratch_path

#: ASCII white space, as a class for Java's, Python's and DuckDB's expressions.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` serves where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The runs between ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_key(text: Column) -> Column:
    """64 bits that tell texts of one id apart; null differs from empty."""
    return F.xxhash64(text.isNull(), text)


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` in one run of an operator.

    A written table cuts the lineage and outlives executors.  ``drop`` removes
    tables that later ones no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path, **options)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables, and let the driver's JVM notice which shuffles nobody refers to any more: their files go too."""
        self.spark._jvm.System.gc()
        for name in names:
            for path in self.paths.pop(name, []):
                location = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                location.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(location, True)
