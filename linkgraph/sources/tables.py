"""Readers for header-less dump tables and schema conforming."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgraph.functions._columns import union_all
from linkgraph.session import path_exists

NULL_MARKER = "\\N"


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_tsv(
    spark: SparkSession, path: str, layout: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """A tab-separated table without header, quoting or escaping.

    ``layout`` names the file's columns by position.  Short rows are padded
    with NULL and the dump's NULL marker becomes NULL.  Selecting ``columns``
    lets the reader skip parsing the others.
    """
    table = spark.read.csv(
        path,
        schema=text_schema(layout),
        sep="\t",
        quote="",
        escape="",
        nullValue=NULL_MARKER,
        mode="PERMISSIVE",
        encoding="UTF-8",
    )
    return table.select(*columns) if columns else table


def scan_ragged(
    spark: SparkSession, path: str, layout: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Like :func:`scan_tsv`, but rows that end before the last wanted column
    are dropped, and text is taken as it stands."""
    position = {name: layout.index(name) for name in columns}
    fields = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).select(fields.alias("fields"))
    wide_enough = rows.filter(F.size("fields") > max(position.values()))
    return wide_enough.select(*[F.col("fields")[i].alias(n) for n, i in position.items()])


def optional_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one when it was never staged."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``.

    Missing columns are added with their default (or NULL), present ones are
    cast, others are dropped.
    """
    defaults = defaults or {}
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def profile(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row and byte counts per expected table; ``None`` marks an absent one.

    Bytes are the text size of all fields, as a dump file would store them.
    """
    def one(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            raise ValueError("absent tables are added by profile")
        width = F.octet_length(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])) + 1
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).alias("n_bytes")
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_bytes", F.lit(True).alias("present"))

    parts = []
    for name, df in tables.items():
        if df is not None:
            parts.append(one(name, df))
    spark = next(df for df in tables.values() if df is not None).sparkSession
    absent = [(name, None, None, False) for name, df in tables.items() if df is None]
    if absent:
        parts.append(
            spark.createDataFrame(
                absent, "table_name string, n_rows bigint, n_bytes bigint, present boolean"
            )
        )
    return union_all(parts)
