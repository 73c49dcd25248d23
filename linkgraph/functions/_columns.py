"""Small shared column helpers."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Union[str, Column]


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
