"""Registered queries: a Spark plan and, where SQL can say it, its check."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    plan: Plan
    check: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name`` with the SQL that must agree with it."""

    def add(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(plan, check)
        return plan

    return add
