"""Judge urls by host and path rules, by a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot: the keys of
a domain and all its subdomains share that domain's key as a prefix and lie
next to each other in order.  So a rule's host is an interval, and intervals
are nested or apart.  Rules and urls are sorted together by key; a sweep keeps
the stack of rule hosts whose interval is open, and looks up the url's path in
the rules of each.

Urls are dealt by the hash of their last two labels, and by a salt of their own
so that one host may hold most of them.  The urls of each hash are counted first, and a
hash gets as many salts as it needs for ``ROWS`` urls a place (at least ``SALTS``).  A rule
goes wherever urls of its host may be (those of a single label to every place).  One count for
each of the ``GROUPS`` hashes comes to the driver, nothing is broadcast and the sweep holds open rules only.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and gets the default verdict; empty labels are labels; repeated
urls are judged one by one; of rules of one length the one with the longer host wins, of rules alike the blocking one; an
empty table gives none; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm.common import LOWER, UPPER

GROUPS, SALTS = 64, 16
ROWS = 250_000
DEFAULT = "allow"
#: The rules in force: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def host_key(host: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``; the empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    )


def _group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(key, ".", 2)), F.lit(groups)).cast("int")


def _best(stack: list[tuple[str, dict, set]], path: str) -> tuple[str | None, str | None]:
    """The longest rule among the open hosts that fits ``path``."""
    best = None
    for key, rules, lengths in stack:
        for n in lengths:
            if n <= len(path) and (verdict := rules.get(path[:n])):
                rule = ".".join(reversed(key[:-1].split("."))) + path[:n]
                if best is None or len(rule) >= len(best[0]):  # hosts get longer up the stack
                    best = (rule, verdict)
    return best or (None, None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (_bucket, _key, _kind): rules (_kind 0) before the urls of their host."""
    stack: list[tuple[str, dict, set]] = []
    bucket = None
    for batch in batches:
        rules, verdicts, urls = [], [], []
        columns = (batch["_bucket"], batch["_key"], batch["_kind"], batch["_path"], batch["_rule_verdict"])
        for i, (b, key, kind, path, verdict) in enumerate(zip(*(c.to_pylist() for c in columns))):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind:
                rule, verdict = _best(stack, path)
                urls.append(i)
                rules.append(rule)
                verdicts.append(verdict)
                continue
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, set()))
            _, open_rules, lengths = stack[-1]
            if open_rules.get(path) != "block":
                open_rules[path] = verdict
            lengths.add(len(path))
        kept = batch.take(pa.array(urls, pa.int64()))
        names = [n for n in batch.schema.names if not n.startswith("_")]
        yield pa.RecordBatch.from_arrays(
            [*(kept[n] for n in names), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=[*names, "rule", "verdict"],
        )


def places(keys: DataFrame, groups: int, salts: int, rows: int) -> tuple[list[int], list[int]]:
    """The first bucket and the number of buckets of each hash; ``keys``: a row (_key) for each url."""
    counts = {r["g"]: r["n"] for r in keys.groupBy(_group_of(F.col("_key"), groups).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    widths = [max(salts, -(-counts.get(g, 0) // rows)) for g in range(groups)]
    return [0, *accumulate(widths)][:-1], widths


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = DEFAULT,
    groups: int = GROUPS,
    salts: int = SALTS,
    rows: int = ROWS,
) -> DataFrame:
    """``pages`` without other columns of these names, with ``host``, ``path``, ``rule`` and ``verdict``.

    Columns whose names begin with an underscore are left out.
    """
    host, path = host_and_path(F.col("url"))
    made = ("host", "path", "rule", "verdict")
    carried = [c for c in pages.columns if c not in made and not c.startswith("_")]
    hosts = pages.select(*carried, host.alias("host"), path.alias("path")).withColumn("_key", host_key(F.col("host")))
    starts, widths = places(hosts.select("_key"), groups, salts, rows)
    of = lambda values: F.get(F.array(*map(F.lit, values)), _group_of(F.col("_key"), groups))
    salt = F.pmod(F.xxhash64("url", *(c for c in ("page_id",) if c in carried)), of(widths)).cast("int")
    urls = hosts.select(
        *carried, "host", "path", "_key", (of(starts) + salt).alias("_bucket"),
        F.lit(1).alias("_kind"), F.col("path").alias("_path"), F.lit(None).cast("string").alias("_rule_verdict"),
    )
    rule_key = host_key(F.translate("host", UPPER, LOWER))
    keyed = rules.select(rule_key.alias("_key"), F.col("path").alias("_path"), F.col("verdict").alias("_rule_verdict"))
    keyed = keyed.where((F.col("_key") != "") & F.col("_path").isNotNull())
    labels = F.size(F.split("_key", r"\.")) - 1
    of_group = F.sequence(of(starts), of(starts) + of(widths) - 1)
    everywhere = F.sequence(F.lit(0), F.lit(sum(widths) - 1))
    sent = keyed.select(
        "_key", "_path", "_rule_verdict", F.lit(0).alias("_kind"),
        F.explode(F.when(labels > 1, of_group).otherwise(everywhere)).alias("_bucket"),
    )
    together = urls.unionByName(sent, allowMissingColumns=True)
    schema = ", ".join(f"`{c}` {together.schema[c].dataType.simpleString()}" for c in [*carried, "host", "path"])
    swept = (
        together.repartition("_bucket")
        .sortWithinPartitions("_bucket", "_key", "_kind")
        .mapInArrow(_sweep, f"{schema}, rule string, verdict string")
    )
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
