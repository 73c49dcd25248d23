"""A Merkle tree over a dataset, with every row's proof, by a butterfly exchange.

Rows are leaves, in order of ``doc_id`` within their source.  Aligned runs of
``FANOUT ** part_levels`` leaves are partitions, each of which hashes its own
subtree.  Then partitions swap roots: in round ``r`` those whose numbers differ
in digit ``r`` alone (base ``FANOUT``) meet, and each of them hashes their common
ancestor for itself.  So after the last round every partition knows the root
and the siblings on its way up, and no pass leads down again.  The last subtree of a
level may be incomplete; its partitions then also answer for the numbers that
are missing.  Sources are swapped in the same way, as partitions of one tree over
their roots.

A node is the lowercase hex sha256 of its children's hex digests, joined.  While a
tree has several nodes on a level, every run of ``FANOUT`` becomes one node, even
a run of one.

Defined cases: nulls are leaves' fields ("-") and sort first, a null source is a
source, first in order, and a null ``doc_id`` is never tampered with; equal ids
are ordered by leaf, equal leaves are interchangeable; one row is its own root,
with an empty proof; an empty table gives no rows; other columns are dropped,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import Scratch, ascii_lower
from linkgraph.llm.positions import in_order, placed

FANOUT = 16
PART_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over the fields, each with its length in bytes, so that no two rows are written alike."""

    def marked(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(marked, fields)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, claimed): ``claimed`` is the leaf of what a reader of the dataset holds, here
    with lower-cased text where 5 divides the id's crc32."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    own = leaf_digest([F.col(c) for c in FIELDS])
    other = leaf_digest([*(F.col(c) for c in FIELDS[:-1]), ascii_lower(F.col("text"))])
    return docs.select("doc_id", "source", own.alias("leaf"), F.when(tampered, other).alias("claimed"))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool, depth: int) -> list[list[str]]:
    """The levels of a partition's subtree, leaves first.  A ``whole`` tree ends at its root, others after ``depth`` steps."""
    levels = [nodes]
    for _ in range(depth):
        last = levels[-1]
        if whole and len(last) == 1:
            break
        levels.append([_hash("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return levels


def _parts(leaf_rows: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(tree, part, parts, rows, node): every partition's leaves, at most ``FANOUT ** depth``, and its root."""
    size = FANOUT**depth
    keyed = leaf_rows.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree"),
        "doc_id",
        F.unhex("leaf").alias("leaf"),
        F.unhex("claimed").alias("claimed"),
    )
    narrow = scratch.write(keyed, "leaves")
    rows = placed(in_order(narrow, "tree", ["doc_id", "leaf"], scratch, "sorted"), "tree")
    parts = rows.groupBy(
        "tree",
        F.floor(F.col("_at") / size).alias("part"),
        F.ceil(F.col("_total") / size).alias("parts"),
    ).agg(F.array_sort(F.collect_list(F.struct("_at", "doc_id", "leaf", "claimed"))).alias("rows"))
    schema = parts.withColumn("node", F.lit("")).schema

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for rows, parts in zip(batch.column("rows"), batch.column("parts")):
                hexes = [row["leaf"].as_py().hex() for row in rows]
                roots.append(levels_of(hexes, parts.as_py() == 1, depth)[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "node"])

    return scratch.write(parts.mapInArrow(rooted, schema), "parts")


def _answers(low: Column, span: int, mine: Column) -> Column:
    """The numbers ``low``, ``low + mine``, ... below ``span`` that a partition answers for."""
    return F.sequence(low, F.lit(span - 1).cast("long"), mine)


def exchange(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(tree, part, root, path) for ``nodes`` (tree, part from 0, parts of the tree, node)."""
    most = nodes.agg(F.max("parts")).first()[0] or 0
    state = nodes.select("tree", "part", "parts", "node", F.array().cast(PATH).alias("path"))
    span = 1
    while span < most:
        wide = span * FANOUT
        left = F.col("parts") - F.floor(F.col("part") / span) * span
        mine, low = F.least(left, F.lit(span)), F.col("part") % span
        digit = (F.floor(F.col("part") / span) % FANOUT).cast("int")
        own = F.struct(low.alias("low"), F.col("part").alias("part"), F.col("path").alias("path"))
        # an incomplete subtree with complete ones before it stands in for its missing partitions
        stands_in = (mine < span) & (digit > 0) & (low + mine < span)
        going = state.where(F.col("parts") > span)
        sent = going.select(
            "tree", "parts", F.floor(F.col("part") / wide).alias("family"), digit.alias("digit"), "node", low.alias("low"), own.alias("home")
        )
        helpers = going.where(stands_in).select(
            "tree", "parts", F.floor(F.col("part") / wide).alias("family"), digit.alias("digit"), "node",
            F.explode(_answers(low + mine, span, mine)).alias("low"), F.lit(None).cast(sent.schema["home"].dataType).alias("home"),
        )
        met = (
            sent.unionByName(helpers)
            .groupBy("tree", "parts", "family", "low")
            .agg(F.array_sort(F.collect_list(F.struct("digit", "node", "home"))).alias("run"))
        )
        names = F.transform("run", lambda x: x["node"])
        above = F.sha2(F.array_join(names, "").cast("binary"), 256)
        each = met.select("tree", "parts", above.alias("above"), names.alias("names"), F.posexplode("run").alias("k", "member"))
        beside = F.struct(
            F.array_join(F.slice("names", F.lit(1), F.col("k")), "").alias("before"),
            F.array_join(F.slice("names", F.col("k") + 2, F.lit(FANOUT)), "").alias("after"),
        )
        home = F.col("member")["home"]
        risen = each.where(home.isNotNull()).select(
            "tree", home["part"].alias("part"), "parts", F.col("above").alias("node"), F.concat(home["path"], F.array(beside)).alias("path")
        )
        state = scratch.write(state.where(F.col("parts") <= span).unionByName(risen), f"{name}-{span}")
        span = wide
    return state.select("tree", "part", F.col("node").alias("root"), "path")


def _prove(depth: int, doc_type: pa.DataType):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [doc_type, *[pa.string()] * 5, pa.bool_()]

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c)[k] for c in batch.schema.names}
                whole, subroot, root = part["parts"].as_py() == 1, part["subroot"].as_py(), part["root"].as_py()
                upper = [(x["before"], x["after"]) for x in part["path"].as_py()]
                upper_text = "".join(a + b for a, b in upper).encode()
                rows = part["rows"].values
                digests = [x.as_py().hex() for x in rows.field("leaf")]
                claims = [x and x.hex() for x in rows.field("claimed").to_pylist()]
                steps = levels_of(digests, whole, depth)[:-1]
                proofs, folds = [], []
                for i, digest in enumerate(digests):
                    proof, at, node = sha256(), i, claims[i] or digest
                    for nodes in steps:
                        start = at - at % FANOUT
                        before, after = "".join(nodes[start:at]), "".join(nodes[at + 1 : start + FANOUT])
                        proof.update((before + after).encode())
                        node, at = _hash(before + node + after), at // FANOUT
                    proof.update(upper_text)
                    for before, after in upper:
                        node = _hash(before + node + after)
                    proofs.append(proof.hexdigest())
                    folds.append(node)
                n = len(digests)
                columns = [rows.field("doc_id"), digests, [subroot] * n, [root] * n, proofs, folds, [f == root for f in folds]]
                arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return proved


def manifest(leaf_rows: DataFrame, part_levels: int = PART_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``leaf_rows``
    (doc_id, source, leaf, claimed); ``claimed``, or the leaf where it is null, is folded up along the proof."""
    spark = leaf_rows.sparkSession
    scratch = Scratch(spark, "merkle")
    parts = _parts(leaf_rows, part_levels, scratch)
    within = scratch.write(exchange(parts.drop("rows"), scratch, "within"), "paths")
    subroots = within.where("part = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    ranked = placed(in_order(subroots, "tree", ["name"], scratch, "sources"), "tree")
    tops = scratch.write(ranked.select("tree", "name", F.col("_at").alias("part"), F.col("_total").alias("parts"), "node"), "tops")
    across = exchange(tops, scratch, "across").join(tops.select("part", "name"), "part")
    found = (
        parts.drop("node")
        .join(within.withColumnsRenamed({"root": "subroot", "path": "inner"}), ["tree", "part"])
        .join(across.select(F.col("name").alias("tree"), "root", F.col("path").alias("outer")), "tree")
        .select("parts", "rows", "subroot", "root", F.concat("inner", "outer").alias("path"))
    )
    doc = leaf_rows.schema["doc_id"].dataType.simpleString()
    kind = leaf_rows.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    return found.mapInArrow(
        _prove(part_levels, kind),
        f"doc_id {doc}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def document_manifest(docs: DataFrame, part_levels: int = PART_LEVELS) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text), tampered with as ``leaves`` says."""
    return manifest(leaves(docs), part_levels)
