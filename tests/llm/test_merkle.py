"""The Merkle manifest against a tree that is built in one piece."""

from hashlib import sha256
from zlib import crc32

import pytest

from linkgraph.llm import merkle_manifest
from linkgraph.llm.merkle_manifest import FANOUT

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    fields = list(row)
    if lower and fields[4] is not None:
        fields[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in fields[4])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """Root, and for every node the siblings before and after it on each level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            start = i - i % FANOUT
            path.append(("".join(level[start:i]), "".join(level[i + 1 : start + FANOUT])))
            i //= FANOUT
        paths.append(path)
    return levels[-1][0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees[name] = ordered, *climb([leaf(r) for r in ordered])
    root, outer = climb([trees[name][1] for name in names])
    found = []
    for name, path in zip(names, outer):
        ordered, subroot, paths = trees[name]
        for row, inner in zip(ordered, paths):
            whole = inner + path
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0
            node = leaf(row, lower=tampered)
            for before, after in whole:
                node = h(before + node + after)
            proof = h("".join(a + b for a, b in whole))
            found.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return found


def key(row):
    return tuple((v is not None, v) for v in row)


def run(spark, rows, part_levels):
    df = spark.createDataFrame(rows, DOCS)
    for name in ("tree", "part", "leaf", "root", "_row", "rows"):
        df = df.selectExpr("*", f"'x' AS {name}")
    out = merkle_manifest.document_manifest(df, part_levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=key)


def many(n, source, start=0):
    return [(start + i, source, "en", i, f"Text {i}") for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        many(1, "a"),
        many(16, "a"),
        many(17, "a") + many(1, "b", 100),
        many(273, "a") + many(33, None, 1000) + many(256, "b", 2000) + many(3, "ß", 3000),
        many(4113, "hot") + many(40, "x", 5000),
        [r for i in range(40) for r in many(i % 3 + 1, f"s{i}", 10 * i)],
    ],
)
def test_trees(spark, rows):
    assert run(spark, rows, 1) == sorted(expected(rows), key=key)


def test_large_partitions(spark):
    rows = many(5000, "a") + many(4096, "b", 10_000)
    assert run(spark, rows, 3) == sorted(expected(rows), key=key)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "s", "en", 3, "Abc"), (5, "s", None, None, ""), (5, "s", None, None, ""),
        (7, "", "en", -1, "ÄÖ A\x00b"), (8, "s", "en", 1, "X" * 300_000), (5, None, "de", 0, "Y"),
    ] + [(9, "same", "en", 1, "Copy")] * 300
    assert run(spark, rows, 1) == sorted(expected(rows), key=key)


def test_no_rows(spark):
    assert run(spark, [], 1) == []


def test_tampering_is_seen(spark):
    found = run(spark, many(200, "a"), 1)
    wrong = [r for r in found if not r[6]]
    assert wrong and all(crc32(str(r[0]).encode()) % 5 == 0 for r in wrong)
