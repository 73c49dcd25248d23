"""Jaccard join of shingle sets with token-combination prefixes.

Texts with one set are one class; only classes are compared.  Let t be the
threshold and a(s) = s - ceil(t s): so many tokens of a set of s may be missing
from a linked one.  Under any order of all tokens, the j-th common token of a
linked pair stands at place a(s) + j or before in either set.

*First join.*  Tokens are ordered by their hash.  Each class lists its first
a(s) + k(s) tokens, k(s) = a(s) + ``SLACK``: prefixes extended far enough that a
linked pair shares many listed tokens, not one.  Listed tokens are counted;
those of at most ``RARE`` classes are indexed one by one, and a pair is a
candidate if it shares k less the frequent tokens that it may share as well.
A linked pair without a rare token shares k frequent ones; so both classes list at
least so many.  Such classes are *heavy*, and few: most of
their text stands in many others.

*Second join*, of the heavy classes among themselves, with whole sets and
tokens in order of frequency.  The prefix is a(s) + 2 long.  Its tokens of one
class are dropped (a class whose prefix has no other has no partner), rare
ones are indexed one by one, and frequent ones by pairs of them: the first two
common tokens are in both prefixes.  Long prefixes would have too many pairs, so a
longer set is cut into parts by its tokens' hashes, and the parts are indexed like
sets: if no part of a linked pair had their threshold, neither would the whole, as
common tokens and all tokens add up over the parts.  The number of parts
doubles with the size of the set; a set whose partners may have another number
is indexed under both.  A key may still have thousands of classes, all
near copies of one text.  They are compared with one of them, the one with the
fewest tokens of its own; classes that this joins to the same component need no further
comparison, and the rest of a key is compared with all of it that is not in its
component yet, each pair under the first key that it shares.

Every candidate is verified on whole sets.  Result: components, not pairs.

Defined cases: a text without words, or null, has no set and is linked with
nothing; rows of one text are one class; an id of several texts stands for each
of them; a null id has a null component unless a linked text has an id; an
empty table gives none; other columns are left out.  Tokens are 64-bit hashes of shingles,
classes 128-bit hashes of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkgraph.llm.common import NO_ID, Scratch, let, text_key
from linkgraph.llm.components import components

PERCENT = 90
SHINGLE = 3
SLACK = 8
RARE = 32
PAIR_PREFIX = 48  # a set of which more tokens may be missing is cut into parts
PART_LEVELS = 2  # a set just above that size has 2 ** (1 + PART_LEVELS) parts, one of twice the size twice as many
BATCH_BYTES = 1 << 20  # of text hashed at once
CHUNK = 1024  # classes whose sets are compared in one group, on either side

#: Random but fixed: a 64-bit number for each byte, A-Z having those of a-z, and an odd base.
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_ODD = _rng.integers(2**62, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word in ``data``, texts end to end that begin at ``begins``.

    A word's hash is a polynomial of its bytes: a difference of prefix sums.
    """
    word = ~_IS_SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[begins] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    firsts = np.flatnonzero(word & (before | new[:-1]))
    lasts = np.flatnonzero(word & (after | new[1:]))
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return firsts, (sums[lasts + 1] - sums[firsts]) * inverse[firsts] + (lasts - firsts).astype(np.uint64)


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), np.uint64(len(words)), np.uint64)
    for k, each in enumerate(words):
        out = (out ^ each) * _ODD[k % len(_ODD)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, "right")) - 1)
            begins = offsets[first : last + 1] - offsets[first]
            firsts, words = _word_hashes(data[offsets[first] : offsets[last]], begins)
            edges = np.searchsorted(firsts, begins)
            count = max(0, len(words) - size + 1)
            windows = _mixed([words[k : k + count] for k in range(size)])
            for a, b in zip(edges, edges[1:]):
                if b - a >= size:
                    yield np.unique(windows[a : b - size + 1])
                elif b > a:
                    yield _mixed([words[i : i + 1] for i in range(a, b)])
                else:
                    yield np.empty(0, np.int64)
            first = last


def _missing(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def _lister(percent: int, size: int, whole: bool):
    """Sets of texts: (carried columns, n, s1, s2, tokens); the listed tokens only, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, s1, s2, lists, ends = [], [], [], [], [0]
            for tokens in shingle_sets(batch["text"], size):
                a, b = np.frombuffer(hashlib.md5(tokens.tobytes()).digest(), np.int64)
                ns.append(len(tokens))
                s1.append(a)
                s2.append(b)
                listed = tokens if whole else tokens[: 2 * _missing(len(tokens), percent) + SLACK]
                lists.append(listed)
                ends.append(ends[-1] + len(listed))
            names = [n for n in batch.schema.names if n != "text"]
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), *(pa.array(x, pa.int64()) for x in (ns, s1, s2)), tokens],
                names=[*names, "n", "s1", "s2", "tokens"],
            )

    return run


def _sets(docs: DataFrame, percent: int, size: int, whole: bool) -> DataFrame:
    carried = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in docs.columns if c != "text")
    return docs.mapInArrow(_lister(percent, size, whole), f"{carried}, n long, s1 long, s2 long, tokens array<long>")


def _a(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs(members: Column) -> Column:
    """All pairs (u, v) of an array of (cid, n, h), in its order."""
    return F.flatten(
        F.transform(
            members,
            lambda x, i: F.transform(
                F.slice(members, i + 2, F.size(members)),
                lambda y: F.struct(
                    x["cid"].alias("u"), y["cid"].alias("v"), x["n"].alias("nu"), y["n"].alias("nv"),
                    x["h"].alias("hu"), y["h"].alias("hv"),
                ),
            ),
        )
    )


def _bucket_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v, block, shared, nu, nv, hu, hv): pairs of the classes under one key; ``rows``: (key, cid, n, h).

    A key has at most ``RARE`` classes.  Keys with the same classes are one, with a
    weight; ``shared`` is how many keys a pair has in common.  The smallest class under a key is the pair's block.
    """
    members = F.array_sort(F.collect_set(F.struct("cid", "n", "h")))
    lists = rows.groupBy("key").agg(members.alias("m")).where(F.size("m") > 1).groupBy("m").agg(F.count(F.lit(1)).alias("w"))
    pairs = lists.select("w", F.col("m")[0]["cid"].alias("block"), F.inline(_pairs(F.col("m"))))
    fit = pairs.where(_sizes_fit(F.col("nu"), F.col("nv"), percent))
    return fit.groupBy("u", "v", "nu", "nv", "hu", "hv").agg(F.min("block").alias("block"), F.sum("w").alias("shared"))


def _comparer(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        tokens = dict(zip(sets["cid"].to_pylist(), (x.values.to_numpy() for x in sets["tokens"])))
        found = []
        for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist()):
            a, b = tokens[u], tokens[v]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                found.append((u, v))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v, block) whose sets are alike enough; ``sets``: (cid, tokens).

    Pairs of a block share their classes, so a set is sent once to a block and not once for each pair.
    A large block is cut into squares of ``CHUNK`` classes on either side.
    """
    pairs = scratch.write(pairs.groupBy("u", "v").agg(F.min("block").alias("block")), "pairs")
    ends = pairs.select("block", F.col("u").alias("cid")).unionByName(pairs.select("block", F.col("v").alias("cid")))
    cuts = ends.distinct().groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("cuts"))

    def cut(cid: str) -> Column:
        return F.pmod(F.xxhash64(cid), F.col("cuts"))

    placed = scratch.write(pairs.join(cuts, "block").select("u", "v", "block", cut("u").alias("i"), cut("v").alias("j")), "placed_pairs")
    sent = placed.select("block", "i", "j", F.col("u").alias("cid")).unionByName(
        placed.select("block", "i", "j", F.col("v").alias("cid"))
    )
    sent = sent.distinct().join(sets, "cid").select(
        F.col("block").alias("b_block"), F.col("i").alias("b_i"), F.col("j").alias("b_j"), "cid", "tokens"
    )
    return placed.groupBy("block", "i", "j").cogroup(sent.groupBy("b_block", "b_i", "b_j")).applyInArrow(
        _comparer(percent), "u long, v long"
    )


def _levels(n: Column, percent: int) -> Column:
    """The numbers of parts under which a set of ``n`` is indexed: its own, and that of the largest set it may be linked with."""
    if percent >= 100:
        return F.array(F.lit(1).cast("long"))
    whole = F.lit(float(max(1, PAIR_PREFIX * 100 // (100 - percent))))

    def level(size: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(size / whole))).cast("int")

    levels = F.sequence(level(n), level(F.floor(n * 100 / F.lit(percent))))
    return F.transform(levels, lambda x: F.when(x == 0, F.lit(1)).otherwise(F.pow(F.lit(2.0), x + PART_LEVELS)).cast("long"))


def _heavy_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, own, part, frequent, keys): what the second join looks for; ``sets``: (cid, n, tokens) of heavy classes.

    ``own`` counts the tokens that no other heavy class has; ``frequent`` are the
    frequent tokens of the part's prefix, in order.  Part j of m has the number m + j.
    """
    tokens = sets.select("cid", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # Tokens of one class have no count: they are the first in the order, as many as are counted without.
    placed = tokens.join(often, "token", "left").withColumn("m", F.explode(_levels(F.col("n"), percent)))
    parts = placed.groupBy("cid", "n", "m", (F.col("m") + F.pmod("token", "m")).alias("part")).agg(
        F.count(F.lit(1)).alias("size"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "token")))).alias("shared"),
    )
    lone = F.col("size") - F.size("shared")
    own = F.sum(lone).over(Window.partitionBy("cid", "m"))
    prefix = F.slice(
        "shared", F.lit(1), F.greatest(F.lit(0).cast("long"), _a(F.col("size"), percent) + 2 - lone).cast("int")
    )
    cut = parts.select("cid", "n", "part", "size", own.alias("own"), prefix.alias("p")).where(F.size("p") > 0)
    cut = cut.select(
        "*", F.filter("p", lambda x: x["c"] <= RARE).alias("rare"), F.filter("p", lambda x: x["c"] > RARE).alias("often")
    )
    none = F.array().cast("array<struct<kind:string,key:bigint>>")

    def keyed(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    single = F.transform("rare", lambda x: keyed("rare", x["token"]))
    paired = F.flatten(
        F.transform(
            "often",
            lambda x, i: F.transform(
                F.slice("often", i + 2, F.size("often")),
                lambda y: keyed("pair", F.xxhash64(F.col("part"), x["token"], y["token"])),
            ),
        )
    )
    # A part so small that one common token is enough for it.
    alone = F.transform("often", lambda x: keyed("one", F.xxhash64(F.col("part"), x["token"])))
    keys = F.concat(single, paired, F.when(F.col("size") * percent <= 100, alone).otherwise(none))
    return cut.select(
        "cid", "n", "own", "part", F.transform("often", lambda x: x["token"]).alias("frequent"), keys.alias("keys")
    )


def _is_first_key(kind: Column, part: Column, key: Column, often: Column, other: Column) -> Column:
    """Whether ``key`` is made of the first frequent tokens that two prefixes of a part share: so for one key of a pair and part."""

    def same(common: Column) -> Column:
        return F.when(kind == "one", F.xxhash64(part, F.get(common, F.lit(0)))).otherwise(
            F.xxhash64(part, F.get(common, F.lit(0)), F.get(common, F.lit(1)))
        ) == key

    return let(F.array_intersect(often, other), same)


def linked(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, _key, n_shingles, component_id): one row per row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    sets = scratch.write(_sets(keyed, percent, size, whole=False), "sets")
    listing = scratch.write(
        sets.where("n > 0")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.min(F.struct("doc_id", "_key")).alias("row"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "listing",
    )
    rows = scratch.write(sets.drop("tokens"), "rows")
    classes = scratch.write(listing.drop("tokens"), "classes")
    scratch.drop("sets")
    # A set below this size is linked with no other set: one token more or less is too much.
    smallest = -(-percent // (100 - percent)) if percent < 100 else 2**62
    listed = listing.where(F.col("n") >= smallest).select("cid", F.explode("tokens").alias("token"))
    counts = scratch.write(
        listed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts"
    )
    scratch.drop()
    shared = scratch.write(listed.join(counts, "token"), "shared")
    scratch.drop("listing", "counts")
    # h: how many frequent tokens a class lists.
    hot = shared.where(F.col("c") > RARE).groupBy("cid").agg(F.count(F.lit(1)).alias("h"))
    sized = scratch.write(
        classes.select("cid", "n").join(hot, "cid", "left").withColumn("h", F.coalesce("h", F.lit(0))), "sized"
    )
    rare = shared.where(F.col("c") <= RARE).select(F.col("token").alias("key"), "cid").join(sized, "cid")

    def k(n: Column) -> Column:
        """So many common tokens are listed by both classes of a linked pair whose smaller one has ``n``."""
        return F.least(_a(n, percent) + SLACK, F.ceil(n * percent / F.lit(100)).cast("long"))

    nu, nv = F.col("nu"), F.col("nv")
    enough = F.col("shared") >= F.least(k(nu), k(nv)) - F.least("hu", "hv")
    first = scratch.write(_bucket_pairs(rare, percent).where(enough).select("u", "v", "block"), "first")
    fewest = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    heavy = sized.where(F.col("h") >= F.least(_a(fewest, percent) + SLACK, fewest)).select(
        "cid", F.lit(True).alias("heavy")
    )
    needed = (
        first.select(F.col("u").alias("cid"), F.lit(False).alias("heavy"))
        .unionByName(first.select(F.col("v").alias("cid"), F.lit(False).alias("heavy")))
        .unionByName(heavy)
        .groupBy("cid")
        .agg(F.max("heavy").alias("heavy"))
    )
    # One text of each class that is needed gives its whole set again.
    wanted = scratch.write(
        needed.join(classes, "cid").select(
            "cid", "heavy", F.coalesce("row.doc_id", F.lit(NO_ID)).alias("_id"), F.col("row._key").alias("_key")
        ),
        "wanted",
    )
    scratch.drop("shared")
    texts = keyed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_key", "text")
    # Merged at every size: what is wanted grows with the corpus, so it has no bound under which to send it around.
    texts = texts.join(wanted.hint("merge"), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    whole = scratch.write(_sets(texts.select("cid", "heavy", "text"), percent, size, whole=True), "whole")
    scratch.drop("wanted")

    prefixes = scratch.write(_heavy_keys(whole.where("heavy").select("cid", "n", "tokens"), percent), "prefixes")
    keys = prefixes.select("cid", "n", "own", "part", F.inline("keys"))
    lone = keys.where("kind = 'rare'").select("key", "cid", "n", F.lit(0).alias("h")).distinct()
    second = _bucket_pairs(lone, percent).select("u", "v", "block")
    many = keys.where("kind != 'rare'")
    centres = many.groupBy("key").agg(
        F.min_by(F.struct("cid", "n", "own"), F.struct("own", "cid")).alias("x"), F.count(F.lit(1)).alias("c")
    )
    centres = scratch.write(
        centres.where("c > 1").select("key", F.col("x.cid").alias("u"), F.col("x.n").alias("nu"), F.col("x.own").alias("ou")),
        "centres",
    )

    def may_link(nu: str, ou: str, nv: str, ov: str) -> Column:
        """Sizes fit, and tokens of their own do not exceed what a linked pair may differ in."""
        nu, ou, nv, ov = map(F.col, (nu, ou, nv, ov))
        # shared >= t / (1 + t) of both sizes
        shared = F.ceil((nu + nv) * percent / F.lit(100 + percent)).cast("long")
        return _sizes_fit(nu, nv, percent) & (F.least(nu - ou, nv - ov) >= shared)

    stars = (
        many.join(centres, "key")
        .where((F.col("cid") != F.col("u")) & may_link("nu", "ou", "n", "own"))
        .select("u", F.col("cid").alias("v"))
        .distinct()
    )
    plain = whole.select("cid", "tokens")
    candidates = first.unionByName(second).unionByName(stars.withColumn("block", F.col("u")))
    links = scratch.write(_verified(candidates, plain, percent, scratch), "links")
    scratch.drop("first", "pairs", "placed_pairs")
    roots = scratch.write(components(links, scratch), "roots")

    # What a key's centre did not reach is compared with the key's classes outside its own component.
    named = many.join(centres.select("key", "u"), "key")
    with_root = named.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid")
    )
    centre_root = centres.select(F.col("u").alias("node")).distinct().join(roots, "node", "left")
    centre_root = centre_root.select(F.col("node").alias("u"), F.coalesce("root", "node").alias("centre"))
    placed = scratch.write(with_root.join(centre_root, "u").drop("u"), "placed")
    scratch.drop()
    outside = placed.where(F.col("root") != F.col("centre"))
    frequent = prefixes.select("cid", "part", "frequent")
    open_keys = placed.join(outside.select("key").distinct(), "key", "left_semi").join(frequent, ["cid", "part"])
    outside = outside.join(frequent, ["cid", "part"])
    other = open_keys.select(
        "key", F.col("cid").alias("v"), F.col("n").alias("nv"), F.col("own").alias("ov"),
        F.col("root").alias("other_root"), F.col("centre").alias("other_centre"), F.col("frequent").alias("other_frequent"),
    )
    rest = (
        outside.join(other, "key")
        .where(
            (F.col("root") != F.col("other_root"))
            & ((F.col("cid") < F.col("v")) | (F.col("other_root") == F.col("other_centre")))
            & may_link("n", "own", "nv", "ov")
            & _is_first_key(F.col("kind"), F.col("part"), F.col("key"), F.col("frequent"), F.col("other_frequent"))
        )
        .select(F.least("cid", "v").alias("u"), F.greatest("cid", "v").alias("v"), F.col("centre").alias("block"))
    )
    more = scratch.write(_verified(rest, plain, percent, scratch), "more")
    scratch.drop("prefixes", "placed", "whole")
    if not more.isEmpty():
        roots = scratch.write(components(links.unionByName(more), scratch), "roots_again")
    of_class = classes.select("cid", "n", "s1", "s2", "rep").join(
        roots.select(F.col("node").alias("cid"), "root"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    smallest_ids = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    named_classes = scratch.write(
        of_class.join(smallest_ids, "root").select(
            F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "component", "root"
        ),
        "named",
    )
    rows = rows.join(
        named_classes, (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left"
    )
    return rows.select(
        "doc_id", "_key", F.col("n").alias("n_shingles"), F.col("root").alias("_root"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of every component; rows without words all stay.

    The one with the smallest doc_id (null last), then text key, stays.
    """
    rows = linked(docs.select("doc_id", "text"), percent, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_key"))
    stay = rows.where(F.col("_root").isNotNull()).groupBy("_root").agg(first.alias("x"))
    stay = stay.select(F.col("x.doc_id").alias("_stay_doc"), F.col("x._key").alias("_stay_key"))
    named = docs.select(
        F.struct(*docs.columns).alias("whole"), "doc_id", text_key(F.col("text")).alias("_key"),
        F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    kept = (
        named.where("worded")
        .join(stay, F.col("doc_id").eqNullSafe(F.col("_stay_doc")) & (F.col("_key") == F.col("_stay_key")), "left_semi")
        .dropDuplicates(["doc_id", "_key"])
    )
    return kept.unionByName(named.where("NOT worded")).select("whole.*")
