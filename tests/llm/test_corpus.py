"""Packing, sharding, token counts, Jaccard join, search, mixing, the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import jaccard_join, mixing, packing, sharding, token_counts, topk_search
from linkgraph.llm.queries import QUERIES, tokenizer_file

WORD_BPE = "word_bpe_49k.json"


def check_pieces(rows, texts, window=4096):
    """``texts``: (doc_id, text) of each packed row."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    copies = Counter(d for d, _ in texts)
    held = Counter()
    sequences = defaultdict(list)
    for r in rows:
        cut = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(cut) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(cut.tobytes()) == r["ids_crc32"]
        held.update((r["doc_id"], i) for i in range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == Counter({(d, i): copies[d] for d in ids for i in range(len(ids[d]))})
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in lengths)
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(lengths) - lengths.count(window) <= window.bit_length()


def test_pieces_of_a_corpus(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    check_pieces(QUERIES["op2_packing"](spark, tiny).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pieces_of_odd_rows(odd_docs, no_docs):
    path = tokenizer_file(WORD_BPE)
    rows = packing.pack(odd_docs, path).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(no_docs, path).count() == 0


def test_windows_hold_the_mixture(make_docs):
    rows = [(i, "w " * 300, "abc"[i % 3] if i % 6 < 3 else "a") for i in range(600)]
    pieces = packing.pack(make_docs(rows), tokenizer_file(WORD_BPE), weights={"a": 2.0, "b": 1.0, "c": 1.0}, with_ids=False)
    by = {(r["sequence_id"], r["source"]): r["n"] for r in pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()}
    # Until b and c end, the tokens of a are never more than a segment from half of all.
    total = {"a": 0, "b": 0, "c": 0}
    for k in range(20):
        for s in total:
            total[s] += by.get((k, s), 0)
        assert abs(total["a"] - 2048 * (k + 1)) <= 3 * packing.GRAIN


@pytest.mark.parametrize("rows", [0, 5, 16, 1000])
def test_shards_are_exact(spark, rows):
    df = spark.range(rows).selectExpr("id AS doc_id", "'x' AS shard_name", "id % 7 AS n")
    placed = sharding.shard(df, ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(rows))
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(s, ())) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard(df, ["doc_id"]).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in placed} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(None, None)] * 30, "doc_id long, t string")
    placed = sharding.shard(df, ["doc_id", "t"]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in placed) == [4] * 10 + [5] * 6


def test_draws_follow_the_hypergeometric_law(spark):
    n = 4000
    drawn = spark.range(n).select(
        sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / n).alias("k")
    )
    counts = Counter(r["k"] for r in drawn.collect())
    from math import comb

    for k in range(11):
        want = comb(20, k) * comb(30, 10 - k) / comb(50, 10)
        assert abs(counts[k] / n - want) < 2 / n


def greedy(word, starting, continuing):
    n, at, pieces = 0, 0, starting
    while at < len(word) or not n:
        for k in range(len(word) - at, -1, -1):
            if word[at : at + k] in pieces and (k or pieces is starting):
                break
        else:
            return 1
        n, at, pieces = n + 1, at + k, continuing
    return n


def test_automaton_cuts_greedily():
    rng = random.Random(1)
    for _ in range(300):
        make = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 5)))
        starting, continuing = {make() for _ in range(6)}, {make() for _ in range(8)} - {b""}
        automaton = token_counts.Automaton(starting, continuing)
        for _ in range(40):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, starting, continuing), (starting, continuing, word)


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    path = tokenizer_file("byte_bpe_50k.json")
    starting, continuing = map(set, token_counts.pieces_of(path))
    for r in token_counts.count_tokens(odd_docs.select("doc_id", "text"), path).collect():
        assert (r["n_words"] == 0) == (r["n_tokens"] == 0)
    texts = {r["text"] for r in odd_docs.collect() if r["text"] and len(r["text"]) < 1000}
    got = token_counts.count_tokens(odd_docs.select("text", F.col("text").alias("t")), path).collect()
    for r in got:
        if r["t"] in texts:
            assert r["n_tokens"] == sum(greedy(w, starting, continuing) for w in r["t"].encode().split())
    assert token_counts.count_tokens(no_docs, path).count() == 0


def set_of(text, size=3):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=90, size=3):
    sets = [(d, set_of(t, size)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def near_copies(seed, n, length, changes, vocabulary=500):
    """Copies of copies of one text, each with up to ``changes`` other words."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(vocabulary)}" for _ in range(length)]]
    while len(texts) < n:
        t = list(rng.choice(texts[-40:]))
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(vocabulary)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("n, length, changes", [(120, 150, 3), (90, 40, 1), (60, 700, 20)])
def test_components_match_brute_force(make_docs, odd_docs, n, length, changes):
    texts = near_copies(n, n, length, changes) + near_copies(n + 1, 8, length, 1)
    passage = " ".join(f"p{i}" for i in range(length))
    texts += [f"{passage} {' '.join(f'q{k}x{i}' for i in range(length // 12))}" for k in range(50)]  # shared by many
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(2000, texts[0]), (2001, texts[0].upper()), (1000, texts[1])]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = jaccard_join.linked(make_docs(rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_long_heavy_sets_match_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIR_PREFIX", 10)
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    rows = list(enumerate(near_copies(5, 70, 110, 2) + near_copies(6, 70, 95, 2)))
    got = jaccard_join.linked(make_docs(rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


@pytest.mark.parametrize("percent, size", [(90, 3), (80, 5)])
def test_sets_in_parts_match_brute_force(make_docs, monkeypatch, percent, size):
    """Sets on both sides of the sizes at which the number of parts doubles, near the threshold."""
    monkeypatch.setattr(jaccard_join, "PAIR_PREFIX", 4)
    monkeypatch.setattr(jaccard_join, "RARE", 2)
    monkeypatch.setattr(jaccard_join, "PART_LEVELS", 1)
    rng = random.Random(8)
    texts = []
    for n in (38, 80, 160, 320):
        base = [f"v{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(40):
            cut = rng.randint(0, n // 8)
            words = base[cut:] + [f"v{rng.randrange(4000)}" for _ in range(rng.randint(0, n // 16))]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = jaccard_join.linked(make_docs(rows), percent, size).collect()
    expected = brute_components(rows, percent, size)
    assert len({c for _, _, c in expected}) > 8
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected


def test_one_of_each_group(make_docs, no_docs):
    text = " ".join(f"w{i}" for i in range(80))
    docs = make_docs([(5, text), (3, text + " end"), (3, text + " end"), (4, "other words here"), (6, None), (7, ""), (None, text)])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]
    assert jaccard_join.one_of_each(no_docs).count() == 0
    assert jaccard_join.linked(no_docs).count() == 0


def brute_top(rows, k):
    whole = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows]
    out = set()
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k]))
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk_search, "PIVOT_ROWS", 40)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)).astype("f4"))]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]  # ties
    vectors += [(400, [1.0, 2.0]), (401, [3.0, 4.0]), (450, []), (500, [1e6] * 6)]
    bad = [(50, None), (51, [1.0, None]), (52, [float("nan")] * 6), (None, [1.0] * 6), (53, [float("inf")] * 6)]
    vectors = [v for v in vectors if v[0] not in (50, 51, 52, 53)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS q_id")
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == brute_top(vectors, 5)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_among_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk_search, "PIVOT_ROWS", 30)
    monkeypatch.setattr(topk_search, "PAIRS_AT_ONCE", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    points = centres[rng.integers(0, 8, 400)] + 0.05 * rng.normal(size=(400, 16))
    points[100:230] = points[100]  # one vector a third of the table
    points[300] *= -1.0  # a query whose scores are mostly below 0
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    vectors += [(1000, [2.0**30] * 3), (1001, [2.0**29] * 3), (1002, [-1.0] * 3)]  # sums beyond a double
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    wide = {r for r in brute_top(vectors, 5) if r[0] != 1000}
    assert {r for r in got if r[0] != 1000} == wide and sum(r[0] == 1000 for r in got) == 2


def test_a_cutoff_leaves_lists_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16)) * 200
    blocks = [np.floor(c + rng.normal(size=(50, 16))) for c in centres]
    wanted = blocks[0][:10]
    cutoffs = np.sort(wanted @ blocks[0].T, axis=1)[:, -5]
    shares = -((-cutoffs) // topk_search.PARTS)
    opened = [topk_search.open_lists(wanted, b, shares) for b in blocks]
    assert opened[0].any() and np.mean(opened[1:]) < 0.5
    for b, o in zip(blocks, opened):
        for s, part in enumerate(topk_search._segments(16)):
            reach = (wanted[:, part] @ b[:, part].T >= shares[:, None]).any(axis=1)
            assert not (reach & ~o[:, s]).any()


def test_mix_meets_targets(spark, make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 40
    # Brute force: share by weight; what a full source leaves goes to the others.
    weight = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    left, open_, want = 1.5 * sum(size.values()), set(weight), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= full
    assert all(abs(want[s] - target[s]) < 1e-6 for s in target)
    again = Counter((r["doc_id"], r["copies"]) for r in mixing.mix(make_docs(rows)).collect())
    assert again == Counter((r["doc_id"], r["copies"]) for r in got)


def test_mix_is_unbiased(make_docs):
    rows = [(i, "w " * (i % 5 + 1), "a") for i in range(40)] + [(100 + i, "w " * 30, "b") for i in range(10)]
    docs = make_docs(rows, extra=False)
    mean = Counter()
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed).where("source = 'b'").collect():
            mean[r["doc_id"]] += r["copies"] / 12
            often = r["target"] / r["source_size"]
    assert abs(sum(mean.values()) / len(mean) - often) < 0.1


def test_mixed_rows(odd_docs, no_docs):
    taken = mixing.mix(odd_docs)
    copies = sum(r["copies"] for r in taken.collect())
    assert taken.count() == odd_docs.count()
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == copies
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_pipeline_stages(spark, tiny, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert counts[0] > counts[1] == counts[2] > counts[3]
    texts = [(r["doc_id"], r["text"]) for r in before.collect()]
    check_pieces(docs.collect(), texts)
    kept = spark.read.parquet(str(tmp_path / "2")).collect()
    groups = brute_components([(r["doc_id"], r["text"]) for r in kept])
    assert sum(groups.values()) == len({c for _, _, c in groups})
    whole = sorted(map(tuple, corpus_pipeline.run(spark, tiny).collect()))
    assert whole == sorted(map(tuple, docs.collect()))


def test_pipeline_links_near_copies_on_five_words(spark, make_docs, tiny):
    """Four words of 200 differ: 0.81 of the five-word shingles are shared, but 0.89 of the three-word ones."""
    import corpus_pipeline

    text = [f"w{i}" for i in range(200)]
    near = [f"v{i}" if i % 50 == 25 else w for i, w in enumerate(text)]
    far = [f"v{i}" if i % 33 == 15 else w for i, w in enumerate(text)]
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(far))]
    a, b, c = (set_of(t, 5) for _, t in rows)
    assert 0.8 <= len(a & b) / len(a | b) and len(a & c) / len(a | c) < 0.8 > len(b & c) / len(b | c)
    a, b, _ = (set_of(t) for _, t in rows)
    assert len(a & b) / len(a | b) < 0.9
    rows += [(100 + i, t) for i, t in enumerate(near_copies(8, 60, 150, 4) + near_copies(9, 40, 60, 2))]
    kept = corpus_pipeline.near_duplicates(spark, make_docs(rows), tiny).collect()
    first = {component for _, _, component in brute_components(rows, 80, 5)}
    assert {1, 3} <= first and {r["doc_id"] for r in kept} == first and len(kept) == len(first)


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    import corpus_pipeline

    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
