import random

import corpus_pipeline
import numpy as np

from driftline.llm import shingles, simhash, wide_simhash

from .test_duplicates import reach
from .test_shingles import SCHEMA, jaccard, near_copies, plain_set


def subs(marks):
    return np.ascontiguousarray(marks[:, : 4 * wide_simhash.TABLES]).view("<u4")


def test_pairs_at_the_threshold_meet():
    """Recall at a similarity of just 0.8, for large and small sets."""
    rng = np.random.default_rng(5)
    missed = 0
    for n in (10, 100, 1000):
        for _ in range(200):
            own = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            x, y = wide_simhash.sketches([own[: n * 9 // 10], own[n // 10 :]])
            assert wide_simhash.differing(x[None, :], y)[0]
            near = np.bitwise_count(subs(x[None, :]) ^ subs(y[None, :])) <= 2
            check = np.bitwise_count(x[-8:].view("<u8") ^ y[-8:].view("<u8"))[0] <= wide_simhash._MOST_CHECKED
            missed += not (near.any() and check)
    assert missed <= 1


def test_meet_equals_all_pairs():
    """Bins together: every pair of sub-fingerprints within 2 bits has a common variant, none beyond."""
    rng = np.random.default_rng(6)
    own = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    own = np.concatenate([own, own[:20], own[:30] ^ np.uint32(1 << 7), own[5:40] ^ np.uint32(3 << 11), own[:30] ^ np.uint32(7)])
    node, check = np.arange(len(own)), np.zeros(len(own), dtype=np.uint64)
    for fold in (3, 8, 32):
        met = {}
        for at in range(1 << fold) if fold < 32 else sorted({int(f) ^ m for f in own for m in [0, *(1 << j for j in range(32))]}):
            for v, n in zip(*wide_simhash.meet(own, node, check, node, at, fold), strict=True):
                met.setdefault(int(v), set()).add(int(n))
        pairs = {(a, b) for group in met.values() for a in group for b in group if a < b}
        assert pairs == {(a, b) for a in node.tolist() for b in node.tolist() if a < b and int(own[a] ^ own[b]).bit_count() <= 2}


def test_stage_searches_by_simhash(spark, monkeypatch):
    """The stage's links come from SimHash balls, and are those of all pairs (minimum hashes took their place before)."""
    rng = random.Random(22)
    texts = near_copies(rng, 50)
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 20 and any(simhash.fingerprint(texts[i], 5).__xor__(simhash.fingerprint(texts[j], 5)).bit_count() > 4 for i, j in pairs)
    monkeypatch.setattr(shingles, "drop_similar", None)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(reach(len(texts), pairs)))


def like_each_other(rng, n, places):
    """Texts with some words changed of one, most pairs at 0.6 to 0.8, few at more."""
    base = [f"v{i}" for i in range(200)]
    texts = []
    for k in range(n):
        copy = list(base)
        for i in rng.sample(range(200), rng.choice(places)):
            copy[i] = f"y{k}_{i}"
        texts.append(" ".join(copy))
    return texts


def test_a_group_costs_rows_in_proportion(spark, monkeypatch):
    """Texts like each other, mostly below the threshold: their pairs met in the balls, and each was a row of its own."""
    rng = random.Random(23)
    texts = like_each_other(rng, 160, [3, 4, 5, 6])
    sets = [plain_set(t) for t in texts]
    alike = [[jaccard(sets[i], sets[j]) for j in range(i)] for i in range(len(texts))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike[i][j] >= 0.8]
    assert sum(0.6 < x < 0.8 for row in alike for x in row) > 5000 and pairs
    made = []
    monkeypatch.setattr(wide_simhash, "_ROUNDS", 4)
    plain_met, plain_candidates = wide_simhash._met, wide_simhash.candidates
    counted = lambda f: lambda *given: (made.append((out := f(*given)).count()), out)[1]
    monkeypatch.setattr(wide_simhash, "_met", counted(plain_met))
    monkeypatch.setattr(wide_simhash, "candidates", counted(plain_candidates))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = wide_simhash.drop_similar(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(reach(len(texts), pairs)))
    assert sum(made) < 30 * len(texts)


def test_blocks_of_a_family_link_every_pair(spark, monkeypatch):
    """A family in many blocks, by nodes or by bytes: links as of all pairs by brute force."""
    rng = random.Random(24)
    texts = like_each_other(rng, 50, [1, 4, 6, 7]) + near_copies(rng, 10)
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(wide_simhash, "_ROUNDS", 1)
    for name, least in (("_LEAST_NODES", 7), ("_MOST_BYTES", 9000)):
        with monkeypatch.context() as m:
            m.setattr(wide_simhash, name, least)
            kept = wide_simhash.drop_similar(df)
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(reach(len(texts), pairs)))


def test_joining_equals_all_pairs():
    rng = np.random.default_rng(9)
    for n in (1, 2, 30, 60):
        near = np.triu(rng.random((n, n)) < 1.5 / n, 1)
        near |= near.T
        label, part = rng.integers(0, n, n), rng.integers(0, 3, n)
        for of in (None, part):
            links = wide_simhash.joining(np.arange(n), label, lambda i, rest, near=near: near[i, rest], of)
            same = [(i, j) for i in range(n) for j in range(i) if label[i] == label[j]]
            wanted = [(i, j) for i in range(n) for j in range(i) if near[i, j] and (of is None or of[i] != of[j])]
            assert len(links) < n and reach(n, same + [tuple(x) for x in links.tolist()]) == reach(n, same + wanted)
