import random

import corpus_pipeline
import numpy as np
import pytest

from driftline.llm import shingles

from .test_duplicates import reach

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_set(text, k=5):
    words = text.lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def near_copies(rng, n):
    """Texts and copies of them with some words changed, at similarities on both sides of 0.8."""
    texts = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.choice([0.01, 0.02, 0.025, 0.03])))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(copy))
    return texts


def test_minima_find_pairs_at_the_threshold():
    """Recall at a similarity of just 0.8: 400 pairs of 80 common shingles of 100."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        own = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        x, y = shingles.minima(own[:90]), shingles.minima(own[10:])
        assert ((x >> np.uint64(24)).astype(np.uint8) == (y >> np.uint64(24)).astype(np.uint8)).sum() >= shingles.enough(0.8)
        missed += not (shingles.sub_fingerprints(x) == shingles.sub_fingerprints(y)).any()
    assert missed <= 1


def test_stage_links_every_pair_at_similarity(spark):
    """The pipeline's stage against all pairs by brute force (4 bits of 64 left most of them)."""
    rng = random.Random(20)
    texts = near_copies(rng, 60)
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 0.5 < jaccard(sets[i], sets[j]) < 0.8]
    assert len(pairs) > 30 and len(near) > 10
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(reach(len(texts), pairs)))


def test_chain_through_a_rejected_hub(spark):
    """A bucket's first node may be unlike the rest: pairs among the others still count."""
    rng = random.Random(21)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for k in range(40):
        copy = list(base)
        for i in rng.sample(range(200), rng.choice([3, 4, 5, 6])):
            copy[i] = f"y{k}_{i}"
        texts.append(" ".join(copy))
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(40) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in shingles.drop_similar(df).collect()) == sorted(set(reach(40, pairs)))


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward.collect()
    sets = [plain_set("".join(c.lower() if c.isascii() else c for c in r["text"] or "")) for r in docs]
    group = reach(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    kept = shingles.drop_similar(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(group))
    assert shingles.drop_similar(nothing).count() == 0
    with pytest.raises(ValueError):
        shingles.drop_similar(nothing, similarity=0.5)
