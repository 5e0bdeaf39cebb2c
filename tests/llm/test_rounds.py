import numpy as np

from driftline.llm import near_vectors

from .test_duplicates import reach


def test_rounds_have_every_pair_once_and_few_copies_of_a_block():
    for near in (1, 5, 40):
        blocks = 40
        count = np.minimum(near, blocks - np.arange(blocks))
        for copies in (1, 4, 10, 1000):
            rounds = near_vectors.rounds_of(count, copies)
            pairs = [tuple(p) for r in rounds for p in r.tolist()]
            assert sorted(pairs) == [(i, i + d) for i in range(blocks) for d in range(count[i])]
            for r in rounds:
                assert max((r == b).any(axis=1).sum() for b in range(blocks)) <= max(3, copies)
    assert near_vectors.rounds_of(np.empty(0, dtype=np.int64), 4) == []


def test_rounds_link_all_pairs(spark, monkeypatch):
    """Many blocks in many rounds, floats and doubles, copies of other length: as all pairs by brute force."""
    monkeypatch.setattr(near_vectors, "ROUND_BYTES", 0)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 16)) * 0.2, 3 * x[:9], x[:9]]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]]
    names = reach(len(x), links)
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>").repartition(3)
        got = sorted(tuple(r) for r in near_vectors.near_vectors(df, block=16).collect())
        assert got == [(i, int(near[i].sum()) - 1, names[i], names[i] == i) for i in range(len(x))]
