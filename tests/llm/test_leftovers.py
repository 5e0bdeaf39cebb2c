import random

import numpy as np

from driftline.llm import common, wide_simhash
from driftline.llm.components import components, least_reachable

from .test_duplicates import reach
from .test_shingles import SCHEMA, jaccard, near_copies, plain_set
from .test_wide_simhash import like_each_other


def test_near_dedup_leaves_few_files(spark, monkeypatch):
    """Of each round's tables nothing stays (each was a checkpoint, which stayed until the driver met its garbage)."""
    monkeypatch.setattr(wide_simhash, "_ROUNDS", 2)
    texts = near_copies(random.Random(31), 20)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    made, before, plain = [], len(common._written), type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *given: (made.append(self), plain(self, *given))[1])
    kept = wide_simhash.drop_similar(df)
    assert len(made) <= 2 and len(common._written) - before <= 10, (len(made), len(common._written) - before)
    assert 20 <= kept.count() < len(texts)


def test_components_of_one_task(spark):
    """The same components by one task from the start, after some rounds, and by rounds alone."""
    rng = np.random.default_rng(32)
    for n, m in ((2, 1), (60, 40), (300, 280)):
        a, b = rng.integers(0, n, (2, m))
        want = reach(n, list(zip(a.tolist(), b.tolist(), strict=True)))
        node, least = least_reachable(a, b)
        assert [want[x] for x in node.tolist()] == least.tolist()
        edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
        for at_once in (0, 20, 1000):
            found = {r["node"]: r["component"] for r in components(edges, at_once=at_once).collect()}
            assert all(want[x] == c for x, c in found.items()) and set(found) == {x for e in zip(a.tolist(), b.tolist(), strict=True) if e[0] != e[1] for x in e}
    assert not components(edges.where("a < 0"), at_once=1000).count()


def test_a_group_below_the_threshold_meets_once(spark, monkeypatch):
    """Texts at 0.55 to 0.75 of each other are one family after the first round (they met in all rounds, told apart each time)."""
    rng = random.Random(33)
    texts = like_each_other(rng, 160, [6, 7, 8])
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    made = []
    monkeypatch.setattr(wide_simhash, "_ROUNDS", 4)
    plain_met = wide_simhash._met
    monkeypatch.setattr(wide_simhash, "_met", lambda *given: (out := plain_met(*given), made.append(out.count()))[0])
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = wide_simhash.drop_similar(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(reach(len(texts), pairs)))
    assert len(made) == 4 and sum(made[1:]) < len(texts), made
