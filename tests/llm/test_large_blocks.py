import random

import numpy as np
import pyarrow as pa

from driftline.llm import induced, near_vectors, suffix_dedup


def test_ranks_of_a_block_beyond_16_bits():
    """Ties on the first projection can make a block of any size; its ranks must not wrap."""
    rng = np.random.default_rng(12)
    other = rng.normal(size=(70_000, 16))
    other /= np.linalg.norm(other, axis=1)[:, None]
    one = other[rng.integers(0, 70_000, 200)] + 0.03 * rng.normal(size=(200, 16))
    one /= np.linalg.norm(one, axis=1)[:, None]
    want = set(map(tuple, np.argwhere(one @ other.T >= 0.95).tolist()))
    assert want and {p for q, y in near_vectors.linked(one, other, 0.95, False) for p in zip(q.tolist(), y.tolist(), strict=True)} == want


def test_shards_end_before_a_recursion(monkeypatch):
    """Large shards of natural text were sorted by recursion, at nearly twice the time: now they end where memory sorts do."""
    rng = random.Random(11)
    monkeypatch.setattr(induced, "CHUNK", 2048)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2048)
    monkeypatch.setattr(suffix_dedup, "map_arrow", lambda rows, f, schema: f)
    levels, whole = [], induced.Level.__post_init__
    monkeypatch.setattr(induced.Level, "__post_init__", lambda self: (levels.append(self.depth), whole(self))[1])
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    rows, batches = [], []
    for name in range(600):
        common = text(60)
        rows += [(name, k, k, name, 0, k, k, b"xyz"[k : k + 1] * 10 + common + b"xyz"[k : k + 1] * 10) for k in (1, 2)]
    columns = ["name", "hash", "chunk", "at", "base", "least", "most", "segment"]
    for a in range(0, len(rows), 75):
        part = rows[a : a + 75]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.binary() if i == 7 else pa.int64()) for i in range(8)], names=columns))

    class Rows:
        repartition = sortWithinPartitions = lambda self, *by: self

    answers = [r for b in suffix_dedup._answers(Rows(), 50, 1 << 20, 1 << 20)(iter(batches)) for r in b.to_pylist()]
    assert len(levels) > 1 and max(levels) == 0
    windows = dict.fromkeys(range(600), 0)
    for r in answers:  # a run may come in two parts
        assert (r["chunk"], r["first"]) == (2, 1)
        windows[r["at"]] += r["windows"]
    assert set(windows.values()) == {11}
