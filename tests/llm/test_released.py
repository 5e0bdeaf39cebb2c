import numpy as np

from driftline.llm import common, wide_simhash


def test_workers_give_freed_memory_back(monkeypatch):
    """A task's end trims the worker's memory, whether it ends or is left early (nothing did before)."""
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common._released(lambda x: x)(iter([1, 2]))) == [1, 2]
    early = common._released(lambda x: x)(iter([1, 2]))
    next(early)
    early.close()
    assert len(calls) == 2


def test_balls_leave_out_what_is_linked_already():
    """Copies in one component say nothing new, however many (each sent all its variants before)."""
    own = np.array([5] * 400 + [5 ^ 1, 900], dtype=np.uint32)
    node, check = np.arange(len(own)), np.zeros(len(own), dtype=np.uint64)
    one = np.zeros(len(own), dtype=np.int64)
    assert not sum(len(wide_simhash.meet(own, node, check, one, at, 3)[0]) for at in range(8))
    one[400] = 1
    met = {n for at in range(8) for n in wide_simhash.meet(own, node, check, one, at, 3)[1].tolist()}
    assert met == set(range(401))
