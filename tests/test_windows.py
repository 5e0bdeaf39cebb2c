import pytest
from pyspark.sql import functions as F

from driftline.frame import EventFrame
from driftline.operators import aggregations as A
from driftline.operators.windows import window_ranges
from driftline.streaming.engine import Engine


def frame(spark, records, schema="bigint"):
    return EventFrame.records(spark, records, schema)


def out(f, *names):
    return sorted(tuple(r) for r in f.df.select("_key", *names).collect())


@pytest.mark.parametrize(
    ("time", "duration", "step", "want"),
    [(1, 20, 20, [(0, 20)]), (0, 10, 5, [(0, 10)]), (12, 10, 5, [(5, 15), (10, 20)]), (10, 10, 5, [(5, 15), (10, 20)]), (25, 10, 3, [(18, 28), (21, 31), (24, 34)])],
)
def test_ranges(spark, time, duration, step, want):
    from driftline.operators.windows import starts

    assert window_ranges(time, duration, step) == want
    got = spark.range(1).select(starts(F.lit(time).cast("long"), duration, step).alias("s")).first()["s"]
    assert [(s, s + duration) for s in got] == want


def test_final_sum_leaves_open_windows(spark):
    f = frame(spark, [(1, "t", 1), (1, "t", 2), (2, "t", 20), (3, "t", 39), (4, "t", 38)])
    assert out(f.tumbling_window(10).sum().final(), "start", "end", "value") == [("t", 0, 10, 2), ("t", 20, 30, 2)]


def test_current_emits_every_update(spark):
    f = frame(spark, [(1, "k", 1000), (2, "k", 9000), (3, "k", 20010)])
    got = f.tumbling_window(10_000, grace_ms=1000).sum().current().df.orderBy("_offset").collect()
    assert [(r["value"], r["_timestamp"], r["_headers"]) for r in got] == [(1, 0, None), (3, 0, None), (3, 20_000, None)]


def test_late_record(spark):
    f = frame(spark, [(1, "t", 1), (2, "t", 20), (3, "t", 19)])
    w = f.tumbling_window(10).sum()
    assert out(w.final(), "start", "value") == [("t", 0, 1)]
    assert [(r["value"], r["start"], r["late_by_ms"]) for r in w.late().collect()] == [(3, 10, 1)]


def test_partition_closing(spark):
    rows = [(1, "a", 100), (3, "a", 105), (5, "b", 102), (7, "b", 108), (2, "a", 110), (2, "b", 109), (2, "a", 112)]
    f = EventFrame.records(spark, rows, "bigint")
    assert out(f.tumbling_window(10, grace_ms=2).sum().final("partition"), "start", "value") == [("a", 100, 4), ("b", 100, 14)]


@pytest.mark.parametrize(
    ("agg", "rows", "want"),
    [
        (A.Count("v"), [1, None, 3], 2), (A.Sum("v"), [None, None], 0), (A.Sum("v"), [1, None, 3], 4), (A.Mean("v"), [1, None, 3], 2.0), (A.Mean("v"), [None], None),
        (A.Max("v"), [1, None, 3], 3), (A.Min("v"), [None, 4, 3], 3), (A.Earliest("v"), [None, 4, 3], 4), (A.Latest("v"), [5, 4, None], 4), (A.First("v"), [None, 7], 7),
        (A.Last("v"), [7, 8, None], 8), (A.Collect("v"), [1, None, 2], [1, None, 2]), (A.Sum("absent"), [1], 0), (A.Count(), [1, 2], 2),
        (A.Reduce(lambda a, b: a + b, lambda v: v, "v"), [1, 2, 3], 6),
    ],
)
def test_aggregators(spark, agg, rows, want):
    """Batch plan, pane plan and sequential engine agree."""
    records = [({"v": v, "w": 1}, "k", i) for i, v in enumerate(rows)] + [({"v": 9, "w": 1}, "k", 50)]
    if isinstance(agg, A.Sum) and agg.column == "absent":
        pass
    for ordered in (False, True):
        f = EventFrame.records(spark, records, "v bigint, w bigint", ordered=ordered)
        assert [r["x"] for r in f.tumbling_window(10).agg(x=agg).final().df.collect()] == [want]
        assert f.hopping_window(10, 5).agg(x=agg).final().df.where("start = 0").first()["x"] == want
    engine = Engine("tumbling", {"duration": 10, "step": 10, "grace": 0}, {"x": agg}, False)
    state, got = engine.fresh(), []
    for i, (v, k, t) in enumerate(records):
        got += engine.process(state, v, k, t, None, i)
    assert [r["x"] for _, _, r in got] == [want] or (want in (0, None) and got == [])


def test_collectors_and_names(spark):
    f = frame(spark, [({"v": 1}, "k", 1)], "v bigint")
    with pytest.raises(ValueError):
        f.tumbling_window(10).collect().current()
    with pytest.raises(ValueError):
        f.tumbling_window(10).agg(start=A.Count())
    columns = f.tumbling_window(10).agg(c=A.Collect(), n=A.Count()).final().value_columns
    assert columns == ["n", "c", "start", "end"]


@pytest.mark.parametrize("make", [lambda f: f.tumbling_window(0), lambda f: f.hopping_window(10, 10), lambda f: f.hopping_window(10, 0), lambda f: f.tumbling_window(10, grace_ms=-1), lambda f: f.tumbling_count_window(1), lambda f: f.hopping_count_window(3, 0)])
def test_validation(spark, make):
    with pytest.raises(ValueError):
        make(frame(spark, []))


def test_sliding_left_windows(spark):
    f = frame(spark, [("A", "k", 23), ("B", "k", 20), ("C", "k", 27), ("z", "k", 60)], "string")
    got = out(f.sliding_window(10, grace_ms=15).collect().final(), "start", "end", "value")
    assert got == [("k", 10, 20, ["B"]), ("k", 13, 23, ["B", "A"]), ("k", 17, 27, ["B", "A", "C"])]


def test_count_windows(spark):
    f = frame(spark, [(i, "k", i) for i in range(1, 12)])
    got = out(f.hopping_count_window(5, 2).collect().final(), "start", "end", "value")
    assert [v for *_, v in got] == [[1, 2, 3, 4, 5], [3, 4, 5, 6, 7], [5, 6, 7, 8, 9], [7, 8, 9, 10, 11]]
    assert out(f.tumbling_count_window(4).sum().final(), "value") == [("k", 10), ("k", 26)]
    assert out(f.hopping_count_window(4, 9).sum().final(), "value") == [("k", 10), ("k", 26)]
    assert len(out(f.sliding_count_window(3).sum().final(), "value")) == 9
    assert [v for *_, v in sorted(tuple(r) for r in f.tumbling_count_window(4).sum().current().df.select("_offset", "value").collect())] == [1, 3, 6, 10, 5, 11, 18, 26, 9, 19, 30]


def test_triggers_replay(spark):
    records = [(v, "k", t) for v, t in [(1, 1), (2, 2), (3, 3), (4, 4), (1, 20)]]
    f = frame(spark, records)
    after = f.tumbling_window(10, after_update=lambda agg, v, k, t, h: agg >= 3).sum().final()
    assert out(after, "start", "value") == [("k", 0, 3), ("k", 0, 3), ("k", 0, 4)]
    before = f.tumbling_window(10, before_update=lambda agg, v, k, t, h: agg + v > 4).sum().final()
    assert out(before, "start", "value") == [("k", 0, 3), ("k", 0, 4)]
    with pytest.raises(ValueError):
        from driftline.operators.windows import Definition

        Definition(f, "sliding", None, {"before_update": len}, duration=3, grace=0)


def test_hot_key_stretches(spark):
    """Running clocks and numbers cut into stretches equal the plain ones."""
    records = [(i, "k", (i * 37) % 50 + i) for i in range(300)]
    whole, cut = (EventFrame(frame(spark, records).df, stretch=s) for s in (1 << 20, 16))
    for make in (lambda f: f.tumbling_window(10, grace_ms=5).sum().final(), lambda f: f.tumbling_count_window(7).sum().final(), lambda f: f.sliding_window(9, grace_ms=3).sum().final()):
        assert out(make(whole), "start", "end", "value") == out(make(cut), "start", "end", "value")
