import pytest
from pyspark.sql import functions as F

from driftline.errors import ColumnDoesNotExist, InvalidOperation
from driftline.frame import EventFrame, try_pipeline
from driftline.operators.windows import HEADERS, KEY, TIME


def frame(spark, values, schema="a bigint, b string"):
    return EventFrame.records(spark, [(v, "k", i) for i, v in enumerate(values)], schema)


def values(f, *names):
    return [tuple(r) for r in f.df.orderBy("_offset").select(*(names or f.value_columns)).collect()]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda f: f["a"] + 1, [2, 0, None]),
        (lambda f: f["a"] - f["a"], [0, 0, None]),
        (lambda f: f["a"] / 4, [0.25, -0.25, None]),
        (lambda f: (f["a"] * 7) % 3, [1, 2, None]),
        (lambda f: (f["a"] * 7) % -3, [-2, -1, None]),
        (lambda f: f["a"] == None, [False, False, True]),  # noqa: E711
        (lambda f: f["a"] != 1, [False, True, True]),
        (lambda f: f["a"].isin([1, None]), [True, False, True]),
        (lambda f: ~f["a"], [False, False, True]),
        (lambda f: f["a"] & f["b"], ["x", "", None]),
        (lambda f: f["a"] | f["b"], ["1", "-1", None]),
        (lambda f: f["b"] + "!", ["x!", "!", None]),
        (lambda f: f["b"].contains("x"), [True, False, None]),
        (lambda f: f["a"].abs(), [1, 1, None]),
        (lambda f: f["b"][-1], ["x", "", None]),
        (lambda f: f["a"].isnull(), [False, False, True]),
        (lambda f: f["a"].notnull(), [True, True, False]),
        (lambda f: f["a"].is_(None), [False, False, True]),
        (lambda f: f["a"].apply(lambda c: c * 10), [10, -10, None]),
    ],
)
def test_series(spark, make, want):
    f = frame(spark, [{"a": 1, "b": "x"}, {"a": -1, "b": ""}, {"a": None, "b": None}])
    f["out"] = make(f)
    assert [v for (v,) in values(f, "out")] == want


def test_series_of_another_frame_is_refused(spark):
    f, g = frame(spark, []), frame(spark, [])
    with pytest.raises(InvalidOperation):
        f["a"] + g["a"]
    with pytest.raises(InvalidOperation):
        bool(f["a"] == 1)
    with pytest.raises(InvalidOperation):
        bool(f)
    with pytest.raises(ColumnDoesNotExist):
        f["none"]


def test_projection_fill_drop_contains(spark):
    f = frame(spark, [{"a": 1, "b": None}])
    assert values(f[["b"]]) == [(None,)]
    f.fill(b="z", c=3)
    assert values(f, "a", "b", "c") == [(1, "z", 3)]
    with pytest.raises(ValueError):
        f.fill()
    assert values(f.apply(lambda v: {"x": f.contains("a").column, "y": f.contains(["a", "q"]).column})) == [(True, False)]
    f.drop("c")
    f.drop([])
    f.drop("q", errors="ignore")
    with pytest.raises(ColumnDoesNotExist):
        f.drop("q")
    with pytest.raises(TypeError):
        f.drop(3)
    assert f.value_columns == ["a", "b"]


def test_filter_drops_null_and_falsy(spark):
    f = frame(spark, [{"a": 1, "b": "x"}, {"a": 0, "b": ""}, {"a": None, "b": None}])
    assert values(f[f["a"] > 0], "a") == [(1,)]
    assert values(f.filter(lambda v: v["b"]), "a") == [(1,)]
    assert values(f.filter(lambda v: v["a"], python=True), "a") == [(1,)]


def test_apply_expand_and_metadata(spark):
    f = frame(spark, [{"a": 2, "b": "p q"}])
    assert values(f.apply(lambda v: F.split(v["b"], " "), expand=True)) == [("p",), ("q",)]
    assert values(f.apply(lambda v: [v["a"]] * v["a"], returns="bigint", expand=True)) == [(2,), (2,)]
    assert values(f.apply(lambda v, k, t, h: F.concat(k, t.cast("string")), metadata=True)) == [("k0",)]
    assert values(f.apply(lambda v, k, t, h: f"{k}{t}", returns="string", metadata=True)) == [("k0",)]


def test_update_in_place(spark):
    f = frame(spark, [{"a": 2, "b": "x"}])
    f.update(lambda v: {"a": v["a"] + 1})
    f.update(lambda v: v.update(b=v["b"] * 2), python=True)
    assert values(f, "a", "b") == [(3, "xx")]


def test_key_time_headers_and_topic(spark):
    f = frame(spark, [{"a": 2, "b": "x"}])
    f = f.group_by("b").set_timestamp(lambda v, k, t, h: t + v["a"])
    f = f.set_headers(lambda v, k, t, h: F.array(F.struct(F.lit("h").alias("key"), F.lit("1").cast("binary").alias("value"))))
    f.to_topic("out").to_topic(lambda v: v["b"], key=lambda v: v["a"])
    row = f.df.first()
    assert (row[KEY], row[TIME], row[HEADERS][0]["key"]) == ("x", 2, "h")
    assert [t for t, _ in f.outputs][0] == "out" and f.outputs[1][1].first()["_topic"] == "x"
    with pytest.raises(ValueError):
        f.group_by(lambda v: v["a"])


def test_concat_and_self(spark):
    f, g = frame(spark, [{"a": 1, "b": "x"}]), frame(spark, [1], "bigint")
    assert f.concat(g).df.count() == 2
    with pytest.raises(InvalidOperation):
        f.concat(f)


def test_stateful_ttl_and_none_key(spark):
    f = EventFrame.records(spark, [({"a": i}, k, t) for i, (k, t) in enumerate([("x", 0), ("x", 5), (None, 5), ("x", 10), ("x", 25)])], "a bigint")

    def first(value, state):
        if state.exists("s"):
            return False
        state.set("s", 1, ttl=10)
        return True

    assert values(f.filter(first, stateful=True)) == [(0,), (3,), (4,)]


def test_try_pipeline(spark):
    out = try_pipeline(spark, lambda f: f.apply(lambda v: v["a"] * 2), {"a": 4}, "a bigint", timestamp=7)
    assert out == [{"_key": "key", "_timestamp": 7, "_headers": None, "_offset": 0, "value": 8}]


def test_frames_as_masks_and_values(spark):
    f = EventFrame.records(spark, [({"a": i, "b": "x" * (i % 3)}, "k", i) for i in range(6)], "a bigint, b string")
    assert sorted(r["a"] for r in f[f.apply(lambda v: v["b"])].df.collect()) == [1, 2, 4, 5]
    g = f.apply(lambda v: {"a": v["a"], "c": v["a"] % 2})
    assert sorted(r["a"] for r in g[g.apply(lambda v: v["c"])].df.collect()) == [1, 3, 5]
    f["n"] = f.apply(lambda v: {"y": v["a"] + 1}).apply(lambda v: v["y"] * 10)
    f["m"] = f.apply(lambda v: v["n"] + 1, returns="bigint")
    f["s"] = f.apply(lambda v: {"p": v["n"], "q": v["b"]}, returns="p bigint, q string")
    assert sorted((r["n"], r["m"], r["s"]["p"]) for r in f.df.collect())[:2] == [(10, 11, 10), (20, 21, 20)]
    stale = f.apply(lambda v: v["a"])
    f["z"] = 1
    for bad in (stale, f.filter(lambda v: v["a"]), f.apply(lambda v: F.array(v["a"]), expand=True), EventFrame.records(spark, [({"a": 1}, "k", 1)], "a bigint")):
        with pytest.raises(InvalidOperation):
            f[bad]
        with pytest.raises(InvalidOperation):
            f["w"] = bad


def test_update_names_with_odd_text(spark):
    f = EventFrame.records(spark, [({"a": 1}, "k", 1)], "a bigint")
    f.update(lambda v: {"b AS c": v["a"] + 1, "d": 5})
    assert f.value_columns == ["a", "b AS c", "d"] and f.df.first()["b AS c"] == 2


def test_error_callbacks(spark):
    f = EventFrame.records(spark, [({"a": i}, "k", i) for i in range(4)], "a bigint")
    broken = lambda v: 12 // v["a"]
    with pytest.raises(Exception):  # noqa: B017
        f.apply(broken, returns="bigint").df.collect()
    f.on_error = lambda e, v: isinstance(e, ZeroDivisionError) and v == {"a": 0}
    assert sorted(r["value"] for r in f.apply(broken, returns="bigint").df.collect()) == [4, 6, 12]
    assert f.filter(broken, python=True).df.count() == 3

    def total(v, state):
        state.set("t", state.get("t", 0) + broken(v))
        return state.get("t")

    assert sorted(r["value"] for r in f.apply(total, returns="bigint", stateful=True).df.collect()) == [12, 18, 22]


def test_bounded_runs(spark, tmp_path, capfd):
    f = EventFrame.records(spark, [({"a": i}, "k", i) for i in range(5)], "a bigint")
    assert len(f.run(count=2)) == 2 and len(f.run()) == 5 and f.run(collect=False) == []
    f.df.write.parquet(str(tmp_path / "in"))
    live = lambda: EventFrame(spark.readStream.schema(f.df.schema).parquet(str(tmp_path / "in")))
    assert len(live().run(count=3)) == 3
    assert sorted(r["_timestamp"] for r in live().run(timeout=3, metadata=True)) == [0, 1, 2, 3, 4]
    assert len(live().run()) == 5
    shown = live().print_table(title="newest")
    from driftline.sinks.writers import ListSink

    shown.sink(ListSink()).awaitTermination(60)
    for q in spark.streams.active:
        q.awaitTermination(60)
    assert "newest" in capfd.readouterr().out
    with pytest.raises(ValueError):
        f.run(count=-1)
