import pytest
from pyspark.sql import functions as F

from driftline.errors import ColumnOverlap
from driftline.frame import EventFrame
from driftline.operators.joins import BytesField, ConfigurationLookup, JSONField, LookupField, QueryField, TableLookup


def frames(spark, left, right, l="l bigint", r="r bigint"):  # noqa: E741
    return EventFrame.records(spark, left, l), EventFrame.records(spark, right, r)


def out(f, *names):
    return sorted((tuple(r) for r in f.df.select("_timestamp", *names).collect()), key=str)


def test_asof(spark):
    left, right = frames(spark, [({"l": 1}, "k", 2), ({"l": 2}, "z", 2), ({"l": 3}, "k", 0)], [({"r": 5}, "k", 1), ({"r": 6}, "k", 2), ({"r": 7}, "k", 2)])
    assert out(left.join_asof(right), "l", "r") == [(2, 1, 7)]
    assert out(left.join_asof(right, "left"), "l", "r") == [(0, 3, None), (2, 1, 7), (2, 2, None)]
    assert out(left.join_asof(right, "left", split_ms=1), "l", "r") == [(0, 3, None), (2, 1, 7), (2, 2, None)]


def test_asof_empty_right_value_is_no_match(spark):
    left, right = frames(spark, [({"l": 1}, "k", 2)], [({"r": 5}, "k", 0), (None, "k", 1)])
    assert out(left.join_asof(right), "l") == []


def test_merge_policies(spark):
    left, right = frames(spark, [({"a": 1, "b": 2}, "k", 2), ({"a": 8, "b": 9}, "n", 2)], [({"b": 3, "c": 4}, "k", 1)], "a bigint, b bigint", "b bigint, c bigint")
    with pytest.raises(ColumnOverlap, match="b"):
        left.join_asof(right)
    assert out(left.join_asof(right, "left", on_merge="keep-left"), "a", "b", "c") == [(2, 1, 2, 4), (2, 8, 9, None)]
    assert out(left.join_asof(right, "left", on_merge="keep-right"), "a", "b", "c") == [(2, 1, 3, 4), (2, 8, 9, None)]
    assert out(left.join_asof(right, on_merge=lambda x, y: x["b"] + y["b"]), "value") == [(2, 5)]
    with pytest.raises(ValueError):
        left.join_asof(left.filter(lambda v: v["a"]))
    with pytest.raises(ValueError):
        left.join_asof(right, "outer")


def test_interval(spark):
    left, right = frames(spark, [({"l": 1}, "k", 7)], [({"r": 2}, "k", 10), ({"r": 3}, "k", 30)])
    assert out(left.join_interval(right, "left", forward_ms=3), "l", "r") == [(10, 1, 2), (7, 1, None)]
    assert out(left.join_interval(right, "inner", forward_ms=3), "l", "r") == [(10, 1, 2)]
    assert out(left.join_interval(right, "right", forward_ms=3), "l", "r") == [(10, 1, 2), (30, None, 3)]
    assert out(left.join_interval(right, "outer", forward_ms=3), "l", "r") == [(10, 1, 2), (30, None, 3), (7, 1, None)]
    with pytest.raises(ValueError):
        left.join_interval(right, backward_ms=10, grace_ms=5)


def test_interval_equal_times_and_null_keys(spark):
    left, right = frames(spark, [({"l": 1}, "k", 5), ({"l": 9}, None, 5)], [({"r": 2}, "k", 5), ({"r": 8}, None, 5)])
    assert out(left.join_interval(right, "outer"), "l", "r") == [(5, 1, 2), (5, 9, None), (5, None, 2), (5, None, 8)]


def test_lookups(spark):
    table = spark.createDataFrame([("k1", "foo", 1), ("k1", "foo0", 0), ("k1", "foo5", 5), ("k2", "bar", 2)], "id string, col1 string, col2 int")
    table.createOrReplaceTempView("lookup_table")
    make = lambda: EventFrame.records(spark, [({"a": 1}, "k1", 0), ({"a": 2}, "none", 0)], "a bigint")
    tables = TableLookup({"t": table})
    fields = {
        "first": LookupField("t", ["col1"], "id", order_by="col2"), "last": LookupField("t", ["col1"], "id", order_by="col2", descending=True, default={"col1": "d"}),
        "every": LookupField("t", ["col2"], "id", order_by="col2", first_match_only=False), "asked": QueryField("SELECT id, max(col2) AS m FROM lookup_table GROUP BY id", "id"),
    }
    got = sorted(make().join_lookup(tables, fields).df.select("a", "first.col1", F.col("last.col1").alias("z"), F.expr("transform(every, x -> x.col2)").alias("e"), "asked.m").collect())
    assert [tuple(r) for r in got] == [(1, "foo0", "foo5", [0, 1, 5], 5), (2, None, "d", [], None)]


def test_configuration_versions(spark):
    log = spark.createDataFrame(
        [("c", "k", 1, 0, "created", '{"x": 1}'), ("c", "k", 2, 10, "updated", '{"x": 2}'), ("c", "k", 3, 5, "updated", '{"x": 3}'), ("c", "k", 4, 0, "created", '{"x": 4}'), ("c", "k", 4, 0, "deleted", None), ("c", "*", 1, None, "created", '{"x": 9}')],
        "type string, target_key string, version int, valid_from bigint, event string, content string",
    )
    f = EventFrame.records(spark, [({"a": t}, k, t) for k, t in [("k", 1), ("k", 5), ("k", 20), ("other", 3)]], "a bigint")
    got = f.join_lookup(ConfigurationLookup(log), {"x": JSONField("c", "$.x"), "raw": BytesField("c"), "no": JSONField("d", "$.q", default="-")})
    assert sorted((r["a"], r["x"], r["no"]) for r in got.df.collect()) == [(1, "1", "-"), (3, "9", "-"), (5, "3", "-"), (20, "3", "-")]


def by_hand(left, right, how, grace, back=0, ahead=0):
    """The sequential rules, record by record in order of arrival; (key, time, place, value) rows."""
    log = sorted([(r[2], 1, r) for r in left] + [(r[2], 0, r) for r in right])
    asof, pairs, seen = [], [], {0: [], 1: []}
    for _, side, (k, t, o, v) in log:
        others = [x for x in seen[1 - side] if x[0] == k]
        if side == 1:
            newest = max((x[1] for x in others), default=0)
            fits = [x for x in others if newest - grace <= x[1] <= t]
            best = max(fits, key=lambda x: (x[1], x[2]), default=None)
            if best or how == "left":
                asof.append((t, v, best and best[3]))
            met = [x for x in others if t - back <= x[1] <= t]
            pairs += [(t, v, x[3]) for x in met] + ([(t, v, None)] if not met and how in ("left", "outer") else [])
        else:
            met = [x for x in others if t - ahead <= x[1] <= t]
            pairs += [(t, x[3], v) for x in met] + ([(t, None, v)] if not met and how in ("right", "outer") else [])
        seen[side].append((k, t, o, v))
    return sorted(asof, key=str), sorted(pairs, key=str)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_joins_by_arrival(spark, how):
    import random

    rng = random.Random(5)
    make = lambda n, first: [(rng.choice("ab"), rng.randint(0, 60), first + 2 * i, i) for i in range(n)]
    left, right = make(40, 1), make(40, 0)
    frame = lambda rows, name: EventFrame.of(spark.createDataFrame(rows, f"k string, t bigint, o bigint, {name} bigint"), "k", "t", "o")[[name]]
    asof, pairs = by_hand(left, right, how, 15, 15, 5)
    if how != "outer":
        assert out(frame(left, "l").join_asof(frame(right, "r"), how, grace_ms=15, by_arrival=True), "l", "r") == asof
    got = frame(left, "l").join_interval(frame(right, "r"), how, grace_ms=15, backward_ms=15, forward_ms=5, by_arrival=True)
    assert out(got, "l", "r") == pairs


def test_asof_of_null_keys_and_stretches(spark):
    left, right = frames(spark, [({"l": i}, None if i % 5 == 0 else "k", 7 * i) for i in range(40)], [({"r": i}, "k", 50 * i) for i in range(4)])
    whole = out(left.join_asof(right, "left"), "l", "r")
    for split in (1, 10, 1000):
        assert out(left.join_asof(right, "left", split_ms=split), "l", "r") == whole
    assert len(whole) == 40 and sum(r is None for _, _, r in whole) == 8
