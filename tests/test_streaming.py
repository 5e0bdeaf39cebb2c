"""Streams from files, one file a micro-batch, against the batch plans on the same records."""

import itertools

import pytest
from pyspark.sql import functions as F

from driftline.frame import EventFrame
from driftline.operators import aggregations as A
from driftline.sinks.writers import FileSink, ListSink
from driftline.streaming.processors import silent_keys

_n = itertools.count()


def stream(spark, tmp_path, records, schema, per_file=3):
    """The records as a streaming frame, and as a batch frame."""
    batch = EventFrame.records(spark, records, schema)
    path = str(tmp_path / f"in{next(_n)}")
    for i in range(0, len(records), per_file):
        batch.df.where(F.col("_offset").between(i, i + per_file - 1)).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(batch.df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return EventFrame(live), batch


def run(frame, tmp_path, *names, output=None):
    sink = ListSink(metadata=True)
    q = frame.sink(sink, checkpoint=str(tmp_path / f"cp{next(_n)}"), output=output)
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((tuple(r[n] for n in names) for r in sink), key=str)


def rows(frame, *names):
    return sorted((tuple(r) for r in frame.df.select(*names).collect()), key=str)


RECORDS = [({"v": i}, "ab"[i % 2], t) for i, t in enumerate([1, 3, 5, 12, 14, 9, 23, 25, 31, 40, 41, 55])]


def test_key_windows_equal_batch(spark, tmp_path):
    for make in (lambda f: f.tumbling_window(10, grace_ms=2), lambda f: f.hopping_window(10, 5)):
        live, batch = stream(spark, tmp_path, RECORDS, "v bigint", per_file=5)
        aggs = {"n": A.Count(), "s": A.Sum("v"), "e": A.Earliest("v"), "c": A.Collect("v")}
        names = ("_key", "start", "end", "n", "s", "e", "c")
        assert run(make(live).agg(**aggs).final(), tmp_path, *names) == rows(make(batch).agg(**aggs).final(), *names)


def test_sliding_and_count_equal_batch(spark, tmp_path):
    ordered = sorted(RECORDS, key=lambda r: r[2])
    for make in (lambda f: f.sliding_window(10), lambda f: f.hopping_count_window(3, 2)):
        live, batch = stream(spark, tmp_path, ordered, "v bigint", per_file=6)
        names = ("_key", "start", "end", "s")
        assert run(make(live).agg(s=A.Sum("v")).final(), tmp_path, *names) == rows(make(batch).agg(s=A.Sum("v")).final(), *names)


def test_current_and_triggers(spark, tmp_path):
    live, batch = stream(spark, tmp_path, RECORDS, "v bigint", per_file=6)
    names = ("_key", "start", "s", "_offset")
    assert run(live.tumbling_window(10).agg(s=A.Sum("v")).current(), tmp_path, *names) == rows(batch.tumbling_window(10).agg(s=A.Sum("v")).current(), *names)
    live, batch = stream(spark, tmp_path, RECORDS, "v bigint", per_file=6)
    make = lambda f: f.tumbling_window(10, after_update=lambda agg, v, k, t, h: agg["s"] >= 6).agg(s=A.Sum("v")).final()
    assert run(make(live), tmp_path, *names[:3]) == rows(make(batch), *names[:3])


def test_partition_closing_by_watermark(spark, tmp_path):
    live, _ = stream(spark, tmp_path, [({"v": 1}, "a", 1000), ({"v": 2}, "b", 2000), ({"v": 3}, "a", 30_000), ({"v": 4}, "a", 60_000)], "v bigint", per_file=1)
    got = run(live.tumbling_window(10_000).agg(s=A.Sum("v")).final("partition"), tmp_path, "_key", "start", "s")
    assert got[:3] == [("a", 0, 1), ("a", 30_000, 3), ("b", 0, 2)]


def test_joins_equal_batch(spark, tmp_path):
    left = [({"l": i}, "ab"[i % 2], t) for i, t in enumerate([4, 9, 15, 22, 30])]
    right = [({"r": i}, "ab"[i % 2], t) for i, t in enumerate([1, 9, 12, 25, 29])]
    for make in (lambda a, b: a.join_asof(b, "left"), lambda a, b: a.join_interval(b, "outer", backward_ms=6, forward_ms=6)):
        (l, lb), (r, rb) = stream(spark, tmp_path, left, "l bigint", 9), stream(spark, tmp_path, right, "r bigint", 9)
        names = ("_key", "_timestamp", "l", "r")
        assert run(make(l, r), tmp_path, *names) == rows(make(lb, rb), *names)


def test_state_survives_a_restart(spark, tmp_path):
    def total(value, state):
        state.set("t", state.get("t", 0) + value["v"])
        return state.get("t")

    batch = EventFrame.records(spark, [({"v": 1}, "k", 0)], "v bigint")
    path, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []
    for k in range(3):
        batch.df.withColumn("v", F.lit(10**k)).write.mode("append").parquet(path)
        live = EventFrame(spark.readStream.schema(batch.df.schema).parquet(path))
        sink = ListSink()
        live.apply(total, returns="bigint", stateful=True).sink(sink, checkpoint=checkpoint).awaitTermination(120)
        seen += [r["value"] for r in sink]
    assert seen == [1, 11, 111]


def test_file_sink_writes_a_batch_once(spark, tmp_path):
    live, batch = stream(spark, tmp_path, RECORDS[:6], "v bigint", per_file=3)
    sink = FileSink(str(tmp_path / "out"), "json", "t")
    live.sink(sink, checkpoint=str(tmp_path / "cpf")).awaitTermination(120)
    sink.write(batch.df.where("_offset < 3"), 0)  # the batch comes again
    assert spark.read.json(str(tmp_path / "out/t/*")).count() == 6


def test_silence_is_told_once(spark, tmp_path):
    live, _ = stream(spark, tmp_path, [({"v": 1}, "k", 5)], "v bigint")
    got = []
    q = silent_keys(live.df, 1000).writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cps")).trigger(processingTime="1 second").start()
    import time

    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(1)
    time.sleep(3)
    q.stop()
    assert [(r["_key"], r["last_timestamp"]) for r in got] == [("k", 5)]
