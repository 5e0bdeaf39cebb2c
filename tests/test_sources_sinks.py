import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline import formats
from driftline.errors import IgnoreMessage
from driftline.frame import EventFrame
from driftline.sinks import services as S
from driftline.sinks import writers as W
from driftline.sources import readers as R
from driftline.sources.clients import Buffered, TimeSlices


def make(spark):
    return EventFrame.records(spark, [({"a": 1, "b": "x"}, "k1", 1_700_000_000_000), ({"a": 2, "b": None}, None, 1_700_003_600_000)], "a bigint, b string")


def values(f, *names):
    return sorted((tuple(r) for r in f.df.select(*names).collect()), key=str)


def test_files_round_trip(spark, tmp_path):
    f = make(spark)
    for form in ("json", "parquet"):
        f.sink(W.LocalFileSink(str(tmp_path / form), form=form, compression="gzip"))
        got = R.local_files(spark, str(tmp_path / form), form=form)
        assert values(got, "_key", "_timestamp", "a", "b") == values(f, "_key", "_timestamp", "a", "b")


def test_csv(spark, tmp_path):
    f = make(spark)
    f.sink(W.CSVSink(str(tmp_path / "c")))
    got = R.csv(spark, str(tmp_path / "c"), key="key", timestamp=F.col("timestamp").cast("long"))
    assert dict(got.df.dtypes)["timestamp"] == "string"
    assert sorted(r["_key"] or "" for r in got.df.collect()) == ["", "k1"]
    assert {json.loads(r["value"])["a"] for r in got.df.collect()} == {1, 2}


def test_lake(spark, tmp_path):
    make(spark).sink(W.LakeSink(str(tmp_path / "lake"), ["b", "year", "hour"]))
    got = spark.read.parquet(str(tmp_path / "lake"))
    assert {(r["a"], r["b"], r["year"], int(r["hour"])) for r in got.collect()} == {(1, "x", 2023, 22), (2, None, 2023, 23)}
    assert (tmp_path / "lake" / "b=__HIVE_DEFAULT_PARTITION__").exists()


def test_pandas(spark):
    pdf = pd.DataFrame({"k": ["a", "b"], "t": [1, 2], "v": [0.5, 1.5]})
    assert values(R.pandas(spark, pdf, "k", "t", keep_meta_as_values=False), "_key", "_timestamp", "v") == [("a", 1, 0.5), ("b", 2, 1.5)]
    with pytest.raises(ValueError):
        R.pandas(spark, pdf, "v", "t")
    with pytest.raises(ValueError):
        R.pandas(spark, pdf, "k", "v")


def test_topic_decodes_broker_rows(spark):
    df = spark.createDataFrame([(b"k", b'{"a": 1, "ts": 9}', "t", 0, 5)], "key binary, value binary, topic string, partition int, offset bigint").withColumn("timestamp", F.timestamp_millis(F.lit(1000)))
    got = R.Topic("t", schema="a bigint, ts bigint", key_format="string", timestamp=lambda v: v["ts"]).decode(df)
    assert values(got, "_key", "_timestamp", "_offset", "a") == [("k", 9, 5, 1)]
    sent = W.KafkaSink("host:1", "out", key_format="string").rows(make(spark).df).collect()
    assert bytes(sent[0]["value"]) == b'{"a":1,"b":"x"}' and bytes(sent[0]["key"]) == b"k1"


class Client:
    def __init__(self, options):
        self.options = options

    def schema(self):
        return "k string, t bigint"

    def slices(self, since):
        at = since or 0
        return [{"n": at}, {"n": at + 1}], at + 2

    def rows(self, part):
        yield (f"k{part['n']}", part["n"])


class LogClient(Client):
    """A stream of numbers up to what a file says; commits are written to another."""

    def latest(self):
        with open(f"{self.options['path']}/upto") as f:
            return int(f.read())

    def between(self, start, end):
        return [{"n": n} for n in range(start or 0, end)]

    def commit(self, at):
        with open(f"{self.options['path']}/committed", "a") as f:
            f.write(f"{at}\n")


def test_polled_stream_is_bounded_and_committed(spark, tmp_path):
    seen = []
    for upto in (3, 5):
        (tmp_path / "upto").write_text(str(upto))
        live = R.polled(spark, "tests.test_sources_sinks:LogClient", key="k", timestamp="t", streaming=True, path=str(tmp_path))
        sink = W.ListSink()
        live.sink(sink, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
        seen.append(sorted(r["t"] for r in sink))
    assert seen == [[0, 1, 2], [3, 4]]


class Queue(Buffered):
    """Messages in memory; ``acked`` holds those acknowledged."""

    waiting, acked = [], []

    def pull(self, most, timeout, keep):
        got = self.waiting[:most]
        keep([("k", d, 1) for d in got])
        del self.waiting[:most]
        self.acked.extend(got)


def test_queues_are_spooled_before_they_are_acknowledged(tmp_path):
    q = Queue({"spool": str(tmp_path / "spool"), "max_messages": "2"})
    Queue.waiting[:] = [b"a", b"b", b"c"]
    first = q.latest()
    assert Queue.acked == [b"a", b"b"]
    again = Queue({"spool": str(tmp_path / "spool")})  # after a restart the batch is there still, as often as asked for
    for _ in range(2):
        assert [r for s in again.between(None, first) for r in again.rows(s)] == [("k", b"a", 1), ("k", b"b", 1)]
    second = again.latest()
    again.commit(first)
    assert again.between(None, first) == [] and [d for s in again.between(first, second) for _, d, _ in again.rows(s)] == [b"c"]
    assert again.latest() == second
    again.commit(second)
    assert q.latest() == second
    with pytest.raises(ValueError):
        Queue({})

    class Failing(Queue):
        def _write(self, name, text):
            raise OSError

    Queue.waiting[:] = [b"d"]
    with pytest.raises(OSError):
        Failing({"spool": str(tmp_path / "spool")}).latest()
    assert Queue.waiting == [b"d"]


def test_time_slices_do_not_change():
    c = TimeSlices({"measurements": "a,b", "start_ms": "0", "end_ms": "25", "step_ms": "10"})
    assert c.latest() == 25 and c.between(10, 25) == c.between(10, 25)
    assert [(s["measurement"], s["start"], s["end"]) for s in c.slices(20)[0]] == [("a", 20, 25), ("b", 20, 25)]


def test_python_deserializers(spark):
    df = spark.createDataFrame([(b"k", b"1"), (b"k", b"x"), (b"k", b"skip")], "key binary, value binary").selectExpr("*", "'t' AS topic", "0 AS partition", "0L AS offset", "timestamp_millis(5) AS timestamp")

    def read(raw):
        if raw == b"skip":
            raise IgnoreMessage
        return {"a": int(raw)}

    topic = lambda **o: R.Topic("t", read, key_format="string", schema="struct<a:bigint>", **o)
    assert values(topic(on_error="skip").decode(df), "a") == [(1,)]
    assert values(topic(on_error=lambda e, raw: isinstance(e, ValueError)).decode(df), "a") == [(1,)]
    with pytest.raises(Exception):  # noqa: B017
        topic().decode(df).df.collect()
    bad = df.withColumn("value", F.when(F.col("value") == F.lit(b"1"), F.lit(b'{"a": 1}')).otherwise(F.col("value")))
    got = R.Topic("t", schema="struct<a:bigint>", key_format="string", on_error="skip").decode(bad)
    assert values(got, "a") == [(1,)] and "_broken" not in got.df.columns


def test_schema_registry(spark):
    asked = []

    def ask(method, path, body):
        asked.append((method, path))
        return {"id": 7, "schema": "{}"}

    registry = formats.SchemaRegistry("http://registry", ask=ask)
    df = spark.createDataFrame([(3,)], "a bigint").select(registry.encode(F.struct("a"), "t-value", "json", "{}").alias("value"))
    raw = bytes(df.first()["value"])
    assert raw[:5] == b"\x00\x00\x00\x00\x07" and json.loads(raw[5:]) == {"a": 3}
    assert asked == [("POST", "/subjects/t-value/versions")] and registry.latest("t-value") == (7, "{}")
    assert df.select(registry.decode(F.col("value"), "t-value", "json", "a bigint").alias("v")).first()["v"]["a"] == 3
    topic = R.Topic("t", schema="a bigint", key_format="string", registry=registry)
    rows = df.selectExpr("CAST('k' AS binary) AS key", "value", "'t' AS topic", "0 AS partition", "0L AS offset", "timestamp_millis(5) AS timestamp")
    assert values(topic.decode(rows), "_key", "a") == [("k", 3)]
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(registry.decode(F.lit(b"no"), "s", "json", "a bigint")).collect()


def test_polled_source(spark):
    got = R.polled(spark, "tests.test_sources_sinks:Client", key="k", timestamp="t")
    assert values(got, "_key", "_timestamp") == [("k0", 0), ("k1", 1)]


def test_wire_formats(spark):
    df = spark.createDataFrame([(-5, 1.5, "é")], "i int, d double, s string")
    for name, form in (("i", "integer"), ("d", "double"), ("s", "string")):
        data = df.select(formats.to_bytes(F.col(name), form).alias("b"))
        assert data.select(formats.from_bytes(F.col("b"), form)).first()[0] == df.first()[name]
    assert bytes(df.select(formats.to_bytes(F.col("i"), "integer")).first()[0]) == (-5).to_bytes(4, "big", signed=True)
    bad = spark.createDataFrame([(b"{",)], "b binary")
    assert bad.select(formats.lenient(F.col("b"), "a bigint").alias("x")).first()["x"]["a"] is None
    assert bad.select(formats.lenient(F.col("b"), "struct<a:bigint>").alias("x")).first()["x"][formats.BROKEN] == "{"
    with pytest.raises(Exception):  # noqa: B017
        bad.select(formats.from_bytes(F.col("b"), "json", "a bigint")).collect()


def test_envelopes(spark):
    text = json.dumps({"Timestamps": [1, 2], "NumericValues": {"x": [0.5, None]}, "StringValues": {"s": ["p", "q"]}, "BinaryValues": {"b": ["AQ==", None]}, "TagValues": {"t": ["u", "v"]}})
    df = spark.createDataFrame([(text,)], "v string")
    got = formats.timeseries_rows(df, "v", ["x"], ["s"], ["b"], ["t"]).orderBy("Timestamp").collect()
    assert [(r["Timestamp"], r["x"], r["s"], r["b"] and bytes(r["b"]), r["Tags"]["t"]) for r in got] == [(1, 0.5, "p", b"\x01", "u"), (2, None, "q", None, "v")]
    one = json.dumps({"Timestamp": 3, "Id": "i", "Value": "w", "Tags": {}})
    events = spark.createDataFrame([(one,), (f"[{one},{one}]",)], "v string")
    assert formats.event_rows(events, "v").count() == 3
    made = spark.range(1).select(formats.timeseries_json(F.lit(7), {"x": F.lit(1.5)}, tags={"t": F.lit("u")}).alias("j"), formats.event_json(F.lit(7), F.lit("i"), F.lit("w")).alias("e")).first()
    assert json.loads(made["j"]) == {"Timestamps": [7], "NumericValues": {"x": [1.5]}, "TagValues": {"t": ["u"]}} and json.loads(made["e"])["Id"] == "i"


ROWS = [{"_key": "k", "_timestamp": 5, "_headers": None, "_offset": 0, "a": 1, "b": "x y", "c": 0.5, "d": None}]


def test_line_protocol():
    assert next(iter(S.InfluxDB3Sink(None, "m,1", tags=["b"]).requests(ROWS))) == r"m\,1,b=x\ y a=1i,c=0.5 5"
    assert list(S.InfluxDB3Sink(None, "m", fields=["d"]).requests(ROWS)) == []
    assert next(iter(S.TDengineSink(None, "s", subtable=lambda r: f"t{r['a']}", fields=["c"]).requests(ROWS))) == "s,__subtable=t1 c=0.5 5"


def test_postgres_statements():
    sink = S.PostgreSQLSink(None, "t", primary_key=["a"], on_conflict="update")
    got = list(sink.requests([*ROWS, ROWS[0] | {"b": "z"}]))
    assert got[0][0].startswith('CREATE TABLE IF NOT EXISTS "t" ("a" BIGINT') and "PRIMARY KEY" in got[0][0]
    assert 'ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"' in got[-1][0]
    assert len(got[-1][1]) == 1 and got[-1][1][0][1] == "z"
    with pytest.raises(ValueError):
        S.PostgreSQLSink(None, "t", on_conflict="update")


def test_other_requests():
    assert next(iter(S.MongoDBSink(None).requests(ROWS))) == ({"_id": "k"}, {"$set": {"a": 1, "b": "x y", "c": 0.5, "d": None}})
    assert next(iter(S.Neo4jSink(None, "MERGE (n)").requests(ROWS)))[0] == "UNWIND $events AS event MERGE (n)"
    assert next(iter(S.ElasticsearchSink(None, "i").requests(ROWS))).split("\n")[0] == '{"index": {"_index": "i", "_id": "k"}}'
    assert next(iter(S.RedisSink(None).requests(ROWS)))[0][0] == "k"
    assert next(iter(S.KinesisSink(None, "s").requests(ROWS)))[0]["PartitionKey"] == "k"
    assert next(iter(S.PubSubSink(None, "s").requests(ROWS)))[0][1] == "k"
    assert next(iter(S.MQTTSink(None, lambda r: f"t/{r['a']}").requests(ROWS)))[0][0] == "t/1"


def test_client_sink_sends_by_partition(spark, tmp_path):
    path = str(tmp_path)

    class Log:
        def pipeline(self, transaction):
            return self

        def set(self, k, v):
            with open(f"{path}/{k}", "w") as f:
                f.write(v)

        def execute(self):
            pass

    make(spark).sink(S.RedisSink(Log))
    assert json.loads((tmp_path / "k1").read_text()) == {"a": 1, "b": "x"}


def test_backpressure_tries_again(spark):
    calls = []

    class Busy(W.Sink):
        def write(self, df, batch_id):
            calls.append(1)
            if len(calls) < 3:
                raise W.Backpressure(0)

    make(spark).sink(Busy())
    assert len(calls) == 3


def test_list_sink(spark):
    sink = W.ListSink()
    make(spark).sink(sink)
    assert {r["a"] for r in sink} == {1, 2}
