"""Sinks: ``run(frame)`` writes a batch frame, or starts a query that writes each micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formats import to_bytes
from ..frame import EventFrame
from ..operators.windows import HEADERS, KEY, ORDER, TIME


class Backpressure(Exception):
    """Raised by a client that wants the batch again after ``retry_after`` seconds."""

    def __init__(self, retry_after: float):
        super().__init__(f"again in {retry_after} s")
        self.retry_after = retry_after


class Sink:
    """Base: ``write(df, batch_id)`` gets frame columns; a failed streaming batch comes again under the same id."""

    mode = "append"

    def write(self, df: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def run(self, frame: EventFrame, checkpoint: str | None = None, trigger: dict[str, Any] | None = None, output: str | None = None, retries: int = 3) -> Any:
        """``trigger`` as of ``DataStreamWriter.trigger`` (availableNow by default)."""

        def batch(df: DataFrame, batch_id: int) -> None:
            for k in range(retries + 1):
                try:
                    return self.write(df, batch_id)
                except Backpressure as e:
                    if k == retries:
                        raise
                    time.sleep(e.retry_after)

        for side, df in frame.outputs:  # what goes elsewhere on the way has its own query, and its own checkpoint
            if isinstance(side, Sink):
                side.beside(df, trigger)
        if not frame.df.isStreaming:
            return batch(frame.df, 0)
        writer = frame.df.writeStream.outputMode(output or self.mode).foreachBatch(batch).trigger(**(trigger or {"availableNow": True}))
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


    def beside(self, df: DataFrame, trigger: dict[str, Any] | None) -> Any:
        """Writes records that a frame passed on its way to another sink."""
        if not df.isStreaming:
            return self.write(df, 0)
        return df.writeStream.outputMode(self.mode).foreachBatch(self.write).trigger(**(trigger or {"availableNow": True})).start()


class ShowSink(Sink):
    """Shows each batch, for debugging."""

    def __init__(self, show: Callable[[DataFrame], None]):
        self.show = show

    def write(self, df: DataFrame, batch_id: int) -> None:
        self.show(df)


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (KEY, TIME, HEADERS, ORDER, "_topic", "_partition")]


def value_of(df: DataFrame) -> Column:
    names = value_columns(df)
    return F.col("value") if names == ["value"] else F.struct(*names)


def as_json(df: DataFrame) -> Column:
    value = value_of(df)
    simple = value_columns(df) == ["value"] and "struct" not in dict(df.dtypes)["value"]
    return F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v") if simple else F.to_json(value)


class CSVSink(Sink):
    """Key, value (JSON), timestamp, order; appended to a folder of CSV files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, batch_id: int) -> None:
        out = df.select(F.col(KEY).cast("string").alias("key"), as_json(df).alias("value"), F.col(TIME).alias("timestamp"), F.col(ORDER).alias("offset"))
        out.write.mode("append").option("header", True).csv(self.path)


class ListSink(Sink, list):
    """Rows as dicts in this list, for tests; with ``metadata`` the reserved columns too. Small results only."""

    def __init__(self, metadata: bool = False):
        super().__init__()
        self.metadata = metadata

    def write(self, df: DataFrame, batch_id: int) -> None:
        names = df.columns if self.metadata else value_columns(df)
        self.extend(r.asDict(recursive=True) for r in df.select(*names).collect())


class FileSink(Sink):
    """JSON lines (``_timestamp, _key, _value``) or Parquet (value columns flat), by topic folder.

    A micro-batch is a folder of its own that a repeated run replaces, so a batch is written once.
    """

    def __init__(self, path: str, form: str = "json", topic: str = "topic", compression: str | None = None):
        if form not in ("json", "parquet"):
            raise ValueError("files are json or parquet")
        self.path, self.form, self.topic, self.compression = path, form, topic, compression

    def write(self, df: DataFrame, batch_id: int) -> None:
        head = [F.col(TIME), F.col(KEY)]
        out = df.select(*head, value_of(df).alias("_value")) if self.form == "json" else df.select(*head, *value_columns(df))
        writer = out.write.mode("overwrite")
        if self.compression:
            writer = writer.option("compression", self.compression)
        writer.format(self.form).save(f"{self.path.rstrip('/')}/{self.topic}/{batch_id:019d}")


def LocalFileSink(path: str, **options: Any) -> FileSink:  # noqa: N802
    return FileSink(path, **options)


def S3FileSink(bucket: str, path: str = "", **options: Any) -> FileSink:  # noqa: N802
    return FileSink(f"s3a://{bucket}/{path}", **options)


def AzureFileSink(account: str, container: str, path: str = "", **options: Any) -> FileSink:  # noqa: N802
    return FileSink(f"abfss://{container}@{account}.dfs.core.windows.net/{path}", **options)


class LakeSink(Sink):
    """Hive-partitioned Parquet: by columns, and by year, month, day, hour of the event time where asked for.

    Rows without a partition value go to Hive's null partition. ``table`` saves a catalog table.
    """

    TIMES = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}

    def __init__(self, path: str, partition_by: list[str], table: str | None = None):
        self.path, self.partition_by, self.table = path, partition_by, table

    def write(self, df: DataFrame, batch_id: int) -> None:
        at = F.timestamp_millis(TIME)
        parts = {c: F.date_format(at, self.TIMES[c]) for c in self.partition_by if c in self.TIMES and c not in df.columns}
        # rows of a folder meet before they are written: a few files for each folder, not one for each task
        out = df.drop(HEADERS).withColumns(parts).repartition(*self.partition_by) if self.partition_by else df.drop(HEADERS)
        writer = out.write.mode("append").partitionBy(*self.partition_by)
        writer.option("path", self.path).saveAsTable(self.table) if self.table else writer.parquet(self.path)


class KafkaSink(Sink):
    """Records to a broker's topic, or to that of a ``_topic`` column (needs the Kafka package of Spark)."""

    def __init__(self, servers: str, topic: str | None = None, value_format: str = "json", key_format: str = "bytes", **options: str):
        self.options = {"kafka.bootstrap.servers": servers} | ({"topic": topic} if topic else {}) | options
        self.value_format, self.key_format = value_format, key_format

    def rows(self, df: DataFrame) -> DataFrame:
        key, value = to_bytes(F.col(KEY), self.key_format), to_bytes(value_of(df), self.value_format)
        topic = [F.col("_topic").alias("topic")] if "_topic" in df.columns else []
        return df.select(key.alias("key"), value.alias("value"), F.col(HEADERS).alias("headers"), *topic)

    def write(self, df: DataFrame, batch_id: int) -> None:
        self.rows(df).write.format("kafka").options(**self.options).save()


class TableSink(Sink):
    """Rows appended through a connector: Iceberg, BigQuery, MongoDB, Elasticsearch, Delta, whose package Spark has.

    A schema that grows is the connector's option (``mergeSchema``); a commit conflict fails the batch, which comes
    again.
    """

    def __init__(self, form: str, **options: str):
        self.form, self.options = form, options

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.format(self.form).options(**self.options).mode("append").save()


class IcebergSink(Sink):
    """Append to an Iceberg table, made at first by identity of the key and day of the time; new columns are merged."""

    def __init__(self, table: str):
        self.table = table

    def write(self, df: DataFrame, batch_id: int) -> None:
        out = df.withColumn(TIME, F.timestamp_millis(TIME))
        if df.sparkSession.catalog.tableExists(self.table):
            out.writeTo(self.table).option("mergeSchema", "true").append()
        else:
            out.writeTo(self.table).using("iceberg").partitionedBy(F.col(KEY), F.days(TIME)).create()


def BigQuerySink(table: str, **options: str) -> TableSink:  # noqa: N802
    return TableSink("bigquery", table=table, allowFieldAddition="true", **options)


class ClientSink(Sink):
    """Base of sinks over a client library: each partition opens a client and sends requests of up to ``size`` rows.

    ``connect`` makes the client on the executor (so credentials and libraries are needed there only); ``requests``
    turns rows into what is sent, ``send`` sends one. Delivery is at least once, as a failed batch is sent again.
    """

    size = 500

    def __init__(self, connect: Callable[[], Any]):
        self.connect = connect

    def requests(self, rows: list[dict]) -> Iterable[Any]:
        raise NotImplementedError

    def send(self, client: Any, request: Any) -> None:
        raise NotImplementedError

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.foreachPartition(self.partition)

    def partition(self, rows: Iterator[Any]) -> None:
        client, held = None, []

        def flush() -> None:
            nonlocal client
            if held:
                client = client if client is not None else self.connect()
                for request in self.requests(held):
                    self.send(client, request)
                held.clear()

        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= self.size:
                flush()
        flush()
        if client is not None and hasattr(client, "close"):
            client.close()


def record(row: dict) -> dict:
    """The value of a row: its columns but for the reserved ones."""
    return {k: v for k, v in row.items() if k not in (KEY, TIME, HEADERS, ORDER)}
