"""Readers of files, tables, brokers and polled services. Each gives an ``EventFrame``, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..formats import BROKEN, SchemaRegistry, from_bytes, from_python, lenient, well_formed
from ..frame import HEADER_TYPE, EventFrame
from ..operators.windows import HEADERS, KEY, ORDER, TIME

Pick = str | Column | Callable[[DataFrame], Column] | None


def _pick(df: DataFrame, what: Pick) -> Column | None:
    return F.col(what) if isinstance(what, str) else what(df) if callable(what) else what


def _reader(spark: SparkSession, streaming: bool, schema: str | T.StructType | None, options: dict[str, Any]) -> Any:
    r = (spark.readStream if streaming else spark.read).options(**options)
    return r if schema is None else r.schema(schema)


def _frame(df: DataFrame, key: Pick, timestamp: Pick, offset: Pick = None, ordered: bool = False) -> EventFrame:
    time = _pick(df, timestamp)
    if time is None:
        time = F.unix_millis(F.current_timestamp())
    order = _pick(df, offset)
    if order is None and not df.isStreaming:
        order = F.monotonically_increasing_id()
    return EventFrame.of(df, _pick(df, key), time, order, ordered=ordered)


def csv(spark: SparkSession, path: str, key: Pick = None, timestamp: Pick = None, streaming: bool = False, schema: str | None = None, **options: Any) -> EventFrame:
    """Rows of CSV files with a header; every value is a string (give ``schema`` for a stream)."""
    return _frame(_reader(spark, streaming, schema, {"header": True} | options).csv(path), key, timestamp)


def files(spark: SparkSession, path: str, form: str = "json", key: Pick = "_key", timestamp: Pick = "_timestamp", value: str | None = "_value", partition_folders: bool = False, streaming: bool = False, schema: str | T.StructType | None = None, **options: Any) -> EventFrame:
    """Recorded files (JSON lines or Parquet, compressed or not), as the file sinks write them.

    ``value`` names the column that holds the record (None: the other columns are it). Paths of object stores
    (s3a://, abfss://) read alike. Folders below the path are read; with ``partition_folders`` their names are
    columns. The pace of a replay is set by ``maxFilesPerTrigger`` and the query's trigger.
    """
    if form not in ("json", "parquet"):
        raise ValueError("files are json or parquet")
    base = {} if partition_folders else {"recursiveFileLookup": True}
    df = _reader(spark, streaming, schema, base | options).format(form).load(path)
    if value and value in df.columns:
        kind = df.schema[value].dataType
        others = [c for c in df.columns if c != value]
        df = df.select(*others, f"{value}.*") if isinstance(kind, T.StructType) else df.withColumnRenamed(value, "value")
    drop = [c for c in (key, timestamp) if isinstance(c, str) and c not in (KEY, TIME)]
    frame = _frame(df, key, timestamp)
    frame.df = frame.df.drop(*drop)
    return frame


def local_files(spark: SparkSession, path: str, **options: Any) -> EventFrame:
    return files(spark, path, **options)


def s3_files(spark: SparkSession, bucket: str, path: str = "", **options: Any) -> EventFrame:
    return files(spark, f"s3a://{bucket}/{path}", **options)


def azure_files(spark: SparkSession, account: str, container: str, path: str = "", **options: Any) -> EventFrame:
    return files(spark, f"abfss://{container}@{account}.dfs.core.windows.net/{path}", **options)


def pandas(spark: SparkSession, pdf: pd.DataFrame, key_column: str, timestamp_column: str, keep_meta_as_values: bool = True) -> EventFrame:
    """Rows of a pandas frame: the key a string column, the timestamp an integer one (ms)."""
    if not pd.api.types.is_string_dtype(pdf[key_column]):
        raise ValueError(f"{key_column} is not a string column")
    if not pd.api.types.is_integer_dtype(pdf[timestamp_column]):
        raise ValueError(f"{timestamp_column} is not an integer column")
    df = spark.createDataFrame(pdf.assign(**{ORDER: range(len(pdf))}))
    frame = EventFrame.of(df, key_column, timestamp_column, ORDER)
    if not keep_meta_as_values:
        frame.df = frame.df.drop(key_column, timestamp_column)
    return frame


@dataclass
class Topic:
    """A topic's formats: how bytes become value and key, and where event time is.

    ``value_format`` may be a Python function of bytes, with ``schema`` as its type; records for which it raises
    ``IgnoreMessage`` are left out. ``on_error`` says what becomes of records that cannot be read: "raise", or "skip"
    (JSON with a schema and Python functions), or a function of exception and bytes that answers true to skip
    (Python functions). With ``registry``, values have its envelope.
    """

    name: str
    value_format: str | Callable[[bytes], Any] = "json"
    key_format: str = "bytes"
    schema: str | None = None
    timestamp: Callable[[Column], Column] | None = None
    options: dict[str, str] = field(default_factory=dict)
    on_error: str | Callable[[Exception, bytes], bool] = "raise"
    registry: SchemaRegistry | None = None

    def decode(self, df: DataFrame) -> EventFrame:
        """A frame of rows with the columns of a Kafka read: key, value, topic, partition, offset, timestamp, headers."""
        if callable(self.value_format):
            value = from_python(F.col("value"), self.value_format, self.schema, self.on_error)
        elif self.registry is not None:
            value = self.registry.decode(F.col("value"), f"{self.name}-value", self.value_format, self.schema)
        elif self.on_error == "skip" and self.value_format == "json" and self.schema:
            value = lenient(F.col("value"), self.schema)
        else:
            value = from_bytes(F.col("value"), self.value_format, self.schema, **self.options)
        key = from_bytes(F.col("key"), self.key_format)
        headers = F.col("headers").cast(HEADER_TYPE) if "headers" in df.columns else F.lit(None).cast(HEADER_TYPE)
        out = df.select(value.alias("value"), key.alias(KEY), F.unix_millis("timestamp").alias(TIME), headers.alias(HEADERS), F.col("offset").cast("long").alias(ORDER))
        if callable(self.value_format):
            out = out.where(F.col("value.kept")).withColumn("value", F.col("value.value"))
        elif self.on_error == "skip" and self.value_format == "json" and self.schema:
            out = out.where(well_formed(F.col("value")))
        if self.timestamp is not None:
            out = out.withColumn(TIME, self.timestamp(F.col("value")).cast("long"))
        kind = out.schema["value"].dataType
        if isinstance(kind, T.StructType):
            out = out.select("value.*", KEY, TIME, HEADERS, ORDER).drop(BROKEN)
        return EventFrame(out)


def kafka(spark: SparkSession, servers: str, topic: Topic, streaming: bool = True, **options: str) -> EventFrame:
    """A topic's records (needs the Kafka package of Spark)."""
    base = {"kafka.bootstrap.servers": servers, "subscribe": topic.name, "includeHeaders": "true"}
    return topic.decode(_reader(spark, streaming, None, base | options).format("kafka").load())


class PolledSource(DataSource):
    """A Python data source over a client: ``slices`` says what there is to read, ``rows`` reads one slice.

    Options: ``client`` is "module:function", a factory of an object with ``schema() -> str``, ``slices(None) ->
    (list[dict], at)`` and ``rows(slice: dict) -> iterator of tuples``. A batch read makes a task of each slice (a time
    range of a measurement, a shard, a subscription's batch). For a stream the object also has ``latest() -> at``, a
    plain value up to which there is something to read, and ``between(start, end) -> list[dict]``, the slices after
    ``start`` (None: from the beginning) up to ``end``, the same ones whenever it is asked again; ``commit(at)``, if
    there, is called when Spark's checkpoint has a batch. Slices are read by tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "driftline_polled"

    def _client(self) -> Any:
        import importlib

        module, _, factory = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), factory)(dict(self.options))

    def schema(self) -> str:
        return self._client().schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Slices(self._client)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self._client)


class _Slice(InputPartition):
    def __init__(self, what: dict):
        self.what = what


class _Slices(DataSourceReader):
    def __init__(self, client: Callable[[], Any]):
        self.client = client

    def partitions(self) -> list[InputPartition]:
        return [_Slice(s) for s in self.client().slices(None)[0]]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.client().rows(partition.what)


class _Stream(DataSourceStreamReader):
    def __init__(self, client: Callable[[], Any]):
        self.client = client

    def initialOffset(self) -> dict:
        return {"at": None}

    def latestOffset(self) -> dict:
        return {"at": self.client().latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Slice(s) for s in self.client().between(start["at"], end["at"])] if end["at"] is not None else []

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.client().rows(partition.what)

    def commit(self, end: dict) -> None:
        client = self.client()
        if hasattr(client, "commit"):
            client.commit(end["at"])


def polled(spark: SparkSession, client: str, key: Pick = None, timestamp: Pick = None, streaming: bool = False, **options: str) -> EventFrame:
    """A frame over a client module (time series databases, shard streams, message queues); see ``PolledSource``."""
    spark.dataSource.register(PolledSource)
    reader = (spark.readStream if streaming else spark.read).format("driftline_polled").options(client=client, **options)
    return _frame(reader.load(), key, timestamp)
