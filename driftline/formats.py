"""Wire formats as columns: bytes to value and back. Names as in topics: json, bytes, string, integer, double, ..."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from .errors import IgnoreMessage, InvalidOperation

#: Fields of the time series envelope.
TIMESTAMPS, NUMBERS, STRINGS, BINARIES, TAGS = "Timestamps", "NumericValues", "StringValues", "BinaryValues", "TagValues"


def from_bytes(c: Column, form: str, schema: str | None = None, charset: str = "UTF-8", **options: str) -> Column:
    """Value of a binary column. json without ``schema`` is a variant; malformed input raises (see ``lenient``)."""
    if form == "bytes":
        return c
    if form == "string":
        return F.decode(c, charset)
    if form == "integer":
        raw = F.conv(F.hex(c), 16, 10).cast("long")
        return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")
    if form == "double":
        return F.pandas_udf(_unpack, "double")(c)
    if form == "json":
        text = F.decode(c, "UTF-8")
        return F.parse_json(text) if schema is None else F.from_json(text, schema, {"mode": "FAILFAST"} | options)
    if form == "avro":
        from pyspark.sql.avro.functions import from_avro  # needs the spark-avro package

        return from_avro(c, schema, options)
    if form == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf  # needs the spark-protobuf package

        return from_protobuf(c, options["message"], binaryDescriptorSet=options["descriptor"])
    raise InvalidOperation(f"no format {form}")


BROKEN = "_broken"


def lenient(c: Column, schema: str) -> Column:
    """JSON where malformed input gives a struct of nulls, and its text in the field ``_broken`` (else null)."""
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(BROKEN, T.StringType())])
    return F.from_json(F.decode(c, "UTF-8"), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def well_formed(value: Column) -> Column:
    return value[BROKEN].isNull()


def from_python(c: Column, f: Callable[[bytes], Any], schema: str, on_error: str | Callable[[Exception, bytes], bool] = "raise") -> Column:
    """A Python deserializer in Arrow batches: a struct of ``kept`` and ``value``; see ``sources.readers.Topic``."""
    kind = T._parse_datatype_string(schema)
    out_type = T.StructType([T.StructField("kept", T.BooleanType()), T.StructField("value", kind)])

    def run(data):  # noqa: ANN001, ANN202
        rows = []
        for raw in data.tolist():
            try:
                rows.append((True, f(raw)))
            except IgnoreMessage:
                rows.append((False, None))
            except Exception as e:
                if not (on_error == "skip" or callable(on_error) and on_error(e, raw)):
                    raise
                rows.append((False, None))
        return pd.DataFrame(rows, columns=["kept", "value"])

    return F.pandas_udf(run, out_type, PandasUDFType.SCALAR)(c)


class SchemaRegistry:
    """A schema registry's envelope: a zero byte, the schema's number in four bytes, and the data.

    Schemas are looked up by subject when the plan is made, through ``ask`` (method, path, body) -> answer, which by
    default speaks HTTP to ``url``. Forms are JSON and Avro (which needs Spark's package).
    """

    def __init__(self, url: str, user: str | None = None, password: str | None = None, ask: Callable[[str, str, Any], Any] | None = None):
        self.url, self.user, self.password = url.rstrip("/"), user, password
        self.ask = ask or self._http

    def _http(self, method: str, path: str, body: Any) -> Any:
        import base64
        import urllib.request

        headers = {"Content-Type": "application/vnd.schemaregistry.v1+json"}
        if self.user:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        request = urllib.request.Request(self.url + path, None if body is None else json.dumps(body).encode(), headers, method=method)
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.loads(answer.read())

    def latest(self, subject: str) -> tuple[int, str]:
        """Number and text of a subject's newest schema."""
        got = self.ask("GET", f"/subjects/{subject}/versions/latest", None)
        return int(got["id"]), got["schema"]

    def register(self, subject: str, schema: str, form: str) -> int:
        return int(self.ask("POST", f"/subjects/{subject}/versions", {"schema": schema, "schemaType": form.upper()})["id"])

    def decode(self, c: Column, subject: str, form: str, schema: str | None = None) -> Column:
        """``schema`` is the columns' type for JSON (none: a variant). Bytes without the envelope raise."""
        marked = F.when(F.hex(F.substring(c, 1, 1)) == "00", F.substring(c, 6, 1 << 30)).otherwise(F.raise_error(F.lit("no schema envelope")).cast("binary"))
        data = F.when(c.isNotNull(), marked)
        if form == "json":
            return from_bytes(data, "json", schema)
        if form == "avro":
            return from_bytes(data, "avro", self.latest(subject)[1])
        raise InvalidOperation(f"no registry format {form}")

    def encode(self, c: Column, subject: str, form: str, schema: str) -> Column:
        number = self.register(subject, schema, form)
        head = F.unhex(F.lit(f"00{number:08x}"))
        return F.concat(head, to_bytes(c, form, **({"schema": schema} if form == "avro" else {})))


def to_bytes(c: Column, form: str, charset: str = "UTF-8", **options: str) -> Column:
    if form == "bytes":
        return c.cast("binary")
    if form == "string":
        return F.encode(c.cast("string"), charset)
    if form == "integer":
        return F.unhex(F.lpad(F.hex(c.cast("int").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    if form == "double":
        return F.pandas_udf(_pack, "binary")(c.cast("double"))
    if form == "json":
        return F.encode(F.to_json(c), "UTF-8")
    if form == "avro":
        from pyspark.sql.avro.functions import to_avro

        return to_avro(c, options.get("schema", ""))
    if form == "protobuf":
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(c, options["message"], binaryDescriptorSet=options["descriptor"])
    raise InvalidOperation(f"no format {form}")


def _unpack(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else struct.unpack(">d", b)[0])


def _pack(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None or x != x else struct.pack(">d", x))


def timeseries_rows(df: DataFrame, column: str, numbers: list[str] = (), strings: list[str] = (), binaries: list[str] = (), tags: list[str] = ()) -> DataFrame:
    """Rows of a column-wise time series envelope (JSON text): a row for each timestamp, with a ``Tags`` struct."""
    if "Timestamp" in {*numbers, *strings, *binaries}:
        raise InvalidOperation("Timestamp is the envelope's own name")
    lists = lambda names, kind: f"struct<{','.join(f'`{n}`:array<{kind}>' for n in names)}>"
    parts = [f"{TIMESTAMPS}:array<bigint>"]
    groups = ((NUMBERS, numbers, "double"), (STRINGS, strings, "string"), (BINARIES, binaries, "string"), (TAGS, tags, "string"))
    parts += [f"{g}:{lists(names, kind)}" for g, names, kind in groups if names]
    read = df.withColumn("e__", F.from_json(column, f"struct<{','.join(parts)}>", {"mode": "FAILFAST"}))
    opened = read.select("*", F.posexplode(f"e__.{TIMESTAMPS}").alias("i__", "Timestamp"))
    item = lambda g, n: F.get(F.col("e__")[g][n], F.col("i__"))
    out = opened.withColumns({n: item(NUMBERS, n) for n in numbers} | {n: item(STRINGS, n) for n in strings} | {n: F.unbase64(item(BINARIES, n)) for n in binaries})
    if tags:
        out = out.withColumn("Tags", F.struct(*[item(TAGS, n).alias(n) for n in tags]))
    return out.drop("e__", "i__")


def timeseries_json(time: Column, numbers: dict[str, Column] = {}, strings: dict[str, Column] = {}, tags: dict[str, Column] = {}) -> Column:  # noqa: B006
    """One record as an envelope of lists of one."""
    group = lambda cs: F.struct(*[F.array(c).alias(n) for n, c in cs.items()])
    parts = [F.array(time).alias(TIMESTAMPS)]
    parts += [group(cs).alias(g) for g, cs in ((NUMBERS, numbers), (STRINGS, strings), (TAGS, tags)) if cs]
    return F.to_json(F.struct(*parts))


EVENT = "struct<Timestamp:bigint,Id:string,Value:string,Tags:map<string,string>>"


def event_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of an event envelope (JSON text): one event, or a list of them."""
    text = F.when(F.ltrim(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    return df.withColumn("e__", F.explode(F.from_json(text, f"array<{EVENT}>", {"mode": "FAILFAST"}))).select("*", "e__.*").drop("e__")


def event_json(time: Column, id_: Column, value: Column, tags: Column | None = None) -> Column:
    return F.to_json(F.struct(time.alias("Timestamp"), id_.alias("Id"), value.cast("string").alias("Value"), (F.create_map() if tags is None else tags).alias("Tags")))


def split_values(df: DataFrame, column: str) -> DataFrame:
    """One record for each item of a list value; a list of nothing gives none."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise InvalidOperation(f"{column} is no list")
    return df.withColumn(column, F.explode(column))
