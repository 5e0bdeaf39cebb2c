"""Sinks over client libraries. What each sends is a plain function of rows, so it is tested without the service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from ..operators.windows import KEY, TIME
from .writers import ClientSink, record


def _escape(text: Any, marks: str) -> str:
    out = str(text).replace("\\", "\\\\")
    for m in marks:
        out = out.replace(m, f"\\{m}")
    return out


def line_protocol(measurement: str, tags: dict[str, Any], fields: dict[str, Any], time: int | None, integers: bool = True) -> str | None:
    """One line; null tags and fields are left out, and a point without fields is none."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int) and integers:
            return f"{v}i"
        if isinstance(v, int | float):
            return repr(float(v))
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    shown = ",".join(f"{_escape(k, ',= ')}={value(v)}" for k, v in fields.items() if v is not None)
    if not shown:
        return None
    head = "".join([_escape(measurement, ", "), *(f",{_escape(k, ',= ')}={_escape(v, ',= ')}" for k, v in sorted(tags.items()) if v not in (None, ""))])
    return f"{head} {shown}" + ("" if time is None else f" {time}")


class LineSink(ClientSink):
    """Line protocol for time series databases: ``client.write(lines)`` with lines of one request joined."""

    def __init__(self, connect: Callable[[], Any], measurement: str | Callable[[dict], str], tags: list[str] = (), fields: list[str] | None = None, integers: bool = True, size: int = 1000):  # type: ignore[assignment]
        super().__init__(connect)
        self.measurement, self.tags, self.fields, self.integers, self.size = measurement, list(tags), fields, integers, size

    def requests(self, rows: list[dict]) -> Iterable[str]:
        lines = []
        for r in rows:
            value = record(r)
            name = self.measurement(value) if callable(self.measurement) else self.measurement
            fields = {k: value.get(k) for k in (self.fields or [k for k in value if k not in self.tags])}
            if line := line_protocol(name, {t: value.get(t) for t in self.tags}, fields, r[TIME], self.integers):
                lines.append(line)
        if lines:
            yield "\n".join(lines)

    def send(self, client: Any, request: str) -> None:
        client.write(request)


class InfluxDB3Sink(LineSink):
    """InfluxDB 3; the client has ``write(record)``."""


class InfluxDB1Sink(LineSink):
    """InfluxDB 1: lines by ``write_points`` in the line protocol."""

    def send(self, client: Any, request: str) -> None:
        client.write_points(request.split("\n"), protocol="line", time_precision="ms")


class TDengineSink(LineSink):
    """TDengine: schemaless lines; ``subtable`` names a row's subtable as a tag."""

    def __init__(self, connect: Callable[[], Any], supertable: str | Callable[[dict], str], subtable: Callable[[dict], str] | None = None, **options: Any):
        super().__init__(connect, supertable, **options)
        self.subtable = subtable

    def requests(self, rows: list[dict]) -> Iterable[str]:
        if self.subtable:
            rows = [r | {"__subtable": self.subtable(record(r))} for r in rows]
            self.tags = [*dict.fromkeys([*self.tags, "__subtable"])]
        yield from super().requests(rows)


_SQL = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE PRECISION", str: "TEXT", bytes: "BYTEA", list: "JSONB", dict: "JSONB"}


class PostgreSQLSink(ClientSink):
    """Rows to tables that are made and widened as needed; ``on_conflict`` is None, "nothing" or "update" of the keys."""

    def __init__(self, connect: Callable[[], Any], table: str | Callable[[dict], str], primary_key: list[str] = (), on_conflict: str | None = None):  # type: ignore[assignment]
        super().__init__(connect)
        if on_conflict not in (None, "nothing", "update") or (on_conflict == "update" and not primary_key):
            raise ValueError("on_conflict is None, nothing or update (with a primary key)")
        self.table, self.primary_key, self.on_conflict = table, list(primary_key), on_conflict

    def requests(self, rows: list[dict]) -> Iterable[tuple[str, list[tuple]]]:
        by_table: dict[str, list[dict]] = {}
        for r in rows:
            value = record(r) | {"timestamp": r[TIME], "__key": None if r[KEY] is None else str(r[KEY])}
            by_table.setdefault(self.table(value) if callable(self.table) else self.table, []).append(value)
        name = lambda c: '"' + c.replace('"', '""') + '"'
        for table, values in by_table.items():
            columns = list(dict.fromkeys(k for v in values for k in v))
            kinds = {c: next((_SQL[type(v[c])] for v in values if type(v.get(c)) in _SQL), "TEXT") for c in columns}
            key = f", PRIMARY KEY ({', '.join(map(name, self.primary_key))})" if self.primary_key else ""
            yield f"CREATE TABLE IF NOT EXISTS {name(table)} ({', '.join(f'{name(c)} {kinds[c]}' for c in columns)}{key})", []
            for c in columns:
                yield f"ALTER TABLE {name(table)} ADD COLUMN IF NOT EXISTS {name(c)} {kinds[c]}", []
            if self.on_conflict == "update":  # one row a key in a statement: the last one stands
                values = list({tuple(v.get(k) for k in self.primary_key): v for v in values}.values())
            sql = f"INSERT INTO {name(table)} ({', '.join(map(name, columns))}) VALUES ({', '.join(['%s'] * len(columns))})"
            if self.on_conflict == "nothing":
                sql += " ON CONFLICT DO NOTHING"
            elif self.on_conflict == "update":
                sql += f" ON CONFLICT ({', '.join(map(name, self.primary_key))}) DO UPDATE SET " + ", ".join(f"{name(c)} = EXCLUDED.{name(c)}" for c in columns if c not in self.primary_key)
            yield sql, [tuple(json.dumps(x) if isinstance(x, list | dict) else x for x in (v.get(c) for c in columns)) for v in values]

    def send(self, client: Any, request: tuple[str, list[tuple]]) -> None:
        sql, rows = request
        with client.cursor() as cursor:
            cursor.executemany(sql, rows) if rows else cursor.execute(sql)
        client.commit()


class MongoDBSink(ClientSink):
    """Upserts (``update_one``, ``update_many`` or ``replace_one``) by the document matcher; the client is a collection."""

    def __init__(self, connect: Callable[[], Any], match: Callable[[dict], dict] | None = None, method: str = "update_one", upsert: bool = True):
        super().__init__(connect)
        if method not in ("update_one", "update_many", "replace_one"):
            raise ValueError("methods are update_one, update_many and replace_one")
        self.match, self.method, self.upsert = match or (lambda r: {"_id": r[KEY]}), method, upsert

    def requests(self, rows: list[dict]) -> Iterable[tuple[dict, dict]]:
        for r in rows:
            yield self.match(r), record(r) if self.method == "replace_one" else {"$set": record(r)}

    def send(self, client: Any, request: tuple[dict, dict]) -> None:
        getattr(client, self.method)(*request, upsert=self.upsert)


class Neo4jSink(ClientSink):
    """A Cypher query for each chunk of rows: ``UNWIND $events AS event`` goes before it."""

    def __init__(self, connect: Callable[[], Any], cypher: str, size: int = 10_000):
        super().__init__(connect)
        self.cypher, self.size = cypher, size

    def requests(self, rows: list[dict]) -> Iterable[tuple[str, list[dict]]]:
        yield f"UNWIND $events AS event {self.cypher}", [{"key": r[KEY], "timestamp": r[TIME], "value": record(r)} for r in rows]

    def send(self, client: Any, request: tuple[str, list[dict]]) -> None:
        client.run(request[0], events=request[1])


class ElasticsearchSink(ClientSink):
    """The bulk API: an index or update action before each document, by key."""

    def __init__(self, connect: Callable[[], Any], index: str, upsert: bool = False):
        super().__init__(connect)
        self.index, self.upsert = index, upsert

    def requests(self, rows: list[dict]) -> Iterable[str]:
        out = []
        for r in rows:
            act = {"_index": self.index} | ({} if r[KEY] is None else {"_id": str(r[KEY])})
            out += [json.dumps({"update" if self.upsert else "index": act}), json.dumps({"doc": record(r), "doc_as_upsert": True} if self.upsert else record(r))]
        yield "\n".join(out) + "\n"

    def send(self, client: Any, request: str) -> None:
        client.bulk(body=request)


class RedisSink(ClientSink):
    """SET of key and JSON value in pipelines; of one key, the last of a request stands."""

    def __init__(self, connect: Callable[[], Any], key: Callable[[dict], str] | None = None):
        super().__init__(connect)
        self.key = key or (lambda r: str(r[KEY]))

    def requests(self, rows: list[dict]) -> Iterable[list[tuple[str, str]]]:
        yield [(self.key(r), json.dumps(record(r))) for r in rows]

    def send(self, client: Any, request: list[tuple[str, str]]) -> None:
        pipe = client.pipeline(transaction=False)
        for k, v in request:
            pipe.set(k, v)
        pipe.execute()


class KinesisSink(ClientSink):
    """``put_records`` of up to 500; records that the service refuses are sent again."""

    def __init__(self, connect: Callable[[], Any], stream: str):
        super().__init__(connect)
        self.stream = stream

    def requests(self, rows: list[dict]) -> Iterable[list[dict]]:
        yield [{"Data": json.dumps(record(r)).encode(), "PartitionKey": str(r[KEY])} for r in rows]

    def send(self, client: Any, request: list[dict]) -> None:
        for _ in range(10):
            got = client.put_records(StreamName=self.stream, Records=request)
            if not got.get("FailedRecordCount"):
                return
            request = [r for r, a in zip(request, got["Records"], strict=True) if "ErrorCode" in a]
        raise RuntimeError("the stream refuses records")


class PubSubSink(ClientSink):
    """``publish`` for each record, all waited for."""

    def __init__(self, connect: Callable[[], Any], topic: str):
        super().__init__(connect)
        self.topic = topic

    def requests(self, rows: list[dict]) -> Iterable[list[tuple[bytes, str]]]:
        yield [(json.dumps(record(r)).encode(), "" if r[KEY] is None else str(r[KEY])) for r in rows]

    def send(self, client: Any, request: list[tuple[bytes, str]]) -> None:
        for sent in [client.publish(self.topic, data, ordering_key=key) for data, key in request]:
            sent.result()


class MQTTSink(ClientSink):
    """``publish`` at quality of service 1 for each record, all waited for; the topic may be a function of the row."""

    def __init__(self, connect: Callable[[], Any], topic: str | Callable[[dict], str]):
        super().__init__(connect)
        self.topic = topic

    def requests(self, rows: list[dict]) -> Iterable[list[tuple[str, str]]]:
        yield [(self.topic(r) if callable(self.topic) else self.topic, json.dumps(record(r))) for r in rows]

    def send(self, client: Any, request: list[tuple[str, str]]) -> None:
        for sent in [client.publish(topic, data, qos=1) for topic, data in request]:
            sent.wait_for_publish()
