"""Clients for ``PolledSource``: a slice is a plain dict, so it travels to a task; libraries are imported there."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator
from typing import Any


class TimeSlices:
    """Base of clients of time series databases: a slice for each measurement and stretch of time."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.measurements = options["measurements"].split(",")
        self.start, self.end, self.step = (int(options[k]) for k in ("start_ms", "end_ms", "step_ms"))

    def schema(self) -> str:
        return self.options.get("schema", "measurement string, time bigint, fields string")

    def slices(self, since: Any) -> tuple[list[dict], Any]:
        return self.between(since, self.end), self.end

    def latest(self) -> int:
        """Steps that are over, up to the end."""
        now = min(self.end, int(time.time() * 1000))
        return max(self.start, now if now == self.end else now - (now - self.start) % self.step)

    def between(self, start: int | None, end: int) -> list[dict]:
        at = self.start if start is None else start
        return [{"measurement": m, "start": t, "end": min(end, t + self.step)} for t in range(at, end, self.step) for m in self.measurements]

    def rows(self, part: dict) -> Iterator[tuple]:
        for at, fields in self.query(part["measurement"], part["start"], part["end"]):
            yield part["measurement"], at, json.dumps(fields)

    def query(self, measurement: str, start: int, end: int) -> Iterator[tuple[int, dict]]:
        raise NotImplementedError


class InfluxDB3(TimeSlices):
    """SQL by time slice through influxdb_client_3 (imported where it runs)."""

    def query(self, measurement: str, start: int, end: int) -> Iterator[tuple[int, dict]]:
        from influxdb_client_3 import InfluxDBClient3

        client = InfluxDBClient3(host=self.options["host"], token=self.options["token"], database=self.options["database"])
        sql = f'SELECT * FROM "{measurement}" WHERE time >= {start * 1_000_000} AND time < {end * 1_000_000}'
        for row in client.query(sql).to_pylist():
            at = row.pop("time")
            yield int(at.timestamp() * 1000), row


class Kinesis:
    """A slice for each shard and stretch of arrival time, so that a slice read again is the same.

    A slice ends before the first record that arrived at its end or later, where the next one begins. Records of the
    last ``delay_ms`` wait, as arrival times are approximate.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def schema(self) -> str:
        return "shard string, sequence string, key string, data binary, time bigint"

    def _boto(self) -> Any:
        import boto3

        return boto3.client("kinesis", region_name=self.options.get("region"))

    def slices(self, since: Any) -> tuple[list[dict], Any]:
        at = self.latest()
        return self.between(since, at), at

    def latest(self) -> int:
        return int(time.time() * 1000) - int(self.options.get("delay_ms", 5000))

    def between(self, start: int | None, end: int) -> list[dict]:
        shards = self._boto().list_shards(StreamName=self.options["stream"])["Shards"]
        return [{"shard": s["ShardId"], "start": start, "end": end} for s in shards]

    def rows(self, part: dict) -> Iterator[tuple]:
        client = self._boto()
        start = {"ShardIteratorType": "TRIM_HORIZON"} if part["start"] is None else {"ShardIteratorType": "AT_TIMESTAMP", "Timestamp": part["start"] / 1000}
        at = client.get_shard_iterator(StreamName=self.options["stream"], ShardId=part["shard"], **start)["ShardIterator"]
        while at:
            got = client.get_records(ShardIterator=at)
            for r in got["Records"]:
                arrived = int(r["ApproximateArrivalTimestamp"].timestamp() * 1000)
                if arrived >= part["end"]:
                    return
                yield part["shard"], r["SequenceNumber"], r["PartitionKey"], r["Data"], arrived
            if not got["Records"] and not got.get("MillisBehindLatest"):
                return
            at = got.get("NextShardIterator")


class Buffered:
    """Base of clients of queues that hand a message out once.

    A batch of up to ``max_messages`` is pulled, written to a file in the folder ``spool`` (shared by the cluster), and
    only then acknowledged; tasks read the file, as often as Spark asks for the batch, and it is deleted when the
    checkpoint has the batch. So delivery is at least once.
    """

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        if "spool" not in options:
            raise ValueError("spool, a folder that the cluster shares, is needed")
        self.options = options
        self.fs, self.path = fs.FileSystem.from_uri(options["spool"])
        self.fs.create_dir(self.path, recursive=True)

    def schema(self) -> str:
        return "key string, data binary, time bigint"

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.path))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _write(self, name: str, text: str) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}.part") as f:
            f.write(text.encode())
        self.fs.move(f"{self.path}/{name}.part", f"{self.path}/{name}")

    def _done(self) -> int:
        """The last batch that was committed."""
        try:
            with self.fs.open_input_stream(f"{self.path}/done") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def slices(self, since: Any) -> tuple[list[dict], Any]:
        at = self.latest()
        return self.between(since, at), at

    def latest(self) -> int:
        last = max([self._done(), *self._numbers()])
        at = max(last + 1, int(time.time() * 1000))
        wrote = False

        def keep(rows: list[tuple[str, bytes, int]]) -> None:
            nonlocal wrote
            if rows:
                self._write(f"{at:020d}.json", json.dumps([(k, base64.b64encode(d).decode(), t) for k, d, t in rows]))
                wrote = True

        self.pull(int(self.options.get("max_messages", 1000)), float(self.options.get("timeout_s", 5)), keep)
        return at if wrote else last

    def between(self, start: int | None, end: int) -> list[dict]:
        return [{"batch": n} for n in self._numbers() if (start or 0) < n <= end]

    def rows(self, part: dict) -> Iterator[tuple]:
        with self.fs.open_input_stream(f"{self.path}/{part['batch']:020d}.json") as f:
            for key, data, at in json.loads(f.read()):
                yield key, base64.b64decode(data), at

    def commit(self, at: int | None) -> None:
        for n in self._numbers():
            if at is not None and n <= at:
                self._write("done", str(n))
                self.fs.delete_file(f"{self.path}/{n:020d}.json")

    def pull(self, most: int, timeout: float, keep: Callable[[list[tuple[str, bytes, int]]], None]) -> None:
        """Gets messages, hands (key, data, time) over to ``keep``, and acknowledges them when it has returned."""
        raise NotImplementedError


class PubSub(Buffered):
    """Pulls of a subscription through google-cloud-pubsub."""

    def pull(self, most: int, timeout: float, keep: Callable[[list[tuple[str, bytes, int]]], None]) -> None:
        from google.cloud import pubsub_v1

        client = pubsub_v1.SubscriberClient()
        path = client.subscription_path(self.options["project"], self.options["subscription"])
        got = client.pull(subscription=path, max_messages=most, timeout=timeout).received_messages
        keep([(m.message.ordering_key, m.message.data, int(m.message.publish_time.timestamp() * 1000)) for m in got])
        if got:
            client.acknowledge(subscription=path, ack_ids=[m.ack_id for m in got])


class MQTT(Buffered):
    """Messages of a topic filter through paho-mqtt, in a lasting session of ``client_id``."""

    def pull(self, most: int, timeout: float, keep: Callable[[list[tuple[str, bytes, int]]], None]) -> None:
        import queue

        import paho.mqtt.client as mqtt

        inbox: queue.Queue = queue.Queue()
        client = mqtt.Client(client_id=self.options.get("client_id", "driftline"), clean_session=False, manual_ack=True)
        client.on_message = lambda c, u, m: inbox.put((m.topic, m.payload, int(time.time() * 1000), m.mid, m.qos))
        client.connect(self.options["host"], int(self.options.get("port", 1883)))
        client.subscribe(self.options["topic"], qos=1)
        client.loop_start()
        end, got = time.monotonic() + timeout, []
        try:
            while len(got) < most and (left := end - time.monotonic()) > 0:
                try:
                    got.append(inbox.get(timeout=left))
                except queue.Empty:
                    break
            keep([m[:3] for m in got])
            for _, _, _, mid, qos in got:
                client.ack(mid, qos)
        finally:
            client.loop_stop()
            client.disconnect()
