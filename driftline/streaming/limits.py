"""A bounded run of a frame, for tests and debugging: so many records, or until nothing comes any more."""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..frame import EventFrame


def run(frame: EventFrame, count: int, timeout: float, collect: bool, metadata: bool, checkpoint: str | None) -> list[dict]:
    if count < 0 or timeout < 0:
        raise ValueError("limits are not negative")
    names = frame.df.columns if metadata else frame.value_columns
    if not frame.df.isStreaming:
        df = frame.df.select(*names)
        rows = (df.limit(count) if count else df).collect() if collect else []
        return [r.asDict(recursive=True) for r in rows]
    out: list[dict] = []
    seen, last = 0, time.monotonic()

    def batch(df: DataFrame, batch_id: int) -> None:
        nonlocal seen, last
        rows = df.select(*names)
        if count:
            rows = rows.limit(count - seen) if count > seen else rows.limit(0)
        if collect:
            got = [r.asDict(recursive=True) for r in rows.collect()]
            out.extend(got)
            n = len(got)
        else:
            n = rows.count()
        seen += n
        if n:
            last = time.monotonic()

    writer = frame.df.writeStream.foreachBatch(batch)
    if not count and not timeout:
        writer = writer.trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        while query.isActive:
            query.awaitTermination(0.1)
            if count and seen >= count or timeout and time.monotonic() - last >= timeout:
                break
    finally:
        query.stop()
    if e := query.exception():
        raise e
    return out
