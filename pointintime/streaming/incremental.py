"""Incremental runs: micro-batches appended exactly once, and stateful limits over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bitemporal import latest
from ..sources.store import Store
from ..vocabulary import RATE_LIMIT, RATE_WINDOW_SECONDS


def new_rows(batch: DataFrame, store: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of a batch that aren't stored yet, one a natural key: a batch that is run again adds nothing."""
    once = batch.dropDuplicates(keys)
    return once if store is None else once.join(store.select(*keys), keys, "left_anti")


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str], buckets: int = 16):
    """Works off what has arrived and stops: ``work`` on each micro-batch, new rows appended to the table ``rows`` of the store at
    ``path``.

    A batch reads the keys of the buckets that its rows can be in, not those of the whole table, and is committed with its number: run
    again under its checkpoint it is known and does nothing, and under a new one its keys are known.
    """
    store = Store(stream.sparkSession, path, buckets)

    def each(batch: DataFrame, number: int) -> None:
        if store.manifest()["done"].get(checkpoint, -1) >= number:
            return
        rows = work(batch).persist()
        try:
            touched = store.touched(rows, keys)
            if touched:
                store.commit({"rows": ("append", new_rows(rows, store.read("rows", touched), keys), keys, None)}, checkpoint, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "source_id", tie: str = "id", buckets: int = 16):
    """Keeps the table ``latest`` of the store at ``path``: the newest row of each key (by knowledge_time, then the larger ``tie``) of all
    that arrived, in whatever order. A batch reads and replaces only the buckets of its keys; a late row changes nothing, and a batch
    that is run again gives what it gave."""
    store = Store(stream.sparkSession, path, buckets)

    def each(batch: DataFrame, number: int) -> None:
        touched = store.touched(batch, [key])
        if touched:
            known = store.read("latest", touched)
            rows = latest(batch if known is None else known.unionByName(batch), key, tie)
            store.commit({"latest": ("replace", rows, [key], touched)}, checkpoint, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(requests: DataFrame, window: int = RATE_WINDOW_SECONDS, most: int = RATE_LIMIT, late: str = "1 hour") -> DataFrame:
    """caller, ts, rejected for a stream of requests: the state of a caller is the start of its window and a count. Of a
    micro-batch only its times are held, and windows are found by binary search.

    A timer ends a caller's window: when the stream's time, ``late`` behind the newest request, has passed it, the state goes, so
    that what is kept are the callers of the last while and not all there ever were. Requests later than ``late`` aren't answered.
    """
    span = int(window * 1_000_000)

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64") for pdf in batches]))
        count, a = np.zeros(len(times), np.int64), 0
        while a < len(times):
            if start is None or times[a] - start >= span:
                start, n = int(times[a]), 0
            end = a + int(np.searchsorted(times[a:], start + span))
            count[a:end] = n + 1 + np.arange(end - a)
            n, a = n + end - a, end
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"caller": key[0], "ts": pd.to_datetime(times, unit="us"), "rejected": count > most})

    kind = requests.schema["caller"].dataType.simpleString()
    timed = requests.withWatermark("ts", late)
    return timed.groupBy("caller").applyInPandasWithState(each, f"caller {kind}, ts timestamp, rejected boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def late(documents: DataFrame) -> DataFrame:
    """Rows that became known after they were published: kept, and hidden only from earlier cut-offs."""
    return documents.where(F.col("published_time") < F.col("knowledge_time"))
