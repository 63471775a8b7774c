"""Greedy throttling of progress values per key, in batch or as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last long"


def forwarded(times: np.ndarray, last: int | None, interval_us: int) -> tuple[np.ndarray, int | None]:
    """The places of the ordered times (microseconds) that pass: the first, and each that is an interval after the last that did."""
    found, at = [], 0 if last is None else int(np.searchsorted(times, last + interval_us))
    while at < len(times):
        found.append(at)
        last = int(times[at])
        at += int(np.searchsorted(times[at:], last + interval_us))
    return np.array(found, np.int64), last


def throttle(events: DataFrame, interval_us: int) -> DataFrame:
    """The rows of events (key, ts, seq) that pass, per key in order of ts and seq. A key's rows are streamed in one task, in the order
    of their sort: whether one passes rests on the one that passed before. The interval is at least 1."""
    rows = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("key").sortWithinPartitions("key", "us", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, begun = None, None, False
        for batch in batches:
            codes = batch.column("key").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            times = batch.column("us").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            keep = []
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                now = batch.column("key")[start].as_py()
                if not begun or now != key:
                    key, last, begun = now, None, True
                found, last = forwarded(times[start:end], last, interval_us)
                keep.append(found + start)
            yield batch.take(pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64)))

    return rows.mapInArrow(run, rows.schema).drop("us")


def throttle_stream(events: DataFrame, interval_us: int) -> DataFrame:
    """The same for a stream with columns key, ts, seq: one long of state a key."""
    rows = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(batches)).sort_values(["us", "seq"])
        keep, last = forwarded(batch["us"].to_numpy(), last, interval_us)
        state.update((last,))
        yield batch.iloc[keep]

    return rows.groupBy("key").applyInPandasWithState(run, rows.schema, STATE, "append", GroupStateTimeout.NoTimeout).drop("us")
