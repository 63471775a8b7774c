"""Debounce per key: a value passes once nothing has followed it for an interval; an empty value passes at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "us long, seq long, value string"
RESULT = "key {key}, seq long, value string, fired timestamp"


def debounce(events: DataFrame, interval_us: int) -> DataFrame:
    """key, seq, value, fired of the rows of events (key, ts, seq, value) that pass, in the order of ts and seq: those that no row of
    their key follows within the interval, at its end, and those without a value (null or empty) at their own time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), F.coalesce("value", F.lit("")).alias("value"), us.alias("us"))
    # The next row alone decides, so a key's rows are streamed through a window.
    after = F.lead("us").over(W.partitionBy("key").orderBy("us", "seq"))
    kept = rows.withColumn("after", after).filter((F.col("value") == "") | F.col("after").isNull() | (F.col("after") - F.col("us") >= interval_us))
    return kept.select("key", "seq", "value", F.timestamp_micros(F.col("us") + F.when(F.col("value") == "", 0).otherwise(interval_us)).alias("fired"))


def debounce_stream(events: DataFrame, interval_us: int, delay: str = "0 seconds") -> DataFrame:
    """The same for a stream whose batches follow each other in time but for `delay`: the last value of a key waits as its state, and a timer
    of event time lets it pass when the watermark is an interval after it."""
    kind = events.schema["key"].dataType.simpleString()
    watched = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = watched.select("key", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.coalesce("value", F.lit("")).alias("value"))

    def fired(key, found: list[tuple[int, int, str]]) -> pd.DataFrame:
        at = [us + (interval_us if value else 0) for us, _, value in found]
        return pd.DataFrame({"key": [key[0]] * len(found), "seq": [s for _, s, _ in found], "value": [v for *_, v in found], "fired": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us")})

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            waiting = state.get
            state.remove()
            yield fired(key, [tuple(waiting)])
            return
        batch = pd.concat(list(batches)).sort_values(["us", "seq"])
        rows_ = [tuple(state.get)] if state.exists else []
        rows_ += list(zip(batch["us"].tolist(), batch["seq"].tolist(), batch["value"].tolist(), strict=True))
        found = [row for row, after in zip(rows_, rows_[1:], strict=False) if row[2] == "" or after[0] - row[0] >= interval_us]
        last = rows_[-1]
        due_ms = -(-(last[0] + interval_us) // 1000)
        if last[2] == "" or due_ms <= state.getCurrentWatermarkMs():
            found.append(last)
            if state.exists:
                state.remove()
        else:
            state.update(last)
            state.setTimeoutTimestamp(due_ms)
        yield fired(key, found)

    return rows.groupBy("key").applyInPandasWithState(run, RESULT.format(key=kind), STATE, "append", GroupStateTimeout.EventTimeTimeout)
