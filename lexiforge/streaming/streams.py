"""Streams: suppression of consecutive doubles, and resolving token lists as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import resolve


def without_repeats(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Rows that differ in some value from the row before them with the same key."""
    along = Window.partitionBy(key).orderBy(*order)
    same: Column = F.row_number().over(along) > 1
    for v in values:
        same = same & F.lag(v).over(along).eqNullSafe(F.col(v))
    return rows.withColumn("same_as_before", same).where("not same_as_before").drop("same_as_before")


def _drop_repeats(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.exists  # a key without rows so far has no last value, not even a null
    last = state.get[0] if seen else None
    for frame in frames:
        frame = frame.sort_values("ts", kind="stable")
        before = frame["value"].shift(1)
        before.iloc[:1] = last
        if len(frame):
            last = frame["value"].iloc[-1]
            state.update((last,))
        same = (frame["value"] == before) | (frame["value"].isna() & before.isna())
        if len(frame) and not seen:
            same.iloc[0] = False
        seen = seen or len(frame) > 0
        yield frame[~same]


def stream_without_repeats(stream: DataFrame) -> DataFrame:
    """A stream (key string, ts timestamp, value string) without rows whose value equals that of the key's last row; the state is one value a key."""
    rows = stream.select("key", "ts", "value")
    return rows.groupBy("key").applyInPandasWithState(_drop_repeats, "key string, ts timestamp, value string", "last string", "append", GroupStateTimeout.NoTimeout)


def _in_order(forget: int | None):
    """Rows that wait until the watermark has passed them and then go through in order of time. forget: milliseconds after its last row that a key is forgotten."""

    def run(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, seen, times, values = state.get if state.exists else (None, 0, False, [], [])
        waiting = list(zip(times, values, strict=True))
        for frame in frames:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            waiting += [(int(t), None if pd.isna(v) else v) for t, v in zip(micros, frame["value"], strict=True)]
        waiting.sort(key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        mark, out = state.getCurrentWatermarkMs(), []
        free = sum(t <= mark * 1000 for t, _ in waiting)
        for t, v in waiting[:free]:
            if not seen or v != last:
                out.append((key[0], t, v))
            last, at, seen = v, t, True
        waiting = waiting[free:]
        if waiting or forget is None or mark <= at // 1000 + forget:
            state.update((last, at, seen, [t for t, _ in waiting], [v for _, v in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] // 1000))
            elif forget is not None:
                state.setTimeoutTimestamp(max(mark + 1, at // 1000 + forget))
        else:
            state.remove()
        if out:
            keys, times, values = zip(*out, strict=True)
            yield pd.DataFrame({"key": list(keys), "ts": pd.to_datetime(list(times), unit="us"), "value": pd.Series(values, dtype=object)})

    return run


def stream_without_repeats_in_order(stream: DataFrame, late: str = "10 minutes", forget_after_seconds: int | None = None) -> DataFrame:
    """A stream (key string, ts timestamp, value string) without rows whose value equals that of the key's row before them in time, however the rows arrive.

    A row waits until the watermark, `late` behind the newest row, has passed it; a row that comes later than that is left out, as is one without a time. Rows of
    one time go in order of value, nulls first. So what comes out is what without_repeats gives for all rows that were in time. The state of a key is its last value and
    the rows that wait. forget_after_seconds: a key without rows for so long is forgotten, and its next row comes out whatever its value.
    """
    rows = stream.select("key", "ts", "value").where("ts is not null").withWatermark("ts", late)
    forget = None if forget_after_seconds is None else 1000 * forget_after_seconds
    kinds = "last string, at long, seen boolean, times array<long>, waiting array<string>"
    return rows.groupBy("key").applyInPandasWithState(_in_order(forget), "key string, ts timestamp, value string", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, value) counted by window and value; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "value").agg(F.count("*").alias("n"))


def resolve_stream(tokens: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, indexes: str | None = None, encoder=None) -> StreamingQuery:
    """Resolves a stream (doc_id, tokens) batch by batch into Parquet. tables: gives the current dictionary and synonym map, and is asked anew for each batch, so a refresh takes effect with the next one.

    indexes: a folder for the vectors of the dictionary's terms and words; a batch encodes only what no batch before it had.
    """

    def batch(rows: DataFrame, number: int) -> None:
        dictionary, synonyms = tables()
        held = resolve.indexes(dictionary, indexes, encoder) if indexes else {}
        resolve.resolved(rows, dictionary, synonyms, encoder=encoder, **held).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
