"""Keyed state over event streams that expires: failures that a success clears, and a cache of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _by_event_time(events: DataFrame, key: str, time: str, others: list[str], out: str, state: str, step, late: str) -> DataFrame:
    kind, names = events.schema[key].dataType.simpleString(), [key, time, *(x.split()[0] for x in out.split(", "))]

    def run(own: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, *others], kind="stable")
        now = kept.get if kept.exists else None
        told = []
        for row in rows[[time, *others]].itertuples(index=False):
            now, said = step(now, int(row[0].timestamp()), *row[1:])
            told.append((own[0], row[0], *said))
        if now is None:
            if kept.exists:
                kept.remove()
        else:
            kept.update(now)
            kept.setTimeoutTimestamp(max(int(now[-1]) * 1000, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=names)

    seen = events.withWatermark(time, late).select(key, time, *others)
    return seen.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {time} timestamp, {out}", state, "append", GroupStateTimeout.EventTimeTimeout)


def failure_state(events: DataFrame, key: str, time: str, failed: str, ttl: int = 900, late: str = "1 hour") -> DataFrame:
    """key, time, failures, blocked of every event: failures since the last success, none of them older than ttl seconds.

    A success clears a key's failures; the state of a key ends with its last failure's ttl.
    """

    def step(now, at: int, bad: bool):
        count, until = now if now and at < now[1] else (0, 0)
        blocked = count > 0
        if not bad:
            return None, (0, blocked)
        return (count + 1, at + ttl), (count + 1, blocked)

    return _by_event_time(events, key, time, [failed], "failures int, blocked boolean", "count int, until long", step, late)


def result_cache(requests: DataFrame, key: str, time: str, result: str, ttl: int = 600, late: str = "1 hour") -> DataFrame:
    """key, time, hit, value of every request: the value stored at the last miss while younger than ttl; a null is never stored."""

    def step(now, at: int, value: str | None):
        if now and at < now[1]:
            return now, (True, now[0])
        return (None if value is None else (value, at + ttl)), (False, value)

    return _by_event_time(requests, key, time, [result], "hit boolean, value string", "value string, until long", step, late)
