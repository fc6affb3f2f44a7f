"""Streaming forms of the ordered state machines, with the same step functions as the batch forms.

State per key is a few numbers. Rows of one micro-batch are put in event order before
they are stepped through; rows of a later micro-batch must not be older than those seen
(the source order, or a watermark before this operator, takes care of that).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contentflow.operators.stateful import MICROS, breaker_step, bucket_step


def _run(df: DataFrame, keys: list[str], ts: str, tie: str, start: Callable, step: Callable, outputs: dict[str, str],
         state_schema: str, idle_ms: int | None) -> DataFrame:
    fields = [f"{n} {t}" for n, t in df.dtypes] + [f"{n} {t}" for n, t in outputs.items()]
    names = list(outputs)

    def work(_key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        current = state.get if state.exists else None
        # one micro-batch of one key; its size is set by the trigger of the source
        pdf = pd.concat(list(frames)).sort_values([ts, tie]).reset_index(drop=True)
        times = (pdf[ts].astype("datetime64[us]").astype("int64")).tolist()
        values = []
        for t, row in zip(times, pdf.to_dict("records")):
            current = start(t, row) if current is None else current
            current, out = step(current, t, row)
            values.append(out)
        state.update(tuple(current))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.concat([pdf, pd.DataFrame(values, columns=names)], axis=1)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(work, ", ".join(fields), state_schema, "append", timeout)


def accept_spaced(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int, strict: bool,
                  idle_ms: int | None = None) -> DataFrame:
    """Adds ``accepted``; ``idle_ms`` forgets keys without rows for that long."""
    gap = gap_seconds * MICROS

    def step(state, t, _row):
        last = state[0]
        ok = last is None or last < 0 or ((t - last > gap) if strict else (t - last >= gap))
        return ((t,) if ok else state), (ok,)

    return _run(df, [key], ts, tie, lambda t, r: (-1,), step, {"accepted": "boolean"}, "last long", idle_ms)


def breaker(df: DataFrame, service: str, ts: str, tie: str, ok: str, threshold: int = 3, timeout_seconds: int = 60) -> DataFrame:
    def step(state, t, row):
        return breaker_step(state, t, bool(row[ok]), threshold, timeout_seconds * MICROS)

    return _run(df, [service], ts, tie, lambda t, r: ("closed", 0, 0), step,
                {"state_before": "string", "allowed": "boolean", "state_after": "string"},
                "state string, failures int, opened long", None)


def token_bucket(df: DataFrame, endpoint: str, ts: str, tie: str, rate: float, burst: float) -> DataFrame:
    def step(state, t, _row):
        return bucket_step(state, t, rate, burst)

    return _run(df, [endpoint], ts, tie, lambda t, r: (burst, t), step,
                {"tokens": "double", "throttled": "boolean", "wait_seconds": "double"}, "tokens double, last long", None)


def full_groups(df: DataFrame, key: str, ts: str, tie: str, size: int = 5) -> DataFrame:
    """Adds ``group_no`` and ``closes``: every ``size`` accepted rows of a key form a group;
    ``closes`` marks the row that completes one. Only the counter is kept as state."""
    def step(state, _t, _row):
        n = state[0]
        return (n + 1,), (n // size, (n + 1) % size == 0)

    return _run(df, [key], ts, tie, lambda t, r: (0,), step, {"group_no": "bigint", "closes": "boolean"}, "n long", None)
