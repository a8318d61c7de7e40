"""Keyed monitors with state: cooldown, bands, crossings, EMA monitor, heartbeats and deadlines.

A key is handled by one task per micro-batch, so what reaches the state is thinned first: one candidate per
key and second, or one check per key and fixed window. Both are spread over (key, time) and combined before
the shuffle. Cooldowns wait for the watermark and so do not depend on the order of rows; the checks that other handlers
get are closed windows, which come in time order from batch to batch, and are sorted by time within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import fixed

BUCKETS = 1024  # of keys that wait for a deadline


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class _Keyed(StatefulProcessor):
    """State in one value, rows in time order, zero or one output row per input row."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", self.state_schema)

    def load(self):
        return self.state.get() if self.state.exists() else None

    def close(self) -> None:
        pass

    def step(self, key, state, row):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self.load(), []
        for row in _rows(rows, ["sec"]).itertuples(index=False):
            state, emit = self.step(key, state, row)
            if emit is not None:
                out.append(emit)
        if state is not None:
            self.state.update(tuple(state))
        if out:
            yield pd.DataFrame(out)


class Cooldown(StatefulProcessor):
    """Greedy cooldown in order of event time: a candidate waits as a timer until the watermark has passed its second.

    Expired timers of a key come in order of time, so rows may arrive in any order the watermark allows.
    """

    def __init__(self, hours: float):
        self.gap = int(hours * 3600)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", "last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for sec in batch["sec"].unique():
                self.handle.registerTimer((int(sec) + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sec = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        last = self.state.get()[0] if self.state.exists() else None
        if last is None or sec - last >= self.gap:
            self.state.update((sec,))
            yield pd.DataFrame({"key": [key[0]], "sec": [sec]})

    def close(self) -> None:
        pass


class Hysteresis(_Keyed):
    state_schema = "zone STRING"

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def step(self, key, state, row):
        zone = "below_low" if row.price < self.low else "above_high" if row.price > self.high else "mid"
        fresh = zone != "mid" and (state is None or state[0] != zone)
        return (zone,), {"key": key[0], "sec": int(row.sec), "price": row.price, "zone": zone} if fresh else None


class EmaMonitor(_Keyed):
    """Incremental EMA with run counters and a cooldown; ``mode`` picks crossings or sustained-below alerts."""

    state_schema = "n BIGINT, ema DOUBLE, above_count BIGINT, below_count BIGINT, last_alert BIGINT"

    def __init__(self, length: int, mode: str, hours: float = 0):
        self.length, self.mode, self.gap = length, mode, int(hours * 3600)

    def step(self, key, state, row):
        n, ema, up, down, last = state if state is not None else (0, 0.0, 0, 0, -1)
        n += 1
        if n <= self.length:  # the seed is the mean of the first values; sums are kept until it is complete
            ema += row.price
            if n < self.length:
                return (n, ema, up, down, last), None
            ema /= self.length
        else:
            ema = (row.price - ema) * (2 / (self.length + 1)) + ema
        above, seen = row.price > ema, up + down > 0
        crossed = seen and (above != (up > 0))
        up, down = (up + 1, 0) if above else (0, down + 1)
        out = {"key": key[0], "sec": int(row.sec), "price": row.price, "ema": ema}
        if self.mode == "cross":
            emit = {**out, "event": "breakout" if above else "breakdown"} if crossed else None
        else:
            ready = last < 0 or int(row.sec) - last >= self.gap
            emit = {**out, "below_count": down} if not above and (crossed or down >= 2) and ready else None
            last = int(row.sec) if emit else last
        return (n, ema, up, down, last), emit


class Heartbeat(StatefulProcessor):
    """Reports when a key falls silent for longer than the limit."""

    def __init__(self, minutes: float):
        self.limit = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", "last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for ms in _rows(rows, ["ms"])["ms"]:
            if last is not None and ms - last > self.limit:
                out.append(last + self.limit)
            last = int(ms) if last is None else max(last, int(ms))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.limit)
        self.state.update((last,))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "stale_at": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "stale_at": [last + self.limit]})

    def close(self) -> None:
        pass


class Deadline(StatefulProcessor):
    """Reports keys when their deadlines pass. A group is a bucket of keys, which share one state and one timer.

    A key that waits keeps the deadline it came with, the earliest of its batch; rows without a time have none.
    """

    def __init__(self, key_type: str = "STRING"):
        self.kind = f"key {key_type}, due BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kind)

    def wait(self, keys: list, dues: list) -> None:
        """Keep these keys as the ones that wait, with a timer at the earliest deadline."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if keys:
            self.waiting.put(list(zip(keys, dues, strict=True)))
            self.handle.registerTimer(min(dues))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due: dict = {}
        for batch in rows:
            some = batch[batch["due"].notna()]
            for k, d in zip(some["key"].tolist(), some["due"].tolist(), strict=True):
                k, d = None if pd.isna(k) else k, int(d)
                due[k] = min(d, due.get(k, d))
        due |= dict(self.waiting.get())
        self.wait(list(due), list(due.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, past, rest = timerValues.getCurrentWatermarkInMs(), [], []
        for k, d in self.waiting.get():
            (past if d <= now else rest).append((k, d))
        self.wait([k for k, _ in rest], [d for _, d in rest])
        if past:
            keys, dues = zip(*past, strict=True)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object if None in keys else None), "expired_at": dues})

    def close(self) -> None:
        pass


def _run(keyed: DataFrame, processor: StatefulProcessor, out: str, timers: bool = False, by: str = "key") -> DataFrame:
    return keyed.groupBy(by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime" if timers else "none")


def thin(candidates: DataFrame) -> DataFrame:
    """One row per key and second; the watermark delay must cover how far rows of a second lie apart."""
    c = candidates.withColumn("sec", F.unix_timestamp("ts"))
    return c.dropDuplicatesWithinWatermark(["key", "sec"]).select("key", "ts", "sec")


def cooldown(candidates: DataFrame, key_type: str, hours: float = fixed.ENGINE_COOLDOWN_HOURS) -> DataFrame:
    """Candidates that are sent, once the watermark has passed them."""
    return _run(thin(candidates), Cooldown(hours), f"key {key_type}, sec BIGINT", timers=True)


def as_checks(closes: DataFrame) -> DataFrame:
    """One check per key and candle."""
    return closes.select("key", F.unix_timestamp("bucket").alias("sec"), F.col("c").alias("price"))


def hysteresis(checks: DataFrame, low: float, high: float) -> DataFrame:
    return _run(checks, Hysteresis(low, high), "key STRING, sec BIGINT, price DOUBLE, zone STRING")


def ema_monitor(checks: DataFrame, length: int = fixed.EMA_LEN, hours: float = fixed.MONITOR_COOLDOWN_HOURS) -> DataFrame:
    return _run(checks, EmaMonitor(length, "below", hours), "key STRING, sec BIGINT, price DOUBLE, ema DOUBLE, below_count BIGINT")


def crosses(checks: DataFrame, length: int = fixed.EMA_LEN) -> DataFrame:
    return _run(checks, EmaMonitor(length, "cross"), "key STRING, sec BIGINT, price DOUBLE, ema DOUBLE, event STRING")


def heartbeats(beats: DataFrame, key_type: str, minutes: float = 5) -> DataFrame:
    """Times (ms) at which keys went stale; ``beats`` has the columns key, ts."""
    return _run(beats.select("key", "ts", F.unix_millis("ts").alias("ms")), Heartbeat(minutes), f"key {key_type}, stale_at BIGINT", timers=True)


def deadlines(opportunities: DataFrame, key_type: str, hours: float = 6) -> DataFrame:
    """Opportunities whose window has passed; ``opportunities`` has the columns key, ts.

    Keys wait in buckets: a call of Python for each bucket and batch costs far less than one for each key. Rows without a key are a bucket of their own.
    """
    bucket = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)) + F.when(F.col("key").isNotNull(), 0), F.lit(-1)).alias("bucket")
    o = opportunities.select(bucket, "key", "ts", (F.unix_millis("ts") + int(hours * 3_600_000)).alias("due"))
    return _run(o, Deadline(key_type), f"key {key_type}, expired_at BIGINT", timers=True, by="bucket")
