"""Streams with state of their own: text sessions with all four rules that end one, and exact trailing windows. They need the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSHED = "key string, source string, text string, events long, started long, ended long, why string"
#: What a press of these keys adds to the text; they end a session.
ENDING = {"enter": " [Enter] ", "tab": " [Tab] "}


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Buffer:
    """The text of one key's open session; `add` gives what an event ends, by the rules of `text_sessions`."""

    def __init__(self, threshold: int, idle: int, held: tuple | None = None) -> None:
        self.threshold, self.idle = threshold, idle
        self.source, self.text, self.events, self.started, self.last = held or (None, "", 0, 0, 0)

    def state(self) -> tuple:
        return self.source, self.text, self.events, self.started, self.last

    def flush(self, why: str) -> list[tuple]:
        if not self.text:
            return []
        out = (self.source, self.text, self.events, self.started, self.last, why)
        self.text, self.events = "", 0
        return [out]

    def add(self, source: str, kind: str, text: str, ts: int) -> list[tuple]:
        out = self.flush("idle") if self.text and ts - self.last >= self.idle else []
        switched = self.flush("switch") if self.source != source else []
        out += switched
        if not self.text:
            self.source, self.started, self.events = source, ts, 0
        self.last, self.events = ts, self.events + 1
        self.text = self.text[:-1] if kind == "backspace" else self.text + ENDING.get(kind, text or "")
        if not switched and (kind in ENDING or len(self.text.encode()) >= self.threshold):
            out += self.flush("end" if kind in ENDING else "length")
        return out


class _Sessions(StatefulProcessor):
    def __init__(self, threshold: int, idle: int) -> None:
        self.threshold, self.idle = threshold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "source string, text string, events long, started long, last long")

    def _buffer(self) -> Buffer:
        return Buffer(self.threshold, self.idle, tuple(self.held.get()) if self.held.exists() else None)

    def _table(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "source", "text", "events", "started", "ended", "why"])

    def _keep(self, buffer: Buffer) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if buffer.text:
            self.held.update(buffer.state())
            self.handle.registerTimer((buffer.last + self.idle) * 1000)
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, out = self._buffer(), []
        for r in pd.concat(list(rows)).sort_values(["seconds", "seq"], kind="stable").itertuples(index=False):
            out += buffer.add(r.source, r.kind, r.text, int(r.seconds))
        self._keep(buffer)
        yield from self._table(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = self._buffer()
        out = buffer.flush("idle")
        self.held.clear()
        yield from self._table(key, out)

    def close(self) -> None:
        pass


def text_sessions(stream: DataFrame, threshold: int = 500, idle: int = 30, late: str = "10 seconds") -> DataFrame:
    """Rows of FLUSHED from a stream of (key, source, kind, text, ts timestamp, seq long): the text of each session of a key.

    A session ends before an event of another source, after `enter` or `tab`, once the text has `threshold` bytes, or when no event came for `idle` seconds
    of event time. An event that ended a session by its source does not end another. `backspace` takes the last sign away. Events of a key
    that come in one batch are put in order of ts and seq.
    """
    with_rocksdb(stream.sparkSession)
    rows = stream.withWatermark("ts", late).select("key", "source", "kind", "text", "ts", "seq", F.unix_seconds("ts").alias("seconds"))
    return rows.groupBy("key").transformWithStateInPandas(_Sessions(threshold, idle), FLUSHED, "Append", "EventTime")


class _Trailing(StatefulProcessor):
    def __init__(self, seconds: int, floor: int, least: int) -> None:
        self.seconds, self.floor, self.least = seconds, floor, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seconds long, tx_id long, amount long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.rows.appendList([(int(s), int(t), int(a), False) for s, t, a in zip(batch["seconds"], batch["tx_id"], batch["amount"], strict=True)])
            for second in set(batch["seconds"].astype(int)):
                self.handle.registerTimer(second * 1000 + 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        held, out, kept = sorted(tuple(r) for r in self.rows.get()), [], []
        low = total = 0
        for high, (second, tx_id, amount, told) in enumerate(held):
            total += amount
            while held[low][0] < second - self.seconds:
                total -= held[low][2]
                low += 1
            ready = second <= passed
            if ready and not told:
                # rows of the same second all count, as in a window by ranges
                same = [r for r in held[high + 1 :] if r[0] == second]
                n, whole = high - low + 1 + len(same), total + sum(r[2] for r in same)
                if n >= self.least and whole >= self.floor:
                    out.append((key[0], tx_id, n, whole))
            if second > passed - self.seconds:
                kept.append((second, tx_id, amount, told or ready))
        self.rows.put(kept) if kept else self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["account", "tx_id", "n", "total"])

    def close(self) -> None:
        pass


def trailing_alerts(stream: DataFrame, floor: int, least: int = 3, seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(account, tx_id, n, total) of every row of a stream (account long, tx_id long, amount long, ts timestamp) that ends a trailing window of enough rows and money.

    A row is judged once the watermark has passed it, when no earlier one can come, so these are exactly the rows of the batch rule. The
    state of an account is what it did in one window and the time that rows may be late.
    """
    with_rocksdb(stream.sparkSession)
    rows = stream.withWatermark("ts", late).select("account", "tx_id", "amount", "ts", F.unix_seconds("ts").alias("seconds"))
    return rows.groupBy("account").transformWithStateInPandas(_Trailing(seconds, floor, least), "account long, tx_id long, n long, total long", "Append", "EventTime")
