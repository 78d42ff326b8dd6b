"""State of connections in a stream: bounded buffers that end with the connection or after a pause."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.flows import micros

#: The provider that keeps several state variables and timers per key.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_TIME, _LONG, _BYTES = T.TimestampType(), T.LongType(), T.BinaryType()
_WAITING = T.StructType().add("ts", _TIME).add("seq", _LONG).add("direction", T.StringType()).add("data", _BYTES).add("ended", T.BooleanType())
_LIFE = T.StructType().add("first_ts", _TIME).add("last_ts", _TIME).add("tx", _BYTES).add("rx", _BYTES).add("seen_tx", _LONG).add("seen_rx", _LONG)


def _ms(ts) -> int:
    """The first millisecond at which the watermark covers this time."""
    return -int(-ts.timestamp() * 1_000_000 // 1000)


class Lives(StatefulProcessor):
    """Packets wait until the watermark passes them and then enter the connection's life in order of time.

    A key has at most one timer: for its earliest waiting packet or, if none waits, for the end of
    the pause after its last one. A life that ends leaves no state behind.
    """

    def __init__(self, keys: list[str], most: int, idle_us: int):
        self.keys, self.most, self.idle_us = keys, most, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.life = handle.getValueState("life", _LIFE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["ts"], r["seq"], r["direction"], r["data"], r["ended"]) for r in rows]
        self.waiting.appendList(new)
        first = min(_ms(r[0]) for r in new)
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            self._only_timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, rest = [r for r in rows if _ms(r[0]) <= mark], [r for r in rows if _ms(r[0]) > mark]
        life, out = (tuple(self.life.get()) if self.life.exists() else None), []
        for ts, _, direction, data, ended in due:
            if life and self._pause(life[1], ts) > self.idle_us:
                out.append(self._row(key, life, False))
                life = None
            life = self._grown(life, ts, direction, bytes(data or b""))
            if ended:
                out.append(self._row(key, life, True))
                life = None
        if life and not rest and self._pause(life[1], None, mark) > self.idle_us:
            out.append(self._row(key, life, False))
            life = None
        if rest:
            self.waiting.put([tuple(r) for r in rest])
        else:
            self.waiting.clear()
        if life:
            self.life.update(life)
        else:
            self.life.clear()
        self._only_timer(_ms(rest[0][0]) if rest else _ms(life[1]) + self.idle_us // 1000 + 1 if life else None)
        return iter([r for r in out if r["seen_tx"] + r["seen_rx"] > 0])

    def _pause(self, last, ts, mark: int = 0) -> int:
        now = round(ts.timestamp() * 1_000_000) if ts else mark * 1000
        return now - round(last.timestamp() * 1_000_000)

    def _grown(self, life, ts, direction: str, data: bytes) -> tuple:
        first, _, tx, rx, seen_tx, seen_rx = life or (ts, ts, b"", b"", 0, 0)
        if direction == "tx":
            tx, seen_tx = (bytes(tx) + data)[-self.most :], seen_tx + len(data)
        elif direction == "rx":
            rx, seen_rx = (bytes(rx) + data)[-self.most :], seen_rx + len(data)
        return first, ts, tx, rx, seen_tx, seen_rx

    def _row(self, key, life: tuple, ended: bool) -> Row:
        names = [*self.keys, "first_ts", "last_ts", "tx", "rx", "seen_tx", "seen_rx", "ended"]
        return Row(**dict(zip(names, [*key, *life, ended], strict=True)))

    def _only_timer(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)


def lives(packets: DataFrame, keys: list[str], most: int = 1 << 16, idle: str = "5 minutes") -> DataFrame:
    """The rows of ``operators.flows.lives`` from a stream whose ``ts`` has a watermark, in whatever order packets come.

    A row appears when the watermark has passed the end of the life or the pause after it. State of a
    key is its bounded buffers and the packets that are later than the watermark. The session needs
    the state store named by PROVIDER.
    """
    schema = T.StructType([*(packets.schema[k] for k in keys), *_LIFE.fields, T.StructField("ended", T.BooleanType())])
    rows = packets.select(*keys, "ts", F.col("seq").cast("long").alias("seq"), "direction", "data", F.coalesce("ended", F.lit(False)).alias("ended"))
    return rows.groupBy(*keys).transformWithState(Lives(keys, most, micros(idle)), schema, "append", "EventTime")
