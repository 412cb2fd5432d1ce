"""Stateful stream processors: sliding-log rate limit, attempt lockout and token revocation.

Rows wait in state until the watermark has passed them and are then judged in time order, so the verdicts are
those of the batch form whatever the order of arrival, for all rows within the delay. Keys share ``BUCKETS``
states by their hash: a call into Python and its state serves many keys, of which there may be millions. State
is Arrow bytes of the rows still waiting and of a short list of times for each key; a key idle for a whole window
leaves it at the next event-time timer.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States that keys share; a running stream must keep its number.
BUCKETS = 256
_WAITING = pa.schema([("key", pa.string()), ("at_us", pa.int64()), ("event_id", pa.string()), ("ok", pa.bool_()), ("until", pa.int64())])
_LOG = pa.schema([("key", pa.string()), ("at", pa.int64())])


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(state, schema: pa.Schema) -> pa.Table:
    parts = [pa.ipc.open_stream(r[0]).read_all() for r in state.get()] if state.exists() else []
    return pa.concat_tables(parts) if parts else schema.empty_table()


class Ordered(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark has passed them; ``settle`` then gets them in order."""

    def __init__(self, id_type: pa.DataType) -> None:
        self.waits = _WAITING.set(2, pa.field("event_id", id_type))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.log = handle.getListState("log", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            # a row that isn't an event has no id; pandas may show that as NaN
            ids = [None if i is None or i != i else int(i) if isinstance(i, float) else i for i in batch["event_id"].tolist()]
            new = pa.table({
                "key": pa.array(batch["key"].tolist(), pa.string()), "at_us": pa.array(batch["at_us"].astype("int64")),
                "event_id": pa.array(ids, self.waits.field("event_id").type), "ok": pa.array(batch["ok"].astype(bool)),
                "until": pa.array(batch["until"].astype("int64")),
            }, schema=self.waits)
            self.waiting.appendValue(_packed(new))
            low = int(batch["at_us"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked(self.waiting, self.waits)
        at = held["at_us"].to_numpy()
        ready, left = held.filter(pa.array(at <= passed)), held.filter(pa.array(at > passed))
        if not len(ready) and not self.log.exists():
            return  # another timer of this watermark has settled them
        if len(left):
            self.waiting.put([_packed(left)])
            self.handle.registerTimer(-(-int(at[at > passed].min()) // 1000))
        else:
            self.waiting.clear()
        # a row that isn't an event stands before the events of its own time
        order = pc.sort_indices(ready, [("key", "ascending"), ("at_us", "ascending"), ("event_id", "ascending")], null_placement="at_start")
        ready = ready.take(order)
        log: dict[str | None, list[int]] = {}
        for name, time in zip(*[c.to_pylist() for c in _unpacked(self.log, _LOG).columns]):
            log.setdefault(name, []).append(time)
        out = self.settle(ready, log)
        kept = [(name, t) for name, times in log.items() for t in times if self.over(t) > passed]
        if kept:
            self.log.put([_packed(pa.table({"key": [k for k, _ in kept], "at": [t for _, t in kept]}, schema=_LOG))])
            self.handle.registerTimer(max(self.over(t) for _, t in kept) // 1000 + 1)
        else:
            self.log.clear()
        if len(out):
            yield out

    def close(self) -> None:
        pass

    def over(self, time: int) -> int:
        """When a time of the log no longer counts."""
        return time

    def settle(self, ready: pa.Table, log: dict[str | None, list[int]]) -> pd.DataFrame:
        """Verdicts on rows in the order of key and time; ``log`` is brought up to date."""
        raise NotImplementedError


class _WindowedLog(Ordered):
    """Judges a key's rows in time order against its log."""

    def __init__(self, limit: int, width_us: int, id_type: pa.DataType) -> None:
        super().__init__(id_type)
        self.limit, self.width_us = limit, width_us

    def over(self, time: int) -> int:
        return time + self.width_us

    def settle(self, ready: pa.Table, log: dict[str | None, list[int]]) -> pd.DataFrame:
        verdict = []
        for key, at, ok in zip(*[ready[c].to_pylist() for c in ("key", "at_us", "ok")]):
            log[key] = [x for x in log.get(key, ()) if at - x < self.width_us]
            verdict.append(self.judge(log[key], at, ok))
        return pd.DataFrame({"event_id": ready["event_id"].to_pylist(), "outcome": verdict})

    def judge(self, log: list, at: int, ok: bool) -> str:
        raise NotImplementedError


class SlidingLimit(_WindowedLog):
    def judge(self, log: list, at: int, ok: bool) -> str:
        if len(log) >= self.limit:
            return "limited"
        log.append(at)
        return "allowed"


class Lockout(_WindowedLog):
    def judge(self, log: list, at: int, ok: bool) -> str:
        if len(log) >= self.limit:
            return "locked"
        if ok:
            log.clear()
            return "verified"
        log.append(at)
        return "failed"


class Revocation(Ordered):
    """Tells of each event whether its token is revoked; keeps one expiry for each token, until it is over."""

    def settle(self, ready: pa.Table, log: dict[str | None, list[int]]) -> pd.DataFrame:
        ids, revoked = [], []
        for key, at, event_id, expiry in zip(*[ready[c].to_pylist() for c in ("key", "at_us", "event_id", "until")]):
            until = log.get(key, (0,))[0]
            if event_id is None:
                log[key] = [max(until, expiry)]
            else:
                ids.append(event_id)
                revoked.append(at < until)
        return pd.DataFrame({"event_id": ids, "revoked": revoked})


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _run(stream: DataFrame, key: str, at: str, event_id: str, ok, make, delay: str) -> DataFrame:
    kind = stream.schema[event_id].dataType
    processor = make(to_arrow_type(kind))
    rows = stream.withWatermark(at, delay).select(
        F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"),
        F.col(event_id).alias("event_id"), ok.alias("ok"), F.lit(0).cast("long").alias("until"),
    )
    return rows.withColumn("bucket", bucket("key")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"event_id {kind.simpleString()}, outcome string",
        outputMode="Append", timeMode="EventTime",
    )


def sliding_limit_stream(stream: DataFrame, key: str, at: str, event_id: str, limit: int = 60, width_s: int = 60, delay: str = "1 minute") -> DataFrame:
    return _run(stream, key, at, event_id, F.lit(True), lambda kind: SlidingLimit(limit, width_s * 1_000_000, kind), delay)


def lockout_stream(stream: DataFrame, key: str, at: str, event_id: str, succeeded: str, limit: int = 5, width_s: int = 300, delay: str = "5 minutes") -> DataFrame:
    return _run(stream, key, at, event_id, F.col(succeeded), lambda kind: Lockout(limit, width_s * 1_000_000, kind), delay)


def revoked_stream(events: DataFrame, revocations: DataFrame, token: str, at: str, event_id: str, delay: str = "1 hour") -> DataFrame:
    """``event_id, revoked`` as in batch: the latest expiry among the revocations made so far decides.

    Tokens may live for any time. An event without a token counts as revoked, at once and without state.
    """
    named = F.coalesce(F.col(token), F.lit("")) != ""
    kind = events.schema[event_id].dataType
    rows = events.where(named).select(
        F.col(token).alias("key"), F.col(at).alias("at"), F.col(event_id).alias("event_id"), F.lit(0).cast("long").alias("until")
    ).unionByName(revocations.select(
        F.col(token).alias("key"), F.col("revoked_at").alias("at"), F.lit(None).cast(kind).alias("event_id"), F.unix_micros("exp").alias("until")
    )).withWatermark("at", delay).select("key", "at", F.unix_micros("at").alias("at_us"), "event_id", F.lit(True).alias("ok"), "until")
    judged = rows.withColumn("bucket", bucket("key")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Revocation(to_arrow_type(kind)), outputStructType=f"event_id {kind.simpleString()}, revoked boolean",
        outputMode="Append", timeMode="EventTime",
    )
    return judged.unionByName(events.where(~named).select("event_id", F.lit(True).alias("revoked")))
