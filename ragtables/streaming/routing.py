"""Streaming form of the routing of conversation events."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ragtables.operators.sessions import Session, step

STATE = T.StructType([
    T.StructField("organization", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("user_present", T.BooleanType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Router(StatefulProcessor):
    """Keeps one small row of state per conversation; events of a batch are taken in the order of their time."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        session = Session(*self.state.get()) if self.state.exists() else Session()
        routes = []
        for actor, kind, organization in zip(events["actor"], events["kind"], events["organization_id"], strict=True):
            session, route = step(session, actor, kind, organization)
            routes.append(route)
        self.state.update((session.organization, session.mode, session.user_present))
        yield pd.DataFrame({"event_id": events["event_id"].to_numpy(), "conversation_id": key[0], "route": routes})

    def close(self) -> None:
        pass


def route_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(event_id, conversation_id, route) of a stream of events, keyed state per conversation.

    A batch of one conversation is held by one task, so bound the batches with the source's admission limits.
    ``ttl_ms`` forgets conversations without events for that long; without it sessions live for ever. Needs the
    RocksDB state store, which this sets on the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    output = T.StructType([
        events.schema["event_id"], T.StructField("conversation_id", events.schema["conversation_id"].dataType),
        T.StructField("route", T.StringType())])
    return (events.select("event_id", "conversation_id", "ts", "organization_id", "actor", "kind")
            .groupBy("conversation_id")
            .transformWithStateInPandas(_Router(ttl_ms), outputStructType=output, outputMode="Append",
                                        timeMode="ProcessingTime" if ttl_ms else "None"))


DAY_MS = 86_400_000
#: Spark's own watermark trails the newest event by this much, so that it drops nothing; see :class:`_OrderedRouter`.
KEEP_MS = 3_650 * DAY_MS
LIFETIME_MS = 90 * DAY_MS
LATE = "late"
#: Conversations are dealt into so many groups; calls to the state are made per group, its events are kept packed.
GROUPS = 512
#: Events that a task packs at once.
PACKED_EVENTS = 200_000
#: Sessions of a group are looked through for forgotten ones at most so many times in a lifetime.
SWEEPS = 16
ORDERED_STATE = T.StructType([*STATE.fields, T.StructField("last_us", T.LongType())])
BOOK = T.StructType([T.StructField(name, T.LongType()) for name in ("first_ms", "sweep_ms", "timer_ms")])
PACKED = T.StructType([T.StructField("events", T.BinaryType())])


def _to_bytes(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema) as writer:
        writer.write_table(events)
    return sink.getvalue().to_pybytes()


def _of_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _ms(events: pa.Table) -> np.ndarray:
    return events.column("at_us").to_numpy() // 1000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of conversations in a run of events: (bucket, newest time, events)."""
    def packed(waiting):
        events = pa.Table.from_batches(waiting).sort_by("bucket").combine_chunks()
        buckets, events = events.column("bucket").to_numpy(), events.drop_columns("bucket")
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        at_us = events.column("at_us").to_numpy()
        for a, b in itertools.pairwise(edges):
            yield buckets[a], at_us[a:b].max(), _to_bytes(events.slice(a, b - a))

    def rows(waiting):
        buckets, newest, data = zip(*packed(waiting), strict=True)
        return pa.record_batch({"bucket": pa.array(buckets, pa.int32()), "newest_us": pa.array(newest, pa.int64()), "events": pa.array(data, pa.binary())})

    waiting, count = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            count += batch.num_rows
        if count >= PACKED_EVENTS:
            yield rows(waiting)
            waiting, count = [], 0
    if waiting:
        yield rows(waiting)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("events"):
            yield from _of_bytes(data.as_py()).to_batches()


class _OrderedRouter(StatefulProcessor):
    """Holds events of a group of conversations back until the clock of the stream has passed them, and takes them in the
    order of their time.

    The clock is the newest event time of earlier batches less ``delay_ms``. Spark would drop late rows before a processor
    sees them, so its watermark is set to trail by ``KEEP_MS`` instead, and clock and timers are moved by the difference.
    """

    def __init__(self, delay_ms: int, lifetime_ms: int, key_type: T.StructType):
        self.shift, self.lifetime_ms, self.key_type = KEEP_MS - delay_ms, lifetime_ms, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", self.key_type, ORDERED_STATE)
        self.waiting = handle.getListState("waiting", PACKED)
        self.book = handle.getValueState("book", BOOK)

    def _clock(self, timer_values) -> int | None:
        mark = timer_values.getCurrentWatermarkInMs()
        return mark + self.shift if mark > 0 else None

    def _read(self) -> tuple[int | None, int | None, int | None]:
        """Time of the first waiting event, time from which sessions may be forgotten, the timer."""
        return tuple(self.book.get()) if self.book.exists() else (None, None, None)

    def _wake(self, first_ms: int | None, sweep_ms: int | None, timer_ms: int | None) -> None:
        """One timer per group, at the earliest time that is needed."""
        times = [t for t in (first_ms, sweep_ms) if t is not None]
        at_ms = min(times) - self.shift + 1 if times else None
        if at_ms != timer_ms:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            if at_ms is not None:
                self.handle.registerTimer(at_ms)
        if times:
            self.book.update((first_ms, sweep_ms, at_ms))
        else:
            self.book.clear()

    @staticmethod
    def _routed(events: pa.Table, routes: pa.Array) -> pd.DataFrame:
        return pd.DataFrame({"events": [_to_bytes(events.select(["event_id", "conversation_id"]).append_column("route", routes))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, first = self._clock(timerValues), None
        for frame in rows:
            packed = []
            for data in frame["events"]:
                events = _of_bytes(data)
                late = _ms(events) < clock if clock is not None else events.column("at_us").to_numpy() < 0
                if late.any():
                    here = events.filter(pa.array(late))
                    yield self._routed(here, pa.array([LATE] * len(here), pa.string()))
                    events = events.filter(pa.array(~late))
                    data = _to_bytes(events)
                if len(events):
                    packed.append((data,))
                    least = int(_ms(events).min())
                    first = least if first is None else min(first, least)
            if packed:
                self.waiting.appendList(packed)
        if first is not None:
            first_ms, sweep_ms, timer_ms = self._read()
            self._wake(first if first_ms is None else min(first, first_ms), sweep_ms, timer_ms)

    def _due(self, clock: int) -> tuple[pa.Table | None, int | None]:
        """Takes the events that the clock has passed from those that wait; the time of the first one left."""
        blobs = [data for (data,) in self.waiting.get()]
        if not blobs:
            return None, None
        events = pa.concat_tables([_of_bytes(bytes(data)) for data in blobs])
        due = _ms(events) < clock
        rest = events.filter(pa.array(~due))
        if due.any():
            if len(rest):
                self.waiting.put([(_to_bytes(rest.combine_chunks()),)])
            else:
                self.waiting.clear()
        return events.filter(pa.array(due)), int(_ms(rest).min()) if len(rest) else None

    def _step(self, conversation, events) -> tuple[list[str], int]:
        """Routes of the next events of a conversation, whose session is kept, and the time of the last."""
        value = self.sessions.getValue((conversation,))
        session, last_us, routes = (Session(*value[:3]), value[3], []) if value is not None else (Session(), None, [])
        for at_us, actor, kind, organization in events:
            if last_us is not None and at_us - last_us > self.lifetime_ms * 1000:
                session = Session()
            session, route = step(session, actor, kind, organization)
            routes.append(route)
            last_us = at_us
        self.sessions.updateValue((conversation,), (*session, last_us))
        return routes, last_us

    def _sweep(self, clock: int) -> int | None:
        """Forgets the sessions that are over; the time of the next sweep."""
        ends = [(key, value[3] // 1000 + self.lifetime_ms) for key, value in self.sessions.iterator()]
        for key, end_ms in ends:
            if clock > end_ms:
                self.sessions.removeKey(key)
        left = [end_ms for _, end_ms in ends if clock <= end_ms]
        return max(min(left), clock + self.lifetime_ms // SWEEPS) if left else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = self._clock(timerValues)
        _, sweep_ms, _ = self._read()
        due, first_ms = self._due(clock)
        if due is not None and len(due):
            due = due.take(pc.sort_indices(due, [("conversation_id", "ascending"), ("at_us", "ascending"), ("event_id", "ascending")],
                                           null_placement="at_start"))
            ids = due.column("conversation_id").to_pylist()
            rows = zip(ids, *(due.column(c).to_pylist() for c in ("at_us", "actor", "kind", "organization_id")), strict=True)
            routes = []
            for conversation, events in itertools.groupby(rows, key=lambda r: r[0]):
                found, last_us = self._step(conversation, (e[1:] for e in events))
                routes += found
                sweep_ms = last_us // 1000 + self.lifetime_ms if sweep_ms is None else min(sweep_ms, last_us // 1000 + self.lifetime_ms)
            yield self._routed(due, pa.array(routes, pa.string()))
        if sweep_ms is not None and clock > sweep_ms:
            sweep_ms = self._sweep(clock)
        self._wake(first_ms, sweep_ms, None)

    def close(self) -> None:
        pass


def route_in_order(events: DataFrame, delay_ms: int = DAY_MS, lifetime_ms: int = LIFETIME_MS, groups: int = GROUPS) -> DataFrame:
    """(event_id, conversation_id, route) of a stream whose events may come out of order.

    An event is routed once the newest event of earlier batches is more than ``delay_ms`` ahead of it, after all events
    before it; so routes are those of :func:`route_messages` over all events but late ones. An event that comes when the
    clock has passed it has the route 'late' and changes nothing; write rows of that route to a table of their own. A
    session without events for ``lifetime_ms`` is forgotten, so state holds the sessions of that time and the events of
    the last ``delay_ms``. A stream that ends leaves its last events waiting until a newer one moves the clock. Events
    without conversation or time are left out. Needs the RocksDB state store, which this sets on the session.

    Conversations are dealt into ``groups`` by a hash; a task holds the waiting events of one group at a time, so give
    more of them where a group's events of a batch and of ``delay_ms`` are many. A stream keeps its number of groups.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (events.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).filter("at_us is not null and conversation_id is not null")
            .withColumn("bucket", F.pmod(F.xxhash64("conversation_id"), F.lit(groups)).cast("int"))
            .select("event_id", "at_us", "actor", "kind", "organization_id", "conversation_id", "bucket"))
    packed = (rows.mapInArrow(_pack, "bucket int, newest_us long, events binary")
              .select("bucket", F.timestamp_micros("newest_us").alias("clock"), "events").withWatermark("clock", f"{KEEP_MS} milliseconds"))
    key = T.StructType([rows.schema["conversation_id"]])
    routed = packed.groupBy("bucket").transformWithStateInPandas(
        _OrderedRouter(delay_ms, lifetime_ms, key), outputStructType=PACKED, outputMode="Append", timeMode="EventTime")
    output = T.StructType([rows.schema["event_id"], rows.schema["conversation_id"], T.StructField("route", T.StringType())])
    return routed.mapInArrow(_unpack, output)
