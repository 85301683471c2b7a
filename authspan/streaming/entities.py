"""Device, session and department features over a stream, and those of the user-device graph by batches.

Each processor keeps one key's state in the state store, gives an event's features from the state before it and then takes
the event in. Event-time timers drop what no later event can count. Within a batch events go by time and
record_id; rows that come later than the watermark are dropped, and results equal the batch operators' as long as
batches follow the time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from authspan.functions.columns import DAY_US
from authspan.operators import graph
from authspan.operators.behaviour import KEEP, MIN_PEERS
from authspan.sources.scratch import materialised

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(events: DataFrame, key: str, processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # maps and timers need it
    rows = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts)).sort_values(["us", "record_id"])
    return rows.astype(object).where(rows.notna(), None)


def _timer(handle: StatefulProcessorHandle, us: int) -> None:
    """One timer for the key, at us."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(us // 1000 + 1)


class Device(StatefulProcessor):
    """When each user was last seen on a device, and the device's first signature."""

    OUT = "record_id long, device_fan_in double, device_fingerprint_mismatch double"

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "device_type string, os string")
        self.seen = handle.getMapState("seen", "user_id string", "us long")

    def handleInputRows(self, key, rows, timerValues):
        rows = _ordered(rows)
        stored = {k[0]: v[0] for k, v in self.seen.iterator()}
        held, out = OrderedDict(sorted(stored.items(), key=lambda kv: kv[1])), []
        first = tuple(self.first.get()) if self.first.exists() else None
        for e in rows.itertuples(index=False):
            while held and next(iter(held.values())) < e.us - self.reach:  # oldest first
                held.popitem(last=False)
            if first is None:
                first = (e.device_type, e.os)
                self.first.update(first)
            out.append((e.record_id, float(len(held)), float((e.device_type, e.os) != first)))
            held[e.user_id] = int(e.us)
            held.move_to_end(e.user_id)
        for user in stored.keys() - held.keys():
            self.seen.removeKey((user,))
        for user, us in held.items():
            if stored.get(user) != us:
                self.seen.updateValue((user,), (us,))
        _timer(self.handle, max(held.values()) + self.reach)
        yield pd.DataFrame(out, columns=["record_id", "device_fan_in", "device_fingerprint_mismatch"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()  # nobody was seen since; the first signature stays
        yield pd.DataFrame({"record_id": pd.Series(dtype="int64"), "device_fan_in": pd.Series(dtype=float), "device_fingerprint_mismatch": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


class Session(StatefulProcessor):
    """A session's foreign resources and the time of its last resource. Forgotten when idle for longer than idle."""

    OUT = "record_id long, session_foreign_resource_count double, session_hop_seconds double"

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.foreign = handle.getListState("foreign", "resource string")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):
        rows = _ordered(rows)
        known = {r[0] for r in self.foreign.get()} if self.foreign.exists() else set()
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for e in rows.itertuples(index=False):
            out.append((e.record_id, float(len(known)), (e.us - last) / 1e6 if last is not None else graph.LONG_HOP))
            if e.foreign and e.resource_accessed not in known:
                known.add(e.resource_accessed)
                self.foreign.appendValue((e.resource_accessed,))
            last = int(e.us) if e.resource_accessed is not None else last
        if last is not None:
            self.last.update((last,))
        _timer(self.handle, int(rows["us"].max()) + self.idle)
        yield pd.DataFrame(out, columns=["record_id", "session_foreign_resource_count", "session_hop_seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.foreign.clear()
        self.last.clear()
        yield pd.DataFrame({"record_id": pd.Series(dtype="int64"), "session_foreign_resource_count": pd.Series(dtype=float), "session_hop_seconds": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


class Department(StatefulProcessor):
    """A department's average, its users' averages and visits, its sessions' last resources, and its moves between resources."""

    OUT = "record_id long, peer_group_deviation double, access_chain_distance double"

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "average double, members long")
        self.users = handle.getMapState("users", "user_id string", "average double, visited array<string>, at array<long>")
        self.sessions = handle.getMapState("sessions", "session_id string", "resource string, us long")
        self.moves = handle.getMapState("moves", "src string, dst string", "at array<long>")

    def handleInputRows(self, key, rows, timerValues):
        rows, out = _ordered(rows), []
        theirs, members = self.group.get() if self.group.exists() else (0.0, 0)
        fetch = lambda state, name: state.getValue(name) if state.containsKey(name) else None
        users, sessions, moves = {}, {}, {}
        for e in rows.itertuples(index=False):
            if e.user_id not in users:
                held = fetch(self.users, (e.user_id,))
                users[e.user_id] = [held[0], OrderedDict(zip(held[1], held[2], strict=True))] if held else None
            fresh = users[e.user_id] is None
            mine, visits = users[e.user_id] or (0.0, OrderedDict())
            deviation = abs(mine - theirs) if members >= MIN_PEERS else 0.0
            since, res, chain = e.us - self.reach, e.resource_accessed, graph.FAR_RESOURCE
            if res is None or visits.get(res, -1 << 62) >= since:
                chain = 0.0
            elif visits and (last := next(reversed(visits))) and visits[last] >= since:
                n = sum(t >= since for t in self._held(moves, fetch, (last, res)))
                chain = 1 / n if n else graph.FAR_RESOURCE
            out.append((e.record_id, deviation, chain))
            x = float(e.is_off_hours)
            theirs, members = KEEP * theirs + (1 - KEEP) * x, members + fresh
            if res is not None:
                visits[res] = int(e.us)
                visits.move_to_end(res)
                if e.session_id not in sessions:
                    held = fetch(self.sessions, (e.session_id,))
                    sessions[e.session_id] = held[0] if held else None
                src, sessions[e.session_id] = sessions[e.session_id], res
                self.sessions.updateValue((e.session_id,), (res, int(e.us)))
                if src is not None and src != res:
                    self._held(moves, fetch, (src, res)).append(int(e.us))
            users[e.user_id] = [KEEP * mine + (1 - KEEP) * x, visits]
        newest = int(rows["us"].max())
        self.group.update((theirs, members))
        for user, (mine, visits) in users.items():
            self.users.updateValue((user,), (mine, list(visits), list(visits.values())))
        for pair, at in moves.items():
            self.moves.updateValue(pair, ([t for t in at if t >= newest - self.reach],))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((newest + self.reach) // 1000 + 1)
        yield pd.DataFrame(out, columns=["record_id", "peer_group_deviation", "access_chain_distance"])

    def _held(self, moves: dict, fetch, pair: tuple) -> list:
        if pair not in moves:
            held = fetch(self.moves, pair)
            moves[pair] = list(held[0]) if held else []
        return moves[pair]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Sessions idle for longer than reach, and moves that old, are forgotten."""
        since = timerValues.getCurrentWatermarkInMs() * 1000 - self.reach
        for name, (_, us) in list(self.sessions.iterator()):
            if us < since:
                self.sessions.removeKey(name)
        for pair, (at,) in list(self.moves.iterator()):
            if not any(t >= since for t in at):
                self.moves.removeKey(pair)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.reach // 1000 + 1)
        yield pd.DataFrame({"record_id": pd.Series(dtype="int64"), "peer_group_deviation": pd.Series(dtype=float), "access_chain_distance": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def stream_devices(events: DataFrame, days: float = 30, late: str = "1 hour") -> DataFrame:
    """graph.device_features over a stream."""
    slim = events.select("record_id", "ts", "device_id", F.col("user_id").cast("string").alias("user_id"), "device_type", "os")
    return _run(slim, "device_id", Device(int(days * DAY_US)), Device.OUT, late)


def stream_sessions(events: DataFrame, users: DataFrame, home: DataFrame, idle_days: float = 30, late: str = "1 hour") -> DataFrame:
    """graph.session_features over a stream; users and home are static."""
    slim = graph.with_home(events, users, home).select("record_id", "ts", "session_id", "resource_accessed", "foreign")
    return _run(slim, "session_id", Session(int(idle_days * DAY_US)), Session.OUT, late)


def stream_departments(events: DataFrame, users: DataFrame, days: float = 30, late: str = "1 hour") -> DataFrame:
    """behaviour.peer_deviation and graph.access_chain_distance over a stream, for users that are known. Departments
    are few: each is a task's work in a batch, which the batch's size bounds."""
    known = events.join(users.select("user_id", "department").where("department is not null"), "user_id")
    slim = known.select("record_id", "ts", "department", F.col("user_id").cast("string").alias("user_id"), "session_id", "resource_accessed", "is_off_hours")
    return _run(slim, "department", Department(int(days * DAY_US)), Department.OUT, late)


class GraphFeatures:
    """For foreachBatch: is_new_edge and peer_community_deviation of a batch's events.

    Batches are kept as a table by batch number, of which the days that still count are read. A batch that is replayed
    after a failure replaces what it wrote, so nothing is counted or given twice.
    """

    def __init__(self, spark: SparkSession, path: str, days: int = 30):
        self.spark, self.path, self.days = spark, path, days

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slim = batch.select("record_id", "ts", "user_id", "device_id")
        slim.write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        span = slim.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        if span.a is None:
            return
        held = spark.read.schema(slim.schema.add("batch", "long")).parquet(f"{self.path}/log").where(F.col("batch") <= number)
        held = materialised(held.where(F.col("ts") >= F.date_sub(F.lit(span.a), self.days + 1)).drop("batch"))
        pairs = graph.live_pairs(held, self.days).where(F.col("epoch").between(F.to_date(F.lit(span.a)), F.to_date(F.lit(span.b))))
        pairs = materialised(pairs)
        own = held.where(F.col("ts") >= F.lit(span.a)).join(slim.select("record_id"), "record_id", "left_semi")
        share = graph.community_deviation(own, pairs, graph.epoch_communities(pairs))
        edges = graph.new_edge(held, self.days).join(slim.select("record_id"), "record_id", "left_semi")
        edges.join(share, "record_id").write.mode("overwrite").parquet(f"{self.path}/features/batch={number}")

    def features(self) -> DataFrame:
        return self.spark.read.schema("record_id long, is_new_edge double, peer_community_deviation double").parquet(f"{self.path}/features/batch=*")
