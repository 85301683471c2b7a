"""The user's behavioural features over a stream: state before an event gives its features, then takes it in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from authspan.functions.columns import DAY_US, EARTH_KM
from authspan.operators.behaviour import KEEP
from authspan.operators.graph import KEEP_DEVICE

OUT = "record_id long, velocity_kmh double, login_location_entropy double, device_switch_rate double, failed_login_ratio double, ema_failure_rate double, user_device_set_delta double"
STATE = "us array<long>, city array<string>, device array<string>, login array<int>, failed array<int>, lat double, lon double, ema double, names array<string>, weights array<double>, total double"


@dataclass
class UserState:
    """What a user's features depend on: the window's events, the last place, and two fading averages."""

    us: list[int] = field(default_factory=list)
    city: list[str] = field(default_factory=list)
    device: list[str] = field(default_factory=list)
    login: list[int] = field(default_factory=list)
    failed: list[int] = field(default_factory=list)
    lat: float = 0.0
    lon: float = 0.0
    ema: float = 0.0
    names: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    total: float = 0.0

    def update(self, e, reach: int) -> tuple:
        """The event's features, from the state before it."""
        drop = int(np.searchsorted(self.us, e.us - reach, side="left"))
        for held in (self.us, self.city, self.device, self.login, self.failed):
            del held[:drop]
        n, logins = len(self.us), sum(self.login)
        speed = 0.0
        if n:
            a, b = np.radians([self.lat, self.lon]), np.radians([e.geo_lat, e.geo_lon])
            h = np.sin((b[0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[0]) * np.sin((b[1] - a[1]) / 2) ** 2
            speed = 2 * EARTH_KM * np.arcsin(min(1.0, np.sqrt(h))) / max((e.us - self.us[-1]) / 3.6e9, 1 / 60)
        share = np.unique(self.city, return_counts=True)[1] / n if n else np.zeros(0)
        entropy = float(-(share * np.log2(share)).sum()) if n else 0.0
        switch = sum(x != y for x, y in zip(self.device, self.device[1:], strict=False)) / (n - 1) if n > 1 else 0.0
        own = self.weights[self.names.index(e.device_id)] if e.device_id in self.names else 0.0
        out = (e.record_id, float(speed), entropy, switch, sum(self.failed) / logins if logins else 0.0, self.ema, 1 - own / self.total if self.total else 1.0)
        self._take(e)
        return out

    def _take(self, e) -> None:
        login, failed = int(e.event_type == "login_attempt"), int(e.event_type == "login_attempt" and e.auth_result == "failure")
        self.us.append(int(e.us))
        self.city.append(e.geo_city)
        self.device.append(e.device_id)
        self.login.append(login)
        self.failed.append(failed)
        self.lat, self.lon = float(e.geo_lat), float(e.geo_lon)
        if login and e.auth_result is not None:
            self.ema = KEEP * self.ema + (1 - KEEP) * failed
        self.weights = [w * KEEP_DEVICE for w in self.weights]
        if e.device_id not in self.names:
            self.names.append(e.device_id)
            self.weights.append(0.0)
        self.weights[self.names.index(e.device_id)] += 1 - KEEP_DEVICE
        self.total = self.total * KEEP_DEVICE + 1 - KEEP_DEVICE

    def row(self) -> tuple:
        return (self.us, self.city, self.device, self.login, self.failed, self.lat, self.lon, self.ema, self.names, self.weights, self.total)


def stream_behaviour(events: DataFrame, days: float = 30) -> DataFrame:
    """behaviour() and device_set_delta() over a stream keyed by user. State is one user's window."""
    reach = int(days * DAY_US)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = UserState(*[list(x) if isinstance(x, (list, tuple, np.ndarray)) else x for x in state.get]) if state.exists else UserState()
        rows = pd.concat(list(parts)).sort_values(["us", "record_id"])
        rows["auth_result"] = rows["auth_result"].astype(object).where(rows["auth_result"].notna(), None)
        out = [held.update(e, reach) for e in rows.itertuples(index=False)]
        state.update(held.row())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    slim = events.select("user_id", "record_id", F.unix_micros("ts").alias("us"), "event_type", "auth_result", "device_id", "geo_city", "geo_lat", "geo_lon")
    return slim.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
