"""Structured Streaming forms: stateful rule risk and features, session alerts, live totals.

Output equals the batch operators for input in time order; later rows than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RISK = "record_id long, user_id long, burst int, new_country int, off_hours int, risk int"


def update_user(state: tuple[list[int], set[str]], events: pd.DataFrame, minutes: float, failures: int) -> tuple[tuple[list[int], set[str]], pd.DataFrame]:
    """The rule risk of a user's events in order, from the state before each, and the state after.

    State: times of failures within minutes, and countries seen. Used by the stream; a batch replay may use it too.
    """
    times, seen = list(state[0]), set(state[1])
    reach = int(minutes * 60e6)
    rows = []
    for e in events.sort_values(["us", "record_id"]).itertuples(index=False):
        times = [t for t in times if e.us - t <= reach]
        burst, new, off = int(len(times) >= failures), int(e.geo_country not in seen), int(e.is_off_hours)
        rows.append((e.record_id, e.user_id, burst, new, off, burst + new + off))
        seen.add(e.geo_country)
        if e.auth_result == "failure":
            times.append(e.us)
    return (times, seen), pd.DataFrame(rows, columns=["record_id", "user_id", "burst", "new_country", "off_hours", "risk"])


def stream_risk(events: DataFrame, minutes: float = 15, failures: int = 5) -> DataFrame:
    """rule_risk over a stream: state is kept per user. A user's rows of a micro-batch are handled in time order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = (list(state.get[0]), set(state.get[1])) if state.exists else ([], set())
        rows = pd.concat(list(parts))
        held, out = update_user(held, rows, minutes, failures)
        state.update((held[0], sorted(x for x in held[1] if x is not None)))
        yield out

    slim = events.select("record_id", "user_id", F.unix_micros("ts").alias("us"), "geo_country", "auth_result", "is_off_hours")
    return slim.groupBy("user_id").applyInPandasWithState(step, RISK, "times array<long>, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def burst_alerts(events: DataFrame, gap: str = "15 minutes", failures: int = 8, delay: str = "1 hour") -> DataFrame:
    """Bursts of failed logins of an account: sessions closed by a gap."""
    failed = events.where("auth_result = 'failure'").withWatermark("ts", delay)
    out = failed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("attempts"))
    return out.where(F.col("attempts") >= failures).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts")


def chain_alerts(events: DataFrame, gap: str = "20 seconds", resources: int = 2, delay: str = "1 hour") -> DataFrame:
    """Chains of resource accesses in quick hops within a session."""
    used = events.where("resource_accessed is not null").withWatermark("ts", delay)
    out = used.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("hops"), F.array_distinct(F.collect_list("resource_accessed")).alias("r"))
    return out.where(F.size("r") >= resources).select("session_id", F.col("w.start").alias("start"), "hops", F.size("r").alias("resources"))


def live_alerts(scored: DataFrame, threshold: float) -> DataFrame:
    """The alert stream: rows at or above the threshold."""
    return scored.where(F.col("score") >= threshold)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now into Parquet at path, exactly once, going on from the checkpoint after a crash."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


class LiveTotals:
    """Running counts of processed rows, alerts and hits, kept in a table by micro-batch: a batch that is
    replayed after a crash replaces its row, and a restart goes on from what the table holds."""

    def __init__(self, spark: SparkSession, threshold: float, path: str):
        self.spark, self.threshold, self.path = spark, threshold, path

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        hit = F.col("score") >= self.threshold
        counts = batch.agg(F.count(F.lit(1)).alias("processed"), F.count_if(hit).alias("alerts"), F.count_if(hit & F.col("is_attack")).alias("hits"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def totals(self) -> dict[str, int | float | None]:
        """processed, alerts, hits, and precision (null without alerts)."""
        kept = self.spark.read.schema("processed long, alerts long, hits long, epoch long").option("basePath", self.path).parquet(self.path)
        sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "alerts", "hits"))
        return kept.agg(*sums).withColumn("precision", F.try_divide("hits", "alerts")).first().asDict()  # one row
