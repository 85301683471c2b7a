"""Streams give what the batch operators give, also after a restart."""

import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from authspan.operators import detectors
from authspan.sources.adapter import Log
from authspan.operators import behaviour, graph
from authspan.streaming import alerts, entities, features

DATA = "/root/testdata/sf0.001"


def in_files(spark, tmp_path, parts=3):
    events = Log(spark, DATA).events.withColumn("n", F.dayofyear("ts"))
    for i in range(parts):
        low, high = i * 31 // parts, (i + 1) * 31 // parts
        events.where((F.col("n") > low) & ((F.col("n") <= high) | F.lit(i == parts - 1))).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(events.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_risk_equals_batch(spark, tmp_path):
    stream = in_files(spark, tmp_path)
    out = alerts.stream_risk(stream, 3 * 1440, 2)
    alerts.run_available(out, f"{tmp_path}/out", f"{tmp_path}/check")
    alerts.run_available(alerts.stream_risk(stream, 3 * 1440, 2), f"{tmp_path}/out", f"{tmp_path}/check")  # nothing new: nothing twice
    cols = ["record_id", "burst", "new_country", "off_hours", "risk"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(cols).collect()))
    want = sorted(map(tuple, detectors.rule_risk(Log(spark, DATA).events, 3 * 1440, 2).select(cols).collect()))
    assert got == want


def sessions(rows, gap):
    """(key, start, members) of rows (key, ts, what) by key, cut where the next is gap or more later."""
    out = []
    for key, ts, what in sorted(rows, key=lambda r: r[:2]):
        if out and out[-1][0] == key and ts - out[-1][2][-1][0] < gap:
            out[-1][2].append((ts, what))
        else:
            out.append((key, ts, [(ts, what)]))
    return out


def test_session_alerts_are_those_of_closed_sessions(spark, tmp_path):
    """What the watermark has passed is alerted, no more than once, and nothing else."""
    stream, log = in_files(spark, tmp_path), Log(spark, DATA)
    rows = log.events.select("user_id", "session_id", "ts", "auth_result", "resource_accessed").collect()
    newest = max(r.ts for r in rows)
    cases = {
        "burst": (alerts.burst_alerts(stream, "3 days", 2), [(r.user_id, r.ts, None) for r in rows if r.auth_result == "failure"], timedelta(days=3), lambda m: len(m) >= 2, "user_id", "attempts"),
        "chain": (alerts.chain_alerts(stream, "1 day"), [(r.session_id, r.ts, r.resource_accessed) for r in rows if r.resource_accessed], timedelta(days=1), lambda m: len({w for _, w in m}) >= 2, "session_id", "hops"),
    }
    for name, (df, events, gap, enough, key, size) in cases.items():
        alerts.run_available(df, f"{tmp_path}/{name}", f"{tmp_path}/k{name}")
        got = sorted((r[key], r.start, r[size]) for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}").collect())
        want = {(k, start, len(m)): m[-1][0] + gap for k, start, m in sessions(events, gap) if enough(m)}
        assert len(got) == len(set(got)) and set(got) <= set(want)
        assert {w for w, end in want.items() if end < newest - timedelta(hours=2)} <= set(got) and got


def test_live_totals(spark, tmp_path):
    log = Log(spark, DATA)
    rows = log.events.select("record_id", F.col("score").cast("double")).join(log.labels.select("record_id", "is_attack"), "record_id")
    rows.write.parquet(f"{tmp_path}/s")
    totals = alerts.LiveTotals(spark, 0.5, f"{tmp_path}/totals")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/s")
    stream.writeStream.foreachBatch(totals).option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
    want = {"processed": rows.count(), "alerts": alerts.live_alerts(rows, 0.5).count(), "hits": rows.where("score >= 0.5 and is_attack").count()}
    got = totals.totals()
    assert {k: got[k] for k in want} == want and got["precision"] == want["hits"] / want["alerts"]
    totals(rows, 0)  # a replayed batch replaces its counts, and a new driver goes on from the table
    assert alerts.LiveTotals(spark, 0.5, f"{tmp_path}/totals").totals() == got


def test_stream_behaviour_equals_batch(spark, tmp_path):
    alerts.run_available(features.stream_behaviour(in_files(spark, tmp_path), 7), f"{tmp_path}/out", f"{tmp_path}/check")
    log = Log(spark, DATA)
    want = behaviour.behaviour(log.events, log.users, 7).drop("geo_distance_from_home_km").join(graph.device_set_delta(log.events), "record_id")
    names = sorted(want.columns)
    got = spark.read.parquet(f"{tmp_path}/out").select(names).toPandas().sort_values("record_id").reset_index(drop=True)
    assert np.allclose(got[names], want.select(names).toPandas().sort_values("record_id").reset_index(drop=True)[names], atol=1e-9)


FAMILIES = {
    "devices": (lambda e, log: entities.stream_devices(e, 7), lambda log: graph.device_features(log.events, 7)),
    "sessions": (lambda e, log: entities.stream_sessions(e, log.users, log.home), lambda log: graph.session_features(log.events, log.users, log.home)),
    "departments": (
        lambda e, log: entities.stream_departments(e, log.users, 7),
        lambda log: behaviour.peer_deviation(log.events, log.users).join(graph.access_chain_distance(log.events, log.users, 7), "record_id"),
    ),
}


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_family_equals_batch_after_a_kill(spark, tmp_path, name):
    """The stream is stopped between batches, and another goes on from its checkpoint."""
    log, (stream, batch) = Log(spark, DATA), FAMILIES[name]
    source = in_files(spark, tmp_path)
    writer = stream(source, log).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").outputMode("append")
    query = writer.start()
    while query.isActive and not any(p.batchId >= 0 and p.numInputRows for p in query.recentProgress):
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None
    before = spark.read.parquet(f"{tmp_path}/out").count()
    alerts.run_available(stream(source, log), f"{tmp_path}/out", f"{tmp_path}/check")
    want = batch(log)
    names = ["record_id", *(c for c in want.columns if c != "record_id")]
    got = spark.read.parquet(f"{tmp_path}/out").select(names).toPandas().sort_values("record_id").reset_index(drop=True)
    assert 0 < before <= len(got)
    want = want.select(names).toPandas().sort_values("record_id").reset_index(drop=True)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)


def test_graph_features_by_batches(spark, tmp_path):
    log = Log(spark, DATA)
    sink = entities.GraphFeatures(spark, f"{tmp_path}/g", 5)
    in_files(spark, tmp_path, 2).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
    got = {r.record_id: r for r in sink.features().collect()}
    want = {r.record_id: r.is_new_edge for r in graph.new_edge(log.events, 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i].is_new_edge - v) < 1e-9 for i, v in want.items())
    assert all(0 <= r.peer_community_deviation <= 1 for r in got.values())
    again = log.events.where("dayofyear(ts) > 15")
    sink(again, 1)  # a replayed batch replaces what it wrote
    assert sink.features().count() == len(got)
