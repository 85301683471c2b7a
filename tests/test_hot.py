"""Keys that hold most rows: results by plain replays, and work that grows with the rows, not their square."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.operators import behaviour, evaluate, graph

START = datetime(2024, 1, 1)


def log(spark, rows):
    """Events of (user, device, hours since START), numbered from 0."""
    kind = "record_id long, user_id long, device_id string, ts timestamp, device_type string, os string"
    return spark.createDataFrame([(i, u, d, START + timedelta(hours=h), "laptop", "x") for i, (u, d, h) in enumerate(rows)], kind)


def test_fan_in_against_a_replay(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.choice("aaaab"), rng.randrange(0, 600)) for _ in range(500)]
    got = {r.record_id: r.device_fan_in for r in graph.device_features(log(spark, rows), 3).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], i))
    for at, i in enumerate(order):
        u, d, h = rows[i]
        assert got[i] == len({rows[j][0] for j in order[:at] if rows[j][1] == d and rows[j][2] >= h - 72})


@pytest.mark.parametrize("name", ["fan_in", "peers", "chain"])
def test_one_hot_key_costs_its_rows(spark, name):
    """Twice the events of one device, department or kind of transition take at most 2.5 times as long."""
    def took(n):
        e = spark.range(n).select(
            F.col("id").alias("record_id"), (F.col("id") % 997).alias("user_id"), F.lit("hot").alias("device_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 20).alias("ts"),
            F.lit("laptop").alias("device_type"), F.lit("x").alias("os"), (F.col("id") % 3 == 0).alias("is_off_hours"), (F.col("id") % 997).cast("string").alias("session_id"),
            F.when(F.floor(F.col("id") / 997) % 2 == 0, "email").otherwise("crm").alias("resource_accessed"),
        )
        users = spark.range(997).select(F.col("id").alias("user_id"), F.lit("all").alias("department"))
        job = {"fan_in": lambda: graph.device_features(e), "peers": lambda: behaviour.peer_deviation(e, users), "chain": lambda: graph.access_chain_distance(e, users, 0.25)}[name]
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(1000)
    once = took(100_000)
    assert took(200_000) <= 2.5 * once + 2


def test_fading_of_one_key_against_a_replay(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else None if rng.random() < 0.5 else "cold", i, float(rng.randrange(2))) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, o long, x double").repartition(7)
    for keep in (0.9, 0.3):
        state, want = {}, {}
        for k, o, x in rows:
            e, n, s = state.get(k, (0.0, 0, 0.0))
            want[o] = (e, n + 1, s + x)
            state[k] = keep * e + (1 - keep) * x, n + 1, s + x
        for r in C.fading(df, ["k"], [F.col("o")], "x", keep, "e", {"s": "x"}).collect():
            e, n, s = want[r.o]
            assert r.e == pytest.approx(e, abs=1e-12) and r.nth == n and r.s == s


def distances(rows, days):
    """is_new_edge of each event, by breadth-first search over the pairs live at its time."""
    out, reach = {}, days * 24
    for i, (u, d, h) in enumerate(rows):
        before = [r for j, r in enumerate(rows) if (r[2], j) < (h, i) and r[0] == u and r[1] == d and r[2] >= h - reach]
        if before:
            out[i] = 0.0
            continue
        live = {(a, b) for a, b, t in rows if h - reach <= t < h}
        users = lambda ds: {a for a, b in live if b in ds}
        devices = lambda us: {b for a, b in live if a in us}
        own = devices({u})
        one = devices(users({d}))
        dist = 2 if own & one else 4 if own & devices(users(one)) else 6
        out[i] = 1 - 1 / (1 + dist)
    return out


def test_new_edge_against_a_search(spark):
    rng = random.Random(3)
    for devices in (30, 60):
        rows = [(rng.randrange(25), f"d{rng.randrange(3) if rng.random() < 0.3 else rng.randrange(devices)}", rng.randrange(0, 500)) for _ in range(260)]
        want = distances(rows, 4)
        for heavy in (0, 3, 64):
            got = {r.record_id: r.is_new_edge for r in graph.new_edge(log(spark, rows), 4, heavy=heavy).collect()}
            assert {i: round(v, 9) for i, v in got.items()} == {i: round(v, 9) for i, v in want.items()}
        assert len({round(v, 3) for v in want.values()}) == 4


def test_new_edge_at_terminals_of_many_users(spark):
    """Two terminals of ten thousand users each, every visit novel: paths are not counted out user by user."""
    n = 10_000
    rows = [(u, f"own{u}", 0) for u in range(n)] + [(u, f"kiosk{u % 2}", 1) for u in range(n)] + [(u, f"kiosk{(u + 1) % 2}", 2) for u in range(0, n, 2)] + [(n, "alone", 0), (n, "kiosk0", 3)]
    began = time.time()
    got = {r.record_id: round(1 / (1 - r.is_new_edge) - 1) for r in graph.new_edge(log(spark, rows), 4).collect()}
    assert time.time() - began < 120
    assert all(got[i] == 6 for i in range(2 * n))  # nobody else's device leads to a user's first ones, at that time
    # At hour 2 each kiosk is linked with its visitors' own devices only; at hour 3 a newcomer's device leads nowhere.
    assert all(got[2 * n + i] == 6 for i in range(n // 2)) and got[len(rows) - 1] == 6
    linked = rows + [(0, "own2", 4), (n + 1, "kiosk1", 4), (n + 1, "own0", 5)]
    more = {r.record_id: round(1 / (1 - r.is_new_edge) - 1) for r in graph.new_edge(log(spark, linked), 4).collect()}
    assert more[len(rows)] == 2 and more[len(rows) + 2] == 2


def test_shared_devices_by_tiles_against_a_count(spark, monkeypatch):
    """Pairs of a terminal's users come from pairs of tiles, and no step sums or shuffles pairs."""
    monkeypatch.setattr(graph, "TILE", 7)
    rng = random.Random(4)
    rows = [(rng.randrange(90), f"d{rng.randrange(2) if rng.random() < 0.4 else rng.randrange(60)}", 0) for _ in range(400)]
    devices = {}
    for u, d, _ in rows:
        devices.setdefault(u, set()).add(d)
    want = {(a, b): len(devices[a] & devices[b]) for a in devices for b in devices if a < b and devices[a] & devices[b]}
    out = graph.shared_devices(log(spark, rows))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {(r.u1, r.u2): r.weight for r in got} == want and len(got) == len(want)
    assert max(want.values()) > 1


def test_each_pair_of_tiles_is_met_once(spark, monkeypatch):
    """Users of terminals and of small devices: weights are those of a count, and no candidate is made both ways round."""
    monkeypatch.setattr(graph, "TILE", 96)
    rng = random.Random(6)
    rows = [(u, f"kiosk{u % 2}", 0) for u in range(400)] + [(u, f"kiosk{(u + 1) % 2}", 0) for u in range(0, 400, 9)] + [(u, f"own{u // 3}", 0) for u in range(400)] + [(u, f"own{rng.randrange(90)}", 0) for u in range(200)]
    devices = {}
    for u, d, _ in rows:
        devices.setdefault(u, set()).add(d)
    want = {(a, b): len(devices[a] & devices[b]) for a in devices for b in devices if a < b and devices[a] & devices[b]}
    out = graph.shared_devices(log(spark, rows))
    got = out.collect()
    assert {(r.u1, r.u2): r.weight for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(ta" in plan and "explode(sequence(0, t#" in plan  # right tiles up to a user's own, not all


def test_communities_pass_over_shared_devices_only(spark, monkeypatch):
    """Devices of one user tell nothing of communities: moves get none, and their users stay by themselves."""
    rows = [(u, f"own{u}", 0) for u in range(40)] + [(u, f"shared{u // 5}", 1) for u in range(20)]
    seen, moves = [], graph._moves
    monkeypatch.setattr(graph, "_moves", lambda pairs, *more: seen.append(pairs) or moves(pairs, *more))
    out = graph.epoch_communities(graph.live_pairs(log(spark, rows), 1))
    groups = {r.user_id: r.community for r in out.collect()}
    assert len(groups) == 40 and all(groups[u] == u for u in range(20, 40))
    assert all(len({groups[u] for u in range(k, k + 5)}) == 1 for k in range(0, 20, 5))
    assert all(p.count() == 20 for p in seen[:1])


def test_a_score_of_all_rows_is_ranked_in_chunks():
    """One score of most rows: no more than a chunk's weights are held at a time, and the sums are those of all rows."""
    draws = evaluate.draws
    rng = np.random.default_rng(5)
    s, y = np.sort(np.where(rng.random(3000) < 0.8, 0.5, rng.random(3000).round(2)))[::-1], rng.random(3000) < 0.3
    w = draws(rng.integers(0, 1 << 62, 3000), 20, 1)
    r = evaluate._Range(0, np.zeros(20), np.zeros(20))
    frames = [f for a in range(0, 3000, 70) for f in r.add(s[a : a + 70], y[a : a + 70], w[a : a + 70])] + [r.end()]
    assert sum(len(f) for f in frames) == 3 * 20
    edges = [f for f in frames for _, f in f.groupby(f["s"].isna()) if f["s"].notna().all()]
    ap = frames[-1]["ap"].to_numpy()[-20:] + sum(np.nan_to_num(e["p"] * (e["tp"] + e["p"]) / (e["tp"] + e["p"] + e["fp"] + e["n"])).astype(float) for e in edges)
    want = np.zeros(20)
    for v in np.unique(s):
        tp, said = w[(s >= v) & y].sum(axis=0, dtype=float), w[s >= v].sum(axis=0, dtype=float)
        want += np.where(said > 0, w[(s == v) & y].sum(axis=0) * tp / np.maximum(said, 1), 0)
    assert np.allclose(ap, want)


def test_a_window_slides_once_however_often_its_result_is_used(spark):
    rows = log(spark, [(1, "a", h) for h in range(5)]).withColumns({"geo_lat": F.lit(0.0), "geo_lon": F.lit(0.0), "geo_city": F.lit("c"), "event_type": F.lit("login_attempt"), "auth_result": F.lit("failure")})
    users = spark.createDataFrame([(1, 0.0, 0.0)], "user_id long, home_lat double, home_lon double")
    plan = behaviour.behaviour(rows, users, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and plan.count("first(") == 1  # cities and failures; the first switch


@pytest.mark.parametrize("name", ["shown_features", "signals", "drift_profiles"])
def test_features_share_one_written_log(spark, monkeypatch, name):
    """The queries over all features make the log of the tables once, not once a family."""
    from authspan.plans import catalog
    from authspan.sources.adapter import Log

    class Stop(Exception):
        pass

    def seen(given):
        assert given.events._table and given.users._table and given.kept() is given
        raise Stop

    monkeypatch.setattr(catalog, "behaviour_features", seen)
    with pytest.raises(Stop):
        getattr(catalog, name)(Log(spark, "/root/testdata/sf0.001"))
