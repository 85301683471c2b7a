"""Answers known beforehand, properties, and a sequential replay."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.operators import analyst, behaviour, detectors, evaluate, explain, graph, learn, schema
from authspan.sources import tables
from authspan.sources.adapter import Log

DATA = "/root/testdata/sf0.001"


def test_haversine_known(spark):
    row = spark.range(1).select(C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), C.haversine_km(F.lit(9.0), F.lit(9.0), F.lit(9.0), F.lit(9.0)).alias("zero")).first()
    assert row.half == pytest.approx(math.pi * 6371, rel=1e-12) and row.zero == 0


def test_off_shift_wraps(spark):
    rows = spark.createDataFrame([(22, 20, 4), (12, 20, 4), (4, 20, 4), (8, 9, 17), (17, 9, 17)], "h int, s int, e int")
    assert [r[0] for r in rows.select(C.off_shift(F.col("h"), F.col("s"), F.col("e"))).collect()] == [False, True, False, True, False]


def test_toy_threshold_metrics(spark):
    rows = spark.createDataFrame([("a", 0.9, True), ("b", 0.6, True), ("c", 0.7, False), ("d", 0.2, False), ("e", 0.1, False)], "record_id string, score double, is_attack boolean")
    m = evaluate.binary_metrics(rows.withColumn("pred", F.col("score") >= 0.5)).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 0, 2)


def test_one_class_has_no_rank_metrics(spark):
    rows = spark.createDataFrame([(1, 0.5, False)], "record_id long, score double, is_attack boolean")
    assert evaluate.ranked_metrics(rows).first().roc_auc is None


def test_calibration_known(spark):
    good = [(i, s, i % 200 < 200 * s) for s in (0.1, 0.3, 0.5, 0.7, 0.9) for i in range(200)]
    bad = [(i, 0.9, i % 10 == 0) for i in range(1000)]
    kind = "record_id long, score double, is_attack boolean"
    assert evaluate.calibration_error(spark.createDataFrame(good, kind)).first().ece < 0.02
    assert evaluate.calibration_error(spark.createDataFrame(bad, kind)).first().ece > 0.5


def test_leakage_audit_fails_on_leaky_ids(spark):
    rows = spark.createDataFrame([(i, i < 300, float(i), float(i % 7)) for i in range(3000)], "record_id long, is_attack boolean, a double, b double")
    leaky = learn.leakage_audit(rows, ["a"], holdouts=2).first()
    assert leaky.mean_auc > 0.9 and not leaky.passed
    with pytest.raises(ValueError):
        learn.leakage_audit(rows.where("is_attack"), ["a"], holdouts=1)


def test_leakage_audit_sees_a_leak_that_leaves_attacks_rare(spark):
    """3 % of attacks on one side and 12 % on the other: no leaf predicts attacks, yet their rates rank the rows."""
    rows = spark.range(20_000).select(F.col("id").alias("record_id"), (F.col("id") % 2).alias("a"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("b"))
    rows = rows.withColumn("is_attack", F.pmod(F.xxhash64("record_id"), F.lit(100)) < F.when(F.col("a") == 0, 12).otherwise(3))
    got = learn.leakage_audit(rows, ["b", "a"], holdouts=3).first()
    assert got.holdouts == 3 and got.mean_auc == pytest.approx(0.663, abs=0.03) and got.std_auc > 0 and not got.passed


def test_leakage_audit_against_stumps_by_numpy(spark):
    """Few values of each column, so that cuts are exact: the best cut by Gini of each holdout, and the AUC of what is held out."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (4000, 2))
    y = rng.random(4000) < 0.05 + 0.02 * (x[:, 1] > 6)
    rows = spark.createDataFrame([(i, bool(y[i]), float(x[i, 0]), int(x[i, 1])) for i in range(4000)], "record_id long, is_attack boolean, a double, b long")
    got = learn.leakage_audit(rows, ["a", "b"], holdouts=5)
    want = []
    for i in range(5):
        h = np.array([r[0] for r in rows.select(learn._uniform(42 + i, "record_id") < 0.3).collect()])
        gini = lambda m: 2 * y[m].sum() * (~y[m]).sum() / max(1, m.sum())
        cost, f, c = min((gini(~h & (x[:, f] <= c)) + gini(~h & (x[:, f] > c)), f, c) for f in (0, 1) for c in range(11))  # noqa: B023
        low = x[:, f] <= c
        p = np.where(low, y[~h & low].mean(), y[~h & ~low].mean())[h]
        a, b = p[y[h]], p[~y[h]]
        want.append(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
    got = got.first()
    assert (got.mean_auc, got.min_auc, got.max_auc, got.std_auc) == pytest.approx((np.mean(want), min(want), max(want), np.std(want)), abs=1e-9)


def test_online_scores_in_one_pass_with_the_weights_of_before(spark):
    """Against a replay by numpy, with a feature named score; what is scored reads one table once, however many parts there are."""
    rng = np.random.default_rng(7)
    part, x, y = np.sort(rng.integers(0, 6, 900)), rng.normal(size=(900, 2)), rng.random(900) < 0.4
    rows = spark.createDataFrame([(i, int(part[i]), float(x[i, 0]), float(x[i, 1]), bool(y[i]), i % 3 > 0) for i in range(900)], "record_id long, part int, score double, b double, is_attack boolean, is_train boolean")
    out = learn.online(rows, "part", ["score", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan and "Join" not in plan
    got = {r.record_id: (r.score, r.predicted_class) for r in out.collect()}
    assert len(got) == 900
    w, full = np.zeros(3), np.column_stack([np.ones(900), x])
    for p in range(6):
        at = np.flatnonzero(part == p)
        score = 1 / (1 + np.exp(-full[at] @ w))
        assert all(got[i][0] == pytest.approx(s, abs=1e-12) and got[i][1] == ("attack" if s >= 0.5 - 1e-12 else "benign") for i, s in zip(at, score, strict=True))
        learnt = at % 3 > 0
        w = w - 0.5 * ((score - y[at])[learnt, None] * full[at][learnt]).mean(axis=0)


def test_noise_has_the_asked_width(spark):
    rows = spark.range(20_000).select(F.col("id").alias("record_id"), (F.col("id") % 100).cast("double").alias("x"), F.lit(3.0).alias("k"))
    out = evaluate.noisy(rows, ["x", "k"], rows, 0.1).join(rows.toDF("record_id", "x0", "k0"), "record_id")
    r = out.agg(F.stddev_pop(F.col("x") - F.col("x0")).alias("s"), F.stddev_pop("x0").alias("s0"), F.max(F.abs(F.col("k") - F.col("k0"))).alias("k")).first()
    assert r.s == pytest.approx(0.1 * r.s0, rel=0.1) and r.k == 0


def test_tuned_thresholds_and_decode(spark):
    rows = [("a" if i % 4 == 0 else "b", "b", "a", 0.4 if i % 4 == 0 else 0.1) for i in range(40)]
    t = learn.tuned_thresholds(spark.createDataFrame(rows, "truth string, guess string, class string, p double")).collect()
    assert [(r["class"], r.threshold, r.f1) for r in t] == [("a", 0.4, 1.0)]
    p = spark.createDataFrame([([0.5, 0.4, 0.1],), ([0.1, 0.2, 0.7],), ([0.6, 0.1, 0.3],)], "p array<double>")
    assert [r[0] for r in p.select(learn.decode(F.col("p"), {1: 0.3, 2: 0.9})).collect()] == [1, 2, 0]


def test_isolation_forest_ranks_the_odd_row_first(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)] + [(999, 12.0, -12.0)], "record_id long, x double, y double")
    out = learn.isolation_score(rows, ["x", "y"], learn.isolation_forest(rows, ["x", "y"], trees=40))
    assert out.orderBy(F.col("score").desc()).first().record_id == 999


def test_smote_balances_and_stays_between(spark):
    rows = spark.createDataFrame([(i, float(i >= 90), float(i), 1.0) for i in range(100)], "record_id long, label double, x double, y double")
    out = learn.smote(rows, ["x", "y"])
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 90, 1.0: 90}
    r = out.where("label = 1").agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    assert r.a >= 90 and r.b <= 99


def test_classifier_boosted_and_out_of_fold(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) + (i % 5) / 100) for i in range(60)], "record_id long, label double, x double")
    oof = learn.out_of_fold(rows, ["x"], folds=2, rounds=3, depth=2)
    assert oof.count() == 60 and oof.where("score < 0 or score > 1").isEmpty()
    boosted = learn.boosted_scores(learn.train_boosted(rows, ["x"], rounds=2, depth=2), rows).join(rows, "record_id")
    assert boosted.where("predicted_class <> case label when 0 then 'benign' else 'brute_force' end").isEmpty() and boosted.count() == 60


def test_adwin_finds_the_step(spark):
    rows = [("s", i, 0.2 if i < 60 else 0.8, 1_700_000_000 + i) for i in range(120)] + [("flat", i, 0.5, 1_700_000_000 + i) for i in range(120)]
    b = spark.createDataFrame(rows, "series string, bin long, mean double, t long").withColumn("last_ts", F.timestamp_seconds("t")).drop("t")
    found = explain.drift_points(b, ["series"]).collect()
    assert found and {r.series for r in found} == {"s"} and min(r.last_ts.timestamp() for r in found) >= 1_700_000_060


def test_describe_falls_back(spark):
    r = spark.createDataFrame([("device_fan_in",), ("odd_one",)], "f string").select(explain.describe(F.col("f"))).collect()
    assert r[0][0].startswith("Users seen on the device") and r[1][0] == "odd one"


def test_recommendation_needs_two_kinds(spark):
    row = (1, 0.995, None, "Initial Access", "standard", 0, 0.0, 0.0, 0.0, *[None] * len(analyst.OWN))
    e = spark.createDataFrame([row], "record_id long, percentile double, severity string, tactic string, privilege_level string, prior_alerts long, failed_login_ratio double, velocity_kmh double, is_new_edge double, " + ", ".join(f"z_{n} double" for n in analyst.OWN))
    got = {r.action: (r.score, r.recommended) for r in analyst.actions(analyst.evidence(e)).collect()}
    assert got == {"require_mfa": (5, True), "disable_account": (3, False), "escalate_soc": (3, False)}


def test_bookkeeping_is_a_permutation(spark):
    e = spark.range(1000).select(F.col("id").alias("record_id"))
    b = schema.bookkeeping(e)
    assert sorted(r.insertion_order for r in b.collect()) == list(range(1000))
    assert b.where("generation_batch < 0 or generation_batch > 15").isEmpty()


def test_sources_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(7, "remote_work_shift")], "day int, change_type string")
    tables.write_csv(df.where("false"), f"{tmp_path}/csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", df.schema).count() == 0
    assert "day,change_type" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    assert tables.read_optional(spark, f"{tmp_path}/none", "a int").columns == ["a"]
    tables.write_parquet(df.withColumn("run", F.lit("r1")), f"{tmp_path}/runs", by="run")
    assert [r.run for r in tables.runs(spark, f"{tmp_path}/runs").collect()] == ["r1"]
    tables.write_json(df, f"{tmp_path}/json")
    built = []
    make = lambda: built.append(1) or df
    assert tables.stage(spark, str(tmp_path), "s", make).count() == tables.stage(spark, str(tmp_path), "s", make).count() == 1 and built == [1]


def test_split_rejects_bad_share(spark):
    with pytest.raises(ValueError):
        evaluate.chronological_split(Log(spark, DATA).events, 1.0)


def test_replay_agrees_with_windows(spark):
    """A sequential pass over the log, written from the definitions."""
    log = Log(spark, DATA)
    rows = log.events.select("record_id", "ts", "user_id", "event_type", "auth_result", "device_id", "geo_city").toPandas().sort_values(["ts", "record_id"])
    got = {r.record_id: r for r in behaviour.behaviour(log.events, log.users, 7).collect()}
    past: dict = {}
    ema: dict = {}
    for e in rows.itertuples():
        mine = [p for p in past.get(e.user_id, []) if (e.ts - p.ts).total_seconds() <= 7 * 86400]
        switch = sum(a.device_id != b.device_id for a, b in zip(mine, mine[1:])) / (len(mine) - 1) if len(mine) > 1 else 0
        logins = [p for p in mine if p.event_type == "login_attempt"]
        failed = sum(p.auth_result == "failure" for p in logins) / len(logins) if logins else 0
        cities = [p.geo_city for p in mine]
        ent = -sum(cities.count(c) / len(cities) * math.log2(cities.count(c) / len(cities)) for c in set(cities)) if cities else 0
        r = got[e.record_id]
        assert r.device_switch_rate == pytest.approx(switch) and r.failed_login_ratio == pytest.approx(failed)
        assert r.login_location_entropy == pytest.approx(ent) and r.ema_failure_rate == pytest.approx(ema.get(e.user_id, 0.0))
        past.setdefault(e.user_id, []).append(e)
        if e.event_type == "login_attempt":
            ema[e.user_id] = 0.9 * ema.get(e.user_id, 0.0) + 0.1 * (e.auth_result == "failure")


def test_new_edge_distances(spark):
    """Users a, b share d1; b, c share d2; c has d3: from a's d1, d2 is two steps away, d3 four."""
    ev = [(1, 10, 1, "d1"), (2, 11, 2, "d1"), (3, 12, 2, "d2"), (4, 13, 3, "d2"), (5, 14, 3, "d3"), (6, 20, 1, "d2"), (7, 21, 4, "d9"), (8, 5000, 1, "d1")]
    e = spark.createDataFrame(ev, "record_id long, m long, user_id long, device_id string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)).drop("m")
    got = {r.record_id: r.is_new_edge for r in graph.new_edge(e, 30).collect()}
    assert got[6] == pytest.approx(2 / 3) and got[7] == pytest.approx(6 / 7) and got[8] == 0
    far = e.where("record_id < 6").unionByName(e.where("record_id = 6").withColumn("device_id", F.lit("d3")))
    assert {r.record_id: r.is_new_edge for r in graph.new_edge(far, 30).collect()}[6] == pytest.approx(4 / 5)


def test_communities_find_the_cliques(spark):
    edges = spark.createDataFrame([(a, b, 1) for g in ([1, 2, 3], [7, 8, 9]) for a in g for b in g if a < b], "u1 long, u2 long, weight long")
    users = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20)], "user_id long")
    got = {r.user_id: r.community for r in graph.communities(edges, users).collect()}
    assert got[1] == got[2] == got[3] != got[7] == got[8] == got[9] and got[20] == 20


def test_violations_empty_for_good_rows(spark):
    assert schema.violations(Log(spark, DATA).events, schema.EVENT_RULES, "events").isEmpty()


def test_default_parameters_run(spark):
    log = Log(spark, DATA)
    for df in (detectors.failed_bursts(log.events), detectors.impossible_travel(log.events), detectors.lateral_movement(log.events, log.users, log.home), detectors.device_reuse(log.events)):
        df.count()
    every = graph.all_features(log.events, log.users, log.home, 7).toPandas()
    assert len(every) == log.events.count() and sorted(every.columns) == sorted(["record_id", *explain.GLOSSARY]) and not every.isna().any().any()


def test_communities_never_look_ahead(spark):
    """Features of the first part of the log are the same without the rest of it."""
    log = Log(spark, DATA)
    early = log.events.where("ts < timestamp '2024-01-12'")
    got = []
    for events in (log.events, early):
        pairs = graph.live_pairs(events, 5)
        out = graph.community_deviation(events, pairs, graph.epoch_communities(pairs)).join(early.select("record_id"), "record_id", "left_semi")
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and any(d > 0 for _, d in got[0])


def test_epoch_communities_find_the_cliques(spark):
    rows = [(u, f"d{g}{i}") for g, us in enumerate(([1, 2, 3], [7, 8, 9])) for i in range(3) for u in us] + [(20, "alone")]
    pairs = spark.createDataFrame(rows, "user_id long, device_id string").withColumn("epoch", F.lit(1))
    got = {r.user_id: r.community for r in graph.epoch_communities(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20}


def plain_modularity(pairs, label):
    """By all pairs of users, weighted by their shared devices."""
    on = {}
    for u, d in pairs:
        on.setdefault(d, set()).add(u)
    w = {}
    for us in on.values():
        for a in us:
            for b in us - {a}:
                w[a, b] = w.get((a, b), 0) + 1
    m2, degree = sum(w.values()), {}
    for (a, _), n in w.items():
        degree[a] = degree.get(a, 0) + n
    total = {}
    for u, k in degree.items():
        total[label[u]] = total.get(label[u], 0) + k
    return sum(n for (a, b), n in w.items() if label[a] == label[b]) / m2 - sum((k / m2) ** 2 for k in total.values()) if m2 else 0.0


def test_communities_by_modularity(spark):
    """Planted groups and a terminal that all use: found whole, of a modularity that plain pairs confirm, at least propagation's."""
    rng, rows = random.Random(4), []
    for epoch in range(3):
        for u in range(60):
            rows += {(epoch, u, f"g{u // 10}-{rng.randrange(6)}") for _ in range(4)} | {(epoch, u, "kiosk")} | ({(epoch, u, f"g{rng.randrange(6)}-0")} if rng.random() < 0.2 else set())
    pairs = spark.createDataFrame(sorted(set(rows)), "epoch long, user_id long, device_id string")
    state = graph.epoch_communities(pairs, rounds=3)
    old = graph.propagated(pairs)
    found, first = ({r.epoch: r.q for r in graph.modularity(pairs, s).collect()} for s in (state, old))
    for epoch in range(3):
        label = {r.user_id: r.community for r in state.where(F.col("epoch") == epoch).collect()}
        assert len(label) == 60
        assert found[epoch] == pytest.approx(plain_modularity([(u, d) for e, u, d in set(rows) if e == epoch], label))
        planted = plain_modularity([(u, d) for e, u, d in set(rows) if e == epoch], {u: u // 10 for u in range(60)})
        assert found[epoch] >= first[epoch] and found[epoch] >= 0.85 * planted


def test_communities_of_the_log_beat_propagation(spark):
    log = Log(spark, DATA)
    pairs = graph.live_pairs(log.events, 7)
    q = graph.modularity(pairs, graph.epoch_communities(pairs)).join(graph.modularity(pairs, graph.propagated(pairs)).withColumnRenamed("q", "p"), "epoch")
    rows = q.collect()
    assert len(rows) > 20 and all(r.q >= r.p for r in rows) and any(r.q > r.p for r in rows)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 4))
    rows = spark.createDataFrame([(i, 1.0, *map(float, r)) for i, r in enumerate(x)], "record_id long, label double, a double, b double, c double, d double").repartition(3)
    got = {r.record_id: set(r.near) for r in learn.neighbours(rows, ["a", "b", "c", "d"], "label").collect()}
    y = x / x.std(axis=0)
    found = 0
    for i in range(0, 6000, 60):
        near = np.argsort(((y - y[i]) ** 2).sum(axis=1))[1:6]
        found += len(got[i] & set(near.tolist()))
    assert found >= 0.9 * 500


def test_running_sums_of_one_group_use_many_ranges(spark):
    rows = spark.range(2000).select("id", F.lit(1).alias("one"), (F.col("id") % 7).alias("g"))
    by = {r.id: r.n for r in C.running(rows, [], [F.col("id")], {"n": "one"}).collect()}
    assert all(n == i + 1 for i, n in by.items())
    per = {r.id: r.n for r in C.running(rows, ["g"], [F.col("id").desc()], {"n": "one"}).collect()}
    assert all(n == (1999 - i) // 7 + 1 for i, n in per.items())
