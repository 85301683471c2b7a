"""Boosting against a plain version that tries every cut of every node by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from authspan.operators import boosting, learn

RULES = boosting.BoostRules(rounds=3, depth=3, rate=0.3, bins=8, least=0.5)


def plain_boost(x, y, classes, cuts, rules):
    """Margins after all rounds; recursion over rows, no histograms."""
    m = np.zeros((len(x), classes))

    def grow(rows, g, h, depth, out):
        value = -rules.rate * g[rows].sum() / (h[rows].sum() + rules.shrink)
        best, choice = 1e-9, None
        for f in range(x.shape[1]) if depth else []:
            for cut in cuts[f]:
                left = rows[~(x[rows, f] > cut)]
                right = rows[x[rows, f] > cut]
                if h[left].sum() < rules.least or h[right].sum() < rules.least:
                    continue
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + rules.shrink)
                gain = round(score(left) + score(right) - score(rows), 9)
                if gain > best:
                    best, choice = gain, (left, right)
        if choice is None:
            out[rows] = value
        else:
            for part in choice:
                grow(part, g, h, depth - 1, out)

    for _ in range(rules.rounds):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for c in range(classes):
            grow(np.arange(len(x)), p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c]), rules.depth, step[:, c])
        m += step
    return np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)


def data(n=400):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 3)).round(3)
    x[rng.random((n, 3)) < 0.03] = np.nan
    y = (np.nan_to_num(x[:, 0]) > 0).astype(int) + (np.nan_to_num(x[:, 1]) > 0.5)
    return x, y


def test_three_rounds_equal_a_plain_version(spark):
    x, y = data()
    rows = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "record_id long, label int, a double, b double, c double").repartition(5)
    cuts = boosting.sketched_cuts(rows.fillna(0.0), ["a", "b", "c"], RULES.bins)
    model = boosting.fit(rows, ["a", "b", "c"], 3, rules=RULES, cuts=cuts)
    got = np.array([r.p for r in boosting.probabilities(model, rows).orderBy("record_id").collect()])
    assert np.allclose(got, plain_boost(np.where(np.isnan(x), -np.inf, x), y, 3, cuts, RULES), atol=1e-9)
    assert (got.argmax(axis=1) == y).mean() > 0.9


def test_folds_in_one_pass_equal_models_of_their_own(spark):
    x, y = data(150)
    rows = spark.createDataFrame([(i, int(c), i % 2, *map(float, np.nan_to_num(r))) for i, (r, c) in enumerate(zip(x, y, strict=True))], "record_id long, label int, fold int, a double, b double, c double")
    cuts, rules = boosting.sketched_cuts(rows, ["a", "b", "c"], 8), boosting.BoostRules(rounds=2, depth=2, bins=8)
    both = {r.record_id: r.p for r in boosting.probabilities(boosting.fit(rows, ["a", "b", "c"], 3, fold="fold", folds=2, rules=rules, cuts=cuts), rows, "fold").collect()}
    for k in (0, 1):
        own = boosting.fit(rows.where(F.col("fold") != k), ["a", "b", "c"], 3, rules=rules, cuts=cuts)
        for r in boosting.probabilities(own, rows.where(F.col("fold") == k)).collect():
            assert both[r.record_id] == pytest.approx(r.p)


def test_folds_are_stratified_and_defaults_are_full(spark):
    rows = spark.createDataFrame([(i, float(i % 10 == 0)) for i in range(300)], "record_id long, label double")
    held, n = learn.stratified(rows, 3)
    per = {(r.label, r.fold): r["count"] for r in held.groupBy("label", "fold").count().collect()}
    assert n == 3 and all(per[0.0, k] == 90 and per[1.0, k] == 10 for k in range(3))
    assert learn.stratified(rows.where("label = 0 or record_id < 20"), 5)[1] == 2
    assert (boosting.BoostRules().rounds, boosting.BoostRules().depth) == (300, 6)


def test_histograms_of_a_batch_against_sums_row_by_row():
    """Bins and margins go through bytes unchanged, and a task's sums are those of its rows, without those of node -1."""
    rng = np.random.default_rng(6)
    x, m = rng.integers(0, 5, (50, 3)).astype(np.uint8), rng.standard_normal((50, 2))
    assert (boosting.matrix(boosting.as_bytes(x), np.uint8, 50) == x).all() and (boosting.matrix(boosting.as_bytes(m), float, 50) == m).all()
    node, place = rng.integers(-1, 2, 50), x.astype(np.int64) + np.arange(3) * 5
    want = np.zeros((2, 2, 15))
    for i in np.flatnonzero(node >= 0):
        want[:, node[i], place[i]] += m[i][:, None]
    assert np.allclose(boosting.histogram(place, m[:, 0], m[:, 1], node, 2, 15), want.reshape(2, -1))


def test_passes_over_blocks_equal_rounds_within_a_task(spark, monkeypatch):
    """Cells of several tasks, past a written table, make the trees that one task makes of all cells."""
    x, y = data()
    rows = spark.createDataFrame([(i, int(c), i % 2, *map(float, np.nan_to_num(r))) for i, (r, c) in enumerate(zip(x, y, strict=True))], "record_id long, label int, fold int, a double, b double, c double")
    cuts = boosting.sketched_cuts(rows, ["a", "b", "c"], RULES.bins)
    one = boosting.fit(rows, ["a", "b", "c"], 3, fold="fold", folds=2, rules=RULES, cuts=cuts)
    monkeypatch.setattr(boosting, "FEW", 0)
    monkeypatch.setattr(boosting, "SHARE", 60)
    monkeypatch.setattr(boosting, "SPAN", 2)
    many = boosting.fit(rows, ["a", "b", "c"], 3, fold="fold", folds=2, rules=RULES, cuts=cuts)
    for a, b in zip([t for m in one.trees for r in m for t in r], [t for m in many.trees for r in m for t in r], strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.allclose(a[2], b[2], atol=1e-12)


def test_rows_of_equal_bins_are_one_cell(spark, monkeypatch):
    """However many rows fall on a few values, what is learnt from is a row for each."""
    seen, blocks = [], boosting._blocks
    monkeypatch.setattr(boosting, "_blocks", lambda cells, *more: seen.append(cells.count()) or blocks(cells, *more))
    rows = spark.range(5000).selectExpr("id as record_id", "cast(id % 3 as int) as label", "cast(id % 5 as double) as a", "cast(id % 7 as double) as b")
    boosting.fit(rows, ["a", "b"], 3, rules=RULES)
    assert seen == [35]


def test_registered_learners_fit_all_rounds(spark, monkeypatch):
    """boosted_scores and stress_grid ask for no fewer rounds or levels than the reference: 300 of depth 6, out of five folds."""
    from authspan.plans import catalog

    class Stop(Exception):
        pass

    asked = []

    def fit(*given, rules, folds=1, **more):
        asked.append((rules.rounds, rules.depth, folds))
        raise Stop

    monkeypatch.setattr(boosting, "fit", fit)
    monkeypatch.setattr(catalog.graph, "all_features", lambda events, *more: events.select("record_id", *(F.lit(0.0).alias(n) for n in catalog.ALL_FEATURES)))
    for name in ("boosted_scores", "stress_grid"):
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert asked == [(300, 6, 5), (300, 6, 1)]
