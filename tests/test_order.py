"""Bootstrap and quantiles against plain versions, with scores that most rows share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.operators import evaluate


def plain_bootstrap(rows, weights):
    """(ap, auc) of each resample from all weighted rows."""
    out = {}
    for b, w in weights.items():
        scores = sorted({s for _, s, _ in rows}, reverse=True)
        tp = fp = ap = auc = 0.0
        for s in scores:
            p = sum(w[i] for i, x, y in rows if x == s and y)
            n = sum(w[i] for i, x, y in rows if x == s and not y)
            tp, fp = tp + p, fp + n
            ap += p * tp / (tp + fp) if tp + fp else 0
            auc += n * (tp - p / 2)
        if tp and fp:
            out[b] = (ap / tp, auc / tp / fp)
    return out


@pytest.mark.parametrize("levels", [3, 40, 100_000])
def test_bootstrap_against_plain_weights(spark, levels):
    rng = random.Random(levels)
    rows = [(i, round(rng.randrange(levels) / levels if rng.random() < 0.7 else 0.5, 6), rng.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, score double, is_attack boolean").repartition(5)
    u = F.shiftrightunsigned(F.xxhash64("record_id", "resample", F.lit(42)), 11) / float(1 << 53)
    held = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("record_id", "resample", u.alias("u")).collect()
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
    weights = {b: {} for b in range(1, 9)}
    for r in held:
        weights[r.resample][r.record_id] = int((steps <= r.u).sum())
    want = plain_bootstrap(rows, weights)
    got = {r.resample: (r.ap, r.auc) for r in evaluate.resampled_ranks(df, "score", 8).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[b], want[b], atol=1e-12) for b in want)


def test_bootstrap_of_one_class_is_empty(spark):
    df = spark.createDataFrame([(i, 0.5, False) for i in range(20)], "record_id long, score double, is_attack boolean")
    assert evaluate.resampled_ranks(df, "score", 5).isEmpty()


def test_quantiles_against_numpy(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else 0.25 if rng.random() < 0.5 else round(rng.gauss(0, 1), 2)) for _ in range(900)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"low": 0.0, "mid": 0.5, "high": 0.99, "top": 1.0}
    for r in C.quantiles(df, ["g"], "v", shares).collect():
        x = [v for g, v in rows if g == r.g and v is not None]
        assert np.allclose([r.low, r.mid, r.high, r.top], np.quantile(x, list(shares.values())))
    whole = C.quantiles(df, [], "v", shares).collect()
    assert len(whole) == 1 and np.allclose(list(whole[0]), np.quantile([v for _, v in rows if v is not None], list(shares.values())))
    mids = {r.g: r.m_v for r in C.medians(df, ["g"], ["v"], "m_").collect()}
    assert mids["one"] == 7.0 and C.medians(df.limit(0), [], ["v"], "m_").first().m_v is None
