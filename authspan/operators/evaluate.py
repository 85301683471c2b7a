"""Splits, ranked metrics, calibration, bootstrap, audits and stress tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.sources.scratch import materialised


def chronological_split(events: DataFrame, share: float = 0.7) -> DataFrame:
    """(record_id, ts, rank, is_train, split_ts): the first int(n * share) events, at least one on either side, train."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    ranked = C.global_rank(events.select("record_id", "ts"), "ts", "record_id")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    cut = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * share)))
    at = n.select(cut.cast("long").alias("cut"))  # one row
    ranked = ranked.join(F.broadcast(at))
    split = ranked.where("rank = cut").select(F.col("ts").alias("split_ts"))
    return ranked.withColumn("is_train", F.col("rank") < F.col("cut")).join(F.broadcast(split)).drop("cut")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of pred against is_attack, per group."""
    yes, hit = F.col("is_attack"), F.col("pred")
    counts = {"tp": yes & hit, "fp": ~yes & hit, "fn": yes & ~hit, "tn": ~yes & ~hit}
    out = rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in counts)
    norm = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.withColumns(
        {
            "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": F.when(norm > 0, (tp * tn - fp * fn) / norm), "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
        }
    )


def score_curve(rows: DataFrame, *by: str) -> DataFrame:
    """Per distinct score: p and n there, tp and fp at or above it, and the totals.

    Runs over distinct scores, first summed; with by, each group has its own curve.
    """
    per = rows.groupBy(*by, "score").agg(F.count_if("is_attack").alias("p"), F.count_if(~F.col("is_attack")).alias("n"))
    out = C.running(per, list(by), [F.col("score").desc()], {"tp": "p", "fp": "n"})
    totals = out.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    if not by:
        return out.join(F.broadcast(totals))  # one row
    named = totals.withColumnsRenamed({c: f"_{c}" for c in by})
    return out.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))


def ranked_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision (a step sum); null with one class."""
    c = score_curve(rows, *by)
    area = F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("all_p") * F.max("all_n"))
    ap = F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    return c.groupBy(*by).agg(F.when(both, area).alias("roc_auc"), F.when(both, ap).alias("average_precision"))


def precision_recall(rows: DataFrame) -> DataFrame:
    c = score_curve(rows)
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("all_p")).alias("recall"))


def operating_threshold(train: DataFrame, share: float = 0.99) -> DataFrame:
    return C.quantiles(train, [], "score", {"threshold": share})


def threshold_range(train: DataFrame) -> DataFrame:
    return C.quantiles(train, [], "score", {"low": 0.9, "high": 0.999})


def false_positives_per_day(rows: DataFrame) -> DataFrame:
    days = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / float(C.DAY_US)
    return rows.agg(F.count_if(F.col("pred") & ~F.col("is_attack")).alias("fp"), days.alias("days")).withColumn("fp_per_day", _ratio(F.col("fp"), F.col("days")))


def recall_by_type(rows: DataFrame) -> DataFrame:
    return rows.where("attack_type is not null").groupBy("attack_type").agg(F.avg(F.col("pred").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def recall_matrix(rows: DataFrame, types: list[str]) -> DataFrame:
    """Recall of each model (rows) for each attack type (columns)."""
    return rows.where("attack_type is not null").groupBy("model").pivot("attack_type", types).agg(F.avg(F.col("pred").cast("double")))


def time_to_detect(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """One row: mean hours from a campaign's start to its first flagged event, not under 0, and the share detected."""
    first = rows.where("pred").groupBy("attack_id").agg(F.min("ts").alias("found"))
    lag = (F.unix_micros("found") - F.unix_micros(F.col("start_time").cast("timestamp"))) / 3.6e9
    a = attacks.join(first, "attack_id", "left").withColumn("lag", F.greatest(lag, F.lit(0.0)))
    a = a.withColumn("lag", F.when(F.col("found").isNotNull(), F.col("lag")))
    return a.agg(F.avg("lag").alias("mttd_hours"), F.try_divide(F.count("found"), F.count(F.lit(1))).alias("coverage"), F.count(F.lit(1)).alias("campaigns"))


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class of (truth, guess), and accuracy, macro and weighted rows."""
    n = rows.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    actual = n.groupBy(F.col("truth").alias("label")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    said = n.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("said"))
    per = actual.join(said, "label", "full_outer").na.fill(0, ["tp", "support", "said"])
    per = per.select("label", "support", _ratio(F.col("tp"), F.col("said")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), _ratio(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "tp")
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    rates = ["precision", "recall", "f1"]
    total = F.sum("support").alias("support")
    accuracy = per.agg(F.lit("accuracy").alias("label"), total, *(F.try_divide(F.sum("tp"), F.sum("support")).alias(c) for c in rates))
    macro = per.agg(F.lit("macro avg").alias("label"), total, *map(mean, rates))
    weight = per.agg(F.lit("weighted avg").alias("label"), total, *map(weighted, rates))
    return per.drop("tp").unionByName(accuracy).unionByName(macro).unionByName(weight)


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Right-closed equal bins, empty ones kept: bin, n, mean_score, rate."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: F.col("score") > e)) - 1))
    per = rows.withColumn("bin", place).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("is_attack").cast("double")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(per, "bin", "left").na.fill(0, ["n"])


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: ece and brier."""
    b = calibration(rows, bins).agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))), F.sum("n")).alias("ece"))
    brier = rows.agg(F.avg(F.pow(F.col("score") - F.col("is_attack").cast("double"), F.lit(2.0))).alias("brier"))
    return b.join(F.broadcast(brier))


# The primes of XXH64.
P1, P2, P3, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of 32-bit values, as Spark chains it on after seed."""
    rotated = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (seed + P5 + np.uint64(4)) ^ (value.astype(np.uint64) * P1)
    h = rotated(h, 23) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def draws(key: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """(rows, resamples) Poisson(1) weights that depend on a row's key, xxhash64 of its record_id, alone."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    out = np.zeros((len(key), resamples), dtype=np.uint8)
    for a in range(0, len(key), 4096):
        with np.errstate(over="ignore"):
            h = _hashed(np.arange(1, resamples + 1), key[a : a + 4096].view(np.uint64)[:, None])
            h = _hashed(np.full(1, seed), h)
        out[a : a + 4096] = np.searchsorted(steps, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")
    return out


def resampled_sums(rows: DataFrame, resamples: int, seed: int, **kinds: Column) -> DataFrame:
    """(resample, a column for each kind): the weight of the rows of that kind in each resample, a batch's rows summed where they are."""
    slim = rows.select(F.xxhash64("record_id").alias("_key"), *(k.alias(c) for c, k in kinds.items()))
    names = list(kinds)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = draws(b["_key"].to_numpy(), resamples, seed)
            yield pd.DataFrame({"resample": np.arange(1, resamples + 1)} | {c: w[b[c].to_numpy(dtype=bool)].sum(axis=0, dtype=np.int64) for c in names})

    schema = "resample int" + "".join(f", {c} long" for c in kinds)
    return slim.mapInPandas(summed, schema).groupBy("resample").agg(*(F.sum(c).alias(c) for c in kinds))


#: Rows whose weights in all resamples are held at a time.
CHUNK = 4096


class _Range:
    """A range of falling scores, read in chunks: the sums of its inner scores in all resamples, and the score at hand."""

    def __init__(self, part: int, tp: np.ndarray, fp: np.ndarray):
        self.part, self.tp, self.fp = part, np.array(tp, dtype=float), np.array(fp, dtype=float)
        self.ap, self.auc = np.zeros(len(self.tp)), np.zeros(len(self.tp))
        self.s, self.p, self.n, self.first = None, None, None, True

    def frame(self, s: float, **v: np.ndarray | float) -> pd.DataFrame:
        return pd.DataFrame({"part": int(self.part), "s": np.full(len(self.tp), s), "resample": np.arange(1, len(self.tp) + 1)} | v)

    def edge(self, s: float, p: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return self.frame(s, tp=self.tp, fp=self.fp, p=p, n=n, ap=0.0, auc=0.0)

    def add(self, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[pd.DataFrame]:
        """Takes rows of scores s, classes y and weights w; yields the range's first score once it is whole."""
        at = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
        p, n = (np.add.reduceat(w * kind[:, None], at, axis=0, dtype=np.int64) for kind in (y, ~y))
        values = s[at]
        if self.s is not None:
            if self.s == values[0]:
                p[0] += self.p
                n[0] += self.n
            else:
                p, n, values = np.vstack([self.p, p]), np.vstack([self.n, n]), np.concatenate([[self.s], values])
        self.s, self.p, self.n = values[-1], p[-1], n[-1]
        p, n = p[:-1], n[:-1]  # whole scores
        if len(p) and self.first:
            yield self.edge(values[0], p[0], n[0])
            self.first, self.tp, self.fp, p, n = False, self.tp + p[0], self.fp + n[0], p[1:], n[1:]
        if len(p):
            after_p, after_n = self.tp + p.cumsum(axis=0), self.fp + n.cumsum(axis=0)
            said = after_p + after_n
            self.ap += (p * np.divide(after_p, said, out=np.zeros_like(said), where=said > 0)).sum(axis=0)
            self.auc += (n * (after_p - p / 2)).sum(axis=0)
            self.tp, self.fp = after_p[-1], after_n[-1]

    def end(self) -> pd.DataFrame:
        """The last score, and the inner sums (score null)."""
        inner = self.frame(np.nan, tp=0.0, fp=0.0, p=0.0, n=0.0, ap=self.ap, auc=self.auc)
        return inner if self.s is None else pd.concat([self.edge(self.s, self.p, self.n), inner])


def resampled_ranks(rows: DataFrame, score: str, resamples: int = 300, seed: int = 42) -> DataFrame:
    """(resample, ap, auc): Poisson bootstrap of average precision and area under the curve; resamples with one class are left out.

    Rows are dealt by ranges of the score, downwards, once; a row's weights in all resamples are a vector made where it
    is needed. Ranges start from vector sums of those before. Scores inside a range add to its two vectors of sums; the
    first and last score of a range, which neighbours may share, are put together after. Between tasks go a few
    vectors a range, whatever the rows, and a task reads its ranges in order, some thousand rows at a time.
    """
    slim = rows.select(F.col(score).cast("double").alias("s"), F.col("is_attack").alias("y"), F.xxhash64("record_id").alias("k"))
    held = materialised(slim.repartitionByRange(F.col("s").desc(), "k").withColumn("part", F.spark_partition_id()))

    def range_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, own in b.groupby("part"):
                w, y = draws(own["k"].to_numpy(), resamples, seed), own["y"].to_numpy(dtype=bool)
                yield pd.DataFrame({"part": part, "resample": np.arange(1, resamples + 1), "p": w[y].sum(axis=0, dtype=np.int64), "n": w[~y].sum(axis=0, dtype=np.int64)})

    sums = held.mapInPandas(range_sums, "part int, resample int, p long, n long").groupBy("part", "resample").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = materialised(sums)
    past = Window.partitionBy("resample").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select("part", "resample", *(F.coalesce(F.sum(c).over(past), F.lit(0)).cast("double").alias(c) for c in ("p", "n")))
    starts = starts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("resample", "p", "n"))).alias("all")).select("part", "all.p", "all.n")
    none = F.array().cast("array<double>")
    stream = held.select("part", F.lit(1).alias("row"), "s", "y", "k", none.alias("p"), none.alias("n"))
    stream = stream.unionByName(starts.select("part", F.lit(0).alias("row"), F.lit(0.0).alias("s"), F.lit(False).alias("y"), F.lit(0).cast("long").alias("k"), "p", "n"))
    stream = stream.repartition("part").sortWithinPartitions("part", "row", F.col("s").desc())

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            for part, own in b.groupby("part", sort=False):
                if now is None or now.part != part:
                    if now is not None:
                        yield now.end()
                    now, own = _Range(part, own["p"].iloc[0], own["n"].iloc[0]), own.iloc[1:]
                s, y, key = own["s"].to_numpy(), own["y"].to_numpy(dtype=bool), own["k"].to_numpy()
                for a in range(0, len(own), CHUNK):
                    yield from now.add(s[a : a + CHUNK], y[a : a + CHUNK], draws(key[a : a + CHUNK], resamples, seed))
        if now is not None:
            yield now.end()

    kind = "part int, s double, resample int, tp double, fp double, p double, n double, ap double, auc double"
    found = materialised(stream.mapInPandas(ranked, kind))
    edge = found.where("s is not null").groupBy("s", "resample").agg(F.min_by("tp", "part").alias("tp"), F.min_by("fp", "part").alias("fp"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    edge = edge.select("resample", F.coalesce(F.try_divide(F.col("p") * (F.col("tp") + F.col("p")), F.col("tp") + F.col("p") + F.col("fp") + F.col("n")), F.lit(0.0)).alias("ap"), (F.col("n") * (F.col("tp") + F.col("p") / 2)).alias("auc"))
    both = edge.unionByName(found.where("s is null").select("resample", "ap", "auc")).groupBy("resample").agg(F.sum("ap").alias("ap"), F.sum("auc").alias("auc"))
    everything = sums.groupBy("resample").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).where("all_p > 0 and all_n > 0")
    return both.join(everything, "resample").select("resample", (F.col("ap") / F.col("all_p")).alias("ap"), (F.col("auc") / F.col("all_p") / F.col("all_n")).alias("auc"))


def bootstrap_ci(rows: DataFrame, resamples: int = 300, seed: int = 42) -> DataFrame:
    """Percentile interval of average precision, area under the curve, and recall, precision and f1 at pred."""
    y, h = F.col("is_attack"), F.col("pred")
    at = resampled_sums(rows, resamples, seed, tp=y & h, fp=~y & h, fn=y & ~h, tn=~y & ~h).where("tp + fn > 0 and fp + tn > 0")
    at = at.join(resampled_ranks(rows, "score", resamples, seed), "resample")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    at = at.select("ap", F.col("auc").alias("roc_auc"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    long = at.unpivot([], ["ap", "roc_auc", "precision", "recall", "f1"], "metric", "value")
    return long.groupBy("metric").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.5).alias("mid"), F.percentile("value", 0.975).alias("high"), F.count(F.lit(1)).alias("resamples"))


def paired_bootstrap(rows: DataFrame, a: str, b: str, resamples: int = 300, seed: int = 42) -> DataFrame:
    """Average precision of score column a less that of b: interval and two-sided p. A record weighs the same for both."""
    both = resampled_ranks(rows, a, resamples, seed).join(resampled_ranks(rows, b, resamples, seed).select("resample", F.col("ap").alias("ap_b")), "resample")
    d = both.select((F.col("ap") - F.col("ap_b")).alias("d"))
    share = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0)))
    return d.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.5).alias("mid"), F.percentile("d", 0.975).alias("high"), p.alias("p_value"))


# The families of features, the levels of noise, and the features left out one by one.
BEHAVIOUR = ("velocity_kmh", "geo_distance_from_home_km", "login_location_entropy", "device_switch_rate", "failed_login_ratio", "ema_failure_rate", "peer_group_deviation")
GRAPH = ("device_fan_in", "is_new_edge", "user_device_set_delta", "access_chain_distance", "device_fingerprint_mismatch", "peer_community_deviation")
SESSION = ("session_foreign_resource_count", "session_hop_seconds")
NOISE = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)
KEY_FEATURES = ("ema_failure_rate", "failed_login_ratio", "access_chain_distance", "peer_group_deviation", "device_fingerprint_mismatch", "geo_distance_from_home_km", "session_foreign_resource_count", "session_hop_seconds")

#: (name, noise as a share of a feature's deviation, features left out)
Scenario = tuple[str, float, tuple[str, ...]]


def stress_scenarios() -> list[Scenario]:
    """Six levels of noise on all features, each of two families left out, and each of eight features."""
    grid: list[Scenario] = [(f"noise {x:g}", x, ()) for x in NOISE]
    grid += [("without behaviour", 0.0, BEHAVIOUR), ("without graph", 0.0, GRAPH)]
    return grid + [(f"without {n}", 0.0, (n,)) for n in KEY_FEATURES]


def stressed(features: DataFrame, names: list[str], train: DataFrame, scenarios: list[Scenario], seed: int = 42) -> DataFrame:
    """features with scenario, once for each: noise in sample deviations of train, left-out features at train's medians.

    The scenarios are a small table in the plan. Draws depend on record_id, feature and seed, so levels of noise scale one
    draw. Features that don't vary in train stay as they are.
    """
    table = F.array(*(F.struct(F.lit(s).alias("scenario"), F.lit(float(x)).alias("noise"), F.array(*map(F.lit, out)).cast("array<string>").alias("out")) for s, x, out in scenarios))
    std = train.agg(*(F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"_s_{n}") for n in names))
    fitted = C.medians(train, [], names, "_m_").join(F.broadcast(std))  # one row
    u = lambda n, k: (F.shiftrightunsigned(F.xxhash64("record_id", F.lit(n), F.lit(seed + k)), 11) + 1) / float((1 << 53) + 1)
    draw = lambda n: F.sqrt(-2 * F.ln(u(n, 0))) * F.cos(2 * F.pi() * u(n, 1))
    rows = features.withColumn("_case", F.explode(table)).join(F.broadcast(fitted))
    value = lambda n: F.when(F.array_contains("_case.out", n), F.col(f"_m_{n}")).when(F.col("_case.noise") > 0, F.col(n) + draw(n) * F.col("_case.noise") * F.col(f"_s_{n}")).otherwise(F.col(n))
    rest = [c for c in features.columns if c not in names]
    return rows.select(F.col("_case.scenario").alias("scenario"), *rest, *(value(n).alias(n) for n in names))


def stress_report(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """A row per scenario of (scenario, record_id, is_attack, score): rates at the threshold, average precision, Brier score and calibration error."""
    rows = materialised(scored.join(F.broadcast(threshold)).withColumn("pred", F.col("score") >= F.col("threshold")))
    rates = binary_metrics(rows, "scenario").select("scenario", "precision", "recall", "f1")
    ranks = ranked_metrics(rows, "scenario").select("scenario", F.col("average_precision").alias("pr_auc"))
    place = F.least(F.lit(9), F.greatest(F.lit(0), F.ceil(F.col("score") * 10).cast("int") - 1))
    y = F.col("is_attack").cast("double")
    cells = rows.groupBy("scenario", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("said"), F.avg(y).alias("rate"), F.sum(F.pow(F.col("score") - y, F.lit(2.0))).alias("squares"))
    calibration = cells.groupBy("scenario").agg((F.sum("squares") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("said") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return rates.join(ranks, "scenario").join(calibration, "scenario")


def noisy(features: DataFrame, names: list[str], train: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """features plus seeded Gaussian noise of share sample deviations of train; constant ones untouched."""
    return stressed(features, names, train, [("", share, ())], seed).select(features.columns)


def ablated(features: DataFrame, names: list[str], train: DataFrame) -> DataFrame:
    """features with the named columns at their train medians."""
    return stressed(features, names, train, [("", 0.0, tuple(names))]).select(features.columns)


def comparison(metrics: DataFrame, ranked: DataFrame, digits: int = 4) -> DataFrame:
    """One row per model: its rates at the threshold and its ranking quality, rounded; best average precision first."""
    rates = ["precision", "recall", "f1", "mcc", "balanced_accuracy", "roc_auc", "average_precision"]
    out = metrics.join(ranked, "model", "left")
    return out.select("model", *(F.round(c, digits).alias(c) for c in rates)).orderBy(F.col("average_precision").desc_nulls_last(), "model")


def alignment(events: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ids on one side only. Both must be 0 before labels are joined."""
    a, b = events.select("record_id"), labels.select("record_id")
    left = a.join(b, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("events_only"))
    return left.join(F.broadcast(b.join(a, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("labels_only"))))
