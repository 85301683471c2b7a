"""Explanations of flagged events, and drift detection over binned series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions.columns import global_rank, running
from authspan.operators.evaluate import stressed
from authspan.sources.scratch import materialised

#: What each feature measures, for readers of an explanation. Windows end before the event.
GLOSSARY = {
    "velocity_kmh": "Great-circle distance from the last event over the hours since then, in km/h.",
    "geo_distance_from_home_km": "Great-circle distance from the home coordinates, in km.",
    "login_location_entropy": "Bits of entropy of the cities in the window.",
    "device_switch_rate": "Share of steps between events in the window that changed the device.",
    "failed_login_ratio": "Failures among the login attempts in the window.",
    "peer_group_deviation": "Gap between two fading averages of off-hours work, the user's and the department's.",
    "ema_failure_rate": "Fading average of failures over all earlier login attempts.",
    "device_fan_in": "Users seen on the device in the window.",
    "user_device_set_delta": "One less the device's share of the user's fading device weights.",
    "is_new_edge": "0 for a pair of user and device seen in the window; else higher the further apart they are in the graph.",
    "access_chain_distance": "Inverse count of the department's moves between these two resources, or 10 for none.",
    "peer_community_deviation": "Share of the other members of the user's device community that weren't on this device.",
    "device_fingerprint_mismatch": "1 if type or operating system isn't the first that was seen under the device's id.",
    "session_foreign_resource_count": "Resources outside the department's usual ones, earlier in the session.",
    "session_hop_seconds": "Seconds since the session's last event, at most an hour.",
}


def describe(feature: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in GLOSSARY.items() for x in kv))
    return F.coalesce(F.try_element_at(known, feature), F.replace(feature, F.lit("_"), F.lit(" ")))


def baseline(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std): std of the sample, at least 1e-6."""
    long = features.unpivot(["record_id"], names, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-6)).alias("std"))


def approximate(features: DataFrame, names: list[str], base: dict[str, tuple[float, float]], weights: dict[str, float], k: int = 5) -> DataFrame:
    """features' record_id with top: the k largest weight * |z|, and a sentence that says it is approximate.

    A column expression over one array, so it serves batch and streams alike. base, weights: a few
    numbers per feature.
    """
    z = lambda n: (F.col(n) - base[n][0]) / base[n][1]
    parts = [F.struct((-weights[n] * F.abs(z(n))).alias("o"), F.lit(n).alias("feature"), z(n).alias("z"), (weights[n] * F.abs(z(n))).alias("contribution")) for n in names]
    top = F.slice(F.sort_array(F.array(*parts)), 1, k)
    out = features.select("record_id", top.alias("top"))
    far = F.filter("top", lambda t: F.abs(t["z"]) >= 1)
    said = F.array_join(F.transform(far, lambda t: F.concat(t["feature"], F.when(t["z"] > 0, F.lit(" above")).otherwise(F.lit(" below")), F.lit(" normal (z = "), F.format_string("%+.2f", t["z"]), F.lit(")"))), ", ")
    text = F.when(F.size(far) == 0, F.lit("Approximate: no feature is far from its normal range.")).otherwise(F.concat(F.lit("Approximate: "), said, F.lit(".")))
    return out.select("record_id", F.transform("top", lambda t: F.struct(t["feature"].alias("feature"), t["z"].alias("z"), t["contribution"].alias("contribution"))).alias("top"), text.alias("sentence"))


def flagged_sample(scores: DataFrame, threshold: float, most: int | None = None, seed: int = 42) -> DataFrame:
    """Flagged rows; with most, a seeded random choice of so many."""
    rows = scores.where(F.col("score") >= threshold)
    return rows if most is None else rows.orderBy(F.xxhash64("record_id", F.lit(seed)), "record_id").limit(most)


def contributions(features: DataFrame, names: list[str], medians: dict[str, float], score: Column) -> DataFrame:
    """(record_id, feature, contribution): the score less the score with that one feature at its median.

    Leave-one-feature-out deltas, not Shapley values. score: an expression over the feature columns.
    """
    rows = features.withColumn("_full", score)
    out = None
    for n in names:
        part = rows.withColumn(n, F.lit(medians[n])).select("record_id", F.lit(n).alias("feature"), (F.col("_full") - score).alias("contribution"))
        out = part if out is None else out.unionAll(part)
    return out


def class_contributions(features: DataFrame, names: list[str], train: DataFrame, classes: tuple[str, ...], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(record_id, predicted_class, feature, value, contribution): the probability of the predicted class less that with
    the one feature at train's median, for each of names, from one scoring pass.

    score: rows (record_id, scenario, names...) to (record_id, scenario, p: array over classes). Leave-one-feature-out
    deltas, not Shapley values.
    """
    cases = [("", 0.0, ())] + [(n, 0.0, (n,)) for n in names]
    scored = materialised(score(stressed(features.select("record_id", *names), names, train, cases)))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    whole = scored.where("scenario = ''").select("record_id", best.alias("_c"), F.get("p", best).alias("_full"))
    values = features.unpivot(["record_id"], names, "feature", "value")
    without = scored.where("scenario <> ''").withColumnRenamed("scenario", "feature").join(whole, "record_id")
    delta = F.col("_full") - F.get("p", F.col("_c"))
    return without.join(values, ["record_id", "feature"]).select("record_id", F.get(F.array(*map(F.lit, classes)), F.col("_c")).alias("predicted_class"), "feature", "value", delta.alias("contribution"))


def top_contributions(parts: DataFrame, k: int = 5, *by: str) -> DataFrame:
    """(record_id, by, top, sentence): the k largest by size, ties by name, with what raised and what offset the score."""
    entry = F.struct((-F.abs("contribution")).alias("o"), "feature", "contribution")
    rows = parts.groupBy("record_id", *by).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    names = lambda keep: F.array_join(F.transform(F.filter("top", keep), lambda t: F.concat(t["feature"], F.format_string(" (%+.3f)", t["contribution"]))), ", ")
    up, down = names(lambda t: t["contribution"] > 0), names(lambda t: t["contribution"] < 0)
    text = F.concat_ws("; ", F.when(up != "", F.concat(F.lit("raised by "), up)), F.when(down != "", F.concat(F.lit("offset by "), down)))
    return rows.select("record_id", *by, F.transform("top", lambda t: F.struct(t["feature"].alias("feature"), t["contribution"].alias("contribution"))).alias("top"), F.when(text == "", "no dominant feature").otherwise(text).alias("sentence"))


def global_weights(parts: DataFrame) -> DataFrame:
    """(feature, weight): mean size of contributions, summing to 1; equal if all are 0."""
    per = parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m"))
    everything = Window.partitionBy(F.lit(1))  # one row per feature
    total = F.sum("m").over(everything)
    return per.select("feature", F.when(total > 0, F.col("m") / total).otherwise(1 / F.count(F.lit(1)).over(everything)).alias("weight"))


def bins(events: DataFrame, value: str, size: int = 100) -> DataFrame:
    """(bin, mean, last_ts, n): consecutive events in bins of size."""
    ranked = global_rank(events.select("record_id", "ts", value), "ts", "record_id")
    return ranked.groupBy(F.floor(F.col("rank") / size).alias("bin")).agg(F.avg(value).alias("mean"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


class AdaptiveWindow:
    """ADWIN over exponential buckets (count, sum, sum of squares), at most ROW of a size, so that a step and
    what is held grow with the logarithm of the window."""

    ROW, LEAST = 5, 5

    def __init__(self, delta: float):
        self.delta, self.buckets = delta, []  # oldest first

    def add(self, x: float) -> bool:
        """Whether the window dropped its older part: two parts whose means differ by more than the bound of the ADWIN paper."""
        self.buckets.append((1, x, x * x))
        size = 1
        while sum(b[0] == size for b in self.buckets) > self.ROW:
            i = next(k for k, b in enumerate(self.buckets) if b[0] == size)
            self.buckets[i : i + 2] = [tuple(a + b for a, b in zip(self.buckets[i], self.buckets[i + 1], strict=True))]
            size *= 2
        dropped = False
        while (cut := self._cut()) is not None:
            del self.buckets[: cut + 1]
            dropped = True
        return dropped

    def _cut(self) -> int | None:
        if len(self.buckets) < 2:
            return None
        n, s, q = np.cumsum(np.array(self.buckets, dtype=float), axis=0).T
        all_n, all_s, all_q = n[-1], s[-1], q[-1]
        n0, n1 = n[:-1], all_n - n[:-1]
        ok = (n0 >= self.LEAST) & (n1 >= self.LEAST)
        if all_n <= 10 or not ok.any():
            return None
        inverse = 1 / n0 + 1 / n1
        log = np.log(2 * np.log(all_n) / self.delta)
        variance = max(all_q / all_n - (all_s / all_n) ** 2, 0.0)
        bound = np.sqrt(2 * inverse * variance * log) + 2 / 3 * inverse * log
        over = np.flatnonzero(ok & (np.abs(s[:-1] / n0 - (all_s - s[:-1]) / n1) > bound))
        return int(over[-1]) if len(over) else None


def drift_points(binned: DataFrame, key: list[str], delta: float = 0.002) -> DataFrame:
    """(key..., last_ts): where each series of bins changes. Series stream through their task in order; what
    is held is one window's buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, AdaptiveWindow(delta)
        for rows in batches:
            found = []
            for i, (name, x) in enumerate(zip(zip(*(rows[k] for k in key), strict=True), rows["mean"].to_numpy(dtype=float), strict=True)):
                if name != now:
                    now, window = name, AdaptiveWindow(delta)
                if window.add(float(x)):
                    found.append(i)
            yield rows.iloc[found][[*key, "last_ts"]]

    kinds = dict(binned.dtypes)
    ordered = binned.select(*key, "bin", "mean", "last_ts").repartition(*key).sortWithinPartitions(*key, "bin")
    return ordered.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", last_ts timestamp")


def series_bins(events: DataFrame, key: str, metrics: list[str], size: int = 100) -> DataFrame:
    """(key, metric, bin, mean, last_ts, n): per value of key, consecutive events in bins of size, for each metric."""
    rows = events.select("record_id", "ts", key, *(F.col(m).cast("double") for m in metrics))
    ranked = running(rows.withColumn("_one", F.lit(1)), [key], [F.col("ts"), F.col("record_id")], {"nth": "_one"})
    long = ranked.withColumn("bin", F.floor((F.col("nth") - 1) / size)).unpivot(["record_id", "ts", key, "bin"], metrics, "metric", "value")
    return long.groupBy(key, "metric", "bin").agg(F.avg("value").alias("mean"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def detection_lag(drift: DataFrame, found: DataFrame, start: Column) -> DataFrame:
    """drift with the first detection at or after each change, its lag in days, and health. drift has a few rows."""
    d = drift.withColumn("at", start)
    hit = d.join(found.select(F.col("last_ts").alias("det")), F.col("det") >= F.col("at"), "left").groupBy(*d.columns).agg(F.min("det").alias("detected_at"))
    lag = (F.unix_micros("detected_at") - F.unix_micros("at")) / 8.64e10
    health = F.when(F.col("detected_at").isNull(), "monitoring gap").when(F.col("lag_days") <= 5, "healthy -- responsive").otherwise("healthy -- slow to react")
    return hit.withColumn("lag_days", lag).withColumn("health", health).withColumn("detected", F.col("detected_at").isNotNull())
