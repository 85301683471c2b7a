"""Behavioural features of an event, each from what its user did strictly before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions import columns as C

KEEP = 0.9
#: Values after which an average with KEEP has forgotten what came before (a weight under 1e-17).
FOLD = 400
MIN_PEERS = 5


def behaviour(events: DataFrame, users: DataFrame, days: float = 30) -> DataFrame:
    """record_id with six features per event. All windows share one shuffle by user."""
    e = C.in_order(events, "user_id")
    w, order = C.before("user_id", days), Window.partitionBy("user_id").orderBy("ok")
    prior = lambda c: F.lag(c).over(order)
    hours = F.greatest((F.unix_micros("ts") - F.unix_micros("_ts")) / 3.6e9, F.lit(1 / 60))
    fresh = F.col("_ok") >= F.col("ok") - C.reach(days)
    km = C.haversine_km(F.col("_lat"), F.col("_lon"), F.col("geo_lat"), F.col("geo_lon"))
    login = F.col("event_type") == "login_attempt"
    failed = (F.col("auth_result") == "failure").cast("double")
    known = login & F.col("auth_result").isNotNull()
    # login rows alone; a partition by user serves this window too
    rows = Window.partitionBy("user_id", "counts").orderBy("ok").rowsBetween(1 - FOLD, 0)
    # What a window gives is named before it is used, as every use would slide the window anew.
    e = e.select(
        "record_id", "user_id", "geo_lat", "geo_lon", "geo_city", "ts", "ok", known.alias("counts"), failed.alias("failed"), login.cast("int").alias("login"), (login & failed.cast("boolean")).cast("int").alias("failure"),
        prior("ts").alias("_ts"), prior("ok").alias("_ok"), prior("geo_lat").alias("_lat"), prior("geo_lon").alias("_lon"), F.coalesce((prior("device_id") != F.col("device_id")).cast("int"), F.lit(0)).alias("switched"),
    )
    e = e.withColumn("_failed", F.collect_list("failed").over(rows)).withColumn("ema_after", F.when(F.col("counts"), C.fold_ema(F.col("_failed"), KEEP))).drop("_failed")
    e = e.withColumns({"_n": F.count(F.lit(1)).over(w), "_cities": F.collect_list("geo_city").over(w), "_switched": F.sum("switched").over(w), "_first": F.first("switched").over(w), "_logins": F.sum("login").over(w), "_failures": F.sum("failure").over(w)})
    e = e.withColumn("_ema", F.last("ema_after", ignorenulls=True).over(C.ever_before("user_id")))
    e = e.select(
        "record_id", "user_id", "geo_lat", "geo_lon",
        F.coalesce(F.when(fresh, km / hours), F.lit(0.0)).alias("velocity_kmh"),
        C.entropy(F.col("_cities")).alias("login_location_entropy"),
        F.when(F.col("_n") >= 2, (F.col("_switched") - F.col("_first")) / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias("device_switch_rate"),
        F.when(F.col("_logins") > 0, F.col("_failures") / F.col("_logins")).otherwise(F.lit(0.0)).alias("failed_login_ratio"),
        F.coalesce("_ema", F.lit(0.0)).alias("ema_failure_rate"),
    )
    home = users.select("user_id", "home_lat", "home_lon")
    away = F.coalesce(C.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("geo_lat"), F.col("geo_lon")), F.lit(0.0))
    return e.join(home, "user_id", "left").withColumn("geo_distance_from_home_km", away).drop("user_id", "geo_lat", "geo_lon", "home_lat", "home_lon")


def peer_deviation(events: DataFrame, users: DataFrame) -> DataFrame:
    """(record_id, peer_group_deviation): the user's off-hours average against the department's.

    Both averages fade over blocks of a fixed number of rows, whatever the size of a user or department.
    """
    e = events.select("record_id", "user_id", "ts", F.col("is_off_hours").cast("double").alias("x")).join(users.select("user_id", "department"), "user_id")
    e = C.fading(e, ["user_id"], [F.col("ts"), F.col("record_id")], "x", KEEP, "own").withColumn("first", (F.col("nth") == 1).cast("int")).drop("nth")
    e = C.fading(e, ["department"], [F.col("ts"), F.col("record_id")], "x", KEEP, "theirs", {"members": "first"})
    gap = F.when(F.col("members") - F.col("first") >= MIN_PEERS, F.abs(F.col("own") - F.col("theirs"))).otherwise(F.lit(0.0))
    return e.select("record_id", gap.alias("peer_group_deviation"))
