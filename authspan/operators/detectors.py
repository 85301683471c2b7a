"""Rule queries: the point-in-time rule risk, and the signatures of five kinds of attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.operators.graph import with_home

FAILED = "auth_result = 'failure'"


def rule_risk(events: DataFrame, minutes: float = 15, failures: int = 5) -> DataFrame:
    """(record_id, burst, new_country, off_hours, risk): many failures just before, a country new to
    the user (the user's first event included), off-hours; risk is their sum."""
    e = C.in_order(events, "user_id")
    failed = F.coalesce(F.sum((F.col("auth_result") == "failure").cast("int")).over(C.before("user_id", minutes / 1440)), F.lit(0))
    e = e.withColumn("burst", (failed >= failures).cast("int"))
    first = F.row_number().over(Window.partitionBy("user_id", "geo_country").orderBy("ok")) == 1
    out = e.select("record_id", "burst", first.cast("int").alias("new_country"), F.col("is_off_hours").cast("int").alias("off_hours"))
    return out.withColumn("risk", F.col("burst") + F.col("new_country") + F.col("off_hours"))


def is_anomaly(risk: Column) -> Column:
    return risk >= 2


def failed_bursts(events: DataFrame, failures: int = 8, least_min: float = 2, most_min: float = 15) -> DataFrame:
    """Sessions with many failures within a span, and whether a success closed them."""
    e = C.in_order(events.where("auth_result is not null"), "session_id")
    t = F.unix_micros("ts")
    failed = F.when(F.expr(FAILED), t)
    out = e.groupBy("user_id", "session_id").agg(
        F.count(failed).alias("attempts"), F.min(failed).alias("first_us"), F.max(failed).alias("last_us"), (F.max_by("auth_result", "ok") == "success").alias("succeeded")
    )
    span = (F.col("last_us") - F.col("first_us")) / 6e7
    return out.withColumn("minutes", span).where((F.col("attempts") >= failures) & span.between(least_min, most_min)).drop("first_us", "last_us")


def impossible_travel(events: DataFrame, least_min: float = 5, most_min: float = 90, least_km: float = 500, most_km: float = 15_000, least_kmh: float = 700) -> DataFrame:
    """Successful logins too far from the user's previous one for the time between."""
    e = C.in_order(events.where("event_type = 'login_attempt' and auth_result = 'success'"), "user_id")
    order = Window.partitionBy("user_id").orderBy("ok")
    minutes = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 6e7
    km = C.haversine_km(F.lag("geo_lat").over(order), F.lag("geo_lon").over(order), F.col("geo_lat"), F.col("geo_lon"))
    e = e.select("record_id", "user_id", minutes.alias("minutes"), km.alias("km"))
    e = e.withColumn("kmh", F.col("km") / F.greatest(F.col("minutes") / 60, F.lit(1 / 60)))
    return e.where(F.col("minutes").between(least_min, most_min) & F.col("km").between(least_km, most_km) & (F.col("kmh") >= least_kmh))


def credential_misuse(events: DataFrame, users: DataFrame, home: DataFrame) -> DataFrame:
    """Successful logins that reach a resource both outside the department and above the user's privilege."""
    e = with_home(events.where("auth_result = 'success'"), users, home).join(users.select("user_id", "privilege_level"), "user_id")
    needed = C.lookup(C.LEAST_PRIVILEGE, F.col("resource_accessed"))
    above = C.privilege_rank(needed) > C.privilege_rank(F.col("privilege_level"))
    return e.where("foreign").where(above).select("record_id", "user_id", "resource_accessed", "privilege_level", needed.alias("needs"))


def lateral_movement(events: DataFrame, users: DataFrame, home: DataFrame, resources: int = 2, least_s: float = 2, most_s: float = 20) -> DataFrame:
    """Sessions over several foreign resources in quick hops, never to a lower value tier."""
    e = with_home(events.where("resource_accessed is not null"), users, home).where("foreign")
    tier = C.lookup(C.TIERS, F.col("resource_accessed"))
    step = F.struct(F.unix_micros("ts").alias("t"), "record_id", tier.alias("tier"), F.col("resource_accessed").alias("res"))
    s = e.groupBy("user_id", "session_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))  # one session's events
    pairs = F.filter(F.transform("steps", lambda x, i: F.struct(((x["t"] - F.get("steps", i - 1)["t"]) / 1e6).alias("hop"), (x["tier"] - F.get("steps", i - 1)["tier"]).alias("up"))), lambda p: p["hop"].isNotNull())
    n = F.size(F.array_distinct(F.transform("steps", lambda x: x["res"])))
    s = s.select("user_id", "session_id", n.cast("long").alias("resources"), pairs.alias("pairs"))
    return s.where(F.col("resources") >= resources).where(F.forall("pairs", lambda p: p["hop"].between(least_s, most_s) & (p["up"] >= 0))).drop("pairs")


def fingerprint_changes(events: DataFrame) -> DataFrame:
    """Events whose device shows another (type, os) than at first."""
    e = C.in_order(events, "device_id")
    first = F.first(F.struct("device_type", "os")).over(Window.partitionBy("device_id").orderBy("ok").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("was", first).where(~F.struct("device_type", "os").eqNullSafe(F.col("was")))
    return e.select("record_id", "device_id", "device_type", "os", F.col("was.device_type").alias("first_type"), F.col("was.os").alias("first_os"))


def device_reuse(events: DataFrame, least_min: float = 10, most_min: float = 240, shared: str = "DEV-KIOSK-%") -> DataFrame:
    """A device of one user so far, not a shared one, taken up by a second user."""
    e = C.in_order(events.where(~F.col("device_id").like(shared)), "device_id")
    order = Window.partitionBy("device_id").orderBy("ok")
    owners = F.collect_set("user_id").over(C.ever_before("device_id"))
    minutes = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 6e7
    e = e.select("record_id", "device_id", F.lag("user_id").over(order).alias("owner"), "user_id", minutes.alias("minutes"), F.size(owners).alias("n"))
    return e.where("n = 1 and owner <> user_id").where(F.col("minutes").between(least_min, most_min)).drop("n")


def device_index(events: DataFrame) -> DataFrame:
    """A row per device: first signature, users, latest event."""
    e = C.in_order(events, "device_id")
    out = e.groupBy("device_id").agg(F.min_by(F.struct("device_type", "os"), "ok").alias("first"), F.count_distinct("user_id").alias("users"), F.max_by("record_id", "ok").alias("last_record"), F.count(F.lit(1)).alias("events"))
    return out.select("device_id", F.col("first.device_type").alias("first_type"), F.col("first.os").alias("first_os"), "users", "last_record", "events")


def severity(success: Column, large: Column, top_tier: Column) -> Column:
    """By outcome: each of success, a large number of events and a top-tier resource raises it one step."""
    steps = success.cast("int") + large.cast("int") + top_tier.cast("int")
    return F.get(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]), steps)


def rationale(bursts: DataFrame) -> DataFrame:
    """A sentence per burst."""
    text = F.format_string("%d failed logins within %.1f minutes on account %s%s.", "attempts", "minutes", F.col("user_id").cast("string"), F.when(F.col("succeeded"), ", ending in a success").otherwise(""))
    return bursts.withColumn("rationale", text)


#: What a campaign's parameters hold, as JSON.
PARAMETERS = "failures long, accounts long, devices long, signatures long, countries array<string>, resources array<string>"


def campaign_parameters(events: DataFrame) -> DataFrame:
    """(attack_id, parameters: JSON) from the campaigns' events; lists are sorted."""
    sorted_set = lambda c: F.sort_array(F.collect_set(c))
    per = events.groupBy("attack_id").agg(
        F.count_if(F.col("auth_result") == "failure").alias("failures"), F.count_distinct("user_id").alias("accounts"), F.count_distinct("device_id").alias("devices"),
        F.count_distinct(F.struct("device_id", "device_type", "os")).alias("signatures"), sorted_set("geo_country").alias("countries"), sorted_set("resource_accessed").alias("resources"),
    )
    return per.select("attack_id", F.to_json(F.struct("failures", "accounts", "devices", "signatures", "countries", "resources")).alias("parameters"))


def campaign_rationale(campaigns: DataFrame) -> DataFrame:
    """campaigns (attack_type, parameters) with what the parameters say, and a sentence. Parameters that aren't JSON say nothing:
    null numbers, empty lists, and a sentence that says so."""
    p = F.from_json("parameters", PARAMETERS)
    held = campaigns.withColumns({c: p[c] for c in ("failures", "accounts", "devices", "signatures")} | {c: F.coalesce(p[c], F.array().cast("array<string>")) for c in ("countries", "resources")})
    listed = lambda c: F.array_join(c, ", ")
    kind = F.col("attack_type")
    text = (
        F.when(F.col("failures").isNull(), "No parameters on record.")
        .when(kind == "brute_force", F.format_string("%d failed logins on %d accounts.", "failures", "accounts"))
        .when(kind == "impossible_travel", F.format_string("Logins from %d countries: %s.", F.size("countries"), listed("countries")))
        .when(kind == "device_spoofing", F.format_string("%d devices showed %d signatures.", "devices", "signatures"))
        .when(kind == "lateral_movement", F.format_string("%d resources in one chain: %s.", F.size("resources"), listed("resources")))
        .otherwise(F.format_string("%d accounts reached: %s.", "accounts", listed("resources")))
    )
    return held.withColumn("rationale", text)


def with_techniques(rows: DataFrame, tactics: DataFrame) -> DataFrame:
    """rows (attack_type) with tactic, tactic_id and technique_ids; the mapping has five rows."""
    return rows.join(F.broadcast(tactics), "attack_type", "left")
