"""Analyst queries over flagged events: filters, posture, campaigns, timelines, evidence, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions import columns as C

# Actions each tactic supports, and control ids of actions.
TACTIC_ACTIONS = {
    "Credential Access": ("require_mfa", "reset_password"),
    "Initial Access": ("require_mfa",),
    "Privilege Escalation": ("disable_account", "escalate_soc"),
    "Lateral Movement": ("disable_account", "escalate_soc"),
    "Defense Evasion": ("block_device", "escalate_soc"),
}
# Features far from the user's own norm, as evidence: category, strength, actions.
OWN = {
    "failed_login_ratio": ("login_failure", 2, ("reset_password", "disable_account")),
    "ema_failure_rate": ("login_failure", 2, ("reset_password",)),
    "geo_distance_from_home_km": ("geo", 2, ("require_mfa",)),
    "access_chain_distance": ("access", 2, ("escalate_soc", "disable_account")),
    "user_device_set_delta": ("device", 1, ("block_device", "require_mfa")),
}
CONTROLS = {
    "disable_account": "NIST CSF: PR.AC-1, RS.MI-1; CIS Controls v8: 5.3",
    "require_mfa": "NIST CSF: PR.AC-7; CIS Controls v8: 6.3, 6.5",
    "reset_password": "NIST CSF: PR.AC-1; CIS Controls v8: 5.2",
    "block_device": "NIST CSF: PR.PT-1, DE.CM-1; CIS Controls v8: 13.1",
    "escalate_soc": "NIST CSF: DE.CM-3, RS.AN-1; CIS Controls v8: 17.4, 8.11",
}


def detail(events: DataFrame, labels: DataFrame, users: DataFrame, tactics: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The wide event table: log, labels, people, tactic and, if given, features. Dimensions may be broadcast."""
    out = events.join(labels, "record_id", "left").join(users, "user_id", "left").join(F.broadcast(tactics), "attack_type", "left")
    return out if features is None else out.join(features, "record_id", "left")


def full_detail(events: DataFrame, labels: DataFrame, users: DataFrame, attacks: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """A row per event: the log, labels, people, the campaign, features, and a model's score and predicted class."""
    out = events.join(labels, "record_id", "left").join(users, "user_id", "left").join(attacks, "attack_id", "left")
    return out.join(features, "record_id", "left").join(scores, "record_id", "left")


def where_in(detail: DataFrame, start=None, end=None, user: str | None = None, **lists: list[str]) -> DataFrame:
    """Conjunction of lists (empty: all), an inclusive time range, and part of a user id in any case (null: no)."""
    for column, values in lists.items():
        if values:
            detail = detail.where(F.col(column).isin(*values))
    if start is not None:
        detail = detail.where(F.col("ts") >= F.lit(start))
    if end is not None:
        detail = detail.where(F.col("ts") <= F.lit(end))
    if user:
        detail = detail.where(F.coalesce(F.contains(F.lower(F.col("user_id").cast("string")), F.lit(user.lower())), F.lit(False)))
    return detail


def flagged(detail: DataFrame, threshold: float) -> DataFrame:
    return detail.where(F.col("score") >= threshold)


def threat_level(rows: DataFrame) -> DataFrame:
    out = rows.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count(F.lit(1)).alias("flagged"),
        F.count_distinct("attack_id").alias("campaigns"), F.count_distinct("device_id").alias("devices"), F.count_distinct("tactic").alias("tactics"), F.max("ts").alias("latest"),
    )
    level = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "ELEVATED").when(F.col("flagged") > 0, "GUARDED").otherwise("LOW")
    return out.withColumn("level", level)


def posture(rows: DataFrame) -> DataFrame:
    """One row: counts, the most frequent attack type (first by name on ties), the department of highest mean score."""
    counts = rows.agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_severity"), F.count_distinct("user_id").alias("users"), F.count_distinct("department").alias("departments"))
    top = lambda df, name: df.orderBy(F.col("m").desc(), name).limit(1).select(F.col(name).alias(f"top_{name}"))
    kind = top(rows.where("attack_type is not null").groupBy("attack_type").agg(F.count(F.lit(1)).alias("m")), "attack_type")
    dept = top(rows.groupBy("department").agg(F.round(F.avg("score"), 9).alias("m")), "department")
    return counts.join(F.broadcast(kind), how="left").join(F.broadcast(dept), how="left")


def score_percentile(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """record_id, score, and the share of rows strictly below, from counts of distinct scores; of asked rows only, if given."""
    per = C.running(rows.groupBy("score").agg(F.count(F.lit(1)).alias("c")), [], [F.col("score")], {"upto": "c"})
    total = per.agg(F.sum("c").alias("all"))  # one row
    per = per.join(F.broadcast(total)).select(F.col("score").alias("s"), ((F.col("upto") - F.col("c")) / F.col("all")).alias("percentile"))
    return (rows if asked is None else asked).join(per, F.col("score") == F.col("s")).select("record_id", "score", "percentile")


def prior_events(events: DataFrame, *keep: str) -> DataFrame:
    """Events of the user strictly earlier in time, equal times left out; fewer than 5 are a thin history. keep: columns that stay."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    out = events.select("record_id", *keep, F.count(F.lit(1)).over(w).alias("prior_events"))
    return out.withColumn("thin", F.col("prior_events") < 5)


def user_deviation(rows: DataFrame, names: list[str], asked: DataFrame | None = None) -> DataFrame:
    """Per record and feature, its z against the user's other events: from the user's sums, without a scan
    per row. Clipped to +-5; 0 where the others don't vary; users with fewer than 3 events are left out. asked: those of
    the rows to return, if not all."""
    sums = [f(c).alias(f"{p}_{c}") for c in names for p, f in (("s", F.sum), ("q", lambda c: F.sum(F.col(c) * F.col(c))))]
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *sums).where("n >= 3")
    joined = (rows if asked is None else asked).select("record_id", "user_id", *names).join(per, "user_id")
    m = F.col("n") - 1

    def z(c: str) -> Column:
        s, q = F.col(f"s_{c}") - F.col(c), F.col(f"q_{c}") - F.col(c) * F.col(c)
        std = F.sqrt(F.greatest((q - s * s / m) / (m - 1), F.lit(0.0)))
        return F.when(std > 1e-6, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(c) - s / m) / std))).otherwise(F.lit(0.0))

    return joined.select("record_id", *(z(c).alias(c) for c in names))


def top_deviations(deviation: DataFrame, names: list[str], least: float = 1.5, most: int = 4) -> DataFrame:
    parts = F.array(*(F.struct((-F.abs(F.col(c))).alias("o"), F.lit(c).alias("feature"), F.col(c).alias("z")) for c in names))
    far = F.slice(F.sort_array(F.filter(parts, lambda p: F.abs(p["z"]) >= least)), 1, most)
    return deviation.select("record_id", F.transform(far, lambda p: F.struct(p["feature"], p["z"])).alias("top"))


def drift_profile(deviation: DataFrame, names: list[str]) -> DataFrame:
    """(record_id, drift, drifted, typical_place, top): mean size of the deviations from the user's norm, whether it is one or
    more, whether the place is within 1.5, and the largest deviations."""
    drift = sum((F.abs(F.col(n)) for n in names), F.lit(0.0)) / len(names)
    place = F.abs(F.col("geo_distance_from_home_km")) < 1.5
    return deviation.select("record_id", drift.alias("drift"), (drift >= 1).alias("drifted"), place.alias("typical_place")).join(top_deviations(deviation, names), "record_id")


def evidence_sentences(rows: DataFrame) -> DataFrame:
    """rows (is_new_edge, velocity_kmh, geo_distance_from_home_km, prior_events) with what stands out, or a fallback."""
    fast = F.col("velocity_kmh") > 800
    said = F.array_compact(
        F.array(
            F.when(F.col("is_new_edge") > 0.5, F.lit("First use of this device by the account within the window.")),
            F.when(fast, F.concat(F.lit("Reaching this place took "), F.format_number(F.col("velocity_kmh"), 0), F.lit(" km/h.")))
            .when(F.col("geo_distance_from_home_km") > 1000, F.concat(F.lit("The place lies "), F.format_number(F.col("geo_distance_from_home_km"), 0), F.lit(" km away from home."))),
            F.when(F.col("prior_events") < 5, F.concat(F.lit("Only "), F.col("prior_events").cast("string"), F.lit(" earlier events are known."))),
        )
    )
    return rows.withColumn("evidence", F.when(F.size(said) == 0, F.array(F.lit("Nothing stands out by itself."))).otherwise(said))


def timeline(events: DataFrame, alerts: DataFrame, last: int = 6) -> DataFrame:
    """For each alert (record_id) the user's last events up to it, newest first, with device and country changes."""
    e = C.in_order(events, "user_id")
    order = Window.partitionBy("user_id").orderBy("ok")
    changed = lambda c: F.coalesce(F.lag(c).over(order) != F.col(c), F.lit(False))
    e = e.select("user_id", "record_id", "ok", changed("device_id").alias("new_device"), changed("geo_country").alias("new_country"), F.row_number().over(order).alias("nth"))
    a = e.join(alerts.select("record_id"), "record_id", "left_semi").select("user_id", F.col("record_id").alias("alert"), F.col("nth").alias("at"))
    rows = a.withColumn("nth", F.explode(F.sequence(F.greatest(F.col("at") - last + 1, F.lit(1)), F.col("at")))).join(e, ["user_id", "nth"])
    return rows.select("alert", (F.col("at") - F.col("nth") + 1).alias("back"), "record_id", "new_device", "new_country")


def evidence(rows: DataFrame) -> DataFrame:
    """record_id with evidence: array of (category, strength, actions). rows needs percentile, severity,
    tactic, privilege_level, prior_alerts, failed_login_ratio, velocity_kmh, is_new_edge, and z_ with each of
    OWN: how far the feature lies from the user's other events, null where there are too few."""

    def one(cond: Column, category: str, strength: int, *actions: str) -> Column:
        return F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(strength).alias("strength"), F.array(*map(F.lit, actions)).alias("actions")))

    p, s = F.col("percentile"), F.col("severity")
    signs = [
        one(p >= 0.99, "score", 3, "disable_account", "escalate_soc", "require_mfa"),
        one((p >= 0.9) & (p < 0.99), "score", 2, "require_mfa", "escalate_soc"),
        one(s == "critical", "severity", 3, "disable_account", "escalate_soc"),
        one(s == "high", "severity", 2, "escalate_soc", "require_mfa"),
        one(F.col("failed_login_ratio") > 0.5, "login_failure", 2, "reset_password", "disable_account"),
        one(F.col("velocity_kmh") > 800, "geo", 3, "require_mfa", "disable_account", "escalate_soc"),
        one(F.col("is_new_edge") > 0.5, "device", 2, "require_mfa", "block_device"),
        *(one(F.col(f"z_{n}") >= 2, category, strength, *supported) for n, (category, strength, supported) in OWN.items()),
        *(one(F.col("tactic") == t, "mitre", 2, *a) for t, a in TACTIC_ACTIONS.items()),
        one(F.col("privilege_level").isin("admin", "domain_admin"), "privilege", 2, "disable_account", "escalate_soc"),
        one(F.col("prior_alerts") > 0, "history", 2, "escalate_soc", "disable_account"),
    ]
    return rows.select("record_id", F.array_compact(F.array(*signs)).alias("evidence"))


def actions(found: DataFrame) -> DataFrame:
    """(record_id, action, score, categories, recommended, priority, confidence, place, controls): an action
    needs two kinds of evidence; others are listed as not recommended."""
    rows = found.select("record_id", F.inline("evidence")).select("record_id", "category", "strength", F.explode("actions").alias("action"))
    per = rows.groupBy("record_id", "action").agg(F.sum("strength").alias("score"), F.count_distinct("category").alias("categories"))
    grade = lambda c, high, mid: F.when(F.col(c) >= high, "High").when(F.col(c) >= mid, "Medium").otherwise("Low")
    ok = F.col("categories") >= 2
    per = per.withColumns({"recommended": ok, "priority": F.when(ok, grade("score", 6, 3)), "confidence": F.when(ok, grade("categories", 4, 3))})
    place = F.row_number().over(Window.partitionBy("record_id", "recommended").orderBy(F.col("score").desc(), "action"))
    return per.withColumn("place", place).withColumn("controls", C.lookup(CONTROLS, F.col("action")))


def reliability(report: DataFrame) -> DataFrame:
    """A note per class of a class report: thin support, low precision, or ok."""
    note = F.when(F.col("support") < 10, "thin").when(F.col("precision") < 0.5, "low precision").otherwise("ok")
    return report.withColumn("note", note)


def prior_alerts(detail: DataFrame, threshold: float) -> DataFrame:
    """Per event, other flagged events of its user."""
    hit = (F.col("score") >= threshold).cast("long")
    per = detail.groupBy("user_id").agg(F.sum(hit).alias("n"))
    return detail.join(per, "user_id").select("record_id", (F.col("n") - hit).alias("prior_alerts"))


def user_profile(events: DataFrame, least: int = 5) -> DataFrame:
    """Per user: events, the three most used devices, the usual hour (smallest on ties; null below least events)."""
    rank = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "device_id")
    d = events.groupBy("user_id", "device_id").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(rank)).where("r <= 3")
    d = d.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "device_id"))), lambda x: x["device_id"]), ",").alias("devices"))
    h = events.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    h = h.groupBy("user_id").agg(F.sum("n").alias("events"), F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"))
    return d.join(h, "user_id").withColumn("hour", F.when(F.col("events") >= least, F.col("hour")))


def hour_gap(a: Column, b: Column) -> Column:
    """Hours between two times of day, the short way round."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def entity_edges(rows: DataFrame, most: int = 150) -> DataFrame:
    """Edges user-device (with the newest flag) and user-resource of the top flagged events."""
    top = rows.orderBy(F.col("score").desc(), "record_id").limit(most)
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    dev = top.groupBy(user.alias("src"), F.concat(F.lit("device:"), "device_id").alias("dst")).agg(F.max_by("is_attack", F.struct("ts", "record_id")).alias("anomalous"))
    res = top.where("resource_accessed is not null").select(user.alias("src"), F.concat(F.lit("resource:"), "resource_accessed").alias("dst")).distinct()
    return dev.unionByName(res.withColumn("anomalous", F.lit(None).cast("boolean")))


def node_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.sort_array(F.collect_set("other")), ",").alias("neighbours"))


def node_flags(rows: DataFrame) -> DataFrame:
    """(node, flagged): flagged events at each user, device and resource."""
    named = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), F.col(c).cast("string")))
    nodes = F.array_compact(F.array(named("user:", "user_id"), named("device:", "device_id"), named("resource:", "resource_accessed")))
    return rows.select(F.explode(nodes).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("flagged"))


def campaigns(rows: DataFrame, threshold: float) -> DataFrame:
    hit = F.count_if(F.col("score") >= threshold)
    n = F.count(F.lit(1))
    return rows.where("attack_id is not null").groupBy("attack_id").agg(
        F.min("attack_type").alias("attack_type"), F.min("severity").alias("severity"), n.alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("department").alias("departments"),
        F.count_distinct("device_id").alias("devices"), F.min("ts").alias("start"), F.max("ts").alias("end"), hit.alias("detected"), (hit / n).alias("rate"),
    )


def techniques(rows: DataFrame) -> DataFrame:
    return rows.where("technique_ids is not null").select("tactic", F.explode(C.split_list(F.col("technique_ids"))).alias("technique")).groupBy("tactic", "technique").agg(F.count(F.lit(1)).alias("n"))


def severity_by_department(rows: DataFrame) -> DataFrame:
    return rows.groupBy("department").pivot("severity", ["low", "medium", "high", "critical"]).agg(F.count(F.lit(1))).na.fill(0)


def driver_table(parts: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """parts (record_id, feature, contribution) with the observed value, the mean of the user's other events
    (null for a single one), the direction, and the sum of the record's contributions."""
    long = rows.select("record_id", "user_id", *names).unpivot(["record_id", "user_id"], names, "feature", "observed")
    per = long.groupBy("user_id", "feature").agg(F.sum("observed").alias("s"), F.count("observed").alias("n"))
    seen = long.join(parts.select("record_id").distinct(), "record_id", "left_semi").join(per, ["user_id", "feature"])
    norm = F.try_divide(F.col("s") - F.col("observed"), F.col("n") - 1)
    total = F.sum("contribution").over(Window.partitionBy("record_id"))
    out = parts.join(seen, ["record_id", "feature"]).withColumns({"norm": norm, "direction": F.when(F.col("contribution") >= 0, "up").otherwise("down"), "total": total})
    return out.select("record_id", "feature", "observed", "norm", "contribution", "direction", "total")


def event_techniques(rows: DataFrame, *record_ids: int) -> DataFrame:
    """Tactic and techniques of single events, a row per technique."""
    picked = rows.where(F.col("record_id").isin(*record_ids)) if record_ids else rows
    return picked.where("technique_ids is not null").select("record_id", "tactic", F.explode(C.split_list(F.col("technique_ids"))).alias("technique"))
