"""Registered queries over the adapter views, and DuckDB statements that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.operators import analyst, behaviour, boosting, detectors, evaluate, explain, graph, learn, schema
from authspan.sources.adapter import ORACLE, Log
from authspan.sources.scratch import materialised

FLAGSHIP = "rule_risk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Oracles without the adapter views, for use within others.
PARTS: dict[str, str] = {}

DAYS = 7
THRESHOLD = 0.7
REACH = DAYS * C.DAY_US * C.TIES + C.TIES - 1


def query(oracle: str | None = None):
    """Registers a function of a Log under its name; the oracle goes on after the adapter views."""

    def add(build: Callable[[Log], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Log(spark, sf_dir))
        if oracle:
            ORACLES[build.__name__], PARTS[build.__name__] = ORACLE + oracle, oracle
        return build

    return add


def part(name: str, of: str) -> str:
    """Another query's oracle as a common table expression."""
    return f"{name} AS (WITH none_ AS (SELECT 1) {PARTS[of]})"


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def ok(key: str, order: str = "record_id") -> str:
    return f"epoch_us(ts) * 1024 + row_number() OVER (PARTITION BY {key}, ts ORDER BY {order}) - 1"


def past(key: str, days: float = DAYS, name: str = "w") -> str:
    return f"{name} AS (PARTITION BY {key} ORDER BY ok RANGE BETWEEN {int(days * C.DAY_US) * 1024 + 1023} PRECEDING AND 1 PRECEDING)"


KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


def km(a: str, b: str, c: str, d: str) -> str:
    return KM.format(a, b, c, d)


# --- rules and detectors -----------------------------------------------------------------------


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok FROM ev)
, f AS (SELECT record_id, CAST(coalesce(sum(CASE WHEN auth_result = 'failure' THEN 1 ELSE 0 END) OVER w, 0) >= 5 AS INT) AS burst,
  CAST(row_number() OVER (PARTITION BY user_id, geo_country ORDER BY ok) = 1 AS INT) AS new_country, CAST(is_off_hours AS INT) AS off_hours FROM e WINDOW {past("user_id", 3)})
SELECT *, burst + new_country + off_hours AS risk, burst + new_country + off_hours >= 2 AS anomaly FROM f""")
def rule_risk(log: Log) -> DataFrame:
    out = detectors.rule_risk(log.events, minutes=3 * 1440, failures=5)
    return out.withColumn("anomaly", detectors.is_anomaly(F.col("risk")))


@query(f"""
, e AS (SELECT *, {ok("session_id")} AS ok FROM ev WHERE auth_result IS NOT NULL)
, g AS (SELECT user_id, session_id, count_if(auth_result = 'failure') AS attempts, min(CASE WHEN auth_result = 'failure' THEN epoch_us(ts) END) AS a,
  max(CASE WHEN auth_result = 'failure' THEN epoch_us(ts) END) AS b, max_by(auth_result, ok) = 'success' AS succeeded FROM e GROUP BY user_id, session_id)
SELECT user_id, session_id, CAST(attempts AS BIGINT) AS attempts, succeeded, round((b - a) / 6e7, 6) AS minutes,
  format('{{}} failed logins within {{:.1f}} minutes on account {{}}{{}}.', attempts, (b - a) / 6e7, user_id, CASE WHEN succeeded THEN ', ending in a success' ELSE '' END) AS rationale
FROM g WHERE attempts >= 3""")
def failed_bursts(log: Log) -> DataFrame:
    return r6(detectors.rationale(detectors.failed_bursts(log.events, failures=3, least_min=0, most_min=1e9)), "minutes")


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok FROM ev WHERE event_type = 'login_attempt' AND auth_result = 'success')
, p AS (SELECT *, lag(ts) OVER o AS t0, lag(geo_lat) OVER o AS la, lag(geo_lon) OVER o AS lo FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ok))
, q AS (SELECT record_id, user_id, (epoch_us(ts) - epoch_us(t0)) / 6e7 AS minutes, {km("la", "lo", "geo_lat", "geo_lon")} AS km FROM p)
SELECT record_id, user_id, round(minutes, 3) AS minutes, round(km, 3) AS km, round(km / greatest(minutes / 60, 1.0 / 60), 3) AS kmh
FROM q WHERE minutes BETWEEN 0 AND 10080 AND km BETWEEN 500 AND 30000""")
def impossible_travel(log: Log) -> DataFrame:
    out = detectors.impossible_travel(log.events, 0, 7 * 1440, 500, 30_000, 0)
    return out.withColumns({c: F.round(c, 3) for c in ("minutes", "km", "kmh")})  # the engines' sines differ in the last bit


@query("""
, e AS (SELECT ev.*, us.privilege_level, home.resources FROM ev JOIN us USING (user_id) LEFT JOIN home USING (department) WHERE auth_result = 'success' AND resource_accessed IS NOT NULL)
, n AS (SELECT *, CASE resource_accessed WHEN 'hr_system' THEN 'elevated' WHEN 'admin_console' THEN 'admin' ELSE 'standard' END AS needs FROM e)
SELECT record_id, user_id, resource_accessed, privilege_level, needs FROM n
WHERE NOT list_contains(string_split(coalesce(resources, 'email,vpn'), ','), resource_accessed)
  AND list_position(['standard', 'elevated', 'admin', 'domain_admin'], needs) > list_position(['standard', 'elevated', 'admin', 'domain_admin'], privilege_level)""")
def credential_misuse(log: Log) -> DataFrame:
    return detectors.credential_misuse(log.events, log.users, log.home)


FOREIGN = """e0 AS (SELECT ev.*, us.department, us.department IS NOT NULL AND resource_accessed IS NOT NULL
  AND NOT list_contains(string_split(coalesce(home.resources, 'email,vpn'), ','), resource_accessed) AS is_foreign FROM ev LEFT JOIN us USING (user_id) LEFT JOIN home USING (department))"""
TIER = "CASE resource_accessed WHEN 'email' THEN 0 WHEN 'vpn' THEN 0 WHEN 'hr_system' THEN 2 WHEN 'admin_console' THEN 3 ELSE 1 END"


@query(f"""
, {FOREIGN}, f AS (SELECT *, {TIER} AS tier, {TIER} - lag({TIER}) OVER o AS up FROM e0 WHERE is_foreign WINDOW o AS (PARTITION BY user_id, session_id ORDER BY ts, record_id))
SELECT user_id, session_id, count(DISTINCT resource_accessed) AS resources FROM f GROUP BY user_id, session_id
HAVING count(DISTINCT resource_accessed) >= 2 AND coalesce(min(up), 0) >= 0""")
def lateral_movement(log: Log) -> DataFrame:
    return detectors.lateral_movement(log.events, log.users, log.home, least_s=0, most_s=1e12)


@query(f"""
, e AS (SELECT *, {ok("device_id")} AS ok FROM ev)
, f AS (SELECT *, first_value(device_type) OVER o AS first_type, first_value(os) OVER o AS first_os FROM e WINDOW o AS (PARTITION BY device_id ORDER BY ok))
SELECT record_id, device_id, device_type, os, first_type, first_os FROM f WHERE device_type IS DISTINCT FROM first_type OR os IS DISTINCT FROM first_os""")
def fingerprint_changes(log: Log) -> DataFrame:
    return detectors.fingerprint_changes(log.events)


@query(f"""
, e AS (SELECT *, {ok("device_id")} AS ok FROM ev WHERE device_id NOT LIKE 'DEV-KIOSK-%')
, f AS (SELECT record_id, device_id, lag(user_id) OVER o AS owner, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 6e7 AS minutes,
  len(list_distinct(list(user_id) OVER (PARTITION BY device_id ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS n FROM e WINDOW o AS (PARTITION BY device_id ORDER BY ok))
SELECT record_id, device_id, owner, user_id, round(minutes, 6) AS minutes FROM f WHERE n = 1 AND owner <> user_id""")
def device_reuse(log: Log) -> DataFrame:
    return r6(detectors.device_reuse(log.events, 0, 1e12), "minutes")


@query(f"""
, e AS (SELECT *, {ok("device_id")} AS ok FROM ev)
SELECT device_id, min_by(device_type, ok) AS first_type, min_by(os, ok) AS first_os, count(DISTINCT user_id) AS users, max_by(record_id, ok) AS last_record, count(*) AS events FROM e GROUP BY device_id""")
def device_index(log: Log) -> DataFrame:
    return detectors.device_index(log.events)


@query("""
, s AS (SELECT record_id, attack_type, auth_result = 'success' AS ok1, value_large AS ok2, resource_accessed = 'admin_console' AS ok3
  FROM (SELECT ev.*, lb.attack_type, score >= 0.5 AS value_large FROM ev JOIN lb USING (record_id) WHERE is_attack) z)
SELECT record_id, s.attack_type, ['low', 'medium', 'high', 'critical'][1 + CAST(coalesce(ok1, false) AS INT) + CAST(ok2 AS INT) + CAST(coalesce(ok3, false) AS INT)] AS rated, tactic, tactic_id, technique_ids
FROM s LEFT JOIN tac USING (attack_type)""")
def rated_attacks(log: Log) -> DataFrame:
    rows = log.events.join(log.labels.where("is_attack"), "record_id")
    no = lambda c: F.coalesce(c, F.lit(False))
    rated = detectors.severity(no(F.col("auth_result") == "success"), F.col("score") >= 0.5, no(F.col("resource_accessed") == "admin_console"))
    return detectors.with_techniques(rows.select("record_id", "attack_type", rated.alias("rated")), log.tactics).select("record_id", "attack_type", "rated", "tactic", "tactic_id", "technique_ids")


# --- features -----------------------------------------------------------------------------------


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok FROM ev)
, s AS (SELECT *, CASE WHEN lag(device_id) OVER o <> device_id THEN 1 ELSE 0 END AS sw, lag(geo_lat) OVER o AS la, lag(geo_lon) OVER o AS lo, lag(ts) OVER o AS t0, lag(ok) OVER o AS ok0
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ok))
, m AS (SELECT record_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(CASE WHEN auth_result = 'failure' THEN 1 ELSE 0 END AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ok ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)), lambda a, x: 0.9 * a + 0.1 * x) AS ema
  FROM s WHERE event_type = 'login_attempt' AND auth_result IS NOT NULL)
, t AS (SELECT s.*, m.ema FROM s LEFT JOIN m USING (record_id))
, f AS (SELECT record_id, user_id, geo_lat, geo_lon,
  CASE WHEN ok0 >= ok - {REACH} THEN {km("la", "lo", "geo_lat", "geo_lon")} / greatest((epoch_us(ts) - epoch_us(t0)) / 3.6e9, 1.0 / 60) ELSE 0 END AS velocity,
  coalesce(list_entropy(list(geo_city) OVER w), 0) AS ent,
  CASE WHEN count(*) OVER w >= 2 THEN (sum(sw) OVER w - first_value(sw) OVER w) / (count(*) OVER w - 1.0) ELSE 0 END AS switch,
  coalesce(sum(CASE WHEN event_type = 'login_attempt' AND auth_result = 'failure' THEN 1.0 ELSE 0 END) OVER w / nullif(sum(CASE WHEN event_type = 'login_attempt' THEN 1.0 ELSE 0 END) OVER w, 0), 0) AS failed,
  coalesce(last_value(ema IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ema0
  FROM t WINDOW {past("user_id")})
SELECT record_id, round(velocity, 3) AS velocity_kmh, round(ent, 6) AS login_location_entropy, round(CAST(switch AS DOUBLE), 6) AS device_switch_rate, round(CAST(failed AS DOUBLE), 6) AS failed_login_ratio,
  round(ema0, 6) AS ema_failure_rate, round(coalesce({km("home_lat", "home_lon", "geo_lat", "geo_lon")}, 0), 3) AS geo_distance_from_home_km
FROM f LEFT JOIN us USING (user_id)""")
def behaviour_features(log: Log) -> DataFrame:
    out = behaviour.behaviour(log.events, log.users, DAYS)
    far = ("velocity_kmh", "geo_distance_from_home_km")
    return r6(out, *[c for c in out.columns if c not in ("record_id", *far)]).withColumns({c: F.round(c, 3) for c in far})


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok, CAST(is_off_hours AS DOUBLE) AS x FROM ev)
, u AS (SELECT record_id, user_id, ts, x, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x) OVER (PARTITION BY user_id ORDER BY ok ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING)), lambda a, b: 0.9 * a + 0.1 * b) AS own,
  row_number() OVER (PARTITION BY user_id ORDER BY ok) = 1 AS fresh FROM e)
, d AS (SELECT u.*, department, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x) OVER (PARTITION BY department ORDER BY ts, record_id ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING)), lambda a, b: 0.9 * a + 0.1 * b) AS theirs,
  coalesce(sum(CAST(fresh AS INT)) OVER (PARTITION BY department ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS members FROM u JOIN us USING (user_id))
SELECT record_id, round(CASE WHEN members >= 5 THEN abs(coalesce(own, 0) - coalesce(theirs, 0)) ELSE 0 END, 6) AS peer_group_deviation FROM d""")
def peer_deviation(log: Log) -> DataFrame:
    return r6(behaviour.peer_deviation(log.events, log.users), "peer_group_deviation")


@query(f"""
, e AS (SELECT *, {ok("device_id")} AS ok FROM ev)
SELECT record_id, CAST(coalesce(len(list_distinct(list(user_id) OVER w)), 0) AS DOUBLE) AS device_fan_in,
  CAST(device_type IS DISTINCT FROM first_value(device_type) OVER o OR os IS DISTINCT FROM first_value(os) OVER o AS DOUBLE) AS device_fingerprint_mismatch
FROM e WINDOW {past("device_id")}, o AS (PARTITION BY device_id ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def device_features(log: Log) -> DataFrame:
    return graph.device_features(log.events, DAYS).withColumn("device_fingerprint_mismatch", F.col("device_fingerprint_mismatch").cast("double"))


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok FROM ev)
, l AS (SELECT record_id, device_id, coalesce(list(device_id) OVER (PARTITION BY user_id ORDER BY ok ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING), []) AS past FROM e)
, x AS (SELECT record_id, device_id, len(past) AS n, unnest(list_concat(past, [NULL])) AS d, generate_subscripts(list_concat(past, [NULL]), 1) AS i FROM l)
SELECT record_id, round(CASE WHEN min(n) = 0 THEN 1.0 ELSE 1 - sum(CASE WHEN d = device_id THEN 0.15 * pow(0.85, n - i) ELSE 0 END) / (1 - pow(0.85, min(n))) END, 6) AS user_device_set_delta FROM x GROUP BY record_id""")
def device_set_delta(log: Log) -> DataFrame:
    return r6(graph.device_set_delta(log.events), "user_device_set_delta")


@query(f"""
, {FOREIGN}, e AS (SELECT *, {ok("session_id")} AS ok FROM e0)
SELECT record_id, CAST(coalesce(len(list_distinct(list(resource_accessed) FILTER (WHERE is_foreign) OVER b)), 0) AS DOUBLE) AS session_foreign_resource_count,
  round(coalesce((epoch_us(ts) - last_value(CASE WHEN resource_accessed IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b) / 1e6, 3600), 6) AS session_hop_seconds
FROM e WINDOW b AS (PARTITION BY session_id ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def session_features(log: Log) -> DataFrame:
    return r6(graph.session_features(log.events, log.users, log.home), "session_hop_seconds")


TRANSITIONS = f"""tr0 AS (SELECT ev.*, department, {ok("session_id")} AS ok FROM ev JOIN us USING (user_id) WHERE resource_accessed IS NOT NULL)
, tr AS (SELECT record_id, department, src, resource_accessed AS dst, ts FROM (SELECT *, lag(resource_accessed) OVER (PARTITION BY session_id ORDER BY ok) AS src FROM tr0) z WHERE src <> resource_accessed)"""


@query(f", {TRANSITIONS} SELECT department, src, dst, count(*) AS n FROM tr GROUP BY department, src, dst")
def transition_counts(log: Log) -> DataFrame:
    return graph.transitions(log.events, log.users).groupBy("department", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
, {TRANSITIONS}, e AS (SELECT ev.*, department, {ok("user_id")} AS ok FROM ev LEFT JOIN us USING (user_id))
, v AS (SELECT record_id, ts, department, resource_accessed AS res, list_distinct(list(resource_accessed) FILTER (WHERE department IS NOT NULL AND resource_accessed IS NOT NULL) OVER w) AS seen,
  last_value(CASE WHEN department IS NOT NULL THEN resource_accessed END IGNORE NULLS) OVER w AS src FROM e WINDOW {past("user_id")})
, c AS (SELECT v.record_id, count(tr.record_id) AS n FROM v JOIN tr ON tr.department = v.department AND tr.src = v.src AND tr.dst = v.res
  AND (tr.ts < v.ts OR (tr.ts = v.ts AND tr.record_id < v.record_id)) AND epoch_us(tr.ts) >= epoch_us(v.ts) - {DAYS * C.DAY_US} GROUP BY v.record_id)
SELECT v.record_id, round(CASE WHEN res IS NULL OR list_contains(seen, res) THEN 0.0 WHEN coalesce(len(seen), 0) = 0 THEN 10.0 WHEN c.n > 0 THEN 1.0 / c.n ELSE 10.0 END, 6) AS access_chain_distance
FROM v LEFT JOIN c USING (record_id)""")
def access_chain(log: Log) -> DataFrame:
    return r6(graph.access_chain_distance(log.events, log.users, DAYS), "access_chain_distance")


@query(f"""
, e AS (SELECT *, {ok("user_id, device_id")} AS ok FROM ev)
, q AS (SELECT record_id, user_id AS u, device_id AS d, epoch_us(ts) AS t, count(*) OVER w > 0 AS live FROM e WINDOW {past("user_id, device_id")})
, s AS (SELECT user_id, device_id, epoch_us(ts) AS t FROM ev)
, nv AS (SELECT * FROM q WHERE NOT live)
, a AS (SELECT DISTINCT nv.record_id, nv.t, s.user_id AS x FROM nv JOIN s ON s.device_id = nv.d AND s.t < nv.t AND s.t >= nv.t - {DAYS * C.DAY_US})
, b0 AS (SELECT DISTINCT nv.record_id, nv.t, s.device_id AS x FROM nv JOIN s ON s.user_id = nv.u AND s.t < nv.t AND s.t >= nv.t - {DAYS * C.DAY_US})
, b AS (SELECT DISTINCT b0.record_id, b0.t, s.user_id AS x FROM b0 JOIN s ON s.device_id = b0.x AND s.t < b0.t AND s.t >= b0.t - {DAYS * C.DAY_US})
, n2 AS (SELECT DISTINCT a.record_id FROM a JOIN b ON a.record_id = b.record_id AND a.x = b.x)
, a4 AS (SELECT DISTINCT a.record_id, s.device_id AS x FROM a JOIN s ON s.user_id = a.x AND s.t < a.t AND s.t >= a.t - {DAYS * C.DAY_US})
, b4 AS (SELECT DISTINCT b.record_id, s.device_id AS x FROM b JOIN s ON s.user_id = b.x AND s.t < b.t AND s.t >= b.t - {DAYS * C.DAY_US})
, n4 AS (SELECT DISTINCT a4.record_id FROM a4 JOIN b4 ON a4.record_id = b4.record_id AND a4.x = b4.x)
SELECT q.record_id, round(CASE WHEN live THEN 0 WHEN n2.record_id IS NOT NULL THEN 1 - 1.0 / 3 WHEN n4.record_id IS NOT NULL THEN 1 - 1.0 / 5 ELSE 1 - 1.0 / 7 END, 6) AS is_new_edge
FROM q LEFT JOIN n2 ON n2.record_id = q.record_id LEFT JOIN n4 ON n4.record_id = q.record_id""")
def new_edge(log: Log) -> DataFrame:
    return r6(graph.new_edge(log.events, DAYS), "is_new_edge")


@query("""
, p AS (SELECT DISTINCT user_id, device_id FROM ev)
SELECT a.user_id AS u1, b.user_id AS u2, count(*) AS weight FROM p a JOIN p b ON a.device_id = b.device_id AND a.user_id < b.user_id GROUP BY a.user_id, b.user_id""")
def shared_devices(log: Log) -> DataFrame:
    return graph.shared_devices(log.events)


@query("""
, p AS (SELECT DISTINCT user_id, device_id FROM ev)
SELECT a.user_id AS u1, b.user_id AS u2, count(*) AS weight FROM p a JOIN p b ON a.device_id = b.device_id AND a.user_id < b.user_id GROUP BY a.user_id, b.user_id HAVING count(*) >= 2""")
def strong_ties(log: Log) -> DataFrame:
    return graph.shared_devices(log.events, least=2)


def own_pairs(log: Log) -> DataFrame:
    return graph.live_pairs(log.events.where(~F.col("device_id").like("DEV-KIOSK-%")), DAYS)


@query(f"""
, d AS (SELECT DISTINCT user_id, device_id, CAST(ts AS DATE) AS day FROM ev WHERE NOT starts_with(device_id, 'DEV-KIOSK-'))
SELECT DISTINCT CAST(epoch_us(day + to_days(CAST(i AS INT))) AS BIGINT) AS epoch_us, user_id, device_id FROM d, range(1, {DAYS + 1}) t(i)""")
def community_pairs(log: Log) -> DataFrame:
    """What each day's communities are made of: pairs of the days before it."""
    return own_pairs(log).select(F.unix_micros(F.col("epoch").cast("timestamp")).alias("epoch_us"), "user_id", "device_id")


@query()
def community_features(log: Log) -> DataFrame:
    """Communities of each day, from devices that aren't shared terminals; label propagation isn't plain SQL."""
    pairs = materialised(own_pairs(log))
    return r6(graph.community_deviation(log.events, pairs, graph.epoch_communities(pairs)), "peer_community_deviation")


@query(f"""
, d AS (SELECT DISTINCT user_id, device_id, CAST(ts AS DATE) AS day FROM ev WHERE NOT starts_with(device_id, 'DEV-KIOSK-'))
, p AS (SELECT DISTINCT day + to_days(CAST(i AS INT)) AS epoch, user_id, device_id FROM d, range(1, {DAYS + 1}) t(i))
, m AS (SELECT DISTINCT epoch, user_id, user_id % 40 AS c FROM p)
, q AS (SELECT record_id, e.user_id, e.device_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS epoch, c FROM ev e LEFT JOIN m ON m.epoch = CAST(CAST(ts AS DATE) AS TIMESTAMP) AND m.user_id = e.user_id)
, z AS (SELECT epoch, c, count(*) AS size FROM m GROUP BY epoch, c)
, n AS (SELECT q.record_id, count(p.user_id) AS n FROM q JOIN m ON m.epoch = q.epoch AND m.c = q.c AND m.user_id <> q.user_id JOIN p ON p.epoch = q.epoch AND p.user_id = m.user_id AND p.device_id = q.device_id GROUP BY q.record_id)
SELECT q.record_id, round(CASE WHEN coalesce(size, 0) <= 1 THEN 0 ELSE 1 - coalesce(n.n, 0) / (size - 1) END, 6) AS peer_community_deviation
FROM q LEFT JOIN z ON z.epoch = q.epoch AND z.c = q.c LEFT JOIN n ON n.record_id = q.record_id""")
def community_share(log: Log) -> DataFrame:
    """The deviation from given communities: those of user_id modulo 40."""
    pairs = own_pairs(log)
    given = pairs.select("epoch", "user_id", F.pmod("user_id", F.lit(40)).alias("community")).distinct()
    return r6(graph.community_deviation(log.events, pairs, given), "peer_community_deviation")


TRAIN = "tr1 AS (SELECT record_id, ts, row_number() OVER (ORDER BY ts, record_id) - 1 AS rank, (SELECT count(*) FROM ev) AS n FROM ev)"


@query(f"""
, {TRAIN} SELECT record_id, CAST(rank AS BIGINT) AS rank, rank < cut AS is_train, epoch_us(max(CASE WHEN rank = cut THEN ts END) OVER ()) AS split_us
FROM (SELECT *, greatest(1, least(n - 1, CAST(floor(n * 0.7) AS BIGINT))) AS cut FROM tr1) z""")
def chronological_split(log: Log) -> DataFrame:
    return evaluate.chronological_split(log.events).select("record_id", "rank", "is_train", F.unix_micros("split_ts").alias("split_us"))


@query(f"""
, {TRAIN}, f AS (SELECT ev.record_id, score, department, ev.ts, join_date FROM ev JOIN us USING (user_id))
, p AS (SELECT department, quantile_cont(score, 0.5) AS prior FROM f JOIN tr1 USING (record_id) WHERE rank < CAST(floor(n * 0.7) AS BIGINT) GROUP BY department)
SELECT record_id, round(CASE WHEN f.ts < CAST(join_date + 14 AS TIMESTAMP) THEN coalesce(prior, score) ELSE score END, 6) AS score FROM f LEFT JOIN p USING (department)""")
def cold_start(log: Log) -> DataFrame:
    scores = log.events.select("record_id", "score")
    train = evaluate.chronological_split(log.events).where("is_train").select("record_id")
    priors = graph.cold_start_priors(scores.join(train, "record_id", "left_semi"), log.events, log.users, ["score"])
    return r6(graph.apply_priors(scores, log.events, log.users, priors, ["score"]), "score")


@query("""
SELECT record_id, array_to_string(list(part) OVER (PARTITION BY user_id ORDER BY ts, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' | ') AS text
FROM (SELECT *, format('score={:.3f}', floor(score * 1000) / 1000) || format(' geo_lat={:.3f}', geo_lat) AS part FROM ev) z""")
def event_sequences(log: Log) -> DataFrame:
    cut = F.floor(F.col("score") * 1000) / 1000  # so that both engines print the same third digit
    return schema.sequences(log.events.select("record_id", cut.alias("score"), "geo_lat"), log.events, ["score", "geo_lat"])


# --- schema, sources, scalars --------------------------------------------------------------------


@query("""
SELECT 'events' AS "table", 'record_id' AS "column", 'null' AS rule, CAST(0 AS BIGINT) AS n_bad WHERE false
UNION ALL SELECT 'events', 'geo_lon', 'range', n FROM (SELECT count(*) AS n FROM ev WHERE NOT geo_lon BETWEEN -150 AND 150) WHERE n > 0
UNION ALL SELECT 'events', 'os', 'vocabulary', n FROM (SELECT count(*) AS n FROM ev WHERE os NOT IN ('macOS', 'Windows')) WHERE n > 0
UNION ALL SELECT 'events', 'score', 'type', 1 UNION ALL SELECT 'events', 'asn', 'missing', 1""")
def schema_violations(log: Log) -> DataFrame:
    rules = (*schema.EVENT_RULES, schema.Rule("geo_lon", "double", low=-150, high=150), schema.Rule("os", "string", values=("macOS", "Windows")), schema.Rule("score", "string"), schema.Rule("asn", "string"))
    return schema.violations(log.events, rules, "events")


@query(""", c AS (SELECT count(*) AS n FROM ev) SELECT (SELECT count(*) FROM us) AS users, (SELECT n FROM c) AS events, (SELECT count(DISTINCT user_id) FROM ev) AS active_users,
  CAST((SELECT count_if(is_attack) FROM lb) AS BIGINT) AS attack_events, (SELECT count(DISTINCT attack_id) FROM lb) AS campaigns, round((SELECT avg(CAST(is_attack AS DOUBLE)) FROM lb), 6) AS attack_ratio, (SELECT count(*) FROM dl) AS drift_events""")
def run_summary(log: Log) -> DataFrame:
    return r6(schema.run_summary(log.users, log.events, log.labels, log.drift), "attack_ratio")


@query(" SELECT CAST(0 AS BIGINT) AS events_only, CAST(count(*) AS BIGINT) AS labels_only FROM lb WHERE record_id NOT IN (SELECT record_id FROM ev WHERE event_type = 'login_attempt')")
def row_alignment(log: Log) -> DataFrame:
    return evaluate.alignment(log.events.where("event_type = 'login_attempt'"), log.labels)


@query("""
, z AS (SELECT ev.*, lb.is_attack, lb.attack_id, lb.attack_type, tac.technique_ids FROM ev JOIN lb USING (record_id) LEFT JOIN tac USING (attack_type))
SELECT record_id, is_attack, attack_id, attack_type, technique_ids FROM z""")
def assembled_labels(log: Log) -> DataFrame:
    marked = log.events.join(log.labels.select("record_id", "attack_id"), "record_id")
    benign = marked.where("attack_id is null").drop("attack_id")
    campaigns = log.attacks.join(F.broadcast(log.tactics), "attack_type")
    _, labels = schema.assemble(benign, marked.where("attack_id is not null"), campaigns)
    return labels.select("record_id", "is_attack", "attack_id", "attack_type", "technique_ids")


@query()
def bookkeeping_ids(log: Log) -> DataFrame:
    return schema.bookkeeping(log.events)


@query(f"""
SELECT ev.record_id, round({km("home_lat", "home_lon", "geo_lat", "geo_lon")}, 3) AS away_km,
  CASE WHEN s <= e THEN NOT hour(ts) BETWEEN s AND e ELSE NOT (hour(ts) >= s OR hour(ts) <= e) END AS off_shift, NOT hour(ts) BETWEEN 7 AND 19 AS off_default, isodow(ts) >= 6 AS weekend, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS holiday,
  CAST(list_position(['standard', 'elevated', 'admin', 'domain_admin'], privilege_level) AS BIGINT) AS privilege, CAST(round_even(score * 10000, 0) AS BIGINT) AS fixed,
  coalesce(attack_type, 'benign') AS label, {TIER} AS tier
FROM (SELECT *, user_id % 24 AS s, (user_id * 7) % 24 AS e FROM ev) ev LEFT JOIN us ON us.user_id = ev.user_id JOIN lb ON lb.record_id = ev.record_id WHERE resource_accessed IS NOT NULL""")
def scalar_functions(log: Log) -> DataFrame:
    e = log.events.where("resource_accessed is not null").join(log.users, "user_id", "left").join(log.labels.select("record_id", "attack_type"), "record_id")
    start, end = F.col("user_id") % 24, F.col("user_id") * 7 % 24
    return e.select(
        "record_id", F.round(C.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("geo_lat"), F.col("geo_lon")), 3).alias("away_km"),
        C.off_shift(F.hour("ts"), start, end).alias("off_shift"), C.off_hours(F.col("ts")).alias("off_default"), C.weekend(F.col("ts")).alias("weekend"), C.holiday(F.col("ts"), ["2024-01-01", "2024-01-15"]).alias("holiday"),
        C.privilege_rank(F.col("privilege_level")).cast("long").alias("privilege"), C.fixed_point(F.col("score")).alias("fixed"),
        F.coalesce("attack_type", F.lit("benign")).alias("label"), C.lookup(C.TIERS, F.col("resource_accessed")).alias("tier"),
    )


@query("""
, o AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'remote_work_shift' ELSE 'schedule_shift' END AS change_type FROM us WHERE user_id % 2 = 0)
SELECT us.user_id, CASE WHEN o.change_type = 'remote_work_shift' AND 10 >= 7 THEN 'remote' ELSE 'onsite' END AS work_mode, CASE WHEN o.change_type = 'schedule_shift' AND 10 >= 20 THEN CAST(11 AS BIGINT) ELSE 9 END AS shift_start
FROM us LEFT JOIN o ON o.user_id = us.user_id""")
def drift_overrides(log: Log) -> DataFrame:
    users = log.users.select("user_id", F.lit("onsite").alias("work_mode"), F.lit(9).cast("long").alias("shift_start"))
    kind = F.when(F.col("user_id") % 3 == 0, "remote_work_shift").otherwise("schedule_shift")
    rollout = log.users.where("user_id % 2 = 0").select("user_id", kind.alias("change_type"), F.lit("remote").alias("to_mode"), F.lit(11).cast("long").alias("to_start"))
    rollout = rollout.join(F.broadcast(log.drift), "change_type").withColumnRenamed("day", "drift_day")
    return schema.overridden(users, rollout, F.lit(10), {"work_mode": ("remote_work_shift", "to_mode"), "shift_start": ("schedule_shift", "to_start")})


# --- evaluation -----------------------------------------------------------------------------------


def scored(log: Log) -> DataFrame:
    """Test events with label, score and prediction."""
    rows = log.events.select("record_id", "ts", "user_id", "score").join(log.labels, "record_id")
    return rows.withColumn("pred", F.col("score") >= THRESHOLD)


SCORED = f"sc AS (SELECT ev.record_id, ev.ts, ev.user_id, score, lb.* EXCLUDE (record_id), score >= {THRESHOLD} AS pred FROM ev JOIN lb USING (record_id))"
CURVE = """pr AS (SELECT score, count_if(is_attack) AS p, count_if(NOT is_attack) AS n FROM sc GROUP BY score)
, cu AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM pr WINDOW d AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""
, {SCORED}, m AS (SELECT CAST(count_if(is_attack AND pred) AS BIGINT) AS tp, CAST(count_if(NOT is_attack AND pred) AS BIGINT) AS fp, CAST(count_if(is_attack AND NOT pred) AS BIGINT) AS fn, CAST(count_if(NOT is_attack AND NOT pred) AS BIGINT) AS tn FROM sc)
SELECT *, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM m""")
def binary_metrics(log: Log) -> DataFrame:
    return r6(evaluate.binary_metrics(scored(log)), "precision", "recall", "f1", "mcc", "balanced_accuracy")


@query(f"""
, {SCORED}, {CURVE} SELECT round(sum(n * (tp - p / 2)) / (max(all_p) * max(all_n)), 6) AS roc_auc, round(sum(p / all_p * tp / (tp + fp)), 6) AS average_precision FROM cu""")
def ranked_metrics(log: Log) -> DataFrame:
    return r6(evaluate.ranked_metrics(scored(log)), "roc_auc", "average_precision")


@query(f""", {SCORED}, {CURVE} SELECT score, round(tp / (tp + fp), 6) AS "precision", round(tp / all_p, 6) AS recall FROM cu""")
def precision_recall_curve(log: Log) -> DataFrame:
    return r6(evaluate.precision_recall(scored(log)), "precision", "recall")


@query(f"""
, {TRAIN}, s AS (SELECT score FROM ev JOIN tr1 USING (record_id) WHERE rank < CAST(floor(n * 0.7) AS BIGINT))
SELECT round(quantile_cont(score, 0.99), 6) AS threshold, round(quantile_cont(score, 0.9), 6) AS low, round(quantile_cont(score, 0.999), 6) AS high FROM s""")
def train_thresholds(log: Log) -> DataFrame:
    train = log.events.join(evaluate.chronological_split(log.events).where("is_train").select("record_id"), "record_id", "left_semi").select("score")
    return r6(evaluate.operating_threshold(train).join(F.broadcast(evaluate.threshold_range(train))), "threshold", "low", "high")


@query(f"""
, {SCORED}, f AS (SELECT CAST(count_if(pred AND NOT is_attack) AS BIGINT) AS fp, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM sc)
SELECT fp, round(days, 6) AS days, round(fp / days, 6) AS fp_per_day FROM f""")
def false_positives_per_day(log: Log) -> DataFrame:
    return r6(evaluate.false_positives_per_day(scored(log)), "days", "fp_per_day")


@query(f", {SCORED} SELECT attack_type, round(avg(CAST(pred AS DOUBLE)), 6) AS recall, count(*) AS n FROM sc WHERE attack_type IS NOT NULL GROUP BY attack_type")
def recall_by_type(log: Log) -> DataFrame:
    return r6(evaluate.recall_by_type(scored(log)), "recall")


@query(f"""
, {SCORED}, t AS (SELECT 'score' AS model, attack_type, pred FROM sc UNION ALL SELECT 'half' AS model, attack_type, score >= 0.5 FROM sc)
SELECT model, round(avg(CAST(pred AS INT)) FILTER (attack_type = 'brute_force'), 6) AS brute_force, round(avg(CAST(pred AS INT)) FILTER (attack_type = 'lateral_movement'), 6) AS lateral_movement FROM t GROUP BY model""")
def recall_matrix(log: Log) -> DataFrame:
    s = scored(log)
    both = s.withColumn("model", F.lit("score")).unionByName(s.withColumn("model", F.lit("half")).withColumn("pred", F.col("score") >= 0.5))
    return r6(evaluate.recall_matrix(both, ["brute_force", "lateral_movement"]), "brute_force", "lateral_movement")


@query(f"""
, {SCORED}, f AS (SELECT attack_id, min(ts) AS found FROM sc WHERE pred GROUP BY attack_id)
SELECT round(avg(greatest(0, (epoch_us(found) - epoch_us(start_time)) / 3.6e9)), 6) AS mttd_hours, round(count(found) / count(*), 6) AS coverage, count(*) AS campaigns
FROM atk LEFT JOIN f USING (attack_id)""".replace("greatest(0, (epoch_us(found) - epoch_us(start_time)) / 3.6e9)", "CASE WHEN found IS NOT NULL THEN greatest(0, (epoch_us(found) - epoch_us(start_time)) / 3.6e9) END"))
def time_to_detect(log: Log) -> DataFrame:
    return r6(evaluate.time_to_detect(scored(log), log.attacks), "mttd_hours", "coverage")


GUESS = "CASE WHEN score >= 0.7 THEN 'brute_force' WHEN score >= 0.6 THEN 'lateral_movement' ELSE 'benign' END"


@query(f"""
, {SCORED}, t AS (SELECT coalesce(attack_type, 'benign') AS truth, {GUESS} AS guess FROM sc)
, k AS (SELECT label, CAST(count_if(truth = label) AS BIGINT) AS support, count_if(guess = label) AS said, count_if(truth = label AND guess = label) AS tp FROM t, (SELECT truth AS label FROM t UNION SELECT guess FROM t) l GROUP BY label)
, r AS (SELECT label, support, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, coalesce(2 * tp / nullif(said + support, 0), 0) AS f, tp FROM k)
, u AS (SELECT label, support, p, r, f FROM r UNION ALL SELECT 'accuracy', CAST(sum(support) AS BIGINT), sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM r
  UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), avg(p), avg(r), avg(f) FROM r UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support) FROM r)
SELECT label, support, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, CASE WHEN support < 10 THEN 'thin' WHEN p < 0.5 THEN 'low precision' ELSE 'ok' END AS note FROM u""")
def class_report(log: Log) -> DataFrame:
    rows = scored(log).select(F.coalesce("attack_type", F.lit("benign")).alias("truth"), F.expr(GUESS).alias("guess"))
    return r6(analyst.reliability(evaluate.class_report(rows)), "precision", "recall", "f1")


@query(f"""
, {SCORED}, b AS (SELECT CAST(least(9, greatest(0, (SELECT count(*) FROM range(0, 11) t(i) WHERE score > i / 10.0) - 1)) AS INT) AS bin, score, is_attack FROM sc)
, g AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(CAST(is_attack AS DOUBLE)) AS r FROM b GROUP BY bin)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_score, round(r, 6) AS rate FROM range(0, 10) t(i) LEFT JOIN g ON g.bin = i""")
def calibration_bins(log: Log) -> DataFrame:
    return r6(evaluate.calibration(scored(log)), "mean_score", "rate")


@query(f"""
, {SCORED}, b AS (SELECT least(9, greatest(0, (SELECT count(*) FROM range(0, 11) t(i) WHERE score > i / 10.0) - 1)) AS bin, score, is_attack FROM sc)
, g AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(CAST(is_attack AS DOUBLE)) AS r FROM b GROUP BY bin)
SELECT round((SELECT sum(n * abs(m - r)) / sum(n) FROM g), 6) AS ece, round((SELECT avg(pow(score - CAST(is_attack AS DOUBLE), 2)) FROM sc), 6) AS brier""")
def calibration_error(log: Log) -> DataFrame:
    return r6(evaluate.calibration_error(scored(log)), "ece", "brier")


@query()
def bootstrap_intervals(log: Log) -> DataFrame:
    return r6(evaluate.bootstrap_ci(scored(log)), "low", "mid", "high")


@query()
def paired_models(log: Log) -> DataFrame:
    """Average precision of the score against that of its coarse form."""
    rows = scored(log).withColumn("coarse", F.round("score", 1))
    return r6(evaluate.paired_bootstrap(rows, "score", "coarse"), "low", "mid", "high", "p_value")


@query("""
, b AS (SELECT record_id, score AS a, round(score, 1) AS c FROM ev) SELECT count(*) AS n, round(avg(a - c), 6) AS mean_gap, 'coarse' AS model_a, 'score' AS model_b FROM b""")
def score_pairs(log: Log) -> DataFrame:
    """Every pair of models in the long score table, paired by record."""
    e = log.events
    long = e.select(F.lit("score").alias("model"), "record_id", "score").unionByName(e.select(F.lit("coarse").alias("model"), "record_id", F.round("score", 1).alias("score")))
    b = long.toDF("model_b", "record_id", "score_b")
    pairs = long.withColumnRenamed("model", "model_a").join(b, "record_id").where("model_a < model_b")
    return r6(pairs.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("score_b") - F.col("score")).alias("mean_gap")), "mean_gap")


#: A fixed model over the features that are left out one by one: (feature, class, weight, value at which it is full).
FIXED = (
    ("ema_failure_rate", 1, 0.31, 0.3), ("failed_login_ratio", 1, 0.23, 0.4), ("access_chain_distance", 2, 0.29, 10.0), ("peer_group_deviation", 2, 0.17, 0.5),
    ("device_fingerprint_mismatch", 2, 0.13, 1.0), ("geo_distance_from_home_km", 2, 0.19, 8000.0), ("session_foreign_resource_count", 2, 0.11, 3.0), ("session_hop_seconds", 2, 0.07, 3600.0),
)
SHOWN = [n for n, *_ in FIXED]


def fixed_probabilities() -> Column:
    """Of benign and two classes of attacks."""
    part = lambda c: sum((0.66 * w * F.least(F.col(n) / full, F.lit(1.0)) for n, k, w, full in FIXED if k == c), F.lit(0.0))
    return F.array(F.round(1 - part(1) - part(2), 9), F.round(part(1), 9), F.round(part(2), 9))


def fixed_part(c: int) -> str:
    return " + ".join(["CAST(0 AS DOUBLE)", *(f"CAST({0.66 * w!r} AS DOUBLE) * least({n} / CAST({full} AS DOUBLE), 1)" for n, k, w, full in FIXED if k == c)])


def shown_features(log: Log) -> DataFrame:
    """Labelled rows of FIXED's features, and whether they train."""
    log = log.kept()
    rows = behaviour_features(log)
    for more in (device_features(log), session_features(log), access_chain(log), peer_deviation(log)):
        rows = rows.join(more, "record_id")
    rows = rows.select("record_id", *(F.col(n).cast("double").alias(n) for n in SHOWN)).join(log.labels.select("record_id", "is_attack"), "record_id")
    return materialised(rows.join(evaluate.chronological_split(log.events).select("record_id", "is_train"), "record_id"))


OUT_OF = {"without behaviour": evaluate.BEHAVIOUR, "without graph": evaluate.GRAPH} | {f"without {n}": (n,) for n in SHOWN}
STRESSED = f"""{part("bf", "behaviour_features")}, {part("df", "device_features")}, {part("sf", "session_features")}, {part("ac", "access_chain")}, {part("pd", "peer_deviation")}
, fx AS (SELECT record_id, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in SHOWN)} FROM bf JOIN df USING (record_id) JOIN sf USING (record_id) JOIN ac USING (record_id) JOIN pd USING (record_id)), {TRAIN}
, sp AS (SELECT record_id, rank < greatest(1, least(n - 1, CAST(floor(n * 0.7) AS BIGINT))) AS is_train FROM tr1)
, md AS (SELECT {", ".join(f"quantile_cont({n}, 0.5) AS {n}" for n in SHOWN)} FROM fx JOIN sp USING (record_id) WHERE is_train)
, st AS (SELECT scenario, fx.record_id, is_train, {", ".join(f"CASE WHEN scenario IN ({', '.join(repr(s) for s, out in OUT_OF.items() if n in out)}) THEN md.{n} ELSE fx.{n} END AS {n}" for n in SHOWN)}
  FROM fx JOIN sp USING (record_id), md, (SELECT unnest(['noise 0', {", ".join(map(repr, OUT_OF))}]) AS scenario) c)
, pb AS (SELECT scenario, record_id, is_train, round(1 - ({fixed_part(1)}) - ({fixed_part(2)}), 9) AS p0, round({fixed_part(1)}, 9) AS p1, round({fixed_part(2)}, 9) AS p2 FROM st)
, th AS (SELECT round(quantile_cont(round(1 - p0, 9), 0.99), 9) AS t FROM pb WHERE is_train AND scenario = 'noise 0')"""


@query(f"""
, {STRESSED}, m AS (SELECT scenario, is_attack, round(1 - p0, 9) AS score, round(1 - p0, 9) >= t AS pred FROM pb JOIN lb USING (record_id), th WHERE NOT is_train)
, c AS (SELECT scenario, count_if(is_attack AND pred) AS tp, count_if(NOT is_attack AND pred) AS fp, count_if(is_attack AND NOT pred) AS fn, avg(pow(score - CAST(is_attack AS INT), 2)) AS brier FROM m GROUP BY scenario)
, d AS (SELECT scenario, score, count_if(is_attack) AS p, count(*) AS n FROM m GROUP BY scenario, score)
, r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS said, sum(p) OVER (PARTITION BY scenario) AS ap FROM d WINDOW w AS (PARTITION BY scenario ORDER BY score DESC))
, k AS (SELECT scenario, sum(p / ap * tp / said) AS pr_auc FROM r GROUP BY scenario)
, b AS (SELECT scenario, least(9, greatest(0, ceil(score * 10) - 1)) AS bin, count(*) AS n, avg(score) AS said, avg(CAST(is_attack AS INT)) AS rate FROM m GROUP BY ALL)
, x AS (SELECT scenario, sum(n * abs(said - rate)) / sum(n) AS ece FROM b GROUP BY scenario)
SELECT scenario, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, round(ece, 6) AS ece
FROM c JOIN k USING (scenario) JOIN x USING (scenario)""")
def stress_ablations(log: Log) -> DataFrame:
    """A fixed model as it is, without each family of features, and without each of eight features, at train's threshold."""
    rows = shown_features(log)
    train = rows.where("is_train")
    score = F.round(1 - F.get(fixed_probabilities(), F.lit(0)), 9)
    limit = evaluate.operating_threshold(train.select(score.alias("score"))).select(F.round("threshold", 9).alias("threshold"))
    cases = [(s, x, tuple(n for n in out if n in SHOWN)) for s, x, out in evaluate.stress_scenarios() if not x]
    cases = evaluate.stressed(rows.where("not is_train"), SHOWN, train, cases).select("scenario", "record_id", "is_attack", score.alias("score"))
    return r6(evaluate.stress_report(cases, limit), "precision", "recall", "f1", "pr_auc", "brier", "ece")


ALL_FEATURES = [*evaluate.BEHAVIOUR, *evaluate.GRAPH, *evaluate.SESSION]


@query()
def stress_grid(log: Log) -> DataFrame:
    """All sixteen scenarios for boosted trees over all fifteen features, oversampled by SMOTE, at the train scores' 99th percentile.

    300 rounds of depth 6, as the reference fits them."""
    log = log.kept()
    labels = log.labels.select("record_id", "is_attack", C.class_index(F.col("attack_type"), learn.CLASSES).cast("double").alias("label"))
    feats = graph.all_features(log.events, log.users, log.home, DAYS).fillna(0.0, ALL_FEATURES).select("record_id", *(F.col(n).cast("double").alias(n) for n in ALL_FEATURES))
    rows = materialised(feats.join(labels, "record_id").join(evaluate.chronological_split(log.events).select("record_id", "is_train"), "record_id"))
    train = rows.where("is_train")
    model = learn.train_boosted(learn.smote(train, ALL_FEATURES), ALL_FEATURES)
    scored = lambda df, *keys: boosting.probabilities(model, df, keys=keys).withColumn("score", 1 - F.get("p", F.lit(0)))
    limit = evaluate.operating_threshold(scored(train, "record_id"))
    cases = evaluate.stressed(rows.where("not is_train"), ALL_FEATURES, train, evaluate.stress_scenarios())
    return r6(evaluate.stress_report(scored(cases, "scenario", "record_id", "is_attack"), limit), "precision", "recall", "f1", "pr_auc", "brier", "ece")


@query(f"""
, {SCORED}, m AS (SELECT 'score' AS model, is_attack, CAST(score AS DOUBLE) AS score, score >= {THRESHOLD} AS pred FROM sc UNION ALL SELECT 'coarse', is_attack, round(CAST(score AS DOUBLE), 1), round(CAST(score AS DOUBLE), 1) >= 0.75 FROM sc)
, c AS (SELECT model, count_if(is_attack AND pred) AS tp, count_if(NOT is_attack AND pred) AS fp, count_if(is_attack AND NOT pred) AS fn, count_if(NOT is_attack AND NOT pred) AS tn FROM m GROUP BY model)
, d AS (SELECT model, score, count_if(is_attack) AS p, count_if(NOT is_attack) AS n FROM m GROUP BY model, score)
, r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS ap, sum(n) OVER (PARTITION BY model) AS an FROM d WINDOW w AS (PARTITION BY model ORDER BY score DESC))
, k AS (SELECT model, sum(n * (tp - p / 2)) / max(ap * an) AS auc, sum(p / ap * tp / (tp + fp)) AS prec FROM r GROUP BY model)
SELECT model, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
  round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 4) AS mcc, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 4) AS balanced_accuracy,
  round(auc, 4) AS roc_auc, round(prec, 4) AS average_precision FROM c JOIN k USING (model)""")
def model_comparison(log: Log) -> DataFrame:
    """Two models of one long score table, compared by their rates and ranking quality."""
    both = F.array(F.struct(F.lit("score").alias("model"), F.col("score").alias("s"), (F.col("score") >= THRESHOLD).alias("p")), F.struct(F.lit("coarse").alias("model"), F.round("score", 1).alias("s"), (F.round("score", 1) >= 0.75).alias("p")))
    long = scored(log).withColumn("score", F.col("score").cast("double")).select("record_id", "is_attack", F.inline(both)).withColumnsRenamed({"s": "score", "p": "pred"})
    return evaluate.comparison(evaluate.binary_metrics(long, "model"), evaluate.ranked_metrics(long, "model"))


# --- drift ----------------------------------------------------------------------------------------


@query(f"""
, {TRAIN} SELECT CAST(floor(rank / 100.0) AS BIGINT) AS bin, round(avg(score), 6) AS mean, epoch_us(max(ts)) AS last_us, count(*) AS n FROM ev JOIN (SELECT record_id, rank FROM tr1) t USING (record_id) GROUP BY 1""")
def event_bins(log: Log) -> DataFrame:
    out = explain.bins(log.events, "score")
    return r6(out.select("bin", "mean", F.unix_micros("last_ts").alias("last_us"), "n"), "mean")


METRICS = ["off_hours", "score"]


@query("""
, r AS (SELECT department, CAST(is_off_hours AS DOUBLE) AS off_hours, CAST(score AS DOUBLE) AS score, ts, (row_number() OVER (PARTITION BY department ORDER BY ts, record_id) - 1) // 100 AS bin FROM ev JOIN us USING (user_id))
, l AS (SELECT department, 'off_hours' AS metric, bin, ts, off_hours AS v FROM r UNION ALL SELECT department, 'score', bin, ts, score FROM r)
SELECT department, metric, CAST(bin AS BIGINT) AS bin, round(avg(v), 6) AS mean, epoch_us(max(ts)) AS last_us, count(*) AS n FROM l GROUP BY department, metric, bin""")
def department_bins(log: Log) -> DataFrame:
    return r6(department_series(log).select("department", "metric", "bin", "mean", F.unix_micros("last_ts").alias("last_us"), "n"), "mean")


def department_series(log: Log) -> DataFrame:
    rows = log.events.withColumn("off_hours", F.col("is_off_hours").cast("double")).join(log.users.select("user_id", "department"), "user_id")
    return explain.series_bins(rows, "department", METRICS)


@query()
def drift_points(log: Log) -> DataFrame:
    """The first change found in any department's series at or after each known one."""
    found = explain.drift_points(department_series(log), ["department", "metric"])
    return explain.detection_lag(log.drift, found, F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("day") * C.DAY_US)).drop("at")


@query("""
, d AS (SELECT ts FROM ev WHERE event_type = 'login_attempt' AND score >= 0.7), g AS (SELECT day, change_type, (SELECT min(ts) FROM ev) + to_days(CAST(day AS INT)) AS at0 FROM dl)
, h AS (SELECT day, change_type, at0, min(d.ts) AS det FROM g LEFT JOIN d ON d.ts >= at0 GROUP BY day, change_type, at0)
SELECT day, change_type, det IS NOT NULL AS detected, round((epoch_us(det) - epoch_us(at0)) / 8.64e10, 6) AS lag_days,
  CASE WHEN det IS NULL THEN 'monitoring gap' WHEN (epoch_us(det) - epoch_us(at0)) / 8.64e10 <= 5 THEN 'healthy -- responsive' ELSE 'healthy -- slow to react' END AS health FROM h""")
def detection_lag(log: Log) -> DataFrame:
    first = log.events.agg(F.min("ts").alias("t0"))
    drift = log.drift.join(F.broadcast(first))
    found = log.events.where("event_type = 'login_attempt' and score >= 0.7").select(F.col("ts").alias("last_ts"))
    out = explain.detection_lag(drift, found, F.timestamp_micros(F.unix_micros("t0") + F.col("day") * C.DAY_US))
    return r6(out.select("day", "change_type", "detected", "lag_days", "health"), "lag_days")


# --- explanations ---------------------------------------------------------------------------------

NAMES = ["score", "geo_lat", "geo_lon"]


@query("""
, l AS (UNPIVOT (SELECT record_id, CAST(score AS DOUBLE) AS score, geo_lat, geo_lon FROM ev) ON score, geo_lat, geo_lon INTO NAME feature VALUE value)
SELECT feature, round(avg(value), 6) AS mean, round(greatest(coalesce(stddev_samp(value), 0), 1e-6), 6) AS std FROM l GROUP BY feature""")
def feature_baseline(log: Log) -> DataFrame:
    return r6(explain.baseline(log.events.select("record_id", F.col("score").cast("double"), "geo_lat", "geo_lon"), NAMES), "mean", "std")


@query("""
, z AS (SELECT record_id, (CAST(score AS DOUBLE) - 0.4) / 0.2 AS z1, geo_lat / 40 AS z2, geo_lon / 90 AS z3 FROM ev)
, c AS (SELECT record_id, 'score' AS f, z1 AS z, 0.5 * abs(z1) AS c FROM z UNION ALL SELECT record_id, 'geo_lat', z2, 0.3 * abs(z2) FROM z UNION ALL SELECT record_id, 'geo_lon', z3, 0.2 * abs(z3) FROM z)
SELECT record_id, f AS feature, round(z, 8) AS z, round(c, 8) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY c DESC, f) AS r FROM c) q WHERE r <= 2""")
def approximate_explanations(log: Log) -> DataFrame:
    base = {"score": (0.4, 0.2), "geo_lat": (0.0, 40.0), "geo_lon": (0.0, 90.0)}
    out = explain.approximate(log.events.withColumn("score", F.col("score").cast("double")), NAMES, base, {"score": 0.5, "geo_lat": 0.3, "geo_lon": 0.2}, k=2)
    return out.select("record_id", F.inline("top")).withColumns({c: F.round(c, 8) for c in ("z", "contribution")})


@query("""
, f AS (SELECT record_id, CAST(score AS DOUBLE) AS s, geo_lat AS a FROM ev WHERE score >= 0.7)
, c AS (SELECT record_id, 'score' AS feature, (s + a / 100) - (0.4 + a / 100) AS c FROM f UNION ALL SELECT record_id, 'geo_lat', (s + a / 100) - (s + 5.0 / 100) FROM f)
, m AS (SELECT feature, avg(abs(c)) AS m FROM c GROUP BY feature) SELECT feature, round(m / sum(m) OVER (), 6) AS weight FROM m""")
def contribution_weights(log: Log) -> DataFrame:
    rows = log.events.where("score >= 0.7").withColumn("score", F.col("score").cast("double"))
    parts = explain.contributions(rows, ["score", "geo_lat"], {"score": 0.4, "geo_lat": 5.0}, F.col("score") + F.col("geo_lat") / 100)
    return r6(explain.global_weights(parts), "weight")


@query("""
, f AS (SELECT record_id, user_id, CAST(score AS DOUBLE) AS score, geo_lat FROM ev)
, n AS (SELECT *, (sum(score) OVER u - score) / nullif(count(*) OVER u - 1, 0) AS ns, (sum(geo_lat) OVER u - geo_lat) / nullif(count(*) OVER u - 1, 0) AS ng FROM f WINDOW u AS (PARTITION BY user_id))
, c AS (SELECT record_id, 'score' AS feature, score AS observed, ns AS norm, score - 0.4 AS contribution FROM n WHERE score >= 0.7 UNION ALL SELECT record_id, 'geo_lat', geo_lat, ng, (geo_lat - 5) / 100 FROM n WHERE score >= 0.7)
SELECT record_id, feature, round(observed, 6) AS observed, round(norm, 5) AS norm, round(contribution, 6) AS contribution, CASE WHEN contribution >= 0 THEN 'up' ELSE 'down' END AS direction,
  round(sum(contribution) OVER (PARTITION BY record_id), 6) AS total FROM c""")
def driver_table(log: Log) -> DataFrame:
    rows = log.events.withColumn("score", F.col("score").cast("double"))
    parts = explain.contributions(rows.where("score >= 0.7"), ["score", "geo_lat"], {"score": 0.4, "geo_lat": 5.0}, F.col("score") + F.col("geo_lat") / 100)
    return r6(analyst.driver_table(parts, rows, ["score", "geo_lat"]), "observed", "contribution", "total").withColumn("norm", F.round("norm", 5))


@query(f"""
, {STRESSED}, b AS (SELECT record_id, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS c FROM pb, th WHERE scenario = 'noise 0' AND round(1 - p0, 9) >= t)
, d AS (SELECT record_id, c, substr(scenario, 9) AS feature, round(CASE c WHEN 0 THEN b.p0 - pb.p0 WHEN 1 THEN b.p1 - pb.p1 ELSE b.p2 - pb.p2 END, 3) + 0.0 AS contribution FROM b JOIN pb USING (record_id) WHERE scenario NOT IN ('noise 0', 'without behaviour', 'without graph'))
, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(contribution) DESC, feature) AS nth FROM d)
, s AS (SELECT record_id, any_value(c) AS c, CAST(to_json(list({{'feature': feature, 'contribution': contribution}} ORDER BY nth)) AS VARCHAR) AS top,
  string_agg(feature || ' (' || printf('%+.3f', contribution) || ')', ', ' ORDER BY nth) FILTER (WHERE contribution > 0) AS up, string_agg(feature || ' (' || printf('%+.3f', contribution) || ')', ', ' ORDER BY nth) FILTER (WHERE contribution < 0) AS down
  FROM r WHERE nth <= 5 GROUP BY record_id)
SELECT record_id, CASE c WHEN 0 THEN 'benign' WHEN 1 THEN 'brute_force' ELSE 'lateral_movement' END AS predicted_class, top,
  coalesce(nullif(concat_ws('; ', 'raised by ' || up, 'offset by ' || down), ''), 'no dominant feature') AS sentence FROM s""")
def flagged_explanations(log: Log) -> DataFrame:
    """Leave-one-out contributions to the predicted class of every flagged event: the five largest as JSON, and in words."""
    rows = shown_features(log)
    train = rows.where("is_train")
    score = F.round(1 - F.get(fixed_probabilities(), F.lit(0)), 9).alias("score")
    limit = evaluate.operating_threshold(train.select(score)).select(F.round("threshold", 9).alias("threshold"))
    some = rows.select("*", score).join(F.broadcast(limit)).where("score >= threshold").select("record_id", *SHOWN)
    parts = explain.class_contributions(some, SHOWN, train, ("benign", "brute_force", "lateral_movement"), lambda df: df.select("record_id", "scenario", fixed_probabilities().alias("p")))
    top = explain.top_contributions(parts.withColumn("contribution", F.round("contribution", 3) + F.lit(0.0)), 5, "predicted_class")
    return top.select("record_id", "predicted_class", F.to_json("top").alias("top"), "sentence")


# --- analyst --------------------------------------------------------------------------------------


def wide(log: Log) -> DataFrame:
    return analyst.detail(log.events, log.labels, log.users, log.tactics)


WIDE = "de AS (SELECT ev.*, lb.* EXCLUDE (record_id), us.* EXCLUDE (user_id), tac.* EXCLUDE (attack_type) FROM ev LEFT JOIN lb USING (record_id) LEFT JOIN us USING (user_id) LEFT JOIN tac USING (attack_type))"
FLAG = f"{WIDE}, fl AS (SELECT * FROM de WHERE score >= {THRESHOLD})"


def hits(log: Log) -> DataFrame:
    return analyst.flagged(wide(log), THRESHOLD)


@query(f"""
, {WIDE} SELECT record_id, department, severity, tactic, privilege_level FROM de WHERE department IN ('BUILDING', 'FURNITURE') AND severity IN ('high', 'critical')
  AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND contains(lower(CAST(user_id AS STRING)), '1')""")
def filtered_detail(log: Log) -> DataFrame:
    import datetime as dt

    rows = analyst.where_in(wide(log), dt.datetime(2024, 1, 3, tzinfo=dt.UTC), dt.datetime(2024, 1, 20, tzinfo=dt.UTC), "1", department=["BUILDING", "FURNITURE"], severity=["high", "critical"], attack_type=[])
    return rows.select("record_id", "department", "severity", "tactic", "privilege_level")


@query(f"""
, {FLAG}, a AS (SELECT CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high, count(*) AS flagged, count(DISTINCT attack_id) AS campaigns, count(DISTINCT device_id) AS devices, count(DISTINCT tactic) AS tactics, epoch_us(max(ts)) AS latest FROM fl)
SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'ELEVATED' WHEN flagged > 0 THEN 'GUARDED' ELSE 'LOW' END AS level FROM a""")
def threat_level(log: Log) -> DataFrame:
    return analyst.threat_level(hits(log)).withColumn("latest", F.unix_micros("latest"))


@query(f"""
, {FLAG} SELECT count(*) AS flagged, CAST(count_if(severity IN ('high', 'critical')) AS BIGINT) AS high_severity, count(DISTINCT user_id) AS users, count(DISTINCT department) AS departments,
  (SELECT attack_type FROM fl WHERE attack_type IS NOT NULL GROUP BY attack_type ORDER BY count(*) DESC, attack_type LIMIT 1) AS top_attack_type,
  (SELECT department FROM fl GROUP BY department ORDER BY round(avg(score), 9) DESC, department LIMIT 1) AS top_department FROM fl""")
def security_posture(log: Log) -> DataFrame:
    return analyst.posture(hits(log))


@query(f""", {FLAG} SELECT record_id, user_id, score, severity FROM fl ORDER BY score DESC, record_id""")
def flagged_list(log: Log) -> DataFrame:
    return hits(log).select("record_id", "user_id", "score", "severity").orderBy(F.col("score").desc(), "record_id")


@query(" SELECT record_id, score, round((rank() OVER (ORDER BY score) - 1) / count(*) OVER (), 6) AS percentile FROM ev")
def score_percentiles(log: Log) -> DataFrame:
    return r6(analyst.score_percentile(log.events), "percentile")


@query("""
SELECT record_id, count(*) OVER w AS prior_events, count(*) OVER w < 5 AS thin FROM (SELECT record_id, user_id, epoch_us(ts) AS t FROM ev) z
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_events(log: Log) -> DataFrame:
    return analyst.prior_events(log.events)


@query("""
, u AS (SELECT user_id, count(*) AS n, sum(CAST(score AS DOUBLE)) AS s, sum(CAST(score AS DOUBLE) * CAST(score AS DOUBLE)) AS q FROM ev GROUP BY user_id HAVING count(*) >= 3)
, j AS (SELECT record_id, CAST(score AS DOUBLE) AS x, n - 1 AS m, s - CAST(score AS DOUBLE) AS s, q - CAST(score AS DOUBLE) * CAST(score AS DOUBLE) AS q FROM ev JOIN u USING (user_id))
, k AS (SELECT record_id, x, s / m AS mean, sqrt(greatest((q - s * s / m) / (m - 1), 0)) AS sd FROM j)
SELECT record_id, round(CASE WHEN sd > 1e-6 THEN greatest(-5, least(5, (x - mean) / sd)) ELSE 0 END, 5) AS score FROM k""")
def user_deviations(log: Log) -> DataFrame:
    rows = log.events.withColumn("score", F.col("score").cast("double"))
    return analyst.user_deviation(rows, ["score"]).withColumn("score", F.round("score", 5))


@query(f"""
, e AS (SELECT *, {ok("user_id")} AS ok FROM ev), s AS (SELECT user_id, record_id, score, row_number() OVER o AS nth, coalesce(lag(device_id) OVER o <> device_id, false) AS new_device, coalesce(lag(geo_country) OVER o <> geo_country, false) AS new_country
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ok)), a AS (SELECT user_id, record_id AS alert, nth AS at0 FROM s WHERE score >= {THRESHOLD})
SELECT alert, CAST(at0 - nth + 1 AS INT) AS back, s.record_id, new_device, new_country FROM a JOIN s ON s.user_id = a.user_id AND nth BETWEEN at0 - 5 AND at0""")
def incident_timeline(log: Log) -> DataFrame:
    return analyst.timeline(log.events, log.events.where(F.col("score") >= THRESHOLD)).withColumn("back", F.col("back").cast("int"))


def own_features(log: Log) -> DataFrame:
    """record_id, user_id, score and what the evidence rules look at, rounded as in the queries."""
    out = behaviour_features(log).select("record_id", "velocity_kmh", "failed_login_ratio", "ema_failure_rate", "geo_distance_from_home_km")
    out = log.events.select("record_id", "user_id", "score").join(out, "record_id")
    for more in (access_chain(log), device_set_delta(log), new_edge(log)):
        out = out.join(more, "record_id")
    return materialised(out)


def signals(log: Log) -> DataFrame:
    """Flagged rows with what the evidence rules look at: sums and places are of all rows, what is joined is flagged."""
    log = log.kept()
    feats = own_features(log)
    some = analyst.flagged(feats, THRESHOLD)
    own = list(analyst.OWN)
    z = analyst.user_deviation(feats, own, some).select("record_id", *(F.round(n, 4).alias(f"z_{n}") for n in own))
    place = analyst.score_percentile(log.events, some).select("record_id", "percentile")
    before = analyst.flagged(analyst.prior_events(log.events, "score"), THRESHOLD).select("record_id", "prior_events")
    out = hits(log).join(some.drop("user_id", "score"), "record_id").join(place, "record_id").join(analyst.prior_alerts(some, THRESHOLD), "record_id")
    return out.join(before, "record_id").join(z, "record_id", "left")


def zs() -> str:
    """SQL for the deviations of OWN from the user's other events, as user_deviation has them."""
    own = list(analyst.OWN)
    sums = ", ".join(f"sum({n}) AS s_{n}, sum({n} * {n}) AS q_{n}" for n in own)
    mean, square = "(s_{0} - {0}) / m", "(q_{0} - {0} * {0})"
    sd = "sqrt(greatest((" + square + " - (s_{0} - {0}) * (s_{0} - {0}) / m) / (m - 1), 0))"
    z = "round(CASE WHEN " + sd + " > 1e-6 THEN greatest(-5, least(5, ({0} - " + mean + ") / " + sd + ")) ELSE 0 END, 4) AS z_{0}"
    return f"fu AS (SELECT ft.*, user_id FROM ft JOIN ev USING (record_id)), fs AS (SELECT user_id, count(*) - 1 AS m, {sums} FROM fu GROUP BY user_id HAVING count(*) >= 3), zz AS (SELECT record_id, {', '.join(z.format(n) for n in own)} FROM fu JOIN fs USING (user_id))"


FEATS = f"""{part("bf", "behaviour_features")}, {part("ac", "access_chain")}, {part("ds", "device_set_delta")}, {part("ne", "new_edge")}
, ft AS (SELECT record_id, velocity_kmh, failed_login_ratio, ema_failure_rate, geo_distance_from_home_km, access_chain_distance, user_device_set_delta, is_new_edge FROM bf JOIN ac USING (record_id) JOIN ds USING (record_id) JOIN ne USING (record_id))"""


@query(f"""
, {FEATS}, {zs()}, l AS (SELECT record_id, unnest([{", ".join(f"'{n}'" for n in analyst.OWN)}]) AS f, unnest([{", ".join(f"z_{n}" for n in analyst.OWN)}]) AS z FROM zz)
, t AS (SELECT record_id, string_agg(f || ' ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END, ', ' ORDER BY abs(z) DESC, f) AS top FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(z) DESC, f) AS r FROM l WHERE abs(z) >= 1.5) q WHERE r <= 4 GROUP BY record_id)
SELECT record_id, round(({" + ".join(f"abs(z_{n})" for n in analyst.OWN)}) / {len(analyst.OWN)}, 5) AS drift, abs(z_geo_distance_from_home_km) < 1.5 AS typical_place, coalesce(top, '') AS top FROM zz LEFT JOIN t USING (record_id)""")
def drift_profiles(log: Log) -> DataFrame:
    """How far each event lies from its user's norm over all features, and where furthest."""
    own = list(analyst.OWN)
    z = analyst.user_deviation(own_features(log.kept()), own).select("record_id", *(F.round(n, 4).alias(n) for n in own))
    out = analyst.drift_profile(z, own)
    said = F.transform("top", lambda t: F.concat_ws(" ", t["feature"], F.when(t["z"] > 0, "above").otherwise("below")))
    return out.select("record_id", F.round("drift", 5).alias("drift"), "typical_place", F.array_join(said, ", ").alias("top"))


@query(f"""
, {STRESSED}, sc2 AS (SELECT record_id, round(1 - p0, 4) AS anomaly, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'benign' WHEN p1 >= p2 THEN 'brute_force' ELSE 'lateral_movement' END AS predicted_class FROM pb WHERE scenario = 'noise 0' AND NOT is_train)
SELECT ev.record_id, us.department, us.privilege_level, lb.is_attack, lb.attack_id, lb.attack_type, atk.severity AS campaign_severity, coalesce(atk.num_events, 0) AS num_events, {", ".join(f"round(fx.{n}, 6) AS {n}" for n in SHOWN)}, anomaly, predicted_class
FROM ev JOIN sc2 USING (record_id) LEFT JOIN lb USING (record_id) LEFT JOIN us ON us.user_id = ev.user_id LEFT JOIN atk ON atk.attack_id = lb.attack_id LEFT JOIN fx ON fx.record_id = ev.record_id""")
def test_detail(log: Log) -> DataFrame:
    """Each test event with its label, person, campaign, features, and the fixed model's score and class."""
    log = log.kept()
    rows = shown_features(log).where("not is_train")
    p = fixed_probabilities()
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    scores = rows.select("record_id", p.alias("p")).select("record_id", F.round(1 - F.get("p", F.lit(0)), 4).alias("anomaly"), F.get(F.array(F.lit("benign"), F.lit("brute_force"), F.lit("lateral_movement")), best).alias("predicted_class"))
    attacks = log.attacks.select("attack_id", F.col("severity").alias("campaign_severity"), F.col("num_events"))
    events = log.events.select("record_id", "user_id").join(scores.select("record_id"), "record_id", "left_semi")
    out = analyst.full_detail(events, log.labels.select("record_id", "is_attack", "attack_id", "attack_type"), log.users.select("user_id", "department", "privilege_level"), attacks, rows.select("record_id", *(F.round(n, 6).alias(n) for n in SHOWN)), scores)
    return out.drop("user_id").fillna(0, ["num_events"])


@query(f"""
, {FLAG}, {FEATS}, pe AS (SELECT record_id, count(*) OVER w AS pe FROM (SELECT record_id, user_id, epoch_us(ts) AS t FROM ev) z WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, s AS (SELECT record_id, concat_ws(' ', CASE WHEN is_new_edge > 0.5 THEN 'First use of this device by the account within the window.' END,
  CASE WHEN velocity_kmh > 800 THEN 'Reaching this place took ' || format('{{:,.0f}}', velocity_kmh) || ' km/h.' WHEN geo_distance_from_home_km > 1000 THEN 'The place lies ' || format('{{:,.0f}}', geo_distance_from_home_km) || ' km away from home.' END,
  CASE WHEN pe < 5 THEN 'Only ' || CAST(pe AS STRING) || ' earlier events are known.' END) AS e FROM fl JOIN ft USING (record_id) JOIN pe USING (record_id))
SELECT record_id, CASE WHEN e = '' THEN 'Nothing stands out by itself.' ELSE e END AS evidence FROM s""")
def evidence_sentences(log: Log) -> DataFrame:
    return analyst.evidence_sentences(signals(log)).select("record_id", F.array_join("evidence", " ").alias("evidence"))


def longs_of(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def own_signs() -> str:
    return "".join(f" UNION ALL SELECT record_id, '{c}', {n}, {list(a)} FROM fl JOIN zz USING (record_id) WHERE z_{f} >= 2" for f, (c, n, a) in analyst.OWN.items())


SIGNS = f"""{FEATS}, {zs()}, pa AS (SELECT user_id, count_if(score >= {THRESHOLD}) - 1 AS pa FROM ev GROUP BY user_id), pc AS (SELECT record_id, (rank() OVER (ORDER BY score) - 1) / count(*) OVER () AS pct FROM ev)
, sg AS (SELECT fl.record_id, 'score' AS category, 3 AS strength, ['disable_account', 'escalate_soc', 'require_mfa'] AS actions FROM fl JOIN pc USING (record_id) WHERE pct >= 0.99
  UNION ALL SELECT fl.record_id, 'score', 2, ['require_mfa', 'escalate_soc'] FROM fl JOIN pc USING (record_id) WHERE pct >= 0.9 AND pct < 0.99
  UNION ALL SELECT record_id, 'severity', 3, ['disable_account', 'escalate_soc'] FROM fl WHERE severity = 'critical' UNION ALL SELECT record_id, 'severity', 2, ['escalate_soc', 'require_mfa'] FROM fl WHERE severity = 'high'
  UNION ALL SELECT record_id, 'login_failure', 2, ['reset_password', 'disable_account'] FROM fl JOIN ft USING (record_id) WHERE failed_login_ratio > 0.5
  UNION ALL SELECT record_id, 'geo', 3, ['require_mfa', 'disable_account', 'escalate_soc'] FROM fl JOIN ft USING (record_id) WHERE velocity_kmh > 800
  UNION ALL SELECT record_id, 'device', 2, ['require_mfa', 'block_device'] FROM fl JOIN ft USING (record_id) WHERE is_new_edge > 0.5{own_signs()}
  UNION ALL SELECT record_id, 'mitre', 2, CASE tactic WHEN 'Credential Access' THEN ['require_mfa', 'reset_password'] WHEN 'Initial Access' THEN ['require_mfa'] WHEN 'Defense Evasion' THEN ['block_device', 'escalate_soc'] ELSE ['disable_account', 'escalate_soc'] END FROM fl WHERE tactic IS NOT NULL
  UNION ALL SELECT record_id, 'privilege', 2, ['disable_account', 'escalate_soc'] FROM fl WHERE privilege_level IN ('admin', 'domain_admin')
  UNION ALL SELECT record_id, 'history', 2, ['escalate_soc', 'disable_account'] FROM fl JOIN pa USING (user_id) WHERE pa > 0)
, r AS (SELECT record_id, category, strength, unnest(actions) AS action FROM sg)
, k AS (SELECT record_id, action, CAST(sum(strength) AS BIGINT) AS score, count(DISTINCT category) AS categories, count(DISTINCT category) >= 2 AS recommended FROM r GROUP BY record_id, action)"""


@query(f", {FLAG}, {SIGNS} SELECT * FROM k")
def action_scores(log: Log) -> DataFrame:
    """Actions by all nine kinds of evidence."""
    return analyst.actions(analyst.evidence(signals(log))).select("record_id", "action", longs_of("score"), "categories", "recommended")


@query(f"""
, {FLAG}, {SIGNS}, ct AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{c}')" for a, c in analyst.CONTROLS.items())}) t(action, controls))
SELECT record_id, k.action, score, categories, recommended, CASE WHEN NOT recommended THEN NULL WHEN score >= 6 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN NOT recommended THEN NULL WHEN categories >= 4 THEN 'High' WHEN categories >= 3 THEN 'Medium' ELSE 'Low' END AS confidence,
  row_number() OVER (PARTITION BY record_id, recommended ORDER BY score DESC, k.action) AS place, controls FROM k LEFT JOIN ct ON ct.action = k.action""")
def recommendations(log: Log) -> DataFrame:
    return analyst.actions(analyst.evidence(signals(log))).select("record_id", "action", longs_of("score"), "categories", "recommended", "priority", "confidence", longs_of("place"), "controls")


@query(f"""
, n AS (SELECT user_id, device_id, count(*) AS n FROM ev GROUP BY user_id, device_id), d AS (SELECT user_id, string_agg(device_id, ',' ORDER BY r) AS devices FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, device_id) AS r FROM n) z WHERE r <= 3 GROUP BY user_id)
, h AS (SELECT user_id, hour(ts) AS hr, count(*) AS n FROM ev GROUP BY user_id, hour(ts)), g AS (SELECT user_id, sum(n) AS events, first(hr ORDER BY n DESC, hr) AS hr FROM h GROUP BY user_id)
SELECT user_id, devices, CAST(events AS BIGINT) AS events, CAST(CASE WHEN events >= 5 THEN hr END AS BIGINT) AS hour, CAST(CASE WHEN events >= 5 THEN least(abs(hr - 20), 24 - abs(hr - 20)) END AS BIGINT) AS gap FROM d JOIN g USING (user_id)""")
def user_profiles(log: Log) -> DataFrame:
    out = analyst.user_profile(log.events)
    return longs(out.withColumn("gap", analyst.hour_gap(F.col("hour"), F.lit(20))), "hour", "gap")


@query(f"""
, {FLAG}, t AS (SELECT * FROM fl ORDER BY score DESC, record_id LIMIT 150)
SELECT 'user:' || CAST(user_id AS STRING) AS src, 'device:' || device_id AS dst, arg_max(is_attack, (ts, record_id)) AS anomalous FROM t GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'user:' || CAST(user_id AS STRING), 'resource:' || resource_accessed, NULL FROM t WHERE resource_accessed IS NOT NULL""")
def entity_edges(log: Log) -> DataFrame:
    return analyst.entity_edges(hits(log))


@query(f"""
, {FLAG}, t AS (SELECT * FROM fl ORDER BY score DESC, record_id LIMIT 150)
, d AS (SELECT DISTINCT 'user:' || CAST(user_id AS STRING) AS a, 'device:' || device_id AS b FROM t UNION SELECT DISTINCT 'user:' || CAST(user_id AS STRING), 'resource:' || resource_accessed FROM t WHERE resource_accessed IS NOT NULL)
, n AS (SELECT a AS node, b AS other FROM d UNION ALL SELECT b, a FROM d) SELECT node, count(*) AS degree, string_agg(DISTINCT other, ',' ORDER BY other) AS neighbours FROM n GROUP BY node""")
def node_degrees(log: Log) -> DataFrame:
    return analyst.node_degrees(analyst.entity_edges(hits(log)))


@query(f"""
, {FLAG}, t AS (SELECT * FROM fl ORDER BY score DESC, record_id LIMIT 150)
, d AS (SELECT DISTINCT 'user:' || CAST(user_id AS STRING) AS a, 'device:' || device_id AS b FROM t UNION SELECT DISTINCT 'user:' || CAST(user_id AS STRING), 'resource:' || resource_accessed FROM t WHERE resource_accessed IS NOT NULL)
, n AS (SELECT a AS node, b AS other FROM d UNION ALL SELECT b, a FROM d)
, f AS (SELECT node, count(*) AS flagged FROM (SELECT 'user:' || CAST(user_id AS STRING) AS node FROM fl UNION ALL SELECT 'device:' || device_id FROM fl UNION ALL SELECT 'resource:' || resource_accessed FROM fl WHERE resource_accessed IS NOT NULL) z GROUP BY node)
SELECT node, count(*) AS degree, string_agg(DISTINCT other, ',' ORDER BY other) AS neighbours, max(flagged) AS flagged FROM n JOIN f USING (node) GROUP BY node""")
def node_inspection(log: Log) -> DataFrame:
    """The nodes of the entity graph with their neighbours and their flagged events in the whole log."""
    rows = hits(log)
    return analyst.node_degrees(analyst.entity_edges(rows)).join(analyst.node_flags(rows), "node")


CAMP = f"""ca AS (SELECT attack_id, min(attack_type) AS attack_type, min(severity) AS severity, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT department) AS departments, count(DISTINCT device_id) AS devices,
  epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end", CAST(count_if(score >= {THRESHOLD}) AS BIGINT) AS detected, count_if(score >= {THRESHOLD}) / count(*) AS rate FROM de WHERE attack_id IS NOT NULL GROUP BY attack_id)"""


@query(f", {WIDE}, {CAMP} SELECT * REPLACE (round(rate, 6) AS rate) FROM ca")
def campaigns(log: Log) -> DataFrame:
    out = analyst.campaigns(wide(log), THRESHOLD)
    return r6(out.withColumns({c: F.unix_micros(c) for c in ("start", "end")}), "rate")


@query(f", {WIDE}, {CAMP} SELECT attack_type, round(avg(rate), 6) AS rate, count(*) AS campaigns FROM ca GROUP BY attack_type")
def detection_by_type(log: Log) -> DataFrame:
    return r6(analyst.campaigns(wide(log), THRESHOLD).groupBy("attack_type").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("campaigns")), "rate")


@query(f", {WIDE}, x AS (SELECT tactic, trim(unnest(string_split(technique_ids, ','))) AS technique FROM de WHERE technique_ids IS NOT NULL) SELECT tactic, technique, count(*) AS n FROM x GROUP BY tactic, technique")
def technique_matrix(log: Log) -> DataFrame:
    return analyst.techniques(wide(log))


@query(f", {WIDE} SELECT record_id, tactic, trim(unnest(string_split(technique_ids, ','))) AS technique FROM de WHERE technique_ids IS NOT NULL")
def event_techniques(log: Log) -> DataFrame:
    return analyst.event_techniques(wide(log))


@query(f""", {WIDE} SELECT attack_type, severity, tactic, count(*) AS n FROM de WHERE is_attack GROUP BY attack_type, severity, tactic""")
def type_by_severity(log: Log) -> DataFrame:
    return wide(log).where("is_attack").groupBy("attack_type", "severity", "tactic").agg(F.count(F.lit(1)).alias("n"))


@query(f""", {WIDE} SELECT department, count_if(severity = 'low') AS low, count_if(severity = 'medium') AS medium, count_if(severity = 'high') AS high, count_if(severity = 'critical') AS critical FROM de WHERE is_attack GROUP BY department""".replace("count_if(", "CAST(count_if(").replace("') AS", "') AS BIGINT) AS"))
def severity_by_department(log: Log) -> DataFrame:
    return analyst.severity_by_department(wide(log).where("is_attack"))


@query(f""", {WIDE}, g AS (SELECT geo_country, round(avg(score), 6) AS mean_score, count(*) AS n FROM de GROUP BY geo_country) SELECT * FROM g ORDER BY mean_score DESC, geo_country LIMIT 15""")
def country_risk(log: Log) -> DataFrame:
    g = log.events.groupBy("geo_country").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("mean_score").desc(), "geo_country").limit(15)


@query(f", {WIDE} SELECT department, round(sum(score), 4) AS risk, count(*) AS n FROM de GROUP BY department")
def department_risk(log: Log) -> DataFrame:
    return wide(log).groupBy("department").agg(F.round(F.sum("score"), 4).alias("risk"), F.count(F.lit(1)).alias("n"))


@query(f"""
, {SCORED}, v AS (SELECT attack_type, avg(CAST(score >= 0.7 AS INT)) AS a, avg(CAST(score >= 0.5 AS INT)) AS b, count(*) AS n FROM sc WHERE attack_type IS NOT NULL GROUP BY attack_type) SELECT attack_type, n AS labelled, round(greatest(a, b), 6) AS best_recall FROM v""")
def attack_coverage(log: Log) -> DataFrame:
    s = scored(log).where("attack_type is not null")
    models = F.array(F.struct(F.lit("strict").alias("model"), F.col("pred").alias("hit")), F.struct(F.lit("half").alias("model"), (F.col("score") >= 0.5).alias("hit")))
    per = s.select("attack_type", F.inline(models)).groupBy("attack_type", "model").agg(F.avg(F.col("hit").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return r6(per.groupBy("attack_type").agg(F.max("n").alias("labelled"), F.max("r").alias("best_recall")), "best_recall")


@query("""
SELECT user_id, record_id, round(CAST(score AS DOUBLE), 6) AS score, geo_lat FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) AS r FROM ev) z WHERE r <= 5""")
def trend_history(log: Log) -> DataFrame:
    rows = log.events.select("record_id", F.round(F.col("score").cast("double"), 6).alias("score"), "geo_lat")
    return schema.history(rows, log.events, last=5).select("user_id", "record_id", "score", "geo_lat")


# --- learners (rows only: no SQL form) --------------------------------------------------------------

LEARN = ["score", "geo_lat", "geo_lon", "hour"]


def training(log: Log) -> DataFrame:
    rows = log.events.join(log.labels.hint("merge"), "record_id")  # a row per event: no task may hold all
    return rows.select("record_id", "ts", F.col("score").cast("double"), "geo_lat", "geo_lon", F.hour("ts").cast("double").alias("hour"), "is_attack", C.class_index(F.col("attack_type"), learn.CLASSES).cast("double").alias("label"))


@query()
def isolation_scores(log: Log) -> DataFrame:
    rows = training(log)
    return learn.isolation_score(rows, LEARN, learn.isolation_forest(rows, LEARN))


@query()
def classifier_scores(log: Log) -> DataFrame:
    """Class-weighted forest, trained on the first 70 % of the log."""
    rows = training(log)
    train = rows.join(evaluate.chronological_split(log.events).where("is_train").select("record_id"), "record_id", "left_semi")
    return learn.class_scores(learn.train_classifier(learn.class_weights(train), LEARN, weighted=True), rows, LEARN).drop("p")


def drawn(seed: int, *key: str) -> str:
    """learn.drawn in SQL."""
    return f"CAST('0x' || substr(md5({' || '.join(f'CAST({k} AS VARCHAR) || chr(45)' for k in key)} || '{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0"


LEARNT = ["score", "geo_lat", "geo_lon", "hour"]


@query(f"""
, x AS (SELECT record_id, coalesce(attack_type, 'benign') AS kind, CAST(score AS DOUBLE) AS score, geo_lat, geo_lon, CAST(hour(ts) AS DOUBLE) AS hour FROM ev JOIN lb USING (record_id))
, n AS (SELECT kind, count(*) AS c, {", ".join(f"coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}" for f in LEARNT)} FROM x GROUP BY kind)
, m AS (SELECT x.*, n.* EXCLUDE (kind), (SELECT max(c) FROM n) AS top, row_number() OVER (PARTITION BY kind ORDER BY {drawn(42, "record_id")}, record_id) AS nth FROM x JOIN n USING (kind) WHERE c < (SELECT max(c) FROM n))
, nb AS (SELECT u.record_id, v.record_id AS other, row_number() OVER (PARTITION BY u.record_id ORDER BY {" + ".join(f"pow((u.{f} - v.{f}) / u.s_{f}, 2)" for f in LEARNT)}, v.record_id) AS r FROM m u JOIN m v ON u.kind = v.kind AND u.record_id <> v.record_id)
, nl AS (SELECT record_id, list(other ORDER BY r) AS near FROM nb WHERE r <= 5 GROUP BY record_id)
, mk AS (SELECT m.*, near, unnest(range(1, 1 + CAST((top - c) // c + CAST(nth <= (top - c) % c AS INT) AS BIGINT))) AS copy FROM m LEFT JOIN nl USING (record_id))
, ch AS (SELECT *, coalesce(near[1 + CAST(floor({drawn(43, "record_id", "copy")} * len(near)) AS INT)], record_id) AS other, {drawn(44, "record_id", "copy")} AS u FROM mk)
, o AS (SELECT ch.kind, {", ".join(f"ch.{f} + u * (x.{f} - ch.{f}) AS {f}" for f in LEARNT)} FROM ch JOIN x ON x.record_id = ch.other UNION ALL SELECT kind, {", ".join(LEARNT)} FROM x)
SELECT kind, count(*) AS n, {", ".join(f"round(avg({f}), 5) AS {f}, round(sum({f} * {f}) / count(*), 4) AS {f}_squared" for f in LEARNT)} FROM o GROUP BY kind""")
def oversampled(log: Log) -> DataFrame:
    """Classes brought to one size: every interpolated row tells in the means of features and of their squares."""
    made = learn.smote(materialised(training(log)), LEARN)
    kind = F.get(F.array(*map(F.lit, learn.CLASSES)), F.col("label").cast("int"))
    means = [x for f in LEARN for x in (F.round(F.avg(f), 5).alias(f), F.round(F.avg(F.col(f) * F.col(f)), 4).alias(f"{f}_squared"))]
    return made.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), *means)


@query()
def boosted_scores(log: Log) -> DataFrame:
    """Boosted trees over all classes, out of fold, with tuned thresholds for the class: 300 rounds of depth 6, as the reference fits them."""
    rows = materialised(training(log))
    p = materialised(learn.out_of_fold(rows, LEARN, boosted=True))
    index = F.array_position("p", F.array_max("p")).cast("int") - 1
    each = p.join(rows.select("record_id", F.col("label").cast("int").alias("truth")), "record_id").select("truth", index.alias("guess"), F.posexplode("p").alias("class", "p"))
    tuned = {int(r["class"]): float(r.threshold) for r in learn.tuned_thresholds(each).select("class", "threshold").collect()}  # a row per class
    return p.select("record_id", F.round("score", 6).alias("score"), learn.decode(F.col("p"), tuned).alias("class"))


@query("""
, s AS (SELECT record_id, coalesce(attack_type, 'benign') <> 'benign' AS truth, CAST(score AS DOUBLE) AS p FROM ev JOIN lb USING (record_id))
, l AS (SELECT truth, p >= 0.5 AS guess, p FROM s), b AS (SELECT coalesce(2 * count_if(truth AND guess) / nullif(count_if(guess) + count_if(truth), 0), 0) AS base FROM l)
, d AS (SELECT p, count_if(truth) AS pos, count(*) AS n FROM l GROUP BY p), r AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS real FROM d WINDOW w AS (ORDER BY p DESC))
, f AS (SELECT p, CASE WHEN said + real > 0 THEN 2 * tp / (said + real) ELSE 0 END AS f1 FROM r)
SELECT CAST(1 AS INT) AS class, round(arg_max(p, (round(f1, 12), -p)), 6) AS threshold, round(max(f1), 6) AS f1 FROM f, b GROUP BY base HAVING max(f1) > base""")
def tuned_threshold(log: Log) -> DataFrame:
    """The threshold of best f1 for attacks, over every distinct score."""
    rows = training(log).select(F.col("is_attack").cast("int").alias("truth"), (F.col("score") >= 0.5).cast("int").alias("guess"), F.lit(1).alias("class"), F.col("score").alias("p"))
    return r6(learn.tuned_thresholds(rows), "threshold", "f1")


@query("""
, s AS (SELECT record_id, CAST(score AS DOUBLE) AS a FROM ev), p AS (SELECT record_id, [1 - a, a * 0.7, a * 0.3] AS p FROM s)
SELECT record_id, CAST(CASE WHEN p[2] >= 0.3 AND NOT (p[1] < p[2]) THEN 1 WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 0 ELSE 1 END AS INT) AS class FROM p""")
def decoded_classes(log: Log) -> DataFrame:
    """The most probable of three classes, unless the second clears its tuned threshold of 0.3."""
    a = F.col("score").cast("double")
    return log.events.select("record_id", learn.decode(F.array(1 - a, a * 0.7, a * 0.3), {1: 0.3}).cast("int").alias("class"))


@query("""
, e AS (SELECT lb.attack_id, lb.attack_type, lb.severity, ev.* FROM ev JOIN lb USING (record_id) WHERE is_attack)
, p AS (SELECT attack_id, min(attack_type) AS attack_type, min(severity) = 'low' AS cut, count_if(coalesce(auth_result = 'failure', false)) AS failures, count(DISTINCT user_id) AS accounts, count(DISTINCT device_id) AS devices,
  count(DISTINCT device_id || chr(31) || device_type || chr(31) || os) AS signatures, coalesce(list_sort(list_distinct(list(geo_country) FILTER (WHERE geo_country IS NOT NULL))), []) AS countries,
  coalesce(list_sort(list_distinct(list(resource_accessed) FILTER (WHERE resource_accessed IS NOT NULL))), []) AS resources FROM e GROUP BY attack_id)
, j AS (SELECT *, CAST(to_json({'failures': failures, 'accounts': accounts, 'devices': devices, 'signatures': signatures, 'countries': countries, 'resources': resources}) AS VARCHAR) AS json FROM p)
SELECT attack_id, CASE WHEN cut THEN left(json, 20) ELSE json END AS parameters, CASE WHEN NOT cut THEN failures END AS failures, CASE WHEN cut THEN 0 ELSE len(countries) END AS n_countries, CASE WHEN NOT cut THEN resources[1] END AS first_resource,
  CASE WHEN cut THEN 'No parameters on record.' WHEN attack_type = 'brute_force' THEN failures || ' failed logins on ' || accounts || ' accounts.' WHEN attack_type = 'impossible_travel' THEN 'Logins from ' || len(countries) || ' countries: ' || array_to_string(countries, ', ') || '.'
    WHEN attack_type = 'device_spoofing' THEN devices || ' devices showed ' || signatures || ' signatures.' WHEN attack_type = 'lateral_movement' THEN len(resources) || ' resources in one chain: ' || array_to_string(resources, ', ') || '.'
    ELSE accounts || ' accounts reached: ' || array_to_string(resources, ', ') || '.' END AS rationale FROM j""")
def campaign_parameters(log: Log) -> DataFrame:
    """Campaigns' parameters as JSON, made of their events; read back, and put in words. Those of low severity are
    torn, as records can be, and must read as none."""
    events = log.events.join(log.labels.where("is_attack"), "record_id")
    held = detectors.campaign_parameters(events).join(log.attacks.select("attack_id", "attack_type", "severity"), "attack_id")
    held = held.withColumn("parameters", F.when(F.col("severity") == "low", F.left("parameters", F.lit(20))).otherwise(F.col("parameters")))
    out = detectors.campaign_rationale(held)
    return out.select("attack_id", "parameters", "failures", F.size("countries").alias("n_countries"), F.get("resources", F.lit(0)).alias("first_resource"), "rationale")


@query(f"""
, x AS (SELECT record_id, is_attack, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY is_attack ORDER BY {drawn(42, "record_id")}, record_id) AS nth FROM ev JOIN lb USING (record_id))
SELECT is_attack, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids, round(avg(score), 6) AS score FROM x WHERE is_attack OR nth <= 600 GROUP BY is_attack""")
def undersampled(log: Log) -> DataFrame:
    """All attacks and 600 benign events: their ids tell which."""
    kept = learn.undersample(training(log), 600).groupBy("is_attack")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"), F.round(F.avg("score"), 6).alias("score"))


@query()
def online_scores(log: Log) -> DataFrame:
    """The log in ten parts by time, each scored before it is learnt from."""
    rows = training(log).withColumns({"geo_lat": F.col("geo_lat") / 60, "geo_lon": F.col("geo_lon") / 170, "hour": F.col("hour") / 24, "is_train": F.lit(True)})
    part = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3)
    return learn.online(rows.withColumn("part", F.when(part >= 9, 9).when(part < 9, F.greatest(part, F.lit(0))).cast("int")), "part", LEARN)


@query()
def leakage_audit(log: Log) -> DataFrame:
    ids = schema.bookkeeping(log.events).withColumn("id_hash", (F.shiftrightunsigned(F.xxhash64("record_id", F.lit(9)), 11) / float(1 << 53)))
    rows = ids.join(log.labels.select("record_id", "is_attack"), "record_id")
    out = learn.leakage_audit(rows, ["insertion_order", "generation_batch", "id_hash"])
    return r6(out, "mean_auc", "min_auc", "max_auc", "std_auc")
