"""Views that make the driver's tables look like an authentication log.

The statements run unchanged in Spark and DuckDB; {name} stands for an input table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authspan.sources.scratch import materialised

EVENTS = """
WITH e0 AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}
), e1 AS (
  SELECT e0.*, c.c_nationkey AS home_g,
    CASE WHEN k % 20 = 0 THEN CAST((user_id + k) % 25 AS INT) ELSE c.c_nationkey END AS g,
    CASE WHEN event_type IN ('view','click') THEN 'resource_access' ELSE 'login_attempt' END AS et
  FROM e0 LEFT JOIN {customer} c ON c.c_custkey = e0.user_id
)
SELECT event_id AS record_id, ts, user_id, concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id, et AS event_type,
  CASE WHEN et = 'login_attempt' THEN CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END END AS auth_result,
  CASE WHEN k % 10 = 0 THEN concat('DEV-KIOSK-', CAST(user_id % 5 AS STRING)) WHEN k = 51 THEN concat('DEV-', CAST(user_id + 1 AS STRING), '-0')
    ELSE concat('DEV-', CAST(user_id AS STRING), '-', CAST(k % 3 AS STRING)) END AS device_id,
  CASE WHEN k = 37 THEN 'mobile' WHEN (user_id + k % 3) % 2 = 0 THEN 'laptop' ELSE 'desktop' END AS device_type,
  CASE WHEN k = 37 THEN 'iOS' WHEN (user_id + k % 3) % 2 = 0 THEN 'macOS' ELSE 'Windows' END AS os,
  n.n_name AS geo_country, concat('C', CAST(g AS STRING), '-', CAST(k % 2 AS STRING)) AS geo_city,
  CAST((g * 37) % 130 - 60 AS DOUBLE) AS geo_lat, CAST((g * 71) % 340 - 170 AS DOUBLE) AS geo_lon,
  CASE WHEN event_type = 'error' THEN NULL WHEN (user_id + k) % 7 = 0 THEN 'email' WHEN (user_id + k) % 7 = 1 THEN 'vpn'
    WHEN (user_id + k) % 7 = 2 THEN 'crm' WHEN (user_id + k) % 7 = 3 THEN 'hr_system' WHEN (user_id + k) % 7 = 4 THEN 'code_repo'
    WHEN (user_id + k) % 7 = 5 THEN 'file_share' ELSE 'admin_console' END AS resource_accessed,
  (hour(ts) < 7 OR hour(ts) > 19) AS is_off_hours, round(value / (value + 50.0), 6) AS score
FROM e1 LEFT JOIN {nation} n ON n.n_nationkey = e1.g
"""

USERS = """
SELECT c_custkey AS user_id, c_mktsegment AS department,
  CASE c_custkey % 8 WHEN 0 THEN 'admin' WHEN 1 THEN 'elevated' WHEN 2 THEN 'elevated' ELSE 'standard' END AS privilege_level,
  CAST(DATE '2023-12-01' + CAST(c_custkey % 60 AS INT) AS DATE) AS join_date,
  CAST((c_nationkey * 37) % 130 - 60 AS DOUBLE) AS home_lat, CAST((c_nationkey * 71) % 340 - 170 AS DOUBLE) AS home_lon
FROM {customer} WHERE c_custkey IN (SELECT user_id FROM {events})
"""

LABELS = """
SELECT event_id AS record_id, is_attack, CASE WHEN is_attack THEN concat('ATK-', CAST(blk AS STRING)) END AS attack_id,
  CASE WHEN is_attack THEN CASE blk % 5 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'impossible_travel' WHEN 2 THEN 'credential_misuse'
    WHEN 3 THEN 'lateral_movement' ELSE 'device_spoofing' END END AS attack_type,
  CASE WHEN is_attack THEN CASE blk % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END END AS severity
FROM (SELECT event_id, (event_id * 31 + user_id * 17) % 97 < 3 AS is_attack, CAST(floor(event_id / 100.0) AS BIGINT) AS blk FROM {events}) z
"""

ATTACKS = """
SELECT l.attack_id, min(l.attack_type) AS attack_type, min(l.severity) AS severity, min(e.ts) AS start_time, max(e.ts) AS end_time, count(*) AS num_events
FROM lb l JOIN ev e ON e.record_id = l.record_id WHERE l.is_attack GROUP BY l.attack_id
"""

# The drift calendar, the mapping of attack types, and home resources by department.
DRIFT = "SELECT * FROM (VALUES (7, 'remote_work_shift'), (20, 'schedule_shift')) AS t(day, change_type)"
TACTICS = """
SELECT * FROM (VALUES
  ('brute_force', 'Credential Access', 'TA0006', 'T1110,T1110.001,T1110.003'), ('impossible_travel', 'Initial Access', 'TA0001', 'T1078,T1078.004'),
  ('credential_misuse', 'Privilege Escalation', 'TA0004', 'T1078,T1078.002'), ('lateral_movement', 'Lateral Movement', 'TA0008', 'T1021'),
  ('device_spoofing', 'Defense Evasion', 'TA0005', 'T1036')) AS t(attack_type, tactic, tactic_id, technique_ids)
"""
HOME = """
SELECT * FROM (VALUES ('AUTOMOBILE', 'email,vpn,file_share'), ('BUILDING', 'email,vpn,crm'), ('FURNITURE', 'email,vpn,code_repo'),
  ('HOUSEHOLD', 'email,vpn,hr_system'), ('MACHINERY', 'email,vpn,admin_console')) AS t(department, resources)
"""

INPUTS = {n: n for n in ("events", "customer", "nation")}
#: What DuckDB oracles start with.
ORACLE = "WITH " + ", ".join(f"{n} AS ({sql.format(**INPUTS)})" for n, sql in (("ev", EVENTS), ("us", USERS), ("lb", LABELS), ("atk", ATTACKS), ("dl", DRIFT), ("tac", TACTICS), ("home", HOME)))


class Log:
    """The views over one dataset, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the log's times are UTC
        self.spark, self.dir, self.is_kept = spark, sf_dir, False

    def kept(self) -> Log:
        """The views with the log and its people written once, for queries that read them many times over."""
        if self.is_kept:
            return self
        out = Log(self.spark, self.dir)
        out.is_kept, out.events, out.users = True, materialised(self.events), materialised(self.users)
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def inputs(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in INPUTS}

    def _sql(self, text: str, **names: DataFrame) -> DataFrame:
        used = {k: v for k, v in (self.inputs | names).items() if "{" + k + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def events(self) -> DataFrame:
        return self._sql(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def users(self) -> DataFrame:
        return self._sql(USERS)

    @cached_property
    def labels(self) -> DataFrame:
        return self._sql(LABELS)

    @cached_property
    def attacks(self) -> DataFrame:
        text = ATTACKS.replace(" lb ", " {lb} ").replace(" ev ", " {ev} ")
        return self._sql(text, lb=self.labels, ev=self.events)

    @cached_property
    def drift(self) -> DataFrame:
        return self.spark.sql(DRIFT)

    @cached_property
    def tactics(self) -> DataFrame:
        return self.spark.sql(TACTICS)

    @cached_property
    def home(self) -> DataFrame:
        return self.spark.sql(HOME).withColumn("resources", F.split("resources", ","))
