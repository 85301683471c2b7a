"""Table contracts: validation in one pass, assembly of the log, bookkeeping ids, run summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a column must be. kind: prefix of the Spark type; values: closed vocabulary; low, high: range."""

    column: str
    kind: str
    nullable: bool = True
    values: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None


EVENT_RULES = (
    Rule("record_id", "bigint", nullable=False),
    Rule("ts", "timestamp", nullable=False),
    Rule("user_id", "bigint", nullable=False),
    Rule("event_type", "string", nullable=False, values=("login_attempt", "resource_access")),
    Rule("auth_result", "string", values=("success", "failure")),
    Rule("device_type", "string", nullable=False, values=("desktop", "laptop", "mobile", "server", "unknown")),
    Rule("resource_accessed", "string", values=("email", "vpn", "crm", "hr_system", "code_repo", "file_share", "admin_console")),
    Rule("geo_lat", "double", low=-90.0, high=90.0),
    Rule("geo_lon", "double", low=-180.0, high=180.0),
    Rule("is_off_hours", "boolean", nullable=False),
)


def violations(df: DataFrame, rules: tuple[Rule, ...], table: str) -> DataFrame:
    """(table, column, rule, n_bad) for every rule that is broken; one aggregation over the rows."""
    kinds = dict(df.dtypes)
    static, checks = [], {}
    for r in rules:
        if r.column not in kinds:
            static.append((table, r.column, "missing", 1))
            continue
        if not kinds[r.column].startswith(r.kind):
            static.append((table, r.column, "type", 1))
            continue
        c = F.col(r.column)
        if not r.nullable:
            checks[(r.column, "null")] = c.isNull()
        if r.values:
            checks[(r.column, "vocabulary")] = ~c.isin(*r.values)
        if r.low is not None:
            checks[(r.column, "range")] = ~c.between(r.low, r.high)
    spark = df.sparkSession
    out = spark.createDataFrame(static, "table string, column string, rule string, n_bad long")
    if checks:
        entry = lambda k, c: F.struct(F.lit(table).alias("table"), F.lit(k[0]).alias("column"), F.lit(k[1]).alias("rule"), F.count_if(c).alias("n_bad"))
        found = df.agg(F.array(*(entry(k, c) for k, c in checks.items())).alias("a")).select(F.inline("a"))
        out = out.unionByName(found.where("n_bad > 0"))
    return out


def assemble(benign: DataFrame, attack: DataFrame, campaigns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, labels): attack rows carry attack_id; labels live in a table of their own."""
    both = benign.unionByName(attack, allowMissingColumns=True)
    labels = both.select("record_id", F.col("attack_id").isNotNull().alias("is_attack"), "attack_id")
    labels = labels.join(campaigns.select("attack_id", "attack_type", "technique_ids"), "attack_id", "left")
    return both.drop("attack_id"), labels


def bookkeeping(events: DataFrame, seed: int = 42, batches: int = 16) -> DataFrame:
    """(record_id, insertion_order, generation_batch) that tell nothing of labels: order by a seeded
    hash, ranked within hash buckets so that no task sorts all rows."""
    from authspan.functions.columns import global_rank

    h = F.xxhash64("record_id", F.lit(seed))
    rows = events.select("record_id", h.alias("h"))
    rows = global_rank(rows, "h", "record_id", name="insertion_order")
    return rows.select("record_id", "insertion_order", F.pmod(F.xxhash64("record_id", F.lit(seed + 1)), F.lit(batches)).cast("int").alias("generation_batch"))


def run_summary(users: DataFrame, events: DataFrame, labels: DataFrame, drift: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    parts = [
        users.agg(one.alias("users")),
        events.agg(one.alias("events"), F.count_distinct("user_id").alias("active_users")),
        labels.agg(F.count_if("is_attack").alias("attack_events"), F.count_distinct("attack_id").alias("campaigns"), F.avg(F.col("is_attack").cast("double")).alias("attack_ratio")),
        drift.agg(one.alias("drift_events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def overridden(users: DataFrame, rollout: DataFrame, day: Column, attributes: dict[str, tuple[str, str]]) -> DataFrame:
    """users as of a day: each attribute takes its override from the rollout day of its change type on.

    rollout: (user_id, change_type, drift_day, <override columns>); attributes: column -> (change type, override column).
    """
    out = users
    for column, (change, override) in attributes.items():
        r = rollout.where(F.col("change_type") == change).groupBy("user_id").agg(F.max(F.when(F.col("drift_day") <= day, F.col(override))).alias("_o"))
        out = out.join(r, "user_id", "left").withColumn(column, F.coalesce("_o", column)).drop("_o")
    return out


def history(features: DataFrame, events: DataFrame, last: int | None = None) -> DataFrame:
    """Features with user and time, sorted within users; last keeps each user's newest rows only."""
    rows = features.join(events.select("record_id", "user_id", "ts"), "record_id")
    if last is not None:
        newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("record_id").desc())
        rows = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "record_id")


def sequences(features: DataFrame, events: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """(record_id, text): the user's last k events, this one included, as 'name=value' parts joined by ' | '."""
    part = F.concat_ws(" ", *(F.concat(F.lit(f"{n}="), F.format_string("%.3f", F.col(n))) for n in names))
    rows = features.join(events.select("record_id", "user_id", "ts"), "record_id").withColumn("part", part)
    w = Window.partitionBy("user_id").orderBy("ts", "record_id").rowsBetween(1 - k, 0)
    return rows.select("record_id", F.array_join(F.collect_list("part").over(w), " | ").alias("text"))
