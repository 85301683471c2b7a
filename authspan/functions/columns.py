"""Column expressions: geography, clock, ordering, averages, text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from authspan.sources.scratch import materialised

EARTH_KM = 6371.0
DAY_US = 86_400_000_000
#: Events of one key and time that keep an order of their own.
TIES = 1024

# Ascending privilege, value tiers and least privilege of resources.
PRIVILEGES = ("standard", "elevated", "admin", "domain_admin")
TIERS = {"email": 0, "vpn": 0, "crm": 1, "code_repo": 1, "file_share": 1, "hr_system": 2, "admin_console": 3}
LEAST_PRIVILEGE = {"email": "standard", "vpn": "standard", "file_share": "standard", "crm": "standard", "code_repo": "standard", "hr_system": "elevated", "admin_console": "admin"}


def lookup(values: dict, key: Column) -> Column:
    """A small fixed table as a map literal; null for what it lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def off_shift(hour: Column, start: Column, end: Column) -> Column:
    """Outside [start, end]; a shift that ends before it starts runs over midnight."""
    return F.when(start <= end, ~hour.between(start, end)).otherwise(~((hour >= start) | (hour <= end)))


def off_hours(ts: Column) -> Column:
    return ~F.hour(ts).between(7, 19)


def weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def holiday(ts: Column, dates: list[str]) -> Column:
    """Whether the day is one of dates (yyyy-mm-dd)."""
    return F.to_date(ts).isin([F.to_date(F.lit(d)) for d in dates])


def privilege_rank(level: Column) -> Column:
    """1 for the lowest; 0 for an unknown level."""
    return F.array_position(F.array(*[F.lit(p) for p in PRIVILEGES]), level)


def class_index(label: Column, classes: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.coalesce(label, F.lit(classes[0]))) - 1).cast("int")


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def parse_list(text: Column, schema: str) -> Column:
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def fixed_point(score: Column, scale: int = 10_000) -> Column:
    """score * scale as a whole number, halves to even; null for a negative score."""
    return F.when(score >= 0, F.bround(score * scale).cast("long"))


def in_order(df: DataFrame, *key: str, name: str = "ok", tie: str = "record_id") -> DataFrame:
    """df with a long that orders a key's events by time, then tie."""
    return df.withColumn(name, order_number(F.row_number().over(Window.partitionBy(*key, "ts").orderBy(tie)) - 1))


def order_number(nth: Column) -> Column:
    """Of the nth event at its time; fails where more events share a time than the numbers between two microseconds."""
    return F.when(nth < TIES, F.unix_micros("ts") * TIES + nth).otherwise(F.raise_error(F.lit(f"over {TIES} events of one key in one microsecond")).cast("long"))


def reach(days: float) -> int:
    """How far back in order numbers a window of days goes, its edge included."""
    return int(days * DAY_US) * TIES + TIES - 1


def before(key: list[str] | str, days: float, order: str = "ok") -> WindowSpec:
    """Rows of the key strictly before the current one, at most days old."""
    return Window.partitionBy(key).orderBy(order).rangeBetween(-reach(days), -1)


def ever_before(key: list[str] | str, order: str = "ok") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def fold_ema(values: Column, keep: float) -> Column:
    """e <- keep * e + (1 - keep) * x over an array, from 0."""
    return F.aggregate(values, F.lit(0.0), lambda e, x: e * keep + x * (1 - keep))


def entropy(values: Column) -> Column:
    """Shannon entropy in bits of an array's values; 0 if empty."""
    n = F.size(values)
    shares = F.transform(F.array_distinct(values), lambda v: (n - F.size(F.array_remove(values, v))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, s: a - s * F.log2(s))


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (name: of which column) along order within by, each row's own included.

    Rows are dealt by ranges of (by, order), so that neither one group nor one stretch of the order is
    one task. What a range adds to is a group that goes on from the range before, so each range has one such
    group at most: these starts are as few as ranges, and broadcast. Rows that tie in order stand in any order.
    """
    held = materialised(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    totals = held.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    past = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.count(F.lit(1)).over(past).alias("_earlier")
    starts = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), earlier, *(F.coalesce(F.sum(f"_t{i}").over(past), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))))
    starts = F.broadcast(starts.where("_earlier > 0").drop("_earlier"))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = held.withColumns({f"_r{i}": F.sum(c).over(inside) for i, c in enumerate(sums.values())})
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = here.join(starts, same, "left")
    return out.select(*df.columns, *((F.col(f"_r{i}") + F.coalesce(f"_s{i}", F.lit(0))).alias(n) for i, n in enumerate(sums)))


def swept(changes: DataFrame, asked: DataFrame, by: list[str], name: str) -> DataFrame:
    """asked (by, ok, more) with name: the sum of the changes (by, at, d) of its key with at <= ok.

    Changes and questions are stacked along one order and summed by ranges of it, so a key with most rows
    is as many tasks as its rows need, and each row is met once however long a window the changes stand for.
    """
    rows = F.struct(*(c for c in asked.columns if c not in by)).alias("_row")
    both = asked.select(*by, F.col("ok").alias("at"), F.lit(0).alias("d"), rows).unionByName(changes.select(*by, "at", "d"), allowMissingColumns=True)
    out = running(both, by, [F.col("at"), F.col("_row").isNotNull()], {name: "d"}).where("_row is not null")
    return out.select(*by, "_row.*", name)


#: Rows of a block of fading(). keep ** -FADE_BLOCK must be a double.
FADE_BLOCK = 256


def fading(df: DataFrame, by: list[str], order: list[Column], value: str, keep: float, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with name, the average e <- keep * e + (1 - keep) * value over all earlier rows of by from 0, nth, the row's place from 1, and running sums.

    A stretch of rows maps an average e to keep ** rows * e + b. Rows are numbered by ranges of the order and cut
    into blocks of FADE_BLOCK rows; within a block the average is a sum of weighted values. A block's b goes on, faded, to the
    blocks behind it until its weight is beyond a double's digits. Nothing is windowed by more than a block.
    """
    rows = running(df.withColumn("_one", F.lit(1)), by, order, {"nth": "_one"} | (sums or {})).drop("_one")
    rows = rows.withColumns({"_b": F.expr(f"(nth - 1) div {FADE_BLOCK}"), "_i": ((F.col("nth") - 1) % FADE_BLOCK).cast("double")})
    rows = rows.withColumn("_w", F.pow(F.lit(1 / keep), F.col("_i")) * F.col(value))
    inside = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    part = (1 - keep) * F.pow(F.lit(keep), F.col("_i") - 1) * F.coalesce(F.sum("_w").over(inside), F.lit(0.0))
    names = [f"_by{i}" for i in range(len(by))]
    own = rows.groupBy(*by, "_b").agg(((1 - keep) * keep ** (FADE_BLOCK - 1) * F.sum("_w")).alias("b"), F.count(F.lit(1)).alias("_c"))
    own = own.where(F.col("_c") == FADE_BLOCK).drop("_c").toDF(*names, "_q", "b")  # only a full block has blocks behind it
    behind = int(math.log(1e-18) / math.log(keep)) // FADE_BLOCK + 2
    starts = own.select(*names, F.col("b"), F.posexplode(F.sequence(F.col("_q") + 1, F.col("_q") + behind)).alias("_k", "_q"))
    starts = starts.groupBy(*names, "_q").agg(F.sum(F.col("b") * F.pow(F.lit(keep**FADE_BLOCK), F.col("_k"))).alias("_s"))
    same = F.col("_b") == F.col("_q")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = rows.withColumn("_part", part).join(starts, same, "left")
    whole = F.pow(F.lit(keep), F.col("_i")) * F.coalesce("_s", F.lit(0.0)) + F.col("_part")
    return out.select(*df.columns, "nth", *(sums or {}), whole.alias(name))


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with its 0-based place in the total order, whose columns together are unique."""
    out = running(df.withColumn("_one", F.lit(1)), [], [F.col(c) for c in order], {"_n": "_one"})
    return out.withColumn(name, F.col("_n") - 1).drop("_one", "_n")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, name of each share): exact quantiles, linear between neighbours; nulls are left out.

    Equal values are counted, counts are summed along the order by ranges (running), and the two values at a share's
    place are the least ones whose sums reach it: partial minima, so that no task holds a group's values.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    summed = running(per, by, [F.col("_v")], {"_upto": "_c"})
    totals = summed.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    summed = summed.join(F.broadcast(totals) if not by else totals, same)
    place = lambda share: (F.col("_n") - 1) * share
    at = lambda k: F.min(F.when(F.col("_upto") >= k + 1, F.col("_v")))
    ends = [x.alias(f"_{i}{e}") for i, s in enumerate(shares.values()) for e, x in (("a", at(F.floor(place(s)))), ("b", at(F.ceil(place(s)))))]
    out = summed.groupBy(*by).agg(F.first("_n").alias("_n"), *ends)
    part = lambda s: place(s) - F.floor(place(s))
    return out.select(*by, *((F.col(f"_{i}a") + part(s) * (F.col(f"_{i}b") - F.col(f"_{i}a"))).alias(n) for i, (n, s) in enumerate(shares.items())))


def medians(rows: DataFrame, by: list[str], names: list[str], prefix: str) -> DataFrame:
    """(by, prefix + name): the exact median of each named column; one row without by, even of no rows."""
    long = rows.select(*by, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(by or [], names, "_name", "_value")
    mid = quantiles(long, [*by, "_name"], "_value", {"_mid": 0.5})
    return mid.groupBy(*by).pivot("_name", names).agg(F.first("_mid")).withColumnsRenamed({n: prefix + n for n in names}) if by else mid.agg(*(F.min(F.when(F.col("_name") == n, F.col("_mid"))).alias(prefix + n) for n in names))
