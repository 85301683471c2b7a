"""Device, session, transition and community features, each from strictly earlier events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.functions import columns as C
from authspan.sources.scratch import materialised

FAR_RESOURCE = 10.0
LONG_HOP = 3600.0
FAR_DEVICE = 6
KEEP_DEVICE = 0.85
FOLD = 250


def device_features(events: DataFrame, days: float = 30) -> DataFrame:
    """record_id, device_fan_in, device_fingerprint_mismatch.

    Users on a device are counted by a sweep: a user's stretch of events, each at most days after the one before,
    adds one after its first event and takes it off days after its last. The first signature is one row a device.
    """
    e = C.in_order(events, "device_id").select("record_id", "device_id", "user_id", "ok", F.struct("device_type", "os").alias("mark"))
    e = materialised(e)
    pair, reach = Window.partitionBy("device_id", "user_id").orderBy("ok"), C.reach(days)
    opens = F.coalesce(F.col("ok") - F.lag("ok").over(pair) > reach, F.lit(True))
    closes = F.coalesce(F.lead("ok").over(pair) - F.col("ok") > reach, F.lit(True))
    change = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    both = F.array(F.when(opens, change(F.col("ok") + 1, 1)), F.when(closes, change(F.col("ok") + reach + 1, -1)))
    changes = e.select("device_id", F.array_compact(both).alias("both")).select("device_id", F.inline("both"))
    first = e.groupBy("device_id").agg(F.min_by("mark", "ok").alias("first")).withColumnRenamed("device_id", "_d")
    e = C.swept(changes, e.select("record_id", "device_id", "ok", "mark"), ["device_id"], "n").join(first, F.col("device_id").eqNullSafe(F.col("_d")))
    return e.select("record_id", F.col("n").cast("double").alias("device_fan_in"), (~F.col("mark").eqNullSafe(F.col("first"))).cast("double").alias("device_fingerprint_mismatch"))


def device_set_delta(events: DataFrame) -> DataFrame:
    """(record_id, user_device_set_delta): 1 - the device's share of the user's fading device weights."""
    e = C.in_order(events, "user_id")
    past = F.collect_list("device_id").over(Window.partitionBy("user_id").orderBy("ok").rowsBetween(-FOLD, -1))
    e = e.select("record_id", "device_id", past.alias("past"))
    n = F.size("past")
    fade = lambda i: F.pow(F.lit(KEEP_DEVICE), (n - 1 - i).cast("double"))
    hits = F.filter(F.transform("past", lambda d, i: F.when(d == F.col("device_id"), fade(i))), lambda x: x.isNotNull())
    own = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x * (1 - KEEP_DEVICE))
    delta = F.when(n == 0, F.lit(1.0)).otherwise(1 - own / (1 - F.pow(F.lit(KEEP_DEVICE), n.cast("double"))))
    return e.select("record_id", delta.alias("user_device_set_delta"))


def with_home(events: DataFrame, users: DataFrame, home: DataFrame) -> DataFrame:
    """events with the user's department, its home resources, and whether the event's resource is foreign to it."""
    known = users.select("user_id", "department").join(home, "department", "left")
    e = events.join(known, "user_id", "left")
    foreign = F.col("department").isNotNull() & F.col("resource_accessed").isNotNull() & ~F.array_contains(F.coalesce("resources", F.array(F.lit("email"), F.lit("vpn"))), F.col("resource_accessed"))
    return e.withColumn("foreign", F.coalesce(foreign, F.lit(False)))


def session_features(events: DataFrame, users: DataFrame, home: DataFrame) -> DataFrame:
    """record_id, session_foreign_resource_count, session_hop_seconds; one shuffle by session."""
    e = C.in_order(with_home(events, users, home), "session_id")
    past = C.ever_before("session_id")
    last = F.last(F.when(F.col("resource_accessed").isNotNull(), F.unix_micros("ts")), ignorenulls=True).over(past)
    count = F.size(F.collect_set(F.when(F.col("foreign"), F.col("resource_accessed"))).over(past))
    hop = F.coalesce((F.unix_micros("ts") - last) / 1e6, F.lit(LONG_HOP))
    return e.select("record_id", count.cast("double").alias("session_foreign_resource_count"), hop.alias("session_hop_seconds"))


def transitions(events: DataFrame, users: DataFrame) -> DataFrame:
    """(record_id, department, src, dst, ts): moves between resources within a session."""
    e = C.in_order(events.where("resource_accessed is not null"), "session_id").join(users.select("user_id", "department"), "user_id")
    src = F.lag("resource_accessed").over(Window.partitionBy("session_id").orderBy("ok"))
    e = e.withColumn("src", src).where("src <> resource_accessed")
    return e.select("record_id", "department", "src", F.col("resource_accessed").alias("dst"), "ts")


def access_chain_distance(events: DataFrame, users: DataFrame, days: float = 30) -> DataFrame:
    """(record_id, access_chain_distance). The transitions that count at an event's time are the difference
    of those begun and those run out by then, from one sweep over questions and transitions of a kind."""
    e = C.in_order(events, "user_id").join(users.select("user_id", "department"), "user_id", "left")
    res, since = F.col("resource_accessed"), F.col("ok") - C.reach(days)
    visit = F.when(F.col("department").isNotNull() & res.isNotNull(), F.struct("ok", res.alias("res")))
    e = e.select(
        "record_id", "ts", "department", "resource_accessed", "ok",
        F.last(visit, ignorenulls=True).over(C.ever_before("user_id")).alias("last"),
        F.lag("ok").over(Window.partitionBy("user_id", "resource_accessed").orderBy("ok")).alias("same"),
    )
    again = F.col("department").isNotNull() & (F.col("same") >= since)
    easy = F.when(res.isNull() | again, F.lit(0.0)).when(F.coalesce(F.col("last.ok") < since, F.lit(True)), F.lit(FAR_RESOURCE))
    e = materialised(e.select("record_id", "ts", "department", res.alias("dst"), F.col("last.res").alias("src"), easy.alias("easy")))
    key = ["department", "src", "dst"]
    asked = e.where("easy is null").select("record_id", *key, "ts", F.lit(0).alias("fact"))
    both = asked.unionByName(transitions(events, users).withColumn("fact", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*key, "ts").orderBy("record_id", "fact")) - 1
    both = materialised(both.select("record_id", *key, "fact", C.order_number(nth).alias("ok")))
    change = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    changes = both.where("fact = 1").select(*key, F.inline(F.array(change(F.col("ok") + 1, 1), change(F.col("ok") + C.reach(days) + 1, -1))))
    cost = C.swept(changes, both.where("fact = 0").select("record_id", *key, "ok"), key, "n")
    cost = cost.select("record_id", F.when(F.col("n") > 0, 1 / F.col("n")).otherwise(FAR_RESOURCE).alias("cost"))
    return e.join(cost, "record_id", "left").select("record_id", F.coalesce("easy", "cost").alias("access_chain_distance"))


def _spells(events: DataFrame, days: float) -> DataFrame:
    """(user_id, device_id, since, until): order numbers between which a pair counts as live."""
    order = F.unix_micros("ts") * C.TIES
    pair = Window.partitionBy("user_id", "device_id").orderBy("o")
    e = events.select("user_id", "device_id", order.alias("o"), "record_id").withColumn("gap", F.col("o") - F.lag("o").over(pair) > C.reach(days))
    e = e.withColumn("spell", F.sum(F.coalesce(F.col("gap"), F.lit(False)).cast("int")).over(pair))
    return e.groupBy("user_id", "device_id", "spell").agg(F.min("o").alias("since"), (F.max("o") + C.reach(days)).alias("until")).drop("spell")


def _merged(df: DataFrame, *key: str) -> DataFrame:
    """The unions of the stretches (since, until] of each key."""
    w = Window.partitionBy(*key).orderBy("since")
    reached = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce(F.col("since") > reached, F.lit(True)).cast("int"))
    df = df.withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "_nth").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_nth")


def _both(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right, both with stretches, where these meet, and the stretch in which they do."""
    right = right.withColumnsRenamed({"since": "_s", "until": "_u"})
    both = left.join(right, on).withColumns({"since": F.greatest("since", "_s"), "until": F.least("until", "_u")})
    return both.where("since < until").drop("_s", "_u")


def adjacent_devices(spells: DataFrame) -> DataFrame:
    """(a, b, since, until): pairs of different devices, both ways round, and when a user was live on both.

    Pairs come from each user's own devices, so a device costs its users, never their square.
    """
    a, b = spells.withColumnRenamed("device_id", "a"), spells.withColumnRenamed("device_id", "b")
    return _merged(_both(a, b, ["user_id"]).where("a <> b"), "a", "b")


def new_edge(events: DataFrame, days: float = 30, hub: int | None = None, heavy: int = 64) -> DataFrame:
    """(record_id, is_new_edge): 0 for a pair seen within days, else 1 - 1 / (1 + d), where d is the
    distance (2, 4, or 6 for more) of the device from the user's own ones in the user-device graph.

    Only novel rows are looked at. Distance 2: the device is adjacent to one of the user's own; 4: a third device is
    adjacent to both. The third is sought among the neighbours of whichever end has at most heavy of
    them. Where both ends are hubs, which are few, the times at which a third links them are found once for each
    pair of hubs that is asked for. Events of equal time count as not before each other here. hub: devices
    of more users than this carry no path, as an option.
    """
    e = C.in_order(events, "user_id", "device_id")
    live = F.coalesce(F.lag("ok").over(Window.partitionBy("user_id", "device_id").orderBy("ok")) >= F.col("ok") - C.reach(days), F.lit(False))
    e = materialised(e.select("record_id", "user_id", "device_id", (F.unix_micros("ts") * C.TIES).alias("o"), live.alias("live")))
    spells = _spells(events, days)
    if hub is not None:
        few = events.groupBy("device_id").agg(F.count_distinct("user_id").alias("n")).where(F.col("n") <= hub).select("device_id")
        spells = spells.join(few, "device_id", "left_semi")
    spells = materialised(spells)
    next_to = materialised(adjacent_devices(spells))
    novel = e.where("not live").select("record_id", "user_id", F.col("device_id").alias("d"), "o")
    when = (F.col("o") > F.col("since")) & (F.col("o") <= F.col("until"))
    asked = novel.join(spells, "user_id").where(when).select("record_id", "o", "d", F.col("device_id").alias("own")).where("d <> own")

    def linked(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.join(next_to, (F.col(a) == next_to["a"]) & (F.col(b) == next_to["b"]) & when, "left_semi")

    near = materialised(linked(asked, "d", "own").select("record_id").distinct())
    hubs = materialised(next_to.select("a", "b").distinct().groupBy("a").count().where(F.col("count") > heavy).select("a"))
    left = asked.join(near, "record_id", "left_anti")
    for end in ("d", "own"):
        left = left.join(hubs.select(F.col("a").alias(end), F.lit(True).alias(f"{end}_hub")), end, "left")
    left = materialised(left.fillna(False, ["d_hub", "own_hub"]))

    def by_third(rows: DataFrame, light: str, other: str) -> DataFrame:
        thirds = rows.join(next_to, (F.col(light) == F.col("a")) & when).select("record_id", "o", other, F.col("b").alias("third")).distinct()
        return linked(thirds, "third", other).select("record_id")

    hard = left.where("d_hub and own_hub")
    pairs = hard.select("d", "own").distinct()
    to_third = pairs.join(next_to.withColumnsRenamed({"a": "d", "b": "third"}), "d")
    bridged = _merged(_both(to_third, next_to.withColumnsRenamed({"a": "third", "b": "own"}), ["third", "own"]), "d", "own")
    far = by_third(left.where("not d_hub"), "d", "own").unionAll(by_third(left.where("d_hub and not own_hub"), "own", "d"))
    far = far.unionAll(hard.join(bridged, ["d", "own"]).where(when).select("record_id")).distinct()
    d = near.withColumn("dist", F.lit(2)).unionAll(far.withColumn("dist", F.lit(4)))
    dist = F.coalesce("dist", F.lit(FAR_DEVICE))
    return e.join(d, "record_id", "left").select("record_id", F.when(F.col("live"), F.lit(0.0)).otherwise(1 - 1 / (1 + dist)).alias("is_new_edge"))


#: Users of a tile: a device of more has its users dealt to tiles, and pairs of tiles are joined. A device of at most a 32nd is a small one.
TILE = 2048


def _crossed(rows: DataFrame) -> DataFrame:
    """(u1, u2, weight 1) of rows (user_id, device_id, tiles, t, rest, met): pairs of a device's users of whom one has no rest, but for those who met.

    A tile is one row, so that tasks are dealt pairs of tiles, and a pair of users costs a few bytes written by columns."""
    person = F.struct("user_id", (F.size("rest") > 0).alias("more"), F.coalesce("met", F.array().cast("array<bigint>")).alias("met"))
    held = materialised(rows.groupBy("device_id", "tiles", "t").agg(F.collect_list(person).alias("users")))
    left = held.select("device_id", F.col("t").alias("ta"), F.col("users.user_id").alias("ua"), F.col("users.more").alias("ma"), F.col("users.met").alias("met"), F.explode(F.sequence("t", F.col("tiles") - 1)).alias("tb"))
    right = held.select("device_id", F.col("t").alias("tb"), F.col("users.user_id").alias("ub"), F.col("users.more").alias("mb"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = held.agg(F.sum(F.col("tiles") - F.col("t"))).first()[0] or 0  # one number
    both = left.join(right, ["device_id", "tb"]).select((F.col("ta") == F.col("tb")).alias("same"), "ua", "ma", "met", "ub", "mb").repartition(max(1, min(n, 4 * cores), -(-n // 64)))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ua, ma, ub, mb = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ua", "ma", "ub", "mb"))
                met, same = batch.column("met")[i].values, batch.column("same")[i].as_py()
                known = np.array([len(m) > 0 for m in met])
                for at in range(0, len(ua), 64):
                    own = ua[at : at + 64, None]
                    u1, u2 = np.minimum(own, ub), np.maximum(own, ub)
                    some = ma[at : at + 64, None] & mb
                    if same or some.any() or known[at : at + 64].any():
                        keep = ~some & (own < ub) if same else ~some
                        for j in np.flatnonzero(known[at : at + 64]):
                            keep[j] &= ~np.isin(ub, met[at + int(j)].values.to_numpy())
                        u1, u2 = u1[keep], u2[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(u1.ravel()), pa.array(u2.ravel()), pa.array(np.ones(u1.size, dtype=np.int64))], ["u1", "u2", "weight"])

    return both.mapInArrow(crossed, "u1 long, u2 long, weight long")


def _tiled_pairs(pairs: DataFrame) -> DataFrame:
    """(u1, u2, weight) of pairs (user_id, device_id, count: users of the device), which are distinct.

    Users of small devices are few pairs, so these are counted by a sum, and what else they share is added. Other pairs come
    from one device, the first large one that they share, and are counted there, so that pairs whose number grows with
    the square of a terminal's users are never shuffled or summed: users bring along their other large devices, which
    most have none of, and whom they met at a small one. A device of n users is n / TILE tiles, each pair of tiles is met
    once, and no task holds more than a tile's users at once.
    """
    small, large = pairs.where(F.col("count") <= TILE // 32), pairs.where(F.col("count") > TILE // 32)
    all_large = materialised(large.groupBy("user_id").agg(F.sort_array(F.collect_list("device_id")).alias("all")))
    near = small.select("device_id", F.col("user_id").alias("u1")).join(small.select("device_id", F.col("user_id").alias("u2")), "device_id").where("u1 < u2").groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("few"))
    for i in ("1", "2"):
        near = near.join(all_large.select(F.col("user_id").alias(f"u{i}"), F.col("all").alias(f"all{i}")), f"u{i}", "left")
    near = materialised(near.select("u1", "u2", "few", F.coalesce(F.size(F.array_intersect("all1", "all2")), F.lit(0)).alias("many")).withColumn("many", F.greatest("many", F.lit(0))))
    met = near.where("many > 0")
    met = met.select(F.col("u1").alias("user_id"), F.col("u2").alias("other")).unionAll(met.select("u2", "u1")).groupBy("user_id").agg(F.collect_list("other").alias("met"))
    rows = large.join(all_large, "user_id").join(met, "user_id", "left")
    rows = rows.select("user_id", "device_id", F.expr("cast(ceil(count / %d) as int)" % TILE).alias("tiles"), F.array_remove("all", F.col("device_id")).alias("rest"), "met")
    rows = materialised(rows.withColumn("t", F.pmod(F.xxhash64("user_id"), F.col("tiles")).cast("int")))
    spread = lambda low, high: F.explode(F.sequence(low, high))
    rest = F.size("rest") > 0
    a = rows.select("device_id", F.col("user_id").alias("ua"), F.col("rest").alias("ra"), rest.alias("more_a"), "met", F.col("t").alias("ta"), spread(F.col("t"), F.col("tiles") - 1).alias("tb"))
    b = rows.select("device_id", F.col("user_id").alias("ub"), F.col("rest").alias("rb"), rest.alias("more_b"), spread(F.lit(0), F.col("t")).alias("ta"), F.col("t").alias("tb"))
    tiles, once = ["device_id", "ta", "tb"], "(ta < tb or ua < ub) and (met is null or not array_contains(met, ub))"
    ends = F.least("ua", "ub").alias("u1"), F.greatest("ua", "ub").alias("u2")
    # Most pairs can share no other large device, and are made as matrices.
    most = _crossed(rows)
    both = a.where("more_a").join(b.where("more_b").hint("merge"), tiles).where(once).select("device_id", *ends, F.array_intersect("ra", "rb").alias("more"))
    both = both.where(F.coalesce(F.get("more", F.lit(0)) > F.col("device_id"), F.lit(True))).select("u1", "u2", (F.size("more") + 1).cast("long").alias("weight"))
    return near.select("u1", "u2", (F.col("few") + F.col("many")).alias("weight")).unionAll(most).unionAll(both)


def shared_devices(events: DataFrame, hub: int | None = None, least: int = 1) -> DataFrame:
    """(u1, u2, weight): pairs of users by number of shared devices, at least least. hub leaves out devices of more users.

    Users who share least devices share one that is not among either's least - 1 most common ones, in any one order of
    all devices. So only a user's rarer devices propose pairs, and a terminal that everyone uses proposes those of
    users who have hardly another device. Proposed pairs are counted over all devices.
    """
    pairs = materialised(events.select("user_id", "device_id").distinct())
    sizes = pairs.groupBy("device_id").count().where("count > 1")
    if hub is not None:
        sizes = sizes.where(F.col("count") <= hub)
    pairs = materialised(pairs.join(sizes, "device_id"))
    a, b = pairs.withColumnRenamed("user_id", "u1").drop("count"), pairs.withColumnRenamed("user_id", "u2").drop("count")
    if least == 1:
        return _tiled_pairs(pairs)
    common = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("count").desc(), "device_id"))
    rare = materialised(pairs.withColumn("nth", common).where(F.col("nth") >= least).select("user_id", "device_id"))
    proposed = rare.withColumnRenamed("user_id", "u1").join(rare.withColumnRenamed("user_id", "u2"), "device_id").where("u1 < u2").select("u1", "u2").distinct()
    return proposed.join(a, "u1").join(b, ["u2", "device_id"]).groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def communities(edges: DataFrame, users: DataFrame, rounds: int = 5) -> DataFrame:
    """(user_id, community): weighted label propagation for a fixed number of rounds.

    A user takes the label with the most weight among neighbours and itself (weight 1), the smallest on
    ties. Users without edges stay alone. Each round is written out, so plans don't grow with rounds.
    """
    edges = materialised(edges)
    both = edges.select("u1", "u2", "weight").unionAll(edges.select(F.col("u2").alias("u1"), F.col("u1").alias("u2"), "weight"))
    state = users.select("user_id", F.col("user_id").alias("community"))
    for _ in range(rounds):
        votes = both.join(state.withColumnRenamed("user_id", "u2"), "u2").select(F.col("u1").alias("user_id"), "community", "weight")
        votes = votes.unionByName(state.withColumn("weight", F.lit(1).cast("long"))).groupBy("user_id", "community").agg(F.sum("weight").alias("w"))
        state = materialised(votes.groupBy("user_id").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community")))
    return state


def live_pairs(events: DataFrame, days: int = 30) -> DataFrame:
    """(epoch, user_id, device_id): pairs seen in the days before the epoch, a day that starts after them. An
    event tells of the days that follow its own only, so what joins on the epoch never looks ahead."""
    seen = events.select("user_id", "device_id", F.to_date("ts").alias("day")).groupBy("user_id", "device_id").agg(F.collect_set("day").alias("seen"))
    epochs = F.array_distinct(F.flatten(F.transform("seen", lambda d: F.sequence(F.date_add(d, 1), F.date_add(d, days)))))
    return seen.select(F.explode(epochs).alias("epoch"), "user_id", "device_id")


def propagated(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(epoch, user_id, community) for the users of pairs (epoch, user_id, device_id), each epoch by itself.

    Label propagation over the user-device graph: a device takes the most frequent label of its users, a
    user that of its shared devices and itself, the smallest on ties. Users are never paired with each other, so a
    terminal of many users costs its users, not their square.
    """
    pairs = materialised(pairs)
    state = pairs.select("epoch", "user_id").distinct().withColumn("community", F.col("user_id"))
    shared = pairs.groupBy("epoch", "device_id").count().where("count > 1").drop("count")
    pairs = materialised(pairs.join(shared, ["epoch", "device_id"]))
    top = lambda votes, key: votes.groupBy("epoch", key).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community"))
    for _ in range(rounds):
        held = pairs.join(state, ["epoch", "user_id"]).groupBy("epoch", "device_id", "community").agg(F.count(F.lit(1)).alias("w"))
        votes = pairs.join(top(held, "device_id"), ["epoch", "device_id"]).select("epoch", "user_id", "community")
        votes = votes.unionByName(state).groupBy("epoch", "user_id", "community").agg(F.count(F.lit(1)).alias("w"))
        state = materialised(top(votes, "user_id"))
    return state


def modularity(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """(epoch, q) of communities (epoch, user_id, community) among users weighted by their shared devices.

    A device of n users adds n - 1 to each one's degree, and k * (k - 1) to the weight inside a community with k of
    them (each pair both ways), so users are never paired. Epochs without a shared device have q = 0.
    """
    sizes = pairs.groupBy("epoch", "device_id").agg(F.count(F.lit(1)).alias("n"))
    inside = pairs.join(state, ["epoch", "user_id"]).groupBy("epoch", "device_id", "community").agg(F.count(F.lit(1)).alias("k"))
    inside = inside.join(sizes, ["epoch", "device_id"])
    per = inside.groupBy("epoch", "community").agg(F.sum(F.expr("k * (k - 1)")).alias("within"), F.sum(F.expr("k * (n - 1)")).alias("degree"))
    out = per.groupBy("epoch").agg(F.sum("within").alias("w"), F.sum("degree").alias("m2"), F.sum(F.pow(F.col("degree").cast("double"), 2)).alias("squares"))
    return out.select("epoch", F.when(F.col("m2") > 0, F.col("w") / F.col("m2") - F.col("squares") / F.pow(F.col("m2").cast("double"), 2)).otherwise(F.lit(0.0)).alias("q"))


def _moves(pairs: DataFrame, state: DataFrame, degree: DataFrame, turn: int, few: int) -> DataFrame:
    """state after the users whose turn it is have moved to where modularity gains most, if it gains.

    A user may move to any community on its devices of at most few communities, and to the largest on
    those of more. All gains are exact, against the communities of before the round.
    """
    on = pairs.join(state, ["epoch", "user_id"]).groupBy("epoch", "device_id", "community").agg(F.count(F.lit(1)).alias("k"))
    on = materialised(on)
    crowd = on.groupBy("epoch", "device_id").agg(F.count(F.lit(1)).alias("many"), F.max_by("community", F.struct("k", -F.col("community"))).alias("top"))
    offered = on.join(crowd, ["epoch", "device_id"]).where((F.col("many") <= few) | (F.col("community") == F.col("top"))).select("epoch", "device_id", "community")
    mover = degree.where(F.pmod(F.xxhash64("user_id"), F.lit(2)) == turn)
    movers = pairs.join(mover.select("epoch", "user_id"), ["epoch", "user_id"])
    own = mover.join(state, ["epoch", "user_id"]).select("epoch", "user_id", "degree", F.col("community").alias("home"))
    choice = movers.join(offered, ["epoch", "device_id"]).select("epoch", "user_id", "community")
    choice = choice.unionByName(own.select("epoch", "user_id", F.col("home").alias("community"))).distinct()
    # Weight to each choice over all the user's devices, itself left out of its own community.
    linked = movers.join(choice, ["epoch", "user_id"]).join(on, ["epoch", "device_id", "community"]).groupBy("epoch", "user_id", "community").agg(F.sum("k").alias("w"), F.count(F.lit(1)).alias("mine"))
    whole = degree.join(state, ["epoch", "user_id"]).groupBy("epoch", "community").agg(F.sum("degree").alias("total"))
    m2 = degree.groupBy("epoch").agg(F.sum("degree").alias("m2"))
    at_home = F.col("community") == F.col("home")
    w = F.coalesce("w", F.lit(0)) - F.when(at_home, F.coalesce("mine", F.lit(0))).otherwise(F.lit(0))
    others = F.coalesce("total", F.lit(0)) - F.when(at_home, F.col("degree")).otherwise(F.lit(0))
    score = w - F.col("degree") * others / F.col("m2")
    scored = choice.join(linked, ["epoch", "user_id", "community"], "left").join(own, ["epoch", "user_id"]).join(whole, ["epoch", "community"], "left").join(m2.where("m2 > 0"), "epoch")
    best = scored.groupBy("epoch", "user_id").agg(F.max_by("community", F.struct(F.round(score, 9), at_home, -F.col("community"))).alias("to"))
    return state.join(best, ["epoch", "user_id"], "left").select("epoch", "user_id", F.coalesce("to", "community").alias("community"))


def epoch_communities(pairs: DataFrame, rounds: int = 2, few: int = 32) -> DataFrame:
    """(epoch, user_id, community): communities of high modularity for the users of pairs (epoch, user_id, device_id).

    Labels are propagated first. Then, in rounds, one half of the users moves and then the other, so that neighbours
    don't swap places, and then an epoch tries the communities of the epoch before, in which new users keep
    their own. Each step is taken in the epochs whose modularity it raises. All epochs go at once.

    A device of one user adds nothing to a degree or to modularity, and a user of such devices only has no neighbour: labels
    and moves pass over the shared devices and their users alone, and the others keep the label of their own until an epoch
    takes the communities of the one before.
    """
    pairs = materialised(pairs.select("epoch", "user_id", "device_id").distinct())
    everyone = pairs.select("epoch", "user_id").distinct()
    sizes = pairs.groupBy("epoch", "device_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = materialised(pairs.join(sizes, ["epoch", "device_id"]).select("epoch", "user_id", "device_id", "n"))
    degree = materialised(pairs.groupBy("epoch", "user_id").agg(F.sum(F.col("n") - 1).alias("degree")))
    pairs = pairs.drop("n")
    before = everyone.select("epoch").distinct()
    before = before.select("epoch", F.lag("epoch").over(Window.orderBy("epoch")).alias("_before"))  # a row an epoch
    lone = everyone.join(degree, ["epoch", "user_id"], "left_anti").withColumn("community", F.col("user_id"))
    state = materialised(propagated(pairs).unionByName(lone))
    held = materialised(modularity(pairs, state))
    for _ in range(rounds):
        for turn in (0, 1, None):
            if turn is None:
                old = state.select(F.col("epoch").alias("_before"), "user_id", F.col("community").alias("old"))
                new = state.join(before, "epoch").join(old, ["_before", "user_id"], "left").select("epoch", "user_id", F.coalesce("old", "community").alias("community"))
            else:
                new = _moves(pairs, state, degree, turn, few)
            new = materialised(new)
            q = held.join(modularity(pairs, new).withColumnRenamed("q", "new"), "epoch")
            held = materialised(q.select("epoch", F.greatest("q", "new").alias("q"), (F.col("new") > F.col("q")).alias("better")))
            better = F.broadcast(held.where("better").select("epoch"))  # a row an epoch
            state = materialised(new.join(better, "epoch", "left_semi").unionByName(state.join(better, "epoch", "left_anti")))
            held = held.select("epoch", "q")
    return state


def community_deviation(events: DataFrame, pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(record_id, peer_community_deviation): the share of the user's community, itself left out, that wasn't
    on the event's device, by pairs and membership of the event's epoch (its day); 0 for users alone."""
    sizes = membership.groupBy("epoch", "community").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    membership = materialised(membership.join(sizes, ["epoch", "community"]).select("epoch", "user_id", "community", "size"))  # without users alone
    own = pairs.join(membership, ["epoch", "user_id"]).select("epoch", "user_id", "device_id", "community", F.lit(1).alias("own"))
    on_device = own.groupBy("epoch", "community", "device_id").agg(F.count(F.lit(1)).alias("n"))
    e = events.select("record_id", "user_id", "device_id", F.to_date("ts").alias("epoch")).join(membership, ["epoch", "user_id"], "left")
    e = e.join(on_device, ["epoch", "community", "device_id"], "left").join(own.drop("community"), ["epoch", "user_id", "device_id"], "left")
    peers = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))
    dev = F.when(F.coalesce("size", F.lit(0)) <= 1, F.lit(0.0)).otherwise(1 - peers / (F.col("size") - 1))
    return e.select("record_id", dev.alias("peer_community_deviation"))


def all_features(events: DataFrame, users: DataFrame, home: DataFrame, days: float = 30) -> DataFrame:
    """All fifteen features in one table keyed by record_id."""
    from authspan.operators import behaviour

    out = behaviour.behaviour(events, users, days)
    pairs = materialised(live_pairs(events, int(days)))
    more = [behaviour.peer_deviation(events, users), device_features(events, days), device_set_delta(events), session_features(events, users, home), access_chain_distance(events, users, days), new_edge(events, days)]
    more.append(community_deviation(events, pairs, epoch_communities(pairs)))
    for part in more:
        out = out.join(part, "record_id", "left")
    return out


def cold_start_priors(features: DataFrame, events: DataFrame, users: DataFrame, names: list[str]) -> DataFrame:
    """(department, prior_<feature>...): medians over the rows given, which should be train rows."""
    rows = features.join(events.select("record_id", "user_id"), "record_id").join(users.select("user_id", "department"), "user_id")
    return C.medians(rows, ["department"], names, "prior_")


def apply_priors(features: DataFrame, events: DataFrame, users: DataFrame, priors: DataFrame, names: list[str], days: int = 14) -> DataFrame:
    """features with named ones replaced by the department's prior for events within days of joining."""
    who = events.select("record_id", "user_id", "ts").join(users.select("user_id", "department", "join_date"), "user_id")
    rows = features.join(who, "record_id").join(priors, "department", "left")
    cold = F.col("ts") < F.date_add("join_date", days).cast("timestamp")
    value: dict[str, Column] = {n: F.when(cold, F.coalesce(f"prior_{n}", n)).otherwise(F.col(n)) for n in names}
    return rows.withColumns(value).select(features.columns)
