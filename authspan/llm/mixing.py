"""Mixing sources to target weights: whole passes, then a subset-sum fit of what remains.

A source with target t and size s gives every document floor(t / s) times. The rest is fitted over
the counts of documents by exact length: a share of each length, and a bounded-knapsack dynamic
programme over the few lengths' worth that the shares leave. Documents of a length are then chosen
by a seeded hash. Only (id, source, length) is shuffled; a length held by many documents is cut by
hash into buckets of about BUCKET rows, so no window partition grows with the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.llm.common import WORD, Scratch, packed, row_key, split_join, text_of, unpacked

BUCKET = 256


@dataclass(frozen=True)
class MixRules:
    #: Weights of the sources in code-point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Words in the mix for each word of the input.
    share: float = 1.5
    #: Most passes over a source.
    most: int = 2
    seed: int = 42


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sized: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """(source, source_size, target), a row per source. Windows here run over one row per source.

    Water-filling: with sources by rising (limit / weight), all before some place are at their limit
    and the rest share what is left by weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in rules.weights])
    per = per.withColumn("w", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(rules.weights)))))
    per = per.withColumn("cap", F.col("source_size") * float(rules.most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * rules.share - full) / F.sum("w").over(rest))
    fits = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    level = F.coalesce(F.max(fits).over(everything), F.lit(float("inf")))
    return per.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (>= 1) to take so that their words come nearest to budget."""
    total = int(lengths @ counts)
    if budget <= 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    take = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int(lengths @ take)
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):  # what is over two longest documents goes without a search
        if left <= 2 * longest:
            break
        more = min(int(counts[i] - take[i]), (left - longest) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    room = left + longest
    reach, items, seen = 1, [], []
    mask = (1 << (room + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        free, step = int(counts[i] - take[i]), 1
        free = min(free, room // int(lengths[i]))
        while free > 0 and not reach >> left & 1:
            n = min(step, free)
            seen.append(reach)
            items.append((i, n))
            reach |= (reach << n * int(lengths[i])) & mask
            free, step = free - n, 2 * step
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    over = (above & -above).bit_length() - 1 if above else None
    at = left + over if over is not None and over < left - below else below
    for (i, n), before in zip(reversed(items), reversed(seen), strict=True):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size").reset_index(drop=True)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(target // size) if size else 0
    keep = rows["size"].to_numpy() > 0
    extra = np.zeros(len(rows), dtype=np.int64)
    extra[keep] = fit(rows["size"].to_numpy()[keep], rows["n"].to_numpy()[keep], round(target - passes * size))
    return rows[["source", "size", "source_size", "target", "n"]].assign(passes=passes, extra=extra)


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken, key) for each row of docs; key names doc_id, source and text.

    Null or blank text: size 0, taken 0. Null source: a source of its own, last in order. Rows that
    repeat a doc_id are separate documents here, and fall together in the choice. No text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select("doc_id", F.col("source").cast("string"), word_count(text_of()).alias("size"), row_key("doc_id", "source", "text").alias("key")), "sized")
    aim = scratch.save(targets(sized, rules), "targets")
    by_length = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    named = aim.toDF("s", "source_size", "target")
    by_length = by_length.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # a group is one source's distinct lengths, however many documents have them
    plan = by_length.groupBy("source").applyInPandas(_fit_source, "source string, size long, source_size long, target double, n long, passes long, extra long")
    plan = scratch.save(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET)), "plan")

    place = F.xxhash64("doc_id", F.lit(rules.seed))
    share = F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))
    # a source's documents of one length may be a large share of all
    rows = split_join(sized, plan.withColumn("rows", F.col("n")), ["source", "size"], "rows")
    rows = rows.withColumn("place", F.shiftrightunsigned(place, 1)).withColumn("bucket", F.floor(share * F.col("buckets")))
    counts = rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    running = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), F.coalesce(F.sum("m").over(running), F.lit(0)).alias("before"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("place", "doc_id", "key.a", "key.b"))
    times = F.col("passes") + (F.col("rank") + F.col("before") <= F.col("extra")).cast("long")
    ranked = rows.withColumn("rank", rank).join(before, on)
    return ranked.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), "key")


def mixed(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. Rows equal in id, source and text share
    out their counts. Columns may have any names."""
    scratch = Scratch(docs.sparkSession, "mixed")
    per = mix(docs, rules).groupBy("key").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 0")
    times = scratch.save(per.select(F.col("key.a").alias("ka"), F.col("key.b").alias("kb"), "times", "rows"), "times")
    # times grow with documents: never a broadcast that small inputs would get
    joined = packed(docs, key=row_key("doc_id", "source", "text")).join(times.hint("merge"), (F.col("key.a") == F.col("ka")) & (F.col("key.b") == F.col("kb")))
    nth = F.row_number().over(Window.partitionBy("ka", "kb").orderBy(F.lit(1)))  # equal rows only
    each = F.floor(F.col("times") / F.col("rows")) + (F.col("nth") <= F.col("times") % F.col("rows")).cast("long")
    joined = joined.withColumn("nth", nth).withColumn("n", each).where("n > 0")
    return unpacked(joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))), docs.columns)
