"""Shared pieces: scratch tables in the shared checkpoint folder, let-binding, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a local master (tests), one temporary folder per application.

    On a cluster it must be set: a folder of the driver's machine would miss what executors write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="authspan-")
    return _fallback[app]


class Scratch:
    """Parquet tables of one run in the shared folder. They cut lineage, and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *but: str) -> None:
        """Removes the run's tables but those that the result still reads."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.listStatus(at) if fs.exists(at) else []:
            if found.getPath().getName() not in but:
                fs.delete(found.getPath(), True)


def let(value: Column, body) -> Column:
    """body(v), with value computed once for a row however often body uses v."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def row_key(*names: str | Column) -> Column:
    """A 128-bit key (a, b) of a row's id and content. Rows that agree in both get one decision."""
    return F.struct(F.xxhash64(*names).alias("a"), F.xxhash64(F.lit(1), *names).alias("b"))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """df as one struct column _row beside more, so that no name of its columns can clash."""
    return df.select(F.struct("*").alias("_row"), *(c.alias(n) for n, c in more.items()))


def unpacked(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of _row again, those in instead replaced."""
    return df.select(*(instead.get(c, F.col("_row").getField(c)).alias(c) for c in names))


#: Most facts that split_join broadcasts.
HOT_FACTS = 1024


def split_join(rows: DataFrame, facts: DataFrame, on: list[str], count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with facts (unique by on; count: how many rows a fact joins), however many rows a key has.

    Facts of over a HOT_FACTS-th of all joined rows are fewer than HOT_FACTS, whatever the input, and are
    broadcast; the others join by a shuffle in which no key holds more than that share. rows is read
    once more, so it should be a saved table. Null keys match null keys.
    """
    total = total if total is not None else facts.agg(F.sum(count)).first()[0] or 0  # one number
    facts = facts.withColumn("_hot", F.col(count) > total / HOT_FACTS)
    hot, cold = facts.where("_hot").drop("_hot", count), facts.where("not _hot").drop("_hot", count)
    named = [f"_on{i}" for i in range(len(on))]

    def matched(some: DataFrame, these: DataFrame, how: str) -> DataFrame:
        these = these.withColumnsRenamed(dict(zip(on, named, strict=True)))
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(on, named, strict=True)]
        return some.join(these, reduce(and_, same), how).drop(*named)

    seldom = matched(rows, F.broadcast(hot.select(*on)), "left_anti")
    return matched(rows, F.broadcast(hot), "inner").unionByName(matched(seldom, cold, how))


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of edges (a, b: long): one row (node, root) per node with an edge.

    Randomised contraction: each round every node moves to the neighbour, itself included, with the
    smallest hash of that round, and edges are renamed. Nodes left shrink by a constant factor a
    round in expectation, whatever the shape; hubs cost one partial aggregate. No neighbour list is
    ever gathered. Maps are then composed from the last round back.
    """
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maps: list[DataFrame] = []
    while True:
        n = len(maps)
        left = scratch.save(left, f"{tag}-edges{n}")
        ends = 2 * left.count()
        if not ends:
            break
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = lambda c: F.xxhash64(F.col(c), F.lit(n))
        best = both.groupBy("a").agg(F.min_by("b", h("b")).alias("b"), F.count(F.lit(1)).alias("n"))
        moved = best.select(F.col("a").alias("node"), F.when(h("b") < h("a"), F.col("b")).otherwise(F.col("a")).alias("root"), "n")
        moved = scratch.save(moved, f"{tag}-map{n}")
        maps.append(moved.drop("n"))
        renamed = left
        for end in ("a", "b"):  # a hub's edges are many, the hubs with a large share of them are few
            renamed = split_join(renamed, moved.toDF(end, f"r{end}", "n"), [end], "n", total=ends)
        renamed = renamed.where("ra <> rb")
        left = renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    if not maps:
        return scratch.spark.createDataFrame([], "node long, root long")
    final = maps[-1]
    for moved in reversed(maps[:-1]):
        later = final.toDF("root", "later")
        final = moved.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return final
