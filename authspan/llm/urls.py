"""URL filters: prefix rules first, then gradient-boosted trees over lexical features.

Only DataFrame expressions and Spark's own tree learner. The urls that a rule decides are the
labelled ones; the trees learn from a bounded sample of them and judge the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import Scratch, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = r"^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "mark_ratio", "entropy", "params", "suffix_rate", "suffix_log")


@dataclass(frozen=True)
class UrlRules:
    block: tuple[str, ...] = ("net/", "example.com/de/")
    allow: tuple[str, ...] = ("example.net/en/", "org/fr/")
    #: Labelled urls the trees are fitted on, about; the hash of the url decides which.
    sample: int = 20_000
    rounds: int = 10
    depth: int = 4
    seed: int = 42
    #: Documents' worth of the overall rate in a suffix's rate.
    suffix_prior: float = 10.0


def with_place(urls: DataFrame) -> DataFrame:
    """urls with host and path, empty for a null url or one without '://'."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, "(?s)" + PLACE, i)
    return urls.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def rule_of(rules: UrlRules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. One expression for each rule."""
    tests = []
    for verdict, entries in (("block", rules.block), ("allow", rules.allow)):
        for rule in entries:
            at, slash, rest = rule.partition("/")
            fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
            tests.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*tests)) if tests else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _entropy(s: Column) -> Column:
    """Shannon entropy of a string's characters, bits a character."""
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda c: (F.length(s) - F.length(F.replace(s, c))) / F.length(c) / n
    terms = F.transform(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), lambda c: let(share(c), lambda p: p * F.log2(p)))
    return -F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def with_features(placed: DataFrame) -> DataFrame:
    url = F.substring(F.coalesce(F.col("url"), F.lit("")), 1, 1 << 30)
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = lambda text, pattern: F.size(F.split(text, pattern, -1)) - 1
    return placed.withColumns(
        {
            "suffix": F.substring_index("host", ".", -2),
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": size(F.col("path"), "/").cast("double"),
            "labels": size(F.col("host"), "[.]").cast("double"),
            "digit_ratio": size(url, "[0-9]") / n,
            "mark_ratio": size(url, "[^0-9A-Za-z]") / n,
            "entropy": _entropy(url),
            "params": F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "&", -1)).cast("double")),
        }
    )


def judge(urls: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of urls (page_id, url).

    rule: the longest that fits a host or a domain above it and the path's start, else null.
    verdict: the rule's, else block if the trees' chance of block is over half. score: that chance,
    null where a rule decided. Without labelled urls of both verdicts there is nothing to learn: the
    one verdict seen holds, or allow if none was. Null url or no '://': host and path empty, judged
    by the trees. Repeated rows: one result each. Other columns are ignored.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    placed = with_place(urls.select("page_id", F.col("url").cast("string"))).withColumn("_r", rule_of(rules, F.col("host"), F.col("path")))
    rows = with_features(placed.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("given")))
    rows = scratch.save(rows, "features")
    label = (F.col("given") == "block").cast("double")
    labelled, blocked = rows.where("given is not null").agg(F.count(F.lit(1)), F.avg(label)).first()  # two numbers
    result = lambda verdict, score: ("page_id", "host", "path", "rule", F.coalesce("given", verdict).alias("verdict"), F.when(F.col("given").isNull(), score).alias("score"))
    if not labelled or blocked in (0.0, 1.0):
        return rows.select(*result(F.lit("block" if blocked else "allow"), F.lit(blocked or 0.0)))

    stats = rows.where("given is not null").groupBy(F.col("suffix").alias("of")).agg(F.sum(label).alias("b"), F.count(F.lit(1)).alias("n"))
    stats = scratch.save(stats, "suffixes")
    n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0.0))
    rated = rows.join(stats, F.col("suffix") == F.col("of"), "left").withColumns({"suffix_rate": (b + blocked * rules.suffix_prior) / (n + rules.suffix_prior), "suffix_log": F.log1p(n)})
    rated = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated.drop("b", "n", "of"))
    part = min(1.0, rules.sample / labelled)
    chosen = F.shiftrightunsigned(F.xxhash64("url", F.lit(rules.seed)), 11) < int(part * (1 << 53))
    sample = rated.where("given is not null").where(chosen).select("features", label.alias("label"))
    trees = GBTClassifier(maxIter=rules.rounds, maxDepth=rules.depth, seed=rules.seed, checkpointInterval=-1)
    # few partitions: each round of each level is a job over the bounded sample
    model = trees.fit(scratch.save(sample.coalesce(4), "sample"))
    score = F.get(vector_to_array("probability"), F.lit(1))
    judged = model.transform(rated).withColumn("_p", score)
    return judged.select(*result(F.when(F.col("_p") > 0.5, "block").otherwise("allow"), F.col("_p")))
