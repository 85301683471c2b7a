"""Queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authspan.llm import embeddings, lines, mixing, oracles, periods, pieces, quality, secrets, simhash, spelling, substrings, tokens, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(_table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("agrees")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dups(_table(spark, sf_dir, "embeddings"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.SIGNALS, "base_failed", "kept")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(_table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(_table(spark, sf_dir, "documents"))


# The columns of three operators that SQL can state, by themselves.


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op9_urls(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("verdict"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substrings": op2_substrings,
    "op3_warc": op3_warc,
    "op4_embeddings": op4_embeddings,
    "op5_pieces": op5_pieces,
    "op6_lines": op6_lines,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_urls": op9_urls,
    "op10_quality": op10_quality,
    "op11_tokens": op11_tokens,
    "op12_periods": op12_periods,
    "op13_spelling": op13_spelling,
    "secret_counts": secret_counts,
    "mix_targets": mix_targets,
    "url_rules": url_rules,
}

ORACLES: dict[str, str] = {
    "op2_substrings": oracles.SUBSTRINGS,
    "op3_warc": oracles.WARC,
    "op4_embeddings": oracles.EMBEDDINGS,
    "op6_lines": lines.ORACLE,
    "op10_quality": quality.ORACLE,
    "op12_periods": oracles.PERIODS,
    "op13_spelling": oracles.SPELLING,
    "secret_counts": oracles.SECRETS,
    "mix_targets": oracles.TARGETS,
    "url_rules": oracles.RULES,
}
