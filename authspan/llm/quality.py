"""Host-level quality rules: rule failures by source, rates shrunk by an empirical beta prior.

Only DataFrame expressions: a text's signals never leave its row, and what is shuffled is one
partial count for each source and task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import WORD, Scratch, let, packed, text_of, unpacked, words_of

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    window: int = 8
    min_words: int = 20
    #: Most percent of a text's words that may lie in repeated windows.
    max_repeat_pct: int = 30
    #: A source is rejected if its shrunk failure rate is over this.
    max_host_rate: float = 0.7
    #: Prior weight, in documents, where sources don't differ enough to fit one.
    prior_docs: float = 10.0


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows found twice or more in the text, from sorted window hashes."""
    w = F.lit(window)
    # hashes of word hashes: slice() would copy the words for every window
    of_window = lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(window)))
    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: of_window(h, i)))

    def covered(pairs: Column) -> Column:
        same = lambda p, q: p["h"] == q["h"]
        twice = F.filter(pairs, lambda p, i: F.coalesce(same(p, F.get(pairs, i - 1)), F.lit(False)) | F.coalesce(same(p, F.get(pairs, i + 1)), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        lengths = let(starts, lambda s: F.transform(s, lambda v, j: F.least(w, F.coalesce(F.get(s, j + 1) - v, w))))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        repeats = let(F.sort_array(h), lambda s: F.exists(F.transform(s, lambda x, i: x == F.get(s, i - 1)), lambda x: x))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.coalesce(repeats, F.lit(False)), let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > w, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def with_signals(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with the five signals and base_failed. Replaces columns of those names."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(words: Column) -> Column:
        n, repeats = F.size(words).cast("long"), _repeat_words(words, rules.window)
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        return let(repeats, lambda r: F.struct(n.alias("n_words"), chars.alias("word_chars"), r.alias("n_repeat_words"), ((n < rules.min_words) | (100 * r > rules.max_repeat_pct * n)).alias("base_failed")))

    # one self-contained expression: a filter on it, pushed to the scan, still cuts the words once a row
    found = docs.withColumn("_s", let(words_of(text), of_words))
    return found.withColumns(
        {
            "n_words": F.col("_s.n_words"),
            "word_chars": F.col("_s.word_chars"),
            "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_s.n_repeat_words"),
            "base_failed": F.col("_s.base_failed"),
        }
    ).drop("_s")


def host_verdicts(signals: DataFrame, scratch: Scratch, rules: QualityRules = QualityRules()) -> DataFrame:
    """(source, docs, failed, rate, rejected), a row per source.

    rate = (failed + a) / (docs + a + b), with a, b of the beta distribution that has the mean and
    variance of the sources' raw rates.
    """
    hosts = signals.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = scratch.save(hosts, "counts")
    raw = F.col("failed") / F.col("docs")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()  # two numbers
    weight = rules.prior_docs if not v or v >= m * (1 - m) else m * (1 - m) / v - 1
    a, b = (m or 0.0) * weight, (1 - (m or 0.0)) * weight
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > rules.max_host_rate)


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(doc_id, source, signals, base_failed, host_rate, kept) for each row of docs.

    Null text: no words, so base_failed. Null source: a source of its own. Repeated rows count each.
    Very long texts are handled whole, within their row. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    signals = scratch.save(with_signals(docs.select("doc_id", F.col("source").cast("string"), "text"), rules).drop("text"), "signals")
    hosts = scratch.save(host_verdicts(signals, scratch, rules), "hosts")  # on disk its size is known when the join is planned
    named = hosts.select(F.col("source").alias("host"), F.col("rate").alias("host_rate"), "rejected")
    joined = signals.join(named, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "source", *SIGNALS, "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that judge() keeps. Columns may have any names.

    The rules run once a text: rows are written with their verdict, and sources are judged from that
    table. No text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality-keep")
    rows = packed(docs, source=F.col("source").cast("string"), text=F.col("text"))
    rows = scratch.save(with_signals(rows, rules).select("_row", "source", "base_failed"), "judged")
    hosts = scratch.save(host_verdicts(rows, scratch, rules), "hosts")
    bad = hosts.where("rejected").select(F.col("source").alias("bad"))
    good = rows.where("not base_failed").join(bad, F.col("source").eqNullSafe(F.col("bad")), "left_anti")
    return unpacked(good, docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM d WHERE len(ws) > 8
), keyed AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM win
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
), h AS (
  SELECT source, count(*) AS docs, sum(CAST(base_failed AS INT)) AS failed FROM f GROUP BY source
), p AS (
  SELECT m, CASE WHEN v = 0 OR v >= m * (1 - m) THEN 10.0 ELSE m * (1 - m) / v - 1 END AS k
  FROM (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM h)
), g AS (
  SELECT source, (failed + m * k) / (docs + k) > 0.7 AS rejected FROM h, p
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
"""
