"""Line dedup: a suffix array over the line-ID sequences of all documents; later copies of runs are deleted.

Only DataFrame expressions. A suffix is a place in a document's sequence of lines, written as the
number of that line in one numbering of all documents' lines, so the suffix k lines on is at + k.

1. A suffix's first rank tells its line's place among the line-IDs (128-bit hashes, range-partitioned).
2. Prefix doubling: rank(2k lines) tells the place of (rank of the suffix, rank of the suffix k lines
   on) among all such pairs. A round does this twice: it joins the ranks with themselves, shifted by
   k, 2k and 3k, and takes one partial aggregation. Suffixes that share a rank are an interval of the suffix array with a
   longest common prefix of k lines or more. An interval of one suffix repeats
   nothing and is dropped, so a round handles repeats only; doubling ends where no interval is left.
3. A suffix that isn't first in its interval starts a later copy of its k lines. A maximal repeated run
   of any length is the union of the copies that the longest such interval of each suffix tells of:
   the next longer run of k lines begins where the last one ends, or before.

A line of over long_words words is a passage by itself: the first ranks tell its repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authspan.llm.common import WORD, Scratch, packed, row_key, split_join, text_of, unpacked

MIN_LINES = 2
#: A line of more words than this is a repeat by itself, where asked for.
LONG_WORDS = 50


def _ids(lines: Column, long_words: int | None) -> Column:
    """(a, b, long): the ID of each line, and whether it is a passage by itself."""
    # so many words have as many characters and separators; the cheap test goes first
    long = lambda x: (F.length(x) > 2 * long_words) & (F.regexp_count(x, F.lit(WORD)) > long_words) if long_words else F.lit(False)
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), long(x).alias("long")))


def suffixes(docs: DataFrame, scratch: Scratch, long_words: int | None = None) -> DataFrame:
    """(at, i, left, a, b, long): every line with a word of every document; and the table doc of (doc, ka, kb).

    at numbers the lines in the order of (doc_id, key, place), a null doc_id before others; at - i names
    the document. left: how many lines follow. Rows that repeat id and text are one document.
    """
    lines = F.filter(F.split(text_of(), "\n", -1), lambda x: x.rlike(WORD))
    rows = docs.select(F.col("doc_id"), row_key("doc_id", "text").alias("k"), _ids(lines, long_words).alias("ids"))
    rows = rows.select("doc_id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "ids").where(F.size("ids") > 0)
    rows = scratch.save(rows, "ids").dropDuplicates(["ka", "kb"])
    placed = rows.repartitionByRange("doc_id", "ka", "kb").sortWithinPartitions("doc_id", "ka", "kb")
    each = placed.select("ka", "kb", F.size("ids").alias("n"), F.posexplode("ids").alias("i", "line"))
    # ids grow along the partitions and, within one, by one from row to row
    each = each.withColumn("at", F.monotonically_increasing_id())
    each = each.select("at", "i", (F.col("n") - F.col("i") - 1).alias("left"), "line.*", "ka", "kb")
    return scratch.save(each, "suffixes")


def _intervals(rows: DataFrame, by: list[str], scratch: Scratch, tag: str) -> DataFrame | None:
    """(at, i, left, long, rank, later) of the suffixes that share what they are grouped by with another one;
    none if none do. Ranks increase in the order of what they stand for, along ranges and within one."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    placed = groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    ranks = scratch.save(placed, f"{tag}-ranks")
    total = ranks.agg(F.sum("n")).first()[0]  # one number
    if not total:
        return None
    held = split_join(rows, ranks, by, "n", total=total)
    return scratch.save(held.select("at", "i", "left", "long", "rank", (F.col("at") > F.col("first")).alias("later")), tag)


def repeats(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(ka, kb, runs: array of (i, to)): the maximal runs of lines that are later copies, per document with any.

    The first copy is that with the smallest (doc_id, key, place), a null doc_id before others.
    """
    every = suffixes(docs, scratch, long_words)
    live, k, found = _intervals(every.drop("ka", "kb"), ["a", "b"], scratch, "rank1"), 1, None
    copies = lambda rows, k: rows.select("at", "i", F.lit(k).alias("w"))
    if live is not None and long_words and min_lines > 1:
        found = copies(live.where("later and long"), 1)
    while live is not None:
        if k >= min_lines:
            some = copies(live.where("later"), k)
            found = some if found is None else found.unionAll(some)
        # up to min_lines by what is left of it, then two doublings a round
        steps = [min(k, min_lines - k)] if k < min_lines else [k, 2 * k, 3 * k]
        # all parts are within their document, as left counts the lines that follow
        joined = live.where(F.col("left") >= steps[-1]).withColumnRenamed("rank", "r0")
        for n, step in enumerate(steps, 1):
            joined = joined.join(live.select((F.col("at") - step).alias("at"), F.col("rank").alias(f"r{n}")), "at")
        k += steps[-1]
        names = [f"r{n}" for n in range(len(steps) + 1)]
        live = _intervals(scratch.save(joined, f"parts{k}"), names, scratch, f"rank{k}")
    if found is None:
        found = copies(every, 0).limit(0)
    longest = found.groupBy("at", "i").agg(F.max("w").alias("w")).select((F.col("at") - F.col("i")).alias("doc"), "i", (F.col("i") + F.col("w")).alias("to"))
    # copies that overlap or meet make one run; a window partition is one document's lines
    past = Window.partitionBy("doc").orderBy("i")
    opens = F.coalesce(F.col("i") > F.max("to").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = longest.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(past))
    runs = runs.groupBy("doc", "run").agg(F.min("i").alias("i"), F.max("to").alias("to"))
    per = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "to"))).alias("runs"))
    named = every.where("i = 0").select(F.col("at").alias("doc"), "ka", "kb")
    return scratch.save(per.join(named, "doc").select("ka", "kb", "runs"), "runs")


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with later copies of repeated line runs cut out of text, and n_lines, n_deleted, n_runs.

    A run counts from min_lines lines on and, if long_words is given, also from one line of over
    long_words words on; shorter lines that repeat alone stay.
    A line is what stands between newlines; lines without a word are kept, and runs reach across
    them. Every distinct line keeps its first occurrence. Null text stays null, with no lines.
    Repeated rows (same doc_id and text) are one document: they lose the same lines. Null doc_ids and
    different texts that share an id are documents of their own. n_runs counts maximal deleted runs.
    Existing columns of those three names are replaced; others, whatever their names, stay.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = repeats(docs, scratch, min_lines, long_words)
    scratch.drop("runs")
    keyed = packed(docs, key=row_key("doc_id", "text"), lines=F.split(text_of(), "\n", -1))
    # runs grow with the documents: the plan of large inputs at every size, never a broadcast that small ones would get
    joined = keyed.join(found.hint("merge"), (F.col("key.a") == F.col("ka")) & (F.col("key.b") == F.col("kb")), "left")
    place = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("place", place).withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<i:int,to:int>>")))
    joined = joined.withColumn("gone", F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["to"] - 1))))
    at = F.transform("gone", lambda i: F.get("place", i))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), at)
    text = F.when(F.size("gone") == 0, F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    counts = {"n_lines": F.size("place").cast("long"), "n_deleted": F.size("gone").cast("long"), "n_runs": F.size("runs").cast("long")}
    named = [c for c in docs.columns if c not in counts]
    return joined.select(*(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in named), *(v.alias(c) for c, v in counts.items()))


def digest(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """dedup() without the texts: (doc_id, n_lines, n_deleted, n_runs, kept_sha256)."""
    out = dedup(docs.select("doc_id", F.col("text").cast("string")), min_lines, long_words)
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents
), s AS (
  SELECT doc_id, line, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS nxt
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), r AS (
  SELECT *, CASE WHEN nxt IS NOT NULL THEN row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, i) END AS nth,
    CASE WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 THEN row_number() OVER (PARTITION BY line ORDER BY doc_id, i) END AS alone FROM s
), g AS (
  SELECT *, coalesce(nth > 1, false) OR coalesce(alone > 1, false) OR coalesce(lag(nth) OVER (PARTITION BY doc_id ORDER BY i) > 1, false) AS gone FROM r
), h AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g
), c AS (
  SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_deleted, count_if(opens) AS n_runs FROM h GROUP BY doc_id
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS kept
  FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.p = l.p WHERE NOT coalesce(h.gone, false) GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_deleted, 0) AS BIGINT) AS n_deleted,
  CAST(coalesce(c.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
