"""Spelling variants: words one letter apart, each with the frequent word it is a form of.

Words are counted over whole texts; a worker counts a bounded number of words before it sends them on.
Near words are found by PartEnum. A word's letters, with repeats told apart (the second a is another letter
than the first), are a binary vector; one inserted, deleted or replaced letter changes at most two of its
places. Its places are dealt into parts (distance + 1 of them at least); vectors at most `distance` apart
agree in all but `distance` parts, so they share a signature among those of all choices of parts.

Letter multisets forget the order, so a signature also names SpellingRules.pieces - 1 of as many pieces that the
word is cut into: one edit leaves all pieces but one as they are. Words with an equal signature are
joined, and an edit distance of exactly one is verified for every pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import Scratch


@dataclass(frozen=True)
class SpellingRules:
    letters: int = 6  # code points of a word, at least
    seen: int = 5  # occurrences of a word, at least
    ratio: int = 5  # a form is so many times as frequent as the word
    distance: int = 2  # places in which letter vectors of near words differ
    parts: int = 3  # of the vector's places; more than distance
    pieces: int = 4  # of the word


#: Words that a worker counts before it sends the counts on.
HELD = 200_000

Edit = Callable[[object, str], str]


def misspelt(key: object, word: str) -> str:
    """The contract's misspelling: where 199 divides the checksum of key and word, a letter is missing. A null key counts as empty."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{'' if key is None else key}:".encode()))
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, rules: SpellingRules = SpellingRules(), name: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    r"""(word, n: long) for the words of all texts that are long and frequent enough.

    Words are maximal runs of [A-Za-zÀ-ÿ], A-Z lower-cased. Null and empty texts have none. edit
    changes a row's words before they are counted; it may shorten them.
    """
    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{rules.letters},}}")
    slim = docs.select(F.col(name).alias("name"), F.col("text").cast("string").cast("binary").alias("body")).where("body is not null")

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(pattern.findall(body.lower().decode("utf-8", "replace")))  # of bytes, ASCII letters alone
                for word, n in own.items():
                    word = edit(key, word) if edit else word
                    if len(word) >= rules.letters:
                        held[word] += n
                if len(held) > HELD:
                    yield sent(held)
                    held.clear()
        yield sent(held)

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.seen)


def letter_parts(word: str, parts: int) -> list[int]:
    """For each part of the places of the word's letter vector, a number of those that are set."""
    out, seen = [0] * parts, Counter()
    for c in word:
        place = zlib.crc32(f"{c}{seen[c]}".encode())
        seen[c] += 1
        out[place % parts] += (place + 1) * 0x9E3779B97F4A7C15
    return out


def agreements(word: str, pieces: int) -> list[tuple]:
    """What words one edit apart share one of: all pieces but one, as the shorter of them is cut.

    Any word may be the shorter, of its own length, or the longer by one letter.
    """
    n, out = len(word), []
    for short in (n, n - 1):
        cuts = [short * k // pieces for k in range(pieces + 1)]
        out += [(short, k, word[: cuts[k]], word[n - short + cuts[k + 1] :]) for k in range(pieces)]
    return out


def signatures(words: DataFrame, rules: SpellingRules) -> DataFrame:
    """(signature: long, word, n), several rows a word. Different signatures rarely share a number, which costs a comparison only."""
    chosen = list(combinations(range(rules.parts), rules.parts - rules.distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for word in batch.column(0).to_pylist():
                letters = letter_parts(word, rules.parts)
                sums = [zlib.crc32(repr((c, [letters[i] for i in c])).encode()) for c in chosen]
                keys += [(s << 32 | zlib.crc32(repr(a).encode(), s)) for a in agreements(word, rules.pieces) for s in sums]
            each = 2 * rules.pieces * len(chosen)
            at = pa.array(np.repeat(np.arange(batch.num_rows), each))
            found = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([found, batch.column(0).take(at), batch.column(1).take(at)], ["signature", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def near_words(words: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """(word, n, other, other_n): all words exactly one inserted, deleted or replaced code point apart, both ways round."""
    left = signatures(words, rules)
    right = left.select("signature", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = left.join(right.hint("merge"), "signature").where("word < other and levenshtein(word, other, 1) = 1")
    pairs = pairs.select("word", "n", "other", "other_n").distinct()  # pairs may share several signatures
    return pairs.unionAll(pairs.select("other", "other_n", "word", "n"))


def group(words: DataFrame, scratch: Scratch, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of words (word, n; a row a word).

    form is the most frequent near word (ties: the first in code-point order) where it is rules.ratio times as
    frequent, else null; root is the last of the forms from word on, word itself without any. Counts grow along
    forms, so they are few in a row and never meet again; each round doubles the steps that roots have taken.
    """
    words = scratch.save(words, "words")
    best = near_words(words, rules).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    best = best.select(F.col("word").alias("near"), "n_near", F.col("best.other").alias("other"), (-F.col("best.col1")).alias("other_n"))
    formed = F.col("other_n") >= rules.ratio * F.col("n")
    found = words.join(best, F.col("word") == F.col("near"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n")
    )
    found = scratch.save(found, "forms")
    steps, nth = found.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = steps.join(further, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved"))
        moved = scratch.save(moved, f"roots{nth}")
        steps, nth = moved.drop("moved"), nth + 1
        if moved.where("moved").isEmpty():
            return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, rules: SpellingRules = SpellingRules(), name: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """group() of the texts' vocabulary: a row per word that is long and frequent enough.

    Rows that repeat count again, null and empty texts add nothing, an empty table has no words, and columns
    other than name and text, whatever their names, are not looked at.
    """
    return group(vocabulary(docs, rules, name, edit), Scratch(docs.sparkSession, "spelling"), rules)


def digest(docs: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """variants() of documents with the contract's misspellings."""
    return variants(docs, rules, edit=misspelt).select("word", "form", "root", "n", "n_near", "form_n")
