"""Periodic runs against a scan of every distance."""

import random

import numpy as np
from pyspark.sql import functions as F

from authspan.llm import periods

EASY = periods.RunRules(chunk=1 << 12)


def scanned(words):
    """(start, period, length) of all runs, by distance."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, q, n) for (s, n), q in out.items())


def texts(rng, few):
    """Texts of random words, repeated stretches, copies of earlier texts and Fibonacci words, one after the other."""
    out = []
    for _ in range(few):
        k, words = rng.choice([1, 2, 3, 5, 100]), []
        for _ in range(rng.randrange(6)):
            kind = rng.randrange(4)
            if kind == 0:
                words += [rng.randrange(k) for _ in range(rng.randrange(60))]
            elif kind == 1:
                size = rng.randrange(1, 200)
                words += ([rng.randrange(k) for _ in range(rng.randrange(1, 40))] * size)[:size]
            elif kind == 2 and out:
                words += rng.choice(out)[: rng.randrange(1, 100)]
            else:
                a, b = [0], [0, 1]
                for _ in range(rng.randrange(3, 9)):
                    a, b = b, b + a
                words += b
        out.append(words)
    return out


def test_runs_against_a_scan():
    for seed in range(60):
        docs = texts(random.Random(seed), seed % 8)
        text, start, length, period = periods.runs_of(np.array([w for d in docs for w in d], dtype=np.int64), np.cumsum([len(d) for d in docs], dtype=np.int64))
        assert list(zip(text.tolist(), start.tolist(), period.tolist(), length.tolist(), strict=True)) == [(k, *r) for k, d in enumerate(docs) for r in scanned(d)]


def test_detect_and_collapse(spark):
    docs = [" ".join(f"w{x}" for x in d) for d in texts(random.Random(99), 40)]
    rows = [(i, d) for i, d in enumerate(docs)] + [(1, docs[1]), (None, "a " * 30), (40, None), (41, ""), (42, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("name", "body", "runs", "collapsed", "top")}).repartition(3)
    got = {}
    for r in periods.detect(df, EASY).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, text in rows:
        words = (text or "").split()
        want = scanned(words)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        for r in got[key]:
            assert [(x.start, x.period, x.length) for x in r.runs] == want
            assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periods.detect(df.limit(0)).isEmpty() and periods.digest(df.limit(0)).isEmpty()


def test_strongest_run_by_exact_fractions(spark):
    runs = [[(5, 30, 10), (0, 24, 8), (9, 27, 9)], [(0, 24, 1), (30, 48, 2)], [(3, 31, 10), (0, 30, 10)], [], [(0, 3 * 10**8 + 1, 10**8), (1, 3 * 10**8 + 2, 10**8)]]
    df = spark.createDataFrame([(i, sorted(r)) for i, r in enumerate(runs)], "i int, runs array<struct<start:long,length:long,period:long>>")
    top = [r.top and r.top.start for r in df.select("i", periods.strongest(F.col("runs")).alias("top")).orderBy("i").collect()]
    assert top == [0, 0, 3, None, 1]


def test_long_periodic_text():
    """A hundred thousand words of short and of long period: the grammar keeps the work near linear."""
    words = np.concatenate((np.zeros(50_000, np.int64), np.tile(np.arange(1, 1001), 50)))
    assert [v.tolist() for v in periods.runs_of(words, np.array([len(words)]))] == [[0, 0], [0, 50_000], [50_000, 50_000], [1, 1000]]


def test_planted_words():
    words = [f"w{i}".encode() for i in range(50)]
    key = next(i for i in range(100) if periods.zlib.crc32(str(i).encode()) % 10 == 0)
    g = periods.zlib.crc32(str(key).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert periods.planted(key, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert periods.planted(None, words) == words and periods.planted(key, []) == []
