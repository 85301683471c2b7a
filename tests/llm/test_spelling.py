"""Spelling variants against all pairs of words, on words of few letters that meet often."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from authspan.llm import spelling
from authspan.llm.common import Scratch


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    """word: (n, n_near, form, form_n, root) from all pairs."""
    by = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, xs in by.items():
        top = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(by[w]), form[w], counts.get(form[w]), root)
    return out


def test_words_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(300)} | {"".join(rng.choice("aÀ×÷ÿz") for _ in range(rng.randrange(6, 14))) for _ in range(100)} | {"a" * n for n in range(6, 30)}
    counts = {w: 5 ** rng.randrange(1, 8) for w in words}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    for rules in (spelling.SpellingRules(), spelling.SpellingRules(parts=5, pieces=2), spelling.SpellingRules(pieces=1)):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group(df, Scratch(spark, "t"), rules).collect()}
        assert got == grouped(counts)
    assert any(r[2] is not None and r[4] != r[2] for r in grouped(counts).values())  # forms of forms occur


def test_digest_against_plain_counts(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    mark = lambda w: "".join(c.upper() if rng.random() < 0.2 and c.isascii() else c for c in w)
    rows = [(i if i % 50 else None, "".join(mark(rng.choice(base)) + rng.choice([" ", "-", "'", "1", "ő", "Ā", "\n"]) for _ in range(rng.randrange(200)))) for i in range(400)]
    rows += [(7, None), (8, ""), rows[9], rows[9]]
    counts = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("name", "body", "word", "n", "near")}).repartition(3)
    got = spelling.digest(df).collect()
    assert len(got) == len(counts) and {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == grouped(counts)
    assert spelling.digest(df.limit(0)).isEmpty()


def test_counts_sent_in_pieces(spark, monkeypatch):
    """Words beyond what a worker holds are still counted whole."""
    df = spark.createDataFrame([(i, f"common word{'abcdefghij'[i % 10] * 3}x") for i in range(500)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == {"common": 500, **{f"word{c * 3}x": 50 for c in "abcdefghij"}}


def test_words_one_edit_apart_share_a_signature():
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 15)))
        i, c = rng.randrange(len(a) + 1), rng.choice("abcd")
        b = rng.choice([a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 :]])
        if b and near(a, b):
            x, y = (spelling.letter_parts(w, 3) for w in (a, b))
            assert any(p == q for p, q in zip(x, y, strict=True))
            assert set(spelling.agreements(a, 4)) & set(spelling.agreements(b, 4))
