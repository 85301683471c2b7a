"""Each operator against a brute-force form or an exact round trip, on small tables with odd cases."""

import base64
import hashlib
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from authspan.llm import embeddings, lines, mixing, pieces, quality, secrets, simhash, substrings, urls, warc
from authspan.llm.common import Scratch, components, split_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def texts(seed=5):
    """Copies, near copies, repeated lines, a long text, odd white space, nulls, ties, repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(rng.randint(3, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "\n".join(rng.choice(shared) if rng.random() < 0.4 else line(rng.randint(1, 50)) for _ in range(rng.randint(0, 6)))
        rows.append((i, t, rng.choice(["a", "b", None, "hot", "hot", "hot"])))
    base = rows[3][1] + "\n" + line(200)
    rows += [(100 + i, base + (" x" if i % 2 else ""), "hot") for i in range(8)]
    rows += [(200, line(5000), "a"), (201, None, "b"), (202, "", None), (203, " \t\n\x0b ", "b"), (204, "word " * 400, "a"), (None, "lonely text here", "a"), (205, "▁ odd\r\n 漢字 😀", "z"), rows[5], rows[5], (7, "another text of a known id", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(texts(), DOCS).repartition(5)
    clash = {c: F.lit("x") for c in ("fp", "key", "size", "n_words", "a", "b", "n", "names", "kept", "piece_ids", "decoded", "count", "verdict", "host")}
    return df.withColumns(clash)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# 1


@pytest.mark.parametrize("shard", [512, 3])
def test_simhash(spark, docs, shard, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, shard))
    rows = texts()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    parent = {f: f for f in fps}
    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            r = find(parent, f)
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(find(parent, f)))) for (i, _, _), f in zip(rows, fps))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_dups(docs).collect())
    assert got == want


def test_simhash_dense_shards(spark):
    """Many values within few bits of each other, in tiles far smaller than their shard."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 3, 20).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    one, two = {v: v for v in values}, {v: v for v in values}
    for a, b in edges:
        one[find(one, a)] = find(one, b)
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                two[find(two, a)] = find(two, b)
    assert len({(find(one, v), find(two, v)) for v in values}) == len({find(one, v) for v in values}) == len({find(two, v) for v in values})


def test_bk_tree_matches_scan():
    rng = random.Random(4)
    tree, values = simhash.BKTree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_keep_one(spark, docs):
    out = simhash.keep_one(docs)
    groups = simhash.similar(docs).select("component_id").distinct().count()
    assert out.count() == groups and out.columns == docs.columns
    assert simhash.keep_one(empty(spark)).isEmpty() and simhash.near_dups(empty(spark)).isEmpty()


def test_similar_finds_jaccard_neighbours(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    rows, near = [], []
    for g in range(40):
        base = [word() for _ in range(400)]
        rows.append((10 * g, " ".join(base)))
        for k, changes in ((1, 3), (2, 40)):  # about 0.93 and 0.4 of five-word shingles in common
            copy = list(base)
            for at in rng.sample(range(0, 400, 8), changes):
                copy[at] = word()
            rows.append((10 * g + k, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), shard=16).collect()}
    assert sum(got[10 * g + 1] == 10 * g for g in range(40)) >= 39
    assert all(got[10 * g + 2] == 10 * g + 2 and got[10 * g] == 10 * g for g in range(40))


def test_similar_judges_shingle_sets(spark):
    """Pairs on both sides of 0.8, near enough that fingerprints can't tell; and a text judged by its set, not by its repeats."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    rows, want = [], {}
    for g in range(60):
        base = [word() for _ in range(400)]
        copy = list(base)
        for at in rng.sample(range(10, 390, 10), 8 if g % 2 else 10):  # 0.816 and 0.775 of the shingles in common
            copy[at] = word()
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy))]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g + (g % 2 == 0)}
    some = [word() for _ in range(100)]
    rows += [(1000, " ".join(some)), (1001, " ".join(some + some[:5] * 100))]  # 96 and 105 shingles, 96 shared
    want |= {1000: 1000, 1001: 1000}
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999).collect()}
    odd = [i for i in want if got[i] != want[i]]
    assert not [i for i in odd if got[i] < want[i]] and len(odd) <= 2  # no false link; 256 bits may hide a pair


def test_similar_settles_groups_around_the_similarity(spark, monkeypatch):
    """Copies of one text on both sides of 0.8 of each other, settled in small tiles, against all pairs."""
    monkeypatch.setattr(simhash, "TILE_BYTES", 8000)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    base, rows = [word() for _ in range(400)], []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(0, 400, 8), rng.choice((4, 5, 6, 7))):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), shard=16).collect()}
    assert 1 < len(set(root)) < len(rows)
    assert all(root[got[i]] == root[i] for i in got)  # nothing is grouped that isn't linked
    assert sum(got[i] == root[i] for i in got) >= 0.97 * len(rows)


def test_rows_without_or_with_shared_ids_stay(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, word(0), "a"), (None, word(1), "a"), (None, word(1), "a"), (3, word(2), "a"), (3, word(3), "a"), (4, word(3), "b")]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.text for r in simhash.keep_one(df).collect())
    assert kept == [word(0), word(1), word(2), word(3)]
    out = mixing.mixed(df).collect()
    want = {r.source: 0 for r in out}
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    assert {s: sum(len(r.text.split()) for r in out if r.source == s) for s in want} == want


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert len({got[i] for i in range(100, 161)}) == 1 and len({got[i] for i in range(40)}) == 1 and got[0] != got[100]


# 2


def plain_substrings(rows, n):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[p : p + n] for _, b in raw for p in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = True
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), runs, bytes(x for x, y in zip(b, gone) if not y)))
    return sorted(out)


@pytest.mark.parametrize("n,hot", [(20, 50_000), (20, 4), (200, 50_000)])
def test_substrings(spark, docs, n, hot):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(docs, n, hot).collect())
    assert got == plain_substrings(texts(), n)


def test_substrings_periodic_and_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 500)
    rng = random.Random(1)
    part = "".join(rng.choice("abc d") for _ in range(260))
    rows = [(1, "ab" * 400), (2, "".join(rng.choice("abc d") for _ in range(1900)) + part), (3, part + "".join(rng.choice("abc d") for _ in range(700)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(df, 50).collect())
    assert got == plain_substrings(rows, 50)
    assert substrings.dedup(empty(spark)).isEmpty()
    with pytest.raises(ValueError):
        substrings.dedup(df, 1)


def test_substrings_one_occurrence_is_no_repeat(spark):
    """Rulers in texts so short that the contexts of two anchors are both the whole text."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(at := rng.randint(0, 70)) + "-" * 150 + noise(70 - at)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(df).collect())
    assert got == plain_substrings(rows, 200)


# 3


def test_warc_round_trip(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # records and payloads cross splits
    try:
        fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde"
        kinds = ["", "plain " * 30, None, "a\r\n\r\n" + fake + "\r\n\r\nWARC/1.1\r\nzz\r\n\r\n" + fake + "\r\n\r\n tail", "x\r\n\r\n\r\n", fake, "\r\n\r\nWARC/1.1\r\n", "é" * 700]
        rows = [(i, f"http://x/{i}\r\nX: y", kinds[i % 8] if i < 40 or kinds[i % 8] is None else kinds[i % 8] + str(i)) for i in range(90)] + [(None, None, "q"), (None, None, None)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
        largest = {}
        for i, _, h in rows:
            if i is not None:
                largest[h or ""] = max(largest.get(h or "", -1), i)
        want = []
        for i, _, h in rows:
            top = largest.get(h or "", i)
            data = (h or "").encode()
            want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top == i else "revisit", str(None if top == i else top), True))
        got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.agrees) for r in warc.round_trip(df).collect()]
        assert sorted(got) == sorted(want)
        # once more, with other splits while the plan is made than while it runs, as when executors come and go
        scratch = Scratch(spark, "warc-test")
        warc.write(df, scratch.path("archives"), scratch)
        late = warc.read(spark, scratch.path("archives"), scratch)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.agrees) for r in late.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warc.round_trip(empty(spark, "page_id long, url string, html string")).isEmpty()


# 4


@pytest.mark.parametrize("tile", [1024, 16])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 250)] + 0.15 * rng.standard_normal((250, 16)), np.repeat(centres[:1], 40, axis=0), rng.standard_normal((100, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, [float("inf")] * 16), (1005, []), (None, v[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x")).repartition(4)
    got = embeddings.near_dups(df, embeddings.ForestRules(tile=tile, leaf=64)).collect()
    unit = np.concatenate([v, v[:1]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    links = link.sum(axis=1) - 1
    found = {r.vec_id: r for r in got}
    have = np.array([found[i].n_links for i in range(len(v))] + [found[None].n_links])
    assert (have <= links).all() and have.sum() >= 0.95 * links.sum()
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(1000, 1006))
    assert len(got) == len(rows) + len(odd) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_dups(empty(spark, "vec_id long, embedding array<float>")).isEmpty()


@pytest.mark.parametrize("n", [1500, 4500])
def test_embeddings_of_refined_leaves(spark, n):
    """Splits fitted on few vectors, leaves dealt anew until they are small: links found, against all pairs, at two sizes."""
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 6, 24))
    v = centres[rng.integers(0, len(centres), n)] + 0.2 * rng.standard_normal((n, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    rules = embeddings.ForestRules(sample=100, leaf=24, most=200, subsample=120, block=64, tile=150)
    got = {r.vec_id: r.n_links for r in embeddings.near_dups(df, rules).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    have = np.array([got[i] for i in range(n)])
    assert (have <= links).all() and have.sum() >= 0.9 * links.sum() > 0


# 5


def test_pieces_round_trip(spark, docs):
    out = pieces.decode(pieces.encode(docs)).collect()
    assert len(out) == len(texts()) and all(r.decoded == r.text for r in out)
    again = {(r.doc_id, r.text): r.piece_ids for r in pieces.encode(docs.repartition(2)).collect()}
    assert all(again[(r.doc_id, r.text)] == r.piece_ids for r in out)
    assert pieces.decode(pieces.encode(empty(spark))).isEmpty()


def test_pieces_sample_the_lattice_exactly():
    import sentencepiece

    rules = pieces.SampleRules(alpha=0.2)
    sp = sentencepiece.SentencePieceProcessor(model_file=rules.model)
    vocab = pieces.vocabulary(rules.model)
    log_p = {int(i): float(p) for t in vocab.tables.values() for i, p in zip(t.ids, t.log_p)}
    of = {sp.id_to_piece(i): i for i in log_p}

    def ways(s):
        if not s:
            return [()]
        return [(of[s[:k]], *rest) for k in range(1, len(s) + 1) if s[:k] in of for rest in ways(s[k:])]

    every = ways("▁tions")
    w = np.array([math.exp(rules.alpha * sum(log_p[i] for i in x)) for x in every])
    n = 30_000
    with np.errstate(over="ignore"):
        ids, counts = pieces.encode_texts(["tions"] * n, np.arange(n, dtype=np.uint64), rules)
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts))
    assert set(seen) <= set(every)
    for x, p in zip(every, w / w.sum()):
        assert abs(seen[x] / n - p) < 0.015


# 6


def plain_lines(rows, m):
    """Distinct documents in (doc_id, key) order; a window of m lines seen before marks its lines."""
    keyed = sorted({(i if i is not None else -1, t) for i, t, *_ in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in keyed:
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        gone = set()
        for p in range(len(ls) - m + 1):
            w = tuple(ls[p : p + m])
            if w in seen:
                gone.update(range(p, p + m))
            seen.add(w)
        out[(i, t)] = (len(ls), len(gone))
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_lines(spark, m):
    rows = [r for r in texts() if r[0] != 7]  # one text per id, so that the order is known
    got = lines.dedup(spark.createDataFrame(rows, DOCS).withColumn("n_runs", F.lit("x")).repartition(4), m).collect()
    want = plain_lines(rows, m)
    source = {(i, t) for i, t, *_ in rows}
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_deleted))
    for i, t in source:
        assert set(by[i]) == {want[(i if i is not None else -1, t)]}
    kept = {x for r in got for x in (r.text or "").split("\n")}
    assert {x for _, t in source for x in (t or "").split("\n") if WORD.search(x)} <= kept  # every line survives once
    assert lines.dedup(empty(spark)).isEmpty()


def test_pipeline_cuts_long_single_lines(spark):
    import corpus_pipeline

    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd"), (3, long), (4, f"{short}\ne"), (5, f"{long}\n\n{long}")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: "", 4: rows[3][1], 5: ""}


# 7


def test_secrets(spark):
    key = "AKIA" + "Q7" * 10
    rows = [
        (1, f'x password="hunter2hunter2" {key} and Token: abcdefghijkl.'), (2, None), (3, ""), (4, "é😀 secret = Zx9Zx9Zx9Zx9Q tail deadbeefdeadbeef00 AKIA12 deadbeef"),
        (5, "q8Zr5TtYw2LmPo0Ks7VbXe4 plain"), (6, "123e4567-e89b-12d3-a456-426614174000 aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 abcdefghijklmnopqrstuvwxyz example0q8Zr5TtYw2LmPo0Ks7"),
        (7, "password: token: abcdefghijklmnop"), (7, "password: token: abcdefghijklmnop"), (8, "w " * 20_000 + key),
    ]
    got = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    rule = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in rule.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = by[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert by[5].spans == "entropy_base64:0:23" and "entropy" not in by[6].spans
    assert secrets.digest(empty(spark)).isEmpty()


def plain_spans(text, rules):
    """All kinds, by loops: base kinds, and candidates that overlap none of them and aren't allowed."""
    rule = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        v, n = m[0], rules.window
        if len(v) < n or any(re.search(a, v) for a in rules.allow) or any(s < m.end() and m.start() < e for s, _, e in spans):
            continue
        hexed = re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)
        peak = max(sum(-c / n * math.log2(c / n) for c in Counter(v[i : i + n]).values()) for i in range(len(v) - n + 1))
        if peak >= (rules.hex_bits if hexed else rules.base64_bits) - 1e-12:
            more.append((m.start(), 3 if hexed else 4, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more))


def test_secret_spans_by_brute_force(spark):
    rng = random.Random(12)
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    makers = [
        lambda: some("ABCDEF0123456789", 10, 40), lambda: some("abcdef0123456789", 10, 40), lambda: some("abcXYZ019+/_=-", 10, 60), lambda: some("ab1", 10, 50), lambda: f"token={some('aB3xY9', 5, 20)}",
        lambda: "AKIA" + some("QWE789", 5, 20), lambda: "some-plain-words-here2024", lambda: some("éß漢", 1, 6), lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "example" + some("aB3xY9Zq", 20, 30), lambda: some("aB3xY9Zq8Kd", 600, 700),
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", "  ", "\n", ".", ",", '"', ": "]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    texts.append(" ".join(some("abcdef0123456789", 16, 20) for _ in range(900)))  # more matches than a block
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == plain_spans(t, secrets.SecretRules()) for i, t in enumerate(texts))
    assert sum("entropy" in v for v in got.values()) > 50


def test_secrets_of_a_megabyte(spark):
    rng = random.Random(1)
    text = "key " + "".join(rng.choice("ABCdefgh0123456789XYZqrstuv+/") for _ in range(1_000_000))
    began = time.time()
    assert secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans == "entropy_base64:4:1000004"
    assert time.time() - began < 120


def test_peak_entropy(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcd0123XYZ") for _ in range(rng.randint(20, 70))),) for _ in range(30)]
    for s, got in spark.createDataFrame(rows, "s string").select("s", secrets.peak_entropy(F.col("s"), 20)).collect():
        h = [sum(-c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)]
        assert got == pytest.approx(max(h))


# 8


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    rows = texts()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    total = sum(r.size for r in got)
    per = {r.source: (r.source_size, r.target) for r in got}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    target, free = {}, dict(weight)
    while True:  # resharing until none is above its limit
        level = (1.5 * total - sum(target.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * per[s][0]]
        if not over:
            break
        for s in over:
            target[s] = 2 * per[s][0]
            free.pop(s)
    target |= {s: level * w for s, w in free.items()}
    for s, (_, t) in per.items():
        assert t == pytest.approx(target[s])
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= max(r.size for r in got if r.source == s) / 2
    assert all(r.taken <= 2 * r.size for r in got)
    assert Counter(got) == Counter(mixing.mix(docs.repartition(3)).collect())
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).isEmpty() and mixing.mixed(empty(spark)).isEmpty()


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(0, 6, len(lengths))
        total = int(lengths @ counts)
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert abs(int(lengths @ take) - budget) <= max(2, min(abs(s - budget) for s in sums) + int(lengths.max()) // 4)


# 9


def test_urls(spark):
    rng = random.Random(6)
    rows = [(i, f"https://{rng.choice(['www.', ''])}{rng.choice(['ab', 'cd', 'ef'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{i}?q={i}") for i in range(300)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "HTTP://EXÄmple.NET/En/x#://y"), (1003, "a://b.net"), (1004, "ftp://x.org/fr/\nz?"), (1004, "ftp://x.org/fr/\nz?"), (None, "http://example.net/en/")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).repartition(3)).collect()
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fit = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fit, key=len) if fit else None
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")
    assert urls.judge(empty(spark, "page_id long, url string")).isEmpty()
    one = urls.judge(spark.createDataFrame([(1, "http://x.net/a"), (2, "http://y.com/a")], "page_id long, url string")).collect()
    assert {r.verdict for r in one} == {"block"}


def test_url_trees_learn(spark):
    """Held-out accuracy: rules label long numeric urls of one suffix, the trees find others of the kind."""
    rng = random.Random(8)
    bad = lambda tld: f"http://{rng.randrange(10**9)}.spam.{tld}/{rng.randrange(10**12)}?a={rng.randrange(10**6)}&b=1"
    good = lambda tld: f"http://news.{tld}/{rng.choice(['politics', 'sports', 'culture'])}/story"
    rows = [(i, bad("bad") if i % 2 else good("good")) for i in range(400)] + [(1000 + i, bad("com") if i % 2 else good("com")) for i in range(100)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.UrlRules(block=("bad/",), allow=("good/",), suffix_prior=1e9)).where("rule is null").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in out) >= 90


# 10


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    cover = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 8)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    base = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cover), base


def test_quality(spark, docs):
    got = quality.judge(docs).collect()
    want = Counter((i, s, *plain_quality(t)) for i, t, s in texts())
    assert Counter((r.doc_id, r.source, *(r[c] for c in quality.SIGNALS), r.base_failed) for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(empty(spark)).isEmpty() and quality.keep_good(empty(spark)).isEmpty()


def test_bad_host_goes_clean_ones_stay(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 20 == 0 else "short", "spam") for i in range(200)] + [(1000 + i, good, f"s{i % 5}") for i in range(200)] + [(5000, good, "new")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i] for i in range(200)) and all(got[1000 + i] for i in range(200)) and got[5000]


CLASH = ("_k", "_id", "_key", "_row", "_times", "_lines", "_s", "keep_id", "ka", "kb", "times", "rows", "runs", "lines", "place", "gone", "source_size", "base_failed", "found", "nth", "copy", "bad", "doc")


def test_stages_keep_columns_of_any_name(spark):
    rows = [r for r in texts() if r[0] != 7]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(c), F.col("source")) for c in CLASH}).repartition(3)
    stages = {
        "lines": lambda d: lines.dedup(d, long_words=50).select(*d.columns), "one": simhash.keep_one, "mix": mixing.mixed, "good": quality.keep_good,
    }
    for name, stage in stages.items():
        out = stage(df)
        assert out.columns == df.columns, name
        found = out.select(*(F.col(c).eqNullSafe(F.concat(F.lit(c), F.col("source"))).alias(c) for c in CLASH)).distinct().collect()
        assert [tuple(r) for r in found] == [(True,) * len(CLASH)], name
        plain = stage(df.select("doc_id", "text", "source"))
        key = ["doc_id", "text", "source"]
        assert Counter(map(tuple, out.select(key).collect())) == Counter(map(tuple, plain.select(key).collect())), name


def test_segmented_keeps_columns_of_any_name(spark):
    names = (*CLASH, "decoded", "piece_ids", "piece_ids_", "_text", "_ids", "_key")
    df = spark.createDataFrame(texts(), DOCS).withColumns({c: F.concat(F.lit(c), F.coalesce("source", F.lit(""))) for c in names}).repartition(3)
    out = pieces.segmented(df)
    assert out.columns == [*df.columns, "piece_ids__"]
    assert Counter(map(tuple, out.drop("piece_ids__").collect())) == Counter(map(tuple, df.collect()))
    plain = pieces.segmented(df.select("doc_id", "text", "source"))
    assert plain.columns == ["doc_id", "text", "source", "piece_ids"]
    bag = lambda d, c: Counter((r.doc_id, r.text, tuple(r[c] or ())) for r in d.collect())
    assert bag(out, "piece_ids__") == bag(plain, "piece_ids")
    import corpus_pipeline

    assert corpus_pipeline.STAGES[-1][1](spark, df, "").columns == out.columns
    assert pieces.segmented(df.limit(0)).isEmpty()


def test_lines_runs_against_a_scan(spark):
    """Long repeated runs, periodic lines and runs that meet: the doubling goes on for several rounds."""
    rng = random.Random(4)
    base = [f"line {rng.randrange(40)}" for _ in range(90)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["x", *base[10:80], "y"])), (3, "same\n" * 37), (4, "\n".join(base[:30] + base[50:] + base[:5])), (5, ""), (None, "\n".join(base[20:25])), (6, "\n\n".join(base))]
    for m in (1, 2, 3, 5):
        got = {r.doc_id: (r.n_lines, r.n_deleted) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
        want = plain_lines(rows, m)
        assert all(got[i] == want[(i if i is not None else -1, t)] for i, t in rows)


def test_split_join_keeps_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else 1 if i % 3 == 1 else i, i) for i in range(3000)], "k long, v long")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = sorted(map(str, split_join(rows, facts, ["k"], "n").collect()))
    assert got == sorted(str(r) for r in rows.join(facts.withColumnRenamed("k", "q"), F.col("k").eqNullSafe(F.col("q"))).select("k", "v", "top").collect())


def test_digest_queries_are_registered():
    from authspan.llm import registry

    assert sorted(int(m[1]) for n in registry.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    json.dumps(registry.ORACLES)
