"""Token files against the tokenizer on whole texts, by position and as a whole."""

import glob
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from authspan.llm import tokens

DATA = "/root/testdata/sf0.001"
SMALL = tokens.TokenRules(length=16, rows=3)
ODD = ["ä ̈b  <|endoftext|>x<|ENDOFTEXT|> ΣΑΣ. ας b c 한글 İx é 'S 'll 12 ½ \x1c x\x85y \U0001f600‍", "H̱i, ẖi. don't,stop..,now é.é×.÷, A<|startoftext|>B", "", None, " \t\n", 'say "hi" ".,', "x" * 5000 + ",y" * 700]


def wanted(rows, rules):
    """Rows (doc_id, start, n_tokens, crc) from whole texts, one after the other."""
    library, at, out = Tokenizer.from_file(rules.tokenizer), 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, rules.end_id]
        out.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = wanted([tuple(r) for r in docs.select("doc_id", "text").collect()], tokens.TokenRules())
    got = sorted(map(tuple, tokens.digest(docs.repartition(5)).collect()))
    assert got == want


def test_odd_texts_over_batches_and_shards(spark):
    rows = [(7 * i % 40, t) for i, t in enumerate(ODD * 4)] + [(None, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("name", "body", "at", "file", "shard", "k0")}).repartition(4)
    assert sorted(map(tuple, tokens.digest(docs, SMALL).collect()), key=lambda r: r[1]) == wanted(rows, SMALL)


def test_repeated_names_and_rows(spark):
    rows = [(3, "b"), (3, "a"), (3, "a"), (None, "z"), (None, None)] * 50
    got = tokens.digest(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    count = lambda rs: sorted((str(r[0]), r[2], r[3]) for r in rs)
    assert count(got) == count(wanted(rows, SMALL))


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.digest(none).isEmpty()


def test_random_access(spark, tmp_path):
    """Every sequence of every shard, by number, is a view of the mapped file; masks cover the padding alone."""
    docs = spark.createDataFrame([(i, "alpha beta gamma " * (i % 9)) for i in range(100)], "doc_id long, text string")
    index = tokens.write(docs, str(tmp_path), SMALL).collect()
    library = Tokenizer.from_file(SMALL.tokenizer)
    flat = []
    for file in sorted({r.file for r in index}):
        shard = tokens.Shard(file)
        before = pa.total_allocated_bytes()
        n = sum(shard.file.get_batch(i).num_rows for i in range(shard.file.num_record_batches))
        assert all(shard.file.get_batch(i).num_rows == SMALL.rows for i in range(shard.file.num_record_batches - 1))
        for i in range(n):
            ids, mask = shard.sequence(i)
            assert len(ids) == len(mask) == SMALL.length and not ids.flags.owndata
            assert mask.true_count == SMALL.length or i == n - 1
            flat += ids[: mask.true_count].tolist()
        assert pa.total_allocated_bytes() - before < 1 << 16
    assert flat == [x for i in range(100) for x in [*library.encode("alpha beta gamma " * (i % 9), add_special_tokens=False).ids, 1]]
    assert len(glob.glob(f"{tmp_path}/shards/*.arrow")) == len({r.file for r in index})


def test_wide_ids():
    """A vocabulary beyond 16 bits, as the end id needs here, is written in 32."""
    rules = tokens.TokenRules(end_id=1 << 16)
    assert tokens.Encoder(rules).dtype == np.dtype("<u4") and tokens.Encoder(SMALL).dtype == np.dtype("<u2")
