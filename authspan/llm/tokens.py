"""Token ids in Arrow files of equal-length sequences, read back by position without copying.

Documents are dealt out by ranges of doc_id and every task writes one shard: an Arrow file (the stream
format with a footer, so that any batch is found at once) whose batches hold

- ids: fixed-size lists of token ids, in the smallest unsigned type that the vocabulary fits,
- mask: fixed-size lists of booleans, false where the shard's last sequence is padded,
- ends: fixed-size lists of booleans, true at the last id of a document.

All batches but a shard's last have equally many sequences, so id number i of a shard is in batch i // (rows *
length). The index, a Parquet table, tells for each document its shard, the file, and the id it begins at.
A file's name carries the task attempt, and the index names the files of attempts that were committed: what a
lost executor left behind belongs to no index.

A text's ids are those of its parts between ASCII white space, as the tokenizer's normaliser and pattern
never join across it (so for the tokenizer of TokenRules; others need to lower-case and to split alike). A worker keeps the ids of parts it has met in a table of bounded size.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authspan.llm.common import Scratch

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ModuleNotFoundError:  # the vocabulary is a parameter; only its default is missing
    TOKENIZER = ""


@dataclass(frozen=True)
class TokenRules:
    tokenizer: str = TOKENIZER  # file of the tokenizers library
    end_id: int = 1  # appended to each document
    length: int = 2048  # ids of a sequence
    rows: int = 64  # sequences of a batch
    cached: int = 600_000  # parts of texts whose ids a worker keeps


#: A mark after a letter or digit, of ASCII or Latin-1: the tokenizer's pattern always parts them.
STOP = re.compile(rb"[.,;:!?](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


#: Parts that the normaliser and the pattern leave as they are: the library's merges alone give their ids.
PLAIN = re.compile(rb"[a-z]+").fullmatch


def plainer(text: bytes) -> bytes:
    """A text with the same ids and fewer distinct parts: marks stand alone and ASCII letters are lower case.

    Letters stay where a combining mark follows some (there are compositions of one case alone) or where a
    special token could come about.
    """
    if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
        text = text.lower()
    return STOP.sub(rb" \g<0>", text)


class Encoder:
    """Ids of texts, as bytes of the vocabulary's type."""

    def __init__(self, rules: TokenRules):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(rules.tokenizer)
        self.dtype = np.dtype("<u2" if max(self.library.get_vocab_size(), rules.end_id + 1) <= 1 << 16 else "<u4")
        self.cells = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.library.get_vocab_size())]
        self.merged = self.library.model.tokenize
        self.limit = rules.cached
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        parts = [plainer(t).split() for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = list(set(chain.from_iterable(parts)))
        rest = []
        for p in new:
            if PLAIN(p):
                self.known[p] = b"".join([self.cells[t.id] for t in self.merged(p.decode())])
            else:
                rest.append(p)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            found = self.library.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            self.known.update(zip(some, (b"".join([self.cells[i] for i in e.ids]) for e in found), strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def encoder(rules: TokenRules) -> Encoder:
    return Encoder(rules)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class ShardWriter:
    """One Arrow file; holds at most a batch and a text."""

    def __init__(self, uri: str, rules: TokenRules, dtype: np.dtype):
        self.rules, self.dtype, self.written = rules, dtype, 0
        lists = lambda kind: pa.list_(kind, rules.length)
        self.schema = pa.schema({"ids": lists(pa.from_numpy_dtype(dtype)), "mask": lists(pa.bool_()), "ends": lists(pa.bool_())}, {"rows": str(rules.rows)})
        fs, path = file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.stops: list[int] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> int:
        """Appends a document's ids; returns the place of the first."""
        at = self.written + self.n
        self.held.append(ids)
        self.n += len(ids)
        self.stops.append(at + len(ids) - 1)
        full = self.rules.length * self.rules.rows
        if self.n >= full:
            flat = np.concatenate(self.held)
            whole = self.n // full * full
            for a in range(0, whole, full):
                self._batch(flat[a : a + full])
            self.held, self.n = [flat[whole:].copy()], self.n - whole
        return at

    def _batch(self, ids: np.ndarray) -> None:
        size = -(-len(ids) // self.rules.length) * self.rules.length
        padded = np.zeros(size, dtype=self.dtype)
        padded[: len(ids)] = ids
        after = self.written + len(ids)
        k = int(np.searchsorted(self.stops, after))
        ends = np.zeros(size, dtype=bool)
        ends[np.array(self.stops[:k], dtype=np.int64) - self.written] = True
        bits = lambda flags: pa.Array.from_buffers(pa.bool_(), size, [None, pa.py_buffer(np.packbits(flags, bitorder="little").tobytes())])
        flat = [pa.array(padded), bits(np.arange(size) < len(ids)), bits(ends)]
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, self.rules.length) for v in flat], schema=self.schema))
        self.written, self.stops = after, self.stops[k:]

    def close(self) -> None:
        if self.n:
            self._batch(np.concatenate(self.held))
        self.file.close()
        self.sink.close()


class Shard:
    """Random access to a shard. On a local disk the file is mapped, so that what it returns are views of it."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.rows = int(self.file.schema.metadata[b"rows"])
        self.length = self.file.schema.field("ids").type.list_size
        self._last: tuple[int, pa.RecordBatch] | None = None

    def batch(self, i: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != i:
            self._last = i, self.file.get_batch(i)
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i."""
        batch = self.batch(i // self.rows)
        flat = batch.column("ids").values.to_numpy()
        a = i % self.rows * self.length
        return flat[a : a + self.length], batch.column("mask")[i % self.rows].values

    def ids(self, at: int, n: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Ids at to at + n in views, a batch at a time, and their ends."""
        size = self.rows * self.length
        while n > 0:
            batch, a = self.batch(at // size), at % size
            take = min(n, size - a)
            yield batch.column("ids").values.to_numpy()[a : a + take], batch.column("ends").values.slice(a, take)
            at, n = at + take, n - take


INDEX = "shard long, file string, at long, n_tokens long"


def write(docs: DataFrame, path: str, rules: TokenRules = TokenRules(), name: str = "doc_id") -> DataFrame:
    """Writes docs, in ascending order of the column name, as shards under path and their index as path/index; returns the index.

    The index has name and INDEX's columns, a row per document. Null texts are empty: the end id alone.
    Null names come first; rows that repeat a name are ordered by a hash of their text, and each is written.
    An empty table gives an empty index and no shard. Other columns are not looked at, whatever their names.
    """
    # A name that many rows share is dealt over tasks by what follows it in the order.
    keys = [F.col(name), F.xxhash64("text"), F.monotonically_increasing_id()]
    slim = docs.select(F.col(name).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"), *(k.alias(f"k{i}") for i, k in enumerate(keys[1:])))
    order = ["name", "k0", "k1"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "body")
    kind = docs.schema[name].dataType
    schema = T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(INDEX).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard = TaskContext.get(), None
        number = task.partitionId()
        uri = f"{path}/shards/{number:06d}-{task.taskAttemptId()}.arrow"
        encode = encoder(rules)
        end = np.array([rules.end_id], dtype=encode.dtype).tobytes()
        for batch in batches:
            if shard is None:
                shard = ShardWriter(uri, rules, encode.dtype)
            at, n = [], []
            bodies = batch.column(1)
            for a, b in _chunks(pa.compute.binary_length(bodies).to_pylist()):
                for ids in encode(bodies.slice(a, b - a).to_pylist()):
                    flat = np.frombuffer(ids + end, dtype=encode.dtype)
                    at.append(shard.add(flat))
                    n.append(len(flat))
            fixed = [pa.array([number] * len(n), pa.int64()), pa.array([uri] * len(n), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fixed], schema.names)
        if shard is not None:
            shard.close()

    index = ranged.mapInArrow(run, schema)
    index.write.mode("overwrite").parquet(f"{path}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{path}/index")


def _chunks(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes, a row at least."""
    start = base = 0
    for i, total in enumerate(accumulate(sizes)):
        if i > start and total - base > most:
            yield start, i
            start, base = i, total - sizes[i]
    if start < len(sizes):
        yield start, len(sizes)


def with_start(index: DataFrame) -> DataFrame:
    """The index with start: the ids of all documents before, over all shards. Sums pass one window, a row per shard."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return index.join(F.broadcast(bases), "shard").withColumn("start", F.col("_base") + F.col("at")).drop("_base")


def read(index: DataFrame, name: str = "doc_id") -> DataFrame:
    """(name, start, n_tokens, ids_crc32) of each document of the index, the checksum from the shards' ids as unsigned 32-bit little-endian integers.

    Fails where a shard's marks don't end the document where the index does.
    """
    slim = with_start(index).select(name, "start", "file", "at", "n_tokens")
    schema = T.StructType([index.schema[name], *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for batch in batches:
            sums = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if file != uri:
                    uri, shard = file, Shard(file)
                crc, ends, last = 0, 0, False
                for ids, marks in shard.ids(at, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                    ends, last = ends + marks.true_count, marks[-1].as_py()
                if ends != 1 or not last:
                    raise ValueError(f"{file}: the document at {at} has {ends} ends")
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], schema.names)

    return slim.mapInArrow(run, schema)


def digest(docs: DataFrame, rules: TokenRules = TokenRules()) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs, written to shards in the shared folder and read back."""
    return read(write(docs, Scratch(docs.sparkSession, "tokens").root, rules))
