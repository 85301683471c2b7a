"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice; lossless decoding.

No piece crosses the start of a run of spaces or a newline, so a text's lattice falls apart into
segments there. A batch filters each distinct segment once, with array operations over all of
them, and then samples every occurrence from its end back. A draw depends on the row's key, the seed
and the place in the text alone, so results don't depend on partitions or batches.

Spaces are written as U+2581 and one is put before the text, as the model expects. A U+2581 of the
text itself, and any character without a piece, becomes its UTF-8 bytes. So decoding gives every
text back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for a U+2581 of the text; no piece has it.
LITERAL = 0x110000
#: Code points handled at once; a longer text is handled alone.
CHUNK = 2_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SampleRules:
    model: str = MODEL
    #: A piece's log-probability is times alpha; 0 makes all segmentations alike, large ones pick the best.
    alpha: float = 0.3
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64, on wrapping 64-bit integers."""
    x = x.astype(np.uint64) + MULT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """Hashes of the pieces of one length, with direct places in a few small levels."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, log_p: np.ndarray):
        self.ids, self.log_p = ids, log_p
        self.keys = np.append(keys, np.uint64(0))
        self.levels = []
        left, shift = np.arange(len(keys)), 48
        while len(left):
            level = np.full(1 << 16, len(keys), dtype=np.int32)
            place = self._place(keys[left], shift)
            level[place] = left  # of several in one place the last stays
            self.levels.append((shift, level))
            left, shift = left[level[place] != left], (shift - 5) % 48
        self.none = len(keys)

    @staticmethod
    def _place(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are pieces, their slots)."""
        where, slots, left = [], [], np.arange(len(h))
        for shift, level in self.levels:
            slot = level[self._place(h[left], shift)]
            hit = (self.keys[slot] == h[left]) & (slot != self.none)
            where.append(left[hit])
            slots.append(slot[hit])
            left = left[~hit]
        return np.concatenate(where), np.concatenate(slots)


class Vocabulary:
    """Pieces of a model by length and hash, their log-weights, and every id's bytes."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        scores = np.array([sp.get_score(i) for i in normal])
        if np.all((scores <= 0) & ((scores == np.round(scores)) | (scores < -1e8))):  # a merge model: its scores are ranks
            ranks = np.minimum(-scores, n)
            log_p = -np.log(ranks + 2.0)
            log_p -= np.log(np.exp(log_p).sum())
        else:
            log_p = scores
        self.rare = float(log_p.min())
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        for i, p in zip(normal, log_p, strict=True):
            cps = np.frombuffer(text[i].encode("utf-32-le"), dtype=np.uint32)
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _mix(cps):
                    h = h * MULT + c
            by_length.setdefault(len(cps), []).append((int(h), i, float(p)))
        self.tables = {}
        for k, rows in by_length.items():
            rows.sort()
            self.tables[k] = Table(*(np.array(x, dtype=kind) for x, kind in zip(zip(*rows, strict=True), (np.uint64, np.int32, np.float64), strict=True)))
        self.longest = max(self.tables)
        self.byte_id = np.zeros(256, dtype=np.int32)
        blob = []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                blob.append(bytes([b]))
            else:
                blob.append(text[i].replace("▁", " ").encode() if i in text else b"")
        self.lengths = np.array([len(b) for b in blob], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def _segments(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where segments start: at texts, at spaces after others, and on both sides of a newline."""
    cut = np.zeros(len(cps), dtype=bool)
    cut[starts] = True
    space, line = cps == SPACE, cps == 10
    cut[1:] |= space[1:] & ~space[:-1]
    cut |= line
    cut[1:] |= line[:-1]
    return np.flatnonzero(cut)


def _distinct(cps: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a segment for each distinct content, the number of that content for each segment)."""
    place = np.arange(len(cps)) - np.repeat(at, size)
    powers = np.ones(int(size.max()), dtype=np.uint64)
    np.multiply.accumulate(np.concatenate((powers[:1], np.full(len(powers) - 1, MULT))), out=powers)
    h = np.add.reduceat((_mix(cps) | np.uint64(1)) * powers[place], at) + size.astype(np.uint64)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    same = cps == cps[np.repeat(at[first[of]], size) + np.minimum(place, np.repeat(size[first[of]] - 1, size))]
    wrong = np.flatnonzero(~np.logical_and.reduceat(same, at) | (size != size[first[of]]))
    if len(wrong):  # equal hashes of other contents: each of these is handled on its own
        of[wrong] = len(first) + np.arange(len(wrong))
        first = np.concatenate((first, wrong))
    return first, of


def _filtered(vocab: Vocabulary, alpha: float, grid: np.ndarray, size: np.ndarray):
    """For segments (rows of grid, padded): per node (row, end) the pieces that may end there.

    Gives arrays row, end, length, id (-1: bytes) and chance of each choice; chances of a node sum to 1.
    """
    n, width = grid.shape
    deepest = min(vocab.longest, width)
    mixed = _mix(grid)
    score = np.full((deepest + 1, width + 1, n), -np.inf)
    h = np.zeros((n, width), dtype=np.uint64)
    ok = np.arange(width)[None, :] < size[:, None]
    found = []
    for k in range(1, deepest + 1):
        h = h[:, : width - k + 1] * MULT + mixed[:, k - 1 :]
        if k not in vocab.tables:
            continue
        table = vocab.tables[k]
        row, col = np.nonzero(ok[:, k - 1 :])
        hit, slot = table.find(h[row, col])
        row, end = row[hit], col[hit] + k
        score[k, end, row] = alpha * table.log_p[slot]
        found.append((row, end, np.full(len(row), k), table.ids[slot]))
    row, col = np.nonzero(ok & np.isneginf(score[1, 1:].T))
    score[1, col + 1, row] = alpha * 4 * vocab.rare
    found.append((row, col + 1, np.ones(len(row), dtype=np.int64), np.full(len(row), -1, dtype=np.int32)))
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0.0
    for e in range(1, width + 1):
        k = np.arange(1, min(deepest, e) + 1)
        term = score[k, e] + forward[e - k]
        score[k, e] = term
        top = term.max(axis=0)
        top[np.isneginf(top)] = 0.0
        with np.errstate(divide="ignore"):
            forward[e] = np.log(np.exp(term - top).sum(axis=0)) + top
    row, end, k, ids = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
    return row, end, k, ids, np.exp(score[k, end, row] - forward[end, row])


def _choices(vocab: Vocabulary, alpha: float, cps: np.ndarray, at: np.ndarray, size: np.ndarray):
    """All distinct segments' choices as one flat list by node, likely ones first; node = base[segment] + end.

    Gives base, where each node's choices start, and the choices' running chance, length and id.
    """
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    parts, order, done = [], np.argsort(size, kind="stable"), 0
    while done < len(order):
        width = int(size[order[done]])
        limit = max(8, 1 << (width - 1).bit_length())
        to = int(np.searchsorted(size[order], limit, side="right"))
        to = min(to, done + max(1, 400_000 // limit))
        rows = order[done:to]
        limit = int(size[rows].max())
        grid = np.zeros((len(rows), limit), dtype=np.uint32)
        col = np.arange(limit)[None, :] + np.zeros((len(rows), 1), dtype=np.int64)
        inside = col < size[rows][:, None]
        grid[inside] = cps[(at[rows][:, None] + col)[inside]]
        r, e, k, ids, chance = _filtered(vocab, alpha, grid, size[rows])
        parts.append((base[rows[r]] + e, k, ids, chance))
        done = to
    node, k, ids, chance = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(node, kind="stable")
    node, k, ids, chance = node[by], k[by], ids[by], chance[by]
    total = np.cumsum(chance)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    before = np.concatenate(([0.0], total[first[1:] - 1]))
    share = total - np.repeat(before, np.diff(np.append(first, len(node))))
    share[np.append(first[1:], len(node)) - 1] = 2.0  # a draw is below 1
    opens = np.zeros(int(base[-1] + size[-1]) + 1, dtype=np.int64)
    opens[node[first]] = first
    return base, opens, share, k, ids


def encode_texts(texts: list[str], keys: np.ndarray, rules: SampleRules) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    vocab = vocabulary(rules.model)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    cps = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    cps[cps == SPACE] = LITERAL
    cps[cps == 32] = SPACE
    ends = np.cumsum(sizes)
    full = sizes > 0
    at = _segments(cps, (ends - sizes)[full])
    size = np.diff(np.append(at, len(cps)))
    first, of = _distinct(cps, at, size)
    base, opens, share, length, ids = _choices(vocab, rules.alpha, cps, at[first], size[first])
    text = np.searchsorted(ends, at, side="right")
    stream = _mix(keys[text].astype(np.uint64) ^ _mix(np.array([rules.seed], dtype=np.uint64)))
    origin = (ends - sizes)[text]
    ended = np.full(len(cps), -2, dtype=np.int32)
    live = np.arange(len(at))
    end = size.copy()
    while len(live):
        place = (at[live] + end - origin[live]).astype(np.uint64)
        u = (_mix(stream[live] + place * MULT) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        pick = opens[base[of[live]] + end]
        over = np.flatnonzero(u >= share[pick])
        while len(over):
            pick[over] += 1
            over = over[u[over] >= share[pick[over]]]
        ended[at[live] + end - 1] = ids[pick]
        end = end - length[pick]
        live, end = live[end > 0], end[end > 0]
    place = np.flatnonzero(ended != -2)
    out = ended[place]
    count = np.ones(len(out), dtype=np.int64)
    lone = np.flatnonzero(out == -1)
    spelled = [(chr(c) if c != LITERAL else "▁").encode("utf-8", "surrogatepass") for c in cps[place[lone]].tolist()]
    count[lone] = [len(b) for b in spelled]
    per_text = np.add.reduceat(count, np.searchsorted(place, (ends - sizes)[full]))
    flat = np.repeat(out, count)
    flat[flat == -1] = vocab.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[full] = per_text
    return flat, counts


def decode_ids(ids: np.ndarray, counts: np.ndarray, model: str = MODEL) -> list[str]:
    """The texts of consecutive runs of ids."""
    vocab = vocabulary(model)
    size = vocab.lengths[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    raw = vocab.blob[np.repeat(vocab.offsets[ids] - (end - size), size) + np.arange(total)].tobytes()
    stops = np.concatenate(([0], end))[np.cumsum(counts)]
    starts = np.concatenate(([0], stops[:-1]))
    return [raw[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK in size."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _rest(df: DataFrame, *names: str) -> Column:
    """The other columns as one struct, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return F.struct(*(others or [F.lit(0).alias("nothing")])).alias("_row")


def _restored(out: DataFrame, columns: list[str], **own: str) -> list[Column]:
    """Columns by name, from those of out where own says so, else from _row."""
    return [F.col(own[c]).alias(c) if c in own else F.col("_row").getField(c).alias(c) for c in columns]


def _encoded(part: pa.RecordBatch, rules: SampleRules) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Ids of a batch of (row, key, text), as lists, flat, and how many each text has."""
    held = part.column(2)
    keys = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):
        ids, counts = encode_texts(["" if t is None else t for t in held.to_pylist()], keys, rules)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(np.array(held.is_null()), False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), ids, counts


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, rules: SampleRules = SampleRules(), into: str = "piece_ids") -> DataFrame:
    """docs with the column into (array<int>): a sampled segmentation of text, seeded by doc_id.

    Null text: null. Empty text: no ids. Rows that repeat a doc_id and text get equal ids. Very long
    texts are encoded whole. An existing column of into's name is replaced; all others pass, whatever their names.
    """
    named = [c for c in docs.columns if c != into]
    keyed = docs.select(_rest(docs, "text", into), F.xxhash64("doc_id").alias("_key"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([keyed.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_ids", IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(pa.compute.fill_null(pa.compute.utf8_length(batch.column(2)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _encoded(part, rules)[0]], schema.names)

    out = keyed.mapInArrow(run, schema)
    return out.select(*_restored(out, named, text="_text"), F.col("_ids").alias(into))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """encoded with the column into (string), the text that the column ids spells; null for null.

    An existing column of into's name is replaced; all others pass, whatever their names.
    """
    named = [c for c in encoded.columns if c != into]
    keyed = encoded.select(_rest(encoded, ids, into), F.col(ids).alias("_ids"))
    schema = T.StructType([*keyed.schema, T.StructField("_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_pylist()
            for a, b in _runs(sizes):
                part = batch.slice(a, b - a)
                lists = part.column(1)
                texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), np.array(sizes[a:b], dtype=np.int64), model)
                texts = pa.array(texts, pa.string(), mask=np.array(lists.is_null()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], schema.names)

    out = keyed.mapInArrow(run, schema)
    return out.select(*_restored(out, named, **{ids: "_ids"}), F.col("_decoded").alias(into))


def segmented(docs: DataFrame, rules: SampleRules = SampleRules()) -> DataFrame:
    """docs with text as decoded from its sampled ids, and these ids as a last column: piece_ids, or where docs
    has a column of that name, which stays, the name with underscores until it is new. Texts pass one worker once."""
    name = next(n for k in range(len(docs.columns) + 1) if (n := "piece_ids" + "_" * k) not in docs.columns)
    keyed = docs.select(_rest(docs, "text"), F.xxhash64("doc_id").alias("_key"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([keyed.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_ids", IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(pa.compute.fill_null(pa.compute.utf8_length(batch.column(2)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                lists, ids, counts = _encoded(part, rules)
                texts = pa.array(decode_ids(ids, counts, rules.model), pa.string(), mask=np.array(part.column(2).is_null()))
                yield pa.RecordBatch.from_arrays([part.column(0), texts, lists], schema.names)

    out = keyed.mapInArrow(run, schema)
    return out.select(*_restored(out, docs.columns, text="_text"), F.col("_ids").alias(name))


def digest(docs: DataFrame, rules: SampleRules = SampleRules()) -> DataFrame:
    """(doc_id, n_pieces, ids_hash, decoded_sha256, lossless) for each row of docs (null text: empty)."""
    sha = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    slim = docs.select("doc_id", F.col("text").cast("string"), sha("text").alias("sha"))
    ids = encode(slim, rules).drop("text")
    out = decode(ids, rules.model)
    n = F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long")
    return out.select("doc_id", F.greatest(n, F.lit(0)).alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), sha("decoded").alias("decoded_sha256"), (sha("decoded") == F.col("sha")).alias("lossless"))
