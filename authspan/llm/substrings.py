"""Exact substring dedup: every byte covered by a string of min_bytes that also starts elsewhere.

Full suffix sorting of a corpus is out of reach, so the suffixes are those that start at an anchor.
An anchor is the GRAM-byte string with the smallest hash among those in a window of min_bytes; two
equal strings of min_bytes hold the same anchor at the same place, so no repeat is lost.

1. Tasks emit each anchor with the hash of all that a min_bytes string around it can reach and of its
   place in that, equal ones of a batch combined. Rows are dealt by gram; neighbours in (gram, context)
   order tell everything about most of them: equal contexts (128 bits, gram included) are repeats over
   their whole length, and a gram seen once is none. Grams that a sample shows to be very frequent are
   dealt by context as well, and count as differing.
2. What is left are contexts that share a gram but differ somewhere. Their bytes are fetched, and
   dealt by gram. There the repeats are found by threshold-bounded interval expansion: intervals of
   contexts with a common prefix after the anchor are refined breadth-first, by increasing prefix
   length, and extended backward by the bytes before it (the columns of a Burrows-Wheeler matrix of
   the anchored suffixes). An interval of one suffix is dropped at once, and extension stops where
   prefix and extension make min_bytes together.
   A group of over CROWD contexts is halved first: strings with at most h bytes before the gram share
   min_bytes - gram - h bytes after it, the others h + 1 bytes before it, so the halves are dealt by
   those bytes too. Contexts that agree in all that a half can reach are repeats, and one stands for
   those of a batch. Halving goes on while groups are that large; in the end a group is one string.
3. Intervals are gathered per document and cut out.

Texts are named by 128 bits of id and content, and so are groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import Scratch, row_key, split_join

MIN_BYTES = 200
#: Most contexts that are expanded together; a larger group is halved.
CROWD = 2_000
#: One text in so many is looked at for very frequent grams, and the share of a frequent one's rows.
ONE_IN, FREQUENT = 64, 1 / 16_384
#: Bytes of text handled at once; longer texts are handled in segments of that size.
SEGMENT = 2_000_000
#: Contexts expanded at once, about.
BATCH = 30_000

BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(20240101).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a buffer, from sums over its prefixes."""

    _powers: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: np.uint64, n: int) -> np.ndarray:
        held = cls._powers.get(int(base))
        if held is None or len(held) < n:
            held = np.full(max(n, SEGMENT + 4096), base, dtype=np.uint64)
            held[0] = 1
            np.multiply.accumulate(held, out=held)
            cls._powers[int(base)] = held
        return held

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTES[buf] * self.powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = self.powers(INVERSE, n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        return _finish((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """For the texts buf[starts:ends], (gram hash, context hash, text, place, bytes before, bytes from) of each anchor."""
    gram = least // 2
    if len(buf) < least:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    hasher = Hasher(buf)
    g = hasher.grams(gram)
    low = np.uint64(0xFFFFFFFF)
    best = _window_min((g & ~low) | np.arange(len(g), dtype=np.uint64), least - gram + 1)
    # only windows within one text: others would make its anchors depend on the next text
    whole = ends - starts >= least
    turns = np.bincount(starts[whole], minlength=len(buf) + 1) - np.bincount(ends[whole] - least + 1, minlength=len(buf) + 1)
    best = best[np.cumsum(turns)[: len(best)] > 0]
    if not len(best):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    best = best[np.concatenate(([True], best[1:] != best[:-1]))]
    place = np.unique((best & low).astype(np.int64))
    text = np.searchsorted(starts, place, side="right") - 1
    inside = (place + gram <= ends[text]) & (ends[text] - starts[text] >= least)
    place, text = place[inside], text[inside]
    left = np.maximum(starts[text], place - (least - gram))
    right = np.minimum(ends[text], place + least)
    # with the bytes before, two places of one occurrence, clipped at both ends, never compare equal
    context = _finish(hasher.at(left, right) ^ ((place - left).astype(np.uint64) * BASE))
    return g[place], context, text, place - starts[text], place - left, right - place


def _text_batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > SEGMENT:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _pack(place: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (place.astype(np.int64) << 28) | (before.astype(np.int64) << 14) | size.astype(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 28, (packed >> 14) & 0x3FFF, packed & 0x3FFF


#: What an anchor's row is: seen once in its batch; one of several with that context, which stands
#: for them from here on; and one of several, whose repeat is settled. WIDE: of a frequent gram.
ONCE, STANDS, SETTLED, WIDE = 0, 1, 2, 4
ANCHORS = "gram long, part long, context long, k1 long, k2 long, packed long, kind long"


def _combined(gram: np.ndarray, context: np.ndarray, k1: np.ndarray, k2: np.ndarray, packed: np.ndarray, frequent: np.ndarray) -> pa.RecordBatch:
    """A batch's anchors, combined before the shuffle: equal contexts in it are repeats already, so they
    are dealt anywhere, and one row stands for them in their gram. A common passage costs its gram a
    row a batch."""
    with np.errstate(over="ignore"):
        _, first, of, n = np.unique(gram ^ (context * BASE), return_index=True, return_inverse=True, return_counts=True)
        several = n[of] > 1
        anywhere = _finish(k1.view(np.uint64) * BASE ^ packed.view(np.uint64))
    wide = np.isin(gram, frequent)
    part = np.where(wide & ~several, context, 0).view(np.int64)
    kind = np.where(several, SETTLED, np.where(wide, WIDE + ONCE, ONCE))
    stands = first[n > 1]
    cells = (np.where(several, anywhere, gram).view(np.int64), part, context.view(np.int64), k1, k2, packed, kind)
    more = (gram[stands].view(np.int64), np.where(wide, context, 0)[stands].view(np.int64), context[stands].view(np.int64), k1[stands], k2[stands], packed[stands], np.where(wide, WIDE + STANDS, STANDS)[stands])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(cells, more, strict=True)], [x.split()[0] for x in ANCHORS.split(", ")])


def _emit_anchors(least: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for a, b in _text_batches(texts):
                parts = []
                if b - a == 1 and len(texts[a]) > SEGMENT:
                    whole = np.frombuffer(texts[a], dtype=np.uint8)
                    for s in range(0, len(whole), SEGMENT):
                        lo, hi = max(0, s - least), min(len(whole), s + SEGMENT + least)
                        g, c, t, p, before, size = anchors(whole[lo:hi], np.array([0]), np.array([hi - lo]), least)
                        own = (p + lo >= s) & (p + lo < s + SEGMENT)  # each place belongs to one segment
                        parts.append((g[own], c[own], t[own] + a, p[own] + lo, before[own], size[own]))
                else:
                    sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
                    ends = np.cumsum(sizes)
                    g, c, t, p, before, size = anchors(np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8), ends - sizes, ends, least)
                    parts.append((g, c, t + a, p, before, size))
                g, c, t, p, before, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                if len(g):
                    yield _combined(g, c, k1[t], k2[t], _pack(p, before, size), frequent)

    return run


def _judge_anchors(least: int):
    """Rows in (gram, part, context) order. open: the context differs from another one of its gram.

    Keeps rows of repeated contexts (open false), and contexts to expand (open true): those seen
    once in a gram that has others, and the first and last row of repeated ones beside others. A row
    needs its neighbours only, so no gram is held.
    """

    def rows(x: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        ext = np.concatenate([y for y in (before, x, after) if y is not None], axis=1)
        gram = ext[0, 1:] == ext[0, :-1]
        same = gram & (ext[2, 1:] == ext[2, :-1])
        gram, same = np.concatenate(([False], gram, [False])), np.concatenate(([False], same, [False]))
        at = np.arange(x.shape[1]) + (before is not None)
        gp, gn, sp, sn = gram[at], gram[at + 1], same[at], same[at + 1]
        reaches = (x[5] >> 14 & 0x3FFF) + (x[5] & 0x3FFF) >= least
        kind, wide = x[6] & ~WIDE, (x[6] & WIDE) > 0
        settled = kind == SETTLED
        copies = settled | ((kind == ONCE) & (sp | sn))
        edge = (gp & ~sp) | (gn & ~sn)
        # of a frequent gram, others are elsewhere; the first row of equal ones stands for them
        differs = np.where(wide, ~sp, edge) & ~settled
        for mask, flag in ((copies & reaches, False), (differs & reaches, True)):
            if mask.any():
                part = x[:, mask]
                yield pa.RecordBatch.from_arrays([*(pa.array(part[i]) for i in (0, 3, 4, 5)), pa.array(np.full(part.shape[1], flag))], ["gram", "k1", "k2", "packed", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held is not None:
                yield from rows(held, last, x[:, :1])
                last = held[:, -1:]
            held = x
        if held is not None:
            yield from rows(held, last, None)

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for shuffles."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], batch.schema.names)


CONTEXTS = "g1 long, g2 long, lo int, hi int, k1 long, k2 long, packed long, before binary, after binary"
NAMES = [x.split()[0] for x in CONTEXTS.split(", ")]


def _fetch(least: int):
    gram = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k1, k2, blob, wanted in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3), strict=True):
                text = press.decompress(blob)
                packed = wanted.values.field("packed")
                place, before, size = _unpack(packed.to_numpy())
                left = [text[p - b : p][::-1] for p, b in zip(place.tolist(), before.tolist(), strict=True)]
                right = [text[p + gram : p + s] for p, s in zip(place.tolist(), size.tolist(), strict=True)]
                other = np.array([xxhash.xxh3_64_intdigest(text[p : p + gram]) for p in place.tolist()], dtype=np.uint64).view(np.int64)
                n, small = len(left), pa.int32()
                keys = (pa.array(np.full(n, k)) for k in (k1, k2))
                yield pa.RecordBatch.from_arrays(
                    [wanted.values.field("gram"), pa.array(other), pa.array(np.zeros(n), small), pa.array(np.full(n, least - gram), small), *keys, packed, pa.array(left, pa.binary()), pa.array(right, pa.binary())], NAMES
                )

    return run


def _halve(least: int):
    """Contexts of strings with lo to hi bytes before the gram, into those of either half; and settled ones.

    The bytes that all strings of a half share name its group. Contexts of a batch that agree in every
    byte that a half's strings can reach are repeats: they are settled (start and size are given), and
    the first goes on for them.
    """
    room = least - least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[tuple]] = {}
            for g1, g2, lo, hi, k1, k2, packed, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if len(before) >= a and len(after) >= room - b:
                        name = xxhash.xxh3_128_digest(b"%d %d %d " % (g1, g2, a) + before[:a] + b"|" + after[: room - b])
                        near, far = before[:b], after[: room - a]
                        groups.setdefault((name, a, b, near, far), []).append((k1, k2, packed))
            out: list[tuple] = []
            for (name, a, b, near, far), rows in groups.items():
                n1, n2 = (int.from_bytes(name[i : i + 8], "little", signed=True) for i in (0, 8))
                if len(rows) > 1:
                    # strings at either end may lack bytes where a text ends
                    first, last = max(a, room - len(far)), min(b, len(near))
                    if first <= last:
                        out += [(n1, n2, a, b, *row, None, None, int(_unpack(np.int64(row[2]))[0]) - last, least + last - first) for row in rows]
                out.append((n1, n2, a, b, *rows[0], near, far, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], [*NAMES, "start", "size"])

    return run


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _grid(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(offsets).astype(np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros((len(column), width), dtype=np.uint8)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _extend(interval: np.ndarray, column: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Intervals split by one more byte; -1 where the byte is missing or the interval has one suffix."""
    out = np.full(len(interval), -1, dtype=np.int64)
    live = np.flatnonzero((interval >= 0) & present)
    if len(live):
        _, of, n = np.unique((interval[live] << 8) | column[live], return_inverse=True, return_counts=True)
        out[live] = np.where(n[of] > 1, of, -1)
    return out


def expand(group: np.ndarray, before: pa.Array, after: pa.Array, lo: int, hi: int, room: int) -> list[tuple[np.ndarray, int]]:
    """For t = lo..hi, the contexts whose string of t bytes before the gram, the gram, and room - t bytes after is
    repeated. Contexts of a group (named by number) agree in the first lo bytes before and room - hi after."""
    left, left_size = _grid(before, max(hi, 1))
    right, right_size = _grid(after, max(room - lo, 1))
    _, start, n = np.unique(group, return_inverse=True, return_counts=True)
    start = np.where(n[start] > 1, start, -1).astype(np.int64)
    prefixes = [np.where(right_size >= room - hi, start, -1)]  # by increasing common prefix
    for i in range(room - hi, room - lo):
        prefixes.append(_extend(prefixes[-1], right[:, i], right_size > i))
    found, back = [], np.where(left_size >= lo, start, -1)
    for t in range(lo, hi + 1):
        if t > lo:
            back = _extend(back, left[:, t - 1], left_size >= t)
        ahead = prefixes[hi - t]
        live = np.flatnonzero((back >= 0) & (ahead >= 0))
        if len(live):
            _, of, n = np.unique((back[live] << 32) | ahead[live], return_inverse=True, return_counts=True)
            live = live[n[of] > 1]
        if len(live):
            found.append((live, t))
    return found


def _expand_groups(least: int):
    """Contexts in (lo, hi, g1, g2) order to spans."""
    room = least - least // 2

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi = (table[c].to_numpy() for c in ("lo", "hi"))
        edges = [0, *(np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), len(lo)]
        for a, b in zip(edges, edges[1:]):
            yield from same_reach(table.slice(a, b - a).combine_chunks(), int(lo[a]), int(hi[a]))

    def same_reach(table: pa.Table, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        column = lambda c: table[c].combine_chunks()
        place, _, _ = _unpack(column("packed").to_numpy())
        k1, k2, g1, g2 = (column(c).to_numpy() for c in ("k1", "k2", "g1", "g2"))
        group = np.cumsum(np.concatenate(([0], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))))
        found = expand(group, column("before"), column("after"), lo, hi, room)
        if not found:
            return
        row, t = np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), t) for x, t in found])
        by = np.lexsort((t, row))
        row, t = row[by], t[by]
        opens = np.ones(len(row), dtype=bool)
        opens[1:] = (row[1:] != row[:-1]) | (t[1:] != t[:-1] + 1)
        closes = np.ones(len(row), dtype=bool)
        closes[:-1] = opens[1:]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        own = row[first]
        start, end = place[own] - t[last], place[own] - t[first] + least
        yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(start), pa.array(end - start)], ["k1", "k2", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= BATCH:
                table = pa.concat_tables(held).combine_chunks()
                now = [table[c].to_numpy() for c in ("lo", "hi", "g1", "g2")]
                differs = np.flatnonzero(np.any([x != x[-1] for x in now], axis=0))
                cut = int(differs[-1]) + 1 if len(differs) else 0  # the last group may go on
                if cut:
                    yield from spans(table.slice(0, cut).combine_chunks())
                held, n = [table.slice(cut)], table.num_rows - cut
        if n:
            yield from spans(pa.concat_tables(held).combine_chunks())

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        removed, spans, kept = [], [], []
        for blob, cuts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = press.decompress(blob)
            if not cuts.is_valid or not len(cuts.values):
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            packed = np.sort(cuts.values.to_numpy())
            start, end = packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF)
            reach = np.maximum.accumulate(end)
            first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
            a, b = start[first], reach[np.append(first[1:], len(start)) - 1]
            removed.append(int((b - a).sum()))
            spans.append(len(first))
            edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _frequent(named: DataFrame, least: int, scratch: Scratch) -> np.ndarray:
    """Grams with a large share of the anchors of one text in ONE_IN: fewer than 1 / FREQUENT. They only
    change how rows are dealt, not what is found."""
    some = named.where(F.pmod("k2", F.lit(ONE_IN)) == 0).select("k1", "k2", "text")
    per = some.mapInArrow(_emit_anchors(least, np.zeros(0, dtype=np.uint64)), ANCHORS).where(F.col("kind") != SETTLED).groupBy("gram").count()
    per = scratch.save(per, "sampled")
    total = per.agg(F.sum("count")).first()[0] or 0  # one number
    found = per.where((F.col("count") > 16) & (F.col("count") > total * FREQUENT)).select("gram").toArrow()
    return found["gram"].to_numpy().astype(np.int64).view(np.uint64)


def _bounded(contexts: DataFrame, least: int, crowd: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """contexts in groups of at most crowd, and the spans (k1, k2, start, size) settled on the way there."""
    by, k = ["g1", "g2", "lo"], 0
    done = spans = None
    contexts = scratch.save(contexts, "contexts0")
    while True:
        sizes = scratch.save(contexts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), f"crowds{k}")
        if sizes.where(F.col("n") > crowd).isEmpty():
            return contexts if done is None else done.unionAll(contexts), spans
        each = scratch.save(split_join(contexts, sizes.withColumn("rows", F.col("n")), by, "rows"), f"sized{k}")
        rest = each.where(F.col("n") <= crowd).select(*NAMES)
        done = rest if done is None else done.unionAll(rest)
        large = each.where(F.col("n") > crowd)
        # a group of strings of one reach is one string
        equal = large.where("lo = hi").select("k1", "k2", (F.shiftright("packed", 28) - F.col("lo")).alias("start"), F.lit(least).cast("long").alias("size"))
        k += 1
        halves = scratch.save(large.where("lo < hi").select(*NAMES).mapInArrow(_halve(least), f"{CONTEXTS}, start long, size long"), f"halves{k}")
        settled = equal.unionAll(halves.where("start is not null").select("k1", "k2", "start", "size"))
        spans = settled if spans is None else spans.unionAll(settled)
        contexts = halves.where("start is null").select(*NAMES)


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary) for each row of docs (doc_id, text).

    Removed is each byte of the text's UTF-8 that is covered by a string of min_bytes (2 to 5000)
    bytes that also starts anywhere else, in this row or another; strings never cross rows and are
    judged on the input. n_spans: maximal removed runs. kept: the remaining bytes, joined; a cut may
    fall inside a character. crowd: see CROWD; results don't depend on it.
    Null text: empty. Texts shorter than min_bytes keep everything. Repeated rows are documents of
    their own, so they are each other's copies. Null or repeated doc_ids are allowed. Long texts are
    handled whole. Other columns are ignored.
    """
    if not 2 <= min_bytes <= 5000:
        raise ValueError("min_bytes must lie in 2..5000")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    named = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("key", row_key("doc_id", "text"))
    # rows with equal keys have equal texts, and are cut alike
    named = named.select("doc_id", F.col("key.a").alias("k1"), F.col("key.b").alias("k2"), "text")

    wide = named.where(F.octet_length("text") >= min_bytes)
    emitted = wide.select("k1", "k2", "text").mapInArrow(_emit_anchors(min_bytes, _frequent(wide, min_bytes, scratch)), ANCHORS)
    dealt = emitted.repartition(n, "gram", "part").sortWithinPartitions("gram", "part", "context")
    judged = scratch.save(dealt.mapInArrow(_judge_anchors(min_bytes), "gram long, k1 long, k2 long, packed long, open boolean"), "judged")
    place, before, size = F.shiftright("packed", 28), F.shiftright("packed", 14).bitwiseAND(F.lit(0x3FFF)), F.col("packed").bitwiseAND(F.lit(0x3FFF))
    span = lambda start, width: (F.shiftleft(start, 32) + width).alias("span")
    spans = judged.where("not open").select("k1", "k2", span(place - before, before + size))

    wanted = judged.where("open").select("gram", "k1", "k2", "packed").distinct()
    squeezed = named.select("k1", "k2", "text").mapInArrow(_squeeze, "k1 long, k2 long, text binary")
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "packed")).alias("wanted"))
    contexts, settled = _bounded(squeezed.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_fetch(min_bytes), CONTEXTS), min_bytes, crowd, scratch)
    found = contexts.repartition(n, "g1", "g2", "lo").sortWithinPartitions("lo", "hi", "g1", "g2").mapInArrow(_expand_groups(min_bytes), "k1 long, k2 long, start long, size long")
    found = found if settled is None else found.unionAll(settled)
    spans = spans.unionAll(found.select("k1", "k2", span(F.col("start"), F.col("size"))))
    cuts = spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("cuts"))  # one text's anchors at most
    whole = named.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(_squeeze, "doc_id long, k1 long, k2 long, n_bytes long, text binary")
    joined = whole.join(cuts, ["k1", "k2"], "left").select("doc_id", "text", "cuts", "n_bytes")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """dedup() with the SHA-256 of what is kept instead of the bytes."""
    return dedup(docs, min_bytes).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
