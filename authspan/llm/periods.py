"""Runs of words that repeat with a period, found on a grammar of the texts, and their collapse to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring
word extends; it counts from RunRules.least words and RunRules.times periods.

Texts are taken by the batch. Re-Pair replaces pairs of neighbouring symbols that occur twice or more by
nonterminals, the more frequent before the less where they overlap, round by round; what is left is paired
evenly until a text is one symbol. The shortest nonterminal over a whole run derives it across the boundary of
its two sides, so it is enough to find, once for each nonterminal, the runs that cross its boundary, and to
translate them to all places where it occurs. In a nonterminal that ends inside a run, a part of the run is
found; parts are dropped as they lie inside the whole.

Of a run across a boundary, at least one side has half its words. Hence RunRules.gram words at the boundary
occur again one period further (or earlier): other occurrences of these words inside the nonterminal are the
only periods to try, the smallest first, and those within a run found that are multiples of its period are
settled by it. Each try extends the match word by word, so equality is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RunRules:
    least: int = 24  # words of a run
    times: int = 3  # periods of a run, 3 or more
    chunk: int = 1 << 21  # bytes of texts whose grammar is made together

    @property
    def gram(self) -> int:
        """Words at a boundary that every run across it repeats a period away on one side."""
        return self.least // 2 - self.least // self.times


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges starts to starts + counts, one after the other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - before[owner] + starts[owner]


def _scatter(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grammar:
    """Occurrences of all nonterminals of at least `least` words: number, place, words of the left side, words."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, least: int):
        self.least = least
        self.found: list[tuple[np.ndarray, ...]] = []
        self.sym = words.astype(np.int64)
        self.next = int(self.sym.max(initial=-1)) + 1
        self.pos = np.arange(len(words))
        self.size = np.ones(len(words), dtype=np.int64)
        self.last = np.zeros(len(words), dtype=bool)  # nothing of its text follows
        self.last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
        self._codes, self._names = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._repair()
        self._finish()
        none = (np.zeros(0, dtype=np.int64),) * 4
        self.names, self.places, self.lefts, self.sizes = (np.concatenate(v) for v in zip(*self.found, none, strict=True))

    def _replace(self, left: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Replaces the pairs at left by names; returns which symbols stay."""
        whole = self.size[left] + self.size[left + 1]
        long = whole >= self.least
        self.found.append((names[long], self.pos[left[long]], self.size[left[long]], whole[long]))
        self.sym[left], self.size[left], self.last[left] = names, whole, self.last[left + 1]
        stays = np.ones(len(self.sym), dtype=bool)
        stays[left + 1] = False
        self.sym, self.pos, self.size, self.last = (x[stays] for x in (self.sym, self.pos, self.size, self.last))
        return stays

    def _named(self, codes: np.ndarray) -> np.ndarray:
        """Nonterminals of distinct ascending pairs, new ones where a pair is new."""
        at = np.searchsorted(self._codes, codes)
        known = np.zeros(len(codes), dtype=bool)
        inside = at < len(self._codes)
        known[inside] = self._codes[at[inside]] == codes[inside]
        names = np.empty(len(codes), dtype=np.int64)
        names[known] = self._names[at[known]]
        fresh = np.count_nonzero(~known)
        names[~known] = np.arange(self.next, self.next + fresh)
        self.next += fresh
        self._codes = np.insert(self._codes, at[~known], codes[~known])
        self._names = np.insert(self._names, at[~known], names[~known])
        return names

    def _repair(self) -> None:
        live = ~self.last  # the pair that begins here may occur twice
        while True:
            at = np.flatnonzero(live)
            if not len(at):
                return
            codes = self.sym[at] << 32 | self.sym[at + 1]
            distinct, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
            # Frequent pairs first; a scattered order among equals lets many be replaced in a round.
            turn = np.empty(len(distinct), dtype=np.int64)
            turn[np.lexsort((_scatter(distinct), counts))] = np.arange(len(distinct))
            rank = np.full(len(self.sym) + 2, -1, dtype=np.int64)  # shifted by one: a neighbour on either side
            again = counts[which] > 1
            rank[at[again] + 1] = turn[which[again]]
            live = rank[1:-1] >= 0
            if not live.any():
                return
            # Stretches of one pair (a a a a): those higher than both neighbours give every second pair.
            begins = np.flatnonzero(live & (rank[1:-1] != rank[:-2]))
            stops = np.flatnonzero(live & (rank[1:-1] != rank[2:]))
            top = (rank[begins] < rank[begins + 1]) & (rank[stops + 2] < rank[stops + 1])
            left = ragged(np.zeros(np.count_nonzero(top), dtype=np.int64), (stops[top] - begins[top]) // 2 + 1)
            left = begins[top][left[0]] + 2 * left[1]
            chosen, of = np.unique(self.sym[left] << 32 | self.sym[left + 1], return_inverse=True)
            live[left] = True
            new = np.zeros(len(live), dtype=bool)
            new[left] = True
            stays = self._replace(left, self._named(chosen)[of])
            live, new = live[stays], new[stays]
            live[:-1] |= new[1:]
            live &= ~self.last

    def _finish(self) -> None:
        while not self.last.all():
            opens = np.flatnonzero(np.concatenate(([True], self.last[:-1])))
            text = np.cumsum(np.concatenate(([0], self.last[:-1].astype(np.int64))))
            left = np.flatnonzero(((np.arange(len(self.sym)) - opens[text]) % 2 == 0) & ~self.last)
            self._replace(left, np.arange(self.next, self.next + len(left)))
            self.next += len(left)


def common(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from i and from j on, or before i and j for step -1, are equal; at most limit."""
    out = np.zeros(len(i), dtype=np.int64)
    alive, width = np.flatnonzero(limit > 0), 4
    shift = 0 if step > 0 else -1
    while len(alive):
        on = []
        for part in np.array_split(alive, -(-len(alive) * width // (1 << 20))):
            k = out[part, None] + np.arange(width)
            inside = k < limit[part, None]
            k = np.minimum(k, limit[part, None] - 1)
            same = inside & (words[i[part, None] + shift + step * k] == words[j[part, None] + shift + step * k])
            more = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += more
            on.append(part[(more == width) & (out[part] < limit[part])])
        alive, width = np.concatenate(on), min(2 * width, 1 << 12)
    return out


def crossing(words: np.ndarray, place: np.ndarray, left: np.ndarray, size: np.ndarray, rules: RunRules) -> tuple[np.ndarray, ...]:
    """(owner, start from place, length, period) of the runs inside place to place + size at the boundary after left words."""
    n, g = len(words), rules.gram
    none = (np.zeros(0, dtype=np.int64),) * 4
    if n < g or not len(place):
        return none
    x = np.full(n - g + 1, 7, dtype=np.uint64)
    for k in range(g):
        x = _scatter(x + words[k : n - g + 1 + k].astype(np.uint64))
    _, gram = np.unique(x, return_inverse=True)
    spots = np.sort(gram << 32 | np.arange(len(gram)))
    stop, edge, most = place + size, place + left, size // rules.times
    owner, anchor, low, high = [], [], [], []
    for ahead in (True, False):
        at = edge if ahead else edge - g
        fits = np.flatnonzero((at >= place) & (at + g <= stop))
        at = at[fits]
        first = at + 1 if ahead else np.maximum(place[fits], at - most[fits])
        after = np.minimum(stop[fits] - g, at + most[fits]) + 1 if ahead else at
        key = gram[at] << 32
        a, b = np.searchsorted(spots, key | first), np.searchsorted(spots, key | np.maximum(after, first))
        some = b > a
        owner.append(fits[some])
        anchor.append(at[some])
        # Occurrences by distance: upwards from low, or, where behind, downwards from high.
        low.append(a[some] if ahead else b[some] - 1)
        high.append(b[some] - a[some])
    behind = np.repeat([1, -1], [len(o) for o in owner])
    owner, anchor, low, count = (np.concatenate(v) for v in (owner, anchor, low, high))
    best = np.zeros((3, len(owner)), dtype=np.int64)  # period, start and end of the longest run so far
    done, width, runs = 0, 1, []
    while len(todo := np.flatnonzero(count > done)):
        many = np.minimum(count[todo] - done, width)
        for group in np.split(todo, np.flatnonzero(np.diff(np.cumsum(many) >> 20)) + 1):
            who, nth = ragged(np.full(len(group), done), np.minimum(count[group] - done, width))
            who = group[who]
            other = spots[low[who] + behind[who] * nth] & 0xFFFFFFFF
            i, j = np.minimum(other, anchor[who]), np.maximum(other, anchor[who])
            q, (q0, s0, e0) = j - i, best[:, who]
            known = (q0 > 0) & (q % np.maximum(q0, 1) == 0) & (q + q0 <= e0 - s0) & (i >= s0) & (j < e0)
            who, i, j, q = (v[~known] for v in (who, i, j, q))
            of = owner[who]
            e = j + common(words, i, j, stop[of] - j, 1)
            s = i - common(words, i, j, i - place[of], -1)
            good = e - s >= np.maximum(rules.least, rules.times * q)
            who, s, e, q, of = (v[good] for v in (who, s, e, q, of))
            runs.append((of, s - place[of], e - s, q))
            up = np.lexsort((-q, e - s))  # the longest is written last
            up = up[(e - s)[up] > (best[2] - best[1])[who[up]]]
            best[:, who[up]] = q[up], s[up], e[up]
        done, width = done + width, 2 * width
    if not runs:
        return none
    found = tuple(np.concatenate(v) for v in zip(*runs, strict=True))
    order = np.lexsort((found[3], found[2], found[1], found[0]))
    found = tuple(v[order] for v in found)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([v[1:] != v[:-1] for v in found[:3]], axis=0)  # the smallest period of a stretch
    return tuple(v[new] for v in found)


def runs_of(words: np.ndarray, ends: np.ndarray, rules: RunRules = RunRules()) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts of words that end at ends, by text, start and period."""
    g = Grammar(words, ends, rules.least)
    order = np.argsort(g.names, kind="stable")
    names, places, lefts, sizes = (v[order] for v in (g.names, g.places, g.lefts, g.sizes))
    first = np.flatnonzero(np.diff(names, prepend=-1))
    times = np.diff(np.append(first, len(names)))
    of, shift, length, period = crossing(words, places[first], lefts[first], sizes[first], rules)
    run, use = ragged(first[of], times[of])
    start, length, period = places[use] + shift[run], length[run], period[run]
    text = np.searchsorted(ends, start, side="right")
    order = np.lexsort((-length, start, period, text))
    text, start, length, period = (v[order] for v in (text, start, length, period))
    group = np.cumsum(np.diff(text, prepend=-1).astype(bool) | np.diff(period, prepend=-1).astype(bool))
    reach = np.maximum.accumulate(group * (len(words) + 1) + start + length)
    whole = np.ones(len(text), dtype=bool)  # parts of a run end where an earlier one of their period reached
    whole[1:] = reach[1:] > np.maximum(reach[:-1], group[1:] * (len(words) + 1))
    text, start, length, period = (v[whole] for v in (text, start, length, period))
    order = np.lexsort((period, start, text))
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return text[order], (start - begins[text])[order], length[order], period[order]


Edit = Callable[[object, list[bytes]], list[bytes]]
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]), False)


def detect(docs: DataFrame, rules: RunRules = RunRules(), name: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """(name, runs: array of (start, length, period), by start and period; collapsed: the words that stay, joined by spaces).

    Of every run its first period stays; a word goes if any run has it after that. Null texts have no words and
    collapse to an empty one; rows that repeat each have their own result, an empty table none. Other columns,
    whatever their names, are not looked at. edit changes a row's words before they are searched.
    """
    slim = docs.select(F.col(name).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    kind = docs.schema[name]
    schema = T.StructType([T.StructField("name", kind.dataType), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // rules.chunk
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column(0), *_collapsed(part, rules, edit)], ["name", "runs", "collapsed"])

    return slim.mapInArrow(run, schema).withColumnRenamed("name", name)


def _collapsed(part: pa.RecordBatch, rules: RunRules, edit: Edit | None) -> tuple[pa.Array, pa.Array]:
    texts = [t.split() for t in part.column(1).to_pylist()]
    if edit:
        texts = [edit(key, t) for key, t in zip(part.column(0).to_pylist(), texts, strict=True)]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    numbers = dict(zip(dict.fromkeys(chain.from_iterable(texts)), count()))
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(ends[-1]))
    text, start, length, period = runs_of(words, ends, rules)
    at = start + ends[text] - np.array([len(texts[t]) for t in text], dtype=np.int64)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at + period, 1)
    np.add.at(change, at + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    kept = []
    for t, b in zip(texts, ends.tolist(), strict=True):
        a = b - len(t)
        kept.append(b" ".join(t if stays[a:b].all() else compress(t, stays[a:b].tolist())))
    offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
    items = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(offsets, items), pa.array(kept, pa.binary()).cast(pa.string())


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The contract's repetition in a tenth of the rows: from a place on, words repeat with a period. A null key plants nothing."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]]


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared as fractions; ties: the smallest start, then period."""
    over = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda top, r: F.when(over(r, top), r).otherwise(top))


def digest(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """A row per document with its number of runs, the strongest, and checksums of all runs and of the collapsed text."""
    found = detect(docs, rules, edit=planted).withColumn("top", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = F.col("top")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
