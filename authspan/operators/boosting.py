"""Boosted trees for several classes at once: softmax gradients summed by (node, feature, bin, class).

A round adds a tree to every class. Trees grow by levels, and a level is one sum over rows for all classes and all models:
each task adds its rows' gradients to histograms, so that what comes to the driver has the size of the model's level for each
task, whatever the rows. Of two siblings only the lighter is counted, the other is what their parent has more; leaves at full
depth are what the best cut has on either side. Features are cut at quantiles of a sketch.

Rows of equal bins have equal margins, so they are one cell, with its weight by fold and class. Cells are dealt to tasks in
blocks, matrices of a row a feature. Margins are kept with them and move when the next round's first level is
counted; each SPAN rounds the blocks are a table, from which a lost executor's part is made again. So few cells that one
task may hold them (FEW) take all rounds of a model within a task, by the same steps.

With a fold column, a model for each fold learns from the other folds' rows, all in the same passes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authspan.sources.scratch import dropped, materialised

#: Rows of a block; cells, times classes, of a task that takes all rounds of a model; cells of any other task, at least; rounds
#: between tables; rows to one that is counted.
BLOCK, FEW, SHARE, SPAN, STRIDE = 1 << 16, 1 << 21, 1 << 14, 20, 16


@dataclass(frozen=True)
class BoostRules:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.1
    bins: int = 64
    shrink: float = 1.0  # added to a node's second derivatives
    least: float = 1.0  # second derivatives of a node, at least


@dataclass
class Boosted:
    """cuts: of each feature. trees[model][round][class]: (feature, bin, value) by node in heap order; feature -1 is a leaf."""

    names: list[str]
    cuts: list[np.ndarray]
    classes: int
    depth: int
    trees: list[list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def sketched_cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 rising cuts of each feature; a value's bin is the number of cuts below it."""
    found = rows.approxQuantile(names, [i / bins for i in range(1, bins)], 0.1 / bins)  # bins numbers a feature
    return [np.unique(np.array(q, dtype=float)) for q in found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Nulls and NaN are in bin 0."""
    x = np.where(np.isnan(x), -np.inf, x)
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)


def walked(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row, in heap order, after at most depth steps; x has a row of bins for each feature.

    Every node compares all rows, which is a few bytes' work a row, and keeps of its children's answers those of the right side.
    """
    feature, cut, _ = tree
    kind = np.uint8 if depth < 8 else np.uint16 if depth < 16 else np.uint32

    def below(at: int, steps: int) -> np.ndarray:
        if not steps or feature[at] < 0:
            return kind(at)
        left, right = below(2 * at + 1, steps - 1), below(2 * at + 2, steps - 1)
        over = x[feature[at]] > int(cut[at])
        over = np.negative(over.view(np.uint8) if kind is np.uint8 else over.astype(kind))  # all bits, or none
        return left ^ (over & (left ^ right))

    return np.broadcast_to(below(0, depth), x.shape[1:])


def softmax(margins: np.ndarray) -> np.ndarray:
    """Probabilities of margins whose next to last axis is the class."""
    e = np.exp(margins - margins.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def derivatives(margins: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss of cells, both (models * classes, cells), by weights (folds, classes, cells).

    A model's weights are those of the other folds; the only one without folds has all."""
    own = weight.sum(axis=0) - weight if len(weight) > 1 else weight
    p, whole = softmax(margins), own.sum(axis=1, keepdims=True)
    return tuple(v.reshape(-1, v.shape[-1]) for v in (whole * p - own, np.maximum(2.0 * p * (1.0 - p), 1e-16) * whole))


def histogram(place: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, width: int, size: int) -> np.ndarray:
    """(2, width * size): sums of g and h over node * size + place, of the rows' places (a row, a place for each feature); node -1 adds nothing.

    A feature's places are a stretch of their own, as wide as any other's."""
    names, bins = place.shape[1], size // place.shape[1]
    out = np.empty((2, names, width, bins))
    rows = np.flatnonzero(node >= 0)
    if len(rows) < len(node):
        node, g, h = node.take(rows), g.take(rows), h.take(rows)
    else:
        rows = None
    at = node * bins
    for f, column in enumerate(place.T):
        here = at + (column if rows is None else column.take(rows))
        for v, sums in ((g, out[0, f]), (h, out[1, f])):
            sums[:] = np.bincount(here, v, width * bins).reshape(width, bins)
        at -= bins
    return out.transpose(0, 2, 1, 3).reshape(2, -1)


def packed(counts: list[int]) -> list[list[int]]:
    """Features by the number of their bins, in groups that together have about as many as the largest feature, so that one sum serves a group."""
    groups: list[list[int]] = []
    most, sizes = 2 * max(counts), []
    for f in sorted(range(len(counts)), key=lambda f: (-counts[f], f)):
        at = next((i for i, n in enumerate(sizes) if n * counts[f] <= most), None)
        if at is None:
            groups.append([f])
            sizes.append(counts[f])
        else:
            groups[at].append(f)
            sizes[at] *= counts[f]
    return groups


def matrix(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    """A column of bytes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(rows, -1)


def as_bytes(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of bytes."""
    raw = np.ascontiguousarray(values)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw)])
    return fixed.cast(pa.binary())


def in_bins(batch: pa.RecordBatch, names: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of a batch of double columns."""
    return binned(np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1), cuts)


def splits(g: np.ndarray, h: np.ndarray, rules: BoostRules) -> tuple[np.ndarray, ...]:
    """(feature, bin, g, h of the left side) of the best split of each node by (node, feature, bin) sums, the first of equals; feature -1 if none gains."""
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
    gain = left_g**2 / (left_h + rules.shrink) + (all_g - left_g) ** 2 / (all_h - left_h + rules.shrink) - all_g**2 / (all_h + rules.shrink)
    gain = np.where((left_h >= rules.least) & (all_h - left_h >= rules.least), np.round(gain, 9), -1.0).reshape(len(g), -1)
    if not gain.size:
        return np.full(len(g), -1), *np.zeros((3, len(g)), dtype=np.int64)
    best, nodes, cuts = gain.argmax(axis=1), np.arange(len(g)), left_g.shape[2]
    feature = np.where(gain[nodes, best] > 1e-9, best // cuts, -1)
    return feature, best % cuts, left_g.reshape(gain.shape)[nodes, best], left_h.reshape(gain.shape)[nodes, best]


#: Trees of a round, of a model and class each; the nodes of a level that are counted, and their slots, by tree.
Trees = list[tuple[np.ndarray, np.ndarray, np.ndarray]]
Counted = list[dict[int, int]]


def level_sums(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], grown: Trees, level: int, counted: Counted, counts: list[int]) -> np.ndarray:
    """(trees, 3, slots, features, bins): sums of derivatives over parts (x, first, second derivatives by tree), and how many of
    every STRIDE-th row, by which the smaller of two siblings is told. counts: bins of each feature."""
    groups, slots = packed(counts), max(map(len, counted))
    width = max(int(np.prod([counts[f] for f in own])) for own in groups)
    kind = np.uint16 if width * len(groups) <= 65536 else np.uint32
    size = width * len(groups)
    sums, slot_of = np.zeros((len(grown), 3, slots * size)), np.full((len(grown), 2 ** (level + 1) - 1), -1)
    for t, own in enumerate(counted):
        for j, slot in own.items():
            slot_of[t, 2**level - 1 + j] = slot
    for x, g, h in parts:
        place = np.empty((len(groups), x.shape[1]), dtype=kind)
        for i, own in enumerate(groups):
            place[i] = x[own[-1]]
            for f in own[-2::-1]:
                place[i] = place[i] * kind(counts[f]) + x[f]
            place[i] += kind(i * width)
        few = np.ascontiguousarray(place[:, ::STRIDE]).T
        ones = np.ones(len(few))
        for t, tree in enumerate(grown):
            if counted[t]:
                node = slot_of[t].take(walked(tree, x, level))
                sums[t, :2] += histogram(place.T, g[t], h[t], node, slots, size)
                sums[t, 2] += histogram(few, ones, ones, node[::STRIDE], slots, size)[0]
    sums = sums.reshape(len(grown), 3, slots, len(groups), width)
    out = np.zeros((len(grown), 3, slots, len(counts), max(counts)))
    for i, own in enumerate(groups):
        shape = [counts[f] for f in own]
        here = sums[..., i, : int(np.prod(shape))].reshape(len(grown), 3, slots, *shape[::-1])
        for at, f in enumerate(own):
            out[..., f, : counts[f]] = here.sum(axis=tuple(2 + len(own) - o for o in range(len(own)) if o != at))
    return out


def grow(sums: Callable[[Trees, int, Counted], np.ndarray], trees: int, rules: BoostRules) -> Trees:
    """Trees of a round, level by level, from sums(trees so far, level, nodes to count)."""
    nodes = 2 ** (rules.depth + 1) - 1
    grown = [(np.full(nodes, -1, dtype=np.int32), np.zeros(nodes, dtype=np.int32), np.zeros(nodes)) for _ in range(trees)]
    worth = lambda g, h: -rules.rate * g / (h + rules.shrink)
    counted: Counted = [{0: 0} for _ in range(trees)]
    parents: dict = {}
    for level in range(max(1, rules.depth)):
        both, whole = sums(grown, level, counted), {}  # (tree, node): its sums
        for t, own in enumerate(counted):
            for j, slot in own.items():
                whole[t, j] = both[t, :, slot]
                if level:
                    whole[t, j ^ 1] = parents[t, j // 2] - whole[t, j]
        stacked = np.stack(list(whole.values()))
        found = splits(stacked[:, 0], stacked[:, 1], rules) if rules.depth else (np.full(len(whole), -1),) * 4
        totals = stacked[:, :2, 0].sum(axis=2)
        counted = [{} for _ in range(trees)]
        for (t, j), (g, h), f, at, left_g, left_h in zip(whole, totals, *found, strict=True):
            feature, cut, value = grown[t]
            here = 2**level - 1 + j
            value[here] = worth(g, h)
            if f < 0:
                continue
            feature[here], cut[here] = f, at
            if level + 1 < rules.depth:
                rows = whole[t, j][2, f]
                counted[t][2 * j + int(2 * rows[: at + 1].sum() > rows.sum())] = len(counted[t])
            else:
                value[2 * here + 1], value[2 * here + 2] = worth(left_g, left_h), worth(g - left_g, h - left_h)
        parents = whole
        if not any(counted):
            break
    return grown


def moved(x: np.ndarray, margins: np.ndarray, grown: Trees, depth: int) -> np.ndarray:
    """The margins (models, classes, rows) with a round's trees added."""
    return margins + np.stack([tree[2][walked(tree, x, depth)] for tree in grown]).reshape(margins.shape)


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of BLOCK rows or somewhat more, as far as they go."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= BLOCK:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _blocks(cells: DataFrame, tasks: int, features: int, small: type, models: int, folds: int, classes: int) -> RDD:
    """Cells (x, w: weights by fold and class) dealt to tasks, as pickled blocks (x, weights, margins of 0)."""

    def as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            n = b.num_rows
            x, w = matrix(b.column("x"), small, n), np.stack([b.column(f"w{i}").to_numpy(zero_copy_only=False) for i in range(folds * classes)])
            made = np.ascontiguousarray(x.reshape(n, features).T), w.reshape(folds, classes, n), np.zeros((models, classes, n))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], ["block"])

    return cells.repartition(tasks).mapInArrow(as_blocks, "block binary").rdd.map(lambda r: bytes(r.block))


def fit(rows: DataFrame, names: list[str], classes: int, label: str = "label", weight: str | None = None, fold: str | None = None, folds: int = 1, rules: BoostRules = BoostRules(), cuts: list[np.ndarray] | None = None) -> Boosted:
    """A model of rows (names..., label: 0 to classes - 1), or with fold (0 to folds - 1) one for each fold, of the others' rows."""
    spark = rows.sparkSession
    cuts = cuts if cuts is not None else sketched_cuts(rows, names, rules.bins)
    models = parts = folds if fold else 1
    features, counts = len(names), [len(c) + 1 for c in cuts]
    xs = [f"x{i}" for i in range(features)]
    slim = rows.select(*(F.col(n).cast("double").alias(x) for n, x in zip(names, xs, strict=True)), F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    small = np.uint8 if max(counts) <= 256 else np.uint16 if max(counts) <= 65536 else np.uint32

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([as_bytes(in_bins(b, xs, cuts).astype(small)), *(b.column(n) for n in ("y", "w", "fold"))], ["x", "y", "w", "fold"])

    here = lambda i: (F.col("fold") == i // classes) & (F.col("y") == i % classes)
    cells = slim.mapInArrow(to_bins, "x binary, y int, w double, fold int").groupBy("x").agg(*(F.sum(F.when(here(i), F.col("w")).otherwise(0.0)).alias(f"w{i}") for i in range(parts * classes)))
    cells = materialised(cells)
    n, cores = cells.count(), spark.sparkContext.defaultParallelism
    few = n * classes <= FEW
    blocks = _blocks(cells, 1 if few else min(cores, -(-n // SHARE)), features, small, models, parts, classes)

    def by_model(block: bytes) -> Iterator[tuple[int, bytes]]:
        x, w, m = pickle.loads(block)
        for k in range(models):
            yield k, pickle.dumps((x, (w.sum(axis=0) - w[k] if models > 1 else w[0])[None], m[k : k + 1]), 5)

    def learnt(blocks: list[bytes]) -> list[Trees]:
        state, out = [pickle.loads(b) for b in blocks], []
        for _ in range(rules.rounds):
            ready = [(x, *derivatives(m, w)) for x, w, m in state]
            out.append(grow(lambda *at: level_sums(ready, *at, counts), classes, rules))  # noqa: B023
            state = [(x, w, moved(x, m, out[-1], rules.depth)) for x, w, m in state]
        return out

    def all_rounds(held: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, list[Trees]]]:
        own: dict[int, list[bytes]] = {}
        for k, b in held:
            own.setdefault(k, []).append(b)
        return ((k, learnt(blocks)) for k, blocks in own.items())

    if not n:
        grown = {k: learnt([]) for k in range(models)}
    elif few:
        grown = dict(blocks.flatMap(by_model).partitionBy(models, lambda k: k).mapPartitions(all_rounds).collect())
    else:
        rounds = _by_passes(blocks, models * classes, rules, counts)
        grown = {k: [r[k * classes : (k + 1) * classes] for r in rounds] for k in range(models)}
    dropped(cells)
    return Boosted(list(names), cuts, classes, rules.depth, [grown[k] for k in range(models)])


def _by_passes(blocks: RDD, trees: int, rules: BoostRules, counts: list[int]) -> list[Trees]:
    """The trees of all rounds; a level is a pass over blocks, and the first of a round moves the margins by the round before."""
    held, depth = StorageLevel.MEMORY_AND_DISK, rules.depth

    def derived(blocks: Iterable[bytes]) -> Iterator[bytes]:
        for x, w, m in map(pickle.loads, blocks):
            yield pickle.dumps((x, *derivatives(m, w)), 5)

    out: list[Trees] = []
    state, ready, table = blocks.persist(held), None, None
    for i in range(rules.rounds):
        past, before = [state, ready] if i else [], None
        if i:

            def step(blocks: Iterable[bytes], last=out[-1]) -> Iterator[bytes]:
                for x, w, m in map(pickle.loads, blocks):
                    yield pickle.dumps((x, w, moved(x, m, last, depth)), 5)

            state = state.mapPartitions(step)
            if i % SPAN == 0:
                before, table = table, materialised(state.map(lambda b: (b,)).toDF("block binary"))
                state = table.rdd.map(lambda r: bytes(r.block))
            state.persist(held)
        ready = state.mapPartitions(derived).persist(held)

        def sums(*at, ready=ready) -> np.ndarray:
            def summed(blocks: Iterable[bytes]) -> Iterator[np.ndarray]:
                yield level_sums(map(pickle.loads, blocks), *at, counts)

            per = ready.mapPartitions(summed)
            return per.treeReduce(np.add) if per.getNumPartitions() > 64 else per.reduce(np.add)

        out.append(grow(sums, trees, rules))
        for rdd in past:
            rdd.unpersist()
        if before is not None:
            dropped(before)
    for rdd in (state, ready):
        if rdd is not None:
            rdd.unpersist()
    if table is not None:
        dropped(table)
    return out


def probabilities(model: Boosted, rows: DataFrame, fold: str | None = None, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(keys, p: array of the classes' probabilities), with fold by the model that didn't learn from the row's fold."""
    xs = [f"_x{i}" for i in range(len(model.names))]
    slim = rows.select(*keys, *(F.col(n).cast("double").alias(x) for n, x in zip(model.names, xs, strict=True)), (F.col(fold).cast("int") if fold else F.lit(0)).alias("_k"))
    schema = slim.select(*keys).schema.add("p", T.ArrayType(T.DoubleType()))
    small = np.uint8 if max([len(c) for c in model.cuts], default=0) < 256 else np.uint32

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            x, which = np.ascontiguousarray(in_bins(b, xs, model.cuts).T.astype(small)), b.column("_k").to_numpy(zero_copy_only=False)
            m = np.zeros((model.classes, b.num_rows))
            for k in np.unique(which):
                at = np.flatnonzero(which == k)
                own, sums = x[:, at], np.zeros((model.classes, len(at)))
                for trees in model.trees[k]:
                    for c, tree in enumerate(trees):
                        sums[c] += tree[2][walked(tree, own, model.depth)]
                m[:, at] = sums
            p = np.ascontiguousarray(softmax(m).T).ravel()
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, model.classes, dtype=np.int32)), pa.array(p))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), p], [*keys, "p"])

    # Trees cost far more than rows: a small table of few files is dealt to all cores, too.
    return slim.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(scored, schema)
