"""Embedding near-dedup: a random-projection tree forest with spill overlap, verified within leaves.

Each tree splits recursively along random directions at the median of a bounded sample; vectors
close to a split go down both sides. Every vector is put into its leaves of every tree. Pairs are
compared, in double precision, within leaves only. A pair that shares several leaves counts in the
first of them, so link counts add up without any list of pairs; what leaves a task is a count for
each vector and a spanning forest of the links.

The first splits are fitted on one bounded sample of all vectors. Where that leaves a leaf with more
than rules.most vectors, a subtree is fitted on a bounded sample of the leaf's own vectors, and the
leaf is dealt anew; this goes on until leaves are bounded, so the number of comparisons grows with
the number of vectors, not with its square. Deeper trees part more neighbours, so there are more
trees the deeper they are. A leaf that splits don't make smaller is cut into tiles, and each pair of
tiles is compared by a task of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import Scratch, components, split_join


@dataclass(frozen=True)
class ForestRules:
    threshold: float = 0.9
    #: Least trees. Where the depth asks for more, there are more: see number_of_trees().
    trees: int = 6
    #: Vectors aimed at in a leaf, before overlap.
    leaf: int = 384
    #: Half width of the overlap, in standard deviations of a node's projections.
    spill: float = 0.2
    #: Vectors that the splits are fitted on, about; at least FEW of them reach every node that is split.
    sample: int = 16_384
    #: Most vectors in a tile.
    tile: int = 1_024
    #: Most vectors in a leaf that isn't split again.
    most: int = 4_096
    #: Vectors of a leaf that its subtree is fitted on, about, and vectors dealt by one task group.
    subsample: int = 4_096
    block: int = 65_536
    #: Share of pairs at the threshold that a split leaves together, as measured on random vectors, and the share of
    #: them that should meet in some tree.
    together: float = 0.96
    meet: float = 0.97
    seed: int = 42


FEW = 16


@dataclass
class Tree:
    """Splits in heap order: node i has children 2i + 1 and 2i + 2; a leaf has no direction."""

    directions: dict[int, np.ndarray]
    cuts: dict[int, tuple[float, float]]


def number_of_trees(depth: int, rules: ForestRules) -> int:
    """So many that a pair at the threshold meets in one of them with chance rules.meet."""
    one = rules.together**depth
    return max(rules.trees, int(np.ceil(np.log(1 - rules.meet) / np.log(1 - one)))) if one < 1 else rules.trees


def grow(sample: np.ndarray, depth: int, rules: ForestRules, *seeds: int) -> Tree:
    rng = np.random.default_rng([rules.seed, *seeds])
    tree = Tree({}, {})
    todo = [(0, 0, np.arange(len(sample)))]
    while todo:
        node, level, rows = todo.pop()
        if level == depth or len(rows) < 2 * FEW:
            continue
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction) or 1.0
        at = sample[rows] @ direction
        cut, margin = float(np.median(at)), float(rules.spill * at.std())
        if (at > cut - margin).all() or (at <= cut + margin).all():
            continue  # no split: one side would take everything
        tree.directions[node], tree.cuts[node] = direction, (cut, margin)
        todo.append((2 * node + 1, level + 1, rows[at <= cut]))
        todo.append((2 * node + 2, level + 1, rows[at > cut]))
    return tree


def leaves_of(tree: Tree, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf of every row."""
    rows_out, leaf_out, todo = [], [], [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in tree.directions:
            rows_out.append(rows)
            leaf_out.append(np.full(len(rows), node, dtype=np.int64))
            continue
        at = unit[rows] @ tree.directions[node]
        cut, margin = tree.cuts[node]
        todo.append((2 * node + 1, rows[at <= cut + margin]))
        todo.append((2 * node + 2, rows[at > cut - margin]))
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows_out), np.concatenate(leaf_out)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows, in double precision; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), col] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # so that squares stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node reachable by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    return label


def _compare(threshold: float, dims: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, copies, own = (group[c].to_numpy() for c in ("id", "copies", "own"))
        leaf, lo, hi = (group[c][0].as_py() for c in ("leaf", "lo", "hi"))
        unit = _unit(_matrix(group["v"].chunk(0), dims))
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if lo != hi:
            linked &= own[:, None] != own[None, :]
        lists = group["leaves"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes)
        earlier = flat < leaf
        if earlier.any() and linked.any():
            _, column = np.unique(flat[earlier], return_inverse=True)
            member = np.zeros((len(ids), int(column.max()) + 1), dtype=np.float32)
            member[row[earlier], column] = 1
            linked &= member @ member.T == 0
        count = linked @ copies
        some = np.flatnonzero(count)
        i, j = np.nonzero(np.triu(linked))
        label = _spanning(i, j, len(ids))
        edge = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table(
            {
                "a": pa.array(np.concatenate((ids[some], ids[edge]))),
                "b": pa.array(np.concatenate((ids[some], ids[label[edge]]))),
                "n": pa.array(np.concatenate((count[some], np.zeros(len(edge), dtype=np.int64)))),
            }
        )

    return run


def _usable(v: Column) -> Column:
    """A vector that has a direction: not null or all zero, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _subtree(rules: ForestRules, dims: int):
    """A leaf's sample to a splitting tree for the leaf."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        leaf, count = group["leaf"][0].as_py(), group["count"][0].as_py()
        sample = _unit(_matrix(group["v"].combine_chunks(), dims))
        tree = grow(sample, int(np.ceil(np.log2(count / rules.leaf))), rules, leaf % (1 << 63))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _deal_again(dims: int):
    """Rows (leaf, block, tree, id, v), each leaf's tree before its vectors, to (id, leaf, into)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
            for at, to in zip(edges, edges[1:]):
                part = batch.slice(at, to - at)
                blob = part.column(2)[0].as_py() if to > at else None
                if blob is not None:
                    now, tree = int(leaf[at]), pickle.loads(blob)
                part = part.filter(part.column(2).is_null())
                for start in range(0, part.num_rows, 2048):
                    some = part.slice(start, 2048)
                    if now != int(leaf[at]) or not tree.directions:  # no sample came, or it had no split
                        row, into = np.arange(some.num_rows), np.full(some.num_rows, leaf[at])
                    else:
                        row, node = leaves_of(tree, _unit(_matrix(some.column(4), dims)))
                        into = _mix(np.int64(leaf[at]), node)
                    yield pa.RecordBatch.from_arrays([some.column(3).take(pa.array(row)), pa.array(np.full(len(row), leaf[at])), pa.array(into)], ["id", "leaf", "into"])

    return run


def _mix(leaf: np.int64, node: np.ndarray) -> np.ndarray:
    """A name for each node under a leaf. Equal names would only put two leaves together."""
    with np.errstate(over="ignore"):
        x = np.uint64(leaf.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _refined(dealt: DataFrame, classes: DataFrame, dims: int, rules: ForestRules, scratch: Scratch, kind: str) -> tuple[DataFrame, DataFrame]:
    """dealt (id, leaf) with leaves of over rules.most vectors dealt anew, and (leaf, count) of all leaves.

    Each round fits a subtree per such leaf, on about rules.subsample of its vectors, and sends the leaf's
    vectors with it in blocks of about rules.block: neither holds a leaf. A round that leaves as many vectors in
    such leaves as before is the last.
    """
    n, before, k = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, 0
    share = lambda seed: F.shiftrightunsigned(F.xxhash64("id", "leaf", F.lit(seed)), 11) / float(1 << 53)
    while True:
        sizes = scratch.save(dealt.groupBy("leaf").count(), f"sizes{k}")
        big = sizes.where(F.col("count") > rules.most)
        held = big.agg(F.sum("count")).first()[0] or 0  # one number
        if not held or (before is not None and held > 0.9 * before):
            return dealt, sizes
        before, k = held, k + 1
        again = scratch.save(split_join(dealt, big.withColumn("rows", F.col("count")), ["leaf"], "rows").join(classes.select("id", "v"), "id"), f"again{k}")
        fitted = again.where(share(rules.seed + k) < rules.subsample / F.col("count")).groupBy("leaf").applyInArrow(_subtree(rules, dims), "leaf long, tree binary")
        blocks = F.greatest(F.ceil(F.col("count") / rules.block), F.lit(1)).cast("int")
        trees = fitted.join(big, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast(kind).alias("v"))
        vectors = again.select("leaf", F.floor(share(7) * blocks).cast("int").alias("block"), F.lit(None).cast("binary").alias("tree"), "id", "v")
        sent = trees.unionAll(vectors).repartition(n, "leaf", "block").sortWithinPartitions("leaf", "block", F.col("tree").isNull())
        moved = sent.mapInArrow(_deal_again(dims), "id long, leaf long, into long").select("id", F.col("into").alias("leaf"))
        rest = split_join(dealt, sizes.withColumnRenamed("count", "rows").withColumn("count", F.col("rows")), ["leaf"], "rows").where(F.col("count") <= rules.most).select("id", "leaf")
        dealt = scratch.save(rest.unionAll(moved).distinct(), f"dealt{k}")


def near_dups(vectors: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    n_links: other rows found with cosine >= threshold. component_id: smallest vec_id reachable by
    links, the row's own included. kept: vec_id = component_id.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of unequal length compare as if the shorter went on with zeros. Equal vectors are
    compared once and counted each. Repeated rows are rows of their own. A null vec_id may link, but
    isn't a smallest id. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    keyed = rows.where(_usable(v)).select("vec_id", "v", F.xxhash64("v").alias("ka"), F.xxhash64(F.lit(1), "v").alias("kb"))
    classes = keyed.groupBy("ka", "kb").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = scratch.save(classes.withColumn("id", F.xxhash64("ka", "kb")), "classes")
    total, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()  # two numbers
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return rows.select("vec_id", *alone)

    picked = F.shiftrightunsigned(F.xxhash64("id", F.lit(rules.seed)), 11) < int(min(1.0, rules.sample / total) * (1 << 53))
    held = classes.where(picked).select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).toArrow()  # bounded by rules.sample
    held = held.sort_by("id").combine_chunks()
    sample = _unit(_matrix(held["v"].chunk(0), dims)) if held.num_rows else np.zeros((0, dims))
    depth = max(0, int(np.ceil(np.log2(total / rules.leaf))))
    trees = number_of_trees(depth, rules)
    forest = pickle.dumps([grow(sample, depth, rules, i) for i in range(trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(forest)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = _unit(_matrix(part.column(1), dims))
                found = [leaves_of(t, unit) for t in held]
                row = np.concatenate([r for r, _ in found])
                leaf = np.concatenate([(n << 48) + x for n, (_, x) in enumerate(found)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(leaf)], ["id", "leaf"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = scratch.save(classes.select("id", "v").mapInArrow(deal, "id long, leaf long"), "dealt0")
    dealt, sizes = _refined(dealt, classes, dims, rules, scratch, kind)

    lists = dealt.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a vector's leaves: trees times overlap
    listed = scratch.save(classes.select("id", "copies", "v").join(lists, "id"), "listed")
    tiled = sizes.where(F.col("count") > rules.tile).select("leaf", F.ceil(F.col("count") / rules.tile).cast("int").alias("tiles"))
    exploded = listed.select("*", F.explode("leaves").alias("leaf"))
    spread = exploded.join(tiled, "leaf", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("id", "copies", "v", "leaves", "leaf", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    found = spread.groupBy("leaf", "lo", "hi").applyInArrow(_compare(rules.threshold, dims), "a long, b long, n long")
    found = scratch.save(found, "found")

    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = components(scratch, found.where("n = 0").select("a", "b"), "links").toDF("id", "root")
    named = classes.join(counts, "id", "left").join(comp, "id", "left")
    named = named.select("ka", "kb", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    named = scratch.save(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    result = split_join(named, smallest, ["root"], "rows").select("ka", "kb", "copies", "n_links", "component_id")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    slim = scratch.save(keyed.select("vec_id", "ka", "kb"), "slim")
    linked = split_join(slim, scratch.save(result, "result"), ["ka", "kb"], "copies").select("vec_id", "n_links", "component_id", kept.alias("kept"))
    scratch.drop("slim", "result")
    return linked.unionAll(rows.where(~_usable(v)).select("vec_id", *alone))
