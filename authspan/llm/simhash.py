"""SimHash near-dedup: 64-bit majority fingerprints, linked by BK-trees over shards.

Fingerprints at 3 or fewer differing bits agree in one of four 16-bit blocks, and, of the other
48 bits, in one of four 12-bit parts. Each of these 16 views deals the distinct fingerprints into
shards that agree in 28 bits; every linked pair shares a shard. A shard's BK-tree keys children by
their integer Hamming distance to the parent, and a search follows only edges within the radius.
Trees travel with their shard by shuffle, not by broadcast: together they grow with the input.
A shard over SHARD members is split into tiles of that size, and each pair of tiles becomes a task
group, so no group is gathered whole. Only a spanning forest of each tree's links leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authspan.llm.common import Scratch, components, packed, row_key, split_join, unpacked

RADIUS = 3
SHINGLE = 3
#: Most members of a BK-tree's tile.
SHARD = 512
#: 64-bit words of the fingerprints of similar().
WORDS = 4
#: Most squeezed bytes of texts in a tile, where one text isn't larger.
TILE_BYTES = 4 << 20
#: Texts are counted in slices of so many shingles, which bounds the bit matrix.
SLICE = 65536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text in 64 bits; zero if it has no word. Repeated shingles count as often as they stand."""
    hashes = _hashes(text, shingle)
    return int.from_bytes(_majority(hashes[:, None]), "little") if len(hashes) else 0


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order; none if it has no word."""
    return np.unique(_hashes(text, shingle))


def sketch(distinct: np.ndarray) -> bytes:
    """The SimHash of a shingle set in 64 * WORDS bits. Bits after the first 64 come from the hashes mixed again."""
    return _majority(np.stack([distinct, *(_mixed(distinct, k) for k in range(1, WORDS))], axis=1)) if len(distinct) else bytes(8 * WORDS)


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    words = (text or b"").lower().split()  # bytes: lower() changes A-Z only, split() cuts at the six ASCII spaces
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    pairs = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in pairs), dtype="<u8", count=n)


def _majority(hashes: np.ndarray) -> bytes:
    """The bits that over half of the rows have set."""
    n, words64 = hashes.shape
    counts = np.zeros(64 * words64, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = np.ascontiguousarray(hashes[at : at + SLICE], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8 * words64), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            down = self.children[at].setdefault(d, new)
            if down == new:
                return
            at = down

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members at most radius bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                stack.extend(kids[x] for x in range(d - radius, d + radius + 1) if x in kids)
            else:
                stack.extend(k for x, k in kids.items() if -radius <= x - d <= radius)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the values of one shard, as pairs of positions."""
    tree, parent, out = BKTree(), [], []
    for i, v in enumerate(values):
        parent.append(i)
        for hit in tree.within(v, radius):
            j = hit
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            if j != i:
                root = i
                while parent[root] != root:
                    root = parent[root]
                if root != j:
                    parent[root] = j
                    out.append((hit, i))
        tree.add(v)
    return out


def nearest(values: list[int], radius: int) -> list[tuple[int, int, int, int]]:
    """A spanning forest like forest(), each link by the nearest member: (position, position, distance, tree)."""
    tree, parent, out = BKTree(), [], []

    def root(j: int) -> int:
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        return j

    for i, v in enumerate(values):
        parent.append(i)
        for d, hit in sorted(((values[j] ^ v).bit_count(), j) for j in tree.within(v, radius)):
            a, b = root(hit), root(i)
            if a != b:
                parent[b] = a
                out.append((hit, i, d))
        tree.add(v)
    return [(x, y, d, root(x)) for x, y, d in out]


def _link_shards(radius: int, trees: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last group, which may go on in the next batch
        for batch in batches:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            key, lo, hi = now[:3]
            if not len(key):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = tuple(x[last:] for x in now)
            yield from (tagged if trees else groups)([x[:last] for x in now[3 * (not trees) :]], np.concatenate(([0], cut)))
        if held is not None:
            yield from (tagged if trees else groups)(list(held[3 * (not trees) :]), np.array([0, len(held[3])]))

    def tagged(columns: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, lo, hi, ids = columns[:4]
        parts = [c.view(np.uint64) for c in columns[4:]]
        found: list[tuple[int, int, int, int]] = []
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            at, to = int(bounds[i]), int(bounds[i + 1])
            values = [sum(w << 64 * k for k, w in enumerate(ws)) for ws in zip(*(p[at:to].tolist() for p in parts), strict=True)]
            name = b"%d %d %d " % (key[at], lo[at], hi[at])
            for x, y, d, tree in nearest(values, radius):
                p, q = sorted((int(ids[at + x]), int(ids[at + y])))
                found.append((_signed(xxhash.xxh64_intdigest(name + b"%d" % ids[at + tree])), p, q, d))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["tag", "a", "b", "d"])

    def groups(columns: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, parts = columns[0], [c.view(np.uint64) for c in columns[1:]]
        a: list[int] = []
        b: list[int] = []
        sizes = np.diff(bounds)
        for i in np.flatnonzero(sizes > 1).tolist():
            at, to = int(bounds[i]), int(bounds[i + 1])
            values = [sum(w << 64 * k for k, w in enumerate(ws)) for ws in zip(*(p[at:to].tolist() for p in parts), strict=True)]
            for x, y in forest(values, radius):
                a.append(at + x)
                b.append(at + y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def shard_keys():
    """The 16 keys of a fingerprint, as a Spark array: view number, 16-bit block, 12-bit part."""
    fp, keys = F.col("fp"), []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        # the other 48 bits: those below the block, and those above it moved down
        low = fp.bitwiseAND(F.lit((1 << 16 * i) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints fps (fp: long) at most radius (<= 3) bits apart."""
    if radius > 3:
        raise ValueError("the shards prove radius 3 at most")
    rows = fps.select(F.explode(shard_keys()).alias("key"), F.col("fp").alias("id"), "fp")
    return _linked(rows, radius, shard)


def _linked(rows: DataFrame, radius: int, shard: int, trees: bool = False) -> DataFrame:
    """Spanning links (a, b: ids) within the shards of rows (key, id, and the fingerprint's words).

    With trees: (tag, a, b, d), a tag for each tree of nearest links, and their distances."""
    words = rows.columns[2:]
    hot = rows.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles")).cast("int")
    dealt = (
        rows.join(hot, "key", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", *words)
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_link_shards(radius, trees), "tag long, a long, b long, d long" if trees else "a long, b long")


def near_dups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable by links of
    radius or fewer differing bits, the document itself included.
    Null, empty or blank text: fingerprint zero, linked like any other. Null doc_id: the row is
    returned and links, but can't be a component's smallest id (null if the component has no other).
    Repeated rows: one result each. An empty table gives an empty result. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, shingle), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    comp = components(scratch, links(distinct.select("fp"), radius), "links")
    rooted = distinct.join(comp.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.save(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    named = scratch.save(split_join(rooted, smallest, ["root"], "fps").select("fp", "component_id", "rows"), "named")
    scratch.drop("fps", "named")
    out = split_join(fps, named, ["fp"], "rows")  # all blank texts share a fingerprint
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _bands(distinct: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n keys of a shingle set, of two least mixed hashes each. Sets share one with chance similarity squared a key."""
    if not len(distinct):
        return np.arange(n, dtype=np.uint64) << np.uint64(56)
    least = np.array([_mixed(distinct, 1000 * seed + k).min() for k in range(2 * n)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(least[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ least[1::2], 7) + np.arange(n, dtype=np.uint64)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [press.compress(t or b"") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blobs, pa.binary())], ["ka", "kb", "blob"])


def _judge(similarity: float, shingle: int):
    """Pairs (a, b, ta, tb: squeezed texts), each with whether its shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held: list[tuple[int | None, np.ndarray | None]] = [(None, None), (None, None)]
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for side, (name, blob) in enumerate(((a, ta), (b, tb))):
                    if held[side][0] != name:
                        held[side] = (name, shingle_set(press.decompress(blob), shingle))
                x, y = held[0][1], held[1][1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "ok"])

    return run


def _across(similarity: float, radius: int, shingle: int):
    """Rows (tag, lo, hi, id, root, squeezed text, words) in group order: links (a, b) that join the roots of a group.

    Pairs of different roots, within the radius and of sizes that allow the similarity, are judged by their
    shingle sets where they meet; what leaves is a spanning forest, fewer links than the group has members.
    """

    def joined(ids: list[int], roots: list[int], x: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        top = np.unique(roots, return_inverse=True)[1]
        if not top.any():
            return []
        sizes = np.array([len(s) for s in sets])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        names, places = np.unique(np.concatenate(sets), return_inverse=True)
        mine, found = np.zeros(len(names), dtype=bool), []
        for i in range(len(ids) - 1):
            after = slice(i + 1, None)
            near = (top[after] != top[i]) & (np.minimum(sizes[after], sizes[i]) >= similarity * np.maximum(sizes[after], sizes[i]) - 1e-9)
            near &= np.bitwise_count(x[after] ^ x[i]).sum(axis=1) <= radius
            own = places[ends[i] : ends[i + 1]]
            mine[own] = True
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if top[j] != top[i]:
                    both = int(np.count_nonzero(mine[places[ends[j] : ends[j + 1]]]))
                    if both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9:
                        found.append((ids[i], ids[j]))
                        top[top == top[j]] = top[i]
            mine[own] = False
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        name: tuple | None = None
        held: list[tuple] = []

        def links() -> Iterator[pa.RecordBatch]:
            ids, roots, sets, *words = zip(*held, strict=True)
            found = joined(list(ids), list(roots), np.array(words, dtype=np.int64).T.view(np.uint64), list(sets))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            for tag, lo, hi, id_, root, blob, *words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != (tag, lo, hi):
                    if held:
                        yield from links()
                    name, held = (tag, lo, hi), []
                held.append((id_, root, shingle_set(press.decompress(blob), shingle), *words))
        if held:
            yield from links()

    return run


def grouped(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.9995, shard: int = SHARD, seed: int = 42) -> DataFrame:
    """(doc_id, ka, kb, root) for each row: (ka, kb) names its doc_id and text, root its component.

    A class is the texts of one shingle set. Shards are classes that share a pair of least hashes; in a
    shard's BK-tree, candidates are classes whose 256-bit fingerprints are three standard errors or
    less beyond the distance expected at the similarity. Each is judged by
    the exact Jaccard similarity of its shingle sets before it links. So that a large group costs no
    square of its size, trees of nearest links are judged first, each class's nearest one before the
    others. Trees with a link that failed are settled where their members meet, in groups of bounded
    members and bytes: pairs between components are judged there, and only links that join some leave.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = [f"f{k}" for k in range(WORDS)]
    typed = ", ".join(f"{w} long" for w in words)
    # a pair at the similarity shares a shard with chance recall, however many texts there are
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(3)]
            ids = [_signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets]
            x = np.frombuffer(b"".join(map(sketch, sets)), dtype="<i8").reshape(-1, WORDS)
            keys = np.concatenate([_bands(s, bands, seed) for s in sets]) if sets else np.zeros(0, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.int64()), *(pa.array(x[:, k].copy()) for k in range(WORDS)), lists], ["doc_id", "ka", "kb", "id", *words, "bands"])

    keyed = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    keyed = keyed.select("doc_id", F.col("key.a").alias("ka"), F.col("key.b").alias("kb"), "text")
    fps = scratch.save(keyed.mapInArrow(run, f"doc_id long, ka long, kb long, id long, {typed}, bands array<long>"), "fps")
    first = F.min(F.struct("ka", "kb")).alias("key")
    distinct = scratch.save(fps.groupBy("id", *words).agg(F.count(F.lit(1)).alias("rows"), first, F.first("bands").alias("bands")), "distinct")

    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    spread = float(np.sqrt(angle * (1 - angle) / (64 * WORDS)))
    radius = int(64 * WORDS * (angle + 3 * spread))
    rows = distinct.select(F.explode("bands").alias("key"), "id", *words)
    edges = scratch.save(_linked(rows, radius, shard, trees=True), "edges")

    ends = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct()
    wanted = distinct.join(ends, "id").select("id", F.col("key.ka").alias("ka"), F.col("key.kb").alias("kb"))
    texts = keyed.select("ka", "kb", "text").mapInArrow(_squeeze, "ka long, kb long, blob binary")
    # wanted grows with the documents: never a broadcast that small inputs would get
    blobs = scratch.save(texts.join(wanted.hint("merge"), ["ka", "kb"]).select("id", "blob").dropDuplicates(["id"]), "blobs")

    def judged(pairs: DataFrame, tag: str) -> DataFrame:
        full = pairs.join(blobs.toDF("a", "ta").hint("merge"), "a").join(blobs.toDF("b", "tb").hint("merge"), "b")
        return scratch.save(full.select("a", "b", "ta", "tb").mapInArrow(_judge(similarity, shingle), "a long, b long, ok boolean"), tag)

    def merged(comp: DataFrame, of: DataFrame, tag: str) -> DataFrame:
        """comp (id, root) with components joined by the pairs that were judged to link."""
        ends = of.where("ok").join(comp.toDF("a", "ra"), "a").join(comp.toDF("b", "rb"), "b")
        more = components(scratch, ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), tag).toDF("root", "into")
        return scratch.save(comp.join(more, "root", "left").select("id", F.coalesce("into", "root").alias("root")), f"{tag}-roots")

    def between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends aren't in one component."""
        return pairs.join(comp.toDF("a", "ra"), "a").join(comp.toDF("b", "rb"), "b").where("ra <> rb").drop("ra", "rb")

    first = F.min(F.struct("d", "a", "b")).alias("e")
    best = edges.withColumn("n", F.explode(F.array("a", "b"))).groupBy("n").agg(first).select("e.a", "e.b").distinct()
    known = judged(best, "nearest")
    comp = merged(scratch.save(ends.select("id", F.col("id").alias("root")), "ends"), known, "links0")
    rest = between(edges.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), comp)
    others = judged(rest, "others")
    comp = merged(comp, others, "links1")
    torn = between(edges, comp).select("tag").distinct()
    members = edges.join(torn, "tag").select("tag", F.explode(F.array("a", "b")).alias("id")).distinct()
    # tiles of few members and bytes; each pair of a tag's tiles is a group
    members = scratch.save(members.join(blobs.select("id", F.length("blob").alias("bytes")), "id"), "members")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / shard, F.sum("bytes") / TILE_BYTES)).cast("int")
    dealt = members.groupBy("tag").agg(parts.alias("tiles"), F.count(F.lit(1)).alias("rows"))
    met = split_join(members, dealt, ["tag"], "rows").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("tag", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id").join(comp, "id")
    met = met.join(blobs.hint("merge"), "id").join(distinct.select("id", *words), "id").select("tag", "lo", "hi", "id", "root", "blob", *words)
    met = met.repartition(n, "tag", "lo", "hi").sortWithinPartitions("tag", "lo", "hi")
    across = scratch.save(met.mapInArrow(_across(similarity, radius, shingle), "a long, b long"), "across")
    comp = merged(comp, across.withColumn("ok", F.lit(True)), "links2")
    of = scratch.save(distinct.select("id", "rows").join(comp, "id", "left").select("id", "rows", F.coalesce("root", "id").alias("root")), "of")
    out = scratch.save(split_join(fps.select("doc_id", "ka", "kb", "id"), of, ["id"], "rows").drop("id"), "grouped")
    scratch.drop("grouped")
    return out


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.9995, shard: int = SHARD, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) like near_dups, for texts whose shingle sets have that Jaccard similarity.

    Links are exact, candidates are found by chance (a pair at the similarity with chance recall, a closer one more surely). Nulls, blanks, repeats and
    empty tables: as in near_dups, but every component
    has an id of its own: of those with one smallest doc_id (or none), all but the first take a row's key.
    """
    found = grouped(docs, similarity, shingle, recall, shard, seed)
    best = _best(found).select("root", "rows", "best.doc_id", "best.ka")
    lead = best.groupBy("doc_id").agg(F.min("ka").alias("ka"))
    lead = lead.select("ka", F.lit(True).alias("lead"))
    named = best.join(lead, "ka", "left").select("root", "rows", F.when(F.col("lead"), F.col("doc_id")).otherwise(F.col("ka")).alias("component_id"))
    return split_join(found, named, ["root"], "rows").select("doc_id", "component_id")


def _best(found: DataFrame) -> DataFrame:
    """(root, rows, best): each component's row with the smallest doc_id, then the smallest key; null ids last."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb"))
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), best.alias("best"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, then the smallest key of id and text.

    Null ids come last. Different texts that share an id, or have none, are documents of their own; of
    rows that repeat both id and text, one stays. Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = grouped(docs, similarity, shingle)
    kept = scratch.save(_best(found).select("best.ka", "best.kb"), "kept")
    # kept keys grow with documents: never a broadcast that small inputs would get
    out = packed(docs, key=row_key("doc_id", "text")).join(kept.hint("merge"), (F.col("key.a") == F.col("ka")) & (F.col("key.b") == F.col("kb")), "left_semi")
    repeated = found.groupBy("ka", "kb").count().where("count > 1")
    return unpacked(out if repeated.isEmpty() else out.dropDuplicates(["key"]), docs.columns)
