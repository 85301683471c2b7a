"""WARC archives: written as one record a row, read back by boundary-chain verification.

Reading: Spark splits the archives at the text that can start a record. For each piece a task emits
a candidate, from its offset to the offset where the record's declared length ends. Pointer jumping
from the start of each file keeps the candidates that the chain of records reaches; what looks
like a record inside a payload is not reached. Chains are first shortened within a split, so the
jumps double over splits, not records. A record whose payload was cut by such a look-alike is put
together from its pieces afterwards, which are kept by the same scan: a second scan could be split
in other places. Offsets are those of the file, so the pieces of a record are found by their range.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from authspan.llm.common import Scratch, split_join

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"

GAP = len(END + MAGIC)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _with_payload(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))


def revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) for rows whose payload another row with a larger page_id has."""
    rows = scratch.save(_with_payload(pages).where(F.octet_length("payload") >= least_bytes).select("page_id", "digest"), "digests")
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    later = split_join(rows, scratch.save(largest, "largest"), ["digest"], "n").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 0) -> None:
    """A record per row of pages (page_id, url, html) in uncompressed archives under path.

    The response of equal payloads is the row with the largest page_id; others are revisits without
    the payload. Rows that tie for the largest are all responses. Null html: an empty payload. Null
    url: no target. Null page_id: a record id without a number, never referred to.
    """
    known = scratch.save(revisits(pages, scratch, least_bytes), "revisits").toDF("_p", "_d", "refers_to")
    rows = _with_payload(pages).join(known, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    revisit = F.col("refers_to").isNotNull()
    number = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", number("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", number("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if v}


def _number(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _parse(data: bytes) -> tuple | None:
    """(length of head, length of block, type, page_id, refers_to, digest) declared at the start of data, which follows a magic."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        return None
    f = _fields(data[:cut])
    size = f.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in f:
        return None
    digest = f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    return cut + 4, int(size), f[b"warc-type"].decode("latin-1"), _number(f.get(b"warc-record-id")), _number(f.get(b"warc-refers-to")), digest


def _measure(kind: str, block: bytes, digest: str) -> tuple[int | None, str, bool]:
    """(bytes of the full payload, its digest, whether content and head agree)."""
    cut = block.find(b"\r\n\r\n")
    said = _fields(block[:cut]).get(b"content-length", b"") if cut >= 0 else b""
    if kind == "revisit":  # its payload is the one it refers to
        return (int(said) if said.isdigit() else None), digest, True
    payload = block[cut + 4 :] if cut >= 0 else block
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return len(payload), own, own == digest and (not said or int(said) == len(payload))


CANDIDATES = "file string, split long, at long, next long, leaves_at long, size long, kind string, page_id long, refers_to long, digest string, bytes long, agrees boolean, whole boolean, data binary"
#: Bytes of a file within which pieces are matched with the records they belong to.
RANGE = 1 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Archive text between places that may start a record, in file order within a task."""
    raw = spark.read.option("lineSep", END + MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, split, offset in the split's text, data after the magic, whether a new split starts)."""
    now, at = None, 0
    for batch in batches:
        for file, split, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = (file, split) != now
            if new:
                now, at = (file, split), 0
            step = len(data) + GAP
            first = split == 0 and at == 0 and data.startswith(MAGIC.encode())
            skip = len(MAGIC) if first else 0
            yield file, split, at + skip, data[skip:], new
            at += step


def _candidates(keep_all: bool):
    """A candidate for each piece. data is kept where the piece may be part of a cut record: it isn't whole
    itself, or lies within what such a one before it in the split declares; or always."""
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CANDIDATES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        until = 0

        def done() -> Iterator[pa.RecordBatch]:
            place = {r[2]: i for i, r in enumerate(rows)}
            for r in reversed(rows):  # where the chain from here leaves the split; -1: it breaks
                if r[3] >= 0:
                    r[4] = rows[place[r[3]]][4] if r[3] in place else r[3]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)
            rows.clear()

        for file, split, at, data, new in _placed(batches):
            if new:
                yield from done()
                until = 0
            found = _parse(data)
            if found is None:
                rows.append([file, split, at, -1, -1, len(data), None, None, None, None, None, None, False, data])
                continue
            head, size, kind, page, refers, digest = found
            end = head + size
            whole = data[end:] in (b"", b"\r\n\r\n") and len(data) >= end
            n, own, agrees = _measure(kind, data[head:end], digest) if whole else (None, digest, None)
            until = until if whole else max(until, at + end)
            kept = data if keep_all or at < until else None
            rows.append([file, split, at, at + end + GAP, -1, len(data), kind, page, refers, own, n, agrees, whole, kept])
        yield from done()

    return run


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a split that the chain reaches from where it enters; a split's records at most."""
    follows = dict(zip(group["at"], group["next"], strict=True))
    reached = set()
    for at in group.loc[group["entry"], "at"]:
        while at in follows and at not in reached:
            reached.add(at)
            at = follows[at]
    return group.loc[group["at"].isin(reached), ["file", "split", "at"]]


def read(spark: SparkSession, path: str, scratch: Scratch, keep_all: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, agrees) for each record under path.

    agrees: the payload has the declared digest and length. Text that no chain of records from a
    file's start reaches is not a record. Empty archives give no rows.
    keep_all: keep the text of every piece for putting cut records together. Without it the scan keeps
    what its split shows to be needed; if a look-alike within a record of an earlier split proves to be
    needed as well, the archives are scanned once more with keep_all.
    """
    every = scratch.save(_pieces(spark, path).mapInArrow(_candidates(keep_all), CANDIDATES), "candidates")
    found = every.withColumn("held", F.col("data").isNotNull()).drop("data")
    # where each split's first piece starts: pieces follow each other without gaps
    splits = found.groupBy("file", "split").agg(F.max(F.col("at") + F.col("size") + GAP).alias("text"))
    order = Window.partitionBy("file").orderBy("split")
    splits = splits.select("file", "split", F.coalesce(F.sum("text").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.row_number().over(order).alias("nth"))
    splits = scratch.save(splits, "splits")
    placed = found.join(splits, ["file", "split"]).withColumn("start", F.col("at") + F.col("base"))
    leave = F.when(F.col("leaves_at") >= 0, F.col("leaves_at") + F.col("base"))
    jumps = scratch.save(placed.select("file", F.col("start").alias("pos"), leave.alias("to")), "jumps0")
    reached = scratch.save(jumps.where(F.col("pos") == len(MAGIC)).select("file", "pos"), "reached0")
    most = splits.agg(F.max("nth")).first()[0] or 1  # one number
    for k in range((most - 1).bit_length()):
        ahead = reached.join(jumps, ["file", "pos"]).where("to is not null").select("file", F.col("to").alias("pos"))
        reached = scratch.save(reached.unionAll(ahead).distinct(), f"reached{k + 1}")
        onward = jumps.toDF("file", "to", "far")
        jumps = scratch.save(jumps.where("to is not null").join(onward, ["file", "to"]).select("file", "pos", F.col("far").alias("to")), f"jumps{k + 1}")
    entries = reached.select("file", F.col("pos").alias("start"), F.lit(True).alias("entry"))
    entered = placed.join(entries, ["file", "start"], "left").select("file", "split", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    chain = entered.groupBy("file", "split").applyInPandas(_walk, "file string, split long, at long")
    records = scratch.save(placed.join(chain, ["file", "split", "at"]), "records")

    result = lambda df: df.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "agrees")
    cut = records.where("not whole").select("file", F.col("start").alias("from"), (F.col("next") + F.col("base")).alias("until"))
    whole = result(records.where("whole"))
    if cut.isEmpty():
        return whole
    inside = scratch.save(_inside(cut, placed.select("file", "split", "at", "start", "held")), "inside")
    if not inside.where("not held").isEmpty():
        return read(spark, path, Scratch(spark, "warc-again"), keep_all=True)
    return whole.unionAll(result(_joined(every, inside)))


def _inside(cut: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces that lie in a cut record, with its start, from. Records of a chain don't overlap, so that is
    the last one that starts at or before the piece; both are dealt by ranges of the file."""
    lowest = lambda c: F.floor(F.col(c) / RANGE).cast("long")
    spread = cut.withColumn("range", F.explode(F.sequence(lowest("from"), F.floor((F.col("until") - 1) / RANGE).cast("long"))))
    spread = spread.select("file", "range", F.greatest("from", F.col("range") * RANGE).alias("start"), F.lit(0).alias("piece"), "from", "until")
    rows = pieces.withColumn("range", lowest("start")).withColumn("piece", F.lit(1)).unionByName(spread, allowMissingColumns=True)
    last = Window.partitionBy("file", "range").orderBy("start", "piece").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(last) for c in ("from", "until")})
    return rows.where("piece = 1 and start < until").select("file", "split", "at", "start", "from", "held")


def _joined(every: DataFrame, inside: DataFrame) -> DataFrame:
    """Records put together from their pieces. Only pieces inside such a record are shuffled."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        data = (END + MAGIC).encode().join(group["data"])
        head, size, kind, page, refers, digest = _parse(data)
        n, own, agrees = _measure(kind, data[head : head + size], digest)
        return pd.DataFrame({"page_id": [page], "bytes": [n], "digest": [own], "kind": [kind], "refers_to": [refers], "agrees": [agrees and len(data) >= head + size]}).astype({"page_id": "Int64", "bytes": "Int64", "refers_to": "Int64"})

    pieces = inside.join(every.where("data is not null").select("file", "split", "at", "data"), ["file", "split", "at"]).select("file", "from", "start", "data")
    return pieces.groupBy("file", "from").applyInPandas(build, "page_id long, bytes long, digest string, kind string, refers_to long, agrees boolean")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, scratch.path("archives"), scratch, least_bytes)
    return read(pages.sparkSession, scratch.path("archives"), scratch)
