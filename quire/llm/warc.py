"""Operator 8: WARC records and a Merkle fixity audit of replicas.

Each record is hashed. Hashes of records whose offsets lie in the same range of RANGE bytes of a file, in offset order, are hashed into a node; FANOUT neighbouring ranges make a node of the next level, up to one root for each file. Two replicas are compared root by root; below a mismatching node, and only there, its children are compared, down to the records. No level needs more than RANGE bytes of records or FANOUT hashes in one place, and record bytes are hashed where they are read, never shuffled.

Edge cases: null bytes count as missing content: the record's hash is that of the empty string. Records of one file at the same offset are one node's neighbours and are compared as a sorted set. A record that one replica lacks is `missing`, one that only the second has is `extra`, one whose bytes differ is `changed`. Null files are one file. Empty replicas give no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, removed, stored

RANGE, FANOUT, FILE_BYTES = 1 << 16, 16, 16 << 20
DATE = "2000-01-01T00:00:00Z"


def header(url: Column, length: Column, key: Column) -> Column:
    """Header block of a WARC/1.0 response record; its id follows from `key`, so reruns agree."""
    h = F.md5(key)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    target = F.when(url.isNull() | (url == ""), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]+", " "), F.lit("\r\n")))
    return F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\n"), target, F.lit("Content-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", content_col: str = "html") -> DataFrame:
    """The id and one WARC record, as bytes, for each row. Null content is empty."""
    body = F.encode(F.coalesce(F.col(content_col), F.lit("")), "UTF-8")
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")))
    return pages.select(F.col(id_col), F.concat(F.encode(header(F.col(url_col), F.octet_length(body), key), "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def place(hashed: DataFrame, order: list[str], length: str = "length", file_bytes: int = FILE_BYTES) -> DataFrame:
    """`hashed` with a file and an offset for each record. Files are about `file_bytes` long, so the window over one is bounded."""
    total = hashed.agg(F.sum(length)).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))
    named = hashed.withColumn("file", F.format_string("part-%05d.warc", F.pmod(F.xxhash64(*order), F.lit(files))))
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def node(children: Column) -> Column:
    return F.sha2(F.concat_ws(",", children), 256)


def levels(most: int) -> int:
    n, top = 0, most // RANGE
    while top:
        n, top = n + 1, top // FANOUT
    return n


def tree(replica: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the ranges up to the roots: file, place, hash. `replica` has file, offset, hash. Each level is written down once, for the next one and the descent."""
    leaf = replica.groupBy("file", F.floor(F.col("offset") / RANGE).alias("place")).agg(node(F.transform(F.array_sort(F.collect_list(F.struct("offset", "hash"))), lambda x: F.concat_ws(":", x["offset"].cast("string"), x["hash"]))).alias("hash"))
    out = [cut(leaf)]
    for _ in range(height):
        up = out[-1].groupBy("file", F.floor(F.col("place") / FANOUT).alias("place"))
        out.append(cut(up.agg(node(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"].cast("string"), x["hash"]))).alias("hash"))))
    return out


def roots(replica: DataFrame) -> DataFrame:
    """file and root hash of each file of a replica (file, offset, hash)."""
    most = replica.agg(F.max("offset")).first()[0] or 0
    return tree(replica, levels(most))[-1].select("file", F.col("hash").alias("root"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at which two levels differ, a null file being a file like any other."""
    both = a.select(*keys, F.col("hash").alias("_a"), F.lit(None).cast("string").alias("_b")).unionByName(b.select(*keys, F.lit(None).cast("string").alias("_a"), F.col("hash").alias("_b")))
    return both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where(~F.col("_a").eqNullSafe(F.col("_b")))


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """file, offset and status of every record in which the second replica differs from the first. Both have file, offset, hash."""
    one, two = cut(one.select("file", "offset", "hash")), cut(two.select("file", "offset", "hash"))
    most = max(one.agg(F.max("offset")).first()[0] or 0, two.agg(F.max("offset")).first()[0] or 0)
    height = levels(most)
    a, b = tree(one, height), tree(two, height)
    wrong = differing(a[-1], b[-1], ["file", "place"]).select("file", "place")
    for k in range(height - 1, -1, -1):
        below = [beneath(t[k], wrong, F.floor(F.col("x.place") / FANOUT)) for t in (a, b)]
        wrong = cut(differing(*below, ["file", "place"]).select("file", "place"))
    last = [beneath(r, wrong, F.floor(F.col("x.offset") / RANGE)) for r in (one, two)]
    sets = [r.groupBy("file", "offset").agg(F.concat_ws(",", F.array_sort(F.collect_list("hash"))).alias("hash")) for r in last]
    return differing(*sets, ["file", "offset"]).select("file", "offset", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("changed").alias("status"))


def beneath(level: DataFrame, wrong: DataFrame, parent: Column) -> DataFrame:
    return level.alias("x").join(wrong.alias("w"), F.col("x.file").eqNullSafe(F.col("w.file")) & (parent == F.col("w.place")), "left_semi")


#: Bytes of the pieces that a stream is stored in, about; each holds whole records.
PIECE = 1 << 20
#: Where a record has the first digit of its date.
DATE_AT = len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: ")


def streams(batches: Iterator[pa.RecordBatch], rot: int) -> Iterator[pa.RecordBatch]:
    """The manifest and the stored copy of records (id, file, offset, length, sha256, pick, record) that lie in the order of files and offsets: manifest rows have no content; rows of the copy have file, offset and the content of a piece. In the copy a record of pick 0 has one wrong digit, and one of pick 1 is zeros."""
    names = ["id", "file", "offset", "length", "sha256", "content"]
    held: list[bytes] = []
    file, start, size = None, 0, 0

    def piece(schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), pa.array([file]), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.nulls(1, pa.string()), pa.array([b"".join(held)], pa.binary())], names=names)

    schema = None
    for batch in batches:
        schema = batch.schema
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.nulls(batch.num_rows, pa.binary())], names=names)
        for k in range(batch.num_rows):
            own, at, pick, record = batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(5)[k].as_py(), batch.column(6)[k].as_py()
            if held and (own != file or size >= PIECE):
                yield piece(schema)
                held.clear()
            if not held:
                file, start, size = own, at, 0
            held.append(record[:DATE_AT] + b"1" + record[DATE_AT + 1 :] if pick == 0 else bytes(len(record)) if pick == 1 else record)
            size += len(record)
    if held:
        yield piece(schema)


def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, offset and hash of the records in the pieces (file, offset, content) of a stream."""
    for batch in batches:
        for k in range(batch.num_rows):
            file, start, content = (c[k].as_py() for c in batch.columns)
            found = [(start + r["offset"], sha256(r["record"]).hexdigest()) for r in parse(content) if "error" not in r]
            yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(found), pa.string()), "offset": pa.array([o for o, _ in found], pa.int64()), "hash": pa.array([h for _, h in found], pa.string())})


def audit_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", content_col: str = "html", rot: int = 500) -> DataFrame:
    """A fixity drill over a table of pages. Its records are laid out as WARC files; their hashes are noted, and the byte streams are stored, in pieces, in the shared folder. In the stored copy one record in `rot` has a wrong digit and another one is lost (zeros), both picked by the hash of the record. The copy is then read back as WARC, its records are hashed, and the audit of these against the noted hashes has to find exactly the damaged ones.

    One row for each page: id, file, offset, length, sha256 and status (ok, changed or missing).
    """
    made = records(pages, id_col, url_col, content_col).select(F.col(id_col).alias("id"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), F.pmod(F.xxhash64("record"), F.lit(rot)).cast("int").alias("pick"), "record")
    placed = place(made, ["id", "sha256"]).select("id", "file", "offset", "length", "sha256", "pick", "record")
    kind = pages.schema[id_col].dataType.simpleString()
    both = stored(placed.mapInArrow(lambda batches: streams(batches, rot), f"id {kind}, file string, offset bigint, length bigint, sha256 string, content binary"))
    manifest = cut(both.where("content is null").drop("content"))
    second = cut(both.where("content is not null").select("file", "offset", "content").mapInArrow(reread, "file string, offset bigint, hash string"))
    removed(both)
    first = manifest.select("file", "offset", F.col("sha256").alias("hash"))
    return manifest.join(audit(first, second), ["file", "offset"], "left").select(F.col("id").alias(id_col), "file", "offset", "length", "sha256", F.coalesce("status", F.lit("ok")).alias("status"))


#: A header line of a WARC record; the blank line after the last one; where a record may begin after a broken one.
FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
BLANK, BEGIN = re.compile(rb"\r\n\r\n"), re.compile(rb"WARC/1\.[0-9]\r\n|\x1f\x8b\x08")


def member(view: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that starts at `at`, and its length; it is fed in bounded windows."""
    d, done, a = zlib.decompressobj(31), [], at
    while not d.eof and a < len(view):
        done.append(d.decompress(view[a : a + (1 << 16)]))
        a += min(1 << 16, len(view) - a)
    if not d.eof:
        raise ValueError("the record is cut off")
    return b"".join(done), a - at - len(d.unused_data)


def parse(content: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or of gzip members: offset and length (of the member, if compressed), type, url, payload and the whole record. What is no record is one row with an `error`, up to where the next one begins."""
    at, view = 0, memoryview(content)
    while at < len(content):
        try:
            own, size, begin = content, 0, at
            if content[at : at + 2] == b"\x1f\x8b":
                own, size = member(view, at)
                begin = 0
            blank = BLANK.search(own, begin)
            if own[begin : begin + 5] != b"WARC/" or not blank:
                raise ValueError("no WARC header")
            head = blank.start()
            fields = {k.strip().lower(): v.strip() for k, v in FIELD.findall(own, begin, head)}
            length = int(fields[b"content-length"])
            if length < 0 or head + 4 + length > len(own):
                raise ValueError("the record is cut off")
            end = min(len(own), head + 4 + length + 4)
            size = size or end - begin
        except (ValueError, KeyError, zlib.error) as e:
            after = BEGIN.search(content, at + 1)
            end = after.start() if after else len(content)
            yield {"offset": at, "length": end - at, "error": str(e)}
            at = end
            continue
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
        yield {"offset": at, "length": size, "type": text(b"warc-type"), "url": text(b"warc-target-uri"), "payload": own[head + 4 : head + 4 + length], "record": own[begin:end]}
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, type, url, payload, hash and error of each record of the WARC files under `path`. A file is one task's work and is held in memory, so files are kept to some hundred MB, as is usual; its records are parsed one by one; `hash` is what audit() compares."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                names = ["file", "offset", "length", "type", "url", "payload", "hash", "error"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
                found = ({"file": name, "hash": sha256(r.get("record", b"")).hexdigest(), **r} for r in parse(content))
                while rows := list(itertools.islice(found, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset bigint, length bigint, type string, url string, payload binary, hash string, error string")
