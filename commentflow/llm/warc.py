"""Deterministic sharded WARC writer and reader.

Pages are sorted by id and cut into shards of about equal row counts, whose bounds are
computed from exact counts of ids (never from a sample, and not from how Spark deals out
partitions). In each shard a record is compressed as a gzip member of its own, and a
new file begins when the current one has reached ``roll_bytes``. Headers and digests are
made anew from the payload; record ids derive from id and digest, and the date is a
parameter, so equal input gives equal bytes on any cluster. Files are written under a temporary name in the
target's folder, renamed when all are there, and listed in a manifest (names,
sizes, records), which is written last: a folder with a manifest is complete.

The members go through Spark's text writer, whose line separator supplies the
last byte of each gzip trailer (zero, as the length field ends in zero for a
record below 16 MB; larger ones are closed by an empty member). So any file
system that Spark can write to works, and Spark's committer handles lost tasks.

Of pages with equal payloads of at least ``min_bytes`` the one with the smallest
id is a response and the others are revisits that refer to it. Only (id, digest)
pairs are grouped and joined; the payload is shuffled once, into id order. A null
html is an empty payload. Rows without an id count as the smallest id and are spread over
shards of their own by digest; rows that repeat id and payload after the first are
revisits of it. Ids that crowd in one 4,096th of their range make uneven shards (files
still roll by size), and the pages of one id lie in one shard.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
BINS = 4096  # of the id range, counted exactly
SHARD_ROWS = 50_000  # rows of a shard, on a large table
LEAST_SHARDS, FEW_ROWS = 32, 500  # smaller tables: up to so many shards, of so many rows at least
_EMPTY = gzip.compress(b"", 6, mtime=0)
_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space for URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAME, f'page:{page}:{digest}')}>"


def _record(page, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record: WARC header, HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = "".join((url or "").split("\r")).replace("\n", "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Page-Id: {'' if page is None else page}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {_PROFILE}",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    return out if out[-1:] == b"\0" else out + _EMPTY


def _shard(sized: DataFrame) -> tuple[Callable[[Column], Column], int]:
    """The shard of a page as an expression of the hash of its payload, and the number of
    shards: a function of exact counts in equal bins of the id range (one number per bin
    on the driver)."""
    ids = F.col("page_id").cast("double")
    n, known, low, high = sized.agg(
        F.count(F.lit(1)), F.count("page_id"), F.coalesce(F.min(ids), F.lit(0.0)), F.coalesce(F.max(ids), F.lit(0.0))
    ).first()
    width = max((high - low) / BINS, 1.0)
    place = (ids - F.lit(low)) / F.lit(width)
    at = F.least(F.floor(place), F.lit(BINS - 1)).cast("int")
    counts = dict(sized.filter("page_id IS NOT NULL").groupBy(at.alias("bin")).count().collect())

    def parts_of(rows: int) -> int:
        return max(-(-rows // SHARD_ROWS), min(LEAST_SHARDS, -(-rows // FEW_ROWS)), 1)

    each, before = -(-known // parts_of(known)) or 1, 0
    first, parts = [], []
    for k in range(BINS):
        after = before + counts.get(k, 0)
        first.append(before // each)
        parts.append(max(after - 1, before) // each - before // each + 1)
        before = after

    def table(values: list[int]) -> Column:  # folded into one constant
        return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), at + 1).cast("int")

    inside = F.least(F.floor((place - at) * table(parts)), table(parts) - 1)
    nameless = parts_of(n - known)

    def shard(digest: Column) -> Column:
        own = parts_of(known) + F.pmod(F.crc32(digest), F.lit(nameless))
        return F.when(F.col("page_id").isNull(), own).otherwise(table(first) + inside).cast("int")

    return shard, parts_of(known) + nameless


def _sorted_rows(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages in id order by shard, each after the row that names the response of its payload."""
    sized = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    narrow = sized.select(
        "page_id", F.sha1(F.col("html").cast("binary")).alias("hash"), F.octet_length("html").alias("n")
    ).filter(F.col("n") >= min_bytes).groupBy("page_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min_by("page_id", F.struct(F.col("page_id").isNotNull(), F.col("page_id")))
    groups = narrow.groupBy("hash").agg(first.alias("first"), F.sum("rows").alias("all")).filter("all > 1").drop("all")
    roles = narrow.join(groups, "hash").select(
        "page_id", F.lit(0).alias("kind"), "hash", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"), "first",
    )
    data = sized.select(
        "page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("hash"), "url", "html",
        F.lit(None).cast("bigint").alias("first"),
    )
    shard, shards = _shard(sized)
    digest = F.when(F.col("page_id").isNull(), F.sha1(F.col("html").cast("binary")))
    both = roles.withColumn("shard", shard(F.col("hash"))).unionByName(data.withColumn("shard", shard(digest)))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html")


def write(pages: DataFrame, target: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20, min_bytes: int = 0) -> dict:
    """Write ``page_id``, ``url`` and ``html`` as archives under ``target``; the manifest."""
    spark = pages.sparkSession

    def run(batches):
        shard, number, size, order = None, 0, 0, 0
        at, roles, seen = object(), {}, set()
        for batch in batches:
            names, seqs, members = [], [], []
            for page, kind, hash_, url, html, first, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != shard:
                    shard, number, size, at = of, 0, 0, object()
                if page != at:
                    at, roles, seen = page, {}, set()
                if kind == 0:
                    roles[hash_] = first
                    continue
                payload = html.encode()
                raw = hashlib.sha1(payload)
                known = raw.hexdigest()
                revisit = known in roles and (roles[known] != page or known in seen)
                seen.add(known)
                digest = base64.b32encode(raw.digest()).decode()
                member = _member(_record(page, url, payload, digest, roles.get(known), revisit, date))
                if size and size + len(member) > roll_bytes:
                    number, size = number + 1, 0
                size, order = size + len(member), order + 1
                names.append(f"{shard:06d}-{number:05d}")
                seqs.append(order)
                members.append(member[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(members, pa.binary())],
                ["file", "seq", "member"],
            )

    rows = _sorted_rows(pages, min_bytes).mapInArrow(run, "file string, seq long, member binary")
    waiting = f"{target.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    # Files stay in order: rows arrive sorted by file and seq, which the writer asks for.
    rows.sortWithinPartitions("file", "seq").select("file", F.col("member").cast("string").alias("value")).write.partitionBy(
        "file"
    ).option("lineSep", "\0").text(waiting)
    return _commit(spark, waiting, target.rstrip("/"))


def _commit(spark: SparkSession, waiting: str, target: str) -> dict:
    """Rename every file to its final name, then write the manifest."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    files = []
    for folder in fs.listStatus(path(waiting)):
        name = folder.getPath().getName()
        if not name.startswith("file="):
            continue
        parts = [p for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{name} has {len(parts)} parts")
        final = f"pages-{name.removeprefix('file=')}.warc.gz"
        if not fs.rename(parts[0].getPath(), path(f"{target}/{final}")):
            raise RuntimeError(f"cannot rename to {final}")
        files.append({"name": final, "bytes": parts[0].getLen()})
    fs.delete(path(waiting), True)
    manifest = {"files": sorted(files, key=lambda f: f["name"])}
    part = path(f"{target}/_{MANIFEST}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.rename(part, path(f"{target}/{MANIFEST}"))
    return manifest


def _records(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every record of an archive, member by member."""
    at = memoryview(raw)
    while len(at):
        unpack = zlib.decompressobj(31)
        record = unpack.decompress(at)
        if not unpack.eof:
            raise ValueError("the archive ends inside a record")
        at = at[len(at) - len(unpack.unused_data):]
        if not record:
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block):] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        yield fields, block


def read(spark: SparkSession, target: str, payloads: bool = False) -> DataFrame:
    """Records of a committed folder: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, on request, the payload of responses.

    A file of the manifest that is missing or has another size is an error.
    """
    target = target.rstrip("/")
    listed = json.loads(spark.read.text(f"{target}/{MANIFEST}", wholetext=True).first()[0])["files"]
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
    if not listed:
        return spark.createDataFrame([], schema).drop(*[] if payloads else ["payload"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(target)
    found = {f: n for f, n in files.select(F.element_at(F.split("path", "/"), -1), "length").collect()}
    if found != {f["name"]: f["bytes"] for f in listed}:
        raise ValueError("the archives differ from the manifest")

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for fields, block in _records(raw.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    page, other = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id", "")
                    rows.append((
                        int(page) if page else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"],
                        int(other) if other else None, None if revisit or not payloads else payload,
                    ))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    got = files.select("content").mapInArrow(run, schema)
    return got if payloads else got.drop("payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
    )
