"""A deterministic, sharded WARC writer and its reader.

Pages are dealt to shards by exact ranges of page_id, sorted in each shard and written as one gzip member a
record; a file that reaches the roll size is followed by the next. Headers and digests are generated from the
row, with a fixed date, so the same rows give the same bytes however Spark deals them. Payloads that
repeat become revisit records of the page with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import files
from lynceus.llm.common import lookup, new_folder, table
from lynceus.llm.sharding import range_bounds, shard_column

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "tmp string, name string, shard int, part int, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _target(url: str | None) -> str | None:
    """A header's value can't hold control characters; they are percent-encoded, as is a percent sign before 0 or 1."""
    return None if url is None else re.sub(r"[\x00-\x1f\x7f]|%(?=[01]|7F)", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _uri(refers_to, digest) if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ])
    return head + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip with no time or name
    return z.compress(data) + z.flush()


class _Roller:
    """Writes one shard's files and keeps their manifest rows."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.root, self.shard, self.roll, self.out, self.rows = root, shard, roll_bytes, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.row = {"tmp": files.temporary(self.root), "name": f"pages-{self.shard:06d}-{len(self.rows):05d}.warc.gz", "shard": self.shard, "part": len(self.rows), "records": 0, "bytes": 0}
            self.out, self.sha = files.create(self.row["tmp"]), hashlib.sha1()
            info = b"software: lynceus\r\nformat: WARC File Format 1.1\r\n"
            self._write(_member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.row['name']}>"), ("WARC-Date", DATE), ("WARC-Filename", self.row["name"]), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
        self._write(_member(data))
        self.row["records"] += 1
        if self.row["bytes"] >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.row["bytes"] += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append(self.row | {"sha1": self.sha.hexdigest()})
            self.out = None


def _writer(root: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, first = None, (None, None, None)
        for batch in batches:
            done: list[dict] = []
            for r in zip(*(batch.column(c) for c in ("shard", "page_id", "digest", "first_id", "url", "html")), strict=True):
                shard, page_id, digest, first_id, url, html = (x.as_py() for x in r)
                if html is None:  # says which page holds the payload, and comes before the pages it is about
                    first = (page_id, digest, first_id)
                    continue
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.rows
                    roller = _Roller(root, shard, roll_bytes)
                big = first[:2] == (page_id, digest)
                holder = first[2] if big else page_id
                roller.add(record(page_id, url, html, holder, big and holder != page_id))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_manifest_schema())
        if roller:
            roller.close()
            if roller.rows:
                yield pa.RecordBatch.from_pylist(roller.rows, schema=_manifest_schema())

    return write


def _manifest_schema() -> pa.Schema:
    return pa.schema([("tmp", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 64 << 20, min_bytes: int = 0, rows_per_shard: int | None = None) -> dict:
    """Writes pages (page_id, url, html; other columns are ignored) as WARC files under root; returns the manifest.

    Among pages with equal payloads of at least min_bytes bytes the smallest page_id is a response and the
    others revisit it. Null html is an empty payload, a null url gives a record without a target, and rows
    with a null page_id come first; a null id never holds a payload for a page that has an id. Rows that repeat a page_id and
    its payload are written alike. An empty table gives a manifest without files. A shard has rows_per_shard
    rows (by default a 64th of all, 500 to 20,000). The driver holds one manifest row for each file.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = table(rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest"), "warc-keys")
    holders = table(keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "warc-holders")
    about = lookup(keys, holders, "digest", F.xxhash64("page_id")).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "first_id")
    n = pages.count()
    bounds = range_bounds(pages, "page_id", rows_per_shard or max(500, min(20_000, n // 64)))
    dealt = (
        rows.select("page_id", "url", F.encode("html", "utf-8").alias("html"), "digest", F.lit(None).cast("long").alias("first_id"))
        .unionByName(about)
        .withColumn("shard", shard_column(bounds, "page_id"))
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")
    )
    written = table(dealt.mapInArrow(_writer(root, roll_bytes), MANIFEST), "warc-manifest")
    entries = [r.asDict() for r in written.orderBy("shard", "part").collect()]
    return files.commit(root, entries, records=sum(e["records"] for e in entries))


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed."""
    data = stream.read(chunk)
    while data:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("the file ends inside a record")
            out.append(z.decompress(data))
            data = z.unused_data or stream.read(chunk)
        yield b"".join(out)


def parse(data: bytes) -> dict | None:
    """What a record says, after a check of its digests; None for a warcinfo record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"] or not revisit and (len(payload), base32_sha1(payload)) != (length, digest):
        raise ValueError(f"digest mismatch in {fields['WARC-Record-ID']}")
    page = lambda k: None if (x := fields[k].split(":")[2]) == "null" else int(x)
    url = fields.get("WARC-Target-URI")
    url = url and re.sub("%(0[0-9A-F]|1[0-9A-F]|7F|25(?=0|1|7F))", lambda m: chr(int(m[1], 16)), url)
    return {"page_id": page("WARC-Record-ID"), "url": url, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload}


def _reader(payloads: bool, batch_bytes: int = 8 << 20):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                s, path = files.store(uri)
                rows, held = [], 0
                with s.open_input_stream(path, compression=None) as f:
                    for data in _members(f):
                        if r := parse(data):
                            rows.append(r if payloads else r | {"payload": None})
                            held += 200 + len(data) * payloads
                        if held > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest under root lists; digests are checked on the way."""
    names = [(f"{root}/{e['name']}",) for e in files.resume(root)["files"]]
    listed = spark.createDataFrame(names, "uri string").repartition(max(1, len(names)))
    return listed.mapInArrow(_reader(payloads), RECORDS)


def archive(pages: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Writes pages under root (by default a new folder in the shared one) and reads the archives back."""
    root = root or new_folder(pages.sparkSession, "warc")
    write_warc(pages, root, **options)
    return read_warc(pages.sparkSession, root, payloads=False)
