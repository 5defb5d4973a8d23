"""WARC archives: a writer with one gzip member per record, and a sequential reader that checks what it reads.

Archives are files of the shared folder, `pages-*.warc.gz`, that any WARC tool opens. Spark's text writer puts them
there: a row is an archive, a file holds one row, and the line end is the zero byte in which every archive ends (the
high byte of its closing record's length). The first record of an archive names it, the last tells how many pages it has.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffles_removed, with_owners, written

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 100
#: An archive is closed once it holds so many bytes; with the last record it is somewhat longer.
ARCHIVE_BYTES = 8 << 20
CHUNK = 64 << 10
#: The byte that an archive ends in: a gzip member ends in its length, and the closing one is short.
END = b"\x00"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs (RFC 4122)


class WarcError(ValueError):
    """An archive that does not keep to the format, or whose digests do not fit its bytes."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers and the payload of a captured response."""
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark:
            raise WarcError("an HTTP head without an end")
        lines = head.decode().split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(record: Record) -> bytes:
    """The record as one gzip member."""
    named = {"WARC-Type": record.kind, **record.headers, "WARC-Block-Digest": f"sha256:{sha256(record.block)}", "Content-Length": str(len(record.block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + record.block + b"\r\n\r\n") + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What each gzip member of a stream holds; only one member is in memory."""
    unpacker, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            try:
                parts.append(unpacker.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            chunk = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the archive ends within a gzip member")


def decode(data: bytes) -> Record:
    """The one record of a member, by its Content-Length and with its block digest checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC head")
    headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        length = int(headers.pop("Content-Length"))
        kind = headers.pop("WARC-Type")
    except (KeyError, ValueError) as e:
        raise WarcError(f"a head without a good {e}") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the member")
    if (said := headers.get("WARC-Block-Digest")) and said != f"sha256:{sha256(block)}":
        raise WarcError("the block does not have its digest")
    return Record(kind, headers, block)


def read(chunks: Iterable[bytes]) -> Iterator[Record]:
    for data in members(chunks):
        record = decode(data)
        said = record.headers.get("WARC-Payload-Digest")
        if record.kind in ("response", "revisit") and said is None:
            raise WarcError(f"a {record.kind} without a payload digest")
        if record.kind == "response" and said != f"sha256:{sha256(record.http[1])}":
            raise WarcError("the payload does not have its digest")
        yield record


def _urn(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{page_id}/{digest}').urn}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Record:
    """A response, or a revisit of page `refers_to`, whose block has the HTTP head alone."""
    digest = sha256(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": _urn(page_id, digest), "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if refers_to is None:
        return Record("response", headers, http + payload)
    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    return Record("revisit", headers, http)


def _name(part: int, number: int) -> str:
    return f"pages-{part:05d}-{number:05d}.warc.gz"


def _write(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    part, number, held, used = TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        name = _name(part, number)
        ident = lambda what: {"WARC-Record-ID": f"<{uuid.uuid5(_SPACE, what).urn}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
        first = encode(Record("warcinfo", {**ident(name), "WARC-Filename": name}, b"format: WARC File Format 1.1\r\n"))
        last = encode(Record("metadata", ident(f"{name}/end"), f"pages: {len(held)}\r\n".encode()))
        data = b"".join([first, *held, last])
        if data[-1:] != END:
            raise WarcError("the closing record is too long")
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["data"])

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                held.append(encode(page_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])))
                used += len(held[-1])
                if used >= archive_bytes:
                    yield close()
                    number, held, used = number + 1, [], 0
    if held:
        yield close()


_FIELDS = {
    "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "archive": pa.string(),
    "record": pa.string(), "of_record": pa.string(),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            view = memoryview(data.as_buffer())
            rows: list[tuple] = []
            pages, kinds = None, []
            for r in read(view[at : at + CHUNK] for at in range(0, len(view), CHUNK)):
                kinds.append(r.kind)
                if r.kind in ("response", "revisit"):
                    http, payload = r.http
                    number = lambda k, h=r.headers: int(h[k]) if k in h else None
                    size = len(payload) if r.kind == "response" else int(http["content-length"])
                    found = (number("X-Page-Id"), size, r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), r.kind, number("X-Refers-To-Page-Id"), r.headers.get("WARC-Target-URI"))
                    rows.append((*found, name.as_py().rpartition("/")[2], r.headers["WARC-Record-ID"], r.headers.get("WARC-Refers-To")))
                elif r.kind == "metadata":
                    pages = int(r.block.removeprefix(b"pages: "))
            if kinds[:1] != ["warcinfo"] or pages != len(rows):
                raise WarcError(f"{name} is not whole: {len(rows)} pages of {pages}")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], list(_FIELDS))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes the archives of a pages table (page_id, url, html) to a new folder of the shared one, whose path it gives.

    Of records with equal payloads of at least MIN_REVISIT_BYTES, that with the smallest page_id is the response. Null
    html is an empty payload; payloads of any length are written whole. Rows with a null page_id, or that repeat the
    response's page_id and payload, are responses too. An empty table gives an empty folder; further columns are not
    looked at.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha2(body, 256).alias("digest")
    digests = rows.filter(F.octet_length(body) >= MIN_REVISIT_BYTES).select("page_id", digest)
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = with_owners(digests, written(first, "first"), "digest", "n", "page_id").drop("n").filter("page_id <> refers_to").distinct()
    marked = rows.select("*", digest).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    archives = marked.mapInArrow(lambda batches: _write(batches, archive_bytes), "data binary")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        archives.select(F.col("data").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)
    # the files get the names that stand in them; only names change
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(hadoop(path)):
        if found := re.match(r"part-(\d+)-.*-c(\d+)\.txt$", status.getPath().getName()):
            fs.rename(status.getPath(), hadoop(f"{path}/{_name(int(found[1]), int(found[2]))}"))
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record of the archives (*.warc.gz) of a folder: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url, archive.

    Every archive is read from its first byte to its last, and every digest is checked: those of blocks and payloads
    against the bytes, that of a revisit against the response it refers to. An archive that is broken or cut off, and a
    revisit whose response is missing or has another payload, raise an error. An empty folder gives no rows.
    """
    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS.items())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    rows = written(files.mapInArrow(_read, schema), "records")
    responses = rows.filter("record_type = 'response'").select(F.col("record").alias("of_record"), F.col("payload_digest").alias("said"), F.col("payload_bytes").alias("size")).distinct()
    revisits = rows.filter("record_type = 'revisit'").join(responses, "of_record", "left")
    whole = (F.col("said") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("a revisit without its response: "), "record"))
    checked = revisits.withColumn("payload_digest", F.when(F.coalesce(whole, F.lit(False)), F.col("payload_digest")).otherwise(wrong.cast("string")))
    columns = [n for n in _FIELDS if n not in ("record", "of_record")]
    return rows.filter("record_type = 'response'").select(columns).union(checked.select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """A pages table (page_id, url, html) written to archives and read back.

    Null html is an empty payload; a null url gives no target URI. A null page_id gives a response without page_id
    that others never refer to. Rows that repeat the response's page_id and payload are responses too. An empty table
    gives no archive and no rows.
    """
    return read_archives(pages.sparkSession, write_archives(pages))
