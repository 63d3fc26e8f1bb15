"""WARC archives: writing, and a reader that salvages what damaged files still hold.

Archives are files of gzip members, one record each, next to each other; the
reader also takes uncompressed records. It reads a file record by record and
checks each one: the member's checksum, the version line, the header, the block
length and the declared block and payload digests (SHA-1 and SHA-256; others are
not known here). Where a check fails, it searches the following bytes for the
next member or version line that passes, goes on from there, and logs the bytes
between as a quarantined gap. A member may hold several records, also one that is
cut or broken: those that pass are read, the rest of the member is a gap. Files come from Spark's binary
reader, one row each, and are written by tasks to a folder that all share.

Results for odd input: a null payload counts as empty; an empty one is a record
with an empty block; null keys get a record each with no identifier in common;
rows that repeat a key give a record each; a very long payload is one record, and
is held as a whole where it is written and read; an empty table gives no archive
and reads back as an empty table; other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import sha256_hex, text_or_empty
from veilspark.session import shared_dir, ship_package

LEAST_SHARED = 100
"""Payload bytes from which a repeated payload becomes a revisit."""
ARCHIVE_BYTES = 8 << 20
"""Compressed size at which a writing task begins a new archive; the reader holds one archive at a time."""

# The format's names.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ADDRESS = "urn:page:"
HTTP_HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_STEP = 1 << 16


@dataclass
class Record:
    """``start`` and ``end``: the bytes of the file that the record takes, or those of its member if that holds more."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    """A check failed."""


def sha256_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _differs(declared: str, data: bytes) -> bool:
    """Whether ``declared`` (algorithm:value, base32 or hex) is a known digest and not that of ``data``."""
    name, _, value = declared.partition(":")
    make = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256}.get(name.strip().lower())
    if not make:
        return False
    digest, value = make(data).digest(), value.strip()
    return value.rstrip("=").upper() != base64.b32encode(digest).decode().rstrip("=") and value.lower() != digest.hex()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    named = headers | {"WARC-Block-Digest": "sha256:" + sha256_base32(block), "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in named.items())]
    return b"\r\n".join(lines) + _END + block + _END


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _parsed(data, at: int) -> Record:
    """The record that begins at ``at`` of uncompressed bytes."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    stop = data.find(_END, at)
    if stop < 0:
        raise Damaged("header without an end")
    headers: dict[str, str] = {}
    for raw in bytes(data[line.end(): stop]).split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no block length")
    begin = stop + len(_END)
    end = begin + int(length)
    if data[end: end + 4] != _END:
        raise Damaged("block does not end where it should")
    block = bytes(data[begin:end])
    record = Record(headers, block, at, end + 4)
    if _differs(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    # A revisit declares the digest of a payload that it does not hold; a segment that of the whole payload.
    whole = headers.get("warc-type", "").lower() not in ("revisit", "continuation") and "warc-segment-number" not in headers
    whole &= _END in block or not headers.get("content-type", "").startswith("application/http")  # else where it begins is unclear
    if whole and _differs(headers.get("warc-payload-digest", ""), payload_of(record)):
        raise Damaged("payload digest differs")
    return record


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Of the member at ``at``: what it yields, its end, and what is wrong with it or ''."""
    unpack = zlib.decompressobj(31)
    plain = bytearray()
    place = at
    try:
        while place < len(data) and not unpack.eof:
            plain += unpack.decompress(data[place: place + _STEP])
            place += _STEP
    except zlib.error:
        # Byte by byte from the start of this step, so that nothing before the damage is lost.
        unpack, plain = zlib.decompressobj(31), bytearray()
        try:
            plain += unpack.decompress(data[at: place])
            for i in range(place, len(data)):
                plain += unpack.decompress(data[i: i + 1])
        except zlib.error:
            pass
        return bytes(plain), len(data), "member is broken"
    if not unpack.eof:
        return bytes(plain), len(data), "member is cut off"
    return bytes(plain), min(place, len(data)) - len(unpack.unused_data), ""


def _found_at(data: bytes, at: int, partial: bool) -> tuple[list[Record], int, str]:
    """The records at ``at`` (one, or those of a gzip member), where to go on, and why the rest of the member is a gap."""
    if data[at: at + 3] != _MEMBER:
        record = _parsed(data, at)
        return [record], record.end, ""
    plain, end, wrong = _unpacked(data, at)
    inside = list(salvage(plain, partial)) if plain[:3] != _MEMBER else []
    records = [Record(x.headers, x.block, at, end) for x in inside if isinstance(x, Record)]
    bad = next((x.reason for x in inside if isinstance(x, Gap)), "" if inside else "member without a record")
    if not records or ((wrong or bad) and not partial):
        raise Damaged(wrong or bad)
    if wrong:  # where a broken member ends is not known: the search goes on behind its first bytes
        end = _next_start(data, at + 1)
        for x in records:
            x.end = end
    return records, end, wrong or bad


def _next_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a member or a version line may begin, or the end."""
    member_at = data.find(_MEMBER, at)
    line = _VERSION_LINE.search(data, at)
    found = [x for x in (member_at, line.start() if line else -1) if x >= 0]
    return min(found, default=len(data))


def salvage(data: bytes, partial: bool = True) -> Iterator[Record | Gap]:
    """All records of an archive that pass their checks, in order, and the gaps between them.

    Of a member that is not good as a whole come its good records, and a gap with the
    member's place follows them; without ``partial`` such a member is only a gap.
    """
    at = 0
    gap: Gap | None = None
    while at < len(data):
        try:
            records, end, rest = _found_at(data, at, partial)
        except Damaged as e:
            gap = gap or Gap(at, at, str(e))
            at = _next_start(data, at + 1)
            continue
        if gap:
            gap.end = at
            yield gap
        yield from records
        gap = Gap(at, end, rest) if rest else None
        at = end
    if gap:
        gap.end = len(data)
        yield gap


_RECORD = (
    "file string, start long, end long, gap string, type string, id string, address string, refers_to string, "
    "digest string, payload binary"
)


def payload_of(record: Record) -> bytes:
    """What follows the HTTP header of a stored response; other blocks are their own payload."""
    if record.headers.get("content-type", "").startswith("application/http"):
        return record.block.partition(_END)[2]
    return record.block


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Records and gaps of archives, given as Spark's binary reader gives them (path, content).

    A gap has its place and reason and no other fields. ``address`` and ``refers_to`` are
    target addresses, ``digest`` is the payload digest as declared.
    """
    ship_package(spark)
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]

    def run(batches):
        for batch in batches:
            for path, content in zip(*(batch.column(i) for i in range(2)), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py() or b"", partial=True):
                    if isinstance(x, Gap):
                        rows.append((path.as_py(), x.start, x.end, x.reason, *[None] * 6))
                    else:
                        h = x.headers
                        rows.append((
                            path.as_py(), x.start, x.end, None, h.get("warc-type"), h.get("warc-record-id"),
                            h.get("warc-target-uri"), h.get("warc-refers-to-target-uri"),
                            h.get("warc-payload-digest"), payload_of(x),
                        ))
                        size += len(x.block)
                    if size > ARCHIVE_BYTES:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, types)

    return files.select("path", "content").mapInArrow(run, _RECORD)


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
    )


def archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The files below ``folder`` that the ``manifest`` (path) lists, so none of a task that was lost half-way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.withColumn("name", name).join(manifest.select("name").distinct(), "name", "left_semi")


def with_originals(pages: DataFrame, key: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """key, payload, digest (hex SHA-256 of the payload), first: the least key that has an equal payload.

    Payloads of fewer than ``least`` bytes are all first of their own. Keys per
    digest are pre-aggregated; digests that do not repeat are not joined.
    """
    body = text_or_empty(payload)
    rows = pages.select(F.col(key).alias("key"), body.alias("payload"), sha256_hex(body).alias("digest"))
    long_enough = F.octet_length("payload") >= least
    repeated = (
        rows.where(long_enough).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("shared"), "first")
    )
    own = F.concat(F.col("digest"), F.lit("-"), F.xxhash64("key").cast("string"))
    return (
        rows.withColumn("shared", F.when(long_enough, F.col("digest")).otherwise(own))
        .join(repeated, "shared", "left").select("key", "payload", "digest", F.coalesce("first", "key").alias("first"))
    )


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write (key, payload, digest, first) as archives below ``folder``; returns the manifest (name, records).

    Each task writes its own files under names that no other attempt uses, and
    lists them in the manifest only when they are complete.
    """
    spark = records.sparkSession
    ship_package(spark)
    spec = "name string, records long"

    def run(batches):
        from pyarrow import fs

        out, root = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
        out.create_dir(f"{root}/archives", recursive=True)
        done, held, size = [], [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with out.open_output_stream(f"{root}/archives/{name}", compression=None) as f:
                f.write(b"".join(held))
            done.append((name, len(held)))

        for batch in batches:
            for key, payload, digest, first in zip(*(c for c in batch.columns), strict=True):
                data = member(page_record(key.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), first.as_py()))
                held.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["name", "records"])

    path = f"{folder}/manifest"
    records.select("key", "payload", "digest", "first").mapInArrow(run, spec).write.parquet(path)
    return spark.read.schema(spec).parquet(path)


def address(key) -> str:
    return f"{ADDRESS}{'' if key is None else key}"


def page_record(key, payload: bytes, digest: str, first) -> bytes:
    """A response with the payload, or a revisit of the page ``first`` without it."""
    revisit = first is not None and first != key
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": address(key),
        "WARC-Payload-Digest": "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode().rstrip("="),
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        headers |= {"WARC-Refers-To-Target-URI": address(first), "WARC-Profile": REVISIT_PROFILE}
    return record_bytes(headers, HTTP_HEADER + (b"" if revisit else payload))


def digested(records: DataFrame) -> DataFrame:
    """Records with the payload's length and hex SHA-256 in its place."""
    return records.select(
        *[c for c in records.columns if c != "payload"], F.octet_length("payload").cast("long").alias("bytes"),
        F.sha2("payload", 256).alias("sha"),
    )


def pages_of(records: DataFrame) -> DataFrame:
    """Of digested records: address, type, refers_to, bytes and digest (hex) of every page's full payload.

    A revisit's are those of the response that it refers to.
    """
    own = records.where("gap IS NULL").select("address", "type", "refers_to", "bytes", "sha")
    responses = own.where("type = 'response'")
    originals = responses.groupBy(F.col("address").alias("refers_to")).agg(F.max(F.struct("bytes", "sha")).alias("o"))
    revisits = own.where("type = 'revisit'").select("address", "type", "refers_to").join(originals, "refers_to", "left")
    return responses.union(revisits.select("address", "type", "refers_to", "o.bytes", "o.sha"))


def fresh_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "warc")
