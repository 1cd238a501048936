"""WARC archives: a distributed writer with revisit records, and a sequential reader.

Archives hold one gzip member for each record. The reader decompresses incrementally,
frames records by their content length, and verifies block and payload digests, so it
needs memory for one record only. Writers give each archive a name of its own attempt and
report it; only reported archives are read, so what a lost task leaves behind doesn't
count. Archives lie in the folder that driver and executors share and are opened through
``pyarrow.fs``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import scratch, settle, ship

#: Compressed bytes after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes that the reader takes in at once.
READ_BYTES = 1 << 18
#: Decompressed bytes that are taken at once, and the longest header.
PIECE_BYTES, HEADER_BYTES = 1 << 20, 1 << 20
_END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return _base32(hashlib.sha1(data))


def _base32(sha: hashlib._Hash) -> str:
    return base64.b32encode(sha.digest()).decode()


@dataclass
class Record:
    """One record: version line, named fields in order, and the block."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def payload(self) -> bytes:
        """The block without the HTTP header of a response; of other records the whole block."""
        if self.fields.get("WARC-Type") not in ("response", "revisit"):
            return self.block
        head, found, body = self.block.partition(_END)
        return body if found else b""

    def http(self) -> dict[str, str]:
        head = self.block.partition(_END)[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}


def member(record: Record, level: int = 1) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in record.fields.items())
    raw = b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(record.block)}\r\n\r\n".encode() + record.block + _END
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


class DamagedArchive(ValueError):
    """An archive that ends early, or whose framing or digests don't hold."""


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """Decompressed pieces, with an empty one after each gzip member."""
    inflate, open_member = zlib.decompressobj(31), False
    while chunk := stream.read(READ_BYTES):
        full = False  # more may be held back
        while chunk or full:
            open_member = True
            try:
                out = inflate.decompress(chunk, PIECE_BYTES)
            except zlib.error as e:
                raise DamagedArchive(str(e)) from e
            if out:
                yield out
            full = len(out) == PIECE_BYTES
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                yield b""
                chunk, full = inflate.unused_data, False
                inflate, open_member = zlib.decompressobj(31), False
    if open_member:
        raise DamagedArchive("the archive ends within a member")


def read_records(stream: BinaryIO, verify: bool = True) -> Iterator[Record]:
    """The records of an archive, in order, each decompressed as it is needed.

    Raises DamagedArchive if a record is cut short, its length doesn't frame it, or (with
    ``verify``) a stated digest isn't that of the block, or of a response's payload.
    """
    pieces = _members(stream)
    for piece in pieces:
        fields, block, sha = _framed(piece, pieces)
        record = Record(fields, bytes(block))
        if verify:
            stated = {name: fields[name].removeprefix("sha1:") for name in ("WARC-Block-Digest", "WARC-Payload-Digest") if name in fields}
            if stated.get("WARC-Block-Digest") not in (None, _base32(sha)):
                raise DamagedArchive("WARC-Block-Digest doesn't hold")
            if "WARC-Payload-Digest" in stated and fields.get("WARC-Type") != "revisit" and stated["WARC-Payload-Digest"] != digest(record.payload()):
                raise DamagedArchive("WARC-Payload-Digest doesn't hold")
        yield record


def _framed(piece: bytes, pieces: Iterator[bytes]) -> tuple[dict[str, str], bytearray, hashlib._Hash]:
    """Fields and block of the record of one member, and the digest of the block, fed as it is read.

    The header is taken as soon as it is whole; then exactly as many bytes as it states,
    behind which only the end of the record may come.
    """
    held = bytearray(piece)
    while (at := held.find(_END)) < 0:
        if len(held) > HEADER_BYTES or not piece:
            raise DamagedArchive("a member doesn't begin with a record header")
        piece = next(pieces, b"")
        held += piece
    lines = held[:at].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise DamagedArchive("a member doesn't begin with a record header")
    fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        length = int(fields.pop("Content-Length"))
    except (KeyError, ValueError) as e:
        raise DamagedArchive("a record without a content length") from e
    del held[: at + len(_END)]
    sha, fed = hashlib.sha1(), 0
    while True:
        end = min(len(held), max(0, length))
        if end > fed:
            with memoryview(held) as view:
                sha.update(view[fed:end])
            fed = end
        if not piece or len(held) > length + len(_END):
            break
        piece = next(pieces, b"")
        held += piece
    if piece or length < 0 or len(held) != length + len(_END) or not held.endswith(_END):
        raise DamagedArchive("a record's length doesn't frame it")
    del held[length:]
    return fields, held, sha


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, size, refers_to) of the pages whose payload a page with a larger id has as well.

    Payloads of fewer than ``min_bytes`` bytes are never revisits. Only digests are
    shuffled: they are counted before the exchange, and the join of the pages that share
    a digest is left to adaptive execution, which splits a digest with very many pages.
    """
    body = F.coalesce("html", F.lit(""))
    known = pages.where(F.col("page_id").isNotNull() & (F.octet_length(body) >= min_bytes)).select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    shared = known.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    return known.join(shared, ["sha", "size"]).where("page_id < refers_to").select("page_id", "sha", "size", "refers_to").dropDuplicates(["page_id", "sha", "size"])


def _record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> Record:
    payload = (html or "").encode()
    own = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    block = head if refers_to is not None else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}
    return Record(fields, block)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page into archives in ``folder``; returns (path, records, bytes) of the archives.

    ``pages`` has page_id, url and html (null: an empty payload). Of records with equal
    payloads of at least ``min_bytes`` bytes the one with the largest page_id is a
    response and the others are revisits of it. Rows that repeat the largest page_id are
    all responses; rows that repeat another page_id are judged by their own payloads; rows
    without a page_id are responses. Extra columns aren't looked at.
    An empty table writes no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    # a page_id may occur with several payloads
    tied = keyed.join(revisits(pages, min_bytes), ["page_id", "sha", "size"], "left").drop("sha", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        paths, counts, sizes = [], [], []
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    paths.append(f"{folder}/{name}"), counts.append(0), sizes.append(0)
                packed = member(_record(*row))
                out.write(packed)
                counts[-1] += 1
                sizes[-1] += len(packed)
                if sizes[-1] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return settle(tied.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(archives: DataFrame, verify: bool = True) -> DataFrame:
    """The records of archives, given as a table of ``path``, one after another.

    Returns (record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to,
    payload). Digest and bytes are those of the full payload: for a response they are
    computed from what was read, for a revisit they are stated by the record, whose payload
    is null. An archive that is damaged, or holds other than the stated number of
    ``records`` (where the table has them), fails the job.
    """
    spark: SparkSession = archives.sparkSession
    ship(spark)
    counted = "records" in archives.columns
    wanted = archives.select("path", F.col("records") if counted else F.lit(-1).cast("long").alias("records"))
    ddl = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split(" ") for x in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, stated in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream, verify):
                        f, again = record.fields, record.fields["WARC-Type"] == "revisit"
                        payload = None if again else record.payload()
                        size = int(record.http().get("content-length", 0)) if again else len(payload)
                        own = f["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest(payload)
                        rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), own, size, f.get("WARC-Refers-To"), payload))
                        held += len(payload or b"")
                        seen += 1
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if stated not in (-1, seen):
                    raise DamagedArchive(f"{path} has {seen} records of {stated}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # one archive a task, dealt in turn: a sequential read can't be split
    files = max(1, wanted.count())
    return wanted.repartition(min(files, 100_000)).mapInArrow(run, ddl)


def _page(name: str) -> F.Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write(pages, scratch(pages.sparkSession, "warc"), min_bytes)
    back = read(archives)
    return back.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUINTETS = " || ".join(
    f"substr('{_LETTERS}', ((('0x' || substr(sha, {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
#: The same rows by DuckDB; base32 is made of groups of five hexadecimal digits.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, strlen(body) AS payload_bytes, {_QUINTETS} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""
