"""WARC archives: writing, normalising and reading.

Crawlers often leave an archive that is one gzip stream over all its records, so no record can be read
without inflating everything before it. The normaliser inflates such a stream once, rewrites every record
as a gzip member of its own, and writes a sidecar with each member's place, after which any record is one
seek away. On the way it turns repeats of a payload into revisit records.

Archives are bounded in size and are the unit of work: a task streams one archive with one record in
memory. Files are written under a name of their attempt and renamed when whole, so a task that runs again
replaces its file with the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import utf8_rows
from .common import materialise, new_path

#: Uncompressed size at which a writer starts the next archive.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are never turned into revisits.
LEAST_REVISIT = 0
_READ = 1 << 20


def _fs(path: str):
    """(file system, path in it). Any store that pyarrow knows: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Output:
    """A file that takes its name when closed whole."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.own = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.own, self.final)
        except OSError:  # some stores do not rename onto an existing file: an earlier attempt was complete
            self.fs.delete_file(self.own)


def base32_sha1(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{key}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def response_record(key: object, url: str | None, payload: bytes | memoryview, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Row-Key", "" if key is None else str(key)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def revisit_record(head: dict[str, str], block: bytes, first: object) -> bytes:
    """A revisit of ``first`` in place of a response: its HTTP header stays, its payload goes."""
    http = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    new = {k: v for k, v in head.items() if k.lower() not in ("warc-type", "content-length")}
    new = {"WARC-Type": "revisit"} | new | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first), "X-Refers-To-Key": str(first), "X-Payload-Length": str(len(block) - len(http)), "Content-Length": str(len(http))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in new.items()).encode() + b"\r\n" + http + b"\r\n\r\n"


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, each read once."""
    z = zlib.decompressobj(31)
    fed = False
    while data := stream.read(_READ):
        while data:
            if z.eof:
                z, fed = zlib.decompressobj(31), False
            fed = True
            part = z.decompress(data, _READ)
            if part:
                yield part
            data = z.unconsumed_tail or z.unused_data
    while fed and not z.eof:
        part = z.decompress(z.unconsumed_tail, _READ)
        if not part:
            raise ValueError("the gzip stream ends early")
        yield part


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an inflated WARC stream. Raises ValueError if it ends within one."""
    buf = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        buf.extend(part)
        return True

    while True:
        while buf[:2] == b"\r\n":
            del buf[:2]
        looked = 0
        while (end := buf.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(buf)
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends within a header")
                return
            while not looked and buf[:2] == b"\r\n":
                del buf[:2]
        lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(next(v for k, v in head.items() if k.lower() == "content-length"))
        while len(buf) < end + 4 + size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buf[end + 4 : end + 4 + size])
        del buf[: end + 4 + size]


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a response record for every row, each archive one gzip stream. Returns (archive, seq, id, digest, n_bytes).

    The payload is the column in UTF-8, nothing for null. What is returned is written too: reading it again does
    not write archives again. An archive's name has the number of the attempt that wrote it, so its rows always tell of
    that very file, in order, even if another attempt is dealt other rows; files of attempts that failed are named nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, number, out, z, size, seq = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, None, 0, 0
        for b in batches:
            rows: list[tuple] = []
            for key, url, view in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8_rows(b.column(2)), strict=True):
                if out is None:
                    name = f"part-{part}-{number:04d}.warc.gz"
                    out, z, size, seq = _Output(folder, name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                digest = base32_sha1(view)
                rec = response_record(key, url, view, digest)
                out.write(z.compress(rec))
                rows.append((name, seq, key, digest, len(view)))
                size, seq = size + len(rec), seq + 1
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out, number = None, number + 1
            names, seqs, keys, digests, sizes = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(keys, b.schema.field(0).type), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "seq", "id", "digest", "n_bytes"])
        if out is not None:
            out.write(z.flush())
            out.close()

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    return materialise(rows.mapInArrow(run, f"archive string, seq long, id {kind}, digest string, n_bytes long"), "warc-written")


def revisits(written: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(archive, list of (seq, first)): which records of each archive repeat the payload of the record of smallest id.

    Payloads move as digests; the smallest id of each comes from partial minima. The lists are as long as an archive
    has records at most. A record without an id revisits the smallest id, like any other; where no record of a payload
    has one, all are responses, as are several of the smallest id.
    """
    first = written.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").select("digest", "first")
    again = written.where(F.col("n_bytes") >= least).join(first, "digest").where("not id <=> first")
    return again.groupBy("archive").agg(F.collect_list(F.struct("seq", F.col("first").cast("string").alias("first"))).alias("again"))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``source`` named in ``archives`` (archive, again: list of (seq, first), or null).

    Every record becomes its own gzip member in target/archive, and target/archive.idx gets a line a record:
    offset, length, type, URI. Returns (archive, n_records), written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for name, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                turn = {r["seq"]: r["first"] for r in again or ()}
                fs, base = _fs(source)
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    counts.append(normalise_stream(stream, _Output(target, name), _Output(target, f"{name}.idx"), turn.get))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["archive", "n_records"])

    n = max(1, archives.count())
    return materialise(archives.repartition(n).mapInArrow(run, "archive string, n_records long"), "warc-normalised")


def normalise_stream(stream: BinaryIO, out: _Output, index: _Output, first_of: Callable[[int], str | None] = lambda seq: None) -> int:
    """Rewrite one inflated stream; first_of(n) is the key that the n-th record revisits, or None. Returns the number of records."""
    seq = -1
    for seq, (head, block) in enumerate(records(inflate(stream))):  # noqa: B007
        first = first_of(seq)
        if first is not None:
            rec = revisit_record(head, block, first)
            kind = "revisit"
        else:
            rec = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
            kind = next((v for k, v in head.items() if k.lower() == "warc-type"), "")
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(rec) + z.flush()
        uri = next((v for k, v in head.items() if k.lower() == "warc-target-uri"), "")
        index.write(f"{out.at}\t{len(member)}\t{kind}\t{uri}\n".encode())
        out.write(member)
    out.close()
    index.close()
    return seq + 1


def read_at(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record at a place of the index: one seek, one member."""
    file.seek(offset)
    return next(records(iter([zlib.decompress(file.read(length), 31)])))


def read_archives(archives: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record, found by the sidecars.

    For responses bytes and digest are those of the payload as read; a digest unlike the header's is an error.
    For revisits they are the header's, and payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, base = _fs(folder)
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    places = [tuple(map(int, line.split(b"\t")[:2])) for line in f.read().split(b"\n") if line]
                with fs.open_input_file(f"{base}/{name}") as f:
                    for k in range(0, len(places), 200):
                        yield _rows([read_at(f, *p) for p in places[k : k + 200]])

    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"
    out = archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, schema)
    return out.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def _rows(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for head, block in found:
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = None
        size = int(head.get("X-Payload-Length", "0"))
        if head["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size = len(payload)
            if base32_sha1(payload) != digest:
                raise ValueError(f"digest of {head['WARC-Record-ID']} does not match")
        for c, v in zip(cols, (head["X-Row-Key"] or None, size, digest, head["WARC-Type"], head.get("X-Refers-To-Key"), head["WARC-Target-URI"], payload), strict=True):
            c.append(v)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages as monolithic archives, normalise them, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of at least ``least`` bytes the record of smallest page_id is the response, the others are
    revisits of it. Rows that repeat a page_id are all kept; an empty table gives an empty result. Null and empty
    payloads have 0 bytes; see revisits() for null ids. The monolithic archives are deleted once they are normalised, the
    others with the session's intermediate tables.
    """
    spark = pages.sparkSession
    source, target = new_path(spark, "warc-monolithic"), new_path(spark, "warc-members")
    written = write_monolithic(pages, source)
    archives = written.select("archive").distinct().join(revisits(written, least), "archive", "left")
    done = normalise(archives, source, target)
    fs, base = _fs(source)
    if done.count():
        fs.delete_dir(base)
    back = read_archives(done, target, dict(pages.dtypes)["page_id"])
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
