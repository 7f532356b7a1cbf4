"""WARC archives with one zstd frame per record and the dictionary in a leading skippable frame: writer and reader.

An archive file starts with a skippable frame (magic 0x184D2A5D, little-endian length) whose content is the dictionary,
zstd-compressed; each record follows as one frame of its own, checksummed and with its content size. The reader walks the
frames by their block headers, so it never decodes twice, and checks each record: one record per frame, version, header
syntax, mandatory fields, Content-Length against the block, the closing blank lines, and the payload digest.

Writers give a file its final name only when it is complete and report it in a manifest that Spark commits, so what a
lost or repeated task leaves behind is never read. Files are rolled at ``roll`` bytes.

Cases: null html is an empty payload; equal payloads of at least ``least`` bytes are one response (largest id) and
revisits; null ids and repeated rows are records of their own (of equal largest ids each is a response); an empty table
gives no archive and no rows; further columns are not read. A bad frame raises ``BadArchive`` or, with ``strict=False``,
becomes a row with ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, numbered, scratch_path, some_rows, write_out

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of compressed records after which a file is closed; a reader holds one record at a time.
ROLL = 64 << 20
#: The dictionary: its size, and the bound on the rows that it is trained on.
DICTIONARY_BYTES, DICTIONARY_ROWS = 32 << 10, 400
#: Repeated payloads up to which their digests are broadcast: some 100 bytes each.
BROADCAST_DIGESTS = 50_000
READ = "archive string, at bigint, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, error string"


class BadArchive(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; the length of what it refers to stands in a header of its own."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(uri.split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, strict_digest: bool = True) -> dict:
    """Fields of one decoded record; raises BadArchive."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        raise BadArchive("no end of headers")
    lines = data[:cut].decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"version {lines[0][:20]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"header {line[:40]!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise BadArchive(f"without {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise BadArchive(f"length {fields['content-length'][:20]!r}")
    n, block = int(fields["content-length"]), data[cut + 4 : -4]
    if len(data) != cut + 8 + n or data[-4:] != b"\r\n\r\n":
        raise BadArchive(f"block of {len(data) - cut - 8} bytes, header says {n}")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if revisit and "warc-refers-to" not in fields:
        raise BadArchive("revisit of nothing")
    if strict_digest and not revisit and said and digest(block) != said:
        raise BadArchive("payload digest differs")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": said or digest(block),
        "payload_bytes": int(fields.get("x-payload-length", n)) if revisit else n,
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload": None if revisit else block,
    }


class Archive:
    """A file being written; under another name until it is closed."""

    def __init__(self, where: fs.FileSystem, folder: str, dictionary: bytes):
        self.where, self.name, self.size = where, f"{uuid.uuid4().hex}.warc.zst", 0
        self.part, self.path = f"{folder}/.{self.name}.part", f"{folder}/{self.name}"
        self.out = where.open_output_stream(self.part, compression=None)
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **given)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.pack.compress(data))

    def close(self) -> str:
        self.out.close()
        self.where.move(self.part, self.path)
        return self.name


def frames(stream: io.RawIOBase) -> Iterator[tuple[int, int, bytes]]:
    """(offset, magic, bytes) of each frame, found by the block headers alone."""
    at = 0

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise BadArchive("cut off")
        return got

    while head := stream.read(4):
        if len(head) < 4:
            raise BadArchive("cut off")
        (magic,) = struct.unpack("<I", head)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = take(4)
            data = take(struct.unpack("<I", size)[0])
            yield at, magic, data
            at += 8 + len(data)
            continue
        if magic != FRAME:
            raise BadArchive(f"magic {magic:#x} at {at}")
        own = [head, take(1)]
        flags = own[1][0]
        single = flags >> 5 & 1
        own.append(take((0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]))
        last = False
        while not last:
            own.append(take(3))
            block = int.from_bytes(own[-1], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            if kind == 3:
                raise BadArchive(f"reserved block at {at}")
            own.append(take(1 if kind == 1 else size))
        if flags >> 2 & 1:
            own.append(take(4))
        data = b"".join(own)
        yield at, magic, data
        at += len(data)


def read_archive(stream: io.RawIOBase, most: int = 1 << 31) -> Iterator[tuple[int, dict]]:
    """(offset, fields) of each record; fields has only ``error`` for a bad one. A frame that can't be found ends the file."""
    unpack, walk = zstandard.ZstdDecompressor(), frames(stream)
    first = True
    while True:
        try:
            at, magic, data = next(walk)
        except StopIteration:
            return
        except BadArchive as e:
            yield -1, {"error": str(e)}
            return
        try:
            if magic != FRAME:
                if first and magic == SKIPPABLE:
                    raw = zstandard.ZstdDecompressor().decompress(data) if data[:4] == struct.pack("<I", FRAME) else data
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                continue
            yield at, parse(unpack.decompress(data, max_output_size=most if zstandard.frame_content_size(data) < 0 else 0))
        except (BadArchive, zstandard.ZstdError, UnicodeDecodeError) as e:
            yield at, {"error": f"{type(e).__name__}: {e}"}
        finally:
            first = False


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def payload_digest(html: Column) -> Column:
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """From at most DICTIONARY_ROWS payloads of ordinary length, those of the smallest hashes; empty if there are too few."""
    usual = pages.where(F.length(html_col).between(200, 20_000)).select(F.col(html_col).alias("h"))
    texts = [r.h.encode() for r in some_rows(usual, F.col("h"), DICTIONARY_ROWS, usual.count()).collect()]
    if len(texts) < 50:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()


def _referring(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """(id, url, payload, refers) of rows: refers is the response of a revisit. twice: sha, first, n of repeated payloads.

    Few repeated payloads are broadcast. Many are joined with (row, digest), those of very many rows by a broadcast; then
    only the revisits' row numbers, each of one row, are joined with the payloads, so no digest is a key that these meet on.
    """
    total, n = twice.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    right = twice.select(F.col("sha").alias("twice"), "first", "n")
    refers = F.when(F.col("id") < F.col("first"), F.col("first"))
    if n <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(right), F.col("sha") == F.col("twice"), "left").select("id", "url", "payload", refers.alias("refers"))
    rows = numbered(rows, "row")
    narrow, heavy = rows.select("row", "id", "sha"), F.col("n") > total / BROADCAST_DIGESTS  # fewer than BROADCAST_DIGESTS are
    hot, same = F.broadcast(right.where(heavy)), F.col("sha") == F.col("twice")
    rest = narrow.join(hot, same, "left_anti").join(right.where(~heavy), same)
    found = narrow.join(hot, same).unionByName(rest).select(F.col("row").alias("at"), refers.alias("refers")).where("refers is not null")
    return rows.join(found, F.col("row") == F.col("at"), "left").select("id", "url", "payload", "refers")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, roll: int = ROLL, dictionary: bytes | None = None) -> DataFrame:
    """Write every row as a record into files under folder; returns the written manifest (archive, records)."""
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    dictionary = train_dictionary(pages, html_col) if dictionary is None else dictionary
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), payload_digest(F.col(html_col)).alias("sha"))
    twice = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = _referring(rows, write_out(twice, "equal-payloads"))
    where, at = open_store(folder)
    where.create_dir(at, recursive=True)
    packed = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(folder)
        archive, n, done = None, 0, []
        for b in batches:
            for i, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None:
                    archive, n = Archive(store, inside, packed.value), 0
                kind = "response" if refers is None else "revisit"
                archive.add(record(kind, f"urn:page:{'' if i is None else i}", url, payload, digest(payload), None if refers is None else f"urn:page:{refers}"))
                n += 1
                if archive.size >= roll:
                    done.append((archive.close(), n))
                    archive = None
        if archive is not None:
            done.append((archive.close(), n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return write_out(rows.mapInArrow(run, "archive string, records bigint"), "manifest")


def read_archives(archives: DataFrame, folder: str, *, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of the files that archives names, as READ. payloads: False leaves their column null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(folder)
        kinds = pa.schema([("archive", pa.string()), ("at", pa.int64()), *((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
        rows: list[dict] = []
        size = 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{inside}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for at, x in read_archive(stream):
                        if strict and "error" in x:
                            raise BadArchive(f"{name} at {at}: {x['error']}")
                        size += len(x.get("payload") or b"") * payloads
                        rows.append(x | {"archive": name, "at": at} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 2000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(spread, "archive").mapInArrow(run, READ)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write pages as archives in the shared folder and read them back, without the payloads."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder)
    back = read_archives(manifest, folder, payloads=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*)$", 1), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
