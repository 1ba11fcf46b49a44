"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_RECORD_ID = re.compile(r"<urn:page:(-?[0-9]+|none)>")

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 100
#: Bytes of an archive before the next one begins, and of a dictionary and the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 8 << 20, 16 << 10, 1 << 20


class WarcError(ValueError):
    """A record, frame, header or length that breaks the format."""


def frame_end(data: bytes | memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, read from its block headers."""
    try:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != ZSTD_FRAME:
            raise WarcError(f"no Zstandard frame at byte {at}")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                last, kind = head & 1, head >> 1 & 3
                if kind == 3 or end + 3 > len(data):
                    raise WarcError(f"broken block at byte {end}")
                end += 3 + (1 if kind == 1 else head >> 3)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise WarcError(f"cut off frame at byte {at}") from None
    if end > len(data):
        raise WarcError(f"cut off frame at byte {at}")
    return end


def load_dictionary(data: bytes | memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame (plain or itself compressed), and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(data, 0)
    raw = bytes(data[8:end])
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if raw[:4] != struct.pack("<I", ZSTD_DICTIONARY):
        raise WarcError("the leading skippable frame holds no Zstandard dictionary")
    return zstandard.ZstdCompressionDict(raw), end


class Headers(dict):
    """Header values by name; case does not count."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: str) -> bool:
        return super().__contains__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def _headers(lines: list[bytes]) -> Headers:
    """Headers of a record or of HTTP; a line that begins with a blank goes on with the one before; a repeated name keeps its first value."""
    out, name = Headers(), None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] = f"{out[name]} {line.strip().decode('utf-8', 'replace')}"
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise WarcError(f"broken header {line[:80]!r}")
        name = key.strip().decode("utf-8", "replace")
        if name not in out:
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def digest_holds(said: str, *candidates: bytes) -> bool:
    """Whether a labelled digest (any algorithm of hashlib; base 16, 32 or 64) is that of one of the candidates; unknown algorithms are not judged."""
    label, _, value = said.partition(":")
    label = label.lower().replace("-", "")
    if label not in hashlib.algorithms_guaranteed or label.startswith("shake"):
        return True
    value = value.strip().rstrip("=")
    for data in candidates:
        raw = hashlib.new(label, data).digest()
        if value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=") or value in (base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("=")):
            return True
    return False


def parse(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; checks the version, required headers, lengths and block digest."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith((b"WARC/1.", b"WARC/0.")):
        raise WarcError("a record begins with its version and ends its headers by an empty line")
    headers = _headers(lines[1:])
    if missing := [x for x in REQUIRED if x not in headers]:
        raise WarcError(f"missing headers {missing}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} but {len(rest) - 4} bytes of content")
    block = rest[:-4]
    if (said := headers.get("WARC-Block-Digest")) and not digest_holds(said, block):
        raise WarcError("the block does not match its digest")
    return headers, block


def unchunk(body: bytes) -> bytes:
    """The content of a body in HTTP's chunked transfer coding (extensions and trailers are dropped)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise WarcError("broken chunked body")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if len(body) < end + 2 + n + 2 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise WarcError("broken chunked body")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(headers: Headers, block: bytes) -> tuple[bytes | None, int | None]:
    """A record's payload (None for a revisit) and its full length, if known.

    Of HTTP messages it is the body, without chunked transfer coding; of all other records the block. Lengths that HTTP
    states and payload digests are checked, unless the record says that it was truncated. A digest may be of the
    body as it was sent or without its transfer coding: both are in use.
    """
    kind, truncated = headers["WARC-Type"].lower(), "WARC-Truncated" in headers
    said, body, sent, length = headers.get("WARC-Payload-Digest"), block, block, None
    if headers.get("Content-Type", "").lower().startswith("application/http") or (kind == "revisit" and block.startswith(b"HTTP/")):
        head, gap, body = block.partition(b"\r\n\r\n")
        http = _headers(head.split(b"\r\n")[1:])
        if not gap and kind != "revisit":
            raise WarcError("no end of the HTTP headers")
        sent, length = body, http.get("Content-Length")
        length = int(length) if length and length.isdigit() else None
        if kind == "revisit":
            return None, length
        if "chunked" in http.get("Transfer-Encoding", "").lower():
            try:
                body, length = unchunk(body), None
            except WarcError:  # some crawlers store the body without its coding
                if not truncated and not (said and digest_holds(said, sent)):
                    raise
        elif length is not None and length != len(body) and not truncated:
            raise WarcError(f"HTTP Content-Length {length} but {len(body)} bytes of payload")
    elif kind == "revisit":
        return None, None
    if said and not truncated and not digest_holds(said, body, sent):
        raise WarcError("the payload does not match its digest")
    return body, len(body)


def records(data: bytes | memoryview) -> Iterator[tuple[int, Headers, bytes]]:
    """Offset, headers and block of every record of an archive, one frame at a time."""
    dictionary, at = load_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == ZSTD_FRAME:
            try:
                record = reader.decompressobj().decompress(bytes(data[at:end]))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at byte {at}: {e}") from None
            yield at, *parse(record)
        at = end


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (whose block has the HTTP headers only) if refers_to is set."""
    urn = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 16 else None
    except zstandard.ZstdError:  # too little or too even data
        return None


def write(pages: DataFrame, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """archive (name) and content (bytes): each task writes its records into archives of about ARCHIVE_BYTES.

    Takes page_id, url, payload, digest (hex SHA-256 of the payload) and refers_to. A task's first
    records train its dictionary; without enough of them the archives have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        packer = dictionary = None
        held: list[bytes] = []
        out: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            nonlocal made, size
            head = []
            if dictionary:
                raw = dictionary.as_bytes()
                head = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw]
            batch = pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{made:06d}.warc.zst"], "content": [b"".join(head + out)]})
            made, size = made + 1, 0
            out.clear()
            return batch

        def pack(record: bytes) -> None:
            nonlocal size
            out.append(packer.compress(record))
            size += len(out[-1])

        def begin() -> None:
            nonlocal packer, dictionary
            dictionary = _train(held)
            packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=level, write_checksum=True)

        waiting = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                record = build(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                if packer is None:
                    held.append(record)
                    waiting += len(record)
                    if waiting < TRAINING_BYTES:
                        continue
                    begin()
                    todo, held = held, []
                else:
                    todo = [record]
                for x in todo:
                    pack(x)
                    if size >= ARCHIVE_BYTES:
                        yield archive()
        if held:
            begin()
            for x in held:
                pack(x)
        if out:
            yield archive()

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (columns archive and content, as from write() or the binaryFile source).

    Records of all types are read, of this module's archives and of others (header names in any case, digests of any
    usual algorithm and base, chunked bodies). payload_digest is the payload's SHA-256 in hex; a revisit has no payload,
    and its length and digest are those it states for the full one (a digest of another algorithm as it stands, with its
    label). payload holds responses, resources and conversions. A broken archive fails the read and names the
    place; null contents are skipped; an empty table gives no rows; further columns are ignored.
    """

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                if not content.is_valid:
                    continue
                for at, head, block in records(memoryview(content.as_buffer())):
                    try:
                        payload, length = payload_of(head, block)
                    except WarcError as e:
                        raise WarcError(f"{name}, byte {at}: {e}") from None
                    kind, digest = head["WARC-Type"], head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    if payload is not None:
                        digest = hashlib.sha256(payload).hexdigest()
                    held = payload if payloads and kind in ("response", "resource", "conversion") else None
                    rows.append((name.as_py(), at, kind, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), length, digest, held))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "archive string, offset bigint, record_type string, record_id string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"
    return archives.select("archive", "content").mapInArrow(run, schema)


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes the archives (archive, content) as files of a folder and gives archive, n_bytes and sha256 of each.

    Executors write through pyarrow's file systems (file, hdfs, s3, gs): each file under a name of its own attempt, then
    renamed, so that a task that is run again after a loss replaces its files by equal ones and readers see whole files
    only. What was written is itself kept as a table in the folder's _written.
    """
    spark = archives.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                beside = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(beside) as stream:
                    stream.write(data)
                system.move(beside, f"{root}/{name}")
                out.append((name.as_py(), len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], ["archive", "n_bytes", "sha256"])

    schema = "archive string, n_bytes bigint, sha256 string"
    archives.select("archive", "content").mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/_written")
    return spark.read.schema(schema).parquet(f"{folder}/_written")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """archive and content of the .warc.zst files of a folder, for read(). A file is one row, of at most 2 GB."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.col("path").alias("archive"), "content")


def page_of(record_id: str) -> F.Column:
    """The page id in a record id; null for a page without one."""
    return F.regexp_extract(record_id, _RECORD_ID.pattern, 1).try_cast("bigint")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of REVISIT_BYTES or more, the smallest page_id is kept.

    A null html is an empty payload. Rows without page_id, and rows that share the smallest page_id
    of a payload, are all responses. Only ids and digests are shuffled to find the copies.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = pages.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = long.join(first, "digest").where("page_id <> refers_to").distinct()
    return pages.join(again, ["page_id", "digest"], "left")


def pack(pages: DataFrame) -> DataFrame:
    """The archives of a pages table (page_id, url, html); an empty table gives none; further columns are ignored."""
    return write(with_revisits(pages))
