"""WARC archives in Zstandard: a writer, and a reader that checks every record.

An archive is a leading skippable frame that holds the dictionary, then one frame for each record. The reader takes the
dictionary from there (plain, or itself compressed), finds each frame's end from its block headers, decompresses one
frame at a time, so that memory holds one archive's compressed bytes and one record, and checks the version line, the
header fields, the lengths and the digests.

Archives are named by partition and number, rows are written in the order of their ids, and a file appears under its
name only when it is whole, so a task that runs again puts the same files in place.

Edge cases: a null payload is empty; a null URL leaves WARC-Target-URI out; control characters in a URL are
percent-encoded; a null id leaves X-Page-ID out, and such a page is a response unless a page with an id has its
payload; rows that repeat the smallest id of a payload are each a response; an empty table gives no archive. A record of
more than `most` bytes (1 GiB) is refused with BadRecord when it is read.
Only the three named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import materialize, shared_path

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = "archive string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


class BadRecord(ValueError):
    """An archive that breaks the format."""


def digest(data: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """Header fields and body of the HTTP message in the block."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"HTTP/"):
            raise BadRecord("the block is no HTTP message")
        return _fields(lines[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        try:
            if not colon or not name or name.strip() != name:
                raise BadRecord(f"not a header field: {line[:80]!r}")
            found[name.decode("ascii").lower()] = value.strip().decode()
        except UnicodeDecodeError as e:
            raise BadRecord(f"not a header field: {line[:80]!r}") from e
    return found


# --- writing


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def page_uri(page_id: int) -> str:
    return f"urn:x-page:{page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of a response record, or of a revisit record if it refers to another page."""
    payload_digest = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = page_uri(page_id) if page_id is not None else f"urn:x-payload:{payload_digest}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{uri}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url) if url is not None else None),
        ("X-Page-ID", page_id),
        ("WARC-Profile", IDENTICAL if revisit else None),
        ("WARC-Refers-To", f"<{page_uri(refers_to)}>" if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = 16_384, samples: int = 256) -> bytes:
    """A dictionary trained on the first records, or the first of them itself where there is too little to learn from."""
    try:
        if len(records) >= 16:  # the trainer takes no fewer
            return zstandard.train_dictionary(size, [r[:8192] for r in records[:samples]]).as_bytes()
    except zstandard.ZstdError:
        pass
    return records[0][:size]


def archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive of the records: the frame of the dictionary, which affects its size alone, and a frame for each record."""
    body = dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(body), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(body)), body, *map(packer.compress, records)])


def _write(batches: Iterable[pa.RecordBatch], folder: str, roll_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    held, size, number, done = [], 0, 0, []

    def flush():
        nonlocal held, size, number
        name = f"{root}/{part:06d}-{number:05d}.warc.zst"
        with store.open_output_stream(f"{root}/_{part}-{number}-{attempt}.tmp") as out:
            out.write(archive(held))
        if store.get_file_info(name).type != fs.FileType.NotFound:  # some stores do not replace a file that a lost task left
            store.delete_file(name)
        store.move(f"{root}/_{part}-{number}-{attempt}.tmp", name)
        done.append((name.rsplit("/", 1)[1], len(held)))
        held, size, number = [], 0, number + 1

    for batch in batches:
        for row in batch.to_pylist():
            held.append(page_record(row["page_id"], row["url"], row["payload"], row["refers_to"], date))
            size += len(held[-1])
            if size >= roll_bytes:
                flush()
    if held:
        flush()
    yield pa.RecordBatch.from_pydict({"archive": [n for n, _ in done], "records": [c for _, c in done]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload: int = 0,
    roll_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Write a record for each page and return archive and records (their number) for each archive.

    folder: a shared folder that pyarrow can write to by its URI. min_payload: smaller payloads are never revisits.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = (
        rows.filter(F.length("payload") >= min_payload).groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    )
    firsts = materialize(firsts, "payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.join(firsts, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    store = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(store)
    rows = rows.sortWithinPartitions("page_id", "url", "refers_to")
    return materialize(rows.mapInArrow(lambda b: _write(b, folder, roll_bytes, date), "archive string, records long"), "archives")


# --- reading


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its block headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise BadRecord("a frame is cut short")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * params.has_checksum
    if end > len(data):
        raise BadRecord("a frame is cut short")
    return end


def read_frames(content: bytes, most: int = 1 << 30) -> Iterator[bytes]:
    """The decompressed bytes of each record frame. most: bytes that one record may have."""
    data, at, dictionary = memoryview(content), 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise BadRecord("a frame is cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise BadRecord("a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY_FRAME:
                body = bytes(data[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                dictionary = zstandard.ZstdCompressionDict(body)
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            stated = zstandard.get_frame_parameters(data[at : at + 18]).content_size
            if most < stated < zstandard.CONTENTSIZE_ERROR:  # the two largest numbers mean unknown and error
                raise BadRecord(f"a record of {stated} bytes")
            try:
                yield zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[at:end], max_output_size=most)
            except zstandard.ZstdError as e:
                raise BadRecord(str(e)) from e
            at = end
        else:
            raise BadRecord(f"no frame begins at byte {at}")


def parse_record(data: bytes) -> Record:
    """One record, if its frame holds just that: version, header fields, lengths and digests are checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise BadRecord("no version line and header")
    headers = _fields(lines[1:])
    for name in REQUIRED:
        if not headers.get(name.lower()):
            raise BadRecord(f"{name} is missing")
    if not headers["content-length"].isdecimal():
        raise BadRecord("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length is {size}, the frame holds {len(rest) - 4}")
    record = Record(headers, rest[:size])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest(record.block):
        raise BadRecord("the block does not have its digest")
    return record


def _page(data: bytes) -> tuple:
    record = parse_record(data)
    kind = record.headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None, record.headers.get("warc-target-uri"), kind, record.block, len(record.block), record.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    http, body = record.http()
    if not http.get("content-length", "").isdecimal():
        raise BadRecord("the HTTP message has no Content-Length")
    size, stated = int(http["content-length"]), record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (size != len(body) or stated and stated != digest(body)):
        raise BadRecord("the payload does not have its length or digest")
    if kind == "revisit" and body:
        raise BadRecord("a revisit has a payload")
    refers = record.headers.get("warc-refers-to", "").strip("<>").removeprefix("urn:x-page:")
    page = record.headers.get("x-page-id")
    return int(page) if page else None, record.headers.get("warc-target-uri"), kind, body if kind == "response" else None, size, stated or None, int(refers) if refers else None


def _read(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name, held, size = path.as_py().rsplit("/", 1)[1], [], 0
            for data in read_frames(content.as_buffer()):
                page = _page(data)
                held.append((name, *page[:3], page[3] if payloads else None, *page[4:]))
                size += len(data) if payloads else 200
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the .warc.zst files in a folder, through Spark's own file reader.

    archive, page_id, url, record_type, payload (null for revisits, or unless asked for), payload_bytes and
    payload_digest (of the full payload), refers_to. A file may have as many bytes as Spark's binary reader takes (2 GB).
    A record that breaks the format fails the job with BadRecord.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(lambda b: _read(b, payloads), RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder, payloads=False)
