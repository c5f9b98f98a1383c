"""WARC archives as Zstandard files: one frame for each record, the dictionary in front.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
compressed or not; every following frame is one whole record. Records carry the page's id, its
payload's length and its SHA-1, and the reader checks them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquela.llm._shared import in_slices, task

#: Skippable frame of a dictionary, and the magic of a dictionary and of a frame.
SKIPPABLE, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
#: A file's dictionary is trained on at most so many of its first records and bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 400, 4 << 20, 64 << 10
DATE = "2000-01-01T00:00:00Z"
READ = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record's bytes; a revisit has no payload of its own."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{x}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest32(body)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + body + b"\r\n\r\n"


def _clean_url(url: str | None) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or b"" where the samples are too few or too short for one."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with `payload`, its size and hex SHA-1, and the response's page_id.

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is
    the response (of repeated rows of that id, each is one). Smaller payloads are all
    responses. The largest id of each payload comes from an aggregate that combines map-side,
    so a payload of very many pages is no hot group; the join splits it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    best = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = best.filter((F.col("n") > 1) & (F.col("size") >= least)).select(F.col("sha1").alias("s"), F.col("size").alias("z"), "first_id")
    return rows.join(shared, (rows["sha1"] == shared["s"]) & (rows["size"] == shared["z"]), "left").drop("s", "z")


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 3) -> DataFrame:
    """Write one record for each page under `folder`, a URI that executors share.

    Null html is an empty payload, a null url an empty one; a page without an id is a response
    that none refers to. A task writes a file of its own name; only files of tasks that ended
    well are listed. Returns (path, records, bytes) for each file.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        held: list[bytes] = []
        out = packer = None
        count = size = 0

        def start() -> None:
            nonlocal out, packer, size
            out, words = fs.open_output_stream(path), dictionary(held)
            if words:
                out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                size += 8 + len(words)
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
            for x in held:
                put(x)
            held.clear()

        def put(record: bytes) -> None:
            nonlocal size
            frame = packer.compress(record)
            out.write(frame)
            size += len(frame)

        seen = 0
        for batch in in_slices(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first_id")]
            for page_id, url, payload, sha1, first in zip(*columns, strict=True):
                kind = "revisit" if None not in (first, page_id) and page_id != first else "response"
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                record = _record(kind, page_id, _clean_url(url), payload, digest, first if kind == "revisit" else None)
                count += 1
                if packer:
                    put(record)
                    continue
                held.append(record)
                seen += len(record)
                if len(held) >= SAMPLE_ROWS or seen >= SAMPLE_BYTES:
                    start()
        if not count:
            return
        if not packer:
            start()
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]}, schema=schema)

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = roles(pages, least).select("page_id", "url", "payload", "sha1", "first_id")
    return rows.mapInArrow(task(run), "path string, records long, bytes long")


class ArchiveError(ValueError):
    """A file or record that doesn't hold what its headers say."""


def _frames(f) -> Iterator[bytes]:
    """The decoded records of a file object: dictionary first, then a frame for each record."""
    data, words = b"", None

    def fill(n: int) -> bool:
        nonlocal data
        while len(data) < n:
            more = f.read(max(READ, n - len(data)))
            if not more:
                return False
            data += more
        return True

    if fill(8) and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        n = struct.unpack("<I", data[4:8])[0]
        if not fill(8 + n):
            raise ArchiveError("the dictionary is cut short")
        words, data = data[8 : 8 + n], data[8 + n :]
        if words[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        if words[:4] != struct.pack("<I", DICT_MAGIC):
            raise ArchiveError("the leading frame holds no dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while fill(1):
        one, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame is damaged: {e}") from e
            data = one.unused_data
            if one.eof:
                break
            if not fill(1):
                raise ArchiveError("the last frame is cut short")
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record's bytes, validated."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"a header line without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"the record has no {name}")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block's length is not the one declared")
    block = rest[:-4]
    declared = headers.get("warc-block-digest", "")
    if declared and declared != f"sha1:{digest32(block)}":
        raise ArchiveError("the block's digest is not the one declared")
    return headers, block


def read_archives(spark: SparkSession, folder: str, paths: list[str], with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record.

    Dictionary, frames, headers, lengths and digests are validated; a fault raises
    ArchiveError. A revisit's bytes and digest are those of the payload it stands for.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] * with_payload
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def row(record: bytes) -> tuple:
        headers, block = parse(record)
        kind, payload = headers["warc-type"], block.partition(b"\r\n\r\n")[2]
        n, digest = headers.get("x-payload-length", ""), headers.get("warc-payload-digest", "")
        if kind == "response" and (digest != f"sha1:{digest32(payload)}" or n != str(len(payload))):
            raise ArchiveError("the payload is not the one declared")
        if kind == "revisit" and "warc-refers-to" not in headers:
            raise ArchiveError("a revisit refers to nothing")
        if not n.isdecimal() or not digest.startswith("sha1:"):
            raise ArchiveError("the payload's length or digest is missing")
        number = lambda name: int(headers[name]) if headers.get(name) else None
        found = (number("x-page-id"), headers.get("warc-target-uri", ""), kind, int(n), digest[5:], number("x-refers-to-page-id"))
        return found + (payload,) * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path) as f:
                    for record in _frames(f):
                        rows.append(row(record))
                        size += len(record)
                        if len(rows) == 4096 or (with_payload and size > 16 << 20):
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(paths))], "i int, path string")
    return files.repartitionByRange(len(paths), "i").mapInArrow(task(run), schema)


def round_trip(pages: DataFrame, folder: str, least: int = 0, with_payload: bool = False) -> DataFrame:
    """write_archives(), then read_archives() of what it wrote. An empty table writes no file."""
    paths = [r.path for r in write_archives(pages, folder, least).select("path").collect()]
    return read_archives(pages.sparkSession, folder, paths, with_payload)
