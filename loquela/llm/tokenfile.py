"""Token files: documents in id order, encoded by the context-mixing range coder, and read back.

Python tasks make and read blocks of ids and their files; the coder between them is Java."""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquela.llm import compiled, rangecoder
from loquela.llm._shared import in_slices, task
from loquela.llm.tokens import encoder, keep


#: A section's head with its counts of documents and ids, or a block's id count, checksum and ids or payload.
_BLOCK = "head binary, n_docs int, n long, crc long, ids binary"
_FILE = "part int, path string, n_docs long, n_ids long, n_bytes long"
#: The first document's start, the ids and lengths of a section's documents, or a block.
_STORED = "start long, docs array<long>, lengths array<long>, n int, crc long, ids binary"
_KINDS = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write every document's ids (and the end id) under `folder`, a URI that executors share.

    One file for each range of doc_id, in ascending order; rows of equal id follow each other
    by text, a null id comes first. Null and empty texts are the end id alone. A file is written
    in sections, so a task holds one and not the file; ids over 65,535 raise ValueError. A task writes a
    file of its own name, and only files of tasks that ended well are listed, so a lost
    executor leaves nothing that is read. Returns one row for each file: (part, path, n_docs,
    n_ids, n_bytes).
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, spaced=False).encode, np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, ids = [], [], []

        def section() -> pa.RecordBatch:
            """What is held: a row with the section's head, then its blocks."""
            whole = np.concatenate(ids)
            cut = [whole[k : k + rangecoder.BLOCK] for k in range(0, len(whole), rangecoder.BLOCK)]
            head = rangecoder.section_head(len(whole), doc_ids, lengths)
            rows = [(head, len(doc_ids), len(whole), 0, None), *((None, 0, len(x), zlib.crc32(x.astype("<u4").tobytes()), x.astype("<u2").tobytes()) for x in cut)]
            for held in (doc_ids, lengths, ids):
                held.clear()
            return _batch(_BLOCK, rows)

        for batch in in_slices(batches, "text"):
            doc_ids += batch.column("doc_id").to_pylist()
            for x in encode(batch.column("text")):
                ids.append(rangecoder.checked(np.frombuffer(x + end, "<u4")))
                lengths.append(len(ids[-1]))
            if sum(lengths) >= rangecoder.SECTION:
                yield section()
        if doc_ids:
            yield section()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        part, file, size, n_docs, n_ids = TaskContext.get().partitionId(), None, 0, 0, 0
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ltk"
        for batch in batches:
            for head, docs_here, n, crc, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                file = file or fs.open_output_stream(path)
                if head is not None:
                    n_docs, n_ids = n_docs + docs_here, n_ids + n
                else:
                    head = rangecoder.block_head(n, len(payload), crc) + payload
                size += file.write(head) or 0
        if file is None:
            return
        file.close()
        yield _batch(_FILE, [(part, path, n_docs, n_ids, size)])

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    code = compiled.function(docs.sparkSession, "RangeCoder.java", "RangeCoder$Encode", "binary")
    coded = dealt.mapInArrow(task(blocks), _BLOCK).withColumn("ids", F.call_function(code, "ids"))
    return coded.mapInArrow(task(files), _FILE)


def read_files(spark: SparkSession, folder: str, listing: list[tuple[int, str, int]], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in the listed files.

    `listing` has (part, path, n_ids) of each file. Lengths and checksums of the header and of
    every block are verified; a damaged file raises ValueError.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    for doc_ids, lengths, payloads in rangecoder.stored(f):
                        yield _batch(_STORED, [(start, doc_ids, lengths, 0, 0, None)])
                        start += sum(lengths)
                        while rows := [(None, None, None, n, crc, payload) for n, payload, crc in itertools.islice(payloads, 256)]:
                            yield _batch(_STORED, rows)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, start, docs, left, crc, parts = [], 0, iter(()), None, 0, []  # left: ids of a document that are still to come
        for batch in batches:
            for begin, doc_ids, lengths, _, check, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if doc_ids is not None:
                    if left is not None:
                        raise ValueError("a section is cut short")
                    start, docs = begin, zip(doc_ids, lengths, strict=True)
                    doc, n = next(docs, (None, None))
                    left, at, data = n, 0, np.zeros(0, "<u4")
                else:
                    data, at = rangecoder.verified(np.frombuffer(ids, "<u2"), check), 0
                while left is not None and (at < len(data) or left == 0):
                    own = data[at : at + left]
                    crc, left, at = zlib.crc32(own.tobytes(), crc), left - len(own), at + len(own)
                    if with_ids:
                        parts.append(own)
                    if left == 0:
                        rows.append((doc, start, n, crc, *([np.concatenate(parts).astype(np.int32)] if with_ids else ())))
                        start, crc, parts = start + n, 0, []
                        doc, n = next(docs, (None, None))
                        left = n
            if rows:
                yield _batch(schema, rows)
                rows = []
        if left is not None:
            raise ValueError("a section is cut short")

    if not listing:
        return spark.createDataFrame([], schema)
    rows, start = [], 0
    for part, path, n in sorted(listing):
        rows.append((part, path, start))
        start += n
    files = spark.createDataFrame(rows, "part int, path string, start long")
    code = compiled.function(spark, "RangeCoder.java", "RangeCoder$Decode", "binary")
    read = files.repartitionByRange(len(rows), "part").mapInArrow(task(blocks), _STORED)
    return read.withColumn("ids", F.call_function(code, "ids", "n")).mapInArrow(task(documents), schema)


def round_trip(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """write_files(), then read_files() of what it wrote. An empty table writes no file."""
    listing = [tuple(r) for r in write_files(docs, folder, vocabulary, end_id).select("part", "path", "n_ids").collect()]
    return read_files(docs.sparkSession, folder, listing, with_ids)
