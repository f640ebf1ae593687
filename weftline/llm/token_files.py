"""Binary token-id files: written in ascending doc_id order, read back whole.

File: the magic ``WIDS0002``; blocks; the document index; a trailer. A block is its id count,
byte count and the CRC-32 of its ids (three unsigned 32-bit integers, little-endian), then the
coded bytes (``id_codec``). Blocks run across documents, hold ``block_ids`` ids each (a file's last
block fewer) and are reset, so each can be decoded alone; one block is held at a time. The index is
the zlib-compressed pairs (doc_id, id count) as signed 64-bit integers; the trailer is the index's
offset and size and the file's document and id counts as four unsigned 64-bit integers.

Texts are range-partitioned by doc_id, so each task writes a file of consecutive documents; a
written manifest (a row for each file) gives each file's first id number by a running sum.
Texts that share a doc_id are in one file, in the order of their hash.

Defined results: null or empty text is the end id alone; rows that repeat a doc_id follow each
other in the order of their text's hash; null ids come first; an empty table writes no file and
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import id_codec
from weftline.llm.common import materialise, text_column, work_path
from weftline.llm.files import opened, reading, writing
from weftline.llm.token_cache import cached

MAGIC = b"WIDS0002"
BLOCK, TRAILER = struct.Struct("<III"), struct.Struct("<QQQQ")
MANIFEST = "file string, part int, docs long, ids long"
NO_DOC = -(1 << 63)  # stands for a null doc_id in the index


class FileWriter:
    """Blocks of one file."""

    def __init__(self, out, block_ids: int):
        self.out, self.block_ids = out, block_ids
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.index: list[tuple[int, int]] = []
        self.at = out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_DOC if doc is None else doc, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        ready = len(flat) if last else len(flat) // self.block_ids * self.block_ids
        for start in range(0, ready, self.block_ids):
            part = flat[start : min(start + self.block_ids, ready)]
            coded = id_codec.encode_block(part)
            self.at += self.out.write(BLOCK.pack(len(part), len(coded), id_codec.checksum(part)) + coded)
        self.held = [flat[ready:].copy()] if ready < len(flat) else []
        self.waiting = len(flat) - ready

    def close(self) -> None:
        self.flush(True)
        index = zlib.compress(np.array(self.index, "<i8").reshape(-1, 2).tobytes(), 1)
        self.out.write(index + TRAILER.pack(self.at, len(index), len(self.index), self.ids))


def read_index(uri: str) -> tuple[np.ndarray, int]:
    """The (doc_id, id count) pairs of a file and the offset where its blocks end."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        end = f.size()
        f.seek(end - TRAILER.size)
        at, size, docs, _ = TRAILER.unpack(f.read(TRAILER.size))
        f.seek(at)
        index = np.frombuffer(zlib.decompress(f.read(size)), "<i8").reshape(-1, 2)
    if len(index) != docs:
        raise ValueError(f"{uri}: the index does not fit its trailer")
    return index, at


def read_blocks(source: io.RawIOBase, end: int) -> Iterator[np.ndarray]:
    """The ids of an open file in order, block by block."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC)
    while at < end:
        n, size, crc = BLOCK.unpack(source.read(BLOCK.size))
        ids = id_codec.decode_block(source.read(size), n)
        if id_codec.checksum(ids) != crc:
            raise ValueError("a block of token ids has the wrong checksum")
        at += BLOCK.size + size
        yield ids


def write_ids(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, block_ids: int = 1 << 21, text_bytes: int = 16 << 20
) -> DataFrame:
    """Write every document's ids to files in ``folder``; returns the written manifest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cached(vocabulary)
        if tokens.dtype.itemsize != 2:
            raise ValueError("the coder takes ids below 65536")
        end = np.array([end_id], np.uint16)
        uri, writer, entry = f"{folder}/ids-{uuid.uuid4().hex}.wids", None, None
        try:
            for batch in batches:
                for doc, found in zip(batch.column(0).to_pylist(), tokens.encode_all(batch.column(1)), strict=True):
                    if writer is None:
                        entry = writing(uri)
                        writer = FileWriter(entry.__enter__(), block_ids)
                    writer.add(doc, np.concatenate([found, end]))
            if writer is not None:
                writer.close()
                entry.__exit__(None, None, None)
        except BaseException as error:
            if entry is not None:
                entry.__exit__(type(error), error, error.__traceback__)
            raise
        if writer is not None:
            row = ([uri], [TaskContext.get().partitionId()], [len(writer.index)], [writer.ids])
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["file", "part", "docs", "ids"])

    n = max(1, -(-size // text_bytes))
    dealt = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(dealt.mapInArrow(run, MANIFEST), "ids-manifest")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    files = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, end = read_index(uri)
                counts = index[:, 1]
                starts = np.cumsum(counts) - counts
                crcs = np.zeros(len(index), np.int64)
                doc, left, crc = 0, int(counts[0]) if len(counts) else 0, 0
                with reading(uri) as source:
                    for ids in read_blocks(source, end):
                        raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                        while at < len(ids):
                            take = min(left, len(ids) - at)
                            crc = zlib.crc32(raw[4 * at : 4 * (at + take)], crc)
                            at, left = at + take, left - take
                            if not left:
                                crcs[doc] = crc
                                doc, crc = doc + 1, 0
                                left = int(counts[doc]) if doc < len(counts) else 0
                if doc != len(counts):
                    raise ValueError(f"{uri}: it ends within a document")
                ids = pa.array(index[:, 0], mask=index[:, 0] == NO_DOC)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts + base), pa.array(counts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    listed = files.select("file", "base")
    n = max(1, manifest.count())
    return listed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, vocabulary, work_path(spark, "ids"), **options))
