"""WARC archives with a Zstandard dictionary: writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed
as a Zstandard frame without one, then one Zstandard frame for each record, so that any record
can be read alone from its offset. A writer task builds the dictionary from the first
``train_records`` records of its own archive (a bounded buffer, documented here; every record
is written), compresses with it, and starts the next archive after ``archive_bytes`` payload
bytes. Archives are listed in a manifest, a written table with a row for each record: its
archive, offset and length.

Equal payloads of at least ``revisit_bytes`` bytes are stored once: the one with the largest
page_id is a ``response``, the others are ``revisit`` records without payload that name its
record id. Digests are grouped with partial aggregation; what revisits refer to is joined back by
page_id, so a hot payload never meets in a task. That join is a broadcast while revisits are few and
otherwise one shuffle of the payloads.

Defined results: null html is an empty payload; a null url is left out of the record's header, and
so is a null page_id, whose record is always a response that nothing refers to;
of rows that repeat one page_id and payload one (the response's row by page_id) counts each, so
all of them are responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialise, work_path
from weftline.llm.files import reading, writing

SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # a fixed capture time keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A page's record id; records without a page each get one of their own."""
    return f"urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers: int | None) -> bytes:
    """One uncompressed record: header lines, a blank line, the block and two line ends."""
    block = payload if kind == "response" else b""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(page_id)}>", "WARC-Date": DATE}
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI"] = "".join(url.split("\r")).replace("\n", "")
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(size)}
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers)}>", "WARC-Refers-To-Page-ID": str(refers)}
    head |= {"Content-Type": "text/html", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(VERSION.rstrip()):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block, size = rest[:-4], int(fields["Content-Length"])
    if len(block) != size or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return fields, block


def trained(samples: list[bytes], dict_bytes: int) -> bytes:
    """A dictionary, or none where there is too little to learn from."""
    try:
        return zstd.train_dictionary(dict_bytes, samples).as_bytes()
    except zstd.ZstdError:
        return b""


class ArchiveWriter:
    """Compressed records of one archive; the dictionary comes from the first of them."""

    def __init__(self, uri: str, train_records: int, dict_bytes: int, level: int):
        self.uri, self.train_records, self.dict_bytes, self.level = uri, train_records, dict_bytes, level
        self.held: list[tuple[int, bytes]] = []
        self.compress, self.at, self.payload = None, 0, 0
        self.entry = writing(uri)
        self.out = self.entry.__enter__()

    def start(self) -> Iterator[tuple[int, int, int]]:
        raw = trained([x for _, x in self.held], self.dict_bytes)
        framed = zstd.ZstdCompressor(level=19).compress(raw)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(framed)) + framed)
        self.at = 8 + len(framed)
        use = zstd.ZstdCompressionDict(raw) if raw else None
        self.compress = zstd.ZstdCompressor(level=self.level, dict_data=use, write_checksum=True).compress
        held, self.held = self.held, []
        for page, x in held:
            yield self.put(page, x)

    def put(self, page: int, raw: bytes) -> tuple[int, int, int]:
        frame = self.compress(raw)
        self.out.write(frame)
        self.at += len(frame)
        return page, self.at - len(frame), len(frame)

    def add(self, page: int, raw: bytes) -> Iterator[tuple[int, int, int]]:
        self.payload += len(raw)
        if self.compress is not None:
            yield self.put(page, raw)
            return
        self.held.append((page, raw))
        if len(self.held) >= self.train_records:
            yield from self.start()

    def close(self) -> Iterator[tuple[int, int, int]]:
        if self.compress is None:
            yield from self.start()
        self.entry.__exit__(None, None, None)

    def abort(self, error: BaseException) -> None:
        self.entry.__exit__(type(error), error, error.__traceback__)


def records_of(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an open archive, streamed."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = zstd.ZstdDecompressor().decompress(source.read(size))
    use = zstd.ZstdCompressionDict(raw) if raw else None
    rest = b""
    while True:
        engine = zstd.ZstdDecompressor(dict_data=use).decompressobj()
        out = io.BytesIO()
        while not engine.eof:
            part = rest or source.read(1 << 18)
            rest = b""
            if not part:
                if out.tell():
                    raise ValueError("the archive ends within a record")
                return
            out.write(engine.decompress(part))
        rest = engine.unused_data
        yield parse(out.getvalue())


def read_at(source, offset: int, length: int, dictionary: bytes) -> tuple[dict[str, str], bytes]:
    """One record by its offset in a seekable archive."""
    source.seek(offset)
    use = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    return parse(zstd.ZstdDecompressor(dict_data=use).decompressobj().decompress(source.read(length)))


MANIFEST = "archive string, page_id long, record_offset long, record_length long"


def classified(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Pages with payload, digest, kind and the page they refer to; hashing is native."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    # The digest pass reads payloads but shuffles ids and digests alone, and only those of copies
    # come back to the pages, by id: a hot payload is dealt out by its many pages.
    narrow = materialise(rows.where((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest", "size"), "warc-digests")
    copied = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.min("page_id").alias("_low")).where("_low < first")
    revisits = narrow.join(copied.drop("_low"), ["digest", "size"]).where("page_id < first").select("page_id", "digest", "first").distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    return rows.select(
        "page_id", "url", "payload", "size", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers"),
    )


def write_archives(
    pages: DataFrame, folder: str, revisit_bytes: int = 1000, train_records: int = 400, dict_bytes: int = 16_384,
    level: int = 3, archive_bytes: int = 256 << 20,
) -> DataFrame:
    """Write archives of all pages to ``folder`` and return the manifest."""

    def listed(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["archive", "page_id", "record_offset", "record_length"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Names are new on each attempt; the manifest lists those of the attempt that succeeded.
        writer: ArchiveWriter | None = None
        try:
            for batch in batches:
                found: list[tuple] = []
                cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "kind", "refers")]
                for values in zip(*cols, strict=True):
                    page, url, payload, digest, size, kind, refers = (v.as_py() for v in values)
                    if writer is not None and writer.payload >= archive_bytes:
                        done, writer = writer, None
                        found += [(done.uri, *x) for x in done.close()]
                    if writer is None:
                        writer = ArchiveWriter(f"{folder}/pages-{uuid.uuid4().hex}.warc.zst", train_records, dict_bytes, level)
                    raw = record(page, url, payload, digest, size, kind, refers)
                    found += [(writer.uri, *x) for x in writer.add(page, raw)]
                if found:
                    yield listed(found)
            if writer is not None:
                done, writer = writer, None
                found = [(done.uri, *x) for x in done.close()]
                if found:
                    yield listed(found)
        except BaseException as error:
            if writer is not None:
                writer.abort(error)
            raise

    return materialise(classified(pages, revisit_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, block_ok boolean"


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives that the manifest lists, in full scans."""
    listed = manifest.select("archive").distinct()
    n = max(1, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with reading(uri) as source:
                    rows: list[tuple] = []
                    for head, block in records_of(source):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = head.get("WARC-Refers-To-Page-ID")
                        ok = kind == "revisit" or hashlib.sha1(block).hexdigest() == digest
                        size = len(block) if kind == "response" else int(head["WARC-Payload-Length"])
                        page = head.get("WARC-Page-ID")
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, uri, ok))
                        if len(rows) >= 1 << 12:
                            yield table_of(rows)
                            rows = []
                    if rows:
                        yield table_of(rows)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in READ.split(", ")]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return listed.repartition(n).mapInArrow(run, READ)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back, and return what the
    archives say of each page; a block whose digest differs fails the query."""
    spark = pages.sparkSession
    manifest = write_archives(pages, work_path(spark, "warc"), **options)
    back = read_archives(spark, manifest)
    sound = F.when(F.col("block_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("bad digest of page "), F.col("page_id"))))
    return back.select("page_id", "payload_bytes", sound.cast("string").alias("payload_digest"), "record_type", "refers_to")


__all__ = ["read_archives", "read_at", "warc_round_trip", "write_archives"]
