"""Packing documents into fixed-length token sequences: first-fit decreasing in random groups.

Each document is encoded in one Arrow pass and cut by itself alone: full sequences first, then
the rest as one piece. So only piece rows (ids' checksums, never ids) are shuffled. Pieces are
dealt to groups of about ``group_pieces`` by a seeded hash; each group is packed alone by
first-fit decreasing, where a tournament tree over the bins' free room finds the first bin that
fits in logarithmic time. Groups have a fixed expected size whatever the input, so no task holds
more than a few groups' rows, and a document of any length spreads over many groups.

Defined results: null or empty text has the end id alone; rows that repeat an id or have a null
one are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, text_column
from weftline.llm.token_cache import cached

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Tournament tree over bins in opening order; each node holds the most free room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """Put ``need`` into the first bin with enough room and return that bin."""
        most, node = self.most, 1
        while node < self.size:
            node *= 2
            if most[node] < need:
                node += 1
        found = node - self.size
        most[node] -= need
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ties keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    tree, filled = RoomTree(len(lengths), room), np.zeros(len(lengths), np.int64)
    for at in order.tolist():
        n = int(lengths[at])
        b = tree.place(n)
        bins[at], offsets[at] = b, filled[b]
        filled[b] += n
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, end_id: int, room: int) -> DataFrame:
    """A row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = cached(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            at, start, length, crc, whole = [], [], [], [], []
            for row, found in enumerate(tokens.encode_all(batch.column(1))):
                ids = np.concatenate([found, end], dtype="<u4")
                for first in range(0, len(ids), room):
                    part = ids[first : first + room]
                    at.append(row)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    whole.append(len(ids))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, whole))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, room: int = 2048, group_pieces: int = 4096, seed: int = 11
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    # The number of a written row deals it out, so that no id, null or repeated, fills a group.
    cut = materialise(pieces(docs, vocabulary, end_id, room).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), room)
        sequence = group["g"].to_numpy() * (1 << 32) + bins
        return group.drop_columns(["g", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, PIECES + ", sequence_id long, offset long")
