"""SimHash near-duplicate classes through pigeonhole blocks.

A fingerprint of ``width`` bits is cut into ``blocks`` blocks. Two fingerprints that differ in
at most ``max_distance`` bits agree on at least ``blocks - max_distance`` blocks, so every such
pair meets in one of the C(blocks, max_distance) tables keyed by the blocks that are left when
``max_distance`` of them are put aside. Candidates of a table are then verified by Hamming
distance.

Work is done on distinct fingerprints (all copies of one are a single row). Cells of a table
with at most ``cell_limit`` fingerprints are joined pairwise. In a larger cell that would be
quadratic, so each member instead posts itself under every value that the set-aside bits take
when at most one of them is flipped: fingerprints within two bits share such a value and those
that share one are within two bits, so linking each to the smallest fingerprint posted there
keeps exactly the same components with a bounded number of rows for each member. Nothing is
dropped at any cell size.

Defined results: null or empty text has the zero fingerprint and links like any other; repeated
rows of one id give one fingerprint row each; rows with a null id take the class of rows of equal
fingerprint and link nothing else (alone their class is null); an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, hex64, materialise, text_column

WIDTH = 64


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Majority bits over the XXH64 values of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle_words)), strict=False)]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(WIDTH, np.int64)
    for start in range(0, len(shingles), 1 << 14):
        part = [digest(x, 42) for x in shingles[start : start + (1 << 14)]]
        values = np.array(part, "<u8")
        set_bits += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every document: one Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                found = [fingerprint(x, shingle_words) for x in rows.column(1).to_pylist()]
                fp = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), fp], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def tables(blocks: int, max_distance: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """For each table: the mask of its key bits and the bit ranges set aside."""
    edge = [round(i * WIDTH / blocks) for i in range(blocks + 1)]
    out = []
    for aside in combinations(range(blocks), max_distance):
        mask = 0
        for b in range(blocks):
            if b not in aside:
                mask |= ((1 << (edge[b + 1] - edge[b])) - 1) << edge[b]
        out.append((mask, tuple((edge[b], edge[b + 1]) for b in aside)))
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(distinct: DataFrame, max_distance: int = 2, blocks: int = 4, cell_limit: int = 32) -> DataFrame:
    """Links ``(u, v)`` between fingerprints of ``distinct(fp long)`` that connect just what all
    pairs within ``max_distance`` bits connect."""
    found = tables(blocks, max_distance)
    if max_distance != 2:
        cell_limit = 1 << 62  # the flip posts below are for two bits
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, (m, _) in enumerate(found)))
        ).alias("cell"),
    ).select("fp", "cell.t", "cell.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(shared, ["t", "k"]), "simhash-cells")

    close: Column = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    few = members.where(F.col("n") <= cell_limit)
    pairs = (
        few.select("t", "k", F.col("fp").alias("u"))
        .join(few.select("t", "k", F.col("fp").alias("v")), ["t", "k"])
        .where(F.col("v") < F.col("u"))
        .where(close)
        .select("u", "v")
    )
    flips = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)) for lo, hi in aside for b in range(lo, hi)))
            for _, aside in found
        )
    )
    posts = members.where(F.col("n") > cell_limit).select(
        "t", F.col("fp").alias("u"), F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")
    )
    posts = posts.select("t", "u", F.col("u").bitwiseXOR(F.col("flip")).alias("at"))
    least = posts.groupBy("t", "at").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = posts.join(least, ["t", "at"]).where("u <> v").where(close).select("u", "v")
    return pairs.unionByName(stars)


def classes(fps: DataFrame, max_distance: int = 2, blocks: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for rows ``(doc_id, fp)``; component_id is the smallest id
    reachable by links, the document's own id included."""
    # One row for each fingerprint stands for all its copies, whatever their number.
    heads = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head"))
    heads = materialise(heads, "simhash-heads")
    found = links(heads.select("fp"), max_distance, blocks)
    by_head = (
        found.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("hu")), "u")
        .join(heads.select(F.col("fp").alias("v"), F.col("head").alias("hv")), "v")
        .select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    )
    member = components(by_head, "simhash-components")
    labelled = heads.join(member, heads["head"] == member["id"], "left").select(
        "fp", F.coalesce("component_id", "head").alias("component_id")
    )
    return fps.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2, blocks: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    fps = materialise(fingerprints(docs, shingle_words), "simhash-fingerprints")
    out = classes(fps, max_distance, blocks)
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest id of their class, all columns as they were.

    Of rows that repeat one id, all stay or go together. Rows with a null id form no class of
    others' rows and stay."""
    found = simhash_dedup(docs, **options)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


__all__ = ["classes", "fingerprint", "fingerprints", "keep_first", "links", "simhash_dedup"]
