"""Near-duplicate classes through SimHash: pigeonhole blocks, then a stated Jaccard similarity.

With ``max_distance``, classes are first those of SimHash near-duplicate detection: 64-bit majority
fingerprints of the distinct shingles, joined on the blocks of bits that a pair within that distance
must share (``simhash_dedup.links``, nothing dropped in any cell), verified by Hamming distance.
Every such pair is a link. The steps below add the pairs of the stated similarity whose
fingerprints lie further apart.

Texts of similarity 0.8 differ in about 15 of 100 fingerprint bits, and no split into blocks that
are worth joining on is sure to leave an equal one for so many. So the pigeonhole is applied to
the shingles themselves; candidates are verified by the Hamming distance of ``WIDTH``-bit SimHash
fingerprints of the shingles, and those left are settled by their shingle sets. Without
``max_distance``, links are thus pairs of that similarity exactly; 64-bit hashes stand for shingles.

* Blocks: two sets of n and m shingles have similarity t or more only if they share t / (1 + t) *
  (n + m) of them. So if all sets are put in one common order, a pair's first shared shingle leaves
  at least that many in both and lies among the first n - ceil(t * n) + 1. The order is by hash,
  which is random, but for frequent shingles, which come last: so at least half of what a pair
  shares is ordered at random, unless frequent ones are t / 2 of both texts. Then the first shared
  one comes after ``FIRST`` = 32 others with a probability below 3 ** -32 (the others left in
  front are less than a third). A text posts its first 32, or all of the exact bound where that is
  less or where frequent shingles are t / 2 of it.
* Frequent: shingles are counted in ``2**BUCKET_BITS`` buckets, a state of fixed size; those of a
  bucket well above the mean are frequent. The choice changes costs, not links.
* Hamming: a bit differs with probability 0.151 at most at similarity 0.8 (the angle between the
  sets), so over ``distance_limit`` of 128 bits, 50 there, have a probability below 1e-9. Texts of
  fewer than ``SURE`` shingles are not judged by it.
* Cells of up to ``cell_limit`` members give all their pairs. Those of a larger cell are first only
  compared with its smallest id; then every pair of members that is not connected yet is judged,
  for which such cells are dealt in blocks, and a task holds two at most.
  Before, a task holds a cell's ids, sizes and fingerprints (40 bytes a member).

Texts of equal words are one row first, so copies are one member of a cell.

Defined results: null or empty text has no words, and texts without words are one class; rows that
repeat an id are one document with several texts, linked by any of them; rows with a null id take
the class of a text equal to theirs, null if there is none, and link nothing; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import simhash_dedup
from weftline.llm.common import components, materialise, text_column

BUCKET_BITS = 21
PART_BITS = 15  # buckets of one row when counts are summed
WIDTH = 128
FIRST = 32
SURE = 64


def mixed(values: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle_words, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed((out ^ each[i : i + len(out)]) + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def signatures(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``(doc_id, key, fp)`` of every text, where key stands for its words and fp is its 64-bit
    fingerprint, and from each task ``(part, counts)`` of its shingles' buckets, which stop at 65,535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(1 << BUCKET_BITS, np.int64), ["doc_id", "key", "fp", "part", "counts"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                keys, prints, found = [], [], []
                for text in rows.column(1).to_pylist():
                    words = text.lower().split()
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    hashes = shingle_hashes(words, shingle_words)
                    prints.append(fingerprint(hashes))
                    found.append(bucket(hashes))
                at, n = np.unique(np.concatenate(found), return_counts=True)
                counts[at] += n
                none = pa.nulls(rows.num_rows)
                arrays = [rows.column(0), pa.array(keys, pa.binary()), pa.array(prints, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)
        if counts.any():
            cut = np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, 1 << PART_BITS)
            none = pa.nulls(len(cut))
            arrays = [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return texts.mapInArrow(run, "doc_id long, key binary, fp long, part int, counts binary")


def frequent_buckets(signed: DataFrame) -> np.ndarray:
    """Whether each bucket's count is well above the mean; as bytes of 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(counts.as_py(), np.uint16)
                sums[part] = sums[part] + more if part in sums else more.astype(np.int64)
        found = [np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(found, pa.binary())], ["part", "total"])

    out = np.zeros((1 << BUCKET_BITS - PART_BITS, 1 << PART_BITS), np.uint32)
    parts = signed.where("part is not null").select("part", "counts").repartition("part")
    for row in parts.mapInArrow(run, "part int, total binary").collect():  # 4 * 2 ** BUCKET_BITS bytes
        out[row["part"]] = np.frombuffer(row["total"], np.uint32)
    mean = out.mean()
    return (out.ravel() > mean + 8 * mean**0.5 + 32).astype(np.uint8)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of a text's shingles as a signed 64-bit integer; 0 without shingles."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_links(heads: DataFrame, max_distance: int) -> DataFrame:
    """Links ``(u, v)`` of ``heads(head, fp)`` that connect just what all pairs of fingerprints
    within ``max_distance`` bits connect: equal ones, and those the pigeonhole blocks find."""
    first = materialise(heads.groupBy("fp").agg(F.min("head").alias("first")), "similar-fingerprints")
    equal = heads.join(first, "fp").where("head <> first").select(F.col("head").alias("u"), F.col("first").alias("v"))
    near_ = simhash_dedup.links(first.select("fp"), max_distance)
    apart = (
        near_.join(first.select(F.col("fp").alias("u"), F.col("first").alias("hu")), "u")
        .join(first.select(F.col("fp").alias("v"), F.col("first").alias("hv")), "v")
        .select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    )
    return materialise(equal.unionByName(apart), "similar-near")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority bits of a text's shingles, two 64-bit words; ``hashes`` are the shingles'."""
    ones = np.zeros(WIDTH, np.int64)
    for start in range(0, len(hashes), 1 << 13):
        part = hashes[start : start + (1 << 13)]
        both = np.stack([part, mixed(part + np.uint64(0x9E3779B97F4A7C15))], axis=1)
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def distance_limit(similarity: float) -> int:
    """Bits in which a pair of that similarity may differ: mean and 7.5 deviations."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return min(WIDTH, math.ceil(WIDTH * p + 7.5 * (WIDTH * p * (1 - p)) ** 0.5))


def near(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], size: np.ndarray, limit: int) -> np.ndarray:
    """Whether fingerprints lie within the limit; ``size`` is the lesser number of shingles."""
    apart = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(a, b, strict=True))
    return (apart <= limit) | (size < SURE)


def prefix_posts(texts: DataFrame, frequent: np.ndarray, similarity: float, shingle_words: int) -> DataFrame:
    """``(cell, head, size, rest, a, b)``: the shingles among which a text's first shared one must
    lie, how many of its ``size`` shingles are left there, and its fingerprint."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # 2 ** BUCKET_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                cells, sizes, posted, prints = [], [], [], []
                for text in rows.column(1).to_pylist():
                    found = shingle_hashes(text.lower().split(), shingle_words)
                    n = len(found)
                    late = frequent[bucket(found)]
                    keep = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                    if late.sum() < similarity / 2 * n:
                        keep = min(keep, FIRST)
                    cells.append(found[np.argsort(late, kind="stable")[:keep]])
                    sizes.append(n)
                    posted.append(keep)
                    prints.append(wide_fingerprint(found))
                size = np.repeat(np.array(sizes, np.int32), posted)
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in posted])
                heads = np.repeat(rows.column(0).to_numpy(), posted)
                a, b = np.repeat(np.array(prints), posted, axis=0).T
                arrays = [np.concatenate(cells).view(np.int64), heads, size, size - at, np.ascontiguousarray(a), np.ascontiguousarray(b)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["cell", "head", "size", "rest", "a", "b"])

    return texts.mapInArrow(run, "cell long, head long, size int, rest int, a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows again, cut only where one of the first ``keys`` columns changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy() for c in batch.columns]
        edges = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            edges[1:] |= part[k][1:] != part[k][:-1]
            edges[0] |= bool(held) and part[k][0] != held[-1][k][-1]
        at = np.flatnonzero(edges)
        if len(at):
            last = at[-1]
            done = [*held, [c[:last] for c in part]]
            yield [np.concatenate(c) for c in zip(*done, strict=True)]
            held, part = [], [c[last:] for c in part]
        held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def distinct_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, v = (np.concatenate(c) for c in zip(*pairs, strict=True))
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new]


def meetings(posts: DataFrame, similarity: float, cell_limit: int) -> DataFrame:
    """Candidate pairs ``(u, v)`` of the cells, with ``cell`` null; and the members of each cell of
    more than ``cell_limit`` as ``(u, v, cell, size, rest, a, b)`` with the cell's smallest id as v."""
    names = ["u", "v", "cell", "size", "rest", "a", "b"]
    limit = distance_limit(similarity)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = distinct_pairs(held)
        none = pa.nulls(len(u))
        long, short = none.cast(pa.int64()), none.cast(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), long, short, short, long, long], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for cell, head, size, rest, a, b in whole_groups(batches, 1):
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            n = np.diff(np.append(starts, len(cell)))
            first, members = np.repeat(starts, n), np.repeat(n, n)
            many = members > cell_limit
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (head, head[first], cell, size, rest, a, b)], names)
            few = np.flatnonzero((members > 1) & ~many)
            for step in range(1, cell_limit):
                few = few[few + step < first[few] + members[few]]
                if not len(few):
                    break
                x, y = few, few + step
                need = similarity * (size[x].astype(np.int64) + size[y]) - 1e-6
                use = (np.minimum(rest[x], rest[y]) * (1 + similarity) >= need) & (head[x] != head[y])
                use &= near((a[x], b[x]), (a[y], b[y]), np.minimum(size[x], size[y]), limit)
                held.append((head[y[use]], head[x[use]]))
                size_held += int(use.sum())
            if size_held > 1_000_000:
                yield rows(held)
                held, size_held = [], 0
        if size_held:
            yield rows(held)

    met = posts.repartition("cell").sortWithinPartitions("cell", "head")
    return met.mapInArrow(run, "u long, v long, cell long, size int, rest int, a long, b long")


def crowd_pairs(crowd: DataFrame, member: DataFrame, similarity: float, block_rows: int = 4096) -> DataFrame:
    """Distinct pairs ``(u, v)`` of members of a crowded cell that may have the similarity and are
    not connected by ``member(id, component_id)``."""
    limit = distance_limit(similarity)
    # The size up to which a partner may have the similarity with this member.
    upto: Column = F.floor(F.col("rest") * ((1 + similarity) / similarity) - F.col("size") + 1e-6)
    known = crowd.join(member, crowd["u"] == member["id"], "left").select(
        "cell", F.col("u").alias("head"), F.col("size").cast("long").alias("size"), upto.cast("long").alias("upto"),
        F.coalesce("component_id", "u").alias("c"), "a", "b",
    )
    known = materialise(known, "similar-crowd")
    cells = known.groupBy("cell").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("size").alias("least"), F.max("upto").alias("most"))
    able = known.join(cells.where("c0 < c1").drop("c0", "c1"), "cell").where("upto >= least and size <= most")
    able = materialise(able.drop("least", "most"), "similar-able")
    blocks = able.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = able.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    dealt = dealt.select("cell", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "size", "head", "upto", "c", "block", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, i, j, size, head, upto, c, block, a, b in whole_groups(batches, 3):
            new = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(cell)]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                z, h, up, k, own, fa, fb = (x[s:e] for x in (size, head, upto, c, block, a, b))
                # Each member with those before it, which are not larger.
                lo = np.searchsorted(z, np.ceil(similarity * z - 1e-6))
                hi = np.minimum(np.searchsorted(z, up, "right"), np.arange(len(z)))
                n = np.maximum(hi - lo, 0)
                for part in np.split(np.arange(len(z)), np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1):
                    x = np.repeat(part, n[part])
                    y = np.arange(len(x)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(lo[part], n[part])
                    use = (up[y] >= z[x]) & (k[x] != k[y]) & (h[x] != h[y])
                    if i[s] != j[s]:
                        use &= own[x] != own[y]
                    use &= near((fa[x], fb[x]), (fa[y], fb[y]), np.minimum(z[x], z[y]), limit)
                    if use.any():
                        x, y = h[x[use]], h[y[use]]
                        u, v = distinct_pairs([(np.maximum(x, y), np.minimum(x, y))])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    met = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "size")
    return met.mapInArrow(run, "u long, v long").distinct()


def chosen_texts(texts: DataFrame, ids: DataFrame, how: str, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Texts joined with ``ids(doc_id)``, which are broadcast while they are few."""
    return texts.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", how)


def exact_links(pairs: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The pairs whose shingle sets have that similarity. Only texts that occur in a pair are cut
    into shingles."""
    ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "similar-ids")
    chosen = chosen_texts(texts, ids, "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                found = [shingle_hashes(x.lower().split(), shingle_words).view(np.int64) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "set"])

    sets = materialise(chosen.mapInArrow(cut, "doc_id long, set array<long>").distinct(), "similar-sets")
    wide = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("b")), "v")
    shared = wide.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("n"))
    return shared.where(F.col("both") >= similarity * (F.col("n") - F.col("both")) - 1e-9).select("u", "v")


def similar_classes(
    docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, cell_limit: int = 32, max_distance: int | None = None
) -> DataFrame:
    """``(doc_id, component_id)``: the smallest id reachable through links of that similarity, and
    with ``max_distance`` also through fingerprints within so many bits."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).cast("binary").alias("text"))
    both = materialise(signatures(texts, shingle_words), "similar-signatures")
    signed = both.where("key is not null").select("doc_id", "key", "fp")
    heads = materialise(signed.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("head"), F.min("fp").alias("fp")), "similar-heads")
    copies = signed.select("doc_id").distinct().join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_anti")
    copies = materialise(copies.where("doc_id is not null"), "similar-copies")
    alone = chosen_texts(texts.where("doc_id is not null"), copies, "left_anti")
    met = materialise(meetings(prefix_posts(alone, frequent_buckets(both), similarity, shingle_words), similarity, cell_limit), "similar-cells")
    pairs = materialise(met.where("u <> v").select("u", "v").distinct(), "similar-pairs")
    linked = exact_links(pairs, texts, similarity, shingle_words)
    if max_distance is not None:
        linked = fingerprint_links(heads.select("head", "fp"), max_distance).unionByName(linked)
    first = materialise(components(linked, "similar-components"), "similar-first")
    open_ = materialise(crowd_pairs(met.where("cell is not null"), first, similarity), "similar-open")
    settled = exact_links(open_, texts, similarity, shingle_words)
    links = first.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(settled)
    member = components(links, "similar-components")
    labelled = heads.join(member, heads["head"] == member["id"], "left").select("key", F.coalesce("component_id", "head").alias("component_id"))
    return signed.drop("fp").join(labelled, "key", "left").select("doc_id", "component_id")


def keep_first_similar(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest id of their class, all columns as they were. Rows that
    repeat an id stay or go together; rows with a null id stay."""
    gone = similar_classes(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
