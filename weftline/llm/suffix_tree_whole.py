"""The whole suffix tree of op 8: every context and next symbol found twice or more, and its scores.

Texts become chunks of word codes (written once, with the training counts of their rare words). The
positions of a chunk, alike ones together, go in compressed blocks to the bucket of the last word of
their context. A word found less than twice in training is in no sequence found twice: it ends the
context it stands in, and as next symbol it is any other one. A bucket holds all that its contexts are made of, whatever their length: it counts,
tests the states, scores its own positions and returns one sum for each chunk and text.

A context of ``bucket // 4`` training tokens or more is hot (and some of three quarters of that, so
there are five a bucket and length at most). Its positions are dealt by one word more of the context;
next symbols are counted by chunk, then in blocks by sequence, and each position brings its count
along. So no bucket gathers a hot context of less than ``max_order`` words; one of ``max_order``
words brings its different positions of each chunk.

64-bit hashes stand for word sequences. Defined results are those of ``suffix_tree_lm``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise, text_column
from weftline.llm.simhash_similar import mixed
from weftline.llm.suffix_tree_lm import END, Lexicon, text_tokens, train

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, byte by byte of their items."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = [np.empty((a.itemsize, len(a)), np.uint8) for a in arrays]
    for a, plane in zip(arrays, planes, strict=True):
        plane[:] = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]))


def smallest(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def unpacked(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for part in data[4:at].decode().split(";"):
        kind, n = np.dtype(part.split(",")[0]), int(part.split(",")[1])
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.empty(n, kind))
        for i, plane in enumerate(planes):
            out[-1].view(np.uint8)[i :: kind.itemsize] = plane
        at += n * kind.itemsize
    return out


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of a sorted column."""
    value, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        for start, end in pairwise([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]):
            if held and values[start] != value:
                yield int(value), pa.Table.from_batches(held)
                held = []
            value = values[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield int(value), pa.Table.from_batches(held)


def rows_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def found_at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted ``table``, and where; of equal neighbours one is looked up."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    heads = keys if 2 * len(start) > len(keys) else keys[start]
    order = in_order(heads)  # neighbours are found near each other
    at = np.empty(len(heads), np.int64)
    at[order] = np.minimum(np.searchsorted(table, heads[order]), len(table) - 1)
    hit = table[at] == heads
    if heads is keys:
        return hit, at
    n = np.diff(np.append(start, len(keys)))
    return np.repeat(hit, n), np.repeat(at, n)


def in_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of hashes. Their high bits with the place below are sorted, which is faster
    than a stable sort; where these bits do not tell two hashes apart, that is done."""
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    found = keys[order]
    return np.argsort(keys, kind="stable") if (found[1:] < found[:-1]).any() else order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of hashes and where in it each different one begins."""
    order = in_order(keys)
    found = keys[order]
    return order, np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(keys)])


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, the first place of each, and the place of each key among them."""
    order, start = grouped(keys)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
    one = order[start]
    return keys[one], one, back


def longer(sequence: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences with one more word behind, by pieces that stay in a core's cache."""
    out = np.empty_like(sequence)
    for start in range(0, len(out), 1 << 14):
        piece = slice(start, start + (1 << 14))
        out[piece] = mixed(sequence[piece] * np.uint64(0x9E3779B97F4A7C15) + word[piece])
    return out


def often(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """False where ``n`` adds up to less than 2 over a key; keys may be taken together."""
    bits = max(len(keys), 16).bit_length() + 2
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(slot, n, 1 << bits)[slot] > 1


STREAM = "chunk long, at long, word binary, block binary"


class Codes(dict):
    """Codes of frequent words, and of the rare words met since the last ``forget``."""

    def __init__(self, ids: dict[bytes, int], size: int):
        super().__init__(ids)
        self.size, self.rare = size, []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.size + len(self.rare)
        self.rare.append(word)
        return code

    def forget(self) -> None:
        for word in self.rare:
            del self[word]
        self.rare.clear()


def hot_words(counts: np.ndarray, least: int) -> np.ndarray:
    """Codes of the words that are hot contexts; the end symbol (1) is in no context."""
    many = np.flatnonzero(counts >= least)
    return many[many > 1]


def hot_runs(codes: np.ndarray, hot: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length from 2: hashes of the sequences of hot words in a row, and how often each is found.
    ``hot`` tells by code; each text ends with a word that is not hot."""
    at = np.flatnonzero(hot[np.minimum(codes, len(hot) - 1)])
    h, out = word_hashes(codes[at]), []
    sequence, last = h, np.arange(len(at))
    for _ in range(1, longest):
        keep = np.flatnonzero((last > 0) & (at[last - 1] == at[last] - 1)) if len(at) else last
        # The sequence before is that which ends one word earlier.
        place = np.full(len(at), -1)
        place[last] = np.arange(len(last))
        keep = keep[place[last[keep] - 1] >= 0]
        sequence, last = longer(sequence[place[last[keep] - 1]], h[last[keep]]), last[keep]
        out.append(np.unique(sequence, return_counts=True))
    return out


def word_codes(texts: DataFrame, lexicon: Lexicon, chunk_tokens: int, least: int, longest: int) -> DataFrame:
    """A block for each chunk of texts, and its rare words: code ``len(counts) + at`` in the block.
    Where ``at`` is -2: hot sequences of 2 to ``longest`` words that have in this chunk a quarter of the
    share of ``least`` or more; what others leave out of a sequence is less than a quarter of ``least``."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon.ids)  # bounded by the share of a common word
    size, total = len(lexicon.counts), lexicon.total
    hot = np.zeros(size + 1, bool)
    hot[hot_words(lexicon.counts, least)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = Codes(shared.value, size), TaskContext.get().partitionId() << 32
        docs, held, lengths, codes = [], [], [], []
        tokens = 0

        def rows() -> Iterator[pa.RecordBatch]:
            null = np.array([d is None for d in docs], np.uint8)
            block = packed(np.array([d or 0 for d in docs], np.int64), null, np.array(held, np.uint8), np.array(lengths, np.uint32), np.concatenate(codes))
            yield rows_of(STREAM, [chunk], [-1], [None], [block])
            if longest > 1 and hot.any():
                trained = np.concatenate([x for x, out in zip(codes, held, strict=True) if not out] or [np.zeros(0, np.uint32)])
                found = hot_runs(trained, hot, longest)
                share = 0.25 * least * len(trained) / total
                found = [(x[n >= share], n[n >= share]) for x, n in found]
                kinds = np.repeat(np.arange(2, longest + 1), [len(x) for x, _ in found])
                yield rows_of(STREAM, [chunk], [-2], [None], [packed(kinds, *map(np.concatenate, zip(*found, strict=True)))])
            words = known.rare
            for start in range(0, len(words), 100_000):
                part = words[start : start + 100_000]
                yield rows_of(STREAM, np.full(len(part), chunk), np.arange(start, start + len(part)), part, [None] * len(part))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                for doc, out, text in zip(part["doc_id"], part["held"], part["text"], strict=True):
                    words = text_tokens(text)
                    ids = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                    docs.append(doc)
                    held.append(out)
                    lengths.append(len(ids))
                    codes.append(ids)
                    tokens += len(ids)
                    if tokens >= chunk_tokens or len(docs) == 1 << 16:
                        yield from rows()
                        chunk, tokens = chunk + 1, 0
                        known.forget()
                        for x in (docs, held, lengths, codes):
                            x.clear()
        if docs:
            yield from rows()

    return texts.mapInArrow(run, STREAM)


BLOCKS = "chunk long, kind long, block binary"


def in_blocks(rows: DataFrame, kind: int, *names: str) -> DataFrame:
    """Columns of the rows as a block for each chunk and million rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            found = pa.Table.from_batches(held).sort_by([("chunk", "ascending"), (names[0], "ascending")])
            for chunk, part in runs(found.to_batches(), "chunk"):
                yield rows_of(BLOCKS, [chunk], [kind], [packed(*(part[x].to_numpy() for x in names))])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > 1_000_000:
                yield from blocks()
                held.clear()
        if sum(x.num_rows for x in held):
            yield from blocks()

    return rows.mapInArrow(run, BLOCKS)


def with_counts(stream: DataFrame, vocabulary: DataFrame, size: int, parts: int) -> DataFrame:
    """The blocks with global codes and training counts ``(code, c)`` of their rare words."""
    asked = stream.where("at >= 0").select("chunk", "at", "word").join(vocabulary.hint("shuffle_hash"), "word").select("chunk", "at", "code", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, found in runs(batches, "chunk"):
            block, *answers = (unpacked(x.as_py()) for x in found["block"])
            rare = [np.zeros(max(int(block[-1].max()) + 1 - size, 0), np.int64) for _ in range(2)]
            for at, *values in answers:
                for out, value in zip(rare, values, strict=True):
                    out[at] = value
            yield rows_of(BLOCKS, [chunk], [0], [packed(*block, *rare)])

    heads = stream.where("at = -1").select("chunk", F.lit(0).cast("long").alias("kind"), "block")
    return heads.unionByName(in_blocks(asked, 1, "at", "code", "c")).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, BLOCKS)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(codes), np.uint64)
    for start in range(0, len(out), 1 << 14):
        piece = slice(start, start + (1 << 14))
        out[piece] = mixed(codes[piece].astype(np.uint64) + np.uint64(1))
    return out


def sequence(words: list[np.ndarray], k: int) -> np.ndarray:
    """Hashes of the words from ``k`` before each token to the first in ``words``."""
    out = word_hashes(words[k])
    for j in range(k - 1, -1, -1):
        out = longer(out, word_hashes(words[j]))
    return out


def hot_place(hot: list[np.ndarray], k: int, words: list[np.ndarray], before: np.ndarray | None) -> np.ndarray:
    """The place of the context of ``k`` words before each token among the hot ones of that length, or -1.
    ``before``: that of the context of one word less. ``hot[0]`` has the place of each frequent word, and -1 for others."""
    first = hot[0][np.minimum(words[k], len(hot[0]) - 1)]
    if k == 1:
        return first
    at = np.flatnonzero((first >= 0) & (before >= 0))
    hit, where = found_at(hot[k], sequence([w[at] for w in words[1 : k + 1]], k - 1))
    out = np.full(len(first), -1)
    out[at[hit]] = where[hit]
    return out


class Positions:
    """The tokens of a chunk that follow a word found twice or more. ``words[k]`` are the global codes ``k``
    words before each, ``place`` of them at most; 0: none, or one found less than twice."""

    def __init__(self, block: bytes, counts: np.ndarray, kind: type, max_order: int):
        _, _, held, lengths, codes, rare, rare_c = unpacked(block)
        lengths = lengths.astype(np.int64) + 1  # each text with an end symbol before it
        first = np.cumsum(lengths) - lengths
        whole = np.ones(int(lengths.sum()), np.uint32)  # END has code 1
        inner = np.ones(len(whole), bool)
        inner[first] = False
        whole[inner] = codes
        count = np.concatenate([counts, rare_c])
        code = np.where(count < 2, 0, np.concatenate([np.arange(len(counts)), rare])).astype(kind)
        count, whole = count[whole], code[whole]
        place = np.zeros(len(whole), np.int8)
        for k in range(max_order):
            place[1:][(place[:-1] >= k) & (whole[:-1] > 0) & inner[1:]] = k + 1  # one more than the token before
        at = np.flatnonzero(place > 0)
        owner = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        self.owner, self.place, self.trained = owner[at], place[at], held[owner[at]] == 0
        self.words = [whole[at], *(np.where(self.place >= k, whole[np.maximum(at - k, 0)], 0) for k in range(1, max_order + 1))]
        self.count, self.max_order, self.at, self.whole = count[at], max_order, at, whole

    def hashed(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By length k: the context of k words before each token, and that with the token."""
        ending = h = word_hashes(self.whole)
        contexts, keys = [h[self.at]], [h[self.at]]
        for _ in range(self.max_order):
            before = np.zeros_like(ending)
            before[1:] = ending[:-1]
            ending = longer(before, h)
            contexts.append(before[self.at])
            keys.append(ending[self.at])
        return contexts, keys

    def hot(self, hot: list[np.ndarray]) -> list[np.ndarray]:
        """By length from 1: the place of the hot context that the token follows, or -1."""
        out: list[np.ndarray] = []
        for k in range(1, len(hot)):
            out.append(hot_place(hot, k, self.words, out[-1] if out else None))
        return out

    def asked(self, follows: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, ...]:
        """The tokens whose counts after hot contexts of ``k`` words are asked for, and the place of each
        among the different sequences; one token, the hash and the part of each of these, in order of parts."""
        at = np.flatnonzero((follows >= 0) & (self.words[0] > 0))
        words = [w[at] for w in self.words[: k + 1]]
        keys, one, back = different(sequence(words, k))
        # All sequences with the same last two words meet in a part, so with their suffixes.
        part = ((sequence([w[one] for w in words[:2]], 1) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        rank = np.argsort(part, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        return at, place[back], at[one[rank]], keys[rank], part[rank]


ASKED = "part long, chunk long, block binary"
SUMS = "context long, occurs long, entries long, mass double, free double, inner double"


def hot_contexts(stream: DataFrame, lexicon: Lexicon, max_order: int, least: int) -> list[np.ndarray]:
    """By length the sorted hashes of hot contexts; at 0, the place of each frequent word among those of one."""
    many = hot_words(lexicon.counts, least)
    h = word_hashes(many)
    hot = [np.full(len(lexicon.counts) + 1, -1), np.sort(h)]
    hot[0][many] = np.argsort(np.argsort(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                kinds, keys, n = unpacked(block)
                yield rows_of("k long, key long, n long", kinds, keys.view(np.int64), n)

    if max_order > 2 and len(many):
        found = stream.where("at = -2").mapInArrow(run, "k long, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
        rows = found.where(F.col("n") >= 0.75 * least).toArrow()  # at most total / (0.75 * least) of each length
        for k in range(2, max_order):
            hot.append(np.sort(rows["key"].to_numpy()[rows["k"].to_numpy() == k].view(np.uint64)))
    while not len(hot[-1]):
        hot.pop()
    return hot


def hot_counts(
    chunks: DataFrame, shared, lexicon: Lexicon, hot: list[np.ndarray], parts: int
) -> tuple[list[dict[str, np.ndarray]], DataFrame]:
    """By length the states of the hot contexts (``occurs``, ``back``: NaN if none); the counts that
    each chunk asked for, as blocks of ``(at, n)`` for each length."""
    spark = chunks.sparkSession
    tables, lengths, (total, discount) = spark.sparkContext.broadcast(hot), range(1, len(hot)), (lexicon.total, lexicon.discount)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block"), strict=True):
                p = Positions(block.as_py(), *shared.value, len(lengths))
                follows, where, columns, cuts = p.hot(tables.value), np.zeros(len(p.owner), np.int64), [], []
                for k in lengths:
                    at, place, one, key, part = p.asked(follows[k - 1], k, parts)
                    n = np.bincount(place, p.trained[at], len(key)).astype(np.int64)
                    more = p.count[one] if k == 1 else where[one] - cuts[-1][part]  # the suffix has a place in the same part
                    where[at] = place
                    cuts.append(np.searchsorted(part, np.arange(parts + 1)))
                    columns.append((key, n, follows[k - 1][one], more))
                for part in range(parts):
                    ends = [(x[part], x[part + 1]) for x in cuts]
                    if any(end > start for start, end in ends):
                        rows = [smallest(x[start:end]) for (start, end), some in zip(ends, columns, strict=True) for x in some]
                        yield rows_of(ASKED, [part], [chunk], [packed(np.array([x for x, _ in ends]), *rows)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in runs(batches, "part"):
            blocks, entries, told = [unpacked(x.as_py()) for x in found["block"]], [], []
            for k in lengths:
                key, n, context, more = (np.concatenate([x[4 * k - 3 + i] for x in blocks]) for i in range(4))
                key = key.astype(np.uint64)
                _, one, mine = different(key)
                times = np.bincount(mine, n, len(one)).astype(np.int64)
                twice = np.flatnonzero(times > 1)
                one = one[twice]
                if k > 1:  # from the place in the block to that among the sequences found twice
                    more = below[more + np.repeat(first, [len(x[4 * k - 3]) for x in blocks])]
                sizes = np.array([len(x[4 * k - 3]) for x in blocks])
                first = np.cumsum(sizes) - sizes
                place = np.full(len(times), -1)
                place[twice] = np.arange(len(twice))
                below = place[mine]
                longer_, at = found_at(tables.value[k + 1], key[one]) if k + 1 < len(hot) else (np.zeros(len(one), bool), one)
                entries += [times[twice], context[one], more[one], at[longer_], times[twice][longer_]]
                told.append([(x[0][k - 1] + (at := np.flatnonzero(n > 1)), n[at]) for x, n in zip(blocks, np.split(times[mine], first[1:]), strict=True)])
            yield rows_of(BLOCKS, [part], [0], [packed(*map(smallest, entries))])
            for chunk, some in zip(found["chunk"].to_pylist(), zip(*told, strict=True), strict=True):
                yield rows_of(BLOCKS, [chunk], [1], [packed(*(smallest(x) for pair in some for x in pair))])

    asked = chunks.mapInArrow(ask, ASKED).repartition(parts, "part").sortWithinPartitions("part", "chunk")
    answers = materialise(asked.mapInArrow(answer, BLOCKS), "lm-told")
    states: list[dict[str, np.ndarray]] = [{}]
    for k in lengths:
        known = spark.sparkContext.broadcast(states)

        def sums(batches: Iterator[pa.RecordBatch], k=k, known=known) -> Iterator[pa.RecordBatch]:
            size = len(tables.value[k])
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    entries, log, occurs = unpacked(block), np.zeros(0), np.zeros(size)
                    for j in range(1, k + 1):
                        n, context, more = entries[5 * j - 5 : 5 * j - 2]
                        before = np.log10((more.astype(float) - discount) / total) if j == 1 else log[more]
                        if j < k:
                            state = known.value[j]
                            back = state["back"][context]
                            log = np.where(np.isnan(back), before, np.log10((n - 0.5) / state["occurs"][context]))
                    if k > 1:
                        occurs[entries[5 * k - 7]] = entries[5 * k - 6]  # found after a context of one word less
                    mass = n - 0.5
                    by = [np.bincount(context, x, size) for x in (np.ones(len(n)), mass, 10.0**before, mass * (np.log(mass) - before * np.log(10.0)))]
                    at = np.flatnonzero((by[0] > 0) | (occurs > 0))
                    yield rows_of(SUMS, at, occurs[at].astype(np.int64), by[0][at].astype(np.int64), *(x[at] for x in by[1:]))

        names = [x.split()[0] for x in SUMS.split(", ")][1:]
        rows = answers.where("kind = 0").mapInArrow(sums, SUMS).groupBy("context").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # hot contexts only
        at, (occurs, entries, mass, free, inner) = rows["context"].to_numpy(), (rows[x].to_numpy() for x in names)
        if k == 1:
            occurs = lexicon.counts[np.flatnonzero(hot[0] >= 0)][np.argsort(hot[0][hot[0] >= 0])][at]
        rest, free, inner = 1.0 - mass / occurs, 1.0 - free, (inner - mass * np.log(occurs)) / occurs
        able = (rest > 1e-9) & (free > 1e-9)
        ratio = np.where(able, rest, 1.0) / np.where(able, free, 1.0)
        state = able & (entries > 0) & (occurs * (inner + rest * np.log(ratio)) > entries + np.log(total))
        states.append({"occurs": np.ones(len(hot[k])), "back": np.full(len(hot[k]), np.nan)})
        states[k]["occurs"][at], states[k]["back"][at] = occurs, np.where(state, np.log10(ratio), np.nan)
    return states, answers.where("kind = 1")


KNOWN = "chunk long, kind long, block binary, told binary"


def with_answers(chunks: DataFrame, answers: DataFrame, lengths: int, parts: int) -> DataFrame:
    """The blocks with ``(at, n)`` of what follows hot contexts, by length of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, found in runs(batches, "chunk"):
            block, *blocks = found["block"]
            blocks = [unpacked(x.as_py()) for x in blocks]
            told = [np.concatenate([np.zeros(0, np.uint8), *(x[i] for x in blocks)]) for i in range(2 * lengths)]
            yield rows_of(KNOWN, [chunk], [0], [block.as_py()], [packed(*told)])

    return chunks.unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, KNOWN)


DEALT = "bucket long, chunk long, block binary"


def dealt(chunks: DataFrame, hot: list[np.ndarray], shared, max_order: int, buckets: int, parts: int) -> DataFrame:
    """The positions of each chunk, by bucket: codes, texts and training counts of alike ones."""
    tables = chunks.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value[0])
        for batch in batches:
            for chunk, block, told in zip(*(batch.column(x).to_pylist() for x in ("chunk", "block", "told")), strict=True):
                p, answers = Positions(block, *shared.value, max_order), unpacked(told) if told else []
                contexts, sequences = p.hashed()
                follows = p.hot(tables.value)
                route, known = contexts[1].copy(), []
                for k in range(1, len(tables.value)):
                    at, place, one, _, _ = p.asked(follows[k - 1], k, parts)
                    n = np.zeros(len(one), np.int64)
                    n[answers[2 * k - 2]] = answers[2 * k - 1]
                    known.append(np.zeros(len(route), np.int64))
                    known[-1][at] = n[place]
                    route = np.where(follows[k - 1] >= 0, np.where(p.place > k, contexts[k + 1], sequences[k]), route)
                order, start = grouped(np.choose(p.place - 1, sequences[1:]))
                one = order[start]
                bucket = (route[one] >> np.uint64(20)) % np.uint64(buckets)
                # Near words side by side, which only makes blocks smaller.
                near = (bucket << np.uint64(42)) + (np.minimum(p.words[1][one], (1 << 21) - 1).astype(np.uint64) << np.uint64(21))
                near += np.minimum(p.words[min(2, max_order)][one], (1 << 21) - 1)
                rank = np.argsort(near)
                texts, start = np.diff(np.append(start, len(order)))[rank], start[rank]
                one, bucket, upto = one[rank], bucket[rank], np.append(0, np.cumsum(texts))
                order = order[np.repeat(start - upto[:-1], texts) + np.arange(len(order))]
                owner = p.owner[order]
                trained = np.diff(np.append(0, np.cumsum(p.trained[order]))[upto])
                if not len(one):
                    continue
                words, texts, trained = [w[one] for w in p.words], texts.astype(np.uint32), trained.astype(np.uint32)
                rare, known = np.where(words[0] >= size, p.count[one], 0), [x[one] for x in known]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(one)]
                for start, end in pairwise(cuts):
                    block = packed(
                        np.concatenate([w[start:end] for w in words]), texts[start:end], trained[start:end], owner[upto[start] : upto[end]],
                        *(smallest(x[start:end]) for x in (rare, *known)),
                    )
                    yield rows_of(DEALT, [bucket[start]], [chunk], [block])

    return chunks.mapInArrow(run, DEALT)


def gains(
    words: list[np.ndarray], h: list[np.ndarray], count: np.ndarray, trained: np.ndarray, told: list[np.ndarray],
    hot: list[np.ndarray], states: list[dict[str, np.ndarray]], lexicon: tuple[int, float],
) -> np.ndarray:
    """What the states add to the log10 probability at the root, for positions of whole contexts."""
    total, discount = lexicon
    root = np.log10(np.maximum(count - discount, 1e-9) / total)  # of use where the word was found twice
    log, last = root.copy(), words[0] > 0  # whether the sequence with the token was found twice
    at, follows = np.arange(len(log)), None
    for k in range(1, len(words)):
        at = at[words[k][at] > 0]
        context = h[k][at]
        for j in range(k - 1, 0, -1):
            context = longer(context, h[j][at])
        n, back, whole = np.zeros(len(at)), np.full(len(at), np.nan), np.ones(len(at))
        is_hot = np.zeros(len(at), bool)
        if k < len(hot):  # what is known of hot contexts comes with the position
            follows = hot_place(hot, k, words, follows)
            is_hot = follows[at] >= 0
            mine = follows[at[is_hot]]
            n[is_hot], back[is_hot], whole[is_hot] = told[k - 1][at[is_hot]], states[k]["back"][mine], states[k]["occurs"][mine]
        key = longer(context, h[0][at])
        may = np.flatnonzero(last[at] & ~is_hot)
        may = may[often(key[may], trained[at[may]])]
        _, one, alike = different(key[may])
        times = np.bincount(alike, trained[at[may]], len(one))
        n[may] = times[alike]
        # Sums over the explicit next symbols of each context that has any.
        twice, times = may[one[times > 1]], times[times > 1]
        contexts, _, mine = different(context[twice])
        hit, of = found_at(contexts, context)
        hit &= ~is_hot
        of = of[hit]
        occurs = np.bincount(of, trained[at[hit]], len(contexts))
        p, q = (times - 0.5) / occurs[mine], 10.0 ** log[at[twice]]
        explicit = np.bincount(mine, minlength=len(contexts))
        rest = 1.0 - np.bincount(mine, p, len(contexts))
        free = 1.0 - np.bincount(mine, q, len(contexts))
        inner = np.bincount(mine, p * np.log(p / q), len(contexts))
        able = (rest > 1e-9) & (free > 1e-9)
        ratio = np.where(able, rest, 1.0) / np.where(able, free, 1.0)
        state = able & (occurs * (inner + rest * np.log(ratio)) > explicit + np.log(total))
        back[hit], whole[hit] = np.where(state, np.log10(ratio), np.nan)[of], occurs[of]
        in_state = ~np.isnan(back)
        explicit = in_state & (n > 1)
        log[at] = np.where(explicit, np.log10(np.where(explicit, (n - 0.5) / whole, 1.0)), log[at] + np.where(in_state, back, 0.0))
        last[at] = n > 1
        at = at[hit | is_hot]  # a longer context needs a symbol found twice after this one
    return log - root


def bucket_sums(blocks: DataFrame, hot: list[np.ndarray], states: list[dict[str, np.ndarray]], shared, lexicon: tuple[int, float], max_order: int, buckets: int) -> DataFrame:
    """A block for each bucket and chunk: texts, and what the states add to their scores."""
    tables = blocks.sparkSession.sparkContext.broadcast((hot, states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _ = shared.value
        for _, found in runs(batches, "bucket"):
            chunks, parts = found["chunk"].to_pylist(), [unpacked(x.as_py()) for x in found["block"]]
            sizes = np.array([len(x[1]) for x in parts])
            words = list(np.concatenate([x[0].reshape(max_order + 1, -1) for x in parts], axis=1))
            rare = np.concatenate([x[4] for x in parts]).astype(np.int64)
            count = np.where(rare > 0, rare, counts[np.minimum(words[0], len(counts) - 1)])
            trained = np.concatenate([x[2] for x in parts]).astype(np.int64)
            told = [np.concatenate(x) for x in zip(*(x[5:] for x in parts), strict=True)]
            more = gains(words, [word_hashes(w) for w in words], count, trained, told, *tables.value, lexicon)
            for chunk, x, part in zip(chunks, parts, np.split(more, np.cumsum(sizes)[:-1]), strict=True):
                sums = np.bincount(x[3], np.repeat(part, x[1]))
                at = np.flatnonzero(sums)
                yield rows_of(BLOCKS, [chunk], [1], [packed(at.astype(np.uint32), sums[at])])

    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, BLOCKS)


def whole_score(docs: DataFrame, held_out: Column, max_order: int = 3, bucket: int = 1_000_000, common: float = 1e-6) -> DataFrame:
    """``suffix_tree_lm.score`` with every context up to ``max_order`` words and every next symbol
    that occurs twice or more, whatever its share. ``bucket``: tokens of a bucket or chunk."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_column(docs).cast("binary").alias("text")
    )
    tree, vocabulary = train(texts.where("not held").select("text"), max_order=0, common=common)
    lexicon = tree.lexicon
    buckets, size, least = 1 + int(1.25 * lexicon.total) // bucket, len(lexicon.counts), max(bucket // 4, 2)
    # Global codes of rare words: their places in the vocabulary's parts, taken in turns.
    parts = (vocabulary.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    code = F.lit(size) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(parts) + F.shiftright("id", 33)
    vocabulary_ = vocabulary.select("word", "c", code.cast("long").alias("code"))
    kind = np.uint32 if (vocabulary_.agg(F.max("code")).first()[0] or 0) < 1 << 32 else np.uint64
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.counts, kind))
    stream = materialise(word_codes(texts, lexicon, bucket, least, max_order - 1), "lm-stream")
    hot = hot_contexts(stream, lexicon, max_order, least) if max_order > 1 else [np.full(size + 1, -1)]
    chunks = materialise(with_counts(stream, vocabulary_, size, buckets), "lm-chunks")
    discard(stream)
    discard(vocabulary)
    n_all, scale = int(lexicon.total), lexicon.total + 0.5 * (lexicon.distinct + 1)
    root = Lexicon({}, np.zeros(0), lexicon.total, lexicon.distinct, lexicon.discount, 0, 0).root

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block"), strict=True):
                ids, null, held, lengths, codes, _, rare_c, *_ = unpacked(block.as_py())
                count = np.concatenate([shared.value[0], rare_c])[codes]
                first = np.cumsum(lengths, dtype=np.int64) - lengths
                sums = (np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10((count + 0.5) / scale), np.log10(root(count))))
                yield rows_of(BLOCKS, [chunk], [0], [packed(ids, null, held, lengths, *sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, "chunk"):
            blocks = found["block"].to_pylist()
            ids, null, held, lengths, known, base, log = unpacked(blocks[0])
            log = log.copy()
            for block in blocks[1:]:
                at, more = unpacked(block)
                log[at] += more
            yield rows_of(SCORES, pa.array(ids, mask=null > 0), held > 0, lengths.astype(np.int64), known, np.full(len(ids), n_all), base, log)

    collect = docs.sparkSession._jvm.System.gc  # Spark then removes the shuffle files of written tables
    collect()
    if not lexicon.total or not max_order:
        rows = chunks.mapInArrow(rooted, BLOCKS)
    else:
        states, parts, told = [{}], 1 + buckets // 2, F.lit(None).cast("binary").alias("told")
        if len(hot) > 1:
            states, answers = hot_counts(chunks, shared, lexicon, hot, parts)
            known = materialise(with_answers(chunks, answers, len(hot) - 1, buckets), "lm-known")
            discard(chunks)
            chunks, told = known, "told"
            collect()
        blocks = dealt(chunks.select("chunk", "block", told), hot, shared, max_order, buckets, parts)
        added = bucket_sums(blocks, hot, states, shared, (lexicon.total, lexicon.discount), max_order, buckets)
        rows = chunks.mapInArrow(rooted, BLOCKS).unionByName(added)
    return rows.repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, SCORES)
