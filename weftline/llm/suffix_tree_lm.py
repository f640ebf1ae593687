"""Probabilistic suffix tree over words: training and whole-text scoring.

``train`` and ``score`` hold a tree whose size is bounded by shares and broadcast. The query uses
``suffix_tree_whole``, which has every context and next symbol found twice or more.

Words are byte strings between spaces, A-Z lower-cased; each text ends with one end symbol.

Training of that tree, level by level over the corpus (all texts marked for training):

* Root: the count of every word, partially counted in each task, then summed. The root gives a
  known word (c - d) / N and the one unknown symbol the mass d * V / N that the absolute
  discount d = n1 / (n1 + 2 n2) frees.
* A context of k words is a candidate if its share of all tokens is at least ``min_context``,
  so a level has at most 1 / min_context candidates; a next symbol is explicit in it if the
  symbol's own share is at least ``min_next`` and the joint share at least ``min_joint``, so a
  level has at most 1 / min_joint entries. These shares bound what the driver gathers and what
  is broadcast, whatever the corpus; the other symbols of a context share its remaining mass in
  proportion to their probability after the next shorter state.
* A candidate becomes a state if its distribution diverges from that of its longest suffix
  state: its log-likelihood gain must exceed one for each entry and log N.

Scoring reads each text once. Words of share ``common`` or more (at most 1 / common of them)
are looked up in the task; the others go, once for each word and text, to a join with the whole
vocabulary by word (none of those is frequent, so no key is hot), and sums return by text.

Defined results: null or empty text is the end symbol alone; ids that repeat are rows of their
own; texts with a null id are trained on and scored like others; without training texts N is 0,
every word is unknown and the score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, text_column

END = b"\n"  # no word holds a line end


def text_tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


@dataclass
class Lexicon:
    """Frequent words by falling count: id 0 stands for every other word."""

    ids: dict[bytes, int]
    counts: np.ndarray  # by id
    total: int  # tokens in training
    distinct: int
    discount: float
    contexts: int  # ids up to this may stand in contexts
    nexts: int  # ids up to this may be explicit next symbols

    def root(self, count: np.ndarray) -> np.ndarray:
        """Probability at the root of words with these training counts."""
        n = max(self.total, 1)
        unknown = self.discount * self.distinct / n if self.total else 1.0
        return np.where(count > 0, (count - self.discount) / n, unknown)


@dataclass
class Level:
    """Candidate contexts of one length: ``keys`` are prefix index * size + last word id, sorted."""

    keys: np.ndarray
    occurs: np.ndarray  # how often each is followed by a token
    suffix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # index in the level below, by candidate
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # state number, or that of the suffix


@dataclass
class SuffixTree:
    """States are numbered from 1, 0 is the root."""

    lexicon: Lexicon
    levels: list[Level]
    keys: np.ndarray  # state * size + next id, sorted
    logs: np.ndarray  # log10 probability of each entry
    back: np.ndarray  # log10 factor of leaving each state for its parent
    parent: np.ndarray

    @property
    def size(self) -> int:
        return len(self.lexicon.counts)


def contexts_at(levels: list[Level], size: int, contexts: int, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each level, the candidate that precedes each token, or -1. ``ids`` holds whole texts
    one after another, ``first`` marks where each begins; what precedes a text is its end."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first] = 1 if size > 1 else 0
    out: list[np.ndarray] = []
    for k, level in enumerate(levels):
        if k == 0:
            out.append(np.where((before > 0) & (before <= contexts), before, 0) - 1)
            continue
        prior = np.empty_like(out[-1])
        prior[1:] = out[-1][:-1]
        prior[first] = -1
        key = np.where((prior >= 0) & (out[0] >= 0), prior * size + before, -1)
        at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
        hit = (level.keys[at] == key) & (key >= 0) if len(level.keys) else np.zeros(len(key), bool)
        out.append(np.where(hit, at, -1))
    return out


def id_stream(lexicon: Lexicon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of texts in a row (the end symbol is an id too) and where each text begins."""
    get, flat, lengths = lexicon.ids.get, [], []
    for text in texts:
        words = text_tokens(text)
        lengths.append(len(words))
        flat += [get(w, 0) for w in words]
    lengths = np.array(lengths, np.int64)
    return np.array(flat, np.int64), np.cumsum(lengths) - lengths


def _batches(batches: Iterator[pa.RecordBatch], column: str, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part, part.column(column).to_pylist()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of all texts; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "n"]
            )

        for _, part in _batches(batches, "text"):
            for text in part:
                counted.update(text_tokens(text))
            if len(counted) > 400_000:
                yield rows()
                counted.clear()
        if counted:
            yield rows()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def next_counts(texts: DataFrame, lexicon: Lexicon, levels: list[Level]) -> DataFrame:
    """``(key, n)``: how often each explicit next symbol follows each candidate of the last level."""
    size, depth = len(lexicon.counts), len(levels)
    shared = texts.sparkSession.sparkContext.broadcast((lexicon, levels))  # bounded by the shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, levels = shared.value
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

        def rows(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

        for _, part in _batches(batches, "text"):
            ids, first = id_stream(lexicon, part)
            at = contexts_at(levels, size, lexicon.contexts, ids, first)[depth - 1]
            use = (at >= 0) & (ids > 0) & (ids <= lexicon.nexts)
            found, n = np.unique(at[use] * size + ids[use], return_counts=True)
            keys.append(found)
            counts.append(n)
            held += len(found)
            if held > 3_000_000:
                found, n = merged()
                if len(found) > 1_500_000:
                    yield rows(found, n)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [found], [n], len(found)
        if held:
            yield rows(*merged())

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def grow(lexicon: Lexicon, levels: list[Level], entries: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
    """Keep the diverging candidates as states, shortest first."""
    size, n_all = len(lexicon.counts), max(lexicon.total, 1)
    root = lexicon.root(lexicon.counts.astype(float))
    state_keys: list[np.ndarray] = []
    state_logs: list[np.ndarray] = []
    back, parent = [0.0], [0]
    dists: list[dict[int, float]] = [{}]

    def prob(state: int, word: int) -> float:
        factor = 1.0
        while state:
            found = dists[state].get(word)
            if found is not None:
                return factor * found
            factor *= 10.0 ** back[state]
            state = parent[state]
        return factor * root[word]

    for k, (level, (keys, counts)) in enumerate(zip(levels, entries, strict=True)):
        level.state = np.zeros(len(level.keys), np.int64)
        starts = np.searchsorted(keys, np.arange(len(level.keys)) * size)
        ends = np.searchsorted(keys, (np.arange(len(level.keys)) + 1) * size)
        for c in range(len(level.keys)):
            above = 0 if k == 0 else int(levels[k - 1].state[level.suffix[c]])
            level.state[c] = above
            s, e = starts[c], ends[c]
            if s == e:
                continue
            words, n = keys[s:e] % size, counts[s:e]
            whole = float(level.occurs[c])
            p = (n - 0.5) / whole
            rest = 1.0 - p.sum()
            q = np.array([prob(above, int(w)) for w in words])
            free = 1.0 - q.sum()
            if rest <= 1e-9 or free <= 1e-9:
                continue
            gain = whole * (float((p * np.log(p / q)).sum()) + rest * np.log(rest / free))
            if gain <= len(words) + np.log(n_all):
                continue
            state = len(back)
            level.state[c] = state
            back.append(float(np.log10(rest / free)))
            parent.append(above)
            dists.append(dict(zip(words.tolist(), p.tolist(), strict=True)))
            state_keys.append(state * size + words)
            state_logs.append(np.log10(p))
    keys = np.concatenate([np.zeros(0, np.int64), *state_keys])
    logs = np.concatenate([np.zeros(0), *state_logs])
    order = np.argsort(keys)
    return SuffixTree(lexicon, levels, keys[order], logs[order], np.array(back), np.array(parent, np.int64))


def train(
    texts: DataFrame, max_order: int = 3, min_context: float = 1e-4, min_next: float = 1e-5, min_joint: float = 1e-6, common: float = 1e-6
) -> tuple[SuffixTree, DataFrame]:
    """The tree and the whole vocabulary ``(word, c, id)``, a written table."""
    vocabulary = materialise(word_counts(texts).withColumn("id", F.monotonically_increasing_id()), "lm-vocabulary")
    total, distinct, ones, twos = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
    ).first()
    # At most 1 / common words have such a share; the end symbol always gets id 1.
    got = vocabulary.where((F.col("c") >= max(common * total, 1)) | (F.col("word") == F.lit(END))).toArrow()
    words, counts = got["word"].to_pylist(), np.array(got["c"].to_numpy(), np.int64)
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
    counts = np.concatenate([[0], counts[order]]).astype(np.int64)

    def upto(share: float) -> int:
        return 1 + int((counts[2:] >= max(share * total, 1)).sum()) if len(counts) > 1 else 0

    discount = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
    lexicon = Lexicon({words[i]: r + 1 for r, i in enumerate(order)}, counts, int(total), int(distinct), discount, upto(min_context), upto(min_next))
    size, floor, wide = len(counts), max(min_joint * total, 2), max(min_context * total, 2)
    levels: list[Level] = []
    entries: list[tuple[np.ndarray, np.ndarray]] = []
    level = Level(np.arange(1, lexicon.contexts + 1), counts[1 : lexicon.contexts + 1])
    sequences = [(int(w),) for w in level.keys]
    while len(level.keys) and len(levels) < max_order:
        levels.append(level)
        found = next_counts(texts, lexicon, levels).where(F.col("n") >= floor).orderBy("key").toArrow()  # at most 1 / min_joint rows
        keys, n = np.array(found["key"].to_numpy(), np.int64), np.array(found["n"].to_numpy(), np.int64)
        entries.append((keys, n))
        longer = (n >= wide) & (keys % size <= lexicon.contexts) & (keys % size > 1)  # no context runs over a text's end
        below = {s: i for i, s in enumerate(sequences)}
        nxt = Level(keys[longer], n[longer])
        grown = [sequences[int(k // size)] + (int(k % size),) for k in nxt.keys]
        has = np.array([s[1:] in below for s in grown], bool)
        nxt.keys, nxt.occurs = nxt.keys[has], nxt.occurs[has]
        sequences = [s for s, ok in zip(grown, has, strict=True) if ok]
        nxt.suffix = np.array([below[s[1:]] for s in sequences], np.int64)
        level = nxt
    return grow(lexicon, levels, entries), vocabulary


def score_stream(tree: SuffixTree, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each token but for the root's part where its id is 0."""
    size, out = tree.size, np.zeros(len(ids))
    state = np.zeros(len(ids), np.int64)
    for level, at in zip(tree.levels, contexts_at(tree.levels, size, tree.lexicon.contexts, ids, first), strict=True):
        hit = at >= 0
        state[hit] = level.state[at[hit]]
    open_ = np.arange(len(ids))
    while len(open_ := open_[state[open_] > 0]):
        s = state[open_]
        key = np.where(ids[open_] > 0, s * size + ids[open_], -1)
        at = np.minimum(np.searchsorted(tree.keys, key), max(len(tree.keys) - 1, 0))
        hit = tree.keys[at] == key
        out[open_[hit]] += tree.logs[at[hit]]
        state[open_[hit]] = -1  # found
        left = ~hit
        out[open_[left]] += tree.back[s[left]]
        state[open_[left]] = tree.parent[s[left]]
    rooted = np.flatnonzero((state == 0) & (ids > 0))
    out[rooted] += np.log10(tree.lexicon.root(tree.lexicon.counts[ids[rooted]].astype(float)))
    return out


PARTIAL = "row long, doc_id long, held_out boolean, word binary, n long, n_known long, base double, score double"


def score(docs: DataFrame, held_out: Column, trained: tuple[SuffixTree, DataFrame] | None = None, **options) -> DataFrame:
    """Scores of all texts by a tree learnt from those that are not held out, or by one from ``train``."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        text_column(docs).cast("binary").alias("text"),
    )
    tree, vocabulary = trained or train(texts.where(~F.col("held_out")).select("text"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(tree)  # bounded by the shares
    lexicon = tree.lexicon
    n_all, n_types, discount = lexicon.total, lexicon.distinct, lexicon.discount
    scale = n_all + 0.5 * (n_types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: SuffixTree = shared.value
        ids_of, counts = tree.lexicon.ids, tree.lexicon.counts
        base_of = np.log10((counts + 0.5) / scale)
        row = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in PARTIAL.split(", ")]
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for part, found in _batches(batches, "text"):
            ids, first = id_stream(tree.lexicon, found)
            logs = score_stream(tree, ids, first)
            common = ids > 0
            sums = [np.add.reduceat(x, first) for x in (np.ones(len(ids), np.int64), common.astype(np.int64), np.where(common, base_of[ids], 0.0), logs)]
            docs_, held = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
            out = [(row + i, docs_[i], held[i], None, int(sums[0][i]), int(sums[1][i]), float(sums[2][i]), float(sums[3][i])) for i in range(len(found))]
            columns = [list(c) for c in zip(*out, strict=True)]
            rare_row, rare_word, rare_n = [], [], []
            for i, text in enumerate(found):
                if sums[0][i] > sums[1][i]:
                    rare = Counter(w for w in text_tokens(text) if w not in ids_of)
                    rare_row += [row + i] * len(rare)
                    rare_word += rare
                    rare_n += rare.values()
            k = len(rare_row)
            extra = [rare_row, [None] * k, [None] * k, rare_word, rare_n, [0] * k, [0.0] * k, [0.0] * k]
            yield pa.RecordBatch.from_arrays([pa.array(a + b, t) for a, b, t in zip(columns, extra, types, strict=True)], names)
            row += len(found)

    partial = materialise(texts.mapInArrow(run, PARTIAL), "lm-partial")
    rare = partial.where("word is not null").select("row", "word", "n")
    known = rare.join(vocabulary, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    unknown = discount * n_types / n_all if n_all else 1.0
    p = F.when(c > 0, (c - F.lit(discount)) / F.lit(float(max(n_all, 1)))).otherwise(F.lit(unknown))
    tail = known.select(
        "row", F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10((c + 0.5) / F.lit(scale))).alias("base"), (F.col("n") * F.log10(p)).alias("score"),
    ).groupBy("row").agg(F.sum("n_known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    heads = partial.where("word is null").drop("word")
    zero = F.lit(0.0)
    return heads.join(tail, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def every_fifth(doc_id: str = "doc_id") -> Column:
    """Held out: ids whose CRC-32 as text is 1 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1
