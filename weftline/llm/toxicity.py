"""Toxicity by cumulative-link ordinal regression over sparse word features.

Model: P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector shared by all ordered
thresholds. x counts, over a text's distinct words, the word itself and its prefixes of 4, 5 and
6 letters (hashed), so inflected and compound forms share weight. The fit runs on the driver
over at most ``fit_rows`` labelled documents of each side (toxic or not), the first by a hash
of their id, weighted back to the labels' true shares: proximal gradient steps with an L1
penalty leave a few hundred weights, none of them negative: clean words don't excuse others.
Only features of at least ``min_docs`` texts and a log odds of ``min_odds`` take part. That is the only bound; every document is scored whole.

Labels that only say toxic or not are made three grades: 0 for clean, and for toxic documents 1
or 2 by whether their number of toxic-leaning words (smoothed log odds over the sample) exceeds
the sample's median.

Defined results: null or empty text scores as a text without words; null labels are not used;
without labels of two grades every document has severity 0; repeated ids are scored row by row;
extra columns are ignored by ``toxicity`` and kept by ``toxicity_filter``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, text_column

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
SCORES = "severity double, toxic_prob double, grade int"


def word_features(word: str) -> list[int]:
    """Hashes of 31 bits, so that they fit 32-bit integers."""
    digest = xxhash.xxh32_intdigest
    return [digest(f"w{word}") >> 1, *(digest(f"p{word[:k]}") >> 1 for k in PREFIXES if len(word) >= k)]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by hashed feature and ascending thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """A row of grade probabilities for each score."""
        below = sigmoid(np.asarray(self.thresholds)[None, :] - np.asarray(scores, float)[:, None])
        n = len(below)
        return np.diff(np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1), axis=1)


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, share: np.ndarray, features: int,
    penalty: float = 1e-4, rounds: int = 600,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient; ``share`` weighs the rows."""
    n, top = len(grades), int(grades.max())
    share = share / share.sum()
    cum = np.clip(np.array([share[grades <= k].sum() for k in range(top)]), 1e-4, 1 - 1e-4)
    first = np.log(cum / (1 - cum))
    # Thresholds as a first value and positive gaps keep their order.
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    w = np.zeros(features)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.concatenate([p[:1], p[:1] + np.cumsum(np.exp(p[1:]))])

    def loss(w: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = np.bincount(rows, values * w[columns], minlength=n)
        cut = thresholds(p)
        below = sigmoid(cut[None, :] - score[:, None])
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        at = np.arange(n)
        upper, lower = edge[at, grades + 1], edge[at, grades]
        prob = np.maximum(upper - lower, 1e-12)
        slope = -share * (upper + lower - 1)  # of the loss by the score
        by_cut = np.zeros(top)
        np.add.at(by_cut, np.minimum(grades, top - 1), np.where(grades < top, -share * upper * (1 - upper) / prob, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, share * lower * (1 - lower) / prob, 0))
        tails = np.cumsum(by_cut[::-1])[::-1]
        by_p = np.concatenate([tails[:1], tails[1:] * np.exp(p[1:])])
        return float(-(share * np.log(prob)).sum()), np.bincount(columns, values * slope[rows], minlength=features), by_p

    step, yw, yp, momentum = 4.0, w, theta, 1.0
    for _ in range(rounds):
        value, gw, gp = loss(yw, yp)
        while True:
            moved = yw - step * gw
            nw = np.maximum(moved - step * penalty, 0)
            np_ = yp - step * gp
            dw, dp = nw - yw, np_ - yp
            if step < 1e-6 or loss(nw, np_)[0] <= value + gw @ dw + gp @ dp + (dw @ dw + dp @ dp) / (2 * step) + 1e-12:
                break
            step /= 2
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        yw, yp = nw + (momentum - 1) / following * (nw - w), np_ + (momentum - 1) / following * (np_ - theta)
        if np.abs(nw - w).max(initial=0) < 1e-5:
            w, theta = nw, np_
            break
        w, theta, momentum = nw, np_, following
    return w, thresholds(theta)


def _sampled(labelled: DataFrame, fit_rows: int) -> tuple[DataFrame | None, dict[int, float]]:
    """The labelled documents to fit on, and the weight of a row of each side."""
    sides = {int(r[0]): r[1] for r in labelled.groupBy((F.col("label") > 0).cast("int")).count().collect()}
    if len(sides) < 2:
        return None, {}
    parts = [
        labelled.where((F.col("label") > 0) == F.lit(bool(side))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for side in (0, 1)
    ]
    return parts[0].unionByName(parts[1]), {side: sides[side] / min(sides[side], fit_rows) for side in (0, 1)}


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 2500, min_docs: int = 4, min_odds: float = 2.0
) -> OrdinalModel | None:
    """Fit on labelled documents; None where the labels hold one grade or none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), text_column(docs).alias("text"))
    ids = texts.select("doc_id").join(known, "doc_id")
    sample, weight = _sampled(ids, fit_rows)
    if sample is None:
        return None
    chosen = texts.join(F.broadcast(sample.dropDuplicates(["doc_id"])), "doc_id")  # at most 2 * fit_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(f for w in text_words(x.as_py()) for f in word_features(w)) for x in batch.column(1)]
            lists = pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["doc_id", "label", "f", "times"])

    lists = chosen.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(run, "doc_id long, label int, f array<int>, times array<int>")
    lists = materialise(lists.withColumn("row", F.monotonically_increasing_id()), "toxicity-features")
    # Features are chosen by the executors; the driver gets the chosen ones of the sample's texts.
    known_rows = lists.select("row", "doc_id", "label").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    label_of = known_rows["label"].to_numpy()
    toxic = label_of > 0
    with_f = lists.select("row", (F.col("label") > 0).cast("int").alias("t"), F.explode(F.arrays_zip("f", "times")).alias("x")).select("row", "t", "x.f", "x.times")
    odds_of = F.log((F.col("n_toxic") + 0.5) / F.lit(float(toxic.sum() + 1))) - F.log((F.col("n_clean") + 0.5) / F.lit(float((~toxic).sum() + 1)))
    seen = with_f.groupBy("f").agg(F.sum("t").alias("n_toxic"), F.sum(1 - F.col("t")).alias("n_clean"))
    seen = seen.where((F.col("n_toxic") + F.col("n_clean") >= min_docs) & (odds_of >= min_odds)).withColumn("odds", odds_of)
    chosen_f = materialise(seen, "toxicity-chosen")
    features = chosen_f.toArrow().sort_by("f")
    kept, leaning = features["f"].to_numpy(), features["odds"].to_numpy() >= 3.0
    cells = with_f.join(chosen_f.select("f"), "f").select("row", "f", "times").toArrow()
    row_at = {r: i for i, r in enumerate(known_rows["row"].to_pylist())}
    row = np.array([row_at[r] for r in cells["row"].to_pylist()], np.int32)
    column, times = np.searchsorted(kept, cells["f"].to_numpy()), cells["times"].to_numpy()
    order = np.lexsort((column, row))
    row, column, times = row[order], column[order], times[order]
    side = np.where(toxic, weight[1], weight[0])
    amount = np.bincount(row, times * leaning[column], minlength=len(label_of))
    if set(np.unique(label_of)) <= {0, 1}:
        middle = np.median(amount[toxic])
        grades = np.where(toxic, np.where(amount > middle, 2, 1), 0)
        grades = grades if (grades == 2).any() and (grades == 1).any() else toxic.astype(int)
    else:
        grades = np.searchsorted(np.unique(label_of), label_of)
    w, cut = fit_ordinal(row, column, times.astype(float), grades, side, len(kept))
    return OrdinalModel({int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}, tuple(map(float, cut)))


class _Weights(dict):
    """Weights of words seen so far; emptied when full."""

    def __init__(self, model: OrdinalModel, entries: int = 400_000):
        super().__init__()
        self.model, self.entries = model, entries

    def __missing__(self, word: str) -> float:
        if len(self) >= self.entries:
            self.clear()
        found = self[word] = self.model.word_weight(word)
        return found


def scored(docs: DataFrame, model: OrdinalModel | None, carry: list[str]) -> DataFrame:
    """``carry`` columns, severity, toxic probability and likeliest grade of every row."""
    rows = docs.select(*carry, text_column(docs).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_text").dtypes) + ", " + SCORES
    if model is None:
        return rows.drop("_text").select("*", *(F.lit(0).cast(x.split()[1]).alias(x.split()[0]) for x in SCORES.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(model).__getitem__
        for batch in batches:
            scores = np.array([sum(map(weight, text_words(x.as_py()))) for x in batch.column("_text")], float)
            prob = model.probabilities(scores)
            found = [prob @ np.arange(prob.shape[1]), 1 - prob[:, 0], prob.argmax(1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, found)], [*batch.schema.names[:-1], "severity", "toxic_prob", "grade"]
            )

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, min_prob: float = 0.5, **options) -> DataFrame:
    """``doc_id``, expected severity, probability of any toxic grade, likeliest grade and
    verdict of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(rows, fit(rows, labels, **options), ["doc_id"])
    return out.withColumn("rejected", F.col("toxic_prob") >= min_prob)


def toxicity_filter(docs: DataFrame, labels: DataFrame, min_prob: float = 0.5, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    columns = docs.columns
    model = fit(docs.select("doc_id", "text"), labels, **options)
    out = scored(docs.select(F.struct(*columns).alias("_row"), "text"), model, ["_row"])
    return out.where(F.col("toxic_prob") < min_prob).select(*(F.col("_row").getField(c).alias(c) for c in columns))
