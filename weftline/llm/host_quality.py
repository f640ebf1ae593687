"""Quality rules with host-level verdicts, in DataFrame functions only.

One scan counts each document's words, symbols, repeated lines and repeated word windows inside
its own row (no shuffle of words). Failures are then summed by host (partial aggregation), host
rates are shrunk towards an empirical beta prior whose two parameters come from the moments of
the host rates, and the few host rows are joined back; the join is Spark's choice by size, and
a hot host is an ordinary skewed left side.

Windows of three words are compared by the 64-bit hash of their words, within one document.

Defined results: null text has no words; a null host is a host of its own; repeated ids and ties
need no care, as each row is judged alone; an empty table gives an empty result; columns beside
id, text and host are carried through ``quality_filter`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, text_column

SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of words found twice or more among ``words``."""
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, window))),
    )

    def covered(ordered: Column) -> Column:
        """Of the sorted (hash, place) pairs: places with an equal neighbour, then their union."""
        twin = F.filter(
            ordered,
            lambda x, k: (F.get(ordered, k - 1)["h"].eqNullSafe(x["h"]) & (k > 0)) | F.get(ordered, k + 1)["h"].eqNullSafe(x["h"]),
        )
        places = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda total, step: total + step,
            ),
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def measures(text: Column) -> Column:
    """The five counts of a text as one struct. Everything hangs on one expression, so that a
    filter on it can be pushed to the scan without splitting the text again and again."""

    def counted(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    trimmed = F.btrim(text, F.lit(SPACE))
    words = let(trimmed, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"[ \t-\r]+")))
    return let(words, counted)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns with the five counts of every whole text."""
    rows = docs.select(*carry, measures(text_column(docs)).alias("_m"))
    return rows.select(*carry, *(F.col("_m").getField(c).alias(c) for c in COUNTS))


def base_failed(of=F.col, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """``of`` gives a count by its name."""
    return (of("n_words") < min_words) | (100 * of("n_repeat_words") > max_repeat_percent * of("n_words"))


def soft_failed() -> Column:
    """Over three symbols for ten word characters, or over one repeated line for twenty words."""
    return (10 * F.col("n_symbols") > 3 * F.col("word_chars")) | (F.col("n_dup_lines") * 20 > F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Method of moments over host rates; a bounded strength where they tell nothing."""
    rate = F.col("failed") / F.col("docs")
    m, v, inverse = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("docs"))).first()
    if m is None:
        return 1.0, 1.0
    m = min(max(m, 1e-6), 1 - 1e-6)
    spread = max(v - m * (1 - m) * inverse, 0.0)  # what sampling alone does not explain
    strength = min(max(m * (1 - m) / spread - 1, 2.0), 1e4) if spread > 0 else 1e4
    return m * strength, (1 - m) * strength


def verdicts(counts: DataFrame, host: str, max_rate: float) -> DataFrame:
    """``(_host, host_rate, host_ok)`` of every host."""
    hosts = counts.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("docs"), F.sum(F.when(base_failed() | soft_failed(), 1).otherwise(0)).alias("failed")
    )
    hosts = materialise(hosts, "quality-hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.select("_host", rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def host_quality(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and the host's shrunk rate."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text")
    counts = materialise(measured(rows, ["doc_id", "host"]), "quality-counts")
    found = verdicts(counts, "host", max_rate)
    return counts.join(found, counts["host"].eqNullSafe(found["_host"]), "left").select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & F.col("host_ok")).alias("kept"), "host_rate"
    )


def quality_filter(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents kept, with all their columns; each row is judged by its own counts, which are
    taken once and written beside it."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(host).alias("host"), "text")
    judged = materialise(measured(rows, ["_row", "host"]), "quality-judged")
    found = verdicts(judged, "host", max_rate).where(~F.col("host_ok")).select("_host")
    kept = judged.where(~base_failed()).join(found, judged["host"].eqNullSafe(found["_host"]), "left_anti")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in columns))
