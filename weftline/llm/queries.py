"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import host_quality, itq_dedup, license_scan, packing, piece_transducer, simhash_dedup, suffix_tree_lm, suffix_tree_whole, token_files, toxicity, warc_zstd
from weftline.llm.common import table, vocabulary

ORACLES: dict[str, str] = {}


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.itq_near_dedup(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


ORACLES["op3_license_scan"] = license_scan.oracle()


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality.host_quality(table(spark, sf_dir, "documents"))
    return found.drop("host_rate")


ORACLES["op6_host_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
twin AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
          FROM twin, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        10 * n_symbols > 3 * word_chars OR n_dup_lines * 20 > n_words AS soft_failed FROM m),
h AS (SELECT source, count(*) AS docs, sum((base_failed OR soft_failed)::INT) AS failed FROM f GROUP BY source),
p AS (SELECT least(greatest(avg(failed / docs), 1e-6), 1 - 1e-6) AS m, var_pop(failed / docs) AS v, avg(1 / docs) AS inv FROM h),
q AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0
        THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 2.0), 1e4) ELSE 1e4 END AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.failed + m * s) / (h.docs + s) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, q
"""


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.warc_round_trip(table(spark, sf_dir, "pages"))


ORACLES["op7_warc_dictionary"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
c AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM c
"""


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_whole.whole_score(table(spark, sf_dir, "documents"), suffix_tree_lm.every_fifth())


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.id_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if re.match(r"op\d+_", name)]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
