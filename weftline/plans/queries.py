"""Registered queries of the stream operators, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import rng, stats
from weftline.operators import batch, lanes, permute, placement
from weftline.plans import oracle_sql as sql
from weftline.plans import fingerprint as fp
from weftline.plans import stages, state, verify
from weftline.sources import iterable, readers
from weftline.streaming import control, lane_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return readers.keyed(table(spark, sf_dir, name), key)


def money(c: str):
    """Exact sums of two-decimal amounts."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


CENTS = "sum({}::DECIMAL(18,2))::DOUBLE"


def ranked_orders(spark: SparkSession, sf_dir: str, **geometry) -> DataFrame:
    orders = indexed(spark, sf_dir, "orders", "o_orderkey").select("index", "o_totalprice")
    g = placement.Geometry(orders.count(), **geometry)
    rows = placement.gather(placement.plan(spark, g), orders)
    return rows.groupBy("rank", "batch_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("offset").alias("last_offset"), money("o_totalprice").alias("total")
    )


def ranked_sql(plan: str) -> str:
    return f"""
WITH s AS (SELECT count(*)::BIGINT AS n FROM orders), plan AS ({plan})
SELECT rank::BIGINT AS rank, batch_id::BIGINT AS batch_id, count(*) AS n, min(pos) AS first_pos, max("offset")::BIGINT AS last_offset,
       {CENTS.format('o_totalprice')} AS total
FROM plan JOIN orders ON o_orderkey = src GROUP BY ALL"""


@query(ranked_sql("""SELECT pos, (pos % 256) // 64 AS rank, pos // 256 AS batch_id, pos % 64 AS "offset", CASE WHEN pos < n THEN pos ELSE (pos - n) % n END AS src
FROM (SELECT n, unnest(range(0, (n + 255) // 256 * 256)) AS pos FROM s)"""))
def e1_padded_rank_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_orders(spark, sf_dir, batch_size=64, world_size=4)


@query(ranked_sql("""SELECT pos, CASE WHEN pos < f THEN (pos % 354) // 59 ELSE ((pos - f + 1) * 6 - 1) // (n - f) END AS rank, pos // 354 AS batch_id,
 CASE WHEN pos < f THEN pos % 59 ELSE pos - f - ((((pos - f + 1) * 6 - 1) // (n - f)) * (n - f)) // 6 END AS "offset", pos AS src
FROM (SELECT n, n // 354 * 354 AS f, unnest(range(0, n)) AS pos FROM s)"""))
def e3_exact_count_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_orders(spark, sf_dir, batch_size=59, world_size=6, exact_count=True)


@query(ranked_sql("""SELECT pos, (pos % 256) // 64 AS rank, pos // 256 AS batch_id, pos % 64 AS "offset", pos AS src
FROM (SELECT n, unnest(range(0, n // 256 * 256)) AS pos FROM s)"""))
def e4_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_orders(spark, sf_dir, batch_size=64, world_size=4, drop_last=True)


@query(ranked_sql("""SELECT pos, 0 AS rank, pos // 100 AS batch_id, pos % 100 AS "offset", pos AS src
FROM (SELECT unnest(range(0, n)) AS pos FROM s)"""))
def e5_single_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_orders(spark, sf_dir, batch_size=100, distributed=False)


@query(f"""
WITH s AS (SELECT count(*)::BIGINT AS n FROM orders),
p AS (SELECT pos // 48 AS batch_id, CASE WHEN pos < n THEN pos ELSE (pos - n) % n END AS src FROM (SELECT n, unnest(range(0, (n + 47) // 48 * 48)) AS pos FROM s))
SELECT batch_id::BIGINT AS batch_id, {CENTS.format('o_totalprice')} AS total_w2, {CENTS.format('o_totalprice')} AS total_w8, true AS same
FROM p JOIN orders ON o_orderkey = src GROUP BY batch_id""")
def e7_elastic_w2_equals_w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = indexed(spark, sf_dir, "orders", "o_orderkey").select("index", "o_totalprice")
    two = placement.Geometry(orders.count(), 24, 2)
    sums = [
        placement.gather(placement.plan(spark, g), orders).groupBy("batch_id").agg(money("o_totalprice").alias(f"total_w{g.world_size}"))
        for g in (two, two.elastic(8))
    ]
    return sums[0].join(sums[1], "batch_id").withColumn("same", F.col("total_w2") == F.col("total_w8"))


@query(f"SELECT c_custkey, pos, c_acctbal FROM {sql.small_permutation('SELECT count(*) FROM customer', 42, 0)} JOIN customer ON c_custkey = index")
def d1_shuffle_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = indexed(spark, sf_dir, "customer", "c_custkey").select("index", "c_custkey", "c_acctbal")
    order = permute.permutation(spark, customer.count(), seed=42)
    return placement.gather(order, customer).select("c_custkey", "pos", "c_acctbal")


@query(f"SELECT pos, index FROM {sql.large_permutation(200_000, 42, 0)}")
def d2_feistel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permute.permutation(spark, 200_000, seed=42)


@query("""SELECT i AS pos, c_custkey, c_acctbal FROM (SELECT unnest(range(0, n)) AS i, n FROM (SELECT count(*)::BIGINT AS n FROM customer))
JOIN customer ON c_custkey = (i * 7 + i // 5) % n""")
def d6_user_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = indexed(spark, sf_dir, "customer", "c_custkey").select("index", "c_custkey", "c_acctbal")
    n = customer.count()
    picks = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.col("id") * 7 + F.floor(F.col("id") / 5), F.lit(n)).cast("long").alias("index"))
    return placement.gather(picks, customer).select("pos", "c_custkey", "c_acctbal")


@query("""SELECT conv_id AS batch_id, turn AS "offset", role,
  sum(CASE WHEN turn = first THEN n ELSE 0 END) OVER (ORDER BY conv_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - n + turn AS coord
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)""")
def d7_batch_sampler_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("offset"), F.col("role").alias("index"))
    return placement.with_batch_sampler(turns).select("batch_id", "offset", F.col("index").alias("role"), "coord")


WORDS = "x0::BIGINT AS w0, x1::BIGINT AS w1, x2::BIGINT AS w2, x3::BIGINT AS w3"


@query("""SELECT event_id, CASE WHEN v >= 9223372036854775808 THEN (v - 18446744073709551616::HUGEINT)::BIGINT ELSE v::BIGINT END AS mixed FROM (
SELECT event_id, xor(c, c >> 31)::HUGEINT AS v FROM (
SELECT event_id, ((xor(b, b >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS c FROM (
SELECT event_id, ((xor(a, a >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS b FROM (
SELECT event_id, (event_id * 1000003)::UBIGINT AS a FROM events))))""")
def c1_splitmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rng.mixed64(F.col("event_id") * 1000003).alias("mixed"))


@query(f"SELECT event_id, {WORDS} FROM ({sql.block('SELECT event_id FROM events', 'event_id', 7, 3)})")
def c4_row_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rng.words(F.col("event_id"), 7, 3).alias("w")).select("event_id", "w.*")


@query(f"SELECT o_orderkey, (x0::DECIMAL(20,0) + x1::DECIMAL(20,0) * 4294967296)::DECIMAL(20,0)::VARCHAR AS seed FROM ({sql.block('SELECT o_orderkey FROM orders', 'o_orderkey', 11, 2)})")
def c6_torch_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rng.words(F.col("o_orderkey"), 11, 2).alias("w"))
    return rows.select("o_orderkey", rng.torch_seed(F.col("w")).cast("string").alias("seed"))


@query(f"SELECT batch_id, {WORDS} FROM ({sql.block('SELECT DISTINCT o_orderkey // 32 AS batch_id FROM orders', 'batch_id', 5, 1, 0, 1)})")
def c7_collate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 32).cast("long").alias("batch_id")).distinct()
    return ids.select("batch_id", rng.words(F.col("batch_id"), 5, 1, stream=rng.COLLATE).alias("w")).select("batch_id", "w.*")


@query(f"SELECT event_id, ((x0 >> 5)::DOUBLE * 67108864 + (x1 >> 6)::DOUBLE) / 9007199254740992 AS u FROM ({sql.block('SELECT event_id FROM events', 'event_id', 3, 0, 0, 6)})")
def c8_uniform53(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", rng.words(F.col("event_id"), 3, 0, stream=rng.ACCESSOR_RANDOM).alias("w"))
    return rows.select("event_id", rng.uniform53(F.col("w")).alias("u"))


@query(f"SELECT event_id, (x0 >> 21)::BIGINT AS bits FROM ({sql.block('SELECT event_id FROM events', 'event_id', 3, 0, 0, 7)})")
def c9_randbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", rng.words(F.col("event_id"), 3, 0, stream=rng.STATE_RANDOM).alias("w"))
    return rows.select("event_id", rng.randbits(F.col("w"), 11).alias("bits"))


@query()
def c10_row_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian, shuffled choice and numpy draws of each row, from its coordinate alone."""
    def run(batches):
        for pdf in batches:
            rows = [rng.RowRng(9, 1, int(i)) for i in pdf["event_id"]]
            yield pd.DataFrame({
                "event_id": pdf["event_id"], "gauss": [r.random().gauss() for r in rows],
                "choice": [r.state_random().choice(range(1000)) for r in rows], "normal": [r.numpy().normal() for r in rows],
            })

    return table(spark, sf_dir, "events").select("event_id").mapInPandas(run, "event_id long, gauss double, choice long, normal double")


@query(f"""
WITH s AS (SELECT count(*)::BIGINT AS n FROM customer), perm AS {sql.small_permutation('SELECT count(*) FROM customer', 42, 0)},
plan AS (SELECT pos AS p, (pos % 128) // 32 AS rank, pos // 128 AS batch_id, pos % 32 AS "offset", CASE WHEN pos < n THEN pos ELSE (pos - n) % n END AS src
         FROM (SELECT n, unnest(range(0, (n + 127) // 128 * 128)) AS pos FROM s))
SELECT rank::BIGINT AS rank, batch_id::BIGINT AS batch_id, count(*) AS n, {CENTS.format('c_acctbal')} AS total,
       string_agg(c_custkey::VARCHAR, ',' ORDER BY "offset") AS keys
FROM plan JOIN perm ON perm.pos = src JOIN customer ON c_custkey = index GROUP BY ALL""")
def f1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a shuffled, padded four-rank epoch of customers, batch by batch."""
    customer = indexed(spark, sf_dir, "customer", "c_custkey").select("index", "c_custkey", "c_acctbal")
    g = placement.Geometry(customer.count(), batch_size=32, world_size=4)
    rows = placement.gather(placement.plan(spark, g, seed=42, shuffle=True), customer)
    out = batch.collate(rows, ["c_custkey", "c_acctbal"], ["rank", "batch_id"])
    total = F.aggregate("c_acctbal", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x.cast("decimal(18,2)")).cast("decimal(28,2)"))
    return out.select("rank", "batch_id", "n", total.cast("double").alias("total"), F.array_join("c_custkey", ",").alias("keys"))


@query("""SELECT o_orderkey // 256 AS batch_id, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys,
 string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY ALL""")
def f2_collate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.batched(table(spark, sf_dir, "orders"), 256, "o_orderkey")
    out = batch.collate(rows, ["o_orderkey", "o_orderpriority"])
    return out.select("batch_id", "n", F.array_join("o_orderkey", ",").alias("keys"), F.array_join("o_orderpriority", ",").alias("priorities"))


@query("""WITH e AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
SELECT vec_id // 32 AS batch_id, count(DISTINCT vec_id) AS n, max(len(embedding))::INTEGER AS width,
       sum(round(embedding[i]::DOUBLE * 1000000)::BIGINT * (vec_id % 32 + 1) * i)::BIGINT AS digest FROM e GROUP BY ALL""")
def f3_stack_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.batched(table(spark, sf_dir, "embeddings").where("embedding is not null"), 32, "vec_id")
    out = batch.collate(rows, ["embedding"])
    by_row = F.transform(
        "embedding",
        lambda v, r: F.aggregate(F.transform(v, lambda x, i: F.round(x.cast("double") * 1000000).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x) * (r + 1),
    )
    return out.select("batch_id", "n", F.array_max(F.transform("embedding", F.size)).alias("width"), F.aggregate(by_row, F.lit(0).cast("long"), lambda a, x: a + x).alias("digest"))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS v FROM documents),
b AS (SELECT doc_id // 8 AS batch_id, max(len(v)) AS longest, string_agg(len(v)::VARCHAR, ',' ORDER BY doc_id) AS lengths FROM d GROUP BY ALL),
e AS (SELECT doc_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS t FROM d)
SELECT batch_id, longest::INTEGER AS longest, lengths, sum(x * t * (doc_id % 8 + 1))::BIGINT AS digest FROM b JOIN e ON doc_id // 8 = batch_id GROUP BY ALL""")
def f6_pad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), F.length).alias("v"))
    out = batch.pad(batch.batched(docs, 8, "doc_id"), "v")
    step = F.transform("v", lambda row, t: F.aggregate(F.transform(row, lambda x, r: x.cast("long") * (r + 1)), F.lit(0).cast("long"), lambda a, x: a + x) * (t + 1))
    return out.select("batch_id", "longest", F.array_join("lengths", ",").alias("lengths"), F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x).alias("digest"))


@query(f"""SELECT b.batch_id, n, middle, x0::BIGINT AS draw FROM (SELECT o_orderkey // 512 AS batch_id, count(*) AS n, median(o_totalprice) AS middle FROM orders GROUP BY ALL) b
JOIN ({sql.block('SELECT DISTINCT o_orderkey // 512 AS batch_id FROM orders', 'batch_id', 1, 0, 0, 1)}) w ON w.batch_id = b.batch_id""")
def f8_user_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function for each batch, with a random draw of the collate stream."""

    def fn(pdf):
        b = int(pdf["batch_id"].iloc[0])
        draw = int(rng.block(1, 0, b, 0, rng.COLLATE)[0])
        return pd.DataFrame({"batch_id": [b], "n": [len(pdf)], "middle": [float(pdf["o_totalprice"].median())], "draw": [draw]})

    rows = batch.batched(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 512, "o_orderkey")
    return batch.user_collate(rows, fn, "batch_id long, n long, middle double, draw long")


@query("""SELECT doc_id // 64 AS batch_id, sum(8 + 8 + octet_length(encode(coalesce(text, ''))) + octet_length(encode(coalesce(lang, ''))) + octet_length(encode(coalesce(source, ''))))::BIGINT AS payload
FROM documents GROUP BY ALL""")
def f11_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.withColumn("payload", batch.payload_bytes(docs.schema))
    return batch.batched(rows, 64, "doc_id").groupBy("batch_id").agg(F.sum("payload").alias("payload"))


@query("""SELECT event_id, (value * 100)::BIGINT * 3 + 1 AS scaled, upper(event_type) AS kind FROM events""")
def b1_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (stages.Transform(lambda c: F.round(c * 100).cast("long")), stages.Transform(lambda c: c * 3 + 1))
    value = F.col("value")
    for s in steps:
        value = s.apply(value)
    return table(spark, sf_dir, "events").select("event_id", value.alias("scaled"), F.upper("event_type").alias("kind"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def b2_decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    decode = stages.Decode(codec="json", schema="k bigint")
    return table(spark, sf_dir, "events").select("event_id", decode.apply(F.col("props").cast("binary")).getField("k").alias("k"))


@query("""SELECT o_orderkey // 32 AS batch_id, sum(o_orderkey * 2)::BIGINT AS value FROM orders GROUP BY ALL""")
def b4_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = indexed(spark, sf_dir, "orders", "o_orderkey").select("index", F.col("o_orderkey").cast("string").cast("binary").alias("value"))
    p = stages.pipeline(
        stages.Source(raw, output_type="binary"), stages.Decode(codec="int", input_type="binary", output_type="bigint"),
        stages.Transform(lambda c: c * 2, "bigint", "bigint"), stages.Collate(lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x), "bigint", "bigint"),
    )
    return p.batches(spark, placement.Geometry(raw.count(), 32, distributed=False)).select("batch_id", "value")


@query("""SELECT vec_id // 16 AS batch_id, count(*) AS n, min(vec_id) AS first, sum(label)::BIGINT AS labels, sum(coalesce(len(embedding), 0))::BIGINT AS numbers FROM embeddings GROUP BY ALL""")
def a3_tensor_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.batched(table(spark, sf_dir, "embeddings"), 16, "vec_id")
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.sum("label").alias("labels"), F.sum(F.coalesce(F.size("embedding"), F.lit(0))).alias("numbers"))


@query("""SELECT o_orderkey AS index, o_totalprice AS price, o_orderpriority AS priority FROM orders""")
def a4_zipped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = indexed(spark, sf_dir, "orders", "o_orderkey")
    return readers.zipped({"price": orders.select("index", "o_totalprice"), "priority": orders.select("index", "o_orderpriority")})


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


@query(f"""SELECT index, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY {LINE}) - 1 AS index FROM lineitem) WHERE index >= 1000 AND index < 5000""")
def a8_parquet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.dense_index(table(spark, sf_dir, "lineitem"), LINE.split(", "))
    return readers.range_batch(rows, 1000, 5000).select("index", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"""SELECT (event_id % 6) - 3 AS lane, count(*) AS n, {CENTS.format('value')} AS total, min(event_id) AS first FROM events WHERE event_id % 6 BETWEEN 3 AND 5 GROUP BY ALL""")
def a11_stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("lane", lanes.stride_lane(F.col("event_id"), 1, 2, 3)).where("lane is not null")
    return rows.groupBy("lane").agg(F.count("*").alias("n"), money("value").alias("total"), F.min("event_id").alias("first"))


@query("""SELECT page_id, hex(encode(html)[11:50]) AS bytes FROM pages""")
def a12_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.hex(F.substring(F.col("html").cast("binary"), 11, 40)).alias("bytes"))


DELIVERED = "SELECT DISTINCT o_orderkey // 10 AS batch_id FROM orders WHERE (o_orderkey // 10) % 3 = 2 OR (o_orderkey // 10) < 17"


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("batch_id")).distinct()
    return ids.where("batch_id % 3 = 2 or batch_id < 17")


@query(f"""SELECT (batch_id - 18) // 8 AS byte, sum(1 << ((batch_id - 18) % 8))::BIGINT AS value FROM ({DELIVERED}) WHERE batch_id > 18 GROUP BY ALL""")
def h3_bitmap_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.bitmap_bytes(delivered(spark, sf_dir), 18)


@query(f"""SELECT batch_id FROM ({DELIVERED}) WHERE batch_id > 18""")
def h3_bitmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = state.bitmap_bytes(delivered(spark, sf_dir), 18)
    bits = packed.select("byte", "value", F.explode(F.array(*map(F.lit, range(8)))).alias("bit")).where(F.expr("bit_get(value, bit) = 1"))
    return bits.select((F.col("byte") * 8 + F.col("bit") + 18).alias("batch_id"))


@query(f"""SELECT o_orderkey // 10 AS batch_id, count(*) AS n, {CENTS.format('o_totalprice')} AS total FROM orders
WHERE o_orderkey // 10 >= 18 AND (o_orderkey // 10) NOT IN (20, 23, 24) GROUP BY ALL""")
def h4_resume_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = indexed(spark, sf_dir, "orders", "o_orderkey").select("index", "o_totalprice")
    plan = placement.plan(spark, placement.Geometry(orders.count(), 10, distributed=False), cursor=18)
    rows = placement.gather(state.open_batches(plan, 18, {20, 23, 24}), orders)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


@query("""WITH c AS (SELECT count(*)::BIGINT AS n FROM customer), p AS (SELECT n, unnest(range(0, n)) AS pos FROM c)
SELECT max(n) AS n, (sum(('0x' || substr(md5(pos || ':' || ((pos * 7 + pos // 5) % n)), 1, 15))::BIGINT) % 9223372036854775808::HUGEINT)::BIGINT AS checksum FROM p""")
def h5_sampler_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    picks = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.col("id") * 7 + F.floor(F.col("id") / 5), F.lit(n)).cast("long").alias("index"))
    return spark.createDataFrame([(n, state.positions_checksum(picks, ["pos"]))], "n long, checksum long")


class Stride:
    """A stateful iterable source: every ``step``-th number from ``at`` up to ``end``."""

    def __init__(self, at: int, step: int, end: int):
        self.at, self.step, self.end = at, step, end

    def state_dict(self) -> dict:
        return {"at": self.at}

    def load_state_dict(self, held: dict) -> None:
        self.at = held["at"]

    def __iter__(self):
        while self.at < self.end:
            self.at += self.step
            yield (self.at - self.step,)


@query("""WITH n AS (SELECT count(*)::BIGINT AS n FROM orders), l AS (SELECT unnest([0, 1, 2])::BIGINT AS lane),
d AS (SELECT lane, 20 + 37 * lane AS delivered_arrival, n FROM l, n),
r AS (SELECT lane, delivered_arrival, unnest(range(lane + 3 * delivered_arrival, n, 3)) AS value FROM d)
SELECT lane, delivered_arrival, delivered_arrival // 16 * 16 AS snapshot_arrival, count(*) AS rows, min(value) AS first, sum(value)::BIGINT AS total FROM r GROUP BY ALL""")
def h7_lane_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes cut after different numbers of rows go on from their newest states."""
    n, count = table(spark, sf_dir, "orders").count(), 3
    iterable.register(spark, "weftline_stride", lambda lane, lanes, rank, world: Stride(rank * lanes + lane, lanes * world, n), "value long")
    done = spark.range(count).select(F.col("id").alias("lane"), (F.col("id") * 37 + 20).alias("delivered_arrival"))
    # States lie 16 rows apart, and only those up to the cut are wanted.
    states = iterable.read_lanes(spark, "weftline_stride", lanes=count, states=16, limit=20 + 37 * count)
    records = lane_state.records(done, states)
    contract = [("dataset.rows", n), ("lanes", count)]
    saved = lane_state.check(lane_state.document(records, contract, 1, 0, 1, [0, 1, 2]), contract, 1, count)
    rest = iterable.read_lanes(spark, "weftline_stride", lanes=count, resume=lane_state.option(saved))
    sums = rest.groupBy("lane").agg(F.count("*").alias("rows"), F.min("value").alias("first"), F.sum("value").alias("total"))
    return records.select("lane", "delivered_arrival", "snapshot_arrival").join(sums, "lane")


@query("""WITH n AS (SELECT count(*)::BIGINT AS n FROM customer), p AS (SELECT n, unnest(range(0, n // 2)) AS pos FROM n)
SELECT pos // 32 AS batch_id, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM p JOIN customer ON c_custkey = (pos * 11 + 3) % p.n GROUP BY ALL""")
def d8_unsized_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler that only ends when it ends: its picks are a lane of an iterable source."""
    customer = indexed(spark, sf_dir, "customer", "c_custkey").select("index", "c_acctbal")
    n = customer.count()
    iterable.register(spark, "weftline_picks", lambda lane, lanes, rank, world: (((i * 11 + 3) % n,) for i in range(n // 2)), "index long")
    picks = iterable.read_lanes(spark, "weftline_picks").select(F.col("arrival").alias("pos"), "index")
    return placement.gather(batch.batched(picks, 32), customer).groupBy("batch_id").agg(F.count("*").alias("n"), money("c_acctbal").alias("total"))


@query("""SELECT event_id // 32 AS batch_id, count(*) AS n, sum(user_id)::BIGINT AS users, sum(length(event_type))::BIGINT AS letters, sum(event_id)::BIGINT AS ids,
 sum(event_id * (event_id % 32 + 1))::BIGINT AS placed FROM events GROUP BY ALL""")
def f4_nested_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings and sequences become a mapping and a sequence of arrays in batch order."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.lit("user"), F.col("user_id").cast("long"), F.lit("letters"), F.length("event_type").cast("long")).alias("m"),
        F.array(F.col("event_id").cast("long"), F.lit(1).cast("long")).alias("s"),
    )
    out = batch.collate_nested(batch.batched(events, 32, "event_id"), ["m", "s"])

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.transform(F.col("s")[0], lambda x, i: x * (F.pmod(x, F.lit(32)) + 1))
    return out.select("batch_id", "n", total(F.col("m")["user"]).alias("users"), total(F.col("m")["letters"]).alias("letters"), total(F.col("s")[0]).alias("ids"), total(placed).alias("placed"))


@query("""SELECT lane, arg_max(payload, arrival) AS payload, max(arrival) AS arrival FROM (
 SELECT user_id % 5 AS lane, event_id AS arrival, event_type AS payload FROM events) WHERE arrival <= 1000 + lane * 777 GROUP BY lane""")
def h8_snapshot_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(5)).alias("lane"), F.col("event_id").alias("arrival"), F.col("event_type").alias("payload"))
    done = spark.range(5).select(F.col("id").alias("lane"), (F.col("id") * 777 + 1000).alias("delivered_arrival"))
    return lanes.select_snapshot(snaps, done)


def lane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(7)).alias("lane"), "event_id", "value")
    return rows.withColumn("arrival", F.row_number().over(Window.partitionBy("lane").orderBy("event_id")).cast("long") - 1)


def lanes_sql(keep: str) -> str:
    return f"""
WITH r AS (SELECT user_id % 7 AS lane, value, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS arrival FROM events),
b AS (SELECT lane, arrival // 64 AS lane_batch, count(*) AS n, {CENTS.format('value')} AS total FROM r GROUP BY ALL)
SELECT lane, lane_batch, n, total, row_number() OVER (ORDER BY lane_batch, lane) - 1 AS delivery FROM b WHERE {keep}"""


@query(lanes_sql("true"))
def j1_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.round_robin(lane_rows(spark, sf_dir), 64)
    return rows.groupBy("lane", "lane_batch", "delivery").agg(F.count("*").alias("n"), money("value").alias("total"))


@query(lanes_sql("n = 64"))
def j2_lane_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.round_robin(lane_rows(spark, sf_dir), 64, drop_last=True)
    return rows.groupBy("lane", "lane_batch", "delivery").agg(F.count("*").alias("n"), money("value").alias("total"))


@query("""SELECT event_id, ((user_id % 4) << 52) | ((user_id % 9) << 40) | event_id AS coord FROM events""")
def j3_coordinate_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    coord = lanes.coordinate(F.pmod("user_id", F.lit(4)), F.pmod("user_id", F.lit(9)), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", coord.alias("coord"))


@query("""
WITH h AS (SELECT o_orderpriority, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bucket, count(*) AS n
           FROM (SELECT o_orderpriority, (o_totalprice * 100)::BIGINT AS v FROM orders) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM h)
SELECT o_orderpriority, max(total)::BIGINT AS total, min(CASE WHEN cum >= ceil(total * 50 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p50,
 min(CASE WHEN cum >= ceil(total * 95 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p95, min(CASE WHEN cum >= ceil(total * 99 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p99
FROM c GROUP BY o_orderpriority""")
def k1_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return stats.histogram_percentiles(rows, "v", ["o_orderpriority"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS samples, count(DISTINCT l_orderkey // 64) AS batches, sum(l_partkey)::BIGINT AS payload_bytes, max(l_suppkey) AS max_latency
FROM lineitem GROUP BY ALL""")
def k2_epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("b", F.floor(F.col("l_orderkey") / 64))
    return stats.epoch_summary(rows, ["l_returnflag", "l_linestatus"], "b", "l_partkey", "l_suppkey")


@query("""SELECT unit, count(*) AS n, string_agg(id, ' ' ORDER BY id) AS ids, 1 AS version FROM (VALUES
 ('bytes', 'bytes_per_sample'), ('bytes', 'staged_copy_transients'), ('bytes', 'view_export_copy'),
 ('events', 'ceiling_binds'), ('events', 'controller_decisions'), ('events', 'gil_restore_events'), ('events', 'growth_events'),
 ('events', 'hold'), ('events', 'overflow_events'), ('events', 'stall_events'),
 ('nanoseconds', 'delivery_latency'), ('nanoseconds', 'startup'), ('nanoseconds', 't_seed'), ('nanoseconds', 't_shim'),
 ('position', 'hung_position'), ('ratio', 'machine_keeping_duty'), ('ratio', 'nontensor_fraction'),
 ('samples_per_second', 'delivery_rate')) AS t(unit, id) GROUP BY unit""")
def k4_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(*r, 1) for r in stats.INSTRUMENTS], "id string, unit string, description string, version int")
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"), F.max("version").alias("version"))


@query("""
WITH h AS (SELECT o_orderpriority, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bucket, count(*) AS n
           FROM (SELECT o_orderpriority, (o_totalprice * 100)::BIGINT AS v FROM orders) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM h),
q AS (SELECT o_orderpriority, min(CASE WHEN cum >= ceil(total * 50 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p50,
 min(CASE WHEN cum >= ceil(total * 95 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p95, min(CASE WHEN cum >= ceil(total * 99 / 100) THEN (1::BIGINT << bucket) - 1 END) AS p99
 FROM c GROUP BY o_orderpriority),
s AS (SELECT o_orderpriority, count(*) AS samples, count(DISTINCT o_orderkey // 64) AS batches, sum(o_custkey)::BIGINT AS payload_bytes,
 sum((o_totalprice * 100)::BIGINT)::BIGINT AS interval_ns, count(*) FILTER (o_orderstatus = 'P') AS stall_events,
 count(*) FILTER (o_orderkey % 20 = 0) AS controller_decisions, count(*) FILTER (o_orderkey % 100 = 0) AS ceiling_binds FROM orders GROUP BY ALL)
SELECT * FROM s JOIN q USING (o_orderpriority)""")
def k2_epoch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.floor(F.col("o_orderkey") / 64).alias("b"), F.col("o_custkey").cast("long").alias("bytes"), F.round(F.col("o_totalprice") * 100).cast("long").alias("ns"),
        (F.col("o_orderstatus") == "P").alias("stalled"), (F.col("o_orderkey") % 20 == 0).alias("decided"), (F.col("o_orderkey") % 100 == 0).alias("bound"),
    )
    return stats.epoch_counters(rows, ["o_orderpriority"], "b", "bytes", "ns", "stalled", "decided", "bound")


@query("""SELECT source, count(DISTINCT doc_id // 64) AS batches, count(*) AS samples, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS payload_bytes,
 sum(octet_length(encode(coalesce(text, '')))) / count(*) AS bytes_per_sample FROM documents GROUP BY source""")
def k10_byte_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("b", F.floor(F.col("doc_id") / 64))
    return stats.byte_ledger(docs, ["source"], "b", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))


@query("""SELECT free, f, least(free, floor(free * f))::BIGINT AS budget FROM (SELECT unnest([0, 1, 999, 1000000007])::BIGINT AS free), (SELECT unnest([0.01, 0.15, 1.0, 2.5])::DOUBLE AS f)""")
def k9_profile_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, f, stats.profile_budget(n, f)) for n in (0, 1, 999, 1000000007) for f in (0.01, 0.15, 1.0, 2.5)]
    return spark.createDataFrame(rows, "free long, f double, budget long")


@query("""WITH e AS (SELECT event_id, value, (xor(c, c >> 31) % 64)::BIGINT AS entry FROM (
 SELECT *, ((xor(b, b >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS c FROM (
 SELECT *, ((xor(a, a >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS b FROM (
 SELECT *, user_id::UBIGINT AS a FROM events)))),
r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY event_id) AS k, count(*) OVER (PARTITION BY entry) AS n FROM e)
SELECT entry, round(sum(CASE WHEN k = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, n - k) * value), 6) AS estimate, count(*) AS observations FROM r GROUP BY entry""")
def k7_hashed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with fewer entries than positions."""
    events = table(spark, sf_dir, "events").select("event_id", "value", stats.profile_entry(F.col("user_id").cast("long"), 64, 1 << 20).alias("entry"))
    out = stats.ema_profile(events, "entry", "event_id", "value")
    return out.select("entry", F.round("estimate", 6).alias("estimate"), "observations")


EMA = """SELECT user_id, sum(CASE WHEN k = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, n - k) * value) AS estimate, count(*) AS observations
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id"""


@query(f"SELECT user_id, round(estimate, 6) AS estimate, observations FROM ({EMA})")
def k7_ema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.ema_profile(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return out.select("user_id", F.round("estimate", 6).alias("estimate"), "observations")


@query("""SELECT round(avg(o_totalprice), 4) AS mean, count(*) AS populated,
 (SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r FROM orders)
  WHERE r = (SELECT greatest(ceil(count(*) * 0.999), 1) FROM orders)) AS p999 FROM orders""")
def k8_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.profile_statistics(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select(F.round("mean", 4).alias("mean"), "p999", "populated")


@query()
def k11_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, 95 % interval and verdict of the events' values against 100."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("value") - 100).alias("value"))
    return stats.mean_interval(rows, "value", draws=100, seed=5).withColumn("verdict", stats.verdict(F.col("lower")))


@query("""SELECT o_orderkey, cost, row_number() OVER (ORDER BY cost DESC NULLS LAST, o_orderkey) - 1 AS dispatch FROM (
 SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS cost FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 612)""")
def l1_lpt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("cost"))
    return stats.lpt_order(rows, "cost", "o_orderkey", 100, 512)


@query("""SELECT o_orderkey // 4 AS batch_id, CASE WHEN count(c) = count(*) THEN sum(c)::DOUBLE END AS cost
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice::DECIMAL(18,2) END AS c FROM orders) GROUP BY ALL""")
def l2_batch_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")).alias("c"))
    return stats.batch_cost(batch.batched(rows, 4, "o_orderkey"), "c").withColumn("cost", F.col("cost").cast("double"))


@query("""SELECT workers, ratio, least(greatest(2 * 8, ceil(workers * greatest(1.0, ratio) * 1.5)), greatest(16, ceil(workers * greatest(1.0, ratio) * 1.5)))::BIGINT AS depth
FROM (SELECT unnest([1, 2, 4, 8, 16, 64])::BIGINT AS workers), (SELECT unnest([0.5, 1.0, 2.5, 7.75])::DOUBLE AS ratio)""")
def l3_frontier_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(w, r, stats.frontier_depth(8, w, ratio=r)) for w in (1, 2, 4, 8, 16, 64) for r in (0.5, 1.0, 2.5, 7.75)]
    return spark.createDataFrame(rows, "workers long, ratio double, depth long")


@query("""SELECT event_id, round(CASE WHEN value <= 10 THEN 0.0 WHEN value <= 50 THEN (value - 10) / 40 * 0.2 WHEN value <= 200 THEN 0.2 + (value - 50) / 150 * 0.5 ELSE 0.7 END, 9) AS loss FROM events""")
def m2_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = [(10.0, 0.0), (50.0, 0.2), (200.0, 0.7)]
    return table(spark, sf_dir, "events").select("event_id", F.round(stats.interpolate(F.col("value"), curve), 9).alias("loss"))


@query()
def m1_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width decisions of each user's event stream taken as deliveries."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("now_ns"), (F.col("event_type") == "error").alias("stalled"), "value")
    schema = "user_id long, event_id long, previous_width long, width long, reason string, starvation boolean, binding string, loss double"

    def step(machine, row):
        return machine.observe(row.now_ns, bool(row.stalled), int(row.value), 8)

    return control.fold(events, "user_id", "event_id", lambda: control.WidthController(8, 2_000_000_000, 5), step, schema)


@query()
def g4_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frontier per user: every event completes a candidate; the commits are returned."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")

    def step(machine, row):
        open_ = machine.candidates()
        if not open_:
            return None
        at = open_[int(row.value * 100) % len(open_)]
        machine.dispatch(at)
        machine.complete(at)
        done = machine.commit()
        return None if done is None else {"committed": done[0], "next": machine.next}

    return control.fold(events, "user_id", "event_id", lambda: control.Frontier(1 << 20, 4), step, "user_id long, event_id long, committed long, next long")


@query("""SELECT o_orderkey // 16 AS batch_id, min((o_orderkey // 16) % 6)::BIGINT AS worker, min(12345 + (o_orderkey // 16) % 6)::BIGINT AS lane_seed, count(*) AS n FROM orders GROUP BY ALL""")
def n2_worker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.batched(table(spark, sf_dir, "orders"), 16, "o_orderkey").groupBy("batch_id").agg(F.count("*").alias("n"))
    worker = F.pmod(F.col("batch_id"), F.lit(6))
    return rows.select("batch_id", worker.cast("long").alias("worker"), (worker + 12345).cast("long").alias("lane_seed"), "n")


PLANTED = "o_orderkey % 10 = 1 AND o_orderkey >= (SELECT max(o_orderkey) // 2 FROM orders)"


@query(f"""SELECT true AS same_run, (SELECT min(o_orderkey) FROM orders WHERE {PLANTED})::BIGINT AS first_mismatch, (SELECT count(*) FROM orders)::BIGINT AS compared""")
def o1_first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two physical runs of a stream agree; of planted changes the first is found."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_totalprice", "o_orderpriority")
    again = verify.verify(orders, orders.repartition(7))
    half = orders.agg(F.max("pos")).first()[0] // 2
    planted = (F.col("pos") % 10 == 1) & (F.col("pos") >= half)
    changed = orders.withColumn("o_totalprice", F.when(planted, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    found = verify.verify(orders, changed)
    return spark.createDataFrame([(again["bit_exact"], found["first_mismatch"], found["compared_samples"])], "same_run boolean, first_mismatch long, compared long")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'user_ceiling' WHEN value > 100 OR user_id % 10 = 0 THEN 'delivery_wait'
 WHEN (event_id % 100) / 100.0 < 0.5 THEN 'low_ready_saturation' ELSE 'not_identified' END AS cause FROM events""")
def o4_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = stats.attribution(
        F.when(F.col("event_type") == "error", F.col("event_type")), F.greatest(F.col("value") - 100, F.lit(0.0)),
        F.col("user_id") % 10 == 0, (F.col("event_id") % 100) / 100,
    )
    return table(spark, sf_dir, "events").select("event_id", cause.alias("cause"))


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def i1_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", fp.row_digest("n_nationkey", "n_name", "n_regionkey").alias("digest"))


@query("""
WITH a AS (SELECT n_nationkey AS ord, 'nation.' || n_name AS path, n_regionkey::VARCHAR AS v FROM nation WHERE n_nationkey <> 20),
b AS (SELECT n_nationkey AS ord, 'nation.' || n_name AS path, CASE WHEN n_nationkey = 7 THEN '9' ELSE n_regionkey::VARCHAR END AS v FROM nation WHERE n_nationkey <> 3)
SELECT coalesce(a.path, b.path) AS path, a.v AS expected, b.v AS found, row_number() OVER (ORDER BY (a.ord IS NULL)::INT, coalesce(a.ord, b.ord)) AS place
FROM a FULL JOIN b USING (path) WHERE a.v IS DISTINCT FROM b.v""")
def i2_first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("nation."), "n_name").alias("path"), F.col("n_regionkey").cast("string").alias("value"))
    changed = base.where("ord <> 3").withColumn("value", F.when(F.col("ord") == 7, "9").otherwise(F.col("value")))
    out = fp.differences(base.where("ord <> 20"), changed)
    return out.select("path", "expected", "found", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


@query()
def i8_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of a stream's contract fingerprint and its digest."""
    from weftline.plans.loader import BatchStream

    stream = BatchStream(indexed(spark, sf_dir, "orders", "o_orderkey"), 32, shuffle=True, seed=1)
    rows = [(p, json.dumps(v, sort_keys=True), fp.digest(stream.contract)) for p, v in stream.contract]
    return spark.createDataFrame(rows, "path string, value string, digest string")
