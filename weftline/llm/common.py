"""Shared pieces: the shared work folder, materialised tables and connected components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every operator's word rule: space and \x09-\x0D,
#: which is just what ``bytes.split()`` splits on.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; the warehouse, which is shared too, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: cuts lineage,
    survives lost executors and computes expensive Python stages once."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table written by ``materialise`` once nothing reads it any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def hex64(col: Column) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def text_column(df: DataFrame) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(u long, v long)``.

    Alternating large-star and small-star rounds: each is one partial-aggregated ``min`` by
    node and one equi-join; the number of rounds grows with the logarithm of the largest
    component. A node with a thousandth of all edges (1000 at least) is a hub: there are 2000 at
    most, and their rows find their minimum by a broadcast, so that no task gathers them. Returns ``(id, component_id)`` for all
    nodes that have an edge, where ``component_id`` is the smallest id reachable. Self-loops
    and repeated edges are allowed; no edges give an empty result.
    """
    spark = edges.sparkSession
    cur = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )

    def with_low(both: DataFrame, low: DataFrame, found: list) -> DataFrame:
        if not found:
            return both.join(low, "u")
        hubs = F.broadcast(spark.createDataFrame(found, "u long, m long"))
        others = both.join(hubs, "u", "left_anti").join(low.join(hubs, "u", "left_anti"), "u")
        return others.unionByName(both.join(hubs, "u"))

    def checksum(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = checksum(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        found = low.where(F.col("n") >= max(1000, before[0] // 1000)).select("u", "m").collect()
        met = with_low(both, low.drop("n"), found)
        low = low.drop("n")
        large = met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes whose larger neighbours moved away keep their own link to the minimum.
        large = large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))  # few rows a node: its minima of before
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_min.select("u", F.col("m").alias("v")))
        nxt = materialise(small.distinct(), name)
        discard(cur)
        cur, after = nxt, checksum(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return members.unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
