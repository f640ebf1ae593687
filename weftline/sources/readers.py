"""Map-style sources: tables and files as DataFrames with a dense ``index`` column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.shared import written


def dense_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """A dense 0-based index in a total order, without a single-task window.

    Rows are range-partitioned, sorted and written once, each with its partition and its place
    there. All that follows reads the written rows: partitions are counted, and a row's index is
    what the partitions before hold and its place. So neither another cut of the ranges nor
    coalesced partitions can change it between jobs. Ties must not exist or be equal rows."""
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), "dense-index")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _first long")
    joined = rows.join(F.broadcast(first), part == F.col("_part"))
    return joined.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_first")


def keyed(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """A table whose key is already a dense index."""
    return df.withColumn(name, F.col(key).cast("long"))


def parquet(spark: SparkSession, path: str, key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet source; projection reaches the scan. Partitioned folders are read too."""
    df = spark.read.parquet(path)
    df = keyed(df, key) if key else dense_index(df, df.columns)
    return df.select("index", *columns) if columns else df


def range_batch(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows [start, stop) of a source; the bound on a key column is pushed to the scan."""
    return df.where((F.col("index") >= start) & (F.col("index") < stop))


def zipped(parts: dict[str, DataFrame]) -> DataFrame:
    """Columns of several sources by equal index; unequal lengths are rejected."""
    sizes = {n: d.count() for n, d in parts.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"sources differ in length: {sizes}")
    out: DataFrame | None = None
    for name, d in parts.items():
        cols = [c for c in d.columns if c != "index"]
        value = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
        one = d.select("index", value.alias(name))
        out = one if out is None else out.join(one, "index")
    return out


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Labelled files: path order gives the index, the sorted parent folders the target."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([s.lstrip(".").lower() for s in suffixes]))
    files = files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("label"))
    labels = [r[0] for r in files.select("label").distinct().orderBy("label").collect()]  # one for each folder
    target = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1 if labels else F.lit(None).cast("long")
    return dense_index(files.withColumn("target", target.cast("long")), ["path"])


def byte_range(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """Bytes [offset, offset + length) of each file, shorter at its end; only these are read."""
    from pyarrow import fs

    def run(batches):
        for pdf in batches:
            found = []
            for name in pdf["path"]:
                system, local = fs.FileSystem.from_uri(name)
                with system.open_input_file(local) as f:
                    f.seek(min(offset, f.size()))
                    found.append(f.read(length))
            yield pdf.assign(bytes=found)

    files = spark.read.format("binaryFile").load(path).select("path")  # the content is not read
    return files.mapInPandas(run, "path string, bytes binary")


# Kinds of source that have a reader of their own.
KINDS = ("parquet", "folder", "records", "columns", "table", "callable")


def source(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    """A source by its kind: the reader of that kind, else the reader of single rows for a
    ``callable``; an unknown kind falls back to Spark's own format of that name, indexed."""
    readers_of = {"parquet": parquet, "folder": folder, "records": fixed_records, "callable": black_box}
    if kind in readers_of:
        return readers_of[kind](spark, *args, **options)
    if kind == "columns":
        return zipped(*args, **options)
    rows = spark.table(args[0]) if kind == "table" else spark.read.format(kind).options(**options).load(*args)
    return dense_index(rows, rows.columns)


def inventory(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Relative path and size of each file; with ``strict`` its SHA-256 too. No times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = files.sparkSession._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    cut = F.expr(f"substring(path, instr(path, '{prefix}') + {len(prefix)})")
    out = files.select(cut.alias("path"), F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if strict else []))
    return out


def fixed_records(spark: SparkSession, path: str, dtype: str, items: int = 1, records_per_task: int = 1 << 16) -> DataFrame:
    """Fixed-width records of a raw binary file: each task reads its own byte range."""
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    kind = np.dtype(dtype)
    width = kind.itemsize * items
    size = system.get_file_info(local).size
    if size % width:
        raise ValueError(f"{path}: {size} bytes are no whole number of {width}-byte records")
    count = size // width
    element = {"i": "bigint", "u": "bigint", "f": "double"}[kind.kind]

    def run(batches):
        system, local = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for pdf in batches:
            for start in pdf["id"]:
                n = min(records_per_task, count - start)
                with system.open_input_file(local) as f:
                    f.seek(int(start) * width)
                    values = np.frombuffer(f.read(n * width), kind).reshape(n, items)
                yield pd.DataFrame({"index": np.arange(start, start + n), "v": list(values.astype(np.int64 if element == "bigint" else np.float64))})

    tasks = max(1, -(-count // records_per_task))
    return spark.range(0, count, records_per_task, tasks).mapInPandas(run, f"index long, v array<{element}>")


def black_box(spark: SparkSession, fn: Callable[[int], dict], length: int, schema: str | T.StructType) -> DataFrame:
    """Any sized indexable: ``fn(index)`` gives a row's fields."""
    if isinstance(length, bool) or not isinstance(length, int) or length < 0:
        raise ValueError("length must be a nonnegative integer")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([T.StructField("index", T.LongType()), *kind.fields])

    def run(batches):
        for pdf in batches:
            rows = [{"index": int(i), **fn(int(i))} for i in pdf["id"]]
            if rows:
                yield pd.DataFrame(rows, columns=full.names)

    return spark.range(length).mapInPandas(run, full)
