"""Batching and collation: rows to struct-of-arrays batches, padding and byte counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNEQUAL = "each element in list of batch should be of equal size"


def batched(df: DataFrame, batch_size: int, position: str = "pos", drop_last: bool = False, length: int | None = None) -> DataFrame:
    """``batch_id`` and ``offset`` from a dense position."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    out = df.withColumn("batch_id", F.floor(F.col(position) / batch_size).cast("long")).withColumn("offset", F.pmod(F.col(position), F.lit(batch_size)))
    if drop_last:
        if length is None:
            raise ValueError("drop_last needs the length")
        out = out.where(F.col(position) < length // batch_size * batch_size)
    return out


def of_name(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


def transposed(kind: T.DataType, values: Column) -> Column:
    """A batch's array of nested values as one nested value of arrays: mappings by the keys of the
    first (a key that another lacks raises), sequences by place (lengths must be equal), structs
    by field, leaves as the array itself."""
    if isinstance(kind, T.StructType):
        return F.struct(*(transposed(f.dataType, F.transform(values, of_name(f.name))).alias(f.name) for f in kind.fields))
    first = F.element_at(values, 1)
    if isinstance(kind, T.MapType):

        def of_key(k: Column) -> Column:
            lacking = F.raise_error(F.concat(F.lit("a mapping of the batch lacks the key "), k.cast("string"))).cast(kind.valueType)
            one = F.transform(values, lambda r: F.when(F.map_contains_key(r, k), F.element_at(r, k)).otherwise(lacking))
            return F.struct(k.alias("key"), transposed(kind.valueType, one).alias("value"))

        return F.map_from_entries(F.transform(F.map_keys(first), of_key))
    if isinstance(kind, T.ArrayType):
        ragged = F.exists(values, lambda r: F.size(r) != F.size(first))
        places = F.when(ragged, F.raise_error(F.lit(UNEQUAL)).cast("array<int>")).when(F.size(first) > 0, F.sequence(F.lit(0), F.size(first) - 1))
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: transposed(kind.elementType, F.transform(values, lambda r: F.get(r, i))))
    return values


def collate_nested(df: DataFrame, columns: list[str], keys: list[str] | None = None, offset: str = "offset") -> DataFrame:
    """One row for each batch, its columns' mappings, sequences and structs transposed."""
    keys, kinds = keys or ["batch_id"], {c: df.schema[c].dataType for c in columns}
    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(offset, *columns)), lambda a, b: (a[offset] - b[offset]).cast("int")).alias("_rows"))
    parts = (transposed(kinds[c], F.transform("_rows", of_name(c))).alias(c) for c in columns)
    return gathered.select(*keys, F.size("_rows").cast("long").alias("n"), *parts)


def collate(df: DataFrame, columns: list[str], keys: list[str] | None = None, offset: str = "offset", strict: bool = True) -> DataFrame:
    """One row for each batch with an array for each column, in offset order.

    ``strict`` is row collation: a null leaf or arrays of unequal size raise; otherwise both are
    kept as they are. A batch is bounded by its size, so the gathered arrays are too."""
    keys = keys or ["batch_id"]
    rows = F.array_sort(F.collect_list(F.struct(offset, *columns)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), rows.alias("_rows"))
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def column(c: str) -> Column:
        values = F.transform("_rows", lambda r: r[c])
        if strict:
            values = F.when(F.exists(values, lambda v: v.isNull()), F.raise_error(F.lit(f"null leaf in column {c}")).cast(T.ArrayType(kinds[c]))).otherwise(values)
            if isinstance(kinds[c], T.ArrayType):
                ragged = F.size(F.array_distinct(F.transform("_rows", lambda r: F.size(r[c])))) > 1
                values = F.when(ragged, F.raise_error(F.lit(UNEQUAL)).cast(T.ArrayType(kinds[c]))).otherwise(values)
        return values.alias(c)

    return out.select(*keys, "n", *(column(c) for c in columns))


def pad(df: DataFrame, column: str, keys: list[str] | None = None, offset: str = "offset", fill=0) -> DataFrame:
    """Padded batches of an array column, time first: ``(longest, batch)`` arrays and lengths."""
    keys = keys or ["batch_id"]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(offset, column))).alias("_rows"))
    rows = rows.select(*keys, F.transform("_rows", lambda r: r[column]).alias("_v"))
    rows = rows.withColumn("longest", F.coalesce(F.array_max(F.transform("_v", F.size)), F.lit(0)))
    steps = F.when(F.col("longest") > 0, F.sequence(F.lit(0), F.col("longest") - 1)).otherwise(F.array().cast("array<int>"))
    element = df.schema[column].dataType.elementType
    padded = F.transform(steps, lambda t: F.transform("_v", lambda r: F.coalesce(F.get(r, t), F.lit(fill).cast(element))))
    return rows.select(*keys, "longest", F.transform("_v", F.size).alias("lengths"), padded.alias(column))


def payload_bytes(schema: T.StructType, prefix: Column | None = None) -> Column:
    """Bytes of a row's payload: texts as UTF-8, numbers in arrays by their width, scalars as 8."""
    widths = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1}

    def of(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        if isinstance(kind, T.ArrayType):
            if type(kind.elementType) in widths:
                return F.greatest(F.size(c), F.lit(0)).cast("long") * widths[type(kind.elementType)]
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + of(kind.elementType, x)), F.lit(0))
        if isinstance(kind, T.StructType):
            return sum((of(f.dataType, c[f.name]) for f in kind.fields), F.lit(0).cast("long"))
        if isinstance(kind, T.NumericType) or isinstance(kind, T.BooleanType):
            return F.when(c.isNotNull(), 8).otherwise(0).cast("long")
        return F.lit(0).cast("long")

    return sum((of(f.dataType, F.col(f.name) if prefix is None else prefix[f.name]) for f in schema.fields), F.lit(0).cast("long"))


def user_collate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] | None = None, offset: str = "offset") -> DataFrame:
    """A user function for each batch, whose rows come in offset order."""
    return df.groupBy(*(keys or ["batch_id"])).applyInPandas(lambda b: fn(b.sort_values(offset, ignore_index=True)), schema)


def batch_shape(schema: T.StructType, batch_size: int) -> dict:
    """What a collated batch looks like, from the schema alone."""

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"kind": "tensor", "dtype": kind.elementType.simpleString(), "shape": ["batch", None]}
        if isinstance(kind, T.StructType):
            return {"kind": "mapping", "items": {f.name: of(f.dataType) for f in kind.fields}}
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return {"kind": "list", "dtype": kind.simpleString(), "shape": ["batch"]}
        return {"kind": "tensor", "dtype": kind.simpleString(), "shape": ["batch"]}

    return {"batch_size": batch_size, "columns": {f.name: of(f.dataType) for f in schema.fields}}
