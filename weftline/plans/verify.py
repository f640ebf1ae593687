"""Bit-exact comparison of two runs of one stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bits(kind: T.DataType, c: Column) -> Column:
    """A value's exact bits as text: floats by their bytes, so -0.0 and NaN payloads count."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        real, whole = (np.float64, np.int64) if isinstance(kind, T.DoubleType) else (np.float32, np.int32)

        @F.pandas_udf("long")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(x.to_numpy(real).view(whole).astype(np.int64))

        return F.when(c.isNotNull(), run(c)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return F.to_json(F.struct(c.alias("v")))


def encoded(df: DataFrame, position: str) -> DataFrame:
    values = [F.coalesce(bits(f.dataType, F.col(f.name)), F.lit("null")) for f in df.schema.fields if f.name != position]
    return df.select(F.col(position).alias("pos"), F.sha2(F.to_json(F.array(*values)), 256).alias("bits"))


def verify(left: DataFrame, right: DataFrame, position: str = "pos") -> dict:
    """Whether two runs agree bit for bit, and the first position at which they do not."""
    if left.schema.simpleString() != right.schema.simpleString():
        return {"bit_exact": False, "compared_samples": 0, "first_mismatch": None}
    a, b = encoded(left, position), encoded(right, position).withColumnRenamed("bits", "other")
    joined = a.join(b, "pos", "full_outer")
    n, first = joined.agg(F.count("*"), F.min(F.when(~F.col("bits").eqNullSafe(F.col("other")), F.col("pos")))).first()
    return {"bit_exact": first is None, "compared_samples": n, "first_mismatch": first}
