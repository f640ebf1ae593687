"""Typed stage pipelines: Source, one Decode at most, any Transforms, Collate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import batch, placement
from weftline.plans import fingerprint as fp

Expression = Callable[[Column], Column]

# Built-in decoders by codec, as name@version.
CODECS = {"utf8": "spark-decode@1", "json": "spark-from-json@1", "int": "spark-cast@1"}


def pins(steps: list, overrides: dict[str, tuple[str, str]] | None = None) -> list[dict]:
    """Which decoder each decode stage of a pipeline uses, as ``(stage, codec, decoder, version,
    by)``. An override is named by the stage, ``pipeline-decode-{i}`` counted over the sample
    stages, or else by the codec, and fits stages with a codec only; one that fits none raises."""
    left, out = dict(overrides or {}), []
    used: set[str] = set()
    samples = [s for s in steps if isinstance(s, (Decode, Transform))]
    for i, stage in enumerate(samples):
        if not isinstance(stage, Decode):
            continue
        name = f"pipeline-decode-{i}"
        if stage.fn is not None:
            who = fp.callable_identity(stage.fn)
            decoder, version, by = who.get("name", "callable"), who.get("code", "none"), "callable"
        else:
            key = next((k for k in (name, stage.codec) if k in left), None)
            used |= {key} - {None}
            decoder, version = left[key] if key else CODECS[stage.codec].split("@")
            by = "override" if key else "table"
        out.append({"stage": name, "codec": stage.codec or "custom", "decoder": decoder, "version": version, "by": by})
    if set(left) - used:
        raise ValueError(f"no stage takes these decoder overrides: {sorted(set(left) - used)}")
    return out


@dataclass(frozen=True)
class Source:
    """Rows ``index, value``: a DataFrame, or ``fn(index)`` over an explicit length."""

    data: DataFrame | Callable
    length: int | None = None
    output_type: str = "object"

    def __post_init__(self) -> None:
        if callable(self.data) and not isinstance(self.data, DataFrame) and self.length is None:
            raise ValueError("a callable source needs an explicit length")

    def rows(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.data, DataFrame):
            return self.data
        fn, kind = self.data, "string" if self.output_type == "object" else self.output_type

        @F.pandas_udf(kind)
        def run(at: pd.Series) -> pd.Series:
            return at.map(lambda i: fn(int(i)))

        return spark.range(self.length).select(F.col("id").alias("index"), run("id").alias("value"))


@dataclass(frozen=True)
class Decode:
    """Bytes to values by a codec name or a column expression; a substitute needs a codec."""

    fn: Expression | None = None
    codec: str | None = None
    schema: str | None = None
    substitute: object = None
    input_type: str = "object"
    output_type: str = "object"

    def __post_init__(self) -> None:
        if self.codec is not None and self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec}")
        if self.substitute is not None and self.codec is None:
            raise ValueError("a substitute needs a codec")
        if self.codec is None and self.fn is None:
            raise ValueError("a decode stage needs a codec or a function")

    def apply(self, c: Column) -> Column:
        if self.fn is not None:
            out = self.fn(c)
        elif self.codec == "utf8":
            out = F.decode(c, "UTF-8")
        elif self.codec == "json":
            out = F.from_json(F.decode(c.cast("binary"), "UTF-8"), self.schema)
        else:
            out = F.decode(c.cast("binary"), "UTF-8").try_cast("bigint")
        return out if self.substitute is None else F.coalesce(out, F.lit(self.substitute))


@dataclass(frozen=True)
class Transform:
    """One value to one value: a column expression, or a Python function run as a pandas UDF."""

    fn: Callable
    input_type: str = "object"
    output_type: str = "object"
    python: bool = False

    def apply(self, c: Column) -> Column:
        if not self.python:
            return self.fn(c)
        fn = self.fn

        @F.pandas_udf(self.output_type)
        def run(x: pd.Series) -> pd.Series:
            return x.map(fn)

        return run(c)


@dataclass(frozen=True)
class Collate:
    """A batch's values to one value: an expression over their array in order."""

    fn: Expression
    input_type: str = "object"
    output_type: str = "object"


@dataclass(frozen=True)
class Pipeline:
    source: Source
    samples: tuple = ()
    collate: Collate | None = None
    elements: tuple = field(default=())

    def values(self, spark: SparkSession) -> DataFrame:
        rows = self.source.rows(spark)
        value = F.col("value")
        for stage in self.samples:
            value = stage.apply(value)
        return rows.select("index", value.alias("value"))

    def batches(self, spark: SparkSession, g: placement.Geometry, **options) -> DataFrame:
        """``rank, batch_id, value`` of the collated batches."""
        plan = placement.plan(spark, g, **options)
        rows = placement.gather(plan, self.values(spark))
        out = batch.collate(rows, ["value"], ["rank", "batch_id"], strict=False)
        return out.select("rank", "batch_id", self.collate.fn(F.col("value")).alias("value"))

    def fingerprint(self) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = []
        for i, s in enumerate((*self.samples, self.collate)):
            codec = getattr(s, "codec", None)
            out.append((f"stages.{i}", {"kind": type(s).__name__, "codec": CODECS.get(codec), "fn": fp.callable_identity(s.fn) if s.fn else None}))
        return out


def pipeline(*stages) -> Pipeline:
    """Check the order and the declared types at the edges, then compose."""
    if len(stages) < 2:
        raise ValueError("a pipeline needs a source and a collate stage")
    if not isinstance(stages[0], Source) or not isinstance(stages[-1], Collate):
        raise TypeError("a pipeline starts with a source and ends with a collate stage")
    inner = stages[1:-1]
    for i, s in enumerate(inner):
        if not isinstance(s, (Decode, Transform)):
            raise TypeError("only decode and transform stages may stand between")
        if isinstance(s, Decode) and i:
            raise ValueError("a decode stage comes once, before any transform")
    for a, b in zip(stages, stages[1:], strict=False):
        if "object" not in (a.output_type, b.input_type) and a.output_type != b.input_type:
            raise TypeError(f"{type(a).__name__} gives {a.output_type} but {type(b).__name__} takes {b.input_type}")
    return Pipeline(stages[0], inner, stages[-1])
