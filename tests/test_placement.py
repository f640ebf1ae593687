import pytest
from pyspark.sql import functions as F

from weftline.operators import placement
from weftline.operators.placement import Geometry, plan


def model(n, b, w, drop, exact):
    """Positions of each rank by a plain loop."""
    g = b * w
    full = n // g * g
    end = full if drop or exact else -(-n // g) * g
    out = {r: [] for r in range(w)}
    for start in range(0, end, g):
        for r in range(w):
            out[r] += [(p, p if p < n else (p - n) % n) for p in range(start + r * b, start + (r + 1) * b)]
    if exact and not drop:
        t = n - full
        for r in range(w):
            out[r] += [(p, p) for p in range(full + r * t // w, full + (r + 1) * t // w)]
    return out


@pytest.mark.parametrize("n, b, w, drop, exact", [(0, 1, 1, False, False), (5, 4, 8, False, False), (103, 4, 8, False, True), (103, 4, 8, True, False), (7, 2, 48, False, True), (17, 4, 1, False, False), (200, 3, 7, False, True)])
def test_plan_equals_loop(spark, n, b, w, drop, exact):
    rows = plan(spark, Geometry(n, b, w, drop, exact)).collect()
    for r, expected in model(n, b, w, drop, exact).items():
        assert sorted((x["pos"], x["index"]) for x in rows if x["rank"] == r) == expected
    for x in rows:
        assert x["coord"] == x["pos"]


def test_offsets_are_dense_in_each_batch(spark):
    for exact in (False, True):
        rows = plan(spark, Geometry(103, 4, 8, exact_count=exact)).groupBy("rank", "batch_id").agg(F.count("*").alias("n"), F.max("offset").alias("top"), F.min("offset").alias("low"))
        assert all(r["top"] == r["n"] - 1 and r["low"] == 0 for r in rows.collect())


@pytest.mark.parametrize("world", [1, 2, 8, 48])
def test_elastic_worlds_share_global_batches(spark, world):
    base = Geometry(500, 48, 1)
    one = {(r["batch_id"], r["index"], r["coord"]) for r in plan(spark, base, 9, 2, True, 1).collect()}
    other = {(r["batch_id"], r["index"], r["coord"]) for r in plan(spark, base.elastic(world), 9, 2, True, 1).collect()}
    assert one == other


def test_resume_is_the_suffix(spark):
    g = Geometry(130, 8, 2)
    whole = plan(spark, g, 1, 0, True).where("batch_id >= 3").collect()
    assert sorted(whole) == sorted(plan(spark, g, 1, 0, True, cursor=3).collect())


def test_single_process_never_pads(spark):
    assert plan(spark, Geometry(10, 4, distributed=False)).count() == 10
    assert plan(spark, Geometry(10, 4)).count() == 12
    assert plan(spark, Geometry(10, 4, distributed=False, drop_last=True)).count() == 8


@pytest.mark.parametrize("bad", [dict(length=-1), dict(length=1, batch_size=0), dict(length=1, world_size=0), dict(length=1, world_size=2, distributed=False)])
def test_bad_geometry(bad):
    with pytest.raises(ValueError):
        Geometry(**bad)


def test_bad_elastic_world_and_rank(spark):
    with pytest.raises(ValueError):
        Geometry(10, 4, 2).elastic(3)
    with pytest.raises(ValueError):
        plan(spark, Geometry(10, 4, 2), rank=2)


def test_gather_rejects_clashing_columns(spark):
    with pytest.raises(ValueError):
        placement.gather(plan(spark, Geometry(3)), spark.range(3).select(F.col("id").alias("index"), F.lit(1).alias("rank")))
