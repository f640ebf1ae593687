import random
from collections import deque

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.operators import batch, lanes
from weftline.plans import fingerprint as fp
from weftline.plans import stages, state, verify
from weftline.plans.loader import BatchStream
from weftline.sources import iterable, readers
from weftline.streaming import control, lane_state


def source(spark, n):
    return spark.range(n).select(F.col("id").alias("index"), (F.col("id") * 10).alias("v"))


def values(rows):
    return [list(r["v"]) for r in rows]


def test_stream_is_reproducible_and_covers_the_epoch(spark):
    a = BatchStream(source(spark, 23), 4, shuffle=True, seed=5)
    b = BatchStream(source(spark, 23).repartition(5), 4, shuffle=True, seed=5)
    first = values(a)
    assert first == values(b) and sorted(sum(first, [])) == [i * 10 for i in range(23)]
    assert values(a) != first and a.epochs.current == 2


@pytest.mark.parametrize("cut", [0, 1, 3, 5])
def test_resume_at_every_cut(spark, cut):
    whole = values(BatchStream(source(spark, 23), 4, shuffle=True, seed=5))
    a = BatchStream(source(spark, 23), 4, shuffle=True, seed=5)
    it = iter(a)
    head = [list(next(it)["v"]) for _ in range(cut)]
    saved = a.state_dict()
    b = BatchStream(source(spark, 23), 4, shuffle=True, seed=99)
    b.load_state_dict(saved)
    assert head + values(b) == whole


def test_resume_out_of_order(spark):
    a = BatchStream(source(spark, 12), 2, seed=1, delivery="on-completion")
    a._delivered = state.Delivered()
    a._delivered.mark(1)
    saved = a.state_dict()
    assert saved["cursor"] == 0 and bytes.fromhex(saved["delivered_bitmap"]) == b"\x02"
    b = BatchStream(source(spark, 12), 2, seed=1, delivery="on-completion")
    b.load_state_dict(saved)
    assert sorted(values(b)) == [[0, 10], [40, 50], [60, 70], [80, 90], [100, 110]]
    with pytest.raises(ValueError, match="in-order"):
        c = BatchStream(source(spark, 12), 2, seed=1)
        c.load_state_dict(saved | {"fingerprint": fp.document(c.contract)})


def test_restore_refuses_changes(spark):
    saved = BatchStream(source(spark, 12), 2, seed=1).state_dict()
    with pytest.raises(ValueError, match="dataset.rows"):
        BatchStream(source(spark, 13), 2, seed=1).load_state_dict(saved)
    with pytest.raises(ValueError, match="elastic"):
        BatchStream(source(spark, 12), 3, seed=1).load_state_dict(saved)
    with pytest.raises(ValueError, match="cursor"):
        BatchStream(source(spark, 12), 2, seed=1).load_state_dict(saved | {"cursor": 7})


def test_sampler_streams(spark):
    picks = spark.createDataFrame([(0, 3), (1, 3), (2, 0), (3, 5), (4, 1)], "pos long, index long")
    s = BatchStream(source(spark, 6), 2, sampler=picks, seed=1)
    assert values(s) == [[30, 30], [0, 50], [10]]
    groups = spark.createDataFrame([(0, 0, 4), (1, 0, 2), (1, 1, 2), (1, 2, 0)], "batch_id long, offset long, index long")
    s = BatchStream(source(spark, 6), batch_sampler=groups, seed=1)
    assert values(s) == [[40], [20, 20, 0]]
    assert [r["coord"] for r in s.plan().orderBy("batch_id", "offset").collect()] == [0, 1, 2, 3]
    swapped = spark.createDataFrame([(0, 3), (1, 3), (2, 5), (3, 0), (4, 1)], "pos long, index long")
    assert state.positions_checksum(picks, ["pos"]) != state.positions_checksum(swapped, ["pos"]) == state.positions_checksum(swapped.repartition(3), ["pos"])


@pytest.mark.parametrize(
    "bad", [dict(shuffle=True, sampler=1), dict(batch_sampler=1, batch_size=2), dict(batch_size=None, drop_last=True), dict(batch_size=0), dict(delivery="x"), dict(seed=1 << 64)]
)
def test_option_conflicts(spark, bad):
    with pytest.raises(ValueError):
        BatchStream(spark.range(3).withColumnRenamed("id", "index"), **bad)


def test_collation_errors_and_padding(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3])], "batch_id long, offset long, v array<long>")
    with pytest.raises(Exception, match="equal size"):
        batch.collate(rows, ["v"]).collect()
    assert batch.collate(rows, ["v"], strict=False).first()["v"] == [[1, 2], [3]]
    assert batch.pad(rows, "v").first()["v"] == [[1, 3], [2, 0]]
    with pytest.raises(Exception, match="null leaf"):
        batch.collate(spark.createDataFrame([(0, 0, None)], "batch_id long, offset long, v long"), ["v"]).collect()


def test_pipeline_of_stages(spark):
    raw = spark.createDataFrame([(i, str(i + 1).encode()) for i in range(4)], "index long, value binary")
    total = stages.Collate(lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x))
    p = stages.pipeline(stages.Source(raw), stages.Decode(codec="int"), stages.Transform(lambda c: c * 2), total)
    from weftline.operators.placement import Geometry

    assert [r["value"] for r in p.batches(spark, Geometry(4, 2, distributed=False)).orderBy("batch_id").collect()] == [6, 14]
    py = stages.pipeline(stages.Source(lambda i: f"x{i}", 3), stages.Transform(lambda v: v + "!", output_type="string", python=True), stages.Collate(lambda v: F.array_join(v, "")))
    assert py.batches(spark, Geometry(3, 3, distributed=False)).first()["value"] == "x0!x1!x2!"
    for wrong in ([stages.Source(raw)], [stages.Source(raw), stages.Transform(abs)], [stages.Source(raw), stages.Transform(abs), stages.Decode(codec="int"), total]):
        with pytest.raises((ValueError, TypeError)):
            stages.pipeline(*wrong)
    with pytest.raises(TypeError):
        stages.pipeline(stages.Source(raw, output_type="binary"), stages.Collate(abs, input_type="bigint"))
    with pytest.raises(ValueError):
        stages.Decode(fn=abs, substitute=1)


def robin(sizes, b, drop):
    """Round robin by a rotating queue."""
    queue, out = deque((lane, list(range(n))) for lane, n in enumerate(sizes)), []
    while queue:
        lane, left = queue.popleft()
        part, left = left[:b], left[b:]
        if not part:
            continue
        if len(part) == b or not drop:
            out.append((lane, tuple(part)))
        if left or len(part) == b:
            queue.append((lane, left))
    return out


def test_round_robin_equals_queue(spark):
    pick = random.Random(2)
    for drop in (False, True):
        sizes = [pick.randint(0, 9) for _ in range(5)]
        rows = spark.createDataFrame([(lane, a) for lane, n in enumerate(sizes) for a in range(n)], "lane long, arrival long")
        got = lanes.round_robin(rows, 3, drop).groupBy("delivery", "lane").agg(F.array_sort(F.collect_list("arrival")).alias("a")).orderBy("delivery").collect()
        assert [(r["lane"], tuple(r["a"])) for r in got] == robin(sizes, 3, drop)
        assert [r["delivery"] for r in got] == list(range(len(got)))


def numbers(lane, lanes, rank, world):
    return ((v,) for v in range(rank * lanes + lane, 10, world * lanes))


def test_iterable_source_batch_and_stream(spark, tmp_path):
    iterable.register(spark, "numbers", numbers, "value long")
    rows = iterable.read_lanes(spark, "numbers", lanes=3)
    out = lanes.round_robin(rows, 2).groupBy("delivery").agg(F.array_sort(F.collect_list(F.struct("arrival", "value"))).alias("v")).orderBy("delivery")
    assert [[x["value"] for x in r["v"]] for r in out.collect()] == [[0, 3], [1, 4], [2, 5], [6, 9], [7], [8]]
    stream = iterable.stream_lanes(spark, "numbers", lanes=3, rows_per_trigger=2, limit=4)
    q = stream.writeStream.format("memory").queryName("numbers_out").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["value"] for r in spark.table("numbers_out").collect()) == list(range(10))


def test_stateful_controller_equals_batch_fold(spark, tmp_path):
    data = [(u, e, e * 1_000_000_000, e % 4 == 0, 9 if u else 2) for u in (0, 1) for e in range(40)]
    schema = "k long, e long, now long, stalled boolean, occupied long"
    spark.createDataFrame(data, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    out = "k long, e long, previous_width long, width long, reason string, starvation boolean, binding string, loss double"

    def make():
        return control.WidthController(6, 3_000_000_000, 2)

    def step(machine, row):
        return machine.observe(row.now, bool(row.stalled), int(row.occupied), 4)

    expected = control.fold(spark.read.parquet(str(tmp_path / "in")), "k", "e", make, step, out).collect()
    stream = control.stateful(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "e", make, step, out)
    q = stream.writeStream.format("memory").queryName("widths").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(spark.table("widths").collect(), key=str) == sorted(expected, key=str) and expected


def test_controller_rules():
    c = control.WidthController(4, 10, 1, hysteresis=2, bandwidth_ceiling=100.0)
    assert c.observe(1, False, 9, 4) is None
    assert c.observe(20, False, 9, 4)["reason"] == "hold"
    assert c.observe(40, False, 9, 4)["reason"] == "resource-minimum" and c.width == 3
    assert c.observe(60, True, 9, 4)["reason"] == "starvation" and c.width == 4
    assert c.observe(80, False, 9, 4, 200.0)["binding"] == "bandwidth" and c.width == 3


def test_frontier_and_ring():
    f = control.Frontier(10, 2, ceiling=8)
    for p in (1, 0):
        f.dispatch(p)
        f.complete(p)
    assert f.commit(2) == [0, 1]
    f.dispatch(2)
    f.dispatch(3)
    assert f.stall() and f.depth == 4 and not f.stall()
    for p in (4, 5):
        f.dispatch(p)
    assert f.stall() and f.depth == 8 and f.growths == 2
    with pytest.raises(RuntimeError):
        f.dispatch(2)
    past = control.LaneHistory(keep=3, most_bytes=4)
    assert all(past.add(a, b"x") for a in (2, 4, 6)) and past.newest(5) == (4, b"x") and past.newest(1) is None
    past.forget(5)
    assert past.arrivals == [4, 6]
    assert not past.add(8, b"12345") and not past.wanted(1, force=True) and past.newest(9) is None


def test_delivered_set_and_bitmap():
    d = state.Delivered()
    d.mark(1)
    assert d.bitmap() == b"\x02"
    d.mark(0)
    assert d.base == 2 and d.bitmap() == b""
    with pytest.raises(RuntimeError):
        d.mark(1)
    assert state.decode_bitmap(2, b"\x02\x01", 20) == {3, 10}
    for base, bits, total in ((5, b"", 4), (0, b"\x01", 9), (0, b"\x00\x80", 9)):
        with pytest.raises(ValueError):
            state.decode_bitmap(base, bits, total)


def test_epochs():
    e = state.EpochClock()
    assert not e.turn("start")
    e.turn("deliver", 0)
    e.turn("finish", 0)
    assert e.current == 1 and not e.turn("start")
    e.turn("deliver", 0)  # of an iteration that is over
    e.turn("deliver", 1)
    assert e.turn("start") and e.current == 2
    e.hold(7)
    assert not e.turn("start") and e.current == 7
    e.hold(9)
    e.turn("finish", 7)
    assert e.current == 9 and e.held
    with pytest.raises(TypeError):
        e.hold(True)
    with pytest.raises(ValueError):
        e.hold(-1)


def test_fingerprints():
    a, b = [("x", 1), ("y", [1, "é"])], [("x", 1), ("y", [2]), ("z", 0)]
    assert fp.parsed(fp.document(a)) == a and fp.first_difference(a, b) == "y" and fp.first_difference(a, a + [("q", 1)]) == "q"
    with pytest.raises(ValueError, match="mismatch at y"):
        fp.require_match(a, b)
    with pytest.raises(ValueError):
        fp.parsed(fp.document(a) | {"digest": "0"})
    with pytest.raises(ValueError):
        fp.digest([("x", 1), ("x", 2)])
    assert fp.callable_identity(lambda v: v + 1)["code"] != fp.callable_identity(lambda v: v + 2)["code"]


def test_verify_sees_float_bits(spark):
    a = spark.createDataFrame([(0, 0.0), (1, float("nan"))], "pos long, v double")
    assert verify.verify(a, a.repartition(3))["bit_exact"]
    assert verify.verify(a, a.withColumn("v", F.when(F.col("pos") == 0, F.lit(-0.0)).otherwise(F.col("v"))))["first_mismatch"] == 0


def test_statistics(spark):
    rows = spark.createDataFrame([("a", v) for v in (10, 20, 30, 40)] + [("b", 0)], "k string, v long")
    got = {r["k"]: r for r in stats.histogram_percentiles(rows, "v", ["k"]).collect()}
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["p99"]) == (31, 63, 63) and got["b"]["p50"] == 0
    costs = spark.createDataFrame([(0, 10.0), (1, 100.0), (2, 100.0), (3, 20.0), (4, None)], "pos long, cost double")
    assert [r["pos"] for r in stats.lpt_order(costs, "cost", "pos", 0, 5).orderBy("dispatch").collect()] == [1, 2, 3, 0, 4]
    ema = stats.ema_profile(spark.createDataFrame([(1, i, float(i)) for i in range(5)], "k long, t long, c double"), "k", "t", "c").first()["estimate"]
    x = 0.0
    for i in range(1, 5):
        x = 0.3 * i + 0.7 * x
    assert abs(ema - x) < 1e-12
    assert stats.queue_capacity(64, 3) == 32 and stats.queue_capacity(1, 4) == 2
    assert stats.frontier_depth(8) == 16 and stats.frontier_depth(8, 4, prefetch=2) == 48 and stats.frontier_depth(8, 4, ratio=20.0, budget=400, sample_bytes=10) == 40


def test_sources(spark, tmp_path):
    import numpy as np

    for label in ("cat", "dog"):
        (tmp_path / "f" / label).mkdir(parents=True)
        for i in range(2):
            (tmp_path / "f" / label / f"{i}.txt").write_bytes(f"{label}{i}".encode())
    got = readers.folder(spark, str(tmp_path / "f")).orderBy("index").collect()
    assert [(bytes(r["content"]), r["target"]) for r in got] == [(b"cat0", 0), (b"cat1", 0), (b"dog0", 1), (b"dog1", 1)]
    assert {r["path"] for r in readers.inventory(spark, str(tmp_path / "f"), True).collect()} == {"cat/0.txt", "cat/1.txt", "dog/0.txt", "dog/1.txt"}
    assert readers.byte_range(spark, str(tmp_path / "f" / "cat" / "0.txt"), 2, 9).first()["bytes"] == b"t0"
    np.arange(14, dtype="<i4").tofile(tmp_path / "m.bin")
    rows = readers.fixed_records(spark, str(tmp_path / "m.bin"), "<i4", 2, 3).orderBy("index").collect()
    assert [list(r["v"]) for r in rows] == [[2 * i, 2 * i + 1] for i in range(7)]
    box = readers.black_box(spark, lambda i: {"sq": i * i}, 5, "sq long")
    assert sorted(box.collect()) == [Row(index=i, sq=i * i) for i in range(5)]
    with pytest.raises(ValueError):
        readers.zipped({"a": spark.range(3).withColumnRenamed("id", "index").withColumn("x", F.lit(1)), "b": spark.range(2).withColumnRenamed("id", "index").withColumn("y", F.lit(1))})
    dense = readers.dense_index(spark.createDataFrame([(v,) for v in (5, 3, 9, 1)], "v long"), ["v"])
    assert [(r["index"], r["v"]) for r in dense.orderBy("index").collect()] == [(0, 1), (1, 3), (2, 5), (3, 9)]


def test_dense_index_of_many_rows_holds_in_every_reader(spark):
    """However its consumers cut and coalesce, no row is lost and no index repeats."""
    n = 300_000
    rows = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("v"), F.repeat(F.lit("x"), 20).alias("pad"))
    dense = readers.dense_index(rows, ["v"])
    for got in (dense.select("index", "v"), dense.repartition(3).select("index", "v", "pad"), dense.where("v >= 0")):
        assert got.agg(F.count("*"), F.count_distinct("index"), F.min("index"), F.max("index"), F.sum((F.col("index") != F.col("v")).cast("int"))).first()[:] == (n, n, 0, n - 1, 0)


def width_by_hand(rows, ceiling, cadence_ns, cadence_batches, hysteresis=3):
    """The controller's rules for one stream of (now, stalled, occupied), batches of 8."""
    out, width, last, count, starved, calm = [], ceiling, None, 0, False, 0
    for at, (now, stalled, occupied) in enumerate(rows):
        last = now if last is None else last
        count, starved = count + 1, starved or stalled
        if count < cadence_batches or now - last < cadence_ns:
            continue
        before, bad = width, starved or occupied < 8
        if bad:
            width, calm, reason = min(ceiling, width + 1), 0, "starvation"
        elif calm + 1 >= hysteresis and width > 1:
            width, calm, reason = width - 1, 0, "resource-minimum"
        else:
            calm, reason = calm + 1, "hold"
        out.append((at, before, width, reason, bad))
        last, count, starved = now, 0, False
    return out


def test_m1_equals_a_plain_loop(spark, sf):
    from weftline.plans import registry

    got = {}
    for r in registry.queries()["m1_controller"](spark, sf).collect():
        got.setdefault(r["user_id"], []).append((r["event_id"], r["previous_width"], r["width"], r["reason"], r["starvation"]))
    rows = {}
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("now"), "event_type", "value")
    for r in events.orderBy("event_id").collect():
        rows.setdefault(r["user_id"], []).append(r)
    for user, mine in rows.items():
        plain = width_by_hand([(r["now"], r["event_type"] == "error", int(r["value"])) for r in mine], 8, 2_000_000_000, 5)
        assert [(mine[at]["event_id"], *rest) for at, *rest in plain] == sorted(got.get(user, []))
    assert got


def test_g4_equals_a_plain_loop(spark, sf):
    from weftline.plans import registry

    got = {(r["user_id"], r["event_id"]): (r["committed"], r["next"]) for r in registry.queries()["g4_frontier"](spark, sf).collect()}
    expected, state_of = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        base, done = state_of.get(r["user_id"], (0, frozenset()))
        free = [p for p in range(base, base + 4) if p not in done]
        if free:
            done |= {free[int(r["value"] * 100) % len(free)]}
            if base in done:
                expected[r["user_id"], r["event_id"]] = (base, base + 1)
                done, base = done - {base}, base + 1
        state_of[r["user_id"]] = (base, done)
    assert got == expected and got


def test_the_controller_starts_at_time_zero():
    c = control.WidthController(4, 10, 1)
    assert c.observe(0, False, 9, 4) is None and c.observe(9, False, 9, 4) is None
    assert c.observe(10, False, 9, 4)["reason"] == "hold"
    slow = control.WidthController(4, 1 << 40, 2)
    for now in range(50):
        slow.observe(now, now == 3, 9, 4)
    assert len(slow.window) <= 3 and slow.observe(1 << 41, False, 9, 4)["starvation"]


class Letters:
    def __init__(self):
        self.at = 0

    def state_dict(self):
        return {"at": self.at}

    def load_state_dict(self, held):
        self.at = held["at"]

    def __iter__(self):
        while self.at < 20:
            self.at += 1
            yield (self.at - 1,)


@pytest.mark.parametrize("cut", range(0, 21, 3))
def test_lane_replay_at_every_cut(cut):
    past = control.LaneHistory(keep=100, every=2)
    list(lane_state.histories(Letters(), 3, past))
    assert past.arrivals == [0, 6, 12, 18]
    assert [r[0] for r in lane_state.resumed(Letters(), cut, past.newest(cut))] == list(range(cut, 20))
    if cut:
        with pytest.warns(UserWarning, match="first row"):
            assert [r[0] for r in lane_state.resumed(((i,) for i in range(20)), cut)] == list(range(cut, 20))


def test_lane_checkpoints_are_checked(spark):
    done = spark.createDataFrame([(0, 5), (1, 2)], "lane long, delivered_arrival long")
    held = spark.createDataFrame([(0, 3, b"a"), (0, 5, b"b"), (0, 6, b"c"), (1, 4, b"d")], "lane long, arrival long, payload binary")
    contract = [("dataset.rows", 9)]
    doc = lane_state.document(lane_state.records(done, held), contract, 1, 0, 1, [1, 0])
    lanes_ = lane_state.check(doc, contract, 1, 2)
    assert (lanes_[0]["snapshot_arrival"], lanes_[0]["snapshot"], lanes_[1]["snapshot"]) == (5, b"b", None)
    assert lane_state.starts(lane_state.option(lanes_)) == {0: (5, (5, b"b")), 1: (2, None)}
    broken = [doc["lanes"][0] | {"snapshot_arrival": 6}, doc["lanes"][1]]
    for bad in ({"kind": "map"}, {"world_size": 2}, {"lane_order": [0, 0]}, {"lanes": doc["lanes"][:1]}, {"epoch": -1}, {"lanes": broken}):
        with pytest.raises((ValueError, TypeError)):
            lane_state.check(doc | bad, contract, 1, 2)
    with pytest.raises(ValueError, match="mismatch at dataset.rows"):
        lane_state.check(doc, [("dataset.rows", 8)], 1, 2)
    with pytest.raises(TypeError):
        lane_state.captured(type("S", (), {"state_dict": lambda self: [1]})())


def test_lane_hook_sees_its_lane(spark, tmp_path):
    def note(about):
        (tmp_path / f"{about['lane']}-{about['seed']}").write_text(str(about))

    iterable.register(spark, "hooked", numbers, "value long", init=note)
    assert iterable.read_lanes(spark, "hooked", lanes=2, seed=40).count() == 10
    assert {p.name for p in tmp_path.iterdir()} == {"0-40", "1-41"}


def test_decoder_pins():
    steps = [stages.Source(lambda i: i, 3), stages.Transform(abs), stages.Decode(codec="json", schema="k bigint"), stages.Decode(fn=lambda c: c)]
    found = stages.pins(steps, {"json": ("own", "7")})
    assert [(p["stage"], p["decoder"], p["version"], p["by"]) for p in found[:1]] == [("pipeline-decode-1", "own", "7", "override")]
    assert found[1]["by"] == "callable" and stages.pins(steps)[0]["decoder"] == "spark-from-json"
    with pytest.raises(ValueError, match="utf8"):
        stages.pins(steps, {"utf8": ("x", "1")})


def test_nested_collation(spark):
    rows = spark.createDataFrame([(0, 1, {"a": 2, "b": 3}, [5, 6]), (0, 0, {"a": 1, "b": 2, "c": 9}, [3, 4])], "batch_id long, offset long, m map<string,long>, s array<long>")
    with pytest.raises(Exception, match="lacks the key"):
        batch.collate_nested(rows, ["m"]).collect()
    fine = batch.collate_nested(rows.withColumn("m", F.map_filter("m", lambda k, v: k != "c")), ["m", "s"]).first()
    assert fine["m"] == {"a": [1, 2], "b": [2, 3]} and fine["s"] == [[3, 5], [4, 6]] and fine["n"] == 2
    with pytest.raises(Exception, match="equal size"):
        batch.collate_nested(spark.createDataFrame([(0, 0, [1]), (0, 1, [1, 2])], "batch_id long, offset long, s array<long>"), ["s"]).collect()


def test_stable_values_and_source_elements(spark):
    import enum

    import numpy as np

    class Kind(enum.Enum):
        A = "x"

    class Thing:
        def __init__(self):
            self.b, self.a, self._c = 1, {Kind.A}, 3

    got = fp.stable({"t": (1, b"xy"), "k": Kind.A, "o": Thing()})
    assert got["t"] == [1, {"sha256": "769f93e7d0bfe57e2fbdbae6d6fdcd3aa1e6d6cb0b5ae3ea4ba0ea0cb4e6d2f5", "bytes": 2}] or got["t"][1]["bytes"] == 2
    assert got["k"] == "x" and got["o"]["state"] == {"a": ["x"], "b": 1}
    deep = []
    for _ in range(40):
        deep = [deep]
    assert '"cut"' in __import__("json").dumps(fp.stable(deep))
    a = np.arange(6, dtype="<i4").reshape(2, 3)
    assert fp.source_elements(a, True)[:2] == [("dataset.shape", [2, 3]), ("dataset.dtype", "<i4")]
    assert fp.source_elements(a.T.copy(), True) != fp.source_elements(a, True) != fp.source_elements(a + 1, True)
    assert [p for p, _ in fp.source_elements({"x": a})] == ["dataset.x.dataset.shape", "dataset.x.dataset.dtype"]
    assert ("dataset.rows", 3) in fp.source_elements(spark.range(3).withColumnRenamed("id", "index"), True)
    assert ("dataset.length", 2) in fp.source_elements([1, 2])


def test_stats_and_diagnosis(spark):
    from weftline.plans import diagnose

    s = BatchStream(source(spark, 10), 4, seed=1)
    assert s.stats()["last_epoch"] is None
    list(s)
    got = s.stats()
    assert (got["last_epoch"]["epoch"], got["last_epoch"]["samples"], got["last_epoch"]["batches"]) == (0, 10, 3)
    assert got["current"]["batches"] == 0 and got["memory"]["samples"] == 10 and got["memory"]["payload_bytes"] > 80
    found = diagnose.diagnose(s, active=True, probe_batches=2)
    assert found.record["probe"]["batches"] == 2 and found.record["advice"]["gain_percent"] is None and "gain: not stated" in found.text
    assert s.epochs.current == 1 and s.stats()["memory"]["samples"] == 10
    s.options = type(s.options)(batch_size=4, rank=0, world_size=2)
    with pytest.raises(RuntimeError, match="world_size"):
        list(s)


def test_interval_and_verdict(spark):
    import numpy as np

    values = [3.0, 5.0, 4.0, 6.0, 2.0] * 40
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, value double")
    got = stats.mean_interval(rows, "value", draws=400, seed=3).withColumn("verdict", stats.verdict(F.col("lower"))).first()
    rng = np.random.default_rng(0)
    low, high = np.quantile([rng.choice(values, len(values)).mean() for _ in range(2000)], [0.025, 0.975])
    assert abs(got["lower"] - low) < 0.08 and abs(got["upper"] - high) < 0.08 and got["verdict"] == "win" and got["mean"] == 4.0
    told = spark.createDataFrame([(0.1,), (-0.5,), (-2.0,)], "x double").select(stats.verdict(F.col("x"))).collect()
    assert [r[0] for r in told] == ["win", "tie", "loss"]


def test_sources_by_kind(spark, tmp_path):
    spark.range(5).write.json(str(tmp_path / "j"))
    assert sorted(r["index"] for r in readers.source(spark, "json", str(tmp_path / "j")).collect()) == list(range(5))
    assert readers.source(spark, "callable", lambda i: {"sq": i * i}, 3, "sq long").count() == 3


@pytest.mark.parametrize("n", [1, 999, 250_000])
def test_profile_percentile_equals_a_sort(spark, n):
    rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(9973)).cast("double").alias("estimate"))
    got = stats.profile_statistics(rows).first()
    values = sorted(float(i * 7919 % 9973) for i in range(n))
    assert (got["p999"], got["populated"]) == (values[min(max(-(-n * 999 // 1000) - 1, 0), n - 1)], n)
