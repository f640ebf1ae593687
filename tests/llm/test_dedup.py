import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import itq_dedup, simhash_dedup
from weftline.llm.common import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(spark):
    pick = random.Random(3)
    edges = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = union_find({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, k=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "one", "One  two", "a b c", "A\tB\nc", "a b c d e f", "ä Ä x\x0by z", "x" * 100_000, "w " * 40_000, "日本 語 テ スト", "a b c"]


def test_fingerprint_equals_plain_code(spark):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fp long, component_id string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.simhash_dedup(docs).collect()}
    assert got == {i: f"{plain_fingerprint(t or ''):016x}" for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == "0" * 16


@pytest.mark.parametrize("limit", [2, 32])
def test_links_connect_all_close_pairs(spark, limit):
    """Random fingerprints, dense clusters and chains; ``limit`` 2 sends cells to the flip posts."""
    pick = random.Random(5)
    values = set()
    for _ in range(25):
        at = pick.getrandbits(64)
        for _ in range(12):
            values.add(at)
            at ^= 1 << pick.randrange(64)
            if pick.random() < 0.5:
                at ^= 1 << pick.randrange(64)
    centre = pick.getrandbits(64)
    values |= {centre ^ (1 << b) for b in range(64)} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(a)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long"), cell_limit=limit).collect()

    def close(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count() <= 2

    assert all(close(r["u"], r["v"]) for r in found)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if close(a, b)]
    assert union_find(values, [(r["u"], r["v"]) for r in found]) == union_find(values, near)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_dedup(docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in docs.collect()}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = union_find(ids, edges)
    assert {i: (f"{fps[i]:016x}", expected[i]) for i in ids} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}
    kept = simhash_dedup.keep_first(docs, shingle_words=3)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.simhash_dedup(docs).count() == 0
    assert itq_dedup.itq_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def vectors(seed=1, n=240, dim=24):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for c in range(30):
        centre = rng.normal(size=dim)
        for _ in range(n // 30):
            rows.append((at, (centre + rng.normal(size=dim) * rng.choice([0.01, 0.08, 0.14])).astype(np.float32).tolist(), c % 3))
            at += 1
    rows += [(at + i, rows[5][1], rows[5][2]) for i in range(7)]  # copies
    at += 7
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(at + i, v, 0) for i, v in enumerate(odd)] + [(at + 6, rows[5][1], None), (at + 7, [1.0, 2.0], 0), (at + 8, [2.0, 4.0], 0)]
    return rows


def brute_links(rows, threshold=0.98):
    def unit(v):
        x = np.array([float("nan") if a is None else a for a in v or []], float)
        return x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None

    units = {i: unit(v) for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    edges = [
        (a, b) for a, _, _ in rows for b, _, _ in rows
        if b < a and label[a] is not None and label[a] == label[b] and units[a] is not None and units[b] is not None
        and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    ]
    return edges


@pytest.mark.parametrize("block_rows", [3, 256])
def test_vector_links_equal_brute_force(spark, block_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, head double, copies string")
    got = {r["vec_id"]: r for r in itq_dedup.itq_near_dedup(df, block_rows=block_rows).collect()}
    edges = brute_links(rows)
    expected = union_find([r[0] for r in rows], edges)
    counts = {i: sum(i in e for e in edges) for i in expected}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (counts[i], c, i == c) for i, c in expected.items()}


def test_vector_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = itq_dedup.itq_near_dedup(df).agg(F.sum("n_links")).first()[0]
    edges = brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert got <= 2 * len(edges) and got >= 0.99 * 2 * len(edges)


def test_itq_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    mean, projection = itq_dedup.fit_itq(x, 16)
    share = (((x - mean) @ projection) > 0).mean(0)
    assert (abs(share - 0.5) < 0.1).all()
