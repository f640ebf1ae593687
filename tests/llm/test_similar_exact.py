import random

import pytest

import corpus_pipeline
from tests.llm.test_pipeline import jaccard, words
from weftline.llm import simhash_similar


def brute_classes(texts, similarity=0.8):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = root(i), root(j)
            if a != b and jaccard(texts[i], texts[j]) >= similarity:
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def classes(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_classes(docs, **options).collect()}


@pytest.mark.parametrize("kind", ["appended", "replaced", "short words", "few words"])
def test_classes_at_the_bound_equal_brute_force(spark, kind):
    """Pairs of similarity about 0.8 whose words differ in one passage."""
    pick = random.Random(kind)
    texts = []
    for _ in range(60):
        n = pick.choice([60, 150, 600]) if kind != "few words" else pick.randint(1, 30)
        base = words(pick, n)
        if kind == "short words":
            base = [w if pick.random() < 0.1 else w[:3] for w in base]
        if kind in ("appended", "few words"):
            other = base + words(pick, max(1, int(n * pick.choice([0.15, 0.2, 0.23, 0.26]))))
        else:
            k, at = int(n * pick.choice([0.06, 0.08, 0.09, 0.11])), pick.randrange(n // 2)
            other = base[:at] + words(pick, k) + base[at + k :]
        texts += [" ".join(base), " ".join(other)]
    expected = brute_classes(texts)
    assert 0 < sum(i != c for i, c in expected.items()) < 60
    assert classes(spark, texts) == expected


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_a_crowd_below_the_bound_is_split_exactly(spark, monkeypatch, block_rows):
    """One template with a passage replaced at one of 12 places: only pages of one place link."""
    monkeypatch.setattr(simhash_similar.crowd_pairs, "__defaults__", (block_rows,))
    pick = random.Random(13)
    base = words(pick, 200)
    texts = []
    for i in range(240):
        at = 10 + 15 * (pick.randrange(12))
        texts.append(" ".join(base[:at] + words(pick, 15) + base[at + 15 :]))
    expected = brute_classes(texts)
    assert len(set(expected.values())) == 12
    assert classes(spark, texts) == expected


def test_the_stage_links_fingerprints_within_two_bits(spark):
    """Texts whose SimHash fingerprints differ in two bits or fewer though their similarity is below
    0.8, found by comparing all, are one class of the pipeline's stage."""
    pick = random.Random(12)
    base = " ".join(words(pick, 10))
    texts = [f"{base} {w}" for w in words(pick, 120)]  # 6 of 8 shingles are shared
    texts += [" ".join(words(pick, 80)) for _ in range(10)]
    prints = [simhash_similar.fingerprint(simhash_similar.shingle_hashes(t.encode().lower().split(), 5)) for t in texts]
    expected = brute_classes(texts)
    apart = {(i, j) for i in range(len(texts)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2}
    for i, j in sorted(apart):
        a, b = expected[i], expected[j]
        expected = {k: min(a, b) if c in (a, b) else c for k, c in expected.items()}
    assert any(jaccard(texts[i], texts[j]) < 0.8 for i, j in apart) and 1 < len(set(expected.values())) < 125
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(expected.values())
    assert classes(spark, texts, max_distance=2) == expected
