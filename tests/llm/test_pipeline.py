import random

import corpus_pipeline
from weftline.llm import simhash_similar


def words(pick, n):
    return ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 9))) for _ in range(n)]


def jaccard(a, b, k=5):
    a, b = ({tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} for x in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similar_classes_find_every_pair_of_the_similarity(spark):
    pick = random.Random(11)
    texts = []
    for _ in range(40):
        base = words(pick, pick.randint(60, 400))
        texts.append(" ".join(base))
        for share in (0.004, 0.012, 0.02, 0.06, 0.2):
            some = list(base)
            for _ in range(max(1, int(len(base) * share))):
                some[pick.randrange(len(some))] = "changed"
            texts.append(" ".join(some))
    texts += [texts[0]] * 50 + ["", None, "a b", "A  b", "x" * 50_000]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, bits int")
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_classes(docs).collect()}
    plain = [t or "" for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    close = [(i, j) for i in range(240) for j in range(i // 6 * 6, i) if jaccard(plain[i], plain[j]) >= 0.8]
    for i, j in close + [(i, 0) for i in range(240, 290)] + [(291, 290), (293, 292)]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    assert sum(got[i] == got[j] for i, j in close) >= 0.99 * len(close)
    assert all(root(i) == root(got[i]) for i in got)
    kept = simhash_similar.keep_first_similar(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())
    assert simhash_similar.similar_classes(docs.limit(0)).count() == 0


def test_a_dense_group_becomes_one_class(spark):
    pick = random.Random(12)
    base = words(pick, 300)
    texts = []
    for _ in range(300):
        some = list(base)
        some[pick.randrange(300)] = "".join(pick.choice("klmnop") for _ in range(8))
        texts.append(" ".join(some))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash_similar.similar_classes(docs).collect()} == {0}


def test_stages_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept and kept <= before
        before = kept
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == before
    for d in before:
        parts = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        assert sum(p[1] for p in parts) == parts[0][2] and parts[0][0] == 0


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
