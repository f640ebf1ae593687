"""Null and repeated ids, clashing columns and brute-force versions of results that SQL can't give."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from weftline.llm import itq_dedup, license_scan, packing, piece_transducer, queries, simhash_dedup, simhash_similar, suffix_tree_lm, suffix_tree_whole, token_files, toxicity, warc_zstd
from weftline.llm.common import components, shared_dir, vocabulary
from weftline.llm.token_cache import CachedTokenizer

BIG = 9007199254740993  # not a double


def test_licenses_of_rows_that_share_an_id(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-header"]
    rows = [(2, mit), (2, mit), (2, gpl), (None, mit), (None, gpl), (3, None), (4, "no such line")]
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'line'").collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in found) == sorted([("2", "MIT"), ("2", "MIT"), ("2", "GPL-3.0-header"), ("None", "MIT"), ("None", "GPL-3.0-header")])
    assert all(r["dice"] == 1 for r in found)


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "MPL-2.0-header", "AGPL-3.0-header", "MIT-licensed-notice"])
def test_each_template_finds_itself_with_small_changes(spark, name):
    words = license_scan.TEMPLATES[name].split()
    changed = words[:-1] if len(words) < 20 else [w for i, w in enumerate(words) if i % 25]
    text = "Some code.\n\n" + " ".join(changed[: len(changed) // 2]) + "\n" + " ".join(changed[len(changed) // 2 :]) + "\n\nMore code."
    found = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("kind = 'block'").collect()
    if len(words) >= 20:
        assert [r["license"] for r in found] == [name]
    whole = spark.createDataFrame([(1, license_scan.TEMPLATES[name])], "doc_id long, text string")
    assert [r["license"] for r in license_scan.license_scan(whole).collect()] == [name]


def test_pages_without_an_id_and_a_hot_payload(spark):
    hot = "h" * 1500
    rows = [(i, "u", hot) for i in range(40)] + [(None, "u", hot), (None, "u", "short"), (7, "u", hot), (50, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc_zstd.warc_round_trip(pages, train_records=4).collect()
    assert len(got) == len(rows) and Counter(r["record_type"] for r in got) == {"revisit": 40, "response": 4}
    assert all(r["refers_to"] == (39 if r["record_type"] == "revisit" else None) for r in got)
    alone = spark.createDataFrame([(None, "u", hot)], "page_id long, url string, html string")
    assert [(r["page_id"], r["record_type"]) for r in warc_zstd.warc_round_trip(alone).collect()] == [(None, "response")]


def test_ids_survive_beside_null_ones(spark):
    rows = [(BIG, "one two"), (None, "three"), (None, None), (BIG, "four"), (-BIG, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter([BIG, None, None, BIG, -BIG])
    assert Counter(r["doc_id"] for r in packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()) == expected
    assert Counter(r["doc_id"] for r in token_files.id_round_trip(docs, vocabulary("byte_bpe_50k.json")).collect()) == expected
    assert Counter(r["doc_id"] for r in piece_transducer.encode_documents(docs, vocabulary("piece_bpe_32k.model")).collect()) == expected


def test_one_id_for_all_rows_is_spread_over_groups(spark):
    docs = spark.range(3000).selectExpr("5L as doc_id", "concat('word ', id) as text")
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), group_pieces=300).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) == 10 and len(rows) == 3000


def test_null_ids_in_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "x"), (3, text, "x"), (1, text, "y"), (None, "alone here", "z")], "doc_id long, text string, _gone string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_dedup.simhash_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 1), (3, 1), (1, 1), (None, None)], key=str)
    for keep in (simhash_dedup.keep_first, simhash_similar.keep_first_similar):
        kept = keep(docs)
        assert kept.columns == docs.columns and sorted((str(r["doc_id"]), r["_gone"]) for r in kept.collect()) == [("1", "y"), ("None", "x"), ("None", "z")]


def test_two_hundred_pairs_in_a_crowd_of_one_vocabulary(spark):
    """Texts that share all their words in another order; each has one near copy."""
    pick = random.Random(21)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for _ in range(200):
        order = list(base)
        pick.shuffle(order)
        other = list(order)
        other[pick.randrange(150)] = "changed"
        texts += [" ".join(order), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_classes(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(400)}


def test_components_with_hubs_equal_brute_force(spark):
    pick = random.Random(5)
    edges = [(0, i) for i in range(1, 2500)] + [(9000, i) for i in range(5000, 7500)] + [(pick.randrange(10_000, 11_000), pick.randrange(10_000, 11_000)) for _ in range(900)] + [(2400, 9000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_vectors_in_doubles(spark):
    rows = [(1, 0, [1e-200, 2e-200]), (2, 0, [1e-200, 2.0001e-200]), (3, 0, [1e300, 0.0]), (4, 0, [1e300, 0.0]), (5, 0, [0.0, 1.0]), (6, 1, [1e-200, 2e-200]), (7, 0, [float("nan"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq_dedup.itq_near_dedup(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


@pytest.mark.parametrize("tables,flips,least", [(4, 1, 0.99), (3, 2, 0.99), (2, 3, 0.97)])
def test_recall_of_each_layout_on_planted_pairs(spark, monkeypatch, tables, flips, least):
    """Pairs of cosine 0.98 to 0.99 among random vectors of one label."""
    monkeypatch.setattr(itq_dedup, "layout", lambda codes, bits: (tables, flips))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine = rng.uniform(0.9805, 0.99, 300)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * away
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r["vec_id"]: r["n_links"] for r in itq_dedup.itq_near_dedup(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert sum(got[i] == 1 == got[300 + i] for i in range(300)) >= least * 300 - 3


@pytest.mark.parametrize("tables, flips", itq_dedup.LAYOUTS[:2])
def test_probes_are_not_broadcast(spark, tmp_path, tables, flips):
    """A few thousand codes make a small file but, with flips, a table that must not pass through the driver."""
    spark.range(3000).selectExpr("1 label", "64 dim", "xxhash64(id) code").write.parquet(str(tmp_path / "codes"))
    met = itq_dedup.code_pairs(spark.read.parquet(str(tmp_path / "codes")), 64, 16, tables, flips)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_layout_follows_the_number_of_codes():
    assert [itq_dedup.layout(n, 64) for n in (10, 10**5, 10**7, 10**9)] == [(4, 1), (4, 1), (3, 2), (2, 3)]


def plain_tree_scores(texts, held, min_context, min_next, min_joint, max_order=3):
    """Suffix tree training and scoring with dicts over word tuples."""
    tokens = [[*(t or "").lower().split(), "<end>"] for t in texts]
    train = [x for x, h in zip(tokens, held, strict=True) if not h]
    count = Counter(w for x in train for w in x)
    n, kinds = sum(count.values()), len(count)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
    frequent = {s: {w for w, c in count.items() if c >= max(s * n, 1)} | {"<end>"} for s in (min_context, min_next)}

    def root(w):
        return (count[w] - d) / n if count[w] else d * kinds / n

    states = {}  # context -> (explicit, factor of leaving it)

    def parent(context):
        context = context[1:]
        while context and context not in states:
            context = context[1:]
        return context

    def prob(context, w):
        factor = 1.0
        while context:
            explicit, leave = states[context]
            if w in explicit:
                return factor * explicit[w]
            factor, context = factor * leave, parent(context)
        return factor * root(w)

    candidates, below = {(w,): count[w] for w in frequent[min_context]}, None
    everything = []
    for order in range(1, max_order + 1):
        if not candidates:
            break
        follows = defaultdict(Counter)
        for x in train:
            whole = ["<end>", *x]
            for i in range(1, len(whole)):
                context = tuple(whole[max(i - order, 0) : i])
                if len(context) == order and context in candidates and whole[i] in frequent[min_next]:
                    follows[context][whole[i]] += 1
        follows = {c: {w: k for w, k in f.items() if k >= max(min_joint * n, 2)} for c, f in follows.items()}
        everything.append((candidates, follows))
        nxt = {(*c, w): k for c, f in follows.items() for w, k in f.items() if k >= max(min_context * n, 2) and w in frequent[min_context] and w != "<end>" and (*c, w)[1:] in candidates}
        candidates = nxt
    for level, follows in everything:
        for c, occurs in level.items():
            found = follows.get(c, {})
            if not found:
                continue
            p = {w: (k - 0.5) / occurs for w, k in found.items()}
            q = {w: prob(parent(c), w) for w in found}
            rest, free = 1 - sum(p.values()), 1 - sum(q.values())
            if rest > 1e-9 and free > 1e-9 and occurs * (sum(p[w] * math.log(p[w] / q[w]) for w in p) + rest * math.log(rest / free)) > len(p) + math.log(n):
                states[c] = (p, rest / free)
    known = set().union(*(level for level, _ in everything)) if everything else set()
    out = []
    for x in tokens:
        whole, total = ["<end>", *x], 0.0
        for i in range(1, len(whole)):
            # The longest candidate whose own suffixes are candidates too, then its longest state.
            context = ()
            for k in range(1, min(i, max_order) + 1):
                if tuple(whole[i - k : i]) in known:
                    context = tuple(whole[i - k : i])
            while context and context not in states:
                context = context[1:]
            total += math.log10(prob(context, whole[i]))
        out.append(total)
    return out, states


def test_tree_scores_equal_plain_code(spark):
    pick = random.Random(31)
    habit = {w: [pick.choice("abcdefgh") for _ in range(2)] for w in itertools.product("abcdefgh", repeat=2)}
    texts = []
    for _ in range(150):
        words = [pick.choice("abcdefgh"), pick.choice("abcdefgh")]
        for _ in range(pick.randint(0, 60)):
            words.append(pick.choice(habit[words[-2], words[-1]]) if pick.random() < 0.8 else pick.choice(["a", "b", f"rare{pick.randrange(60)}"]))
            words = words if words[-1] in "abcdefgh" else [*words, pick.choice("abcdefgh"), pick.choice("abcdefgh")]
        texts.append(" ".join(words).upper() if pick.random() < 0.3 else " ".join(words))
    texts += ["", None, "never seen", texts[0]]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    shares = dict(min_context=0.004, min_next=0.002, min_joint=0.001)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(docs, suffix_tree_lm.every_fifth(), **shares, common=0.002).collect()}
    expected, states = plain_tree_scores(texts, held, **shares)
    assert {1, 2} <= {len(c) for c in states}
    assert all(abs(got[i] - e) < 1e-6 * max(1, abs(e)) for i, e in enumerate(expected))
    flat, _ = plain_tree_scores(texts, held, **shares, max_order=0)
    assert sum(e for e, h in zip(expected, held, strict=True) if h) > sum(f for f, h in zip(flat, held, strict=True) if h) + 20


def test_the_query_scores_by_the_whole_tree(spark, tmp_path):
    """Contexts far below any share of the corpus are states too."""
    pick = random.Random(33)
    common = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    phrases = [[f"rare{i}", "odd", "strange", f"seldom{i}"] for i in range(12)]
    pairs = [[f"lone{i}", f"pair{i}"] for i in range(30)]
    texts = []
    for _ in range(400):
        words = [pick.choice(common) for _ in range(250)]
        for some, share in ((phrases, 1), (pairs, 0.4)):
            if pick.random() < share:
                words += [*pick.choice(some), *(pick.choice(common) for _ in range(5))]
        texts.append(" ".join(words))
    texts += ["", None, "never seen", " ".join(phrases[0])]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op8_suffix_tree_scores(spark, str(tmp_path)).collect()}
    expected, states = plain_tree_scores(texts, held, min_context=0, min_next=0, min_joint=0)
    assert {1, 3} <= {len(c) for c in states}
    assert all(abs(got[i] - e) < 1e-6 * max(1, abs(e)) for i, e in enumerate(expected))


def test_the_whole_tree_in_many_buckets_with_hot_contexts(spark):
    pick = random.Random(35)
    habit = {w: pick.choices("abcdefgh", k=2) for w in itertools.product("abcdefgh", repeat=3)}
    line = "the very common line of all texts".split()
    texts = []
    for _ in range(300):
        words = pick.choices("abcdefgh", k=3)
        for _ in range(pick.randint(0, 60)):
            chance = pick.random()
            words += [pick.choice(habit[tuple(words[-3:])])] if chance < 0.8 else ["a", "b", "a"] if chance < 0.95 else [f"rare{pick.randrange(300)}", *"bcd"]
        texts.append(" ".join([*line, *words] if pick.random() < 0.6 else words))
    texts += ["", None, "never seen", texts[0], " ".join(["a"] * 500)]
    ids = [None if i == 7 else i for i in range(len(texts))]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    expected, states = plain_tree_scores(texts, held, min_context=0, min_next=0, min_joint=0)
    assert {1, 2, 3} <= {len(c) for c in states}
    for options in (dict(bucket=800), dict(bucket=800, common=0.01), dict(bucket=3000, common=0.001)):
        # From 200 tokens on, words and pairs are hot; each is split among many buckets.
        got = {r["doc_id"]: r for r in suffix_tree_whole.whole_score(docs, suffix_tree_lm.every_fifth(), **options).collect()}
        assert len(got) == len(texts)
        for i, e in zip(ids, expected, strict=True):
            assert abs(got[i]["score"] - e) < 1e-6 * max(1, abs(e))
    plain = {r["doc_id"]: r for r in suffix_tree_lm.score(docs, suffix_tree_lm.every_fifth()).collect()}
    for i, r in got.items():
        assert all(r[x] == plain[i][x] for x in ("held_out", "n_tokens", "n_known", "train_tokens"))
        assert abs(r["base_score"] - plain[i]["base_score"]) < 1e-9 * max(1, abs(r["base_score"]))
    nothing = suffix_tree_whole.whole_score(docs, F.lit(True)).collect()
    assert len(nothing) == len(texts) and {r["score"] for r in nothing} == {0.0}
    assert suffix_tree_whole.whole_score(docs.limit(0), F.lit(False)).count() == 0


def test_words_that_the_cache_lacks_are_encoded_together():
    """One call for a slice's unknown words; what is held, how it is bounded and the ids stay the same."""
    tokens = CachedTokenizer(vocabulary("byte_bpe_50k.json"), entries=40)
    whole, asked, made = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), [], tokens.make_all
    tokens.make_all = lambda parts: asked.append(parts) or made(parts)
    pick = random.Random(37)
    words = ["".join(pick.choice("etaoinshr") for _ in range(pick.randint(1, 9))) for _ in range(300)] + ["é", "日本", "x" * 70, "12", "don't", ""]
    for _ in range(6):
        text = " ".join(pick.choices(words, k=25))
        assert [x.tolist() for x in tokens.encode_all(pa.array([text, text]))] == [whole.encode(text).ids] * 2
        assert len(tokens.parts) <= 40 and not any(len(x) > 64 for x in tokens.parts)
    assert len(asked) == 6 and all(len(set(x)) == len(x) > 1 for x in asked)
    assert tokens.parts.older


def test_arcs_out_of_a_state_are_those_of_finite_weight():
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        machine = piece_transducer.Transducer(piece_transducer.PieceModel(f.read()))
    text, most = "▁thermodynamics日é", max(map(len, machine.ids))
    for state in (piece_transducer.START, "▁the", "m", "日"):
        zeros = {}
        for at in range(len(text)):
            pieces = [text[at:end] for end in range(at + 1, min(len(text), at + most) + 1) if text[at:end] in machine.ids or end == at + 1]
            finite = [x for x in pieces if not machine.zero(state, x)]
            got = machine.arcs(text, at, state, zeros)
            assert [(end, x) for end, x, _ in got] == [(at + len(x), x) for x in finite]
            assert all(cost == (-machine.score[x] if x in machine.ids else machine.unknown_cost) for _, x, cost in got)


def test_the_order_of_hashes_is_stable_also_where_high_bits_are_alike():
    pick = np.random.default_rng(5)
    for keys in (pick.integers(0, 1 << 63, 3000).astype(np.uint64), pick.integers(0, 50, 3000).astype(np.uint64), np.repeat(np.uint64(1 << 63), 5), np.zeros(0, np.uint64)):
        found, one, back = suffix_tree_whole.different(keys)
        expected = np.unique(keys, return_index=True, return_inverse=True)
        assert all((x == y).all() for x, y in zip((found, one, back), expected, strict=True))
        table, asked = found[::2], np.sort(keys)
        hit, at = suffix_tree_whole.found_at(table, asked)
        assert (hit == np.isin(asked, table)).all() and (table[at[hit]] == asked[hit]).all()


def test_the_whole_tree_is_within_four_times_the_input(spark, tmp_path):
    """What op 8 shuffles and the tables that it leaves, together."""

    def shuffled():
        none = spark._jvm.java.util.ArrayList()
        stages = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    def written():
        folder = Path(shared_dir(spark).removeprefix("file://")) / "weftline"
        return {p: p.stat().st_size for p in folder.rglob("*.parquet")}

    source = Path("/root/testdata/sf0.01/documents.parquet")
    size = sum(p.stat().st_size for p in ([source] if source.is_file() else source.glob("*.parquet")))
    before, files = shuffled(), written()
    assert queries.op8_suffix_tree_scores(spark, "/root/testdata/sf0.01").where("score is not null").count() > 0
    moved = sum(n for stage, n in shuffled().items() if stage not in before)
    kept = sum(n for path, n in written().items() if path not in files)
    assert 0 < moved + kept < 4 * size


def test_toxicity_scores_equal_plain_sums(spark):
    pick = random.Random(9)
    plain, bad = "the of and to in is it was".split(), ["idiot", "moron", "scum"]
    rows = [(i, " ".join(pick.choice(plain) for _ in range(30)) + " " + " ".join(pick.choices(bad, k=i % 4 if i % 3 == 0 else 0))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and i % 4 > 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.toxicity(docs, labels).join(docs, "doc_id").collect():
        score = sum(model.weights.get(f, 0.0) for w in toxicity.text_words(r["text"]) for f in toxicity.word_features(w))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]  # P(grade > k)
        assert abs(r["severity"] - sum(above)) < 1e-9 and abs(r["toxic_prob"] - above[0]) < 1e-9
        assert list(model.thresholds) == sorted(model.thresholds) and r["rejected"] == (above[0] >= 0.5)


def model_variants():
    for kind, squeeze, dummy, fallback, mapped, own in [(2, True, True, True, True, False), (2, False, True, False, True, True), (2, True, False, False, False, False), (1, True, True, True, True, False), (1, False, False, False, False, True), (2, False, False, True, False, True)]:
        yield pytest.param(kind, squeeze, dummy, fallback, mapped, own, id=f"{kind}{squeeze:d}{dummy:d}{fallback:d}{mapped:d}{own:d}")


@pytest.mark.parametrize("kind,squeeze,dummy,fallback,mapped,own", model_variants())
def test_other_piece_models_equal_the_library(kind, squeeze, dummy, fallback, mapped, own):
    """Both kinds, with a character map, without byte pieces, with user-defined pieces."""
    m = pb.ModelProto.FromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, dummy
    if mapped:
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        m.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(rule).normalizer_spec.precompiled_charsmap
    pick, kept, seen = random.Random(8), [], {"h▁t", "qzq"} if own else set()
    for p in m.pieces:
        if p.piece in seen or (p.type == 6 and not fallback):
            continue
        if kind == 1 and p.type == 1:
            p.score = -pick.uniform(3, 15)
        kept.append(pb.ModelProto.SentencePiece.FromString(p.SerializeToString()))
    kept += [pb.ModelProto.SentencePiece(piece=x, type=4) for x in sorted(seen)]
    del m.pieces[:]
    m.pieces.extend(kept)
    raw = m.SerializeToString()
    mine, library = piece_transducer.Encoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(pick.choice("aabethin  \n.,▁éß☃日01Ａ①　½hqz") for _ in range(pick.randint(0, 30))) for _ in range(300)]
    wrong = [t for t in texts if mine.encode(t)[0] != library.encode(t)]
    if kind == 1:  # paths of equal weight may differ

        def weight(t):
            m_ = mine.machine  # neighbouring unspelt characters come as one piece
            return sum(-m_.score[x] if x in m_.score else len(x) * m_.unknown_cost for x in library.encode(t, out_type=str) if not x.startswith("<0x"))

        unspelt = [t for t in wrong if any(x.startswith("<0x") for x in library.encode(t, out_type=str))]
        wrong = [t for t in wrong if t not in unspelt and abs(mine.encode(t)[1] - weight(t)) > 1e-3]
    assert wrong == [] and [t for t in texts if mine.decode(library.encode(t)) != library.decode(library.encode(t))] == []


def test_the_query_takes_shortest_paths(spark, monkeypatch):
    calls = []
    plain = piece_transducer.Transducer.shortest_path
    monkeypatch.setattr(piece_transducer.Transducer, "shortest_path", lambda self, text: calls.append(text) or plain(self, text))
    use = piece_transducer.Encoder(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    columns = list(use.digests(pa.array(["unseen words here", "", "and  more\nlines"])))[0]
    assert calls and [int(x) for x in columns[0]] == [len(use.encode(t)[0]) for t in ("unseen words here", "", "and  more\nlines")]


def rows_of_joins(spark, after=-1):
    """Rows that joins made in executions after this one, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, found = 0, store.executionsList()
    ids = [e for e in (found.apply(i).executionId() for i in range(found.size())) if e > after]
    for e in ids:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            told = [values.get(m.accumulatorId()) for m in metrics if "Join" in node.name() and m.name() == "number of output rows"]
            rows += sum(int(x.get().replace(",", "")) for x in told if x.isDefined())
    return rows, max([after, *ids])


def test_rows_joined_for_the_tree_grow_with_the_input_as_contexts_become_hot(spark):
    pick = random.Random(39)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join([*pick.choices(words, k=60), f"rare{pick.randrange(200)}", f"rare{pick.randrange(200)}"]) for _ in range(750)]
    _, last = rows_of_joins(spark)
    made = []
    for n in (150, 750):  # 120 and 600 times each word: one is below 250, the other is not
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string").repartition(2)
        got = {r["doc_id"]: r["score"] for r in suffix_tree_whole.whole_score(docs, suffix_tree_lm.every_fifth(), bucket=1000, common=0.001).collect()}
        assert len(got) == n
        rows, last = rows_of_joins(spark, last)
        made.append(rows)
    assert 0 < made[1] <= 6 * made[0]


def test_sequences_of_hot_words_in_a_row_are_counted(spark):
    pick = np.random.default_rng(41)
    codes = pick.integers(1, 9, 4000).astype(np.uint32)
    hot = np.isin(np.arange(6), [2, 3, 4])  # 5 and up are rare; 1 ends a text
    for length, (keys, n) in enumerate(suffix_tree_whole.hot_runs(codes, hot, 4), 2):
        rows = [tuple(codes[i : i + length].tolist()) for i in range(len(codes) - length + 1)]
        expected = Counter(r for r in rows if {*r} <= {2, 3, 4})
        some = list(expected)
        hashes = suffix_tree_whole.sequence([np.array([r[length - 1 - k] for r in some]) for k in range(length)], length - 1)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(zip(hashes.tolist(), expected.values(), strict=True))
    assert all(not len(keys) for keys, _ in suffix_tree_whole.hot_runs(codes[:0], hot, 3))


def test_hot_contexts_of_any_length_are_counted_in_blocks(spark):
    """Four words of context: of one to three words, contexts are hot."""
    pick = random.Random(43)
    habit = {w: pick.choices("abcd", k=2) for w in itertools.product("abcd", repeat=3)}
    texts = []
    for _ in range(250):
        words = pick.choices("abcd", k=3)
        for _ in range(pick.randint(0, 50)):
            words += [pick.choice(habit[tuple(words[-3:])])] if pick.random() < 0.85 else [f"rare{pick.randrange(40)}", *pick.choices("abcd", k=3)]
        texts.append(" ".join(words))
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for order in (1, 2, 4):
        expected, _ = plain_tree_scores(texts, held, min_context=0, min_next=0, min_joint=0, max_order=order)
        got = {r["doc_id"]: r["score"] for r in suffix_tree_whole.whole_score(docs, suffix_tree_lm.every_fifth(), max_order=order, bucket=400).collect()}
        assert len(got) == len(texts) and all(abs(got[i] - e) < 1e-6 * max(1, abs(e)) for i, e in enumerate(expected))


def test_blocks_come_back_as_they_were():
    pick = np.random.default_rng(45)
    arrays = [pick.integers(0, 200, 1000).astype(t) for t in (np.uint8, np.uint16, np.uint32, np.int64, np.uint64)] + [pick.random(7), np.zeros(0, np.int64)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, suffix_tree_whole.unpacked(suffix_tree_whole.packed(*arrays)), strict=True))
    for top, kind in ((0, np.uint8), (255, np.uint8), (256, np.uint16), (1 << 16, np.uint32), (1 << 32, np.uint64)):
        assert suffix_tree_whole.smallest(np.array([0, top])).dtype == kind
    assert len(suffix_tree_whole.smallest(np.zeros(0, np.int64))) == 0
