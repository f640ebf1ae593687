import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import check
from weftline.llm import host_quality, id_codec, license_scan, packing, piece_transducer, queries, suffix_tree_lm, token_files, toxicity, warc_zstd
from weftline.llm.common import vocabulary
from weftline.llm.token_cache import CachedTokenizer

ODD = ["", None, "one", "  lead", "a  b   c", "tab\tb\r\nc\x0bd", "é É ß ẞ İ", "日本語 テスト🙂", "<|endoftext|> <s> </s>", "a" * 30_000, "don't it's 'S 12 345 ½", "x, y. z.,", "\x1c a\x1cb", "\n\n \n", "K Å ́a", "w " * 3000]


def documents(spark, texts=ODD):
    """Odd texts with repeated ids and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i % 3, 7, "k") for i, t in enumerate(texts)] + [(2, "one", "x", 1, 7, "k"), (2, "one", None, 1, 7, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, fp long, sequence_id string")


def empty(spark):
    return documents(spark).limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    check(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_tokenizer_equals_library(spark, sf, file):
    whole = Tokenizer.from_file(vocabulary(file))
    pick = random.Random(1)
    fuzz = ["".join(pick.choice("ab c\n\t '.,é1日 ") for _ in range(pick.randint(0, 40))) for _ in range(500)]
    atoms = "a,Bc, ,  ,\n,\n\n, \n,\t,\r\n,'s,İ!,É.,é,word.,x.y,12,<|endoftext|>,...,\u3000,日本,<,>,\u0338,e\u0301!,\x0b,\x1f,|>,   ".split(",")
    fuzz += ["".join(pick.choice(atoms) for _ in range(pick.randint(0, 14))) for _ in range(1500)]
    texts = [t or "" for t in ODD] + fuzz + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for entries in (10, 100_000):
        tokens = CachedTokenizer(vocabulary(file), entries=entries)
        assert [t for t in texts if np.frombuffer(tokens.encode(t), tokens.dtype).tolist() != whole.encode(t, add_special_tokens=False).ids] == []


def test_first_fit_decreasing_equals_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 200):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, placed = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(100)
            placed[i] = (b, 100 - room[b])
            room[b] -= lengths[i]
        assert [placed[i] for i in range(n)] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def test_packing_covers_every_id_once(spark):
    docs = documents(spark)
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), room=64, group_pieces=50).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for i, t in enumerate(ODD):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        copies = 3 if i == 2 else 1
        expected = sorted((s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)) * copies
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i]) == sorted(expected)
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_plain_code(spark):
    pick = random.Random(2)
    texts = ODD + [" ".join(pick.choice("abc#") for _ in range(pick.randint(0, 80))) for _ in range(40)] + ["l\nl\n l\n\nl", "a b c a b c a", "a a a a"]
    got = host_quality.host_quality(documents(spark, texts)).collect()
    assert {(r["doc_id"], *(r[c] for c in host_quality.COUNTS)) for r in got} == {(i, *plain_quality(t)) for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2 and all(r["kept"] is not None for r in got)
    assert host_quality.host_quality(empty(spark)).count() == 0 and host_quality.quality_filter(empty(spark)).count() == 0


def test_bad_hosts_go_and_clean_hosts_stay(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "clean") for i in range(60)] + [(100 + i, good if i < 5 else "junk " * 90, "bad") for i in range(60)] + [(300, good, "new"), (301, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_quality.host_quality(docs).where("kept").collect()}
    assert kept == {*range(60), 300, 301}
    assert {r["doc_id"] for r in host_quality.quality_filter(docs).collect()} == kept


CODED = [[], [5], [0] * 3000, [*range(700), *[65535] * 300, *[1, 2] * 100], [7] * 5000, [*range(65536), *range(65536)]]


@pytest.mark.parametrize("ids", CODED, ids=range(len(CODED)))
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint16)
    assert np.array_equal(id_codec.decode_block(id_codec.encode_block(ids), len(ids)), ids)


def test_coder_round_trip_of_random_ids_and_gain():
    rng = np.random.default_rng(4)
    for n in (1, 511, 513, 5000, 200_000):
        noise = rng.integers(0, 65536, n).astype(np.uint16)
        skewed = (rng.integers(0, 300, n) ** 2 // 2).astype(np.uint16)
        for ids in (noise, skewed):
            assert np.array_equal(id_codec.decode_block(id_codec.encode_block(ids), n), ids)
    text = np.tile(rng.integers(0, 500, 5000), 20).astype(np.uint16)
    assert len(id_codec.encode_block(text)) < 0.8 * len(text)  # half of its raw size is len(text)
    assert len(id_codec.encode_block(skewed)) * 8 < 9 * n


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark).where("doc_id is not null")
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = token_files.id_round_trip(docs, vocabulary("byte_bpe_50k.json"), block_ids=64, text_bytes=4000).orderBy("start").collect()
    start, expected = 0, []
    for i, t in enumerate(ODD):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for _ in range(3 if i == 2 else 1):
            expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert [tuple(r) for r in rows] == expected
    assert token_files.id_round_trip(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("place,why", [("magic", "not a token-id file"), ("lanes", "other lanes"), ("ids", "checksum")])
def test_damaged_token_file_is_rejected(spark, tmp_path, place, why):
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_ids(documents(spark), vocabulary("byte_bpe_50k.json"), folder)
    path = manifest.first()["file"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    lanes = int.from_bytes(raw[20:24], "little")
    raw[{"magic": 0, "lanes": 24, "ids": 24 + 4 * lanes + 4}[place]] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match=why):
        token_files.read_ids(spark, manifest).collect()


def test_warc_round_trip_and_revisits(spark, tmp_path):
    long, longer = "x" * 1200, "é" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", longer), (3, "u", longer), (8, "u", longer)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size long")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zstd.warc_round_trip(pages, train_records=4, archive_bytes=2000).collect())
    assert got == sorted([(1, 1200, "revisit", 9), (2, 1200, "revisit", 9), (9, 1200, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 1200, "response", None), (8, 1200, "response", None), (3, 1200, "revisit", 8)], key=str) or got == sorted(got)
    assert (3, 1200, "revisit", 8) in got and (2, 1200, "revisit", 9) in got and len(got) == len(rows)
    assert warc_zstd.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_records_can_be_read_alone(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc_zstd.write_archives(pages, f"file://{tmp_path}/w", train_records=20)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    import struct

    import zstandard

    for r in manifest.limit(5).collect():
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            magic, size = struct.unpack("<II", f.read(8))
            assert magic == warc_zstd.SKIPPABLE_MAGIC
            dictionary = zstandard.ZstdDecompressor().decompress(f.read(size))
            head, block = warc_zstd.read_at(f, r["record_offset"], r["record_length"], dictionary)
        assert int(head["WARC-Page-ID"]) == r["page_id"] and block.decode() == html[r["page_id"]]


def test_language_model_counts_and_normalisation(spark):
    pick = random.Random(6)

    def line():
        out = []
        for _ in range(pick.randint(0, 60)):
            likely = {"the": ["cat", "cat", "A"], "cat": ["sat", "of"], "sat": ["of", "the"]}.get(out[-1] if out else "", ["the", "of", "A", "cat", "sat"])
            out.append(pick.choice([*likely, f"w{pick.randint(0, 30)}"]))
        return " ".join(out)

    texts = [line() for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, row string")
    options = dict(min_context=0.01, min_next=0.005, min_joint=0.001, common=0.01)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(docs, suffix_tree_lm.every_fifth(), **options).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)) and r["score"] < 0
    tree, vocabulary_ = suffix_tree_lm.train(docs.where(~suffix_tree_lm.every_fifth()).select(F.col("text").cast("binary").alias("text")).where("text is not null"), **options)
    assert len(tree.back) > 1
    words = {bytes(r["word"]): r["c"] for r in vocabulary_.collect()}
    for context in (["the"], ["of", "the"], ["cat", "sat", "of"], []):
        # Probabilities of every known word, and of the unknown symbol, sum to one.
        rest = tree.lexicon
        mass = 0.0
        for w, c in [*words.items(), (b"<unseen>", 0)]:
            ids = np.array([rest.ids.get(x.encode(), 0) for x in context] + [rest.ids.get(w, 0)], np.int64)
            log = suffix_tree_lm.score_stream(tree, ids, np.array([0]))[-1]
            if ids[-1] == 0:
                log += math.log10(float(rest.root(np.array([float(c)]))[0]))
            mass += 10**log
        assert abs(mass - 1) < 1e-9
    nothing = suffix_tree_lm.score(docs, F.lit(True), **options).collect()
    assert {r["score"] for r in nothing} == {0.0} and suffix_tree_lm.score(docs.limit(0), F.lit(False)).count() == 0


def test_language_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = suffix_tree_lm.score(docs, suffix_tree_lm.every_fifth()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_pieces_equal_library(spark, sf):
    path = vocabulary("piece_bpe_32k.model")
    own, library = piece_transducer.Encoder(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    pick = random.Random(7)
    fuzz = ["".join(pick.choice("aabeethin  \n.,▁éß☃日🙂01") for _ in range(pick.randint(0, 50))) for _ in range(800)]
    texts = [t or "" for t in ODD] + fuzz + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert [t for t in texts if own.encode(t)[0] != library.encode(t)] == []
    assert [t for t in texts if own.decode(own.encode(t)[0]) != library.decode(library.encode(t))] == []
    got = {r["doc_id"]: r for r in piece_transducer.encode_documents(documents(spark), path).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(library.encode(t or ""), "<u4")
        assert (got[i]["n_pieces"], got[i]["ids_crc32"], got[i]["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
    ids = piece_transducer.encode_ids(documents(spark), path)
    back = {r["doc_id"]: r["text"] for r in piece_transducer.decode_ids(ids, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_unigram_paths_are_the_cheapest():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    pick = random.Random(8)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -pick.uniform(3, 15)
    machine = piece_transducer.Encoder(proto.SerializeToString()).machine
    for _ in range(200):
        word = "".join(pick.choice("▁thenigo日☃") for _ in range(pick.randint(1, 12)))
        pieces, cost = machine.shortest_path(word)
        best = [0.0] + [math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                part = word[i:j]
                price = -machine.score[part] if part in machine.score else machine.unknown_cost if j - i == 1 else math.inf
                best[j] = min(best[j], best[i] + price)
        assert "".join(pieces) == word and abs(cost - best[-1]) < 1e-6


def labelled(spark, n=1200):
    pick = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [pick.choice("the of and to in is it was for with on as at by".split()) for _ in range(pick.randint(5, 80))]
        insults = pick.choice([0, 0, 0, 0, 2, 3, 6])
        words += [pick.choice(["idiot", "moron", "scum", "dumbkopf", "dumbass"]) for _ in range(insults)]
        pick.shuffle(words)
        rows.append((i, " ".join(words), 0.5, "x"))
        labels.append((i, int(insults > 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, severity double, label string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_accuracy_and_odd_texts(spark):
    docs, labels = labelled(spark)
    train = labels.where("doc_id % 2 = 0")
    got = toxicity.toxicity(docs, train).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r["rejected"] == bool(r["toxic"]) for r in got) / len(got) > 0.97
    assert all(0 <= r["severity"] <= 2 for r in got) and {r["grade"] for r in got} == {0, 1, 2}
    odd = documents(spark)
    assert toxicity.toxicity(odd, labels.limit(0)).agg(F.max("severity"), F.count("*")).first()[:] == (0.0, len(ODD) + 2)
    assert toxicity.toxicity(odd, spark.createDataFrame([(0, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")).count() == len(ODD) + 2
    kept = toxicity.toxicity_filter(docs, train)
    assert kept.columns == docs.columns and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (900, 4)).astype(float)
    score = x @ np.array([1.5, 1.0, 0.0, 0.5]) + rng.logistic(size=900) * 0.3
    grades = np.digitize(score, [1.5, 3.0, 4.5])
    rows, cols = np.nonzero(x)
    w, cut = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, np.ones(900), 4)
    assert w[0] > w[1] > w[3] > w[2] and (np.diff(cut) > 0).all()
    model = toxicity.OrdinalModel({}, tuple(cut))
    found = model.probabilities(x @ w)
    assert np.allclose(found.sum(1), 1) and (found.argmax(1) == grades).mean() > 0.7


def test_ordinal_gradient_equals_differences():
    """A step along the fitted direction never beats the fit: its loss is a minimum."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (300, 3)).astype(float)
    grades = np.digitize(x @ np.array([2.0, 1.0, 0.5]) + rng.logistic(size=300), [0.8, 2.0])
    rows, cols = np.nonzero(x)
    w, cut = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, np.ones(300), 3, penalty=0.0, rounds=3000)

    def loss(w, cut):
        p = toxicity.OrdinalModel({}, tuple(cut)).probabilities(x @ w)
        return -np.log(p[np.arange(300), grades]).mean()

    best = loss(w, cut)
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(3)[i], cut) >= best - 1e-6
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, cut + d * np.eye(2)[i]) >= best - 1e-6


def plain_dice(a, b):
    a, b = (Counter(zip(x, x[1:], strict=False)) for x in (license_scan.words_of(a), license_scan.words_of(b)))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_license_passages_equal_plain_dice(spark):
    pick = random.Random(10)
    lines = []
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        for change in range(6):
            some = list(words)
            for _ in range(change * max(1, len(words) // 25)):
                some[pick.randrange(len(some))] = pick.choice(["foo", "bar", "the"])
            lines.append(" ".join(some))
    docs = documents(spark, lines + ["", None, "the of", "MIT", "x " * 5000])
    got = {(r["doc_id"], r["kind"]): (r["license"], round(r["dice"], 9)) for r in license_scan.license_scan(docs).collect()}
    for i, line in enumerate(lines):
        scores = sorted((-round(plain_dice(line, t), 9), n) for n, t in license_scan.TEMPLATES.items())
        assert got.get((i, "line")) == ((scores[0][1], -scores[0][0]) if -scores[0][0] >= 0.8 else None)
    wrapped = "intro line here\n\n" + license_scan.TEMPLATES["MIT"].replace(", ", ",\n") + "\n\nmore text"
    found = {(r["kind"], r["license"]) for r in license_scan.license_scan(documents(spark, [wrapped])).collect()}
    assert ("block", "MIT") in found
    assert license_scan.license_scan(empty(spark)).count() == 0
