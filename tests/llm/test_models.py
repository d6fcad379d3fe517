"""Tokenizing, packing and the learned operators: exact round trips, brute force, held-out quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, byte_bpe, characters, language_id, lm_score, near_dedup, packing, toxicity

ODD = [None, "", " ", "a\x1cb \x1d\x85 c", "x" * 50_000, " \n\n  word", "İÉ 'll don't'S", "\U0001f642\U0001f642 ok　ＡＢ", "<|endoftext|> hi", "﻿a​b", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark, sf):
    extra = [(1_000_000 + i, t, None, "odd", 0) for i, t in enumerate(ODD)] + [(1_000_001, "", None, "odd", 0), (None, "no id at all", "en", None, None)]
    base = spark.read.parquet(f"{sf}/documents.parquet")
    return base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1)).cache()


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_byte_bpe_equals_tiktoken(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got, n = by_id(byte_bpe.digests(docs, path, P.PATTERN)), 0
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        x = got[r["doc_id"]][0]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        n += 1
    assert sum(map(len, got.values())) == n
    encoded = byte_bpe.encode(docs, path, P.PATTERN)
    back = by_id(byte_bpe.decode(encoded, path, P.PATTERN))
    assert all(bytes(back[r["doc_id"]][0]["data"]).decode() == (r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert byte_bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def odd_texts():
    """Every code point between letters, odd ones and a sample also beside marks and apostrophes, and 50,000 random strings."""
    every = characters.code_points()
    odd = "".join(sorted(characters.odd_characters(P.path("word_bpe_49k.json"))))
    shapes = ["a{0}b", "'{0}'s 1{0}2", "e{0}\u0301{0}\u0323 \u03a3{0}"]
    for shape, chars in zip(shapes, (every, odd + every[:0x3F800:11], odd + every[:0x3F800:11]), strict=True):
        for k in range(0, len(chars), 96):
            yield " ".join(shape.format(c) for c in chars[k:k + 96])
    rng = random.Random(1)
    common = "abcXYZ019 '\t\n\r.,;-sStTlLdD\u0323\u0301\u0345\xa0 \x85\x1c\x1f\u200b\u0130ı\u03a3\u03c3ſ\u212aẞßﬁ가각क़一٠²①\U0001f642\u200d<|>"
    pools = [common, common + odd[:200], every[:0x3000], every, odd]
    for _ in range(50_000):
        yield "".join(rng.choice(rng.choice(pools) if rng.random() < 0.5 else common) for _ in range(rng.randint(1, 14)))


def test_tokenizers_agree_on_every_code_point():
    import tiktoken
    from tokenizers import Tokenizer

    path, words = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    codec, lib, mine = byte_bpe.Codec(path, P.PATTERN), Tokenizer.from_file(words), packing.Tokenizer(words)
    texts = list(odd_texts())
    for k in range(0, len(texts), 4096):
        part = texts[k:k + 4096]
        assert codec.encode_many(part) == enc.encode_ordinary_batch(part)
        assert [x.tolist() for x in mine(part)] == [x.ids for x in lib.encode_batch(part, add_special_tokens=False)]


def test_packing_keeps_every_id_once(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [r for r in docs.select("doc_id", "text").collect() if r["doc_id"] != 1_000_001]
    want = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = packing.pack(docs.repartition(3), P.path("word_bpe_49k.json"), queue=64, with_ids=True).collect()
    got, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        if p["doc_id"] != 1_000_001:
            got[p["doc_id"]].append(p)
    for i, ids in want.items():
        parts = sorted(got[i], key=lambda p: p["start"])
        assert [x for p in parts for x in p["ids"]] == ids and parts[0]["doc_tokens"] == len(ids)
        assert all(p["start"] == sum(q["length"] for q in parts[:k]) for k, p in enumerate(parts))
    short = 0
    for w in windows.values():
        w.sort()
        assert all(o == sum(n for _, n in w[:k]) for k, (o, _) in enumerate(w))
        n = sum(x for _, x in w)
        assert n in (256, 512, 1024, 2048) or n < 256
        short += n < 256
    assert short <= 3  # one window of each partition may need padding
    steps = defaultdict(int)
    for p in packing.pack(docs.coalesce(1), P.path("word_bpe_49k.json"), step_tokens=32768).collect():
        steps[p["step"]] += p["length"]
    assert max(steps.values()) <= 32768 + 2048 and sorted(steps.values())[1] >= 32768 - 2048
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_filters_keep_columns_of_any_name(spark):
    rows = [(i, "you are a fool" if i % 2 else "the cat sat on the mat", "en", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, x int").selectExpr("*", "x as __text", "x as __tox", "x as __lang_pred", "x as __score", "x as __TOX_")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert language_id.filter_documents(docs).columns == docs.columns == toxicity.filter_documents(docs, labels).columns
    assert language_id.filter_documents(docs).count() == 20 and toxicity.filter_documents(docs, labels).count() <= 20


def test_every_language_has_landmarks():
    x = np.eye(300, dtype=np.float32)
    model = language_id.fit(np.repeat(x, 2, axis=0), [f"l{i:03d}" for i in range(300) for _ in range(2)])
    assert [model.labels[k] for k in model.margins(x).argmax(1)] == [f"l{i:03d}" for i in range(300)]


def test_language_id_held_out(docs):
    got = by_id(language_id.identify(docs))
    right = n = 0
    for r in docs.select("doc_id", "text", "lang").collect():
        x = got[r["doc_id"]][0]
        assert 0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (x["lang_pred"] == "und") == (not letter)
        if x["held_out"] and r["lang"] and letter:
            n, right = n + 1, right + (x["lang_pred"] == r["lang"])
    assert right / n >= 0.93, (right, n)
    kept = language_id.filter_documents(docs)
    assert kept.columns == docs.columns and 0.9 * docs.count() < kept.count() <= docs.count()
    assert language_id.identify(docs.limit(0)).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("lang_pred <> 'und'").count() == 0


def test_string_kernel_is_the_normalised_intersection():
    a, b = "abcab", "bca"
    x = language_id.presence([a, b], 1 << 13, 3)
    grams = [{t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (a, b)]
    assert list(x.sum(1)) == [len(g) for g in grams]
    k = language_id.kernel(x[:1], language_id.unit(x[1:]))[0, 0]
    assert abs(k - len(grams[0] & grams[1]) / math.sqrt(len(grams[0]) * len(grams[1]))) < 1e-6


def edit1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, p = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1] <= 1


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(3)
    terms = ["".join(rng.choice(list("abc"), rng.integers(4, 8))) for _ in range(15)]
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        w = "".join(rng.choice(list("abcd"), rng.integers(3, 9)))
        assert (trie.near(w) is not None) == any(edit1(w, t) for t in terms), w


def test_toxicity_held_out(spark, sf):
    base = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "you l0ser, you total idiott and morron", "en"), (-3, "x" * 20_000, "en")], base.schema)
    docs = base.unionByName(more)
    got = by_id(toxicity.score_documents(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    hit = miss = wrong = clean = 0
    for i, t in truth.items():
        x = got[i][0]
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5)
        if x["held_out"]:
            hit, miss = hit + (t and x["predicted"]), miss + (t and not x["predicted"])
            wrong, clean = wrong + (not t and x["predicted"]), clean + (not t)
    assert hit >= 0.9 * (hit + miss) and wrong <= 0.01 * clean, (hit, miss, wrong, clean)
    assert got[-2][0]["predicted"] == 1 and got[-1][0]["predicted"] == got[None][0]["predicted"] == 0
    empty = toxicity.score_documents(docs, labels.limit(0))
    assert empty.where("score <> 0").count() == 0 and empty.count() == docs.count()
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_quotation_scores_below_abuse():
    lexicon = toxicity.Lexicon(["idiot"], [])
    abuse, quoted = (toxicity.features(t, lexicon, 6) for t in ("you are an idiot my friend", 'she said "idiot" in the report'))
    assert abuse[0] > 0 == abuse[1] and quoted[0] == 0 < quoted[1]


def test_lm_counts_base_and_probabilities(docs):
    rows = docs.select("doc_id", "text").collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    toks = {i: [*(r["text"] or "").encode().lower().split(), b""] for i, r in enumerate(rows)}
    c = Counter(t for i, r in enumerate(rows) if fold(r["doc_id"]) != 1 for t in toks[i])
    n, v = sum(c.values()), len(c)
    got = by_id(lm_score.score_documents(docs))
    other = by_id(lm_score.score_documents(docs.repartition(7), head=50))  # other partitions, and most tokens joined
    better = held = 0
    for i, r in enumerate(rows):
        x = got[r["doc_id"]][0]
        base = math.fsum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks[i])
        for y in (x, other[r["doc_id"]][0]):
            assert (y["held_out"], y["n_tokens"], y["n_known"], y["train_tokens"]) == (fold(r["doc_id"]) == 1, len(toks[i]), sum(c[t] > 0 for t in toks[i]), n)
            assert abs(y["base_score"] - base) < 1e-9 * abs(base) + 1e-9 and y["score"] <= 0
        assert abs(other[r["doc_id"]][0]["score"] - x["score"]) < 1e-6 * abs(x["score"])
        if x["held_out"] and len(toks[i]) > 20:
            held, better = held + 1, better + (x["score"] > x["base_score"])
    assert better > 0.9 * held
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    none = lm_score.score_documents(docs.where("doc_id = 3").select("doc_id", "text"), modulus=1, held=0).collect()  # nothing to learn from
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in none] == [(0, 0, 0.0)]


LM_TEXTS = ["the cat sat on the mat.", "The dog sat, the dog ran", "a cat ran on a dog!!!", "", "the the the", "zebra xylophone the quux", None, "x" * 5000 + " mat. " + "ab" * 4000] * 3 + ["one more cat sat"]


def test_lm_equals_a_model_made_token_by_token(spark):
    """Counts, both updates and every factor by plain loops; only the hashes of tokens and features are shared."""
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(LM_TEXTS)], "doc_id long, text string, uid int, rare int")
    got = {r["doc_id"]: r for r in lm_score.score_documents(table, head=4).collect()}
    number = lambda w: int(lm_score.numbers(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    texts = [[*map(number, (t or "").encode().lower().split()), int(lm_score.END)] for t in LM_TEXTS]
    learn = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in learn for w in t)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    top = sorted((w for w in c if w != int(lm_score.END)), key=lambda w: (-c[w], signed(w)))[:lm_score.TOP]
    K, S = lm_score.CLASSES, lm_score.SLOTS

    def kind(w):
        return K - 1 if w == int(lm_score.END) else top.index(w) if w in top else lm_score.TOP + w % 32

    def histories(t):
        codes = [int(lm_score.FIRST), *(w >> 32 for w in t)]
        return [(codes[i], codes[i - 1] if i else int(lm_score.SECOND)) for i in range(len(t))]

    def rows(one, two, k):
        one, two = np.array([one], np.uint32), np.array([two], np.uint32)
        wide = lm_score.TOP <= k < K - 1
        return [int(r[0]) for r in lm_score.class_rows(one, two)], [int(r[0]) for r in lm_score.slot_rows(one, two, np.array([k - lm_score.TOP]))] if wide else []

    leaf, fresh_once = Counter(), Counter()
    for w, x in c.items():
        leaf[kind(w), w >> 5 & 31] += x
        fresh_once[kind(w)] += x == 1
    class_tokens = [sum(x for (k, _), x in leaf.items() if k == j) for j in range(K)]
    p = np.array([x + 0.5 for x in class_tokens]) / sum(x + 0.5 for x in class_tokens)
    q = {k: np.array([leaf[k, s] + 0.5 for s in range(S)]) / sum(leaf[k, s] + 0.5 for s in range(S)) for k in range(lm_score.TOP, K - 1)}
    n, m = defaultdict(lambda: np.zeros(K)), defaultdict(lambda: np.zeros(S))
    for t in learn:
        for w, (one, two) in zip(t, histories(t), strict=True):
            a, b = rows(one, two, kind(w))
            for r in a:
                n[r][kind(w)] += 1
            for r in b:
                m[r][w >> 5 & 31] += 1
    prior = lambda r: q[lm_score.TOP + r // lm_score.SLOT_BUCKETS]
    step = lambda x, p: 0.6 * np.log((x + 100 * p) / ((x.sum() + 100) * p))
    w1, w2 = defaultdict(lambda: np.zeros(K), {r: step(x, p) for r, x in n.items()}), defaultdict(lambda: np.zeros(S), {r: step(x, prior(r)) for r, x in m.items()})

    def softmax(z):
        return np.exp(z) / np.exp(z).sum()

    e, f = defaultdict(lambda: np.zeros(K)), defaultdict(lambda: np.zeros(S))
    for t in learn:
        for w, (one, two) in zip(t, histories(t), strict=True):
            a, b = rows(one, two, kind(w))
            x = softmax(np.log(p) + sum(w1[r] for r in a))
            for r in a:
                e[r] += x
            if b:
                x = softmax(np.log(q[kind(w)]) + sum(w2[r] for r in b))
                for r in b:
                    f[r] += x
    second = lambda x, y, p: np.clip(0.5 * (x - y) / (y + 400 * p + 20), -1, 1)
    for r in n:
        w1[r] = w1[r] + second(n[r], e[r], p)
    for r in m:
        w2[r] = w2[r] + second(m[r], f[r], prior(r))
    for i, t in enumerate(texts):
        total = 0.0
        for w, (one, two) in zip(t, histories(t), strict=True):
            k = kind(w)
            a, b = rows(one, two, k)
            total += np.log(softmax(np.log(p) + sum(w1[r] for r in a))[k])
            if b:
                unknown = min((fresh_once[k] + 0.5) / (class_tokens[k] + 1), 0.5) if class_tokens[k] else 1.0
                slot = softmax(np.log(q[k]) + sum(w2[r] for r in b))[w >> 5 & 31]
                total += np.log(slot * (1 - unknown) * c[w] / leaf[k, w >> 5 & 31]) if c[w] else np.log(unknown)
        assert abs(got[i]["score"] - total / np.log(10)) < 1e-5 * abs(total) + 1e-6, (i, got[i]["score"], total / np.log(10))


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    names = [b"the", b"of", b"cat", b"cats", b"dog"]
    ids = [int(lm_score.numbers(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in names] + [int(lm_score.END)]
    counts = dict(zip(ids, range(1, 7), strict=True))
    classes = lm_score.Classes(ids[:2])
    totals, (k, s) = np.zeros((lm_score.LEAVES, 2), np.int64), (lm_score.ENDINGS, lm_score.SLOTS)
    arrays = np.array(ids, np.uint64)
    leaf = lm_score.leaf_of(arrays, classes.of(arrays))
    for at, c in zip(leaf, counts.values(), strict=True):
        totals[at] += (c, c == 1)
    _, by_slot = lm_score._leaf_sums(totals[:, 0])
    normal = lambda *shape: rng.normal(size=shape)
    with np.errstate(divide="ignore"):
        model = lm_score.Model(classes, normal(lm_score.CLASSES), np.log(by_slot / np.maximum(by_slot.sum(1, keepdims=True), 1)), normal(lm_score.BUCKETS, lm_score.CLASSES), normal(k * lm_score.SLOT_BUCKETS, s))
    leaves = lm_score.Leaves(totals)
    history = np.full(len(ids), 5, np.uint32), np.full(len(ids), 9, np.uint32)
    y, p, slot = model.log_probabilities(lm_score.Chunk(arrays, np.zeros(len(ids), int), *history))
    known = np.exp(p + np.where(leaf <= lm_score.TOP, 0, slot + leaves.known[leaf] + np.log(list(counts.values()))))
    x = lm_score.softmax(model.class_sums(lm_score.class_rows(history[0][:1], history[1][:1])))[0]
    unknown = (x[lm_score.TOP:-1] * np.exp(leaves.unknown[lm_score.TOP + 1::s])).sum()
    assert abs(known.sum() + unknown + x[2:lm_score.TOP].sum() - 1) < 1e-5  # and classes without a token here


def test_lm_chunks_are_the_tokens():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.|AB  \n\té\x85") for _ in range(rng.choice([0, 1, 5, 40, 900]))) for _ in range(300)] + ["y" * 9000 + "z", "y" * 9000 + "w", "." * 70 + " ..a.."]
    expected = [w for t in texts for w in [*t.encode().lower().split(), None]]
    column = pa.array(["skipped", *texts]).slice(1)
    for size in (7, 64, 1 << 18):
        found = list(lm_score.chunks(column, size))
        ids = np.concatenate([c.ids for c in found]).tolist()
        names: dict = {}
        assert len(ids) == len(expected) and all(names.setdefault(w, i) == i for w, i in zip(expected, ids, strict=True)) and len(set(names.values())) == len(names)
        assert np.concatenate([c.docs for c in found]).tolist() == [i for i, t in enumerate(texts) for _ in range(len(t.encode().split()) + 1)]
        history = np.stack([np.concatenate([c.one for c in found]), np.concatenate([c.two for c in found])])
        if size == 7:
            first = history
        assert (history == first).all()


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000 + i, x[40].tolist(), 1) for i in range(60)]
    rows += [(3000, None, 1), (3020, [0.0] * 24, 1), (3040, [float("nan")] * 24, 1), (3060, [1.0] * 5, 1), (3080, [None, *[1.0] * 23], 1), (None, x[3].tolist(), 1), (40, x[40].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in ann.search(df, lambda c: c % 20 == 0, k=20, pivots=128, prefix=32, share=0.15, least=64, index_block=700, query_block=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    valid = {i: np.array(v) for i, v, _ in rows[:1560]}
    ids = np.array(sorted(valid))
    m = np.stack([valid[i] for i in ids])
    assert set(got) == {i for i in ids if i % 20 == 0}
    found = 0
    for q, hits in got.items():
        hits.sort()
        s = (m * valid[q]).sum(1)
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        assert all(abs(h[2] - float((valid[h[1]] * valid[q]).sum())) < 1e-9 for h in hits)
        found += len({h[1] for h in hits} & set(want))
    assert found >= 0.9 * 20 * len(got)
    assert [h[1] for h in got[40]][:20] == [2000 + i for i in range(20)]
    assert ann.search(df.limit(0), lambda c: c % 20 == 0).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>"), lambda c: c % 20 == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 0.0)]


def plain_shingles(text):
    words = re.findall(r"\w+", (text or "").lower()) or ["".join((text or "").split())] * bool((text or "").strip())
    n = min(5, len(words))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else Counter(), tuple(words)


def both_readings(a, b):
    """Probability Jaccard and plain Jaccard of two counters, from their definitions."""
    common, every = sorted(a.keys() & b.keys()), sorted(a.keys() | b.keys())
    if not common:
        return 0.0, 0.0
    x, y = (np.array([c[s] for s in every], float) for c in (a, b))
    p, q = (np.array([c[s] for s in common], float) for c in (a, b))
    probability = sum((1 / np.maximum(x / u, y / v).sum() for u, v in zip(p, q, strict=True)), 0.0)
    return probability, len(common) / len(every)


def brute_classes(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (sets[i][1] == sets[j][1] or sets[i][0] and max(both_readings(sets[i][0], sets[j][0])) >= 0.8 - 1e-9):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_near_dedup_recall_of_each_reading(spark):
    """Pairs just over 0.8 in one reading only: at least nine in ten are linked."""
    rng = np.random.default_rng(12)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    for reading in (0, 1):
        rows = []
        for k in range(40):
            if reading:  # the same words, then a line that only one repeats
                body, line = draw(300), draw(6)
                pair = [body + draw(15), body + line * 100]
            else:  # a repeated line, then a tail that only one has
                line = draw(6)
                pair = [line * 60, line * 60 + draw(40)]
            rows += [(2 * k + i, " ".join(w)) for i, w in enumerate(pair)]
        got = both_readings(*(plain_shingles(t)[0] for _, t in rows[:2]))
        assert got[reading] > 0.8 > got[1 - reading], got
        found = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("class_size = 2").count()
        assert found >= 0.9 * len(rows), (reading, found)


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.integers(len(w))] = f"new{rng.integers(10**9)}"
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(10**6)}" for _ in range(300)]
    extra = [(2_000_000 + i, edited(rng, base, 6), "en", "s", 1) for i in range(60)] + [(3_000_000 + i, " ".join(base[:150]), "en", "s", 1) for i in range(30)]
    all_docs = docs.drop("score", "held_out").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = [tuple(r) for r in all_docs.select("doc_id", "text").collect()]
    got = near_dedup.classes(all_docs)
    groups = defaultdict(list)
    for r in got.collect():
        groups[r["class_id"]].append(r)
    assert sorted(sorted(str(r["doc_id"]) for r in g) for g in groups.values()) == brute_classes(rows)
    for class_id, g in groups.items():
        assert all(r["class_size"] == len(g) for r in g) and [r["doc_id"] for r in g if r["kept"]] == [class_id]
    kept = near_dedup.filter_documents(all_docs)
    assert kept.columns == all_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, groups))
    assert near_dedup.classes(all_docs.limit(0)).count() == 0 and near_dedup.filter_documents(all_docs.limit(0)).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    b = np.unique(np.concatenate([a[:150], rng.integers(0, 2**63, 30).astype(np.uint64)]))
    wa, wb = rng.integers(1, 5, len(a)).astype(np.int32), rng.integers(1, 5, len(b)).astype(np.int32)
    s = near_dedup.signatures([(a, wa), (b, wb)], 4000)
    x, y = dict(zip(a, wa / wa.sum(), strict=True)), dict(zip(b, wb / wb.sum(), strict=True))
    direct = sum(1 / sum(max(x.get(d, 0) / x[c], y.get(d, 0) / y[c]) for d in x.keys() | y.keys()) for c in x.keys() & y.keys())
    assert abs(near_dedup.similarity(a, wa, b, wb)[0] - direct) < 1e-9 and abs((s[0] == s[1]).mean() - direct) < 0.03
