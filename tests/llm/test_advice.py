"""Cases of a review: places where an operator once did less than its whole job."""

import numpy as np

from tessera.llm import language_id, lm_score, near_dedup, toxicity


def test_near_copies_that_repeat_a_line_are_found(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(12):
        body, line = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, n)) for n in (300, 6)]
        rows += [(2 * k, f"{body} {line}"), (2 * k + 1, " ".join([body] + [line] * 200))]
    a, b = (near_dedup.shingles(t)[:2] for _, t in rows[:2])
    weighted, plain = near_dedup.similarity(*a, *b)
    assert weighted < 0.4 and plain > 0.95
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_repeated_lines_are_linked_whatever_the_sizes_of_their_sets(spark):
    rng, rows = np.random.default_rng(6), []
    for k in range(4):
        line, tail = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, n)) for n in (6, 24)]
        rows += [(2 * k, " ".join([line] * 500)), (2 * k + 1, " ".join([line] * 500 + [tail]))]
    a, b = (near_dedup.shingles(t)[:2] for _, t in rows[:2])
    assert (len(a[0]), len(b[0])) == (6, 30) and near_dedup.similarity(*a, *b)[0] > 0.98
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_refusals_agree_with_the_similarity():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        sets = []
        for _ in range(2):
            v = np.unique(rng.integers(0, 12, rng.integers(1, 12))).astype(np.uint64)
            sets += [v, rng.choice([1, 1, 3, 200], len(v)).astype(np.int32)]
        assert near_dedup.linked(*sets, 0.8) == (max(near_dedup.similarity(*sets)) >= 0.8 - 1e-12)


def test_frequent_terms_and_long_lists_stay_in_the_lexicon(spark):
    rng = np.random.default_rng(8)
    draw = lambda: f"w{rng.integers(0, 500)}"
    rows = [(f"{draw()} {draw()} grumph {draw()} {draw()}", 1) for _ in range(400)] + [(" ".join(draw() for _ in range(12)), 0) for _ in range(2000)]
    rows += [(f"{draw()} {draw()} grumph {draw()} {draw()}", 0) for _ in range(12)]
    many = [(" ".join(f"t{k}x {draw()}" for k in rng.permutation(5200)), 1) for _ in range(8)]
    for found, words in ((rows, {"grumph"}), (rows[400:2400] + many, {f"t{k}x" for k in range(5200)})):
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "doc_id long, text string, toxic int")
        assert toxicity.train(table, table.select("doc_id", "toxic"), modulus=1, held=1).lexicon.trie.exact == words


def test_quoted_reported_and_abusive_uses_differ(spark):
    lexicon = toxicity.Lexicon(["idiot"], [])
    kinds = lambda text: [k for k in range(3) if toxicity.features(text, lexicon, 6)[k] > 0]
    assert kinds("you are an idiot my friend") == kinds("don't be an idiot, it's late") == [0]
    assert kinds("the word 'idiot' was on the wall") == kinds("‘idiot’ was on the wall") == kinds('on the wall: "idiot"') == [1]
    assert kinds("the word idiot was on the wall") == [2]
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    rows = [(f"{draw(8)} you idiot {draw(8)}", 1) for _ in range(300)] + [(draw(18), 0) for _ in range(600)]
    rows += [(f"{draw(8)} {use} {draw(8)}", 0) for _ in range(12) for use in ("the word idiot", "the 'idiot' here")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.select("doc_id", "toxic"), modulus=1, held=1)
    abusive, reported, quoted = (model.score(f"a b c d e f g {use} h i j k l m n") for use in ("you idiot", "the word idiot", "the 'idiot' here"))
    assert abusive > 0.5 > max(reported, quoted)


def test_long_texts_keep_their_language(spark):
    rng, letters = np.random.default_rng(10), [list(map(chr, range(0x4E00 + 400 * k, 0x4E00 + 400 * k + 700))) for k in range(3)]  # overlapping
    write = lambda k, n: "".join(rng.choice(letters[k], n))
    rows = [(i, write(i % 3, 300), f"l{i % 3}") for i in range(240)] + [(1000 + i, write(i % 3, 60_000), f"l{i % 3}") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table.where("doc_id < 1000"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(table.where("doc_id >= 1000"), model).collect()}
    assert all(got[1000 + i][0] == f"l{i % 3}" for i in range(9)), got
    parts = language_id.chunks("abcdefg" * 999, 4)
    assert "".join(c[:-3] for c in parts[:-1]) + parts[-1] == "abcdefg" * 999


def test_language_model_keeps_its_classes():
    assert lm_score.TOP >= 15 and lm_score.ENDINGS >= 32


def test_pairs_that_are_not_compared_cannot_be_linked():
    rng = np.random.default_rng(11)
    for _ in range(20):
        sets = []
        for _ in range(40):
            v = np.unique(rng.integers(0, rng.choice([8, 30, 300]), rng.integers(1, 25))).astype(np.uint64)
            sets.append((v, rng.choice([1, 1, 2, 50], len(v)).astype(np.int32)))
        for often in (2, 5, 24):
            common, mass = near_dedup.overlaps(sets, often=often, columns=7)
            for i in range(len(sets)):
                for j in range(i):
                    both, at, _ = np.intersect1d(sets[i][0], sets[j][0], return_indices=True)
                    assert common[i, j] == len(both) and abs(mass[i, j] - sets[i][1][at].sum() / sets[i][1].sum()) < 1e-5
        may, sure = near_dedup.may_be_linked(sets, 0.8)
        for i in range(len(sets)):
            for j in range(i):
                found = max(near_dedup.similarity(*sets[i], *sets[j])) >= 0.8 - 1e-12
                assert may[i, j] or not found
                assert found or not sure[i, j]


def test_words_of_one_vocabulary_do_not_become_terms(spark):
    """Toxic and clean texts over the same words, toxic ones three times as many: one real term, and clean texts stay clean."""
    rng = np.random.default_rng(12)
    vocabulary = [f"word{k}x" for k in range(3000)]
    weights = 1 / np.arange(1, 3001)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    rows = [(f"{draw(20)} grumph {draw(20)}", 1) for _ in range(600)] + [(draw(40), 0) for _ in range(200)]
    unseen = [(5 * k, f"{draw(20)} grumph {draw(20)}" if k % 5 == 0 else draw(40)) for k in range(600)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.select("doc_id", "toxic"), modulus=1, held=1)
    assert model.lexicon.trie.exact == {"grumph"}
    flagged = {i for i, t in unseen if model.score(t) >= 0.5}
    clean, bad = [i for i, _ in unseen if i % 25], [i for i, _ in unseen if i % 25 == 0]
    assert len(flagged & set(clean)) < 0.01 * len(clean) and len(flagged & set(bad)) >= 0.9 * len(bad)


def _edit1(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1] <= 1


def test_toxicity_scores_equal_brute_force(spark, sf):
    """Every word against every term by edit distance, every hit's window by hand, and the logistic score."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "You l0ser! He said 'pathetik' and \"trash\"."), (-2, None), (-3, "scum"), (-3, "scum")], "doc_id long, text string"))
    model = toxicity.train(docs, labels)
    terms, stop, split = model.lexicon.trie.exact, model.lexicon.stop, toxicity.WORDS
    assert terms

    def kind(w):
        plain = w.translate(toxicity.LETTERS)
        near = lambda x: any(len(t) >= toxicity.SHORTEST and _edit1(x, t) for t in terms)
        return 1 if w in terms else 0 if w in stop else 2 if plain in terms or near(w) or near(plain) else 0

    def score(text):
        low, counts = (text or "").lower(), np.zeros((2, 3))
        found = list(split.finditer(low))
        for i, m in enumerate(found):
            k = kind(m[0])
            if k:
                near = found[max(0, i - 6):i + 7]
                start, end = (found[i - 7].end() if i > 6 else 0), (found[i + 7].start() if i + 7 < len(found) else len(low))
                before, after = low[start:m.start()], low[m.end():end]
                double = toxicity.QUOTES.search(before) and toxicity.QUOTES.search(after)
                single = any(x.start() <= m.start() and x.start() >= start for x in toxicity.OPENING.finditer(low, 0, m.start() + 1)) and any(m.end() <= x.start() < end for x in toxicity.CLOSING.finditer(low))
                counts[k - 1, 1 if double or single else 2 if {x[0] for x in near} & toxicity.REPORTING else 0] += 1
        x = np.zeros(toxicity.FEATURES)
        if counts.sum():
            density = 100 * counts.sum() / len(found)
            x[:] = [*np.log1p(counts.ravel()), density / (1 + density), counts[:, 0].sum() > 0]
        return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))

    scored, name = toxicity.scored(docs, model)
    rows = scored.collect()
    assert len(rows) == docs.count()
    hits = [r for r in rows if abs(r[name] - score(None)) > 1e-9]
    assert len(hits) >= 8 and all(abs(r[name] - score(r["text"])) < 1e-9 for r in [*hits, *rows[:25], *rows[-4:]])


def test_language_scores_equal_brute_force_kernel_regression():
    """Set intersections, the whole kernel matrix, and ridge regression in its kernel form; long texts as the mean of their chunks."""
    rng = np.random.default_rng(13)
    alphabet = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghi "}
    texts = [("".join(rng.choice(list(alphabet[k]), rng.integers(5, 80))), k) for k in alphabet for _ in range(12)]
    asked = ["".join(rng.choice(list(alphabet[k]), n)) for k in alphabet for n in (1, 7, 60, 2500)]
    buckets, max_n = 1 << 10, 3

    def sets(text):
        out = []
        for c in language_id.chunks(text, max_n):
            held = set()
            for n in range(1, max_n + 1):
                for i in range(len(c) - n + 1):
                    h = 0
                    for step, ch in enumerate(c[i:i + n].lower(), 1):
                        h = ((h ^ ord(ch)) * int(language_id.MULTIPLIERS[0]) + step) % 2**32
                    held.add((h * int(language_id.MULTIPLIERS[n]) % 2**32) >> (32 - (buckets - 1).bit_length()))
            out.append(held)
        return out

    one = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    kernel = lambda a, b: np.mean([[one(x, y) for y in sets(b)] for x in sets(a)])
    names, labels = sorted(alphabet), [k for _, k in texts]
    gram = np.array([[kernel(a, b) for b, _ in texts] for a, _ in texts])
    y = np.array([[1.0 if n == k else -1.0 for n in names] for k in labels])
    alpha = np.linalg.pinv(gram @ gram + 1e-3 * len(texts) * gram, rcond=1e-12) @ gram @ y  # languages of equal size: all weights are 1
    want = np.array([[kernel(a, b) for b, _ in texts] for a in asked]) @ alpha
    model = language_id.fit(language_id.vectors([t for t, _ in texts], buckets, max_n), labels, landmarks=len(texts))
    assert np.abs(model.score(asked, max_n) - want).max() < 1e-3
    assert np.abs(model.margins(language_id.vectors(asked, buckets, max_n)) - want).max() < 1e-3


def test_repeated_rows_and_clashing_columns_each_get_their_result(spark):
    from tessera.llm import url_filter

    rows = [(1, "you idiot"), (1, "you idiot"), (2, "calm words"), (None, "you idiot"), (3, None)]
    docs = spark.createDataFrame([(*r, "clash", "clash", 1.0) for r in rows], "doc_id long, text string, predicted string, bad string, score double")
    labels = spark.createDataFrame([(2, 0, "clash"), (1, 1, "clash")], "doc_id long, toxic int, score string")
    got = toxicity.score_documents(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None"] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    kept = toxicity.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5 and {r["score"] for r in got} == {0.0}  # no word tells the two labelled rows apart
    pages = spark.createDataFrame([(7, "http://a.com/fr/x", None, "clash"), (7, "http://a.com/fr/x", None, "clash"), (8, "http://b.com/" + "y" * 50_000, "", "clash")], "page_id long, url string, html string, host string")
    judged = url_filter.judge(pages).collect()
    assert sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in judged if r["page_id"] == 7) == [(7, "a.com", "com/fr/", "allow")] * 2
    assert [len(r["path"]) for r in judged if r["page_id"] == 8] == [50_001]


def test_hot_copies_of_vectors_and_license_texts(spark):
    from tessera.llm import ann, license_scan

    rng = np.random.default_rng(14)
    x = rng.normal(size=(120, 8))
    rows = [(i, [float(v) for v in (x[0] if i % 3 == 0 else x[i % 120])]) for i in range(600)]  # a third of all rows share one vector
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    v = np.array([e for _, e in rows])
    for q, found in got.items():
        score = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -np.round(score, 12))) if i != q][:5]
        assert [i for _, i in sorted(found)] == want
    assert len(got) == 30
    hot = [(i, "this text stands under the MIT license") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(100)]
    labels = license_scan.scan(spark.createDataFrame(hot, "doc_id long, text string")).groupBy("labels").count().collect()
    assert {r["labels"]: r["count"] for r in labels} == {"mit": 400, "": 100}
