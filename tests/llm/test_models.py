"""Toxicity and language ID: held-out accuracy on made-up classes, plain versions of both models, and odd rows."""

import math
import random
import zlib

import numpy as np

from chronoset.llm import language_id, toxicity

ODD = [(1, None), (2, ""), (3, "...\n!"), (None, "what is this"), (4, "123 456"), (5, "日本語のテキスト"), (6, "word " * 50000), (6, "word " * 50000)]
DOCS = "doc_id long, text string, lang string, score double, sentence string, _score string, _Offending string, _lang string, _lang_score string, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, *["x"] * 6) for i, t, g in rows], DOCS)


def corpus(seed, n):
    rnd = random.Random(seed)
    sentence = lambda: " ".join("".join(rnd.choice("bdklmnrt") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(8))
    rows = []
    for k in range(n):
        parts, toxic = [sentence() for _ in range(rnd.randrange(1, 12))], rnd.random() < 0.3
        if toxic:
            parts[rnd.randrange(len(parts))] += " zog" + rnd.choice(("xu", "xo", "xi", "xa")) + rnd.choice("abc")
        rows.append((k, ". ".join(parts) + ".", int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = corpus(1, 900)
    docs, labels = docs_of(spark, [(k, t, "en") for k, t, _ in rows]), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((scored[k]._score >= 0.5) == y for k, _, y in held) >= 0.95 * len(held)
    for k, t, y in held:  # the sentence that offends is found
        if y and scored[k]._score >= 0.9:
            assert any("zogx" in t[x.begin : x.end] and t[x.end - 1] == "." for x in scored[k]._offending)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r._score for r in kept.collect()} == {"x"}
    assert {r.doc_id for r in kept.collect()} == {k for k, r in scored.items() if r._score < 0.5}


def test_sentence_spans():
    text = "  One two.  !? three\nfour É. five"
    assert [text[a:b] for a, b in toxicity.sentence_spans(text)] == ["One two.", "three\n", "four É.", "five"]


def plain_score(model, text):
    """Noisy-or over sentences, word by word."""
    clean = 1.0
    for sentence in (text or "").lower().replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        found = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in sentence).split()
        if found:
            logit = model.bias + sum(model.weights.get(f, 0.0) for w in found for f in toxicity.features(w.encode()))
            clean *= 1 - 1 / (1 + math.exp(-max(-40, min(40, logit))))
    return 1 - clean


def test_score_is_noisy_or():
    rnd = random.Random(5)
    names = ["alpha", "beta", "gammas", "Ümlaut", "x1"]
    model = toxicity.Model({f: rnd.uniform(-2, 3) for w in names for f in toxicity.features(w.lower().encode())}, -1.5)
    known = toxicity._Weights(model.weights)
    for _ in range(300):
        text = "".join(rnd.choice([*names, "other", ".", "! ", "\n", ", ", " ", "-"]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(25)))
        assert abs(model.score(text, known)[0] - plain_score(model, text)) < 1e-9


def test_fit_goes_down_the_slope_of_noisy_or():
    """A first step of the fit moves each weight against the numerical slope of the plain likelihood."""
    rows = [("bad one. fine words here", 1), ("fine words. other things", 0), ("bad. bad", 1), ("other things here", 0), ("", 0)]
    bags = [toxicity.bag(t) for t, _ in rows]
    fitted = toxicity.fit([(b[0], b[1], y) for b, (_, y) in zip(bags, rows, strict=True)], [b[2] for b in bags], steps=1)

    def loss(weights):
        model = toxicity.Model(weights, -6.0)
        return -sum(math.log(max(1e-12, p if y else 1 - p)) for t, y in rows for p in [plain_score(model, t)]) / len(rows)

    for f in {f for t, _ in rows for w in toxicity.tokens(t) for f in toxicity.features(w)}:
        slope = (loss({f: 1e-4}) - loss({f: -1e-4})) / 2e-4
        assert fitted.weights.get(f, 0.0) * slope < 0 or abs(slope) < 1e-6


def test_sample_is_bounded_in_bytes_and_ids_count_once(spark):
    rows = corpus(7, 400)
    docs = docs_of(spark, [(k, t, "en") for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample_bytes=0) == toxicity.Model()
    assert toxicity.train(docs.union(docs).union(docs), labels.union(labels)) == toxicity.train(docs, labels)


def test_toxicity_uses_no_held_out_label(spark):
    rows = corpus(2, 300)
    docs = docs_of(spark, [(k, t, "en") for k, t, _ in rows])
    flip = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in rows]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(k, y) for k, _, y in rows], flip))
    assert a == b


def test_toxicity_odd_rows(spark):
    docs, labels = docs_of(spark, [(i, t, None) for i, t in ODD]), spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r._score <= 1 for r in out)
    assert all(r._score == 0 for r in out if not (r.text or "").strip("., \n!"))
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def languages(seed, n):
    rnd = random.Random(seed)
    kinds = {"aa": ("bdg", "ou"), "bb": ("mnl", "ei"), "cc": ("ktp", "aeé")}
    rows = []
    for k in range(n):
        lang = rnd.choice(sorted(kinds))
        c, v = kinds[lang]
        rows.append((k, " ".join("".join(rnd.choice(c) + rnd.choice(v) for _ in range(3)) for _ in range(rnd.randrange(3, 60))), lang))
    return rows


def test_language_held_out(spark):
    rows = languages(3, 400)
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[k]._lang == lang for k, _, lang in held) >= 0.98 * len(held)
    shuffled = docs_of(spark, [(k, t, "zz" if zlib.crc32(str(k).encode()) % 3 == 1 else g) for k, t, g in rows])
    assert language_id.train(shuffled).languages == ["aa", "bb", "cc"]


def plain_presence(text):
    """Hashed n-grams, one by one."""
    out = set()
    for n in (1, 2, 3):
        for k in range(len(text) - n + 1):
            code = 0
            for c in text.lower()[k : k + n]:
                code = code << 21 | (ord(c) + 1)
            out.add((code * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - language_id.SLOT_BITS))
    return out


def test_language_against_plain_kernel_ridge():
    """Kernel, landmarks, ridge and scores written out with sets and dense matrices."""
    rows, marks = [(t, g) for _, t, g in languages(11, 90)] + [("日本語のテキストです", "ja"), ("これは本です", "ja")], 8
    sets = [plain_presence(t) for t, _ in rows]
    model = language_id.fit([(language_id.presence(t), g) for t, g in rows], landmarks=marks)
    assert [set(language_id.presence(t).tolist()) for t, _ in rows] == sets
    names = sorted({g for _, g in rows})
    mark = [x for k, x in enumerate(sets) if sum(rows[j][1] == rows[k][1] for j in range(k)) < marks]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    own = np.array([[kernel(a, b) for b in mark] for a in mark])
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    phi = np.array([[kernel(a, b) for b in mark] for a in sets]) @ vectors[:, keep] / np.sqrt(values[keep])
    share = np.array([len(rows) / len(names) / sum(h == g for _, h in rows) for _, g in rows])
    target = np.array([[g == c for c in names] for _, g in rows], float)
    solved = np.linalg.inv(phi.T @ np.diag(share) @ phi + language_id.RIDGE * len(rows) / 100 * np.eye(phi.shape[1])) @ phi.T @ np.diag(share) @ target
    want = phi @ solved
    got, scores = model.predict([t for t, _ in rows])
    assert got == [names[k] for k in want.argmax(axis=1)]
    assert np.allclose(scores, np.clip(want.max(axis=1), 0, 1), atol=1e-4)


def test_language_texts_unlike_all_landmarks():
    model = language_id.fit([(language_id.presence(t), g) for t, g in [("the cat", "en"), ("un chat", "fr"), ("le chien", "fr")]])
    assert model.predict(["日本語のテキスト", "123", "", None, "?!", "the"]) == (["fr", "und", "und", "und", "und", "en"], model.predict(["日本語のテキスト", "123", "", None, "?!", "the"])[1])
    assert model.predict(["日本語のテキスト"])[1] == [0.0]


def test_many_languages_each_have_landmarks():
    rnd = random.Random(2)
    alphabets = {f"l{k:03d}": [chr(0x4E00 + 20 * k + j) for j in range(20)] for k in range(150)}
    rows = [("".join(rnd.choices(a, k=30)), g) for g, a in alphabets.items() for _ in range(4)]
    model = language_id.fit([(language_id.presence(t), g) for t, g in rows])
    fresh = [("".join(rnd.choices(a, k=30)), g) for g, a in alphabets.items()]
    assert model.predict([t for t, _ in fresh])[0] == [g for _, g in fresh]


def test_presence_of_very_long_texts(monkeypatch):
    text = "".join(random.Random(4).choices("abcdé日 ", k=5000))
    want = language_id.presence(text)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert (language_id.presence(text) == want).all() and language_id.presence("").size == 0


def test_language_odd_rows(spark):
    rows = languages(4, 100)
    model = language_id.train(docs_of(spark, [*rows, (500, None, "aa"), (501, "", "aa"), (502, "x", None)]))
    docs = docs_of(spark, [(i, t, None) for i, t in ODD])
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(ODD) and all(0 <= r._lang_score <= 1 for r in out)
    assert all(r._lang != 'und' for r in out if r.doc_id in (None, 5, 6))
    assert {r._lang for r in out if r.text is None or r.doc_id in (2, 3, 4)} == {"und"}
    assert language_id.identify(docs, language_id.train(docs.where("false"))).where("_lang <> 'und'").count() == 0
    assert language_id.identify(docs.where("false"), model).count() == 0
