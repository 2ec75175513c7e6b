"""Classifiers: held-out accuracy on made-up text, gradients' effect, and odd tables."""

import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import language_id, quality, subwords, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "le eau eux qu ê on tion é ai ou".split(), "es": "os ción ado que ar mi ez ñ co la".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def tables(spark):
    """Documents in three languages; toxic ones hold a bad word, low quality ones are decorated."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        lang = r.choice(list(SYLLABLES))
        words = prose(r, lang, r.randrange(5, 120)).split()
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.8)
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(r.randrange(len(words) + 1), r.choice(["idiot", "scumbag", "trash"]) + r.choice(["", ".", ","]))
        if not good:
            words = [w + r.choice(["%%%", "###", "$$$"]) for w in words]
        text = " ".join(words)
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, good, toxic))
    docs += [(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, "12 !? 34", None, None, 8), (None, "the end", "en", None, None), (1003, "word " * 60_000, "en", None, 5)]
    labels += [(None, 1, 1), (1000, None, None), (1001, 1, 0), (1004, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def both(spark):
    d, labels = tables(spark)
    return d.cache(), labels.cache()


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_toxicity(spark, both):
    d, labels = both
    model = toxicity.fit_toxicity(d, labels)
    score = {x.doc_id: x.score for x in toxicity.score_toxicity(d, model).collect()}
    assert len(score) == 605 and all(0 <= s <= 1 for s in score.values())
    want = {x.doc_id: x.toxic for x in labels.collect() if x.doc_id is not None and x.doc_id < 600}
    test = [i for i in want if held(i, 5, 0)]
    assert np.mean([(score[i] >= 0.5) == want[i] for i in test]) > 0.95
    table = subwords.WordTable(toxicity.split, model.rows)
    misspelt = model.scores(table, ["the reon idiots thon", "the reon idiott thon", "the reon heand thon"])
    assert misspelt[0] > 0.5 and misspelt[1] > 0.5 > misspelt[2]
    again = toxicity.fit_toxicity(d.repartition(7), labels.repartition(3))
    assert np.allclose(again.weights, model.weights)


def test_toxicity_of_long_and_cut_texts(both):
    model = toxicity.fit_toxicity(*both)
    table = subwords.WordTable(toxicity.split, model.rows)
    r = random.Random(1)
    clean = prose(r, "en", 4000)
    both_texts = model.scores(table, [clean, clean + " you idiot " + prose(r, "en", 4000)])
    assert both_texts[1] > 0.5 and both_texts[0] < both_texts[1]
    each = [float(model.scores(table, [t])[0]) for t in (clean, "", None, "idiot")]
    assert np.allclose(model.scores(table, [clean, "", None, "idiot"]), each)


def test_without_labels(spark, both):
    d, labels = both
    none = labels.limit(0)
    assert {x.score for x in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none)).collect()} == {1 / (1 + np.exp(30.0))}
    assert all(x.score < 1e-9 for x in quality.score_quality(d, quality.fit_quality(d, none)).collect())
    assert toxicity.score_toxicity(d.limit(0), toxicity.fit_toxicity(d.limit(0), none)).count() == 0


def test_languages(spark, both):
    d, _ = both
    model = language_id.fit_languages(d)
    found = {x.doc_id: x for x in language_id.identify_languages(d, model, keep=("source", "text")).collect()}
    want = {x.doc_id: x.lang for x in d.collect()}
    test = [i for i in want if i is not None and i < 600 and held(i, 4, 2)]
    assert np.mean([found[i].lang_pred == want[i] for i in test]) > 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].ambiguous for i in (1000, 1001, 1002))
    assert found[1003].text == "word " * 60_000 and all(0 <= x.score <= 1 for x in found.values())
    nobody = language_id.fit_languages(d.filter("lang IS NULL"))
    assert {x.lang_pred for x in language_id.identify_languages(d, nobody).collect()} == {"und"}
    one = language_id.fit_languages(d.filter("lang = 'en'"))
    assert {x.lang_pred for x in language_id.identify_languages(d, one).collect()} == {"en", "und"}


def test_many_languages(spark):
    """Over 400 languages, each of one letter of its own, in one plan."""
    rows = [(i, " ".join([chr(0x4E00 + i % 450) * 3] * 12), f"l{i % 450:03d}", "s", 47) for i in range(1800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.fit_languages(d)
    assert len(model.languages) == 450
    found = {x.doc_id: x.lang_pred for x in language_id.identify_languages(d, model).collect()}
    assert np.mean([found[i] == lang for i, _, lang, _, _ in rows]) > 0.95


def test_long_texts_are_fitted(spark):
    """A label that only texts of over 30 000 characters have."""
    rows = [(i, ("ugly " if i % 2 else "fine ") * 8000, i % 2) for i in range(40)]
    d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    score = {x.doc_id: x.score for x in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_samples_do_not_depend_on_order(spark):
    rows = [(i % 60, f"text {i}", i % 3) for i in range(180)]
    d, marks = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i % 60, i % 3) for i in range(180)], "doc_id long, y int")
    first, again = (subwords.labelled(x, y, "y", {0: 7, 2: 9}, lambda i: i >= 5) for x, y in ((d, marks), (d.repartition(7), marks.repartition(3))))
    assert first == again and 0 < len(first) <= 16
    assert len(subwords.labelled(d, marks, "y", 4, lambda i: i >= 0)) <= 12


def brute_toxicity(model, text):
    """The greatest mean over a text's windows, each word from its own n-grams, one by one."""
    every = toxicity.split(text or "")
    words = [w for k, w in enumerate(every) if not k or every[k - 1] != w]
    if not words:
        return 1 / (1 + np.exp(-model.bias))

    def value(w):
        framed = b"<" + w + b">"
        grams = [framed[i : i + n] for n in range(toxicity.LO, toxicity.HI + 1) for i in range(len(framed) - n + 1)]
        at = [zlib.crc32(w) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - toxicity.LOG2)]
        for g in grams:
            h = 0
            for b in g:
                h = (h * 0x100000001B3 + b + 1) % (1 << 64)
            at.append(((h ^ len(g)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.LOG2))
        return np.mean([model.weights[k] for k in at])

    values = [value(w) for w in words]
    size = min(toxicity.WINDOW, len(values))
    best = max(np.mean(values[k : k + size]) for k in range(len(values) - size + 1))
    return 1 / (1 + np.exp(-np.clip(best + model.bias, -30, 30)))


def test_toxicity_scores_equal_brute_force(both):
    model = toxicity.fit_toxicity(*both)
    r = random.Random(4)
    texts = [prose(r, "fr", n) for n in (1, 2, 3, 4, 5, 9, 30)] + ["a a a idiot", "", None, "l'idiot é " * 5, "scum bag"]
    table = subwords.WordTable(toxicity.split, model.rows)
    assert np.allclose(model.scores(table, texts), [brute_toxicity(model, t) for t in texts])


def test_language_scores_equal_brute_force(both):
    model = language_id.fit_languages(both[0])
    r = random.Random(4)
    texts = [prose(r, lang, 20) for lang in SYLLABLES] + ["a", "x", "12 b"]
    names, score, vague = model.predict(subwords.WordTable(language_id.split, model.rows), texts)
    for t, name, s, v in zip(texts, names, score, vague, strict=True):
        words = language_id.split(t)
        rows = [model.weights[subwords.ngrams([w], language_id.LO, language_id.HI, language_id.LOG2)[0]].mean(0) for w in words]
        margin = np.mean(rows, axis=0) + model.bias
        loss = [sum(np.log(1 + np.exp(-b * m)) for b, m in zip(code, margin, strict=True)) for code in model.code]
        order = np.argsort(loss, kind="stable")
        assert name == model.languages[order[0]] and np.isclose(s, np.exp(-loss[order[0]]) / np.sum(np.exp(-np.array(loss))))
        assert v == (loss[order[1]] - loss[order[0]] < language_id.GAP * model.code.shape[1])


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 20, 100])
def test_codewords_differ(k):
    code = language_id.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
    distance = (code.shape[1] - code @ code.T) // 2
    np.fill_diagonal(distance, 99)
    assert distance.min() >= (1 if k < 3 else 2 ** (k - 2) if k <= 5 else 4)


def test_quality(spark, both):
    d, labels = both
    model = quality.fit_quality(d, labels)
    score = {x.doc_id: x.score for x in quality.score_quality(d, model).collect()}
    want = {x.doc_id: x.quality for x in labels.collect() if x.doc_id is not None and x.doc_id < 600}
    test = [i for i in want if held(i, 5, 0)]
    assert len(score) == 605 and np.mean([(score[i] >= 0.3) == want[i] for i in test]) > 0.95


def test_factorisation_identity():
    """Scores in linear time equal the sum over all pairs of features."""
    r = random.Random(2)
    texts = [prose(r, "en", 12), "a a b", "", "X!! y"]
    d, f, x, stats = quality.features(subwords.WordTable(quality.split, quality.word_rows), texts, [3, None, 0, 5])
    rng = np.random.default_rng(0)
    width = quality.WORDS + quality.SHAPES + quality.STATS
    model = quality.QualityModel(rng.normal(size=width), rng.normal(size=(width, quality.RANK)), 0.3, stats.mean(0), stats.std(0) + 1e-3)
    logits, _ = model.logits(d, f, x, stats)
    dense = model._dense(stats)
    for i in range(len(texts)):
        at = np.concatenate([f[d == i], np.arange(quality.STATS) + width - quality.STATS])
        v = np.concatenate([x[d == i], dense[i]])
        pairs = sum(v[a] * v[b] * (model.factors[at[a]] @ model.factors[at[b]]) for a in range(len(at)) for b in range(a))
        assert np.isclose(logits[i], 0.3 + v @ model.linear[at] + pairs)


def test_ngrams_in_blocks(monkeypatch):
    words = [b"the", b"\xc3\xa9t", b"", b"x" * 300, b"ab"]
    whole = subwords.ngrams(words, 2, 4, 12)
    table = np.random.default_rng(0).normal(size=(1 << 12, 3))
    mean = subwords.means(table, *whole)
    monkeypatch.setattr(subwords, "BLOCK", 16)
    parts = subwords.ngrams(words, 2, 4, 12)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert np.allclose(subwords.means(table, *parts), mean)
    assert whole[1].tolist() == [1 + 4 + 3 + 2, 1 + 4 + 3 + 2, 1 + 1, 1 + 301 + 300 + 299, 1 + 3 + 2 + 1]


def test_words_are_forgotten(monkeypatch, both):
    model = toxicity.fit_toxicity(*both)
    table = subwords.WordTable(toxicity.split, model.rows)
    texts = ["the idiot ran", "a quiet line", None]
    want = [model.scores(table, [t])[0] for t in texts]
    monkeypatch.setattr(subwords, "MAX_WORDS", 1)
    assert [model.scores(table, [t])[0] for t in texts] == want
