import math
import zlib

import numpy as np
import pytest

from quireflow.llm import langid

from conftest import sentence

GERMAN = "der die und das ist nicht ein eine zu mit auf für von den dem sich auch werden über größer".split()


def german(k):
    rng = np.random.default_rng(k)
    return " ".join(GERMAN[x] for x in rng.integers(0, len(GERMAN), 30)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, sentence(k) if k % 2 else german(k), "en" if k % 2 else "de", "s", "x", "x") for k in range(400)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, score STRING, rejected STRING")


@pytest.fixture(scope="module")
def model(corpus):
    return langid.train(corpus)


def test_letters():
    s = lambda t: "".join(map(chr, langid.letters(t)))
    assert s("Ab, c1d!") == " ab c d " and s("ÄÖ") == " äö " and s("1 2") == "" and s(None) == "" and s("\U00010400x") == " \U00010428x "


def test_probabilities_sum_to_one():
    counts = langid.Counter("".join(x) for t in ("abcab", "abd", "cab") for x in zip(*[("\x02\x02" + t)[k:] for k in range(3)], strict=False))
    m = langid.KneserNey(counts, 3, 5)
    for context in ("\x02\x02", "ab", "zz", "ca", "b", ""):
        known = sum(m.prob(context + c) for c in "abcd")
        assert known + m.prob(context + "?") == pytest.approx(1)


def test_arrays_agree_with_the_model(corpus):
    counts = {x: langid.Counter("".join(g) for t in ts for g in zip(*[("\x02\x02\x02" + "".join(map(chr, langid.letters(t))))[k:] for k in range(4)], strict=False)) for x, ts in (("a", [sentence(1), sentence(2)]), ("b", [german(1), german(2)]))}
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    models = {x: langid.KneserNey(c, 4, alphabet) for x, c in counts.items()}
    fitted = langid.fit(counts)
    texts = [sentence(9) + " ẞ xyz", german(5), None, "", "q" * 3000]
    for t, (n, h) in zip(texts, langid.Scorer(fitted)(iter(texts)), strict=True):
        c = "".join(map(chr, langid.letters(t)))
        assert n == len(c)
        for k, x in enumerate(("a", "b")):
            padded = "\x02\x02\x02" + c
            want = -sum(math.log(models[x].prob(padded[j : j + 4])) for j in range(n)) / max(n, 1)
            assert h[k] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_cache_collisions_do_not_matter(corpus, model, monkeypatch):
    texts = [sentence(k) + german(k) for k in range(20)]
    want = [h for _, h in langid.Scorer(model)(iter(texts))]
    monkeypatch.setattr(langid, "CACHE", 1 << 4)
    assert np.allclose(want, [h for _, h in langid.Scorer(model)(iter(texts))], rtol=1e-5)


def test_held_out_accuracy_and_columns(corpus, model):
    rows = langid.predict(corpus, model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in held)
    assert not any(r.rejected for r in rows)


def test_rejection(spark, model):
    texts = ["qxz vkj wqpzx kkqjx zzxqv jqkxw qqzx vvkxj wzqx kqjz xvvq zqkw pqx jzk", "123 !?", None, "The of and", german(3), "", "Ж" * 80]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING"), model).orderBy("doc_id").collect()
    assert [r.rejected for r in got] == [True, True, True, False, False, True, True]
    assert [r.lang_pred for r in got[1:3]] == ["und", "und"] and got[3].lang_pred == "en" and got[4].lang_pred == "de"


def test_held_out_text_is_not_learnt_from(corpus, model):
    from pyspark.sql import functions as F

    changed = corpus.withColumn("text", F.when(langid.held_out(F.col("doc_id")), "zzz").otherwise(F.col("text")))
    again = langid.train(changed)
    assert all(np.array_equal(a, b) for x, y in zip(model["tables"], again["tables"], strict=True) for a, b in zip(x, y, strict=True)) and again["calibration"] == model["calibration"]


def test_odd_and_empty(odd, empty, model):
    got = langid.predict(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"en", "und"}
    assert langid.predict(empty).count() == 0 and langid.accepted(empty).count() == 0
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.filter("text IS NULL").count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "text", None)], "doc_id LONG, text STRING, lang STRING")
    assert [(r.lang_pred, r.rejected) for r in langid.predict(d).collect()] == [("und", True)]


def test_equal_texts_wherever_they_stand(model):
    """A text's cross-entropies do not depend on the texts around it."""
    t = german(3) + " " + sentence(4)
    runs = [[t], [sentence(1)] * 7 + [t], [None, "x", t, sentence(2)], [sentence(5, 4000), t]]
    got = [[h.tolist() for _, h in langid.Scorer(model)(iter(r))][r.index(t)] for r in runs]
    assert all(h == got[0] for h in got)


def test_whole_query_by_brute_force(corpus, model):
    """Each document's language, score and rejection from probabilities in dictionaries, on the query's own sample."""
    rows = langid.sample(corpus, langid.DOCS_PER_LANGUAGE).collect()
    grams = {}
    for r in rows:
        if not r.calibrate:
            t = "\x02\x02\x02" + "".join(map(chr, langid.letters(r.text)))
            grams.setdefault(r.lang, langid.Counter()).update(t[k : k + 4] for k in range(len(t) - 3))
    alphabet = len({g[-1] for c in grams.values() for g in c}) + 1
    models = {x: langid.KneserNey(c, 4, alphabet) for x, c in grams.items()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    for r in langid.predict(corpus, model).collect():
        t = "".join(map(chr, langid.letters(texts[r.doc_id])))
        padded = "\x02\x02\x02" + t
        h = {x: -sum(math.log(m.prob(padded[k : k + 4])) for k in range(len(t))) / len(t) for x, m in models.items()}
        best = min(sorted(h), key=h.get)
        assert r.lang_pred == best and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.cross_entropy == pytest.approx(h[best], rel=1e-4)
        assert r.score == pytest.approx(1 / sum(math.exp(-(x - h[best]) * min(len(t), langid.EVIDENCE)) for x in h.values()), rel=1e-3)
        mean, mixed = model["calibration"][best]
        assert r.rejected == (h[best] > (mean + mixed) / 2 and (h[best] - mean) * min(len(t), 400) ** 0.5 > langid.WIDTH)
