"""Language identification: against a plain scorer, on held-out documents with and without known words, and by case."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import langid
from tests.llm import awkward

ROWS = [(r[0], r[1] or "") for r in awkward.rows()]


def v(*x):
    return np.array(x, float)


def plain_score(word: str, words: dict, grams: list[dict]) -> np.ndarray | None:
    """The method word by word: a known word, else the mean of its longest n-grams, each unknown one the mean of its two parts."""
    if len(word) <= langid.LONGEST and word in words:
        return words[word]

    def of(gram: str):
        if gram in grams[len(gram) - 1]:
            return grams[len(gram) - 1][gram]
        parts = [p for p in (of(gram[:-1]), of(gram[1:])) if p is not None] if len(gram) > 1 else []
        return np.mean(parts, 0) if parts else None

    padded = f"<{word}>"
    n = min(len(grams), len(padded))
    known = [x for i in range(len(padded) - n + 1) if (x := of(padded[i : i + n])) is not None]
    return np.mean(known, 0) * langid.WEIGHT if known else None


def plain_shares(text: str, languages: list, words: dict, grams: list[dict]) -> np.ndarray:
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not runs:
        return np.zeros(len(languages))
    weights = [max(1.0, len(w) / langid.LONGEST) for w in runs]
    scores = [s if (s := plain_score(w, words, grams)) is not None else np.zeros(len(languages)) for w in runs]
    mean = sum(s * w for s, w in zip(scores, weights, strict=True)) / sum(weights) * min(sum(weights), 20)
    share = np.exp(mean - mean.max())
    return share / share.sum()


@pytest.mark.parametrize("places", [7, 1 << 17])
def test_scores_are_those_of_the_plain_method(monkeypatch, places):
    draw = random.Random(3)
    piece = lambda n: "".join(draw.choice("abcdeé<") for _ in range(n)).replace("<", "")
    value = lambda: -np.array([draw.random() * 9 for _ in range(3)])
    words = {w: value() for _ in range(30) if (w := piece(draw.randint(1, 5)))}
    grams = [{g: value() for _ in range(n * 6) if len(g := "".join(draw.choice("abcde<>") for _ in range(n))) == n} for n in (1, 2, 3, 4)]
    grams[0].pop("e", None)
    model = langid.Model.of(["x", "y", "z"], words, grams)
    texts = [" ".join(piece(draw.choice([1, 2, 4, 9, 70])) for _ in range(draw.randint(0, 12))) + draw.choice([" Ab!", "", " 12"]) for _ in range(80)] + ["", None, "e", "ÉÉ e", "a" * 5000 + "b"]
    monkeypatch.setattr(langid, "PLACES", places)
    got = model.shares(texts)
    expected = np.stack([plain_shares(t or "", model.languages, words, grams) for t in texts])
    assert np.allclose(got, expected, atol=1e-4)


def test_language(spark):
    got = langid.identify(awkward.table(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (60, 61, 62, 63, 66))
    assert langid.identify(awkward.empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward.table(spark), langid.learn(awkward.empty(spark))).collect()} == {"und"}


@pytest.mark.parametrize("n_words", [10_000, 0])
def test_held_out_accuracy(spark, n_words):
    """Over held-out documents alone; without a table of words every one is scored by backoff."""
    draw = random.Random(7)
    stems = {"x": ["strand", "feder", "kugel", "licht"], "y": ["plage", "monde", "rivière", "oiseau"]}
    rows = [(i, " ".join(draw.choice(stems[k]) + draw.choice("aeiou") * draw.randint(0, 3) for _ in range(6)), k) for i in range(300) for k in ["xy"[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where(langid.learned_from(docs["doc_id"])), n_words=n_words)
    assert bool(len(model.words.hashes)) == bool(n_words)
    held = {i: k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert len(held) > 50 and sum(got[i] == k for i, k in held.items()) >= 0.98 * len(held)


def test_counts_of_words_and_ngrams(spark):
    """Every key of length n has n code points, and counts are those of whole words and runs."""
    run = "ab" * 40 + "cd" * 50 + "e"
    docs = spark.createDataFrame([("Où où été", "x"), (run, "x"), ("zz 1 zz", "y")], "text string, lang string")
    got = {(r.length, r.key, r.lang): r.n for r in langid.counts(docs).collect()}
    assert all(len(key) == length for length, key, _ in got if length)
    expected = Counter()
    for text, lang in [("où où été", "x"), (run, "x"), ("zz zz", "y")]:
        for word in text.split():
            if len(word) <= langid.LONGEST:
                expected[0, word, lang] += 1
            padded = f"<{word}>"
            expected.update((n, padded[i : i + n], lang) for n in range(1, 5) for i in range(len(padded) - n + 1))
    assert got == dict(expected)


def test_each_language_keeps_its_own_keys(spark):
    rows = [(i, " ".join(f"{c}{d}" for c in "abcdefgh" for d in "stuv"), "big") for i in range(9)] + [(99, "zz yy xx", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, n_words=10)
    assert len(model.words.hashes) == 13
    assert model.shares(["zz yy xx"])[0].argmax() == 1
    assert math.isclose(model.words.values[:, 1].max(), math.log(1 / 3 + langid.FLOOR), rel_tol=1e-5)


def test_signs_are_not_letters(spark):
    model = langid.learn(awkward.table(spark))
    docs = spark.createDataFrame([(1, "½ ² ③"), (2, "½ the")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(docs, model).collect()} == {1: True, 2: False}
    assert [r.doc_id for r in langid.keep_identified(docs, model).collect()] == [2]


def test_ties_go_to_the_first_language(spark):
    model = langid.Model.of(["x", "y"], {"same": v(-2, -2)}, [{"q": v(-3, -3)}])
    docs = spark.createDataFrame([(1, "same"), (2, "qq"), (3, "unknown letters")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("x", 0.5)}


def test_long_runs_count_whole(spark):
    """Text without spaces: what follows the first 64 letters counts."""
    model = langid.Model.of(["x", "y"], {}, [{"a": v(-1, -9), "b": v(-9, -1)}])
    docs = spark.createDataFrame([(1, "a" * 64 + "b" * 3000), (2, "b" * 64 + "a" * 3000), (3, "aaa " * 5 + "b" * 3000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "y", 2: "x", 3: "y"}


def test_all_keys_of_the_sample_are_kept_on_request(spark):
    """None keeps every key, as a number beyond all of them does; ten leave some out."""
    rows = [(i, " ".join(f"{a}{b}{'xyz'[i % 3]}" for a in "abcdefg" for b in "hijkl"), "one" if i % 2 else "two") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every, many, few = (langid.learn(docs, n_words=n, n_grams=n) for n in (None, 10**6, 10))
    for a, b, c in zip([every.words, *every.grams], [many.words, *many.grams], [few.words, *few.grams], strict=True):
        assert (np.sort(a.hashes) == np.sort(b.hashes)).all() and len(c.hashes) <= len(a.hashes)
    assert len(every.words.hashes) == 105 > len(few.words.hashes)
    mixed = langid.learn(docs, n_words=None, n_grams=10)
    assert len(mixed.words.hashes) == 105 and len(mixed.grams[1].hashes) < len(every.grams[1].hashes)
