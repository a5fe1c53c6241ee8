import itertools
import random
import zlib

import numpy as np

from blurframe.llm import language, queries

WORDS = {"en": "the of and to in that with from this have", "de": "der die und ist nicht auf mit eine werden auch", "fr": "le les des une est dans pour que avec sont"}


def corpus(n=240):
    langs = [sorted(WORDS)[i % 3] for i in range(n)]
    return [" ".join(WORDS[lang].split()[(i + j * 7) % 10] for j in range(30)) for i, lang in enumerate(langs)], langs


def test_predictions(docs, odd):
    texts, langs = corpus()
    rows = {r["doc_id"]: r for r in language.identify(docs(texts + odd, langs=langs + [None] * len(odd))).collect()}
    assert len(rows) == len(texts) + len(odd)
    for i, lang in enumerate(langs):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i]["lang_pred"] == lang and 0 <= rows[i]["score"] <= 1
    for i, t in enumerate(odd):
        letters = any(c.isalpha() for c in t or "")
        assert (rows[len(texts) + i]["lang_pred"] == "und") == (not letters)


def test_mixture_names_both_languages(docs):
    texts, langs = corpus()
    profiles = language.fit_profiles(docs(texts, langs=langs))
    both = profiles.mixture(" ".join(texts[0:1] * 6 + texts[1:2] * 6))
    assert set(both) == {langs[0], langs[1]} and abs(sum(both.values()) - 1) < 1e-6 and min(both.values()) > 0.3
    assert list(profiles.mixture(texts[2])) == [langs[2]]


def many_languages(n=9):
    rng = random.Random(8)
    words = {f"l{i}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for i in range(n)}
    counts = np.zeros((n, language.BUCKETS))
    for i, lang in enumerate(sorted(words)):
        at, c = language.features(" ".join(rng.choice(words[lang]) for _ in range(3000)))
        counts[i, at] = c
    return words, language.Profiles.fit(sorted(words), counts)


def test_a_mixture_of_many_languages():
    words, profiles = many_languages()
    rng = random.Random(1)
    for n in (1, 3, 7, 9):
        langs = rng.sample(sorted(words), n)
        found = profiles.mixture(" ".join(rng.choice(words[lang]) for lang in langs for _ in range(60)))
        assert set(found) == set(langs) and all(abs(s - 1 / n) < 0.08 for s in found.values())


def test_the_set_is_that_of_all_sets_compared():
    """Against an independent expectation-maximisation for every set of languages."""
    words, profiles = many_languages(4)
    rng = random.Random(2)
    for _ in range(12):
        text = " ".join(rng.choice(words[rng.choice(sorted(words)[: rng.randrange(1, 5)])]) for _ in range(rng.randrange(3, 60)))
        at, counts = language.features(text)
        like = np.exp(profiles.log[at])
        values = {}
        for k in range(1, 5):
            for some in itertools.combinations(range(4), k):
                share = np.full(k, 1 / k)
                for _ in range(300):
                    resp = like[:, some] * share
                    resp /= resp.sum(axis=1, keepdims=True)
                    share = counts @ resp / counts.sum()
                values[some] = counts @ np.log(like[:, some] @ share) - (k - 1) * 0.5 * np.log(max(counts.sum(), 2)) * language.ORDER
        best = max(values, key=values.__getitem__)
        found = tuple(sorted(profiles.languages.index(x) for x in profiles.mixture(text)))
        assert values[found] >= values[best] - 0.5


def test_labels_of_held_out_rows_teach_nothing(docs):
    texts, langs = corpus()
    wrong = ["xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang for i, lang in enumerate(langs)]
    assert "xx" not in {r["lang_pred"] for r in language.identify(docs(texts, langs=wrong)).collect()}
    empty = language.identify(docs(["some text"], langs=[None])).collect()
    assert empty[0]["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_mixture(spark, sf).join(truth, "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95
