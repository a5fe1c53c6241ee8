import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blurframe.llm import quality


def slow(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    times = Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.encode().split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c#", "\n", "café", "  ", "a b c d e f g h\n", "\x85", " "]), max_size=60))
def test_counts_equal_brute_force(parts):
    text = " ".join(parts)
    assert quality.measure(text.encode()) == slow(text)


def test_odd_rows_and_verdicts(docs, odd):
    out = {r["doc_id"]: r for r in quality.judge(docs(odd)).collect()}
    assert len(out) == len(odd)
    for i, t in enumerate(odd[:-1]):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == slow(t)[:3]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert out[9]["n_repeat_words"] == 30000 and out[9]["base_failed"]
    assert quality.judge(docs([])).count() == 0


def test_hosts(docs):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(9999)) for _ in range(40))
    good = [text() for _ in range(60)]
    bad = ["spam " * 40 for _ in range(40)]
    texts = good + bad + [text(), text()]
    sources = ["fine"] * 60 + ["junk"] * 40 + ["junk", None]
    out = {r["doc_id"]: r for r in quality.judge(docs(texts, sources)).collect()}
    assert all(out[i]["kept"] for i in range(60))
    assert not out[60]["kept"]
    assert not out[100]["base_failed"] and not out[100]["kept"]  # falls with its host
    assert out[101]["kept"]  # a host of one document is not judged by it alone
    kept = quality.keep_good(docs(texts, sources))
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if r["kept"]}
    flags = docs(texts, sources).select(F.col("source").alias("host"), *[F.lit(False).alias(r) for r in quality.RULES])
    assert quality.host_verdicts(flags).where("host_bad").isEmpty()
