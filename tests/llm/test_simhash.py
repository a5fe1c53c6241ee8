import random

import pytest
import xxhash
from pyspark.sql import functions as F

from blurframe.llm import simhash
from blurframe.llm.components import connected_components


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(prints):
    """Smallest doc_id reachable over links of 2 bits or fewer."""
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_fingerprints(docs, odd):
    out = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs(odd)).collect()}
    assert out == {i: slow_print(t) for i, t in enumerate(odd)}


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_keep_the_components(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = set(base)
    for b in base:
        for _ in range(15):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(fps, bucket)).collect()}
    want = slow_classes({signed(x): x for x in prints})
    got = {signed(x): roots.get(signed(x), signed(x)) for x in prints}
    assert len({(want[x], got[x]) for x in got}) == len(set(want.values())) == len(set(got.values()))


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 201: 200} | {k: v for k, v in out.items() if k == v}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_what_stays(docs, odd):
    df = docs(odd + ["Two Words", None])
    out = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert out == slow_classes({i: slow_print(t) for i, t in enumerate(odd + ["Two Words", None])})
    kept = simhash.keep_first(df.union(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(out.values())) and kept.columns == df.columns
    nulls = docs(["same text here", "same text here"], ids=[None, 5])
    assert [r["component_id"] for r in simhash.classes(nulls).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [5, 5]
    assert simhash.classes(docs([])).count() == 0
